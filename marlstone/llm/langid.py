"""Language identification by the nearest of several TF-IDF centroids per language.

A text is the vector of its hashed byte n-grams (1 to 3 bytes, A-Z lower-cased, ASCII bytes that aren't letters turned
into single spaces): the counts' logarithms times the inverse document frequencies, of length one. Each language has up to
``clusters`` centroids from spherical k-means. A text gets the language of the centroid with the greatest cosine. A centroid
with less than the share ``FOUNDED`` of its language's texts (one text of junk can be a centroid) can't vouch for a text: it
is rejected if its cosine to the nearest of the others is below ``slack`` times the least that training texts of its length
have but for one in two hundred.

For that, the training texts of each language are cut to the lengths ``LENGTHS``, and each half of them is held against
centroids of the other half, as new texts are. A text counts as the greatest of these lengths that is not longer than itself:
shorter texts have lower cosines. A centroid with fewer than ``OWN`` texts of a length has the limit of its language, and a
length that too few texts reach (``OWN``, or half of them) has that of the length before.

The model is fitted on a bounded sample: at most ``per_language`` texts of a language, those with the smallest hash of
doc_id and text, at most ``SAMPLE`` in all; rows that share both count once, and rows without doc_id are drawn as others are.
Prediction reads whole texts of all rows and nothing but the text.

A null text, or one without letters, is ``und`` with score 0 and rejected. With no rows to learn from, every text is.
Repeated rows are predicted alike; ties go to the first centroid in order of languages.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import LOWER, lean, text_bytes

DIMENSIONS, CLUSTERS, PER_LANGUAGE, SAMPLE, SLACK = 4096, 4, 800, 4000, 1.0
LENGTHS, OWN, REST, FOUNDED = tuple(1 << i for i in range(3, 13)), 200, 0.005, 0.01
SHAPE = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in LOWER)
UNKNOWN = "und"


def counts(data: bytes, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Hashed counts of a text's byte n-grams."""
    b = np.frombuffer(b" " + b" ".join(data.translate(SHAPE).split()) + b" ", np.uint8).astype(np.uint32)
    grams = [b, b[:-1] << 8 | b[1:] | 1 << 24, b[:-2] << 16 | b[1:-1] << 8 | b[2:] | 2 << 24]
    hashed = np.concatenate(grams) * np.uint32(2654435761) >> np.uint32(32 - dimensions.bit_length() + 1)
    return np.bincount(hashed, minlength=dimensions)


def length_class(n: int) -> int:
    """The greatest of LENGTHS that is at most n."""
    return max(0, bisect.bisect_right(LENGTHS, n) - 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12).astype(x.dtype)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]  # of each centroid
    floors: np.ndarray  # the least cosine that each centroid accepts, by length
    founded: np.ndarray  # which centroids stand for enough texts to accept one

    def predict(self, data: bytes | None) -> tuple[str, float, bool]:
        """Language, cosine and whether the text is rejected."""
        if not data or not len(self.centroids) or not any(map(str.isalpha, data.decode())):
            return UNKNOWN, 0.0, True
        found = counts(data, len(self.idf))
        cosines = self.centroids @ unit(np.log1p(found) * self.idf).astype(np.float32)
        best = int(cosines.argmax())
        score = min(1.0, max(0.0, float(cosines[best])))
        near = int(np.where(self.founded, cosines, -1).argmax())
        return self.languages[best], score, bool(cosines[near] < self.floors[near, length_class(int(found.sum()) // 3)])


def clustered(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from the vector nearest to the mean and then the ones farthest from those chosen."""
    chosen = [int((x @ unit(x.mean(axis=0))).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    centres = x[chosen]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        centres = unit(np.stack([x[own == i].mean(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))]))
    return centres


def limits(texts: list[bytes], x: np.ndarray, idf: np.ndarray, centres: np.ndarray, clusters: int) -> np.ndarray:
    """The least cosine of a language's texts cut to each of LENGTHS but for the share REST, for each centre. The cosines
    of each half of the texts are those to centroids of the other half, as new texts have them."""
    halves = [np.arange(i, len(texts), 2) for i in (0, 1)]
    others = [founded_only(x[h], clustered(x[h], clusters)) if len(h) else centres for h in reversed(halves)]
    best = (x @ centres.T).argmax(axis=1)
    out = np.zeros((len(centres), len(LENGTHS)))
    for i, length in enumerate(LENGTHS):
        near = np.full(len(texts), np.nan)
        for half, other in zip(halves, others, strict=True):
            for t in half:
                if i == 0 or len(texts[t]) >= length:
                    near[t] = (other @ unit(np.log1p(counts(texts[t][:length], len(idf))) * idf).astype(np.float32)).max()
        told = ~np.isnan(near)
        if i:
            out[:, i] = out[:, i - 1]  # where too few texts are as long
        if i == 0 or told.sum() >= min(OWN, len(texts) / 2):
            for j in range(len(centres)):
                own = near[told & (best == j)]
                out[j, i] = np.quantile(own if len(own) >= OWN else near[told], REST) - 1e-6
    return out


def well_founded(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Which centres are the nearest of at least the share FOUNDED of x."""
    return np.bincount((x @ centres.T).argmax(axis=1), minlength=len(centres)) >= max(1, FOUNDED * len(x))


def founded_only(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return centres[well_founded(x, centres)]


def fit_rows(texts: list[bytes], languages: list[str], clusters: int = CLUSTERS, slack: float = SLACK, dimensions: int = DIMENSIONS) -> Model:
    x = np.zeros((len(texts), dimensions), np.float32)
    for i, t in enumerate(texts):
        x[i] = np.log1p(counts(t, dimensions))
    idf = (np.log((1 + len(texts)) / (1 + np.count_nonzero(x, axis=0))) + 1).astype(np.float32)
    x *= idf  # in place: the sample's vectors are most of the driver's memory
    for row in x:
        row /= max(float(np.linalg.norm(row)), 1e-12)
    names, centroids, floors, founded = [], [], [], []
    told = np.array(languages)
    for language in sorted(set(languages)):
        own = x[told == language]
        centres = clustered(own, clusters)
        founded += list(well_founded(own, centres))
        names += [language] * len(centres)
        centroids += list(centres)
        floors += list(slack * limits([t for t, name in zip(texts, languages, strict=True) if name == language], own, idf, centres, clusters))
    return Model(idf, np.array(centroids, np.float32).reshape(-1, dimensions), names, np.array(floors).reshape(-1, len(LENGTHS)), np.array(founded, bool))


def fit(rows: DataFrame, clusters: int = CLUSTERS, per_language: int = PER_LANGUAGE, slack: float = SLACK) -> Model:
    """rows: doc_id, text and lang of labelled documents, of which the bounded sample is taken."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"))), 1, 8), 16, 10)
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select(F.col("lang").cast("string").alias("lang"), text_bytes().alias("text"), drawn.cast("long").alias("draw"))
    found = {r[0]: r[1] for r in known.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n"), F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(SAMPLE).collect()}
    if not found:
        return fit_rows([], [], clusters, slack)
    quota = max(1, min(per_language, SAMPLE // len(found)))
    # a hash below the share is drawn; twice as many as are needed pass, and all of a language with few
    share = F.element_at(F.create_map(*(x for lang, n in found.items() for x in (F.lit(lang), F.lit(min(1.0, (2.2 * quota + 60) / max(n, 1)))))), F.col("lang"))
    few = known.where(F.col("draw") <= share * float(1 << 32)).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy("draw")
    sample = few.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= quota)
    taken = [(r[0], bytes(r[1])) for r in sample.select("lang", "text").orderBy("lang", "nth").toLocalIterator() if r[1] and any(map(str.isalpha, r[1].decode()))]
    return fit_rows([t for _, t in taken], [lang for lang, _ in taken], clusters, slack)


def predict(docs: DataFrame, model: Model, *columns: str, text: str = "text", with_text: bool = False) -> DataFrame:
    """The given columns of docs, the text if asked for, then lang_pred, score and rejected. The text goes to Python once,
    as bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*columns, text_bytes(text).alias("__text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(x.as_py()) for x in b.column(b.num_columns - 1)]
            made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            last = b.num_columns if with_text else b.num_columns - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:last], *made], [*b.schema.names[:last], "lang_pred", "score", "rejected"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema][: None if with_text else -1]
    return kept.mapInArrow(lean(rows), ", ".join([*fields, "lang_pred string, score double, rejected boolean"]))


def held_out():
    """True for the rows that are never learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is recognised, all columns as they are; learns from the labelled rows of docs
    outside the held-out third."""
    model = fit(docs.where(F.coalesce(~held_out(), F.lit(True))))
    other = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in other.items()), F.col("text"))
    marked = predict(plain, model, *other.values(), with_text=True).where(~F.col("rejected"))
    return marked.select(*(F.col(other[c]).alias(c) if c in other else F.col("__text").cast("string").alias(c) for c in docs.columns))
