import base64
import math
import random

import pytest

from marlstone.llm import langid
from marlstone.llm.entry import op10_language


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_language(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and 0.2 < len(held) / len(rows) < 0.47
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.02 * len(rows)


def test_defined_results(spark, table):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    model = langid.fit(table(train))
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the dog and the cat"), (5, "die katze und der hund"), (None, "日本語" * 9000)]
    out = {r.doc_id: (r.lang_pred, r.rejected) for r in langid.predict(table(rows), model, "doc_id").collect()}
    assert out[1] == out[2] == out[3] == ("und", True) and out[4] == ("en", False) and out[5] == ("de", False)
    assert out[None][0] in ("en", "de") and out[None][1]  # Japanese is told apart from what was learned
    nothing = langid.fit(table([(1, "text", None), (2, None, "en")]))
    assert [tuple(r) for r in langid.predict(table([(1, "some text")]), nothing, "doc_id").collect()] == [(1, "und", 0.0, True)]
    assert langid.accepted(table([])).count() == 0


def test_no_language_vanishes(spark, table):
    """Many rows of one doc_id, or without any, are drawn as others are; a text that repeats counts once."""
    rows = [(7, f"eins zwei drei nummer {i} und noch ein wort", "de") for i in range(3000)]
    rows += [(None, f"one two three number {i} and one more word", "en") for i in range(3000)]
    rows += [(8, "uno dos tres", "es")] * 3000 + [(i, f"un deux trois {i}", "fr") for i in range(4)]
    model = langid.fit(table(rows), per_language=50)
    assert sorted(set(model.languages)) == ["de", "en", "es", "fr"] and model.languages.count("es") == 1
    assert [model.predict(t)[0] for t in (b"eins zwei drei", b"one two three", b"uno dos tres", b"un deux trois")] == ["de", "en", "es", "fr"]


def slow_vector(text, idf):
    """Hashed byte n-grams of 1 to 3 bytes as they are defined, one by one."""
    data = text.encode()
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    data = b" " + b" ".join(bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in data).split()) + b" "
    found = {}
    for n in (1, 2, 3):
        for i in range(len(data) - n + 1):
            code = int.from_bytes(data[i : i + n], "big") + ((n - 1) << 24)
            slot = (code * 2654435761 % (1 << 32)) >> (32 - 12)
            found[slot] = found.get(slot, 0) + 1
    vector = {k: math.log1p(c) * idf[k] for k, c in found.items()}
    length = math.sqrt(sum(x * x for x in vector.values()))
    return {k: x / length for k, x in vector.items()}


def test_nearest_centroid_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = langid.fit(docs)
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model, "doc_id").collect()}
    for doc_id, text in rows[:60]:
        if not text or not any(map(str.isalpha, text)):
            assert out[doc_id] == ("und", 0.0)
            continue
        vector = slow_vector(text, model.idf)
        cosines = [sum(x * centre[k] for k, x in vector.items()) for centre in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert out[doc_id][1] == pytest.approx(min(1.0, cosines[best]), abs=1e-4)
        assert out[doc_id][0] in {model.languages[i] for i, c in enumerate(cosines) if c > cosines[best] - 1e-4}


def test_sample_is_bounded_and_deterministic(spark, table):
    docs = table([(i, f"text number {i}", "en") for i in range(500)])
    a, b = langid.fit(docs, per_language=20), langid.fit(docs.repartition(5), per_language=20)
    assert (a.centroids == b.centroids).all() and len(a.centroids) <= langid.CLUSTERS


@pytest.mark.parametrize("names", [["lang_pred", "score"], ["__bytes", "rejected"]])
def test_accepted_keeps_columns(spark, names):
    docs = spark.createDataFrame([(i, "the cat and dog", "en", 1, 2) for i in range(30)] + [(99, "5", None, 1, 2)], f"doc_id long, text string, lang string, {names[0]} int, {names[1]} int")
    out = langid.accepted(docs)
    assert out.columns == docs.columns and out.count() == 30


def test_rejects_what_was_not_learned(spark):
    """Unlearned languages in Latin script and random text go; held-out documents of the learned ones stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r.text.encode() for r in docs.where(langid.held_out() & docs.text.isNotNull()).collect()]
    model = langid.fit(docs.where(~langid.held_out()))
    rng = random.Random(1)
    other = [
        "Suomen kieli kuuluu uralilaisten kielten itämerensuomalaiseen ryhmään, ja talvella järvet jäätyvät ja lapset luistelevat koko päivän.",
        "Język polski należy do grupy języków zachodniosłowiańskich. Wczoraj wieczorem poszliśmy do lasu, żeby zbierać grzyby, ale nic nie znaleźliśmy.",
        "Tiếng Việt là ngôn ngữ của người Việt. Hôm nay trời rất đẹp nên chúng tôi đi dạo quanh hồ và uống cà phê với bạn bè.",
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(400)),
        " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(60)),
        base64.b64encode(rng.randbytes(300)).decode(),
        rng.randbytes(300).hex(),
    ]
    for text in other:
        for times in (1, 8):
            assert model.predict(((text + " ") * times).encode())[2], text
    assert sum(model.predict(t)[2] for t in held) <= 0.03 * len(held)
    assert not any(model.predict(t)[2] for t in (b"Th", b"the and"))
