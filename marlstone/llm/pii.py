"""Personal data: weak-supervision labelers vote on candidate spans, expectation-maximisation weighs them.

Base spans (email, ip, card, phone) are matched and checked as they are defined and always stay. Candidates are the base
spans and wider ones that overlap none of them: card-like numbers of 12 to 19 digits that fail the checksum (``number``),
strings of 20 or more letters and digits (``secret``), phone numbers without a country code (``tel``), account numbers
(``iban``) and social security numbers (``ssn``). Four labelers vote on each candidate: a regex or rule of the strict form, a
gazetteer (issuer, country and calling codes, top domains, special networks), the words before it, and the characters
around it. Vote patterns are counted over all documents; a two-class model of independent labelers per kind is fitted to
the counts by expectation-maximisation, which gives each labeler's reliability. Its posteriors train the span classifier, a
logistic regression over kind, votes, and what no labeler looks at: length, shape and the word before the span, hashed. A
candidate that is no base span is added if the classifier's probability is 0.5 or more. Patterns are a bounded table: kinds
x 16 votes x lengths x shapes x word buckets.

Texts are read whole and once, in time that grows with their length. Null is empty and has no spans. Repeated rows are
scanned one by one. Ties in start go by the order of kinds, then by end. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import lean, written

KINDS = ("email", "ip", "card", "phone", "number", "secret", "tel", "iban", "ssn")
BASE_KINDS, LABELERS, LENGTH_CLASSES, SHAPES, BUCKETS = 4, 4, 4, 8, 8

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
# A match starts where a run of digits does: what precedes a later digit of the run would only lengthen it.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}")
TEL = re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,5}\)[\x20-]?|[0-9]{2,5}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z.-]?[0-9])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# What the gazetteer and the context labelers know. Issuer ranges are first and last leading digits; calling
# codes of one and two digits, and the zones of three-digit ones; an email's last label of two letters is a country's.
ISSUERS = [("4", "4"), ("34", "34"), ("37", "37"), ("50", "50"), ("51", "55"), ("56", "58"), ("300", "305"), ("36", "36"), ("38", "39"), ("2221", "2720"), ("3528", "3589"), ("6011", "6011"), ("62", "62"), ("644", "649"), ("65", "65"), ("67", "67")]
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
ZONES = ("21", "22", "23", "24", "25", "26", "29", "35", "37", "38", "42", "50", "59", "67", "68", "69", "80", "85", "87", "88", "96", "97", "99")
TOP_DOMAINS = {"aero", "app", "biz", "blog", "cloud", "club", "com", "coop", "dev", "edu", "email", "gov", "health", "info", "int", "jobs", "live", "mil", "mobi", "museum", "name", "net", "news", "online", "org", "page", "post", "pro", "shop", "site", "store", "tech", "tel", "travel", "work", "world", "xyz", "zone"}
IBAN_COUNTRIES = "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK".split()
NAMED = {
    "email": ("mail", "email", "contact", "write", "address", "adresse", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "client", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "paid", "carte", "karte", "kreditkarte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "telefono", "portable", "handy"),
    "number": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "account", "iban", "carte", "karte", "kreditkarte", "konto", "tarjeta", "cuenta"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "access_key", "bearer", "auth", "credential", "credentials"),
    "tel": ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "telefono", "portable", "handy"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank", "transfer"),
    "ssn": ("ssn", "social", "security", "tax", "id"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A match starts at the first of the local characters before an @, so it is sought from the @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.fullmatch(text, start - 1, start):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Kind, start, end of the base spans, by start and kind."""
    found = [(0, *span) for span in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m[0]) if m.end() - m.start() <= 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], s[0], s[2]))


def more_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that overlap no base span and none of a form that is sought before theirs."""
    kinds = [
        (7, (m.span() for m in IBAN.finditer(text))),
        (4, (m.span() for m in CARD.finditer(text) if m.end() - m.start() <= 40 and 12 <= sum(map(str.isdigit, m[0])) <= 19)),
        (5, (m.span() for m in SECRET.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]))),
        (8, (m.span() for m in SSN.finditer(text))),
        (6, (m.span() for m in TEL.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 12)),
    ]
    taken, found = sorted((a, b) for _, a, b in base), []
    for kind, spans in kinds:
        new, at, reach = [], 0, 0
        for a, b in spans:  # both ascend, so one pass over either tells what overlaps
            while at < len(taken) and taken[at][0] < b:
                reach = max(reach, taken[at][1])
                at += 1
            if reach <= a:
                new.append((a, b))
        found += [(kind, a, b) for a, b in new]
        taken = sorted(taken + new)
    return found


def issued(digits: str) -> bool:
    return any(low <= digits[: len(low)] <= high for low, high in ISSUERS)


def own_network(value: str) -> bool:
    """Not of a network kept for special use."""
    a, b, *_ = (int(p) for p in value.split("."))
    return a not in (0, 10, 127) and a < 224 and (a, b) not in ((169, 254), (192, 168)) and not (a == 172 and 16 <= b < 32)


def votes(text: str, kind: int, start: int, end: int) -> int:
    """A bit for each labeler: strict form, gazetteer, context before, characters around."""
    name, value = KINDS[kind], text[start:end]
    digits = "".join(c for c in value if "0" <= c <= "9")
    before = words_before(text, start)
    around = (text[start - 1] if start else " ") + (text[end] if end < len(text) else " ")
    strict = {
        "email": lambda: len(value) <= 254 and ".." not in value and value[0] != ".",
        "ip": lambda: all(p == str(int(p)) for p in value.split(".")),
        "card": lambda: len(digits) in (13, 15, 16),
        "phone": lambda: 10 <= len(digits) <= 13,
        "number": lambda: len(digits) in (15, 16) and bool(re.fullmatch(r"[0-9]+|[0-9]{4}(?:[\x20-][0-9]{4}){2,3}", value)),
        "secret": lambda: len(value) in (20, 32, 40, 64) or bool(re.search("[a-z]", value) and re.search("[A-Z]", value)),
        "tel": lambda: bool(re.fullmatch(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|\(?0[0-9]{1,4}\)?[\x20.-].+", value)),
        "iban": lambda: int("".join(str(int(c, 36)) for c in (value[4:] + value[:4]).replace(" ", ""))) % 97 == 1,
        "ssn": lambda: value[3:6] != "-00" and value[-4:] != "0000",
    }[name]()
    known = {
        "email": lambda: (last := value.rsplit(".", 1)[-1].lower()) in TOP_DOMAINS or len(last) == 2 and last.isalpha(),
        "ip": lambda: own_network(value),
        "card": lambda: issued(digits),
        "phone": lambda: digits.startswith(CALLING) or digits.startswith(ZONES),
        "number": lambda: issued(digits),
        "secret": lambda: len(set(value)) >= 10,
        "tel": lambda: digits[0] == "0" or digits[0] in "23456789" and len(digits) == 10,
        "iban": lambda: value[:2] in IBAN_COUNTRIES,
        "ssn": lambda: value[:3] not in ("000", "666") and value[0] != "9",
    }[name]()
    context = any(w in NAMED[name] for w in before)
    clear = all(c in " \n\t\"'.,;:!?|()[]<>=" for c in around)
    return strict | known << 1 | context << 2 | clear << 3


def words_before(text: str, start: int) -> list[str]:
    return re.findall(r"\w+", text[max(0, start - 40) : start].lower())[-3:]


def shape(text: str, start: int, end: int) -> int:
    """A bit each for a mark in front, separators inside, and letters."""
    value = text[start:end]
    return (start > 0 and text[start - 1] in "\"'=:(<[") | bool(re.search(r"[\x20().-]", value)) << 1 | bool(re.search("[A-Za-z]", value)) << 2


def bucket(text: str, start: int) -> int:
    before = words_before(text, start)
    return zlib.crc32(before[-1].encode()) % BUCKETS if before else 0


def fitted(counts: dict[tuple[int, ...], int], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """counts by kind, votes, length class, shape and word bucket. Returns the classifier's probability of each of them."""
    soft: dict[tuple[int, ...], float] = {}
    bits = (np.arange(1 << LABELERS)[:, None] >> np.arange(LABELERS)) & 1
    for kind in {k[0] for k in counts}:
        n = np.zeros(1 << LABELERS)
        for (k, v, *_), c in counts.items():
            n[v] += c * (k == kind)
        share, right = 0.5, np.stack([np.full(LABELERS, 0.3), np.full(LABELERS, 0.8)])  # P(vote | class)
        for _ in range(rounds):
            like = np.exp(bits @ np.log(right.T) + (1 - bits) @ np.log1p(-right.T)) * np.array([1 - share, share])
            post = like[:, 1] / like.sum(axis=1)
            for c, weight in enumerate((n * (1 - post), n * post)):
                right[c] = (weight @ bits + 1) / (weight.sum() + 2)
            share = (n @ post + 1) / (n.sum() + 2)
        for k in counts:
            if k[0] == kind:
                soft[k] = float(post[k[1]])
    if not counts:
        return {}
    keys = sorted(counts)
    widths = (LENGTH_CLASSES, SHAPES, BUCKETS)
    own = 1 + LABELERS
    x = np.zeros((len(keys), len(KINDS) * own + sum(widths)))
    for i, (k, v, *features) in enumerate(keys):
        x[i, k * own] = 1
        x[i, k * own + 1 : (k + 1) * own] = bits[v]
        at = len(KINDS) * own
        for feature, width in zip(features, widths, strict=True):
            x[i, at + feature] = 1
            at += width
    y, weight, beta = np.array([soft[k] for k in keys]), np.array([counts[k] for k in keys], float), np.zeros(x.shape[1])
    for _ in range(25):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        beta += np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * beta)
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    return dict(zip(keys, p.tolist(), strict=True))


def length_class(start: int, end: int) -> int:
    return min((end - start) // 16, LENGTH_CLASSES - 1)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, votes, size, shape, bucket, base) of every row."""
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.int32()), ("size", pa.int32()), ("shape", pa.int32()), ("bucket", pa.int32()), ("base", pa.bool_())])

    def scanned(text: str | None) -> list[dict]:
        if not text:
            return []
        base = base_spans(text)
        every = [(*s, True) for s in base] + [(*s, False) for s in more_candidates(text, base)]
        every.sort(key=lambda s: (s[1], s[0], s[2]))
        return [{"kind": k, "start": a, "end": e, "votes": votes(text, k, a, e), "size": length_class(a, e), "shape": shape(text, a, e), "bucket": bucket(text, a), "base": own} for k, a, e, own in every]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((scanned(x.as_py()) for x in b.column(1)), pa.list_(span))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(lean(rows), "doc_id long, spans array<struct<kind:int,start:bigint,end:bigint,votes:int,size:int,shape:int,bucket:int,base:boolean>>")


PATTERN = ("kind", "votes", "size", "shape", "bucket")


def personal_data(docs: DataFrame) -> DataFrame:
    """For each document the base kinds' counts, base_sha256, spans (``kind:start:end``, comma-joined), and whether there
    are any."""
    found = written(candidates(docs), "spans")
    patterns = found.select(F.explode("spans").alias("s")).groupBy(*(F.col(f"s.{c}").alias(c) for c in PATTERN)).count()
    model = fitted({tuple(r[:-1]): r[-1] for r in patterns.collect()})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = lambda spans: ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in spans)
        for b in batches:
            counts, digests, lines = [], [], []
            for spans in b.column(1).to_pylist():
                base = [s for s in spans if s["base"]]
                kept = [s for s in spans if s["base"] or model.get(tuple(s[c] for c in PATTERN), 0.0) >= 0.5]
                counts.append([sum(s["kind"] == k for s in base) for k in range(BASE_KINDS)])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                lines.append(joined(kept))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(BASE_KINDS)]
            columns += [pa.array(digests, pa.string()), pa.array(lines, pa.string()), pa.array([line != "" for line in lines], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", *(f"n_{k}" for k in KINDS[:BASE_KINDS]), "base_sha256", "spans", "has_personal_data"])

    return found.mapInArrow(lean(rows), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, has_personal_data boolean")
