import hashlib
import random
import re
import time

import pytest

from marlstone.llm import pii
from marlstone.llm.entry import op7_personal_data


def slow_base(text):
    """The definitions as they stand, with plain searches."""
    text, found = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19:
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
            if sum(d // 10 + d % 10 for d in doubled) % 10 == 0:
                found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


TEXTS = [
    None,
    "",
    "mail a.b+c@x-y.co.uk. and é@x.de, @x.de a@b a@b.c@d.e x@@y.z a@b..c a@.b.c a@b.c.",
    "ip 1.2.3.4 256.1.1.1 1.2.3.4.5 001.002.003.004 1..2.3.4 1.2.3 9999.1.1.1.1 0.0.0.0",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111 1111 1111 12 5500005555555559x",
    "+1 (017) 555-7713 +123 ++4912345678901 +1.2.3.4.5.6.7.8.9.0.1.2.3.4.5.6 +49 (0) 30 123456 -",
    'é token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x',
    "a" * 30_000 + "@b.c " + "1" * 30_000 + "+1" * 2000 + " 1.2.3.4",
    "1.2.3.4@5.6.7.8 +11.22.33.44 4111111111111111@mail.com",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans(text):
    assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text or "")] == slow_base(text if len(text or "") < 20_000 else text)


def test_query(spark, sf):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_personal_data(spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        base = slow_base(text[r.doc_id])
        line = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(line).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS[:4]]
        assert set(line) <= set(r.spans.split(",")) | {""}
        starts = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert starts == sorted(starts)


def check_digits(country, account):
    digits = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{country}{98 - int(digits) % 97:02d}{account}"


def planted(n=600):
    """Texts with one planted span each, and clean ones that look a little like them."""
    rng, rows, want = random.Random(9), [], {}
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvz") for _ in range(rng.randint(2, 9)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    make = {
        "email": lambda: f"write to {word()}.{digits(2)}@{word()}.example.{rng.choice(['com', 'de', 'org'])}",
        "ip": lambda: f"login from {rng.randint(11, 120)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(1, 254)}",
        "number": lambda: f"{rng.choice(['card', 'visa', 'credit card'])} {rng.choice('45')}{digits(15)}",
        "secret": lambda: f'{rng.choice(["token", "api_key", "password"])} = "{hashlib.sha1(digits(9).encode()).hexdigest()[: rng.choice((20, 32, 40))]}"',
        "tel": lambda: f"{rng.choice(['call', 'phone', 'fax'])} ({rng.randint(201, 989)}) {rng.randint(200, 999)}-{digits(4)}",
        "iban": lambda: f"account {check_digits('DE', digits(18))}",
        "ssn": lambda: f"ssn {rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
    }
    for i in range(n):
        kind = [*make, None, None][i % 9]
        span = make[kind]() if kind else f"{word()} {rng.choice(['part 12-34', 'in 1999', 'of 3.14', 'build 1.2.3', 'see ' + word() * 5])}"
        rows.append((i, f"{word()} {word()} {span} {word()}, {word()}."))
        want[i] = kind
    return rows, want


def test_recall_on_planted_spans(spark, table):
    rows, want = planted()
    out = {r.doc_id: (r.spans, r.has_personal_data) for r in pii.personal_data(table(rows)).collect()}
    for kind in {k for k in want.values() if k}:
        ids = [i for i, k in want.items() if k == kind]
        named = {kind, "card"} if kind == "number" else {kind}  # one in ten passes the checksum
        assert sum(bool({s.split(":")[0] for s in out[i][0].split(",")} & named) for i in ids) >= 0.9 * len(ids), kind
    clean = [i for i, k in want.items() if k is None]
    assert not any(out[i][1] for i in clean) and all(has == bool(spans) for spans, has in out.values())
    assert pii.fitted({}) == {}


def test_long_secrets_and_many_candidates():
    text = "key = " + "aB3" * 100_000 + " end"
    assert [s for s in pii.more_candidates(text, []) if s[0] == 5] == [(5, 6, 6 + 300_000)]
    many = " ".join(f"a{i}@b.c no {i:016d}7 at 1.2.3.{i % 256} or (201) 555-{i % 10_000:04d}" for i in range(40_000))
    began = time.process_time()
    base = pii.base_spans(many)
    found = pii.more_candidates(many, base)
    assert time.process_time() - began < 20 and len(found) > 70_000
    spans = sorted([(a, b) for _, a, b in base if _ < 4] + [(a, b) for _, a, b in found])
    new = {(a, b) for _, a, b in found}
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False) if x in new or y in new)


def test_added_spans_by_brute_force():
    """A candidate is added if and only if nothing before it in the order of kinds overlaps it."""
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["1", "23", "456-78-9012", " ", "-", "a@b.c", "DE89370400440532013000", "+49 30 1234567", "(201) 555-0199", "x" * 21 + "7", "1.2.3.4", "4111 1111 1111 1112"]) for _ in range(12))
        base = pii.base_spans(text)
        tests = {4: lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and len(m) <= 40, 5: lambda m: re.search("[0-9]", m) and re.search("[A-Za-z]", m), 7: bool, 8: bool, 6: lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 12}
        taken, want = [s[1:] for s in base], []
        for kind, pattern in ((7, pii.IBAN), (4, pii.CARD), (5, pii.SECRET), (8, pii.SSN), (6, pii.TEL)):
            new = [m.span() for m in pattern.finditer(text) if tests[kind](m[0]) and not any(a < m.end() and m.start() < b for a, b in taken)]
            taken, want = taken + new, want + [(kind, *s) for s in new]
        assert pii.more_candidates(text, base) == want


def test_reliabilities_are_found():
    rng = __import__("random").Random(1)
    counts = {}
    for _ in range(4000):
        real = rng.random() < 0.4
        v = sum((rng.random() < (p if real else q)) << i for i, (p, q) in enumerate([(0.95, 0.1), (0.9, 0.2), (0.7, 0.05), (0.8, 0.5)]))
        counts[5, v, 2, 0, 1] = counts.get((5, v, 2, 0, 1), 0) + 1
    model = pii.fitted(counts)
    p = lambda v: model[5, v, 2, 0, 1]
    assert p(15) > 0.9 and p(0) < 0.1 and p(8) < 0.5 < p(7)


def test_empty_table_and_repeats(spark, table):
    assert pii.personal_data(table([])).count() == 0
    out = [tuple(r) for r in pii.personal_data(table([(1, "a@b.c"), (1, "a@b.c"), (None, None)])).collect()]
    assert len(out) == 3 and out.count(out[0]) == 2 and sorted(r[6] for r in out) == ["", "email:0:5", "email:0:5"]
