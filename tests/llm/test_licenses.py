import re

import pytest

from marlstone.llm import licenses
from marlstone.llm.entry import op4_license_templates


def slow_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in hits}))


def test_base_against_brute_force(spark, sf):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op4_license_templates(spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == slow_base(text[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", "mit"),
        ("under the terms of the MIT license", "mit"),
        ("under the terms of MIT license", ""),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3", "gpl-3"),
        ("under the GNU Lesser General Public License version 3", "lgpl"),
        ("Copyright (c) 2019 Some One. All rights reserved.", "all-rights-reserved"),
        ("Licensed under the Apache License, Version 2.0", "apache-2,apache-2.0"),
        ("under the MIT lícense", ""),
        ("under the mit license under the mit license", "mit"),
        ("", ""),
        (None, ""),
        ("x " * 50_000 + "CC-BY-NC", "cc-by-nc"),
    ],
)
def test_templates(text, labels):
    found = licenses.Scanner().scan(text.encode() if text is not None else None)
    assert found[5] == labels and found[:5] == slow_base(text)


def test_automaton_against_regex():
    a = licenses.compiled("t", "a b <<optional>>c <<any 2>> d<<end>> e <<any 1>>")
    like = re.compile(r"a b(?: c(?: \w){0,2} d)? e(?: \w)?(?= |$)")
    import itertools

    for n in range(2, 8):
        for tail in itertools.product("cdex", repeat=n - 2):
            words = ["a", "b", *tail]
            ends = [i for i in range(1, n + 1) if like.fullmatch(" ".join(words[:i]))]
            assert a.longest([w.encode() for w in words], 0) == (max(ends) if ends else None)
    with pytest.raises(ValueError, match="mandatory"):
        licenses.compiled("t", "<<optional>>a<<end>> b")


def test_full_texts():
    """Regions may be left out or replaced; a change in mandatory wording leaves only the shorter templates."""
    scanner = licenses.Scanner()
    for label, template in licenses.TEMPLATES:
        regions = re.sub(r"<<any \d+>>", " Some One ", template)
        for text in (re.sub(r"<<(optional|end)>>", " ", regions), re.sub(r"<<optional>>.*?<<end>>", " ", regions, flags=re.DOTALL)):
            found = scanner.scan(f"Before it. {text} After it.".upper().encode())
            assert label in found[5].split(","), (label, text)
            anchor, _, mandatory, most = licenses.as_regex(template)
            whole = [m for m in found[7] if m[0] == label and mandatory <= m[2] - m[1] <= most and m[1] == 2]
            assert whole and anchor
    mit = next(t for label, t in licenses.TEMPLATES if label == "mit" and "SHALL" in t)
    text = re.sub(r"<<any \d+>>", "THE AUTHORS", re.sub(r"<<(optional|end)>>", " ", mit))
    n = len(re.findall(r"\w+", text))
    assert max(m[2] for m in scanner.scan(text.encode())[7]) > n - 5
    assert max(m[2] for m in scanner.scan(text.replace("substantial", "minor").encode())[7]) < 30


def test_empty_table_and_repeats(spark, table):
    assert licenses.scan(table([])).count() == 0
    out = licenses.scan(table([(1, "all rights reserved"), (1, "all rights reserved"), (None, None)])).collect()
    assert sorted(r.labels for r in out) == ["", "all-rights-reserved", "all-rights-reserved"]
