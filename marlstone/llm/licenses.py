"""License scans: templates with optional and replaceable regions, compiled to token automata.

A template is text in which ``<<optional>> ... <<end>>`` may be left out and ``<<any N>>`` stands for up to N words of the
document's own. Its words become the edges of an automaton over words; a document matches where the automaton accepts,
that is where every mandatory word stands exactly as written, in order, with nothing between but what a region allows.
An automaton starts only where the words before its first region stand, which a byte search finds, so a document without
them costs one search; whole texts are read.

Null and empty texts have no words and no labels. Repeated rows are scanned one by one. Extra columns aren't returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import alnum_words, lean, text_bytes
from marlstone.llm.license_texts import BASE, TEMPLATES

_MARK = re.compile(r"<<\s*(optional|end|any\s+(\d+))\s*>>")


@dataclass
class Automaton:
    label: str
    anchor: bytes  # the words before the first region, with a space on each side
    edges: list[dict[bytes, set[int]]]  # by state: the states after a word
    others: list[set[int]]  # by state: the states after any word
    final: int
    mandatory: int  # how many words are mandatory

    def longest(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest text that starts at word ``at`` and is accepted."""
        states, end = {0}, 0 if self.final == 0 else None
        while at < len(words) and states:
            word, after = words[at], set()
            for s in states:
                after |= self.edges[s].get(word, set()) | self.others[s]
            states, at = after, at + 1
            if self.final in states:
                end = at
        return end


def compiled(label: str, template: str) -> Automaton:
    """Builds the automaton with empty moves first and then takes them out."""
    word_moves: list[tuple[int, bytes | None, int]] = []
    empty: dict[int, set[int]] = {}
    state, opened, mandatory, anchor, plain = 0, [], 0, [], True
    for part in re.split(r"(<<[^>]*>>)", template):
        if mark := _MARK.fullmatch(part.strip()):
            plain = False
            if mark[1] == "optional":
                opened.append(state)
            elif mark[1] == "end":
                empty.setdefault(opened.pop(), set()).add(state)
            else:
                start = state
                for _ in range(int(mark[2])):
                    word_moves.append((state, None, state + 1))
                    state += 1
                for s in range(start, state):
                    empty.setdefault(s, set()).add(state)
            continue
        if "<<" in part:
            raise ValueError(f"unknown region {part!r}")
        for word in alnum_words(part.encode()):
            word_moves.append((state, word, state + 1))
            state += 1
            mandatory += not opened
            if plain:
                anchor.append(word)
    if opened or not anchor:
        raise ValueError("a template starts with mandatory words and closes its regions")

    def reached(s: int) -> set[int]:
        found, todo = {s}, [s]
        while todo:
            for t in empty.get(todo.pop(), ()):
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return found

    edges: list[dict[bytes, set[int]]] = [{} for _ in range(state + 1)]
    others: list[set[int]] = [set() for _ in range(state + 1)]
    for a, word, b in word_moves:
        if word is None:
            others[a] |= reached(b)
        else:
            edges[a].setdefault(word, set()).update(reached(b))
    return Automaton(label, b" " + b" ".join(anchor) + b" ", edges, others, state, mandatory)


def places(line: bytes, phrase: bytes) -> Iterator[int]:
    """Numbers of the words at which phrase starts; line and phrase have a space around each word."""
    at, word, done = line.find(phrase), 0, 0
    while at >= 0:
        word, done = word + line.count(b" ", done, at), at
        yield word
        at = line.find(phrase, at + 1)


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> None:
        self.automata = [compiled(*t) for t in templates]
        self.base = [(f" {phrase} ".encode(), label) for phrase, label in base.items()]

    def matches(self, words: list[bytes], line: bytes) -> list[tuple[str, int, int, float]]:
        """Label, first word, end and the share of mandatory words of each accepted text."""
        found = []
        for a in self.automata:
            for at in places(line, a.anchor):
                if (end := a.longest(words, at)) is not None:
                    found.append((a.label, at, end, a.mandatory / max(end - at, a.mandatory)))
        return found

    def scan(self, data: bytes | None) -> tuple:
        words = alnum_words(data)
        line = b" " + b" ".join(words) + b" "
        hits = [(at, label) for phrase, label in self.base for at in places(line, phrase)]
        matched = self.matches(words, line)
        labels = {label for _, label in hits}
        starts = [at for at, _ in hits]
        every = labels | {m[0] for m in matched}
        score = max((m[3] for m in matched), default=0.0)
        return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score, matched


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """For each document the base phrases' and the templates' labels, and matches: label, first word, end, score."""
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    match = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, base)
        for b in batches:
            found = [scanner.scan(x.as_py()) for x in b.column(1)]
            columns = [pa.array([f[i] for f in found], kind) for i, (_, kind) in enumerate(fields)]
            columns.append(pa.array([[dict(zip(("label", "first", "end", "score"), m, strict=True)) for m in f[7]] for f in found], pa.list_(match)))
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", *(n for n, _ in fields), "matches"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first:bigint,end:bigint,score:double>>"
    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(lean(rows), schema)


def as_regex(template: str) -> tuple[str, str, int, int]:
    """A template over a line of words with a space before each: the words before its first region, a regular expression, how
    many words are mandatory and the most that a match has."""
    found, opened, mandatory, most, anchor, plain = "", 0, 0, 0, [], True
    for piece in re.split(r"(<<[^>]*>>)", template):
        if mark := _MARK.fullmatch(piece.strip()):
            plain = False
            found += {"optional": "(?:", "end": ")?"}.get(mark[1], f"(?: [^ ]+){{0,{mark[2]}}}")
            opened += {"optional": 1, "end": -1}.get(mark[1], 0)
            most += int(mark[2] or 0)
            continue
        words = [w.decode() for w in alnum_words(piece.encode())]
        found += "".join(f" {w}" for w in words)
        mandatory, most = mandatory + len(words) * (not opened), most + len(words)
        anchor += words * plain
    return " ".join(anchor), found, mandatory, most


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x + "'" for x in r) + ")" for r in rows)


#: The same in DuckDB, for a table documents, with the templates as regular expressions.
SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
lines AS (SELECT r, words, ' ' || array_to_string(words, ' ') || ' ' AS line FROM docs),
base AS (SELECT * FROM (VALUES {_rows([(phrase, label, len(phrase.split()), phrase.split()[0]) for phrase, label in BASE.items()])}) AS t(phrase, label, n, first)),
told AS (
  SELECT * FROM (SELECT r, words, phrase, label, n, first, unnest(range(1, len(words) + 1)) AS i FROM lines, base WHERE contains(line, ' ' || phrase || ' '))
  WHERE words[i] = first AND array_to_string(words[i:i + n - 1], ' ') = phrase),
templates AS (SELECT * FROM (VALUES {_rows([(label, *as_regex(t)) for label, t in TEMPLATES])}) AS t(label, anchor, shape, mandatory, most)),
starts AS (
  SELECT * FROM (SELECT r, words, t.*, unnest(range(1, len(words) + 1)) AS i FROM lines, templates AS t WHERE contains(line, ' ' || anchor || ' '))
  WHERE words[i] = split_part(anchor, ' ', 1)),
tried AS (
  SELECT r, label, mandatory, regexp_extract(' ' || array_to_string(words[i:i + most], ' '), '^(' || shape || ')(?: |$)', 1) AS match FROM starts),
matched AS (
  SELECT r, label, mandatory::DOUBLE / greatest(len(match) - len(replace(match, ' ', '')), mandatory) AS score FROM tried WHERE match <> ''),
labelled AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM told UNION SELECT r, label FROM matched) GROUP BY r),
counted AS (
  SELECT r, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM told GROUP BY r),
scored AS (SELECT r, max(score) AS score FROM matched GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN counted USING (r) LEFT JOIN labelled USING (r) LEFT JOIN scored USING (r)
"""
