"""Every query over tables with nulls in each column, empty and very long texts, ties, repeated rows and extra columns of
clashing names, and over empty tables."""

import pytest

import corpus_pipeline
from marlstone.llm import entry

LONG = "très long wörd " * 8000
TEXTS = [None, "", " \t\n", "one", "The cat and the dog sat on the mat, 10.0.0.1 mail a@b.co", LONG, "token = " + "ab1" * 20, "Under the MIT License. all rights reserved " * 3, "1234 5678", "😀 ñ"]
CLASHING = "fp long, row string, words string, size string, __key string, bucket long, rank int, slot int, group string, spans string, lang_pred string, score string, c0 string, __bytes string, hit string"


def tables(spark, folder, empty):
    docs = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "")[i % 4], None if i % 2 else 5) for i, t in enumerate(TEXTS * 3)]
    docs += [(None, None, None, None, None), (None, "no id", "en", "a", 1), docs[4], docs[4], (4, "same id, other text", "en", "a", 2)]
    extra = tuple(None if i % 2 else 1 if kind in ("long", "int") else "x" for i, kind in enumerate(c.split()[1] for c in CLASHING.split(", ")))
    made = {
        "documents": ([(*d, *extra) for d in docs], "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING),
        "labels": ([(0, 1, 0), (1, None, None), (None, 1, 0), (4, 1, 0), (4, 1, 0), (5, 0, 1), (9999, 1, 0)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, "the dog sat on the mat"), (2, None), (None, "one"), (3, ""), (1, "the dog sat on the mat")], "item_id long, text string"),
        "pages": ([(1, None, None), (2, "https://h.org/a", "<p>x"), (3, "https://h.org/a", "<p>x"), (None, "", "<article>y</article>"), (3, "https://h.org/a", "<p>x"), (4, "https://h.org/b", f"<div>{LONG}</div>")], "page_id long, url string, html string, host string, lines string, edge int, text string"),
    }
    for name, (rows, schema) in made.items():
        width = len(schema.split(","))
        full = [] if empty else [(*r, *(None,) * (width - len(r))) for r in rows]
        spark.createDataFrame(full, schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return f"{folder}", len(docs), len(made["pages"][0])


@pytest.fixture(scope="module", params=[False, True], ids=["odd", "empty"])
def folder(request, spark, tmp_path_factory):
    path, docs, pages = tables(spark, f"file://{tmp_path_factory.mktemp('odd')}", request.param)
    return path, 0 if request.param else docs, 0 if request.param else pages


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, folder, name):
    path, docs, pages = folder
    run = lambda: sorted(map(str, entry.queries()[name](spark, path).collect()))
    rows = run()
    assert len(rows) == (pages if name == "op8_main_text" else docs)
    assert run() == rows


def test_pipeline(spark, folder):
    path, docs, _ = folder
    out = corpus_pipeline.run(spark, path)
    names = spark.read.parquet(f"{path}/documents.parquet").columns
    assert out.columns == [*("_" + n if n in ("size", "shard", "slot") else n for n in names), "size", "shard", "slot"]
    assert 0 < out.count() < docs if docs else out.count() == 0
