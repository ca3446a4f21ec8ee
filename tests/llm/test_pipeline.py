"""The pipeline on a small corpus against brute force, and the registration."""

from __future__ import annotations

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    import test_operators as t

    rows = [(i, t.text(60 + i % 7), "en", "a.org", 1) for i in range(40)]
    rows += [(100, rows[3][1], "en", "a.org", 1), (101, rows[4][1] + " token=abcdefghijklmnop", "en", "b.org", 1), (102, None, "en", None, None), (103, "123 456", "en", "b.org", 7)]
    item = t.text(30)
    rows += [(104, t.text(20) + " " + item + " " + t.text(20), "en", "b.org", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names, docs = [], df
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        names.append((name, {r["doc_id"] for r in docs.collect()}))
        if name != "best-fit packing":
            assert tuple(docs.columns) == pipeline.COLUMNS
    ids = {r[0] for r in rows}
    assert names[0][1] == ids - {102, 103}
    assert names[1][1] == names[0][1] - {100, 101}
    assert names[2][1] == names[1][1] - {104}
    assert names[3][1] == names[4][1] == names[2][1]
    assert {r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect()} == names[4][1]


def test_stages_of_odd_tables(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, repeated ids, clashing columns; and no rows at all."""
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "some words of a text that is long enough to tell", "en", "a", 9), (2, "some words of a text that is long enough to tell", "en", "a", 9), (2, "quite another text under the same id as before it", "en", "a", 9), (None, "a text without any id but with words and letters", "en", None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("_id", "_key", "_p", "row_key", "name", "blob")})
    for name, stage in pipeline.STAGES:
        out, none = stage(spark, df, str(tmp_path)), stage(spark, df.where("false"), str(tmp_path))
        assert none.count() == 0, name
        texts = {r["text"] for r in out.collect()} if "text" in out.columns else None
        assert texts is None or {x[1] for x in rows[2:]} <= texts, name
        if name in ("benchmark decontamination", "secret scans", "best-fit packing"):
            assert out.count() == len(rows), name
        if name == "n-gram Jaccard join":
            assert out.where("doc_id = 2").count() == 3


def test_secrets_are_masked(spark):
    df = spark.createDataFrame([(1, "see token=abcdefghijklmnop now", "en", "s", 30)], "doc_id long, text string, lang string, source string, n_chars long")
    r = pipeline.secret_scan(spark, df, "").first()
    assert r["text"] == "see [SECRET] now" and r["n_chars"] == len(r["text"])


def test_registration():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.split("_")[0][2:].isdigit()) == list(range(1, 11))
    assert "pipeline" in entry.queries()
