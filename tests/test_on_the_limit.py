"""Texts whose sentence lengths deviate by exactly 4 or 6 words, a limit of the rule score, against the SQL."""

import duckdb
import pytest

import __spark_entry__

LENGTHS = [(11, 14, 3, 12, 23, 9), (18, *[1] * 16), (13, 9, 1, 6, 4, 3)]


@pytest.mark.parametrize("name", ["rule_score", "stream_rule_score", "confidence_bands", "stream_verdicts", "explanations"])
def test_as_the_sql(spark, tmp_path, name):
    rows = [(k, " ".join(" ".join(f"w{k}x{i}y{j}" for j in range(n)) + "." for i, n in enumerate(ns)), "en", "web", 1) for k, ns in enumerate(LENGTHS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = base.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 0
