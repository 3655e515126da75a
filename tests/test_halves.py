"""Shares that are halves of the sixth digit are rounded as in the SQL, which judges the scaled double."""

import duckdb
import pytest

import __spark_entry__


@pytest.mark.parametrize("name", ["rule_score", "stream_rule_score"])
def test_as_the_sql(spark, tmp_path, name):
    rows = [(k, " ".join(f"w{i % n}" for i in range(640)) + ".", "en", "web", 1) for k, n in enumerate((41, 323, 333, 127))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = base.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == len(rows)


def test_means_as_the_sql(spark, tmp_path):
    rows = [(k, f"a{k}. " + " ".join(f"w{i}" for i in range(11)) + ".", "en", "web", 1) for k in range(31)] + [(31, "One short sentence.", "en", "web", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = __spark_entry__.queries()["stream_verdicts"](spark, str(tmp_path))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = base.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()['stream_verdicts']})").fetchall()
    assert list(map(tuple, got.collect())) == want and [r[2:] for r in want] == [(32, 0.504687)]
