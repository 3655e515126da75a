"""Places of rows that come out of a shuffle whose partitions adaptive plans cut by size."""

from pyspark.sql import functions as F

from textloom.sources import corpora


def test_every_answer_of_a_sorted_table(spark, tmp_path):
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(128)), lambda i: F.sha2(F.concat_ws(":", "id", i), 256)), "")
    spark.range(4000).select("id", text.alias("text")).write.parquet(str(tmp_path / "turns"))
    rows = spark.read.parquet(str(tmp_path / "turns")).groupBy("id").agg(F.collect_list("text").alias("human_answers"), F.collect_list(F.col("id").cast("string")).alias("chatgpt_answers")).orderBy("id")
    out = corpora.ingest_answers(rows).select("sample_id", "origin", "text").collect()
    assert len(out) == 8000
    assert all(r.sample_id == f"hc3_ai_{r.text}_0" for r in out if r.origin == "AI_RAW")
    assert {r.sample_id for r in out if r.origin == "HUMAN"} == {f"hc3_human_{k}_0" for k in range(4000)}
