"""The pipeline's stages, one by one and as a whole."""

from collections import Counter

import brute
import corpus_pipeline as P
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit("x"))
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "benchmark_decontamination", "source_mixing", "sharding"]
    assert P.ORACLE_SQL is None
    kept = P.language_id(spark, docs, SF).persist()
    assert kept.columns == columns and kept.count() >= 0.95 * docs.count()

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    classes = brute.classes(rows)
    single = P.near_duplicates(spark, kept, SF).persist()
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(d for d, (c, _) in classes.items() if c == d)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in single.collect()]
    leaks = {d for d, _ in brute.leaks(rows, items)}
    clean = P.benchmark_decontamination(spark, single, SF).persist()
    assert clean.columns == columns and sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in rows if d not in leaks)

    mixed = P.source_mixing(spark, clean, SF).persist()
    assert mixed.columns == columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    out = P.shards(spark, mixed, SF)
    assert out.count() == mixed.count() and out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_run(spark):
    assert P.run(spark, SF).count() > 100


def test_stages_on_odd_rows(spark):
    long = " ".join(f"wort{i} und die" for i in range(60))
    rows = [(1, long, "de", "s"), (1, long, "de", "s"), (2, long, "de", None), (None, long, "de", "s"), (None, long, "de", "s"), (3, None, None, "s"), (4, "", "de", "s"), (5, "the quick brown fox and the dog " * 9, "en", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    assert Counter(r.doc_id for r in P.near_duplicates(spark, docs, SF).collect()) == Counter([1, 3, 4, 5])
    out = docs
    for _, stage in P.STAGES:
        out = stage(spark, out, SF)
    assert out.count() > 0
    none = docs.limit(0)
    for _, stage in P.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0
