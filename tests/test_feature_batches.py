"""Features in Arrow batches are those of the expressions, and the benchmark makes them once of each different text."""

import random

from pyspark.sql import functions as F

from textloom.operators import detector, feature_batches, features, perturb
from textloom.plans import queries

SF = "/root/testdata/sf0.001"
BITS = ["The", "the", "it's", "don't", "However,", "in conclusion", "first", "ÉCOLE", "ΣΑΣ", "İx", "straße", "中文", "x​y", "аbс", "½", "_", "a_b", "# Head", "HEADING", "\x1c", "　", "\xa0", "\x85", " ", "᠎", "“q”", "—", "\U0001f600", "\U00020000"]
GAPS = [" ", " ", " ", " ", ". ", "! ", "? ", "\n", "\n\n", "\n \t\n", ", ", "; ", ".", "'", "\r\n", "\n\n\n", ".\x1c", "...  "]


def test_batches_give_the_features_of_the_expressions(spark):
    r = random.Random(1)
    texts = [None, "", " ", "\n", ".", "a", "a b", "a b c", "a a a a a a a", "... !", "# x", "A. ", "A\n\nB\n\nA", "x" * 300, "​", "'", "\U0001f600"]
    texts += ["".join(r.choice(BITS) + r.choice(GAPS) for _ in range(n)) for n in (3, 12, 45, 60, 110, 260) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, got = ({x[0]: x[1:] for x in assemble(docs).collect()} for assemble in (features.assemble, feature_batches.assemble))
    assert want.keys() == got.keys() == set(range(len(texts)))
    far = [(k, c) for k in want for c, x, y in zip(features.FEATURES, want[k], got[k], strict=True) if abs(x - y) > 1e-9 * max(1, abs(x))]
    assert far == []


def test_detectors_features_have_no_interpreted_lambdas(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    plan = detector.labelled_features(docs, labels.withColumnRenamed("quality", "label"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "MapInArrow" in plan


def test_benchmark_assembles_each_different_text_once(spark, monkeypatch):
    made = []

    def assemble(docs):
        made.append(docs.withColumn("digest", F.md5("text")).select("doc_id", "digest").collect())
        return docs.select("doc_id", *[F.lit(0.0).alias(c) for c in detector.FEATURES])

    monkeypatch.setattr(detector, "assemble", assemble)
    monkeypatch.setattr(detector.Detector, "fit", lambda self, rows: self)
    monkeypatch.setattr(detector.Detector, "predict_proba", lambda self, rows: rows.withColumn("ai_probability", F.lit(0.5)))
    out = {(r.model, r.attack): r.n_samples for r in queries.adversarial_benchmark(spark, SF).collect()}
    train, varied = made
    digests = [r.digest for r in train]
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    test = docs.filter(~F.col("doc_id").isin([r.doc_id for r in train])).select(F.md5("text").alias("digest"), "quality").collect()
    attacks = ["clean", "zero_width", "homoglyph", "synonym", "humanizer"]
    assert out == {(m, a): len(test) for m in ("logistic", "forest", "boosted") for a in attacks}
    assert len(digests) + len(test) == docs.count()
    plain = [r.digest for r in test]
    assert sorted(r.digest for r in varied if r.digest in set(plain)) == sorted(plain)


def test_chosen_is_whether_a_draw_is_below_the_rate(spark):
    key = F.col("id")
    on = spark.range(1).select(perturb.draw(F.lit(5), "op", 9)).first()[0]
    rows = spark.range(300)
    for rate in (0.0, 1e-9, 0.02, on, 0.068, 0.5, 1.0, 1.5, -0.1):
        differ = rows.filter((perturb.draw(key, "op", F.lit(9)) < rate) != perturb._chosen(key, "op", F.lit(9), rate, perturb.SEED))
        assert differ.count() == 0, rate
