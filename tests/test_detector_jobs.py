"""What keeps the many short jobs of training short, and the cores busy."""

import threading

from pyspark.sql import functions as F

from textloom.operators import detector, features, perturb, sanitize
from textloom.plans import queries

SF = "/root/testdata/sf0.001"


def test_training_starts_from_stored_features(spark, monkeypatch):
    plans = []

    def fit(self, rows):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return self

    monkeypatch.setattr(detector.Detector, "fit", fit)
    monkeypatch.setattr(detector.Detector, "predict_proba", lambda self, rows: rows.withColumn("ai_probability", F.lit(0.5)))
    monkeypatch.setattr(detector, "assemble", lambda docs: docs.select("doc_id", *[F.size(F.split("text", "x+")).cast("double").alias(c) for c in detector.FEATURES]))
    queries.detector_scores(spark, SF)
    assert len(plans) == 1 and all("split(" not in p and "InMemoryRelation" not in p for p in plans)


def test_folds_are_trained_side_by_side(spark, monkeypatch):
    meeting = threading.Barrier(detector.FOLDS, timeout=30)

    class Meets:
        def fit(self, rows):
            meeting.wait()
            return self

        def transform(self, rows):
            return rows.withColumn("margin", F.lit(0.0))

    monkeypatch.setattr(detector.Detector, "_pipeline", lambda self: Meets())
    monkeypatch.setattr(detector.Detector, "_calibrator", lambda self: type("Rests", (), {"fit": lambda self, rows: rows})())
    monkeypatch.setattr(detector.Detector, "_margin", staticmethod(lambda out: out))
    rows = spark.range(30).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"))
    assert len(detector.Detector("boosted").fit(rows).models) == detector.FOLDS


def test_variants_are_assembled_once_and_whole(spark):
    text = "Moreover, the important result is clear. We use it, and it helps to show many things. But people know this."
    docs = spark.createDataFrame([(1, text, 1), (2, text + "  Other\twords.", 0), (3, None, 0), (4, "", 1)], "doc_id long, text string, label int")
    kinds = ["zero_width", "homoglyph", "synonym", "humanizer"]
    attacked = perturb.apply_attacks(docs, kinds, 0.6).withColumn("text", F.when(F.col("label") == 1, F.col("perturbed_text")).otherwise(F.col("text")))
    texts = detector.variants(attacked)
    assert {r.doc_id: r.n for r in texts.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}[2] == 2
    assert texts.select(F.sum(F.size("uses"))).first()[0] == 4 * len(kinds) * 2
    key = F.concat_ws("|", "label", "attack_type", "form", "doc_id").alias("doc_id")
    raw = attacked.withColumn("form", F.lit("raw")).select(key, "text")
    tidy = sanitize.sanitize(attacked).withColumn("form", F.lit("sanitised")).select(key, F.col("clean_text").alias("text"))
    parts = F.split("doc_id", r"\|")
    want = features.assemble(raw.unionByName(tidy)).select(parts[0].cast("int").alias("label"), parts[1].alias("attack"), parts[2].alias("form"), *features.FEATURES)
    assert sorted(map(tuple, detector.assembled_once(texts).collect())) == sorted(map(tuple, want.collect()))
