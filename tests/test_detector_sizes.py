"""The registered detector queries train models of the reference's sizes."""

from pyspark.sql import functions as F

from textloom.operators import detector
from textloom.plans import queries

SF = "/root/testdata/sf0.001"


def test_sizes_of_the_models(spark, monkeypatch):
    trained = []

    def fit(self, rows):
        trained.append((self.kind, self.trees, self.depth, self.step))
        return self

    monkeypatch.setattr(detector.Detector, "fit", fit)
    monkeypatch.setattr(detector.Detector, "predict_proba", lambda self, rows: rows.withColumn("ai_probability", F.lit(0.5)))
    monkeypatch.setattr(detector, "assemble", lambda docs: docs.select("doc_id", *[F.lit(0.0).alias(c) for c in detector.FEATURES]))
    monkeypatch.setattr(detector.metrics, "evaluate", lambda scored, by: scored.select(*by, "score"))
    queries.detector_scores(spark, SF)
    assert trained == [("boosted", 120, 5, 0.05)]
    trained.clear()
    queries.adversarial_benchmark(spark, SF)
    assert [t[:3] for t in trained if t[0] != "logistic"] == [("forest", 100, 6), ("boosted", 120, 5)]
    assert len(trained) == 3
