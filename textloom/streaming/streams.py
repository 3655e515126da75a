"""The per-document operators on streams: they hold no state, so a readStream runs through them unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..operators import curation, explain, sanitize


def score(stream: DataFrame) -> DataFrame:
    """Rule scores of a stream of (doc_id, text)."""
    return explain.rule_score(stream)


def clean(stream: DataFrame) -> DataFrame:
    """Sanitised texts with their audit."""
    return sanitize.sanitize(stream)


def deduplicate(stream: DataFrame, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """First arrivals of each normalised text within the watermark; state is dropped as the watermark passes."""
    (h,) = fresh(stream, "h")
    hashed = stream.withColumn(h, curation.dedup_hash(F.coalesce(F.col("text"), F.lit(""))))
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark([h]).drop(h)


def verdict_counts(stream: DataFrame, time: str = "ts", size: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Verdicts per tumbling window of event time, from scored rows with a time."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, size), "classification").agg(F.count("*").alias("n"), F.avg("ai_probability").alias("mean_probability"))
