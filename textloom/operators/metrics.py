"""Detector metrics from (label, score) rows as aggregates and windows over distinct scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import fresh

#: Bits of a score that make up a range for two-level cumulative sums.
RANGES = 256


def binary(scores: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 (binary and macro) and Brier score; ratios by zero are 0."""
    y, yes = F.col("label") == 1, F.col("score") >= threshold
    counts = scores.groupBy(*(by or [])).agg(F.count_if(~y & ~yes).alias("tn"), F.count_if(~y & yes).alias("fp"), F.count_if(y & ~yes).alias("fn"), F.count_if(y & yes).alias("tp"), F.count("*").alias("n_samples"), F.avg(F.pow(F.col("score") - F.col("label"), F.lit(2.0))).alias("brier"))
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    f1 = ratio(2 * tp, 2 * tp + fp + fn)
    macro = (f1 + ratio(2 * tn, 2 * tn + fp + fn)) / 2
    return counts.select(*(by or []), ratio(tp + tn, F.col("n_samples")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1.alias("f1_binary"), macro.alias("f1_macro"), "brier", "tn", "fp", "fn", "tp", "n_samples")


def curve(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(score, pos, neg, tp, fp, all_pos, all_neg): at each distinct score, counts of labels there and at or above it.

    Cumulative sums have two levels, ranges of scores and within them, so that no task sorts all scores.
    """
    by = by or []
    points = scores.groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    r, above_pos, above_neg = fresh(points, "r", "above_pos", "above_neg")
    points = points.withColumn(r, F.floor(F.col("score") * RANGES))
    sums = points.groupBy(*by, r).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    every = W.partitionBy(*by)
    down = every.orderBy(F.desc(r)).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*by, r, F.coalesce(F.sum("p").over(down), F.lit(0)).alias(above_pos), F.coalesce(F.sum("n").over(down), F.lit(0)).alias(above_neg), F.sum("p").over(every).alias("all_pos"), F.sum("n").over(every).alias("all_neg"))
    own = W.partitionBy(*by, r).orderBy(F.desc("score"))
    out = points.join(sums, [*by, r]).withColumn("tp", F.col(above_pos) + F.sum("pos").over(own)).withColumn("fp", F.col(above_neg) + F.sum("neg").over(own))
    return out.select(*by, "score", "pos", "neg", "tp", "fp", "all_pos", "all_neg")


def ranking(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """roc_auc (0.5 if a class is missing), pr_auc (average precision), fpr_at_95_tpr and fpr_at_99_tpr (1 if never reached)."""
    by = by or []
    c = curve(scores, by)
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + 0.5 * F.col("neg") * F.col("pos"))
    steps = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    pairs = F.max("all_pos").cast("double") * F.max("all_neg")
    reach = lambda t: F.coalesce(F.min(F.when((F.col("tp") >= t * F.col("all_pos") - 1e-12) & (F.col("all_pos") > 0) & (F.col("all_neg") > 0), F.col("fp") / F.nullif("all_neg", F.lit(0)))), F.lit(1.0))
    both = (F.max("all_pos") > 0) & (F.max("all_neg") > 0)
    return c.groupBy(*by).agg(F.when(both, F.try_divide(wins, pairs)).otherwise(0.5).alias("roc_auc"), F.coalesce(F.try_divide(steps, F.max("all_pos").cast("double")), F.lit(0.0)).alias("pr_auc"), reach(0.95).alias("fpr_at_95_tpr"), reach(0.99).alias("fpr_at_99_tpr"))


def calibration(scores: DataFrame, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """(bin, n, accuracy, confidence, gap): bins are (low, high] on the edges k * (1 / bins); a score of 0 is in none."""
    by = by or []
    edges = [k * (1.0 / bins) for k in range(bins + 1)]
    which = F.lit(None).cast("int")
    for k in range(bins):
        which = F.when((F.col("score") > edges[k]) & (F.col("score") <= edges[k + 1]), k).otherwise(which)
    rows = scores.withColumn("bin", which)
    total = rows.groupBy(*by).agg(F.count("*").alias("total"))
    out = rows.filter("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(F.col("label").cast("double")).alias("accuracy"), F.avg("score").alias("confidence"))
    out = out.join(total, by) if by else out.crossJoin(F.broadcast(total))  # one row
    return out.select(*by, "bin", "n", "accuracy", "confidence", (F.abs(F.col("accuracy") - F.col("confidence")) * F.col("n") / F.col("total")).alias("gap"))


def ece(scores: DataFrame, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    return calibration(scores, bins, by).groupBy(*(by or [])).agg(F.sum("gap").alias("ece"))


def evaluate(scores: DataFrame, threshold: float = 0.5, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """All metrics, a row per group of `by` (one row without), rounded."""
    one = [] if by else fresh(scores, "one")
    by = by or one
    scores = scores.withColumn(one[0], F.lit(1)) if one else scores
    out = binary(scores, threshold, by).join(ranking(scores, by), by).join(ece(scores, by=by), by, "left").withColumn("ece", F.coalesce("ece", F.lit(0.0)))
    doubles = [c for c, t in out.dtypes if t == "double"]
    return out.select(*[c for c in by if c not in one], *[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in out.columns if c not in by])
