"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of the budget by weight, capped at twice its size, with the excess reshared by weight. A
target takes complete epochs first; the rest is a weighted sample without replacement: each document's key is an exponential
draw divided by its quality weight, keys are sorted within the source, and documents are taken while the prefix sum of
their sizes stays within the rest. The document at the border is cut to the words that are left (`cut`) or taken whole where that
comes nearer to the target.

Prefix sums have two levels: keys fall into buckets, buckets' totals give each bucket's prefix, and only the bucket at
each source's border is sorted. Draws are hashes of (doc_id, seed), of the text where there is no doc_id, so reruns agree. Null texts have size 0 and are
taken 0 words of; a null source is a source of its own, after the others. Ties go by key, then doc_id, then the text's hash; repeated
rows are documents of their own, of which the border takes as many as fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, fresh, prepare, quoted

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2.0, 42
#: Rows of a source that a bucket of keys holds on average.
BUCKET_ROWS = 100_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: str = "doc_id", seed: int = SEED, text: str = "text") -> Column:
    """A number in (0, 1) drawn from the md5 of id and seed: 52 bits, the same in other engines. Rows without an id draw by their text."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.md5(F.col(text).cast("string")), F.lit("")), F.lit(str(seed))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def quality_weight(text: str = "text") -> Column:
    """1 for texts without junk symbols, falling to 1/10 as they take over."""
    share = F.regexp_count(text, F.lit("[#*$%&|<>]")) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.1), 1 - 4 * share), F.lit(1.0))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size); weights repeat over sources by code point, null last.

    Capping and resharing until none is above its cap ends where every source gets min(cap, level * weight); the level
    is found in one pass over the sources sorted by cap / weight.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    budget = share * F.sum("source_size").over(every.orderBy(F.lit(0)))
    rows = rows.withColumn("level", (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every.orderBy(F.lit(0))) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    rows = rows.withColumn("nth", F.row_number().over(W.orderBy("ratio", F.col("source").asc_nulls_last())))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("nth", "level"))).over(every.orderBy(F.lit(0)))
    return rows.select("source", "source_size", F.least("cap", F.coalesce(first["level"], F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _placed(docs: DataFrame, size: Column | None, weight: Column | None, weights: tuple[float, ...], share: float, most: float, seed: int) -> tuple[DataFrame, DataFrame, Column, int]:
    """Rows without texts, the (source, bucket) table, the expression of keys, and the number of buckets."""
    prepare(docs.sparkSession)
    size, weight = word_count() if size is None else size, quality_weight() if weight is None else weight
    key = -F.log(uniform(seed=seed)) / F.greatest(weight, F.lit(1e-6))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.cast("long").alias("size"), key.alias("key"), F.xxhash64(F.col("text").cast("string")).alias("h")).checkpoint()
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).checkpoint()
    buckets = int(max(16, min(1 << 16, (totals.agg(F.max("n")).first()[0] or 0) // BUCKET_ROWS)))
    goal = F.floor(F.col("target") + 0.5).cast("long")
    plan = targets(totals.select("source", "source_size"), weights, share, most)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.greatest(goal - F.col("epochs") * F.col("source_size"), F.lit(0)))
    sums = rows.groupBy("source", _bucket(F.col("key"), buckets).alias("bucket")).agg(F.sum("size").alias("in_bucket"))
    sums = sums.withColumn("before", F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket")) - F.col("in_bucket"))
    sums = sums.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    sums = sums.withColumn("whole", F.col("before") + F.col("in_bucket") <= F.col("rest")).withColumn("border", ~F.col("whole") & (F.col("before") < F.col("rest")))
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "source_size", "target", "epochs", "rest", "whole", "border").checkpoint()
    return rows, sums, key, buckets


def _bucket(key: Column, buckets: int) -> Column:
    return F.floor((1 - F.exp(-key)) * buckets).cast("int")


def _border(placed: DataFrame, cut: bool) -> DataFrame:
    """Rows of the buckets at the borders, sorted within their source, with the part that the last epoch takes."""
    one = W.partitionBy("source").orderBy("key", "doc_id", "h").rowsBetween(W.unboundedPreceding, -1)
    left = F.greatest(F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(one), F.lit(0)), F.lit(0))
    return placed.filter("border").withColumn("left", left).withColumn("part", F.least("size", "left") if cut else F.when(2 * F.col("left") >= F.col("size"), F.col("size")).otherwise(0))


def mix(docs: DataFrame, size: Column | None = None, weight: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, cut: bool = True) -> DataFrame:
    """doc_id, source, size, source_size, target and taken, one row per row of docs.

    taken: words of the document in the mix, repeats counted: epochs * size plus what the last, partial epoch takes.
    """
    rows, sums, _, buckets = _placed(docs, size, weight, weights, share, most, seed)
    # The table has sources * buckets rows; Spark broadcasts it below its own limit, and else AQE splits the hot source.
    placed = rows.withColumn("bucket", _bucket(F.col("key"), buckets)).join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    others = placed.filter("not border").withColumn("part", F.when(F.col("whole"), F.col("size")).otherwise(0))
    out = _border(placed, cut).drop("left").unionByName(others)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, weight: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, broadcast_rows: int = 100_000) -> DataFrame:
    """The mix itself: rows of docs, whole, each as often as its epochs take it; all columns stay, whatever their names.

    Texts are not shuffled: a source's border is a key, and rows compare their own key with it. The borders (a row per
    source) are broadcast up to `broadcast_rows` and joined by a shuffle beyond. Where repeated rows stand at a border, as many of
    them are taken as fit; they are alike but for columns that the mix doesn't read.
    """
    rows, sums, key, buckets = _placed(docs, None, weight, weights, share, most, seed)
    placed = rows.withColumn("bucket", _bucket(F.col("key"), buckets)).join(sums.filter("border"), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    ties = _border(placed, False).groupBy("source", "key", "doc_id", "h").agg(F.count("*").alias("m"), F.count_if(F.col("part") > 0).alias("n")).filter("n > 0")
    last = ties.groupBy(F.col("source").alias("of")).agg(F.max(F.struct("key", "doc_id", "h", "n", "m")).alias("last"))
    plan = sums.groupBy("s").agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("whole"), F.col("b"))).alias("whole_to"))
    names = fresh(docs, "s", "epochs", "whole_to", "last", "key", "times", "nth")
    s, epochs, whole_to, border, own_key, times, nth = names
    plan = plan.join(last, F.col("s").eqNullSafe(F.col("of")), "left").select(*[F.col(c).alias(n) for c, n in zip(("s", "epochs", "whole_to", "last"), names, strict=False)]).checkpoint()
    small = plan.count() <= broadcast_rows
    exact = plan.filter(F.col(border)["m"] > F.col(border)["n"]).isEmpty()
    out = docs.withColumn(own_key, key).join(F.broadcast(plan) if small else plan, F.col("source").cast("string").eqNullSafe(F.col(s)))
    own = F.struct(F.col(own_key).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    at = F.struct(*[F.col(border)[c].alias(c) for c in ("key", "doc_id", "h")])
    inside = F.coalesce(F.col(border).isNotNull() & ((own <= at) if exact else (own < at)), F.lit(False))
    again = F.coalesce(_bucket(F.col(own_key), buckets) <= F.col(whole_to), F.lit(False)) | inside
    columns = [F.col(quoted(c)) for c in docs.columns]
    taken = out.withColumn(times, F.col(epochs).cast("int") + again.cast("int")).filter(F.col(times) > 0)
    taken = taken.withColumn(nth, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select(*columns)
    if exact:
        return taken
    # Few sources have repeated rows at their border; of those, rows that are alike give what fits.
    some = out.filter(F.col(border).isNotNull() & (own == at)).groupBy(F.col(s)).agg(F.first(F.struct(*columns)).alias(own_key), F.first(F.col(border)["n"]).alias(times))
    some = some.withColumn(nth, F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int")))).select(*[F.col(own_key).getField(c).alias(c) for c in docs.columns])
    return taken.unionByName(some)
