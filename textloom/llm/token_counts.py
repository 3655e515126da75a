"""Exact token counts by length histogram.

Texts are encoded with a public byte-level BPE vocabulary (a file of ranks whose path is a parameter), and documents are
counted by encoded length. Suffix sums over the histogram answer totals, quantiles and truncated totals for any
context limit without reading a text again. The histogram has a row per distinct length, however many documents there are; suffix
sums have two levels, so no task holds all of it. Null and empty texts have length 0.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths in a bucket of the first level of suffix sums.
SPAN = 1024


def encoder(ranks: bytes, pattern: str = PATTERN):
    """A function that counts a text's tokens."""
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}, special_tokens={})
    return lambda text: len(own.encode_ordinary(text))


def histogram(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, n_docs): documents of each encoded length."""
    spark = prepare(docs.sparkSession)
    with open(ranks, "rb") as f:  # a vocabulary of the driver's, broadcast: about 1 MB
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches):
        count = encoder(shared.value, pattern)
        for batch in batches:
            lengths = [count(x.as_py() or "") for x in batch.column("text")]
            n, c = np.unique(np.array(lengths, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(c.astype(np.int64))], ["n_tokens", "n_docs"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n_tokens long, n_docs long")
    return counts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(counts: DataFrame, span: int = SPAN) -> DataFrame:
    """For each length as a context limit: documents and tokens at least as long, all tokens, tokens once texts are truncated.

    quantile: the share of documents that are no longer than this.
    """
    rows = counts.withColumn("bucket", F.floor(F.col("n_tokens") / span)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).checkpoint()
    sums = rows.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = W.orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0).cast("long")
    sums = sums.select("bucket", F.coalesce(F.sum("d").over(above), zero).alias("docs_above"), F.coalesce(F.sum("t").over(above), zero).alias("tokens_above"), F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("total_tokens"))
    down = W.partitionBy("bucket").orderBy(F.desc("n_tokens"))
    out = rows.join(sums, "bucket").withColumn("docs_at_least", F.col("docs_above") + F.sum("n_docs").over(down)).withColumn("tokens_at_least", F.col("tokens_above") + F.sum("tokens").over(down))
    truncated = F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    share = (F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")
    return out.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "total_tokens", truncated.alias("truncated_total"), share.alias("quantile"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_total, docs_cut): any limits, also such that no text has for its length."""
    wanted = sums.sparkSession.createDataFrame([(x,) for x in limits], "context_limit long")
    over = sums.join(F.broadcast(wanted), F.col("n_tokens") > F.col("context_limit"), "right").groupBy("context_limit").agg(F.min("n_tokens").alias("n"), F.max("total_tokens").alias("t"), F.max("docs_at_least").alias("cut"), F.max("tokens_at_least").alias("long"))
    whole = sums.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("all"))
    return over.crossJoin(F.broadcast(whole)).select("context_limit", F.when(F.col("n").isNull(), F.col("all")).otherwise(F.col("t") - F.col("long") + F.col("context_limit") * F.col("cut")).alias("truncated_total"), F.coalesce("cut", F.lit(0)).alias("docs_cut"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """(n_tokens): the least length that a share q of the documents does not exceed."""
    return sums.filter(F.col("quantile") >= q - 1e-12).agg(F.min("n_tokens").alias("n_tokens"))
