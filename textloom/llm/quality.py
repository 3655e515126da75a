"""Quality rules by document and by host.

Every document is measured in one pass; a host's failures are summed, its failure rate is shrunk towards the rates of all hosts
by an empirical beta prior (method of moments over hosts), and hosts above `host_limit` fail whole. Document rows never meet
by host: counts are partial sums, and verdicts are joined back to the small measured rows.

Null texts have no words and fail. Null hosts are a host of their own. Repeated rows count each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, rolling, slices, splitmix, word_table

#: Fixed limits of the base rules and of a host's shrunk failure rate.
LEAST_WORDS, MOST_REPEATED, HOST_LIMIT = 50, 50, 0.5
_WHITE, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(words: np.ndarray, offsets: np.ndarray, n: int = 3) -> np.ndarray:
    """Per row, the words that lie in n-word windows found twice or more in the row."""
    hashes, into = rolling(words, offsets, n)
    row = np.repeat(np.arange(len(into) - 1), np.diff(into))
    with np.errstate(over="ignore"):
        key = splitmix(hashes ^ splitmix(row.astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = np.flatnonzero(again) + (offsets[:-1] - into[:-1])[row[again]]
    hit = np.zeros(len(words) + 1, np.int64)
    for k in range(n):
        hit[at + k + 1] = 1
    sums = np.cumsum(hit)
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _measure(batches):
    for batch in batches:
        for part in slices(batch):
            words, offsets = word_table(part)
            chars, symbols, lines = [], [], []
            for x in part.column("text"):
                text = x.as_py() or ""
                raw = text.encode()
                solid = raw.translate(None, _WHITE)
                chars.append(len(text) - len(raw) + len(solid))
                symbols.append(len(solid) - len(solid.translate(None, _SYMBOLS)))
                worded = [y for y in text.split("\n") if y.strip(" \t\n\r\x0b\x0c")]
                lines.append(len(worded) - len(set(worded)))
            values = (np.diff(offsets), np.array(chars), np.array(symbols), np.array(lines), _repeated(words, offsets))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), *(pa.array(x.astype(np.int64)) for x in values)], ["doc_id", "host", *_MEASURES])


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts of each document."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_measure, "doc_id long, host string, " + ", ".join(f"{c} long" for c in _MEASURES))


def host_rates(failures: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, rate): posterior mean failure rates, from rows (host, failed).

    The prior's mean is the mean of hosts' rates and its strength fits their variance beyond sampling noise; where hosts
    don't differ more than by chance, every host gets close to the common rate.
    """
    hosts = failures.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n_docs")).alias("per"))
    spread = F.col("m") * (1 - F.col("m"))
    between = F.greatest(F.col("v") - spread * F.col("per"), F.lit(1e-6))
    prior = prior.select("m", F.greatest(F.least(spread / between - 1, F.lit(1e6)), F.lit(1.0)).alias("strength"))
    shrunk = (F.col("n_failed") + F.col("m") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n_docs", "n_failed", shrunk.alias("rate"))  # the prior is one row


def quality_verdicts(docs: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """doc_id, the counts, base_failed, host_rate and kept, one row per row of docs."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = measure(docs, host).withColumn("base_failed", failed).checkpoint()
    rates = host_rates(rows.select("host", F.col("base_failed").alias("failed"))).select(F.col("host").alias("of"), F.col("rate").alias("host_rate"))
    out = rows.join(rates, F.col("host").eqNullSafe(F.col("of")), "left")
    return out.select("doc_id", *_MEASURES, "base_failed", "host_rate", (~F.col("base_failed") & (F.col("host_rate") <= host_limit)).alias("kept"))
