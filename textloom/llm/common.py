"""Session, checkpoint and hashing helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  gives pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documented bound on what one Arrow batch and one numpy slice hold.
BATCH_ROWS, BATCH_BYTES, SLICE_BYTES = 1000, 8 << 20, 3 << 20

#: Fixed pattern of a word: a run of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"

_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches and makes sure that checkpoint() has a folder.

    The folder in spark.checkpoint.dir is taken as it is; where that is unset, a temporary one does in local mode only.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            spark.conf.set(key, str(most))
        except Exception:  # noqa: BLE001  an option that this Spark lacks
            continue
    context = spark.sparkContext
    _ship(context)
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="textloom-"))
    return spark


def _ship(context) -> None:
    """Gives the package to Python workers that would not find it, once per context."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [os.path.abspath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), "."] if p]
    if root in known or getattr(context, "_textloom_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="textloom-"), "textloom.zip")  # the driver's; Spark serves it to executors
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "textloom")):
            for name in names:
                if name.endswith(".py"):
                    out.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    context.addPyFile(path)
    context._textloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as it is, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """These names, with underscores until no column of docs has them in any case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key that rows share only if they are repeats of one another."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def splitmix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; a bijection, the same on every machine."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_LETTER = splitmix(np.arange(1, 257, dtype=_U))
_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            row = np.full(n, base, _U)
            row[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[k] = np.cumprod(row, dtype=_U)
    return _POWERS[0], _POWERS[1]


def hash_words(data: np.ndarray, borders: np.ndarray, step: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words in UTF-8 bytes; borders: where texts start.

    A word's hash is a polynomial of its bytes, got from differences of prefix sums.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    white = _WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[borders] = True
    edge[0] = edge[-1] = True
    before = edge[:-1].copy()
    before[1:] |= white[:-1]
    after = edge[1:].copy()
    after[:-1] |= white[1:]
    starts, ends = np.flatnonzero(before & ~white), np.flatnonzero(after & ~white) + 1
    out, i = np.empty(len(starts), _U), 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, "right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            up, down = _powers(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, _U)
            np.cumsum(_LETTER[data[lo:hi]] * up[: hi - lo], out=sums[1:])
            a, b = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = splitmix((sums[b] - sums[a]) * down[a] + (b - a).astype(_U))
            i = j
    return starts, ends, out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its texts; nulls are empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES):
    """A batch in slices of about `most` bytes of text, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def word_table(batch: pa.RecordBatch, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice, and where each row's words start among them."""
    data, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
    starts, _, hashes = hash_words(data, at[:-1][at[:-1] < len(data)])
    return hashes, np.searchsorted(starts, at)


def run_places(offsets: np.ndarray, n: int) -> np.ndarray:
    """Where each row's runs of n words start in a list of all runs that lie in one row."""
    return np.concatenate([[0], np.cumsum(np.maximum(np.diff(offsets) - n + 1, 0))])


def rolling(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words that lie in one row, and where each row's runs start."""
    into = run_places(offsets, n)
    return run_hashes(hashes, np.repeat(offsets[:-1] - into[:-1], np.diff(into)) + np.arange(into[-1]), n), into


def run_hashes(hashes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words that start at these places: polynomials, from differences of prefix sums."""
    up, down = _powers(len(hashes) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(hashes) + 1, _U)
        np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
        return splitmix((sums[first + n] - sums[first]) * down[first])


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root): the smallest node that each node of an edge list is connected with.

    Alternates large-star and small-star steps; each round is checkpointed, so that a lost executor costs
    one round. No row holds a whole component, and nodes' neighbours meet in partial aggregates only.
    """
    pairs = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct().checkpoint()
    mark = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        pairs = small.union(low.select("u", "m")).toDF("u", "v").filter("u <> v").distinct().checkpoint()
        seen = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    roots = pairs.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
