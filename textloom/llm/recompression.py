"""Substring dedup by recompression.

Every text is rewritten in rounds. A round first replaces each maximal run of one symbol by a symbol named after
(symbol, length), then draws a coin for each symbol and replaces each pair of a "left" and a following "right" symbol by a
symbol named after the pair. Names are 64-bit hashes of what they stand for, hence global without a shuffle: equal
content gets equal names in every task. Next to each symbol stands its *reach*, the words that decided it. Two equal
runs of words hold the same symbols wherever a symbol's reach lies inside the run, so a window can only repeat if each
symbol reaching no further than the window is shared. Windows that pass are verified by 96 bits
of hash of all their words.

A task combines what it finds in blocks of BLOCK_ENTRIES: of a mark or window only one row a block goes to the exchange, that of
its least document, however often the block repeats it, so that the rows of the most frequent one number a millionth of all
entries.

Nulls and texts without words have nothing to remove. Rows with a null doc_id come before all others, in an order of
their texts' hashes, and show null again. Repeated rows get the same result each; a row never loses a window to another row
of its own doc_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, run_hashes, run_places, slices, splitmix, word_table

_U = np.uint64
ROUNDS, WINDOW = 7, 50
#: Rows that share a doc_id are told apart by their texts' hash modulo this, carried in the low bits of places.
TAGS = 1 << 16
#: Marks or windows that a task combines at a time, about 100 MB of arrays.
BLOCK_ENTRIES = 1 << 20


def parse(words: np.ndarray, offsets: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, row, reach from, reach to) of the symbols after some rounds; a reach past a row's end can't lie in a window."""
    n = len(words)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    name, start, end = words, np.arange(n), np.arange(1, n + 1)
    low, high = start.copy(), end.copy()
    for r in range(rounds):
        if len(name) < 2:
            break
        row_of = row[start]
        inner = row_of[1:] == row_of[:-1]
        # Runs. A symbol and its neighbour differ for certain where their words at the seam's same side differ.
        equal = inner & (name[1:] == name[:-1])
        head = np.flatnonzero(np.concatenate([[True], ~equal]))
        count = np.diff(np.append(head, len(name)))
        tail = head + count - 1
        if len(head) < len(name):
            name = np.where(count > 1, splitmix(name[head] ^ splitmix(count.astype(_U) + _U(r << 32))), name[head])
            low = np.minimum.reduceat(low, head)
            high = np.maximum.reduceat(high, head)
            start, end = start[head], end[tail]
            row_of = row[start]
            inner = row_of[1:] == row_of[:-1]
        left, right = start - 1, end + 1
        ends_differ = words[end[1:] - 1] != words[end[:-1] - 1]
        heads_differ = words[start[1:]] != words[start[:-1]]
        before, after = low.copy(), high.copy()
        left[1:] = np.where(inner, np.where(ends_differ, left[1:], before[:-1]), left[1:])
        right[:-1] = np.where(inner, np.where(heads_differ, right[:-1], after[1:]), right[:-1])
        low, high = np.minimum(low, left), np.maximum(high, right)
        # Pairs.
        coin = (splitmix(name ^ _U(0xA5A5A5A5 + r)) >> _U(17)) & _U(1) == 1
        join = inner & ~coin[:-1] & coin[1:]
        first, second = np.concatenate([join, [False]]), np.concatenate([[False], join])
        before, after = low.copy(), high.copy()
        lone_left, lone_right = ~coin & ~first, coin & ~second
        reach = end + 1
        reach[:-1] = np.where(inner, after[1:], reach[:-1])
        high = np.where(lone_left, np.maximum(high, reach), high)
        reach = start - 1
        reach[1:] = np.where(inner, before[:-1], reach[1:])
        low = np.where(lone_right, np.minimum(low, reach), low)
        at = np.flatnonzero(first)
        with np.errstate(over="ignore"):
            name = name.copy()
            name[at] = splitmix(splitmix(name[at] + _U(r + 1)) * _U(3) + name[at + 1])
        low[at], high[at], end = np.minimum(low[at], low[at + 1]), np.maximum(high[at], high[at + 1]), end.copy()
        end[at] = end[at + 1]
        name, start, end, low, high = (x[~second] for x in (name, start, end, low, high))
    return name, row[start] if n else np.zeros(0, np.int64), low, high


def _marks(words: np.ndarray, offsets: np.ndarray, window: int, rounds: int):
    """Symbols that fit a window, as (name, row, reach from, reach to), and the windows (row, start) in which none fits."""
    name, row, low, high = parse(words, offsets, rounds)
    fits = (low >= offsets[row]) & (high <= offsets[row + 1]) & (high - low <= window)
    name, row, low, high = name[fits], row[fits], low[fits], high[fits]
    into = run_places(offsets, window)
    bare = np.flatnonzero(~_covered(low, high, row, offsets, into, window))
    bare_row = np.searchsorted(into, bare, "right") - 1
    return (name, row, low, high), into, (bare, bare_row)


def _covered(low, high, row, offsets, into, window) -> np.ndarray:
    """Of all windows (numbered through the rows), those in which one of these reaches lies."""
    count = into[row + 1] - into[row]
    first = np.maximum(high - offsets[row] - window, 0)
    last = np.minimum(low - offsets[row], count - 1)
    real = first <= last
    steps = np.zeros(into[-1] + 1, np.int64)
    np.add.at(steps, into[row[real]] + first[real], 1)
    np.add.at(steps, into[row[real]] + last[real] + 1, -1)
    return np.cumsum(steps)[:-1] > 0


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, pa.Array]:
    """Values by row, for rows that have any: the rows, and a list each."""
    order = np.argsort(rows, kind="stable")
    counts = np.bincount(rows, minlength=n)
    have = np.flatnonzero(counts)
    ends = np.concatenate([[0], np.cumsum(counts[have])]).astype(np.int32)
    return have, pa.ListArray.from_arrays(pa.array(ends), pa.array(values[order]))


class _Groups:
    """Entries grouped by equal keys; within a group by id, so that those of the least id come first."""

    def __init__(self, keys: tuple[np.ndarray, ...], ids: np.ndarray):
        self.order = np.lexsort((ids, *keys))
        new = np.ones(len(self.order), bool)
        new[1:] = np.any([k[self.order][1:] != k[self.order][:-1] for k in keys], axis=0)
        self.heads = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        tails = np.append(self.heads[1:], len(self.order)) - 1
        own = ids[self.order]
        self.first = self.order[self.heads]
        self.sent, self.shared = np.empty(len(ids), bool), np.empty(len(ids), bool)
        self.sent[self.order] = own == own[self.heads][self.group]
        self.shared[self.order] = (own[self.heads] < own[tails])[self.group]

    def others(self, values: np.ndarray, width: int = 1) -> pa.Array:
        """By group: the values (rows of `width`) of entries of the least id besides the first one; null where there are none."""
        more = self.sent[self.order]
        more[self.heads] = False
        counts = np.bincount(self.group[more], minlength=len(self.heads)) * width
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[self.order[more]].ravel()), mask=pa.array(counts == 0))


def _first_pass(window: int, rounds: int):
    """Marks (key, doc_id, place), and per row the places already known to be shared within the block.

    Of a mark one row a block is sent, for its least doc; `places` has the others of this doc there. In rows without a place,
    `places` are known to be shared.
    """

    def flush(held):
        names, rows, place, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        found = _Groups((names,), ids[rows])
        at = found.first
        yield pa.RecordBatch.from_arrays([pa.array(names[at].view(np.int64)), pa.array(ids[rows][at]), pa.array(place[at]), found.others(place)], ["key", "doc_id", "place", "places"])
        have, lists = _lists(rows[found.shared], place[found.shared], len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(splitmix(ids[have].view(_U)).view(np.int64)), pa.array(ids[have]), pa.nulls(len(have), pa.int64()), lists], ["key", "doc_id", "place", "places"])

    def run(batches):
        held, n, base = [], 0, 0
        for batch in batches:
            for part in slices(batch):
                words, offsets = word_table(part)
                ids, tags = part.column("doc_id").to_numpy(), part.column("tag").to_numpy()
                (name, row, low, _), into, (bare, bare_row) = _marks(words, offsets, window, rounds)
                start = bare - into[bare_row]
                rows = np.concatenate([row, bare_row])
                if not len(rows):
                    continue
                names = np.concatenate([name, run_hashes(words, offsets[bare_row] + start, window)])
                place = np.concatenate([low - offsets[row], -1 - start]) * TAGS + tags[rows]
                held.append((names, rows + base, place, ids))
                n, base = n + len(names), base + len(ids)
                if n >= BLOCK_ENTRIES:
                    yield from flush(held)
                    held, n, base = [], 0, 0
        if held:
            yield from flush(held)

    return run


def _second_pass(window: int, rounds: int):
    """Windows (key, check, doc_id, start) that may repeat, and per row the stretches known to repeat a doc of the block.

    A stretch is a pair of window starts, the second one exclusive. Of a window one row a block is sent, for its least doc;
    `stretches` has its others in this doc there. In rows without a start, `stretches` are known to repeat.
    """
    names = ["key", "check", "doc_id", "start", "stretches"]

    def flush(held):
        first, second, rows, start, low_start, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        found = _Groups((first, second), ids[rows])
        at, pairs = found.first, np.stack([low_start, low_start + TAGS], 1)
        yield pa.RecordBatch.from_arrays([pa.array(first[at].view(np.int64)), pa.array(second[at]), pa.array(ids[rows][at]), pa.array(low_start[at]), found.others(pairs, 2)], names)
        known = np.flatnonzero(~found.sent)
        if len(known):
            gap = (np.diff(known) > 1) | (rows[known][1:] != rows[known][:-1]) | (np.diff(start[known]) > 1)
            heads, tails = known[np.concatenate([[True], gap])], known[np.concatenate([gap, [True]])]
            pairs = np.stack([low_start[heads], low_start[tails] + TAGS], 1).ravel()
            have, lists = _lists(np.repeat(rows[heads], 2), pairs, len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(splitmix(ids[have].view(_U)).view(np.int64)), pa.nulls(len(have), pa.int32()), pa.array(ids[have]), pa.nulls(len(have), pa.int64()), lists], names)

    def run(batches):
        held, n, base = [], 0, 0
        for batch in batches:
            for part in slices(batch):
                words, offsets = word_table(part)
                ids, tags = part.column("doc_id").to_numpy(), part.column("tag").to_numpy()
                (_, row, low, high), into, (bare, bare_row) = _marks(words, offsets, window, rounds)
                places = part.column("places")
                owner = np.repeat(np.arange(len(ids)), pa.compute.list_value_length(places).to_numpy())
                values = pa.compute.list_flatten(places).to_numpy()
                own = values % TAGS == tags[owner]
                span = int(offsets[-1]) + 2
                code = lambda r, p: r * np.int64(2 * span) + p + span
                shared = np.sort(code(owner[own], values[own] // TAGS))
                alone = ~_among(code(row, low - offsets[row]), shared)
                out = ~_covered(low[alone], high[alone], row[alone], offsets, into, window)
                out[bare] = _among(code(bare_row, -1 - (bare - into[bare_row])), shared)
                at = np.flatnonzero(out)
                if not len(at):
                    continue
                r = np.searchsorted(into, at, "right") - 1
                start = at - into[r]
                first = run_hashes(words, offsets[r] + start, window)
                second = (run_hashes(splitmix(words ^ _U(0x1234567)), offsets[r] + start, window) >> _U(32)).astype(np.uint32).view(np.int32)
                held.append((first, second, r + base, start, start * TAGS + tags[r], ids))
                n, base = n + len(at), base + len(ids)
                if n >= BLOCK_ENTRIES:
                    yield from flush(held)
                    held, n, base = [], 0, 0
        if held:
            yield from flush(held)

    return run


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _last_pass(window: int):
    def run(batches):
        for batch in batches:
            n_words, n_removed, digest, kept = [], [], [], []
            for text, at, pairs, tag in zip(batch.column("text"), batch.column("starts"), batch.column("stretches"), batch.column("tag").to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                if at.is_valid and len(at) + len(pairs):
                    steps = np.zeros(len(words) + 1, np.int32)
                    one, two = at.values.to_numpy(zero_copy_only=False), pairs.values.to_numpy(zero_copy_only=False).reshape(-1, 2)
                    for low, high in ((one, one + TAGS), (two[:, 0], two[:, 1])):
                        own = low % TAGS == tag
                        np.add.at(steps, low[own] // TAGS, 1)
                        np.add.at(steps, high[own] // TAGS - 1 + window, -1)
                    gone = np.cumsum(steps)[:-1] > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                joined = b" ".join(words)
                digest.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Cuts words that a window repeats from a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256 and kept_text (the kept words, joined by one space), one row per
    row of docs. Other columns of docs are ignored.
    """
    prepare(docs.sparkSession)
    stand_in = F.lit(-(1 << 62)) - F.abs(F.coalesce(F.xxhash64("text"), F.lit(0)) % (1 << 60))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), stand_in).alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.filter("doc_id is not null")  # always true; the inner join below asks for it, and so both joins' inputs are alike
    # Where no doc_id repeats, as a shuffle of ids alone tells, tags are 0 and cost no space in the shuffles below.
    repeated = not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    docs = docs.withColumn("tag", F.coalesce(F.pmod(F.xxhash64("text"), F.lit(TAGS)), F.lit(0)) if repeated else F.lit(0).cast("long"))
    # Windows over a key hold a row per block of text at most: what a block shares is known there.
    by_key = W.partitionBy("key")
    marks = docs.mapInArrow(_first_pass(window, rounds), "key long, doc_id long, place long, places array<long>")
    sent = F.when(F.col("place").isNotNull(), F.col("doc_id"))
    marks = marks.withColumn("low", F.min(sent).over(by_key)).withColumn("high", F.max(sent).over(by_key)).filter("place is null or low < high")
    places = marks.groupBy("doc_id").agg(F.collect_list("place").alias("one"), F.flatten(F.collect_list("places")).alias("many"))
    places = places.select("doc_id", F.concat("one", "many").alias("places"))
    windows = docs.join(places, "doc_id").mapInArrow(_second_pass(window, rounds), "key long, check int, doc_id long, start long, stretches array<long>")
    sent = F.when(F.col("start").isNotNull(), F.col("doc_id"))
    taken = windows.withColumn("low", F.min(sent).over(W.partitionBy("key", "check"))).filter("start is null or low < doc_id")
    taken = taken.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.flatten(F.collect_list("stretches")).alias("stretches"))
    # Both joins read one exchange of the texts, whose plans are alike.
    out = docs.join(taken, "doc_id", "left").select("doc_id", "text", "tag", "starts", "stretches").mapInArrow(_last_pass(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") >= -(1 << 61), F.col("doc_id")))
