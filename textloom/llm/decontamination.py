"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number q of five-word shingles into classes [2**k, 2**(k+1)). For class k every document is cut
into segments of 2**(k+2) shingles, one starting every 2**(k+1), so that a copy of an item lies whole in a segment of
bounded size and containment t means a Jaccard similarity of t / (4 + ...) at least, however long the document is. A segment
is a candidate where one of HASHES minima equals an item's; that misses an item with a chance below (1 - t / 5) ** HASHES.
Minima are evaluated where they can matter: a segment's i-th minimum can equal an item's only if it holds the very shingle
that is the item's i-th minimum, so other segments' minima are never computed. Candidates are verified by exact containment
of the item's shingles in the whole document.

Words are lower-cased and split at white space and ASCII punctuation. Items of fewer than five words have no shingle and match
nothing, as do null and empty texts on either side. Items are a stated query set: they are taken in blocks of
bounded size, each broadcast. Repeated rows give repeated results; equal items each match, those without an item_id too, which show null for it.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, prepare, rolling, slices, splitmix, text_bytes

_U = np.uint64
SHINGLE, CONTAINMENT, HASHES = 5, 0.8, 64
#: Most bytes of item texts in a broadcast block.
BLOCK_BYTES = 16 << 20
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[ord(c) for c in string.punctuation]] = 0x20
_SEEDS = splitmix(np.arange(1000, 1000 + HASHES, dtype=_U))


def shingle_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's shingles in their order, and where rows start."""
    data, at = text_bytes(pc.utf8_lower(column))
    starts, _, hashes = hash_words(_PLAIN[data], at[:-1][at[:-1] < len(data)])
    return rolling(hashes, np.searchsorted(starts, at), SHINGLE)


class Index:
    """Items by size class: for each class the shingles that are minima, sorted, with (item, number of the hash)."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        runs, into = shingle_runs(pa.array(texts, pa.string()))
        self.ids, self.sets = list(ids), [np.unique(runs[a:b]) for a, b in zip(into, into[1:], strict=False)]
        rows: dict[int, list] = {}
        for item, own in enumerate(self.sets):
            if len(own):
                least = own[splitmix(own[None, :] ^ _SEEDS[:, None]).argmin(1)]
                rows.setdefault(int(len(own)).bit_length() - 1, []).append((least, np.full(HASHES, item), np.arange(HASHES)))
        self.classes = {}
        for k, x in rows.items():
            least, item, which = (np.concatenate(c) for c in zip(*x, strict=True))
            order = np.argsort(least, kind="stable")
            self.classes[k] = least[order], item[order], which[order]

    def candidates(self, runs: np.ndarray, into: np.ndarray) -> np.ndarray:
        """Distinct (row, item) of which a segment and the item share a minimum."""
        found = []
        row_of = None
        for k, (least, item, which) in self.classes.items():
            place = np.minimum(np.searchsorted(least, runs), len(least) - 1)
            hit = np.flatnonzero(least[place] == runs)
            if not len(hit):
                continue
            row_of = np.repeat(np.arange(len(into) - 1), np.diff(into)) if row_of is None else row_of
            n = np.searchsorted(least, runs[hit], "right") - place[hit]
            at = np.repeat(hit, n)
            entry = np.repeat(place[hit], n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            stride, size = 2 << k, 4 << k
            for i in range(0, len(at), 1 << 11):
                p, e = at[i : i + (1 << 11)], entry[i : i + (1 << 11)]
                row = row_of[p]
                own = splitmix(runs[p] ^ _SEEDS[which[e]])
                good = np.zeros(len(p), bool)
                for back in (0, 1):  # the two segments that hold a place
                    start = np.maximum(((p - into[row]) // stride - back) * stride, 0) + into[row]
                    cells = start[:, None] + np.arange(size)[None, :]
                    inside = cells < into[row + 1][:, None]
                    values = splitmix(runs[np.where(inside, cells, p[:, None])] ^ _SEEDS[which[e]][:, None])
                    good |= values.min(1) == own
                found.append(np.stack([row[good], item[e[good]]], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def search(self, column: pa.Array, containment: float) -> list[tuple[int, int | None, int, int]]:
        """(row, item_id, shared shingles, the item's shingles) of each match."""
        runs, into = shingle_runs(column)
        out = []
        for row, item in self.candidates(runs, into).tolist():
            own = self.sets[item]
            shared = int(np.isin(own, runs[into[row] : into[row + 1]]).sum())
            if shared >= containment * len(own) - 1e-9:
                out.append((row, self.ids[item], shared, len(own)))
        return out


def _blocks(items: DataFrame, block_bytes: int):
    """Broadcast indexes of the items, block by block."""
    items = items.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        rows = (items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).collect()
        yield items.sparkSession.sparkContext.broadcast(Index([r.item_id for r in rows], [r.text for r in rows]))


def find_leaks(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of each document that holds an item."""
    prepare(docs.sparkSession)
    docs, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), None

    def search(index):
        def run(batches):
            for batch in batches:
                for part in slices(batch):
                    if found := index.value.search(part.column("text"), containment):
                        row, item, shared, size = zip(*found, strict=True)
                        shared, size = np.array(shared), np.array(size)
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(item, pa.int64()), *(pa.array(x) for x in (shared, size, shared / size))], ["doc_id", "item_id", "n_shared", "n_item", "containment"])

        return run

    for index in _blocks(items, block_bytes):
        own = docs.mapInArrow(search(index), "doc_id long, item_id long, n_shared long, n_item long, containment double")
        out = own if out is None else out.unionByName(own)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, all columns, without the rows whose text holds an item. Decided row by row, without a shuffle."""
    prepare(docs.sparkSession)

    def clean(index):
        def run(batches):
            for batch in batches:
                for part in slices(batch):
                    keep = np.ones(len(part), bool)
                    keep[[x[0] for x in index.value.search(part.column(part.schema.get_field_index("text")), containment)]] = False
                    yield part.filter(pa.array(keep))

        return run

    for index in _blocks(items, block_bytes):
        docs = docs.mapInArrow(clean(index), docs.schema)
    return docs
