"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles (words are runs without ASCII white space, unchanged; a text of one to four
words is one shingle). Each run samples about 1/threshold of a set's shingles by a hash that all sets share,
and each sampled shingle is a bucket: two sets of similarity s >= threshold meet in a run with probability 1 - 1/e at least.
Buckets of more than `small` sets are split by a further shared shingle, drawn
from the bucket's path, up to `depth` times; two sets draw the same one with probability s. A run so brings a pair together
with p = (1 - 1/e) * threshold ** (depth - 1) at least, and it takes log(1 - recall) / log(1 - p) runs to reach the target recall.
Sets of few shingles have too few draws for that, so pairs with a set below SHORT
shingles are also found without chance: sets are ordered by how many short sets hold a shingle, and two similar ones share one
in their prefixes. Small buckets are brute-forced for candidate links; buckets that stay large share
`depth` drawn shingles and are taken as one dense candidate group. Candidate links are closed to groups, and within a
group every pair is compared exactly, by incidence products over blocks of bounded size: no pair is dropped for a group's
size, and no pair becomes a row.

Candidates must meet in SHARE of the smaller set's samples. In 16 runs a pair at threshold 0.8 has M ~ Poisson(16) common samples and
O ~ Poisson(4) others, and SHARE asks for M >= 0.18 O: a chance of 5e-7 to fail, far below what the recall allows. Meetings behind a path
of k shingles weigh 1 / 0.8 ** (k - 1) or more, the inverse of the chance that one lasts so long.

A distinct text has a key of its own, a hash of its content, whatever its rows' doc_ids are; where two texts share one (n ** 2 / 2 ** 65
texts of n, told by a second hash), their keys are the second hash. Equal texts (empty ones too) are one class from the
start and join as one set with a count. A null text is a class of its own. A class is named by its least doc_id, null if all are
null. Repeated rows count as copies. Results do not depend on partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, fresh, prepare, quoted, rolling, slices, splitmix, word_table

_U = np.uint64
SHINGLE, THRESHOLD, RECALL, SMALL, DEPTH = 5, 0.8, 0.9975, 24, 4
#: A meeting in a small bucket weighs more the longer its path; candidates need this share of the sampled shingles.
WEIGHTS, SHARE = (1.0, 1.5, 2.5, 4.0), 0.15
#: Pairs with a set of fewer shingles are found by prefixes, exactly.
SHORT = 20
#: Bounds of one block of a group: sets, and shingles in all.
BLOCK_SETS, BLOCK_SHINGLES = 4096, 1_500_000
#: Keys that a task remembers, so as not to work on copies again.
SEEN = 1 << 18


def shingles(words: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's set of shingles, sorted by both."""
    hashes, into = rolling(words, offsets, n)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(into))
    counts = np.diff(offsets)
    for k in range(1, n):
        few = np.flatnonzero(counts == k)
        if len(few):
            at = np.stack([offsets[few], offsets[few] + k], 1).ravel()
            own = np.concatenate([words[a:b] for a, b in at.reshape(-1, 2)])
            h, _ = rolling(own, np.arange(len(few) + 1) * k, k)
            hashes, row = np.concatenate([hashes, splitmix(h + _U(k))]), np.concatenate([row, few])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new]


def runs_for(recall: float, threshold: float, depth: int) -> int:
    """Runs that bring a pair at the threshold together with the target recall, if all its buckets are split to the end."""
    one = (1 - math.exp(-1)) * threshold ** (depth - 1)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - one)))


def _once(batches):
    """Batches (key, text) without texts that this task has seen lately; copies that slip through are dropped after the shuffle."""
    seen: set[int] = set()
    for batch in batches:
        new = []
        for key in batch.column("key").to_pylist():
            new.append(key not in seen)
            seen.add(key)
        if len(seen) > SEEN:
            seen.clear()
        yield batch.filter(pa.array(new, pa.bool_()))


def _paths(runs: int, threshold: float, depth: int):
    """Rows (key, number of sampled shingles, path): a path is a sampled shingle and the shingles drawn after it."""
    fields = [f"p{k}" for k in range(1, depth + 1)]

    def run(batches):
        for batch in _once(batches):
            for part in slices(batch):
                row, sh = shingles(*word_table(part))
                if not len(row):
                    continue
                ids = part.column("key").to_numpy()
                size = np.bincount(row, minlength=len(ids))
                # Run r samples the hashes in [r, r + width): runs are disjoint, and widths shrink with a set's size.
                place = splitmix(sh ^ _U(0xC0FFEE)).astype(np.float64) * (runs / 2.0**64)
                taken = place - np.minimum(np.floor(place), runs - 1) < np.minimum(1.0, runs / (threshold * size[row]))
                row, sh = row[taken], sh[taken]
                heads, counts = np.unique(row, return_counts=True)
                ends = np.cumsum(counts)
                paths = np.empty((depth, len(sh)), _U)
                for lo, hi in zip(ends - counts, ends, strict=True):
                    own = sh[lo:hi]
                    paths[0, lo:hi] = path = splitmix(own)
                    for k in range(1, depth):
                        drawn = splitmix(path[:, None] ^ own[None, :])
                        np.fill_diagonal(drawn, ~_U(0))
                        paths[k, lo:hi] = path = splitmix(path + own[drawn.argmin(1)])
                short = [pa.array((x >> _U(32)).astype(np.uint32).view(np.int32)) for x in paths[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(np.repeat(counts, counts).astype(np.int32)), pa.array(paths[0].view(np.int64)), *short], ["key", "n_sampled", *fields])

    return run, "key long, n_sampled int, p1 long" + "".join(f", {f} int" for f in fields[1:])


def _candidates(paths: DataFrame, small: int, depth: int, share: float) -> DataFrame:
    """Candidate links (u, v): pairs of sets that meet in enough small buckets, and stars over dense groups."""
    left, leaves = paths, []
    for k in range(1, depth + 1):
        path = [f"p{j}" for j in range(1, k + 1)]
        counts = left.groupBy(*path).agg(F.count("*").alias("n_in"), F.min("key").alias("low"))
        split = left.join(counts.filter("n_in > 1"), path).checkpoint()
        leaves.append(split.filter(F.col("n_in") <= small).select(F.xxhash64(*path).alias("leaf"), "key", "n_sampled", F.lit(WEIGHTS[min(k, len(WEIGHTS)) - 1]).alias("weight")))
        left = split.filter(F.col("n_in") > small)
        if k < depth:
            left = left.drop("n_in", "low")
    met = leaves[0]
    for x in leaves[1:]:
        met = met.unionByName(x)
    other = met.select("leaf", F.col("key").alias("v"), F.col("n_sampled").alias("m_sampled"))
    close = met.withColumnRenamed("key", "u").join(other, "leaf").filter("u > v").groupBy("u", "v").agg(F.sum("weight").alias("met"), F.max(F.least("n_sampled", "m_sampled")).alias("least"))
    dense = left.select(F.col("key").alias("u"), F.col("low").alias("v")).filter("u <> v")
    return close.filter(F.col("met") >= share * F.col("least")).select("u", "v").union(dense)


def _short_sets(most: int):
    """Rows (key, sh): all shingles of the sets of at most `most` shingles."""

    def run(batches):
        for batch in _once(batches):
            for part in slices(batch):
                row, sh = shingles(*word_table(part))
                own = np.bincount(row, minlength=len(part))[row] <= most
                row, sh = row[own], sh[own]
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(part.column("key").to_numpy()[row]), pa.array(sh.view(np.int64))], ["key", "sh"])

    return run, "key long, sh long"


def _short_candidates(sets: DataFrame, small: int, thousandths: int) -> DataFrame:
    """Candidate links (u, v) among short sets, none missing: close pairs of small prefix buckets, and stars over large ones."""
    often = sets.groupBy("sh").agg(F.count("*").alias("n")).filter(F.col("n") > small)
    ranked = sets.join(often, "sh", "left").select("key", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "sh").alias("x"))
    own = ranked.groupBy("key").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["sh"]).alias("own"))  # short sets only
    size = F.size("own")
    prefix = size - F.ceil(size * thousandths / F.lit(1000) - 1e-9).cast("int") + 1
    rows = own.select("key", "own", F.explode(F.slice("own", F.lit(1), prefix)).alias("sh"))
    counts = rows.groupBy("sh").agg(F.count("*").alias("n_in"), F.min("key").alias("low")).filter("n_in > 1")
    split = rows.join(counts, "sh").checkpoint()
    met = split.filter(F.col("n_in") <= small)
    pairs = met.select("sh", F.col("key").alias("u"), "own").join(met.select("sh", F.col("key").alias("v"), F.col("own").alias("other")), "sh").filter("u > v")
    close = F.size(F.array_intersect("own", "other")) * (1000 + thousandths) >= thousandths * (F.size("own") + F.size("other"))
    dense = split.filter(F.col("n_in") > small).select(F.col("key").alias("u"), F.col("low").alias("v")).filter("u <> v")
    return pairs.filter(close).select("u", "v").union(dense)


def _common(row_a, sh_a, n_a, row_b, sh_b, n_b) -> np.ndarray:
    """Sizes of the intersections of two lists of sets; rare shingles by enumeration, frequent ones by products."""
    out = np.zeros(n_a * n_b, np.float32)
    keys = np.intersect1d(sh_a, sh_b)

    def columns(row, sh):
        at = np.minimum(np.searchsorted(keys, sh), len(keys) - 1)
        hit = keys[at] == sh
        col, row = at[hit], row[hit]
        order = np.argsort(col, kind="stable")
        return row[order], np.searchsorted(col[order], np.arange(len(keys) + 1))

    if not len(keys):
        return out.reshape(n_a, n_b)
    (ra, ia), (rb, ib) = columns(row_a, sh_a), columns(row_b, sh_b)
    ca, cb = np.diff(ia), np.diff(ib)
    often = ca * cb > max(256, n_a * n_b // 150)
    few = np.flatnonzero(~often)
    sums = np.cumsum(ca[few] * cb[few])
    i = 0
    while i < len(few):
        j = max(i + 1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + 1_000_000, "right")))
        k = few[i:j]
        n = ca[k] * cb[k]
        which = np.repeat(np.arange(len(k)), n)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        wide = cb[k][which]
        np.add.at(out, ra[ia[k][which] + nth // wide] * n_b + rb[ib[k][which] + nth % wide], np.float32(1))
        i = j
    out = out.reshape(n_a, n_b)
    often = np.flatnonzero(often)
    for i in range(0, len(often), 256):
        k = often[i : i + 256]
        x, y = np.zeros((n_a, len(k)), np.float32), np.zeros((n_b, len(k)), np.float32)
        for c, key in enumerate(k):
            x[ra[ia[key] : ia[key + 1]], c] = 1
            y[rb[ib[key] : ib[key + 1]], c] = 1
        out += x @ y.T
    return out


def _cell(ids, copies, side, row, sh, thousandths: int) -> list:
    """Links within one block (side 0) or between two (sides -1 and 1): parts of (key, least linked key, links)."""
    size = np.bincount(row, minlength=len(ids))
    place = np.zeros(len(ids), np.int64)

    def pick(mask):
        place[mask] = np.arange(mask.sum())
        own = mask[row]
        return np.flatnonzero(mask), place[row[own]], sh[own]

    a, row_a, sh_a = pick(side <= 0)
    b, row_b, sh_b = pick(side > 0) if side.any() else (a, row_a, sh_a)
    if not len(a) or not len(b):
        return []
    both = _common(row_a, sh_a, len(a), row_b, sh_b, len(b))
    # J >= t if and only if common * (1 + t) >= t * (sum of sizes); in whole thousandths, exact in doubles.
    near = np.empty(both.shape, bool)
    for i in range(0, len(a), 512):
        k = a[i : i + 512]
        near[i : i + 512] = (both[i : i + 512].astype(np.float64) * (1000 + thousandths) >= thousandths * (size[k][:, None] + size[b][None, :])) & (both[i : i + 512] > 0) & (ids[k][:, None] != ids[b][None, :])
    r, c = np.nonzero(near)
    root_a, root_b = ids[a].copy(), ids[b].copy()
    while len(r):
        was = root_a.copy(), root_b.copy()
        low = np.minimum(root_a[r], root_b[c])
        np.minimum.at(root_a, r, low)
        np.minimum.at(root_b, c, low)
        if b is a:
            root_a = root_b = np.minimum(root_a, root_b)
        if np.array_equal(root_a, was[0]) and np.array_equal(root_b, was[1]):
            break
    out = [(ids[a], root_a, np.bincount(r, copies[b][c], len(a)))]
    if b is not a:
        out.append((ids[b], root_b, np.bincount(c, copies[a][r], len(b))))
    return out


def _verify(thousandths: int):
    """Of rows sorted by cell: each key's links in a cell, and the least key that it is linked with there."""

    def batch_of(parts):
        key, root, links = (np.concatenate(c) for c in zip(*parts, strict=True))
        keep = links > 0
        return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(root[keep]), pa.array(links[keep].astype(np.int64))], ["key", "root", "links"])

    def flush(held):
        part = pa.Table.from_batches(held).combine_chunks()
        ids = part.column("key").to_numpy()
        rows, hashes, base = [], [], 0
        for x in part.to_batches():
            for y in slices(x):
                r, h = shingles(*word_table(y))
                rows.append(r + base)
                hashes.append(h)
                base += len(y)
        return _cell(ids, part.column("copies").to_numpy(), part.column("side").to_numpy(), np.concatenate(rows), np.concatenate(hashes), thousandths)

    def run(batches):
        held, key, out = [], None, []
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]])) if len(cells) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and cells[lo] != key:
                    out += flush(held)
                    held = []
                    if len(out) > 1000:
                        yield batch_of(out)
                        out = []
                key = cells[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            out += flush(held)
        if out:
            yield batch_of(out)

    return run


def _rows(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame, Column]:
    """Rows (doc_id, key, chars) of texts, the distinct texts (key, first, n_copies, chars), and the key as an expression of `text`."""
    text = F.col("text").cast("string")
    one, two = F.shiftright(F.xxhash64(text), 64 - bits) if bits < 64 else F.xxhash64(text), F.xxhash64(text, F.lit(7))
    rows = docs.filter(text.isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("chars"), one.alias("a"), two.alias("b")).checkpoint()
    texts = rows.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"), F.max("chars").alias("chars")).checkpoint()
    shared = [r.a for r in texts.groupBy("a").count().filter("count > 1").select("a").collect()]  # collisions of 64-bit hashes
    key = lambda a, b: F.when(a.isin(shared), b).otherwise(a) if shared else a
    named = key(F.col("a"), F.col("b")).alias("key")
    return rows.select("doc_id", named), texts.select(named, "first", "n_copies", "chars"), key(one, two)


def text_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL, depth: int = DEPTH, bits: int = 64) -> tuple[DataFrame, DataFrame, Column]:
    """Rows (doc_id, key) of texts; a table of distinct texts (key, first, n_copies, n_links, class_id, class_key); the key of `text`.

    first: the least doc_id of a text; n_links: rows within the threshold besides one's own; class_id and class_key: the least doc_id in
    the class, and a text that has it. bits: of a key's hash, fewer in tests only.
    """
    spark = prepare(docs.sparkSession)
    rows, firsts, key = _rows(docs, bits)
    texts = docs.filter(F.col("text").isNotNull()).select(key.alias("key"), F.col("text").cast("string").alias("text"))
    run, schema = _paths(runs_for(recall, threshold, depth), threshold, depth)
    paths = texts.mapInArrow(run, schema).distinct().checkpoint()
    run, schema = _short_sets(int(SHORT / threshold))
    short = texts.mapInArrow(run, schema).distinct().checkpoint()
    candidates = _candidates(paths, small, depth, SHARE).union(_short_candidates(short, small, round(threshold * 1000)))
    sizes = firsts.select("key", "chars", F.col("n_copies").alias("copies"))
    groups = components(candidates).withColumnRenamed("node", "key").join(sizes, "key").checkpoint()

    # A large group's sets are dealt by hash into parts of bounded size; each pair of parts is a cell.
    parts = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("chars") / (6 * BLOCK_SHINGLES), F.lit(1))).cast("int")
    blocks = groups.groupBy("root").agg(parts.alias("parts")).filter("parts > 1")
    dealt = groups.join(blocks, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("key", F.lit(3)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.signum(F.col("part") - F.col("other")).cast("int")
    dealt = dealt.select("key", "copies", F.xxhash64("root", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), side.alias("side"))
    # Copies of a text are dropped before and after the exchange, so none of them meets its cells twice.
    cells = dealt.join(texts.dropDuplicates(["key"]), "key").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell", "key")
    found = cells.mapInArrow(_verify(round(threshold * 1000)), "key long, root long, links long").checkpoint()

    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("key").alias("u"), F.col("root").alias("v"))).toDF("key", "class")
    table = firsts.join(links, "key", "left").join(classes, "key", "left").withColumn("class", F.coalesce("class", "key"))
    named = table.groupBy("class").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "key")).alias("least"))
    table = table.join(named, "class").select("key", "first", "n_copies", (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"), F.col("least.first").alias("class_id"), F.col("least.key").alias("class_key"))
    return rows, table, key


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL, depth: int = DEPTH, bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, class_id, same_text_id, n_copies, n_links.

    class_id: the least doc_id that links lead to; same_text_id: the least doc_id of this very text; n_copies: rows
    with this very text; n_links: other rows within the threshold. Other columns of docs are ignored.
    """
    rows, table, _ = text_classes(docs, threshold, recall, small, depth, bits)
    out = rows.join(table, "key").select("doc_id", "class_id", F.col("first").alias("same_text_id"), "n_copies", "n_links")
    one, none, doc = F.lit(1).cast("long"), F.lit(0).cast("long"), F.col("doc_id").cast("long")
    return out.unionByName(docs.filter(F.col("text").isNull()).select(doc.alias("doc_id"), doc.alias("class_id"), doc.alias("same_text_id"), one.alias("n_copies"), none.alias("n_links")))


def keep_one(docs: DataFrame, **limits) -> DataFrame:
    """docs, all columns, with one row of each class: a row with its least doc_id, one with a null doc_id only if all are null.

    Rows with null texts stay. Decisions are keyed by doc_id and text; of rows that share both, one stays.
    """
    rows, table, key = text_classes(docs, **limits)
    told = rows.join(table.filter("n_links > 0"), "key").groupBy("key", "doc_id", "first", "class_key").agg(F.count("*").alias("n"))
    stays = (F.col("key") == F.col("class_key")) & F.col("doc_id").eqNullSafe(F.col("first"))
    told = told.select("key", "doc_id", stays.alias("stays"), "n").filter("not stays or n > 1").checkpoint()
    k, of, doc = fresh(docs, "key", "of", "doc")
    match = (F.col(k) == F.col(of)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc))
    side = lambda t: t.select(F.col("key").alias(of), F.col("doc_id").alias(doc))
    left = docs.withColumn(k, key).join(side(told.filter("not stays")), match, "left_anti")
    columns, repeats = [F.col(quoted(c)) for c in docs.columns], side(told.filter("stays"))
    if repeats.isEmpty():
        return left.select(*columns)
    once = left.join(repeats, match, "left_semi").dropDuplicates([k])
    return left.join(repeats, match, "left_anti").select(*columns).unionByName(once.select(*columns))
