"""Each operator against a plain version, on small tables with nulls, ties, repeats, long and empty texts."""

import random
import zlib
from collections import Counter, defaultdict

import brute
import pytest

from textloom.llm import chosen_path, decontamination, langid, mixing, quality, recompression, sharding, token_counts

SF = "/root/testdata/sf0.001/documents.parquet"
ODD = [None, "", " \n\t ", "a", "a b", "a b", "a b c d", "a b c d e", "é ü 😀 word", "x" * 5000, None, ""]


def table(spark, rows, schema="doc_id long, text string"):
    """Rows with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, schema).withColumns({c: F.lit(k) for k, c in enumerate(("key", "size", "h", "tag", "host"))})


def patchwork(seed, n=60):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh") for _ in range(60)] for _ in range(3)]
    rows = []
    for d in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            b, i = rng.choice(base), rng.randint(0, 40)
            w += b[i : i + rng.randint(1, 50)] + [rng.choice("abcdefghij") for _ in range(rng.randint(0, 9))]
            if rng.random() < 0.3:
                w += ["z"] * rng.randint(1, 30)
        rows.append((d, " ".join(w)))
    return rows + [(100 + i, t) for i, t in enumerate(ODD)] + [(200, rows[3][1])]


@pytest.mark.parametrize(("window", "rounds"), [(5, 2), (12, 4), (20, 5), (50, 7)])
def test_removed_words(spark, window, rounds):
    rows = patchwork(window)
    got = recompression.remove_repeats(table(spark, rows), window, rounds).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute.remove_repeats(rows, window)


@pytest.mark.parametrize("block", [1, 300])
def test_removed_words_do_not_depend_on_blocks(spark, monkeypatch, block):
    """Blocks are of a task's own; workers are forked with the module as it is here, or read the size from the closure."""
    rows = patchwork(17, 80) + [(300 + i, "same " * 90 + str(i % 3)) for i in range(9)]
    docs = [(d, t) for d, t in rows]
    import pandas as pd
    import pyarrow as pa

    monkeypatch.setattr(recompression, "BLOCK_ENTRIES", block)
    batch = pa.RecordBatch.from_pandas(pd.DataFrame({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs], "tag": 0}))
    whole = list(recompression._first_pass(12, 4)(iter([batch.slice(0, 40), batch.slice(40)])))
    assert len(whole) >= (4 if block == 1 else 2)
    keys = [k for b in whole for k, p in zip(b.column("key").to_pylist(), b.column("place").to_pylist()) if p is not None]
    assert block == 1 or len(keys) == len(set(keys)) or len(whole) > 2
    got = recompression.remove_repeats(table(spark, rows), 12, 4).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute.remove_repeats(rows, 12)


def test_removed_words_of_rows_that_share_an_id_or_have_none(spark):
    a, b = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(5, a), (5, a), (5, b), (7, a + " x"), (7, "x " + b), (None, "q " + b), (None, None)]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in recompression.remove_repeats(table(spark, rows), 10, 3).collect())
    assert got == [(-1, 0, 0), (-1, 31, 0), (5, 30, 0), (5, 30, 0), (5, 30, 30), (7, 31, 30), (7, 31, 30)]


def copies(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(120)] for _ in range(5)]
    rows = []
    for d in range(300):
        w = list(base[d % 5])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((d, " ".join(w)))
    rows += [(1000 + i, t) for i, t in enumerate(ODD)]
    return rows + [(2000 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for i in range(50)]


@pytest.mark.parametrize("block", [20, 4096])
def test_near_duplicate_classes(spark, monkeypatch, block):
    monkeypatch.setattr(chosen_path, "BLOCK_SETS", block)
    rows = copies()
    got = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.near_duplicate_classes(table(spark, rows)).collect()}
    assert got == brute.classes(rows)


def test_near_duplicate_classes_of_the_test_table(spark):
    docs = spark.read.parquet(SF)
    got = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.near_duplicate_classes(docs).collect()}
    assert got == brute.classes([(r.doc_id, r.text) for r in docs.collect()])


def test_near_duplicates_with_null_and_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(40))
    got = Counter((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in chosen_path.near_duplicate_classes(table(spark, [(None, t), (3, t), (3, t), (4, t + " x"), (None, None)])).collect())
    assert got == Counter({(None, 3, 3, 3): 1, (3, 3, 3, 3): 2, (4, 3, 1, 3): 1, (None, None, 1, 0): 1})


def leaky(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"Word{i}" for i in range(3000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([5, 6, 9, 14, 20, 33, 60, 130])))) for i in range(40)] + [(90, None), (91, ""), (92, "four words are few"), (93, items0 := "Equal Items here are two"), (94, items0)]
    rows = []
    for d in range(400):
        w = some(rng.choice([0, 3, 40, 200, 900]))
        if d % 2:
            own = (items[rng.randrange(40)][1]).split()
            for _ in range(rng.randint(0, 2) * len(own) // 20):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randint(0, len(w))
            w = w[:at] + [x.upper() + "," for x in own] + w[at:]
        rows.append((d, " ".join(w)))
    return [*rows, (900, "so equal items here are two!"), *[(1000 + i, t) for i, t in enumerate(ODD)]], items


def test_leaks(spark):
    rows, items = leaky()
    items_table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontamination.find_leaks(table(spark, rows), items_table).collect())
    assert got == brute.leaks(rows, items) and len(got) > 150
    blocks = sorted((r.doc_id, r.item_id) for r in decontamination.find_leaks(table(spark, rows), items_table, block_bytes=1500).collect())
    assert blocks == got
    docs = table(spark, rows)
    clean = decontamination.drop_leaks(docs, items_table)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == sorted({d for d, _ in rows} - {d for d, _ in got})


def test_quality(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "bb", "c#", "d\n", "é|", "\n\n", "same line\n"]) for _ in range(rng.randint(0, 90))), f"h{i % 3}" if i % 7 else None) for i in range(150)]
    rows += [(500 + i, "good words " + " ".join(f"w{k}" for k in range(60)), "h9") for i in range(5)] + [(600 + i, t, "bad") for i, t in enumerate(ODD * 4)]
    got = {r.doc_id: r for r in quality.quality_verdicts(table(spark, rows, "doc_id long, text string, source string")).collect()}
    assert len(got) == len(rows)
    for d, t, host in rows:
        m = brute.measures(t)
        r = got[d]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == m, t
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert r.kept == (not r.base_failed and r.host_rate <= 0.5)
    assert got[500].kept and got[600].host_rate > 0.5


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "b", "B", "é", "z", None, "lone"][: 3 + i % 5])) for i in range(700)] + [(None, None, "a"), (3, "x y", "a"), (3, "x y", "a")]
    docs = table(spark, rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(brute.words(t))
    want, taken = brute.fill(sizes, (5, 2, 1), 1.5, 2.0), defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        assert r.taken >= (r.target // sizes[r.source]) * r.size - 1e-6 if sizes[r.source] else r.taken == 0
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    whole = mixing.mixed_rows(docs).collect()
    assert set(whole[0].asDict()) == set(docs.columns)
    mixed = defaultdict(int)
    for r in whole:
        mixed[r.source] += len(brute.words(r.text))
    assert all(abs(mixed[s] - want[s]) <= 300 for s in want)


def test_mixing_prefers_heavy_documents(spark):
    from pyspark.sql import functions as F

    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(3000)]
    docs = table(spark, rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, weight=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0), share=0.5).collect()
    even = sum(r.taken for r in got if r.doc_id % 2 == 0)
    assert even > 0.6 * sum(r.taken for r in got)


def test_best_fit_decreasing():
    rng = random.Random(7)
    for _ in range(30):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 80))]
        bins = sharding.best_fit_decreasing(sizes, 60)
        room, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fit = [(r, b) for b, r in enumerate(room) if r >= sizes[i]]
            b = min(fit)[1] if fit else len(room)
            if not fit:
                room.append(60)
            room[b] -= sizes[i]
            want[i] = b
        assert bins == want


def test_shards(spark):
    rng = random.Random(8)
    rows = [(i, "hot text " * 9) for i in range(900)] + [(1000 + i, "w" * rng.randint(0, 300)) for i in range(2500)] + [(9000 + i, t) for i, t in enumerate(ODD)] + [(None, "x"), (9999, "same"), (9999, "same")]
    got = sharding.shard(table(spark, rows)).collect()
    assert len(got) == len(rows)
    loads, slots, groups = defaultdict(int), defaultdict(list), defaultdict(set)
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(t)
    for r in got:
        t = texts[r.doc_id][0]
        assert r.size == len((t or "").encode()) + 16 and r.text_crc32 == zlib.crc32((t or "").encode()) and r.law == "bytes" and r.grown_shard is None
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[t].add(r.shard)
    assert set(loads) == set(range(40)) and max(loads.values()) - min(loads.values()) <= 0.05 * sum(loads.values()) / 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    hot = groups.pop("hot text " * 9)  # larger than a shard
    assert all(len(s) == 1 for s in groups.values()) and len(hot) > 1


def test_language_ids(spark):
    docs = spark.read.parquet(SF)
    model = langid.train(docs.filter(~langid.held_out()))
    got = {r.doc_id: r for r in langid.predict(docs, model, ["doc_id"]).collect()}
    rows = docs.collect()
    assert sum(got[r.doc_id].lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.predict(docs, model, docs.columns, only_accepted=True).collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, r in got.items() if not r.rejected) and set(kept[0].asDict()) == set(docs.columns)
    odd = langid.predict(table(spark, list(enumerate([None, "", "123 !?", "ok"]))), model, ["doc_id"]).collect()
    assert [r.lang_pred for r in sorted(odd)][:3] == ["und"] * 3 and sorted(odd)[3].lang_pred != "und"
    held = {r.doc_id: r.h for r in docs.select("doc_id", langid.held_out().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in held.items())


def test_token_counts(spark):
    texts = [r.text for r in spark.read.parquet(SF).collect()] + ODD
    with open(token_counts.RANKS, "rb") as f:
        count = token_counts.encoder(f.read())
    lengths = [count(t or "") for t in texts]
    sums = token_counts.suffix_sums(token_counts.histogram(table(spark, list(enumerate(texts)))), span=64).persist()
    got = {r.n_tokens: r for r in sums.collect()}
    assert {n: r.n_docs for n, r in got.items()} == dict(Counter(lengths))
    for n, r in got.items():
        long = [x for x in lengths if x >= n]
        assert (r.docs_at_least, r.tokens_at_least, r.total_tokens, r.truncated_total) == (len(long), sum(long), sum(lengths), sum(min(x, n) for x in lengths))
    limits = [0, 1, 7, 100, 333, 10**6]
    assert {r.context_limit: (r.truncated_total, r.docs_cut) for r in token_counts.at_limits(sums, limits).collect()} == {n: (sum(min(x, n) for x in lengths), sum(x > n for x in lengths)) for n in limits}
    assert token_counts.quantile(sums, 0.5).first().n_tokens == sorted(lengths)[(len(lengths) + 1) // 2 - 1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame([], "item_id long, text string")
    assert recompression.remove_repeats(none).count() == 0
    assert chosen_path.near_duplicate_classes(none).count() == 0
    assert decontamination.find_leaks(none, items).count() == 0 and decontamination.drop_leaks(none, items).count() == 0
    assert quality.quality_verdicts(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0
    assert sharding.shard(none).count() == 0
    assert token_counts.suffix_sums(token_counts.histogram(none)).count() == 0
    assert langid.train(none) == [] and langid.predict(none, [], ["doc_id"]).count() == 0


def packed(sizes, capacity, bins=None):
    """Best-fit decreasing of items in this order, one by one over a list of rooms."""
    room = [capacity] * (bins or 0)
    out = []
    for x in sizes:
        fit = [(r, b) for b, r in enumerate(room) if r >= x]
        if fit:
            b = min(fit)[1]
        elif bins:
            b = max((r, b) for b, r in enumerate(room))[1]
        else:
            b = len(room)
            room.append(max(capacity, x))
        room[b] -= x
        out.append(b)
    return out


@pytest.mark.parametrize(("shards", "capacity"), [(7, None), (None, 4000), (40, None)])
def test_shards_equal_packing_group_by_group(spark, shards, capacity, monkeypatch):
    monkeypatch.setattr(sharding, "RANKED", 50)
    rng = random.Random(13)
    texts = [f"{i} " + "y" * rng.choice([1, 2, 3, 30, rng.randint(0, 90)]) for i in range(900)] + [None, ""]
    rows = [(i, rng.choice(texts)) for i in range(1500)]
    docs = table(spark, rows)
    got = sharding.shard(docs, shards, capacity).collect()
    hashes = {r.text: (r.g, r.h2) for r in docs.selectExpr("text", "xxhash64(text is null, text) as g", "xxhash64(text, 11) as h2").collect()}
    size, own = defaultdict(int), {}
    for d, t in rows:
        size[t] += len((t or "").encode()) + 16
        own[d] = t
    order = sorted(size, key=lambda t: (-size[t], hashes[t]))
    room = capacity or -(-sum(size.values()) // shards)
    want = dict(zip(order, packed([size[t] for t in order], room, shards), strict=True))
    assert len(got) == len(rows) and all(r.shard == want[own[r.doc_id]] for r in got)
    if capacity:
        loads = Counter()
        for r in got:
            loads[r.shard] += r.size
        assert max(loads.values()) <= capacity and set(loads) == set(range(len(loads)))


def test_strides_equal_single_steps():
    rng = random.Random(14)
    for k in range(60):
        sizes = sorted((rng.choice([0, 1, 3, 7, 20, 59, 60, 61]) for _ in range(rng.randint(1, 120))), reverse=True)
        bins = rng.choice([None, 1, 4, 9])
        assert sharding.best_fit_decreasing(sizes, 60, bins) == packed(sizes, 60, bins), k


def test_a_host_that_fails_takes_its_good_documents_along(spark):
    """Rates come from a plain empirical beta prior here, not from the operator."""
    good, poor = "good words " + " ".join(f"w{k}" for k in range(60)), "few words"
    share = {"a": 0.02, "b": 0.05, "c": 0.9, "d": 0.01, "e": 0.0, "f": 0.85}
    rows = [(1000 * n + i, poor if i < 300 * bad else good, h) for n, (h, bad) in enumerate(share.items()) for i in range(300)] + [(9000, poor, "tiny"), (9001, good, "tiny")]
    got = {r.doc_id: r for r in quality.quality_verdicts(table(spark, rows, "doc_id long, text string, source string")).collect()}
    n, failed = Counter(h for _, _, h in rows), Counter(h for _, t, h in rows if t == poor)
    rates = [failed[h] / n[h] for h in n]
    mean = sum(rates) / len(rates)
    variance = sum((r - mean) ** 2 for r in rates) / (len(rates) - 1)
    between = max(variance - mean * (1 - mean) * sum(1 / n[h] for h in n) / len(n), 1e-6)
    strength = max(min(mean * (1 - mean) / between - 1, 1e6), 1.0)
    want = {h: (failed[h] + mean * strength) / (n[h] + strength) for h in n}
    assert all(got[d].host_rate == pytest.approx(want[h]) for d, _, h in rows)
    assert all(got[d].kept == (t == good and want[h] <= 0.5) for d, t, h in rows)
    assert sum(t == good and not got[d].kept for d, t, _ in rows) >= 70 and want["tiny"] < 0.5 < want["c"]


def test_language_sizes_equal_plain_compression(spark):
    import zstandard

    docs = spark.read.parquet(SF)
    model = langid.train(docs.filter(~langid.held_out()))
    for r in langid.predict(docs, model, ["doc_id", "text"]).orderBy("doc_id").limit(60).collect():
        raw = "".join(c if c.isalpha() else " " for c in r.text.lower())
        raw = (" " if raw[:1] == " " else "") + " ".join(raw.split()) + (" " if raw[-1:] == " " and raw.strip() else "")
        sizes = []
        for _, content in model:
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            packer = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
            pieces = [raw.encode()[i : i + langid.BLOCK] for i in range(0, len(raw.encode()), langid.BLOCK)]
            sizes.append(sum(len(packer.compress(p)) - len(packer.compress(b"")) for p in pieces))
        first, second = sorted(sizes)[:2]
        assert r.score == pytest.approx((second - first) / second, abs=0.02)
        assert r.rejected or sizes[[k for k, _ in model].index(r.lang_pred)] <= first + 2


def test_repeated_rows_at_a_border_are_taken_as_far_as_they_fit(spark):
    from pyspark.sql import functions as F

    rows = [(i, " ".join([f"w{i}"] * 5), "a") for i in range(40)] + [(77, "x y z", "a")] * 500 + [(None, f"n{i} m", "a") for i in range(60)]
    docs = table(spark, rows, "doc_id long, text string, source string").withColumns({c: F.lit(c) for c in ("_key", "_s", "s", "epochs", "a.b", "nth", "times", "last")})
    for share in (0.2, 0.5, 0.9, 1.3):
        whole = mixing.mixed_rows(docs, share=share)
        assert whole.columns == docs.columns
        got = whole.collect()
        total = sum(len(t.split()) for _, t, _ in rows)
        assert abs(sum(len(r.text.split()) for r in got) - share * total) <= 5
        assert all(r["a.b"] == "a.b" and r.epochs == "epochs" and r._key == "_key" for r in got)
