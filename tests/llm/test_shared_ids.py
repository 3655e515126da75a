"""Near-duplicate classes are classes of texts: ids may be null, repeated, or shared by texts."""

import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from textloom.llm import chosen_path

WORDS = [f"w{i}" for i in range(500)]


def near(rng, base, n):
    w = list(base)
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def mixed_up():
    rng = random.Random(11)
    bases = [[rng.choice(WORDS) for _ in range(rng.choice([7, 12, 40, 90]))] for _ in range(12)]
    texts = [near(rng, rng.choice(bases), rng.choice([0, 0, 1, 2])) for _ in range(150)]
    rows = [(rng.choice([None, *range(25)]), rng.choice(texts)) for _ in range(260)]
    return [*rows, (None, None), (3, None), (3, None), (4, ""), (None, "")]


@pytest.mark.parametrize("bits", [64, 3])
def test_classes_of_rows_with_shared_ids(spark, bits):
    rows = mixed_up()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in chosen_path.near_duplicate_classes(docs, bits=bits).collect())
    want = brute.row_classes(rows)
    want = [(d, d if t is None else c, 0 if t is None else n) for (d, c, n), (_, t) in zip(want, rows, strict=True)]
    assert got == Counter(want)


def test_one_row_of_each_class_stays_whatever_its_id(spark):
    rows = mixed_up()
    got = Counter((r.doc_id, r.text) for r in chosen_path.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert not got - Counter(rows)
    own = brute.classes(list(enumerate(t for _, t in rows)))
    least, at = {}, {}
    for i, (d, t) in enumerate(rows):
        if t is not None:
            c = own[i][0]
            at.setdefault(t, c)
            least[c] = min(least.get(c, (True, 0)), (d is None, d or 0))
    assert {k: n for k, n in got.items() if k[1] is None} == {(None, None): 1, (3, None): 2}
    stays = [(at[t], (d is None, d or 0)) for (d, t), n in got.items() if t is not None for _ in range(n)]
    assert Counter(c for c, _ in stays) == Counter(least.keys()) and all(d == least[c] for c, d in stays)


def test_no_document_goes_with_another_one_of_its_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (1, a), (1, b)], "doc_id long, text string")
    assert Counter((r.doc_id, r.text) for r in chosen_path.keep_one(docs).collect()) == Counter([(1, a), (1, b)])
    b = " ".join(f"b{i}" for i in range(8))
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b + " x")], "doc_id long, text string")
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in chosen_path.near_duplicate_classes(docs).collect()) == Counter([(1, 1, 1), (5, 1, 1), (5, 5, 1), (7, 5, 1)])
    assert Counter((r.doc_id, r.text) for r in chosen_path.keep_one(docs).collect()) == Counter([(1, a), (5, b)])


def test_recall_near_the_threshold_with_a_passage_that_all_texts_share(spark):
    rng = random.Random(12)
    common, rows = [f"c{i}" for i in range(60)], []
    for k in range(400):
        own = [f"o{k}x{i}" for i in range(120)]
        other = list(own)
        for i in rng.sample(range(0, 115, 5), rng.choice([3, 4])):
            other[i + rng.randrange(5)] = f"new{k}x{i}"
        rows += [(2 * k, " ".join([*common, *own])), (2 * k + 1, " ".join([*common, *other]))]
    close = {}
    for (d, t), (e, u) in zip(rows[::2], rows[1::2], strict=True):
        x, y = brute.shingles(t), brute.shingles(u)
        j = len(x & y) / len(x | y)
        if 0.8 <= j <= 0.87:
            close[d] = e
    assert len(close) > 150
    got = {r.doc_id: r.n_links for r in chosen_path.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[d] == 1 and got[e] == 1 for d, e in close.items())
    assert found >= 0.99 * len(close)
    assert sum(got.values()) <= 2 * len(rows) // 2


def test_runs_follow_from_the_target_recall():
    assert chosen_path.runs_for(0.9975, 0.8, 4) == 16
    assert chosen_path.runs_for(0.99999, 0.8, 4) > chosen_path.runs_for(0.99, 0.8, 4) >= 1


def test_columns_of_the_rows_pass_unchanged(spark):
    t = " ".join(f"w{i}" for i in range(40))
    names = ["key", "of", "doc", "_gone", "first", "class_key", "a.b", "x`y", "n"]
    docs = spark.createDataFrame([(1, t), (2, t + " x"), (2, t + " x"), (3, "else")], "doc_id long, text string").select("*", *[F.lit(c).alias(c) for c in names])
    kept = chosen_path.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and all(r[2:] == tuple(names) for r in kept.collect())
