import random

import pytest
from plain import features as plain
from pyspark.sql import functions as F

from textloom.operators import features as X

HUMAN = "\nI don't think it's simple — far from it. We've tried twice!\n\nMaybe next year? My friend's view, though, isn't mine.\n"
MACHINE = "\nFurthermore, the approach is crucial. Moreover, it is pivotal. In conclusion, however, the results are clear.\n\nAdditionally, first, second, third.\n"


def cases():
    rng = random.Random(1)
    vocabulary = ["the", "However,", "attribute", "authentic", "straße", "x_1", "don't", "rock'n'roll", "état.", "End!", "we", "could", "a", "b", "c?", "also", "—", '"', "Then", "42"]
    out = ["", "\n \n", HUMAN, MACHINE, "the the the the the", "One.\n\nTwo two.\n\nThree three three.", "# Introduction\n\nText here. More.\n\n# Methods\nSHORT CAPS LINE\n" + "W " * 9 + "\n" + "W " * 10, None, "...", "a", "A. A. B.", "one two", "état only", "x_ y9 é"]
    for n in (1, 2, 5, 6, 9, 10, 41, 42, 99, 100, 101, 150, 151, 400):
        out += [" ".join(rng.choice(vocabulary[: rng.choice([3, 20])]) for _ in range(n)), " ".join(f"w{rng.randint(0, 60)}" for _ in range(n)), "\n\n".join(" ".join(rng.choice(vocabulary) for _ in range(1 + n // 4)) for _ in range(4))]
    return out


@pytest.fixture(scope="module")
def table(spark):
    texts = cases()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return texts, {r.doc_id: r.asDict() for r in X.assemble(docs).collect()}


def test_all_features_equal_their_plain_definitions(table):
    texts, got = table
    assert len(X.FEATURES) == 84 and len(got) == len(texts)
    for i, t in enumerate(texts):
        for name, want in zip(X.FEATURES, plain(t), strict=True):
            tolerance = 1e-4 if name.startswith("sem") else 1e-9
            assert got[i][name] == pytest.approx(want, abs=tolerance, rel=1e-9), (name, t)


def test_ranges(table):
    _, got = table
    for r in got.values():
        assert 0 <= r["sty_ttr"] <= 1 and -1 <= r["prd_burstiness"] <= 1 and r["prd_vocab_burstiness"] == 0


def test_families_and_vectors(spark):
    docs = spark.createDataFrame([(1, HUMAN), (2, MACHINE)], "doc_id long, text string")
    sizes = {f: len(X.assemble(docs, (f,)).columns) - 1 for f in X.FAMILIES}
    assert sizes == {"sty": 33, "str": 24, "prd": 18, "sem": 9}
    assert all(len(r.features) == 84 for r in X.vector(X.assemble(docs)).collect())


def test_features_cost_no_exchange_and_cut_a_text_once(spark):
    docs = spark.range(0, 64, 1, 64).select(F.col("id").alias("doc_id"), F.lit(HUMAN).alias("text"))
    plan = X.assemble(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Cartesian" not in plan and "Python" not in plan and "Join" not in plan
    few = spark.range(0, 3, 1, 1).select(F.col("id").alias("doc_id"), F.lit(HUMAN).alias("text"))
    assert X.assemble(few)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    stored = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    whole = X.assemble(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert whole.count("AS _tok#") == 1 and whole.count("AS _sent#") == 1
