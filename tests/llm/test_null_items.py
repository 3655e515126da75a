"""Benchmark items without an item_id are searched for like others."""

from textloom.llm import decontamination


def test_items_without_an_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(12)) for x in "ab")
    docs = spark.createDataFrame([(1, f"so {a} on"), (2, f"so {b} on"), (3, "nothing of the kind is here")], "doc_id long, text string")
    items = spark.createDataFrame([(None, a), (7, b), (None, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontamination.find_leaks(docs, items).collect()}
    assert got == {(1, None, 8, 8), (2, 7, 8, 8)}
    assert [r.doc_id for r in decontamination.drop_leaks(docs, items).collect()] == [3]
