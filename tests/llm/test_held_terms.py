"""Texts meet the few terms that they hold without being shuffled; beyond the bound they are, with the same spans."""

import pytest

from textloom.llm import common, privacy


@pytest.mark.parametrize(("term_bytes", "shuffled"), [(privacy.TERM_BYTES, False), (-1, True)])
def test_texts_stay_where_they_are(spark, term_bytes, shuffled):
    common.prepare(spark)
    rows = [(i, f"word{i} zanzibar Zanzibar") for i in range(3)] + [(9, "nothing here"), (9, "nothing here"), (2, "word2 zanzibar Zanzibar"), (None, None)]
    terms = spark.createDataFrame([("zanzibar", "[email]")], "term string, value string")
    out = privacy._term_spans(spark.createDataFrame(rows, "doc_id long, text string"), terms, term_bytes)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert ("SortMergeJoin" in plan) == shuffled and ("BroadcastHashJoin" in plan) != shuffled
    got = sorted([(s.start, s.kind, s.end, s.value) for s in r.extra] for r in out.collect())
    assert got == [[(6, 4, 14, "[email]"), (15, 4, 23, "[email]")]] * 3
