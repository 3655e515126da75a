"""Terms that reveal an entity are found in every text, not only beside the entity."""

import random

import pytest

from textloom.llm import privacy, queries

WORDS = "the of and to in for with on by from".split()


def rows():
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    out = [(i, some(30)) for i in range(300)]
    out += [(1000 + i, f"{some(10)} zanzibar boss@corp.example.com {WORDS[i]} {some(60)} Zanzibar {some(3)}") for i in range(6)]
    return [*out, (2000, "zanzibar alone the of ZANZIBAR zanzibars"), (2000, "zanzibar alone the of ZANZIBAR zanzibars"), (2001, "x zanzibar@corp.example.com zanzibar"), (None, "é zanzibar"), (2002, None)]


def terms(text, spans):
    return [text[int(x.split(":")[1]) : int(x.split(":")[2])] for x in spans.split(",") if x.startswith("term")]


@pytest.mark.parametrize("term_bytes", [privacy.TERM_BYTES, -1])
def test_terms_far_from_the_entity_and_in_other_texts(spark, term_bytes):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    got = {(r.doc_id, r.spans) for r in privacy.privacy_report(docs, term_bytes=term_bytes).collect()}
    assert privacy.privacy_report(docs, term_bytes=term_bytes).count() == len(rows())
    got = dict(got)
    for d, t in rows():
        want = {2000: ["zanzibar", "ZANZIBAR"], 2001: ["zanzibar"], None: ["zanzibar"]}.get(d, ["zanzibar", "Zanzibar"] if d and 1000 <= d < 2000 else [])
        assert terms(t or "", got[d]) == want, (d, got[d])


def test_sanitised_texts_and_the_query_hold_no_revealing_term(spark, tmp_path):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    clean = {r.doc_id: r.clean_text for r in privacy.sanitise(docs).collect()}
    assert "anzibar" not in clean[1000] and clean[2000] == "[email] alone the of [email] zanzibars"
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_term for r in queries.op6_personal_data(spark, str(tmp_path)).collect()}
    assert got[2000] == 2 and got[1000] == 2 and got[0] == 0
