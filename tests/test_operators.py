"""Curation, sanitising, perturbation, metrics, explanations, sources and streams on small tables."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from textloom.functions import lexicons as L
from textloom.operators import curation, explain, metrics, perturb, sanitize
from textloom.sources import corpora
from textloom.streaming import replay, streams


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_exact_dedup(spark):
    docs = docs_of(spark, ["The quick brown fox.", "the  QUICK brown\nfox. ", "A different sentence entirely.", None, ""])
    assert sorted(r.doc_id for r in curation.exact_dedup(docs).collect()) == [0, 2, 3]
    assert curation.dedup_report(docs).first().asDict() == {"initial_count": 5, "exact_duplicates_removed": 2, "final_count": 3}
    again = curation.exact_dedup(curation.exact_dedup(docs))
    assert again.count() == 3


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(1)
    base = [[rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 60))] for _ in range(8)]
    texts = []
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        texts.append(" ".join(w))
    texts += ["", "a b", "a b", None]
    sets = {i: {tuple(t.lower().split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in enumerate(texts) if t}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-12}
    got = {(r.id_a, r.id_b): r.jaccard for r in curation.near_pairs(docs_of(spark, texts)).collect()}
    assert got == pytest.approx(want)
    removed = set()
    for a in range(len(texts)):
        if a not in removed:
            removed |= {y for x, y in want if x == a}
    pairs = spark.createDataFrame([(a, b) for a, b in want], "id_a long, id_b long")
    assert {r.id for r in curation.greedy_removed(pairs).collect()} == removed


def test_greedy_suppression_is_not_connected_components(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "id_a long, id_b long")
    assert [r.id for r in curation.greedy_removed(pairs).collect()] == [2]


def test_lineage(spark):
    edges = [("orig", None), ("para", "orig"), ("other", None), ("lost", "absent"), ("c1", "c2"), ("c2", "c1"), ("b0", "c2")] + [(f"n{i:03d}", f"n{i - 1:03d}" if i else None) for i in range(70)] + [(f"k{i:02d}", f"k{(i + 1) % 23:02d}") for i in range(23)]
    got = {r.id: r.root for r in curation.lineage_roots(spark.createDataFrame(edges, "id string, parent_id string")).collect()}
    assert got["para"] == "orig" and got["other"] == "other" and got["lost"] == "absent" and got["c1"] == got["c2"] == got["b0"] == "c1"
    assert all(got[f"n{i:03d}"] == "n000" for i in range(70)) and all(got[f"k{i:02d}"] == "k00" for i in range(23)) and len(got) == len(edges)


def test_split_keeps_groups_together(spark):
    groups = spark.createDataFrame([(i, i // 3) for i in range(300)], "id long, root long")
    rows = curation.grouped_split(groups).collect()
    by = {}
    for r in rows:
        by.setdefault(r.root, set()).add(r.split)
    assert len(rows) == 300 and all(len(s) == 1 for s in by.values())
    sizes = [sum(s == {x} for s in by.values()) for x in ("train", "val", "test")]
    assert sizes == [70, 15, 15]


def test_leakage(spark):
    rows = [(1, None, "Same text", "train"), (2, None, "same  TEXT", "val"), (3, 1, "child", "test"), (4, 1, "child two", "train")]
    got = {(r.kind, r.split_a, r.split_b, r.n) for r in curation.leakage(spark.createDataFrame(rows, "id long, parent_id long, text string, split string")).collect()}
    assert got == {("EXACT_TEXT_OVERLAP", "train", "val", 1), ("LINEAGE_ACROSS_SPLITS", "test", "train", 1)}


def test_sanitizing(spark):
    zero, odd = "".join(L.ZERO_WIDTH), "".join(L.HOMOGLYPHS)
    texts = ["clean sentence.", "a​b‌", odd + " x", "ﬁ ① ", "  a \t b\n\n\n\nc ", zero * 4, "", "е", None]
    got = {r.doc_id: r for r in sanitize.sanitize(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        z, h = sum(c in zero for c in t or ""), sum(c in odd for c in t or "")
        a = got[i].audit
        assert (a.zero_width_count, a.homoglyph_count, a.adversarial_markers_present) == (z, h, z + h > 0)
        assert [d.position for d in a.homoglyph_details] == [k for k, c in enumerate(t or "") if c in odd][:20]
        assert [d.name for d in a.zero_width_details] == [L.ZERO_WIDTH[c] for c in t or "" if c in zero][:20]
        assert a.mixed_script_anomaly == (h > 0 and any(ord(c) < 128 for c in t)) and a.adversarial_risk_score == pytest.approx(min(1, 0.2 * z + 0.1 * h))
    assert got[2].audit.homoglyph_details[0].unicode_name == unicodedata.name(odd[0])
    assert [got[i].clean_text for i in range(9)] == ["clean sentence.", "ab", "".join(L.HOMOGLYPHS.values()) + " x", "fi 1", "a b\n\nc", "", "", "e", None]
    kept = sanitize.sanitize(docs_of(spark, ["a​е"]), strip_zero_width=False, strip_homoglyphs=False).first().clean_text
    assert kept == "a​е"


def test_perturbation(spark):
    text = "It is important to use fast tools, and they help. Good work is often slow, but we make it. However, show it! " * 4
    docs = docs_of(spark, [text, "", "plain"])
    rows = {(r.doc_id, r.attack_type): r for r in perturb.apply_attacks(docs, [*perturb.ATTACKS, "unknown"], 0.9).collect()}
    again = {(r.doc_id, r.attack_type): r for r in perturb.apply_attacks(docs.repartition(3), [*perturb.ATTACKS, "unknown"], 0.9).collect()}
    assert rows == again and rows[0, "unknown"].perturbed_text == text
    zw, homo, syn = (rows[0, k].perturbed_text for k in ("zero_width", "homoglyph", "synonym"))
    assert "".join(c for c in zw if c not in L.ZERO_WIDTH) == text and len(zw) > len(text)
    assert homo != text and "".join(L.HOMOGLYPHS.get(c, c) for c in homo) == text
    assert syn != text and len(syn.split()) >= len(text.split()) and any(s in syn for v in L.SYNONYMS.values() for s in v)
    assert rows[0, "humanizer"].perturbed_text != text and rows[1, "combined"].perturbed_text == "" and rows[2, "synonym"].perturbed_text == "plain"


def plain_metrics(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y != 1]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else 0.5
    ap, last = 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        if pos:
            ap += (tp / len(pos) - last) * tp / (tp + fp)
            last = tp / len(pos)
    ece = 0.0
    for k in range(10):
        own = [(y, s) for y, s in rows if k * 0.1 < s <= (k + 1) * 0.1]
        if own:
            ece += abs(sum(y for y, _ in own) - sum(s for _, s in own)) / len(rows)
    fpr = {t: min((sum(n >= c for n in neg) / len(neg) for c in {s for _, s in rows} if sum(p >= c for p in pos) >= t * len(pos)), default=1.0) if pos and neg else 1.0 for t in (0.95, 0.99)}
    return auc, ap, ece, fpr[0.95], fpr[0.99]


@pytest.mark.parametrize("case", [0, 1, 2, 3])
def test_metrics(spark, case):
    rng = random.Random(case)
    rows = [(rng.randint(0, 1), rng.choice([0.0, 1.0, 0.1, 0.3, 0.30000000000000004, 0.5, rng.random()])) for _ in range(200)] if case < 3 else [(1, 0.2), (1, 0.9)]
    r = metrics.evaluate(spark.createDataFrame(rows, "label int, score double"), digits=9).first()
    assert (r.roc_auc, r.pr_auc, r.ece, r.fpr_at_95_tpr, r.fpr_at_99_tpr) == pytest.approx(plain_metrics(rows), abs=1e-8)
    tp, fp = sum(y == 1 and s >= 0.5 for y, s in rows), sum(y == 0 and s >= 0.5 for y, s in rows)
    assert (r.tp, r.fp, r.n_samples) == (tp, fp, len(rows)) and r.precision == pytest.approx(tp / (tp + fp), abs=1e-8)
    assert r.brier == pytest.approx(sum((s - y) ** 2 for y, s in rows) / len(rows), abs=1e-8)


def test_heatmap(spark):
    words = lambda n: " ".join(["w"] * (n - 1) + ["w."])
    text = " ".join(words(n) for n in (5, 6, 14, 15, 26, 27, 42, 43)) + " Furthermore, a delve here now then. A tapestry, is not tapestry!"
    rows = sorted(explain.sentence_heatmap(docs_of(spark, [text, None, " "])).collect(), key=lambda r: r.sentence_index)
    assert [r.ai_probability for r in rows] == [0.35, 0.5, 0.5, 0.6, 0.6, 0.5, 0.5, 0.35, 0.95, 0.35]
    assert [r.suspicion_level for r in rows][-2:] == ["HIGH", "LOW"]


def test_rule_score_and_bands(spark):
    texts = ["Furthermore, crucial pivotal. " * 9, "​ one. two three four five six seven eight nine. ten eleven twelve thirteen fourteen.", None, "a_b é'x don't"]
    rows = {r.doc_id: r for r in explain.rule_score(docs_of(spark, texts)).collect()}
    assert rows[0].ai_probability == 0.96 and rows[0].classification == "AI_GENERATED" and rows[0].confidence_band == "VERY_HIGH"
    assert rows[1].ai_probability == pytest.approx(0.85) and all(0.04 <= r.ai_probability <= 0.96 for r in rows.values())
    bands = spark.createDataFrame([(p,) for p in (0.5, 0.61, 0.71, 0.86, 0.1)], "p double").select(explain.confidence_band(F.col("p")).alias("b")).collect()
    assert [r.b for r in bands] == ["LOW_BORDERLINE", "MODERATE", "HIGH", "VERY_HIGH", "VERY_HIGH"]


def test_explanations(spark):
    row = spark.createDataFrame([(1, 0.9, 0.5, 1.0, 2.0, 0.1, 0.1, 3.0)], "doc_id long, ai_probability double, sty_ttr double, sem_semantic_monotony_index double, sty_std_sentence_length double, str_transition_density double, prd_burstiness double, prd_unigram_entropy double")
    strict, intended = (explain.explanation(row, {"sty_ttr": 0.3}, mode=m).first() for m in ("strict", "intended"))
    assert [a.feature for a in strict.feature_attributions] == ["sty_ttr", "sem_semantic_monotony_index"] and strict.linguistic_diagnostics == []
    assert strict.feature_attributions[0].weight_impact == 1.5 and len(intended.feature_attributions) == 6
    assert [d.category for d in intended.linguistic_diagnostics] == ["STYLE", "DISCOURSE", "PREDICTABILITY"] and intended.confidence_band == "VERY_HIGH_CONFIDENCE"


def test_sources(spark, tmp_path):
    (tmp_path / "qa.jsonl").write_text("\n".join(json.dumps(x) for x in ({"question": "q", "human_answers": ["yes", " "], "chatgpt_answers": ["no"]}, {"question": "r", "human_answers": [], "chatgpt_answers": ["a", "b"]})) + "\n\n")
    rows = corpora.ingest_answers(corpora.read_jsonl(spark, str(tmp_path / "qa.jsonl"))).collect()
    assert sorted((r.sample_id, r.origin, r.text) for r in rows) == [("hc3_ai_0_0", "AI_RAW", "no"), ("hc3_ai_1_0", "AI_RAW", "a"), ("hc3_ai_1_1", "AI_RAW", "b"), ("hc3_human_0_0", "HUMAN", "yes")]
    (tmp_path / "x.csv").write_text('text,label,model\n"one, two", AI ,m\nthree,odd,\n')
    rows = sorted(corpora.ingest_labelled(spark, str(tmp_path / "x.csv")).collect(), key=lambda r: r.sample_id)
    assert [(r.text, r.origin, r.generator, r.word_count, r.char_count, len(r.content_hash)) for r in rows] == [("one, two", "AI_RAW", "m", 2, 8, 64), ("three", "HUMAN", None, 1, 5, 64)]
    with pytest.raises(ValueError, match="unsupported"):
        corpora.ingest_labelled(spark, "x.docx")
    table = corpora.canonical(spark.createDataFrame([("a", "This is a test sentence for somebody.", "HUMAN"), ("b", "hello", "BAD")], "sample_id string, text string, origin string"))
    assert table.first().word_count == 7 and [r.sample_id for r in corpora.invalid(table).collect()] == ["b"]
    path = corpora.save(table, str(tmp_path), "corpus")
    loaded = corpora.load_samples(spark, f"{path}/samples.jsonl")
    assert loaded.schema.fieldNames() == corpora.CANONICAL.fieldNames() and loaded.count() == 2
    about = spark.read.json(f"{path}/manifest.json").first()
    assert about.total_samples == 2 and about.origin_distribution.HUMAN == 1 and about.content_hash == corpora.dataset_hash(loaded).first().content_hash
    corpora.save_splits(table.withColumn("split", F.lit("train")), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s/splits")).filter("split = 'train'").count() == 2
    assert json.loads(corpora.export(table.limit(1)).first().json)["sample_id"] == "a"


def test_generated_corpora(spark):
    bank = {"NEWS": [f"Sentence {i} is good." for i in range(10)]}
    rows = corpora.generated_corpus(spark, bank, 20, "AI_RAW")
    got = rows.collect()
    assert len(got) == 20 and {r.text.count("Sentence") for r in got} <= {3, 4}
    children = corpora.humanized_children(rows).collect()
    assert len(children) == 20 and {r.parent_id for r in children} == {r.sample_id for r in got} and {r.transformation_severity for r in children} == {"MEDIUM", "HEAVY", "LIGHT"}


def test_streams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r.ai_probability for r in explain.rule_score(docs).collect()}
    assert {r.doc_id: r.ai_probability for r in replay.replayed(spark, "/root/testdata/sf0.001", "documents", streams.score).collect()} == want
    once = replay.replayed(spark, "/root/testdata/sf0.001", "documents", lambda s: streams.deduplicate(s.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))))
    assert once.count() == curation.exact_dedup(docs).count()


def test_queries_have_names_and_oracles(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) >= 30
    assert entry.entry(spark).count() == 200
