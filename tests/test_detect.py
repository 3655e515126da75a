"""Detectors, their calibration and storage; batch detection and its bounds; metrics that are read again."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from textloom.operators import detect, detector, metrics, sanitize
from textloom.operators.features import FEATURES, assemble
from textloom.sources import corpora

COLUMNS = FEATURES[:6]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    made = []
    for i in range(240):
        y = rng.randint(0, 1)
        made.append((i, y, *[None if rng.random() < 0.05 else rng.gauss(y * (k < 3), 1.0) for k in range(len(COLUMNS))]))
    return spark.createDataFrame(made, "doc_id long, label int, " + ", ".join(f"{c} double" for c in COLUMNS)).repartition(2).persist()


@pytest.fixture(scope="module")
def boosted(rows):
    return detector.Detector("boosted", trees=4, depth=2, columns=COLUMNS).fit(rows)


def by_id(df, column="ai_probability"):
    return {r.doc_id: r[column] for r in df.select("doc_id", column).collect()}


def test_each_fold_is_calibrated_on_what_its_model_has_not_seen(rows, boosted):
    folds = rows.withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(detector.SEED)), F.lit(detector.FOLDS))).collect()
    assert len(boosted.models) == 3 and {r.fold for r in folds} == {0, 1, 2}
    sums = dict.fromkeys((r.doc_id for r in folds), 0.0)
    for k, (model, calibrator) in enumerate(boosted.models):
        filled = model.stages[0].surrogateDF.first()
        for c in COLUMNS:  # the medians that fill gaps are those of the other folds
            seen = sorted(r[c] for r in folds if r.fold != k and r[c] is not None)
            assert seen[len(seen) // 2 - 2] <= filled[c] <= seen[len(seen) // 2 + 2]
        curve = calibrator.stages[-1]
        margins = by_id(boosted._margin(model.transform(rows)), "margin")
        for d, m in margins.items():
            sums[d] += 1 / (1 + math.exp(-(curve.coefficients[0] * m + curve.intercept))) / 3
        # A logistic fit on the fold itself: its mean probability is the fold's share of label 1.
        own = [r for r in folds if r.fold == k]
        fitted = [1 / (1 + math.exp(-(curve.coefficients[0] * margins[r.doc_id] + curve.intercept))) for r in own]
        assert statistics.mean(fitted) == pytest.approx(statistics.mean(r.label for r in own), abs=0.01)
    assert by_id(boosted.predict_proba(rows)) == pytest.approx(sums)
    said = boosted.predict(rows).collect()
    assert all(r.prediction == (r.ai_probability >= 0.5) for r in said)
    assert sum(r.prediction == r.label for r in said) > 0.75 * len(said)


@pytest.mark.parametrize("kind", ["boosted", "forest", "logistic"])
def test_importances_sum_to_one_and_models_survive_storage(spark, rows, boosted, kind, tmp_path):
    model = boosted if kind == "boosted" else detector.Detector(kind, trees=5, depth=3, columns=COLUMNS).fit(rows)
    shares = model.importances()
    assert sum(x for _, x in shares) == pytest.approx(1) and [x for _, x in shares] == sorted((x for _, x in shares), reverse=True) and {c for c, _ in shares} == set(COLUMNS)
    assert {c for c, _ in shares[:2]} <= set(COLUMNS[:3])
    model.save(spark, str(tmp_path / "model"))
    again = detector.Detector.load(spark, str(tmp_path / "model"))
    assert (again.kind, again.columns, again.calibrate) == (kind, COLUMNS, kind == "boosted") and again.importances() == shares
    assert by_id(again.predict_proba(rows)) == pytest.approx(by_id(model.predict_proba(rows)))


def test_isotonic_calibration_never_falls(rows):
    model = detector.Detector("boosted", trees=3, depth=2, columns=COLUMNS, method="isotonic").fit(rows)
    fold, curve = model.models[0]
    out = curve.transform(model._margin(fold.transform(rows))).orderBy("margin").select("calibrated").collect()
    assert all(0 <= a.calibrated <= b.calibrated <= 1 for a, b in zip(out, out[1:]))


HUMAN = "We drove out late. The lake was cold, and nobody swam! My aunt laughed; she had seen it all before, hadn't she? Rain came. We stayed until the lamps went out and the dog slept under the old table by the door."
ROBOT = "Furthermore, the system is important to use. Moreover, the system is crucial to use. In conclusion, the system is essential to use. Consequently, the system is pivotal to use. Furthermore, the system is holistic to use."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    texts = []
    for i in range(80):
        parts = (HUMAN if i % 2 else ROBOT).split(". ")
        rng.shuffle(parts)
        texts.append((i, ". ".join(parts[: rng.randint(3, len(parts))]) + f" Note {rng.randint(1, 9)}.", 1 - i % 2))
    return spark.createDataFrame(texts, "doc_id long, text string, label int")


@pytest.fixture(scope="module")
def judge(corpus):
    rows = assemble(corpus).join(corpus.select("doc_id", "label"), "doc_id").persist()
    return detector.Detector("forest", trees=5, depth=3).fit(rows)


def test_requests_out_of_bounds_are_told_and_never_scored(spark, judge):
    asked = [(1, HUMAN), (2, ROBOT), (3, "too short"), (4, None), (5, "x" * 250_001), (6, "ten chars!"), (7, "y " * 125_000)]
    requests = spark.createDataFrame(asked, "doc_id long, text string")
    assert {(r.doc_id, r.reason, r.char_count) for r in detect.rejects(requests).collect()} == {(3, "too_short", 9), (4, "missing", 0), (5, "too_long", 250_001)}
    assert sorted(r.doc_id for r in detect.accepted(requests).collect()) == [1, 2, 6, 7]
    got = {r.doc_id: r for r in detect.detect(requests.filter("doc_id < 7"), judge).collect()}
    assert sorted(got) == [1, 2, 6]
    assert got[2].classification == "AI_GENERATED" and got[1].classification == "HUMAN_WRITTEN"
    for d, r in got.items():
        away = abs(r.ai_probability - 0.5)
        assert r.confidence_band == ("VERY_HIGH" if away > 0.35 else "HIGH" if away > 0.2 else "MODERATE" if away > 0.1 else "LOW_BORDERLINE")
        assert (r.word_count, r.char_count, r.tampering_detected) == (len(dict(asked)[d].split()), len(dict(asked)[d]), False)
    sizes = {r.batch: (r.n, r.reason) for r in detect.batch_size(spark.range(130).select((F.col("id") % 3 * 0 + F.when(F.col("id") < 51, 1).otherwise(2)).alias("b")), "b", 78).collect()}
    assert sizes == {1: (51, None), 2: (79, "too_many")}


def test_the_flag_chooses_the_text_that_is_judged(spark, judge):
    tampered = ROBOT.replace("o", "о").replace(" is", "​ is")
    requests = spark.createDataFrame([(1, tampered, True), (2, tampered, False), (3, tampered, None), (4, ROBOT, False)], "doc_id long, text string, sanitize_adversarial boolean")
    chosen = {r.doc_id: r for r in detect.choose(requests).collect()}
    assert chosen[1].text == chosen[3].text == ROBOT and chosen[2].text == tampered and chosen[4].text == ROBOT
    assert [chosen[k].audit.adversarial_markers_present for k in (1, 2, 3, 4)] == [True, True, True, False]
    got = {r.doc_id: r for r in detect.detect(requests, judge).collect()}
    assert got[1].ai_probability == got[3].ai_probability == got[4].ai_probability and got[1].tampering_report.homoglyph_count == tampered.count("о")
    cleaned = detect.clean(requests.filter("doc_id = 1")).first()
    assert cleaned.sanitized_text == ROBOT and cleaned.tampering_audit.zero_width_count == tampered.count("​")


def test_explained_requests_and_batches(spark, judge):
    requests = spark.createDataFrame([(1, HUMAN), (2, ROBOT), (3, "short")], "doc_id long, text string")
    told = {r.doc_id: r for r in detect.explained(requests, judge, mode="intended").collect()}
    plain = {r.doc_id: r for r in detect.detect(requests, judge).collect()}
    assert sorted(told) == [1, 2]
    for d, r in told.items():
        assert (r.ai_probability, r.classification, r.confidence_band) == (plain[d].ai_probability, plain[d].classification, plain[d].confidence_band)
        weights = [a.weight_impact for a in r.feature_attributions]
        assert len(weights) == 6 and weights == sorted(weights, reverse=True)
        assert dict((a.feature, a.weight_impact) for a in r.feature_attributions)["sty_ttr"] == round(5 * dict(judge.importances())["sty_ttr"], 3)
    assert len(told[2].sentence_heatmap) == 5 and [h.sentence_index for h in told[2].sentence_heatmap] == [0, 1, 2, 3, 4]
    results, counts = detect.batch(requests, judge)
    assert sorted(r.doc_id for r in results.collect()) == [1, 2] and counts.first().asDict() == {"total_processed": 2, "total_rejected": 1}


def test_metrics_are_read_again(spark, tmp_path):
    scores = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.4), (0, 0.6)], "label int, score double")
    rows = metrics.evaluate(scores)
    corpora.save_results(rows, str(tmp_path / "results"))
    again = corpora.read_results(spark, str(tmp_path / "results"))
    assert again.select(*rows.columns).first().asDict() == rows.first().asDict()
    (tmp_path / "whole.json").write_text('{\n "timestamp": "t",\n "clean_benchmarks": {"lr": {"roc_auc": 0.5}}\n}')
    assert corpora.read_results(spark, str(tmp_path / "whole.json")).first().clean_benchmarks.lr.roc_auc == 0.5
    assert corpora.read_results(spark, str(tmp_path / "absent")).columns == ["message"]


def test_ablation(spark, corpus, monkeypatch):
    small = detector._classifier
    monkeypatch.setattr(detector, "_classifier", lambda kind, trees, depth, step: small(kind, 2, 2, step))
    labels = corpus.select("doc_id", "label")
    got = {r.subset: r for r in detector.ablation(detector.labelled_features(corpus, labels)).collect()}
    assert {k: r.num_features for k, r in got.items()} == {"stylometry": 33, "structural": 24, "predictability": 18, "semantic": 9, "all": 84}
    assert got["all"].roc_auc > 0.9 and all(0 <= r.ece <= 1 for r in got.values())


def test_names_of_a_callers_columns_survive(spark):
    from textloom.operators import curation, perturb
    from textloom.streaming import streams

    names = ["h", "_h", "of", "least", "each", "rough", "_rough", "audit", "clean_text", "severity", "attack_type", "a.b", "one", "r"]
    docs = spark.createDataFrame([(1, "Some text here."), (2, "some  TEXT here.")], "doc_id long, text string").select("*", *[F.lit(c).alias(c) for c in names])
    kept = curation.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.first()[2:] == tuple(names) and kept.count() == 1
    clean = sanitize.sanitize(docs)
    assert clean.columns == [*docs.columns, "audit_", "clean_text_"] and clean.first()[2 : 2 + len(names)] == tuple(names)
    varied = perturb.apply_attacks(docs, ["synonym"])
    assert varied.columns[: len(docs.columns)] == docs.columns and varied.first()[2 : 2 + len(names)] == tuple(names) and "severity_" in varied.columns
    assert near(curation, docs).columns == docs.columns
    scores = spark.createDataFrame([(1, 0.9, "x", "y"), (0, 0.1, "x", "y")], "label int, score double, r string, one string")
    assert metrics.evaluate(scores, by=["r", "one"]).first().roc_auc == 1.0 and metrics.evaluate(scores).columns[0] == "accuracy"
    assert streams.deduplicate(docs.withColumn("ts", F.current_timestamp())).columns == [*docs.columns, "ts"]


def near(curation, docs):
    return curation.near_dedup(docs)


def test_representatives_stand_for_equal_sets(spark):
    from textloom.operators import curation

    a = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(i, a) for i in range(5)] + [(9, a + " x"), (10, "nothing like that at all")], "doc_id long, text string")
    pairs, members = curation.near_representatives(docs)
    assert [(r.rep_a, r.rep_b) for r in pairs.collect()] == [(0, 9)]
    assert {r.id: r.rep for r in members.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 9: 9, 10: 10}
    assert curation.near_pairs(docs).count() == 5 * 4 // 2 + 5 and sorted(r.doc_id for r in curation.near_dedup(docs).collect()) == [0, 10]


def test_a_benchmark_is_built_in_one_job(spark, tmp_path):
    rows = [(f"s{i:02d}", f"Text number {i % 30}.", "HUMAN", "NEWS", None) for i in range(40)] + [(f"c{i:02d}", f"Child {i}.", "AI_HUMANIZED", "NEWS", f"s{i:02d}") for i in range(10)]
    table = corpora.canonical(spark.createDataFrame(rows, "sample_id string, text string, origin string, domain string, parent_id string"))
    corpora.save_benchmark(table, str(tmp_path), "small")
    built = {r.sample_id: r.split for r in corpora.load_samples(spark, f"{tmp_path}/splits").collect()}
    assert len(built) == 40 and all(built[f"c{i:02d}"] == built[f"s{i:02d}"] for i in range(10)) and set(built.values()) == {"train", "val", "test"}
    about = corpora.load_manifest(spark, f"{tmp_path}/dataset_manifest.json").first()
    assert (about.dataset_name, about.total_samples, about.train_samples + about.val_samples + about.test_samples) == ("small", 40, 40)
    assert about.dedup_metadata.asDict() == {"initial_count": 50, "exact_duplicates_removed": 10, "final_count": 40}
    assert about.origins.asDict() == {"HUMAN": 30, "AI_HUMANIZED": 10} and about.domains.NEWS == 40
    manifest = corpora.manifest(table.withColumn("split", F.lit("train")), "m", notes="n", plain_hash=True).first()
    assert manifest.split_sizes == {"train": 50} and manifest.notes == "n" and manifest.humanizer_distribution == {} and manifest.source_datasets == []
