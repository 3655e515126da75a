"""The registered queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.names import shared_folder
from ..operators import curation, detect, detector, explain, features, metrics, perturb, sanitize
from ..sources import corpora
from ..streaming import replay, streams
from . import oracles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nearest(x: Column, digits: int = 6) -> Column:
    """x rounded as DuckDB does: halves are those of the scaled double, so that 323 / 640, 504687.49999999994 millionths, goes down."""
    return F.round(x * 10.0**digits) / 10.0**digits


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; a negative zero becomes zero."""
    return df.select(*[(nearest(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _branch(f):
    return lambda spark, sf_dir: rounded(f(features.base(table(spark, sf_dir, "documents"))))


def _docs(spark, sf_dir):
    return features.spread(table(spark, sf_dir, "documents"))


def doc_text_stats(spark, sf_dir):
    docs, text = _docs(spark, sf_dir), F.col("text")
    more = docs.select("doc_id", F.size(T.tokens(text)).cast("long").alias("tokens"), F.size(T.sentences(text)).cast("long").alias("sentences"), F.size(T.paragraphs(text)).cast("long").alias("paragraphs"))
    stats = explain.text_stats(docs)
    return stats.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("words", "chars", "read_minutes")]).join(more, "doc_id")


def features_all_84(spark, sf_dir):
    return rounded(features.assemble(_docs(spark, sf_dir)))


def rule_score(spark, sf_dir):
    return rounded(explain.rule_score(_docs(spark, sf_dir)))


def confidence_bands(spark, sf_dir):
    p = F.col("ai_probability")
    return explain.rule_score(_docs(spark, sf_dir)).select("doc_id", explain.classification(p).alias("classification"), explain.confidence_band(p).alias("api_band"), explain.confidence_band(p, "report").alias("report_band"))


def sentence_heatmap(spark, sf_dir):
    return explain.sentence_heatmap(_docs(spark, sf_dir)).withColumns({c: F.col(c).cast("long") for c in ("sentence_index", "word_count")})


def feature_signals(spark, sf_dir):
    rows = features.assemble(_docs(spark, sf_dir), ("sty", "sem"))
    rows = rows.filter("sty_word_count > 0").select("doc_id", F.explode(explain.attributions(rows)).alias("a"))
    return rows.select("doc_id", "a.feature", "a.ai_indicative", "a.value", "a.weight_impact")


def explanations(spark, sf_dir):
    """Packages in intended mode, a row per signal and finding: features and score of the documents, audit of their tampered variants."""
    docs = _docs(spark, sf_dir)
    audited = sanitize.sanitize(_tampered(spark, sf_dir)).select("doc_id", "audit")
    rows = rounded(features.assemble(docs)).join(audited, "doc_id").join(explain.rule_score(docs).select("doc_id", "ai_probability"), "doc_id")
    shared_folder(spark)
    rows = explain.explanation(rows, mode="intended").checkpoint()  # the filters that explode() infers would copy features' whole expressions
    head = ["doc_id", "ai_probability", "classification", "confidence_band"]
    signals = rows.select(*head, F.explode("feature_attributions").alias("x")).select(*head, F.lit("signal").alias("kind"), F.col("x.feature").alias("name"), F.col("x.ai_indicative").alias("of"), F.round("x.value", 4).alias("value"))
    findings = rows.select(*head, F.explode("linguistic_diagnostics").alias("x")).select(*head, F.lit("finding").alias("kind"), F.col("x.title").alias("name"), F.concat_ws(" ", "x.category", "x.severity").alias("of"), F.lit(0.0).alias("value"))
    return signals.unionByName(findings)


def exact_dedup(spark, sf_dir):
    return curation.exact_dedup(_docs(spark, sf_dir)).select("doc_id", curation.dedup_hash(F.col("text")).alias("dedup_hash"))


def dedup_report(spark, sf_dir):
    return curation.dedup_report(_docs(spark, sf_dir))


def near_duplicate_pairs(spark, sf_dir):
    return rounded(curation.near_pairs(_docs(spark, sf_dir)))


def near_dedup(spark, sf_dir):
    return curation.near_dedup(_docs(spark, sf_dir)).select("doc_id")


def lineage_roots(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn")
    parent = F.lag("id").over(Window.partitionBy("conv_id").orderBy("turn"))
    return curation.lineage_roots(turns.select("id", parent.alias("parent_id")))


def grouped_split(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", curation.dedup_hash(F.col("text")).alias("h"))
    roots = docs.groupBy("h").agg(F.min("doc_id").alias("root"))
    return curation.grouped_split(docs.join(roots, "h").select(F.col("doc_id").alias("id"), "root"))


def leakage_report(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("h", curation.dedup_hash(F.col("text"))).withColumn("d", F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 1))
    split = F.when(F.col("d").isin("0", "1"), "val").when(F.col("d").isin("2", "3"), "test").otherwise("train")
    parent = F.lag("doc_id").over(Window.partitionBy("h").orderBy("doc_id"))
    return curation.leakage(docs.select(F.col("doc_id").alias("id"), parent.alias("parent_id"), "text", split.alias("split")))


def _perturbed(f):
    def query(spark, sf_dir):
        out = _docs(spark, sf_dir).select("doc_id", f(F.col("text"), F.col("doc_id")).alias("t"))
        return out.select("doc_id", F.length("t").cast("long").alias("perturbed_length"), F.md5("t").alias("digest"))

    return query


def _tampered(spark, sf_dir):
    docs, key = _docs(spark, sf_dir), F.col("doc_id")
    docs = docs.select("doc_id", perturb.zero_width(F.col("text"), key, 0.06).alias("text"))
    return docs.select("doc_id", perturb.homoglyph(F.col("text"), key, 0.09).alias("text"))


def all_attacks(spark, sf_dir):
    return perturb.apply_attacks(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "attack_type", "severity", "original_length", "perturbed_length", F.md5("perturbed_text").alias("digest"))


def sanitize_audit(spark, sf_dir):
    rows = _tampered(spark, sf_dir).select("doc_id", sanitize.audit(F.col("text")).alias("a"))
    long = lambda x, name: x.cast("long").alias(name)
    return rows.select("doc_id", "a.adversarial_markers_present", long(F.col("a.zero_width_count"), "zero_width_count"), long(F.col("a.homoglyph_count"), "homoglyph_count"), long(F.size("a.zero_width_details"), "zero_width_listed"), long(F.size("a.homoglyph_details"), "homoglyph_listed"), "a.mixed_script_anomaly", F.round("a.adversarial_risk_score", 6).alias("adversarial_risk_score"))


def sanitize_clean(spark, sf_dir):
    return sanitize.sanitize(_tampered(spark, sf_dir)).select("doc_id", F.md5("clean_text").alias("digest"))


def manifest_distributions(spark, sf_dir):
    return corpora.distributions(_docs(spark, sf_dir), ("lang", "source"))


def canonical_table(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    rows = corpora.canonical(docs.select(F.col("doc_id").alias("sample_id"), "text", F.col("lang").alias("language"), F.col("source").alias("source_dataset")))
    return rows.select("sample_id", "origin", "language", "source_dataset", *[F.col(c).cast("long").alias(c) for c in ("word_count", "char_count", "sentence_count")], "content_hash")


def corpus_manifest(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    rows = corpora.canonical(docs.select(F.col("doc_id").alias("sample_id"), "text", F.col("lang").alias("language"), F.col("source").alias("source_dataset")))
    maps = [F.to_json(c).alias(c) for c in ("origin_distribution", "domain_distribution", "generator_distribution", "humanizer_distribution", "split_sizes")]
    return corpora.manifest(rows, "documents").select("name", "version", "description", "total_samples", *maps, "content_hash", F.array_join("source_datasets", ",").alias("source_datasets"), "notes")


def ingest_answers(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    rows = turns.groupBy("conv_id").agg(of("user").alias("human_answers"), of("assistant").alias("chatgpt_answers")).orderBy("conv_id")
    return corpora.ingest_answers(rows).select("sample_id", "origin", "content_hash")


def label_origins(spark, sf_dir):
    code = F.col("quality") * 2 + F.col("toxic")
    label = F.when(code == 0, " AI ").when(code == 1, "Machine").when(code == 2, "human").otherwise("other")
    rows = table(spark, sf_dir, "labels").select("doc_id", label.alias("label")).withColumn("origin", corpora.origin_of(F.col("label")))
    return rows.withColumn("y", (F.col("origin") != "HUMAN").cast("long"))


def generated_corpus(spark, sf_dir):
    """A corpus of generated samples and their humanised children, from sentences of the documents as banks: 40 a source."""
    sentences = _docs(spark, sf_dir).select(F.col("source").alias("domain"), F.explode(T.sentences(F.col("text"))).alias("s")).withColumn("h", F.md5("s"))
    slot = F.conv(F.substring("h", 1, 6), 16, 10).cast("int") % 40
    rows = sentences.groupBy("domain", slot.alias("slot")).agg(F.min(F.struct("h", "s")).alias("x"))
    bank = rows.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "x"))), lambda y: y["x"]["s"]).alias("bank"))
    ai = corpora.generated_corpus(spark, bank, 10, "AI_RAW", generator="generated")
    rows = ai.unionByName(corpora.generated_corpus(spark, bank, 10, "HUMAN", seed=7)).unionByName(corpora.humanized_children(ai))
    return rows.select("sample_id", "origin", "domain", "generator", "humanizer", "transformation_severity", "parent_id", F.col("word_count").cast("long").alias("word_count"), "content_hash")


def _written(spark, write):
    """The path of a new folder that `write` has filled."""
    path = replay.folder(spark)
    write(path)
    return path


def jsonl_read(spark, sf_dir):
    """Documents written as JSON lines and read again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    path = _written(spark, lambda p: docs.write.json(p))
    return corpora.read_jsonl(spark, path, docs.schema).select("doc_id", "source", F.md5("text").alias("digest"))


def csv_labelled(spark, sf_dir):
    """Labelled documents written as CSV and ingested again."""
    code = F.col("quality") * 2 + F.col("toxic")
    label = F.when(code == 0, " AI ").when(code == 1, "Machine").when(code == 2, "human").otherwise("other")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", label.alias("label"), F.col("source").alias("model"))
    rows = docs.orderBy("doc_id").coalesce(1).select("text", "label", "model").write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    path = _written(spark, lambda p: rows.csv(f"{p}/rows.csv"))
    return corpora.ingest_labelled(spark, f"{path}/rows.csv").select("sample_id", "origin", "generator", "source_id", "content_hash")


def whole_texts(spark, sf_dir):
    """Items of the benchmark written as files of their own and read as whole texts."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    path = _written(spark, lambda p: items.write.partitionBy("item_id").text(p))
    rows = corpora.read_texts(spark, f"{path}/*")
    return rows.select(F.regexp_extract("path", r"item_id=(\d+)/", 1).cast("long").alias("item_id"), F.md5(F.regexp_replace("text", r"\n\z", "")).alias("digest"))


def exported(spark, sf_dir):
    return corpora.export(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"))


def _samples(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return corpora.canonical(docs.select(F.col("doc_id").alias("sample_id"), "text", F.col("lang").alias("language"), F.upper("source").alias("domain"), F.col("source").alias("source_dataset")))


def saved_benchmark(spark, sf_dir):
    """Dedup, grouped split and save as one job; the splits as they are read again."""
    path = _written(spark, lambda p: corpora.save_benchmark(_samples(spark, sf_dir), p))
    return corpora.load_samples(spark, f"{path}/splits").select("sample_id", "split", "domain", "content_hash")


def benchmark_manifest(spark, sf_dir):
    """The manifest that is saved beside the splits, as it is read again."""
    path = _written(spark, lambda p: corpora.save_benchmark(_samples(spark, sf_dir), p, "documents"))
    row = corpora.load_manifest(spark, f"{path}/dataset_manifest.json")
    return row.select("dataset_name", "total_samples", "train_samples", "val_samples", "test_samples", "dedup_metadata.initial_count", "dedup_metadata.exact_duplicates_removed", "dedup_metadata.final_count", F.to_json("domains").alias("domains"))


def plain_hash(spark, sf_dir):
    return corpora.plain_dataset_hash(_samples(spark, sf_dir))


def request_rejects(spark, sf_dir):
    rows = detect.rejects(_docs(spark, sf_dir), 300, 5000)
    return rows.select("doc_id", "reason", F.col("char_count").cast("long").alias("char_count"))


def request_batches(spark, sf_dir):
    return detect.batch_size(_docs(spark, sf_dir).withColumn("of", F.col("doc_id") % 23), "of", 42)


def request_texts(spark, sf_dir):
    """The text that is judged, clean for even ids and raw for odd ones, and what is told of the raw one."""
    rows = detect.choose(_tampered(spark, sf_dir).withColumn("sanitize_adversarial", F.col("doc_id") % 2 == 0))
    return rows.select("doc_id", F.md5("text").alias("digest"), F.col("audit.adversarial_markers_present").alias("tampered"), *[F.col(c).cast("long").alias(c) for c in ("word_count", "char_count")])


def sanitize_details(spark, sf_dir):
    """The first look-alikes and invisible characters of each tampered text, with their names and places."""
    rows = _tampered(spark, sf_dir).select("doc_id", sanitize.audit(F.col("text")).alias("a"))
    entry = lambda x, new, name: F.struct(x["position"].cast("long").alias("position"), x["char"].alias("char"), new.alias("replacement"), x[name].alias("name"))
    alike = F.transform("a.homoglyph_details", lambda x: entry(x, x["replacement"], "unicode_name"))
    zero = F.transform("a.zero_width_details", lambda x: entry(x, F.lit(""), "name"))
    # explode() alone infers a filter that audits every text again
    return rows.select("doc_id", F.explode_outer(F.concat(alike, zero)).alias("d")).filter("d is not null").select("doc_id", "d.*")


def sanitize_toggles(spark, sf_dir):
    """Texts cleaned of invisible characters only, of look-alikes only, and of neither."""
    rows = _tampered(spark, sf_dir)
    clean = lambda zero, alike: sanitize.tidy(sanitize.normal_form(sanitize.replaced(F.col("text"), zero, alike)))
    return rows.select("doc_id", F.md5(sanitize.tidy(sanitize.replaced(F.col("text"), True, False))).alias("invisible"), F.md5(sanitize.tidy(sanitize.replaced(F.col("text"), False, True))).alias("alike"), F.md5(clean(True, True)).alias("both"))


def feature_family(spark, sf_dir):
    """One family only, by its prefix."""
    return rounded(features.assemble(_docs(spark, sf_dir), ("sem",)))


def stream_verdicts(spark, sf_dir):
    """Verdicts per five minutes of event time; documents arrive one a second."""
    def count(stream):
        scored = streams.score(stream).withColumn("ts", F.timestamp_seconds(F.col("doc_id") % 3600))
        return streams.verdict_counts(scored).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "classification", "n", nearest(F.col("mean_probability")).alias("mean_probability"))

    return replay.replayed(spark, sf_dir, "documents", count, "complete")


def _scores(spark, sf_dir):
    docs, labels = _docs(spark, sf_dir), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(F.col("quality").alias("label"), ((F.col("n_chars") % 101).cast("double") / 100).alias("score"))


def metrics_all(spark, sf_dir):
    return metrics.evaluate(_scores(spark, sf_dir))


def metrics_curve(spark, sf_dir):
    return metrics.curve(_scores(spark, sf_dir))


def metrics_calibration(spark, sf_dir):
    out = rounded(metrics.calibration(_scores(spark, sf_dir)))
    return out.withColumn("bin", F.col("bin").cast("long"))


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))


def detector_scores(spark, sf_dir):
    rows = detector.stored(detector.labelled_features(_docs(spark, sf_dir), _labels(spark, sf_dir)))
    model = detector.Detector("boosted").fit(rows.filter("split = 'train'"))
    return model.predict(rows.filter("split = 'test'")).select("doc_id", "label", "ai_probability", "prediction")


def ablation(spark, sf_dir):
    return detector.ablation(detector.labelled_features(_docs(spark, sf_dir), _labels(spark, sf_dir)))


def adversarial_benchmark(spark, sf_dir):
    return detector.adversarial_benchmark(_docs(spark, sf_dir), _labels(spark, sf_dir))


def stream_rule_score(spark, sf_dir):
    return rounded(replay.replayed(spark, sf_dir, "documents", explain.rule_score))


def stream_event_windows(spark, sf_dir):
    def count(stream):
        return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "5 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")

    return replay.replayed(spark, sf_dir, "events", count, "complete")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "doc_text_stats": doc_text_stats,
    "sty_scalars": _branch(features.stylometry_scalars),
    "gram_features": _branch(features.gram_features),
    "position_features": _branch(features.position_features),
    "str_scalars": _branch(features.structural_scalars),
    "sentence_counts": _branch(features.sentence_counts),
    "sentence_variation": _branch(features.sentence_variation),
    "char_entropy": _branch(features.char_features),
    "sem_scalars": _branch(features.semantic_scalars),
    "sem_cross_entropy": _branch(features.cross_entropies),
    "perturb_zero_width": _perturbed(lambda t, k: perturb.attack(t, k, "zero_width", 0.5)),
    "perturb_homoglyph": _perturbed(lambda t, k: perturb.attack(t, k, "homoglyph", 0.5)),
    "perturb_synonym": _perturbed(lambda t, k: perturb.attack(t, k, "synonym", 0.5)),
    **{
        f.__name__: f
        for f in (
            features_all_84, rule_score, confidence_bands, sentence_heatmap, feature_signals, explanations, exact_dedup, dedup_report, near_duplicate_pairs, near_dedup, lineage_roots, grouped_split,
            leakage_report, all_attacks, sanitize_audit, sanitize_clean, manifest_distributions, canonical_table, corpus_manifest, ingest_answers, label_origins, generated_corpus, metrics_all, metrics_curve,
            metrics_calibration, detector_scores, ablation, adversarial_benchmark, stream_rule_score, stream_event_windows, stream_verdicts, jsonl_read, csv_labelled, whole_texts, exported, saved_benchmark, benchmark_manifest,
            plain_hash, request_rejects, request_batches, request_texts, sanitize_details, sanitize_toggles, feature_family,
        )
    },
}

ORACLES: dict[str, str] = {
    "doc_text_stats": oracles.TEXT_STATS,
    "sty_scalars": oracles.STY_SCALARS,
    "gram_features": oracles.GRAMS,
    "position_features": oracles.POSITIONS,
    "str_scalars": oracles.STR_SCALARS,
    "sentence_counts": oracles.SENTENCE_COUNTS,
    "sentence_variation": oracles.VARIATION,
    "char_entropy": oracles.CHARS,
    "sem_scalars": oracles.SEM_SCALARS,
    "sem_cross_entropy": oracles.CROSS,
    "features_all_84": oracles.features_all(features.FEATURES),
    "rule_score": oracles.RULE_SCORE,
    "stream_rule_score": oracles.RULE_SCORE,
    "stream_event_windows": oracles.WINDOWS,
    "confidence_bands": oracles.BANDS,
    "sentence_heatmap": oracles.HEATMAP,
    "feature_signals": oracles.SIGNALS,
    "exact_dedup": oracles.EXACT_DEDUP,
    "dedup_report": oracles.DEDUP_REPORT,
    "near_duplicate_pairs": oracles.NEAR_PAIRS,
    "lineage_roots": oracles.LINEAGE,
    "grouped_split": oracles.GROUPED_SPLIT,
    "leakage_report": oracles.LEAKAGE,
    "perturb_zero_width": oracles.ZERO_WIDTH,
    "perturb_homoglyph": oracles.HOMOGLYPH,
    "perturb_synonym": oracles.SYNONYM,
    "sanitize_audit": oracles.AUDIT,
    "sanitize_clean": oracles.CLEAN,
    "manifest_distributions": oracles.DISTRIBUTIONS,
    "canonical_table": oracles.CANONICAL,
    "ingest_answers": oracles.ANSWERS,
    "label_origins": oracles.ORIGINS,
    "metrics_all": oracles.METRICS,
    "metrics_curve": oracles.CURVE,
    "metrics_calibration": oracles.CALIBRATION,
    "near_dedup": oracles.NEAR_DEDUP,
    "all_attacks": oracles.ATTACKS,
    "corpus_manifest": oracles.MANIFEST,
    "plain_hash": oracles.PLAIN_HASH,
    "explanations": oracles.explanations(features.FEATURES),
    "generated_corpus": oracles.GENERATED,
    "jsonl_read": oracles.JSONL,
    "csv_labelled": oracles.LABELLED,
    "whole_texts": oracles.WHOLE,
    "exported": oracles.EXPORTED,
    "saved_benchmark": oracles.BENCHMARK,
    "benchmark_manifest": oracles.BENCHMARK_MANIFEST,
    "request_rejects": oracles.REJECTS,
    "request_batches": oracles.BATCHES,
    "request_texts": oracles.CHOSEN,
    "sanitize_details": oracles.DETAILS,
    "sanitize_toggles": oracles.TOGGLES,
    "feature_family": oracles.features_all([c for c in features.FEATURES if c.startswith("sem")]),
    "stream_verdicts": oracles.VERDICTS,
}
