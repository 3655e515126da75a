"""Explanations: rule scores, bands, sentence heat maps, attributions and diagnostics, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from .sanitize import normal_form


def confidence_band(p: Column, style: str = "api") -> Column:
    """Band by distance from 0.5; two vocabularies."""
    names = {"api": ("VERY_HIGH", "HIGH", "MODERATE", "LOW_BORDERLINE"), "report": ("VERY_HIGH_CONFIDENCE", "HIGH_CONFIDENCE", "MODERATE_CONFIDENCE", "BORDERLINE_UNCERTAIN")}[style]
    away = F.abs(p - 0.5)
    return F.when(away > 0.35, names[0]).when(away > 0.20, names[1]).when(away > 0.10, names[2]).otherwise(names[3])


def classification(p: Column) -> Column:
    return F.when(p >= 0.5, "AI_GENERATED").otherwise("HUMAN_WRITTEN")


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id, words, chars and minutes to read (220 words a minute, 1 at least)."""
    n = T.n_space_words(F.col("text"))
    return docs.select("doc_id", n.alias("words"), F.length("text").alias("chars"), F.greatest(F.lit(1), F.ceil(n / 220).cast("int")).alias("read_minutes"))


#: Fixed patterns of the rule score. Word borders are ASCII, whatever the Java version takes them for.
_ZERO, _ODD = "[\\u200B-\\u200D\\uFEFF]", "[\\u0400-\\u04FF\\u0370-\\u03FF]"
_RULE_SENTENCE = "(?<![^.!?])[^.!?]++[.!?]++"  # from the start of a run, so that runs without an end are scanned once
_RULE_WORD = "(?:(?<![a-z0-9_])(?=[a-z0-9])|(?<=[a-z0-9_])(?='))[a-z0-9']+(?:(?<=[a-z0-9])(?![a-z0-9_])|(?<=')(?=[a-z0-9_]))"


def rule_score(docs: DataFrame) -> DataFrame:
    """A score that needs no model: keyword density, vocabulary, sentence rhythm and tampering.

    doc_id, ai_probability, classification, confidence_band, transition_density, ttr, burstiness.
    """
    text = F.col("text")
    zero, odd = F.regexp_count(text, F.lit(_ZERO)), F.regexp_count(text, F.lit(_ODD))
    rows = docs.select("doc_id", normal_form(F.regexp_replace(F.coalesce(text, F.lit("")), _ZERO, "")).alias("clean"), (F.coalesce(zero + odd, F.lit(0)) > 0).alias("tampered"))
    found = F.regexp_extract_all("clean", F.lit(_RULE_SENTENCE), F.lit(0))
    rows = rows.select("doc_id", "tampered", F.regexp_extract_all(F.lower("clean"), F.lit(_RULE_WORD), F.lit(0)).alias("w"), F.when(F.size(found) > 0, found).otherwise(F.array("clean")).alias("sent"))
    lengths = F.transform("sent", lambda s: F.regexp_count(s, F.lit("[A-Za-z0-9_]+")))
    n = F.greatest(F.size("w"), F.lit(1))
    rows = rows.select("doc_id", "tampered", (F.size(F.array_distinct("w")) / n).alias("ttr"), (F.size(F.filter("w", lambda x: x.isin(*L.RULE_KEYWORDS))) / n).alias("transition_density"), T.deviation(lengths, 0).alias("burstiness"))
    one = lambda c, v: F.when(c, v).otherwise(0.0)
    p = F.lit(0.5) + one(F.col("transition_density") > 0.02, 0.28) + one(F.col("ttr") < 0.65, 0.18) + one(F.col("burstiness") < 4.0, 0.15) + one(F.col("tampered"), 0.20) - one((F.col("ttr") > 0.78) & (F.col("burstiness") > 6.0), 0.35)
    rows = rows.withColumn("p", F.greatest(F.lit(0.04), F.least(F.lit(0.96), p)))
    p = F.col("p")
    band = F.when((p > 0.8) | (p < 0.2), "VERY_HIGH").when((p > 0.65) | (p < 0.35), "HIGH").otherwise("MODERATE")
    return rows.select("doc_id", F.round("p", 3).alias("ai_probability"), F.when(p >= 0.5, "AI_GENERATED").otherwise("HUMAN_AUTHORED").alias("classification"), band.alias("confidence_band"), "transition_density", "ttr", "burstiness")


def sentence_heatmap(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_index, text, word_count, ai_probability, suspicion_level."""
    rows = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_index", "sentence"))
    rows = rows.withColumn("lower", F.lower("sentence")).withColumn("word_count", T.n_space_words(F.col("sentence")))
    formal = F.regexp_like("lower", F.lit("^(?:" + "|".join(L.FORMAL_OPENERS) + ")"))
    buzz = F.exists(T.space_words(F.col("lower")), lambda w: w.isin(*L.BUZZWORDS))
    n = F.col("word_count")
    score = 0.50 + F.when(formal, 0.25).otherwise(0.0) + F.when(buzz, 0.20).otherwise(0.0) + F.when(n.between(15, 26), 0.10).when((n < 6) | (n > 42), -0.15).otherwise(0.0)
    score = F.round(F.greatest(F.lit(0.04), F.least(F.lit(0.96), score)), 3)
    level = F.when(score >= 0.70, "HIGH").when(score >= 0.50, "MODERATE").otherwise("LOW")
    return rows.select("doc_id", "sentence_index", F.col("sentence").alias("text"), "word_count", score.alias("ai_probability"), level.alias("suspicion_level"))


#: Signals: name of the feature in strict mode, in intended mode, shown name, direction, explanation. Fixed values.
SIGNALS = [
    ("prd_burstiness_word_length", "prd_burstiness", "Word Length Burstiness", "low", "AI text typically lacks natural variation in word length rhythm."),
    ("prd_token_entropy", "prd_unigram_entropy", "Vocabulary Entropy", "low", "Robotic text exhibits constrained lexical entropy compared to human prose."),
    ("str_transition_word_density", "str_transition_density", "Formal Transition Density", "high", "LLMs overuse formal discourse markers (furthermore, moreover, consequently)."),
    ("sty_ttr", "sty_ttr", "Type-Token Ratio (TTR)", "low", "Repetitive or constrained vocabulary diversity."),
    ("sem_semantic_monotony_index", "sem_semantic_monotony_index", "Semantic Monotony", "high", "Excessively uniform inter-sentence semantic similarity."),
    ("str_sentence_length_std", "sty_std_sentence_length", "Sentence Length Rhythm (Std Dev)", "low", "Human text has high sentence length rhythm variance (staccato vs compound)."),
]


def attributions(features: DataFrame, importances: dict[str, float] | None = None, mode: str = "strict") -> Column:
    """Signals of a feature row, by weight (5 times the feature's importance, or 1), heaviest first.

    strict: only signals whose strict name is a feature, as two of six are; intended: all six, by their real names.
    """
    rows = []
    for k, (strict, real, name, direction, why) in enumerate(SIGNALS):
        column = strict if mode == "strict" else real
        if column in features.columns:
            weight = 5.0 * importances[column] if importances and column in importances else 1.0
            rows.append((-weight, k, F.struct(F.lit(column).alias("feature"), F.lit(name).alias("display_name"), F.round(column, 4).alias("value"), F.lit(direction).alias("ai_indicative"), F.lit(round(weight, 3)).alias("weight_impact"), F.lit(why).alias("explanation"))))
    return F.array(*[x[2] for x in sorted(rows, key=lambda x: x[:2])])


def diagnostics(features: DataFrame, report: Column | None = None, mode: str = "strict") -> Column:
    """Findings as an array of (category, severity, title). In strict mode the three style findings read names that no
    feature has, and never fire."""
    names = {s: (s if mode == "strict" else r) for s, r, *_ in SIGNALS}

    def finding(condition, category, severity, title):
        return F.when(condition, F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(title).alias("title")))

    # Categories, severities, titles and limits.
    rows = []
    if report is not None:
        rows.append(finding(report["zero_width_count"] > 0, "SECURITY", "CRITICAL", "Invisible Zero-Width Character Injection Detected"))
        rows.append(finding(report["homoglyph_count"] > 0, "SECURITY", "WARNING", "Homoglyph / Confusable Characters Detected"))
    for signal, test, rest in (
        ("str_sentence_length_std", lambda x: x < 3.5, ("STYLE", "MODERATE", "Low Sentence Rhythm Variation")),
        ("str_transition_word_density", lambda x: x > 0.06, ("DISCOURSE", "MODERATE", "High Discourse Transition Density")),
        ("prd_burstiness_word_length", lambda x: x < 0.2, ("PREDICTABILITY", "HIGH", "Low Token Burstiness")),
    ):
        if names[signal] in features.columns:
            rows.append(finding(test(F.col(names[signal])), *rest))
    none = F.array().cast("array<struct<category:string,severity:string,title:string>>")
    return F.array_compact(F.array(*rows)) if rows else none


def explanation(scored: DataFrame, importances: dict[str, float] | None = None, mode: str = "strict") -> DataFrame:
    """doc_id, ai_probability, classification, band, attributions and diagnostics, from features with ai_probability."""
    p = F.col("ai_probability")
    report = F.col("audit") if "audit" in scored.columns else None
    return scored.select("doc_id", "ai_probability", classification(p).alias("classification"), confidence_band(p, "report").alias("confidence_band"), attributions(scored, importances, mode).alias("feature_attributions"), diagnostics(scored, report, mode).alias("linguistic_diagnostics"))
