"""84 text features per document in four families.

All features are array expressions over a document's tokens, sentences and paragraphs, counts included: those are run lengths of
sorted arrays, which takes a fraction of exploding and hash-grouping the same tokens. A family's functions add columns to
rows of (doc_id, text), and assemble() chains them, so that features of any number of documents cost one pass without joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T

STYLOMETRY = (
    "ttr mtld_score hd_d_score hapax word_count unique_word_count avg_word_length std_word_length max_word_length sentence_count "
    "avg_sentence_length std_sentence_length max_sentence_length min_sentence_length paragraph_count avg_paragraph_length "
    "function_word_ratio comma_ratio period_ratio question_ratio exclamation_ratio semicolon_ratio colon_ratio dash_ratio quote_ratio "
    "first_person_ratio second_person_ratio third_person_ratio modal_ratio conjunction_ratio discourse_marker_count discourse_marker_ratio contraction_ratio"
).split()
STRUCTURAL = (
    "paragraph_count avg_paragraph_word_count std_paragraph_word_count min_paragraph_word_count max_paragraph_word_count paragraph_length_ratio "
    "avg_sentences_per_paragraph std_sentences_per_paragraph heading_count has_headings transition_addition_count transition_contrast_count "
    "transition_cause_count transition_sequence_count transition_example_count transition_conclusion_count total_transitions transition_density "
    "starter_diversity repeated_starter_ratio paragraph_start_repetition avg_sentence_position_similarity sentence_length_trend structure_score"
).split()
PREDICTABILITY = (
    "unigram_entropy bigram_entropy trigram_entropy char_entropy burstiness vocab_burstiness bigram_repeat_rate trigram_repeat_rate "
    "exact_sentence_repeat_rate avg_word_rank std_word_rank top10_coverage top50_coverage new_word_rate vocab_growth_rate "
    "sentence_length_cv sentence_start_entropy conditional_entropy"
).split()
SEMANTIC = (
    "word_2gram_cross_entropy word_2gram_perplexity word_3gram_cross_entropy word_3gram_perplexity inter_sentence_jaccard_mean "
    "inter_sentence_jaccard_std semantic_monotony_index trigram_repetition_rate quadgram_repetition_rate"
).split()
FAMILIES = {"sty": STYLOMETRY, "str": STRUCTURAL, "prd": PREDICTABILITY, "sem": SEMANTIC}
#: The fixed order of the feature vector.
FEATURES = [f"{p}_{c}" for p, names in FAMILIES.items() for c in names]


#: What a family's columns stand beside by default; assemble() hands the columns of earlier families on.
KEY = ("doc_id",)


#: What several branches read of a text. assemble() computes each once, as a column of this name that it hands on.
SHARED = {
    "_tok": lambda text: T.tokens(text),
    "_alpha": lambda text: T.alpha_tokens(text),
    "_sent": lambda text: T.sentences(text),
    "_para": lambda text: T.paragraphs(text),
    "_slen": lambda text: F.transform(T.sentences(text), T.n_space_words),
    "_start": lambda text: F.transform(T.sentences(text), lambda s: T.starter(s)),
}


def _of(b: DataFrame, name: str) -> Column:
    """A shared column, or its expression where b hasn't got it."""
    return F.col(name) if name in b.columns else SHARED[name](F.col("text"))


def share(b: DataFrame) -> DataFrame:
    """b (doc_id, text) with the shared columns; those made of sentences read the sentences' column."""
    b = b.select("doc_id", "text", *[SHARED[c](F.col("text")).alias(c) for c in ("_tok", "_alpha", "_sent", "_para")])
    return b.select("*", F.transform("_sent", T.n_space_words).alias("_slen"), F.transform("_sent", lambda s: T.starter(s)).alias("_start"))


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: small files have few row groups, and features take much work a row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def base(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and text, in as many partitions as there are cores at least; large inputs stay as they are read, without a shuffle."""
    return spread(docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")))


def _zero(x: Column, when_empty: Column) -> Column:
    return F.when(when_empty, F.lit(0.0)).otherwise(x.cast("double"))


def run_counts(keys: Column) -> Column:
    """How often each distinct key occurs, in the order of keys: lengths of the runs of the sorted array."""

    def count(s):
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return T.let(heads, lambda h: F.transform(h, lambda x, k: F.coalesce(F.get(h, k + 1), F.size(s)) - x))

    none = F.array().cast("array<int>")
    return F.coalesce(T.let(F.sort_array(keys), lambda s: F.when(F.size(s) > 0, count(s)).otherwise(none)), none)


def _sum(xs: Column, f) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x.cast("double")))


def _entropy(counts: str, total: Column) -> Column:
    """Bits per item of the distribution that counts give; 0 for none."""
    return F.when(total > 0, F.greatest(F.log2(total) - T.ratio(_sum(F.col(counts), lambda x: x * F.log2(x)), total), F.lit(0.0))).otherwise(0.0)


def _again(counts: str) -> Column:
    """Share of distinct items that occur more than once."""
    return T.ratio(F.size(F.filter(counts, lambda x: x > 1)), F.size(counts))


def stylometry_scalars(b: DataFrame, keep: tuple[str, ...] = KEY) -> DataFrame:
    """Stylometric features that need no counts by token."""
    tok, text = F.col("tok"), F.col("_text")
    b = b.select(*keep, F.col("text").alias("_text"), F.lower("text").alias("lower"), _of(b, "_tok").alias("tok"), _of(b, "_sent").alias("sent"), _of(b, "_para").alias("para"))
    b = b.withColumn("len", F.transform("tok", F.length)).withColumn("slen", F.transform("sent", lambda s: F.size(T.tokens(s))))
    n, chars = F.size(tok), F.length(text)
    per_char = {"comma": ",", "period": ".", "question": "?", "exclamation": "!", "semicolon": ";", "colon": ":", "dash": "-—", "quote": "\"'“”"}
    lists = {"function_word_ratio": L.FUNCTION_WORDS, "first_person_ratio": L.PRONOUNS_FIRST, "second_person_ratio": L.PRONOUNS_SECOND, "third_person_ratio": L.PRONOUNS_THIRD, "modal_ratio": L.MODAL_VERBS, "conjunction_ratio": L.CONJUNCTIONS}
    found = T.markers(F.col("lower"), L.DISCOURSE_MARKERS)
    out = {
        "word_count": n,
        "avg_word_length": T.mean(F.col("len")),
        "std_word_length": T.deviation(F.col("len")),
        "max_word_length": F.array_max("len"),
        "sentence_count": F.size("sent"),
        "avg_sentence_length": T.mean(F.col("slen")),
        "std_sentence_length": T.deviation(F.col("slen")),
        "max_sentence_length": F.array_max("slen"),
        "min_sentence_length": F.array_min("slen"),
        "paragraph_count": F.size("para"),
        "avg_paragraph_length": T.ratio(n, F.size("para")),
        **{k: T.share_of(tok, v) for k, v in lists.items()},
        **{f"{k}_ratio": T.ratio(T.occurrences(text, v), chars) for k, v in per_char.items()},
        "discourse_marker_count": found,
        "discourse_marker_ratio": T.ratio(found, F.size("sent")),
        "contraction_ratio": T.ratio(F.regexp_count(text, F.lit(rf"{T.WORD}'{T.WORD}")), n),
    }
    return b.select(*keep, *[_zero(F.coalesce(x, F.lit(0)), n == 0).alias(f"sty_{k}") for k, x in out.items()])


def structural_scalars(b: DataFrame, keep: tuple[str, ...] = KEY) -> DataFrame:
    text = F.col("_text")
    b = b.select(*keep, F.col("text").alias("_text"), F.lower("text").alias("lower"), _of(b, "_sent").alias("sent"), _of(b, "_para").alias("para"), _of(b, "_slen").alias("slen"), _of(b, "_start").alias("start"))
    # A text of one paragraph is its own paragraph, but for white space around it, and has its sentences.
    whole = F.when(F.size("para") == 1, F.array(F.size("sent"))).otherwise(F.transform("para", lambda p: F.size(T.sentences(p))))
    b = b.withColumn("plen", F.transform("para", T.n_space_words)).withColumn("psent", whole).withColumn("heads", F.size(T.headings(text)))
    for family, words in L.TRANSITIONS.items():
        b = b.withColumn(f"transition_{family}_count", T.markers(F.col("lower"), words))
    families = [f"transition_{k}_count" for k in L.TRANSITIONS]
    b = b.withColumn("transitions", sum((F.col(c) for c in families[1:]), F.col(families[0])))
    slen, n = F.col("slen"), F.size("slen")
    later = F.slice(slen, F.lit(2), F.greatest(n - 1, F.lit(0)))
    steps = F.zip_with(later, F.slice(slen, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, c: F.abs(a - c))
    centre = (n - 1) / 2.0
    product = T.total(F.transform(slen, lambda x, i: (i * x).cast("double"))) - centre * T.total(slen)
    spread = n.cast("double") * (n.cast("double") * n - 1) / 12.0
    diversity = T.ratio(F.size(F.array_distinct("start")), n)
    out = {
        "paragraph_count": F.size("para"),
        "avg_paragraph_word_count": T.mean(F.col("plen")),
        "std_paragraph_word_count": T.deviation(F.col("plen")),
        "min_paragraph_word_count": F.array_min("plen"),
        "max_paragraph_word_count": F.array_max("plen"),
        "paragraph_length_ratio": T.ratio(F.array_max("plen"), F.array_min("plen")),
        "avg_sentences_per_paragraph": T.mean(F.col("psent")),
        "std_sentences_per_paragraph": T.deviation(F.col("psent")),
        "heading_count": F.col("heads"),
        "has_headings": (F.col("heads") > 0).cast("int"),
        **{c: F.col(c) for c in families},
        "total_transitions": F.col("transitions"),
        "transition_density": T.ratio(F.col("transitions"), n),
        "starter_diversity": diversity,
        "avg_sentence_position_similarity": T.mean(steps),
        "sentence_length_trend": F.when(n >= 2, T.ratio(product, spread)).otherwise(0.0),
        "structure_score": 2.0 * (F.col("heads") > 0).cast("int") + F.least(F.size("para"), F.lit(10)) + F.least(F.col("transitions"), F.lit(20)) / 2.0 + 5.0 * diversity,
    }
    return b.select(*keep, *[_zero(F.coalesce(x, F.lit(0)), n == 0).alias(f"str_{k}") for k, x in out.items()])


def sentence_counts(b: DataFrame, keep: tuple[str, ...] = KEY) -> DataFrame:
    """Features of repeated sentences and of words that start sentences or paragraphs."""
    lower = lambda s: F.array_join(T.space_words(F.lower(s)), " ")
    b = b.select(*keep, _of(b, "_sent").alias("sent"), _of(b, "_para").alias("para"), _of(b, "_start").alias("start"))
    if keep == KEY:
        b = b.filter(F.size("sent") > 0)
    kinds = {"start": F.col("start"), "raw": F.transform("sent", lambda s: T.starter(s, None)), "para": F.transform("para", lambda s: T.starter(s)), "whole": F.transform("sent", lower)}
    b = b.select(*keep, *[run_counts(x).alias(k) for k, x in kinds.items()])
    return b.select(*keep, _again("start").alias("str_repeated_starter_ratio"), _again("para").alias("str_paragraph_start_repetition"), _again("whole").alias("prd_exact_sentence_repeat_rate"), _entropy("raw", _sum(F.col("raw"), lambda c: c)).alias("prd_sentence_start_entropy"))


def sentence_variation(b: DataFrame, keep: tuple[str, ...] = KEY) -> DataFrame:
    b = b.select(*keep, F.size(_of(b, "_tok")).alias("n"), _of(b, "_slen").alias("slen"))
    return b.select(*keep, F.when(F.col("n") > 0, T.ratio(T.deviation(F.col("slen")), T.mean(F.col("slen")))).otherwise(0.0).alias("prd_sentence_length_cv"))


def gram_run_counts(tok: str, n: int, without: int = 0) -> Column:
    """Counts of a token column's n-grams, the last `without` of them left out. Grams are told apart by 64-bit keys."""

    def keys(t):
        last = F.size(t) - (n - 1) - without
        key = lambda i: F.xxhash64(*[F.get(t, i + k) for k in range(n)])
        return F.when(last > 0, F.transform(F.sequence(F.lit(0), last - 1), key)).otherwise(F.array().cast("array<bigint>"))

    return T.let(F.col(tok), lambda t: run_counts(keys(t)))


def gram_features(b: DataFrame, keep: tuple[str, ...] = KEY) -> DataFrame:
    """Entropies, repeat rates, ranks, coverage, hapax and HD-D, from the counts of each document's own grams.

    Counts are run lengths of sorted arrays: nothing is exploded, grouped or shuffled. Rank features depend on counts only,
    as words of one count hold a stretch of ranks whichever order they take in it.
    """
    b = b.select(*keep, _of(b, "_tok").alias("tok"))
    b = b.select(*keep, F.size("tok").cast("double").alias("n"), F.sort_array(run_counts(F.col("tok")), asc=False).alias("c1"), *[gram_run_counts("tok", k).alias(f"c{k}") for k in (2, 3)])
    if keep == KEY:
        b = b.filter("n > 0")
    n, zero = F.col("n"), F.lit(0.0)
    one = F.col("c1")
    start = F.struct(*[zero.alias(k) for k in ("s", "r", "q")])
    rank = lambda a, c: F.struct((a["s"] + 1).alias("s"), (a["r"] + c * a["s"]).alias("r"), (a["q"] + c * a["s"] * a["s"]).alias("q"))
    missed = lambda c: F.aggregate(F.sequence(F.lit(0), F.lit(41)), F.lit(1.0), lambda a, i: a * F.greatest(n - c - i, zero) / (n - i))
    hdd = F.aggregate(F.array_distinct(one), zero, lambda a, c: a + F.size(F.filter(one, lambda d: d == c)) * (1 - missed(c)))
    top = lambda k: T.ratio(_sum(F.slice(one, 1, k), lambda c: c), n)
    types = F.size(one).cast("double")
    b = b.select(
        *keep, "n", F.aggregate(one, start, rank).alias("ranks"), _entropy("c1", n).alias("h1"), _entropy("c2", n - 1).alias("h2"), _entropy("c3", n - 2).alias("h3"), _again("c2").alias("r2"), _again("c3").alias("r3"),
        T.ratio(types, n).alias("ttr"), types.alias("types"), T.ratio(F.size(F.filter(one, lambda x: x == 1)), n).alias("hapax"), F.when(n >= 42, hdd).otherwise(zero).alias("hdd"), top(10).alias("top10"), top(50).alias("top50"),
    )
    mean = T.ratio(F.col("ranks.r"), n)
    spread = F.greatest(F.col("ranks.q") - n * mean * mean, zero)
    return b.select(
        *keep,
        F.col("ttr").alias("sty_ttr"),
        F.col("hdd").alias("sty_hd_d_score"),
        F.col("hapax").alias("sty_hapax"),
        F.col("types").alias("sty_unique_word_count"),
        F.col("h1").alias("prd_unigram_entropy"),
        F.col("h2").alias("prd_bigram_entropy"),
        F.col("h3").alias("prd_trigram_entropy"),
        F.col("r2").alias("prd_bigram_repeat_rate"),
        F.col("r3").alias("prd_trigram_repeat_rate"),
        mean.alias("prd_avg_word_rank"),
        F.sqrt(spread / F.greatest(n - 1, F.lit(1.0))).alias("prd_std_word_rank"),
        F.col("top10").alias("prd_top10_coverage"),
        F.col("top50").alias("prd_top50_coverage"),
        F.col("ttr").alias("prd_new_word_rate"),
        F.greatest(F.col("h2") - F.col("h1"), zero).alias("prd_conditional_entropy"),
    )


def _factors(rows: Column, seen, limit: float = 0.72) -> Column:
    """Words per factor: a segment ends where its share of new words falls to the limit.

    A word is new in its segment if its last occurrence, seen(x), lies before the segment's start, so the state is four numbers.
    """
    start = F.struct(F.lit(0.0).alias("factors"), F.lit(0).alias("start"), F.lit(0).alias("types"), F.lit(0).alias("at"))

    def step(acc, x):
        types = acc["types"] + F.when(F.coalesce(seen(x) < acc["start"], F.lit(True)), 1).otherwise(0)
        at = acc["at"] + 1
        full = types / (at - acc["start"]) <= limit
        return F.struct((acc["factors"] + F.when(full, 1.0).otherwise(0.0)).alias("factors"), F.when(full, at).otherwise(acc["start"]).alias("start"), F.when(full, 0).otherwise(types).alias("types"), at.alias("at"))

    def end(acc):
        rest = acc["at"] - acc["start"]
        factors = acc["factors"] + F.when(rest > 0, (1 - acc["types"] / rest) / (1 - limit)).otherwise(0.0)
        return F.when(factors > 0, acc["at"] / factors).otherwise(acc["at"].cast("double"))

    return F.aggregate(rows, start, step, end)


def neighbours(tok: Column) -> Column:
    """Array by position of (pos, prev, next): where the token stands, and where its word stands before and after.

    Sorted by (word, position), a token's neighbours are next to it; sorted back by position, they are in text order.
    """
    placed = F.sort_array(F.transform(tok, lambda w, i: F.struct(F.xxhash64(w).alias("w"), w.alias("t"), i.alias("pos"))))

    def link(s):
        other = lambda x, i: F.when((F.get(s, i)["w"] == x["w"]) & (F.get(s, i)["t"] == x["t"]), F.get(s, i)["pos"])
        return F.sort_array(F.transform(s, lambda x, i: F.struct(x["pos"].alias("pos"), other(x, i - 1).alias("prev"), other(x, i + 1).alias("next"))))

    return T.let(placed, link)


def position_features(b: DataFrame, keep: tuple[str, ...] = KEY) -> DataFrame:
    """MTLD, burstiness and vocabulary growth, from each token's distance to its neighbours of the same word."""
    b = b.select(*keep, _of(b, "_tok").alias("tok"))
    if keep == KEY:
        b = b.filter(F.size("tok") > 0)
    b = b.select(*keep, F.size("tok").alias("n"), neighbours(F.col("tok")).alias("ahead"))
    n, ahead = F.col("n"), F.col("ahead")
    gap = lambda x: (x["pos"] - x["prev"]).cast("double")
    start = F.struct(*[F.lit(0.0).alias(k) for k in ("k", "s", "q")], F.lit(0).alias("fresh"))

    def step(a, x):
        block = x["pos"] - x["pos"] % 50
        fresh = (block < n - 50) & F.coalesce(x["prev"] < block, F.lit(True))
        more = F.coalesce(gap(x), F.lit(0.0))
        return F.struct((a["k"] + x["prev"].isNotNull().cast("double")).alias("k"), (a["s"] + more).alias("s"), (a["q"] + more * more).alias("q"), (a["fresh"] + fresh.cast("int")).alias("fresh"))

    b = b.select(*keep, "n", "ahead", F.aggregate(ahead, start, step).alias("g"))
    k, mean = F.col("g.k"), T.ratio(F.col("g.s"), F.col("g.k"))
    spread = F.sqrt(F.greatest(F.col("g.q") - k * mean * mean, F.lit(0.0)) / (k - 1))
    return b.select(
        *keep,
        F.when(n >= 10, (_factors(ahead, lambda x: x["prev"]) + _factors(F.reverse(ahead), lambda x: n - 1 - x["next"])) / 2).otherwise(0.0).alias("sty_mtld_score"),
        F.when((n >= 10) & (k >= 2), T.ratio(spread - mean, spread + mean)).otherwise(0.0).alias("prd_burstiness"),
        F.when(n >= 100, T.ratio(F.col("g.fresh") / 50.0, F.ceil((n - 50) / 50))).otherwise(0.0).alias("prd_vocab_growth_rate"),
    )


def char_features(b: DataFrame, keep: tuple[str, ...] = KEY) -> DataFrame:
    worded = F.regexp_like("text", F.lit(T.WORD))
    if keep == KEY:
        b = b.filter(worded)
    b = b.select(*keep, F.length("text").cast("double").alias("n"), run_counts(F.when(worded, F.split(F.lower("text"), ""))).alias("c"))
    share = lambda x: x / F.col("n")
    return b.select(*keep, (0.0 - _sum(F.col("c"), lambda x: share(x) * F.log2(share(x)))).alias("prd_char_entropy"))


def semantic_scalars(b: DataFrame, keep: tuple[str, ...] = KEY) -> DataFrame:
    b = b.select(*keep, _of(b, "_alpha").alias("w"), F.transform(_of(b, "_sent"), lambda s: F.array_distinct(T.alpha_tokens(s))).alias("sets"))
    n, size = F.size("sets"), F.size("w")
    cut = lambda k: F.slice("sets", F.lit(k), F.greatest(n - 1, F.lit(0)))
    b = b.withColumn("sims", F.zip_with(cut(1), cut(2), lambda x, y: T.ratio(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))))
    mean, spread = T.mean(F.col("sims")), T.deviation(F.col("sims"), 0)

    def repetition(k):
        rate = 1 - T.ratio(F.size(F.array_distinct(T.ngrams(F.col("w"), k))), size - (k - 1))
        return F.when(size >= 6, F.round(F.greatest(rate, F.lit(0.0)), 4)).otherwise(0.0)

    return b.select(
        *keep,
        F.round(mean, 4).alias("sem_inter_sentence_jaccard_mean"),
        F.round(spread, 4).alias("sem_inter_sentence_jaccard_std"),
        F.when(n >= 2, F.round(mean / (spread + 0.05), 4)).otherwise(0.0).alias("sem_semantic_monotony_index"),
        repetition(3).alias("sem_trigram_repetition_rate"),
        repetition(4).alias("sem_quadgram_repetition_rate"),
    )


def cross_entropies(b: DataFrame, keep: tuple[str, ...] = KEY, alpha: float = 0.1) -> DataFrame:
    """Cross-entropy and perplexity of a text under its own add-alpha smoothed bigram and trigram model.

    The sum of c log((c + alpha) / (of + alpha v)) parts into sums over the counts c of grams and the counts of their prefixes.
    """
    b = b.select(*keep, _of(b, "_alpha").alias("w"))
    if keep == KEY:
        b = b.filter(F.size("w") > 1)
    size = F.size("w")
    grams = {f"g{n}": gram_run_counts("w", n) for n in (2, 3)}
    prefixes = {f"p{n}": gram_run_counts("w", n - 1, 1) for n in (2, 3)}
    b = b.select(*keep, size.alias("m"), F.greatest(F.size(F.array_distinct("w")), F.lit(10)).alias("v"), *[x.alias(k) for k, x in (grams | prefixes).items()])
    for n in (2, 3):
        own = _sum(F.col(f"g{n}"), lambda c: c * F.log2(c + alpha))
        of = _sum(F.col(f"p{n}"), lambda c: c * F.log2(c + alpha * F.col("v")))
        b = b.withColumn(f"h{n}", F.when(F.col("m") >= n, -(own - of) / (F.col("m") - (n - 1))))
    columns = []
    for n in (2, 3):
        x = F.col(f"h{n}")
        columns += [F.coalesce(F.round(x, 4), F.lit(0.0)).alias(f"sem_word_{n}gram_cross_entropy"), F.coalesce(F.when(x.isNotNull(), F.round(F.least(F.pow(F.lit(2.0), x), F.lit(10000.0)), 4)), F.lit(0.0)).alias(f"sem_word_{n}gram_perplexity")]
    return b.select(*keep, *columns)


#: Which branches a family needs.
BRANCHES = {
    "sty": [stylometry_scalars, gram_features, position_features],
    "str": [structural_scalars, sentence_counts],
    "prd": [gram_features, position_features, char_features, sentence_counts, sentence_variation],
    "sem": [semantic_scalars, cross_entropies],
}


def assemble(docs: DataFrame, families: tuple[str, ...] = ("sty", "str", "prd", "sem"), text: str = "text") -> DataFrame:
    """doc_id and the families' features in their fixed order, as doubles; 0 where a text is too short for a feature.

    A chain of projections, row by row: no join, no aggregation and, after base(), no exchange. A text is tokenised and cut into
    sentences once for all branches. Null texts count as empty.
    """
    b = share(base(docs, text))
    keep = tuple(b.columns)
    for branch in dict.fromkeys(x for f in families for x in BRANCHES[f]):
        b = branch(b, keep)
        keep = tuple(b.columns)
    if "prd" in families:
        b = b.withColumn("prd_vocab_burstiness", F.lit(0.0))
    return b.select("doc_id", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in FEATURES if c[:3] in families])


def vector(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The features as an ML vector column `features`."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns or [c for c in FEATURES if c in features.columns], outputCol="features").transform(features)
