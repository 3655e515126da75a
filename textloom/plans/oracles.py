"""DuckDB SQL of the registered queries, written apart from the Spark plans."""

from __future__ import annotations

import unicodedata

from ..functions import lexicons as L

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def _tok(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def _sent(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({_strip(x)}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s0: {_strip('s0')}), lambda s1: s1 <> '')"


def _para(x: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({_strip(x)}, '\n\s*\n'), lambda p0: {_strip('p0')}), lambda p1: p1 <> '')"


def _ws(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w0: w0 <> '')"


def _starter(x: str, cut: bool = True) -> str:
    first = f"lower(coalesce(({_ws(x)})[1], ''))"
    return f"regexp_replace({first}, '[.,!?:;]+$', '')" if cut else first


def _alpha(x: str) -> str:
    return f"list_filter({_tok(x)}, lambda a0: regexp_full_match(a0, '[a-z]+'))"


def _marks(words: list[str], x: str = "low") -> str:
    return "(" + " + ".join(f"contains({x}, {_q(w)})::INT" for w in words) + ")"


def _share(words: list[str]) -> str:
    return f"len(list_filter(tok, lambda w1: w1 IN ({', '.join(map(_q, words))})))::DOUBLE / len(tok)"


def _chars(chars: str) -> str:
    return "(" + " + ".join(f"length(text) - length(replace(text, {_q(c)}, ''))" for c in chars) + ")::DOUBLE / length(text)"


_ratio = "coalesce({}::DOUBLE / nullif({}, 0), 0)".format
_dev = "CASE WHEN len({0}) > 1 THEN list_aggregate({0}, 'stddev_samp') ELSE 0 END".format
_mean = "coalesce(list_aggregate({0}, 'avg'), 0)".format


def _final(columns: dict[str, str], guard: str, source: str, digits: int = 6) -> str:
    body = ", ".join(f"round(CASE WHEN {guard} THEN 0 ELSE coalesce(({x})::DOUBLE, 0) END, {digits}) AS {k}" for k, x in columns.items())
    return f"SELECT doc_id, {body} FROM {source}"


_BASE = "b0 AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"

_STY = {
    "word_count": "len(tok)", "avg_word_length": _mean("wl"), "std_word_length": _dev("wl"), "max_word_length": "list_max(wl)", "sentence_count": "len(sent)",
    "avg_sentence_length": _mean("sl"), "std_sentence_length": _dev("sl"), "max_sentence_length": "list_max(sl)", "min_sentence_length": "list_min(sl)",
    "paragraph_count": "len(para)", "avg_paragraph_length": _ratio("len(tok)", "len(para)"),
    "function_word_ratio": _share(L.FUNCTION_WORDS), "first_person_ratio": _share(L.PRONOUNS_FIRST), "second_person_ratio": _share(L.PRONOUNS_SECOND), "third_person_ratio": _share(L.PRONOUNS_THIRD),
    "modal_ratio": _share(L.MODAL_VERBS), "conjunction_ratio": _share(L.CONJUNCTIONS),
    **{f"{k}_ratio": _chars(v) for k, v in {"comma": ",", "period": ".", "question": "?", "exclamation": "!", "semicolon": ";", "colon": ":", "dash": "-—", "quote": "\"'“”"}.items()},
    "discourse_marker_count": _marks(L.DISCOURSE_MARKERS), "discourse_marker_ratio": _ratio(_marks(L.DISCOURSE_MARKERS), "len(sent)"),
    "contraction_ratio": r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+''[\p{L}\p{N}_]+'))::DOUBLE / len(tok)",
}
STY_SCALARS = f"""WITH {_BASE},
b1 AS (SELECT doc_id, text, lower(text) AS low, {_tok("text")} AS tok, {_sent("text")} AS sent, {_para("text")} AS para FROM b0),
b2 AS (SELECT *, list_transform(tok, lambda t1: length(t1)) AS wl, list_transform(sent, lambda s2: len({_tok("s2")})) AS sl FROM b1)
{_final({f"sty_{k}": v for k, v in _STY.items()}, "len(tok) = 0", "b2")}"""

_FAMILY = {k: _marks(v) for k, v in L.TRANSITIONS.items()}
_ALL = " + ".join(f"t_{k}" for k in L.TRANSITIONS)
_STR = {
    "paragraph_count": "len(para)", "avg_paragraph_word_count": _mean("pl"), "std_paragraph_word_count": _dev("pl"), "min_paragraph_word_count": "list_min(pl)", "max_paragraph_word_count": "list_max(pl)",
    "paragraph_length_ratio": _ratio("list_max(pl)", "list_min(pl)"), "avg_sentences_per_paragraph": _mean("ps"), "std_sentences_per_paragraph": _dev("ps"), "heading_count": "heads", "has_headings": "(heads > 0)::INT",
    **{f"transition_{k}_count": f"t_{k}" for k in L.TRANSITIONS}, "total_transitions": _ALL, "transition_density": f"({_ALL})::DOUBLE / len(sl)",
    "starter_diversity": "len(list_distinct(st))::DOUBLE / len(st)",
    "avg_sentence_position_similarity": "CASE WHEN len(sl) > 1 THEN list_aggregate(list_transform(range(2, len(sl) + 1), lambda i1: abs(sl[i1] - sl[i1 - 1])), 'avg') ELSE 0 END",
    "sentence_length_trend": "CASE WHEN len(sl) > 1 THEN (SELECT regr_slope(y, x) FROM (SELECT unnest(sl) AS y, unnest(range(len(sl))) AS x)) ELSE 0 END",
    "structure_score": f"2.0 * (heads > 0)::INT + least(len(para), 10) + least({_ALL}, 20) / 2.0 + 5.0 * len(list_distinct(st))::DOUBLE / len(st)",
}
_HEAD = rf"len(list_filter(list_transform(string_split(text, chr(10)), lambda h0: {_strip('h0')}), lambda h1: regexp_matches(h1, '^#{{1,6}}\s+') OR (upper(h1) = h1 AND lower(h1) <> h1 AND length(h1) < 80 AND len({_ws('h1')}) < 10)))"
STR_SCALARS = f"""WITH {_BASE},
b1 AS (SELECT doc_id, text, lower(text) AS low, {_sent("text")} AS sent, {_para("text")} AS para FROM b0),
b2 AS (SELECT doc_id, sent, para, {_HEAD} AS heads, list_transform(para, lambda p2: len({_ws("p2")})) AS pl, list_transform(para, lambda p3: len({_sent("p3")})) AS ps,
  list_transform(sent, lambda s2: len({_ws("s2")})) AS sl, list_transform(sent, lambda s3: {_starter("s3")}) AS st, {", ".join(f"{v} AS t_{k}" for k, v in _FAMILY.items())} FROM b1)
{_final({f"str_{k}": v for k, v in _STR.items()}, "len(sent) = 0", "b2")}"""


def _repeated(kind: str) -> str:
    return f"coalesce(count(*) FILTER (kind = '{kind}' AND c > 1)::DOUBLE / nullif(count(*) FILTER (kind = '{kind}'), 0), 0)"


SENTENCE_COUNTS = f"""WITH {_BASE},
u AS (SELECT doc_id, 'start' AS kind, unnest(list_transform({_sent("text")}, lambda a1: {_starter("a1")})) AS x FROM b0
  UNION ALL SELECT doc_id, 'raw', unnest(list_transform({_sent("text")}, lambda a2: {_starter("a2", False)})) FROM b0
  UNION ALL SELECT doc_id, 'para', unnest(list_transform({_para("text")}, lambda a3: {_starter("a3")})) FROM b0
  UNION ALL SELECT doc_id, 'whole', unnest(list_transform({_sent("text")}, lambda a4: array_to_string({_ws("lower(a4)")}, ' '))) FROM b0),
c AS (SELECT doc_id, kind, x, count(*) AS c FROM u GROUP BY ALL),
e AS (SELECT doc_id, sum(c) FILTER (kind = 'raw') AS n FROM c GROUP BY doc_id)
SELECT doc_id, round({_repeated("start")}, 6) AS str_repeated_starter_ratio, round({_repeated("para")}, 6) AS str_paragraph_start_repetition,
  round({_repeated("whole")}, 6) AS prd_exact_sentence_repeat_rate, round(greatest(coalesce(-sum(c / n * log2(c / n)) FILTER (kind = 'raw'), 0), 0), 6) AS prd_sentence_start_entropy
FROM c JOIN e USING (doc_id) GROUP BY doc_id"""

GRAMS = f"""WITH {_BASE},
t AS (SELECT doc_id, unnest(tok) AS w, unnest(range(len(tok))) AS pos FROM (SELECT doc_id, {_tok("text")} AS tok FROM b0)),
g AS (SELECT doc_id, pos, w, w || ' ' || lead(w, 1) OVER o AS w2, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS w3 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT doc_id, 1 AS n, w AS gram, count(*) AS c, min(pos) AS first FROM g GROUP BY doc_id, w
  UNION ALL SELECT doc_id, 2, w2, count(*), min(pos) FROM g WHERE w2 IS NOT NULL GROUP BY doc_id, w2
  UNION ALL SELECT doc_id, 3, w3, count(*), min(pos) FROM g WHERE w3 IS NOT NULL GROUP BY doc_id, w3),
s AS (SELECT doc_id, n, gram, c, sum(c) OVER (PARTITION BY doc_id, n) AS total, row_number() OVER (PARTITION BY doc_id, n ORDER BY c DESC, first) - 1 AS r FROM c),
a AS (SELECT doc_id, max(total) FILTER (n = 1) AS words, count(*) FILTER (n = 1) AS types, count(*) FILTER (n = 1 AND c = 1) AS once,
  greatest(coalesce(-sum(c / total * log2(c / total)) FILTER (n = 1), 0), 0) AS h1, greatest(coalesce(-sum(c / total * log2(c / total)) FILTER (n = 2), 0), 0) AS h2, greatest(coalesce(-sum(c / total * log2(c / total)) FILTER (n = 3), 0), 0) AS h3,
  coalesce(count(*) FILTER (n = 2 AND c > 1)::DOUBLE / nullif(count(*) FILTER (n = 2), 0), 0) AS r2, coalesce(count(*) FILTER (n = 3 AND c > 1)::DOUBLE / nullif(count(*) FILTER (n = 3), 0), 0) AS r3,
  sum(c * r) FILTER (n = 1)::DOUBLE / max(total) FILTER (n = 1) AS mean_rank, coalesce(sum(c) FILTER (n = 1 AND r < 10), 0)::DOUBLE AS top10, coalesce(sum(c) FILTER (n = 1 AND r < 50), 0)::DOUBLE AS top50,
  coalesce(sum(CASE WHEN total - c >= 42 THEN 1 - exp(lgamma(total - c + 1) - lgamma(total - c - 41) - lgamma(total + 1) + lgamma(total - 41)) ELSE 1 END) FILTER (n = 1 AND total >= 42), 0) AS hdd FROM s GROUP BY doc_id),
d AS (SELECT s.doc_id, sum(c * pow(r - mean_rank, 2)) AS q FROM s JOIN a USING (doc_id) WHERE n = 1 GROUP BY s.doc_id)
SELECT doc_id, round(types::DOUBLE / words, 6) AS sty_ttr, round(hdd, 6) AS sty_hd_d_score, round(once::DOUBLE / words, 6) AS sty_hapax, round(types::DOUBLE, 6) AS sty_unique_word_count,
  round(h1, 6) AS prd_unigram_entropy, round(h2, 6) AS prd_bigram_entropy, round(h3, 6) AS prd_trigram_entropy, round(r2, 6) AS prd_bigram_repeat_rate, round(r3, 6) AS prd_trigram_repeat_rate,
  round(mean_rank, 6) AS prd_avg_word_rank, round(sqrt(q / greatest(words - 1, 1)), 6) AS prd_std_word_rank, round(top10 / words, 6) AS prd_top10_coverage, round(top50 / words, 6) AS prd_top50_coverage,
  round(types::DOUBLE / words, 6) AS prd_new_word_rate, round(greatest(h2 - h1, 0), 6) AS prd_conditional_entropy FROM a JOIN d USING (doc_id)"""


def _walk(xs: str) -> str:
    state = "{'factors': 0.0::DOUBLE, 'start': 0, 'types': 0, 'at': 0, 'prev': -1}"
    item = f"list_transform({xs}, lambda z0: {{'factors': 0.0::DOUBLE, 'start': 0, 'types': 0, 'at': 0, 'prev': z0.prev}})"
    types = "(CASE WHEN z.prev < acc.start THEN acc.types + 1 ELSE acc.types END)"
    full = f"({types}::DOUBLE / (acc.at + 1 - acc.start) <= 0.72)"
    step = f"{{'factors': CASE WHEN {full} THEN acc.factors + 1 ELSE acc.factors END, 'start': CASE WHEN {full} THEN acc.at + 1 ELSE acc.start END, 'types': CASE WHEN {full} THEN 0 ELSE {types} END, 'at': acc.at + 1, 'prev': -1}}"
    return f"list_reduce(list_prepend({state}, {item}), lambda acc, z: {step})"


def _factor(s: str) -> str:
    total = f"({s}.factors + CASE WHEN {s}.at > {s}.start THEN (1 - {s}.types::DOUBLE / ({s}.at - {s}.start)) / (1 - 0.72) ELSE 0 END)"
    return f"(CASE WHEN {total} > 0 THEN {s}.at / {total} ELSE {s}.at END)"


POSITIONS = f"""WITH {_BASE},
t AS (SELECT doc_id, len(tok) AS n, unnest(tok) AS w, unnest(range(len(tok))) AS pos FROM (SELECT doc_id, {_tok("text")} AS tok FROM b0)),
p AS (SELECT doc_id, n, pos, lag(pos) OVER o AS prev, lead(pos) OVER o AS next FROM t WINDOW o AS (PARTITION BY doc_id, w ORDER BY pos)),
a AS (SELECT doc_id, any_value(n) AS n, avg(pos - prev) AS m, stddev_samp(pos - prev) AS s, count(prev) AS gaps,
  count(*) FILTER (pos // 50 * 50 < n - 50 AND (prev IS NULL OR prev < pos // 50 * 50)) AS fresh,
  list({{'prev': coalesce(prev, -1)::INT}} ORDER BY pos) AS ahead, list({{'prev': coalesce(n - 1 - next, -1)::INT}} ORDER BY pos DESC) AS behind FROM p GROUP BY doc_id),
f AS (SELECT *, {_walk("ahead")} AS x, {_walk("behind")} AS y FROM a)
SELECT doc_id, round(CASE WHEN n >= 10 THEN ({_factor("x")} + {_factor("y")}) / 2 ELSE 0 END, 6) AS sty_mtld_score,
  round(CASE WHEN n >= 10 AND gaps >= 2 THEN coalesce((s - m) / nullif(s + m, 0), 0) ELSE 0 END, 6) AS prd_burstiness,
  round(CASE WHEN n >= 100 THEN fresh / 50.0 / ceil((n - 50) / 50.0) ELSE 0 END, 6) AS prd_vocab_growth_rate FROM f"""

CHARS = f"""WITH {_BASE},
u AS (SELECT doc_id, length(text) AS n, unnest(string_split(lower(text), '')) AS ch FROM b0 WHERE len({_tok("text")}) > 0),
c AS (SELECT doc_id, n, ch, count(*) AS c FROM u GROUP BY ALL)
SELECT doc_id, round(-sum(c::DOUBLE / n * log2(c::DOUBLE / n)), 6) AS prd_char_entropy FROM c GROUP BY doc_id"""

VARIATION = f"""WITH {_BASE}, b1 AS (SELECT doc_id, len({_tok("text")}) AS n, list_transform({_sent("text")}, lambda s2: len({_ws("s2")})) AS sl FROM b0)
SELECT doc_id, round(CASE WHEN n > 0 THEN coalesce({_dev("sl")} / nullif({_mean("sl")}, 0), 0) ELSE 0 END, 6) AS prd_sentence_length_cv FROM b1"""


def _repetition(n: int) -> str:
    grams = f"list_transform(range(1, len(w) - {n - 2}), lambda i2: array_to_string(w[i2:i2 + {n - 1}], ' '))"
    return f"CASE WHEN len(w) >= 6 THEN round(greatest(1 - len(list_distinct({grams}))::DOUBLE / (len(w) - {n - 1}), 0), 4) ELSE 0 END"


SEM_SCALARS = f"""WITH {_BASE},
b1 AS (SELECT doc_id, {_alpha("text")} AS w, list_transform({_sent("text")}, lambda s2: list_distinct({_alpha("s2")})) AS sets FROM b0),
b2 AS (SELECT *, list_transform(range(1, greatest(len(sets), 1)), lambda i1: coalesce(len(list_intersect(sets[i1], sets[i1 + 1]))::DOUBLE / nullif(len(list_distinct(list_concat(sets[i1], sets[i1 + 1]))), 0), 0)) AS sims FROM b1),
b3 AS (SELECT *, coalesce(list_aggregate(sims, 'avg'), 0) AS m, CASE WHEN len(sims) > 1 THEN list_aggregate(sims, 'stddev_pop') ELSE 0 END AS d FROM b2)
SELECT doc_id, round(m, 4)::DOUBLE AS sem_inter_sentence_jaccard_mean, round(d, 4)::DOUBLE AS sem_inter_sentence_jaccard_std, (CASE WHEN len(sets) >= 2 THEN round(m / (d + 0.05), 4) ELSE 0 END)::DOUBLE AS sem_semantic_monotony_index,
  ({_repetition(3)})::DOUBLE AS sem_trigram_repetition_rate, ({_repetition(4)})::DOUBLE AS sem_quadgram_repetition_rate FROM b3"""

CROSS = f"""WITH {_BASE},
w AS MATERIALIZED (SELECT doc_id, {_alpha("text")} AS w FROM b0), v AS MATERIALIZED (SELECT doc_id, greatest(len(list_distinct(w)), 10) AS v FROM w),
t0 AS (SELECT doc_id, unnest(w) AS a, unnest(range(len(w))) AS pos FROM w), t AS (SELECT doc_id, v, a, pos FROM t0 JOIN v USING (doc_id)),
g AS (SELECT doc_id, v, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
u AS (SELECT doc_id, v, 2 AS n, a AS prefix, b AS last FROM g WHERE b IS NOT NULL UNION ALL SELECT doc_id, v, 3, a || ' ' || b, c FROM g WHERE c IS NOT NULL),
k AS (SELECT doc_id, v, n, prefix, last, count(*) AS c FROM u GROUP BY ALL),
p AS (SELECT *, sum(c) OVER (PARTITION BY doc_id, n, prefix) AS total FROM k),
h AS (SELECT doc_id, -sum(c * log2((c + 0.1) / (total + 0.1 * v))) FILTER (n = 2) / sum(c) FILTER (n = 2) AS h2, -sum(c * log2((c + 0.1) / (total + 0.1 * v))) FILTER (n = 3) / sum(c) FILTER (n = 3) AS h3 FROM p GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(round(h{n}::DOUBLE, 4), 0)::DOUBLE AS sem_word_{n}gram_cross_entropy, CASE WHEN h{n} IS NULL THEN 0 ELSE round(least(pow(2, h{n}::DOUBLE), 10000), 4) END::DOUBLE AS sem_word_{n}gram_perplexity" for n in (2, 3))} FROM h"""


ALL = """SELECT d.doc_id, {} FROM documents d LEFT JOIN ({}) USING (doc_id)"""


def features_all(names: list[str]) -> str:
    """All features in their order: the families' queries joined by doc_id."""
    parts = [STY_SCALARS, GRAMS, POSITIONS, STR_SCALARS, SENTENCE_COUNTS, VARIATION, CHARS, SEM_SCALARS, CROSS]
    joins = " ".join(f"LEFT JOIN ({p}) q{k} USING (doc_id)" for k, p in enumerate(parts))
    columns = ", ".join("0.0::DOUBLE AS prd_vocab_burstiness" if c == "prd_vocab_burstiness" else f"coalesce({c}, 0)::DOUBLE AS {c}" for c in names)
    return f"SELECT doc_id, {columns} FROM (SELECT doc_id FROM documents) d {joins}"


TEXT_STATS = f"""SELECT doc_id, len({_ws("text")})::BIGINT AS words, length(text)::BIGINT AS chars, greatest(1, ceil(len({_ws("text")}) / 220.0))::BIGINT AS read_minutes,
  len({_tok("text")})::BIGINT AS tokens, len({_sent("text")})::BIGINT AS sentences, len({_para("text")})::BIGINT AS paragraphs FROM documents"""

_RULE = f"""r0 AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w, regexp_extract_all(text, '[^.!?]+[.!?]+') AS s, text FROM documents),
r1 AS (SELECT doc_id, w, CASE WHEN len(s) > 0 THEN s ELSE [text] END AS s FROM r0),
r2 AS (SELECT doc_id, len(list_distinct(w))::DOUBLE / greatest(len(w), 1) AS ttr, len(list_filter(w, lambda x1: x1 IN ({", ".join(map(_q, L.RULE_KEYWORDS))})))::DOUBLE / greatest(len(w), 1) AS density,
  list_aggregate(list_transform(s, lambda s1: len(regexp_extract_all(s1, '[A-Za-z0-9_]+'))), 'stddev_pop') AS burst FROM r1),
r3 AS (SELECT *, greatest(0.04, least(0.96, 0.5::DOUBLE + CASE WHEN density > 0.02 THEN 0.28::DOUBLE ELSE 0 END + CASE WHEN ttr < 0.65 THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN burst < 4.0 THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN ttr > 0.78 AND burst > 6.0 THEN 0.35::DOUBLE ELSE 0 END)) AS p FROM r2)"""
_RULE_ROWS = """SELECT doc_id, round(p, 3)::DOUBLE AS ai_probability, CASE WHEN p >= 0.5 THEN 'AI_GENERATED' ELSE 'HUMAN_AUTHORED' END AS classification,
  CASE WHEN p > 0.8 OR p < 0.2 THEN 'VERY_HIGH' WHEN p > 0.65 OR p < 0.35 THEN 'HIGH' ELSE 'MODERATE' END AS confidence_band,
  round(density, 6) AS transition_density, round(ttr, 6) AS ttr, round(burst, 6) AS burstiness FROM r3"""
RULE_SCORE = f"WITH {_RULE} {_RULE_ROWS}"

BANDS = f"""WITH {_RULE}, x AS (SELECT doc_id, round(p, 3)::DOUBLE AS p FROM r3)
SELECT doc_id, CASE WHEN p >= 0.5 THEN 'AI_GENERATED' ELSE 'HUMAN_WRITTEN' END AS classification,
  CASE WHEN abs(p - 0.5) > 0.35 THEN 'VERY_HIGH' WHEN abs(p - 0.5) > 0.20 THEN 'HIGH' WHEN abs(p - 0.5) > 0.10 THEN 'MODERATE' ELSE 'LOW_BORDERLINE' END AS api_band,
  CASE WHEN abs(p - 0.5) > 0.35 THEN 'VERY_HIGH_CONFIDENCE' WHEN abs(p - 0.5) > 0.20 THEN 'HIGH_CONFIDENCE' WHEN abs(p - 0.5) > 0.10 THEN 'MODERATE_CONFIDENCE' ELSE 'BORDERLINE_UNCERTAIN' END AS report_band FROM x"""

HEATMAP = f"""WITH h0 AS (SELECT doc_id, unnest(s) AS text, unnest(range(len(s))) AS sentence_index FROM (SELECT doc_id, {_sent("text")} AS s FROM documents)),
h1 AS (SELECT *, {_ws("text")} AS w FROM h0),
h2 AS (SELECT doc_id, sentence_index, text, len(w) AS n, 0.5::DOUBLE + CASE WHEN {" OR ".join(f"starts_with(lower(text), {_q(o)})" for o in L.FORMAL_OPENERS)} THEN 0.25::DOUBLE ELSE 0 END
  + CASE WHEN len(list_filter(w, lambda x1: lower(x1) IN ({", ".join(map(_q, L.BUZZWORDS))}))) > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN len(w) BETWEEN 15 AND 26 THEN 0.1::DOUBLE WHEN len(w) < 6 OR len(w) > 42 THEN -0.15::DOUBLE ELSE 0 END AS p FROM h1),
h3 AS (SELECT *, round(greatest(0.04, least(0.96, p)), 3)::DOUBLE AS q FROM h2)
SELECT doc_id, sentence_index::BIGINT AS sentence_index, text, n::BIGINT AS word_count, q AS ai_probability, CASE WHEN q >= 0.7 THEN 'HIGH' WHEN q >= 0.5 THEN 'MODERATE' ELSE 'LOW' END AS suspicion_level FROM h3"""

_HASH = f"sha256(array_to_string({_ws('lower(text)')}, ' '))"
EXACT_DEDUP = f"SELECT min(doc_id) AS doc_id, h AS dedup_hash FROM (SELECT doc_id, {_HASH} AS h FROM documents) GROUP BY h"
DEDUP_REPORT = f"SELECT count(*)::BIGINT AS initial_count, (count(*) - count(DISTINCT {_HASH}))::BIGINT AS exact_duplicates_removed, count(DISTINCT {_HASH})::BIGINT AS final_count FROM documents"

_SHINGLES = f"""w AS MATERIALIZED (SELECT doc_id, {_ws("lower(text)")} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i1: w[i1] || ' ' || w[i1 + 1] || ' ' || w[i1 + 2])) AS g FROM w)),
k AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)"""
NEAR_PAIRS = f"""WITH {_SHINGLES} SELECT id_a, id_b, round(c::DOUBLE / (x.n + y.n - c), 6) AS jaccard FROM j JOIN k x ON x.doc_id = id_a JOIN k y ON y.doc_id = id_b WHERE c::DOUBLE / (x.n + y.n - c) >= 0.8"""

_TURNS = "SELECT conv_id * 1000 + turn AS id, lag(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_id, text FROM conversations"
LINEAGE = f"""WITH RECURSIVE e AS ({_TURNS}), r AS (SELECT id, id AS root FROM e WHERE parent_id IS NULL UNION ALL SELECT e.id, r.root FROM e JOIN r ON e.parent_id = r.id) SELECT id, root FROM r"""

_GROUPS = f"g AS MATERIALIZED (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY {_HASH}) AS root, text FROM documents)"
_SPLIT = """o AS (SELECT root, row_number() OVER (ORDER BY sha256(root::VARCHAR || ':42'), root) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT root FROM g)),
sp AS (SELECT root, CASE WHEN r < floor(0.7 * n) THEN 'train' WHEN r < floor(0.7 * n) + floor(0.15 * n) THEN 'val' ELSE 'test' END AS split FROM o)"""
GROUPED_SPLIT = f"WITH {_GROUPS}, {_SPLIT} SELECT id, root, split FROM g JOIN sp USING (root)"

_ROWS = f"""p AS (SELECT doc_id AS id, text, {_HASH} AS h, CASE substr(sha256(doc_id::VARCHAR), 1, 1) WHEN '0' THEN 'val' WHEN '1' THEN 'val' WHEN '2' THEN 'test' WHEN '3' THEN 'test' ELSE 'train' END AS split FROM documents),
q AS (SELECT id, split, h, lag(id) OVER (PARTITION BY h ORDER BY id) AS parent_id FROM p)"""
LEAKAGE = f"""WITH {_ROWS}, d AS (SELECT DISTINCT split, h FROM q), n AS (SELECT split, h, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS k FROM d)
SELECT 'EXACT_TEXT_OVERLAP' AS kind, 'HIGH' AS severity, a.split AS split_a, b.split AS split_b, count(*)::BIGINT AS n FROM n a JOIN n b ON a.h = b.h AND a.k < b.k GROUP BY ALL
UNION ALL SELECT 'LINEAGE_ACROSS_SPLITS', 'CRITICAL', c.split, p.split, count(*)::BIGINT FROM q c JOIN q p ON c.parent_id = p.id WHERE c.split <> p.split GROUP BY ALL"""


def _draw(op: str, place: str) -> str:
    return f"(('0x' || substr(md5(doc_id::VARCHAR || ':{op}:' || ({place})::VARCHAR || ':42'), 1, 7))::BIGINT::DOUBLE / {1 << 28})"


def _list(xs) -> str:
    return "[" + ", ".join(map(_q, xs)) + "]"


def _case(pairs, x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in pairs) + " END"


def _pick(options: str, u: str) -> str:
    return f"({options})[1 + floor({u} * len({options}))::INT]"


_BACK: dict[str, list[str]] = {}
for _odd, _plain in L.HOMOGLYPHS.items():
    _BACK.setdefault(_plain, []).append(_odd)
_LETTERS = r"regexp_matches(c, '^[\p{L}\p{N}]$')"


def _zero_width(rate: float, text: str = "text") -> str:
    return f"array_to_string(list_transform(string_split({text}, ''), lambda c, i: CASE WHEN {_LETTERS} AND {_draw('zw', 'i - 1')} < {rate!r}::DOUBLE THEN c || {_pick(_list(L.ZERO_WIDTH), _draw('zw_pick', 'i - 1'))} ELSE c END), '')"


def _homoglyph(rate: float, text: str = "text") -> str:
    return f"array_to_string(list_transform(string_split({text}, ''), lambda c, i: CASE WHEN c <> '' AND contains({_q(''.join(_BACK))}, c) AND {_draw('homo', 'i - 1')} < {rate!r}::DOUBLE THEN {_pick('(' + _case([(k, _list(v)) for k, v in _BACK.items()], 'c') + ')', _draw('homo_pick', 'i - 1'))} ELSE c END), '')"


_BARE = r"lower(regexp_replace(w, '[^\p{L}\p{N}_]', '', 'g'))"
_NEW = _pick("(" + _case([(k, _list(v)) for k, v in L.SYNONYMS.items()], _BARE) + ")", _draw("syn_pick", "i - 1"))
_TITLE = r"regexp_matches(w, '^[^\p{L}]*\p{Lu}[^\p{Lu}]*$')"
_CASED = f"(CASE WHEN {_TITLE} THEN upper(substr({_NEW}, 1, 1)) || lower(substr({_NEW}, 2)) ELSE {_NEW} END)"
_TAIL = r"regexp_extract(w, '[^\p{L}\p{N}]$')"


def _synonym(rate: float, text: str = "text") -> str:
    return f"array_to_string(list_transform({_ws(text)}, lambda w, i: CASE WHEN {_BARE} IN ({', '.join(map(_q, L.SYNONYMS))}) AND {_draw('syn', 'i - 1')} < {rate!r}::DOUBLE THEN {_CASED} || {_TAIL} ELSE w END), ' ')"


def _jittered(source: str) -> str:
    """(doc_id, t) of a table (doc_id, t): sentences cut and filled."""
    half = lambda mark, opener: f"[substr(x, 1, instr(x, {_q(mark)}) - 1) || '.', {_q(opener)} || substr(x, instr(x, {_q(mark)}) + {len(mark)})]"
    cut = f"flatten(list_transform({_sent('t')}, lambda x, i: CASE WHEN contains(x, ', and ') AND {_draw('and', 'i - 1')} < 0.3 THEN {half(', and ', 'And ')} WHEN contains(x, ', but ') AND {_draw('but', 'i - 1')} < 0.3 THEN {half(', but ', 'However, ')} ELSE [x] END))"
    fill = f"list_transform(p, lambda y, i: CASE WHEN i - 1 = floor({_draw('filler_at', '0')} * len(p))::INT THEN {_pick(_list(L.FILLERS), _draw('filler_pick', '0'))} || ' ' || y ELSE y END)"
    return f"SELECT doc_id, CASE WHEN len(p) = 0 THEN t WHEN {_draw('filler', '0')} < 0.4 THEN array_to_string({fill}, ' ') ELSE array_to_string(p, ' ') END AS t FROM (SELECT doc_id, t, {cut} AS p FROM ({source}))"


_ZW, _HOMO = _zero_width(0.06), _homoglyph(0.09)
_digest = "SELECT doc_id, length(t)::BIGINT AS perturbed_length, md5(t) AS digest FROM ({})".format
ZERO_WIDTH = _digest(f"SELECT doc_id, {_ZW} AS t FROM documents")
HOMOGLYPH = _digest(f"SELECT doc_id, {_HOMO} AS t FROM documents")
SYNONYM = _digest(f"SELECT doc_id, {_synonym(0.175)} AS t FROM documents")
_HUMANIZER = _jittered(f"SELECT doc_id, {_synonym(0.18)} AS t FROM documents")
_COMBINED = _jittered(f"SELECT doc_id, {_synonym(0.075, 'h')} AS t FROM (SELECT doc_id, {_homoglyph(0.015)} AS h FROM documents)")
ATTACKS = "WITH x AS (" + " UNION ALL ".join(f"SELECT doc_id, {_q(k)} AS attack_type, t FROM ({v})" for k, v in (("zero_width", f"SELECT doc_id, {_ZW} AS t FROM documents"), ("homoglyph", f"SELECT doc_id, {_HOMO} AS t FROM documents"), ("synonym", f"SELECT doc_id, {_synonym(0.175)} AS t FROM documents"), ("humanizer", _HUMANIZER), ("combined", _COMBINED))) + """)
SELECT doc_id, attack_type, 0.5::DOUBLE AS severity, length(text)::INT AS original_length, length(t)::INT AS perturbed_length, md5(t) AS digest FROM x JOIN documents USING (doc_id)"""

_TAMPERED = f"t0 AS MATERIALIZED (SELECT doc_id, {_ZW} AS text FROM documents), t1 AS MATERIALIZED (SELECT doc_id, {_HOMO} AS text FROM t0)"
_COUNT = lambda chars: "(length(text) - length(translate(text, " + _q(chars) + ", '')))"
AUDIT = f"""WITH {_TAMPERED}, a AS (SELECT doc_id, {_COUNT("".join(L.ZERO_WIDTH))} AS z, {_COUNT("".join(L.HOMOGLYPHS))} AS h, regexp_matches(text, '[\x01-\x7F]') AS plain FROM t1)
SELECT doc_id, (z > 0 OR h > 0) AS adversarial_markers_present, z::BIGINT AS zero_width_count, h::BIGINT AS homoglyph_count, least(20, z)::BIGINT AS zero_width_listed, least(20, h)::BIGINT AS homoglyph_listed,
  (h > 0 AND plain) AS mixed_script_anomaly, round(least(1.0, 0.2 * z + 0.1 * h), 6)::DOUBLE AS adversarial_risk_score FROM a"""
CLEAN = f"""WITH {_TAMPERED}, c AS (SELECT doc_id, translate(translate(text, {_q("".join(L.ZERO_WIDTH))}, ''), {_q("".join(L.HOMOGLYPHS))}, {_q("".join(L.HOMOGLYPHS.values()))}) AS t FROM t1)
SELECT doc_id, md5({_strip("regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g')")}) AS digest FROM c"""

DISTRIBUTIONS = """SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'source' END AS dimension, coalesce(lang, source) AS value, count(*)::BIGINT AS n FROM documents GROUP BY GROUPING SETS ((lang), (source))"""
CANONICAL = f"""SELECT doc_id::VARCHAR AS sample_id, 'HUMAN' AS origin, lang AS language, source AS source_dataset, len({_ws("text")})::BIGINT AS word_count, length(text)::BIGINT AS char_count, 0::BIGINT AS sentence_count, sha256(text) AS content_hash FROM documents"""
ANSWERS = """WITH r AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS k, list(text ORDER BY turn) FILTER (role = 'user') AS u, list(text ORDER BY turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id),
x AS (SELECT k, 'human' AS tag, 'HUMAN' AS origin, unnest(u) AS text, unnest(range(len(u))) AS i FROM r UNION ALL SELECT k, 'ai', 'AI_RAW', unnest(a), unnest(range(len(a))) FROM r)
SELECT 'hc3_' || tag || '_' || k || '_' || i AS sample_id, origin, sha256(text) AS content_hash FROM x WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''""".replace("\\\\", "\\")
ORIGINS = """WITH x AS (SELECT doc_id, CASE quality * 2 + toxic WHEN 0 THEN ' AI ' WHEN 1 THEN 'Machine' WHEN 2 THEN 'human' ELSE 'other' END AS label FROM labels)
SELECT doc_id, label, CASE lower(trim(label)) WHEN 'ai' THEN 'AI_RAW' WHEN 'machine' THEN 'AI_RAW' ELSE 'HUMAN' END AS origin, CASE WHEN lower(trim(label)) IN ('ai', 'machine') THEN 1 ELSE 0 END::BIGINT AS y FROM x"""

_SCORES = "sc AS MATERIALIZED (SELECT l.quality AS label, (n_chars % 101)::DOUBLE / 100 AS score FROM documents d JOIN labels l USING (doc_id))"
_SAFE = "coalesce({} / nullif({}, 0), 0)::DOUBLE".format
METRICS = f"""WITH {_SCORES},
c AS (SELECT count(*) FILTER (label <> 1 AND score < 0.5)::DOUBLE AS tn, count(*) FILTER (label <> 1 AND score >= 0.5)::DOUBLE AS fp, count(*) FILTER (label = 1 AND score < 0.5)::DOUBLE AS fn, count(*) FILTER (label = 1 AND score >= 0.5)::DOUBLE AS tp, count(*) AS n, avg(pow(score - label, 2)) AS brier FROM sc),
u AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM sc GROUP BY score),
v AS (SELECT *, sum(pos) OVER (ORDER BY score DESC)::DOUBLE AS t, sum(neg) OVER (ORDER BY score DESC)::DOUBLE AS f, sum(pos) OVER ()::DOUBLE AS np, sum(neg) OVER ()::DOUBLE AS nn FROM u),
r AS (SELECT sum(neg * (t - pos) + 0.5 * neg * pos) / (max(np) * max(nn)) AS auc, sum(pos * t / (t + f)) / max(np) AS ap, min(f / nn) FILTER (t >= 0.95 * np - 1e-12) AS f95, min(f / nn) FILTER (t >= 0.99 * np - 1e-12) AS f99 FROM v),
e AS (SELECT sum(abs(a - p) * k / (SELECT count(*) FROM sc)) AS ece FROM (SELECT b, count(*) AS k, avg(label) AS a, avg(score) AS p FROM (SELECT *, CASE {" ".join(f"WHEN score > {k * 0.1!r}::DOUBLE AND score <= {(k + 1) * 0.1!r}::DOUBLE THEN {k}" for k in range(10))} END AS b FROM sc) WHERE b IS NOT NULL GROUP BY b))
SELECT round({_SAFE("(tp + tn)", "n")}, 4) AS accuracy, round({_SAFE("tp", "(tp + fp)")}, 4) AS precision, round({_SAFE("tp", "(tp + fn)")}, 4) AS recall, round({_SAFE("2 * tp", "(2 * tp + fp + fn)")}, 4) AS f1_binary,
  round(({_SAFE("2 * tp", "(2 * tp + fp + fn)")} + {_SAFE("2 * tn", "(2 * tn + fp + fn)")}) / 2, 4) AS f1_macro, round(brier, 4) AS brier, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp, n::BIGINT AS n_samples,
  round(auc, 4) AS roc_auc, round(ap, 4) AS pr_auc, round(f95, 4) AS fpr_at_95_tpr, round(f99, 4) AS fpr_at_99_tpr, round(ece, 4) AS ece FROM c, r, e"""
CURVE = f"""WITH {_SCORES}, u AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM sc GROUP BY score)
SELECT score, pos::BIGINT AS pos, neg::BIGINT AS neg, sum(pos) OVER (ORDER BY score DESC)::BIGINT AS tp, sum(neg) OVER (ORDER BY score DESC)::BIGINT AS fp, sum(pos) OVER ()::BIGINT AS all_pos, sum(neg) OVER ()::BIGINT AS all_neg FROM u"""
CALIBRATION = f"""WITH {_SCORES}, b AS (SELECT *, CASE {" ".join(f"WHEN score > {k * 0.1!r}::DOUBLE AND score <= {(k + 1) * 0.1!r}::DOUBLE THEN {k}" for k in range(10))} END AS bin FROM sc)
SELECT bin::BIGINT AS bin, count(*)::BIGINT AS n, round(avg(label), 6)::DOUBLE AS accuracy, round(avg(score), 6) AS confidence, round(abs(avg(label) - avg(score)) * count(*) / (SELECT count(*) FROM sc), 6) AS gap FROM b WHERE bin IS NOT NULL GROUP BY bin"""
SIGNALS = f"""WITH t AS (SELECT doc_id, {_tok("text")} AS tok FROM documents), x AS (SELECT doc_id, len(list_distinct(tok))::DOUBLE / len(tok) AS ttr, coalesce(sem_semantic_monotony_index, 0) AS m FROM t JOIN ({SEM_SCALARS}) s USING (doc_id) WHERE len(tok) > 0)
SELECT doc_id, 'sty_ttr' AS feature, 'low' AS ai_indicative, round(ttr, 4) AS value, 1.0::DOUBLE AS weight_impact FROM x UNION ALL SELECT doc_id, 'sem_semantic_monotony_index', 'high', round(m, 4), 1.0::DOUBLE FROM x"""
WINDOWS = """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL"""

NEAR_DEDUP = f"""WITH RECURSIVE {_SHINGLES}, p AS MATERIALIZED (SELECT id_a, id_b FROM j JOIN k x ON x.doc_id = id_a JOIN k y ON y.doc_id = id_b WHERE c::DOUBLE / (x.n + y.n - c) >= 0.8),
o AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS nth, coalesce(list(id_a) FILTER (id_a IS NOT NULL), []) AS earlier FROM (SELECT id_a AS id FROM p UNION SELECT id_b FROM p) q LEFT JOIN p ON id_b = id GROUP BY id),
g AS (SELECT 0::BIGINT AS nth, []::BIGINT[] AS kept UNION ALL SELECT o.nth, CASE WHEN list_has_any(kept, earlier) THEN kept ELSE list_append(kept, id) END FROM g JOIN o ON o.nth = g.nth + 1),
f AS (SELECT arg_max(kept, nth) AS kept FROM g)
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM o, f WHERE NOT list_contains(kept, id))"""

_TREE = """l AS (SELECT substr(sha256(sample_id), 1, 4) AS r, sha256(string_agg(content_hash, '' ORDER BY sample_id)) AS h FROM s GROUP BY ALL),
m AS (SELECT substr(r, 1, 2) AS q, sha256(string_agg(h, '' ORDER BY r)) AS h FROM l GROUP BY ALL)"""
MANIFEST = f"""WITH s AS (SELECT doc_id::VARCHAR AS sample_id, sha256(text) AS content_hash, source FROM documents), {_TREE}
SELECT 'documents' AS name, '1.0' AS version, 'Processed documents dataset' AS description, (SELECT count(*) FROM s)::BIGINT AS total_samples, '{{"HUMAN":' || (SELECT count(*) FROM s) || '}}' AS origin_distribution,
  '{{"OTHER":' || (SELECT count(*) FROM s) || '}}' AS domain_distribution, '{{}}' AS generator_distribution, '{{}}' AS humanizer_distribution, '{{}}' AS split_sizes, (SELECT sha256(string_agg(h, '' ORDER BY q)) FROM m) AS content_hash,
  (SELECT string_agg(DISTINCT source, ',' ORDER BY source) FROM s) AS source_datasets, '' AS notes"""
PLAIN_HASH = "SELECT sha256(string_agg(sha256(text), '' ORDER BY doc_id::VARCHAR)) AS content_hash FROM documents"


def explanations(names: list[str]) -> str:
    real = ("prd_burstiness", "prd_unigram_entropy", "str_transition_density", "sty_ttr", "sem_semantic_monotony_index", "sty_std_sentence_length")
    signals = " UNION ALL ".join(f"SELECT doc_id, 'signal' AS kind, '{c}' AS name, '{'high' if c in ('str_transition_density', 'sem_semantic_monotony_index') else 'low'}' AS of, round({c} + sign({c}) * 1e-9, 4)::DOUBLE AS value FROM f" for c in real)  # halves go up, as six-digit values have them
    tests = (
        ("zero_width_count > 0", "a", "Invisible Zero-Width Character Injection Detected", "SECURITY CRITICAL"), ("homoglyph_count > 0", "a", "Homoglyph / Confusable Characters Detected", "SECURITY WARNING"),
        ("sty_std_sentence_length < 3.5", "f", "Low Sentence Rhythm Variation", "STYLE MODERATE"), ("str_transition_density > 0.06", "f", "High Discourse Transition Density", "DISCOURSE MODERATE"), ("prd_burstiness < 0.2", "f", "Low Token Burstiness", "PREDICTABILITY HIGH"),
    )
    findings = " UNION ALL ".join(f"SELECT doc_id, 'finding', '{title}', '{of}', 0::DOUBLE FROM {t} WHERE {test}" for test, t, title, of in tests)
    return f"""WITH f AS MATERIALIZED ({features_all(names)}), a AS MATERIALIZED ({AUDIT}), b AS MATERIALIZED ({BANDS}), r AS MATERIALIZED ({RULE_SCORE}), x AS ({signals} UNION ALL {findings})
SELECT doc_id, r.ai_probability, b.classification, b.report_band AS confidence_band, kind, name, of, value FROM x JOIN r USING (doc_id) JOIN b USING (doc_id)"""


def _sampled(origin: str, seed: int, generator: str) -> str:
    u = lambda x: f"md5('{seed}:{origin}:' || domain || ':' || k || ':' || {x})"
    order = f"list_sort(list_transform(bank, lambda s, i: {{'u': {u('(i - 1)')}, 's': s}}))"
    return f"""SELECT '{origin.lower()}_' || lower(domain) || '_' || k AS sample_id, '{origin}' AS origin, domain, {generator} AS generator,
  array_to_string(list_transform(({order})[1:3 + ('0x' || substr({u("'n'")}, 1, 1))::BIGINT % 2], lambda y: y.s), ' ') AS text FROM bk, (SELECT unnest(range(10)) AS k)"""


_TURN = "(('0x' || substr(md5(doc_id || ':turn:42'), 1, 1))::BIGINT % 4)"
GENERATED = f"""WITH u AS (SELECT source AS domain, unnest({_sent("text")}) AS s FROM documents), v AS (SELECT domain, s, md5(s) AS h FROM u),
w AS (SELECT domain, ('0x' || substr(h, 1, 6))::BIGINT % 40 AS slot, min({{'h': h, 's': s}}).s AS s FROM v GROUP BY ALL), bk AS MATERIALIZED (SELECT domain, list(s ORDER BY slot) AS bank FROM w GROUP BY domain),
ai AS MATERIALIZED ({_sampled("AI_RAW", 42, "'generated'")}), hu AS ({_sampled("HUMAN", 7, "NULL::VARCHAR")}), d AS MATERIALIZED (SELECT sample_id AS doc_id, domain, generator, text, {_TURN.replace("doc_id", "sample_id")} AS turn FROM ai),
z AS (SELECT doc_id, {_synonym(0.18)} AS t FROM d WHERE turn = 0 UNION ALL SELECT doc_id, {_synonym(0.30)} FROM d WHERE turn = 1 UNION ALL SELECT doc_id, text FROM d WHERE turn = 3),
y AS (SELECT doc_id, {_synonym(0.3)} AS t FROM d WHERE turn = 2 UNION ALL {_jittered("SELECT doc_id, t FROM z")}),
al AS (SELECT sample_id, origin, domain, generator, NULL::VARCHAR AS humanizer, 'NONE' AS transformation_severity, NULL::VARCHAR AS parent_id, text FROM (SELECT * FROM ai UNION ALL SELECT * FROM hu)
  UNION ALL SELECT 'humanized_' || doc_id, 'AI_HUMANIZED', domain, generator, (['humanizer_medium', 'humanizer_high', 'synonym', 'jitter'])[turn + 1], (['MEDIUM', 'HEAVY', 'LIGHT', 'LIGHT'])[turn + 1], doc_id, t FROM d JOIN y USING (doc_id))
SELECT sample_id, origin, domain, generator, humanizer, transformation_severity, parent_id, len({_ws("text")})::BIGINT AS word_count, sha256(text) AS content_hash FROM al"""

JSONL = "SELECT doc_id, source, md5(text) AS digest FROM documents"
LABELLED = """WITH x AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS k, text, source, quality * 2 + toxic AS code FROM documents JOIN labels USING (doc_id))
SELECT 'generic_' || k AS sample_id, CASE WHEN code IN (0, 1) THEN 'AI_RAW' ELSE 'HUMAN' END AS origin, source AS generator, k::VARCHAR AS source_id, sha256(text) AS content_hash FROM x"""
WHOLE = "SELECT item_id, md5(text) AS digest FROM benchmark"
EXPORTED = "SELECT to_json({'doc_id': doc_id, 'lang': lang, 'source': source, 'n_chars': n_chars})::VARCHAR AS json FROM documents"
_UNIQUE = f"""e AS MATERIALIZED (SELECT min(doc_id::VARCHAR) AS sample_id FROM documents GROUP BY {_HASH}),
o AS (SELECT sample_id, row_number() OVER (ORDER BY sha256(sample_id || ':42'), sample_id) - 1 AS r, count(*) OVER () AS n FROM e),
sp AS MATERIALIZED (SELECT sample_id, CASE WHEN r < floor(0.7 * n) THEN 'train' WHEN r < floor(0.7 * n) + floor(0.15 * n) THEN 'val' ELSE 'test' END AS split FROM o)"""
BENCHMARK = f"WITH {_UNIQUE} SELECT sample_id, split, upper(source) AS domain, sha256(text) AS content_hash FROM sp JOIN documents ON sample_id = doc_id::VARCHAR"
BENCHMARK_MANIFEST = f"""WITH {_UNIQUE}, b AS (SELECT split, upper(source) AS domain FROM sp JOIN documents ON sample_id = doc_id::VARCHAR), d AS (SELECT domain, count(*) AS n FROM b GROUP BY domain)
SELECT 'documents' AS dataset_name, count(*)::BIGINT AS total_samples, count(*) FILTER (split = 'train')::BIGINT AS train_samples, count(*) FILTER (split = 'val')::BIGINT AS val_samples, count(*) FILTER (split = 'test')::BIGINT AS test_samples,
  (SELECT count(*) FROM documents)::BIGINT AS initial_count, ((SELECT count(*) FROM documents) - count(*))::BIGINT AS exact_duplicates_removed, count(*)::BIGINT AS final_count,
  '{{' || (SELECT string_agg('"' || domain || '":' || n, ',' ORDER BY domain) FROM d) || '}}' AS domains FROM b"""
REJECTS = "SELECT doc_id, CASE WHEN length(text) < 300 THEN 'too_short' ELSE 'too_long' END AS reason, length(text)::BIGINT AS char_count FROM documents WHERE length(text) < 300 OR length(text) > 5000"
BATCHES = "SELECT (doc_id % 23)::BIGINT AS batch, count(*)::BIGINT AS n, CASE WHEN count(*) > 42 THEN 'too_many' END AS reason FROM documents GROUP BY ALL"
_tidied = lambda t: _strip(f"regexp_replace(regexp_replace({t}, '[ \t]+', ' ', 'g'), chr(10) || '{{3,}}', chr(10) || chr(10), 'g')")
_VISIBLE = f"translate(text, {_q(''.join(L.ZERO_WIDTH))}, '')"
_unalike = lambda t: f"translate({t}, {_q(''.join(L.HOMOGLYPHS))}, {_q(''.join(L.HOMOGLYPHS.values()))})"
CHOSEN = f"""WITH {_TAMPERED} SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN {_tidied(_unalike(_VISIBLE))} ELSE text END) AS digest, ({_COUNT("".join(L.ZERO_WIDTH) + "".join(L.HOMOGLYPHS))} > 0) AS tampered,
  len(regexp_extract_all(text, '[^\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+'))::BIGINT AS word_count, length(text)::BIGINT AS char_count FROM t1""".replace("\\\\", "\\")
TOGGLES = f"WITH {_TAMPERED} SELECT doc_id, md5({_tidied(_VISIBLE)}) AS invisible, md5({_tidied(_unalike('text'))}) AS alike, md5({_tidied(_unalike(_VISIBLE))}) AS both FROM t1"


def _details(table: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"({_q(c)}, {_q(r)}, {_q(n)})" for c, r, n in table)
    return f"SELECT doc_id, position, x.char, replacement, name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS nth FROM p JOIN (VALUES {values}) x(char, replacement, name) ON p.char = x.char) x WHERE nth <= 20"


DETAILS = f"""WITH {_TAMPERED}, p AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, '')) AS char, unnest(range(length(text)))::BIGINT AS position FROM t1)
{_details([(c, r, unicodedata.name(c, "UNKNOWN")) for c, r in L.HOMOGLYPHS.items()])} UNION ALL {_details([(c, "", n) for c, n in L.ZERO_WIDTH.items()])}"""
VERDICTS = f"""WITH {_RULE}, x AS (SELECT time_bucket(INTERVAL 5 MINUTE, make_timestamp((doc_id % 3600) * 1000000)) AS window_start, CASE WHEN p >= 0.5 THEN 'AI_GENERATED' ELSE 'HUMAN_AUTHORED' END AS classification, round(p, 3)::DOUBLE AS p FROM r3)
SELECT window_start, classification, count(*)::BIGINT AS n, round(avg(p), 6) AS mean_probability FROM x GROUP BY ALL"""
