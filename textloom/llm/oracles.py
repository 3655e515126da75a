"""DuckDB SQL of those queries that SQL can express, written from their contracts."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_PLAIN = r"regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\[-`{-~]', ' ', 'g'), '[^\x20\x09-\x0D]+')"


def _grams(words: str, n: int, key: str, table: str) -> str:
    """Distinct (key, g): sets of word n-grams."""
    gram = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(n))
    return f"SELECT DISTINCT {key}, g FROM (SELECT {key}, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: {gram})) AS g FROM (SELECT {key}, {words} AS w FROM {table}))"


OP3 = f"""WITH d AS MATERIALIZED ({_grams(_PLAIN, 5, "doc_id", "documents")}), b AS MATERIALIZED ({_grams(_PLAIN, 5, "item_id", "benchmark")}),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id), s AS (SELECT doc_id, item_id, count(*) AS c FROM d JOIN b USING (g) GROUP BY ALL)
SELECT doc_id, item_id, c::BIGINT AS n_shared, n::BIGINT AS n_item, c::DOUBLE / n AS containment FROM s JOIN n USING (item_id) WHERE c >= 0.8 * n - 1e-9"""

OP5 = rf"""WITH d AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'i': i, 'g': [w[i], w[i + 1], w[i + 2]]}})) AS x FROM d),
q AS (SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.g) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM q WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM f GROUP BY source),
a AS (SELECT avg(k::DOUBLE / n) AS m, coalesce(var_samp(k::DOUBLE / n), 0) AS v, avg(1.0::DOUBLE / n) AS per FROM h),
s AS (SELECT m, greatest(least(m * (1 - m) / greatest(v - m * (1 - m) * per, 1e-6) - 1, 1e6), 1) AS strength FROM a),
o AS (SELECT source, (k + m * strength) / (n + strength) AS rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate, (NOT base_failed AND rate <= 0.5) AS kept FROM f JOIN o ON f.source IS NOT DISTINCT FROM o.source"""

OP7 = rf"""WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h FROM d),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS low FROM x) WHERE low < doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS j FROM f), a AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id),
k AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN a USING (doc_id)),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
t AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.j) AS kept FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.j = g.j WHERE g.j IS NULL GROUP BY u.doc_id)
SELECT k.doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN t ON k.doc_id = t.doc_id"""

OP8 = rf"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, text, {_WORDS} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c) UNION SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON x.text = y.text AND x.doc_id <> y.doc_id),
r AS (SELECT doc_id AS a, doc_id AS root FROM w UNION SELECT l.b, r.root FROM r JOIN l USING (a)),
c AS (SELECT a AS doc_id, min(root) AS class_id FROM r GROUP BY a), k AS (SELECT a AS doc_id, count(*) AS n FROM l GROUP BY a)
SELECT w.doc_id, class_id, min(w.doc_id) OVER (PARTITION BY text) AS same_text_id, (count(*) OVER (PARTITION BY text))::BIGINT AS n_copies, coalesce(k.n, 0)::BIGINT AS n_links FROM w JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""

OP10 = rf"""WITH d AS MATERIALIZED (SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
  -ln((('0x' || substr(md5(doc_id::VARCHAR || ':42'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
  / greatest(coalesce(greatest(0.1::DOUBLE, 1 - 4 * len(regexp_extract_all(text, '[#*$%&|<>]'))::DOUBLE / greatest(length(text), 1)), 1), 1e-6) AS key FROM documents),
t AS (SELECT source, sum(size)::DOUBLE AS total, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM d GROUP BY source),
r AS (SELECT *, 2 * total / weight AS ratio, row_number() OVER (ORDER BY 2 * total / weight, source NULLS LAST) AS nth FROM t),
v AS (SELECT *, (1.5 * sum(total) OVER () - coalesce(sum(2 * total) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM r WINDOW o AS (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, total, least(2 * total, weight * (SELECT arg_min(level, nth) FROM v WHERE level <= ratio)) AS target FROM v),
e AS (SELECT source, total, target, CASE WHEN total > 0 THEN floor(floor(target + 0.5) / total) ELSE 0 END AS epochs FROM g),
x AS (SELECT d.*, total, target, epochs, greatest(floor(target + 0.5) - epochs * total, 0) AS rest, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, total::BIGINT AS source_size, target, (epochs * size + least(size, greatest(rest - before, 0)))::BIGINT AS taken FROM x"""

ORACLES = {"op3_benchmark_decontamination": OP3, "op5_quality_rules": OP5, "op7_substring_dedup": OP7, "op8_ngram_jaccard_join": OP8, "op10_source_mixing": OP10}
