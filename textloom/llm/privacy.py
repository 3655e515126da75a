"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that reveal them.

Only DataFrame functions are used. Matches of the patterns are protected entities, each of a class (its pattern). Terms within REACH code
points of an entity are its context. Counts are of distinct texts, so copies are no evidence: of N texts, n(k) hold an entity
of class k, n(c) hold entity c, n(t) hold term t anywhere, n(k, t) and n(c, t) hold t in a context of class k or of entity c.
What someone who reads t can tell about c is estimated in two steps, each shrunk to what is known without t by STRENGTH texts:

    P(k | t) = (n(k, t) + STRENGTH n(k) / N) / (n(t) + STRENGTH)
    P(c | k, t) = (n(c, t) + STRENGTH n(c) / (n(k) + 1)) / (n(k, t) + STRENGTH)

so that an entity or a term that is seen once reveals little, and each further text tells more. With P their product, c's information is
log2(N / n(c)), of which t discloses log2(P N / n(c)). A term is revealing where it discloses a share of DISCLOSURE at least and leaves
RESIDUAL bits at most: (2 / 3) ** 2, two of two texts, leaves 1.17. From a share of REMOVAL on it is removed, else generalised to the entity's
class. All its occurrences in all texts become spans of kind `term`; where it reveals several entities, the strictest action holds.

Only terms that would be revealing if they stood in no other text are looked for in all texts, which rules out most and loses none, as
P falls with n(t). Counts are partial aggregates; terms are joined to the words of texts, broadcast where they are few, else over salted
keys, never to an entity's whole rows. Texts are joined to the terms that they hold, which are broadcast where they are few, so that texts
needn't be shuffled. Null texts are empty. Repeated rows get their result each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, row_key
from .spans import SPAN, count_of, masked, none, shown, spans

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Fixed patterns. Possessive loops and run starts keep them linear on long runs; matches are those of the plain forms.
EMAIL = f"(?:(?<!{_LOCAL})|\\G){_LOCAL}++@{_LABEL}++(?:\\.{_LABEL}++)++"
IP = "(?:(?<![0-9])|\\G)[0-9]++(?:\\.[0-9]++){3}"
CARD = "[0-9](?:[\\x20-]?[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
TERM = "\\p{L}[\\p{L}\\p{N}_']{2,}"
REACH, DISCLOSURE, REMOVAL = 80, 0.8, 0.95
#: Texts that a prior weighs, and the bits that a revealing term leaves unknown at most.
STRENGTH, RESIDUAL = 1.0, 1.2
#: Most bytes of revealing terms that are broadcast, and the parts a term's rows are dealt to beyond that.
TERM_BYTES, SALTS = 1 << 20, 32
#: Most bytes that rows' revealing terms are broadcast with, as a multiple of term_bytes, and what a row and a term of it take beside their strings.
HELD_TIMES, HELD_ROW, HELD_TERM = 4, 64, 32


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & (F.substring(bare, 1, 3).cast("int") <= 255)


def base_spans(text: Column) -> Column:
    """Spans of the patterns, unsorted."""
    digit = F.regexp_like(text, F.lit("[0-9]{2}|[0-9][\\x20.-][0-9]"))
    card = lambda hit, _: F.length(_digits(hit)).between(12, 19) & F.call_function("luhn_check", _digits(hit))
    return F.concat(
        spans(text, EMAIL, 0, gate=text.contains("@")),
        spans(text, IP, 1, lambda hit, _: F.forall(F.split(hit, "\\."), _small), gate=digit),
        spans(text, CARD, 2, card, gate=digit),
        spans(text, PHONE, 3, lambda hit, _: F.length(_digits(hit)).between(9, 15), gate=text.contains("+")),
    )


def _entity(s: Column) -> Column:
    return F.concat(s["kind"].cast("string"), F.lit(":"), F.when(s["kind"] == 0, F.lower(s["value"])).when(s["kind"] == 1, s["value"]).otherwise(_digits(s["value"])))


def _context(text: Column, found: Column, reach: int) -> Column:
    """For each span: the entity, and the text on both sides with where it starts; words cut at the rim are dropped."""

    def one(s):
        low = F.greatest(s["start"] - reach, F.lit(0))
        before, after = F.substring(text, low + 1, s["start"] - low), F.substring(text, s["end"] + 1, F.lit(reach))
        cut = F.when(low > 0, F.regexp_replace(before, "^[\\p{L}\\p{N}_']+", "")).otherwise(before)
        full = F.when(F.length(after) < reach, after).otherwise(F.regexp_replace(after, "[\\p{L}\\p{N}_']+$", ""))
        return F.struct(_entity(s).alias("entity"), s["kind"].alias("of"), cut.alias("before"), (s["start"] - F.length(cut)).alias("low"), full.alias("after"), s["end"].alias("high"))

    return F.transform(found, one)


def _measured(docs: DataFrame, reach: int) -> DataFrame:
    rows = _texts(docs).withColumn("base", F.array_sort(base_spans(F.col("text"))))
    context = F.when(F.size("base") > 0, _context(F.col("text"), F.col("base"), reach))
    return rows.select("doc_id", row_key().alias("rid"), F.xxhash64("text").alias("text_hash"), "base", context.alias("context"))


def _occurrences(rows: DataFrame) -> DataFrame:
    """(text_hash, of, entity, term), distinct: terms in contexts that no base span touches."""
    each = rows.filter("context is not null").select("text_hash", "base", F.explode("context").alias("c"))
    sides = F.array(F.struct(F.col("c.before").alias("side"), F.col("c.low").alias("at")), F.struct(F.col("c.after").alias("side"), F.col("c.high").alias("at")))
    each = each.select("text_hash", "base", F.col("c.entity").alias("entity"), F.col("c.of").alias("of"), F.explode(sides).alias("x"))
    each = each.withColumn("hit", F.explode(spans(F.col("x.side"), TERM, 4)))
    each = each.select("text_hash", "base", "of", "entity", F.lower("hit.value").alias("term"), (F.col("x.at") + F.col("hit.start")).alias("start"), (F.col("x.at") + F.col("hit.end")).alias("end"))
    return each.filter(~F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))).select("text_hash", "of", "entity", "term").distinct()


def disclosed(strength: float = STRENGTH) -> tuple[Column, Column]:
    """From the counts n, n_k, n_c, n_t, n_kt, n_ct: the share of c's information that t discloses (null where there is none), and the bits left."""
    of_class = (F.col("n_kt") + strength * F.col("n_k") / F.col("n")) / (F.col("n_t") + strength)
    of_entity = (F.col("n_ct") + strength * F.col("n_c") / (F.col("n_k") + 1)) / (F.col("n_kt") + strength)
    known, left = F.log2(F.col("n") / F.col("n_c")), -F.log2(of_class * of_entity)
    return F.when(known > 0, (known - left) / known), left


def suspected_terms(rows: DataFrame, strength: float = STRENGTH, disclosure: float = DISCLOSURE, residual: float = RESIDUAL) -> DataFrame:
    """(of, entity, term, n, n_k, n_c, n_kt, n_ct): terms that are revealing unless they stand in texts without an entity of the class."""
    found = _occurrences(rows).checkpoint()
    held = rows.filter("context is not null").select("text_hash", F.explode("context").alias("c")).select("text_hash", F.col("c.of").alias("of"), F.col("c.entity").alias("entity")).distinct()
    total = rows.agg(F.count_distinct("text_hash").alias("n"))
    n_k = held.select("of", "text_hash").distinct().groupBy("of").agg(F.count("*").alias("n_k"))
    n_c = held.groupBy("of", "entity").agg(F.count("*").alias("n_c"))
    n_kt = found.select("of", "term", "text_hash").distinct().groupBy("of", "term").agg(F.count("*").alias("n_kt"))
    n_ct = found.groupBy("of", "entity", "term").agg(F.count("*").alias("n_ct"))
    pairs = n_ct.join(n_kt, ["of", "term"]).join(n_c, ["of", "entity"]).join(F.broadcast(n_k), "of").crossJoin(F.broadcast(total))  # a row per kind, and one row
    share, left = disclosed(strength)
    pairs = pairs.withColumn("n_t", F.col("n_kt"))
    return pairs.filter((share >= disclosure) & (left <= residual)).drop("n_t")


def _with(words: DataFrame, terms: DataFrame, term_bytes: int) -> DataFrame:
    """words (rid, term, ...) joined with terms (term, ...)."""
    size = terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    if size <= term_bytes:
        return words.join(F.broadcast(terms), "term")
    dealt = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return words.withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int")).join(dealt, ["term", "salt"]).drop("salt")


def _words(docs: DataFrame) -> DataFrame:
    """(rid, text_hash, term): the distinct terms of each row's text."""
    texts = _texts(docs).select(row_key().alias("rid"), F.xxhash64("text").alias("text_hash"), "text")
    words = F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), lambda w: F.lower(w))
    return texts.select("rid", "text_hash", F.explode(F.array_distinct(words)).alias("term"))


def revealing_terms(rows: DataFrame, docs: DataFrame, strength: float = STRENGTH, disclosure: float = DISCLOSURE, residual: float = RESIDUAL, term_bytes: int = TERM_BYTES) -> DataFrame:
    """(of, entity, term, the counts, ratio, bits): revealing terms by the entity that they reveal."""
    pairs = suspected_terms(rows, strength, disclosure, residual).checkpoint()
    share, left = disclosed(strength)
    terms = pairs.select("term").distinct()
    if pairs.isEmpty():
        n_t = terms.withColumn("n_all", F.lit(0).cast("long"))
    else:
        n_t = _with(_words(docs), terms, term_bytes).select("term", "text_hash").distinct().groupBy("term").agg(F.count("*").alias("n_all"))
    # Contexts cut by the rim may see less of a term than whole texts do, never more; greatest() guards the reverse.
    out = pairs.join(n_t, "term").withColumn("n_t", F.greatest("n_all", "n_kt")).withColumn("ratio", share).withColumn("bits", left)
    return out.filter((F.col("ratio") >= disclosure) & (F.col("bits") <= residual)).select("of", "entity", "term", "n", "n_k", "n_c", "n_t", "n_kt", "n_ct", "ratio", "bits")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _term_spans(docs: DataFrame, terms: DataFrame, term_bytes: int) -> DataFrame:
    """(rid, extra): spans of all occurrences of terms (term, value) in whole texts."""
    held = _with(_words(docs).drop("text_hash"), terms, term_bytes)
    held = held.groupBy("rid").agg(F.map_from_entries(F.collect_set(F.struct("term", "value"))).alias("held")).checkpoint()  # at most a text's terms
    strings = F.aggregate(F.map_entries("held"), F.lit(0).cast("long"), lambda a, e: a + F.octet_length(e["key"]) + F.octet_length(e["value"]) + HELD_TERM)
    if (held.agg(F.sum(strings + HELD_ROW)).first()[0] or 0) <= HELD_TIMES * term_bytes:
        held = F.broadcast(held)
    hits = spans(F.col("text"), TERM, 4, lambda hit, _: F.map_contains_key("held", F.lower(hit)))
    texts = _texts(docs).select(row_key().alias("rid"), "text")
    each = texts.join(held, "rid").dropDuplicates(["rid"]).select("rid", "held", hits.alias("hits"))
    return each.select("rid", F.transform("hits", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.element_at("held", F.lower(s["value"])).alias("value"))).alias("extra"))


def personal_data(docs: DataFrame, reach: int = REACH, strength: float = STRENGTH, disclosure: float = DISCLOSURE, residual: float = RESIDUAL, removal: float = REMOVAL, term_bytes: int = TERM_BYTES) -> DataFrame:
    """doc_id, rid, base, spans (sorted arrays of (start, kind, end, value)); a term's value says what becomes of it."""
    prepare(docs.sparkSession)
    rows = _measured(docs, reach).checkpoint()
    kinds = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    action = F.when(F.col("ratio") >= removal, "").otherwise(F.get(kinds, F.col("of")))
    terms = revealing_terms(rows, docs, strength, disclosure, residual, term_bytes).groupBy("term").agg(F.min(action).alias("value")).checkpoint()
    if terms.isEmpty():
        return rows.select("doc_id", "rid", "base", F.col("base").alias("spans"))
    out = rows.join(_term_spans(docs, terms, term_bytes), "rid", "left")
    extra = F.coalesce(F.col("extra").cast(f"array<{SPAN}>"), none())
    extra = F.filter(extra, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.select("doc_id", "rid", "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def sanitise(docs: DataFrame, **limits) -> DataFrame:
    """doc_id and clean_text: entities become their kind; revealing terms are generalised to it or removed."""
    kinds = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    found = personal_data(docs, **limits).select("rid", "spans").distinct()
    texts = _texts(docs).withColumn("rid", row_key())
    label = lambda s: F.when(s["kind"] == 4, s["value"]).otherwise(F.get(kinds, s["kind"]))
    return texts.join(found, "rid").select("doc_id", masked(F.col("text"), F.col("spans"), label).alias("clean_text"))


def privacy_report(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans as text, one row per row of docs."""
    found = F.col("spans")
    return personal_data(docs, **limits).select("doc_id", *[count_of(found, k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(shown(F.col("base"), KINDS), 256).alias("base_sha256"), shown(found, KINDS).alias("spans"))
