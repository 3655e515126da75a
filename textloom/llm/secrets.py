"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Only DataFrame functions are used. A candidate is a run of at least WINDOW key characters that holds letters and digits. Its
character class (hexadecimal, or mixed) sets the threshold; a window of WINDOW characters slides over it, with the counts
of its characters updated by the one that enters and the one that leaves, and so the sum of c * log2(c) that entropy
needs. The span is the hull of the windows above the threshold. Windows never touch a pattern's span: what such spans leave of a
candidate are candidates by themselves. Those that an allow-list pattern matches are suppressed. Null texts are empty; repeated rows give repeated results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import SPAN, count_of, masked, none, shown, spans

KINDS = ("assign", "access", "hex", "entropy")
#: Fixed patterns.
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW, LIMITS = 20, {"[0-9a-fA-F]+": 2.9, "": 3.6}
#: Strings that are no secrets: UUIDs, paths, dashed or underscored words, stretches of the alphabet or of digits, samples.
ALLOWED = ("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "([A-Za-z0-9_.=-]{0,15}/)+[A-Za-z0-9_.=-]{0,15}", "([a-zA-Z]{0,15}[-_=]|[0-9]{0,4}[-_=])+[a-zA-Z0-9]{0,15}", ".*(?i:abcdefgh|01234567|example|placeholder).*")


def base_spans(text: Column) -> Column:
    """Spans of the patterns, unsorted."""
    lower = F.lower(text)
    named = lower.contains("passw") | lower.contains("secret") | lower.contains("token") | lower.contains("api")
    assign = spans(text, ASSIGN, 0, lambda _, part: F.length(part) >= 6, group=2, gate=named)
    return F.concat(assign, spans(text, ACCESS, 1, gate=text.contains("AKIA")), spans(text, HEX, 2))


def entropy_hull(value: Column, limit: Column, window: int = WINDOW) -> Column:
    """(low, high) of the windows whose entropy reaches the limit, low being -1 if there are none; for ASCII strings."""
    parts = [F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(window + 2)]
    weight = lambda c: F.element_at(F.array(*parts), c + 1)
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    start = F.struct(F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0.0).alias("s"), F.lit(-1).alias("low"), F.lit(-1).alias("high"))

    def step(acc, i):
        enters = F.element_at(codes, i)
        leaves = F.when(i > window, F.get(codes, i - window - 1))
        was = F.element_at(acc["n"], enters + 1)
        gone = F.element_at(acc["n"], leaves + 1) + (leaves == enters).cast("int")
        total = acc["s"] - weight(was) + weight(was + 1)
        total = F.when(i > window, total - weight(gone) + weight(gone - 1)).otherwise(total)
        high = (i >= window) & (math.log2(window) - total / window >= limit)
        counts = F.transform(acc["n"], lambda n, k: n + (k == enters).cast("int") - F.coalesce((k == leaves).cast("int"), F.lit(0)))
        return F.struct(counts.alias("n"), total.alias("s"), F.when(high & (acc["low"] < 0), i - window).otherwise(acc["low"]).alias("low"), F.when(high, i).otherwise(acc["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.length(value)), start, step, lambda acc: F.struct(acc["low"].alias("low"), acc["high"].alias("high")))


def _stretches(found: Column, base: Column, least: int) -> Column:
    """What the sorted spans of base leave of found, in stretches of at least some characters."""

    def cut(s):
        piece = lambda low, high: F.when(high - low >= least, F.array(F.struct(low.alias("start"), s["kind"].alias("kind"), high.alias("end"), F.substring(s["value"], low - s["start"] + 1, high - low).alias("value")))).otherwise(none())
        start = F.struct(s["start"].alias("at"), none().alias("out"))
        touching = F.filter(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        step = lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["out"], piece(acc["at"], b["start"])).alias("out"))
        return F.aggregate(touching, start, step, lambda acc: F.concat(acc["out"], piece(acc["at"], s["end"])))

    return F.flatten(F.transform(found, cut))


def entropy_spans(text: Column, base: Column, window: int = WINDOW, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Spans of high entropy, given the sorted spans of the patterns."""
    (hexadecimal, low), (_, high) = LIMITS.items()

    def good(s):
        out = F.regexp_like(s["value"], F.lit("[0-9]")) & F.regexp_like(s["value"], F.lit("[A-Za-z]"))
        for pattern in allowed:
            out = out & ~F.regexp_like(s["value"], F.lit(f"^(?:{pattern})$"))
        return out

    found = F.filter(_stretches(spans(text, CANDIDATE, 3), base, window), good)
    limit = lambda s: F.when(F.regexp_like(s["value"], F.lit(f"^{hexadecimal}$")), F.lit(low)).otherwise(F.lit(high))

    def hull(s):
        ends = entropy_hull(s["value"], limit(s), window)
        return F.struct((s["start"] + ends["low"]).alias("start"), F.when(ends["low"] >= 0, s["kind"]).alias("kind"), (s["start"] + ends["high"]).alias("end"), s["value"].alias("value"))

    return F.when(F.size(found) > 0, F.filter(F.transform(found, hull), lambda s: s["kind"].isNotNull())).otherwise(none())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: sorted arrays of (start, kind, end, value), kinds by their place in KINDS."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("base", F.array_sort(base_spans(F.col("text"))))
    rows = rows.withColumn("extra", entropy_spans(F.col("text"), F.col("base")))
    return rows.select("doc_id", "text", "base", F.array_sort(F.concat("base", "extra")).cast(f"array<{SPAN}>").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and clean_text: the text with secrets replaced by their kind."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    return scan(docs).select("doc_id", masked(F.col("text"), F.col("spans"), lambda s: F.get(names, s["kind"])).alias("clean_text"))


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans as text, one row per row of docs."""
    return scan(docs).select("doc_id", *[count_of(F.col("spans"), k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(shown(F.col("base"), KINDS), 256).alias("base_sha256"), shown(F.col("spans"), KINDS).alias("spans"))
