"""Spans of regular expressions as DataFrame expressions: places of matches in code points, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,kind:int,end:int,value:string>"


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def spans(text: Column, pattern: str, kind: int, keep=None, group: int = 0, gate: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of a pattern that never matches the empty string, as an array of SPAN.

    Gaps between matches come from split(), the matches from regexp_extract_all(); both scan alike, so their running
    lengths are the places. keep(match, group) filters matches. Texts that the gate or the pattern rules out cost one scan.
    """
    regex = F.lit(pattern)
    hits = F.regexp_extract_all(text, regex, F.lit(0))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), *([F.regexp_extract_all(text, regex, F.lit(group)).alias("part")] if group else []))
    start = F.struct(F.lit(0).alias("at"), none().alias("out"))

    def step(acc, x):
        at = acc["at"] + F.length(x["gap"])
        end = at + F.coalesce(F.length(x["hit"]), F.lit(0))
        good = x["hit"].isNotNull()
        if keep is not None:
            good = good & keep(x["hit"], x["part"] if group else x["hit"])
        one = F.array(F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("value")))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(zipped, start, step, lambda acc: acc["out"])
    seen = F.regexp_like(text, regex)
    return F.when(seen if gate is None else gate & seen, found).otherwise(none())


def shown(found: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(found: Column, kind: int) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def masked(text: Column, found: Column, label) -> Column:
    """The text with each of the sorted spans replaced by label(span); of overlapping spans the first holds."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), label(s))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), piece.alias("out"))).otherwise(acc)

    return F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
