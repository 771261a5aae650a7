"""Places of pattern matches in a text, by DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"
TAGGED = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def find(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches of the Java pattern, in code points, end exclusive; those that `keep` holds for.

    What lies between the matches is found by the same pattern, so the lengths of both give every place.
    The running place goes through all matches; only kept ones are gathered.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    steps = F.zip_with(found, gaps, lambda m, gap: F.struct(m.alias("value"), F.char_length(gap).alias("gap")))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.char_length(x["value"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        out = F.concat(state["out"], span)
        return F.struct(end.alias("at"), (F.when(keep(x["value"]), out).otherwise(state["out"]) if keep else out).alias("out"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    # The first test is one pass without allocation, which most texts end.
    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(steps, nothing, step, lambda s: s["out"])).otherwise(F.array().cast(SPAN))


def tagged(spans: Column, kind: str, rank: int) -> Column:
    """Spans with their kind, in fields that sort by start, then by the kind's rank."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def listed(spans: Column) -> Column:
    """kind:start:end of tagged spans, by start and rank, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: Column) -> Column:
    return F.sha2(listed(spans).cast("binary"), 256)


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
