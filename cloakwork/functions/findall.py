"""All matches of a regular expression with their places, in one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def find_all(text: Column, head: str, body: str, tail: str = "", flags: str = "(?iuU)") -> Column:
    """Matches of head + body + tail from left to right: an array of (start, end, value), of the body alone.

    Gaps and matches follow one another, so places are running lengths. The last alternative takes
    the unmatched rest at once; without it every place of the rest would be tried again.
    """
    whole = f"{flags}(?s:(.*?))({head})({body}){tail}|(?s:.+)"
    gap, label, value = (F.regexp_extract_all(text, F.lit(whole), F.lit(i)) for i in (1, 2, 3))
    kind = "array<struct<start:int,end:int,value:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))

    def step(acc, m):
        start = acc["at"] + F.length(m["gap"]) + F.length(m["label"])
        end = start + F.length(m["value"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(m["value"] != "", F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    rows = F.arrays_zip(gap.alias("gap"), label.alias("label"), value.alias("value"))
    return F.when(text.rlike(f"{flags}{head}{body}{tail}"), F.aggregate(rows, zero, step, lambda acc: acc["found"])).otherwise(F.array().cast(kind))


def slice_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))
