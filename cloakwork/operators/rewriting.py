"""Rewriting texts: repeats of known values, replacements in three modes, and what survived."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.findall import slice_text
from ..functions.scores import overlaps
from ..functions.taxonomy import marker, shown_digits
from .spans import ENTITY, by

MASK, PARTIAL, PSEUDONYM = "mask", "partial", "pseudonymize"
# Values shorter than this aren't swept or reported; digits of a tag; blanks.
LEAST, TAG = 4, 6
DEMO_KEY = b"cloakwork-demo-key"
BLANKS = " \t\n\r\x0b\x0c"


def _places(text: Column, value: Column) -> Column:
    """Starts of all non-overlapping occurrences of a value: running lengths of the text split at it."""
    parts = F.split(text, F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(acc, p):
        start = acc["at"] + F.length(p)
        return F.struct((start + F.length(value)).alias("at"), F.concat(acc["starts"], F.array(start)).alias("starts"))

    return F.aggregate(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), zero, step, lambda acc: acc["starts"])


def sweep(text: Column, entities: Column) -> Column:
    """Every other whole-word occurrence of a found value joins the entities, in their order; claims don't overlap."""
    word = r"^[\p{L}\p{N}_]$"

    def of(claimed, e):
        value = F.btrim(e["text"], F.lit(BLANKS))

        def claim(acc, start):
            end = start + F.length(value)
            span = F.struct(start.alias("start"), end.alias("end"))
            free = ~F.exists(acc, lambda c: overlaps(c, span))
            alone = ~F.substring(text, start, F.when(start > 0, 1).otherwise(0)).rlike(word) & ~F.substring(text, end + 1, F.lit(1)).rlike(word)
            new = e.withField("text", value).withField("start", start).withField("end", end).withField("found_by", F.lit("repeat_sweep"))
            return F.when(free & alone, F.concat(acc, F.array(new))).otherwise(acc)

        return F.when(F.length(value) >= LEAST, F.aggregate(_places(text, value), claimed, claim)).otherwise(claimed)

    return by(F.aggregate(entities, entities, of), lambda e: e["start"])


def pseudonym(value: Column, kind: Column, key: bytes, digits: int = TAG) -> Column:
    """The first hex digits of HMAC-SHA256(key, kind:value); the pads are computed once, the hashes by Spark."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    said = F.encode(F.concat(kind, F.lit(":"), F.lower(F.btrim(value, F.lit(BLANKS)))), "UTF-8")
    return F.substring(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, said), 256))), 256), 1, digits)


def replacement(e: Column, lang: Column, mode: str = MASK, key: bytes = DEMO_KEY) -> Column:
    mark = marker(e["type"], lang)
    open_ = F.substring(mark, F.lit(1), F.length(mark) - 1)
    if mode == MASK:
        return mark
    if mode == PARTIAL:
        digits, shown = F.regexp_replace(e["text"], r"\D", ""), shown_digits(e["type"])
        return F.when(F.length(digits) > shown, F.concat(open_, F.lit("_****"), F.right(digits, shown), F.lit("]"))).otherwise(mark)
    if mode == PSEUDONYM:
        return F.concat(open_, F.lit(":"), pseudonym(e["text"], e["type"], key), F.lit("]"))
    raise ValueError(mode)


REPLACEMENT = "struct<original:string,replacement:string,type:string,source_start:int,source_end:int,redacted_start:int,redacted_end:int,score:double>"


def redact(text: Column, entities: Column, lang: Column, mode: str = MASK, key: bytes = DEMO_KEY) -> Column:
    """(redacted_text, replacements): entities by start, those that begin inside the last one left out."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.array().cast(f"array<{REPLACEMENT}>").alias("done"))

    def step(acc, e):
        new = replacement(e, lang, mode, key)
        start = F.length(acc["out"]) + e["start"] - acc["at"]
        one = F.struct(e["text"].alias("original"), new.alias("replacement"), e["type"].alias("type"), e["start"].alias("source_start"), e["end"].alias("source_end"), start.alias("redacted_start"), (start + F.length(new)).alias("redacted_end"), F.round(e["score"], 4).alias("score"))
        cut = F.struct(e["end"].alias("at"), F.concat(acc["out"], slice_text(text, acc["at"], e["start"]), new).alias("out"), F.concat(acc["done"], F.array(one)).alias("done"))
        return F.when((e["start"] >= acc["at"]) | (F.size(acc["done"]) == 0), cut).otherwise(acc)

    def finish(acc):
        return F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))).alias("redacted_text"), acc["done"].alias("replacements"))

    return F.aggregate(by(entities, lambda e: e["start"]), zero, step, finish)


def leaks(redacted: Column) -> Column:
    """Replaced values that still stand in the text, as they were."""
    kept = F.filter(redacted["replacements"], lambda r: (F.length(F.btrim(r["original"], F.lit(BLANKS))) >= LEAST) & F.contains(redacted["redacted_text"], F.btrim(r["original"], F.lit(BLANKS))))
    return F.transform(kept, lambda r: F.struct(r["type"].alias("type"), F.btrim(r["original"], F.lit(BLANKS)).alias("value")))


def no_entities() -> Column:
    return F.array().cast(f"array<{ENTITY}>")
