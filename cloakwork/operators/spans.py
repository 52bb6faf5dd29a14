"""Spans in arrays: entity structs, trimming, overlap resolution, clusters and merging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.findall import slice_text
from ..functions.scores import overlaps, rank
from ..functions.taxonomy import MULTILINE

#: Half-open code-point spans; what a stage doesn't set is null.
FIELDS = {
    "ord": "int", "start": "int", "end": "int", "type": "string", "score": "double", "source": "string", "text": "string",
    "rule": "string", "checksum": "string", "checksum_passed": "boolean", "context_keyword": "string", "dob_context": "string",
    "suppressed": "array<struct<type:string,start:int,end:int,score:double,source:string>>",
    "presidio_label": "string", "n_tokens": "int", "min_token_prob": "double", "mean_margin": "double",
    "detectors": "array<string>", "n_agreeing": "int", "agreement": "boolean", "conflicting_types": "array<string>", "raw_scores": "array<struct<source:string,score:double>>",
    "raw_score": "double", "calibration_group": "string", "calibrated": "boolean", "group_calibrated": "boolean",
    "score_before_repeat_propagation": "double", "decision": "string", "decision_reasons": "array<string>", "found_by": "string",
}
ENTITY = f"struct<{','.join(f'`{k}`:{v}' for k, v in FIELDS.items())}>"
# Characters that spans don't begin or end with; those that may stand between merged spans.
EDGES = " \t\n\r.,;:!?\"'()[]{}<>«»¡¿"
GAP = r"^[ \t,.\-/]*$"


def entity(**fields: Column) -> Column:
    return F.struct(*[(fields[k].cast(v) if k in fields else F.lit(None).cast(v)).alias(k) for k, v in FIELDS.items()])


def trimmed(text: Column, start: Column, end: Column) -> Column:
    """(start, end) without the edge characters; empty if nothing else is there."""
    value = slice_text(text, start, end)
    left = F.length(value) - F.length(F.ltrim(value, F.lit(EDGES)))
    kept = F.length(F.btrim(value, F.lit(EDGES)))
    return F.struct((start + left).alias("start"), (start + left + kept).alias("end"))


def normalize(text: Column, entities: Column) -> Column:
    """Within the text, up to the first line end unless the kind may go on, trimmed; empty spans go."""

    def one(e):
        start, end = F.greatest(e["start"], F.lit(0)), F.least(e["end"], F.length(text))
        line = F.instr(slice_text(text, start, end), F.lit("\n"))
        end = F.when((line > 0) & ~e["type"].isin(*MULTILINE), start + line - 1).otherwise(end)
        return let(trimmed(text, start, end), lambda t: e.withField("start", t["start"]).withField("end", t["end"]).withField("text", slice_text(text, t["start"], t["end"])))

    return F.filter(F.transform(F.filter(entities, lambda e: F.least(e["end"], F.length(text)) > F.greatest(e["start"], F.lit(0))), one), lambda e: e["end"] > e["start"])


def _brief(e: Column) -> Column:
    return F.struct(e["type"].alias("type"), e["start"].alias("start"), e["end"].alias("end"), F.round(e["score"], 4).alias("score"), e["source"].alias("source"))


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def by(entities: Column, *keys) -> Column:
    """Sorted by keys, each a function of the entity, then by place."""
    keyed = F.transform(entities, lambda e, i: F.struct(*[k(e).alias(f"k{n}") for n, k in enumerate(keys)], i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda k: k["e"])


def strongest_first(entities: Column) -> Column:
    def minus(name: str):
        return lambda e: -rank(e)[name]

    return by(entities, minus("check"), minus("score"), minus("priority"), minus("length"), lambda e: e["start"])


def resolve(entities: Column) -> Column:
    """Strongest first, each that overlaps none of those kept; the first one it clashes with records it."""
    none = F.array().cast(f"array<{ENTITY}>")

    def step(kept, e):
        def tell(clash):
            told = F.transform(kept, lambda k, i: F.when(i + 1 == clash, k.withField("suppressed", F.concat(F.coalesce(k["suppressed"], F.array().cast(FIELDS["suppressed"])), F.array(_brief(e))))).otherwise(k))
            return F.when(clash > 0, told).otherwise(F.concat(kept, F.array(e)))

        return let(F.array_position(F.transform(kept, lambda k: overlaps(k, e)), F.lit(True)), tell)

    return by(F.aggregate(strongest_first(entities), none, step), lambda e: e["start"])


def clusters(entities: Column) -> Column:
    """Arrays of entities that overlap one another, directly or through others, by start, end and order."""
    none = F.array().cast(f"array<struct<stop:int,members:array<{ENTITY}>>>")

    def step(acc, e):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(F.greatest(last["stop"], e["end"]).alias("stop"), F.concat(last["members"], F.array(e)).alias("members"))
        new = F.struct(e["end"].alias("stop"), F.array(e).alias("members"))
        goes_on = (F.size(acc) > 0) & (e["start"] < last["stop"])
        return F.when(goes_on, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(new)))

    return F.transform(F.aggregate(by(entities, lambda e: e["start"], lambda e: e["end"]), none, step), lambda c: c["members"])


def merge_adjacent(spans: Column, text: Column, max_gap: int = 2, fields: str = "struct<start:int,end:int,type:string,score:double,group:string>") -> Column:
    """Neighbours of one type with at most a small gap of separators are one span: the first one's fields, the weakest score."""
    none = F.array().cast(f"array<{fields}>")

    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        gap = F.when(text == "", F.lit("")).otherwise(slice_text(text, last["end"], s["start"]))
        fits = (F.size(acc) > 0) & (s["type"] == last["type"]) & (s["start"] - last["end"] <= max_gap) & gap.rlike(GAP)
        one = last.withField("end", F.greatest(last["end"], s["end"])).withField("score", F.coalesce(F.least(last["score"], s["score"]), last["score"]))
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(one))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(by(spans, lambda s: s["start"], lambda s: s["end"]), none, step)
