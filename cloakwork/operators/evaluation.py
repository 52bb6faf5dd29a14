"""Evaluation of predicted against true spans: matches by span, leaks and losses by character."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import iou, precision_recall, ratio
from .spans import by, merge_adjacent

SPAN = "struct<start:int,end:int,type:string,score:double,group:string>"


def spans(entities: Column, least: float = 0.0) -> Column:
    """Entities as evaluation spans, those below a score left out."""
    kept = F.filter(entities, lambda e: e["score"] >= least)
    return F.transform(kept, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["type"].alias("type"), e["score"].alias("score"), e["calibration_group"].alias("group")))


def match(gold: Column, pred: Column, mode: str = "exact", least: float = 0.5) -> Column:
    """For each gold span in turn the place of the prediction that it takes, -1 if none is left that fits.

    exact: the first equal one; partial: the one of largest overlap over union, `least` or more. A
    prediction is taken once.
    """

    def step(taken, g):
        def fit(p, i):
            free = ~F.array_contains(taken, i) & (p["type"] == g["type"])
            if mode == "exact":
                return F.when(free & (p["start"] == g["start"]) & (p["end"] == g["end"]), F.struct(F.lit(1.0).alias("s"), (-i).alias("i")))
            return F.when(free & (iou(g, p) >= least) & (iou(g, p) > 0), F.struct(iou(g, p).alias("s"), (-i).alias("i")))

        best = F.array_max(F.transform(pred, fit))
        return F.concat(taken, F.array(F.coalesce(-best["i"], F.lit(-1))))

    return F.aggregate(gold, F.array().cast("array<int>"), step)


def aligned(docs: DataFrame, mode: str = "exact", least: float = 0.5) -> DataFrame:
    """docs(text, gold, pred: arrays of spans) with both sides merged and `taken`, the matches."""
    text = F.coalesce(F.col("text"), F.lit(""))
    both = docs.withColumn("gold", merge_adjacent(F.col("gold").cast(f"array<{SPAN}>"), text)).withColumn("pred", merge_adjacent(F.col("pred").cast(f"array<{SPAN}>"), text))
    return both.withColumn("taken", match(F.col("gold"), F.col("pred"), mode, least))


def _outcomes() -> Column:
    """From `aligned`: (type, outcome) of each true positive, miss and false alarm."""
    gold = F.transform("gold", lambda g, i: F.struct(g["type"].alias("type"), F.when(F.get(F.col("taken"), i) >= 0, "tp").otherwise("fn").alias("outcome")))
    extra = F.filter(F.transform("pred", lambda p, i: F.when(~F.array_contains("taken", i), F.struct(p["type"].alias("type"), F.lit("fp").alias("outcome")))), lambda x: x.isNotNull())
    return F.concat(gold, extra)


def outcomes(found: DataFrame, *keys: str) -> DataFrame:
    """From `aligned`: a row (type, outcome) for each true positive, miss and false alarm."""
    return found.select(*keys, F.explode(_outcomes()).alias("o")).select(*keys, "o.type", "o.outcome")


def by_type(found: DataFrame, *keys: str) -> DataFrame:
    n = [F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")]
    counts = outcomes(found, *keys).groupBy(*keys, "type").agg(*n)
    return counts.select(*keys, "type", *precision_recall(F.col("tp"), F.col("fp"), F.col("fn")), "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"))


def overall(found: DataFrame, *keys: str) -> DataFrame:
    """Micro figures from the summed counts, macro ones as means of the rounded figures by type."""
    sums = by_type(found, *keys).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[F.round(F.avg(c), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    return sums.select(*keys, *precision_recall(F.col("tp"), F.col("fp"), F.col("fn")), "tp", "fp", "fn", "macro_precision", "macro_recall", "macro_f1")


def _union(spans_: Column) -> Column:
    """Disjoint intervals that cover the spans."""

    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]), joined).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    return F.aggregate(by(spans_, lambda s: s["start"], lambda s: s["end"]), F.array().cast("array<struct<start:int,end:int>>"), step)


def _size(intervals: Column) -> Column:
    return F.aggregate(intervals, F.lit(0), lambda a, s: a + s["end"] - s["start"])


def _shared(s: Column, intervals: Column) -> Column:
    return F.aggregate(intervals, F.lit(0), lambda a, o: a + F.greatest(F.lit(0), F.least(s["end"], o["end"]) - F.greatest(s["start"], o["start"])))


def characters(found: DataFrame) -> DataFrame:
    """Each document's characters: sensitive, covered, leaked, others, destroyed; its entities, and those not fully covered."""
    rows = found.withColumn("_g", _union(F.col("gold"))).withColumn("_p", _union(F.col("pred")))
    covered = F.aggregate("_g", F.lit(0), lambda a, s: a + _shared(s, F.col("_p")))
    length = F.when(F.length(F.coalesce("text", F.lit(""))) > 0, F.length("text")).otherwise(F.coalesce(F.array_max(F.transform(F.concat("gold", "pred"), lambda s: s["end"])), F.lit(0)))
    part = F.size(F.filter("gold", lambda s: _shared(s, F.col("_p")) < s["end"] - s["start"]))
    rows = rows.withColumn("gold_chars", _size(F.col("_g"))).withColumn("covered_chars", covered)
    return rows.withColumn("leaked_chars", F.col("gold_chars") - F.col("covered_chars")).withColumn("other_chars", F.greatest(F.lit(0), length - F.col("gold_chars"))).withColumn("over_chars", _size(F.col("_p")) - F.col("covered_chars")).withColumn("n_entities", F.size("gold")).withColumn("n_leaked_entities", part).drop("_g", "_p")


CHARACTERS = ("gold_chars", "covered_chars", "leaked_chars", "other_chars", "over_chars", "n_entities", "n_leaked_entities")


def _rates() -> list[Column]:
    return [
        ratio(F.col("leaked_chars"), F.col("gold_chars")).alias("char_leakage_rate"), ratio(F.col("n_leaked_entities"), F.col("n_entities")).alias("entity_leakage_rate"),
        ratio(F.col("covered_chars"), F.col("gold_chars")).alias("char_coverage"), ratio(F.col("over_chars"), F.col("other_chars"), 6).alias("over_redaction_rate"),
    ]


def privacy(found: DataFrame, *keys: str) -> DataFrame:
    c = characters(found).groupBy(*keys).agg(*[F.sum(x).alias(x) for x in CHARACTERS])
    return c.select(*keys, *_rates(), "n_entities", "n_leaked_entities")


def figures(found: DataFrame, *keys: str) -> DataFrame:
    """`overall` and `privacy` side by side, for keys with any outcome, from one pass over the documents."""
    whole = F.array(F.struct(F.lit(None).cast("string").alias("type"), F.lit("all").alias("outcome")))
    rows = characters(found).select(*keys, *CHARACTERS, F.explode(F.concat(_outcomes(), whole)).alias("o"))
    is_whole = F.col("o.outcome") == "all"
    sums = rows.groupBy(*keys, is_whole.alias("_whole"), F.col("o.type").alias("_type")).agg(*[F.count_if(F.col("o.outcome") == o).alias(o) for o in ("tp", "fp", "fn")], *[F.sum(F.when(is_whole, F.col(x))).alias(x) for x in CHARACTERS])
    by_kind = sums.select("*", *precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))
    macro = [F.round(F.avg(F.when(~F.col("_whole"), F.col(c))), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    all_ = by_kind.groupBy(*keys).agg(F.count_if(~F.col("_whole")).alias("_kinds"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *macro, *[F.sum(c).alias(c) for c in CHARACTERS])
    return all_.where("_kinds > 0").select(*keys, *precision_recall(F.col("tp"), F.col("fp"), F.col("fn")), "tp", "fp", "fn", "macro_precision", "macro_recall", "macro_f1", *_rates(), "n_entities", "n_leaked_entities")


def samples(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(score, correct, group) of each merged prediction: whether a gold span takes it in partial matching."""
    found = aligned(docs, "partial", least)
    rows = F.transform("pred", lambda p, i: F.struct(p["score"].alias("score"), F.array_contains("taken", i).cast("int").alias("correct"), p["group"].alias("group")))
    return found.select(F.explode(rows).alias("s")).select("s.*")


def best_system(scores: DataFrame, *keys: str) -> DataFrame:
    """(keys, system, f1) -> the system of the highest f1, the first by name of equals."""
    return scores.groupBy(*keys).agg(F.min(F.struct((-F.col("f1")).alias("f"), "system")).alias("b")).select(*keys, F.col("b.system").alias("system"), (-F.col("b.f")).alias("f1"))
