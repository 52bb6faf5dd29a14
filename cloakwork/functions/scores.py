"""Scores and span arithmetic as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .taxonomy import priority


def noisy_or(scores: Column) -> Column:
    """1 - the product of (1 - s), of an array."""
    return 1 - F.aggregate(scores, F.lit(1.0), lambda a, s: a * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def iou(a: Column, b: Column) -> Column:
    shared = F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])
    whole = F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"])
    return F.when(shared > 0, shared / whole).otherwise(F.lit(0.0))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x.cast("double") - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def geometric_mean(probs: Column) -> Column:
    return F.exp(F.aggregate(probs, F.lit(0.0), lambda a, p: a + F.ln(F.greatest(p, F.lit(1e-9)))) / F.size(probs))


def margin(probs: Column) -> Column:
    """The largest less the second largest."""
    s = F.sort_array(probs, asc=False)
    return F.when(F.size(s) > 1, F.get(s, F.lit(0)) - F.get(s, F.lit(1))).otherwise(F.get(s, F.lit(0)))


def checksum_rank(passed: Column) -> Column:
    return F.when(passed, 1).when(~passed, -1).otherwise(0)


def rank(e: Column) -> Column:
    """What decides between overlapping spans: check, score to three digits, priority, length."""
    return F.struct(checksum_rank(e["checksum_passed"]).alias("check"), F.round(e["score"], 3).alias("score"), priority(e["type"]).alias("priority"), (e["end"] - e["start"]).alias("length"))


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(F.when(whole > 0, part / whole).otherwise(F.lit(0.0)), digits)


def precision_recall(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    return [F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)), 4).alias("f1")]
