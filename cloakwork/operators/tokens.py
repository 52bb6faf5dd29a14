"""Token labels: spans from begin/inside labels, windows, and labels from spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import geometric_mean, overlaps

DECODED = "struct<start:int,end:int,type:string,n_tokens:int,probs:array<double>,margins:array<double>>"


def decode(tokens: Column) -> Column:
    """tokens: array of (label, start, end, prob, margin) in order -> spans with the tokens' certainty.

    A span begins with B, without an open span, or where the kind changes; O ends it; tokens of no
    width are skipped.
    """
    none = F.array().cast(f"array<{DECODED}>")

    def step(acc, t):
        kind = F.substring(t["label"], 3, 100)
        last = F.try_element_at(acc["spans"], F.lit(-1))
        goes_on = acc["open"] & ~t["label"].startswith("B-") & (last["type"] == kind)
        new = F.struct(t["start"].alias("start"), t["end"].alias("end"), kind.alias("type"), F.lit(1).alias("n_tokens"), F.array(t["prob"]).alias("probs"), F.array(t["margin"]).alias("margins"))
        longer = F.struct(last["start"].alias("start"), t["end"].alias("end"), last["type"].alias("type"), (last["n_tokens"] + 1).alias("n_tokens"), F.concat(last["probs"], F.array(t["prob"])).alias("probs"), F.concat(last["margins"], F.array(t["margin"])).alias("margins"))
        spans = F.when(goes_on, F.concat(F.slice(acc["spans"], 1, F.greatest(F.size(acc["spans"]) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc["spans"], F.array(new)))
        out = F.struct(F.lit(True).alias("open"), spans.alias("spans"))
        return F.when(t["end"] <= t["start"], acc).when(t["label"] == "O", F.struct(F.lit(False).alias("open"), acc["spans"].alias("spans"))).otherwise(out)

    zero = F.struct(F.lit(False).alias("open"), none.alias("spans"))
    spans = F.aggregate(tokens, zero, step, lambda acc: acc["spans"])

    def finish(s):
        mean = F.aggregate(s["margins"], F.lit(0.0), lambda a, m: a + m) / F.size(s["margins"])
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), geometric_mean(s["probs"]).alias("score"), s["n_tokens"].alias("n_tokens"), F.array_min(s["probs"]).alias("min_token_prob"), mean.alias("mean_margin"))

    return F.transform(spans, finish)


def dedup_windows(found: DataFrame) -> DataFrame:
    """(doc_id, start, end, type, score, window): of equal spans of overlapping windows the surest, the first window's of equals."""
    order = Window.partitionBy("doc_id", "start", "end", "type").orderBy(F.col("score").desc(), "window")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def windows(tokens: Column, size: int = 192, stride: int = 64) -> Column:
    """Overlapping runs of tokens: each begins `size - stride` after the one before."""
    step = size - stride
    count = F.greatest(F.lit(1), F.ceil((F.size(tokens) - stride) / F.lit(step)).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(tokens, k * step + 1, size))


def align(tokens: Column, entities: Column) -> Column:
    """Labels of tokens (start, end): B for the first token of the first span it overlaps, I for the rest; -100 for no width."""

    def label(t, i):
        hit = F.try_element_at(F.filter(F.array_sort(F.transform(entities, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["type"].alias("type")))), lambda e: overlaps(e, t)), F.lit(1))
        before = F.get(tokens, i - 1)
        begins = (i == 0) | ~F.coalesce(overlaps(hit, before), F.lit(False))
        return F.when(t["end"] <= t["start"], F.lit("-100")).when(hit.isNull(), F.lit("O")).otherwise(F.concat(F.when(begins, "B-").otherwise("I-"), hit["type"]))

    return F.transform(tokens, label)


def words(text: Column) -> Column:
    """(start, end) of the runs of anything but white space, for tests and stand-ins of a tokenizer."""
    from ..functions.findall import find_all

    return F.transform(find_all(text, "", r"\S+", flags="(?U)"), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
