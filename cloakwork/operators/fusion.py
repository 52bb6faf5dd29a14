"""Fusing what several detectors found in a document into disjoint entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scores import iou, noisy_or, rank
from .spans import FIELDS, by, clusters, let

# Fixed values.
AGREEMENT_IOU, CONFLICT_PENALTY = 0.5, 0.75


def _winner(cluster: Column) -> Column:
    """The place of the entity of highest rank, the first of equals."""
    return F.array_max(F.transform(cluster, lambda e, i: F.struct(rank(e).alias("rank"), (-i).alias("i"))))["i"] * -1


def _fused(cluster: Column) -> Column:
    return let(_winner(cluster), lambda at: let(F.get(cluster, at), lambda win: _merged(cluster, at, win)))


def _merged(cluster: Column, at: Column, win: Column) -> Column:
    agree = F.filter(F.transform(cluster, lambda e, i: F.when((e["type"] == win["type"]) & ((i == at) | (iou(e, win) >= AGREEMENT_IOU)), e["score"])), lambda s: s.isNotNull())
    sources = F.array_sort(F.array_distinct(F.transform(cluster, lambda e: e["source"])))
    others = F.array_sort(F.array_distinct(F.transform(F.filter(cluster, lambda e: e["type"] != win["type"]), lambda e: e["type"])))
    score = F.when(F.size(agree) > 1, noisy_or(agree)).otherwise(win["score"]) * F.when(F.size(others) > 0, CONFLICT_PENALTY).otherwise(1.0)
    # The last score of each source.
    raw = F.transform(sources, lambda s: F.struct(s.alias("source"), F.round(F.try_element_at(F.filter(cluster, lambda e: e["source"] == s), F.lit(-1))["score"], 4).alias("score")))
    out = win.withField("score", score).withField("source", F.array_join(sources, "+"))
    for name, value in {"detectors": sources, "n_agreeing": F.size(agree), "agreement": F.size(agree) > 1, "conflicting_types": others, "raw_scores": raw}.items():
        out = out.withField(name, value.cast(FIELDS[name]))
    return out


def fuse(entities: Column) -> Column:
    """One entity for each cluster: the strongest member, its score raised by agreement and lowered by conflict."""
    return by(F.transform(clusters(entities), _fused), lambda e: e["start"])
