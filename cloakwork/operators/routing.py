"""Routing: who decides about an entity - redacted at once, reviewed by a person, or let go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.taxonomy import high_risk

AUTO, REVIEW, DISCARD = "auto_redact", "review", "discard"


@dataclass(frozen=True)
class Policy:
    # The default thresholds.
    tau_auto: float = 0.90
    tau_discard: float = 0.50
    tau_high_risk: float = 0.95
    review_on_conflict: bool = True
    tau_single_detector: float = 0.97

    def reasons(self, e: Column) -> Column:
        """Why a person should look; null entries left out."""
        score = F.format_string("%.2f", e["score"])
        passed = F.coalesce(e["checksum_passed"], F.lit(False))
        conflicts = F.coalesce(e["conflicting_types"], F.array().cast("array<string>"))
        one = F.size(F.coalesce(e["detectors"], F.array().cast("array<string>"))) == 1
        listed = F.concat(F.lit("['"), F.array_join(conflicts, "', '"), F.lit("']"))
        return F.array_compact(F.array(
            F.when((e["score"] < self.tau_discard) & passed, F.concat(F.lit("low score "), score, F.lit(" but "), e["checksum"], F.lit(" checksum verified"))),
            F.when(F.lit(self.review_on_conflict) & (F.size(conflicts) > 0), F.concat(F.lit("type conflict with "), listed)),
            F.when(~e["checksum_passed"], F.concat(e["checksum"], F.lit(" checksum failed"))),
            F.when(high_risk(e["type"]) & (e["score"] < self.tau_high_risk), F.concat(F.lit("high-risk "), e["type"], F.lit(f" below {self.tau_high_risk} confidence"))),
            F.when(e["score"] < self.tau_auto, F.concat(F.lit("score "), score, F.lit(f" < {self.tau_auto}"))),
            F.when(~F.coalesce(e["agreement"], F.lit(False)) & one & (e["score"] < self.tau_single_detector), F.concat(F.lit("only "), F.get(e["detectors"], F.lit(0)), F.lit(" detected it"))),
        ))

    def decide(self, e: Column) -> Column:
        """The entity with its decision and the reasons."""
        gone = (e["score"] < self.tau_discard) & ~F.coalesce(e["checksum_passed"], F.lit(False))
        why = self.reasons(e)
        decision = F.when(gone, DISCARD).when(F.size(why) > 0, REVIEW).otherwise(AUTO)
        let_go = F.array(F.concat(F.lit("score "), F.format_string("%.2f", e["score"]), F.lit(f" < {self.tau_discard}")))
        told = F.when(gone, let_go).when(F.size(why) > 0, why).otherwise(F.array(F.lit("high confidence, no conflicts")))
        return e.withField("decision", decision).withField("decision_reasons", told)


def route(entities: Column, policy: Policy) -> Column:
    return F.transform(entities, policy.decide)


def _value(e: Column) -> Column:
    """Case-folded: the sharp s is two."""
    return F.replace(F.lower(F.btrim(e["text"], F.lit(" \t\n\r\x0b\x0c"))), F.lit("ß"), F.lit("ss"))


def unify(entities: Column) -> Column:
    """Mentions of one value and kind in a document have the highest of their scores."""

    def one(e):
        best = F.array_max(F.transform(F.filter(entities, lambda o: (_value(o) == _value(e)) & (o["type"] == e["type"])), lambda o: o["score"]))
        up = best > e["score"]
        return e.withField("score_before_repeat_propagation", F.when(up, F.round(e["score"], 4)).otherwise(e["score_before_repeat_propagation"])).withField("score", F.greatest(best, e["score"]))

    return F.transform(entities, one)
