"""The whole way of a document: detect, fuse, calibrate, unify, route, sweep, redact, verify.

Everything about a document happens in its row, without a shuffle, so the same plan runs on tables
and on streams.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ship
from ..functions.findall import slice_text
from ..operators import calibration, docloop, fusion, rewriting, review, routing, ruleloop, rules
from ..operators.evaluation import aligned, figures, spans
from ..operators.spans import ENTITY, entity, normalize, resolve

# Words and letters that tell the two languages apart.
SPANISH = r"(?iU)\b(el|la|los|las|de|del|que|para|con|por|una|nombre|tel[eé]fono|direcci[oó]n|fecha|cliente|cuenta|correo|documento|factura|contrato)\b"
ENGLISH = r"(?iU)\b(the|and|for|with|from|your|name|phone|address|date|customer|account|email|invoice|agreement|please)\b"
ACCENTS = r"(?iu)[áéíóúñ¿¡]"
# Labels of an outside recognizer (None: dropped) and its least score.
RECOGNIZER_FLOOR = 0.3


def language(text: Column) -> Column:
    """es or en, by words and accents; es if they are even."""
    es = F.regexp_count(text, F.lit(SPANISH)) + 2 * F.regexp_count(text, F.lit(ACCENTS))
    return F.when(es >= F.regexp_count(text, F.lit(ENGLISH)), "es").otherwise("en")


Detector = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Config:
    engines: tuple[str, ...] = ("rules",)
    mode: str = rewriting.MASK
    key: bytes = rewriting.DEMO_KEY
    policy: routing.Policy = field(default_factory=routing.Policy)
    calibrator: calibration.Calibrator = field(default_factory=calibration.Calibrator)
    context_window: int = rules.WINDOW
    #: Further detectors by name: each adds an array<ENTITY> column of the name it is given.
    plugins: dict[str, Detector] = field(default_factory=dict)


def from_recognizer(found: Column, text: Column, labels: dict[str, str | None], source: str, least: float = RECOGNIZER_FLOOR) -> Column:
    """An outside recognizer's (label, start, end, score) as entities: mapped, weak and unmapped ones dropped, resolved."""
    known = {k: v for k, v in labels.items() if v}

    def kind(s):
        out = None
        for k, v in known.items():
            out = F.when(s["label"] == k, v) if out is None else out.when(s["label"] == k, v)
        return out if out is not None else F.lit(None).cast("string")

    kept = F.filter(found, lambda s: kind(s).isNotNull() & (s["score"] >= least))
    made = F.transform(kept, lambda s, i: entity(ord=i, start=s["start"], end=s["end"], type=kind(s), score=s["score"], source=F.lit(source), text=slice_text(text, s["start"], s["end"]), presidio_label=s["label"]))
    return resolve(normalize(text, made))


def key_of(e: Column) -> Column:
    return F.concat_ws(":", e["start"].cast("string"), e["end"].cast("string"), e["type"])


class Pipeline:
    def __init__(self, config: Config | None = None):
        self.config = config or Config()
        known = {"rules", *self.config.plugins}
        for name in self.config.engines:
            if name not in known:
                warnings.warn(f"no detector {name!r}; going on without it", stacklevel=2)
        self.engines = [n for n in self.config.engines if n in known]

    def _with_lang(self, docs: DataFrame) -> DataFrame:
        docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
        found = language(F.col("text"))
        return docs.withColumn("lang", F.coalesce("lang", found) if "lang" in docs.columns else found)

    def detect(self, docs: DataFrame) -> DataFrame:
        """docs(doc_id, text[, lang]) with lang and one array of entities per engine."""
        c = self.config
        docs = self._with_lang(docs)
        for name in self.engines:
            into = f"_{name}"
            docs = rules.detect(docs, width=c.context_window, into=into) if name == "rules" else c.plugins[name](docs, into)
        return docs

    def fuse(self, docs: DataFrame) -> DataFrame:
        """From `detect`: entities, fused, calibrated and unified."""
        every = F.concat(*[F.col(f"_{n}") for n in self.engines]) if self.engines else F.array().cast(f"array<{ENTITY}>")
        docs = docs.withColumn("_all", every)
        docs = docs.withColumn("_fused", fusion.fuse(F.col("_all")))
        docs = docs.withColumn("_calibrated", calibration.apply(F.col("_fused"), self.config.calibrator))
        return docs.withColumn("entities", routing.unify(F.col("_calibrated"))).drop("_all", "_fused", "_calibrated")

    def transform(self, docs: DataFrame) -> DataFrame:
        """docs(doc_id, text[, lang]) with lang, entities, redacted_text, replacements, leaks, stats."""
        c = self.config
        if self.engines == ["rules"] and not c.calibrator.fitted and type(c.policy) is routing.Policy:
            return self._in_one_loop(docs)
        return self.transform_in_expressions(docs)

    def _in_one_loop(self, docs: DataFrame) -> DataFrame:
        """`transform` for rules alone and scores as they are, in one pass of Python workers."""
        c = self.config
        ship(docs.sparkSession)
        run = docloop.over_batches(rules.RULES, c.context_window, rules.BIRTH, c.policy, c.mode, c.key)
        docs = self._with_lang(docs).withColumn("_way", F.arrow_udf(run, docloop.DDL).asNondeterministic()("text", "lang"))
        way = F.col("_way")
        told = (*ruleloop.TYPES, *docloop.MORE)

        def whole(e):
            group = F.concat(F.lit("rules|"), e["type"])
            fixed = {"source": F.lit("rules"), "detectors": F.array(F.lit("rules")), "n_agreeing": F.lit(1), "agreement": F.lit(False), "conflicting_types": F.array().cast("array<string>"), "raw_scores": F.array(F.struct(F.lit("rules").alias("source"), e["raw_score"].alias("score")))}
            return entity(**{k: e[k] for k in told}, **fixed, calibration_group=group, calibrated=F.lit(False), group_calibrated=group.isin(*c.calibrator.groups) if c.calibrator.groups else F.lit(False))

        n = way["n_entities"]
        rate = F.round(F.when(n > 0, way["n_review"] / n).otherwise(F.lit(0.0)), 4)
        stats = self._told(*[way[k] for k in docloop.COUNTS], rate, way["by_type"], F.struct(n.alias("rules")))
        docs = docs.withColumn("entities", F.transform(way["entities"], whole)).withColumn("leaks", way["leaks"]).withColumn("stats", stats)
        return docs.withColumn("n_discarded_values", way["n_discarded"]).withColumn("redacted_text", way["redacted_text"]).withColumn("replacements", way["replacements"]).drop("_way")

    def transform_in_expressions(self, docs: DataFrame) -> DataFrame:
        """`transform` for any engines and curves; what the loop is held against."""
        c = self.config
        docs = self.fuse(self.detect(docs))
        counts = F.struct(*[F.size(f"_{n}").alias(n) for n in self.engines]) if self.engines else F.lit(None)
        docs = docs.withColumn("_counts", counts).drop(*[f"_{n}" for n in self.engines])
        docs = docs.withColumn("entities", routing.route(F.col("entities"), c.policy))
        docs = docs.withColumn("_acted", F.filter("entities", lambda e: e["decision"] != routing.DISCARD))
        docs = docs.withColumn("_swept", rewriting.sweep(F.col("text"), F.col("_acted")))
        docs = docs.withColumn("_out", rewriting.redact(F.col("text"), F.col("_swept"), F.col("lang"), c.mode, c.key))
        docs = docs.withColumn("leaks", rewriting.leaks(F.col("_out"))).withColumn("stats", self._stats(F.col("entities"), F.col("_counts")))
        kept = F.filter("entities", lambda e: e["decision"] == routing.DISCARD)
        docs = docs.withColumn("n_discarded_values", F.size(kept)).withColumn("redacted_text", F.col("_out.redacted_text")).withColumn("replacements", F.col("_out.replacements"))
        return docs.drop("_acted", "_swept", "_out", "_counts")

    def _stats(self, entities: Column, counts: Column) -> Column:
        def of(d):
            return F.size(F.filter(entities, lambda e: e["decision"] == d))

        n = F.size(entities)
        kinds = F.array_distinct(F.transform(entities, lambda e: e["type"]))
        by_type = F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(entities, lambda e: e["type"] == k))))
        rate = F.round(F.when(n > 0, of(routing.REVIEW) / n).otherwise(F.lit(0.0)), 4)
        return self._told(n, of(routing.AUTO), of(routing.REVIEW), of(routing.DISCARD), rate, by_type, counts)

    def _told(self, n: Column, auto: Column, review: Column, discarded: Column, rate: Column, by_type: Column, counts: Column) -> Column:
        return F.struct(n.alias("n_entities"), auto.alias("n_auto_redacted"), review.alias("n_review"), discarded.alias("n_discarded"), rate.alias("review_rate"), by_type.alias("by_type"), counts.alias("detections_per_engine"), F.array(*map(F.lit, self.engines)).cast("array<string>").alias("engines"), F.lit(self.config.mode).alias("redaction_mode"))

    def review_items(self, result: DataFrame, created_at: Column | None = None) -> DataFrame:
        return review.items(result, "entities", created_at)


def with_decision(entities: Column, decision: str) -> Column:
    return F.filter(entities, lambda e: e["decision"] == decision)


def decisions(entities: Column) -> Column:
    """start:end:type -> decision."""
    return F.map_from_entries(F.transform(entities, lambda e: F.struct(key_of(e).alias("key"), e["decision"].alias("value"))))


def audit(result: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, text, redacted_text, audit JSON) of each document."""
    body = F.struct(F.col("doc_id").cast("string").alias("document_id"), F.col("lang").alias("language"), "stats", "leaks", "entities", F.filter("entities", lambda e: e["decision"] == routing.REVIEW).alias("review_items"))
    return result.select("doc_id", *keep, "text", "redacted_text", F.to_json(body).alias("audit"))


def totals(result: DataFrame) -> DataFrame:
    """The corpus's routing figures, summed up."""
    s = F.col("stats")
    sums = result.agg(*[F.coalesce(F.sum(s[c]), F.lit(0)).alias(c) for c in ("n_entities", "n_auto_redacted", "n_review", "n_discarded")], F.coalesce(F.sum(F.size("leaks")), F.lit(0)).alias("verbatim_leaks"))
    n = F.col("n_entities")
    return sums.select("*", F.round(F.when(n > 0, F.col("n_review") / n).otherwise(F.lit(0.0)), 4).alias("review_rate"), F.round(F.when(n > 0, F.col("n_auto_redacted") / n).otherwise(F.lit(0.0)), 4).alias("auto_rate"))


@dataclass(frozen=True)
class System:
    """A detection system: DataFrame -> DataFrame with `pred`. Those of one `family` share what their engines find."""

    pipeline: Pipeline
    family: object
    swept: bool = False

    def pred(self, found: DataFrame, into: str = "pred") -> DataFrame:
        """From the engines' columns, which stay."""
        p = self.pipeline
        out = found.withColumn("entities", F.col("_rules")) if p.engines == ["rules"] else p.fuse(found)
        if self.swept:
            out = out.withColumn("entities", rewriting.sweep(F.col("text"), F.col("entities")))
        return out.withColumn(into, spans(F.col("entities"))).drop("entities")

    def __call__(self, docs: DataFrame) -> DataFrame:
        return self.pred(self.pipeline.detect(docs)).drop(*[f"_{e}" for e in self.pipeline.engines])


def systems(plugins: dict[str, Detector], calibrator: calibration.Calibrator | None = None) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Detection systems by name, each DataFrame -> DataFrame with `pred`; those of absent plugins are left out."""
    family = object()

    def system(*engines: str, swept: bool = False) -> System:
        return System(Pipeline(Config(engines=engines, plugins=plugins, calibrator=calibrator or calibration.Calibrator())), family, swept)

    out = {"rules": system("rules")}
    for name in plugins:
        out[name] = system(name)
        out[f"rules+{name}"] = system("rules", name)
    if plugins:
        out["ensemble"] = system("rules", *plugins, swept=True)
    return out


def _predicted(gold: DataFrame, ladder: dict[str, System]) -> DataFrame:
    """(gold's columns, system, pred) of systems of one family: each engine reads a document once, however many systems it is in."""
    widest = next(iter(ladder.values())).pipeline.config
    engines = tuple(dict.fromkeys(e for s in ladder.values() for e in s.pipeline.engines))
    docs = Pipeline(replace(widest, engines=engines)).detect(gold)
    for i, s in enumerate(ladder.values()):
        docs = s.pred(docs, f"_pred{i}")
    every = F.array(*[F.struct(F.lit(name).alias("system"), F.col(f"_pred{i}").alias("pred")) for i, name in enumerate(ladder)])
    return docs.select(*gold.columns, F.explode(every).alias("_s")).select(*gold.columns, "_s.system", "_s.pred")


def compare_systems(gold: DataFrame, ladder: dict[str, Callable[[DataFrame], DataFrame]], mode: str = "exact") -> DataFrame:
    """gold(doc_id, text, lang, gold) -> a row for each system with its figures."""
    families: dict[int, dict[str, System]] = {}
    parts = []
    for name, run in ladder.items():
        if isinstance(run, System):
            families.setdefault(id(run.family), {})[name] = run
        else:
            parts.append(run(gold).withColumn("system", F.lit(name)))
    parts += [_predicted(gold, f) for f in families.values()]
    out = None
    for part in parts:
        rows = figures(aligned(part, mode), "system")
        out = rows if out is None else out.unionByName(rows)
    return out


def highlight(text: Column, entities: Column) -> Column:
    """The text with entities in <mark> elements; those that begin inside the last one are left out."""

    def safe(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def step(acc, e):
        new = F.concat(acc["out"], safe(slice_text(text, acc["at"], e["start"])), F.lit('<mark title="'), e["type"], F.lit('">'), safe(slice_text(text, e["start"], e["end"])), F.lit("</mark>"))
        return F.when(e["start"] >= acc["at"], F.struct(e["end"].alias("at"), new.alias("out"))).otherwise(acc)

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(entities, zero, step, lambda acc: F.concat(acc["out"], safe(F.substring(text, acc["at"] + 1, F.length(text)))))
