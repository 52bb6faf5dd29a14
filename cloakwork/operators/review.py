"""The review queue: an append-only log of items and verdicts, and its current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.findall import slice_text
from .routing import REVIEW

PENDING, APPROVED, REJECTED = "pending", "approved", "rejected"
CONTEXT = 60
ITEM = "document_id string, entity_type string, text string, start int, end int, score double, reasons array<string>, context string, source string, status string, created_at timestamp, resolved_at timestamp, reviewer_note string"


def context_snippet(text: Column, start: Column, end: Column, width: int = CONTEXT) -> Column:
    """The value in << >> with what stands around it on one line, dots where the text goes on."""
    lo, hi = F.greatest(start - width, F.lit(0)), F.least(end + width, F.length(text))
    shown = F.concat(F.when(lo > 0, "...").otherwise(""), slice_text(text, lo, start), F.lit("<<"), slice_text(text, start, end), F.lit(">>"), slice_text(text, end, hi), F.when(hi < F.length(text), "...").otherwise(""))
    return F.translate(shown, "\n", " ")


def items(docs: DataFrame, entities: str = "entities", created_at: Column | None = None) -> DataFrame:
    """The entities that go to review, an item each."""
    e = F.col("e")
    rows = docs.select(F.col("doc_id").cast("string").alias("document_id"), "text", F.explode_outer(F.filter(entities, lambda x: x["decision"] == REVIEW)).alias("e")).where("e is not null")
    return rows.select(
        "document_id", e["type"].alias("entity_type"), e["text"].alias("text"), e["start"].alias("start"), e["end"].alias("end"), F.round(e["score"], 4).alias("score"), e["decision_reasons"].alias("reasons"),
        context_snippet(F.col("text"), e["start"], e["end"]).alias("context"), e["source"].alias("source"), F.lit(PENDING).alias("status"),
        (created_at if created_at is not None else F.current_timestamp()).alias("created_at"), F.lit(None).cast("timestamp").alias("resolved_at"), F.lit("").alias("reviewer_note"),
    )


def with_ids(found: DataFrame) -> DataFrame:
    """Ids from what an item is about, so that enqueuing it again changes nothing."""
    return found.withColumn("id", F.xxhash64("document_id", "start", "end", "entity_type"))


class ReviewQueue:
    """A folder with two Parquet logs - items and verdicts - and a JSON copy of the items for audits."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, schema in (("items", f"{ITEM}, id long"), ("verdicts", "id long, status string, resolved_at timestamp, reviewer_note string")):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")

    def _log(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def enqueue(self, found: DataFrame) -> int:
        """Add the items whose ids aren't there yet; how many were added."""
        new = with_ids(found).dropDuplicates(["id"]).join(self._log("items").select("id"), "id", "left_anti").select(*self._log("items").columns)
        before = self._log("items").count()
        new.write.mode("append").parquet(f"{self.path}/items")
        added = self._log("items")
        n = added.count() - before
        if n:
            found.write.mode("append").json(f"{self.path}/audit")
        return n

    def resolve(self, verdicts: DataFrame) -> None:
        """verdicts(id, status, resolved_at, reviewer_note): appended; the last one of an item holds."""
        verdicts.select("id", "status", "resolved_at", "reviewer_note").write.mode("append").parquet(f"{self.path}/verdicts")

    def state(self) -> DataFrame:
        return latest(self._log("items"), self._log("verdicts"))

    def pending(self, limit: int = 100) -> DataFrame:
        return pending(self.state(), limit)

    def all_items(self, limit: int = 500) -> DataFrame:
        return newest(self.state(), limit)

    def stats(self) -> DataFrame:
        return stats(self.state())

    def clear(self) -> None:
        for name in ("items", "verdicts"):
            kept = self._log(name).schema
            self.spark.createDataFrame([], kept).write.mode("overwrite").parquet(f"{self.path}/{name}")


def latest(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Items with their last verdict, if any."""
    last = verdicts.groupBy("id").agg(F.max(F.struct("resolved_at", "status", "reviewer_note")).alias("v"))
    rows = found.drop("status", "resolved_at", "reviewer_note").join(last, "id", "left")
    return rows.select(*rows.drop("v").columns, F.coalesce("v.status", F.lit(PENDING)).alias("status"), F.col("v.resolved_at").alias("resolved_at"), F.coalesce("v.reviewer_note", F.lit("")).alias("reviewer_note"))


def pending(state: DataFrame, limit: int = 100) -> DataFrame:
    """The least certain first."""
    return state.where(F.col("status") == PENDING).orderBy("score", "id").limit(limit)


def newest(state: DataFrame, limit: int = 500) -> DataFrame:
    return state.orderBy(F.col("id").desc()).limit(limit)


def stats(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count("*").alias("n"))


def released(docs: DataFrame, state: DataFrame, entities: str = "entities") -> DataFrame:
    """Documents whose entities lack those that a reviewer rejected, to be redacted anew."""
    no = state.where(F.col("status") == REJECTED).groupBy("document_id").agg(F.collect_set(F.struct(F.col("start"), F.col("end"), F.col("entity_type").alias("type"))).alias("_no"))
    rows = docs.join(no, F.col("doc_id").cast("string") == F.col("document_id"), "left").drop("document_id")
    kept = F.filter(F.col(entities), lambda e: ~F.coalesce(F.array_contains(F.col("_no"), F.struct(e["start"].alias("start"), e["end"].alias("end"), e["type"].alias("type"))), F.lit(False)))
    return rows.withColumn(entities, kept).drop("_no")
