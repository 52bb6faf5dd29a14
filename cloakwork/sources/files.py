"""Reading and writing: raw corpora, annotated JSON lines, plain texts, examples and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,type:string,text:string>>"
ANNOTATED = f"id string, lang string, text string, entities {SPANS}"
SYNTHETIC = f"{ANNOTATED}, doc_type string, locale string"


def raw_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def land_corpus(raw: DataFrame, path: str) -> None:
    """The rows and columns that later steps need, as Parquet."""
    from ..operators.corpus import ingest

    ingest(raw).write.mode("overwrite").parquet(path)


def annotated(spark: SparkSession, path: str, synthetic: bool = False) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped."""
    rows = spark.read.schema(SYNTHETIC if synthetic else ANNOTATED).json(path)
    return rows.where("id is not null or text is not null")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files (.txt, .md, or a glob) as doc_id and text; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def examples(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """The first document of each doc_type and language."""
    nth = F.row_number().over(Window.partitionBy("doc_type", "lang").orderBy(order))
    return docs.withColumn("_n", nth).where("_n = 1").drop("_n")


def write_examples(result: DataFrame, path: str) -> None:
    """Input, redacted text and audit of each example."""
    from ..plans.pipeline import audit

    name = F.concat_ws("_", "doc_type", "lang")
    rows = audit(result, "doc_type", "lang").select(name.alias("name"), "text", "redacted_text", "audit")
    rows.write.mode("overwrite").partitionBy("name").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A report's table; reports have a row per system or kind."""
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(str(v) for v in r) + " |" for r in rows])


def entities_table(result: DataFrame) -> DataFrame:
    """A row per entity, for spreadsheets."""
    e = F.col("e")
    return result.select("doc_id", F.explode("entities").alias("e")).select("doc_id", e["type"].alias("type"), e["text"].alias("text"), e["start"].alias("start"), e["end"].alias("end"), F.round(e["score"], 4).alias("score"), e["source"].alias("source"), e["decision"].alias("decision"), F.array_join(e["decision_reasons"], "; ").alias("reasons"))
