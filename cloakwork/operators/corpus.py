"""Building an annotated corpus: cleaning, balanced samples, splits and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.findall import slice_text
from ..functions.scores import overlaps
from ..functions.taxonomy import map_label
from .spans import by

CLEAN = "struct<start:int,end:int,type:string,text:string>"
LANGUAGES = {"English": "en", "Spanish": "es"}


def language_code(name: Column) -> Column:
    return F.when(name == "English", "en").when(name == "Spanish", "es").otherwise("en")


def ingest(raw: DataFrame) -> DataFrame:
    """The raw rows in our languages, and only the columns that later steps read: both reach the scan."""
    return raw.where(F.col("language").isin(*LANGUAGES)).select("source_text", "privacy_mask", "language")


def _reason(a: Column, text: Column) -> Column:
    label = F.upper(F.trim(a["label"]))
    bad = (a["start"] < 0) | (a["end"] > F.length(text)) | (a["start"] >= a["end"])
    return F.when(map_label(a["label"]).isNull(), label).when(bad, F.concat(F.lit("__bad_offset__"), label)).when(slice_text(text, a["start"], a["end"]) != a["value"], F.concat(F.lit("__offset_mismatch__"), label))


def clean(raw: DataFrame) -> DataFrame:
    """raw(source_text, privacy_mask, language, ...) with lang, text, entities (first of overlapping ones, longest first) and dropped, the reasons."""
    text = F.col("source_text")
    judged = F.transform("privacy_mask", lambda a: F.struct(a.alias("a"), _reason(a, text).alias("why")))
    rows = raw.where(F.trim(text) != "").withColumn("_judged", judged)
    fine = F.transform(F.filter("_judged", lambda j: j["why"].isNull()), lambda j: F.struct(j["a"]["start"].cast("int").alias("start"), j["a"]["end"].cast("int").alias("end"), map_label(j["a"]["label"]).alias("type"), j["a"]["value"].alias("text")))
    kept = F.aggregate(by(fine, lambda e: e["start"], lambda e: e["start"] - e["end"]), F.array().cast(f"array<{CLEAN}>"), lambda acc, e: F.when(F.exists(acc, lambda k: overlaps(k, e)), acc).otherwise(F.concat(acc, F.array(e))))
    return rows.withColumn("lang", language_code(F.col("language"))).withColumn("text", text).withColumn("entities", kept).withColumn("dropped", F.transform(F.filter("_judged", lambda j: j["why"].isNotNull()), lambda j: j["why"])).drop("_judged")


def dropped_labels(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(F.explode("dropped").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def balanced_sample(rows: DataFrame, limit: int, key: str = "id", seed: int = 13, strata: str = "lang") -> DataFrame:
    """limit // strata rows of each stratum, chosen and ordered by a seeded hash; everything if the limit allows."""
    n, k = rows.agg(F.count("*"), F.count_distinct(strata)).first()
    order = F.xxhash64(F.lit(seed), F.col(key))
    if limit >= n:
        return rows.withColumn("_o", order).orderBy("_o", key).drop("_o")
    nth = F.row_number().over(Window.partitionBy(strata).orderBy(order, key))
    return rows.withColumn("_n", nth).where(F.col("_n") <= limit // max(1, k)).withColumn("_o", order).orderBy("_o", key).limit(limit).drop("_n", "_o")


def carve(rows: DataFrame, train: int, validation: int, key: str = "id", seed: int = 13) -> DataFrame:
    """The first rows by a seeded hash are `train`, the next `validation`; the others go."""
    order = F.xxhash64(F.lit(seed), F.col(key))
    chosen = rows.withColumn("_o", order).orderBy("_o", key).limit(train + validation)
    nth = F.row_number().over(Window.orderBy("_o", key))  # over the chosen rows alone
    return chosen.withColumn("split", F.when(nth <= train, "train").otherwise("validation")).drop("_o")


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    """docs, entities, docs without any, of each key."""
    return rows.groupBy(*keys).agg(F.count("*").alias("docs"), F.sum(F.size("entities")).alias("entities"), F.count_if(F.size("entities") == 0).alias("docs_without_pii"))


def type_counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.explode("entities").alias("e")).groupBy(*keys, F.col("e.type").alias("type")).agg(F.count("*").alias("n"))


def label_inventory(raw: DataFrame, key: str = "id") -> DataFrame:
    """Each raw label's count and its first value, by the key and the place."""
    rows = raw.select(F.col(key).alias("key"), F.posexplode("privacy_mask").alias("pos", "a"))
    return rows.groupBy(F.col("a.label").alias("label")).agg(F.count("*").alias("n"), F.min_by("a.value", F.struct("key", "pos")).alias("example"))


def crosstab(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return rows.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)
