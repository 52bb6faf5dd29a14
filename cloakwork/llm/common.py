"""What the corpus operators share: tables, the shared folder, streamed Arrow batches, buckets, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local run has one of its own; a cluster can't go on."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cloakwork-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows of an Arrow batch: of tables that hold texts or sets of shingles, and of others.
TEXT_ROWS, ROWS = 1000, 10_000


def batch_rows(spark: SparkSession, rows: int) -> None:
    """Rows of the Arrow batches that the JVM and Python workers exchange from now on: each side holds whole batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def give_back() -> None:
    """Memory that is free in this process goes back to the system, which else sees it as taken."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc alone
        ctypes.CDLL(None).malloc_trim(0)


#: What operators keep in a Python worker from task to task.
_MEMORY: dict[str, dict] = {}


def memory(owner: str) -> dict:
    """An operator's own memory in this Python worker; what other operators left there goes, for workers outlive their stages."""
    others = [k for k in _MEMORY if k != owner]
    for k in others:
        _MEMORY.pop(k).clear()
    if others:
        gc.collect()
        give_back()
    return _MEMORY.setdefault(owner, {})


#: The tables written within each open `scratch`.
_SCRATCH: list[list[DataFrame]] = []


def materialize(df: DataFrame, spark: SparkSession, outlives: int = 0, rows: int = ROWS) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives a lost executor. The table outlives so many `scratch`.
    rows: of an Arrow batch on the way."""
    path = f"{shared_dir(spark)}/cloakwork/{uuid.uuid4().hex}"
    batch_rows(spark, rows)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cloakwork_path = path
    if len(_SCRATCH) > outlives:
        _SCRATCH[-1 - outlives].append(out)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables written within, at the end; what is to last is written after it, or in an outer one."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for df in _SCRATCH.pop():
            discard(df, spark)


def packed(docs: DataFrame) -> Column:
    """All columns as one, so that no name of the input can clash with one added to it."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def numbered(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """(row, doc): docs, packed and written with a number for each row."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), packed(docs)), spark)


def discard(df: DataFrame, spark: SparkSession) -> None:
    """Delete what `materialize` wrote; nothing may read it after."""
    path = getattr(df, "_cloakwork_path", None)
    if path:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Bits of the filter that `marked` broadcasts, whatever the size of the tables: 2 ** 18 rows of a long.
FILTER_BITS = 1 << 24


def marked(rows: DataFrame, key: str, ids: DataFrame, into: str) -> DataFrame:
    """rows with a boolean column that is true wherever the long `key` is in ids' only column, and seldom elsewhere.

    A filter of FILTER_BITS bits is broadcast: what it leaves out needs no join and its columns no
    shuffle; what it lets through is for an exact join. The more ids, the more it lets through.
    """
    name = ids.columns[0]

    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))

    words = ids.select(place(name).alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 as int))")).alias("_bits"))
    found = rows.join(F.broadcast(words), F.shiftright(place(key), 6) == F.col("_word"), "left")
    hit = F.expr(f"(_bits & shiftleft(1L, cast(pmod(xxhash64({key}), {FILTER_BITS}L) & 63 as int))) <> 0")
    return found.withColumn(into, F.coalesce(hit, F.lit(False))).drop("_word", "_bits")


def in_parts(met: DataFrame, spark: SparkSession, most: int) -> DataFrame:
    """(key, node, ...) -> the same with (part, i, j): buckets of over `most` rows are cut into parts, and each pair
    of parts (i, j), or part for itself (i, i), is a group of its own. So no group has over about 2 * `most` rows and
    all that share a bucket still meet."""
    big = materialize(met.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("parts")), spark)
    if fits_broadcast(big, 24):
        big = F.broadcast(big)
    out = met.join(big, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    out = out.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return out.withColumn("i", F.least("part", "_other")).withColumn("j", F.greatest("part", "_other")).drop("parts", "_other")


def fits_broadcast(df: DataFrame, row_bytes: int, limit: int = 16 << 20) -> bool:
    """Whether a materialized table is within the stated size for a broadcast."""
    return df.count() * row_bytes <= limit


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut where `column`'s bytes add up to `most`, so that long texts don't pile up."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lens = np.asarray(pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0))
        ends = np.cumsum(lens)
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right"))
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges (u, v longs) -> (node, root): root is the smallest node reachable. Nodes without edges don't occur.

    Alternating large-star and small-star rounds: each is a minimum by node (combined before the
    shuffle) and a join back to the edges, so no group is ever gathered. Both sides of a join are
    written tables, so that adaptive execution can split a node of very many edges. The loop ends
    when a round changes nothing.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), spark)
    before = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before or not now[0]:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
            out._cloakwork_path = e._cloakwork_path
            return out
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), spark)
        # e's v are the smaller ends: only they have larger neighbours.
        large = e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = materialize(large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct(), spark)
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), spark)
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), spark)
        for x in (e, low, large, low2):
            discard(x, spark)
        e = after
