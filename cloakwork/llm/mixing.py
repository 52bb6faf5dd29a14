"""Mixing sources to target weights by cube-method balanced sampling.

Each source is to give a target number of words. A document's inclusion is its source's target over
its source's size: the whole part is whole copies, the fraction is an inclusion probability. The
cube method moves a block's probabilities along the null space of its constraints - the expected
number of documents and of words stay what they are - until each step has put one document to 0 or
1 and two at most are left, besides a small reserve that is held back. What is left of a source's
blocks goes through further rounds of blocks until it fits one. There the landing problem is
solved: of the few documents left those are taken whose words come nearest to what is missing.

Blocks are dealt by a hash of the document and so split any source, however large; a block's seed
is its content's, so reruns agree.

Defined results: null text has size 0; a null source is a source of its own, last in order. A
source whose sizes are all 0 has target 0 and nothing taken. Documents that repeat a doc_id are
drawn separately; equal rows may swap their draws. Extra columns are ignored, an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, discard, fits_broadcast, materialize, numbered, scratch, table

WEIGHTS = (5.0, 2.0, 1.0)
#: A document may be taken so many times at most.
MOST = 3.0
#: Documents of a block of the flight, and of those held back for the landing.
BLOCK, RESERVE = 4096, 24
#: Bits of the landing's table of reachable word totals; larger documents are rounded before.
LANDING_BITS = 1 << 22
EPS = 1e-9


def _row(rows: DataFrame) -> list[str]:
    """The number of each row, where rows have one."""
    return [c for c in rows.columns if c == "row"]


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", *_row(docs), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, no target above MOST times its source.

    A row for each source; sources are ranked by code point, then by how soon they reach their
    limit. Below the limit a target is weight times one level for all, found by running totals.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("limit", F.col("source_size") * MOST)
    up_to = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = up_to.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The level is that of the first source that stays below its limit.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), F.col("level").alias("level")))).over(everything)
    return by.select("source", "source_size", F.coalesce(F.least("limit", level["level"] * F.col("weight")), F.col("limit")).alias("target"))


def flight(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: sums of prob and of prob * size are kept, two fractions at most are left."""
    p = prob.tolist()
    s = size.astype(float).tolist()
    todo = [i for i, x in enumerate(p) if EPS < x < 1 - EPS]
    draws = iter(rng.random(len(todo) + 3).tolist())
    active: list[int] = []
    for i in [*todo, None]:
        if i is not None:
            active.append(i)
        while len(active) == 3 or i is None and len(active) == 2 and s[active[0]] == s[active[1]]:
            at = active
            if len(at) == 2:
                u = (1.0, -1.0)
            else:
                a, b, c = (s[k] for k in at)
                u = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
            up = down = float("inf")
            for k, d in zip(at, u, strict=True):
                if d > 0:
                    up, down = min(up, (1 - p[k]) / d), min(down, p[k] / d)
                elif d < 0:
                    up, down = min(up, p[k] / -d), min(down, (1 - p[k]) / -d)
            step = up if next(draws) * (up + down) < down else -down
            left = []
            for k, d in zip(at, u, strict=True):
                x = p[k] + step * d
                p[k] = 0.0 if x <= EPS else 1.0 if x >= 1 - EPS else x
                if 0.0 < p[k] < 1.0:
                    left.append(k)
            active = left
    return np.array(p)


def land(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """0 or 1 for each probability so that the words come nearest to their expectation."""
    out = np.round(prob)
    open_ = [i for i in np.lexsort((np.arange(len(size)), size)).tolist() if EPS < prob[i] < 1 - EPS]
    want = float(sum(prob[i] * size[i] for i in open_))
    small, total = [], 0
    for i in open_:
        if (total + int(size[i])) <= LANDING_BITS or not small:
            small.append(i)
            total += int(size[i])
        else:  # too large for the table
            out[i] = float(rng.random() < prob[i])
            want -= out[i] * size[i]
    reach = [1]
    for i in small:
        reach.append(reach[-1] | reach[-1] << int(size[i]))
    goal = min(max(0, round(want)), total)
    below = (reach[-1] & ((1 << goal + 1) - 1)).bit_length() - 1
    rest = reach[-1] >> goal
    above = goal + (rest & -rest).bit_length() - 1 if rest else below
    now = below if want - below <= above - want else above
    for i, had in zip(reversed(small), reversed(reach[:-1]), strict=True):
        # size 0 can't matter to the words: its probability decides
        take = rng.random() < prob[i] if size[i] == 0 else not had >> now & 1
        out[i] = float(take)
        now -= int(size[i]) if take else 0
    return out


def _block(pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["deal", "size", "doc_id"], kind="stable", ignore_index=True)
    seed = int(pd.util.hash_pandas_object(pdf[["deal", "size"]], index=False).sum() & 0xFFFFFFFF)
    rng = np.random.default_rng(seed)
    p, s = pdf["prob"].to_numpy(float).copy(), pdf["size"].to_numpy()
    n = len(p) - min(len(p), int(pdf["reserve"].iloc[0]))
    p[:n] = flight(p[:n], s[:n], rng)
    return pdf.assign(prob=land(p, s, rng) if last else p)


def _solver(last: bool):
    return lambda pdf: _block(pdf, last).drop(columns=["block", "blocks", "reserve"])


def draw(sized: DataFrame, wanted: DataFrame, spark: SparkSession) -> DataFrame:
    """(doc_id, source, size[, row]) and targets -> the same rows with source_size, target, copies and taken."""
    keys = _row(sized)
    dealt = F.when(F.col("doc_id").isNull(), F.xxhash64("row", F.lit(7))).otherwise(F.xxhash64("doc_id", F.lit(7))) if keys else F.xxhash64("doc_id", F.lit(7))
    wanted = materialize(wanted, spark)
    if fits_broadcast(wanted, 64):
        wanted = F.broadcast(wanted)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.join(wanted, sized.source.eqNullSafe(wanted.source)).drop(wanted.source)
    rows = rows.withColumn("whole", F.floor(ratio + EPS)).withColumn("prob", F.greatest(F.lit(0.0), ratio - F.col("whole")))
    rows = materialize(rows.withColumn("deal", dealt).withColumn("done", F.lit(False)), spark)
    ready, rounds, to_drop = [], 0, [rows]
    schema = rows.schema
    while True:
        # A row for each source: how many blocks its open documents need.
        counts = materialize(rows.groupBy("source").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), spark)
        last = (counts.agg(F.max("n")).first()[0] or 0) <= 2 * BLOCK
        small = F.broadcast(counts) if fits_broadcast(counts, 64) else counts
        blocks = rows.join(small, rows.source.eqNullSafe(small.source)).drop(small.source, "n")
        blocks = blocks.withColumn("reserve", F.ceil(F.lit(RESERVE) / F.col("blocks")).cast("int"))
        blocks = blocks.withColumn("block", F.lit(0) if last else F.pmod(F.xxhash64("deal", F.lit(rounds)), F.col("blocks")).cast("int"))
        moved = blocks.groupBy("source", "block").applyInPandas(_solver(last), schema)
        moved = materialize(moved, spark)
        for x in (*to_drop, counts):
            discard(x, spark)
        if last:
            ready.append(moved)
            break
        settled = (F.col("prob") <= EPS) | (F.col("prob") >= 1 - EPS)
        ready.append(moved.where(settled))
        rows, to_drop, rounds = moved.where(~settled), [], rounds + 1
    out = ready[0]
    for x in ready[1:]:
        out = out.unionByName(x)
    copies = (F.col("whole") + F.round("prob")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source", *keys)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialize(sizes(table(spark, sf_dir, "documents")), spark)
    return draw(sized, targets(sized), spark).select("doc_id", "size", "source_size", "target", "taken", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    rows = numbered(docs, spark)
    with scratch(spark):
        sized = materialize(sizes(rows.select("row", "doc.doc_id", "doc.source", "doc.text")), spark)
        copies = draw(sized, targets(sized), spark).where("copies > 0").select("row", F.col("copies").cast("int").alias("copies"))
        copies = materialize(copies, spark, 1)
    copies = F.broadcast(copies) if fits_broadcast(copies, 24) else copies.hint("shuffle_hash")
    kept = rows.join(copies, "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return kept.select("doc.*")
