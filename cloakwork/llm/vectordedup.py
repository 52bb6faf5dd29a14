"""Near-duplicate vectors by cross-polytope hashing with multiprobe, every candidate pair verified.

A vector is turned by three rounds of random signs and fast Hadamard transforms; its hash is the
nearest vertex of the cross-polytope, its largest coordinate and that one's sign. TABLES tables each
join HASHES such hashes. A vector is at home in one bucket of each table and probes those whose
vertices come next; a pair is a candidate where one probes the other's home. To the buckets go the classes'
numbers and BITS signs against random planes; vectors follow only to buckets where a mate's signs
differ in few enough places, and there every pair's cosine is computed from the whole vectors. Of
pairs at the least cosine the signs miss about one in 100,000.

Equal vectors, known by two 64-bit hashes, are one class from the start. A bucket yields, for each class, the number of vectors
it newly links there and one edge to its group in the bucket, never the pairs: a pair is counted
only in the first place where it meets, which both codes tell. Buckets of over PART rows are cut
into parts; each pair of parts is a task of its own, so every pair is still compared.

Defined results: vectors that are null, zero or empty or hold a null or a component that is not
finite link with nothing and are their own component; vectors of different lengths don't link.
Rows that repeat a vec_id each keep a row; a null vec_id links like any other and its component
is its group's smallest id. Extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, in_parts, materialize, table

TABLES, HASHES, PROBES = 8, 2, 4
BITS = 128
SIGNS = [f"sign{i}" for i in range(BITS // 64)]
PART = 2048
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform of each row; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def codes(vectors: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """(rows, tables, probes) bucket numbers, the home bucket first, the others by what they lose."""
    n, dim = vectors.shape
    d = 1 << max(1, (dim - 1).bit_length())
    x = np.zeros((n, d))
    x[:, :dim] = vectors
    rng = np.random.default_rng([SEED, d])
    out = np.empty((n, tables, probes), np.int64)
    each = min(probes, d)
    for t in range(tables):
        code, loss = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for _ in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * np.where(rng.random(d) < 0.5, -1.0, 1.0))
            size = np.abs(y)
            best = np.argpartition(-size, each - 1, axis=1)[:, :each]
            top = np.take_along_axis(size, best, 1)
            order = np.argsort(-top, axis=1, kind="stable")
            best, top = np.take_along_axis(best, order, 1), np.take_along_axis(top, order, 1)
            vertex = best * 2 + (np.take_along_axis(y, best, 1) < 0)
            code = (code[:, :, None] * (2 * d) + vertex[:, None, :]).reshape(n, -1)
            loss = (loss[:, :, None] + (top[:, :1] - top)[:, None, :] ** 2).reshape(n, -1)
            keep = np.argsort(loss, axis=1, kind="stable")[:, :probes]
            code, loss = np.take_along_axis(code, keep, 1), np.take_along_axis(loss, keep, 1)
        out[:, t, : code.shape[1]] = code
        out[:, t, code.shape[1] :] = code[:, :1]
    return out


def unit(vectors: list) -> np.ndarray:
    """Vectors of one length, scaled to length 1."""
    v = np.stack([np.asarray(x, np.float64) for x in vectors])
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def signs(units: np.ndarray) -> np.ndarray:
    """(rows, BITS / 64) words: on which side of each of BITS random planes a vector lies."""
    planes = np.random.default_rng([SEED, units.shape[1], BITS]).standard_normal((units.shape[1], BITS))
    return np.packbits(units @ planes >= 0, axis=1).view(np.int64)


def radius(least: float) -> int:
    """Differing signs up to which a pair may have the cosine: each differs with probability angle / pi; 4.5 deviations more."""
    p = np.arccos(least) / np.pi
    return int(np.ceil(BITS * p + 4.5 * np.sqrt(BITS * p * (1 - p))))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, h1, h2, low, m, x) -> the same with the length, the signs and the codes."""
    for batch in batches:
        rows = batch.column("x").to_pylist()
        dims = np.array([len(r) for r in rows])
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            v = unit([rows[i] for i in at])
            c = codes(v).reshape(len(at), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * c.shape[1], pa.int32()), pa.array(c.ravel()))
            part = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(np.full(len(at), dim), pa.int32()), *(pa.array(w) for w in signs(v).T), lists],
                [*part.schema.names, "dim", *SIGNS, "codes"],
            )


def _meets_before(cx: np.ndarray, cy: np.ndarray, t: int) -> np.ndarray:
    """For pairs of codes (pairs, tables, probes): whether a table before t already made them candidates."""
    if not t:
        return np.zeros(len(cx), bool)
    return ((cx[:, :t] == cy[:, :t, :1]).any(axis=2) | (cy[:, :t] == cx[:, :t, :1]).any(axis=2)).any(axis=1)


def bucket_links(t: int, bucket: int, units: np.ndarray, code: np.ndarray, m: np.ndarray, part: np.ndarray, parts: tuple[int, int], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many vectors it newly links here, and the index of its group's first row."""
    n = len(m)
    home = code[:, t, 0] == bucket
    near = np.zeros((n, n), bool)
    h = np.flatnonzero(home)
    near[h] = units[h] @ units.T >= least
    a, b = np.nonzero(near)
    ok = (a != b) & ~(home[b] & (a > b))
    if parts[0] != parts[1]:
        ok &= part[a] != part[b]
    a, b = a[ok], b[ok]
    fresh = np.ones(len(a), bool)
    for lo in range(0, len(a), 1 << 15):
        x, y = code[a[lo : lo + (1 << 15)]], code[b[lo : lo + (1 << 15)]]
        both = (y[:, t, 0] != bucket) & (x[:, t] == y[:, t, :1]).any(axis=1)  # they meet at the other's home too
        fresh[lo : lo + (1 << 15)] = ~_meets_before(x, y, t) & ~(both & (y[:, t, 0] < bucket))
    a, b = a[fresh], b[fresh]
    links = np.bincount(a, m[b], n) + np.bincount(b, m[a], n)
    near[:] = False
    near[a, b] = near[b, a] = True
    root = np.full(n, -1)
    for i in np.unique(np.concatenate((a, b))).tolist():
        if root[i] < 0:
            front = np.array([i])
            root[i] = i
            while len(front):
                front = np.flatnonzero(near[front].any(axis=0) & (root < 0))
                root[front] = i
    return links.astype(np.int64), root


def _groups(close):
    """A mapInArrow function: calls close with the columns of whole groups, which share the first three columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # of the last group, which may go on; 2 * PART rows or a few more
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [_objects(c) if pa.types.is_nested(c.type) else np.asarray(c) for c in batch.columns]
            tail = (cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1])
            last = int(np.flatnonzero(tail)[-1]) + 1 if tail.any() else 0
            if held and not last and all(held[0][k][0] == cols[k][-1] for k in range(3)):
                held.append(cols)
                continue
            yield close([np.concatenate(c) for c in zip(*held, [x[:last] for x in cols], strict=True)])
            held = [[x[last:] for x in cols]]
        if held:
            yield close([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _objects(lists: pa.Array) -> np.ndarray:
    out = np.empty(len(lists), object)
    out[:] = [np.asarray(x.values) for x in lists]
    return out


def _bounds(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups of equal key, i and j begin and end."""
    cuts = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [len(cols[0])]))


def _hopeful(most: int):
    """(key, i, j, part, node, home, signs) -> the rows (key, i, j, part, node) with a mate of few differing signs, either at home.

    Row k is held against row k + step for each step, of all groups of the batch at once.
    """

    def close(cols: list[np.ndarray]) -> pa.RecordBatch:
        home, words = cols[5], cols[6:]
        n = len(home)
        begins, ends = _bounds(cols)
        end = np.repeat(ends, ends - begins)
        hit = np.zeros(n, bool)
        at, step = np.arange(n), 1
        while len(at := at[at + step < end[at]]):
            x = at[home[at] | home[at + step]]
            y = x + step
            differ = sum(np.bitwise_count((w[x] ^ w[y]).view(np.uint64)).astype(np.int32) for w in words)  # signed words are counted by their absolute value
            ok = differ <= most
            hit[x[ok]] = hit[y[ok]] = True
            step += 1
        return pa.RecordBatch.from_arrays([pa.array(c[hit]) for c in cols[:5]], ["key", "i", "j", "part", "node"])

    return _groups(close)


def _verify(least: float):
    """(key, i, j, part, node, m, x, codes) -> (node, links, root): see bucket_links."""

    def close(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, i, j, part, node, m, x, code = cols
        out: list[list] = [[], [], []]
        for lo, hi in zip(*(b.tolist() for b in _bounds(cols)), strict=True):
            if hi - lo < 2:
                continue
            t, bucket = int(key[lo] >> 40) % TABLES, int(key[lo] & ((1 << 40) - 1))
            c = np.stack(code[lo:hi]).reshape(hi - lo, TABLES, -1)
            links, root = bucket_links(t, bucket, unit(x[lo:hi]), c, m[lo:hi], part[lo:hi], (i[lo], j[lo]), least)
            at = np.flatnonzero(root >= 0)
            out[0] += node[lo + at].tolist()
            out[1] += links[at].tolist()
            out[2] += node[lo + root[at]].tolist()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["node", "links", "root"])

    return _groups(close)


def usable(x: str):
    """Vectors that can link: not empty, all components finite, not all zero."""
    v = F.col(x)
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda e: e != 0), F.lit(False))


def near_vectors(rows: DataFrame, spark: SparkSession, least: float = 0.9) -> DataFrame:
    """rows(vec_id, embedding) -> (vec_id, n_links, component_id), a row for each row."""
    ready = rows.select("vec_id", F.col("embedding").alias("x"), usable("embedding").alias("ok"))
    ready = ready.withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64("x", F.lit(SEED))})
    kind = ready.schema["x"].dataType.simpleString()
    classes = ready.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("low"), F.count("*").alias("m"), F.first("x").alias("x"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "low", "m", "x")
    coded = classes.mapInArrow(_coded, f"node long, h1 long, h2 long, low long, m long, x {kind}, dim int, {', '.join(w + ' long' for w in SIGNS)}, codes array<long>")
    coded = materialize(coded, spark)
    # A bucket's key: length, table, number. A class comes to a bucket once, even if it is named twice.
    keys = F.transform("codes", lambda c, i: F.shiftleft(F.col("dim").cast("long") * TABLES + F.floor(i / PROBES).cast("long"), 40).bitwiseOR(c))
    homes = F.filter(keys, lambda k, i: i % PROBES == 0)
    at_home = F.transform(homes, lambda k: F.struct(k.alias("key"), F.lit(True).alias("home")))
    probing = F.transform(F.array_except(keys, homes), lambda k: F.struct(k.alias("key"), F.lit(False).alias("home")))
    keyed = F.concat(at_home, probing)
    met = coded.select(F.explode(keyed).alias("p"), "node", *SIGNS).select("p.key", "node", "p.home", *SIGNS)
    # Signs alone go to all buckets; vectors go only where a mate's signs are near.
    spread = in_parts(met, spark, PART).select("key", "i", "j", "part", "node", "home", *SIGNS)
    hopeful = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_hopeful(radius(least)), "key long, i int, j int, part int, node long")
    hopeful = materialize(hopeful, spark)
    full = hopeful.join(coded.select("node", "m", "x", "codes"), "node").select("key", "i", "j", "part", "node", "m", "x", "codes")
    found = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_verify(least), "node long, links long, root long")
    found = materialize(found, spark)
    discard(hopeful, spark)
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(spark, found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    member = coded.select("node", "h1", "h2", "low", "m").join(linked, "node", "left").join(joined, "node", "left")
    member = member.select("h1", "h2", "low", "m", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    low = member.groupBy("root").agg(F.min("low").alias("component_id"))
    member = member.join(low, "root").select("h1", "h2", (F.col("links") + F.col("m") - 1).alias("n_links"), "component_id")
    alone = ready.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return ready.where("ok").select("vec_id", "h1", "h2").join(member, ["h1", "h2"]).select("vec_id", "n_links", "component_id").unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(table(spark, sf_dir, "embeddings"), spark)
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
