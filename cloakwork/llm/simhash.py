"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints within `radius` bits of each other are linked; a group is all that links reach. Equal
fingerprints are one to begin with, so a group of copies is one row from then on. Each distinct
fingerprint goes to one bucket for every choice of AGREE of the BLOCKS blocks of its bits: with
radius <= BLOCKS - AGREE two linked fingerprints agree on such a choice and meet. In a bucket the
fingerprints are laid down as bit planes, in blocks of SLICE; a fingerprint is held against a whole
block at once by adding, plane by plane, the differing bits to carry-save counters that are bitwise
integers themselves, and leaves the block as soon as all in it exceed the radius. What a fingerprint
links with leaves the block's open set, so a bucket gives one edge per fingerprint at most and
never its pairs. Short buckets share a block, which is held against itself shifted by 1, 2, ...
places. Buckets of very many members are cut into parts, and each pair of parts is a group.

`stage` links by similarity of the sets of five-word shingles, SIMILAR or more, which is further apart than 64
bits and equal blocks can tell: its fingerprints have 64 * WIDE bits, each distinct shingle counted once, and
its buckets are bands of minimum hashes. Texts of equal sets are one to begin with; the others' fingerprints are
held against the bucket's bit planes as above, with WIDE_RADIUS, and of those within it the sets themselves are
compared: they decide. Only texts that share a band with another set are sent there. What a text links with
leaves the bucket.

Defined results: a null text counts as empty; a text without words has fingerprint zero, and is
linked like any other. Rows that repeat a doc_id are each returned, with the same component; a null
doc_id takes part and comes out with its group's component_id, which is null only if no document of
the group has an id. Extra columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXT_ROWS, components, discard, in_parts, marked, materialize, memory, numbered, scratch, slices, table

BLOCKS, AGREE = 6, 2
#: Fingerprints in a block of bit planes.
SLICE = 4096
#: Buckets of up to so many fingerprints share blocks and are compared with their neighbours at all distances.
SHORT = 32
#: Members of a bucket that meet in one group: fingerprints, and sets of shingles.
MOST_FINGERPRINTS, MOST_SETS = 1 << 16, 2048
SEED = 42

#: Shared shingles over all shingles of a link.
SIMILAR = 0.8
#: A pair of similarity 0.8 shares one of the bands with probability 0.995.
BANDS, BAND_ROWS = 18, 6
#: Words of a wide fingerprint. Of its 256 bits a pair of similarity 0.8 differs in 38.8, give or take 5.7, and in 48 and
#: 6.2 at worst (4 of 5 shingles); unrelated sets in 128 and 8 (110 for four shingles). The radius is 6 deviations above the worst.
WIDE, WIDE_RADIUS = 4, 88


def shingle_hashes(data: bytes, shingle: int, most: int = 1 << 16) -> Iterator[np.ndarray]:
    """XXH64 of the lower-cased text's word shingles, in arrays of `most` at most."""
    words = data.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    stops = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]) - 1
    h = xxhash.xxh64_intdigest
    for lo in range(0, n, most):
        yield np.array([h(text[a:b], SEED) for a, b in zip(begins[lo : min(n, lo + most)].tolist(), stops[lo : lo + most].tolist())], np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set, from the highest."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprint(data: bytes, shingle: int = 4) -> int:
    """64 bits, each set if it is set in more than half of the hashes of the lower-cased text's word shingles."""
    total, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(data, shingle):
        total += _ones(hashes)
        n += len(hashes)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1)


def shingle_set(data: bytes, shingle: int = 5) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    parts = [np.unique(h) for h in shingle_hashes(data, shingle)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def sketch(hashes: np.ndarray) -> tuple[int, int, list[int]]:
    """Of a shingle set: 128 bits that tell it from others, and the keys of the bands of minimum hashes; all signed."""
    lowest = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 2048):
        lowest = np.minimum(lowest, (hashes[lo : lo + 2048, None] * _MINS).min(axis=0))
    whole = xxhash.xxh3_128_digest(hashes.tobytes())
    bands = [xxhash.xxh3_64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(lowest.reshape(BANDS, BAND_ROWS))]
    return int.from_bytes(whole[:8], "big", signed=True), int.from_bytes(whole[8:], "big", signed=True), bands


_SPREAD, _MINS = _odd(WIDE, 1), _odd(BANDS * BAND_ROWS, 2)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE longs of a shingle set: bits set in more than half of as many further hashes of each shingle."""
    total = np.zeros((WIDE, 64), np.int64)
    for lo in range(0, len(hashes), 2048):
        h = hashes[lo : lo + 2048]
        for i, odd in enumerate(_SPREAD):
            x = (h ^ h >> np.uint64(31)) * odd
            total[i] += _ones((x ^ x >> np.uint64(29)) * _SPREAD[i - 1])
    return np.packbits(total * 2 > len(hashes), axis=1).view(">u8")[:, 0].astype(np.uint64)


def similar_edges(sets: list[np.ndarray], fps: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (index, index) that join all sets of a bucket which links of SIMILAR or more reach.

    A search like that of `bucket_edges`: the open sets within WIDE_RADIUS are found in bit planes, which are
    made anew when half of the sets are gone; of those the sets decide. fps: the sets' wide fingerprints.
    """
    fps = np.stack([wide_fingerprint(x) for x in sets]) if fps is None else fps
    lens = np.array([len(x) for x in sets])
    values = [int.from_bytes(row.tobytes(), "little") for row in np.ascontiguousarray(fps, "<u8")]
    open_ = np.ones(len(sets), bool)
    edges: list[tuple[int, int]] = []
    blocks: list[tuple[np.ndarray, _Planes]] = []
    left, laid = len(sets), len(sets) * 2

    for root in range(len(sets)):
        if not open_[root]:
            continue
        open_[root] = False
        left -= 1
        todo = [root]
        while todo and left:
            if left * 2 <= laid:
                at, laid = np.flatnonzero(open_), left
                blocks = [(at[lo : lo + SLICE], _Planes(fps[at[lo : lo + SLICE]])) for lo in range(0, left, SLICE)]
            one = todo.pop()
            for at, planes in blocks:
                still = int.from_bytes(np.packbits(open_[at], bitorder="little").tobytes(), "little")
                near = at[_members(planes.near(values[one], WIDE_RADIUS, still))] if still else at[:0]
                # a much smaller or larger set can't be similar; in whole numbers: 4 / 5 exactly is a link
                near = near[np.minimum(lens[near], lens[one]) * 10 >= round(SIMILAR * 10) * np.maximum(lens[near], lens[one])]
                shared = _shared(sets[one], [sets[i] for i in near])
                found = near[shared * 10 >= round(SIMILAR * 10) * (lens[near] + lens[one] - shared)]
                open_[found] = False
                left -= len(found)
                todo += found.tolist()
                edges += [(int(i), root) for i in found]
    return edges


def _shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members of a sorted set each of the others holds."""
    if not others or not len(one):
        return np.zeros(len(others), np.int64)
    keys = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, keys), len(one) - 1)
    held = np.concatenate(([0], np.cumsum(one[at] == keys)))
    ends = np.cumsum([len(x) for x in others])
    return held[ends] - held[np.concatenate(([0], ends[:-1]))]


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp long); fp holds the 64 bits, signed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint((t or "").encode(), shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _bounds() -> list[tuple[int, int]]:
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def bucket_keys(fp: str = "fp"):
    """An array of one long for each choice of AGREE blocks: the choice's number and the chosen bits."""
    keys = []
    for number, chosen in enumerate(combinations(_bounds(), AGREE)):
        bits = F.lit(number).cast("long")
        for lo, hi in chosen:
            bits = F.shiftleft(bits, hi - lo).bitwiseOR(F.shiftrightunsigned(F.col(fp), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)))
        keys.append(bits)
    return F.array(*keys)


class _Planes:
    """A block of fingerprints (a row of longs each) as bit planes, each an integer with one bit for every fingerprint."""

    def __init__(self, fps: np.ndarray):
        bits = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
        rows = np.packbits(bits.T, axis=1, bitorder="little")
        self.planes = [int.from_bytes(row.tobytes(), "little") for row in rows]
        self.all = (1 << len(fps)) - 1

    def near(self, fp: int, radius: int, open_: int) -> int:
        """The fingerprints of the open set within the radius, as a bit set."""
        return self._within((p ^ self.all if fp >> k & 1 else p for k, p in enumerate(self.planes)), radius, open_)

    def near_shifted(self, shift: int, radius: int, open_: int) -> int:
        """The fingerprints of the open set within the radius of the one `shift` places after them."""
        return self._within((p ^ p >> shift for p in self.planes), radius, open_)

    def _within(self, differing: Iterator[int], radius: int, open_: int) -> int:
        """Where at most `radius` of the planes are set, within the open set: carry-save counters over all at once."""
        counters = [0] * max(1, radius.bit_length())
        over = ~open_
        flip = self.all
        for k, carry in enumerate(differing):
            for i, c in enumerate(counters):
                if not carry:
                    break
                counters[i], carry = c ^ carry, c & carry
            over |= carry
            if k >= radius and not ~over & flip:  # the counters are over or all exceed the radius
                return 0
            if k % 8 == 7:
                over |= _above(counters, radius, flip)
                if not ~over & flip:
                    return 0
        return ~(over | _above(counters, radius, flip)) & flip


def _above(counters: list[int], radius: int, flip: int) -> int:
    """Bits whose counter exceeds the radius."""
    more, same = 0, flip
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            same &= counters[i]
        else:
            more |= same & counters[i]
            same &= ~counters[i]
    return more


def _members(bits: int) -> list[int]:
    out = []
    while bits:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out


def bucket_edges(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (index, index) that join all fingerprints of a bucket which links reach: a search that
    takes each fingerprint out of the open sets once it is found. fps: longs, or a row of longs each."""
    fps = fps.reshape(len(fps), -1)
    values = [int.from_bytes(row.tobytes(), "little") for row in np.ascontiguousarray(fps, "<u8")]
    blocks = [(lo, _Planes(fps[lo : lo + SLICE])) for lo in range(0, len(fps), SLICE)]
    open_ = [p.all for _, p in blocks]
    edges = []
    for root in range(len(values)):
        if not open_[root // SLICE] >> root % SLICE & 1:
            continue
        open_[root // SLICE] ^= 1 << root % SLICE
        todo = [root]
        while todo:
            fp = values[todo.pop()]
            for b, (lo, planes) in enumerate(blocks):
                if open_[b] and (found := planes.near(fp, radius, open_[b])):
                    open_[b] ^= found
                    for i in _members(found):
                        todo.append(lo + i)
                        edges.append((lo + i, root))
    return edges


def packed_edges(fps: np.ndarray, sizes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (index, index) that join the fingerprints of each of many short buckets, laid one after another.

    They share blocks of bit planes: the planes are held against themselves shifted by 1, 2, ... places,
    so that every pair of a bucket is compared in a few operations for all buckets of the block.
    """
    fps = fps.reshape(len(fps), -1)
    edges: list[tuple[int, int]] = []
    stops = np.cumsum(sizes)
    bucket = 0
    lo = 0
    while bucket < len(sizes):
        last = max(bucket + 1, int(np.searchsorted(stops, lo + SLICE, "right")))
        hi = int(stops[last - 1])
        block, own = _Planes(fps[lo:hi]), sizes[bucket:last]
        ends = np.repeat(np.cumsum(own), own)
        root = list(range(hi - lo))
        for shift in range(1, int(own.max())):
            paired = np.arange(hi - lo) + shift < ends  # of one bucket
            mask = int.from_bytes(np.packbits(paired, bitorder="little").tobytes(), "little")
            for i in _members(block.near_shifted(shift, radius, mask)):
                a, b = i, i + shift
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                if a != b:
                    root[max(a, b)] = min(a, b)
                    edges.append((lo + i + shift, lo + i))
        bucket, lo = last, hi
    return edges


def links(fps: DataFrame, radius: int, columns: list[str]) -> DataFrame:
    """(key, i, j, `columns` with the distinct fingerprints' bits, node) -> edges (u, v) between nodes that meet in a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # of the last group, which may go on

        def close(key, i, j, node, *words):
            fp = np.stack(words, axis=1).view(np.uint64)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            begins = np.concatenate(([0], cuts))
            sizes = np.diff(np.concatenate((begins, [len(key)])))
            edges: list[tuple[int, int]] = []
            short = (sizes > 1) & (sizes <= SHORT)
            if short.any():
                at = np.flatnonzero(np.repeat(short, sizes))
                edges += [(int(at[a]), int(at[b])) for a, b in packed_edges(fp[at], sizes[short], radius)]
            for k in np.flatnonzero(sizes > SHORT).tolist():
                lo = int(begins[k])
                edges += [(lo + a, lo + b) for a, b in bucket_edges(fp[lo : lo + int(sizes[k])], radius)]
            ends = np.array(edges, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(node[ends[:, 0]]), pa.array(node[ends[:, 1]])], ["u", "v"])

        for batch in batches:
            cols = tuple(np.asarray(c) for c in batch.columns)
            if not len(cols[0]):
                continue
            other = (cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1])
            last = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if held and not last and all(held[0][k][0] == cols[k][-1] for k in range(3)):
                held.append(cols)
                continue
            whole = [*held, tuple(c[:last] for c in cols)]
            held = [tuple(c[last:] for c in cols)]
            yield close(*(np.concatenate(c) for c in zip(*whole, strict=True)))
        if held:
            yield close(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return fps.select("key", "i", "j", "node", *columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "u long, v long")


def groups(distinct: DataFrame, edges: DataFrame, spark: SparkSession, columns: list[str]) -> DataFrame:
    """distinct(`columns`, low, node) -> (`columns`, root, component_id), written: the smallest doc_id that edges between nodes reach.

    Members and roots are written before they are joined: a group of very many is then split.
    """
    found = components(spark, edges)
    member = distinct.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    member = materialize(member.select(*columns, "low", F.coalesce("root", "node").alias("root")), spark)
    low = materialize(member.groupBy("root").agg(F.min("low").alias("component_id")), spark)
    out = materialize(member.join(low, "root").select(*columns, "root", "component_id"), spark, 1)
    for x in (found, member, low):
        discard(x, spark)
    return out


def simhash_groups(docs: DataFrame, spark: SparkSession, radius: int = 4, shingle: int = 4) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp, component_id), a row for each row."""
    if radius > BLOCKS - AGREE:
        raise ValueError(f"the blocks find pairs within {BLOCKS - AGREE} bits")
    fps = materialize(fingerprints(docs, shingle), spark)
    with scratch(spark):
        distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")).withColumn("node", F.col("fp")), spark)
        met = in_parts(distinct.select(F.explode(bucket_keys()).alias("key"), "fp", "node"), spark, MOST_FINGERPRINTS)
        edges = materialize(links(met, radius, ["fp"]), spark)
        found = groups(distinct, edges, spark, ["fp"])
    return fps.join(found, "fp").select("doc_id", "fp", "component_id")


def _similar_links(sets: DataFrame) -> DataFrame:
    """(key, i, j, node, fp binary, hashes binary) -> edges (u, v) between nodes that meet in a group and are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, fps, held = None, [], [], []

        def close() -> pa.RecordBatch:
            edges = similar_edges(held, np.frombuffer(b"".join(fps), "<u8").reshape(-1, WIDE)) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in edges], pa.int64()), pa.array([nodes[j] for _, j in edges], pa.int64())], ["u", "v"])

        for batch in batches:
            for *group, node, fp, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != now:
                    yield close()
                    now, nodes, fps, held = group, [], [], []
                nodes.append(node)
                fps.append(fp)
                held.append(np.frombuffer(hashes, np.uint64))
        yield close()

    return sets.select("key", "i", "j", "node", "fp", "hashes").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "u long, v long")


def similar_rows(rows: DataFrame, spark: SparkSession, shingle: int = 5) -> DataFrame:
    """Written rows (row, doc_id, text) -> (row, doc_id, root, component_id): groups by similarity of shingles, SIMILAR or more.

    root names a group; component_id, its smallest doc_id, is null if no row of the group has one.
    """

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory("simhash")
        for batch in slices(batches, "text"):
            found = [sketch(shingle_set((t or "").encode(), shingle)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)), pa.array([f[2] for f in found], pa.list_(pa.int64()))], ["row", "doc_id", "k0", "k1", "keys"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingle_set((t or "").encode(), shingle) for t in batch.column(1).to_pylist()]
            fps = [wide_fingerprint(x).astype("<u8").tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "fp", "hashes"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    fps = materialize(rows.select("row", "doc_id", "text").mapInArrow(sketched, f"row long, doc_id {kind}, k0 long, k1 long, keys array<long>"), spark, rows=TEXT_ROWS)
    with scratch(spark):
        distinct = materialize(fps.groupBy("k0", "k1").agg(F.min("doc_id").alias("low"), F.min("keys").alias("keys"), F.min("row").alias("node")), spark)
        met = distinct.select(F.explode("keys").alias("key"), "node")
        # Buckets of one are left out, and all but one of those with the same members.
        marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"m{i}") for i in (0, 1)]
        buckets = met.groupBy("key").agg(F.count("*").alias("n"), *marks).where("n > 1").groupBy("n", "m0", "m1").agg(F.min("key").alias("key"))
        buckets = materialize(buckets.select("key"), spark)
        met = materialize(met.join(buckets, "key"), spark)
        # The texts that share a band, and few others: their sets alone are shuffled.
        near = marked(rows.select("row", "text"), "row", met.select("node").distinct(), "_maybe").where("_maybe")
        sets = materialize(near.select("row", "text").mapInArrow(shingled, "node long, fp binary, hashes binary"), spark, rows=TEXT_ROWS)
        edges = materialize(_similar_links(in_parts(met, spark, MOST_SETS).join(sets, "node")), spark, rows=TEXT_ROWS)
        found = groups(distinct.drop("keys"), edges, spark, ["k0", "k1"])
    return fps.join(found, ["k0", "k1"]).select("row", "doc_id", "root", "component_id")


def similar_groups(docs: DataFrame, spark: SparkSession, shingle: int = 5) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, component_id), a row for each row."""
    rows = numbered(docs.select("doc_id", "text"), spark)
    return similar_rows(rows.select("row", "doc.doc_id", "doc.text"), spark, shingle).select("doc_id", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(table(spark, sf_dir, "documents"), spark)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, that with the smallest doc_id; five-word shingles.

    A row without an id stays only if no row of its group has one, and then one row of the group does.
    Of rows that repeat a kept doc_id one stays.
    """
    rows = numbered(docs, spark)
    with scratch(spark):
        found = materialize(similar_rows(rows.select("row", "doc.doc_id", "doc.text"), spark).select("row", "doc_id", "root"), spark)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
        kept = materialize(found.groupBy("root").agg(first).select("first.*"), spark)
        named = kept.where("doc_id is not null").groupBy("doc_id").agg(F.min("row").alias("row")).select("row")
        kept = named.unionByName(kept.where("doc_id is null").select("row"))
        dropped = materialize(found.select("row").join(kept, "row", "left_anti"), spark, 1)
    # Only what the filter names is looked up: the texts that stay are not shuffled.
    rows = marked(rows, "row", dropped, "_maybe")
    unsure = rows.where("_maybe").join(dropped.hint("shuffle_hash"), "row", "left_anti")
    return rows.where("not _maybe").unionByName(unsure).select("doc.*")
