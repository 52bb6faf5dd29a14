"""Removal of repeated substrings: every byte under a WIDTH-byte string that starts earlier too.

Equal strings must meet without moving each of them. Every WIDTH-byte window names an anchor, the
leftmost of its GRAM-byte grams with the least hash, so equal windows name anchors of equal content
at equal places. The windows that name one anchor are consecutive; they and their bytes are the
anchor's context. First, contexts of equal anchor and equal bytes are compared by hash: all but the
earliest repeat an earlier string in all their windows. Then the earliest contexts of anchors that
have several different ones are cut out of the texts and sorted: their windows are suffixes of one
buffer, in order by a merge sort whose comparisons find the common extension of two suffixes by
binary search over prefix polynomial hashes, in a logarithm of their length. A window whose own hash
occurs once among those of its anchor equals no other and is left out of the sort. Neighbours with
a common extension of WIDTH bytes are verified byte by byte; in each run of equal ones all but the
earliest window repeat.

Contexts of anchors with over HOT_CONTEXTS different ones go window by window, dealt by the window,
so that no group holds more than repeats of one string.

Defined results: a null text has 0 bytes; documents are ordered by doc_id, then by the hash of their
text where ids repeat; equal rows of one id are one document, searched once, and each row gets its
result; a null id comes before all others. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, slices, table

WIDTH, GRAM = 100, 20
SPAN = WIDTH - GRAM + 1  # grams of a window
HOT_CONTEXTS = 4096
#: Bytes of contexts that are sorted at a time.
CHUNK = 4 << 20
SEGMENT = (1 << 20) - 1
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(x: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = x
        out = np.multiply.accumulate(out)
    return out


class PrefixHash:
    """Polynomial hashes of all prefixes of a buffer, modulo 2**64; a substring's comes from two of them."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.inverse = _powers(INVERSE, len(data) + 1)
        terms = (data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(data))
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.inverse[start]

    def extension(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """The common extension of the suffixes at a and b, `most` bytes at most: binary search over the hashes."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.of(a, mid) == self.of(b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def after(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Whether the suffix at a comes after that at b, by `most` bytes."""
        n = self.extension(a, b, most)
        end = np.minimum(n, most - 1)
        return (n < most) & (self.data[a + end] > self.data[b + end])


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's bytes: each anchor's hash and place, its first window and the number of its windows."""
    n = len(data) - WIDTH + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    parts = []
    for lo in range(0, n, SEGMENT - WIDTH):
        part = data[lo : lo + SEGMENT]
        hashes = PrefixHash(part)
        grams = _mix(hashes.of(np.arange(len(part) - GRAM + 1), GRAM))
        low = (grams & ~np.uint64(SEGMENT)) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equal ones
        width = 1
        while width * 2 <= SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if SPAN > width:
            low = np.minimum(low[: width - SPAN], low[SPAN - width :])
        at = (low & np.uint64(SEGMENT)).astype(np.int64)[: SEGMENT - WIDTH]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        count = np.diff(np.concatenate((first, [len(at)])))
        parts.append((grams[at[first]], at[first] + lo, first + lo, count))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tie, text) -> a row for each of a text's contexts: (anchor, content, doc, tie, place, stop).

    place: first window << 16 | the anchor's place behind it << 8 | windows. What repeats within the text is joined to runs that have no
    content but a stop; their anchor only deals them.
    """
    for batch in slices(batches, "text", 4 << 20):
        out: list[list[np.ndarray]] = [[] for _ in range(8)]
        for doc, tie, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = (text or "").encode()
            grams, at, first, count = anchors(np.frombuffer(raw, np.uint8))
            if not len(first):
                continue
            stop = first + count + WIDTH - 1
            content = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)], np.uint64)
            order = np.lexsort((first, content, grams))
            again = np.zeros(len(first), bool)
            again[order[1:]] = (grams[order[1:]] == grams[order[:-1]]) & (content[order[1:]] == content[order[:-1]])
            own = ~again
            a, z = first[again], stop[again]
            new = np.concatenate(([True], a[1:] > np.maximum.accumulate(z)[:-1])) if len(a) else np.zeros(0, bool)
            a, z = a[new], np.maximum.reduceat(z, np.flatnonzero(new)) if len(z) else z
            n, m = int(own.sum()), len(a)
            for col, v in zip(out, (
                np.concatenate((grams[own], _mix(a.astype(np.uint64) + np.uint64(tie & 0xFFFF) + np.uint64(doc or 0)))).view(np.int64),
                np.concatenate((content[own], np.zeros(m, np.uint64))).view(np.int64),
                np.concatenate((np.zeros(n, bool), np.ones(m, bool))),
                np.full(n + m, doc or 0, np.int64),
                np.full(n + m, doc is None),
                np.full(n + m, tie, np.int64),
                np.concatenate((first[own] << 16 | (at - first)[own] << 8 | count[own], a << 16)),
                np.concatenate((np.zeros(n, np.int64), z)),
            ), strict=True):
                col.append(v)
        if out[0]:
            anchor, content, run, doc, no_doc, tie, place, stop = (np.concatenate(c) for c in out)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(content, mask=run), pa.array(doc, mask=no_doc), pa.array(tie), pa.array(place), pa.array(stop, mask=~run)], ["anchor", "content", "doc", "tie", "place", "stop"])


def sorted_runs(hashes: PrefixHash, starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order by group and their first WIDTH bytes, and whether each equals the one before it.

    A merge sort from below: at each level every element finds its place among its sibling run by
    binary search, all at once; elements of different groups never change places.
    """
    order = np.argsort(group, kind="stable")
    starts_, group_ = starts[order], group[order]
    begin = np.flatnonzero(np.concatenate(([True], group_[1:] != group_[:-1])))
    size = np.diff(np.concatenate((begin, [len(group_)])))
    base, n = np.repeat(begin, size), np.repeat(size, size)
    at = np.arange(len(starts_)) - base  # within the group
    width, most = 1, int(size.max(initial=1))
    suffix = starts_.copy()
    while width < most:
        live = np.flatnonzero(n > width)
        run = at[live] // width
        left = run % 2 == 0
        other = base[live] + (run + np.where(left, 1, -1)) * width  # the sibling run's begin
        stop = np.minimum(other + width, base[live] + n[live])
        lo, hi = np.zeros(len(live), np.int64), np.maximum(0, stop - other)
        while (open_ := lo < hi).any():
            k = np.flatnonzero(open_)
            mid = (lo[k] + hi[k]) >> 1
            mine, its = suffix[live[k]], suffix[other[k] + mid]
            # A left element passes those strictly before it, a right one also its equals.
            later = np.where(left[k], hashes.after(mine, its, WIDTH), ~hashes.after(its, mine, WIDTH))
            lo[k], hi[k] = np.where(later, mid + 1, lo[k]), np.where(later, hi[k], mid)
        pair = base[live] + run // 2 * 2 * width
        to = pair + (at[live] - run * width) + lo
        moved, moved_order = suffix[live], order[live]
        suffix[to], order[to] = moved, moved_order
        width *= 2
    same = np.zeros(len(suffix), bool)
    if len(suffix) > 1:
        k = np.flatnonzero(group_[1:] == group_[:-1]) + 1
        k = k[hashes.extension(suffix[k], suffix[k - 1], WIDTH) >= WIDTH]
        for lo in range(0, len(k), 1 << 16):  # verified: the bytes themselves
            part = k[lo : lo + (1 << 16)]
            step = np.arange(WIDTH)
            same[part] = (hashes.data[suffix[part][:, None] + step] == hashes.data[suffix[part - 1][:, None] + step]).all(axis=1)
    return order, same


def repeats(keys: np.ndarray, data: np.ndarray, lens: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts in order of their documents and places, sorted by key, their bytes one after another in `data`: the
    windows that repeat an earlier one of their key, as (context, offset), and whether a first window comes from each context.

    begin: the anchor's place in each context; equal windows have it at the same place, so key and place deal them.
    """
    windows = lens - WIDTH + 1
    hashes = PrefixHash(data)
    context = np.repeat(np.arange(len(lens)), windows)
    inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = np.repeat(np.cumsum(lens) - lens, windows) + inner
    of_key = np.cumsum(np.concatenate(([0], keys[1:] != keys[:-1])))
    group = of_key[context] * (2 * WIDTH) + begin[context] - inner
    # A window of a hash that its group has once is the first of its string: it needs no place in the order.
    print_ = _mix(hashes.of(starts, WIDTH) ^ _mix(group.astype(np.uint64) + BASE))
    order = np.argsort(print_)
    again = np.zeros(len(order), bool)
    equal = print_[order[1:]] == print_[order[:-1]]
    again[order[1:]] |= equal
    again[order[:-1]] |= equal
    fresh = np.zeros(len(lens), bool)
    fresh[context[~again]] = True
    live = np.flatnonzero(again)
    place, same = sorted_runs(hashes, starts[live], group[live])
    place = live[place]
    fresh[context[place[~same]]] = True
    found = np.sort(place[same])
    return context[found], inner[found], fresh


def _sort_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, tie, first, anchor_at, bytes) by key, doc, tie, first -> runs of repeated windows as (doc, tie, start, stop)."""
    rows: list[pa.RecordBatch] = []
    kept: pa.RecordBatch | None = None  # of the key that goes on: contexts with a first window
    size = 0

    def close() -> pa.RecordBatch:
        nonlocal rows, kept, size
        seen = kept.num_rows if kept is not None else 0
        both = pa.Table.from_batches([kept, *rows] if seen else rows).combine_chunks().to_batches()[0]
        rows, size = [], 0
        key, doc, tie, first, at = (np.asarray(c.fill_null(0)) for c in both.columns[:5])
        no_doc = np.asarray(both.column(1).is_null())
        part = both.column(5)
        ends = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        data = np.frombuffer(part.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        context, inner, fresh = repeats(key, data, np.diff(ends), at)
        new = context >= seen
        context, inner = context[new], inner[new]
        head = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | (inner[1:] != inner[:-1] + 1)))) if len(context) else context
        tail = np.concatenate((head[1:], [len(context)])) - 1 if len(head) else head
        c = context[head]
        start = first[c] + inner[head]
        stop = first[c] + inner[tail] + WIDTH
        kept = both.take(pa.array(np.flatnonzero(fresh & (key == key[-1]))))
        return pa.RecordBatch.from_arrays([pa.array(doc[c], mask=no_doc[c]), pa.array(tie[c]), pa.array(start), pa.array(stop)], ["doc", "tie", "start", "stop"])

    for batch in batches:
        for part in slices(iter([batch]), "bytes", CHUNK):
            rows.append(part)
            size += part.column(5).nbytes
            if size >= CHUNK:
                yield close()
    if rows:
        yield close()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tie, text, wanted: structs of anchor, place and whether it is hot) -> the contexts' rows for sorting."""
    for batch in slices(batches, "text", 4 << 20):
        out: list[list] = [[], [], [], [], [], []]
        key, docs, ties, first, at, parts = out
        wanted = batch.column(3)
        own = np.diff(np.asarray(wanted.offsets))
        flat = wanted.flatten()
        anchor, place, hot = (np.asarray(flat.field(k)).tolist() for k in range(3))
        i = 0
        for doc, tie, text, n in zip(*(c.to_pylist() for c in batch.columns[:3]), own.tolist(), strict=True):
            raw = (text or "").encode()
            for k in range(i, i + n):
                begin, count = place[k] >> 16, place[k] & 255
                context = raw[begin : begin + count + WIDTH - 1]
                if hot[k]:
                    windows = [context[i : i + WIDTH] for i in range(count)]
                    key += [xxhash.xxh3_64_intdigest(w) - 2**63 for w in windows]
                    first += range(begin, begin + count)
                    at += [0] * count
                    parts += windows
                else:
                    key.append(anchor[k])
                    first.append(begin)
                    at.append(place[k] >> 8 & 255)
                    parts.append(context)
            docs += [doc] * (len(parts) - len(docs))
            ties += [tie] * (len(parts) - len(ties))
            i += n
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 5 else pa.binary()) for k, c in enumerate(out)], ["key", "doc", "tie", "first", "anchor_at", "bytes"])


def _rewrite(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, cuts) -> the figures and, if asked for, the bytes that stay."""
    for batch in slices(batches, "text", 4 << 20):
        out: list[list] = [[], [], [], [], []]
        for text, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = (text or "").encode()
            spans: list[list[int]] = []
            for a, b in sorted((c["start"], c["stop"]) for c in cuts or ()):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            stays, at = [], 0
            for a, b in spans:
                stays.append(raw[at:a])
                at = b
            stays.append(raw[at:])
            kept = b"".join(stays)
            for col, v in zip(out, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if keep else None), strict=True):
                col.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, spark: SparkSession, keep: bool = True, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary if `keep`)."""
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    tie = F.xxhash64("text") if repeated else F.lit(0).cast("long")  # only ids that repeat need one
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), tie.alias("tie"), "text")
    once = rows.dropDuplicates(["doc", "tie"]) if repeated else rows
    contexts = once.mapInArrow(_contexts, "anchor long, content long, doc long, tie long, place long, stop long")
    # Equal contexts: all but the earliest are cut whole. One shuffle, by anchor; a frequent one is streamed from disk.
    equal = Window.partitionBy("anchor", "content").orderBy("doc", "tie", "place")
    marked = contexts.withColumn("nth", F.row_number().over(equal))
    marked = marked.withColumn("contents", F.sum((F.col("nth") == 1).cast("int")).over(Window.partitionBy("anchor")))
    found = F.col("stop").isNotNull() | (F.col("nth") > 1)
    unsure = F.col("stop").isNull() & (F.col("nth") == 1) & (F.col("contents") > 1)
    begin = F.shiftright("place", 16)
    stop = F.coalesce("stop", begin + F.col("place").bitwiseAND(255) + (WIDTH - 1))
    marked = marked.where(found | unsure).select("doc", "tie", F.when(found, begin).alias("start"), F.when(found, stop).alias("stop"), F.when(~found, F.struct("anchor", "place", (F.col("contents") > hot_contexts).alias("hot"))).alias("want"))
    with scratch(spark):
        marked = materialize(marked, spark)
        # The earliest of several different contexts of an anchor: cut out and sorted.
        wants = marked.where("want is not null").groupBy("doc", "tie").agg(F.collect_list("want").alias("wanted"))
        cut = _of(once, wants, "wanted").mapInArrow(_cut, "key long, doc long, tie long, first long, anchor_at long, bytes binary")
        again = cut.repartition("key").sortWithinPartitions("key", "doc", "tie", "first").mapInArrow(_sort_contexts, "doc long, tie long, start long, stop long")
        cuts = marked.where("want is null").select("doc", "tie", "start", "stop").unionByName(again)
        cuts = materialize(cuts.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("cuts")), spark, 1)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _of(rows, cuts, "cuts", "left").drop("tie").mapInArrow(lambda batches: _rewrite(batches, keep), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumn("doc_id", F.col("doc_id").cast(kind))


def _of(rows: DataFrame, per_doc: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """The documents with what was gathered for each; ids without a null are a plain key."""
    p = per_doc.select(F.col("doc").alias("_doc"), F.col("tie").alias("_tie"), column)
    same = (F.coalesce("doc", F.lit(0)) == F.coalesce("_doc", F.lit(0))) & (F.col("doc").isNull() == F.col("_doc").isNull()) & (F.col("tie") == F.col("_tie"))
    return rows.join(p, same, how).select("doc", "tie", "text", column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), spark, keep=False).drop("kept")
