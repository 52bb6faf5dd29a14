"""Language-model scores of texts: a probabilistic suffix tree over bytes, beside word counts.

Both learn from the training texts, whole, with A-Z in lower case and words joined by one blank.

The tree's symbols are SYMBOLS classes of bytes and an end. Counts of every depth + 1 symbols in a
row are summed in each task, then over the corpus; shorter contexts' counts are sums of those. The
depth grows with the training texts (`depth_for`). A context of one to depth symbols is kept if its
next symbols diverge from those of its suffix: the count times the Kullback-Leibler divergence, in
nats, exceeds GAIN. A kept context's distribution is smoothed by that of its longest kept suffix,
with a weight of as many counts as symbols follow it (Witten and Bell); the root's by one for each
symbol. A text's score follows the longest kept suffix of what came
before each symbol and adds the byte's share of its class.

All contexts that pass are kept: the tree is a written table of probabilities, made level by level,
and is never in one place. Texts are dealt into chunks of CHUNK bytes; a chunk's distinct symbol
runs meet the table in a join and come back to the chunk's texts.

The base score adds up log10((c + 1) / (N + V + 1)) over a text's words and one end. Words at least
as frequent as a level that HOT_WORDS or fewer reach are broadcast; all others meet their counts in
a join, which therefore has no frequent key.

Defined results: a null text counts as empty and has the end alone; a null doc_id is in training;
repeated rows each keep a row; without training texts every word is unknown and the tree is its
root; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROWS, TEXT_ROWS, discard, give_back, materialize, slices, table
from .langid import held_out

SYMBOLS, BITS, DEPTH = 64, 6, 4
GAIN, LEAST_COUNT = 2.0, 2
#: Bytes of the texts that share their look-ups in the tree.
CHUNK = 32 << 20
#: Bytes of the texts whose symbols are laid out at a time: their arrays take some sixty times as many.
STEP = 1 << 20
HOT_WORDS = 1 << 17
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 400_000


def _classes() -> np.ndarray:
    """The class of each byte: the end is 0, then blank, letters, digits, marks, other ASCII, and UTF-8's bytes."""
    out = np.full(256, 33, np.uint8)
    out[32] = 1
    out[97:123] = np.arange(2, 28)
    out[48:58] = 28
    out[[33, 34, *range(35, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32
    out[46], out[44], out[33] = 29, 30, 31
    out[0x80:0xA0] = 34 + (np.arange(32) & 1)
    out[0xA0:0xC0] = 36 + np.minimum(np.arange(32), 23)
    out[0xC0:0xE0] = 61
    out[0xC3] = 60
    out[0xE0:0xF0] = 62
    out[0xF0:] = 63
    return out


CLASS = _classes()


def canonical(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def depth_for(symbols: int) -> int:
    """The depth for so many training symbols: a hundred times the text for each further one; DEPTH at least.

    Codes are longs and hold nine symbols and the next one.
    """
    return min(9, max(DEPTH, int(1.4 + math.log(max(1, symbols), 100))))


def _stream(texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all symbols of the texts in turn: the code of depth + 1 symbols that ends there, and the bytes; ends of the texts."""
    joined = [b" ".join(words) for words in texts]
    gap = bytes(depth + 1)  # an end, and the empty past of the next text
    data = np.frombuffer(bytes(depth) + gap[:-1].join(t + b"\0" for t in joined), np.uint8)
    lens = np.array([len(t) + 1 for t in joined])
    starts = depth + np.cumsum(lens + depth) - lens - depth
    sym = CLASS[data]
    sym[data == 0] = 0  # a text's own NUL is an end to the tree
    sym = sym.astype(np.int64)
    code = np.zeros(len(sym) - depth, np.int64)
    for k in range(depth + 1):
        code = code << BITS | sym[k : len(sym) - depth + k]
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
    return code[at - depth], data[at], np.cumsum(lens)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, held_out, text) -> the same with the number of a chunk of CHUNK bytes of text."""
    number, size = TaskContext.get().partitionId() << 32, 0
    for batch in slices(batches, "text", CHUNK // 8):
        if size >= CHUNK:
            number, size = number + 1, 0
        size += batch.column(2).nbytes
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, number))], ["doc_id", "held_out", "text", "chunk"])


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begins and ends of the rows that are alike in all columns."""
    cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(columns[0])], strict=True)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts, of two such. Takes little beyond its result; the larger's counts are written over."""
    (keys, n), (more, more_n) = sorted((a, b), key=lambda x: -len(x[0]))
    at = np.searchsorted(keys, more)
    old = keys[np.minimum(at, len(keys) - 1)] == more
    n[at[old]] += more_n[old]
    at = at[~old]
    return np.insert(keys, at, more[~old]), np.insert(n, at, more_n[~old])


def _counter(depth: int):
    return lambda batches: _count(batches, depth)


def _count(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Texts by chunk -> rows (word or null, gram or null, chunk, n), n counting the training texts alone.

    Gram -1 - b counts byte b; grams of held-out texts alone have n 0. The word of the end is empty.
    """
    words: Counter[bytes] = Counter()
    grams: list[tuple[np.ndarray, np.ndarray]] = []  # each over twice as long as the next
    seen = np.zeros(256, np.int64)
    now = None

    def rows(word, gram, n) -> pa.RecordBatch:
        a = pa.nulls(len(n), pa.string()) if word is None else pa.array(word, pa.string())
        b = pa.nulls(len(n), pa.int64()) if gram is None else pa.array(gram, pa.int64())
        return pa.RecordBatch.from_arrays([a, b, pa.nulls(len(n), pa.int64()) if now is None else pa.array(np.full(len(n), now), pa.int64()), pa.array(n, pa.int64())], ["word", "gram", "chunk", "n"])

    def add(part: tuple[np.ndarray, np.ndarray]) -> None:
        """Merges the part with those before it that are not over twice as long."""
        while grams and len(grams[-1][0]) <= 2 * len(part[0]):
            part = _merged(grams.pop(), part)
        grams.append(part)

    def gram_rows() -> Iterator[pa.RecordBatch]:
        """All grams, in batches of ROWS; a large one would be held whole here and in the JVM."""
        while len(grams) > 1:
            grams.append(_merged(grams.pop(), grams.pop()))
        for keys, n in grams:
            for lo in range(0, len(keys), ROWS):
                yield rows(None, keys[lo : lo + ROWS], n[lo : lo + ROWS])
        grams.clear()
        give_back()

    def word_rows() -> Iterator[pa.RecordBatch]:
        items = iter(words.items())
        while some := list(islice(items, ROWS)):
            yield rows([w.decode() for w, _ in some], None, [n for _, n in some])
        words.clear()

    for batch in slices(batches, "text", STEP):
        chunk, held = np.asarray(batch.column(2)), np.asarray(batch.column(0))
        for lo, hi in _runs(chunk):
            if now != chunk[lo]:
                yield from gram_rows()
            now = int(chunk[lo])
            texts = [canonical(t) for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
            for learn in (True, False):
                chosen = [t for t, h in zip(texts, held[lo:hi].tolist(), strict=True) if h != learn]
                if not chosen:
                    continue
                code, data, _ = _stream(chosen, depth)
                found, n = np.unique(code, return_counts=True)
                add((found, n * learn))
                if learn:
                    for t in chosen:
                        words.update(t)
                    words[b""] += len(chosen)
                    seen += np.bincount(data, minlength=256)
        if len(words) > HELD_WORDS:
            yield from word_rows()
    yield from word_rows()
    yield from gram_rows()
    if seen.any():
        yield rows(None, -1 - np.arange(256), seen)


def _level(table_: DataFrame, value: Column, most: int) -> float:
    """The least power of two (of steps of a quarter for small ones) that `most` or fewer rows' values reach."""
    step = F.floor(F.log2(value) * 4)
    counts = sorted(((r[0], r[1]) for r in table_.groupBy(step.alias("s")).count().collect()), reverse=True)
    total, level = 0, math.inf
    for s, n in counts:
        total += n
        if total > most:
            break
        level = 2.0 ** (s / 4)
    return level


def grow(grams: DataFrame, spark: SparkSession, depth: int = DEPTH) -> DataFrame:
    """(gram, n) of depth + 1 symbols -> (gram, logp, state): log10 of the last symbol's probability after
    the others, and the depth of the kept context that gives it. A gram with n 0 is looked up alone.

    A context's rows are SYMBOLS at most, and so are those of a suffix: neither has a frequent key.
    """
    levels = [materialize(grams.groupBy("gram").agg(F.sum("n").alias("n")), spark)]
    for d in range(depth - 1, -1, -1):
        code = F.col("gram").bitwiseAND((1 << BITS * (d + 1)) - 1)
        levels.append(materialize(levels[-1].groupBy(code.alias("gram")).agg(F.sum("n").alias("n")), spark))
    levels.reverse()
    own = Window.partitionBy(F.shiftright("gram", BITS))
    up = None
    for d, level in enumerate(levels):
        if up is None:
            out = level.withColumn("total", F.sum("n").over(own)).withColumn("p", (F.col("n") + 1.0) / (F.col("total") + SYMBOLS)).withColumn("state", F.lit(0))
        else:
            shorter = F.col("gram").bitwiseAND((1 << BITS * d) - 1)
            out = level.withColumn("up", shorter).join(up.select(F.col("gram").alias("up"), "share", F.col("p").alias("up_p"), F.col("state").alias("up_state")), "up")
            out = out.withColumn("total", F.sum("n").over(own))
            ratio = F.try_divide(F.col("n").cast("double"), F.col("total") * F.col("share"))
            out = out.withColumn("gain", F.sum(F.when(F.col("n") > 0, F.col("n") * F.log(ratio))).over(own))
            kept = F.coalesce((F.col("gain") > GAIN) & (F.col("total") >= LEAST_COUNT), F.lit(False))
            out = out.withColumn("kinds", F.sum((F.col("n") > 0).cast("long")).over(own))
            out = out.withColumn("p", F.when(kept, (F.col("n") + F.col("kinds") * F.col("up_p")) / (F.col("total") + F.col("kinds"))).otherwise(F.col("up_p"))).withColumn("state", F.when(kept, d).otherwise(F.col("up_state")))
        made = materialize(out.select("gram", F.try_divide(F.col("n").cast("double"), F.col("total")).alias("share"), "p", "state"), spark)
        for x in (level, up):
            discard(x, spark)
        up = made
    out = up.select("gram", F.log10("p").alias("logp"), "state")
    out._cloakwork_path = up._cloakwork_path
    return out


def byte_shares(seen: dict[int, int]) -> np.ndarray:
    """log10 of each byte's share of its class."""
    bytes_ = np.array([seen.get(b, 0) + 1.0 for b in range(256)])
    bytes_[0] = 1.0
    groups = CLASS.copy()
    groups[0] = 0
    return np.log10(bytes_ / np.bincount(groups, bytes_, SYMBOLS)[groups])


@dataclass
class WordCounts:
    hot: dict[bytes, int]
    tokens: int
    distinct: int

    def log(self, count: int) -> float:
        return math.log10((count + 1) / (self.tokens + self.distinct + 1))


def score_texts(docs: DataFrame, training: Column, spark: SparkSession) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_tokens, n_known, train_tokens, base_score, score) and whether it is held out."""
    depth = depth_for(docs.where(training).agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", (~training).alias("held_out"), "text").mapInArrow(_chunks, f"doc_id {kind}, held_out boolean, text string, chunk long")
    texts = materialize(texts, spark, rows=TEXT_ROWS)
    learned = materialize(texts.select("held_out", "text", "chunk").mapInArrow(_counter(depth), "word string, gram long, chunk long, n long"), spark, rows=TEXT_ROWS)
    counts = materialize(learned.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), spark)
    tokens, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    level = _level(counts, F.col("n"), HOT_WORDS)
    hot = {r[0].encode(): r[1] for r in counts.where(F.col("n") >= level).collect()}  # HOT_WORDS at most
    seen = {-1 - r[0]: r[1] for r in learned.where("gram < 0").groupBy("gram").agg(F.sum("n")).collect()}
    grams = learned.where("gram >= 0")
    tree = grow(grams.select("gram", "n"), spark, depth)
    model = WordCounts(hot, tokens or 0, distinct or 0)
    shared = spark.sparkContext.broadcast((model, byte_shares(seen)))
    found = grams.select("gram", "chunk").join(tree, "gram").select("chunk", "gram", F.col("logp").cast("float").alias("logp"))
    dealt = texts.withColumn("is_text", F.lit(True)).unionByName(found.withColumn("is_text", F.lit(False)), allowMissingColumns=True)
    dealt = dealt.select("doc_id", "held_out", "text", "chunk", "is_text", "gram", "logp").repartition("chunk").sortWithinPartitions("chunk", "is_text", "gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, byte_logp = shared.value
        logs = {n: model.log(n) for n in {0, *model.hot.values()}}
        end_n = model.hot.get(b"", 0)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        keys = logp = None

        def pieces() -> Iterator[pa.RecordBatch]:
            """The texts, once `keys`, in order, and `logp` hold the look-ups of their chunk."""
            nonlocal parts, keys, logp
            for batch in batches:
                if not batch.num_rows:
                    continue
                is_text = np.asarray(batch.column(4))
                for lo, hi in _runs(np.asarray(batch.column(3)), is_text):
                    part = batch.slice(lo, hi - lo)
                    if not is_text[lo]:
                        keys = logp = None  # the chunk before is through
                        parts.append((np.array(part.column(5)), np.array(part.column(6))))  # copies: the batch goes
                        continue
                    if parts:  # a chunk's look-ups come before its texts
                        some, more = zip(*parts, strict=True)
                        parts = []
                        keys, some = np.concatenate(some), None
                        logp, more = np.concatenate(more), None
                    yield from slices(iter([part]), "text", STEP // 4)  # beside the words and the look-ups

        for batch in pieces():
            texts = [canonical(t) for t in batch.column(2).to_pylist()]
            code, data, ends = _stream(texts, depth)
            order = np.argsort(code)
            at = np.empty(len(code), np.int64)
            at[order] = np.searchsorted(keys, code[order])
            if (keys[np.minimum(at, len(keys) - 1)] != code).any():
                raise AssertionError("a symbol run without its look-up")
            scores = np.add.reduceat(logp[at].astype(np.float64) + byte_logp[data], np.concatenate(([0], ends[:-1])))
            base, sure, rare, times, cuts = [], [], [], [], [0]
            for words in texts:
                total, n = logs[end_n], int(end_n > 0)
                for w, k in Counter(words).items():
                    if (got := model.hot.get(w)) is not None:
                        total += k * logs[got]
                        n += k
                    else:
                        rare.append(w)
                        times.append(k)
                base.append(total)
                sure.append(n)
                cuts.append(len(rare))
            cuts = pa.array(cuts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(w) + 1 for w in texts], pa.int64()), pa.array(sure, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()), pa.ListArray.from_arrays(cuts, pa.array(rare, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32()))],
                ["doc_id", "held_out", "n_tokens", "sure", "base", "score", "rare", "times"],
            )

    rows = dealt.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, sure long, base double, score double, rare array<string>, times array<int>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), spark, rows=TEXT_ROWS)
    for x in (texts, learned, tree):
        discard(x, spark)
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    rare = rare.join(counts.where(F.col("n") < level), "word", "left")
    unit = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(model.tokens + model.distinct + 1)))
    rare = rare.groupBy("row").agg(F.sum(unit * F.col("times")).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    out = rows.drop("rare", "times").join(rare, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("sure") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), ~held_out("doc_id", 7, 2), spark)
