"""Language identification with error-correcting output codes.

Every learned language owns a codeword; every bit of the codewords has a binary n-gram classifier
that tells the languages whose bit is one from the others. A text is given the language whose
codeword loses least against the classifiers' margins, each bit weighted by how well its classifier
separates the training languages. The texts of all labelled training rows are used: they are only
summed up per language, in each task first, so nothing but one vector per language is gathered.

Defined results: a text that is null or has no letter is `und` with score 0; without any labelled
training text everything is `und`; with one language every text with a letter is given it. Ties go
to the smaller language. Empty tables give empty results; extra columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXT_ROWS, batch_rows, memory, slices, table

#: Buckets of hashed byte n-grams (1 to 4 bytes share them).
BUCKETS = 1 << 14
#: Bytes of a text that are counted at a time.
STEP = 1 << 18
#: Codeword bits for more languages than exhaustive codes serve.
BITS_PER_DOUBLING = 12
UNKNOWN = "und"
#: A text whose nearest codeword is wrong in a bit is identified from this share of the votes on.
IDENTIFIED_FROM = 0.8
#: A text below that is still kept, as a mixture of learned languages, if its n-grams' mean familiarity reaches this.
FAMILIAR_FROM = 1.5


def _counts(data: bytes) -> np.ndarray:
    """How often each bucket is met by the n-grams of a text: lower-case bytes, white space and punctuation as one blank."""
    b = _FOLD[np.frombuffer(data, np.uint8)]
    out = np.zeros(BUCKETS, np.int64)
    for lo in range(0, len(b), STEP):  # the n-grams that begin in a step
        code = part = b[lo : lo + STEP + 3].astype(np.uint32)
        out += np.bincount(part[:STEP], minlength=BUCKETS)
        for n in (2, 3, 4):
            if len(part) < n:
                break
            code = code[:-1] * np.uint32(257) + part[n - 1 :]
            out += np.bincount((code[:STEP] * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(18), minlength=BUCKETS)
    return out


def _fold() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    fold[[c for c in range(128) if not (chr(c).isalpha())]] = 32
    return fold


_FOLD = _fold()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> the n-gram counts of each language in this task."""
    memory("langid")
    sums: dict[str, np.ndarray] = {}
    for batch in slices(batches, "text"):
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text.encode())
        for lang, texts in by_lang.items():
            got = _counts(b"  ".join(texts))
            sums[lang] = sums[lang] + got if lang in sums else got
    rows = [(k, i, int(v[i])) for k, v in sums.items() for i in np.flatnonzero(v)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "bucket", "n"])


@dataclass
class CodeModel:
    """Languages, their codewords (+1/-1), the classifiers' weights by bit and bucket, and the bits' weights."""

    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    alpha: np.ndarray
    #: By bucket, the log of how much likelier it is in the learned languages than any bucket by chance.
    familiar: np.ndarray
    #: Below this share of the votes the nearest codeword is called ambiguous.
    ambiguous_below: float = 0.5

    def _margin(self, data: bytes) -> np.ndarray:
        counts = _counts(data)
        return self.weights @ counts / max(1, counts.sum()) * self.bias

    def identified(self, data: bytes) -> bool:
        """Whether the decoding holds: no classifier speaks against the nearest codeword, or its share of the votes
        is IDENTIFIED_FROM or more. One bit alone (two languages) has only the votes; one language takes all. A text that mixes learned
        languages fails that, yet its n-grams are familiar (FAMILIAR_FROM): it stays."""
        lang, vote, _ = self.decide(data)
        if vote >= IDENTIFIED_FROM:
            return True
        code = self.codes[self.langs.index(lang)]
        if len(code) > 1 and not (code * self._margin(data) < 0).any():
            return True
        counts = _counts(data)
        return float(self.familiar @ counts / max(1, counts.sum())) >= FAMILIAR_FROM

    def decide(self, data: bytes) -> tuple[str, float, bool]:
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        margin = self._margin(data)
        loss = (self.alpha * np.log1p(np.exp(-self.codes * margin))).sum(axis=1)
        vote = np.exp(-(loss - loss.min()))
        vote /= vote.sum()
        best = int(np.argmin(loss))
        return self.langs[best], float(vote[best]), bool(vote[best] < self.ambiguous_below)


def codewords(n: int) -> np.ndarray:
    """Exhaustive codes up to seven languages; beyond, the best of a few seeded random dense codes."""
    if n <= 7:
        cols = [[1 if i == 0 or not (c >> (i - 1)) & 1 else -1 for i in range(n)] for c in range(1, 2 ** (n - 1))]
        return np.array(cols, np.float64).T
    bits = BITS_PER_DOUBLING * int(np.ceil(np.log2(n)))
    tries = [np.where(np.random.default_rng(s).random((n, bits)) < 0.5, -1.0, 1.0) for s in range(16)]
    apart = [min((bits - t @ t[i])[np.arange(n) != i].min() for i in range(n)) if n <= 512 else 0 for t in tries]
    code = tries[int(np.argmax(apart))]
    return code[:, np.abs(code.sum(axis=0)) < n]


def train(docs: DataFrame) -> CodeModel:
    """Fit on all rows of docs(lang, text); what reaches the driver is BUCKETS counts for each language at most."""
    batch_rows(docs.sparkSession, TEXT_ROWS)
    sums = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(_sums, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r[0] for r in sums})
    counts = np.zeros((len(langs), BUCKETS))
    at = {k: i for i, k in enumerate(langs)}
    for lang, bucket, n in sums:
        counts[at[lang], bucket] = n
    if len(langs) < 2:
        return CodeModel(langs, np.ones((len(langs), 1)), np.zeros((1, BUCKETS)), np.ones(1), np.ones(1), np.zeros(BUCKETS))
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    codes = codewords(len(langs))
    weights = np.stack([np.log(share[c > 0].mean(axis=0)) - np.log(share[c < 0].mean(axis=0)) for c in codes.T])
    margins = weights @ share.T  # of each bit on each language's own distribution
    weights -= ((margins * (codes.T > 0)).sum(axis=1) / (codes > 0).sum(axis=0) + (margins * (codes.T < 0)).sum(axis=1) / (codes < 0).sum(axis=0))[:, None] / 2
    margins = weights @ share.T * codes.T
    scale = 4.0 / np.maximum(1e-6, np.abs(margins).mean(axis=1))
    alpha = np.clip(margins.min(axis=1) * scale / 4.0, 0.05, 1.0)
    return CodeModel(langs, codes, weights, scale, alpha, np.log(share.mean(axis=0) * BUCKETS))


def predict(docs: DataFrame, model: CodeModel, key: str = "doc_id") -> DataFrame:
    """(key, text) -> (key, lang_pred, score, ambiguous); the text alone decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x bits x BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory("langid")
        m = shared.value
        for batch in slices(batches, "text"):
            got = [m.decide(t.encode()) if m.langs and t and any(map(str.isalpha, t)) else (UNKNOWN, 0.0, True) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got]), pa.array([g[1] for g in got]), pa.array([g[2] for g in got])], ["key", "lang_pred", "score", "ambiguous"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("key", key)


def held_out(column: str, folds: int, fold: int):
    """Whether crc32 of the id as text leaves this remainder (null ids: never)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds == fold, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out("doc_id", 4, 2)).select("lang", "text"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents without a letter and those that no learned language's codeword fits; keep all others as they are."""
    model = train(docs.where(~held_out("doc_id", 4, 2)).select("lang", "text"))
    return keep_identified(docs, model)


def keep_identified(docs: DataFrame, model: CodeModel) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory("langid")
        m = shared.value
        for batch in slices(batches, "text"):
            ok = [bool(m.langs and t and any(map(str.isalpha, t)) and m.identified(t.encode())) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
