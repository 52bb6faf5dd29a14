"""Token ids in succinct files: a wavelet matrix for each shard of documents.

Documents are dealt by ranges of doc_id and sorted; a task encodes its documents one after another
and closes a shard whenever its ids reach SHARD_TOKENS. A shard is one file: a header, the documents'
ids and lengths, and the wavelet matrix of all the shard's ids - for every bit of an id, from the
highest, the bits of the ids in their order at that level, zeros before ones at the next. Each plane
is a zstandard frame of its own, and so is its directory of running counts, which answers rank at
once and select by a search; the header tells where they are, and a reader inflates a plane when it
first asks for it. Access, counts and the places of an id are answered without decoding the ids.

The files are the binary column of a Parquet table in the shared folder (task, number, n_docs,
n_tokens, file), so that any store Spark writes to can hold them and a lost task is written anew.

Encoding works on units that the byte-level pre-tokenizer can't join - a word with its blank, the
rest of a run of white space - and keeps the ids of units it has met; a new one goes to the
tokenizers library. Texts that hold a special token's string, or the separators that engines class
differently, are given to the library whole.

Defined results: a null text counts as empty and has the end id alone; doc_ids that repeat are
ordered by text, null ids come last; extra columns are ignored; an empty table gives no file and an
empty result.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fits_broadcast, materialize, slices, table

END_ID = 2
SHARD_TOKENS = 1 << 21
#: Ones before each such many bits are stored, for rank.
RANK_STEP = 512
MAGIC = b"WVM2"
#: Units kept per worker, twice, and their characters.
KEPT_UNITS, KEPT_CHARS = 400_000, 16 << 20

#: A word of Latin letters with its blank, if what follows is surely none; other runs; white space as the pre-tokenizer takes it.
_UNITS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[\x00-@\[-`{-\x7f]|$)| ?\S+|\s+(?!\S)|\s+")
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
_ASCII_UNITS = re.compile(r" ?[A-Za-z]+| ?\S+|\s+(?!\S)|\s+")


def _visible_bytes() -> dict[int, int]:
    """Byte-level models write each byte as a visible character: printable ones as they are, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


_VISIBLE = _visible_bytes()
_UNSURE = re.compile(r"[\x1c-\x1f\x85᠎​-‍⁠﻿]")
_ASCII_UNSURE = re.compile("[\x1c-\x1f]")


class WaveletMatrix:
    """Bit planes over a sequence of ids, with rank and select. `planes` and `ranks` are lists, or what reads them from a file."""

    def __init__(self, n: int, planes: Sequence[np.ndarray], zeros: list[int], ranks: Sequence[np.ndarray] | None = None):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.ranks = [self._ranks(p) for p in planes] if ranks is None else ranks

    @staticmethod
    def _ranks(plane: np.ndarray) -> np.ndarray:
        """Ones before each RANK_STEP bits, and all."""
        step = RANK_STEP // 64
        words = np.frombuffer(plane.tobytes() + bytes(-len(plane) % (RANK_STEP // 8)), np.uint64)
        return np.concatenate(([0], np.cumsum(np.bitwise_count(words).reshape(-1, step).sum(axis=1, dtype=np.int64))))

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max(initial=0)).bit_length())
        planes, zeros, order = [], [], ids.astype(np.uint16) if bits <= 16 else ids
        for k in reversed(range(bits)):
            one = (order & order.dtype.type(1 << k)) != 0
            planes.append(np.packbits(one))
            low = order[~one]
            zeros.append(len(low))
            order = np.concatenate((low, order[one]))
        return cls(len(ids), planes, zeros)

    def rank1(self, level: int, at: int) -> int:
        """Ones among the first `at` bits of a plane."""
        block, plane = at // RANK_STEP, self.planes[level]
        lo, hi = block * RANK_STEP // 8, at // 8
        ones = int(self.ranks[level][block]) + int(np.bitwise_count(plane[lo:hi]).sum())
        return ones + (int(plane[hi]) >> (8 - at % 8)).bit_count() if at % 8 else ones

    def bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at >> 3]) >> (7 - (at & 7)) & 1

    def access(self, at: int) -> int:
        """The id at a place."""
        out = 0
        for level in range(len(self.planes)):
            one = self.bit(level, at)
            ones = self.rank1(level, at)
            at = self.zeros[level] + ones if one else at - ones
            out = out << 1 | one
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            a, b = self.rank1(level, lo), self.rank1(level, hi)
            if token >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often an id occurs between two places."""
        if token >> len(self.planes):
            return 0
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, level: int, one: int, k: int) -> int:
        """The place of the k-th (from 0) one or zero of a plane."""
        held = self.ranks[level] if one else np.minimum(np.arange(len(self.ranks[level])) * RANK_STEP, self.n) - self.ranks[level]
        block = int(np.searchsorted(held, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * RANK_STEP // 8 : (block + 1) * RANK_STEP // 8])
        return block * RANK_STEP + int(np.flatnonzero(bits == one)[k - int(held[block])])

    def occurrence(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of an id."""
        lo, hi = self._range(token, 0, self.n) if not token >> len(self.planes) else (0, 0)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in reversed(range(len(self.planes))):
            one = token >> (len(self.planes) - 1 - level) & 1
            at = self.select(level, one, at - self.zeros[level] if one else at)
        return at

    def sequence(self) -> np.ndarray:
        """All ids, from the lowest bit up: each plane tells where the next one's zeros and ones came from."""
        out = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bits = np.unpackbits(plane)[: self.n].astype(bool)
            up = np.empty_like(out)
            up[~bits] = out[:zeros]
            up[bits] = out[zeros:] | out.dtype.type(1 << k)
            out = up
        return out


def pack(doc_ids: list[int | None], lens: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard's file: the magic, the header's length, the header, and the frames it places."""
    m = WaveletMatrix.build(ids)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    missing = np.packbits(np.array([d is None for d in doc_ids], bool)).tobytes()
    small, body = zstandard.ZstdCompressor(level=1), []
    body.append(small.compress(keys + missing + lens.astype("<i8").tobytes()))
    for plane, ranks in zip(m.planes, m.ranks, strict=True):
        body += [small.compress(plane.tobytes()), small.compress(ranks.astype("<i8").tobytes())]
    head = json.dumps({"n": m.n, "docs": len(doc_ids), "zeros": m.zeros, "frames": [len(b) for b in body]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *body])


class _Frames:
    """Every other frame of a file from a first one on, as arrays; each is inflated once it is asked for."""

    def __init__(self, data: bytes, places: list[tuple[int, int]], kind: str):
        self.data, self.places, self.kind = data, places, kind
        self.open: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, level: int) -> np.ndarray:
        if not 0 <= level < len(self.places):
            raise IndexError(level)
        if level not in self.open:
            at, size = self.places[level]
            self.open[level] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.data[at : at + size]), self.kind)
        return self.open[level]


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """doc_ids, tokens of each document, and the matrix of a shard's file, whose planes are read when used."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    size = struct.unpack_from("<I", data, 4)[0]
    head = json.loads(data[8 : 8 + size])
    ends = np.cumsum([8 + size, *head["frames"]]).tolist()
    places = list(zip(ends[:-1], head["frames"], strict=True))
    own = zstandard.ZstdDecompressor().decompress(data[places[0][0] : ends[1]])
    docs = head["docs"]
    keys = np.frombuffer(own, "<i8", docs).tolist()
    missing = np.unpackbits(np.frombuffer(own, np.uint8, -(-docs // 8), 8 * docs))[:docs]
    lens = np.frombuffer(own, "<i8", docs, 8 * docs + -(-docs // 8))
    matrix = WaveletMatrix(head["n"], _Frames(data, places[1::2], "u1"), head["zeros"], _Frames(data, places[2::2], "<i8"))
    return [None if x else k for k, x in zip(keys, missing, strict=True)], lens, matrix


class _Memory(dict):
    """Units and their ids; a unit that is new is taken over from the memory before, or encoded."""

    def __init__(self, encode: Callable[[str], bytes], older: dict[str, bytes]):
        self.encode, self.older, self.chars = encode, older, 0

    def __missing__(self, unit: str) -> bytes:
        ids = self.older.get(unit) or self.encode(unit)
        self[unit] = ids
        self.chars += len(unit)
        return ids


class UnitEncoder:
    """The tokenizers library's ids (as little-endian 32-bit integers), with a memory of units."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = json.loads(self.tokenizer.to_str())
        self.byte_level = kind.get("normalizer") is None and (kind.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not kind["pre_tokenizer"].get("add_prefix_space")
        self.model = self.tokenizer.model.tokenize
        self.known = _Memory(self._one, {})

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _one(self, unit: str) -> bytes:
        if self.byte_level and _WORD.fullmatch(unit):  # one pre-token: the library's model encodes it alone
            return array("I", [t.id for t in self.model(unit.encode().decode("latin-1").translate(_VISIBLE))]).tobytes()
        return array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()

    def _units(self, text: str) -> list[str] | None:
        """None: the text goes to the library whole."""
        if text.isascii():
            return None if _ASCII_UNSURE.search(text) or any(s in text for s in self.special) else _ASCII_UNITS.findall(text)
        return None if _UNSURE.search(text) or any(s in text for s in self.special) else _UNITS.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.byte_level:
            return self.whole(texts)
        if len(self.known) > KEPT_UNITS or self.known.chars > KEPT_CHARS:
            older = dict(self.known)
            self.known = _Memory(self._one, older)
        out = []
        for text in texts:
            units = self._units(text)
            out.append(self.whole([text])[0] if units is None else b"".join(map(self.known.__getitem__, units)))
        return out


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_shards(docs: DataFrame, spark: SparkSession, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """docs(doc_id, text) -> the table of files: (task, number, n_docs, n_tokens, file). path: the tokenizer's file."""
    path = path or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        task, number = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            lens = np.array([len(p) // 4 for p in parts])
            ids = np.frombuffer(b"".join(parts), "<u4")
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([number], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([pack(keys, lens, ids)], pa.binary())], ["task", "number", "n_docs", "n_tokens", "file"])

        for batch in slices(batches, "text", 2 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for key, ids in zip(batch.column(0).to_pylist(), e.encode(texts), strict=True):
                keys.append(key)
                parts.append(ids + end)
                held += len(parts[-1]) // 4
                if held >= SHARD_TOKENS:
                    yield close()
                    keys, parts, held, number = [], [], 0, number + 1
        if keys:
            yield close()

    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(order[0]).sortWithinPartitions(*order)
    return materialize(dealt.mapInArrow(run, "task int, number int, n_docs long, n_tokens long, file binary"), spark)


def read_documents(files: DataFrame, spark: SparkSession) -> DataFrame:
    """The table of files -> (doc_id, start, n_tokens, ids_crc32), all from the files."""
    order = Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("task", "number", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))  # a row for each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, number, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, lens, matrix = unpack(file)
                ids = matrix.sequence().astype("<u4").tobytes()
                ends = np.cumsum(lens)
                begins = ends - lens
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array([task] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(keys, pa.int64()), pa.array(begins, pa.int64()), pa.array(lens, pa.int64()), pa.array(crc, pa.int64())], ["task", "number", "doc_id", "local", "n_tokens", "ids_crc32"])

    rows = files.select("task", "number", "file").mapInArrow(run, "task int, number int, doc_id long, local long, n_tokens long, ids_crc32 long")
    base = materialize(base, spark)
    if fits_broadcast(base, 24):
        base = F.broadcast(base)
    return rows.join(base, ["task", "number"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(table(spark, sf_dir, "documents"), spark), spark)
