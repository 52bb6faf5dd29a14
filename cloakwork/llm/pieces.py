"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces come from a public SentencePiece model file. Its scores are merge ranks, not
probabilities, so the log scores are those of Zipf's law over the ranks: log(1 / (H * rank)). The
best segmentation maximises their sum; a character that no piece covers costs the least score less
UNKNOWN and is written as byte pieces. Blanks are the marker U+2581, and a text begins with one.

A text is cut into units that no piece crosses - blanks and what follows them up to the next, line
ends alone - and units that a worker has met are looked up. New ones go through the trie together:
all that start at the same place step from node to node as arrays.

Defined results: null and empty texts have no pieces and decode to an empty text; a text's own
U+2581 is written as bytes, so every text decodes to itself. Ties go to the longer last piece.
Repeated rows and null ids each keep a row; extra columns are ignored; empty tables give empty
results.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXT_ROWS, batch_rows, memory, slices, table

MARK = "▁"
UNKNOWN = 10.0
#: Units kept per worker, of at most so many characters; longer ones are also encoded alone.
KEPT_UNITS, KEPT_LENGTH = 150_000, 40
_UNITS = re.compile(f"{MARK}*[^{MARK}\\n]+|{MARK}+|\\n")


@dataclass
class Trie:
    """Double array: from node s by character number c to base[s] + c, if check there is s."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    chars: dict[str, int]
    depth: int

    @classmethod
    def build(cls, pieces: dict[str, int]) -> Trie:
        chars = {c: i + 1 for i, c in enumerate(sorted({c for p in pieces for c in p}))}
        tree: dict = {}
        for piece, number in pieces.items():
            node = tree
            for c in piece:
                node = node.setdefault(chars[c], {})
            node[0] = number
        base, check, value = [0], [0], [-1]
        todo, first, top = [(0, tree)], 1, 1

        def room(n: int) -> None:
            if n > len(base):
                more = n + len(base)
                base.extend([0] * more)
                check.extend([-1] * more)
                value.extend([-1] * more)

        room(2 * len(chars) + 2)
        while todo:
            state, node = todo.pop()
            kids = sorted(c for c in node if c)
            value[state] = node.get(0, -1)
            if not kids:
                continue
            while check[first] >= 0:
                first += 1
                room(first + 1)
            at = max(1, first - kids[0])
            for _ in range(32):  # the holes first, then the end
                room(at + kids[-1] + 1)
                if all(check[at + c] < 0 for c in kids):
                    break
                at += 1
            else:
                at = max(1, top + 1 - kids[0])
                room(at + kids[-1] + 1)
            base[state] = at
            top = max(top, at + kids[-1])
            for c in kids:
                check[at + c] = state
                todo.append((at + c, node[c]))
        used = top + len(chars) + 2
        return cls(*(np.array((a + [fill] * used)[:used], np.int32) for a, fill in ((base, 0), (check, -1), (value, -1))), chars, max(map(len, pieces), default=0))


@dataclass
class PieceModel:
    """The trie, log scores by id, what each id decodes to, and the ids of the 256 bytes."""

    trie: Trie
    scores: np.ndarray
    content: list[bytes]
    byte_ids: list[int]
    unknown: float
    cuts: bool

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        plain = [i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        return cls.of([m.id_to_piece(i) for i in ids], plain, [i for i in ids if m.is_byte(i)])

    @classmethod
    def of(cls, names: list[str], plain: list[int], byte_ids: list[int]) -> PieceModel:
        total = math.log(sum(1 / r for r in range(1, len(plain) + 1)))
        scores = np.zeros(len(names))
        content = [b""] * len(names)
        for rank, i in enumerate(plain, 1):
            scores[i] = -math.log(rank) - total
            content[i] = names[i].replace(MARK, " ").encode()
        unknown = float(scores[plain].min(initial=0.0)) - UNKNOWN
        for byte, i in enumerate(byte_ids):
            content[i] = bytes([byte])
            scores[i] = 0.0 if 0x80 <= byte < 0xC0 else unknown  # a character's cost is its first byte's
        crosses = any(MARK in names[i].lstrip(MARK) or "\n" in names[i] for i in plain)
        return cls(Trie.build({names[i]: i for i in plain}), scores, content, byte_ids, unknown, not crosses)

    def fallback(self, text: str) -> list[int]:
        return [self.byte_ids[b] for b in text.encode()]

    def viterbi(self, unit: str) -> list[int]:
        """One unit, place by place."""
        base, check, value, chars = self._lists()
        c = [chars.get(x, 0) for x in unit]
        n, scores = len(c), self._score_list
        best, back = [0.0] + [-math.inf] * n, [(0, -1)] * (n + 1)
        for i in range(n):
            node, single = 0, False
            for j in range(i, n):
                to = base[node] + c[j]
                if not c[j] or check[to] != node:
                    break
                node = to
                if value[node] >= 0:
                    single |= j == i
                    s = best[i] + scores[value[node]]
                    if s > best[j + 1]:
                        best[j + 1], back[j + 1] = s, (i, value[node])
            if not single and best[i] + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + self.unknown, (i, -1)
        out, at = [], n
        while at:
            i, v = back[at]
            out.append([v] if v >= 0 else self.fallback(unit[i:at]))
            at = i
        return [v for part in reversed(out) for v in part]

    def _lists(self):
        if not hasattr(self, "_plain"):
            self._plain = (self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.trie.chars)
            self._score_list = self.scores.tolist()
        return self._plain

    def viterbi_many(self, units: list[str]) -> list[list[int]]:
        """Units of like length at once: every start's walks through the trie are arrays."""
        t, n = self.trie, len(units)
        lens = np.array([len(u) for u in units])
        width = int(lens.max(initial=0))
        get = t.chars.get
        codes = np.zeros((n, width + 1), np.int32)
        for k, u in enumerate(units):
            codes[k, : len(u)] = [get(x, 0) for x in u]
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        piece = np.full((n, width + 1), -1, np.int32)
        came = np.zeros((n, width + 1), np.int32)
        for i in range(width):
            rows = np.flatnonzero(lens > i)
            alone = rows
            node = np.zeros(len(rows), np.int32)
            for j in range(i, min(width, i + t.depth)):
                c = codes[rows, j]
                to = t.base[node] + c
                ok = (c > 0) & (t.check[to] == node)
                rows, node = rows[ok], to[ok]
                if not len(rows):
                    break
                value = t.value[node]
                is_piece = value >= 0
                at, value = rows[is_piece], value[is_piece]
                score = best[at, i] + self.scores[value]
                better = score > best[at, j + 1]
                at, value = at[better], value[better]
                best[at, j + 1], piece[at, j + 1], came[at, j + 1] = score[better], value, i
                if j == i:
                    mask = np.ones(n, bool)
                    mask[rows[is_piece]] = False
                    alone = alone[mask[alone]]
            score = best[alone, i] + self.unknown
            better = score > best[alone, i + 1]
            at = alone[better]
            best[at, i + 1], piece[at, i + 1], came[at, i + 1] = score[better], -1, i
        out = []
        for u, p, f in zip(units, piece.tolist(), came.tolist(), strict=True):
            ids, at = [], len(u)
            while at:
                ids.append([p[at]] if p[at] >= 0 else self.fallback(u[f[at] : at])[::1])
                at = f[at]
            out.append([v for part in reversed(ids) for v in part])
        return out

    def decode(self, ids: list[int]) -> str:
        """Byte pieces join to characters, markers become blanks, the first blank is the one that was added."""
        return b"".join(map(self.content.__getitem__, ids)).decode("utf-8", "replace")[1:]


class PieceEncoder:
    """A model with a memory of units; ids as little-endian 32-bit integers."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _units(self, text: str) -> list[str]:
        text = MARK + text.replace(" ", MARK)
        return _UNITS.findall(text) if self.model.cuts else [text]

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        if len(self.known) > KEPT_UNITS:
            self.known, self.older = {}, self.known
        found = {u: self.older[u] for u in missing if u in self.older}
        fresh = sorted(missing.difference(found), key=len)
        short = [u for u in fresh if len(u) <= KEPT_LENGTH]
        for lo in range(0, len(short), 4096):
            part = short[lo : lo + 4096]
            found.update((u, np.array(ids, "<u4").tobytes()) for u, ids in zip(part, self.model.viterbi_many(part), strict=True))
        for u in fresh[len(short) :]:
            found[u] = np.array(self.model.viterbi(u), "<u4").tobytes()
        self.known.update((u, ids) for u, ids in found.items() if len(u) <= KEPT_LENGTH)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._units(t) if t and MARK not in t else [] for t in texts]
        got = [list(map(self.known.get, units)) for units in split]
        missing = {u for units, ids in zip(split, got, strict=True) if None in ids for u, i in zip(units, ids, strict=True) if i is None}
        if missing:
            fresh = self._learn(missing)
            got = [ids if None not in ids else [fresh[u] if i is None else i for u, i in zip(units, ids, strict=True)] for units, ids in zip(split, got, strict=True)]
        return [b"".join(ids) if MARK not in t else self._with_marks(t) for t, ids in zip(texts, got, strict=True)]

    def _with_marks(self, text: str) -> bytes:
        """A text with markers of its own: they are bytes, what lies between is encoded as it stands."""
        own = np.array(self.model.fallback(MARK), "<u4").tobytes()
        parts = []
        for k, part in enumerate(text.split(MARK)):
            units = self._units(part)
            if k:  # no blank was added here
                units = self._units_of(MARK.join(part.split(" ")))
            fresh = self._learn({u for u in units})
            parts.append(b"".join(fresh[u] for u in units))
        return own.join(parts)

    def _units_of(self, marked: str) -> list[str]:
        return _UNITS.findall(marked) if self.model.cuts else [marked] if marked else []


def _encoder(shared: Broadcast) -> PieceEncoder:
    encoders = memory("pieces")
    if shared._path not in encoders:
        encoders.clear()
        encoders[shared._path] = PieceEncoder(shared.value)
    return encoders[shared._path]


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """docs(doc_id, text) -> the kept columns, ids array<int> (if asked for), n_pieces, n_bytes, score, ids_crc32, round_trip.

    round_trip: whether the ids decode to the text.
    """
    spark = docs.sparkSession
    batch_rows(spark, TEXT_ROWS)
    model = PieceModel.load(path or default_pieces())
    shared = spark.sparkContext.broadcast(model)  # the size of the vocabulary
    rows = docs.select(*keep, "text")
    names = [*keep, *(["ids"] if ids else []), "n_pieces", "n_bytes", "score", "ids_crc32", "round_trip"]
    kinds = [rows.schema[k].dataType.simpleString() for k in keep] + ["array<int>"] * ids + ["long", "long", "double", "long", "boolean"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(shared)
        m = e.model
        is_byte = np.zeros(len(m.content), bool)
        is_byte[m.byte_ids] = True
        for batch in slices(batches, "text", 1 << 20):
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            raw = e.encode(texts)
            arrays = [np.frombuffer(r, "<u4") for r in raw]
            out = [batch.column(i) for i in range(len(keep))]
            if ids:
                ends = np.cumsum([0, *(len(a) for a in arrays)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).astype(np.int32) if arrays else [], pa.int32())))
            out += [pa.array([len(a) for a in arrays], pa.int64()), pa.array([int(is_byte[a].sum()) for a in arrays], pa.int64()), pa.array([float(m.scores[a].sum()) for a in arrays])]
            out += [pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array([m.decode(a.tolist()) == t for a, t in zip(arrays, texts, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, names)

    return rows.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def decode(encoded: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """(doc_id, ids) -> (doc_id, text)."""
    shared = encoded.sparkSession.sparkContext.broadcast(PieceModel.load(path or default_pieces()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], [key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} {encoded.schema[key].dataType.simpleString()}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ids=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source of each document with its ids and their figures."""
    return encode(docs, keep=("doc_id", "lang", "source"))
