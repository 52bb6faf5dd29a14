"""The rules over one text after another in a Python worker, with the engine's regular expressions compiled once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import pyarrow as pa

from ..functions.checks import CUIT_WEIGHTS, DNI_LETTERS, NIF_LETTERS
from ..functions.taxonomy import KINDS, MULTILINE
from .spans import EDGES

#: Texts whose findings are Python objects at a time; the rest of a batch is in Arrow.
STEP = 250
#: Letters that fold to ASCII letters but don't become them in lower case, or not one for one.
FOLDED = re.compile("[ſıİK]")
PRIORITY = {k[0]: k[1] for k in KINDS}
BRIEF = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("source", pa.string())]))


@lru_cache(10_000)
def rounded(score: float, digits: int) -> float:
    """As Spark rounds: half up, of the shortest decimal that reads as the number."""
    return float(Decimal(repr(score)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


# ---- the checks of functions.checks, on strings

_NOT_DIGIT, _BLANK = re.compile(r"[^0-9]"), re.compile(r"[ \t\n\x0b\f\r-]")
_IBAN, _DNI, _NIF = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}"), re.compile(r"([XYZ]?)([0-9]{7,8})([A-Z])"), re.compile(r"[ABCDEFGHJNPQRSUVW][0-9]{7}[0-9A-J]")
_TWICE = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def _digits(value: str) -> str:
    return _NOT_DIGIT.sub("", value)


def _bare(value: str) -> str:
    return _BLANK.sub("", value).upper()


def luhn(value: str) -> bool:
    d = _digits(value)
    return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else _TWICE[int(c)] for i, c in enumerate(reversed(d))) % 10 == 0


def iban(value: str) -> bool:
    v = _bare(value)
    return _IBAN.fullmatch(v) is not None and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def dni(value: str) -> bool:
    m = _DNI.fullmatch(_bare(value))
    return m is not None and DNI_LETTERS[int({"X": "0", "Y": "1", "Z": "2", "": ""}[m[1]] + m[2]) % 23] == m[3]


def cuit(value: str) -> bool:
    d = _digits(value)
    if len(d) != 11:
        return False
    rest = 11 - sum(int(c) * w for c, w in zip(d, CUIT_WEIGHTS, strict=False)) % 11
    return int(d[10]) == {11: 0, 10: 9}.get(rest, rest)


def ssn(value: str) -> bool:
    d = _digits(value)
    return len(d) == 9 and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def nif(value: str) -> bool:
    v = _bare(value)
    if _NIF.fullmatch(v) is None:
        return False
    want = -sum(_TWICE[int(c)] if i % 2 else int(c) for i, c in enumerate(v[1:8], 1)) % 10
    return v[8] in (str(want), NIF_LETTERS[want])


CHECKS: dict[str, Callable[[str], bool]] = {"luhn": luhn, "iban": iban, "dni": dni, "cuit": cuit, "ssn": ssn, "nif": nif}


# ---- finding


def lowered(pattern: str) -> str:
    """The pattern for texts in lower case; escapes stay as they are."""
    return re.sub(r"\\.|[^\\]+", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), pattern)


class Compiled:
    """A rule's pattern in the forms that `Finder` takes, and its check."""

    def __init__(self, number: int, rule):
        pattern = f"(?:{rule.head})({rule.body}){rule.tail}"
        self.number, self.rule, self.check = number, rule, CHECKS.get(rule.check)
        self.any_case = "i" in rule.flags
        self.plain = re.compile(pattern, re.IGNORECASE if self.any_case else 0)
        self.low = re.compile(lowered(pattern)) if self.any_case else self.plain
        self.needs = re.compile(rule.needs) if rule.needs else None


class Finder:
    """The findings of the rules in a text: trimmed, the strongest of overlapping ones kept, by start."""

    def __init__(self, rules, width: int, birth: tuple[str, ...]):
        self.rules, self.width, self.birth = [Compiled(i, r) for i, r in enumerate(rules)], width, birth
        self.needs = {c.needs for c in self.rules if c.needs is not None}

    def near(self, text: str, start: int, end: int) -> str:
        return text[max(start - self.width, 0) : end + self.width].lower()

    def born(self, text: str, start: int, end: int) -> str | None:
        before = text[max(start - self.width, 0) : start].rpartition("\n")[2]
        after = text[end : end + self.width].partition("\n")[0]
        near = (before + text[start:end] + after).lower()
        return next((w for w in self.birth if w in near), None)

    def matches(self, text: str, lang: str | None) -> list[tuple]:
        """(rank, place, fields) of each finding, in the order of the rules."""
        out: list[tuple] = []
        has = {p: p.search(text) is not None for p in self.needs}
        low = text.lower()
        folds = len(low) == len(text) and FOLDED.search(text) is None
        for c in self.rules:
            r = c.rule
            if lang not in r.langs or not has.get(c.needs, True):
                continue
            found = c.low.finditer(low) if folds and c.any_case else c.plain.finditer(text)
            for m in found:
                start, end = m.span(1)
                if start == end:
                    continue
                passed = hit = dob = None
                score, kind = r.score, r.kind
                if c.check is not None:
                    passed = c.check(text[start:end])
                    if not passed and r.invalid is None:
                        continue
                    score = min(0.99, score + 0.11) if passed else r.invalid
                if r.context:
                    near = self.near(text, start, end)
                    hit = next((w for w in r.context if w in near), None)
                    score = min(0.99, score + 0.06) if hit is not None else max(0.35, score - 0.12)
                if r.require_context and hit is None:
                    continue
                if kind == "DATE_TIME":
                    dob = self.born(text, start, end)
                    if dob is not None:
                        kind, score = "DATE_OF_BIRTH", min(0.99, score + 0.05)
                value = text[start:end]
                if kind not in MULTILINE:
                    value = value.partition("\n")[0]
                rest = value.lstrip(EDGES)
                start += len(value) - len(rest)
                value = rest.rstrip(EDGES)
                end = start + len(value)
                if value:
                    rank = (-1 if passed else 0 if passed is None else 1, -rounded(score, 3), -PRIORITY.get(kind, 0), start - end, start, len(out))
                    out.append((rank, c.number, start, end, kind, score, value, r.name, r.check, passed, hit, dob))
        return out

    def __call__(self, text: str, lang: str | None) -> list[tuple]:
        """(finding, what it suppressed or None), disjoint, by start."""
        kept: list[list] = []
        for f in sorted(self.matches(text, lang)):
            start, end = f[2], f[3]
            clash = next((k for k in kept if k[0][2] < end and start < k[0][3]), None)
            if clash is None:
                kept.append([f, None])
            else:
                clash[1] = clash[1] or []
                clash[1].append({"type": f[4], "start": start, "end": end, "score": rounded(f[5], 4), "source": "rules"})
        kept.sort(key=lambda k: k[0][2])
        return kept


#: What `Finder` tells of a finding, behind its rank, and its Arrow types.
TYPES = {
    "ord": pa.int32(), "start": pa.int32(), "end": pa.int32(), "type": pa.string(), "score": pa.float64(), "text": pa.string(),
    "rule": pa.string(), "checksum": pa.string(), "checksum_passed": pa.bool_(), "context_keyword": pa.string(), "dob_context": pa.string(),
}
DDL = "array<struct<ord:int,start:int,end:int,type:string,score:double,text:string,rule:string,checksum:string,checksum_passed:boolean,context_keyword:string,dob_context:string,suppressed:array<struct<type:string,start:int,end:int,score:double,source:string>>>>"


def packed(found: list[list[tuple]]) -> pa.Array:
    """The findings of some texts, an array for each."""
    ends = [0]
    for f in found:
        ends.append(ends[-1] + len(f))
    flat = [k for f in found for k in f]
    columns = [pa.array([k[0][i] for k in flat], t) for i, t in enumerate(TYPES.values(), 1)]
    columns.append(pa.array([k[1] for k in flat], BRIEF))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, [*TYPES, "suppressed"]))


def in_steps(batches: Iterator[tuple[pa.Array, pa.Array]], of: Callable, pack: Callable) -> Iterator[pa.Array]:
    """What a function says of each (text, lang), packed for STEP texts at a time."""
    for texts, langs in batches:
        parts = []
        for at in range(0, len(texts), STEP):
            rows = zip(texts.slice(at, STEP).to_pylist(), langs.slice(at, STEP).to_pylist(), strict=True)
            parts.append(pack([of(t or "", g) for t, g in rows]))
        yield pa.concat_arrays(parts) if parts else pack([])


def over_batches(rules, width: int, birth: tuple[str, ...]):
    """A function of batches (text, lang), for `arrow_udf`."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from in_steps(batches, Finder(rules, width, birth), packed)

    return run
