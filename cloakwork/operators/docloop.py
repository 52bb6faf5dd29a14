"""A document's whole way in a Python worker, for rules alone and scores as they are: what `fusion`, `routing` and
`rewriting` say in expressions. What one detector finds is disjoint, so fusing leaves each entity as it is."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa

from ..functions.taxonomy import HIGH_RISK, KINDS
from . import ruleloop
from .rewriting import BLANKS, LEAST, MASK, PARTIAL, PSEUDONYM, REPLACEMENT, TAG
from .routing import AUTO, DISCARD, REVIEW, Policy
from .ruleloop import rounded

_NOT_DIGIT = re.compile(r"[^0-9]")
_MARKERS = {lang: {k[0]: k[i] for k in KINDS} for lang, i in (("es", 3), ("en", 4))}
_SHOWN = {k[0]: k[5] for k in KINDS if k[5]}


def unified(found: list[tuple]) -> list[float]:
    """The scores of `routing.unify`."""
    keys = [(f[6].strip(BLANKS).lower().replace("ß", "ss"), f[4]) for f in found]
    best: dict[tuple, float] = {}
    for k, f in zip(keys, found, strict=True):
        best[k] = max(best.get(k, f[5]), f[5])
    return [best[k] for k in keys]


def decide(p: Policy, kind: str, score: float, checksum: str | None, passed: bool | None) -> tuple[str, list[str]]:
    """`Policy.decide` of an entity that the rules alone found."""
    said = f"{rounded(score, 2):.2f}"
    if score < p.tau_discard and not passed:
        return DISCARD, [f"score {said} < {p.tau_discard}"]
    why = []
    if score < p.tau_discard and passed:
        why.append(f"low score {said} but {checksum} checksum verified")
    if passed is False:
        why.append(f"{checksum} checksum failed")
    if kind in HIGH_RISK and score < p.tau_high_risk:
        why.append(f"high-risk {kind} below {p.tau_high_risk} confidence")
    if score < p.tau_auto:
        why.append(f"score {said} < {p.tau_auto}")
    if score < p.tau_single_detector:
        why.append("only rules detected it")
    return (REVIEW, why) if why else (AUTO, ["high confidence, no conflicts"])


def _in_word(c: str) -> bool:
    return c == "_" or (c != "" and unicodedata.category(c)[0] in "LN")


def sweep(text: str, spans: list[tuple]) -> list[tuple]:
    """(start, end, value, kind, score) and every other whole-word occurrence of the values, by start."""
    claimed = list(spans)
    for _, _, value, kind, score in spans:
        value = value.strip(BLANKS)
        if len(value) < LEAST:
            continue
        at = text.find(value)
        while at >= 0:
            end = at + len(value)
            if not any(c[0] < end and at < c[1] for c in claimed) and not _in_word(text[at - 1 : at] if at else "") and not _in_word(text[end : end + 1]):
                claimed.append((at, end, value, kind, score))
            at = text.find(value, end)
    return sorted(claimed, key=lambda c: c[0])


def replacement(value: str, kind: str, lang: str | None, mode: str, key: bytes) -> str:
    mark = _MARKERS["en" if lang == "en" else "es"].get(kind, kind)
    if mode == PARTIAL:
        digits, shown = _NOT_DIGIT.sub("", value), _SHOWN.get(kind)
        if shown is not None and len(digits) > shown:
            return f"[{mark}_****{digits[-shown:]}]"
    if mode == PSEUDONYM:
        return f"[{mark}:{hmac.new(key, f'{kind}:{value.strip(BLANKS).lower()}'.encode(), hashlib.sha256).hexdigest()[:TAG]}]"
    return f"[{mark}]"


def redact(text: str, spans: list[tuple], lang: str | None, mode: str, key: bytes) -> tuple[str, list[tuple]]:
    """The text and its replacements, in the order of REPLACEMENT's fields."""
    out, done, at, length = [], [], 0, 0
    for start, end, value, kind, score in spans:
        if start < at and done:
            continue
        new = replacement(value, kind, lang, mode, key)
        first = length + start - at
        out += (text[at:start], new)
        at, length = end, first + len(new)
        done.append((value, new, kind, start, end, first, length, rounded(score, 4)))
    return "".join((*out, text[at:])), done


REPLACED = [("original", pa.string()), ("replacement", pa.string()), ("type", pa.string()), *((n, pa.int32()) for n in ("source_start", "source_end", "redacted_start", "redacted_end")), ("score", pa.float64())]
LEAK = [("type", pa.string()), ("value", pa.string())]
#: What is told of an entity besides `ruleloop.TYPES`.
MORE = {"suppressed": ruleloop.BRIEF, "raw_score": pa.float64(), "score_before_repeat_propagation": pa.float64(), "decision": pa.string(), "decision_reasons": pa.list_(pa.string())}
COUNTS = ("n_entities", "n_auto_redacted", "n_review", "n_discarded")
_ENTITY = ruleloop.DDL.removeprefix("array<").removesuffix(">>") + ",raw_score:double,score_before_repeat_propagation:double,decision:string,decision_reasons:array<string>>"
DDL = f"struct<entities:array<{_ENTITY}>,redacted_text:string,replacements:array<{REPLACEMENT}>,leaks:array<struct<type:string,value:string>>,by_type:map<string,int>,{','.join(f'{c}:int' for c in COUNTS)}>"


def _nested(rows: list[list[tuple]], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    """Arrays of structs from lists of tuples, column by column."""
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + len(r))
    columns = list(zip(*[x for r in rows for x in r], strict=True)) or [()] * len(fields)
    made = [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(made, [n for n, _ in fields]))


class Way:
    """A text's entities, redacted text, replacements, leaks and counts."""

    def __init__(self, find: ruleloop.Finder, policy: Policy, mode: str, key: bytes):
        self.find, self.policy, self.mode, self.key = find, policy, mode, key

    def __call__(self, text: str, lang: str | None) -> tuple:
        kept = self.find(text, lang)
        entities, acted, kinds, n = [], [], {}, dict.fromkeys((AUTO, REVIEW, DISCARD), 0)
        for (f, gone), score in zip(kept, unified([f for f, _ in kept]), strict=True):
            _, number, start, end, kind, raw, value, rule, checksum, passed, hit, dob = f
            decision, why = decide(self.policy, kind, score, checksum, passed)
            n[decision] += 1
            kinds[kind] = kinds.get(kind, 0) + 1
            least = rounded(raw, 4)
            entities.append((number, start, end, kind, score, value, rule, checksum, passed, hit, dob, gone, least, least if score > raw else None, decision, why))
            if decision != DISCARD:
                acted.append((start, end, value, kind, score))
        redacted, done = redact(text, sweep(text, acted), lang, self.mode, self.key)
        leaks = [(r[2], v) for r in done if len(v := r[0].strip(BLANKS)) >= LEAST and v in redacted]
        return entities, redacted, done, leaks, list(kinds.items()), len(entities), n[AUTO], n[REVIEW], n[DISCARD]


def packed(rows: list[tuple]) -> pa.Array:
    entities, redacted, done, leaks, kinds, *counts = map(list, zip(*rows, strict=True)) if rows else ([] for _ in range(9))
    columns = [_nested(entities, [*ruleloop.TYPES.items(), *MORE.items()]), pa.array(redacted, pa.string()), _nested(done, REPLACED), _nested(leaks, LEAK), pa.array(kinds, pa.map_(pa.string(), pa.int32())), *(pa.array(c, pa.int32()) for c in counts)]
    return pa.StructArray.from_arrays(columns, ["entities", "redacted_text", "replacements", "leaks", "by_type", *COUNTS])


def over_batches(rules, width: int, birth: tuple[str, ...], policy: Policy, mode: str, key: bytes):
    """A function of batches (text, lang), for `arrow_udf`."""
    if mode not in (MASK, PARTIAL, PSEUDONYM):
        raise ValueError(mode)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        way = Way(ruleloop.Finder(rules, width, birth), policy, mode, key)
        yield from ruleloop.in_steps(batches, way, packed)

    return run
