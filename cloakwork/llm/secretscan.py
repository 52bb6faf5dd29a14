"""Secret scans over an inverted index of trigrams, in DataFrame operations only.

Each rule's regular expression is parsed, and what every match must hold becomes a Boolean query
over trigrams, in lower case: the strings that a part without open classes or repetitions can be,
alternatives joined by or, parts that follow one another by and. The index has a posting (trigram,
document) for every trigram of the queries. Postings are intersected by gathering, for each
document, a bit for each of its trigrams, on which the queries are then evaluated; the documents
that fulfil one are the rule's candidates, and only they are verified with the regular expression.
A rule without mandatory trigrams has every document as candidate.

The base kinds are `assign`, `access` and `hex`; the others are added. Spans are of whole matches,
in code points, end exclusive; matches of one kind are leftmost and don't overlap, those of
different kinds may. A match is dropped after matching if it is too short, so it still hides what
it covers.

Defined results: a null text counts as empty; no spans give an empty string and the hash of it;
repeated doc_ids, null ids and equal rows each keep a row of their own; extra columns are ignored,
`stage` returns them as they are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fits_broadcast, materialize, packed, scratch, table

#: A trigram, ("all", queries), ("any", queries), or None, which everything fulfils.
Query = str | tuple[str, tuple] | None
#: So many strings at most are told apart for a part of a pattern, and so many characters for a class.
MOST_STRINGS, MOST_CLASS = 64, 16
#: Trigrams of a word of the intersection.
WORD_BITS = 62


def _join(kind: str, queries: Iterable[Query]) -> Query:
    parts = list(dict.fromkeys(queries))
    if kind == "any" and None in parts:
        return None
    parts = [q for q in parts if q is not None]
    return (kind, tuple(parts)) if len(parts) > 1 else parts[0] if parts else None


def _of_string(text: str) -> Query:
    """Every third trigram and the last: together they hold all its characters."""
    if len(text) < 3:
        return None
    return _join("all", [text[i : i + 3] for i in (*range(0, len(text) - 3, 3), len(text) - 3)])


@dataclass(frozen=True)
class _Part:
    """What a part of a pattern can match: all its strings, if they are few, and a query that each match fulfils."""

    strings: frozenset[str] | None
    beyond: Query = None

    @property
    def query(self) -> Query:
        if self.strings is None:
            return self.beyond
        # What holds a longer string also holds the shorter ones within it.
        least = [s for s in sorted(self.strings) if not any(t != s and t in s for t in self.strings)]
        return _join("any", map(_of_string, least))


_NOTHING, _ANYTHING = _Part(frozenset([""])), _Part(None)


def _sequence(parts: Iterable[_Part]) -> _Part:
    """Parts in a row: strings are put together as long as they are few, then turned into a query."""
    run, queries, whole = _NOTHING, [], True
    for part in parts:
        if part.strings is not None and len(run.strings) * len(part.strings) <= MOST_STRINGS:
            run = _Part(frozenset(a + b for a in run.strings for b in part.strings))
            continue
        queries.append(run.query)
        whole = False
        run = part if part.strings is not None else _NOTHING
        if part.strings is None:
            queries.append(part.beyond)
    return run if whole else _Part(None, _join("all", [*queries, run.query]))


def _either(parts: list[_Part]) -> _Part:
    if all(p.strings is not None for p in parts) and sum(len(p.strings) for p in parts) <= MOST_STRINGS:
        return _Part(frozenset().union(*[p.strings for p in parts]))
    return _Part(None, _join("any", [p.query for p in parts]))


def _class(items: list) -> _Part:
    chars: set[str] = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            chars.add(chr(value).lower())
        elif kind is sre.RANGE and value[1] - value[0] < 4 * MOST_CLASS:
            chars.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return _ANYTHING
    return _Part(frozenset(chars)) if len(chars) <= MOST_CLASS else _ANYTHING


def _part(node) -> _Part:
    kind, value = node
    if kind is sre.LITERAL:
        return _Part(frozenset([chr(value).lower()]))
    if kind is sre.IN:
        return _class(value)
    if kind is sre.BRANCH:
        return _either([_sequence(map(_part, b)) for b in value[1]])
    if kind is sre.SUBPATTERN:
        return _sequence(map(_part, value[-1]))
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, body = value
        one = _sequence(map(_part, body))
        if (least, most) == (0, 1):
            return _either([_NOTHING, one])
        times = min(least, 4)
        return _sequence([one] * times + ([_ANYTHING] if times < most else []))
    return _NOTHING if kind in (sre.AT, sre.ASSERT, sre.ASSERT_NOT) else _ANYTHING


@cache
def trigram_query(pattern: str) -> Query:
    """The Boolean query that each match of a regular expression fulfils, in lower case."""
    return _sequence(map(_part, sre_parser.parse(pattern))).query


def trigrams_of(query: Query) -> set[str]:
    if query is None or isinstance(query, str):
        return {query} if query else set()
    return set().union(*map(trigrams_of, query[1]))


@dataclass(frozen=True)
class SecretRule:
    """`pattern` finds matches; `minimum` characters are asked of group `measured` (0: of the match)."""

    kind: str
    pattern: str
    measured: int = 0
    minimum: int = 1
    base: bool = False

    @property
    def groups(self) -> int:
        return sre_parser.parse(self.pattern).state.groups - 1

    @property
    def query(self) -> Query:
        return trigram_query(self.pattern)

    @property
    def probe(self) -> str:
        """A pattern that each text with a kept match has: where a repetition of one character ends the pattern, and
        what is measured is that behind a head of one length, the length is asked for at once."""
        nodes, inner, closing = list(sre_parser.parse(self.pattern)), 0, ""
        while nodes and nodes[-1][0] is sre.SUBPATTERN and self.pattern.endswith(")" + closing):
            inner, nodes, closing = nodes[-1][1][0], list(nodes[-1][1][-1]), closing + ")"
        body = self.pattern.removesuffix(closing)
        if inner != self.measured or not nodes or nodes[-1][0] is not sre.MAX_REPEAT or not body.endswith("+"):
            return self.pattern
        least, most, repeated = nodes[-1][1]
        head = sre_parser.SubPattern(sre_parser.State(), nodes[:-1]).getwidth()
        if (least, most) != (1, sre.MAXREPEAT) or repeated.getwidth() != (1, 1) or head[0] != head[1] or self.minimum <= head[0]:
            return self.pattern
        return f"{body[:-1]}{{{self.minimum - head[0]},}}{closing}"


RULES = (
    SecretRule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        measured=2, minimum=8, base=True,
    ),
    SecretRule("access", r"AKIA[A-Z0-9]+", minimum=16, base=True),
    SecretRule("hex", r"[0-9a-f]+", minimum=32, base=True),
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]+", minimum=24),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]+", minimum=15),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)


def _trigrams(rules: tuple[SecretRule, ...]) -> list[str]:
    return sorted(set().union(*[trigrams_of(r.query) for r in rules]))


def postings(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """The inverted index: (trigram, doc_id) for the trigrams of the rules' queries. ids that repeat share their postings."""
    text = F.lower(F.col("text"))
    found = F.array_compact(F.array(*[F.when(text.contains(g), F.lit(g)) for g in _trigrams(rules)]).cast("array<string>"))
    return docs.select("doc_id", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(doc_id, cand): for each rule, whether the postings of the document fulfil its query; documents that fulfil none are left out.

    A posting is a bit in the document's words of the intersection, so postings are combined before
    the shuffle and a frequent trigram is no group.
    """
    at = {g: divmod(i, WORD_BITS) for i, g in enumerate(_trigrams(rules))}
    words = range(1 + max((w for w, _ in at.values()), default=0))

    def word(w: int) -> Column:
        bits = [F.when(F.col("trigram") == g, F.lit(1 << b)) for g, (x, b) in at.items() if x == w]
        return F.bit_or(F.coalesce(*bits, F.lit(0)).cast("long")).alias(f"seen{w}")

    def holds(q: Query) -> Column:
        if isinstance(q, str):
            q = ("all", (q,))
        kind, parts = q
        tests = [holds(p) for p in parts if not isinstance(p, str)]
        for w in words:
            mask = sum(1 << at[g][1] for g in parts if isinstance(g, str) and at[g][0] == w)
            if mask:
                met = F.col(f"seen{w}").bitwiseAND(F.lit(mask).cast("long"))
                tests.append(met == mask if kind == "all" else met != 0)
        out = tests[0]
        for t in tests[1:]:
            out = out & t if kind == "all" else out | t
        return out

    seen = index.groupBy("doc_id").agg(*map(word, words))
    cand = F.array(*[F.lit(False) if r.query is None else holds(r.query) for r in rules])
    return seen.select("doc_id", cand.alias("cand")).where(F.exists("cand", lambda c: c))


def _runs(text: Column, rule: SecretRule) -> Column:
    """Spans (start, end) of the rule's kept matches: gaps and matches in turn, positions as running lengths."""
    whole = f"(?s:(.*?))({rule.pattern})|(?s:.+)"
    gaps, matches = F.regexp_extract_all(text, F.lit(whole), F.lit(1)), F.regexp_extract_all(text, F.lit(whole), F.lit(2))
    measured = F.regexp_extract_all(text, F.lit(whole), F.lit(2 + rule.measured)) if rule.measured else matches
    kind = "array<struct<start:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["match"])
        kept = F.length(x["measured"]) >= rule.minimum
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(kept, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    rows = F.arrays_zip(gaps.alias("gap"), matches.alias("match"), measured.alias("measured"))
    return F.aggregate(rows, start, step, lambda acc: acc["spans"])


def _named(rank: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def _spans(text: Column, rules: tuple[SecretRule, ...]) -> Column:
    """All rules' spans in texts with their `cand`, by start and then the rules' order."""
    found = []
    for number, rule in enumerate(rules):
        spans = F.transform(_runs(text, rule), _named(number, rule.kind))
        asked = F.lit(True) if rule.query is None else F.coalesce(F.get("cand", F.lit(number)), F.lit(False))
        found.append(F.when(asked & text.rlike(rule.probe), spans))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return F.array_sort(F.flatten(F.array(*[F.coalesce(f, none) for f in found])))


def _verified(docs: DataFrame, spark: SparkSession, rules: tuple[SecretRule, ...]) -> DataFrame:
    """(doc, spans): the documents, packed, with all spans of their texts."""
    with scratch(spark):
        cand = materialize(candidates(postings(docs, rules), rules), spark, 1)
    cand = F.broadcast(cand) if fits_broadcast(cand, 40) else cand.hint("shuffle_hash")
    rows = docs.select(packed(docs))
    rows = rows.join(cand.withColumnRenamed("doc_id", "_id"), F.col("doc.doc_id").eqNullSafe(F.col("_id")), "left")
    return rows.select("doc", _spans(F.coalesce("doc.text", F.lit("")), rules).alias("spans"))


def scan(docs: DataFrame, spark: SparkSession, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, spans): an array of (kind, start, end), by start and then the rules' order."""
    return _verified(docs.select("doc_id", "text"), spark, rules).select("doc.doc_id", "spans")


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), spark)
    base = F.filter("spans", lambda s: s["rank"] < sum(r.base for r in RULES))
    return found.select("doc_id", *[_count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with each secret's characters replaced by [SECRET]; texts without any stay as they are."""
    rows = _verified(docs, spark, RULES)
    text = F.col("doc.text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        gap = F.when(fresh, F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("[SECRET]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    cut = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return rows.select(F.col("doc").withField("text", F.when(F.size("spans") > 0, cut).otherwise(text)).alias("doc")).select("doc.*")


def oracle() -> str:
    """DuckDB: matches are marked by two private-use characters, then split; positions are running lengths."""
    parts = []
    for number, rule in enumerate(RULES):
        pattern = rule.pattern.replace("(?i:", "(?:") if rule.kind != "assign" else _either_case(rule.pattern)
        quoted = pattern.replace("'", "''")
        measured = f"regexp_extract(parts[i], '{quoted}', {rule.measured})" if rule.measured else "parts[i]"
        parts.append(
            f"SELECT doc_id, {number} AS rank, '{rule.kind}' AS kind, {int(rule.base)} AS base, len(parts[i]) AS n, "
            f"coalesce(list_sum([len(x) for x in parts[1:i-1]]), 0)::BIGINT AS start, length({measured}) >= {rule.minimum} AS kept "
            f"FROM (SELECT doc_id, parts, unnest(range(2, len(parts) + 1, 2)) AS i FROM (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '({quoted})', chr(57344) || '\\1' || chr(57345), 'g'), '[' || chr(57344) || chr(57345) || ']') AS parts FROM documents))"
        )
    spans = " UNION ALL ".join(parts)
    text = "kind || ':' || start || ':' || (start + n)"
    return (
        f"WITH s AS (SELECT * FROM ({spans}) WHERE kept), g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, "
        f"coalesce(string_agg({text}, ',' ORDER BY start, rank) FILTER (base = 1), '') AS b, string_agg({text}, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id) "
        "SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id"
    )


def _either_case(pattern: str) -> str:
    """The labels with both cases spelled out: ignoring case would take other letters in too."""
    head, _, rest = pattern.partition("))")
    label = head.removeprefix("((?i:")
    return "(" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in label) + ")" + rest
