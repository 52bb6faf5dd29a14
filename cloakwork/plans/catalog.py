"""Queries by name for every operator of the engine, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, scores
from ..functions.findall import find_all
from ..functions.taxonomy import KINDS, marker, priority
from ..operators import calibration, corpus, evaluation, fusion, review, rewriting, routing, rules, tokens
from ..operators import spans as sp
from ..sources import synthetic
from . import inputs
from .pipeline import Config, Pipeline, audit, compare_systems, decisions, language, systems, totals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def business(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt out by id; the exchange also keeps the generator's expressions out of those that read the text."""
    return inputs.rows(spark, sf_dir, inputs.BUSINESS).repartition("doc_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---- scans: two queries for each rule, over business documents and over the documents


def _found_sql(source: str, r: rules.Rule) -> str:
    """Matches marked by two private-use characters, then split; places are running lengths."""
    flags = "(?i)" if "i" in r.flags else ""
    head, body = r.head.replace("'", "''"), r.body.replace("'", "''")
    text = "text"
    if "(?<!" in r.head:  # a character before the match stands in for the look-behind
        kept = r.head[4:-1]
        head = "(?:^|[^" + kept.strip("[]") + "])"
    tail = "" if r.tail == r"(?![\w])" else r.tail
    marked = f"regexp_replace({text}, '{flags}({head})({body}){tail}', '\\1' || chr(57344) || '\\2' || chr(57345), 'g')"
    return (
        f"SELECT doc_id, coalesce(list_sum([len(x) for x in parts[1:i-1]]), 0)::INTEGER AS start_at, parts[i] AS value FROM (SELECT doc_id, parts, unnest(range(2, len(parts) + 1, 2)) AS i "
        f"FROM (SELECT doc_id, string_split_regex({marked}, '[' || chr(57344) || chr(57345) || ']') AS parts FROM {source}))"
    )


def _scan(rule: rules.Rule, table: Callable) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir).select("doc_id", F.explode(find_all(F.col("text"), rule.head, rule.body, rule.tail, rule.flags)).alias("m"))
        return rows.select("doc_id", F.col("m.start").alias("start_at"), F.col("m.value").alias("value"))

    return run


for _r in rules.RULES:
    _plain = "(?<" not in _r.head
    query(f"scan_{_r.name}", _found_sql(f"({inputs.BUSINESS})", _r) if _plain else None)(_scan(_r, business))
for _name in ("email", "ipv4", "credit_card", "password_labeled"):
    query(f"scan_documents_{_name}", _found_sql("documents", rules.BY_NAME[_name]))(_scan(rules.BY_NAME[_name], documents))
for _r in rules.RULES:
    if f"scan_documents_{_r.name}" not in QUERIES:
        query(f"scan_documents_{_r.name}", _found_sql("documents", _r) if "(?<" not in _r.head else None)(_scan(_r, documents))


# ---- checks of identifiers

_VALUE = {
    "luhn": "'4' || lpad(CAST(c_custkey * 7919 % 100000000 AS STRING), 14, '0') || CAST(c_custkey % 10 AS STRING)",
    "iban": "'ES' || lpad(CAST(c_custkey % 97 AS STRING), 2, '0') || ' ' || lpad(CAST(c_custkey * 104729 % 10000000000 AS STRING), 10, '0') || lpad(CAST(c_custkey AS STRING), 10, '0')",
    "dni": f"lpad(CAST(c_custkey * 7919 % 100000000 AS STRING), 8, '0') || substring('{checks.DNI_LETTERS}', CAST(c_custkey % 23 AS INT) + 1, 1)",
    "cuit": "'20-' || lpad(CAST(c_custkey * 7919 % 100000000 AS STRING), 8, '0') || '-' || CAST(c_custkey % 10 AS STRING)",
    "ssn": "lpad(CAST(c_custkey * 31 % 1000 AS STRING), 3, '0') || '-' || lpad(CAST(c_custkey % 12 AS STRING), 2, '0') || '-' || lpad(CAST(c_custkey % 50 * 3 AS STRING), 4, '0')",
    "nif": f"substring('ABCDEFGHJNPQRSUVW', CAST(c_custkey % 17 AS INT) + 1, 1) || lpad(CAST(c_custkey * 7919 % 10000000 AS STRING), 7, '0') || substring('0123456789{checks.NIF_LETTERS}', CAST(c_custkey % 20 AS INT) + 1, 1)",
}
_D = "[CAST(x AS INT) for x in string_split(regexp_replace(v, '[^0-9]', '', 'g'), '')]"
_OK = {
    "luhn": f"list_sum([CASE WHEN (len({_D}) - i) % 2 = 1 THEN CASE WHEN {_D}[i] > 4 THEN 2 * {_D}[i] - 9 ELSE 2 * {_D}[i] END ELSE {_D}[i] END for i in range(1, len({_D}) + 1)]) % 10 = 0",
    "iban": "(((substring(replace(v, ' ', ''), 5) || '1428' || substring(v, 3, 2))::HUGEINT) % 97) = 1",
    "dni": f"substring('{checks.DNI_LETTERS}', (substring(v, 1, 8)::BIGINT % 23 + 1)::INT, 1) = substring(v, 9, 1)",
    "cuit": f"(CASE WHEN 11 - list_sum([{_D}[i] * [5,4,3,2,7,6,5,4,3,2][i] for i in range(1, 11)]) % 11 = 11 THEN 0 WHEN 11 - list_sum([{_D}[i] * [5,4,3,2,7,6,5,4,3,2][i] for i in range(1, 11)]) % 11 = 10 THEN 9 ELSE 11 - list_sum([{_D}[i] * [5,4,3,2,7,6,5,4,3,2][i] for i in range(1, 11)]) % 11 END) = {_D}[11]",
    "ssn": "substring(v, 1, 3) NOT IN ('000', '666') AND substring(v, 1, 1) <> '9' AND substring(v, 5, 2) <> '00' AND substring(v, 8, 4) <> '0000'",
    "nif": f"substring(v, 9, 1) IN (c::VARCHAR, substring('{checks.NIF_LETTERS}', (c + 1)::INT, 1))",
}
_NIF_DIGIT = "(10 - (list_sum([CASE WHEN i % 2 = 1 THEN (CASE WHEN substring(v, i + 1, 1)::INT > 4 THEN 2 * substring(v, i + 1, 1)::INT - 9 ELSE 2 * substring(v, i + 1, 1)::INT END) ELSE substring(v, i + 1, 1)::INT END for i in range(1, 8)])) % 10) % 10"


def _check(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = inputs.rows(spark, sf_dir, f"SELECT c_custkey AS id, {_VALUE[name]} AS v FROM customer")
        return rows.select("id", F.col("v").alias("value"), checks.CHECKS[name](F.col("v")).alias("ok"))

    return run


for _name in checks.CHECKS:
    _c = f", {_NIF_DIGIT} AS c" if _name == "nif" else ""
    query(f"check_{_name}", f"SELECT id, v AS value, ({_OK[_name]}) AS ok FROM (SELECT *{_c} FROM (SELECT c_custkey AS id, {_VALUE[_name]} AS v FROM customer))")(_check(_name))


# ---- language, context, scores

_ES = "el la los las de del que para con por una nombre telefono teléfono direccion dirección fecha cliente cuenta correo documento factura contrato".split()
_EN = "the and for with from your name phone address date customer account email invoice agreement please".split()
_WORDS = r"string_split_regex(lower(text), '[^\p{L}\p{N}_]+')"


@query("detect_language", f"SELECT doc_id, CASE WHEN len(list_filter({_WORDS}, lambda w: w IN {tuple(_ES)})) + 2 * len(regexp_extract_all(text, '[áéíóúñ¿¡ÁÉÍÓÚÑ]')) >= len(list_filter({_WORDS}, lambda w: w IN {tuple(_EN)})) THEN 'es' ELSE 'en' END AS detected FROM documents")
def detect_language(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", language(F.col("text")).alias("detected"))


_NEAR = "lower(substring(text, greatest(p - 45, 1), p - greatest(p - 45, 1)) || substring(text, p, 4 + 45))"


@query("context_hit", f"SELECT doc_id, CASE WHEN contains({_NEAR}, 'cuenta') THEN 'cuenta' WHEN contains({_NEAR}, 'card') THEN 'card' WHEN contains({_NEAR}, 'email') THEN 'email' END AS hit FROM (SELECT *, instr(text, 'IBAN') AS p FROM ({inputs.BUSINESS}))")
def context_hit(spark, sf_dir):
    at = F.instr("text", "IBAN") - 1
    return business(spark, sf_dir).select("doc_id", rules.context_hit(F.col("text"), at, at + 4, ("cuenta", "card", "email")).alias("hit"))


@query("rule_detector")
def rule_detector(spark, sf_dir):
    found = rules.detect(business(spark, sf_dir))
    return found.select("doc_id", F.explode_outer("found").alias("e")).where("e is not null").select("doc_id", "e.start", "e.end", "e.type", F.round("e.score", 6).alias("score"), "e.text", "e.rule", "e.checksum_passed", "e.context_keyword", "e.dob_context", F.size(F.coalesce("e.suppressed", F.array().cast(sp.FIELDS["suppressed"]))).alias("n_suppressed"))


@query("rule_score_card", f"SELECT doc_id, CASE WHEN ok THEN 0.99::DOUBLE ELSE 0.56::DOUBLE END AS score FROM (SELECT doc_id, list_sum([CASE WHEN i % 2 = 1 THEN CASE WHEN v[i]::INT > 4 THEN 2 * v[i]::INT - 9 ELSE 2 * v[i]::INT END ELSE v[i]::INT END for i in range(1, 17)]) % 10 = 0 AS ok FROM (SELECT doc_id, regexp_extract(text, '(Card|Tarjeta): ([0-9]+)', 2) AS v FROM ({inputs.BUSINESS})))")
def rule_score_card(spark, sf_dir):
    rule = rules.BY_NAME["credit_card"]
    rows = business(spark, sf_dir).select("doc_id", F.explode(rules.scan(F.col("text"), rule, 0)).alias("e"))
    return rows.where(F.col("e.text").startswith("4")).where(F.length("e.text") == 16).select("doc_id", F.round("e.score", 6).alias("score"))


@query("dob_retype", f"SELECT doc_id, regexp_extract(text, 'nacimiento: ([0-9/]+)', 1) AS value, 'DATE_OF_BIRTH' AS type FROM ({inputs.BUSINESS}) UNION ALL SELECT doc_id, regexp_extract(text, 'Issued ([0-9-]+)', 1), 'DATE_TIME' FROM ({inputs.BUSINESS})")
def dob_retype(spark, sf_dir):
    rows = business(spark, sf_dir).select("doc_id", F.explode(rules.scan(F.col("text"), rules.BY_NAME["date_numeric"], 0)).alias("e"))
    return rows.where(F.col("e.text").rlike("[/-]")).select("doc_id", F.col("e.text").alias("value"), F.col("e.type").alias("type"))


@query("softmax_margin")
def softmax_margin(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("p", scores.softmax(F.col("embedding")))
    return rows.select("vec_id", F.round(F.array_max("p"), 9).alias("top"), F.round(scores.margin(F.col("p")), 9).alias("margin"))


SQL["softmax_margin"] = "SELECT vec_id, round(s[1] / t, 9) AS top, round((s[1] - s[2]) / t, 9) AS margin FROM (SELECT vec_id, list_reverse_sort(e) AS s, list_sum(e) AS t FROM (SELECT vec_id, [exp(x::DOUBLE - list_max(embedding)::DOUBLE) for x in embedding] AS e FROM embeddings))"


# ---- spans

def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, entities) of the order lines' spans."""
    rows = inputs.rows(spark, sf_dir, inputs.SPANS)
    e = sp.entity(ord=F.col("ord"), start=F.col("s"), end=F.col("e"), type=F.col("type"), score=F.col("score"), source=F.col("source"), text=F.col("value"), checksum=F.when(F.col("passed").isNotNull(), F.lit("luhn")), checksum_passed=F.col("passed"))
    return rows.groupBy("doc_id").agg(F.collect_list(e).alias("entities")).withColumn("entities", sp.by(F.col("entities"), lambda x: x["ord"]))


_S = inputs.SPANS
_PRIORITY = "CASE type " + " ".join(f"WHEN '{k[0]}' THEN {k[1]}" for k in KINDS) + " END"
_RANKED = f"(SELECT *, CASE WHEN passed THEN 1 WHEN NOT passed THEN -1 ELSE 0 END AS ck, {_PRIORITY} AS prio FROM ({_S}))"
_CLUSTERED = f"(SELECT *, sum(CASE WHEN s < pm THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, e, ord) AS c FROM (SELECT *, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS pm FROM {_RANKED}))"
_FUSED = (
    f"(SELECT q.doc_id, q.c, q.s, q.e, q.type, CASE WHEN count(*) FILTER (agrees) > 1 THEN 1 - product(CASE WHEN agrees THEN 1 - m.score ELSE 1 END) ELSE q.score END * CASE WHEN count(*) FILTER (m.type <> q.type) > 0 THEN 0.75 ELSE 1 END AS score, count(*) FILTER (agrees) AS n_agreeing, count(DISTINCT m.type) FILTER (m.type <> q.type) AS n_conflicts, string_agg(DISTINCT m.source, '+' ORDER BY m.source) AS source "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, c ORDER BY ck DESC, score DESC, prio DESC, e - s DESC, s, e, ord) AS rn FROM {_CLUSTERED}) q "
    f"JOIN (SELECT a.*, b.ord AS word, (a.type = b.type AND (a.ord = b.ord OR CAST(greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) AS DOUBLE) / (greatest(a.e, b.e) - least(a.s, b.s)) >= 0.5)) AS agrees FROM {_CLUSTERED} a JOIN {_CLUSTERED} b ON a.doc_id = b.doc_id AND a.c = b.c) m ON m.doc_id = q.doc_id AND m.c = q.c AND m.word = q.ord WHERE q.rn = 1 GROUP BY q.doc_id, q.c, q.s, q.e, q.type, q.score)"
)


@query("span_overlap_pairs", f"SELECT a.doc_id, a.ord AS a, b.ord AS b, round(CAST(least(a.e, b.e) - greatest(a.s, b.s) AS DOUBLE) / (greatest(a.e, b.e) - least(a.s, b.s)), 9) AS iou FROM ({_S}) a JOIN ({_S}) b ON a.doc_id = b.doc_id AND a.ord < b.ord AND a.s < b.e AND b.s < a.e")
def span_overlap_pairs(spark, sf_dir):
    rows = inputs.rows(spark, sf_dir, _S).select("doc_id", F.struct("ord", F.col("s").alias("start"), F.col("e").alias("end")).alias("x"))
    a, b = rows.withColumnRenamed("x", "a"), rows.withColumnRenamed("x", "b")
    pairs = a.join(b, "doc_id").where(F.col("a.ord") < F.col("b.ord")).where(scores.overlaps(F.col("a"), F.col("b")))
    return pairs.select("doc_id", F.col("a.ord").alias("a"), F.col("b.ord").alias("b"), F.round(scores.iou(F.col("a"), F.col("b")), 9).alias("iou"))


@query("span_clusters", f"SELECT doc_id, min(s) AS first_start, max(e) AS last_end, count(*)::INTEGER AS n FROM {_CLUSTERED} GROUP BY doc_id, c")
def span_clusters(spark, sf_dir):
    rows = line_spans(spark, sf_dir).select("doc_id", F.explode(sp.clusters(F.col("entities"))).alias("c"))
    return rows.select("doc_id", F.array_min(F.transform("c", lambda e: e["start"])).alias("first_start"), F.array_max(F.transform("c", lambda e: e["end"])).alias("last_end"), F.size("c").alias("n"))


@query("span_resolve")
def span_resolve(spark, sf_dir):
    rows = line_spans(spark, sf_dir).select("doc_id", F.explode(sp.resolve(F.col("entities"))).alias("e"))
    return rows.select("doc_id", "e.ord", "e.start", "e.end", "e.type", F.size(F.coalesce("e.suppressed", F.array().cast(sp.FIELDS["suppressed"]))).alias("n_suppressed"))


@query("span_trim", f"SELECT doc_id, trim(split_part(substring(text, 4, 60), chr(10), 1), ' .,;:!?()') AS value FROM ({inputs.BUSINESS})")
def span_trim(spark, sf_dir):
    e = F.array(sp.entity(start=F.lit(3), end=F.lit(63), type=F.lit("PERSON"), score=F.lit(1.0)))
    return business(spark, sf_dir).select("doc_id", sp.normalize(F.col("text"), e)[0]["text"].alias("value"))


@query("fuse", f"SELECT doc_id, s AS start_at, e AS end_at, type, round(score, 9) AS score, n_agreeing::INTEGER AS n_agreeing, n_conflicts::INTEGER AS n_conflicts, source FROM {_FUSED}")
def fuse(spark, sf_dir):
    rows = line_spans(spark, sf_dir).select("doc_id", F.explode(fusion.fuse(F.col("entities"))).alias("e"))
    return rows.select("doc_id", F.col("e.start").alias("start_at"), F.col("e.end").alias("end_at"), "e.type", F.round("e.score", 9).alias("score"), "e.n_agreeing", F.size("e.conflicting_types").alias("n_conflicts"), "e.source")


@query("unify_repeats", f"SELECT doc_id, ord, max(score) OVER (PARTITION BY doc_id, value, type) AS score, CASE WHEN max(score) OVER (PARTITION BY doc_id, value, type) > score THEN score END AS before FROM ({_S})")
def unify_repeats(spark, sf_dir):
    rows = line_spans(spark, sf_dir).select("doc_id", F.explode(routing.unify(F.col("entities"))).alias("e"))
    return rows.select("doc_id", "e.ord", "e.score", F.col("e.score_before_repeat_propagation").alias("before"))


_HIGH = "type IN ('CREDENTIAL','CREDIT_CARD','BANK_ACCOUNT','GOV_ID')"


@query("route_policy", f"SELECT doc_id, ord, CASE WHEN score < 0.5 AND NOT coalesce(passed, false) THEN 'discard' WHEN score < 0.5 OR NOT coalesce(passed, true) OR ({_HIGH} AND score < 0.95) OR score < 0.9 THEN 'review' ELSE 'auto_redact' END AS decision, CASE WHEN score < 0.5 AND NOT coalesce(passed, false) THEN 1 ELSE greatest(1, (score < 0.5)::INT + (NOT coalesce(passed, true))::INT + ({_HIGH} AND score < 0.95)::INT + (score < 0.9)::INT) END AS n_reasons FROM ({_S})")
def route_policy(spark, sf_dir):
    rows = line_spans(spark, sf_dir).select("doc_id", F.explode(routing.route(F.col("entities"), routing.Policy())).alias("e"))
    return rows.select("doc_id", "e.ord", "e.decision", F.size("e.decision_reasons").alias("n_reasons"))


@query("route_reasons")
def route_reasons(spark, sf_dir):
    rows = line_spans(spark, sf_dir).withColumn("f", fusion.fuse(F.col("entities"))).withColumn("r", routing.route(F.col("f"), routing.Policy()))
    return rows.select("doc_id", F.explode("r").alias("e")).select("doc_id", "e.start", "e.decision", F.array_join("e.decision_reasons", "; ").alias("reasons"))


# ---- calibration

def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.rows(spark, sf_dir, inputs.SAMPLES).withColumnRenamed("grp", "group")


_BIN = f"(SELECT *, CAST(ceil(round(score * 10, 9)) AS INT) AS bin FROM ({inputs.SAMPLES}))"


@query("calibration_error", f"SELECT sum(k)::BIGINT AS n, round(sum(k * gap) / sum(k), 9) AS ece FROM (SELECT count(*) AS k, abs(avg(correct::DOUBLE) - avg(score)) AS gap FROM {_BIN} GROUP BY bin)")
def calibration_error(spark, sf_dir):
    return calibration.calibration_error(samples(spark, sf_dir)).select("n", F.round("ece", 9).alias("ece"))


@query("reliability_bins", f"SELECT b::INTEGER AS bin, coalesce(k, 0)::BIGINT AS n, round(coalesce(conf, 0), 9) AS conf, round(coalesce(acc, 0), 9) AS acc FROM (SELECT unnest(range(1, 11)) AS b) LEFT JOIN (SELECT bin, count(*) AS k, avg(score) AS conf, avg(correct::DOUBLE) AS acc FROM {_BIN} GROUP BY bin) ON b = bin")
def reliability(spark, sf_dir):
    r = calibration.reliability_bins(samples(spark, sf_dir))
    return r.select(F.round(F.col("bin_upper") * 10).cast("int").alias("bin"), F.col("count").alias("n"), F.round("mean_confidence", 9).alias("conf"), F.round("accuracy", 9).alias("acc"))


@query("calibrate_apply", f"SELECT doc_id, ord, round(CASE WHEN source = 'rules' AND type = 'EMAIL' THEN 1 / (1 + exp(-(0.5 * ln(score / (1 - score)) + 0.25))) WHEN source = 'ner' AND type = 'PERSON' THEN 1 / (1 + exp(-(-1.5))) ELSE score END, 9) AS score, source || '|' || type AS grp FROM ({_S})")
def calibrate_apply(spark, sf_dir):
    c = calibration.Calibrator(1.0, 0.0, True, {"rules|EMAIL": (0.5, 0.25), "ner|PERSON": (0.0, -1.5)})
    rows = line_spans(spark, sf_dir).select("doc_id", F.explode(calibration.apply(F.col("entities"), c)).alias("e"))
    return rows.select("doc_id", "e.ord", F.round("e.score", 9).alias("score"), F.col("e.calibration_group").alias("grp"))


@query("platt_global")
def platt_global(spark, sf_dir):
    return calibration.fit_global(samples(spark, sf_dir)).select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "fitted", "n")


@query("platt_grouped")
def platt_grouped(spark, sf_dir):
    return calibration.fit_groups(samples(spark, sf_dir)).select("group", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("calibration_report")
def calibration_report(spark, sf_dir):
    s = samples(spark, sf_dir)
    return calibration.compare(s, calibration.fit(s))


# ---- rewriting

_EMAIL = r"(?i)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,63}\b"


@query("redact_mask_email", f"SELECT doc_id, regexp_replace(text, '{_EMAIL}', '[EMAIL]', 'g') AS redacted FROM documents")
def redact_mask_email(spark, sf_dir):
    rows = rules.detect(documents(spark, sf_dir).withColumn("lang", F.lit("en")), (rules.BY_NAME["email"],))
    return rows.select("doc_id", rewriting.redact(F.col("text"), F.col("found"), F.col("lang"))["redacted_text"].alias("redacted"))


def _hmac_sql(value: str) -> str:
    block = rewriting.DEMO_KEY.ljust(64, b"\0")
    inner, outer = ("".join(f"\\x{b ^ pad:02X}" for b in block) for pad in (0x36, 0x5C))
    return f"substring(sha256('{outer}'::BLOB || unhex(sha256('{inner}'::BLOB || encode({value})))), 1, 6)"


@query("redact_pseudonym_email", f"SELECT doc_id, '[EMAIL:' || {_hmac_sql(chr(39) + 'EMAIL:' + chr(39) + ' || lower(v)')} || ']' AS tag FROM (SELECT doc_id, regexp_extract(text, 'Email: (\\S+)', 1) AS v FROM ({inputs.BUSINESS}))")
def redact_pseudonym_email(spark, sf_dir):
    rows = rules.detect(business(spark, sf_dir), (rules.BY_NAME["email"],))
    return rows.select("doc_id", rewriting.replacement(F.col("found")[0], F.col("lang"), rewriting.PSEUDONYM).alias("tag"))


@query("redact_partial_card", f"SELECT doc_id, CASE WHEN lang = 'en' THEN '[CREDIT_CARD_****' ELSE '[TARJETA_****' END || right(regexp_extract(text, '(Card|Tarjeta): ([0-9]+)', 2), 4) || ']' AS tag FROM ({inputs.BUSINESS})")
def redact_partial_card(spark, sf_dir):
    rows = business(spark, sf_dir).withColumn("e", F.filter(rules.scan(F.col("text"), rules.BY_NAME["credit_card"], 0), lambda e: e["text"].startswith("4") & (F.length(e["text"]) == 16)))
    return rows.select("doc_id", rewriting.replacement(F.col("e")[0], F.col("lang"), rewriting.PARTIAL).alias("tag"))


@query("sweep_repeats", f"SELECT doc_id, count(*)::INTEGER AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) FROM ({inputs.BUSINESS})) GROUP BY doc_id")
def sweep_repeats(spark, sf_dir):
    rows = rules.detect(business(spark, sf_dir), (rules.BY_NAME["email"],)).withColumn("first", F.slice("found", 1, 1))
    return rows.select("doc_id", F.size(rewriting.sweep(F.col("text"), F.col("first"))).alias("n"))


@query("markers", "SELECT doc_id, CASE WHEN lang = 'en' THEN '[PHONE]' ELSE '[TELEFONO]' END AS phone FROM documents")
def markers(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", marker(F.lit("PHONE"), F.col("lang")).alias("phone"))


def _redacted(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = Pipeline(Config(mode=mode)).transform(business(spark, sf_dir))
        return out.select("doc_id", "redacted_text", F.size("replacements").alias("n"), F.size("leaks").alias("n_leaks"))

    return run


for _mode in (rewriting.MASK, rewriting.PARTIAL, rewriting.PSEUDONYM):
    query(f"pipeline_{_mode}")(_redacted(_mode))


@query("pipeline_documents")
def pipeline_documents(spark, sf_dir):
    out = Pipeline().transform(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "lang", "redacted_text", "stats.n_entities", "stats.n_review", F.size("leaks").alias("n_leaks"))


@query("pipeline_totals")
def pipeline_totals(spark, sf_dir):
    return totals(Pipeline().transform(business(spark, sf_dir)))


@query("pipeline_audit")
def pipeline_audit(spark, sf_dir):
    out = Pipeline().transform(business(spark, sf_dir))
    return audit(out.withColumn("n_decisions", F.size(decisions(F.col("entities")))), "n_decisions").select("doc_id", "audit", "n_decisions")


@query("pipeline_review_items")
def pipeline_review_items(spark, sf_dir):
    p = Pipeline()
    return p.review_items(p.transform(business(spark, sf_dir)), F.lit("2024-01-01 00:00:00").cast("timestamp"))


@query("replacement_offsets")
def replacement_offsets(spark, sf_dir):
    out = Pipeline().transform(business(spark, sf_dir))
    rows = out.select("doc_id", "text", "redacted_text", F.explode_outer("replacements").alias("r")).where("r is not null")
    return rows.select("doc_id", "r.source_start", "r.redacted_start", (F.expr("substring(text, r.source_start + 1, r.source_end - r.source_start) = r.original and substring(redacted_text, r.redacted_start + 1, r.redacted_end - r.redacted_start) = r.replacement")).alias("holds"))


# ---- review queue

_LATEST = f"(SELECT i.id, document_id, score, coalesce(v.status, 'pending') AS status, coalesce(v.reviewer_note, '') AS reviewer_note FROM ({inputs.ITEMS}) i LEFT JOIN (SELECT id, status, reviewer_note, row_number() OVER (PARTITION BY id ORDER BY resolved_at DESC, status DESC, reviewer_note DESC) AS n FROM ({inputs.VERDICTS})) v ON v.id = i.id AND v.n = 1)"


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.latest(inputs.rows(spark, sf_dir, inputs.ITEMS), inputs.rows(spark, sf_dir, inputs.VERDICTS))


@query("queue_latest_state", f"SELECT * FROM {_LATEST}")
def queue_latest_state(spark, sf_dir):
    return state(spark, sf_dir).select("id", "document_id", "score", "status", "reviewer_note")


@query("queue_pending_topk", f"SELECT id, score FROM {_LATEST} WHERE status = 'pending' ORDER BY score, id LIMIT 100")
def queue_pending_topk(spark, sf_dir):
    return review.pending(state(spark, sf_dir)).select("id", "score")


@query("queue_newest", f"SELECT id, status FROM {_LATEST} ORDER BY id DESC LIMIT 500")
def queue_newest(spark, sf_dir):
    return review.newest(state(spark, sf_dir)).select("id", "status")


@query("queue_stats", f"SELECT status, count(*) AS n FROM {_LATEST} GROUP BY status")
def queue_stats(spark, sf_dir):
    return review.stats(state(spark, sf_dir))


@query("context_snippet", f"SELECT doc_id, replace('...' || substring(text, p - 60, 60) || '<<IBAN>>' || substring(text, p + 4, 60) || '...', chr(10), ' ') AS snippet FROM (SELECT *, instr(text, 'IBAN') AS p FROM ({inputs.BUSINESS}))")
def context_snippet(spark, sf_dir):
    at = F.instr("text", "IBAN") - 1
    return business(spark, sf_dir).select("doc_id", review.context_snippet(F.col("text"), at, at + 4).alias("snippet"))


# ---- evaluation

def gold_and_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    def side(sql: str, name: str) -> DataFrame:
        s = F.struct(F.col("s").alias("start"), F.col("e").alias("end"), "type", F.lit(0.9).alias("score"), F.lit("rules").alias("group"))
        return inputs.rows(spark, sf_dir, sql).groupBy("doc_id").agg(F.sort_array(F.collect_list(s)).alias(name))

    none = F.array().cast(f"array<{evaluation.SPAN}>")
    both = side(inputs.GOLD, "gold").join(side(inputs.PRED, "pred"), "doc_id", "full")
    return both.select("doc_id", F.lit("").alias("text"), F.coalesce("gold", none).alias("gold"), F.coalesce("pred", none).alias("pred"))


_PAIR = f"(SELECT coalesce(g.type, p.type) AS type, g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL AS tp, p.doc_id IS NULL AS fn FROM ({inputs.GOLD}) g FULL JOIN ({inputs.PRED}) p ON g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e AND g.type = p.type)"
_PART = f"(SELECT coalesce(g.type, p.type) AS type, g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL AS tp, p.doc_id IS NULL AS fn FROM ({inputs.GOLD}) g FULL JOIN ({inputs.PRED}) p ON g.doc_id = p.doc_id AND g.ord = p.ord AND g.type = p.type AND CAST(p.e - p.s AS DOUBLE) / (g.e - g.s) >= 0.5)"
_PRF = "SELECT type, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn FROM (SELECT type, (count(*) FILTER (tp))::DOUBLE AS tp, (count(*) FILTER (NOT tp AND NOT fn))::DOUBLE AS fp, (count(*) FILTER (fn))::DOUBLE AS fn FROM {} GROUP BY type)"


def _prf(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evaluation.by_type(evaluation.aligned(gold_and_pred(spark, sf_dir), mode)).select("type", "precision", "recall", "tp", "fp", "fn")

    return run


query("match_exact_by_type", _PRF.format(_PAIR))(_prf("exact"))
query("match_partial_by_type", _PRF.format(_PART))(_prf("partial"))


@query("match_overall", f"SELECT round(sum(tp::INT) / count(*) FILTER (tp OR NOT fn), 4) AS precision, round(sum(tp::INT) / count(*) FILTER (tp OR fn), 4) AS recall, sum(tp::INT)::BIGINT AS tp FROM {_PAIR}")
def match_overall(spark, sf_dir):
    return evaluation.overall(evaluation.aligned(gold_and_pred(spark, sf_dir))).select("precision", "recall", "tp")


_CH = "(SELECT DISTINCT doc_id, unnest(range(s, e)) AS c FROM ({}))"


@query("privacy_characters", f"SELECT round(count(*) FILTER (g AND NOT p) / count(*) FILTER (g), 4) AS char_leakage_rate, round(count(*) FILTER (g AND p) / count(*) FILTER (g), 4) AS char_coverage FROM (SELECT x.c IS NOT NULL AS g, y.c IS NOT NULL AS p FROM {_CH.format(inputs.GOLD)} x FULL JOIN {_CH.format(inputs.PRED)} y ON x.doc_id = y.doc_id AND x.c = y.c)")
def privacy_characters(spark, sf_dir):
    return evaluation.privacy(evaluation.aligned(gold_and_pred(spark, sf_dir))).select("char_leakage_rate", "char_coverage")


@query("merge_adjacent", f"SELECT doc_id, min(s)::INTEGER AS start_at, max(e)::INTEGER AS end_at, min(score) AS score FROM (SELECT *, sum(CASE WHEN s - pm <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, e, ord) AS c FROM (SELECT *, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -9) AS pm FROM ({_S}))) GROUP BY doc_id, c")
def merge_adjacent(spark, sf_dir):
    s = F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.lit("X").alias("type"), e["score"].alias("score"), F.lit("g").alias("group")))
    rows = line_spans(spark, sf_dir).select("doc_id", F.explode(sp.merge_adjacent(s, F.lit(""))).alias("m"))
    return rows.select("doc_id", F.col("m.start").alias("start_at"), F.col("m.end").alias("end_at"), "m.score")


@query("calibration_samples")
def calibration_samples(spark, sf_dir):
    return evaluation.samples(gold_and_pred(spark, sf_dir))


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic document for each customer; dealt out, so that what made a text stays out of what reads it."""
    return synthetic.from_numbers(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("n"))).repartition("id")


def _stub(docs: DataFrame, into: str) -> DataFrame:
    """A second detector for the comparison: capitalised names after a label, as an outside recognizer would give them."""
    found = F.transform(find_all(F.col("text"), r"(?:Nombre|Full name): ", r"[A-Z][a-z]+ [A-Z][a-z]+", flags="(?U)"), lambda m, i: sp.entity(ord=i, start=m["start"], end=m["end"], type=F.lit("PERSON"), score=F.lit(0.85), source=F.lit("ner"), text=m["value"]))
    return docs.withColumn(into, found)


@query("system_ladder")
def system_ladder(spark, sf_dir):
    rows = made(spark, sf_dir)
    gold = rows.select(F.col("id").alias("doc_id"), "text", "lang", F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["type"].alias("type"), F.lit(1.0).alias("score"), F.lit("gold").alias("group"))).alias("gold"))
    return compare_systems(gold, systems({"ner": _stub}), "partial")


# ---- corpus

def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source_text, privacy_mask, language): texts of numbered places, some annotations off."""
    rows = inputs.rows(spark, sf_dir, inputs.ANNOTATIONS)
    value = F.when(F.col("wrong"), F.lit("?")).otherwise(F.concat(F.lit("w"), F.lpad(F.col("ord").cast("string"), 4, "0")))
    mask = F.struct(F.col("ord"), F.col("label"), F.col("s").alias("start"), F.col("e").alias("end"), value.alias("value"))
    by = rows.groupBy("id").agg(F.sort_array(F.collect_list(mask)).alias("m"))
    text = F.lit(" " * 8 + "".join(f"w{i:04d}   " for i in range(1, 8)))
    strip = F.transform("m", lambda m: F.struct(m["label"].alias("label"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    return by.select("id", text.alias("source_text"), strip.alias("privacy_mask"), F.when(F.col("id") % 2 == 0, "English").otherwise("Spanish").alias("language"))


_LABEL = "upper(trim(label))"
_REASON = f"CASE WHEN {_LABEL} NOT IN ('EMAIL', 'GIVENNAME1', 'CITY') THEN {_LABEL} WHEN s < 0 OR e > 64 THEN '__bad_offset__' || {_LABEL} WHEN s <> ord * 8 OR wrong THEN '__offset_mismatch__' || {_LABEL} END"


@query("dropped_labels", f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM ({inputs.ANNOTATIONS})) WHERE reason IS NOT NULL GROUP BY reason")
def dropped_labels(spark, sf_dir):
    return corpus.dropped_labels(corpus.clean(annotations(spark, sf_dir)))


@query("clean_annotations", f"SELECT id, s AS start_at, CASE {_LABEL} WHEN 'EMAIL' THEN 'EMAIL' WHEN 'GIVENNAME1' THEN 'PERSON' ELSE 'ADDRESS' END AS type FROM (SELECT *, {_REASON} AS reason FROM ({inputs.ANNOTATIONS})) WHERE reason IS NULL")
def clean_annotations(spark, sf_dir):
    rows = corpus.clean(annotations(spark, sf_dir)).select("id", F.explode("entities").alias("e"))
    return rows.select("id", F.col("e.start").alias("start_at"), "e.type")


@query("split_summary", f"SELECT CASE WHEN id % 2 = 0 THEN 'en' ELSE 'es' END AS lang, count(*) AS docs, sum(n)::BIGINT AS entities, count(*) FILTER (n = 0) AS docs_without_pii FROM (SELECT id, count(*) FILTER (reason IS NULL) AS n FROM (SELECT *, {_REASON} AS reason FROM ({inputs.ANNOTATIONS})) GROUP BY id) GROUP BY 1")
def split_summary(spark, sf_dir):
    return corpus.summary(corpus.clean(annotations(spark, sf_dir)), "lang")


@query("label_inventory", f"SELECT label, count(*) AS n, arg_min(CASE WHEN wrong THEN '?' ELSE 'w' || lpad(ord::VARCHAR, 4, '0') END, (id, ord)) AS example FROM ({inputs.ANNOTATIONS}) GROUP BY label")
def label_inventory(spark, sf_dir):
    return corpus.label_inventory(annotations(spark, sf_dir))


@query("balanced_sample")
def balanced_sample(spark, sf_dir):
    return corpus.balanced_sample(documents(spark, sf_dir).select("doc_id", "lang"), 200, key="doc_id")


@query("carve_splits")
def carve_splits(spark, sf_dir):
    return corpus.carve(documents(spark, sf_dir).select("doc_id", "lang"), 100, 50, key="doc_id")


@query("lang_source_crosstab", "SELECT lang, count(*) FILTER (source = 'src0') AS src0, count(*) FILTER (source = 'src1') AS src1, count(*) FILTER (source = 'src2') AS src2, count(*) FILTER (source IS NULL OR source NOT IN ('src0', 'src1', 'src2')) AS other FROM documents GROUP BY lang")
def lang_source_crosstab(spark, sf_dir):
    """Three sources in columns of their own, all others and null in `other`."""
    source = F.when(F.col("source").isin("src0", "src1", "src2"), F.col("source")).otherwise("other")
    return corpus.crosstab(documents(spark, sf_dir).withColumn("source", source), "lang", "source", ["src0", "src1", "src2", "other"])


@query("lang_source_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def lang_source_counts(spark, sf_dir):
    """The crosstab of all sources, in long form."""
    return documents(spark, sf_dir).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("synthetic_documents")
def synthetic_documents(spark, sf_dir):
    rows = made(spark, sf_dir)
    return rows.select("id", "lang", "doc_type", "locale", "text", F.size("entities").alias("n_entities"))


@query("best_system", "SELECT l_shipdate::DATE::VARCHAR AS day, arg_min(l_returnflag, (-l_discount, l_returnflag)) AS system, max(l_discount) AS f1 FROM lineitem GROUP BY 1")
def best_system(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_date("l_shipdate").cast("string").alias("day"), F.col("l_returnflag").alias("system"), F.col("l_discount").alias("f1"))
    return evaluation.best_system(rows, "day")


# ---- tokens

_TAG = "CASE WHEN l_partkey % 3 = 0 THEN 'O' WHEN l_partkey % 3 = 1 THEN 'B-' ELSE 'I-' END || CASE WHEN l_partkey % 3 = 0 THEN '' WHEN l_suppkey % 2 = 0 THEN 'PERSON' ELSE 'EMAIL' END"
_TOKENS = f"SELECT l_orderkey AS doc_id, line AS ord, {_TAG} AS label, CAST(line * 10 AS INT) AS s, CAST(line * 10 + 6 AS INT) AS e, CAST(50 + l_partkey % 50 AS DOUBLE) / 100 AS prob FROM {inputs.LINES} l"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.struct("ord", "label", F.col("s").alias("start"), F.col("e").alias("end"), "prob", F.lit(0.5).alias("margin"))
    return inputs.rows(spark, sf_dir, _TOKENS).groupBy("doc_id").agg(F.sort_array(F.collect_list(t)).alias("tokens"))


@query("bio_decode", f"SELECT doc_id, min(s) AS start_at, max(e) AS end_at, max(substring(label, 3)) AS type, count(*)::INTEGER AS n_tokens, round(exp(avg(ln(prob))), 9) AS score FROM (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY ord) AS c FROM (SELECT *, CASE WHEN label LIKE 'I-%' AND lag(label) OVER w IN ('I-' || substring(label, 3), 'B-' || substring(label, 3)) THEN 0 ELSE 1 END AS b FROM ({_TOKENS}) WINDOW w AS (PARTITION BY doc_id ORDER BY ord))) WHERE label <> 'O' GROUP BY doc_id, c")
def bio_decode(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("doc_id", F.explode(tokens.decode(F.col("tokens"))).alias("s"))
    return rows.select("doc_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), "s.type", "s.n_tokens", F.round("s.score", 9).alias("score"))


@query("token_window_dedup", f"SELECT doc_id, s AS start_at, type, score, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s, e, type ORDER BY score DESC, ord) AS n FROM (SELECT doc_id, ord, s // 40 * 40 AS s, s // 40 * 40 + 9 AS e, type, score FROM ({_S}))) WHERE n = 1")
def token_window_dedup(spark, sf_dir):
    rows = inputs.rows(spark, sf_dir, _S).select("doc_id", F.col("ord").alias("window"), (F.floor(F.col("s") / 40) * 40).cast("int").alias("start"), "type", "score").withColumn("end", F.col("start") + 9)
    return tokens.dedup_windows(rows).select("doc_id", F.col("start").alias("start_at"), "type", "score", F.col("window").alias("ord"))


@query("token_align")
def token_align(spark, sf_dir):
    rows = made(spark, sf_dir).withColumn("tokens", tokens.words(F.col("text")))
    rows = rows.select("id", F.posexplode(tokens.align(F.col("tokens"), F.col("entities"))).alias("pos", "label"))
    return rows.groupBy("id").agg(F.count_if(F.col("label").startswith("B-")).alias("n_begin"), F.count_if(F.col("label") == "O").alias("n_out"))


@query("token_windows", "SELECT doc_id, greatest(1, ceil((n - 2) / 3.0))::INTEGER AS n_windows FROM (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1)")
def token_windows(spark, sf_dir):
    return labelled(spark, sf_dir).select("doc_id", F.size(tokens.windows(F.col("tokens"), 5, 2)).alias("n_windows"))


@query("type_priority", f"SELECT doc_id, ord, {_PRIORITY} AS priority FROM ({_S})")
def type_priority(spark, sf_dir):
    return inputs.rows(spark, sf_dir, _S).select("doc_id", "ord", priority(F.col("type")).alias("priority"))
