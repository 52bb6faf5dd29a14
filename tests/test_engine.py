"""Detection, fusion, routing and rewriting on small texts."""

import hmac
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cloakwork.functions import checks
from cloakwork.operators import calibration, evaluation, fusion, rewriting, routing, rules
from cloakwork.operators import spans as sp
from cloakwork.operators.review import ReviewQueue
from cloakwork.plans.pipeline import Config, Pipeline, language
from cloakwork.sources import synthetic

CASES = [
    ("luhn", "4111 1111 1111 1111", True), ("luhn", "4111111111111111", True), ("luhn", "4111111111111112", False), ("luhn", "42", False), ("luhn", "", False),
    ("iban", "ES91 2100 0418 4502 0005 1332", True), ("iban", "GB82WEST12345698765432", True), ("iban", "ES91 2100 0418 4502 0005 1333", False), ("iban", "hello", False),
    ("dni", "12345678Z", True), ("dni", "X1234567L", True), ("dni", "12345678A", False),
    ("cuit", "20-12345678-6", True), ("cuit", "20-12345678-5", False),
    ("ssn", "123-45-6789", True), ("ssn", "666-45-6789", False), ("ssn", "900-45-6789", False),
    ("nif", "A58818501", True), ("nif", "A58818502", False),
]


def test_checks(spark):
    rows = spark.createDataFrame(CASES, "name string, value string, ok boolean")
    for name, check in checks.CHECKS.items():
        assert rows.where(F.col("name") == name).where(check(F.col("value")) != F.col("ok")).collect() == []


def _found(spark, text, lang="es"):
    rows = Pipeline().transform(spark.createDataFrame([(1, text, lang)], "doc_id long, text string, lang string"))
    return rows.first()


def test_detection_lines_and_context(spark):
    r = _found(spark, "DNI 12345678Z, tel. 612 34 56 78, mail ana@example.com, IP 10.0.0.1\nFecha de nacimiento: 01/02/1980\nFecha de emisión: 03/04/2020")
    kinds = {e.text: e.type for e in r.entities}
    assert kinds["12345678Z"] == "GOV_ID" and kinds["ana@example.com"] == "EMAIL" and kinds["10.0.0.1"] == "IP_ADDRESS"
    assert kinds["01/02/1980"] == "DATE_OF_BIRTH" and kinds["03/04/2020"] == "DATE_TIME"
    assert all("\n" not in e.text for e in r.entities if e.type != "ADDRESS")
    assert not r.leaks and "ana@example.com" not in r.redacted_text
    for x in r.replacements:
        assert r.text[x.source_start : x.source_end] == x.original and r.redacted_text[x.redacted_start : x.redacted_end] == x.replacement


def test_valid_iban_beats_a_card_inside(spark):
    r = _found(spark, "Cuenta ES91 2100 0418 4502 0005 1332")
    assert [e.type for e in r.entities] == ["BANK_ACCOUNT"]


def test_null_empty_and_other_languages(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "", "es"), (3, "a@b.com", "de")], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in Pipeline().transform(rows).collect()}
    assert out[1].entities == [] and out[2].redacted_text == "" and out[3].entities == []
    assert Pipeline().transform(rows.limit(0)).count() == 0


def _entity(**k):
    return sp.entity(**{n: F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for n, v in k.items()})


def test_fusion_conflict_and_agreement(spark):
    one = spark.range(1)
    a, b = _entity(start=0, end=5, type="EMAIL", score=0.8, source="rules", text="x"), _entity(start=0, end=5, type="EMAIL", score=0.5, source="ner", text="x")
    e = one.select(fusion.fuse(F.array(a, b)).alias("f")).first().f
    assert len(e) == 1 and e[0].score == pytest.approx(0.9) and e[0].agreement and e[0].source == "ner+rules"
    c = _entity(start=0, end=5, type="PHONE", score=0.5, source="ner", text="x")
    e = one.select(fusion.fuse(F.array(a, c)).alias("f")).first().f
    assert e[0].conflicting_types == ["PHONE"] and e[0].score == pytest.approx(0.6)


@pytest.mark.parametrize("fields,decision", [
    ({"type": "EMAIL", "score": 0.99, "agreement": True}, "auto_redact"),
    ({"type": "EMAIL", "score": 0.60}, "review"),
    ({"type": "EMAIL", "score": 0.10}, "discard"),
    ({"type": "CREDIT_CARD", "score": 0.92, "agreement": True}, "review"),
    ({"type": "BANK_ACCOUNT", "score": 0.42, "checksum": "iban", "checksum_passed": True}, "review"),
])
def test_policy(spark, fields, decision):
    e = _entity(start=0, end=5, text="x", source="rules", **fields)
    assert spark.range(1).select(routing.Policy().decide(e)["decision"]).first()[0] == decision


def test_unify_and_sweep(spark):
    text = "Ana Gil wrote. Ana Gil signed. Ana Gilmore too."
    a, b = _entity(start=0, end=7, type="PERSON", score=0.51, text="Ana Gil"), _entity(start=15, end=22, type="PERSON", score=0.48, text="ana gil")
    got = spark.range(1).select(routing.unify(F.array(a, b)).alias("u"), rewriting.sweep(F.lit(text), F.array(a)).alias("s")).first()
    assert [e.score for e in got.u] == [0.51, 0.51]
    assert [(e.start, e.end) for e in got.s] == [(0, 7), (15, 22)]


def test_modes_and_pseudonyms(spark):
    e = _entity(start=0, end=16, type="CREDIT_CARD", score=0.9, text="4111111111111111")
    tag = hmac.new(b"k", b"CREDIT_CARD:4111111111111111", sha256).hexdigest()[:6]
    got = spark.range(1).select(*[rewriting.replacement(e, F.lit("en"), m, b"k") for m in ("mask", "partial", "pseudonymize")]).first()
    assert list(got) == ["[CREDIT_CARD]", "[CREDIT_CARD_****1111]", f"[CREDIT_CARD:{tag}]"]


def test_resolve_matches_a_loop(spark):
    import random

    rng = random.Random(3)
    for _ in range(3):
        rows = [(s := rng.randrange(40), s + rng.randrange(1, 12), rng.choice(["EMAIL", "PHONE"]), rng.randrange(40, 99) / 100) for _ in range(12)]
        pri = {"EMAIL": 80, "PHONE": 70}
        kept = []
        for r in sorted(rows, key=lambda r: (-r[3], -pri[r[2]], -(r[1] - r[0]), r[0])):
            if not any(r[0] < k[1] and k[0] < r[1] for k in kept):
                kept.append(r)
        got = spark.range(1).select(sp.resolve(F.array(*[_entity(start=a, end=b, type=t, score=s, source="rules") for a, b, t, s in rows])).alias("r")).first().r
        assert sorted(kept) == [(e.start, e.end, e.type, e.score) for e in got]


def test_merge_and_match(spark):
    def s(a, b, t="PERSON"):
        return F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("type"), F.lit(0.5).alias("score"), F.lit("g").alias("group"))

    text = F.lit("Mayza Balloi lives")
    got = spark.range(1).select(sp.merge_adjacent(F.array(s(0, 5), s(6, 12)), text).alias("m"), evaluation.match(F.array(s(0, 10)), F.array(s(0, 4), s(0, 9)), "partial").alias("t")).first()
    assert [(x.start, x.end) for x in got.m] == [(0, 12)] and got.t == [1]


def test_calibrator_leaves_unknown_groups(spark, tmp_path):
    c = calibration.Calibrator(1.0, 0.0, True, {"rules|EMAIL": (0.0, 0.0)})
    e = [_entity(start=0, end=1, type=t, score=0.75, source="rules") for t in ("EMAIL", "PHONE")]
    got = spark.range(1).select(calibration.apply(F.array(*e), c).alias("c")).first().c
    assert [round(x.score, 6) for x in got] == [0.5, 0.75]
    c.save(spark, f"{tmp_path}/c")
    assert calibration.Calibrator.load(spark, f"{tmp_path}/c") == c and not calibration.Calibrator.load(spark, f"{tmp_path}/none").fitted


def test_synthetic_documents_hold_their_spans(spark):
    rows = synthetic.documents(spark, 40)
    assert synthetic.broken(rows).count() == 0 and rows.select("doc_type", "lang").distinct().count() == 10


def test_queue_is_idempotent(spark, tmp_path):
    p = Pipeline(Config())
    result = p.transform(spark.createDataFrame([(1, "Nombre: Ana Gil", "es")], "doc_id long, text string, lang string"))
    q = ReviewQueue(spark, str(tmp_path / "q"))
    assert (q.enqueue(p.review_items(result)), q.enqueue(p.review_items(result))) == (1, 0)
    row = q.pending().first()
    q.resolve(spark.createDataFrame([(row.id, "approved", "ok")], "id long, status string, reviewer_note string").withColumn("resolved_at", F.current_timestamp()))
    assert {r.status: r.n for r in q.stats().collect()} == {"approved": 1}


def test_language(spark):
    rows = spark.createDataFrame([("the phone and your name",), ("el teléfono de la cuenta",), ("",)], "t string")
    assert [r[0] for r in rows.select(language(F.col("t"))).collect()] == ["en", "es", "es"]


def test_lang_source_counts_have_all_sources(spark):
    from collections import Counter

    from cloakwork.plans import catalog

    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source").collect()
    got = {(r.lang, r.source): r.n for r in catalog.QUERIES["lang_source_counts"](spark, sf_dir).collect()}
    assert got == Counter((r.lang, r.source) for r in docs)


def test_every_rule_scans_the_documents(spark):
    from cloakwork.operators import rules
    from cloakwork.plans import catalog

    sf_dir = "/root/testdata/sf0.001"
    assert all(f"scan_documents_{r.name}" in catalog.QUERIES for r in rules.RULES)
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text rlike '[0-9]{1,3}(\\\\.[0-9]{1,3}){3}'").count()
    assert n and catalog.QUERIES["scan_documents_ipv4"](spark, sf_dir).select("doc_id").distinct().count() <= n
    assert catalog.QUERIES["scan_documents_phone_us"](spark, sf_dir).columns == ["doc_id", "start_at", "value"]


PIECES = [
    "Nombre: Ana López", "EMAIL: Ana.Gil@Example.com", "IP 10.2.3.4", "tarjeta 4111 1111 1111 1111", "card 4111 1111 1111 1112", "IBAN ES91 2100 0418 4502 0005 1332", "IBAN ES91 2100 0418 4502 0005 1333",
    "DNI 12345678Z", "12345678A", "NIF A58818501", "20-12345678-6", "SSN 123-45-6789", "666-45-6789", "Passport no. X1234567", "Password: pw-0123", "usuario: ſan_ıto", "Fecha de nacimiento: 01/02/1980", "born 3 May 2021",
    "2024-01-15", "Código postal: 28001", "CVV: 123", "MAC 0a:1B:2c:3D:4e:5F", "Cuenta corriente: 0123 4567 89", "+34 612 34 56 78", "tel. (212) 555-0100", "fax: 0551234567", "Dr. José Ñandú", "12 Oak Tree Street, Apt. 4",
    "Calle Mayor 5, piso 2", "2001:db8:0:0:0:0:0:1", "sk-ABCDEFGHIJKLMNOP1234", "@ann_reed", "driver license: D-12345", "STRAßE İKKe 5551234567", "CLIENTE: ÁLVARO DÍAZ", "(\"x\")", "\n", "\t", " ", ", ", ". ", "ª", "9",
]


def test_rule_loop_finds_what_the_expressions_find(spark):
    import random

    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(PIECES) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(14))), rng.choice(["es", "en", "fr", None])) for i in range(300)]
    docs = spark.createDataFrame([*rows, (300, None, "es"), (301, "\n".join(PIECES), "es"), (302, "\n".join(PIECES), "en")], "doc_id long, text string, lang string")
    loop, expressions = ({r.doc_id: r.found for r in f(docs).collect()} for f in (rules.detect, rules.detect_in_expressions))
    assert loop == expressions
    assert {r.rule for found in loop.values() for r in found} == set(rules.BY_NAME) and any(e.suppressed for e in loop[301])


def test_rules_take_one_pass_in_python(spark):
    docs = spark.createDataFrame([(1, "a@b.com", "es")], "doc_id long, text string, lang string")
    plan = rules.detect(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_extract_all" not in plan


def test_document_loop_says_what_the_expressions_say(spark):
    import random

    rng = random.Random(9)
    rows = [(i, "".join(rng.choice(PIECES) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(14))), rng.choice(["es", "en", "fr", None])) for i in range(150)]
    every = "\n".join(PIECES)
    docs = spark.createDataFrame([*rows, (150, None, "es"), (151, every + "\nAna López; xAna López, ana.gil@example.com. Ana.Gil@Example.com", "es"), (152, every + every, "en")], "doc_id long, text string, lang string")
    for mode in ("mask", "partial", "pseudonymize"):
        p = Pipeline(Config(mode=mode))
        loop, expressions = ({r.doc_id: r for r in f(docs).collect()} for f in (p.transform, p.transform_in_expressions))
        assert loop.keys() == expressions.keys()
        for i, r in loop.items():
            assert r.asDict(True) == expressions[i].asDict(True)
        assert any(x.source_start > len(every) for x in loop[151].replacements)


def test_audit_reads_its_documents_once(spark, tmp_path):
    from cloakwork.plans import catalog

    spark.createDataFrame([(k, k % 25) for k in range(1, 9)], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    out = catalog.QUERIES["pipeline_audit"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("ArrowEvalPython") == 1
    assert out.count() == 8 and out.where("n_decisions > 0").count() == 8


def test_systems_share_one_detection_and_figures_one_pass(spark):
    from cloakwork.plans import catalog
    from cloakwork.plans.pipeline import compare_systems, systems

    span = "array<struct<start:int,end:int,type:string,score:double,group:string>>"
    rows = [(1, "Nombre: Ana Lopez, a@b.com", "es", [(8, 17, "PERSON", 1.0, "g"), (19, 26, "EMAIL", 1.0, "g")]), (2, "Full name: Ann Reed", "en", [(0, 4, "PHONE", 1.0, "g")]), (3, "nothing", "en", [])]
    gold = spark.createDataFrame(rows, f"doc_id long, text string, lang string, gold {span}")
    ladder = systems({"ner": catalog._stub})
    out = compare_systems(gold, ladder, "partial")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    got = {r.system: r for r in out.collect()}
    assert got.keys() == ladder.keys()
    for name, run in ladder.items():
        found = evaluation.aligned(run(gold), "partial").withColumn("system", F.lit(name))
        assert got[name] == evaluation.overall(found, "system").join(evaluation.privacy(found, "system"), "system").first()


def test_labels_are_trimmed_once_each(spark):
    from cloakwork.functions.taxonomy import CORPUS_LABELS, map_label

    labels = [*CORPUS_LABELS, *(f" {k.lower()} " for k in CORPUS_LABELS), "NOPE", "", None]
    rows = spark.createDataFrame([(x,) for x in labels], "label string")
    assert [r.k for r in rows.select(map_label(F.col("label")).alias("k")).collect()] == [CORPUS_LABELS.get((x or "").strip().upper()) for x in labels]
    assert rows.select(map_label(F.col("label")).alias("k"))._jdf.queryExecution().optimizedPlan().toString().count("trim(") == 1
