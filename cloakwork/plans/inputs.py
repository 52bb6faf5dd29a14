"""Inputs of the catalogue, from the star schema: SQL that Spark and DuckDB both read, so oracles have the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.checks import DNI_LETTERS

_SUM15 = " + ".join(f"(CASE WHEN {i % 2} = 1 THEN CASE WHEN CAST(substring(card, {i}, 1) AS INT) > 4 THEN 2 * CAST(substring(card, {i}, 1) AS INT) - 9 ELSE 2 * CAST(substring(card, {i}, 1) AS INT) END ELSE CAST(substring(card, {i}, 1) AS INT) END)" for i in range(1, 16))
#: A business document for each customer, every third with wrong check digits.
BUSINESS = f"""
WITH a AS (
  SELECT c_custkey AS k, c_nationkey AS n, CASE WHEN c_custkey % 2 = 0 THEN 'es' ELSE 'en' END AS lang,
    '4' || lpad(CAST(c_custkey * 7919 % 100000000 AS STRING), 14, '0') AS card,
    lpad(CAST(c_custkey * 7919 % 100000000 AS STRING), 8, '0') AS num,
    lpad(CAST(c_custkey * 104729 % 10000000000 AS STRING), 10, '0') AS h1, lpad(CAST(c_custkey * 1299709 % 10000000000 AS STRING), 10, '0') AS h2
  FROM customer
), b AS (
  SELECT *, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS bad,
    CAST((10 - ({_SUM15}) % 10) % 10 AS INT) AS last,
    98 - CAST((((CAST(h1 AS BIGINT) % 97) * 52 + CAST(h2 AS BIGINT)) % 97 * 1000000 + 142800) % 97 AS INT) AS kk
  FROM a
)
SELECT k AS doc_id, lang,
  'Ref ' || CAST(k AS STRING) || chr(10) || CASE WHEN lang = 'es' THEN 'Nombre: Ana Lopez' ELSE 'Full name: Ann Reed' END || chr(10)
  || 'Email: user' || CAST(k AS STRING) || '@mail' || CAST(n AS STRING) || '.example.com' || chr(10)
  || 'IP 10.' || CAST(n AS STRING) || '.' || CAST(k % 250 AS STRING) || '.7' || chr(10)
  || CASE WHEN lang = 'es' THEN 'Tarjeta: ' ELSE 'Card: ' END || card || CAST((last + bad) % 10 AS STRING) || chr(10)
  || 'Cuenta IBAN: ES' || lpad(CAST((kk + bad) % 100 AS STRING), 2, '0') || h1 || h2 || chr(10)
  || 'DNI: ' || num || substring('{DNI_LETTERS}', CAST((CAST(num AS BIGINT) + bad) % 23 AS INT) + 1, 1) || chr(10)
  || 'SSN: ' || lpad(CAST(k % 900 AS STRING), 3, '0') || '-' || lpad(CAST(k % 100 AS STRING), 2, '0') || '-' || lpad(CAST(k % 10000 AS STRING), 4, '0') || chr(10)
  || 'Passport no. X' || num || chr(10) || 'Password: pw-' || h2 || chr(10) || 'User: u_' || CAST(k AS STRING) || chr(10)
  || 'Fecha de nacimiento: ' || lpad(CAST(k % 28 + 1 AS STRING), 2, '0') || '/' || lpad(CAST(k % 12 + 1 AS STRING), 2, '0') || '/' || CAST(1950 + k % 50 AS STRING) || chr(10)
  || 'Issued 2024-0' || CAST(k % 9 + 1 AS STRING) || '-15, ZIP ' || lpad(CAST(k % 100000 AS STRING), 5, '0') || ', CVV: ' || lpad(CAST(k % 1000 AS STRING), 3, '0') || chr(10)
  || 'MAC 0A:1B:2C:3D:4E:' || lpad(CAST(k % 100 AS STRING), 2, '0') || ' CUIT 20-' || num || '-' || CAST(k % 10 AS STRING) || ' A' || substring(num, 1, 7) || CAST(k % 10 AS STRING) || chr(10)
  || 'Account number: ' || h1 || ' and 3 May 2021' || chr(10)
  || 'Phone: +1 212 555 ' || lpad(CAST(k % 10000 AS STRING), 4, '0') || ', or +34 612 34 56 ' || lpad(CAST(k % 100 AS STRING), 2, '0') || ', or (212) 555-' || lpad(CAST(k % 10000 AS STRING), 4, '0') || chr(10)
  || 'Mr. John Smith, ' || CAST(k % 900 + 1 AS STRING) || ' Oak Tree Street; Calle Mayor ' || CAST(k % 90 + 1 AS STRING) || chr(10)
  || 'Host 2001:db8:0:0:0:0:0:' || CAST(k % 1000 AS STRING) || ' key sk-' || h1 || h2 || ' by @ann_' || CAST(k AS STRING) || chr(10)
  || 'Driver license: D-' || num || chr(10) || 'Repeat user' || CAST(k AS STRING) || '@mail' || CAST(n AS STRING) || '.example.com.' AS text
FROM b
"""
_KINDS = "'CREDENTIAL','CREDIT_CARD','BANK_ACCOUNT','GOV_ID','EMAIL','IP_ADDRESS','PHONE','DATE_OF_BIRTH','PERSON','ADDRESS','USERNAME','DATE_TIME'"
_KIND = " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(_KINDS.split(",")))
#: Order lines, numbered within their order.
LINES = "(SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INT) AS line FROM lineitem)"
#: A span for each order line: places, kinds, scores, checks and detectors that are functions of its keys.
SPANS = f"""
SELECT l_orderkey AS doc_id, line AS ord, CAST((l_partkey * 37 + line * 11) % 120 AS INT) AS s,
  CAST((l_partkey * 37 + line * 11) % 120 + 4 + l_suppkey % 17 AS INT) AS e,
  CASE l_partkey % 12 {_KIND} END AS type,
  CAST(40 + (l_partkey * 7 + l_suppkey * 3 + line) % 60 AS DOUBLE) / 100 AS score,
  CASE l_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS passed,
  CASE line % 3 WHEN 0 THEN 'rules' WHEN 1 THEN 'ner' ELSE 'model' END AS source,
  'v' || CAST(l_partkey % 7 AS STRING) AS value
FROM {LINES} l
"""
SAMPLES = f"""
SELECT CAST(1 + (l_partkey * 31 + l_suppkey) % 99 AS DOUBLE) / 100 AS score,
  CASE WHEN (l_partkey * 31 + l_suppkey) % 99 + l_orderkey % 37 > 70 THEN 1 ELSE 0 END AS correct,
  l_linestatus || '|' || l_returnflag AS grp
FROM {LINES} l
"""
GOLD = f"""
SELECT l_orderkey AS doc_id, line AS ord, CAST(line * 30 AS INT) AS s, CAST(line * 30 + 5 + l_partkey % 12 AS INT) AS e,
  CASE l_partkey % 3 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PHONE' ELSE 'PERSON' END AS type FROM {LINES} l
"""
#: Predictions: some gone, some moved, some of another kind.
PRED = f"""
SELECT doc_id, ord, CAST(CASE WHEN ord % 4 = 1 THEN s + 2 ELSE s END AS INT) AS s, e, CASE WHEN (doc_id + ord) % 7 = 0 THEN 'ADDRESS' ELSE type END AS type
FROM ({GOLD}) g WHERE (doc_id + 3 * ord) % 5 <> 0
"""
ITEMS = """
SELECT event_id AS id, 'd' || CAST(user_id AS STRING) AS document_id, CAST(CAST(event_id * 7919 % 1000 AS DOUBLE) / 1000 AS DOUBLE) AS score FROM events
"""
VERDICTS = """
SELECT event_id % 500 AS id, ts AS resolved_at, CASE WHEN event_id % 3 = 0 THEN 'approved' WHEN event_id % 3 = 1 THEN 'rejected' ELSE 'pending' END AS status, 'n' || CAST(event_id AS STRING) AS reviewer_note
FROM events
"""
ANNOTATIONS = f"""
SELECT l_orderkey AS id, line AS ord, CASE l_partkey % 6 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'title' WHEN 2 THEN ' GIVENNAME1' WHEN 3 THEN 'CITY' WHEN 4 THEN 'SEX' ELSE 'NOPE' END AS label,
  CAST(line * 8 - (CASE WHEN l_suppkey % 10 = 0 THEN 60 ELSE 0 END) AS INT) AS s, CAST(line * 8 + 5 AS INT) AS e, l_suppkey % 7 = 0 AS wrong
FROM {LINES} l
"""
TABLES = ("customer", "lineitem", "events", "documents", "orders", "embeddings", "nation")


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the tables of a folder, which it names as {table}."""
    import re

    return spark.sql(re.sub(r"\bFROM (customer|lineitem|events|documents|orders|embeddings|nation)\b", r"FROM {\1}", sql.replace("{", "{{").replace("}", "}}")), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in sql})
