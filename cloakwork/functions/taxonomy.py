"""Kinds of sensitive values, their priorities, markers and label maps, as data and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (kind, priority, high risk, marker in Spanish, marker in English, digits a partial mask shows).
KINDS = (
    ("CREDENTIAL", 100, True, "CREDENCIAL", "CREDENTIAL", None),
    ("CREDIT_CARD", 95, True, "TARJETA", "CREDIT_CARD", 4),
    ("BANK_ACCOUNT", 90, True, "CUENTA_BANCARIA", "BANK_ACCOUNT", 4),
    ("GOV_ID", 85, True, "IDENTIFICACION", "GOV_ID", 3),
    ("EMAIL", 80, False, "EMAIL", "EMAIL", None),
    ("IP_ADDRESS", 75, False, "IP", "IP", None),
    ("PHONE", 70, False, "TELEFONO", "PHONE", 3),
    ("DATE_OF_BIRTH", 60, False, "FECHA_NACIMIENTO", "DATE_OF_BIRTH", None),
    ("PERSON", 55, False, "NOMBRE", "NAME", None),
    ("ADDRESS", 50, False, "DIRECCION", "ADDRESS", None),
    ("USERNAME", 45, False, "USUARIO", "USERNAME", None),
    ("DATE_TIME", 20, False, "FECHA", "DATE", None),
)
MULTILINE = ("ADDRESS",)
UNSUPPORTED_BY_CORPUS = ("CREDIT_CARD", "BANK_ACCOUNT")
# Corpus label to kind (None: dropped on purpose).
CORPUS_LABELS = {
    "GIVENNAME1": "PERSON", "GIVENNAME2": "PERSON", "LASTNAME1": "PERSON", "LASTNAME2": "PERSON", "LASTNAME3": "PERSON",
    "EMAIL": "EMAIL", "TEL": "PHONE",
    "STREET": "ADDRESS", "BUILDING": "ADDRESS", "SECADDRESS": "ADDRESS", "CITY": "ADDRESS", "STATE": "ADDRESS", "POSTCODE": "ADDRESS", "GEOCOORD": "ADDRESS",
    "BOD": "DATE_OF_BIRTH", "DATE": "DATE_TIME", "TIME": "DATE_TIME",
    "SOCIALNUMBER": "GOV_ID", "IDCARD": "GOV_ID", "PASSPORT": "GOV_ID", "DRIVERLICENSE": "GOV_ID",
    "USERNAME": "USERNAME", "PASS": "CREDENTIAL", "IP": "IP_ADDRESS",
    "TITLE": None, "SEX": None, "COUNTRY": None, "CARDISSUER": None,
}

NAMES = tuple(k[0] for k in KINDS)
HIGH_RISK = tuple(k[0] for k in KINDS if k[2])
MODEL_KINDS = tuple(k for k in NAMES if k not in UNSUPPORTED_BY_CORPUS)


def lookup(pairs: dict, key: Column, default=None) -> Column:
    """A literal map as a CASE: it folds where the key is a literal."""
    out = None
    for k, v in pairs.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out if default is None else out.otherwise(default if isinstance(default, Column) else F.lit(default))


def priority(kind: Column) -> Column:
    return lookup({k[0]: k[1] for k in KINDS}, kind, 0)


def high_risk(kind: Column) -> Column:
    return kind.isin(*HIGH_RISK)


def marker(kind: Column, lang: Column) -> Column:
    """[NAME] in the document's language; other languages have the Spanish ones, unknown kinds their own name."""
    spanish, english = ({k[0]: k[i] for k in KINDS} for i in (3, 4))
    return F.concat(F.lit("["), F.when(lang == "en", lookup(english, kind, kind)).otherwise(lookup(spanish, kind, kind)), F.lit("]"))


def shown_digits(kind: Column) -> Column:
    return lookup({k[0]: k[5] for k in KINDS if k[5]}, kind)


def map_label(label: Column) -> Column:
    """A corpus label's kind; null if it is dropped or unknown."""
    known = {k: v for k, v in CORPUS_LABELS.items() if v}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.upper(F.trim(label)))  # a CASE would trim for each of its branches


def bio_labels(kinds: tuple[str, ...] = NAMES) -> list[str]:
    return ["O", *(f"{p}-{k}" for k in kinds for p in "BI")]
