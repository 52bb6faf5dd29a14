"""Check digits and ranges of identifiers, as expressions on strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
NIF_LETTERS = "JABCDEFGHI"
CUIT_WEIGHTS = (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _bare(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, r"[\s-]", ""))


def _at(text: Column, i: int) -> Column:
    return F.substring(text, i, 1).cast("int")


def luhn(value: Column) -> Column:
    d = _digits(value)
    return F.length(d).between(12, 19) & F.call_function("luhn_check", d)


def iban(value: Column) -> Column:
    """ISO 13616: the rotated text as a number leaves 1 modulo 97; taken character by character."""
    v = _bare(value)

    def step(acc, c):
        n = F.ascii(c)
        return F.when(c == "", acc).when(n >= 65, (acc * 100 + n - 55) % 97).otherwise((acc * 10 + n - 48) % 97)

    def rest(x):
        turned = F.split(F.concat(F.substring(x, 5, 34), F.substring(x, 1, 4)), "")
        return F.when(x.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$"), F.aggregate(turned, F.lit(0), step) == 1).otherwise(F.lit(False))

    return F.get(F.transform(F.array(v), rest), F.lit(0))


def dni(value: Column) -> Column:
    v = _bare(value)
    number = F.translate(F.regexp_extract(v, "^([XYZ]?[0-9]{7,8})[A-Z]$", 1), "XYZ", "012")
    return v.rlike("^[XYZ]?[0-9]{7,8}[A-Z]$") & F.coalesce(F.substring(F.lit(DNI_LETTERS), (number.cast("long") % 23 + 1).cast("int"), F.lit(1)) == F.right(v, F.lit(1)), F.lit(False))


def cuit(value: Column) -> Column:
    d = _digits(value)
    total = sum((_at(d, i) * w for i, w in enumerate(CUIT_WEIGHTS, 1)), F.lit(0))
    rest = 11 - total % 11
    want = F.when(rest == 11, 0).when(rest == 10, 9).otherwise(rest)
    return F.coalesce((F.length(d) == 11) & (want == _at(d, 11)), F.lit(False))


def ssn(value: Column) -> Column:
    d = _digits(value)
    area = F.substring(d, 1, 3)
    return (F.length(d) == 9) & ~area.isin("000", "666") & ~area.startswith("9") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def nif(value: Column) -> Column:
    v = _bare(value)
    total = F.lit(0)
    for i in range(2, 9):
        twice = _at(v, i) * 2
        total = total + (_at(v, i) if i % 2 else F.when(twice > 9, twice - 9).otherwise(twice))
    want = (10 - total % 10) % 10
    last = F.right(v, F.lit(1))
    return v.rlike("^[ABCDEFGHJNPQRSUVW][0-9]{7}[0-9A-J]$") & F.coalesce((last == want.cast("string")) | (last == F.substring(F.lit(NIF_LETTERS), want + 1, F.lit(1))), F.lit(False))


CHECKS = {"luhn": luhn, "iban": iban, "dni": dni, "cuit": cuit, "ssn": ssn, "nif": nif}
