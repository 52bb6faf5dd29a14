"""Business documents with known spans, from a range of numbers: five kinds in two languages.

A document is an array of segments, each with its kind or none. Text and spans come from one fold
over the segments, so every span's slice is its value by construction. All values are drawn by
hashes of the number; identifiers carry valid check digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import DNI_LETTERS

KINDS = ("invoice", "contract", "email", "support_ticket", "onboarding_form")
LOCALES = {"es": ("es_ES", "es_AR", "es_MX"), "en": ("en_US", "en_GB")}
GIVEN = {"es": ("Lucía", "Martín", "Sofía", "Hugo", "Valeria", "Mateo", "Carmen", "Diego"), "en": ("Emma", "Liam", "Olivia", "Noah", "Grace", "Henry", "Alice", "Oscar")}
FAMILY = {"es": ("García", "Fernández", "López", "Navarro", "Iglesias", "Ortega", "Romero", "Vidal"), "en": ("Walker", "Bennett", "Harris", "Coleman", "Foster", "Reed", "Murphy", "Sutton")}
STREET = {"es": ("Calle Mayor", "Avenida Libertad", "Plaza España", "Paseo Marítimo"), "en": ("Oak Street", "Maple Avenue", "Church Road", "Park Lane")}
CITY = {"es": ("Sevilla", "Bilbao", "Rosario", "Puebla"), "en": ("Austin", "Leeds", "Denver", "Bristol")}


def _draw(n: Column, salt: str, most: int) -> Column:
    return F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(most))


def _pick(n: Column, salt: str, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_draw(n, salt, len(values)) + 1).cast("int"))


def _digits(n: Column, salt: str, count: int) -> Column:
    return F.lpad(_draw(n, salt, 10**count).cast("string"), count, "0")


def luhn_digit(body: Column, count: int) -> Column:
    """The last digit that makes `count` digits and itself pass."""
    total = F.lit(0)
    for i in range(1, count + 1):
        d = F.substring(body, i, 1).cast("int")
        twice = d * 2
        total = total + (d if (count - i) % 2 else F.when(twice > 9, twice - 9).otherwise(twice))
    return ((10 - total % 10) % 10).cast("string")


def spanish_iban(account: Column) -> Column:
    """ES and the check digits of 20 digits: 98 less the rest of the number with ES00 turned to the end."""
    rest = F.aggregate(F.split(F.concat(account, F.lit("142800")), ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * 10 + F.ascii(c) - 48) % 97))
    return F.concat(F.lit("ES"), F.lpad((98 - rest).cast("string"), 2, "0"), account)


def cuit(number: Column) -> Column:
    """20-########-#, numbers that have no valid last digit nudged on."""
    body = F.concat(F.lit("20"), number)
    total = sum((F.substring(body, i, 1).cast("int") * w for i, w in enumerate((5, 4, 3, 2, 7, 6, 5, 4, 3, 2), 1)), F.lit(0))
    rest = 11 - total % 11
    return F.concat(F.lit("20-"), number, F.lit("-"), F.when(rest == 11, 0).when(rest == 10, 9).otherwise(rest).cast("string"))


def persona(n: Column, lang: Column, locale: Column) -> dict[str, Column]:
    """Attributes that fit one another."""

    def both(salt: str, values: dict) -> Column:
        return F.when(lang == "es", _pick(n, salt, values["es"])).otherwise(_pick(n, salt, values["en"]))

    given, family = both("given", GIVEN), both("family", FAMILY)
    user = F.concat(F.translate(F.lower(given), "áéíóúñ", "aeioun"), F.lit("."), F.translate(F.lower(family), "áéíóúñ", "aeioun"), _draw(n, "user", 90).cast("string"))
    number = _digits(n, "dni", 8)
    dni = F.concat(number, F.substring(F.lit(DNI_LETTERS), (number.cast("long") % 23 + 1).cast("int"), F.lit(1)))
    ssn = F.concat((_draw(n, "area", 565) + 100).cast("string"), F.lit("-"), (_draw(n, "group", 89) + 10).cast("string"), F.lit("-"), (_draw(n, "serial", 8999) + 1000).cast("string"))
    card = F.concat(F.lit("4"), _digits(n, "card", 14))
    return {
        "name": F.concat(given, F.lit(" "), family),
        "email": F.concat(user, F.lit("@example.com")),
        "username": user,
        "phone": F.when(lang == "es", F.concat(F.lit("+34 6"), _digits(n, "p1", 2), F.lit(" "), _digits(n, "p2", 3), F.lit(" "), _digits(n, "p3", 3))).otherwise(F.concat(F.lit("("), (_draw(n, "p1", 700) + 200).cast("string"), F.lit(") 555-"), _digits(n, "p2", 4))),
        "address": F.when(lang == "es", F.concat(_pick(n, "street", STREET["es"]), F.lit(" "), (_draw(n, "no", 99) + 1).cast("string"))).otherwise(F.concat((_draw(n, "no", 999) + 1).cast("string"), F.lit(" "), _pick(n, "street", STREET["en"]))),
        "city": both("city", CITY),
        "postcode": _digits(n, "zip", 5),
        "gov_id": F.when(locale == "es_ES", dni).when(locale == "en_US", ssn).when(locale == "es_AR", cuit(number)).otherwise(F.concat(F.upper(F.substring(family, 1, 1)), _digits(n, "other", 8))),
        "iban": spanish_iban(F.concat(_digits(n, "iban1", 10), _digits(n, "iban2", 10))),
        "card": F.concat(card, luhn_digit(card, 15)),
        "cvv": _digits(n, "cvv", 3),
        "born": F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), _draw(n, "born", 18000).cast("int")), "dd/MM/yyyy"),
        "date": F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), _draw(n, "date", 2000).cast("int")), "dd/MM/yyyy"),
        "password": F.concat(F.lit("Xk!"), F.substring(F.sha2(F.concat(F.lit("pw"), n.cast("string")), 256), 1, 9)),
        "ip": F.concat_ws(".", *[(_draw(n, f"ip{i}", 254) + 1).cast("string") for i in range(4)]),
        "company": F.concat(_pick(n, "firm", FAMILY["en"]), F.lit(" & Co")),
    }


def distractors(n: Column) -> dict[str, Column]:
    """What looks like an identifier and is none."""
    return {
        "invoice_no": F.concat(F.lit("INV-"), _digits(n, "d1", 6)),
        "order_no": F.concat(F.lit("PO"), _digits(n, "d2", 7)),
        "sku": F.concat(F.lit("SKU-"), _digits(n, "d3", 4), F.lit("-X")),
        "amount": F.concat((_draw(n, "d4", 9000) + 100).cast("string"), F.lit(",00")),
        "version": F.concat(F.lit("v"), _draw(n, "d5", 9).cast("string"), F.lit("."), _draw(n, "d6", 9).cast("string")),
        "ticket": F.concat(F.lit("#"), _digits(n, "d7", 5)),
        "clause": F.concat(F.lit("§"), (_draw(n, "d8", 40) + 1).cast("string")),
    }


def _templates(p: dict[str, Column], d: dict[str, Column]) -> dict[tuple[str, str], list]:
    """Segments by (kind, language): plain texts, or (value, kind of value)."""
    who, mail, tel, at = (p["name"], "PERSON"), (p["email"], "EMAIL"), (p["phone"], "PHONE"), (p["address"], "ADDRESS")
    city, code, gov, iban = (p["city"], "ADDRESS"), (p["postcode"], "ADDRESS"), (p["gov_id"], "GOV_ID"), (p["iban"], "BANK_ACCOUNT")
    card, cvv, born, on = (p["card"], "CREDIT_CARD"), (p["cvv"], "CREDIT_CARD"), (p["born"], "DATE_OF_BIRTH"), (p["date"], "DATE_TIME")
    secret, user, ip = (p["password"], "CREDENTIAL"), (p["username"], "USERNAME"), (p["ip"], "IP_ADDRESS")
    return {
        ("invoice", "es"): ["FACTURA ", d["invoice_no"], "\nEmisor: ", p["company"], "\nFecha de emisión: ", on, "\nCliente: ", who, "\nNIF: ", gov, "\nDirección: ", at, ", ", code, " ", city, "\nTotal: ", d["amount"], " EUR (", d["sku"], ")\nIBAN: ", iban, "\nContacto: ", mail, "\n"],
        ("invoice", "en"): ["INVOICE ", d["invoice_no"], "\nFrom: ", p["company"], "\nIssued: ", on, "\nCustomer: ", who, "\nAddress: ", at, ", ", city, " ", code, "\nTotal: ", d["amount"], " USD (", d["sku"], ")\nCard: ", card, "\nContact email: ", mail, "\n"],
        ("contract", "es"): ["CONTRATO DE ARRENDAMIENTO ", d["order_no"], "\nArrendatario: ", who, "\nDocumento de identidad: ", gov, "\nFecha de nacimiento: ", born, "\nDomicilio en ", at, ".\nCláusula ", d["clause"], ": la renta se abona en la cuenta ", iban, ".\nFirmado el ", on, ".\n"],
        ("contract", "en"): ["LEASE AGREEMENT ", d["order_no"], "\nTenant: ", who, "\nDate of birth: ", born, "\nThe premises at ", at, ", ", city, ".\nSection ", d["clause"], ": rent is paid to account ", iban, ".\nSigned on ", on, ".\n"],
        ("email", "es"): ["De: ", mail, "\nAsunto: pedido ", d["order_no"], "\n\nHola, soy ", who, ". Mi teléfono es ", tel, " y vivo en ", at, ".\nUn saludo\n"],
        ("email", "en"): ["From: ", mail, "\nSubject: order ", d["order_no"], "\n\nHello, this is ", who, ". Please call me on ", tel, " or write to ", at, ".\nThe release is ", d["version"], ".\nRegards\n"],
        ("support_ticket", "es"): ["TICKET ", d["ticket"], "\nUsuario: ", user, "\nContraseña: ", secret, "\nDesde la IP ", ip, " con la versión ", d["version"], "\nCorreo: ", mail, "\n"],
        ("support_ticket", "en"): ["TICKET ", d["ticket"], "\nUsername: ", user, "\nPassword: ", secret, "\nFrom IP ", ip, " on release ", d["version"], "\nEmail: ", mail, "\n"],
        ("onboarding_form", "es"): ["ALTA DE EMPLEADO\nNombre: ", who, "\nFecha de nacimiento: ", born, "\nDNI: ", gov, "\nTeléfono: ", tel, "\nEmail: ", mail, "\nCuenta: ", iban, "\n"],
        ("onboarding_form", "en"): ["ONBOARDING FORM\nFull name: ", who, "\nDate of birth: ", born, "\nSSN: ", gov, "\nPhone: ", tel, "\nEmail: ", mail, "\nCard on file: ", card, " CVV: ", cvv, "\n"],
    }


def assemble(segments: Column) -> Column:
    """array<struct<seg,type>> -> (text, entities): the offsets are the lengths so far."""
    kind = "array<struct<start:int,end:int,type:string,text:string>>"
    zero = F.struct(F.lit("").alias("text"), F.array().cast(kind).alias("entities"))

    def step(acc, s):
        start = F.length(acc["text"])
        span = F.array(F.struct(start.alias("start"), (start + F.length(s["seg"])).alias("end"), s["type"].alias("type"), s["seg"].alias("text")))
        return F.struct(F.concat(acc["text"], s["seg"]).alias("text"), F.when(s["type"].isNotNull(), F.concat(acc["entities"], span)).otherwise(acc["entities"]).alias("entities"))

    return F.aggregate(segments, zero, step)


def documents(spark: SparkSession, n: int = 250, seed: int = 7) -> DataFrame:
    """(id, lang, text, entities, doc_type, locale), kinds and languages in turn."""
    return from_numbers(spark.range(n).select(F.col("id").alias("n")), seed)


def from_numbers(numbers: DataFrame, seed: int = 7) -> DataFrame:
    rows = numbers.select("n", F.xxhash64("n", F.lit(seed)).alias("key"))
    rows = rows.withColumn("doc_type", F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod("n", F.lit(5)) + 1).cast("int"))).withColumn("lang", F.when(F.pmod(F.floor(F.col("n") / 5), F.lit(2)) == 0, "es").otherwise("en"))
    rows = rows.withColumn("locale", F.when(F.col("lang") == "es", _pick(F.col("key"), "locale", LOCALES["es"])).otherwise(_pick(F.col("key"), "locale", LOCALES["en"])))
    p, d = persona(F.col("key"), F.col("lang"), F.col("locale")), distractors(F.col("key"))
    segments = None
    for (kind, lang), parts in _templates(p, d).items():
        made = F.array(*[F.struct((x[0] if isinstance(x, tuple) else F.lit(x) if isinstance(x, str) else x).alias("seg"), F.lit(x[1] if isinstance(x, tuple) else None).cast("string").alias("type")) for x in parts])
        here = (F.col("doc_type") == kind) & (F.col("lang") == lang)
        segments = F.when(here, made) if segments is None else segments.when(here, made)
    rows = rows.withColumn("_s", segments)
    rows = rows.withColumn("_d", assemble(F.col("_s")))
    return rows.select(F.format_string("synth-%05d", "n").alias("id"), "lang", F.col("_d.text").alias("text"), F.col("_d.entities").alias("entities"), "doc_type", "locale")


def broken(docs: DataFrame) -> DataFrame:
    """Documents with a span whose slice isn't its value; there are none."""
    return docs.where(F.exists("entities", lambda e: F.substring("text", e["start"] + 1, e["end"] - e["start"]) != e["text"]))
