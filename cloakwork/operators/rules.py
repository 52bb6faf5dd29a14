"""The rule detector: declarative patterns with checks and context words, compiled to expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ship
from ..functions import checks
from ..functions.findall import find_all, slice_text
from . import ruleloop
from .spans import ENTITY, FIELDS, entity, let, normalize, resolve

ANY_CASE, AS_IS = "(?iuU)", "(?U)"
BOTH = ("es", "en")


@dataclass(frozen=True)
class Rule:
    """`head` is a label before the value, `tail` what must follow; `invalid` is the score after a failed check, None drops.
    `needs` is a pattern that every text with a match has somewhere, cheaper to look for."""

    name: str
    kind: str
    score: float
    body: str
    head: str = ""
    tail: str = ""
    flags: str = ANY_CASE
    langs: tuple[str, ...] = BOTH
    check: str | None = None
    invalid: float | None = 0.55
    context: tuple[str, ...] = ()
    require_context: bool = False
    guard: object = None
    needs: str = ""


# Context width, months, birth wording and the rules' patterns, scores and context words.
WINDOW = 45
MONTHS = r"(?:ene|feb|mar|abr|may|jun|jul|ago|sep|sept|oct|nov|dic|jan|apr|aug|dec|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre|january|february|march|april|june|july|august|september|october|november|december)"
BIRTH = ("nacimiento", "nacid", "f. nac", "fec. nac", "fnac", "born", "birth", "date of birth", "dob", "cumple")
_NAME = r"(?:[A-ZÁÉÍÓÚÑ][A-Za-zÁÉÍÓÚÑáéíóúñ'\-]+[ \t]*){1,4}"
_BYTE = r"(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)"
RULES: tuple[Rule, ...] = (
    Rule("email", "EMAIL", 0.97, r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,63}", r"\b", r"\b", needs="@"),
    Rule("password_labeled", "CREDENTIAL", 0.93, r"\S{6,64}", r"(?:contrase[nñ]a|clave|password|passwd|pwd|api[_ -]?key|token|secret)\s*[:=]\s*", needs="[:=]"),
    Rule("api_key_like", "CREDENTIAL", 0.9, r"(?:sk|pk|ghp|xox[baprs])[-_][A-Za-z0-9]{16,}", r"\b", r"\b", AS_IS, needs="[-_]"),
    Rule("iban", "BANK_ACCOUNT", 0.9, r"[A-Z]{2}\d{2}[\s-]?(?:[A-Z0-9]{4}[\s-]?){2,7}[A-Z0-9]{1,4}", r"\b", r"\b", AS_IS, check="iban", invalid=0.5, context=("iban", "cuenta", "account", "banco", "bank", "transferencia", "swift"), needs=r"\d"),
    Rule("credit_card", "CREDIT_CARD", 0.88, r"(?:\d{4}[\s\-]?){3}\d{1,4}", r"\b", r"\b", check="luhn", invalid=0.5, context=("tarjeta", "card", "visa", "mastercard", "amex", "credit", "débito", "debito"), needs=r"\d"),
    Rule("cvv", "CREDIT_CARD", 0.9, r"\d{3,4}", r"(?:cvv|cvc|cod(?:igo)?\.?\s*seg(?:uridad)?)\s*[:=]?\s*", r"\b", needs=r"\d"),
    Rule("bank_account_labeled", "BANK_ACCOUNT", 0.85, r"[0-9][0-9\s\-]{6,24}[0-9]", r"(?:n[ºo°]?\.?\s*de\s*cuenta|cuenta\s*(?:bancaria|corriente)?|account\s*(?:number|no\.?|#)|routing)\s*[:#]?\s*", needs=r"\d"),
    Rule("dni_nie", "GOV_ID", 0.85, r"[XYZ]?\d{7,8}[\s-]?[A-Z]", r"\b", r"\b", AS_IS, ("es",), "dni", None, ("dni", "nie", "identidad", "documento", "identificación", "identificacion"), needs=r"\d"),
    Rule("nif_cif", "GOV_ID", 0.85, r"[ABCDEFGHJNPQRSUVW]\d{7}[0-9A-J]", r"\b", r"\b", AS_IS, ("es",), "nif", None, ("nif", "cif", "fiscal", "empresa", "sociedad"), needs=r"\d"),
    Rule("cuit_cuil", "GOV_ID", 0.88, r"\d{2}-\d{8}-\d", r"\b", r"\b", langs=("es",), check="cuit", invalid=0.5, needs=r"\d-\d"),
    Rule("ssn", "GOV_ID", 0.9, r"\d{3}-\d{2}-\d{4}", r"\b", r"\b", langs=("en",), check="ssn", invalid=0.5, needs=r"\d-\d"),
    Rule("passport", "GOV_ID", 0.87, r"[A-Z0-9]{6,12}", r"(?:pasaporte|passport)\s*(?:n[ºo°]?\.?|number|no\.?|#)?\s*[:#]?\s*", r"\b"),
    Rule("driver_license", "GOV_ID", 0.85, r"[A-Z0-9\-]{5,15}", r"(?:licencia\s*(?:de\s*conducir)?|carn[eé]\s*de\s*conducir|driver'?s?\s*licen[sc]e|dl)\s*(?:n[ºo°]?\.?|no\.?|#)?\s*[:#]?\s*", r"\b"),
    Rule("phone_international", "PHONE", 0.92, r"\+\d{1,3}[\s.\-]?(?:\(?\d{1,4}\)?[\s.\-]?){1,5}\d{2,4}", r"(?<![\w.])", r"(?![\w])", needs=r"\d"),
    Rule("phone_es", "PHONE", 0.8, r"(?:[6789]\d{2}[\s.\-]?\d{2}[\s.\-]?\d{2}[\s.\-]?\d{2}|[6789]\d{2}[\s.\-]?\d{3}[\s.\-]?\d{3})", r"(?<![\w.+])", r"(?![\w])", langs=("es",), context=("tel", "teléfono", "telefono", "móvil", "movil", "celular", "whatsapp", "contacto", "fax"), needs=r"\d"),
    Rule("phone_us", "PHONE", 0.85, r"\(?\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}", r"(?<![\w.+])", r"(?![\w])", langs=("en",), needs=r"\d"),
    Rule("phone_labeled", "PHONE", 0.9, r"\+?\d[\d\s.\-()]{6,20}\d", r"(?:tel[eé]fono|tel\.?|m[oó]vil|celular|phone|mobile|cell|fax|whatsapp)\s*[:#]?\s*", needs=r"\d"),
    Rule("address_es", "ADDRESS", 0.78, r"(?:calle|c/|avda\.?|avenida|av\.|plaza|pza\.?|paseo|ronda|carrera|carretera|ctra\.?|camino|urbanizaci[oó]n)\s+[A-Za-zÁÉÍÓÚÑáéíóúñ.'\-]+(?:\s+[A-Za-zÁÉÍÓÚÑáéíóúñ.'\-]+){0,4}(?:\s*,?\s*(?:n[ºo°]?\.?\s*)?\d{1,4}[A-Za-z]?\b)?(?:\s*,?\s*(?:piso|pta\.?|puerta|esc\.?|bajo|izq\.?|dcha\.?|\d{1,2}\s*[ºª]?)(?:\s*[A-Za-z0-9]{1,4}\b)?)?", r"\b", langs=("es",)),
    Rule("address_en", "ADDRESS", 0.8, r"\d{1,5}\s+(?:[A-Z][A-Za-z.'\-]+\s+){1,4}(?:street|st\.?|avenue|ave\.?|road|rd\.?|boulevard|blvd\.?|lane|ln\.?|drive|dr\.?|court|ct\.?|way|place|pl\.?|terrace|parkway|circle)(?:\s+(?:NW|NE|SW|SE|N|S|E|W)\b)?(?:\s*,?\s*(?:apt\.?|suite|ste\.?|unit|#)\s*[A-Za-z0-9\-]+)?", r"\b", langs=("en",), needs=r"\d"),
    Rule("postal_code", "ADDRESS", 0.85, r"\d{5}(?:-\d{4})?", r"(?:c[oó]digo\s*postal|cp|zip(?:\s*code)?|postal\s*code)\s*[:#]?\s*", r"\b", needs=r"\d"),
    Rule("date_numeric", "DATE_TIME", 0.85, r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b", needs=r"\d[/\-.]\d"),
    Rule("date_textual", "DATE_TIME", 0.85, rf"\b\d{{1,2}}\s*(?:de\s+)?{MONTHS}\.?\s*(?:de\s+|,\s*)?\d{{2,4}}\b|\b{MONTHS}\.?\s+\d{{1,2}},?\s+\d{{4}}\b", needs=r"\d"),
    Rule("ipv4", "IP_ADDRESS", 0.95, rf"(?:{_BYTE}\.){{3}}{_BYTE}", r"\b", r"\b", needs=r"\d\.\d"),
    Rule("ipv6", "IP_ADDRESS", 0.95, r"(?:[A-F0-9]{1,4}:){7}[A-F0-9]{1,4}", r"\b", r"\b", needs=":"),
    Rule("mac_address", "IP_ADDRESS", 0.93, r"(?:[0-9A-F]{2}[:-]){5}[0-9A-F]{2}", r"\b", r"\b", needs="[:-]"),
    Rule("username_labeled", "USERNAME", 0.82, r"[A-Za-z0-9._\-]{3,32}", r"(?:usuario|user(?:name)?|login|nick|alias|cuenta\s*de\s*usuario)(?:\s+[A-Za-zÁÉÍÓÚÑáéíóúñ]+)?\s*[:=#]\s*", r"\b", needs="[:=#]"),
    Rule("username_handle", "USERNAME", 0.8, r"@[A-Za-z0-9._]{3,30}", r"(?<![\w@])", r"\b", needs="@"),
    Rule("person_honorific", "PERSON", 0.72, _NAME, r"\b(?:sr\.?a?\.?|sra\.?|srta\.?|do[nñ]a?|d\.?[ªº]?|mr\.?|mrs\.?|ms\.?|miss|dr\.?a?\.?|ing\.?|lic\.?|prof\.?)[ \t]+"),
    Rule("person_labeled", "PERSON", 0.75, _NAME, r"(?:nombre(?:\s*(?:y\s*apellidos?|completo))?|cliente|titular|solicitante|arrendatario|arrendador|destinatario|remitente|atenci[oó]n\s*a|a\s*la\s*atenci[oó]n\s*de|name|full\s*name|customer|client|tenant|landlord|recipient|attn\.?|bill\s*to|ship\s*to)[ \t]*[:#][ \t]*", needs="[:#]"),
)
BY_NAME = {r.name: r for r in RULES}
#: What a rule says of a match; the other fields of an entity are added once, behind all rules.
FOUND = ("ord", "start", "end", "type", "score", "source", "text", "rule", "checksum", "checksum_passed", "context_keyword", "dob_context")


def context_hit(text: Column, start: Column, end: Column, words: tuple[str, ...], same_line: bool = False, width: int = WINDOW) -> Column:
    """The first of the words, in their order, that stands near the span; null if none does. The value counts as near."""
    before = slice_text(text, F.greatest(start - width, F.lit(0)), start)
    after = F.substring(text, end + 1, F.lit(width))
    if same_line:
        before, after = F.substring_index(before, "\n", -1), F.substring_index(after, "\n", 1)
    near = F.lower(F.concat(before, slice_text(text, start, end), after))
    return let(near, lambda n: F.coalesce(*[F.when(F.contains(n, F.lit(w)), F.lit(w)) for w in words]))


def scan(text: Column, rule: Rule, number: int, width: int = WINDOW) -> Column:
    """The rule's findings in a text, scored, not yet trimmed: structs of the FOUND fields."""

    def judged(m: Column) -> Column:
        """What is known about a match, each computed once."""
        passed = checks.CHECKS[rule.check](m["value"]) if rule.check else F.lit(None).cast("boolean")
        hit = context_hit(text, m["start"], m["end"], rule.context, width=width) if rule.context else F.lit(None).cast("string")
        dob = context_hit(text, m["start"], m["end"], BIRTH, same_line=True, width=width) if rule.kind == "DATE_TIME" else F.lit(None).cast("string")
        return F.struct(passed.alias("passed"), hit.alias("hit"), dob.alias("dob"))

    def scored(m: Column) -> Column:
        return let(judged(m), lambda q: found_entity(m, q))

    def found_entity(m: Column, q: Column) -> Column:
        score, kind = F.lit(rule.score), F.lit(rule.kind)
        if rule.check:
            score = F.when(q["passed"], F.least(F.lit(0.99), score + 0.11)).otherwise(F.lit(rule.invalid if rule.invalid is not None else 0.0))
        if rule.context:
            score = F.when(q["hit"].isNotNull(), F.least(F.lit(0.99), score + 0.06)).otherwise(F.greatest(F.lit(0.35), score - 0.12))
        if rule.kind == "DATE_TIME":
            kind = F.when(q["dob"].isNotNull(), F.lit("DATE_OF_BIRTH")).otherwise(kind)
            score = F.when(q["dob"].isNotNull(), F.least(F.lit(0.99), score + 0.05)).otherwise(score)
        made = {"ord": F.lit(number), "start": m["start"], "end": m["end"], "type": kind, "score": score, "source": F.lit("rules"), "text": m["value"], "rule": F.lit(rule.name), "checksum": F.lit(rule.check), "checksum_passed": q["passed"], "context_keyword": q["hit"], "dob_context": q["dob"]}
        return F.struct(*[made[k].cast(FIELDS[k]).alias(k) for k in FOUND])

    found = find_all(text, rule.head, rule.body, rule.tail, rule.flags)
    if rule.guard is not None:
        found = F.filter(found, lambda m: rule.guard(m["value"]))
    found = F.transform(found, scored)
    if rule.check and rule.invalid is None:
        found = F.filter(found, lambda e: e["checksum_passed"])
    return F.filter(found, lambda e: e["context_keyword"].isNotNull()) if rule.require_context else found


def detect_in_expressions(docs: DataFrame, rules: tuple[Rule, ...] = RULES, width: int = WINDOW, into: str = "found") -> DataFrame:
    """`detect` without Python workers: what the loop is held against, and the way of rules with a guard, which is a Column's."""
    text, lang = F.coalesce(F.col("text"), F.lit("")), F.col("lang")
    none = F.array().cast(f"array<struct<{','.join(f'`{k}`:{FIELDS[k]}' for k in FOUND)}>>")
    found = [F.when(lang.isin(*r.langs), scan(text, r, i, width)).otherwise(none) for i, r in enumerate(rules)]
    docs = docs.withColumn("_raw", F.flatten(F.array(*found)))
    docs = docs.withColumn("_raw", normalize(text, F.col("_raw")))
    whole = F.transform(F.col("_raw"), lambda e: entity(**{k: e[k] for k in FOUND}))
    return docs.withColumn(into, resolve(whole)).drop("_raw")


def detect(docs: DataFrame, rules: tuple[Rule, ...] = RULES, width: int = WINDOW, into: str = "found") -> DataFrame:
    """docs(text, lang, ...) with the rules' findings: trimmed, the strongest of overlapping ones kept, by start."""
    if any(r.guard is not None for r in rules):
        return detect_in_expressions(docs, rules, width, into)
    ship(docs.sparkSession)
    # Declared as not deterministic, so that no optimizer rule copies the call.
    loop = F.arrow_udf(ruleloop.over_batches(rules, width, BIRTH), ruleloop.DDL).asNondeterministic()
    docs = docs.withColumn("_loop", loop(F.coalesce(F.col("text"), F.lit("")), F.col("lang")))
    found = {k: None for k in (*ruleloop.TYPES, "suppressed")}
    whole = F.transform(F.col("_loop"), lambda e: entity(source=F.lit("rules"), **{k: e[k] for k in found}))
    return docs.withColumn(into, whole).drop("_loop")
