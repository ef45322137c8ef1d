"""Annotated synthetic texts at any scale, and their quality checks.

Every value is a function of (seed, id, slot): the corpus is the same whatever the partitioning, and rows are built
where they are. Segments are arrays of (type, value), plain text having no type.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskline import fixed_values as fixed
from maskline.functions import checks
from maskline.functions.text import let, quote, title_case

# Public place names and postcodes, invented people and companies.
PLACES = [
    ("Rennes", "35000"), ("Nantes", "44000"), ("Le Mans", "72000"), ("Aix-en-Provence", "13100"), ("Pau", "64000"),
    ("Saint-Malo", "35400"), ("Lille", "59000"), ("Dijon", "21000"), ("Boulogne-sur-Mer", "62200"), ("Annecy", "74000"),
]
FIRST_NAMES = ["Alix", "Bruno", "Claire", "Didier", "Édith", "Fabien", "Gaëlle", "Hugo", "Irène", "Jean-Luc", "Karim", "Lise"]
LAST_NAMES = ["Aubry", "Besson", "Chevalier", "Delmas", "Fabre", "Gaillard", "Humbert", "Lacroix", "Marchal", "Noël", "Perrin", "Roche"]
STREETS = ["rue des Peupliers", "avenue du Stade", "place de la Mairie", "chemin des Vignes", "quai du Canal", "impasse du Lavoir"]
COMPANIES = ["Société Nordique", "Atelier Beaulieu", "Groupe Verdon", "Comptoir Armor"]
MAIL_JOINS = [".", "_", "-", ""]
ACCENTED, PLAIN = "àâäçéèêëîïôöùûüÿ", "aaaceeeeiioouuuy"
MAIL_DOMAINS = ["example.fr", "example.org", "example.net"]


class Pick:
    """Pseudo-random choices of one row, by slot: a hash of seed, id and slot."""

    def __init__(self, seed: int, id_: Column):
        self.seed, self.id = seed, id_

    def number(self, slot: str, low: int, high: int) -> Column:
        """A whole number from low to high, both included."""
        return F.pmod(F.xxhash64(F.lit(self.seed), self.id, F.lit(slot)), F.lit(high - low + 1)) + low

    def one(self, slot: str, items: list[str]) -> Column:
        return F.get(F.array(*map(F.lit, items)), self.number(slot, 0, len(items) - 1).cast("int"))

    def digits(self, slot: str, n: int, low: int = 0) -> Column:
        return F.lpad(self.number(slot, low, 10**n - 1).cast("string"), n, "0")


def laid_out(p: Pick, slot: str, value: Column, masks: list[str]) -> Column:
    """value in one of the layouts, each as likely as the others: a mask has a # for each of its characters in turn."""

    def fill(v: Column, mask: str) -> Column:
        parts, at = [], 1
        for run in re.findall(r"#+|[^#]+", mask):
            parts.append(F.substring(v, at, len(run)) if run[0] == "#" else F.lit(run))
            at += len(run) if run[0] == "#" else 0
        return F.concat(*parts)

    return let(value, lambda v: F.get(F.array(*[fill(v, m) for m in masks]), p.number(f"{slot}.mask", 0, len(masks) - 1).cast("int")))


def nir(p: Pick, slot: str) -> Column:
    two = lambda part, low, high: F.lpad(p.number(f"{slot}.{part}", low, high).cast("string"), 2, "0")
    body = F.concat(
        p.one(f"{slot}.sex", ["1", "2"]), two("year", 0, 99), two("month", 1, 12), two("department", 21, 89),
        p.digits(f"{slot}.town", 3, 100), p.digits(f"{slot}.order", 3, 100),
    )
    whole = let(body, lambda b: F.concat(b, F.lpad(checks.nir_key(b).cast("string"), 2, "0")))
    return laid_out(p, slot, whole, ["###############", "# ## ## ## ### ### ##", "############# ##"])


def fiscal_number(p: Pick, slot: str) -> Column:
    body = F.concat(p.one(f"{slot}.first", ["0", "1", "2", "3"]), p.digits(f"{slot}.rest", 9))
    whole = let(body, lambda b: F.concat(b, F.lpad(checks.fiscal_key(b).cast("string"), 3, "0")))
    return laid_out(p, slot, whole, ["## ## ### ### ###", "#############", "#### ### ### ###"])


def iban(p: Pick, slot: str) -> Column:
    bban = F.concat(p.digits(f"{slot}.bank", 10), p.digits(f"{slot}.account", 13))
    whole = let(bban, lambda b: F.concat(F.lit("FR"), checks.iban_key(F.lit("FR"), b), b))
    return laid_out(p, slot, whole, ["#### #### #### #### #### #### ###", "#" * 27, "#### ##### ##### ########### ##"])


def card(p: Pick, slot: str) -> Column:
    body = F.concat(p.one(f"{slot}.brand", ["40", "43", "51", "54", "60"]), p.digits(f"{slot}.rest", 13))
    digit = lambda b: F.pmod(F.lit(10) - checks.luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10))
    whole = let(body, lambda b: F.concat(b, digit(b).cast("string")))
    return laid_out(p, slot, whole, ["#### #### #### ####", "####-####-####-####", "#" * 16])


def phone(p: Pick, slot: str) -> Column:
    national = F.concat(p.one(f"{slot}.zone", ["14", "22", "33", "45", "56", "64", "77", "97"]), p.digits(f"{slot}.rest", 7))
    return laid_out(p, slot, national, ["0# ## ## ## ##", "0#-##-##-##-##", "+33#########", "0033 # ## ## ## ##"])


def unaccented(name: Column) -> Column:
    """A name as it stands in an address: small letters without accents, no spaces or apostrophes."""
    return F.regexp_replace(F.translate(F.lower(name), ACCENTED, PLAIN), "[ '’]", "")


def email(p: Pick, slot: str, first: str = "first", last: str = "last") -> Column:
    """The address of the person whose names are picked at first and last, in one of several forms, numbered or not."""
    one, other = unaccented(p.one(first, FIRST_NAMES)), unaccented(p.one(last, LAST_NAMES))
    forms = [(one, other), (F.left(one, F.lit(1)), other), (other, one)]
    join, n = p.one(f"{slot}.join", MAIL_JOINS), p.number(f"{slot}.n", 0, 300)
    local = F.get(F.array(*[F.concat(a, join, b) for a, b in forms]), p.number(f"{slot}.form", 0, len(forms) - 1).cast("int"))
    return F.concat(local, F.when(n < 100, n.cast("string")).otherwise(""), F.lit("@"), p.one(f"{slot}.domain", MAIL_DOMAINS))


def siret(p: Pick, slot: str) -> Column:
    """A company's number: fourteen digits, the last a check digit, and the first none that a bank card begins with."""
    body = F.concat(p.digits(f"{slot}.company", 9, 7 * 10**8), p.digits(f"{slot}.seat", 4))
    digit = lambda b: F.pmod(F.lit(10) - checks.luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10))
    whole = let(body, lambda b: F.concat(b, digit(b).cast("string")))
    return laid_out(p, slot, whole, ["### ### ### #####", "##############"])


def valid_identifiers(ids: DataFrame, seed: int = 1) -> DataFrame:
    """ids (id) -> one value of every identifier type per row, check digits right, in several layouts; the e-mail is that of
    the person, and the company number is nobody's."""
    p = Pick(seed, F.col("id"))
    makers = {
        "FR_NIR": nir, "FR_FISCAL_NUMBER": fiscal_number, "IBAN_CODE": iban, "CREDIT_CARD": card, "PHONE_NUMBER": phone, "EMAIL_ADDRESS": email,
    }
    name = F.concat_ws(" ", p.one("first", FIRST_NAMES), p.one("last", LAST_NAMES))
    return ids.select("id", name.alias("PERSON"), siret(p, "SIRET").alias("SIRET"), *[make(p, kind).alias(kind) for kind, make in makers.items()])


def _values(p: Pick) -> dict[str, Column]:
    """The values that the templates of a row draw from, each worked out once."""
    day = F.date_add(F.lit("2021-03-01").cast("date"), p.number("day", 0, 900).cast("int"))
    amount = p.number("amount", 900, 700000)
    return {
        "name": F.concat_ws(" ", p.one("first", FIRST_NAMES), p.one("last", LAST_NAMES)),
        "doctor": p.one("doctor", LAST_NAMES),
        "street": F.concat_ws(" ", p.number("house", 2, 98).cast("string"), p.one("street", STREETS)),
        "town": p.one("town", [f"{code} {city}" for city, code in PLACES]),
        "city": p.one("city", [c for c, _ in PLACES]),
        "mail": email(p, "mail"),
        "phone": phone(p, "phone"),
        "iban": iban(p, "iban"),
        "nir": nir(p, "nir"),
        "fiscal": fiscal_number(p, "fiscal"),
        "card": card(p, "card"),
        "ip": F.concat_ws(".", *[p.number(f"ip.{i}", 11, 223).cast("string") for i in range(4)]),
        "day": F.date_format(day, "d.M.yyyy"),
        "amount": F.concat(F.floor(amount / 100).cast("string"), F.lit(","), F.lpad((amount % 100).cast("string"), 2, "0"), F.lit(" EUR")),
        "ref": F.concat(F.lit("dossier "), p.number("file", 100, 99999).cast("string")),
        "company": p.one("company", COMPANIES),
        "siret": siret(p, "siret"),
    }


# Kinds of texts. A template names values in braces; `type:value` makes an annotated item of it, and
# `FR_ADDRESS:address` or `FR_ADDRESS:block` joins street and town on one line or two.
TEMPLATES = {
    "parking_permit": "Carte de stationnement demandée par Mme {PERSON:name}. Domicile : {FR_ADDRESS:address}. "
    "Justificatif attendu à {EMAIL_ADDRESS:mail} avant le {day}.",
    "library": "Bibliothèque de {LOCATION:city} : {PERSON:name} a trois livres en retard depuis le {day}. "
    "Amende de {amount}, renseignements au {PHONE_NUMBER:phone}.",
    "payroll": "Bulletin de paie\n{PERSON:name}\n{FR_ADDRESS:block}\nN° de sécurité sociale {FR_NIR:nir}\n"
    "Net versé : {amount}, virement sur {IBAN_CODE:iban}\n",
    "tax_notice": "Avis du {day} : {PERSON:name}, numéro fiscal {FR_FISCAL_NUMBER:fiscal}, doit encore {amount}.",
    "login_alert": "Connexion depuis {IP_ADDRESS:ip} au compte {EMAIL_ADDRESS:mail}. La carte {CREDIT_CARD:card} est bloquée, {ref}.",
    "house_call": "Bonjour Dr {PERSON:doctor}, je serai à {LOCATION:city} le {day}. On peut m'appeler au {PHONE_NUMBER:phone}.",
    "supplier": "{company}\nSIRET {siret}\nContact : M. {PERSON:name}\n{FR_ADDRESS:address}\nPaiement sur {IBAN_CODE:iban}, {ref}",
}
KINDS = list(TEMPLATES)


def _segments(template: str) -> str:
    """A template as a SQL array of (type, value) segments over the value columns."""
    parts = []
    for i, part in enumerate(re.split(r"\{([^}]+)\}", template)):
        kind, _, name = part.rpartition(":") if i % 2 else ("", "", "")
        if i % 2:
            value = {"address": "concat(street, ', ', town)", "block": "concat(street, '\\n', town)"}.get(name, f"`{name}`")
        elif part:
            value = quote(part)
        else:
            continue
        parts.append(f"struct({quote(kind) if kind else 'cast(NULL AS string)'} AS type, {value} AS value)")
    return f"array({', '.join(parts)})"


def corpus_segments(ids: DataFrame, seed: int = 1) -> DataFrame:
    """ids (id) -> (id, kind, segments); the kind goes round the kinds by id."""
    values = ids.select("id", *[v.alias(n) for n, v in _values(Pick(seed, F.col("id"))).items()])
    place = f"pmod(id, {len(KINDS)})"
    kinds = " ".join(f"WHEN {i} THEN {quote(kind)}" for i, kind in enumerate(KINDS))
    segments = " ".join(f"WHEN {i} THEN {_segments(TEMPLATES[kind])}" for i, kind in enumerate(KINDS))
    return values.select(
        "id", F.expr(f"CASE {place} {kinds} END").alias("kind"), F.expr(f"CASE {place} {segments} END").alias("segments")
    )


def render_segments(segments: DataFrame) -> DataFrame:
    """(id, kind, segments) -> (id, kind, text, entities) with exact offsets, within the row."""
    placed = F.aggregate(
        "segments",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, s: F.struct(
            (acc["at"] + F.length(s["value"])).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")
        ),
        lambda acc: acc["starts"],
    )
    joined = F.zip_with(
        "segments",
        placed,
        lambda s, at: F.struct(
            s["type"].alias("type"), at.alias("start"), (at + F.length(s["value"])).alias("end"), s["value"].alias("value")
        ),
    )
    return segments.select(
        "id", "kind", F.array_join(F.transform("segments", lambda s: s["value"]), "").alias("text"),
        F.filter(joined, lambda e: e["type"].isNotNull()).alias("entities"),
    )


def build_corpus(ids: DataFrame, seed: int = 1) -> DataFrame:
    return render_segments(corpus_segments(ids, seed))


# --- Quality checks: each returns the violations ---------------------------------------------------------------------


def check_offsets(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """Annotations whose text is not their value."""
    joined = gold.join(docs.select("doc_id", "text"), "doc_id")
    there = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return joined.where(~there.eqNullSafe(F.col("value"))).select(gold.columns)


def check_no_overlap(gold: DataFrame) -> DataFrame:
    """Annotations that start before the previous one of their text has ended."""
    order = W.partitionBy("doc_id").orderBy("start", "end")
    return gold.withColumn("_previous", F.lag("end").over(order)).where("_previous > start").drop("_previous")


def check_identifiers(gold: DataFrame) -> DataFrame:
    """Identifiers whose check digits, or numbering plan, are wrong."""
    value, kind = F.col("value"), F.col("entity_type")
    right = (
        F.when(kind == "FR_NIR", checks.valid_nir(value))
        .when(kind == "FR_FISCAL_NUMBER", checks.valid_fiscal_number(value))
        .when(kind == "IBAN_CODE", checks.valid_iban(value))
        .when(kind == "CREDIT_CARD", checks.valid_luhn(value))
        .when(kind == "PHONE_NUMBER", checks.valid_fr_phone(value))
        .otherwise(True)
    )
    return gold.where(~right)


def corpus_profile(annotated: DataFrame) -> DataFrame:
    """Texts per kind, and items per type of each kind."""
    items = annotated.select("kind", F.explode("entities.type").alias("entity_type"))
    texts = annotated.groupBy("kind").agg(F.count("*").alias("n")).select("kind", F.lit("TEXTS").alias("entity_type"), "n")
    return items.groupBy("kind", "entity_type").agg(F.count("*").alias("n")).unionByName(texts)


def corpus_fingerprint(annotated: DataFrame) -> DataFrame:
    """One hash for the whole corpus that does not depend on the order of the rows."""
    row = F.xxhash64("id", "kind", "text", F.to_json("entities"))
    return annotated.agg(F.count("*").alias("texts"), F.bit_xor(row).alias("fingerprint"))


def first_name_dictionary(census: DataFrame, excluded: DataFrame, min_births: int = fixed.FIRST_NAME_MIN_BIRTHS) -> DataFrame:
    """Births per title-cased spelling over years and sexes; rare-name groups (`_...`) and exclusions dropped."""
    # Summed per raw spelling first: the title case is worked out once per spelling.
    raw = census.where(~F.startswith("preusuel", F.lit("_"))).groupBy("preusuel").agg(F.sum("nombre").alias("_n"))
    births = raw.groupBy(title_case(F.col("preusuel")).alias("name")).agg(F.sum("_n").cast("bigint").alias("births"))
    return births.where(F.col("births") >= min_births).join(excluded.select("name"), "name", "left_anti")
