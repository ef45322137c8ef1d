"""Queries of the detection family."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskline import fixed_values as fixed
from maskline.operators import detect as d
from maskline.operators import plugins as p
from suite.registry import query, tagged

OUT = ["doc_id", "start", "end", "entity_type", "score", "context_word", "checksum", "value"]
TYPES = {"score": "DOUBLE", "context_word": "VARCHAR", "checksum": "BOOLEAN"}
SPOKEN = "(select * from documents where lang in ('fr', 'en')) docs"


def out(spans):
    return spans.select(*OUT)


def expected(found: str, entity_type: str, score: str, context: str = "null", checksum: str = "null", where: str = "true") -> str:
    return f"""select doc_id, start, "end", '{entity_type}' as entity_type, {score} as score, {context} as context_word,
{checksum} as checksum, value from ({found}) found where {where}"""


EMAIL_RE = r"\b[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}\b"
IP_RE = r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"


def found_emails(docs: str) -> str:
    return tagged(docs, EMAIL_RE)


@query("find_spans", f"""select doc_id, 'HASH' as entity_type, 0.2 as score, start, "end", value from ({tagged('documents docs', '[0-9]{2,}')}) found""", score="DOUBLE")
def find_spans(t):
    """Every number of two digits or more, all languages."""
    return d.find_spans(t("documents"), "[0-9]{2,}", "HASH", 0.2).drop("recognizer")


NIR_RE = r"\b[1-478] ?[0-9]{2} ?(?:0[1-9]|1[0-2]|[23][0-9]|4[0-2]|[5-9][0-9]) ?(?:[0-9]{2}|2[AB]) ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}\b"
_NIR_OK = "97 - cast(substr(replace(value, ' ', ''), 1, 13) as bigint) % 97 = cast(substr(replace(value, ' ', ''), 14, 2) as bigint)"


@query("detect_fr_nir", expected(tagged("fx_nir", NIR_RE), "FR_NIR", "1.0", "'sécurité'", "true", _NIR_OK), **TYPES)
def detect_fr_nir(t):
    return out(d.detect_fr_nir(t("fx_nir")))


FISCAL_RE = r"\b[0-3][0-9] ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}\b"
_FISCAL_OK = "cast(substr(replace(value, ' ', ''), 1, 10) as bigint) % 511 = cast(substr(replace(value, ' ', ''), 11, 3) as bigint)"


@query("detect_fr_fiscal_number", expected(tagged("fx_fiscal", FISCAL_RE), "FR_FISCAL_NUMBER", "1.0", "'fiscal'", "true", _FISCAL_OK), **TYPES)
def detect_fr_fiscal_number(t):
    return out(d.detect_fr_fiscal_number(t("fx_fiscal")))


@query("detect_fr_address", """select doc_id, start, "end", entity_type, 0.95 as score, 'domicil' as context_word,
cast(null as boolean) as checksum, value from fx_gold where entity_type = 'FR_ADDRESS'""", **TYPES)
def detect_fr_address(t):
    return out(d.detect_fr_address(t("fx_letters")))


TOWNS = """select g.doc_id, cast(g."end" - length(p.town) as int) as start, g."end", 'FR_ADDRESS' as entity_type, 0.3 as score,
cast(null as string) as context_word, cast(null as boolean) as checksum, p.town as value
from fx_gold g join fx_parts p on p.k = g.doc_id where g.entity_type = 'FR_ADDRESS'"""


@query("detect_fr_postcode_city", TOWNS, **TYPES)
def detect_fr_postcode_city(t):
    return out(d.detect_fr_postcode_city(t("fx_letters")))


CARD_RE = (r"\b(?:[1346][0-9]{3}|5[0-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)"
           r"[- ]?[0-9]{3,4}[- ]?[0-9]{3,4}[- ]?[0-9]{3,5}\b")
_LUHN = """list_sum(list_transform(range(length(regexp_replace(value, '[^0-9]', '', 'g'))), lambda j:
  case when j % 2 = 0 then cast(reverse(regexp_replace(value, '[^0-9]', '', 'g'))[j + 1] as int)
  else (cast(reverse(regexp_replace(value, '[^0-9]', '', 'g'))[j + 1] as int) * 2) % 10 + cast(floor(cast(reverse(regexp_replace(value, '[^0-9]', '', 'g'))[j + 1] as int) / 5) as int) end)) % 10 = 0"""
_CARDS = f"(select doc_id, lang, text from fx_card union all select doc_id + 1000000000, lang, text from {SPOKEN}) docs"


@query("detect_credit_card", expected(
    tagged(_CARDS, CARD_RE), "CREDIT_CARD", "1.0", "case when doc_id < 1000000000 then 'carte' end", "true",
    f"{_LUHN} and not (value like '1%' and length(value) = 13)"), **TYPES)
def detect_credit_card(t):
    cards = t.sql(f"select doc_id, lang, text from fx_card union all select doc_id + 1000000000, lang, text from {SPOKEN}")
    return out(d.detect_credit_card(cards))


PLAN = "|".join(fixed.FR_NUMBER_PREFIXES)


@query("detect_fr_phone", f"""select doc_id, cast(strpos(text, value) - 1 as int) as start, cast(strpos(text, value) - 1 + length(value) as int) as "end",
'PHONE_NUMBER' as entity_type, 0.75 as score, 'appel' as context_word, cast(null as boolean) as checksum, value
from fx_phone where regexp_matches(national, '^(?:{PLAN})')""", **TYPES)
def detect_fr_phone(t):
    return out(d.detect_fr_phone(t("fx_phone")))


@query("detect_intl_phone", expected(
    tagged("(select * from documents where lang = 'en') docs", r"\+1 \([2-9][0-9]{2}\) [2-9][0-9]{2}-[0-9]{4}\b"),
    "PHONE_NUMBER", "0.4"), **TYPES)
def detect_intl_phone(t):
    return out(d.detect_intl_phone(t("documents")))


@query("detect_iban", """select doc_id, cast(strpos(text, value) - 1 as int) as start, cast(strpos(text, value) - 1 + length(value) as int) as "end",
'IBAN_CODE' as entity_type, 1.0 as score, 'virement' as context_word, true as checksum, value from fx_iban where valid""", **TYPES)
def detect_iban(t):
    return out(d.detect_iban(t("fx_iban")))


@query("detect_email", expected(found_emails(SPOKEN), "EMAIL_ADDRESS", "1.0", checksum="true"), **TYPES)
def detect_email(t):
    return out(d.detect_email(t("documents")))


@query("detect_ip", expected(
    tagged(SPOKEN, IP_RE), "IP_ADDRESS", "0.6",
    where="list_max(list_transform(string_split(value, '.'), lambda o: cast(o as int))) <= 255"), **TYPES)
def detect_ip(t):
    return out(d.detect_ip(t("documents")))


_LINKS = "(select page_id as doc_id, 'en' as lang, 'Read ' || url || ' or write to office@' || split_part(split_part(url, '/', 3), ':', 1) || ', thanks.' as text from pages) docs"


@query("detect_url_outside_email", f"""select doc_id, 5 as start, cast(5 + length(url) as int) as "end", 'URL' as entity_type, 0.6 as score,
cast(null as string) as context_word, cast(null as boolean) as checksum, url as value from (select page_id as doc_id, url from pages) p""", **TYPES)
def detect_url_outside_email(t):
    return out(d.detect_url_outside_email(t.sql(f"select * from {_LINKS}")))


# Public example addresses; every second customer writes one with its last character changed.
WALLETS = ["1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"]
_WALLET = "case c_custkey % 3 " + " ".join(f"when {i} then '{w}'" for i, w in enumerate(WALLETS)) + " end"
_WALLETS = f"""select c_custkey as doc_id, 'en' as lang, c_name || ' pays with bitcoin from ' ||
case when c_custkey % 2 = 0 then {_WALLET} else substr({_WALLET}, 1, length({_WALLET}) - 1) || 'x' end || ' now' as text from customer"""


@query("detect_crypto", f"""select c_custkey as doc_id, cast(length(c_name) + 24 as int) as start, cast(length(c_name) + 24 + length({_WALLET}) as int) as "end",
'CRYPTO' as entity_type, 1.0 as score, 'bitcoin' as context_word, true as checksum, {_WALLET} as value from customer where c_custkey % 2 = 0""", **TYPES)
def detect_crypto(t):
    return out(d.detect_crypto(t.sql(_WALLETS)))


_DAY = "cast(cast(o_orderdate as date) as string)"
_ORDERS = f"""select o_orderkey as doc_id, 'fr' as lang, 'Commande ' || o_orderpriority || ' du ' || case when o_orderkey % 2 = 0 then {_DAY}
else substr({_DAY}, 9, 2) || '/' || substr({_DAY}, 6, 2) || '/' || substr({_DAY}, 1, 4) end || '.' as text from orders"""


@query("detect_date_time", f"""select doc_id, cast(length(text) - 11 as int) as start, cast(length(text) - 1 as int) as "end", 'DATE_TIME' as entity_type,
0.6 as score, cast(null as string) as context_word, cast(null as boolean) as checksum, substr(text, length(text) - 10, 10) as value from ({_ORDERS}) o""", **TYPES)
def detect_date_time(t):
    return out(d.detect_date_time(t.sql(_ORDERS)))


_NAMED = """select doc_id, cast(length(pre) as int) as start, cast(length(pre) + length(name) as int) as "end", 'PERSON' as entity_type,
{score} as score, cast(null as string) as context_word, cast(null as boolean) as checksum, name as value from fx_names where {where}"""


@query("detect_person_titled", """select doc_id, start, "end", entity_type, 0.85 as score, cast(null as string) as context_word,
cast(null as boolean) as checksum, value from fx_gold where entity_type = 'PERSON'""", **TYPES)
def detect_person_titled(t):
    docs = t.sql("select doc_id, lang, text from fx_letters union all select doc_id, lang, text from fx_names where kind = 2")
    return out(d.detect_person_titled(docs))


@query("detect_person_on_line", _NAMED.format(score="0.85", where="kind in (0, 1)"), **TYPES)
def detect_person_on_line(t):
    return out(d.detect_person_on_line(t("fx_names"), t("fx_first_names")))


@query("detect_person_named", _NAMED.format(score="case kind when 2 then 0.6 else 0.3 end", where="kind in (2, 3)"), **TYPES)
def detect_person_named(t):
    return out(d.detect_person_named(t("fx_names"), t("fx_first_names")))


_LABELS = "case doc_id % 8 when 0 then 'PER' when 1 then 'LOC' when 2 then 'ORG' when 3 then 'GPE' when 4 then 'MISC' when 5 then 'DATE' when 6 then 'NORP' else 'MONEY' end"
_MODEL = f"""select doc_id, 0 as start, 5 as "end", {_LABELS} as label, 0.85e0 as score from documents"""


@query("map_entity_labels", f"""select doc_id, start, "end", case label when 'PER' then 'PERSON' when 'LOC' then 'LOCATION' when 'GPE' then 'LOCATION'
when 'DATE' then 'DATE_TIME' when 'NORP' then 'NRP' end as entity_type, score from ({_MODEL}) m where label not in ('ORG', 'MISC', 'MONEY')""")
def map_entity_labels(t):
    return d.map_entity_labels(t.sql(_MODEL))


# What the nine types of a letter give, with the context word that the letter puts before each.
_ALL = f"""
select doc_id, start, "end", entity_type, value,
  case entity_type when 'PERSON' then 0.85 when 'FR_ADDRESS' then 0.95 when 'PHONE_NUMBER' then 0.75 when 'IP_ADDRESS' then 0.6 else 1.0 end as score,
  case entity_type when 'FR_ADDRESS' then 'domicil' when 'PHONE_NUMBER' then 'joindre' when 'FR_NIR' then 'sécurité'
    when 'FR_FISCAL_NUMBER' then 'fiscal' when 'IBAN_CODE' then 'compte' when 'CREDIT_CARD' then 'carte' end as context_word,
  case when entity_type in ('EMAIL_ADDRESS', 'FR_NIR', 'FR_FISCAL_NUMBER', 'IBAN_CODE', 'CREDIT_CARD') then true end as checksum,
  case entity_type when 'PERSON' then 'FrPerson' when 'FR_ADDRESS' then 'FrAddress' when 'PHONE_NUMBER' then 'FrPhone' when 'EMAIL_ADDRESS' then 'Email'
    when 'FR_NIR' then 'FrNir' when 'FR_FISCAL_NUMBER' then 'FrFiscalNumber' when 'IBAN_CODE' then 'Iban' when 'CREDIT_CARD' then 'Card' else 'Ip' end as recognizer,
  case entity_type when 'PERSON' then 0.85 when 'FR_ADDRESS' then 0.6 when 'PHONE_NUMBER' then 0.4 when 'IP_ADDRESS' then 0.6 when 'EMAIL_ADDRESS' then 0.5
    when 'IBAN_CODE' then 0.5 else 0.3 end as original_score
from fx_gold
union all select doc_id, start, "end", entity_type, value, score, context_word, checksum, 'FrAddress', 0.3 from ({TOWNS}) towns"""


@query("detect_all", f"""select doc_id, start, "end", entity_type, score, context_word, checksum, value from ({_ALL}) a""", **TYPES)
def detect_all(t):
    return out(d.detect_all(t("fx_letters"), t("fx_first_names")))


def case_numbers(texts: list[str]) -> list[list[tuple]]:
    """A user's detector that is not always right: it breaks on some texts and places some spans outside."""
    found = []
    for text in texts:
        number = text.split()[1]
        if int(number) % 7 == 0:
            raise ValueError(number)
        spans = [(8, 8 + len(number), "CASE_NUMBER", 0.7)]
        found.append(spans + [(0, len(text) + 1, "CASE_NUMBER", 0.7)] * (int(number) % 11 == 0))
    return found


CASES = p.Detector("Cases", ("CASE_NUMBER",), case_numbers, languages=("fr",))
_SPAN = "doc_id, entity_type, start, \"end\", value, problem"


@query("plugin_rows", f"""select {_SPAN} from (select k as doc_id, 'CASE_NUMBER' as entity_type, cast(8 as int) as start, cast(8 + length(cast(k as string)) as int) as "end", cast(k as string) as value, cast(null as string) as problem from fx_parts where k % 7 <> 0
union all select k, null, null, null, null, 'failed: ValueError: ' || cast(k as string) from fx_parts where k % 7 = 0
union all select k, null, null, null, null, 'bad span: outside of the text' from fx_parts where k % 11 = 0 and k % 7 <> 0) x""")
def plugin_rows(t):
    return p.plugin_rows(t("fx_letters"), [CASES]).select("doc_id", "entity_type", "start", "end", "value", "problem")


@query("detect_all_plugins", f"""select recognizer, count(*) as spans from ({_ALL}) a group by recognizer union all select 'Cases', count(*) from fx_parts where k % 7 <> 0""")
def detect_all_plugins(t):
    """The recognizers and a user's detector together."""
    found = d.detect_all(t("fx_letters"), t("fx_first_names"), plugins=[CASES])
    return found.groupBy("recognizer").agg(F.count("*").alias("spans"))


@query("explain_spans", f"""select doc_id, entity_type as type, start, "end", value as text, score, recognizer, original_score, context_word, checksum from ({_ALL}) a""", score="DOUBLE", original_score="DOUBLE")
def explain_spans(t):
    return d.explain_spans(d.detect_all(t("fx_letters"), t("fx_first_names")))


def _counted(docs: str, pattern: str, entity_type: str, recognizer: str, where: str = "true") -> str:
    return f"select '{entity_type}' as entity_type, '{recognizer}' as recognizer, count(*) as spans from ({tagged(docs, pattern)}) found where {where}"


@query("detect_all_documents", "select * from (" + " union all ".join([
    _counted(SPOKEN, EMAIL_RE, "EMAIL_ADDRESS", "Email"),
    _counted(SPOKEN, IP_RE, "IP_ADDRESS", "Ip", "list_max(list_transform(string_split(value, '.'), lambda o: cast(o as int))) <= 255"),
    _counted(SPOKEN, CARD_RE, "CREDIT_CARD", "Card", f"{_LUHN} and not (value like '1%' and length(value) = 13)"),
    _counted("(select * from documents where lang = 'en') docs", r"\+1 \([2-9][0-9]{2}\) [2-9][0-9]{2}-[0-9]{4}\b", "PHONE_NUMBER", "Phone"),
]) + ") c where spans > 0")
def detect_all_documents(t):
    """Every recognizer over the whole texts of the documents table: found spans per language, type and recognizer."""
    found = d.detect_all(t("documents"), t("fx_first_names"))
    return found.groupBy("entity_type", "recognizer").agg(F.count("*").alias("spans"))
