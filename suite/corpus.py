"""Queries of the corpus family and of the file sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskline import fixed_values as fixed
from maskline.operators import corpus as c
from maskline.session import shared_folder
from maskline.sources import files
from suite.fixtures import LETTER_TYPES
from suite.registry import parts_of, query

_IDS = "select c_custkey as id from customer"
# Items of each kind of text, as the templates declare them.
_ITEMS = {
    "parking_permit": {"PERSON": 1, "FR_ADDRESS": 1, "EMAIL_ADDRESS": 1},
    "library": {"LOCATION": 1, "PERSON": 1, "PHONE_NUMBER": 1},
    "payroll": {"PERSON": 1, "FR_ADDRESS": 1, "FR_NIR": 1, "IBAN_CODE": 1},
    "tax_notice": {"PERSON": 1, "FR_FISCAL_NUMBER": 1},
    "login_alert": {"IP_ADDRESS": 1, "EMAIL_ADDRESS": 1, "CREDIT_CARD": 1},
    "house_call": {"PERSON": 1, "LOCATION": 1, "PHONE_NUMBER": 1},
    "supplier": {"PERSON": 1, "FR_ADDRESS": 1, "IBAN_CODE": 1},
}
_PROFILE = ", ".join(
    f"({i}, '{kind}', '{t}', {n})" for i, kind in enumerate(c.KINDS) for t, n in {**_ITEMS[kind], "TEXTS": 1}.items()
)


def corpus(t):
    return c.build_corpus(t.sql(_IDS))


_SIZES = ", ".join(f"({i}, '{kind}', {sum(_ITEMS[kind].values())})" for i, kind in enumerate(c.KINDS))


@query("build_corpus", f"""select c_custkey as id, kind, items, true as exact, true as typed from customer join (values {_SIZES}) as k(i, kind, items) on k.i = c_custkey % {len(c.KINDS)}""")
def build_corpus(t):
    """Every text: its kind, its items, whether each item lies where it says, and whether all types are known."""
    there = lambda e: F.substring(F.col("text"), e["start"] + 1, e["end"] - e["start"]) == e["value"]
    return corpus(t).select(
        "id", "kind", F.size("entities").alias("items"), F.forall("entities", there).alias("exact"),
        F.forall("entities", lambda e: e["type"].isin(fixed.MASKED_ENTITIES)).alias("typed"),
    )


@query("corpus_profile", f"""select kind, entity_type, cast(sum(n) as bigint) as n from customer
join (values {_PROFILE}) as p(i, kind, entity_type, n) on p.i = c_custkey % {len(c.KINDS)} group by kind, entity_type""")
def corpus_profile(t):
    return c.corpus_profile(corpus(t))


def _skeleton(template: str) -> str:
    """A template with its items as <TYPE>, numbers as 0 and the company as a word."""
    import re

    plain = {"day": "0.0.0", "amount": "0,0 EUR", "ref": "dossier 0", "company": "Société", "siret": "0"}
    filled = re.sub(r"\{([A-Z_]+):[a-z]+\}", r"<\1>", template)
    return re.sub(r"\{([a-z]+)\}", lambda m: plain[m[1]], filled)


_SKELETONS = " ".join(f"when {i} then '{_skeleton(c.TEMPLATES[kind])}'".replace("m'appeler", "m''appeler") for i, kind in enumerate(c.KINDS))


@query("corpus_skeletons", f"select c_custkey as id, case c_custkey % {len(c.KINDS)} {_SKELETONS} end as skeleton from customer")
def corpus_skeletons(t):
    """The texts themselves: each with its items cut out by their places and what else varies made equal."""
    cut = F.aggregate(
        F.array_sort(F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["type"].alias("type")))),
        F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda acc, e: F.struct(
            F.concat(acc["text"], F.substring(F.col("text"), acc["at"] + 1, e["start"] - acc["at"]), F.lit("<"), e["type"], F.lit(">")).alias("text"), e["end"].alias("at")
        ),
        lambda acc: F.concat(acc["text"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    plain = F.regexp_replace(F.regexp_replace(cut, "|".join(c.COMPANIES), "Société"), "[0-9]+(?: [0-9]+)*", "0")
    return corpus(t).select("id", plain.alias("skeleton"))


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9A-Z]', '', 'g')"


@query("valid_identifiers", "select c_custkey as id, true as nir, true as fiscal, true as iban, true as card, true as phone, true as mail, true as siret from customer")
def valid_identifiers(t):
    """The identifiers, audited with other arithmetic than the one that made them."""
    made = c.valid_identifiers(t.sql(_IDS))
    compact = lambda v: F.regexp_replace(v, "[^0-9A-Z]", "")
    nir, spi, iban, card = (compact(F.col(x)) for x in ("FR_NIR", "FR_FISCAL_NUMBER", "IBAN_CODE", "CREDIT_CARD"))
    body = F.regexp_replace(F.regexp_replace(F.left(nir, F.lit(13)), "2A", "19"), "2B", "18").cast("decimal(20,0)")
    # F = 15, R = 27: the rearranged number in two halves, each within a decimal.
    turned = F.concat(F.substring(iban, 5, 23), F.lit("1527"), F.substring(iban, 3, 2))
    half = F.left(turned, F.lit(15)).cast("decimal(38,0)") % 97 * F.lit(10**14).cast("decimal(38,0)") + F.substring(turned, 16, 14).cast("decimal(38,0)")
    luhn = sum(
        (F.substring(card, i + 1, 1).cast("int") * 2 - F.when(F.substring(card, i + 1, 1).cast("int") > 4, 9).otherwise(0)) if i % 2 == 0
        else F.substring(card, i + 1, 1).cast("int")
        for i in range(16)
    )
    company = compact(F.col("SIRET"))
    siret_sum = sum(
        F.aggregate(F.split((F.substring(company, i + 1, 1).cast("int") * (2 if i % 2 == 0 else 1)).cast("string"), ""), F.lit(0), lambda s, d: s + F.coalesce(d.try_cast("int"), F.lit(0)))
        for i in range(14)
    )
    # The letters of the address are those of the names, or of the last name behind the first one's initial, without accents.
    bare = F.regexp_replace(F.regexp_replace(F.lower("PERSON"), "[éèëê]", "e"), "[^a-z ]", "")
    first, last = F.split(bare, " ")[0], F.split(bare, " ")[1]
    local = F.regexp_replace(F.split("EMAIL_ADDRESS", "@")[0], "[^a-z]", "")
    mail = local.isin(F.concat(first, last), F.concat(F.left(first, F.lit(1)), last), F.concat(last, first)) & F.col("EMAIL_ADDRESS").rlike(r"^[a-z._-]+[0-9]{0,2}@example\.(?:fr|org|net)$")
    return made.select(
        "id",
        (F.lit(97) - body % 97 == F.right(nir, F.lit(2)).cast("int")).alias("nir"),
        (F.left(spi, F.lit(10)).cast("bigint") % 511 == F.right(spi, F.lit(3)).cast("int")).alias("fiscal"),
        (half % 97 == 1).alias("iban"),
        (luhn % 10 == 0).alias("card"),
        F.col("PHONE_NUMBER").rlike(r"^(?:0|\+33|0033 )[1-9](?:[ -]?[0-9]{2}){4}$").alias("phone"),
        mail.alias("mail"),
        (siret_sum % 10 == 0).alias("siret"),
    )


@query("render_segments", """select g.doc_id as id, 'letter' as kind, l.text, g.entity_type as type, g.start, g."end", g.value from fx_gold g join fx_letters l on l.doc_id = g.doc_id""")
def render_segments(t):
    """Letters from all their parts: the text and every item with its place."""
    segment = lambda kind, value: F.struct(F.lit(kind).cast("string").alias("type"), value.alias("value"))
    pairs = [x for i, kind in enumerate(LETTER_TYPES) for x in (segment(None, F.col(f"p{i}")), segment(kind, F.col(f"v{i}")))]
    parts = t("fx_parts").select(
        F.col("k").alias("id"), F.lit("letter").alias("kind"), F.array(*pairs, segment(None, F.lit("."))).alias("segments")
    )
    return c.render_segments(parts).select("id", "kind", "text", F.inline("entities"))


# Gold with mistakes: shifted in every ninth text, overlapping in every eighth.
_BAD = """select doc_id, entity_type, cast(start + case when doc_id % 9 = 0 then 1 else 0 end as int) as start, cast("end" + case when doc_id % 9 = 0 then 1 else 0 end as int) as "end", value from fx_gold
union all select doc_id, 'LOCATION', cast("end" - 4 as int), "end", substr(value, length(value) - 3, 4) from fx_gold where entity_type = 'FR_ADDRESS' and doc_id % 8 = 0"""


@query("check_offsets", f"""select b.* from ({_BAD}) b join fx_letters l on l.doc_id = b.doc_id where substr(l.text, b.start + 1, b."end" - b.start) <> b.value""")
def check_offsets(t):
    return c.check_offsets(t("fx_letters"), t.sql(_BAD))


@query("check_no_overlap", f"""select doc_id, entity_type, start, "end", value from (select *, lag("end") over (partition by doc_id order by start, "end") as p from ({_BAD}) b) x where p > start""")
def check_no_overlap(t):
    return c.check_no_overlap(t.sql(_BAD))


_IDENTIFIERS = """select doc_id, 'FR_NIR' as entity_type, value, valid from fx_nir union all select doc_id, 'FR_FISCAL_NUMBER', value, valid from fx_fiscal
union all select doc_id, 'CREDIT_CARD', value, valid from fx_card union all select doc_id, 'IBAN_CODE', value, valid from fx_iban"""


@query("check_identifiers", f"select doc_id, entity_type, value from ({_IDENTIFIERS}) i where not valid")
def check_identifiers(t):
    return c.check_identifiers(t.sql(f"select doc_id, entity_type, value from ({_IDENTIFIERS}) i"))


@query("corpus_fingerprint", "select count(*) as texts, true as same, false as same_for_other_seed from customer")
def corpus_fingerprint(t):
    """Same seed: same fingerprint, whatever the order and partitioning. Another seed: another one."""
    ids = t.sql(_IDS)
    one = c.corpus_fingerprint(c.build_corpus(ids, 1)).withColumnRenamed("fingerprint", "a")
    two = c.corpus_fingerprint(c.build_corpus(ids.repartition(5, "id"), 1)).select("texts", F.col("fingerprint").alias("b"))
    three = c.corpus_fingerprint(c.build_corpus(ids, 2)).select("texts", F.col("fingerprint").alias("c"))
    return one.join(two, "texts").join(three, "texts").select("texts", F.expr("a = b").alias("same"), F.expr("a = c").alias("same_for_other_seed"))


_TITLED = "case preusuel when 'LÉA-ROSE' then 'Léa-Rose' when 'D''ARCY' then 'D''Arcy' when 'MARC-ANTOINE' then 'Marc-Antoine' else upper(substr(preusuel, 1, 1)) || lower(substr(preusuel, 2)) end"


@query("first_name_dictionary", f"""select {_TITLED} as name, cast(sum(nombre) as bigint) as births from fx_census where preusuel not like '\\_%' escape '\\'
group by 1 having sum(nombre) >= 500 and {_TITLED} not in ('Paris', 'France')""".replace("group by 1 having sum(nombre) >= 500 and " + _TITLED, f"group by {_TITLED} having sum(nombre) >= 500 and {_TITLED}"))
def first_name_dictionary(t):
    excluded = t.sql("select * from (values ('Paris'), ('France')) as x(name)")
    return c.first_name_dictionary(t("fx_census"), excluded)


# --- Sources and sinks -------------------------------------------------------------------------------------------


def scratch(t) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/suite-{uuid.uuid4().hex}"


@query("read_annotated", 'select cast(doc_id as string) as doc_id, entity_type, start, "end", value from fx_gold')
def read_annotated(t):
    path = scratch(t)
    files.write_annotated(t("fx_letters"), t("fx_gold"), path)
    return files.gold_of(files.read_annotated(t.spark, path))


@query("write_annotated", "select cast(l.doc_id as string) as doc_id, l.text, n.n from fx_letters l join fx_annotated_counts n on n.doc_id = l.doc_id")
def write_annotated(t):
    path = scratch(t)
    files.write_annotated(t("fx_letters"), t("fx_gold"), path)
    read = files.read_annotated(t.spark, path)
    return read.select(F.col("id").alias("doc_id"), "text", F.size("entities").cast("bigint").alias("n"))


@query("read_alias_prices", """select c.call_id, c.alias, cast(c.tokens_in * coalesce(a.price_in, 0) + c.tokens_out * coalesce(a.price_out, 0) as double) as price
from fx_calls c join fx_aliases a on a.alias = c.alias""")
def read_alias_prices(t):
    path = scratch(t)
    t("fx_aliases").write.json(path)
    prices = files.read_alias_prices(t.spark, path)
    price = F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")
    return t("fx_calls").join(prices, "alias").select("call_id", "alias", price.cast("double").alias("price"))


_MASKED = ", ".join(f"'{e}'" for e in fixed.MASKED_ENTITIES)


@query("read_masking_policy", f"select doc_id, start, 'MASK' as action from fx_spans where score >= 0.4 and entity_type in ({_MASKED})")
def read_masking_policy(t):
    """The policy as a file, with a type that it doesn't mask."""
    path = scratch(t)
    rows = [(e, "MASK", fixed.SCORE_THRESHOLD) for e in fixed.MASKED_ENTITIES] + [("DATE_TIME", "KEEP", 0.0)]
    t.spark.createDataFrame(rows, "entity_type string, action string, threshold double").write.json(path)
    policy = files.read_masking_policy(t.spark, path).where("action = 'MASK'")
    return t("fx_spans").join(policy, "entity_type").where("score >= threshold").select("doc_id", "start", "action")


@query("read_teams", """select c.call_id, t.team_id, cast(t.max_budget as decimal(18,6)) as max_budget, cast(30 as double) as budget_days, t.rpm_limit, x.alias is not null as allowed from fx_calls c
join fx_teams t on t.team_id = c.team left join fx_access x on x.team_id = c.team and x.alias = c.alias""")
def read_teams(t):
    path = scratch(t)
    allowed = t("fx_access").groupBy("team_id").agg(F.collect_list("alias").alias("models"))
    t("fx_teams").join(allowed, "team_id").select(
        "team_id", "team_alias", "models", "max_budget", F.lit("30d").alias("budget_duration"), "pii_masking",
        F.struct(F.concat("team_id", F.lit("-app")).alias("key_alias"), "rpm_limit", "tpm_limit").alias("key"),
    ).write.json(path)
    teams, access = files.read_teams(t.spark, path)
    calls = t("fx_calls").join(teams, F.col("team") == F.col("team_id"))
    marked = calls.join(access.withColumn("allowed", F.lit(True)), ["team_id", "alias"], "left")
    return marked.select("call_id", "team_id", "max_budget", "budget_days", "rpm_limit", F.coalesce("allowed", F.lit(False)).alias("allowed"))


@query("read_census", "select preusuel, cast(nombre as bigint) as nombre from fx_census")
def read_census(t):
    path = scratch(t)
    t("fx_census").select("sexe", "preusuel", F.col("annee").alias("annais"), "nombre").write.csv(path, sep=";", header=True)
    return files.read_census(t.spark, path)


_LOG = """select call_id as seq, case when call_id % 4 = 0 then 'INFO call ' || alias || ' done' else
  '   -d ''{''model'': ''' || alias || ''', ''messages'': [{''role'': ''user'', ''content'': "It''s ' || cast(tokens_in as string) || ' é"}, {''role'': ''system'', ''content'': ''ok''}], ''stream'': False, ''stop'': None}''' end as value from fx_calls"""


@query("read_request_log", """select call_id as seq, alias as model, 'It''s ' || cast(tokens_in as string) || ' é' as content, 2 as n_messages, false as unreadable from fx_calls where call_id % 4 <> 0""")
def read_request_log(t):
    """The log as files: the sequence is their order, and the call is named in the line before the body."""
    path = scratch(t)
    # A file is read in order by one task: a longer log has more of them.
    log = t.sql(_LOG)
    log.repartition(parts_of(log, least=3)).sortWithinPartitions("seq").select(F.concat_ws("\n", F.concat(F.lit("call "), F.col("seq").cast("string")), "value")).write.text(path)
    lines = files.log_lines(t.spark, path)
    before = W.partitionBy("seq.file").orderBy("seq.line")
    named = lines.withColumn("call", F.regexp_extract(F.lag("value").over(before), "^call ([0-9]+)$", 1))
    calls = named.select(F.col("call").try_cast("bigint").alias("call"), "seq")
    bodies = files.read_request_log(t.spark, path).join(calls, "seq").withColumn("seq", F.col("call"))
    return bodies.select("seq", "model", F.get("messages", F.lit(0))["content"].alias("content"), F.size("messages").alias("n_messages"), "unreadable")


@query("read_observations", "select 'trace-' || cast(call_id as string) as trace_id, alias, tokens_in from fx_calls where team = 'f' and alias = 'click'")
def read_observations(t):
    path = scratch(t)
    observed = t("fx_calls").select(
        F.coalesce("team", F.lit("shared")).alias("project"), F.concat(F.lit("trace-"), F.col("call_id").cast("string")).alias("trace_id"),
        F.lit("call").alias("name"), F.lit("GENERATION").alias("type"), "team", "alias", "tokens_in", "tokens_out",
        F.lit(0).cast("decimal(30,10)").alias("cost"), "latency", F.lit("DEFAULT").alias("level"), F.lit(None).cast("map<string,bigint>").alias("masked"),
    )
    files.write_observations(observed, path)
    return files.read_observations(t.spark, path, ["trace_id", "alias", "tokens_in"], project="f", alias="click")


@query("metrics_tables", """select 'gold_counts' as section, entity_type, cast(count(*) as double) as n from fx_gold group by entity_type
union all select 'left_in_clear', g.entity_type, cast(count(*) as double) from fx_gold g where not exists (
  select 1 from fx_pred p where p.doc_id = g.doc_id and p.start <= g.start and p."end" >= g."end") group by g.entity_type
union all select 'latency', alias, cast(quantile_cont(latency, 0.5) as double) from fx_calls group by alias""")
def metrics_tables(t):
    """Sections of a report, each written as a table and read back."""
    from maskline.operators import evaluate as e

    folder = scratch(t)
    latency = e.latency_percentiles(t("fx_calls").select(F.col("alias").alias("variant"), F.col("latency").alias("ms")))
    sections = {"gold_counts": e.gold_counts(t("fx_gold")), "left_in_clear": e.gold_counts(e.left_in_clear(t("fx_gold"), t("fx_pred"))), "latency": latency}
    files.write_metrics(sections, folder)
    read = {name: t.spark.read.parquet(f"{folder}/{name}") for name in sections}
    row = lambda name, kind, n: read[name].select(F.lit(name).alias("section"), F.col(kind).alias("entity_type"), F.col(n).cast("double").alias("n"))
    return row("gold_counts", "entity_type", "items").unionByName(row("left_in_clear", "entity_type", "items")).unionByName(row("latency", "variant", "p50"))
