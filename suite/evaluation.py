"""Queries of the evaluation and leak-audit families."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from maskline import fixed_values as fixed
from maskline.operators import evaluate as e
from maskline.operators import leaks as l
from maskline.session import shared_folder
from maskline.sources import files
from maskline.sources.files import annotate
from suite.registry import query

HIT = "a.doc_id = b.doc_id and a.entity_type = b.entity_type and a.start < b.\"end\" and b.start < a.\"end\""


@query("match_spans", f"""select a.doc_id, a.entity_type as gold_type, a.start as gold_start, a."end" as gold_end, b.entity_type as pred_type,
b.start as pred_start, b."end" as pred_end from fx_gold a join fx_pred b on {HIT}""")
def match_spans(t):
    return e.match_spans(t("fx_gold"), t("fx_pred"))


def counts(pred: str = "fx_pred", gold: str = "fx_gold", keys: str = "entity_type") -> str:
    return f"""select {keys}, cast(sum(gold) as bigint) as gold, cast(sum(found) as bigint) as found,
cast(sum(predicted) as bigint) as predicted, cast(sum(correct) as bigint) as correct from (
  select {keys}, 1 as gold, case when exists (select 1 from {pred} b where {HIT}) then 1 else 0 end as found, 0 as predicted, 0 as correct from {gold} a
  union all select {keys}, 0, 0, 1, case when exists (select 1 from {gold} b where {HIT}) then 1 else 0 end from {pred} a) u group by {keys}"""


@query("scores_per_type", f"select *, found / nullif(gold, 0) as recall, correct / nullif(predicted, 0) as precision from ({counts()}) c")
def scores_per_type(t):
    return e.scores_per_type(t("fx_gold"), t("fx_pred"))


@query("scores_overall", f"""select *, 2 * precision * recall / (precision + recall) as f1 from (
  select *, correct / predicted as precision, found / gold as recall from (select cast(sum(gold) as bigint) as gold, cast(sum(found) as bigint) as found,
    cast(sum(predicted) as bigint) as predicted, cast(sum(correct) as bigint) as correct from ({counts()}) c) s) r""")
def scores_overall(t):
    return e.scores_overall(t("fx_gold"), t("fx_pred"))


def clear(pred: str, keys: str = "doc_id") -> str:
    """Gold items with a character in clear, character by character."""
    return f"""select distinct g.doc_id, g.entity_type, g.start, g.value from (
  select doc_id, entity_type, start, value, unnest(range(start, "end")) as at from fx_gold) g
left join {pred} p on p.doc_id = g.doc_id and p.start <= g.at and g.at < p."end"
where p.doc_id is null and not regexp_matches(substr(g.value, cast(g.at - g.start + 1 as bigint), 1), '\\s')"""


@query("fully_masked", f"""select i.n as items, i.n - c.n as masked, (i.n - c.n) / i.n as share
from (select count(*) as n from fx_gold) i, (select count(*) as n from ({clear('fx_pred')}) x) c""")
def fully_masked(t):
    return e.fully_masked(t("fx_gold"), t("fx_pred"))


@query("left_in_clear", f"select doc_id, entity_type, value from ({clear('fx_pred')}) x")
def left_in_clear(t):
    return e.left_in_clear(t("fx_gold"), t("fx_pred"))


@query("gold_counts", "select entity_type, count(*) as items from fx_gold group by entity_type")
def gold_counts(t):
    return e.gold_counts(t("fx_gold"))


_LAYERS = """with base as (select * from fx_pred where doc_id % 2 = 0), full_ as (select * from fx_pred),
r1 as ({c1}), r2 as ({c2}), l1 as (select entity_type, count(*) as n from ({x1}) x group by entity_type),
l2 as (select entity_type, count(*) as n from ({x2}) x group by entity_type)
select r2.entity_type, r1.found / r1.gold as recall_base, r2.found / r2.gold as recall_full, coalesce(l1.n, 0) as left_base, coalesce(l2.n, 0) as left_full
from r2 join r1 on r1.entity_type = r2.entity_type left join l1 on l1.entity_type = r2.entity_type left join l2 on l2.entity_type = r2.entity_type
where r2.gold > 0""".format(c1=counts("base"), c2=counts("full_"), x1=clear("base"), x2=clear("full_"))


@query("compare_layers", _LAYERS)
def compare_layers(t):
    pred = t("fx_pred")
    layered = pred.withColumn("layer", F.lit("full")).unionByName(pred.where("doc_id % 2 = 0").withColumn("layer", F.lit("base")))
    return e.compare_layers(t("fx_gold"), layered, ["base", "full"])


def _layer(name: str, pred: str) -> str:
    return f"""select '{name}' as layer, sum(correct) / sum(predicted) as precision, sum(found) / sum(gold) as recall,
1 - (select count(*) from ({clear(pred)}) x) / (select count(*) from fx_gold) as fully_masked, (select count(*) from ({clear(pred)}) x) as left_in_clear from ({counts(pred)}) c"""


@query("layer_scores", f"""with base as (select * from fx_pred where doc_id % 2 = 0), full_ as (select * from fx_pred) {_layer('base', 'base')} union all {_layer('full', 'full_')}""")
def layer_scores(t):
    pred = t("fx_pred")
    layered = pred.withColumn("layer", F.lit("full")).unionByName(pred.where("doc_id % 2 = 0").withColumn("layer", F.lit("base")))
    return e.layer_scores(t("fx_gold"), layered, ["base", "full"])


_CORPUS = "case when doc_id % 4 = 0 then 'held_out' else 'tuned' end as corpus"


@query("compare_corpora", f"""select entity_type, max(case when corpus = 'tuned' then recall end) as recall_tuned,
  max(case when corpus = 'held_out' then recall end) as recall_held_out,
  max(case when corpus = 'held_out' then recall end) - max(case when corpus = 'tuned' then recall end) as recall_delta
from (select *, found / nullif(gold, 0) as recall from ({counts('(select *, ' + _CORPUS + ' from fx_pred)', '(select *, ' + _CORPUS + ' from fx_gold)', 'corpus, entity_type')}) c) r
group by entity_type""")
def compare_corpora(t):
    split = F.when(F.col("doc_id") % 4 == 0, "held_out").otherwise("tuned")
    return e.compare_corpora(t("fx_gold").withColumn("corpus", split), t("fx_pred").withColumn("corpus", split))


_DURATIONS = "select event_type as variant, value as ms from events"


def quantile(p: float) -> str:
    at = f"greatest(least(cast(floor({p} * (n + 1)) as bigint), n - 1), 1)"
    return f"l[{at}] + (l[{at} + 1] - l[{at}]) * ({p} * (n + 1) - {at})"


_QUANTILES = f"select variant, {quantile(0.5)} as p50, {quantile(0.95)} as p95 from (select variant, list_sort(list(ms)) as l, count(*) as n from ({_DURATIONS}) d group by variant) q"


@query("latency_percentiles", _QUANTILES)
def latency_percentiles(t):
    return e.latency_percentiles(t.sql(_DURATIONS))


@query("latency_added", f"""select a.p50 as p50_without, a.p95 as p95_without, b.p50 as p50_masked, b.p95 as p95_masked, b.p50 - a.p50 as p50_added, b.p95 - a.p95 as p95_added
from ({_QUANTILES}) a, ({_QUANTILES}) b where a.variant = 'click' and b.variant = 'view'""")
def latency_added(t):
    return e.latency_added(t.sql(_DURATIONS), "click", "view")


_REPORT = f"""with base as (select * from fx_pred where doc_id % 2 = 0), full_ as (select * from fx_pred), c as ({counts()}), o as (
  select sum(gold) as gold, sum(found) as found, sum(predicted) as predicted, sum(correct) as correct from c), layers as ({_layer('base', 'base')} union all {_layer('full', 'full_')}), q as ({_QUANTILES})
select 'scores' as section, 'precision' as key, cast(correct / predicted as double) as value from o union all select 'scores', 'recall', cast(found / gold as double) from o
union all select 'per_type', entity_type, cast(found / nullif(gold, 0) as double) from c
union all select 'latency', variant, cast(p95 as double) from q
union all select 'left_in_clear', entity_type, cast(count(*) as double) from ({clear('fx_pred')}) x group by entity_type
union all select 'layers', layer, cast(fully_masked as double) from layers"""


@query("report_tables", f"select section, key, round(value, 9) as value from ({_REPORT}) r")
def report_tables(t):
    """All sections of a report, written as tables and read back, a figure of each row."""
    pred = t("fx_pred")
    layered = pred.withColumn("layer", F.lit("full")).unionByName(pred.where("doc_id % 2 = 0").withColumn("layer", F.lit("base")))
    folder = f"{shared_folder(t.spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    sections = e.report_sections(t("fx_gold"), layered, t.sql(_DURATIONS), ["base", "full"])
    files.write_metrics(sections, folder)
    read = {name: t.spark.read.parquet(f"{folder}/{name}") for name in sections}
    row = lambda name, key, value: read[name].select(F.lit(name).alias("section"), key.alias("key"), F.round(value.cast("double"), 9).alias("value"))
    in_clear = read["left_in_clear"].groupBy("entity_type").agg(F.count("*").alias("n"))
    rows = [row("scores", F.lit(c), F.col(c)) for c in ("precision", "recall")]
    rows += [row("per_type", F.col("entity_type"), F.col("recall")), row("latency", F.col("variant"), F.col("p95")), row("layers", F.col("layer"), F.col("fully_masked"))]
    rows.append(in_clear.select(F.lit("left_in_clear").alias("section"), F.col("entity_type").alias("key"), F.col("n").cast("double").alias("value")))
    return reduce(lambda a, b: a.unionByName(b), rows)


_ANSWERS = """select doc_id as answer_id, case when doc_id % 7 = 2 then 500 else 200 end as status, case when doc_id % 7 = 3 then 'length' else 'stop' end as done_reason,
case doc_id % 7 when 0 then '{"entities": [{"type": "PERSON", "te' when 1 then '{"items": []}' when 6 then '{"entities": []}' else
  '{"entities": [{"type": "PERSON", "text": " ' || value || ' "}, {"type": "HOBBY", "text": "chess"}, "noise", {"type": "IP_ADDRESS", "text": "  "}, {"text": "no type"}]}' end as content
from fx_gold where entity_type = 'PERSON'"""


@query("parse_model_entities", """select doc_id as answer_id, case when doc_id % 7 = 2 then 500 else 200 end as status, case when doc_id % 7 = 3 then 'length' else 'stop' end as done_reason,
doc_id % 7 < 4 as invalid, case when doc_id % 7 in (4, 5) then 'PERSON' end as entity_type, case when doc_id % 7 in (4, 5) then value end as value from fx_gold where entity_type = 'PERSON'""")
def parse_model_entities(t):
    return e.parse_model_entities(t.sql(_ANSWERS), fixed.MASKED_ENTITIES)


_QUALITY = "select alias as model, status <> 200 as invalid, tokens_out % 3 as not_in_text, tokens_in, tokens_out from fx_calls"


@query("answer_quality", f"""select model, count(*) as texts, count(*) filter (where invalid) as unusable, cast(sum(not_in_text) as bigint) as not_in_text,
avg(tokens_in + tokens_out) as tokens_per_text from ({_QUALITY}) q group by model""")
def answer_quality(t):
    return e.answer_quality(t.sql(_QUALITY))


_COST = "select end_user || alias as model, case when end_user = 'app' then alias end as alias, tokens_in, tokens_out from fx_calls"


@query("cost_per_1000", f"""select q.model, count(*) as texts, cast(sum(tokens_in * price_in + tokens_out * price_out) * 1000 / count(*) as double) as cost_per_1000
from ({_COST}) q left join fx_aliases a on a.alias = q.alias group by q.model""")
def cost_per_1000(t):
    return e.cost_per_1000(t.sql(_COST), t("fx_aliases"))


# --- Leak audit ----------------------------------------------------------------------------------------------------

WORDS = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+')"
_PUBLIC = " || ' ' || ".join(f"p{i}" for i in range(9)) + " || ' .'"
_PRIVATE = f"""select distinct k as doc_id, word from (select k, unnest(list_concat({', '.join(WORDS.format(f'v{i}') for i in range(9))})) as word,
  {WORDS.format(_PUBLIC)} as public from fx_parts) w where not list_contains(public, word)"""
# What was sent: one text in three as it is, the others without the person.
_SENT = "select l.doc_id, case when l.doc_id % 3 = 0 then l.text else replace(l.text, g.value, '<PERSON_1>') end as body from fx_letters l join fx_gold g on g.doc_id = l.doc_id and g.entity_type = 'PERSON'"
_LEAKED = f"""select p.doc_id, p.word from ({_PRIVATE}) p join ({_SENT}) s on s.doc_id = p.doc_id where list_contains({WORDS.format('s.body')}, p.word)"""


def annotated(t):
    return annotate(t("fx_letters"), t("fx_gold")).select("doc_id", "text", "entities")


@query("private_words", _PRIVATE)
def private_words(t):
    return l.private_words(annotated(t))


@query("leaked_words", _LEAKED)
def leaked_words(t):
    return l.leaked_words(annotated(t), t.sql(_SENT))


_RECORDS = """select 'traces' as place, doc_id as record_id, text from fx_letters
union all select 'logs', conv_id * 1000 + turn, text || ' 06 10 04 86 11 luc.robin@example.org 87000 Limo' from conversations"""


@query("leaked_values", f"""with records as ({_RECORDS}),
words as (select distinct place, unnest({WORDS.format('text')}) as leak from records),
vals as (select distinct value as leak from fx_gold),
held as (select distinct r.place, v.leak from vals v join records r on contains(r.text, v.leak))
select distinct place, doc_id, leak from (
  select w.place, p.doc_id, w.leak from words w join ({_PRIVATE}) p on p.word = w.leak where regexp_full_match(w.leak, '\\p{{L}}{{4,}}|[0-9]{{5,}}')
  union all select h.place, g.doc_id, h.leak from held h join fx_gold g on g.value = h.leak) u""")
def leaked_values(t):
    return l.leaked_values(annotated(t), t.sql(_RECORDS))


_KNOWN = "select doc_id, word from ({}) k where doc_id % 2 = 0 union all select doc_id, 'gone' from fx_letters where doc_id % 100 = 0"


@query("leaks_vs_known", f"""select doc_id, word, 'new' as change from ({_LEAKED}) a where doc_id % 2 <> 0
union all select doc_id, 'gone', 'fixed' from fx_letters where doc_id % 100 = 0""")
def leaks_vs_known(t):
    leaks = l.leaked_words(annotated(t), t.sql(_SENT))
    known = leaks.where("doc_id % 2 = 0").unionByName(t.sql("select doc_id, 'gone' as word from fx_letters where doc_id % 100 = 0"))
    return l.leaks_vs_known(leaks, known)


@query("exposure_baseline", f"select count(*) as words, count(distinct doc_id) as texts from ({_PRIVATE}) p")
def exposure_baseline(t):
    return l.exposure_baseline(annotated(t))


@query("request_log_complete", """with a as (select event_id as seq, row_number() over (order by event_id) as position from events where event_id % 10 <> 0),
b as (select event_id as doc_id, row_number() over (order by event_id) as position from events)
select coalesce(a.position, b.position) as position, a.seq, b.doc_id from a full outer join b on a.position = b.position where a.seq is null or b.doc_id is null""")
def request_log_complete(t):
    log = t.sql("select event_id as seq from events where event_id % 10 <> 0")
    return l.request_log_complete(log, t.sql("select event_id as doc_id from events"))
