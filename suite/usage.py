"""Queries of the usage, price and limit families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from maskline import fixed_values as fixed
from maskline.operators import limits as lim
from maskline.operators import usage as u
from suite.registry import query

_COST = "cast(c.tokens_in * cast(coalesce(a.price_in, 0) as decimal(18,10)) + c.tokens_out * cast(coalesce(a.price_out, 0) as decimal(18,10)) as decimal(30,10))"


@query("price_calls", f"select c.call_id, c.alias, case when a.alias is not null then {_COST} end as cost from fx_calls c left join (select * from fx_aliases where alias <> 'signup') a on a.alias = c.alias")
def price_calls(t):
    return u.price_calls(t("fx_calls"), t("fx_aliases").where("alias <> 'signup'")).select("call_id", "alias", "cost")


@query("price_per_query", f"select c.call_id, case when a.price_query is not null then cast(a.price_query as decimal(30,10)) else {_COST} end as cost from fx_calls c join fx_aliases a on a.alias = c.alias")
def price_per_query(t):
    return u.price_per_query(t("fx_calls"), t("fx_aliases")).select("call_id", "cost")


@query("resolve_alias", """select t.call_id, t.team, t.traced_model, a.alias from fx_traced t left join fx_aliases a
on regexp_full_match(lower(t.traced_model), lower(a.alias) || '|(' || split_part(a.model, '/', 1) || '/)?' || split_part(a.model, '/', 2))""")
def resolve_alias(t):
    return u.resolve_alias(t("fx_traced"), t("fx_aliases"))


_SERVED = "select distinct event_type || cast(user_id % 3 as string) as alias, 'p/' || case when user_id % 3 = 0 then 'shared:1b' else event_type || cast(user_id % 3 as string) end as model from events"


@query("ambiguous_models", f"""select split_part(model, '/', 2) as model, count(*) as n, string_agg(alias, ',' order by alias) as aliases from ({_SERVED}) s group by split_part(model, '/', 2) having count(*) > 1""")
def ambiguous_models(t):
    return u.ambiguous_models(t.sql(_SERVED))


@query("price_as_of", """select c.call_id, cast(h.price_in as double) as price_in, cast(h.price_out as double) as price_out from fx_calls c asof left join fx_history h on h.alias = c.alias and c.ts >= h.valid_from""")
def price_as_of(t):
    priced = u.price_as_of(t("fx_calls"), t("fx_history"))
    return priced.select("call_id", F.col("price_in").cast("double").alias("price_in"), F.col("price_out").cast("double").alias("price_out"))


def periods(key: str, days: int) -> str:
    return f"""select p.*, cast(floor((epoch_us(p.ts) - epoch_us(f.first)) / ({days} * 86400000000.0)) as int) as period from fx_priced p
join (select {key}, min(ts) as first from fx_priced group by {key}) f on f.{key} = p.{key}"""


@query("spend_by_team", f"select team, period, count(*) as calls, sum(cost) as spend from ({periods('team', 7)}) p group by team, period")
def spend_by_team(t):
    return u.spend_by_team(t("fx_priced"), 7)


@query("usage_daily", """select team, cast(day as string) as day, alias, count(*) as calls, cast(sum(tokens_in + tokens_out) as bigint) as tokens, sum(cost) as cost, cast(sum(cast(latency as decimal(20,6))) as double) / count(latency) as latency,
count(*) filter (where status >= 400) as errors from (select *, cast(ts as date) as day from fx_priced where team is not null) p group by rollup (team, day, alias)""")
def usage_daily(t):
    return u.usage_daily(t("fx_priced")).withColumn("day", F.col("day").cast("string"))


def spent(key: str, days: int, where: str = "true") -> str:
    return f"""select *, coalesce(sum(cost) over (partition by {key}, period order by ts, call_id rows between unbounded preceding and 1 preceding), 0) as spent
from ({periods(key, days)}) p where {where}"""


# Support has no budget and Manuals no limit of requests; Billing has no row at all.
_PARTIAL = """(select team_id, case when team_id = 's' then null else max_budget end as max_budget, case when team_id = 'm' then null else rpm_limit end as rpm_limit,
tpm_limit from fx_teams where team_id <> 'b')"""


@query("budget_decisions", f"""select s.call_id, s.team, s.period, case when s.spent >= t.max_budget then 422 else 200 end as decision from ({spent('team', 7)}) s left join {_PARTIAL} t on t.team_id = s.team
union all select call_id, team, null, 200 from fx_priced where team is null""")
def budget_decisions(t):
    return lim.budget_decisions(t("fx_priced"), t.sql(f"select * from {_PARTIAL} p"), 7)


@query("provider_cap", f"select s.call_id, s.provider, case when s.spent >= c.cap then 'refused' else 'accepted' end as decision from ({spent('provider', 30)}) s join fx_caps c on c.provider = s.provider")
def provider_cap(t):
    return lim.provider_cap(t("fx_priced"), t("fx_caps"))


@query("provider_remaining", f"select s.call_id, s.provider, cast(greatest(c.cap - s.spent - s.cost, 0) as double) as remaining from ({spent('provider', 30)}) s join fx_caps c on c.provider = s.provider")
def provider_remaining(t):
    return lim.provider_remaining(t("fx_priced"), t("fx_caps")).withColumn("remaining", F.col("remaining").cast("double"))


_RATE = """select c.call_id, c.team, c.minute, row_number() over w - 1 as requests, coalesce(sum(c.tokens_in + c.tokens_out) over (w rows between unbounded preceding and 1 preceding), 0) as tokens, t.rpm_limit, t.tpm_limit
from (select *, date_trunc('minute', ts) as minute from fx_calls) c left join """ + _PARTIAL + """ t on t.team_id = c.team window w as (partition by c.team, c.minute order by c.ts, c.call_id)"""


@query("rate_decisions", f"""select call_id, team, case when requests >= rpm_limit or tokens >= tpm_limit then 429 else 200 end as decision,
case when requests >= rpm_limit or tokens >= tpm_limit then cast(epoch_us(minute) / 1000000 as bigint) + 60 end as reset_at from ({_RATE}) r""")
def rate_decisions(t):
    decided = lim.rate_decisions(t("fx_calls"), t.sql(f"select * from {_PARTIAL} p"))
    return decided.withColumn("reset_at", F.unix_seconds(F.col("reset_at").cast("timestamp")))


@query("access_decisions", """select c.call_id, c.team, c.alias, case when x.alias is null then 403 else 200 end as decision from fx_calls c left join fx_access x on x.team_id = c.team and x.alias = c.alias""")
def access_decisions(t):
    return lim.access_decisions(t("fx_calls"), t("fx_access")).select("call_id", "team", "alias", "decision")


_ALLOWED = """select c.*, row_number() over (order by c.ts, c.call_id) as r, x.alias is not null as allowed, date_trunc('minute', c.ts) as minute
from fx_priced c left join fx_access x on x.team_id = c.team and x.alias = c.alias"""
_WITHIN = """select a.*, t.max_budget,
  row_number() over w - 1 < t.rpm_limit and coalesce(sum(a.tokens_in + a.tokens_out) over (w rows between unbounded preceding and 1 preceding), 0) < t.tpm_limit as within
from allowed a join fx_teams t on t.team_id = a.team where a.allowed window w as (partition by a.team, a.minute order by a.r)"""
_AGE = "cast(floor((epoch_us(w.ts) - epoch_us({f}.first)) / (30 * 86400000000.0)) as int)"


def _stops(key: str, period: str, limit: str, other: str, other_period: str, closed: str | None) -> str:
    """First call of each key and period that finds its limit spent, without the calls that the other side refuses."""
    join = f"left join {closed} s on s.key = c.{other} and s.period = c.{other_period}" if closed else ""
    cost = "case when s.at is null or c.r < s.at then c.cost else 0 end" if closed else "c.cost"
    return f"""select key, period, min(r) as at from (select c.{key} as key, c.{period} as period, c.r, c.{limit} as most,
  coalesce(sum({cost}) over (partition by c.{key}, c.{period} order by c.r rows between unbounded preceding and 1 preceding), 0) as spent from cand c {join}) x
where spent >= most group by key, period"""


# Eight rounds are more than the stops of these tables need; tests/ compare with a call-by-call fold besides.
_ROUNDS = ",\n".join(
    f"t{i} as ({_stops('team', 'tp', 'max_budget', 'provider', 'pp', f'p{i - 1}' if i else None)}),\n"
    f"p{i} as ({_stops('provider', 'pp', 'cap', 'team', 'tp', f't{i}')})"
    for i in range(8)
)


ADMISSION = f"""with allowed as ({_ALLOWED}), within_ as ({_WITHIN}),
cand as (select w.call_id, w.r, w.team, w.provider, w.cost, w.max_budget, c.cap, {_AGE.format(f='tf')} as tp, {_AGE.format(f='pf')} as pp from within_ w
  join (select team, min(ts) as first from fx_priced group by team) tf on tf.team = w.team join (select provider, min(ts) as first from fx_priced group by provider) pf on pf.provider = w.provider
  left join fx_caps c on c.provider = w.provider where w.within),
{_ROUNDS}
select call_id, 403 as decision, 'access' as reason from allowed where not allowed
union all select call_id, 429, 'rate' from within_ where not within
union all select c.call_id, case when c.r >= t.at then 422 when c.r >= p.at then 429 else 200 end,
  case when c.r >= t.at then 'budget' when c.r >= p.at then 'provider cap' else 'accepted' end
from cand c left join t7 t on t.key = c.team and t.period = c.tp left join p7 p on p.key = c.provider and p.period = c.pp"""


@query("admission", ADMISSION)
def admission(t):
    return lim.admission(t("fx_priced"), t("fx_teams"), t("fx_access"), t("fx_caps"))


@query("route_to_project", "select c.call_id, c.team, coalesce(r.project, 'shared') as project from fx_calls c left join fx_routes r on r.team = c.team")
def route_to_project(t):
    return u.route_to_project(t("fx_calls"), t("fx_routes")).select("call_id", "team", "project")


_ROUTED = """select c.call_id, c.team, case when c.call_id % 100 = 7 then 'forecast' else coalesce(r.project, 'shared') end as project from fx_calls c left join fx_routes r on r.team = c.team
union all select call_id, team, 'billing' from fx_calls where call_id % 250 = 0"""


@query("project_isolation", f"""select s.call_id, coalesce(r.project, 'shared') as project, s.seen from (select call_id, team, string_agg(distinct project, ',' order by project) as seen from ({_ROUTED}) x group by call_id, team) s
left join fx_routes r on r.team = s.team where s.seen <> coalesce(r.project, 'shared')""")
def project_isolation(t):
    return u.project_isolation(t.sql(_ROUTED), t("fx_routes"))


@query("lead_visibility", """select m.account, c.call_id from fx_calls c join fx_members m on m.team = c.team or m.team = '*'""")
def lead_visibility(t):
    """What each account sees: a filter per account."""
    accounts = [r["account"] for r in t("fx_members").select("account").distinct().orderBy("account").collect()]
    seen = [u.lead_visibility(t("fx_calls"), t("fx_members"), a).select(F.lit(a).alias("account"), "call_id") for a in accounts]
    return reduce(lambda x, y: x.unionByName(y), seen)


_CHARGED = "select team, cast(cost + case when call_id % 1000 = 5 and team = 'm' then 0.0000000001 else 0 end as decimal(30,10)) as cost from fx_priced"


@query("cost_reconciliation", f"""select a.team, cast(a.traced as decimal(37,10)) as traced, cast(b.charged as decimal(37,10)) as charged, a.traced - b.charged as gap from (select team, sum(cost) as traced from fx_priced group by team) a
join (select team, sum(cost) as charged from ({_CHARGED}) c group by team) b on a.team is not distinct from b.team where a.traced <> b.charged""")
def cost_reconciliation(t):
    return u.cost_reconciliation(t("fx_priced"), t.sql(_CHARGED))


@query("spend_by_end_user", """select team, sum(cost) filter (where end_user = 'worker') as jobs_spend, sum(cost) filter (where end_user <> 'worker') as own_spend,
count(*) filter (where end_user = 'worker') as jobs_calls from fx_priced where team is not null group by team""")
def spend_by_end_user(t):
    return u.spend_by_end_user(t("fx_priced"), fixed.JOB_END_USER)


@query("error_calls", "select team, alias, count(*) as calls, count(*) filter (where status >= 400) as errors, avg(case when status >= 400 then 1.0 else 0.0 end) as error_rate from fx_calls group by team, alias")
def error_calls(t):
    return u.error_calls(t("fx_calls"))


@query("fallback_rate", """select alias, count(*) as calls, count(*) filter (where served_alias <> alias) as fallbacks, avg(case when served_alias <> alias then 1.0 else 0.0 end) as fallback_rate,
cast(sum(cast(latency as decimal(20,6))) filter (where served_alias <> alias) as double) / count(*) filter (where served_alias <> alias) - cast(sum(cast(latency as decimal(20,6))) filter (where served_alias = alias) as double) / count(*) filter (where served_alias = alias) as added_latency from fx_served group by alias""")
def fallback_rate(t):
    return u.fallback_rate(t("fx_served"))


_TRACE = "cast(floor(call_id / 4) as bigint)"


@query("trace_summary", f"""select m.trace_id, m.team, m.tokens_in, m.latency, g.masked from (select {_TRACE} as trace_id, max(case when call_id % 4 = 0 then team end) as team,
  max(case when call_id % 4 = 0 then tokens_in end) as tokens_in, max(case when call_id % 4 = 0 then latency end) as latency from fx_calls group by {_TRACE}) m
left join (select trace_id, string_agg(k || '=' || cast(n as string), ' ' order by k) as masked from (select {_TRACE} as trace_id, k, sum(n) as n from (
  select call_id, 'PERSON' as k, cast(call_id % 3 as bigint) as n from fx_calls where call_id % 4 > 0 union all select call_id, case when call_id % 2 = 0 then 'IBAN_CODE' else 'LOCATION' end, 1 from fx_calls where call_id % 4 > 0) c
  group by {_TRACE}, k) s group by trace_id) g on g.trace_id = m.trace_id""")
def trace_summary(t):
    kind = F.when(F.col("call_id") % 2 == 0, "IBAN_CODE").otherwise("LOCATION")
    observed = t("fx_calls").select(
        F.floor(F.col("call_id") / 4).alias("trace_id"), F.when(F.col("call_id") % 4 == 0, "GENERATION").otherwise("GUARDRAIL").alias("type"),
        "team", "tokens_in", "tokens_out", F.lit(0).cast("decimal(30,10)").alias("cost"), "latency",
        F.create_map(F.lit("PERSON"), (F.col("call_id") % 3).cast("bigint"), kind, F.lit(1).cast("bigint")).alias("masked"),
    )
    told = F.array_join(F.transform(F.map_entries("masked"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
    return u.trace_summary(observed).select("trace_id", "team", "tokens_in", "latency", told.alias("masked"))


@query("valid_json_answers", """select answer_id, event_id_mod < 2 as valid, case event_id_mod when 2 then 'field season' when 3 then 'size of variants' when 4 then 'not json' when 5 then 'field query' when 6 then 'field query' when 7 then 'not json' end as reason
from (select answer_id, answer_id % 8 as event_id_mod from fx_json) j""")
def valid_json_answers(t):
    found = u.valid_json_answers(t("fx_json"), {"query": "string", "season": "int?", "variants": "array"}, {"variants": 2})
    return found.select("answer_id", "valid", "reason")


@query("tool_call_check", """select answer_id, reason, reason is null as valid from (select answer_id, case when answer_id % 9 = 0 then 'unknown tool' when answer_id % 5 = 3 then 'not json'
  when answer_id % 5 = 2 then 'missing season' when answer_id % 5 = 1 then 'wrong type' end as reason from fx_tool_calls) r""")
def tool_call_check(t):
    tools = t.sql("select 'get_race' as tool, map('season', 'integer', 'name', 'string') as parameters, array('season', 'name') as required")
    return u.tool_call_check(t("fx_tool_calls"), tools).select("answer_id", "reason", "valid")


@query("parameter_check", """select event_id as request_id, event_type as alias, case when event_id % 4 = 0 then case when event_type = 'signup' then 'dropped' else 'refused' end when event_id % 4 = 1 then 'refused' else 'passed' end as decision,
case event_id % 4 when 0 then 'user' when 1 then 'logprobs' else '' end as unknown from events""")
def parameter_check(t):
    requests = t("events").select(
        F.col("event_id").alias("request_id"), F.col("event_type").alias("alias"),
        F.expr("concat(array('messages', 'max_tokens'), CASE event_id % 4 WHEN 0 THEN array('user') WHEN 1 THEN array('logprobs') ELSE array() END)").alias("keys"),
    )
    parameters = t("fx_aliases").select(
        "alias", F.expr("array('messages', 'max_tokens', 'temperature')").alias("allowed"),
        F.expr("IF(alias = 'signup', array('user', 'encoding_format'), array())").alias("dropped"),
    )
    return u.parameter_check(requests, parameters)




@query("embedding_dims", "select vec_id, 63 as dims from embeddings where vec_id % 10 = 0")
def embedding_dims(t):
    vectors = t("embeddings").withColumn("embedding", F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    return u.embedding_dims(vectors, 64)
