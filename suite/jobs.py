"""Queries of the reconciliation, job and retrieval families."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskline.operators import jobs as j
from maskline.operators import retrieve as r
from maskline.operators import state as s
from suite.registry import VECTORS_A_TASK, parts_of, query

FIELDS = ["name", "nation", "balance"]
_DIFFERS = "d.name is distinct from a.name or d.nation is distinct from a.nation or d.balance is distinct from a.balance"
_PAIRS = "fx_declared d left join fx_actual a on a.id = d.id"


@query("reconcile_teams", f"select d.id, case when a.id is null then 'created' else 'updated' end as action from {_PAIRS}")
def reconcile_teams(t):
    return s.reconcile_teams(t("fx_declared"), t("fx_actual"), FIELDS, "id")


_SALT = "pepper"


@query("reconcile_keys", f"""select k.team_id, k.key_hash, k.display, case when k.value not like 'sk-%' then 'refused' when k.n % 3 = 0 then 'updated' else 'created' end as action
from (select team_id, value, sha256(value || sha256('{_SALT}')) as key_hash, substr(value, 1, 6) || '...' || right(value, 4) as display,
  cast(substr(team_id, 5) as int) as n from fx_keys) k""")
def reconcile_keys(t):
    actual = t("fx_keys").where("cast(substr(team_id, 5) as int) % 3 = 0").select(s.salted_key_hash(F.col("value"), _SALT).alias("key_hash"))
    return s.reconcile_keys(t("fx_keys"), actual, _SALT)


@query("conditional_upsert", f"select d.id, case when a.id is null then 'created' when {_DIFFERS} then 'updated' else 'unchanged' end as action from {_PAIRS}")
def conditional_upsert(t):
    return s.conditional_upsert(t("fx_declared"), t("fx_actual"), ["id"], FIELDS)


_PRICES = "select cast(nation as string) as project, name as alias, name || '|x' as pattern, cast(id as decimal(18,6)) as price_in, cast(1 as decimal(18,6)) as price_out, id from fx_declared"
_HELD = "select cast(nation as string) as project, name as alias, case when id % 5 = 0 then 'old' else name || '|x' end as pattern, cast(case when id % 3 = 0 then id + 1 else id end as decimal(18,6)) as price_in, cast(1 as decimal(18,6)) as price_out, id % 8 = 0 as managed from fx_declared where id % 7 <> 0"


@query("reconcile_prices", f"""select project, alias, case when id % 7 = 0 or id % 8 = 0 then 'created' when id % 5 = 0 or id % 3 = 0 then 'replaced' else 'skipped' end as action from ({_PRICES}) p""")
def reconcile_prices(t):
    return s.reconcile_prices(t.sql(_PRICES).drop("id"), t.sql(_HELD))


@query("reconcile_memberships", """select nation as org, name as account, 'VIEWER' as role, case when id % 9 = 0 then 'created' else 'updated' end as action,
id % 9 <> 0 and id % 4 = 0 as was_reset from fx_declared""")
def reconcile_memberships(t):
    declared = t("fx_declared").select(F.col("nation").alias("org"), F.col("name").alias("account"), F.lit("VIEWER").alias("role"), "id")
    held = declared.where("id % 9 <> 0").withColumn("role", F.when(F.col("id") % 4 == 0, "OWNER").otherwise("VIEWER"))
    return s.reconcile_memberships(declared.drop("id"), held)


@query("config_agreement", f"select d.id, case when a.id is null then 'missing' else 'different' end as problem from {_PAIRS} where a.id is null or ({_DIFFERS})")
def config_agreement(t):
    return s.config_agreement(t("fx_declared"), t("fx_actual"), FIELDS, "id")


@query("declared_checks", """select id, concat_ws(',', case when id % 6 = 0 then 'balance' end, case when nation > 20 then 'nation' end, case when id % 10 = 3 then 'key prefix' end) as reasons
from fx_declared where id % 6 = 0 or nation > 20 or id % 10 = 3""")
def declared_checks(t):
    rows = t("fx_declared").withColumn("key", F.when(F.col("id") % 10 == 3, "pk-x").otherwise("sk-x"))
    rules = {"balance": F.col("balance").isNotNull(), "nation": F.col("nation") <= 20, "key prefix": F.startswith("key", F.lit("sk-"))}
    return s.declared_checks(rows, rules).select("id", "reasons")


@query("second_run_is_noop", "select id, cast(null as string) as action from fx_declared where false")
def second_run_is_noop(t):
    return s.second_run_is_noop(t("fx_declared"), t("fx_actual"), ["id"], FIELDS)


_LOST = f"select d.id, 'updated' as action from {_PAIRS} where a.id is not null and d.nation > 12 and ({_DIFFERS})"


@query("second_run_tells", f"select id, 'created' as action from fx_declared where id not in (select id from fx_actual) and id % 2 = 0 union all {_LOST}")
def second_run_tells(t):
    """A first run that lost some updates, and creates every second row as an update: the second run shows them all."""
    actions = s.conditional_upsert(t("fx_declared"), t("fx_actual"), ["id"], FIELDS).join(t("fx_declared").select("id", "nation"), "id")
    lost = (F.col("action") == "updated") & (F.col("nation") > 12)
    wrong = F.when((F.col("action") == "created") & (F.col("id") % 2 == 0), "updated").otherwise(F.col("action"))
    broken = actions.where(~lost).withColumn("action", wrong).drop("nation")
    return s.second_run_is_noop(t("fx_declared"), t("fx_actual"), ["id"], FIELDS, broken)


@query("apply_actions", "select id, name, nation, balance from fx_declared union all select a.id, a.name, a.nation, a.balance from fx_actual a left join fx_declared d on d.id = a.id where d.id is null")
def apply_actions(t):
    actions = s.conditional_upsert(t("fx_declared"), t("fx_actual"), ["id"], FIELDS)
    return s.apply_actions(t("fx_declared"), t("fx_actual"), actions, ["id"], FIELDS).select("id", *FIELDS)


@query("new_state", "select id, name, nation, balance from fx_declared union all select a.id, a.name, a.nation, a.balance from fx_actual a left join fx_declared d on d.id = a.id where d.id is null")
def new_state(t):
    return s.new_state(t("fx_declared"), t("fx_actual"), ["id"])


# --- Jobs -----------------------------------------------------------------------------------------------------------


@query("parse_jobs", """select message_id, case message_id % 12 when 0 then 'j' || cast(message_id as string) when 1 then '7' else '' end as id,
case message_id % 12 when 0 then 'f' when 1 then 'm' else 'x' end as team, case message_id % 12 when 0 then substr(reply_to, 7) else 'a' end as alias,
case message_id % 12 when 0 then 512 when 1 then 64 else 4096 end as max_tokens, 'Hi' as content from fx_job_messages where message_id % 12 in (0, 1, 10)""")
def parse_jobs(t):
    jobs = j.parse_jobs(t("fx_job_messages"))
    return jobs.select("message_id", "id", "team", "alias", "max_tokens", F.get("messages", F.lit(0))["content"].alias("content"))


@query("invalid_jobs", """select message_id, case message_id % 12 when 2 then 'not JSON' when 3 then 'not an object' when 4 then 'no team' when 5 then 'no alias' when 6 then 'no messages'
when 7 then 'bad max_tokens' when 8 then 'bad max_tokens' when 9 then 'no team' else 'no messages' end as reason from fx_job_messages where message_id % 12 not in (0, 1, 10)""")
def invalid_jobs(t):
    return j.invalid_jobs(t("fx_job_messages"))


@query("jobs_without_key", "select message_id, 'x' as team, 'no key for team x' as reason from fx_job_messages where message_id % 12 = 10")
def jobs_without_key(t):
    keys = t.sql("select distinct 'TEAM_KEY_' || upper(team_id) as variable from fx_teams")
    return j.jobs_without_key(j.parse_jobs(t("fx_job_messages")), keys).select("message_id", "team", "reason")


OUTCOME = "case when status between 200 and 299 then 'done' when status = 429 then 'backoff' when status < 500 and status <> 408 then 'dead' else 'retry' end"


@query("classify_outcome", f"select attempt_id, status, {OUTCOME} as outcome from fx_attempts")
def classify_outcome(t):
    return j.classify_outcome(t("fx_attempts")).select("attempt_id", "status", "outcome")


@query("backoff_seconds", """select attempt_id, cast(least(greatest(coalesce(epoch_us(try_strptime(reset_at, '%Y-%m-%d %H:%M:%S UTC')) / 1e6 - epoch_us(ts) / 1e6,
case when retry_after is null then 10.0 else coalesce(try_cast(retry_after as double), 10.0) end), 1.0), 60.0) * 1000 as bigint) as wait_ms from fx_attempts where status = 429""")
def backoff_seconds(t):
    waits = j.backoff_seconds(t("fx_attempts").where("status = 429"), jitter=0.0)
    return waits.select("attempt_id", F.round(F.col("wait") * 1000).cast("bigint").alias("wait_ms"))


_MARKED = f"""select *, max(cast(ends as int)) over (partition by job_id order by ts, attempt_id rows between unbounded preceding and 1 preceding) as over_ from (
  select *, outcome in ('done', 'dead') or (outcome = 'retry' and failures > 2) as ends from (
    select *, sum(case when outcome = 'retry' then 1 else 0 end) over (partition by job_id order by ts, attempt_id) as failures from (
      select *, {OUTCOME} as outcome from fx_attempts) c) f) e"""
MARKED = f"(select * from ({_MARKED}) m where coalesce(over_, 0) = 0) m"


@query("job_lifecycle", f"""select job_id, count(*) as attempts, count(*) filter (where outcome = 'retry') as failures, count(*) filter (where outcome = 'backoff') as backoffs,
case when not bool_or(ends) then 'pending' when bool_or(outcome = 'done') then 'done' else 'dead' end as state from {MARKED} group by job_id""")
def job_lifecycle(t):
    return j.job_lifecycle(t("fx_attempts"))


@query("redelivery_time", f"""select job_id, attempt_id, cast(least(5 * failures, 30) as int) as delay, cast(epoch_us(ts) + 1000000 * least(5 * failures, 30) as bigint) as next_us
from {MARKED} where outcome = 'retry' and not ends""")
def redelivery_time(t):
    timed = j.redelivery_time(t("fx_attempts"))
    return timed.select("job_id", "attempt_id", "delay", F.unix_micros(F.col("next_ts").cast("timestamp")).alias("next_us"))


@query("match_replies", """select m.message_id, m.reply_to, 'answer ' || cast(m.message_id as string) as content from fx_job_messages m where m.message_id % 3 = 0""")
def match_replies(t):
    replies = t.sql("select event_id as correlation_id, 'answer ' || cast(event_id as string) as content, ts as replied_ts from events where event_id % 3 = 0")
    return j.match_replies(t("fx_job_messages"), replies).drop("replied_ts")


@query("job_results", f"""select job_id, alias, 'done' as status from {MARKED} where outcome = 'done'""")
def job_results(t):
    results = j.job_results(t("fx_attempts"))
    read = lambda f: F.get_json_object("result", f"$.{f}").alias(f)
    return results.select("job_id", read("alias"), read("status"))


@query("dead_letters", f"""select job_id, case when bool_or(outcome = 'dead') then 'refused with ' || cast(max(case when outcome = 'dead' then status end) as string) else 'third failure' end as reason,
'jobs' as queue, count(*) as deliveries from {MARKED} group by job_id having bool_or(ends) and not bool_or(outcome = 'done')""")
def dead_letters(t):
    return j.dead_letters(t("fx_attempts"), "jobs")


@query("job_metrics", f"""select team, alias, count(distinct job_id) as jobs, count(*) as attempts, count(*) filter (where outcome = 'done') as done, count(*) filter (where outcome = 'retry') as retry,
count(*) filter (where outcome = 'backoff') as backoff, count(*) filter (where outcome = 'dead') as dead, list_sort(list(seconds))[cast(ceil(count(*) * 0.5) as int)] as p50,
list_sort(list(seconds))[cast(ceil(count(*) * 0.95) as int)] as p95 from (select *, {OUTCOME} as outcome from fx_attempts) a group by team, alias""")
def job_metrics(t):
    return j.job_metrics(t("fx_attempts"))


# --- Retrieval -------------------------------------------------------------------------------------------------------

# Every twentieth vector is a query; all others are its passages.
_CANDIDATES = """select q.vec_id as query_id, p.vec_id as passage_id, q.label = p.label as right_one, q.embedding as a, p.embedding as b
from (select * from embeddings where vec_id % 20 = 0) q join embeddings p on p.vec_id <> q.vec_id"""
_SCORED = f"select query_id, passage_id, right_one, round(list_cosine_similarity(a, b), 4) as score from ({_CANDIDATES}) c"


# Pairs that a task makes, about, and bytes of the vectors that are sent to all tasks, at most.
PAIRS_A_TASK, SENT = 2_000_000, 64 << 20


def paired(asked, others, tasks: int, width: int):
    """asked (q_vec_id, ...) by others (p_vec_id, ...; `width` bytes a row) but itself: over `tasks` tasks at least. Where the
    others are few enough to be sent to all tasks, a task has all pairs of its queries, so that nothing by query moves them."""
    n = others.count()
    cells = max(1, tasks, -(-asked.count() * n // PAIRS_A_TASK))
    if n * width <= SENT:
        return asked.repartition(cells, "q_vec_id").join(F.broadcast(others), F.col("p_vec_id") != F.col("q_vec_id"))
    # Each part of the queries meets each part of the others in a task: the driver holds a few numbers of all of these.
    parts = max(1, min(tasks, cells))
    asked, others = asked.repartition(-(-cells // parts), "q_vec_id"), others.repartition(parts, "p_vec_id")
    return asked.join(others, F.col("p_vec_id") != F.col("q_vec_id"))


def sides(vectors, *columns: str):
    """(queries, all vectors), the columns of each with its letter."""
    asked, others = (vectors.select(*[F.col(c).alias(f"{side}_{c}") for c in columns]) for side in "qp")
    return asked.where("q_vec_id % 20 = 0"), others


def scored(t):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, k: i.cast("double") * k.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    # A vector's own product is worked out once, not once per pair.
    vectors = t("embeddings").withColumn("own", dot("embedding", "embedding"))
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    pairs = paired(*sides(vectors, "vec_id", "label", "embedding", "own"), parts_of(vectors, rows=VECTORS_A_TASK), 64 + 8 * longest)
    cosine = dot("q_embedding", "p_embedding") / F.sqrt(F.col("q_own") * F.col("p_own"))
    return pairs.select(
        F.col("q_vec_id").alias("query_id"), F.col("p_vec_id").alias("passage_id"), (F.col("q_label") == F.col("p_label")).alias("right_one"),
        F.round(cosine, 4).alias("score"),
    )


# Ranks from an integer score, so that both engines order alike.
_RANKED = f"""select query_id, passage_id, score, row_number() over (partition by query_id order by score desc, passage_id) as rank from (
select query_id, passage_id, (passage_id * 7919 + query_id * 31) % 1009 as score from ({_CANDIDATES}) c) s"""


def candidates(t):
    vectors = t("embeddings")
    pairs = paired(*sides(vectors, "vec_id", "label"), parts_of(vectors, rows=VECTORS_A_TASK), 32)
    return pairs.selectExpr(
        "q_vec_id as query_id", "p_vec_id as passage_id", "(p_vec_id * 7919 + q_vec_id * 31) % 1009 as score", "q_label = p_label as right_one"
    )


@query("rerank", _RANKED)
def rerank(t):
    return r.rerank(candidates(t).drop("right_one"))


@query("rerank_top", f"select query_id, passage_id, score, cast(rank as int) as rank from ({_RANKED}) r where rank <= 5")
def rerank_top(t):
    """The first five, as a caller keeps them."""
    return r.rerank(candidates(t).drop("right_one"), 5)


@query("rerank_cosine", f"select query_id, count(*) as candidates, max(score) as best from ({_SCORED.replace('list_cosine_similarity(a, b)', 'list_cosine_similarity(cast(a as double[]), cast(b as double[]))')}) s group by query_id")
def rerank_cosine(t):
    ranked = r.rerank(scored(t).drop("right_one"))
    return ranked.groupBy("query_id").agg(F.count("*").alias("candidates"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"))


_QUESTION = "select doc_id, 'texts from ' || source as query, text from documents"


@query("truncate_pairs", f"select doc_id, query, array_to_string(string_split(text, ' ')[1:509], ' ') as text from ({_QUESTION}) q")
def truncate_pairs(t):
    """A reader of 512 words, of which the question takes three."""
    return r.truncate_pairs(t.sql(_QUESTION), 512)


@query("truncate_pairs_to_tokens")
def truncate_pairs_to_tokens(t):
    """A reader of 512 tokens; tests compare it with the tokenizers library."""
    import public_tokenizers

    return r.truncate_pairs_to_tokens(t.sql(_QUESTION), public_tokenizers.path("byte_bpe_50k.json"), 512)


@query("recall_at_k", f"""select count(*) as queries, count(*) filter (where hit) as hits, count(*) filter (where hit) / count(*) as recall from (
select c.query_id, bool_or(r.rank <= 5) as hit from ({_CANDIDATES}) c join ({_RANKED}) r on r.query_id = c.query_id and r.passage_id = c.passage_id where c.right_one group by c.query_id) q""")
def recall_at_k(t):
    found = candidates(t)
    return r.recall_at_k(r.rerank(found.drop("right_one"), 5), found.where("right_one").select("query_id", "passage_id"), 5)
