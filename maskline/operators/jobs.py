"""Batch side of the job stream: jobs, outcomes, delays, lifecycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskline import fixed_values as fixed
from maskline.operators.scan import nearest_ranks


def _field(parsed: Column, name: str) -> Column:
    return F.try_variant_get(parsed, f"$.{name}", "variant")


def _is(value: Column, pattern: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike(pattern), F.lit(False))


def _job_reason(parsed: Column) -> Column:
    """First reason why a job can never succeed, null when it is valid."""
    team, alias, messages, tokens = (_field(parsed, n) for n in ("team", "alias", "messages", "max_tokens"))
    size = F.size(F.try_variant_get(messages, "$", "array<variant>"))
    number = F.try_variant_get(parsed, "$.max_tokens", "bigint")
    text = lambda v, name: _is(v, "^STRING$") & (F.try_variant_get(parsed, f"$.{name}", "string") != "")
    return (
        F.when(parsed.isNull(), "not JSON")
        .when(~_is(parsed, "^OBJECT"), "not an object")
        .when(~text(team, "team"), "no team")
        .when(~text(alias, "alias"), "no alias")
        .when(~_is(messages, "^ARRAY") | (size == 0), "no messages")
        .when(
            tokens.isNotNull() & ~(_is(tokens, "^BIGINT$") & F.coalesce(number.between(1, fixed.JOB_MAX_TOKENS), F.lit(False))),
            "bad max_tokens",
        )
    )


def checked_jobs(messages: DataFrame) -> DataFrame:
    """messages (message_id, body, ...) with the parsed body and the reason of invalid ones."""
    parsed = messages.withColumn("_job", F.try_parse_json("body"))
    return parsed.withColumn("reason", _job_reason(F.col("_job")))


def parse_jobs(messages: DataFrame) -> DataFrame:
    """Valid bodies -> typed jobs, with defaults: 512 tokens, the id as text."""
    job = F.col("_job")
    number = F.coalesce(F.try_variant_get(job, "$.max_tokens", "int"), F.lit(fixed.JOB_DEFAULT_TOKENS))
    return checked_jobs(messages).where("reason IS NULL").select(
        "message_id",
        F.coalesce(F.try_variant_get(job, "$.id", "string"), F.lit("")).alias("id"),
        F.try_variant_get(job, "$.team", "string").alias("team"),
        F.try_variant_get(job, "$.alias", "string").alias("alias"),
        F.from_json(F.to_json(_field(job, "messages")), "array<struct<role:string,content:string>>").alias("messages"),
        number.alias("max_tokens"),
    )


def invalid_jobs(messages: DataFrame) -> DataFrame:
    return checked_jobs(messages).where("reason IS NOT NULL").select("message_id", "reason")


def jobs_without_key(jobs: DataFrame, keys: DataFrame) -> DataFrame:
    """Jobs of teams without a key; a key is named by its variable, TEAM_KEY_<TEAM>."""
    teams = keys.select(F.lower(F.regexp_replace("variable", "^TEAM_KEY_", "")).alias("team"))
    return jobs.join(teams, "team", "left_anti").withColumn("reason", F.concat(F.lit("no key for team "), "team"))


def outcome(status: Column, invalid: Column | None = None) -> Column:
    """done, retry, backoff or dead. A null status is a connection error; of the others below 500 only a timeout is tried again."""
    failed = (
        F.when(status.between(200, 299), "done")
        .when(status == 429, "backoff")
        .when((status < 500) & (status != 408), "dead")
        .otherwise("retry")
    )
    return failed if invalid is None else F.when(invalid, "dead").otherwise(failed)


def classify_outcome(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn("outcome", outcome(F.col("status")))


def backoff_seconds(attempts: DataFrame, jitter: float = 2.0) -> DataFrame:
    """Wait before a rate-limited job is given back: until reset_at (UTC), else retry_after, else 10 s; 1 to 60 s.

    A jitter of at most `jitter` seconds comes from the job and the attempt, so a rerun gives the same delay.
    """
    reset = F.try_to_timestamp("reset_at", F.lit("yyyy-MM-dd HH:mm:ss 'UTC'"))
    until = (F.unix_micros(reset) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    asked = F.when(F.col("retry_after").isNull(), fixed.JOB_BACKOFF_DEFAULT_SECONDS).otherwise(
        F.coalesce(F.col("retry_after").try_cast("double"), F.lit(fixed.JOB_BACKOFF_DEFAULT_SECONDS))
    )
    wait = F.least(F.greatest(F.coalesce(until, asked), F.lit(1.0)), F.lit(fixed.JOB_BACKOFF_MAX_SECONDS))
    spread = F.pmod(F.xxhash64("job_id", "attempt_id"), F.lit(1000)) / 1000.0 * jitter
    return attempts.withColumn("wait", wait + spread if jitter else wait)


def _at() -> Column:
    return F.struct("ts", "attempt_id")


def _first_failures(classified: DataFrame) -> DataFrame:
    """The first failures of each job, numbered. The limit on the number is applied before the shuffle too (window
    group limit), so a job with any number of attempts sends a few rows."""
    order = W.partitionBy("job_id").orderBy("ts", "attempt_id")
    numbered = classified.where("outcome = 'retry'").withColumn("failures", F.row_number().over(order))
    return numbered.where(F.col("failures") <= fixed.JOB_FAILURES_ALLOWED + 1)


def job_ends(classified: DataFrame) -> DataFrame:
    """(job_id, end_at, end_outcome, end_status): the attempt that ends each job: done, refused, or one failure too
    many. Jobs that go on have no row."""
    final = classified.where("outcome IN ('done', 'dead')").groupBy("job_id").agg(
        F.min(F.struct(_at().alias("at"), "outcome", "status")).alias("end")
    )
    exhausted = _first_failures(classified).where(F.col("failures") > fixed.JOB_FAILURES_ALLOWED).select(
        "job_id", F.struct(_at().alias("at"), "outcome", "status").alias("end")
    )
    return final.unionByName(exhausted).groupBy("job_id").agg(F.min("end").alias("end")).select(
        "job_id", F.col("end.at").alias("end_at"), F.col("end.outcome").alias("end_outcome"), F.col("end.status").alias("end_status")
    )


def _marked(attempts: DataFrame) -> DataFrame:
    """Attempts up to the end of their job, with that end. One row per job joins them, so a job that holds most
    attempts is split by the skew join."""
    classified = classify_outcome(attempts)
    ends = job_ends(classified)
    return classified.join(ends, "job_id", "left").where(F.col("end_at").isNull() | (_at() <= F.col("end_at")))


def job_lifecycle(attempts: DataFrame) -> DataFrame:
    """Final state of each job: done, dead (hopeless or third failure) or pending; back-offs do not count."""
    end = F.first("end_outcome")
    state = F.when(end.isNull(), "pending").when(end == "done", "done").otherwise("dead")
    return _marked(attempts).groupBy("job_id").agg(
        F.count("*").alias("attempts"),
        F.count_if(F.col("outcome") == "retry").alias("failures"),
        F.count_if(F.col("outcome") == "backoff").alias("backoffs"),
        state.alias("state"),
    )


def redelivery_time(attempts: DataFrame) -> DataFrame:
    """Next attempt of the jobs to retry: 5 s per failure so far, at most 30 s."""
    classified = classify_outcome(attempts)
    failed = _first_failures(classified).where(F.col("failures") <= fixed.JOB_FAILURES_ALLOWED)
    going_on = failed.join(job_ends(classified), "job_id", "left").where(F.col("end_at").isNull() | (_at() < F.col("end_at")))
    delay = F.least(F.lit(fixed.JOB_RETRY_MIN_SECONDS) * F.col("failures"), F.lit(fixed.JOB_RETRY_MAX_SECONDS))
    return going_on.select(
        "job_id", "attempt_id", delay.cast("int").alias("delay"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), delay.cast("decimal(18,6)"))).alias("next_ts"),
    )


def match_replies(jobs: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies joined to their jobs by correlation id (batch twin of the stream join)."""
    return jobs.join(replies, jobs["message_id"] == replies["correlation_id"]).select(
        "message_id", "reply_to", "content", F.col("replied_ts")
    )


def job_results(attempts: DataFrame) -> DataFrame:
    """Exactly one result row, as JSON, per job that finished well."""
    marked = _marked(attempts).where("outcome = 'done'")
    result = F.to_json(F.struct(F.col("job_id").alias("id"), F.lit("done").alias("status"), "alias", "seconds"))
    return marked.select("job_id", result.alias("result"))


def dead_letters(attempts: DataFrame, queue: str) -> DataFrame:
    """Jobs set aside: reason, source queue, deliveries."""
    dead = _marked(attempts).where("end_outcome <> 'done'")
    reason = F.when(
        F.col("end_outcome") == "dead", F.concat(F.lit("refused with "), F.col("end_status").cast("string"))
    ).otherwise("third failure")
    return dead.groupBy("job_id", reason.alias("reason")).agg(F.lit(queue).alias("queue"), F.count("*").alias("deliveries"))


def job_metrics(attempts: DataFrame) -> DataFrame:
    """Per team and alias: jobs, attempts, outcomes, and the durations that half and 95 % of the attempts keep within."""
    classified = classify_outcome(attempts)
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    counts = classified.groupBy("team", "alias").agg(
        F.count_distinct("job_id").alias("jobs"),
        F.count("*").alias("attempts"),
        *[count(o) for o in ("done", "retry", "backoff", "dead")],
    )
    ranks = nearest_ranks(attempts, ["team", "alias"], "seconds").withColumnsRenamed({"team": "_team", "alias": "_alias"})
    same = F.col("team").eqNullSafe(F.col("_team")) & F.col("alias").eqNullSafe(F.col("_alias"))
    return counts.join(ranks, same, "left").drop("_team", "_alias")
