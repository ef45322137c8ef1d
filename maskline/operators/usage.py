"""Usage analytics: price, spend, routing, visibility and quality of calls.

Dimensions (aliases, teams, routes) are joined on equality and left to Spark's own size-checked broadcast; calls are
never shuffled for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskline.session import materialize

MONEY = "decimal(30,10)"


def exact_mean(value: Column) -> Column:
    """Mean that does not depend on the order of the rows: an exact decimal sum, divided once."""
    return F.sum(value.cast("decimal(20,6)")).cast("double") / F.count(value)


def token_cost() -> Column:
    price = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,10)")
    return (F.col("tokens_in") * price("price_in") + F.col("tokens_out") * price("price_out")).cast(MONEY)


def price_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """cost = tokens in x price in + tokens out x price out; calls of an unknown alias keep a null cost."""
    dim = prices.select("alias", "price_in", "price_out", F.lit(True).alias("_known"))
    joined = calls.join(dim, "alias", "left")
    return joined.withColumn("cost", F.when(F.col("_known"), token_cost())).drop("price_in", "price_out", "_known")


def price_per_query(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Flat price of the aliases that are priced per query, token price of the others."""
    joined = calls.join(prices.select("alias", "price_in", "price_out", "price_query"), "alias")
    flat = F.col("price_query").cast("decimal(18,10)").cast(MONEY)
    return joined.withColumn("cost", F.when(F.col("price_query").isNotNull(), flat).otherwise(token_cost())).drop(
        "price_in", "price_out", "price_query"
    )


def alias_names(aliases: DataFrame) -> DataFrame:
    """(alias, name): the lower-cased names a trace of the alias can carry: alias, model, provider/model."""
    model = F.substring_index("model", "/", -1)
    return aliases.select("alias", F.explode(F.array_distinct(F.transform(F.array("alias", "model", model), F.lower))).alias("name"))


def resolve_alias(calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """calls (traced_model) with the alias whose price applies, null when none does. An equality join."""
    names = alias_names(aliases)
    return calls.join(names, F.lower("traced_model") == F.col("name"), "left").drop("name")


def ambiguous_models(aliases: DataFrame) -> DataFrame:
    """Models that several aliases serve: their traces cannot be priced."""
    served = aliases.select(F.substring_index("model", "/", -1).alias("model"), "alias")
    return served.groupBy("model").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases")
    ).where("n > 1")


def price_as_of(calls: DataFrame, history: DataFrame) -> DataFrame:
    """Price in force at the time of each call. history: (alias, valid_from, price_in, price_out).

    Prices become intervals (one window over the small history), so the calls are only joined on the alias with a
    residual time condition: broadcast when the history is small, never sorted.
    """
    until = F.lead("valid_from").over(W.partitionBy("alias").orderBy("valid_from"))
    intervals = history.select(
        F.col("alias").alias("_alias"), "valid_from", until.alias("_until"), "price_in", "price_out"
    )
    in_force = (
        (F.col("alias") == F.col("_alias"))
        & (F.col("ts") >= F.col("valid_from"))
        & (F.col("_until").isNull() | (F.col("ts") < F.col("_until")))
    )
    return calls.join(intervals, in_force, "left").drop("_alias", "_until", "valid_from")


def period_start(calls: DataFrame, key: str, days: int) -> DataFrame:
    """calls with `period`: how many whole periods of `days` lie between the first call of the key and this one."""
    # One row per key, written once: its size is then known, and it is broadcast when small.
    first = materialize(calls.groupBy(key).agg(F.min("ts").alias("_first")))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))
    return calls.join(first, key).withColumn("period", F.floor(seconds / (days * 86400 * 1000000)).cast("int")).drop("_first")


def spend_by_team(priced: DataFrame, days: int = 30) -> DataFrame:
    """Calls and spend per team and budget period, from the team's first call."""
    return period_start(priced.where("team IS NOT NULL"), "team", days).groupBy("team", "period").agg(
        F.count("*").alias("calls"), F.sum("cost").alias("spend")
    )


def usage_daily(priced: DataFrame) -> DataFrame:
    """Calls, tokens, cost, mean latency and errors per team, day and alias, with totals (nulls mark a total)."""
    day = priced.select("*", F.to_date("ts").alias("day"))
    return day.where("team IS NOT NULL").rollup("team", "day", "alias").agg(
        F.count("*").alias("calls"),
        F.sum(F.col("tokens_in") + F.col("tokens_out")).cast("bigint").alias("tokens"),
        F.sum("cost").alias("cost"),
        exact_mean(F.col("latency")).alias("latency"),
        F.count_if(F.col("status") >= 400).alias("errors"),
    )


def route_to_project(calls: DataFrame, routes: DataFrame, shared: str = "shared") -> DataFrame:
    """calls with the project of their team, or the shared one."""
    return calls.join(routes.select("team", "project"), "team", "left").withColumn("project", F.coalesce("project", F.lit(shared)))


def project_isolation(routed: DataFrame, routes: DataFrame, shared: str = "shared") -> DataFrame:
    """Calls seen in a project that is not theirs, or in several."""
    seen = routed.groupBy("call_id", "team").agg(F.collect_set("project").alias("_seen"))
    wanted = route_to_project(seen, routes, shared)
    return wanted.where(~((F.size("_seen") == 1) & F.array_contains("_seen", F.col("project")))).select(
        "call_id", "project", F.array_join(F.array_sort("_seen"), ",").alias("seen")
    )


def lead_visibility(calls: DataFrame, memberships: DataFrame, account: str) -> DataFrame:
    """The calls that an account may see: those of the teams it leads, or all for an admin (team '*')."""
    # The teams of one account: a few names of the configuration, which become a filter at the scan.
    teams = [r["team"] for r in memberships.where(F.col("account") == account).select("team").distinct().collect()]
    return calls if "*" in teams else calls.where(F.col("team").isin(teams))


def cost_reconciliation(traced: DataFrame, charged: DataFrame) -> DataFrame:
    """Teams whose cost computed from traces is not the cost charged, to the last digit."""
    # Within 37 digits, a difference keeps every digit of the scale.
    total = lambda name: F.sum("cost").cast("decimal(37,10)").alias(name)
    a = traced.groupBy("team").agg(total("traced"))
    b = charged.groupBy("team").agg(total("charged"))
    both = a.join(b.withColumnRenamed("team", "_team"), F.col("team").eqNullSafe(F.col("_team")), "full_outer")
    gap = F.coalesce("traced", F.lit(0)) - F.coalesce("charged", F.lit(0))
    return both.select(F.coalesce("team", "_team").alias("team"), "traced", "charged", gap.alias("gap")).where("gap <> 0")


def spend_by_end_user(priced: DataFrame, worker: str) -> DataFrame:
    """Spend of the jobs (end user `worker`) apart from the team's own calls with the same key."""
    jobs = F.coalesce(F.col("end_user") == worker, F.lit(False))
    return priced.where("team IS NOT NULL").groupBy("team").agg(
        F.sum(F.when(jobs, F.col("cost"))).alias("jobs_spend"),
        F.sum(F.when(~jobs, F.col("cost"))).alias("own_spend"),
        F.count_if(jobs).alias("jobs_calls"),
    )


def error_calls(calls: DataFrame) -> DataFrame:
    """Calls, failed calls and error rate per team and alias."""
    failed = F.col("status") >= 400
    return calls.groupBy("team", "alias").agg(
        F.count("*").alias("calls"), F.count_if(failed).alias("errors"), F.avg(failed.cast("double")).alias("error_rate")
    )


def fallback_rate(calls: DataFrame) -> DataFrame:
    """Per alias asked: share of calls served by another alias, and the time they took beyond the others."""
    fell = F.col("served_alias") != F.col("alias")
    return calls.groupBy("alias").agg(
        F.count("*").alias("calls"),
        F.count_if(fell).alias("fallbacks"),
        F.avg(fell.cast("double")).alias("fallback_rate"),
        (exact_mean(F.when(fell, F.col("latency"))) - exact_mean(F.when(~fell, F.col("latency")))).alias("added_latency"),
    )


def trace_summary(observations: DataFrame) -> DataFrame:
    """One row per trace: its generation, and the masked counts summed over its guardrail spans."""
    generation = F.col("type") == "GENERATION"
    main = observations.groupBy("trace_id").agg(
        *[F.max(F.when(generation, F.col(c))).alias(c) for c in ("team", "tokens_in", "tokens_out", "cost", "latency")]
    )
    counts = (
        observations.where("type = 'GUARDRAIL'")
        .select("trace_id", F.explode("masked"))
        .groupBy("trace_id", "key").agg(F.sum("value").alias("n"))
        .groupBy("trace_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("masked"))
    )
    return main.join(counts, "trace_id", "left")


def valid_json_answers(answers: DataFrame, fields: dict[str, str], list_sizes: dict[str, int] | None = None) -> DataFrame:
    """Answers (answer_id, content) that are a JSON object with the fields, typed; `reason` is the first fault.

    fields: name -> string, int, array (of strings), with `?` after the type when null is allowed.
    """
    parsed = F.try_parse_json("content")
    checks = [(parsed.isNull(), "not json")]
    for name, spec in fields.items():
        nullable, kind = spec.endswith("?"), spec.rstrip("?")
        raw = F.try_variant_get(parsed, f"$.{name}", "variant")
        schema = F.schema_of_variant(raw)
        good = {"string": schema == "STRING", "int": schema == "BIGINT", "array": schema.rlike("^ARRAY<(STRING|VOID)>$")}[kind]
        absent = raw.isNull()
        bad = absent | ~(good | (schema == "VOID") if nullable else good)
        checks.append((F.coalesce(bad, F.lit(True)), f"field {name}"))
        if list_sizes and name in list_sizes:
            size = F.size(F.try_variant_get(parsed, f"$.{name}", "array<string>"))
            checks.append((F.coalesce(size != list_sizes[name], F.lit(True)), f"size of {name}"))
    reason = F.coalesce(*[F.when(bad, why) for bad, why in checks])
    return answers.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def tool_call_check(answers: DataFrame, tools: DataFrame) -> DataFrame:
    """Tool calls (answer_id, tool, arguments as JSON) against declared tools (tool, parameters map name -> type, required).

    Valid: the tool is declared, every required argument is there, every declared argument has its type.
    """
    parsed = F.try_parse_json("arguments")
    schema = F.from_json("arguments", "map<string,string>")
    joined = answers.join(tools, "tool", "left").withColumn("_arguments", schema)
    missing = F.array_except("required", F.coalesce(F.map_keys("_arguments"), F.array().cast("array<string>")))

    def wrong(name: Column, kind: Column) -> Column:
        there = F.col("_arguments")[name]
        return F.when(kind == "integer", ~there.rlike(r"^-?[0-9]+$")).when(kind == "boolean", ~there.isin("true", "false")).otherwise(False)

    badly_typed = F.filter(
        F.map_entries("parameters"),
        lambda p: F.array_contains(F.map_keys("_arguments"), p["key"]) & F.coalesce(wrong(p["key"], p["value"]), F.lit(True)),
    )
    reason = (
        F.when(F.col("parameters").isNull(), "unknown tool")
        .when(parsed.isNull() | F.col("_arguments").isNull(), "not json")
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ",")))
        .when(F.size(badly_typed) > 0, F.lit("wrong type"))
    )
    return joined.select(*answers.columns, reason.alias("reason"), reason.isNull().alias("valid"))


def parameter_check(requests: DataFrame, parameters: DataFrame) -> DataFrame:
    """Requests (request_id, alias, keys) against (alias, allowed, dropped): refused for a key that the alias neither
    takes nor has listed as dropped without a word."""
    joined = requests.join(parameters, "alias")
    unknown = F.array_except("keys", "allowed")
    refused = F.array_except(unknown, F.col("dropped"))
    return joined.select(
        "request_id", "alias",
        F.when(F.size(refused) > 0, "refused").when(F.size(unknown) > 0, "dropped").otherwise("passed").alias("decision"),
        F.array_join(F.array_sort(unknown), ",").alias("unknown"),
    )


def embedding_dims(embeddings: DataFrame, expected: int) -> DataFrame:
    """Vectors that have not the expected number of dimensions."""
    return embeddings.where(F.coalesce(F.size("embedding") != expected, F.lit(True))).select(
        "vec_id", F.size("embedding").alias("dims")
    )
