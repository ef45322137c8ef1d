"""Access, rate, budget and provider limits, call by call.

Few teams make most calls, so a window per team would be one task. Calls are cut once into blocks of consecutive
calls; running totals are then exact for any key (see scan.py). Within a window the first refusal blocks every later
call, so totals over all calls equal totals over accepted calls up to it, and a prefix decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskline.operators.scan import BLOCK, ordered_blocks, running_before
from maskline.operators.usage import period_start
from maskline.session import materialize

ORDER = ["ts", "call_id"]


def access_decisions(calls: DataFrame, access: DataFrame) -> DataFrame:
    """calls with `allowed`: is the alias one of the team's? 403 otherwise."""
    listed = access.select(F.col("team_id").alias("team"), "alias", F.lit(True).alias("_listed"))
    joined = calls.join(listed, ["team", "alias"], "left")
    return joined.withColumn("allowed", F.coalesce("_listed", F.lit(False))).drop("_listed").withColumn(
        "decision", F.when(F.col("allowed"), 200).otherwise(403)
    )


def _minute(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def _rated(blocked: DataFrame, keys: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Blocked calls with `within_rate`: requests and tokens of the team's minute so far, both under the limits. A limit
    that is null, or of a team without a row, limits nothing. carried (team, minute, requests, tokens) came before."""
    minute = blocked.withColumn("minute", _minute(F.col("ts")))
    counted = running_before(
        minute, ["team", "minute"], ORDER, {"_requests": F.lit(1), "_tokens": F.col("tokens_in") + F.col("tokens_out")}
    )
    if carried is not None:
        counted = counted.join(carried, ["team", "minute"], "left")
        for name in ("requests", "tokens"):
            counted = counted.withColumn(f"_{name}", F.col(f"_{name}") + F.coalesce(name, F.lit(0)))
        counted = counted.drop("requests", "tokens")
    limits = keys.select(F.col("team_id").alias("team"), "rpm_limit", "tpm_limit")
    under = lambda used, limit: F.coalesce(F.col(used) < F.col(limit), F.lit(True))
    within = under("_requests", "rpm_limit") & under("_tokens", "tpm_limit")
    return counted.join(limits, "team", "left").withColumn("within_rate", within).drop("_requests", "_tokens", "rpm_limit", "tpm_limit")


def rate_decisions(calls: DataFrame, keys: DataFrame) -> DataFrame:
    """One decision per call: 429 with the time of the reset beyond the requests or tokens a key may use in its minute.

    Calls without a team, and of teams without limits, are let through.
    """
    narrow = calls.select(*ORDER, "team", "tokens_in", "tokens_out")
    rated = _rated(ordered_blocks(narrow, ORDER), keys)
    return rated.select(
        "call_id", "team", F.when(F.col("within_rate"), 200).otherwise(429).alias("decision"),
        F.when(~F.col("within_rate"), F.col("minute") + F.expr("INTERVAL 1 MINUTE")).alias("reset_at"),
    )


def _stops(blocked: DataFrame, key: str, period: str, limit: str, spent: Column) -> DataFrame:
    """(key, period, at): the first call of each key and period that finds its limit spent.

    Rows are not sorted for this. Sums per block (combined before the shuffle) tell in which block the limit is
    crossed; only the calls of that one block are put in order, and the first call of the next block follows if the
    crossing call was the last.
    """
    money = "decimal(36,10)"
    narrow = blocked.select(
        BLOCK, F.col(key).alias("key"), F.col(period).alias("period"), F.struct(*ORDER).alias("at"),
        F.col(limit).alias("most"), spent.alias("spent"),
    )
    totals = narrow.groupBy("key", "period", "most", BLOCK).agg(
        F.sum("spent").cast(money).alias("total"), F.min("at").alias("first_at")
    )
    earlier = W.partitionBy("key", "period").orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carried = materialize(totals.withColumn("carry", F.coalesce(F.sum("total").over(earlier), F.lit(0)).cast(money)))
    after = carried.where("carry >= most").groupBy("key", "period").agg(F.min("first_at").alias("at"))
    crossing = carried.where("carry < most AND carry + total >= most").select("key", "period", BLOCK, "carry")
    inside = W.partitionBy("key", "period").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    ordered = narrow.join(crossing, ["key", "period", BLOCK]).withColumn("before", F.sum("spent").over(inside).cast(money))
    within = ordered.where(F.col("carry") + F.coalesce("before", F.lit(0)) >= F.col("most")).select("key", "period", "at")
    return within.unionByName(after).groupBy("key", "period").agg(F.min("at").alias("at"))


def _with_stop(calls: DataFrame, stops: DataFrame, key: str, period: str, name: str) -> DataFrame:
    """calls with a boolean: is this call at or after the stop of its key and period? Stops are few, and written, so
    Spark knows their size and broadcasts them."""
    s = stops.select(F.col("key").alias(key), F.col("period").alias(period), F.col("at").alias("_at"))
    over = F.coalesce(F.struct(*ORDER) >= F.col("_at"), F.lit(False))
    return calls.join(s, [key, period], "left").withColumn(name, over).drop("_at")


def budget_decisions(priced: DataFrame, teams: DataFrame, days: int = 30) -> DataFrame:
    """One decision per call: 422 after the call that reached the team's budget, until the period ends. Other teams go on.

    Calls without a team (whose period is null), and of teams without a budget, are let through.
    """
    narrow = priced.select(*ORDER, "team", "cost")
    budgets = teams.select(F.col("team_id").alias("team"), "max_budget")
    dated = period_start(narrow.where("team IS NOT NULL"), "team", days).join(budgets, "team", "left")
    dated = dated.unionByName(narrow.where("team IS NULL"), allowMissingColumns=True)
    blocked = ordered_blocks(dated, ORDER)
    stops = materialize(_stops(blocked.where("max_budget IS NOT NULL"), "team", "period", "max_budget", F.col("cost")))
    decided = _with_stop(blocked, stops, "team", "period", "over")
    return decided.select("call_id", "team", "period", F.when(F.col("over"), 422).otherwise(200).alias("decision"))


def _capped(priced: DataFrame, caps: DataFrame, days: int) -> DataFrame:
    capped = priced.select(*ORDER, "provider", "cost").join(caps.select("provider", "cap"), "provider")
    return ordered_blocks(period_start(capped, "provider", days), ORDER)


def provider_cap(priced: DataFrame, caps: DataFrame, days: int = 30) -> DataFrame:
    """Calls of capped providers, over all teams: refused once the cap of the period is spent."""
    blocked = _capped(priced, caps, days)
    stops = materialize(_stops(blocked, "provider", "period", "cap", F.col("cost")))
    decided = _with_stop(blocked, stops, "provider", "period", "over")
    return decided.select("call_id", "provider", F.when(F.col("over"), "refused").otherwise("accepted").alias("decision"))


def provider_remaining(priced: DataFrame, caps: DataFrame, days: int = 30) -> DataFrame:
    """What is left of the cap after each call."""
    spent = running_before(_capped(priced, caps, days), ["provider", "period"], ORDER, {"spent": F.col("cost")})
    left = F.greatest(F.col("cap") - F.col("spent") - F.col("cost"), F.lit(0))
    return spent.select("call_id", "provider", left.cast("decimal(30,10)").alias("remaining"))


def _key_sums(candidates: DataFrame) -> DataFrame:
    """(block, team, team_period, provider, provider_period, max_budget, cap, settled, us, id, units): what the calls of a
    block sum up to, in units of 10^-10; us and id are null. Combined before the shuffle."""
    keys = [BLOCK, "team", "team_period", "provider", "provider_period", "max_budget", "cap", "settled"]
    total = F.sum(_units()).cast("decimal(38,0)").alias("units")
    none = F.lit(None).cast("bigint")
    return candidates.groupBy(*keys).agg(total).select(*keys, none.alias("us"), none.alias("id"), "units")


def _units() -> Column:
    return (F.coalesce("cost", F.lit(0)).cast("decimal(30,10)") * 10000000000).cast("decimal(38,0)")


def _scaled(limit) -> int | None:
    return None if limit is None else int(limit * 10**10)


class _Keys:
    """Teams and providers with their period, as the fold sees them; what has no limit is no key."""

    def __init__(self) -> None:
        self.limit: dict[tuple, int] = {}

    def of(self, row: dict) -> list[tuple]:
        """The limited keys of a row."""
        found = []
        for kind, limit in (("team", row["max_budget"]), ("provider", row["cap"])):
            if limit is not None:
                key = (kind, row[kind], row[f"{kind}_period"])
                self.limit.setdefault(key, _scaled(limit))
                found.append(key)
        return found


def _by_block(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each block; parts are in order of the blocks."""
    block, rows = None, []
    for part in parts:
        for row in part.to_pylist():
            if row[BLOCK] != block and rows:
                yield block, rows
                rows = []
            block = row[BLOCK]
            row["units"] = int(row["units"])
            rows.append(row)
    if rows:
        yield block, rows


def _windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sums per block: the blocks in which each key may reach its limit.

    A key's spend lies between two bounds. In a block a call counts for the upper one if neither of its keys is surely
    stopped, and for the lower one if the other key stays open for sure; a key that goes on until its limit has spent that
    much at least. With no coupling the bounds agree, and one block is left.
    """
    keys, low, high, seen = _Keys(), {}, {}, {}
    for block, rows in _by_block(parts):
        pairs = [(keys.of(row), row) for row in rows]
        more: dict[tuple, int] = {}
        for own, row in pairs:
            if row["settled"] or not any(low.get(k, 0) >= keys.limit[k] for k in own):
                for k in own:
                    more[k] = more.get(k, 0) + row["units"]
        touched = {k for own, _ in pairs for k in own}
        through = {k: high.get(k, 0) + more.get(k, 0) < keys.limit[k] for k in touched}
        sure: dict[tuple, int] = {}
        for own, row in pairs:
            for k in own:
                if row["settled"] or all(through[o] for o in own if o != k):
                    sure[k] = sure.get(k, 0) + row["units"]
        for k in touched:
            if low.get(k, 0) < keys.limit[k] and not through[k]:
                seen[k] = (seen.get(k, (block,))[0], block)
            high[k] = high.get(k, 0) + more.get(k, 0)
            spent = low.get(k, 0) + sure.get(k, 0)
            low[k] = spent if through[k] else max(low.get(k, 0), min(keys.limit[k], spent))
    columns = [[*c] for c in zip(*((*k, *w) for k, w in seen.items()), strict=True)] or [[]] * 5
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "key", "period", "low", "high"])


def _settled_stops(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sums and, where a key may reach its limit, calls in order: the call after which each key is stopped."""
    keys, spent, after = _Keys(), {}, {}
    for _, rows in _by_block(parts):
        for row in rows:
            own = keys.of(row)
            for k in own:
                if keys.limit[k] <= 0:
                    after.setdefault(k, (-(2**63), -1))
            if not row["settled"] and any(k in after for k in own):
                continue
            for k in own:
                spent[k] = spent.get(k, 0) + row["units"]
                if spent[k] >= keys.limit[k]:
                    after.setdefault(k, (-(2**63) if row["us"] is None else row["us"], -1 if row["id"] is None else row["id"]))
    columns = [[*c] for c in zip(*((*k, *a) for k, a in after.items()), strict=True)] or [[]] * 5
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "key", "period", "us", "id"])


def _coupled_stops(candidates: DataFrame) -> DataFrame:
    """(kind, key, period, us, id): the call after which each team and provider has spent its limit in a period, where calls
    that one of them refuses don't count for the other.

    Two folds, each of one task over sums per block, team and provider, which are as many as blocks times pairs in use,
    however many calls there are. The first one bounds the blocks in which a key may reach its limit. The calls of these
    blocks and keys, and the sums of all others, are then folded in order: no more jobs for many stops than for one.
    """
    limited = candidates.where("max_budget IS NOT NULL OR cap IS NOT NULL")
    sums = materialize(_key_sums(limited))
    order = [BLOCK, F.desc("settled"), "us", "id"]
    windows = sums.repartition(1).sortWithinPartitions(BLOCK).mapInArrow(_windows, "kind string, key string, period int, low bigint, high bigint")
    windows = materialize(windows)

    def detailed(rows: DataFrame) -> DataFrame:
        for kind in ("team", "provider"):
            own = windows.where(F.col("kind") == kind).select(
                F.col("key").alias(kind), F.col("period").alias(f"{kind}_period"), F.col("low").alias(f"_{kind}_low"), F.col("high").alias(f"_{kind}_high")
            )
            rows = rows.join(own, [kind, f"{kind}_period"], "left")
        inside = [F.coalesce(F.col(BLOCK).between(F.col(f"_{k}_low"), F.col(f"_{k}_high")), F.lit(False)) for k in ("team", "provider")]
        return rows.withColumn("_detailed", inside[0] | inside[1])

    least = F.lit(-(2**62))
    calls = detailed(limited).where("_detailed").select(
        *[c for c in sums.columns if c not in ("us", "id", "units")],
        F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), least).alias("us"), F.coalesce("call_id", F.lit(-1)).alias("id"), _units().alias("units"),
    )
    rows = calls.unionByName(detailed(sums).where("NOT _detailed").select(*sums.columns))
    told = rows.repartition(1).sortWithinPartitions(*order).mapInArrow(_settled_stops, "kind string, key string, period int, us bigint, id bigint")
    return materialize(told)


def _after_stop(calls: DataFrame, stops: DataFrame, kind: str, name: str) -> DataFrame:
    """calls with a boolean: does this call come after the stop of its key and period? Stops are few, and written, so Spark
    knows their size and broadcasts them."""
    own = stops.where(F.col("kind") == kind).select(F.col("key").alias(kind), F.col("period").alias(f"{kind}_period"), F.struct("us", "id").alias("_after"))
    here = F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("call_id").alias("id"))
    return calls.join(own, [kind, f"{kind}_period"], "left").withColumn(name, F.coalesce(here > F.col("_after"), F.lit(False))).drop("_after")


def admission(calls: DataFrame, teams: DataFrame, access: DataFrame, caps: DataFrame, days: int = 30) -> DataFrame:
    """One decision per call, with its reason: access, then rate, then team budget, then provider cap.

    A call without a team has no access. Limits, budgets and caps that are null, or have no row, refuse nothing; a call
    without a provider meets no cap. A refused call spends nothing. Budget and cap are coupled: calls that one refuses do
    not count for the other. Each is described by its stop, the call after which it is spent, one row per team or provider
    and period; the number of jobs does not depend on how many stops there are. Costs are not negative.
    """
    return admitted(calls, teams, access, caps, days).select("call_id", "decision", "reason")


class Carried(NamedTuple):
    """What earlier calls leave to later ones, a few rows per team and provider."""

    #: (kind, key, first): first call of each team and provider.
    firsts: DataFrame
    #: (team, provider, team_period, provider_period, spent) of accepted calls.
    spent: DataFrame
    #: (team, minute, requests, tokens) of calls with access.
    minutes: DataFrame


def first_calls(calls: DataFrame, earlier: Carried | None = None) -> DataFrame:
    """(kind, key, first) of teams and providers."""
    found = [calls.select(F.lit(kind).alias("kind"), F.col(kind).alias("key"), "ts") for kind in ("team", "provider")]
    rows = found[0].unionByName(found[1]).where("key IS NOT NULL")
    if earlier is not None:
        rows = rows.unionByName(earlier.firsts.withColumnRenamed("first", "ts"))
    return rows.groupBy("kind", "key").agg(F.min("ts").alias("first"))


def admitted(
    calls: DataFrame, teams: DataFrame, access: DataFrame, caps: DataFrame, days: int = 30, earlier: Carried | None = None
) -> DataFrame:
    """calls, all later than what `earlier` sums up, with `decision`, `reason`, `team_period` and `provider_period`."""
    open_ = access_decisions(calls.select("call_id", "ts", "team", "alias", "provider", "tokens_in", "tokens_out", "cost"), access)
    told = ["call_id", "ts", "team", "provider", "tokens_in", "tokens_out", "cost"]
    verdict = lambda df, code, why: df.select(*told, F.lit(code).alias("decision"), F.lit(why).alias("reason"))
    refused = verdict(open_.where("NOT allowed"), 403, "access")
    narrow = open_.where("allowed").select(*told)
    rated = materialize(_rated(ordered_blocks(narrow, ORDER), teams, earlier.minutes if earlier else None))
    limited = verdict(rated.where("NOT within_rate"), 429, "rate")

    firsts = materialize(first_calls(calls, earlier))
    budgets = teams.select(F.col("team_id").alias("team"), "max_budget")
    first = lambda kind: firsts.where(F.col("kind") == kind).select(F.col("key").alias(kind), F.col("first").alias(f"{kind}_first"))
    since = lambda key: F.floor(
        (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col(f"{key}_first").cast("timestamp"))) / (days * 86400 * 1000000)
    ).cast("int").alias(f"{key}_period")
    candidates = rated.where("within_rate").join(first("team"), "team").join(first("provider"), "provider", "left")
    candidates = candidates.select(BLOCK, *told, F.lit(False).alias("settled"), since("team"), since("provider"))
    if earlier is not None:
        # What has been spent is a call before all others, which nothing refuses any more.
        before = earlier.spent.withColumnRenamed("spent", "cost").select(
            "*", F.lit(-1).alias(BLOCK), F.lit(-1).cast("bigint").alias("call_id"), F.lit(True).alias("settled"),
            F.timestamp_seconds(F.lit(0)).cast(dict(calls.dtypes)["ts"]).alias("ts"),
        )
        candidates = candidates.unionByName(before, allowMissingColumns=True)
    candidates = candidates.join(budgets, "team", "left").join(caps.select("provider", "cap"), "provider", "left")
    candidates = materialize(candidates)

    stops = _coupled_stops(candidates)
    judged = _after_stop(candidates, stops, "team", "over_budget")
    judged = _after_stop(judged, stops, "provider", "over_cap")
    decision = F.when(F.col("over_budget"), 422).when(F.col("over_cap"), 429).otherwise(200)
    reason = F.when(F.col("over_budget"), "budget").when(F.col("over_cap"), "provider cap").otherwise("accepted")
    final = judged.where("NOT settled").select(*told, decision.alias("decision"), reason.alias("reason"), "team_period", "provider_period")
    return final.unionByName(refused.unionByName(limited), allowMissingColumns=True)

