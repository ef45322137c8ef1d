"""Live limits: access, rate, budget and provider cap on a stream of calls.

Each micro-batch is decided as a whole by the batch operator, which works in blocks: no team is one task or one Python
loop. What earlier calls leave behind (first calls, spend per period, the last minute's requests and tokens) is a few rows
per team and provider, written with the batch. Calls that are earlier than what is decided already cannot be decided any
more; they go to a table of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskline.operators.limits import Carried, admitted, first_calls
from maskline.session import forget, materialize, scope

HORIZON = "ts timestamp, call_id bigint"
SCHEMAS = {
    "firsts": "kind string, key string, first timestamp",
    "spent": "team string, provider string, team_period int, provider_period int, spent decimal(30,10)",
    "minutes": "team string, minute timestamp, requests bigint, tokens bigint",
}


def _state(decided: DataFrame, firsts: DataFrame, earlier: Carried, horizon, days: int) -> dict[str, DataFrame]:
    """What this batch and the earlier ones leave to later calls."""
    accepted = decided.where("decision = 200").groupBy("team", "provider", "team_period", "provider_period").agg(F.sum("cost").alias("spent"))
    keys = ["team", "provider", "team_period", "provider_period"]
    spent = earlier.spent.unionByName(accepted.withColumn("spent", F.col("spent").cast("decimal(30,10)"))).groupBy(*keys)
    spent = spent.agg(F.sum("spent").cast("decimal(30,10)").alias("spent"))
    # Only periods that go on at the horizon matter to later calls.
    age = F.floor((F.unix_micros(F.lit(horizon.ts)) - F.unix_micros("first")) / (days * 86400 * 1000000)).cast("int")
    now = lambda kind: firsts.where(F.col("kind") == kind).select(F.col("key").alias(kind), age.alias(f"{kind}_now"))
    going = spent.join(now("team"), "team").join(now("provider"), "provider", "left")
    going = going.where("team_period = team_now OR provider_period = provider_now")
    minute = F.date_trunc("minute", F.lit(horizon.ts))
    asked = decided.where("reason <> 'access'").where(F.date_trunc("minute", "ts") == minute).groupBy("team", minute.alias("minute")).agg(
        F.count("*").alias("requests"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens")
    )
    minutes = earlier.minutes.where(F.col("minute") == minute).unionByName(asked).groupBy("team", "minute").agg(
        F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens")
    )
    return {"firsts": firsts, "spent": going.select(*keys, "spent"), "minutes": minutes}


def limits_stream(
    calls: DataFrame, teams: DataFrame, access: DataFrame, caps: DataFrame, folder: str, checkpoint: str, days: int = 30, hold: str = "0 seconds", **trigger
) -> StreamingQuery:
    """calls (call_id, ts, team, alias, provider, tokens_in, tokens_out, cost) -> one decision per call, or a late row.

    Writes folder/decisions (call_id, team, decision, reason) and folder/late (calls not later than the last decided one),
    per batch, and folder/state. A call is decided when one that is later by `hold` has come; until then it is part of the
    state, so that calls may come out of order by as much over the batches. Decisions are those of `admission` over all calls
    that are not late, in whatever order and files they come. A batch that runs again reads the state before it
    and replaces what it wrote; the last two states are kept, and what a batch wrote on its way is deleted at its end.
    """

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = lambda name, n: f"{folder}/{name}/batch={n}"
        put = lambda df, name: df.write.mode("overwrite").parquet(at(name, batch_id))
        start = batch_id == 0
        read = lambda name, schema: spark.createDataFrame([], schema) if start else spark.read.schema(schema).parquet(at(f"state/{name}", batch_id - 1))
        with scope(spark):
            horizon = read("horizon", HORIZON).first()
            earlier = Carried(*[read(name, SCHEMAS[name]) for name in Carried._fields])
            batch = materialize(batch)
            mark = F.struct("ts", "call_id")
            done = F.lit(False) if horizon is None else mark <= F.struct(F.lit(horizon.ts).alias("ts"), F.lit(horizon.call_id).alias("call_id"))
            put(batch.where(done), "late")
            waiting = batch.where(~done).unionByName(read("pending", calls.schema).select(*calls.columns))
            waiting = materialize(waiting)
            newest = waiting.agg(F.max(F.col("ts")).alias("ts")).first().ts
            due = F.lit(True) if newest is None else F.coalesce(F.col("ts") <= F.lit(newest) - F.expr(f"INTERVAL {hold}"), F.lit(True))
            put(waiting.where(~due), "state/pending")
            new = waiting.where(due)
            last = new.agg(F.max(mark).alias("last")).first().last
            if last is None:
                put(spark.createDataFrame([], "call_id bigint, team string, decision int, reason string"), "decisions")
                for name in Carried._fields:
                    put(getattr(earlier, name), f"state/{name}")
                put(read("horizon", HORIZON), "state/horizon")
                return
            decided = materialize(admitted(new, teams, access, caps, days, earlier))
            put(decided.select("call_id", "team", "decision", "reason"), "decisions")
            for name, table in _state(decided, first_calls(new, earlier), earlier, last, days).items():
                put(table, f"state/{name}")
            put(new.where(mark == F.struct(F.lit(last.ts).alias("ts"), F.lit(last.call_id).alias("call_id"))).select("ts", "call_id"), "state/horizon")
            # A batch that runs again needs the state before it; no other is read any more.
            forget(spark, [at(f"state/{name}", batch_id - 2) for name in (*Carried._fields, "horizon", "pending") if batch_id > 1])

    return calls.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(**trigger).start()
