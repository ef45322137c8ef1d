"""Masking as a stream: messages masked as they come, with markers that go on over batches; streamed answers, buffered to
their end, then unmasked and sent as one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from maskline.operators.mask import apply_markers, more_markers, unmask_answers
from maskline.plans.masking import message_spans
from maskline.session import forget, materialize, scope

#: Columns without which a row is no chunk, besides its time.
CHUNK_NEEDS = ("answer_id", "seq")
ANSWER = "answer_id long, conv_id long, text string, complete boolean"
BUFFER = "conv_id long, seqs array<int>, parts array<string>, expected int"


def _buffer(wait_ms: int):
    """One answer: its chunks, until all up to the last one are there, or time is up."""

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        conv_id, seqs, parts, expected = state.get if state.exists else (None, [], [], -1)
        seqs, parts, newest = list(seqs), list(parts), None
        if not state.hasTimedOut:
            for chunk in chunks:
                known = chunk["conv_id"].dropna()
                conv_id = int(known.iloc[0]) if len(known) else conv_id
                seqs += [int(s) for s in chunk["seq"]]
                parts += list(chunk["chunk"])
                ends = chunk.loc[chunk["is_last"].astype(bool), "seq"]
                expected = int(ends.max()) + 1 if len(ends) else expected
                newest = chunk["ts"].max()
        complete = expected >= 0 and len(set(seqs)) >= expected
        if state.hasTimedOut or complete:
            text = "".join(part for _, part in sorted(dict(zip(seqs, parts)).items()))
            if state.exists:
                state.remove()
            yield pd.DataFrame({"answer_id": [key[0]], "conv_id": pd.array([conv_id], "Int64"), "text": [text], "complete": [complete]})
        else:
            state.update((conv_id, seqs, parts, expected))
            state.setTimeoutTimestamp(max(int(newest.timestamp() * 1000) + wait_ms, state.getCurrentWatermarkMs() + 1))

    return step


def whole_answers(chunks: DataFrame, late: str = "10 minutes", wait_ms: int = 600_000) -> DataFrame:
    """chunks (answer_id, conv_id, seq, chunk, is_last, ts) -> one row per finished answer.

    A chunk delivered twice counts once. An answer that never ends is sent when event time passes its last chunk by
    wait_ms, so state is bounded; it is not `complete`: chunks are missing in it or at its end. A null chunk is empty, a
    null is_last is false, and an answer may lack a conversation. Rows without answer_id, seq or ts are no chunks, and
    chunks behind the watermark come too late: streaming.late.sort_out, with `CHUNK_NEEDS`, puts both into tables before.
    """
    chunks = chunks.where(" AND ".join(f"{c} IS NOT NULL" for c in (*CHUNK_NEEDS, "ts"))).select(
        "answer_id", "conv_id", "seq", F.coalesce("chunk", F.lit("")).alias("chunk"), F.coalesce("is_last", F.lit(False)).alias("is_last"), "ts"
    )
    return chunks.withWatermark("ts", late).groupBy("answer_id").applyInPandasWithState(
        _buffer(wait_ms), ANSWER, BUFFER, "append", GroupStateTimeout.EventTimeTimeout
    )


def unmask_stream(chunks: DataFrame, markers: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Finished answers, with the values of their conversation, written per batch (a rerun batch replaces itself)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            unmask_answers(batch, markers).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        finally:
            batch.unpersist()

    return whole_answers(chunks).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def mask_stream(
    messages: DataFrame,
    first_names: DataFrame | None,
    folder: str,
    checkpoint: str,
    keep: str = "1 day",
    compact: int = 16,
    options: dict | None = None,
    **trigger,
) -> StreamingQuery:
    """messages (conv_id, turn, text, ts, ...) -> folder/masked, the messages with masked_text, and folder/markers.

    A value of a conversation keeps its marker over all batches, and numbers go on: as long as turns come in order, the
    answer is that of `mask_conversations` over all messages. A conversation without a message for `keep` of event time is
    forgotten and starts anew if it comes back. Messages older than that go to folder/late unmasked, as what belonged to
    them may be forgotten; rows without conv_id, turn or ts go to folder/bad. So rows in = rows masked + late + bad. A
    message that is delivered again is masked again, with the same markers. A null text stays null. options are those of
    `message_spans`.

    State is keyed by conversation: (conv_id, life, numbered, seen) and the markers of each life, a row per value. A batch
    writes what it adds; every `compact` batches all that is still alive is written as one, and what came before the one
    before is deleted, so that state is bounded by what lives. A batch that runs again reads the state before it and
    replaces what it wrote.
    """
    kind = messages.schema["conv_id"].dataType.simpleString()
    talk = f"conv_id {kind}, life bigint, numbered bigint, seen timestamp"
    marker = f"conv_id {kind}, life bigint, value string, marker string, n bigint"

    def mask(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = lambda name, n=batch_id: f"{folder}/{name}/batch={n}"
        put = lambda df, name, n=batch_id: df.write.mode("overwrite").parquet(at(name, n))
        since = batch_id // compact * compact

        def state(schema: str, base: str, added: str) -> DataFrame:
            paths = [at(base, since)] * (since > 0) + [at(added, n) for n in range(since, batch_id)]
            return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

        def latest(talks: DataFrame) -> DataFrame:
            newest = F.max(F.struct("life", "numbered", "seen")).alias("t")
            return talks.groupBy("conv_id").agg(newest).select("conv_id", "t.*")

        horizon = None if batch_id == 0 else spark.read.schema("horizon timestamp").parquet(at("state/horizon", batch_id - 1)).first().horizon
        forgotten = lambda seen, now: F.lit(False) if now is None else F.col(seen).cast("timestamp") < F.lit(now) - F.expr(f"INTERVAL {keep}")
        with scope(spark):
            rows = materialize(batch.withColumn("_row", F.monotonically_increasing_id()))
            whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("ts").isNotNull()
            put(rows.where(~whole).drop("_row"), "bad")
            put(rows.where(whole & forgotten("ts", horizon)).drop("_row"), "late")
            good = rows.where(whole & ~forgotten("ts", horizon))
            talks, markers = state(talk, "state/base_talks", "state/talks"), state(marker, "state/base_markers", "markers")
            asked = good.groupBy("conv_id").agg(F.max(F.col("ts").cast("timestamp")).alias("now"))
            held = latest(talks.join(asked.select("conv_id"), "conv_id", "left_semi")).where(~forgotten("seen", horizon))
            asked = asked.join(held, "conv_id", "left").select(
                "conv_id", F.coalesce("life", F.lit(batch_id)).cast("bigint").alias("life"),
                F.coalesce("numbered", F.lit(0)).cast("bigint").alias("numbered"), F.greatest("now", "seen").alias("seen"),
            )
            asked = materialize(asked)
            known = materialize(markers.join(asked.select("conv_id", "life"), ["conv_id", "life"], "left_semi"))
            # The row's number tells messages with the same turn apart.
            turned = good.withColumn("turn", F.struct("turn", "_row"))
            spans = message_spans(turned.select("conv_id", "turn", "text"), first_names, **(options or {}))
            spans = materialize(spans.select("doc_id.*", "start", "end", "entity_type", "value"))
            new = more_markers(spans, known.select("conv_id", "value"), asked.select("conv_id", "numbered"))
            new = materialize(new.join(asked.select("conv_id", "life"), "conv_id").select("conv_id", "life", "value", "marker", "n"))
            marked = spans.join(known.unionByName(new), ["conv_id", "value"]).select("conv_id", "turn", "start", "end", "marker")
            masked = apply_markers(turned, marked, ["conv_id", "turn"])
            put(masked.withColumn("turn", F.col("turn.turn")).select(*batch.columns, "masked_text"), "masked")
            put(new, "markers")
            more = new.groupBy("conv_id").agg(F.max("n").alias("more"))
            after = asked.join(more, "conv_id", "left").select("conv_id", "life", F.coalesce("more", "numbered").alias("numbered"), "seen")
            put(after, "state/talks")
            newest = good.agg(F.greatest(F.max(F.col("ts").cast("timestamp")), F.lit(horizon).cast("timestamp")).alias("horizon"))
            newest = materialize(newest.coalesce(1))
            put(newest, "state/horizon")
            if (batch_id + 1) % compact == 0:
                live = materialize(latest(talks.unionByName(after)).where(~forgotten("seen", newest.first().horizon)))
                put(live, "state/base_talks", batch_id + 1)
                put(markers.unionByName(new).join(live.select("conv_id", "life"), ["conv_id", "life"], "left_semi"), "state/base_markers", batch_id + 1)
                old = [at("state/talks", n) for n in range(since - compact, since) if n >= 0]
                gone = [at(f"state/base_{name}", since - compact) for name in ("talks", "markers")]
                forget(spark, old + gone)

    return messages.writeStream.foreachBatch(mask).option("checkpointLocation", checkpoint).trigger(**trigger).start()
