"""Masking with numbered markers that are stable over a conversation, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline import fixed_values as fixed
from maskline.functions.patterns import ANSWER_MARKER
from maskline.functions.text import CLOSE, OPEN, let, neutral, replace_spans_sql
from maskline.operators.scan import positions


def span_values(messages: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Merged spans with the text they cover."""
    return spans.join(messages.select(*keys, "text"), keys).select(
        *spans.columns, F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("value")
    )


def assign_markers(spans: DataFrame) -> DataFrame:
    """Merged spans (conv_id, turn, start, entity_type, value) -> (conv_id, value, marker, n).

    Distinct values of a conversation are numbered by first occurrence; the type of the first occurrence names the
    marker. Pre-aggregated per value, then numbered in blocks: a conversation of any size is never one task.
    """
    first = spans.groupBy("conv_id", "value").agg(F.min(F.struct("turn", "start", "entity_type")).alias("first"))
    flat = first.select("conv_id", "value", "first.*")
    numbered = positions(flat, ["conv_id"], ["turn", "start"], "n")
    return numbered.select(
        "conv_id", "value", F.format_string("<%s_%d>", "entity_type", "n").alias("marker"), "n"
    )


def more_markers(spans: DataFrame, known: DataFrame, numbered: DataFrame) -> DataFrame:
    """(conv_id, value, marker, n) of the values of spans that are not among the known ones (conv_id, value): `assign_markers`
    for conversations that go on. numbered (conv_id, numbered) has how many a conversation has so far."""
    first = spans.groupBy("conv_id", "value").agg(F.min(F.struct("turn", "start", "entity_type")).alias("first"))
    new = first.join(known.select("conv_id", "value"), ["conv_id", "value"], "left_anti").select("conv_id", "value", "first.*")
    placed = positions(new, ["conv_id"], ["turn", "start"], "place").join(numbered, "conv_id", "left")
    n = (F.coalesce("numbered", F.lit(0)) + F.col("place")).cast("bigint").alias("n")
    return placed.select("conv_id", "value", "entity_type", n).select(
        "conv_id", "value", F.format_string("<%s_%d>", "entity_type", "n").alias("marker"), "n"
    )


def apply_markers(messages: DataFrame, marked: DataFrame, keys: list[str]) -> DataFrame:
    """Messages with each span of `marked` (keys, start, end, marker) replaced; messages without span unchanged."""
    per_message = marked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "marker"))).alias("_spans"))
    joined = messages.join(per_message, keys, "left")
    return joined.withColumn("masked_text", F.expr(replace_spans_sql("text", "_spans", "marker"))).drop("_spans")


def anonymize_plain(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans replaced by `<TYPE>`, without number."""
    marked = spans.select("doc_id", "start", "end", F.concat(F.lit("<"), "entity_type", F.lit(">")).alias("marker"))
    return apply_markers(docs, marked, ["doc_id"])


def masked_entity_count(spans: DataFrame, key: str = "conv_id") -> DataFrame:
    """Masked spans per type, after merging; a value masked twice counts twice."""
    return spans.groupBy(key, "entity_type").agg(F.count("*").alias("masked"))


def with_values(answer: Column, values: Column) -> Column:
    """The answer with its markers, in order, replaced by `values` (array of struct with field `v`)."""
    pieces = F.split(F.regexp_replace(neutral(answer), F.lit(f"({ANSWER_MARKER})"), F.lit(f"{OPEN}$1{CLOSE}")), OPEN)

    def back(piece: Column, i: Column) -> Column:
        rest = F.substring_index(piece, CLOSE, -1)
        return F.when(i == 0, piece).otherwise(F.concat(F.get(values, i - 1)["v"], rest))

    restored = let(pieces, lambda p: F.array_join(F.transform(p, back), ""))
    return F.when(values.isNull(), answer).otherwise(restored)


def unmask_answers(answers: DataFrame, markers: DataFrame) -> DataFrame:
    """Answers (answer_id, conv_id, text) with the values of their conversation put back.

    Only the markers an answer names, with their place, are joined on (conversation, marker): a conversation with many
    answers is spread over its markers. A marker that the conversation does not know stays as it is.
    """
    named = answers.select(
        "answer_id", "conv_id",
        F.posexplode(F.regexp_extract_all("text", F.lit(f"({ANSWER_MARKER})"), F.lit(1))).alias("nth", "marker"),
    )
    known = named.join(markers.select("conv_id", "marker", "value"), ["conv_id", "marker"], "left")
    values = known.groupBy("answer_id").agg(
        F.array_sort(F.collect_list(F.struct("nth", F.coalesce("value", "marker").alias("v")))).alias("_values")
    )
    return answers.join(values, "answer_id", "left").withColumn(
        "unmasked_text", with_values(F.col("text"), F.col("_values"))
    ).drop("_values")


def unmask_chunks(chunks: DataFrame, markers: DataFrame) -> DataFrame:
    """Batch twin of the streamed answers: chunks (answer_id, conv_id, seq, chunk) joined in order, then unmasked."""
    whole = chunks.groupBy("answer_id", "conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda c: c["chunk"]), "").alias("text")
    )
    return unmask_answers(whole, markers)


def masking_decision(requests: DataFrame, teams: DataFrame) -> DataFrame:
    """Is the request masked? Required team: always; optional team: only on request; no team: yes."""
    choice = teams.select(F.col("team_id").alias("team"), "pii_masking")
    decided = F.when(F.col("pii_masking") == "optional", F.coalesce("asks_masking", F.lit(False))).otherwise(True)
    return requests.join(choice, "team", "left").withColumn("masked", decided)


def redact_messages(calls: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Calls without their messages: input and output replaced, metadata entries kept by allow-list."""
    return (
        calls.withColumn("input", F.lit(fixed.REDACTED))
        .withColumn("output", F.lit(fixed.REDACTED))
        .withColumn("metadata", F.map_filter("metadata", lambda k, _: k.isin(*keep)))
    )
