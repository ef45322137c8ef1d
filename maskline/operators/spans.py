"""Span algebra on span rows. All windows are per text: a group is bounded by the length of one text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskline import fixed_values as fixed
from maskline.functions.text import words as words_of
from maskline.operators.detect import boosted, context_word_in, near_words, sql_array
from maskline.operators.search import places_in


def apply_check_digits(spans: DataFrame) -> DataFrame:
    """checksum true -> score 1.0, false -> row dropped, null (no check) -> unchanged."""
    return spans.where(F.coalesce("checksum", F.lit(True))).withColumn(
        "score", F.when(F.col("checksum"), F.lit(1.0)).otherwise(F.col("score"))
    )


def boost_by_context(docs: DataFrame, spans: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """Score raised when a context word of the recognizer is near; `words` maps recognizer to its ordered words."""
    texts = docs.select("doc_id", "text")
    joined = spans.drop("context_word").join(texts, "doc_id")
    n = fixed.CONTEXT_WORDS_BEFORE
    # The last words are nearly always in the end of what comes before; only if not is all of it cut into words.
    end = F.substring("text", F.greatest(F.col("start") - 40 * n + 1, F.lit(1)), F.least(F.col("start"), F.lit(40 * n)))
    before = F.when(F.size(words_of(end)) > n, end).otherwise(F.substring("text", F.lit(1), F.col("start")))
    value = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    listed = F.expr(sql_array([]))
    for recognizer, its_words in words.items():
        listed = F.when(F.col("recognizer") == recognizer, F.expr(sql_array(its_words))).otherwise(listed)
    word = context_word_in(near_words(before, value), listed)
    return joined.withColumn("context_word", word).withColumn(
        "score", boosted(F.col("score"), F.col("context_word"))
    ).drop("text")


def filter_spans(spans: DataFrame, policy: DataFrame) -> DataFrame:
    """Spans of the policy's types with score >= threshold. To be run before merge_overlaps."""
    return spans.join(policy.select("entity_type", "threshold"), "entity_type").where("score >= threshold").drop("threshold")


def drop_contained(spans: DataFrame) -> DataFrame:
    """Drops a span contained in another of its type that has a higher score, or the same score and is longer.

    Of equal spans one stays. All ranks before a rank are at most one block of ranks on each level of a binary tree:
    where bit b of a span's rank is set, it is compared with the spans of the block before its own on level b, by the
    furthest end among those that start no later. So a span is one row per level, not one per better score.
    """
    group = [F.col("doc_id"), F.col("entity_type")]
    tie = [c for c in ("recognizer", "value") if c in spans.columns]
    by_score = W.partitionBy(*group).orderBy(F.desc("score"))
    ranked = spans.withColumn("_rank", (F.dense_rank().over(by_score) - 1).cast("bigint"))
    ranked = ranked.withColumn("_id", F.row_number().over(W.partitionBy(*group).orderBy("_rank", "start", F.desc("end"), *tie)))
    ranked = ranked.withColumn("_most", F.max("_rank").over(W.partitionBy(*group)))
    # Level -1 is the span's own rank.
    levels = F.sequence(F.lit(-1), F.length(F.bin("_most")) - 1)
    leveled = ranked.withColumn("_level", F.explode(levels))
    own = F.col("_level") < 0
    asks = F.when(own, True).otherwise(F.expr("shiftright(_rank, greatest(_level, 0)) % 2 = 1"))
    block = F.when(own, F.col("_rank")).otherwise(F.expr("shiftright(_rank, greatest(_level, 0) + 1)"))
    leveled = leveled.withColumn("_asks", asks).withColumn("_block", block)
    # On level -1 everything before in this order is a container; elsewhere what doesn't ask is.
    told = F.when(own | ~F.col("_asks"), F.col("end"))
    before = W.partitionBy(*group, "_level", "_block").orderBy("start", "_asks", F.desc("end"), "_id").rowsBetween(W.unboundedPreceding, -1)
    reached = leveled.withColumn("_reach", F.when(F.col("_asks"), F.max(told).over(before)))
    kept = reached.groupBy(*group, "_id").agg(
        F.max(F.coalesce(F.col("_reach") >= F.col("end"), F.lit(False))).alias("_inside"), F.first(F.struct(*spans.columns)).alias("_span")
    )
    # The keys themselves, so that Spark knows that the rows are still where the keys put them.
    keys = ("doc_id", "entity_type")
    return kept.where("NOT _inside").select(*[c if c in keys else F.col("_span")[c].alias(c) for c in spans.columns])


def merge_overlaps(spans: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One span per group of transitively overlapping spans: union of the positions, type and score of the main one.

    Main: longest, then highest score, then last type in alphabetical order. Spans that only touch stay apart.
    One shuffle on the keys; the grouping that follows keeps its partitioning. When the spans carry their `value`, the
    value of the union is put together from them, so that the text is not needed again.
    """
    ordered = W.partitionBy(*keys).orderBy("start", "end", "entity_type", "score")
    reach = F.max("end").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    flagged = spans.withColumn("_new", F.when(F.col("start") < reach, 0).otherwise(1))
    grouped = flagged.withColumn("_group", F.sum("_new").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    rank = F.struct((F.col("end") - F.col("start")).alias("length"), F.col("score"), F.col("entity_type"))
    wanted = [F.min("start").alias("start"), F.max("end").alias("end"), F.max(rank).alias("main")]
    if "value" in spans.columns:
        wanted.append(F.array_sort(F.collect_set(F.struct("start", "end", "value"))).alias("_parts"))
    merged = grouped.groupBy(*keys, "_group").agg(*wanted)
    out = [*keys, "start", "end", F.col("main.entity_type").alias("entity_type"), F.col("main.score").alias("score")]
    if "value" in spans.columns:
        out.append(_union_value(F.col("_parts"), F.col("start")).alias("value"))
    return merged.select(*out)


def _union_value(parts: Column, start: Column) -> Column:
    """Text of overlapping parts (sorted by start): of each part, what lies beyond the ones before."""

    def extend(acc: Column, part: Column) -> Column:
        beyond = F.substring(part["value"], acc["end"] - part["start"] + 1, F.length(part["value"]))
        return F.when(
            part["end"] > acc["end"],
            F.struct(F.concat(acc["text"], beyond).alias("text"), part["end"].alias("end")),
        ).otherwise(acc)

    return F.aggregate(parts, F.struct(F.lit("").alias("text"), start.alias("end")), extend, lambda acc: acc["text"])


#: Values of a text that are looked for at once; rows of an output batch.
VALUES, ROWS = 10_000, 1 << 15


def locate_values(docs: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, entity_type, value) -> spans at every position of the value, exact, else ignoring case.

    A value that is not in its text, an empty or a null one gives one row at (-1, -1): a prediction that masks nothing. All
    values of a text, VALUES at a time, are found in one pass over it.
    """
    each = W.partitionBy("doc_id").orderBy("entity_type", "value")
    part = F.floor((F.row_number().over(each) - 1) / VALUES).alias("_part")
    grouped = values.select("doc_id", "entity_type", "value", part).groupBy("doc_id", "_part").agg(
        F.collect_list(F.struct("entity_type", "value")).alias("_values")
    )
    kind = values.schema["doc_id"].dataType.simpleString()
    joined = grouped.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "text", "_values")
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
            at, *columns = (list(c) for c in zip(*rows, strict=True))
            types = [pa.string(), pa.string(), pa.int32(), pa.int32()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at)), *arrays], names=["doc_id", "entity_type", "value", "start", "end"])

        for batch in batches:
            rows: list[tuple] = []
            for k in range(len(batch)):
                wanted = batch["_values"][k].as_py()
                for v, found in zip(wanted, places_in(batch["text"][k].as_py(), [v["value"] for v in wanted]), strict=True):
                    own = k, v["entity_type"], v["value"]
                    for start in found or [-1]:
                        rows.append((*own, start, start + len(v["value"]) if found else -1))
                        if len(rows) == ROWS:
                            yield told(batch, rows)
                            rows = []
            if rows:
                yield told(batch, rows)

    return joined.mapInArrow(locate, f"doc_id {kind}, entity_type string, value string, start int, end int")
