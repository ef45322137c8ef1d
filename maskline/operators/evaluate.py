"""Detector evaluation: gold spans (doc_id, entity_type, start, end, value) against predicted spans.

Overlap tests never list pairs: a sweep over sorted ends gives each span whether any span of the other side overlaps
it. Where pairs are the result, spans are cut into position bins, so that a join only meets neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskline.operators.scan import ordered_blocks, running_before

BIN = 64


def flag_overlapped(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """left with a boolean: does a span of right, same text and type, overlap it?

    In the order of positions, a right span enters at its start and a left span asks at its end: the furthest end
    among the right spans that entered strictly before must lie beyond the left start. One sort per text and type.
    """
    asks = left.select("*", F.col("end").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("int").alias("_reach"))
    enters = right.select(
        "doc_id", "entity_type", F.col("start").alias("_at"), F.lit(1).alias("_kind"), F.col("end").alias("_reach")
    )
    # At the same position the question comes first: a span that starts where another ends does not overlap it.
    sweep = (
        W.partitionBy("doc_id", "entity_type").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    swept = asks.unionByName(enters, allowMissingColumns=True).withColumn("_far", F.max("_reach").over(sweep))
    return swept.where("_kind = 0").select(*left.columns, F.coalesce(F.col("_far") > F.col("start"), F.lit(False)).alias(name))


def _binned(spans: DataFrame) -> DataFrame:
    low, high = F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN)
    return spans.where("end > start").withColumn("_bin", F.explode(F.sequence(low, high)))


def match_spans(gold: DataFrame, spans: DataFrame, by_type: bool = True) -> DataFrame:
    """Pairs of overlapping gold and predicted spans of a text (and type): an interval join on (text, bin).

    A pair that shares several bins is kept in the bin where the later of the two starts.
    """
    g = _binned(gold).select(
        "doc_id", "_bin", F.col("entity_type").alias("gold_type"), F.col("start").alias("gold_start"), F.col("end").alias("gold_end")
    )
    p = _binned(spans).select(
        "doc_id", "_bin", F.col("entity_type").alias("pred_type"), F.col("start").alias("pred_start"), F.col("end").alias("pred_end")
    )
    pairs = g.join(p, ["doc_id", "_bin"]).where(
        (F.col("gold_start") < F.col("pred_end"))
        & (F.col("pred_start") < F.col("gold_end"))
        & (F.floor(F.greatest("gold_start", "pred_start") / BIN) == F.col("_bin"))
    )
    if by_type:
        pairs = pairs.where("gold_type = pred_type")
    return pairs.drop("_bin")


def span_counts(gold: DataFrame, spans: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """gold, found, predicted, correct per type (and per `extra` columns of both sides, such as the layer)."""
    keys = [*(extra or []), "entity_type"]
    if extra:
        # One evaluation per layer: the layer becomes part of the text's key.
        gold = gold.withColumn("doc_id", F.struct(*extra, "doc_id"))
        spans = spans.withColumn("doc_id", F.struct(*extra, "doc_id"))
    zero = F.lit(0)
    found = flag_overlapped(gold, spans, "hit").select(
        *keys, F.lit(1).alias("gold"), F.col("hit").cast("int").alias("found"), zero.alias("predicted"), zero.alias("correct")
    )
    correct = flag_overlapped(spans, gold, "hit").select(
        *keys, zero.alias("gold"), zero.alias("found"), F.lit(1).alias("predicted"), F.col("hit").cast("int").alias("correct")
    )
    counters = ["gold", "found", "predicted", "correct"]
    return found.unionByName(correct).groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in counters])


def _ratio(part: str, whole: str) -> Column:
    return F.col(part) / F.when(F.col(whole) != 0, F.col(whole))


def scores_per_type(gold: DataFrame, spans: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Per type: the four counts, recall, and precision (null when nothing was predicted)."""
    return span_counts(gold, spans, extra).withColumns(
        {"recall": _ratio("found", "gold"), "precision": _ratio("correct", "predicted")}
    )


def scores_overall(gold: DataFrame, spans: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Micro precision (0 when nothing was predicted), recall and F1 over the summed counts."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("gold", "found", "predicted", "correct")]
    totals = span_counts(gold, spans, extra).groupBy(*(extra or [])).agg(*sums)
    scored = totals.withColumns(
        {"precision": F.coalesce(_ratio("correct", "predicted"), F.lit(0.0)), "recall": _ratio("found", "gold")}
    )
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both != 0, 2 * F.col("precision") * F.col("recall") / F.when(both != 0, both)).otherwise(0.0)
    return scored.withColumn("f1", f1)


def gold_with_clear(gold: DataFrame, spans: DataFrame) -> DataFrame:
    """Gold items with `masked`: every character that is not a space lies in a predicted span, whatever its type.

    Characters in clear are what is left of the value between the predicted spans that overlap it.
    """
    g = gold.withColumn("_id", F.struct("doc_id", "entity_type", "start", "end"))
    pieces = _binned(g).select("_id", "doc_id", "_bin", "start", "end")
    covers = _binned(spans).select("doc_id", "_bin", F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    met = pieces.join(covers, ["doc_id", "_bin"]).where("start < p_end AND p_start < end")
    # Few spans overlap one item; the set drops those met in several bins.
    per_item = met.groupBy("_id").agg(F.array_sort(F.collect_set(F.struct("p_start", "p_end"))).alias("_covers"))
    joined = g.join(per_item, "_id", "left")
    # Walk the covers in order; `at` is the first position that no cover has reached yet, `clear` what was skipped.
    walked = F.aggregate(
        F.coalesce("_covers", F.array().cast("array<struct<p_start:int,p_end:int>>")),
        F.struct(F.col("start").alias("at"), F.lit("").alias("clear")),
        lambda acc, c: F.struct(
            F.greatest(acc["at"], F.least(c["p_end"], F.col("end"))).alias("at"),
            F.concat(
                acc["clear"],
                F.when(
                    c["p_start"] > acc["at"],
                    F.substring(F.col("value"), acc["at"] - F.col("start") + 1, c["p_start"] - acc["at"]),
                ).otherwise(""),
            ).alias("clear"),
        ),
        lambda acc: F.concat(
            acc["clear"], F.substring(F.col("value"), acc["at"] - F.col("start") + 1, F.length("value"))
        ),
    )
    return joined.select(*gold.columns, (~walked.rlike(r"(?U)\S")).alias("masked"))


def fully_masked(gold: DataFrame, spans: DataFrame) -> DataFrame:
    """Number and share of gold items with no character left in clear."""
    return gold_with_clear(gold, spans).agg(
        F.count("*").alias("items"),
        F.count_if("masked").alias("masked"),
        F.avg(F.col("masked").cast("double")).alias("share"),
    )


def left_in_clear(gold: DataFrame, spans: DataFrame) -> DataFrame:
    return gold_with_clear(gold, spans).where("NOT masked").select("doc_id", "entity_type", "value")


def gold_counts(gold: DataFrame) -> DataFrame:
    return gold.groupBy("entity_type").agg(F.count("*").alias("items"))


def compare_layers(gold: DataFrame, spans: DataFrame, layers: list[str]) -> DataFrame:
    """Recall and items left in clear per type, one column per layer of `spans` (doc_id, ..., layer).

    The layers are read in one pass: gold is repeated per layer, and the layer is part of every key.
    """
    repeated = gold.withColumn("layer", F.explode(F.array(*map(F.lit, layers))))
    recall = span_counts(repeated, spans, ["layer"]).where("gold > 0").withColumn("recall", _ratio("found", "gold"))
    recalls = recall.groupBy("entity_type").pivot("layer", layers).agg(F.first("recall"))
    keyed = [df.withColumn("doc_id", F.struct("layer", "doc_id")) for df in (repeated, spans)]
    left = gold_with_clear(*keyed).where("NOT masked").groupBy("entity_type").pivot("layer", layers).agg(F.count(F.lit(1)))
    named_recall = recalls.select("entity_type", *[F.col(x).alias(f"recall_{x}") for x in layers])
    named_left = left.select("entity_type", *[F.coalesce(x, F.lit(0)).alias(f"left_{x}") for x in layers])
    return named_recall.join(named_left, "entity_type", "left").na.fill(0, [f"left_{x}" for x in layers])


def layer_scores(gold: DataFrame, spans: DataFrame, layers: list[str]) -> DataFrame:
    """Per layer: precision, recall, share of items fully masked, items left in clear."""
    repeated = gold.withColumn("layer", F.explode(F.array(*map(F.lit, layers))))
    scored = scores_overall(repeated, spans, ["layer"]).select("layer", "precision", "recall")
    keyed = [df.withColumn("doc_id", F.struct("layer", "doc_id")) for df in (repeated, spans)]
    masked = gold_with_clear(*keyed).groupBy("layer").agg(
        F.avg(F.col("masked").cast("double")).alias("fully_masked"), F.count_if(~F.col("masked")).alias("left_in_clear")
    )
    return scored.join(masked, "layer")


def report_sections(gold: DataFrame, spans: DataFrame, durations: DataFrame, layers: list[str]) -> dict[str, DataFrame]:
    """The tables behind a report, by name: overall scores, scores per type, latencies, items left in clear and layers.

    spans (doc_id, ..., layer) holds each layer's spans; the last layer is the one that is reported as a whole. durations
    (variant, ms) are those of each variant that was timed.
    """
    whole = spans.where(F.col("layer") == layers[-1]).drop("layer")
    return {
        "scores": scores_overall(gold, whole),
        "per_type": scores_per_type(gold, whole),
        "latency": latency_percentiles(durations),
        "left_in_clear": left_in_clear(gold, whole),
        "layers": layer_scores(gold, spans, layers),
    }


def compare_corpora(gold: DataFrame, spans: DataFrame) -> DataFrame:
    """Scores of the tuned and the held-out corpus (column `corpus`) and their difference per type."""
    scored = scores_per_type(gold, spans, ["corpus"])
    return scored.groupBy("entity_type").agg(
        F.max(F.when(F.col("corpus") == "tuned", F.col("recall"))).alias("recall_tuned"),
        F.max(F.when(F.col("corpus") == "held_out", F.col("recall"))).alias("recall_held_out"),
    ).withColumn("recall_delta", F.col("recall_held_out") - F.col("recall_tuned"))


def latency_percentiles(durations: DataFrame, key: str = "variant", value: str = "ms", shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Exclusive quantiles (position p * (n + 1), linear between neighbours), exact, for groups of any size.

    Equal durations are counted first; a scan in blocks gives each distinct duration the ranks it holds, and only the
    two around each position are kept.
    """
    counted = durations.groupBy(key, value).agg(F.count("*").alias("_n"))
    blocked = ordered_blocks(counted, [key, value])
    ranked = running_before(blocked, [key], [value], {"_before": F.col("_n")})
    sizes = blocked.groupBy(key).agg(F.sum("_n").alias("_size"))
    joined = ranked.join(sizes, key)
    columns = []
    for share in shares:
        # Position from 1, kept within the first and the last pair of neighbours.
        position = F.lit(share) * (F.col("_size") + 1)
        low = F.greatest(F.least(F.floor(position), F.col("_size") - 1), F.lit(1))
        part = F.when(F.col("_size") == 1, 0.0).otherwise(position - low)
        holds = lambda rank: (F.col("_before") < rank) & (rank <= F.col("_before") + F.col("_n"))
        at_low = F.max(F.when(holds(low), F.col(value)))
        at_high = F.max(F.when(holds(F.least(low + 1, F.col("_size"))), F.col(value)))
        columns.append((at_low + (at_high - at_low) * F.max(part)).alias(f"p{round(share * 100)}"))
    return joined.groupBy(key).agg(*columns)


def latency_added(durations: DataFrame, without: str, masked: str) -> DataFrame:
    """Percentiles with and without masking, and what masking adds."""
    per_variant = latency_percentiles(durations)
    pick = lambda v, p: F.max(F.when(F.col("variant") == v, F.col(p)))
    return per_variant.agg(
        *[pick(v, p).alias(f"{p}_{n}") for n, v in (("without", without), ("masked", masked)) for p in ("p50", "p95")],
        *[(pick(masked, p) - pick(without, p)).alias(f"{p}_added") for p in ("p50", "p95")],
    )


def parse_model_entities(answers: DataFrame, entities: list[str]) -> DataFrame:
    """Model answers (answer_id, status, done_reason, content) -> rows (answer_id, entity_type, value) + invalid flag.

    Unusable: failed call, cut answer, invalid JSON, no `entities` list. Unknown types and empty values are skipped.
    One row per usable item; an answer without item gives one row of nulls, so that nothing is lost.
    """
    parsed = F.try_parse_json("content")
    items = F.try_variant_get(parsed, "$.entities", "array<variant>")
    invalid = (F.col("status") != 200) | F.coalesce(F.col("done_reason") == "length", F.lit(False)) | items.isNull()
    typed = F.transform(
        items,
        lambda v: F.struct(
            F.coalesce(F.try_variant_get(v, "$.type", "string"), F.lit("")).alias("entity_type"),
            F.trim(F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit(""))).alias("value"),
        ),
    )
    usable = F.filter(typed, lambda i: i["entity_type"].isin(entities) & (i["value"] != ""))
    flagged = answers.withColumn("invalid", invalid).withColumn("_items", F.when(~F.col("invalid"), usable))
    return flagged.select(
        *answers.columns, "invalid", F.explode_outer("_items").alias("_item")
    ).select(*[c for c in answers.columns if c != "content"], "invalid", "_item.entity_type", "_item.value")


def answer_quality(answers: DataFrame) -> DataFrame:
    """Per model: unusable answers, values that are not in the text, mean tokens per text.

    `answers`: (model, invalid, not_in_text, tokens_in, tokens_out), one row per text.
    """
    return answers.groupBy("model").agg(
        F.count("*").alias("texts"),
        F.count_if("invalid").alias("unusable"),
        F.sum("not_in_text").cast("bigint").alias("not_in_text"),
        F.avg(F.col("tokens_in") + F.col("tokens_out")).alias("tokens_per_text"),
    )


def cost_per_1000(answers: DataFrame, prices: DataFrame) -> DataFrame:
    """Price of 1,000 texts per model; null when the model is not an alias with a price."""
    sums = answers.groupBy("model", "alias").agg(
        F.count("*").alias("texts"), F.sum("tokens_in").alias("_in"), F.sum("tokens_out").alias("_out")
    )
    priced = sums.join(prices.select("alias", "price_in", "price_out"), "alias", "left")
    total = F.col("_in") * F.col("price_in") + F.col("_out") * F.col("price_out")
    return priced.select("model", "texts", (total * 1000 / F.col("texts")).cast("double").alias("cost_per_1000"))
