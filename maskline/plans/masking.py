"""The masking plan, end to end: detect, filter, merge, number, replace, over all the messages of a conversation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline import fixed_values as fixed
from maskline.operators.detect import detect_all
from maskline.operators.mask import apply_markers, assign_markers
from maskline.operators.plugins import Detector
from maskline.operators.spans import drop_contained, filter_spans, merge_overlaps
from maskline.session import materialize

KEYS = ["conv_id", "turn"]


def message_spans(
    messages: DataFrame,
    first_names: DataFrame | None = None,
    model_spans: DataFrame | None = None,
    entities: list[str] = fixed.MASKED_ENTITIES,
    threshold: float = fixed.SCORE_THRESHOLD,
    language: str = "fr",
    policy: DataFrame | None = None,
    plugins: Sequence[Detector] = (),
) -> DataFrame:
    """Merged spans of every message with the text they cover, one narrow pass over the texts plus one on span rows.

    plugins are the user's detectors; their types have to be among the entities.
    policy (entity_type, action, threshold), a table of a row per type, takes the place of entities and threshold. Weak
    spans go first: a span never drops one that scores higher. What is left is shuffled once, by message.
    """
    if policy is not None:
        policy = policy.where("action = 'MASK'")
        entities = [r["entity_type"] for r in policy.select("entity_type").distinct().collect()]
    docs = messages.select(F.struct(*KEYS).alias("doc_id"), F.lit(language).alias("lang"), "text")
    found = detect_all(docs, first_names, entities, plugins=plugins)
    if model_spans is not None:
        found = found.unionByName(model_spans, allowMissingColumns=True)
    if policy is None:
        strong = found.where(F.col("entity_type").isin(entities) & (F.col("score") >= threshold))
    else:
        strong = filter_spans(found, policy)
    return merge_overlaps(drop_contained(strong.repartition("doc_id")))


def mask_conversations(
    messages: DataFrame, first_names: DataFrame | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """(masked messages, marker table).

    Detection runs once: its merged spans, with the text they cover, are written to the shared folder. The messages
    themselves are shuffled once, to meet their markers.
    """
    merged = message_spans(messages, first_names, **options)
    spans = materialize(merged.select("doc_id.*", "start", "end", "entity_type", "score", "value"))
    markers = assign_markers(spans)
    marked = spans.join(markers, ["conv_id", "value"]).select(*KEYS, "start", "end", "marker")
    return apply_markers(messages, marked, KEYS), markers
