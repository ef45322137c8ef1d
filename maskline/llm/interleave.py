"""Shards that each hold the mixture of the whole: proportional stratified interleaving, with DataFrame operations only.

Rows get a rank within their source after a seeded shuffle. Sorted by fractional rank, (rank - 1/2) / rows of the
source, every stretch of the order holds each source in its share; the order is cut into runs whose row counts differ by
one at most. Ranks of a source that holds a third of the rows are counted over blocks of a range partitioning, never in
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.operators.scan import positions


def shuffle_key(seed: int):
    """60 bits of a digest of the id and the seed; the same in any engine that has md5."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def interleaved_shards(docs: DataFrame, shards: int = 8, seed: int = 7) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of docs (doc_id, text, source).

    The law is `rows`: counts of shards differ by one at most; slot counts from 0 within a shard; grown_shard is null. A
    null text has no bytes (size 1, checksum 0), like an empty one. A null source is a source of its own, a null id sorts
    first; rows alike in everything stand next to each other. Equal texts form no groups here: each row is placed by itself.
    An empty table gives none.
    """
    bytes_of = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(bytes_of) + 1).cast("bigint").alias("size"),
        F.crc32(bytes_of).alias("text_crc32"),
    ).withColumn("key", shuffle_key(seed))
    tie = ["key", "doc_id", "text_crc32", "size"]
    ranked = positions(rows, ["source"], tie, "rank")
    # One row per source.
    sources = ranked.groupBy("source").agg(F.max("rank").alias("rows"))
    joined = ranked.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    fraction = (2 * F.col("rank") - 1).cast("double") / (2 * F.col("rows")).cast("double")
    ordered = joined.select("r.*", fraction.alias("fraction"))
    placed = positions(ordered, [], ["fraction", "source", *tie], "place")
    total = rows.agg(F.count("*").alias("total"))
    # total is one row.
    cut = placed.crossJoin(F.broadcast(total)).withColumn("shard", F.expr(f"((place - 1) * {shards}) div total").cast("int"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return cut.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("place") - 1 - first).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
