"""Exact dedup by an extendible-hash index on shared files, with DataFrame operations only.

A text is looked up by the 64-bit hash of its normal form (every run of blanks one space). The index has one entry per
hash: how many rows have it and the smallest id among them; these are sums with map-side parts, so a text that a third
of the rows share is one entry before it is shuffled.

Entries lie in buckets. A bucket holds the hashes that begin with the same bits, as many bits as its local depth; one with
more than `capacity` entries is split by its next bit. The directory has a slot for each value of the first bits of a hash,
as many as its depth, and doubles with the number of entries; it says how deep the bucket of a slot is. Where a slot is
still overfull, its buckets are split by bits beyond the directory's depth, as many as it takes. Entries are written to
the shared folder in ranges of buckets, each owned by a task.

A row goes through the directory: its first bits name the slot, the slot's local depth its bucket, and it meets entries of
that bucket only. Rows that meet a shared entry form its chain, and their bytes are compared with those of the chain's
first row. Where two texts collide, the chain is settled by the bytes themselves.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline.llm.common import id_and_text, partitions, squeezed
from maskline.session import materialize

#: Bits of a hash, and with that the deepest that a bucket can be.
BITS = 64


def first_bits(h: str, n: str) -> str:
    """The first n bits of a hash, as a number; a shift by all 64 would be one by none."""
    return f"IF({n} = 0, 0L, shiftrightunsigned({h}, {BITS} - {n}))"


def directory(entries: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """((slot, local_depth), depth) over the slots in use by entries (h).

    Up to the directory's depth, the bucket of a slot is the shortest beginning whose entries fit. A slot that is overfull by
    itself has a local depth beyond, the least at which all that its hashes are cut into fits.
    """
    n = entries.count()
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, n / capacity)))) + 3)
    slotted = entries.select("h", F.expr(first_bits("h", f"{depth}")).alias("slot"))
    slots = materialize(slotted.groupBy("slot").agg(F.count("*").alias("n")))
    levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local_depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {depth} - local_depth)"))
    fits = levels.groupBy("local_depth", "prefix").agg(F.sum("n").alias("total")).where(F.col("total") <= capacity)
    found = levels.join(fits, ["local_depth", "prefix"]).groupBy("slot").agg(F.min("local_depth").alias("local_depth"))
    if depth == BITS:
        return found, depth
    # Few entries, if hashes are even: those of slots that hold more than a bucket.
    overfull = slotted.join(slots.where(F.col("n") > capacity).select("slot"), "slot", "left_semi")
    deeper = overfull.select("h", "slot", F.explode(F.sequence(F.lit(depth + 1), F.lit(BITS))).alias("local_depth"))
    cut = deeper.groupBy("slot", "local_depth", F.expr(first_bits("h", "local_depth")).alias("prefix")).agg(F.count("*").alias("n"))
    most = cut.groupBy("slot", "local_depth").agg(F.max("n").alias("most")).where(F.col("most") <= capacity)
    return found.unionByName(most.groupBy("slot").agg(F.min("local_depth").alias("local_depth"))), depth


def in_bucket(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """rows (h, ...) with local_depth and bucket, by a look into the directory. Spark sends the directory to all tasks where
    it is small, and deals both by slot where it is not."""
    slotted = rows.withColumn("slot", F.expr(first_bits("h", f"{depth}")))
    return slotted.join(slots, "slot").withColumn("bucket", F.expr(first_bits("h", "local_depth"))).drop("slot")


def exact_groups(docs: DataFrame, capacity: int = 200_000, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs (doc_id, text).

    A null text is the empty text, and empty texts equal each other. Rows without an id never stay when the group has
    one with an id; keep_id is null only if no row of the group has an id. Rows that repeat an id and a text are equal
    texts like any other: each counts, and all that carry keep_id are marked kept. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs).withColumn("norm", squeezed(F.col("text"))).drop("text").withColumn("h", hash_of(F.col("norm")))
    leaves = materialize(rows.select("h", "doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")))
    entries = leaves.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = materialize(entries)
    slots, depth = directory(entries.select("h"), capacity)
    slots = materialize(slots)
    index = in_bucket(entries, slots, depth)
    # A bucket's hashes follow each other in the order of unsigned numbers.
    by_key = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    index = materialize(index.repartitionByRange(partitions(spark), by_key).sortWithinPartitions("local_depth", "bucket", "h"))

    chains = index.where("group_size > 1").select("h")
    # One plan at every size: chains grow with the input, so they are merged and not sent to every task.
    members = materialize(rows.join(chains.hint("merge"), "h").select("h", "doc_id", "norm"))
    by_id = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "norm")
    heads = members.groupBy("h").agg(F.min(by_id).alias("head")).select("h", F.col("head.norm").alias("head"))
    # Written, so that the join below is between two shuffles and Spark can split a chain that is long.
    heads = materialize(heads)
    collided = members.join(heads.hint("merge"), "h").where("norm <> head").select("h").distinct()
    same = in_bucket(leaves, slots, depth).join(index, ["local_depth", "bucket", "h"])
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    if collided.isEmpty():
        return same.select(*columns)
    collided = materialize(collided)
    odd = members.join(collided, "h", "left_semi")
    settled = odd.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    apart = odd.join(settled, ["h", "norm"]).withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    return same.join(collided, "h", "left_anti").select(*columns).unionByName(apart.select(*columns))
