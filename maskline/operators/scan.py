"""Running totals and positions over groups of any size, one team or conversation holding most rows included.

A window puts a whole group in one task. Here the rows are first cut into blocks of consecutive rows (range
partitioning on a total order, sampled by Spark, written once so that block numbers cannot change), then:
per block and key a small summary, a window over the summaries for what comes before each block, and a window inside
each block. No task holds more than one block of one key; summaries are one row per key and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskline.session import materialize

BLOCK = "_block"
#: Rows of a block at most.
ROWS = 200_000


def ordered_blocks(df: DataFrame, order: list[str], blocks: int | None = None, rows: int | None = None) -> DataFrame:
    """df with a block number that grows with `order`, which must be a total order (end it with a unique id).

    The order is cut into ranges (`blocks`, or as many as Spark sees fit), and a task numbers its rows in order and cuts
    them into blocks of at most `rows` rows (ROWS), so blocks don't grow with the data.
    """
    ranges = df.repartitionByRange(*order) if blocks is None else df.repartitionByRange(blocks, *order)
    placed = ranges.sortWithinPartitions(*order).withColumn(BLOCK, F.monotonically_increasing_id())
    # The number of a row: its partition in the upper bits, its place there in the lower 33.
    inside = F.floor(F.col(BLOCK).bitwiseAND((1 << 33) - 1) / (rows or ROWS))
    return materialize(placed.withColumn(BLOCK, F.shiftright(BLOCK, 33) * (1 << 31) + inside.cast("bigint")))


def running_before(blocked: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the sum of its column over the rows of the same keys that come strictly before (0 if none).

    What comes before a block enters it as one extra row that sorts first, so one window inside the block gives the
    whole total: no join, one shuffle on (keys, block).
    """
    values = blocked.select("*", F.lit(1).alias("_row"), *[c.alias(f"_v_{n}") for n, c in sums.items()])
    totals = values.groupBy(*keys, BLOCK).agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in sums])
    earlier = W.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*keys, BLOCK, F.lit(0).alias("_row"), *[F.sum(f"_v_{n}").over(earlier).alias(f"_v_{n}") for n in sums])
    inside = W.partitionBy(*keys, BLOCK).orderBy("_row", *order).rowsBetween(W.unboundedPreceding, -1)
    united = values.unionByName(carried, allowMissingColumns=True)
    summed = united.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)).alias(n) for n in sums])
    return summed.where("_row = 1").select(*blocked.columns, *sums)


def positions(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with its 1-based position among the rows of the same keys, in `order`."""
    blocked = ordered_blocks(df, [*keys, *order])
    numbered = running_before(blocked, keys, order, {name: F.lit(1)})
    return numbered.withColumn(name, (F.col(name) + 1).cast("bigint")).drop(BLOCK)


def nearest_ranks(df: DataFrame, keys: list[str], value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(keys, p<share in %>): the smallest value that at least the share of the group's values do not exceed; nulls left out.

    Equal values are counted first, and ranks come from blocks: exact, for groups of any size.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = running_before(ordered_blocks(counted, [*keys, value]), keys, [value], {"_before": F.col("_n")})
    sizes = counted.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum("_n").alias("_size"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    rank = lambda share: F.ceil(F.lit(share) * F.col("_size"))
    found = lambda share: F.max(F.when((F.col("_before") < rank(share)) & (rank(share) <= F.col("_before") + F.col("_n")), F.col(value)))
    return ranked.join(sizes, same).groupBy(*keys).agg(*[found(s).alias(f"p{round(s * 100)}") for s in shares])
