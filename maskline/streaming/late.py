"""A ledger of event time before a stateful step: what comes too late, or can't be placed, goes to tables of its own.

Spark drops rows behind the watermark before a stateful operator sees them. Here a stream is dealt out first, by the latest
event time of all batches before: rows further back than the watermark's delay go to a side table, rows without event time or
key to another, and all others become the source of the stateful query. That query sees whole batches of the ledger only, so
its watermark is never ahead of the ledger's, and it drops nothing: rows in = rows decided + rows late + rows bad.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from maskline.session import make_folder, materialize, publish, scope


def sort_out(
    rows: DataFrame, ts: str, late: str, folder: str, checkpoint: str, required: tuple[str, ...] = (), **trigger
) -> StreamingQuery:
    """Deals the stream rows out to folder/on_time, folder/late and folder/bad, batch by batch.

    late is the delay of the stateful step's watermark. Bad rows lack `ts` or a required column (column `reason`: the first
    one that is missing). The latest event time so far is kept per batch. A batch that runs again finds what it has
    published and replaces the rest.
    """
    spark = rows.sparkSession
    make_folder(spark, f"{folder}/on_time")
    missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in (ts, *required)])

    def deal(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = lambda name, n=batch_id: f"{folder}/{name}/batch={n}"
        mark = None if batch_id == 0 else spark.read.schema("mark timestamp").parquet(at("mark", batch_id - 1)).first().mark
        with scope(spark):
            told = materialize(batch.withColumn("reason", missing))
            good = told.where("reason IS NULL").drop("reason")
            # The watermark in whole milliseconds, 1970 at the start; what equals it is behind it.
            passed = F.lit(0) if mark is None else F.greatest(F.lit(0), F.unix_millis(F.lit(mark) - F.expr(f"INTERVAL {late}")))
            behind = F.unix_micros(F.col(ts).cast("timestamp")) <= passed * 1000
            told.where("reason IS NOT NULL").write.mode("overwrite").parquet(at("bad"))
            good.where(behind).write.mode("overwrite").parquet(at("late"))
            newest = good.agg(F.greatest(F.max(F.col(ts).cast("timestamp")), F.lit(mark).cast("timestamp")).alias("mark"))
            newest.coalesce(1).write.mode("overwrite").parquet(at("mark"))
            publish(spark, good.where(~behind), at("staging"), at("on_time"))

    return rows.writeStream.foreachBatch(deal).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def on_time(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """What `sort_out` has put on time, as a stream. A trigger takes whole batches of the ledger; it must not be bounded by
    files, as that would cut them."""
    return spark.readStream.schema(schema).parquet(f"{folder}/on_time").drop("batch")
