"""A stream of file rows into the stored table of files, by content hash (INC-2, INC-3 as a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from srclake import schemas
from srclake.operators import incremental
from srclake.plans.lineage import stable
from srclake.sources import stores

STREAM = schemas.SOURCE_FILES + ", ingested_at timestamp"


def read(spark: SparkSession, folder: str, fmt: str = "json") -> DataFrame:
    """File rows as they arrive in a folder."""
    return spark.readStream.schema(STREAM).format(fmt).load(folder)


#: Parts of the stored table by hash of the file's key; a batch rewrites those that it touches.
PARTS = 64


def sync(files: DataFrame, store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each batch's last row of a file replaces the stored one if its content differs; what changed goes to "changes".

    Changes are written first, in a folder of their batch. A batch that is run again after a fault finds them there and
    takes them as they are, so none is lost or doubled, and puts the same rows into the table again.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64("repo_id", "rel_path"), F.lit(PARTS)).cast("int")
        fresh = stable(stores.latest_by(batch, ["repo_id", "rel_path"], [F.col("ingested_at").desc_nulls_last(), F.md5(F.coalesce("content", F.lit("")))]).withColumn("part", part))
        stored = stores.load(spark, store, "files")
        if stored is None:
            stored = spark.createDataFrame([], STREAM + ", part int")
        log = f"{stores.store_path(store, 'changes')}/batch={batch_id}"
        if not stores.exists(spark, f"{log}/_SUCCESS"):
            known = stored.join(fresh.select("repo_id", "rel_path"), ["repo_id", "rel_path"], "left_semi")
            found = incremental.changes(incremental.hashes(known), incremental.hashes(fresh)).where("change IN ('added', 'modified')")
            found.write.mode("overwrite").parquet(log)
        changed = spark.read.parquet(log)
        if changed.isEmpty():
            return
        new = stable(fresh.join(changed.select("repo_id", "rel_path"), ["repo_id", "rel_path"], "left_semi"))
        touched = [r[0] for r in new.select("part").distinct().collect()]  # at most PARTS numbers
        table = stable(stores.upsert(stored.where(F.col("part").isin(touched)), new, ["repo_id", "rel_path"]))
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(stores.store_path(store, "files"))

    writer = files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
