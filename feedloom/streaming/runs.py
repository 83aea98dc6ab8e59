"""Stream sources over table folders, and runs that write each micro-batch to its own folder.

A batch folder is named by the batch number and overwritten when the batch is replayed, so a restart after a lost
executor or driver changes nothing that was already written."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from feedloom.schemas import TABLES
from feedloom.session import ROCKSDB, fresh_folder


def stream_table(
    spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None, bytes_per_batch: str | None = None
) -> DataFrame:
    """Files of one table as an unbounded table; new files are picked up by later batches.

    The batch bound matters for keyed state: the rows that one key has in one batch are held by one task."""
    reader = spark.readStream.schema(TABLES[name])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    elif bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(f"{folder}/{name}*.parquet")


def event_time(c: str = "ts"):
    """Watermarks need a zoned timestamp."""
    return F.col(c).cast("timestamp")


def run_batches(
    stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", every: str | None = None,
    state_folder: str | None = None,
) -> None:
    """Run over all available input, or every `every` (for example "30 minutes") until stopped."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    query = (
        stream.writeStream.outputMode(mode).trigger(**trigger)
        .option("checkpointLocation", state_folder or fresh_folder(spark, "stream-state"))
        .foreachBatch(each).start()
    )
    query.awaitTermination()


def write_batches(stream: DataFrame, mode: str = "append", out: str | None = None, **options) -> DataFrame:
    """All rows a stream emitted, with the number of their batch."""
    spark = stream.sparkSession
    out = out or fresh_folder(spark, "stream-out")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_batches(stream, write, mode, **options)
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    return spark.read.schema(schema).option("basePath", out).parquet(out)


def last_update(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final row per key of a stream in update mode."""
    values = [c for c in updates.columns if c not in keys and c != "batch"]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])
