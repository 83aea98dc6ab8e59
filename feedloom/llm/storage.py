"""Stored intermediate tables: written to the shared folder of the session, so that they outlive executors."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.session import fresh_folder, remove

BROADCAST_ROWS = 20_000
BROADCAST_CHARS = 2_000_000


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again; lineage ends there."""
    path = fresh_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    free_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more, once what was made of them is stored."""
    for table in tables:
        files = table.inputFiles()
        if files:
            remove(table.sparkSession, files[0].rsplit("/", 1)[0])


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps: it does so once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until the table has no such column (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def spread_join(rows: DataFrame, few: DataFrame, key: str, by: Column, how: str = "left", parts: int = 16) -> DataFrame:
    """Join of `rows`, where one key may hold a third of them, with a stored table `few`, one row per key.

    A table of at most BROADCAST_ROWS rows and BROADCAST_CHARS characters of keys, both counted here, is broadcast. Of a larger one each key stands
    `parts` times, and `by` deals the rows out to these; its value only decides where a row meets its partner. Null keys meet each
    other. Besides `key`, `few` must not share names with `rows`.
    """
    salt, part, same = (free_name(rows, n) for n in ("salt_of_row", "part_of_key", "key_again"))
    others = [quoted(c) for c in few.columns if c != key]
    size = few.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(quoted(key).cast("string"))), F.lit(0)).alias("chars")).first()
    if size.n <= BROADCAST_ROWS and size.chars <= BROADCAST_CHARS:
        right = F.broadcast(few.select(quoted(key).alias(same), *others))
        return rows.join(right, quoted(key).eqNullSafe(F.col(same)), how).drop(same)
    left = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    right = few.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(part), quoted(key).alias(same), *others)
    return left.join(right.hint("merge"), (F.col(salt) == F.col(part)) & quoted(key).eqNullSafe(F.col(same)), how).drop(salt, part, same)
