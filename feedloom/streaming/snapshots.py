"""Versioned snapshots of a keyed table in hash buckets, so that a batch writes only the buckets it touches.

Rows of bucket b as of batch n lie in `out/version=n/bucket=b`. A manifest per batch tells the newest version of each bucket; it is
written last, so a batch counts once its manifest is there, and a batch that runs again reads the manifest before it and
gives the same files. The files of the last two manifests stay, as the last batch may be run again; older versions are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from feedloom.session import exists, files_of, remove

BUCKETS = 256
BUCKET = "bucket"
MANIFEST = StructType([StructField(BUCKET, IntegerType()), StructField("version", LongType())])


class Snapshots:
    """A table with `keys`, dealt to `buckets` by their hash. The number of buckets stays as it was at the start; it bounds what the
    driver holds of a manifest."""

    def __init__(self, spark: SparkSession, out: str, schema: StructType, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.out, self.keys, self.buckets = spark, out.rstrip("/"), keys, buckets
        self.schema = schema
        if BUCKET in schema.names:
            raise ValueError(f"a column is named {BUCKET}")

    def _manifest_path(self, number: int) -> str:
        return f"{self.out}-manifest/after={number}"

    def manifest(self, number: int) -> dict[int, int]:
        """Version of each bucket that has rows after a batch."""
        return {r[0]: r[1] for r in self.spark.read.schema(MANIFEST).parquet(self._manifest_path(number)).collect()}

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, number: int, before: dict[int, int], touched: list[int]) -> None:
        folder = f"{self.out}/version={number}"
        dealt = self._dealt(rows).withColumnRenamed("_bucket", BUCKET)
        dealt.repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite").parquet(folder)
        found = self.spark.read.schema(StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])).option("basePath", folder).parquet(folder)
        full = {r[0] for r in found.select(BUCKET).distinct().collect()}  # at most `buckets` numbers
        now = {b: v for b, v in before.items() if b not in touched} | {b: number for b in full}
        table = self.spark.createDataFrame(sorted(now.items()), MANIFEST)
        table.coalesce(1).write.mode("overwrite").parquet(self._manifest_path(number))

    def create(self, rows: DataFrame) -> None:
        """The table before the first batch; nothing happens if it is there."""
        if not exists(self.spark, f"{self._manifest_path(-1)}/_SUCCESS"):
            self._write(rows.select(*self.schema.names), -1, {}, [])

    def _rows(self, versions: dict[int, int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.out}/version={v}/{BUCKET}={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def merge(self, batch: DataFrame, number: int, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Version `number`: the buckets that the batch touches get `merged(stored rows, batch)`, the others stay."""
        before = self.manifest(number - 1)
        touched = [r[0] for r in self._dealt(batch).select("_bucket").distinct().collect()]  # at most `buckets` numbers
        stored = self._rows({b: v for b, v in before.items() if b in set(touched)})
        self._write(merged(stored, batch).select(*self.schema.names), number, before, touched)
        self._forget(number, before)

    def _forget(self, number: int, before: dict[int, int]) -> None:
        """Removes what only the manifest two batches ago names, and that manifest."""
        old = number - 2
        if old < -1 or not exists(self.spark, self._manifest_path(old)):
            return
        for bucket, version in self.manifest(old).items():
            if before.get(bucket) != version:
                remove(self.spark, f"{self.out}/version={version}/{BUCKET}={bucket}")
        remove(self.spark, self._manifest_path(old))

    def latest(self) -> int:
        """Number of the last batch whose manifest is there."""
        files, place = files_of(self.spark, f"{self.out}-manifest")
        names = [status.getPath().getName() for status in files.listStatus(place)]
        return max(int(n.split("=")[1]) for n in names if n.startswith("after=") and exists(self.spark, f"{self.out}-manifest/{n}/_SUCCESS"))

    def read(self) -> DataFrame:
        return self._rows(self.manifest(self.latest()))
