"""Exact quantiles of whole numbers by radix selection, as one plan without jobs of its own.

Equal values are counted first; all that follows reads these counts. A first histogram per key has the values' leading 20 bits as cells, so that
its size is bounded whatever the table; the cell with the wanted rank is told by a running sum, and the next histogram has the
next bits of that cell only, until single values are left. Numbers of 32 bits take two histograms, others three.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, ShortType

LEADING = (20, 42, 63)


def leading_bits(value: Column, bits: int) -> Column:
    """The number with all but its `bits` leading bits cleared; of negative ones those of -x - 1. Keeps the order."""
    size = F.when(value < 0, F.bitwise_not(value)).otherwise(value)
    cut = F.transform(F.array(F.struct(size.alias("x"), F.greatest(F.length(F.bin(size)) - bits, F.lit(0)).alias("s"))),
                      lambda p: F.call_function("shiftleft", F.call_function("shiftright", p["x"], p["s"]), p["s"]))
    return F.when(value < 0, F.bitwise_not(F.get(cut, F.lit(0)))).otherwise(F.get(cut, F.lit(0)))


def _same(keys: Sequence[str]) -> tuple[list[Column], Column]:
    renamed = [F.col(k).alias(f"_k_{k}") for k in keys]
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return renamed, same


def nearest_rank_of(counts: DataFrame, keys: Sequence[str], value: str, n: str, quantiles: dict[str, float]) -> DataFrame:
    """One column per quantile: the value at place ceil(total * q), 1 at least, of each key's sorted values. `counts` has a row per key and value with the
    number `n` of its occurrences; keys may be null, values and numbers may not."""
    kind = counts.schema[value].dataType
    small = isinstance(kind, (ByteType, ShortType, IntegerType))
    rows = counts.select(*keys, F.col(value).cast("bigint").alias("_v"), F.col(n).cast("bigint").alias("_n"))
    of_key = Window.partitionBy(*keys)
    cells = rows.groupBy(*keys, leading_bits(F.col("_v"), LEADING[0]).alias("_cell")).agg(F.sum("_n").alias("_n"))
    ranks = F.array(*[
        F.struct(F.lit(name).alias("name"), F.greatest(F.ceil(F.col("_total") * F.lit(q)), F.lit(1)).cast("bigint").alias("rank"))
        for name, q in quantiles.items()
    ])
    upto = cells.withColumn("_upto", F.sum("_n").over(of_key.orderBy("_cell"))).withColumn("_total", F.sum("_n").over(of_key))
    wanted = upto.withColumn("_q", F.explode(ranks)).filter("_q.rank > _upto - _n AND _q.rank <= _upto")
    wanted = wanted.select(*keys, "_cell", F.col("_q.name").alias("_name"), (F.col("_q.rank") - F.col("_upto") + F.col("_n")).alias("_rank"))
    levels = [LEADING[-1]] if small else list(LEADING[1:])
    before = LEADING[0]
    for bits in levels:
        renamed, same = _same(keys)
        inside = rows.withColumn("_in", leading_bits(F.col("_v"), before)).join(
            wanted.select(*renamed, F.col("_cell").alias("_c"), "_name", "_rank"), same & (F.col("_in") == F.col("_c"))
        )
        cells = inside.groupBy(*keys, "_name", "_rank", leading_bits(F.col("_v"), bits).alias("_cell")).agg(F.sum("_n").alias("_n"))
        in_order = Window.partitionBy(*keys, "_name").orderBy("_cell")
        found = cells.withColumn("_upto", F.sum("_n").over(in_order)).filter("_rank > _upto - _n AND _rank <= _upto")
        wanted = found.select(*keys, "_cell", "_name", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))
        before = bits
    return wanted.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_cell"))).cast(kind).alias(name) for name in quantiles])


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """The same from single rows; null values do not count, and a key without others has no row."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_count"))
    return nearest_rank_of(counts, keys, value, "_count", quantiles)
