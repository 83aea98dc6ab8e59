"""Pages at any depth: the range of sort keys that holds the offset is found by counting, and only what lies there is sorted.

Each pass counts rows per range of a key, a partial aggregate over two columns without a row shuffled, and goes on inside the range that
holds the offset, until few enough rows are left, or one value; then the next key tells its ties apart. The rows
before the range are never ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = 2048
DIRECT = 10_000  # rows to the end of a page that a bounded heap per task may hold
LEFT = 100_000


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, direct: int = DIRECT, left: int = LEFT) -> DataFrame:
    """Rows offset + 1 to offset + limit in descending order of the whole-number columns `order`, nulls last.

    Together the columns must tell rows apart; rows that they do not are in any order. Beyond the last row the page is empty."""
    by = [k.desc_nulls_last() for k in order]
    if offset + limit <= direct:
        return rows.orderBy(*by).offset(offset).limit(limit)
    ties, after, skip = F.lit(True), F.lit(False), offset
    for column in order:
        here = rows.filter(ties)
        low, high, n = here.agg(F.min(column), F.max(column), F.count(F.lit(1))).first()
        low, high = (low - 1, high) if low is not None else (0, 0)
        key = F.coalesce(column.cast("bigint"), F.lit(low))  # nulls below all others
        while n > left and low < high:
            width = -(-(high - low + 1) // RANGES)
            nth = F.call_function("div", F.lit(high).cast("decimal(20,0)") - key.cast("decimal(20,0)"), F.lit(width).cast("decimal(20,0)")).cast("int")
            inside = here.filter((key >= F.lit(low)) & (key <= F.lit(high)))
            counts = sorted(inside.groupBy(nth.alias("nth")).agg(F.count(F.lit(1)).alias("n")).collect())  # at most RANGES rows
            for cell, n in counts:
                if skip < n:
                    break
                skip -= n
            else:
                return rows.limit(0)
            high -= cell * width
            low = max(low, high - width + 1)
        if n <= left or column is order[-1]:
            after = after | (ties & (key <= F.lit(high)))
            break
        after = after | (ties & (key < F.lit(high)))
        ties = ties & (key == F.lit(high))
    return rows.filter(after).orderBy(*by).offset(skip).limit(limit)
