"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Every document draws the exponential key -ln(u) / weight, so that heavier (better) documents come early. A source
whose target is t times its size gives floor(t) complete epochs, then the documents with the smallest keys up to the
rest of the budget. The prefix sums that find the border need no task that holds a source: keys are mapped to (0, 1),
sizes are added up per (source, slice) before the shuffle, the slice with the border is cut once more in the same way,
and only that slice of a slice, a 16-millionth of the range of keys, is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.storage import free_name, quoted, saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SLICES = 4096
TYPICAL_WORD = 6.0


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.25 and 1: less the further a text's mean word length, with one blank, is from a usual one."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.greatest(F.lit(0.25), F.least(F.lit(1.0), 1.0 - F.abs(F.coalesce(mean, F.lit(0.0)) - TYPICAL_WORD) / 12.0))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the values only, so that reruns agree: 52 bits of a digest. Nulls are skipped."""
    digest = F.md5(F.concat_ws("|", F.lit("mix"), *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(
    sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sources by code point, null last, weigh `weights`, repeating, and share `share` of all sizes; a target stops at
    `most` times its source's size and the excess is shared anew by weight until none is above. Water-filling:
    with sources ordered by cap / weight, those up to some place are capped. One row per source is what the two
    windows order; texts and documents never meet there.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    nth = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("nth", F.row_number().over(by_name)).withColumn("weight", nth).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(everyone) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(everyone))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / (F.col("all_weight") - F.col("gone")))
        .withColumn("is_capped", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("final", F.max(F.when(~F.col("is_capped"), F.col("level"))).over(everyone))
    )
    target = F.when(F.col("is_capped"), F.col("cap")).otherwise(F.col("final") * F.col("weight"))
    return filled.select("source", F.col("source_size").cast("long").alias("source_size"), target.cast("double").alias("target"))


def _copies(items: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds `copies` to stored rows (source, size, key, order) by the targets of their sources."""
    budget = plan.select(
        F.col("source").alias("s"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
    ).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    same = F.col("source").eqNullSafe(F.col("s"))
    fine = F.floor(F.col("key") * SLICES * SLICES).cast("long")
    rows = items.withColumn("fine", F.least(fine, F.lit(SLICES * SLICES - 1))).withColumn("slice", F.floor(F.col("fine") / SLICES))

    def border(sums: DataFrame, name: str, base: Column) -> DataFrame:
        """The first slice per source at whose end the running total exceeds the rest, and the total before it."""
        upto = F.sum("n").over(Window.partitionBy("source").orderBy(name).rowsBetween(Window.unboundedPreceding, 0)) + base
        passed = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("rest"))
        return passed.groupBy("source").agg(
            F.min(name).alias(name), F.min_by(F.col("upto") - F.col("n"), name).alias("before"))

    coarse = rows.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    coarse = coarse.join(budget, same).select("source", "slice", "n", "rest")
    first = border(coarse, "slice", F.lit(0)).select(F.col("source").alias("s1"), F.col("slice").alias("slice1"), F.col("before").alias("before1"))
    inner = rows.join(first, F.col("source").eqNullSafe(F.col("s1")) & (F.col("slice") == F.col("slice1")))
    inner = inner.groupBy("source", "fine").agg(F.sum("size").alias("n"), F.min("before1").alias("base"))
    inner = inner.join(budget, same).select("source", "fine", "n", "rest", "base")
    second = border(inner, "fine", F.col("base")).select(F.col("source").alias("s2"), F.col("fine").alias("fine2"), F.col("before").alias("before2"))

    limits = budget.join(second, F.col("s").eqNullSafe(F.col("s2")), "left").select("s", "source_size", "target", "epochs", "rest", "fine2", "before2")
    # the border is found by (source, fine), and only its few rows meet by source
    edge = rows.join(limits, same & (F.col("fine") == F.col("fine2")))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("key", "order").rowsBetween(Window.unboundedPreceding, -1))
    middle = F.col("before2") + F.coalesce(upto, F.lit(0)) + F.col("size") / 2  # the nearest place for a whole document
    edge = edge.withColumn("extra", (middle <= F.col("rest")).cast("long"))
    others = rows.join(limits, same, "left").filter("fine2 is null or fine <> fine2").withColumn(
        "extra", (F.col("fine2").isNull() | (F.col("fine") < F.col("fine2"))).cast("long"))
    # without a border the whole source fits in the rest, which is then less than a word short of it or empty
    extra = F.when((F.col("rest") <= 0) | (F.col("size") == 0), F.lit(0)).otherwise(F.col("extra"))
    return others.unionByName(edge).withColumn("copies", F.col("epochs") + extra)


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, row: str | None = None,
) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, copies) of every row of `docs`.

    `row` names a column that numbers the rows, if there is one. `weight` is the quality of a row (default: `quality_weight`); not positive or null counts as the least weight.
    A null text has size 0 and 0 copies; a null source is a source of its own, the last one. Repeated rows draw the
    same key and are taken in the order of their row numbers. An empty table gives no rows. No row gets more copies
    than `most`, rounded up, and the words of a source differ from its target by half a document at most.
    """
    size = words(quoted(text))
    quality = quality_weight(quoted(text), size) if weight is None else weight
    quality = F.coalesce(F.greatest(quality.cast("double"), F.lit(1e-6)), F.lit(1e-6))
    drawn = docs.select(
        quoted(doc_id).alias("doc_id"), quoted(source).alias("source"), size.alias("size"),
        (-F.log(uniform(quoted(doc_id), quoted(text))) / quality).alias("raw"),
        (F.monotonically_increasing_id() if row is None else quoted(row)).alias("order"),
    ).withColumn("key", 1 - F.exp(-F.col("raw"))).drop("raw")
    items = saved(drawn, "mix")
    sources = items.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = saved(targets(sources, weights, share, most), "targets")
    return _copies(items, plan).select(
        F.col("order").alias("row"), "doc_id", "source", "size", "source_size", "target", "copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix with all their columns, each as often as it has copies."""
    row = free_name(docs, "row")
    stored = saved(docs.withColumn(row, F.monotonically_increasing_id()), "mixed")
    copies = saved(mix(stored, row=row, **options).filter("copies > 0").select(F.col("row").alias(row), "copies"), "copies")
    time = free_name(docs, "time")
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(time)
    return stored.join(copies.select(row, times), row).select(*[quoted(c) for c in docs.columns])


def op4(spark, folder: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{folder}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP4_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), keyed AS (
  SELECT doc_id, source, size, 1 - exp(ln((('0x' || substr(md5(concat_ws('|', 'mix', doc_id::VARCHAR, text)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496)
    / greatest(0.25::DOUBLE, least(1::DOUBLE, 1 - abs(coalesce(length(text)::DOUBLE / greatest(size, 1), 0) - 6) / 12))) AS k FROM docs
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth, source_size::DOUBLE * 2 AS cap FROM sources
), weighted AS (
  SELECT *, ([3, 1, 2][((nth - 1) % 3 + 1)::INT])::DOUBLE AS w FROM ranked
), filled AS (
  SELECT *, sum(source_size::DOUBLE) OVER () * 1.5 AS total, sum(w) OVER () AS all_w, coalesce(sum(cap) OVER earlier, 0) AS capped,
    coalesce(sum(w) OVER earlier, 0) AS gone FROM weighted
  WINDOW earlier AS (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (total - capped) / (all_w - gone) AS level FROM filled
), plan AS (
  SELECT source, source_size, CASE WHEN cap <= level * w THEN cap ELSE max(CASE WHEN cap > level * w THEN level END) OVER () * w END AS target FROM levels
), budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM plan
), placed AS (
  SELECT k.*, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN budget b ON k.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
  size * (epochs + CASE WHEN rest > 0 AND size > 0 AND before + size / 2 <= rest THEN 1 ELSE 0 END)::BIGINT AS taken FROM placed
"""
