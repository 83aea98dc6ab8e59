"""Roll-ups of usage, latency and first-seen values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import text as tx
from feedloom.operators.lists import top_per_group
from feedloom.operators.ordered import numbered
from feedloom.operators.quantiles import nearest_rank_of

TOKENS = ("input_tokens", "output_tokens", "total_tokens")


def zero_sum(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint").alias(column)


def usage_totals(usage: DataFrame) -> DataFrame:
    return usage.groupBy("provider").agg(
        F.count(F.lit(1)).alias("request_count"), *[zero_sum(t) for t in TOKENS], F.max("created_at").alias("updated_at")
    )


def usage_totals_merge(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Stored totals plus the totals of new usage rows."""
    return stored.unionByName(usage_totals(delta)).groupBy("provider").agg(
        F.sum("request_count").alias("request_count"), *[zero_sum(t) for t in TOKENS],
        F.max("updated_at").alias("updated_at"),
    )


def usage_summary(usage: DataFrame, newest: int = 20) -> DataFrame:
    """The newest rows per provider beside the provider's totals."""
    order = [F.col("created_at").desc(), F.col("id").desc()]
    recent = top_per_group(usage.select("provider", "id", "created_at", "status", "total_tokens"), ["provider"], order, newest)
    totals = usage_totals(usage).select(
        F.col("provider").alias("_provider"), "request_count", *[F.col(t).alias(f"sum_{t}") for t in TOKENS]
    )
    return recent.join(totals, F.col("provider").eqNullSafe(F.col("_provider"))).drop("_provider")


def usage_by_kind_status(usage: DataFrame) -> DataFrame:
    """Requests and tokens by kind and status, with subtotals (NULL marks a subtotal row)."""
    return usage.rollup("request_kind", "status").agg(
        F.count(F.lit(1)).alias("requests"), zero_sum("total_tokens"),
        F.grouping_id().cast("bigint").alias("level"),
    )


def latency_percentiles(samples: DataFrame) -> DataFrame:
    """Nearest-rank p50 and p95, mean, mean calls and aborted calls per scenario, all from one pass over the samples."""
    folded = samples.groupBy("scenario", "latency_ms").agg(
        F.count(F.lit(1)).alias("n"), F.count("latency_ms").alias("timed"), F.sum("calls").alias("calls"), F.sum("aborted").alias("aborted")
    )
    ranks = nearest_rank_of(folded.filter("timed > 0"), ["scenario"], "latency_ms", "n", {"p50": 0.5, "p95": 0.95})
    rows = F.sum("n")
    sums = folded.groupBy("scenario").agg(
        (F.sum(F.col("latency_ms") * F.col("n")) / rows).alias("mean_ms"), (F.sum("calls") / rows).alias("mean_calls"),
        F.sum("aborted").cast("bigint").alias("aborted"),
    )
    same = F.col("scenario").eqNullSafe(F.col("_scenario"))
    return sums.join(ranks.withColumnRenamed("scenario", "_scenario"), same, "left").drop("_scenario")


def distinct_first_seen(rows: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """Distinct values per key, numbered in the order of their first occurrence."""
    firsts = rows.filter(tx.blank_to_null(F.col(value)).isNotNull()).groupBy(*keys, value).agg(
        F.min(pos).alias("first_pos")
    )
    return numbered(firsts, keys, ["first_pos", value], "seen_no")


def cookie_headers(cookies: DataFrame, most: int = 500) -> DataFrame:
    """`name=value; name=value` header of each domain in pieces (piece, pieces) of at most `most` cookies. The last value of a name wins, in the
    place of its first one.

    A domain of usual size has one piece, its header. Names are numbered without a task that holds a domain, and dealt to pieces by number, so what is
    collected is bounded however many names a domain has; joined in order with `; ` the pieces are the header."""
    domain = F.regexp_replace(F.lower(tx.trim_space(F.coalesce(F.col("domain"), F.lit("")))), r"^\.", "")
    name = tx.trim_space(F.coalesce(F.col("name"), F.lit("")))
    usable = cookies.select(domain.alias("domain"), name.alias("name"), "value", "pos").filter(
        (F.col("domain") != "") & (F.col("name") != "")
    )
    # The empty string stands for NULL: max_by must see the last value even when it is missing.
    last = usable.groupBy("domain", "name").agg(
        F.min("pos").alias("place"), F.max_by(F.coalesce("value", F.lit("")), "pos").alias("value")
    )
    pairs = last.withColumn("value", tx.trim_space(F.col("value"))).filter(F.col("value") != "")
    dealt = numbered(pairs, ["domain"], ["place", "name"], "_no").withColumn("piece", F.floor((F.col("_no") - 1) / most).cast("bigint"))
    placed = F.array_sort(F.collect_list(F.struct("_no", F.concat_ws("=", "name", "value").alias("pair"))))
    pieces = dealt.groupBy("domain", "piece").agg(
        F.array_join(F.transform(placed, lambda p: p["pair"]), "; ").alias("header"), F.count(F.lit(1)).alias("cookies")
    )
    counts = pieces.groupBy("domain").agg(F.count(F.lit(1)).alias("pieces"))
    return pieces.join(counts, "domain")
