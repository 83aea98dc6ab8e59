"""Raw response logs (event streams or plain JSON) to usage records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.values import token_count

COUNTS = "STRUCT<input_tokens: STRING, prompt_tokens: STRING, output_tokens: STRING, completion_tokens: STRING, total_tokens: STRING>"
PAYLOAD = f"response STRUCT<usage: {COUNTS}>, usage {COUNTS}"


def ingest_usage_log(logs: DataFrame, key: str, raw: str) -> DataFrame:
    """Last usage record of each response; token counts that are no whole numbers are NULL.

    A log is plain JSON, or blocks parted by blank lines whose `data:` lines form one JSON text each."""
    blocks = F.split(F.col(raw), r"\n\n+")
    data = F.transform(blocks, lambda b: F.array_join(
        F.transform(
            F.filter(F.split(b, r"\r?\n"), lambda line: F.startswith(line, F.lit("data:"))),
            lambda line: F.ltrim(F.substring(line, 6, 2147483647)),
        ), "\n"))
    payloads = F.when(F.try_parse_json(F.col(raw)).isNotNull(), F.array(F.col(raw))).otherwise(data)
    read = logs.withColumn("_p", F.filter(payloads, lambda p: p != "")).withColumn(
        "_u", F.transform("_p", lambda p: F.from_json(p, PAYLOAD))
    )
    usages = F.filter(F.transform("_u", lambda p: F.coalesce(p["response"]["usage"], p["usage"])), lambda u: u.isNotNull())
    last = read.withColumn("_last", F.try_element_at(usages, F.lit(-1)))
    return last.withColumns({
        "input_tokens": token_count(F.coalesce("_last.input_tokens", "_last.prompt_tokens")),
        "output_tokens": token_count(F.coalesce("_last.output_tokens", "_last.completion_tokens")),
        "total_tokens": token_count(F.col("_last.total_tokens")), "has_usage": F.col("_last").isNotNull(),
    }).drop("_p", "_u", "_last", raw)
