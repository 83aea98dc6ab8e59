"""Scalar value rules: retry hints, flags, providers, errors, token counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import truncate_text

# Back-off steps, capped at the last one.
RETRY_HOURS = (2, 6, 12, 24)
PROBE_MINUTES = (15, 30, 60, 120)


def step_delay(steps: tuple[int, ...], failures: Column, unit_seconds: int) -> Column:
    """Day-time interval of the step for the n-th consecutive failure."""
    at = F.least(F.greatest(failures, F.lit(1)), F.lit(len(steps))).cast("int")
    seconds = F.element_at(F.array(*[F.lit(s * unit_seconds) for s in steps]), at)
    return F.make_dt_interval(secs=seconds)


def parse_date(c: Column) -> Column:
    """ISO-8601 or RFC-822 text to TIMESTAMP, NULL when it is neither."""
    rfc = F.regexp_replace(F.trim(c), "^[A-Za-z]{3,9}, *", "")
    rfc = F.regexp_replace(rfc, " (?:GMT|UTC|UT|Z)$", " +0000")
    is_rfc = F.rlike(rfc, F.lit(r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d [+-]\d{4}$"))
    return F.when(is_rfc, F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss xx"))).otherwise(
        F.try_to_timestamp(F.trim(c))
    )


def parse_retry_after(c: Column, now: Column) -> Column:
    """Seconds from now, an epoch second above 1e9, or a date text; NULL when unusable."""
    number = F.trim(c).try_cast("double")
    return (
        F.when(c.isNull() | (F.trim(c) == ""), F.lit(None).cast("timestamp"))
        .when(number > 1e9, F.timestamp_micros((number * 1e6).cast("bigint")))
        .when(number >= 0, now + F.make_dt_interval(secs=number))
        .otherwise(parse_date(c))
    )


def base_provider(c: Column, default: str = "source-feed") -> Column:
    return F.coalesce(F.nullif(F.substring_index(c, "+", 1), F.lit("")), F.lit(default))


def flag_value(c: Column, default: bool) -> Column:
    """Boolean of a request flag, the default when blank, NULL when it must be rejected."""
    text = F.lower(F.trim(c))
    return (
        F.when(c.isNull() | (text == ""), F.lit(default))
        .when(text.isin("true", "1", "yes", "on"), F.lit(True))
        .when(text.isin("false", "0", "no", "off"), F.lit(False))
    )


def redact_error(c: Column, fixed: str = "operation failed; see server logs for details") -> Column:
    private = r"(?i)/(?:Users|home|app)/|[A-Za-z]:\\|auth file|\.codex"
    message = F.coalesce(F.nullif(c, F.lit("")), F.lit("operation failed"))
    return F.when(F.rlike(message, F.lit(private)), F.lit(fixed)).otherwise(truncate_text(message, 500))


def token_count(c: Column) -> Column:
    """Whole number >= 0, else NULL."""
    number = F.trim(c.cast("string")).try_cast("decimal(38,6)")
    return F.when((number >= 0) & (number == F.floor(number)), number.try_cast("bigint"))


def unzoned_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, read as UTC whatever the zone of the session."""
    plain = ts.cast("timestamp_ntz")
    seconds = F.hour(plain) * 3600 + F.minute(plain) * 60
    day = F.unix_date(plain.cast("date")).cast("bigint") * 86_400_000_000
    return day + seconds.cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), plain) * 1_000_000).cast("bigint")
