"""What a fetcher decides from a response, as native columns; the fetching itself is left to a source that fills ``pages``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a crawl takes in.
ACCEPTED = ("text/html", "application/xhtml+xml", "text/markdown")
RETRIES = 2
TIMEOUT_SECONDS = 10


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))


def is_accepted(content_type: Column) -> Column:
    return media_type(content_type).isin(*ACCEPTED)


def retry_after(value: Column, now: Column) -> Column:
    """The seconds of a ``Retry-After`` field: a number, or an HTTP date after ``now``; null for anything else."""
    v = F.trim(value)
    date = F.try_to_timestamp(F.regexp_replace(v, "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.unix_timestamp(date) - F.unix_timestamp(now)
    return F.when(v.rlike("^[0-9]+$"), v.try_cast("bigint")).when(date.isNotNull(), F.greatest(seconds, F.lit(0)))


def next_try(status: Column, attempt: Column, retry_field: Column, now: Column, base_seconds: float = 1.0) -> Column:
    """Seconds until the next try, null where there is none: too many requests wait as the server says, failures of
    the server and of the connection (null status) double their delay; after ``RETRIES`` tries it ends."""
    backoff = F.lit(base_seconds) * F.pow(F.lit(2.0), attempt)
    wait = F.when(status == 429, F.greatest(F.coalesce(retry_after(retry_field, now).cast("double"), backoff), backoff)).when(status.isNull() | (status >= 500), backoff)
    return F.when(attempt < RETRIES, wait)
