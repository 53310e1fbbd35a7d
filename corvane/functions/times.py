"""Timestamps: canonical UTC text, lenient parsing, retry times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_text(ts: Column) -> Column:
    """ISO-8601 with Z; a fraction only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(ts) % 1_000_000
    return F.concat(whole, F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("Z"))


def strict(text: Column) -> Column:
    """A timestamp from ISO-8601 with an offset; null without one."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(F.regexp_replace(text, r"([+-]\d\d)(\d\d)$", "$1:$2")))


def lenient(text: Column) -> Column:
    """ISO-8601 (UTC if it names no offset), RFC 2822, or the form with the year last; null for anything else."""
    named = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},? ", "")
    year_last = F.try_to_timestamp(F.when(named.rlike(r"^[A-Za-z]{3} \d\d [\d:]{8} [+-]\d{4} \d{4}$"), named), F.lit("MMM dd HH:mm:ss xxxx yyyy"))
    mail = F.try_to_timestamp(F.when(named.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} [\d:]{8} [+-]\d{4}$"), named), F.lit("d MMM yyyy HH:mm:ss xxxx"))
    plain = F.try_to_timestamp(F.when(F.trim(text).rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?)?$"), F.trim(text)))
    return F.coalesce(strict(F.trim(text)), plain, year_last, mail)


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait: a number, or the time until an HTTP date, never below 0; null if it is neither."""
    date = F.try_to_timestamp(F.when(header.rlike(r"^[A-Za-z]{3}, \d\d [A-Za-z]{3} \d{4} [\d:]{8} GMT$"), F.substr(header, F.lit(6), F.lit(20))), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.coalesce(header.try_cast("int").cast("double"), F.unix_seconds(date) - F.unix_seconds(now))
    return F.greatest(wait, F.when(wait.isNotNull(), F.lit(0.0)))


def later_or_equal(a: Column, b: Column) -> Column:
    """By time, not by text: a fraction sorts after its whole second."""
    return strict(a) >= strict(b)
