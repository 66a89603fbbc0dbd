"""Schedules: the next run of one-off, periodic and cron entries, and how they read."""

from __future__ import annotations

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def next_run(kind: Column, at_ms: Column, every_ms: Column, now_ms: Column) -> Column:
    """Epoch milliseconds of the next run of ``at`` (strictly later) and ``every`` entries; null for others."""
    return F.when((kind == "at") & (at_ms > now_ms), at_ms).when((kind == "every") & (every_ms > 0), now_ms + every_ms)


def timing(kind: Column, every_ms: Column, expr: Column, tz: Column) -> Column:
    unit = F.when(every_ms % 3_600_000 == 0, F.concat(F.floor(every_ms / 3_600_000).cast("string"), F.lit("h")))
    for size, name in ((60_000, "m"), (1000, "s")):
        unit = unit.when(every_ms % size == 0, F.concat(F.floor(every_ms / size).cast("string"), F.lit(name)))
    unit = unit.otherwise(F.concat(every_ms.cast("string"), F.lit("ms")))
    zone = F.when(tz.isNotNull() & (tz != ""), F.concat(F.lit(" ("), tz, F.lit(")"))).otherwise(F.lit(""))
    return F.when(kind == "cron", F.concat(F.lit("cron: "), expr, zone)).when((kind == "every") & (every_ms > 0), F.concat(F.lit("every "), unit)).otherwise(kind)


def _field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, b = (low, high) if span == "*" else map(int, span.split("-")) if "-" in span else (int(span), high if step else int(span))
        if not low <= a <= b <= high or step and int(step) <= 0:
            raise ValueError(part)
        out |= set(range(a, b + 1, int(step or 1)))
    return out


def next_cron(expr: str, now_ms: int, tz: str = "UTC") -> int | None:
    """The next time a five-field expression matches in its zone; null for an expression or zone that isn't valid. Where
    both day fields are set, either may match. Times that a clock change skips don't match."""
    try:
        minute, hour, day, month, week = expr.split()
        fields = [_field(minute, 0, 59), _field(hour, 0, 23), _field(day, 1, 31), _field(month, 1, 12), {w % 7 for w in _field(week, 0, 7)}]
        zone = ZoneInfo(tz or "UTC")
    except (ValueError, KeyError, OSError, AttributeError):
        return None
    t = datetime.fromtimestamp(now_ms / 1000, zone).replace(second=0, microsecond=0, tzinfo=None) + timedelta(minutes=1)
    end = t + timedelta(days=366 * 5)
    while t < end:
        days = (t.day in fields[2], (t.isoweekday() % 7) in fields[4])
        right_day = all(days) if "*" in (day, week) else any(days)
        if t.month not in fields[3] or not right_day:
            t = (t + timedelta(days=1)).replace(hour=0, minute=0)
        elif t.hour not in fields[1]:
            t = (t + timedelta(hours=1)).replace(minute=0)
        elif t.minute not in fields[0]:
            t += timedelta(minutes=1)
        else:
            aware = t.replace(tzinfo=zone)
            ms = int(aware.timestamp() * 1000)
            if datetime.fromtimestamp(ms / 1000, zone).replace(tzinfo=None) == t and ms > now_ms:
                return ms
            t += timedelta(minutes=1)
    return None


@F.pandas_udf(LongType())
def cron_next(expr: pd.Series, now_ms: pd.Series, tz: pd.Series) -> pd.Series:
    return pd.Series([None if e is None or pd.isna(n) else next_cron(e, int(n), z or "UTC") for e, n, z in zip(expr, now_ms, tz, strict=True)], dtype="Int64")


def next_of(kind: Column, at_ms: Column, every_ms: Column, expr: Column, tz: Column, now_ms: Column) -> Column:
    """The next run of an entry of any kind; only cron entries go to Python."""
    cron = kind == "cron"
    return F.when(cron, cron_next(F.when(cron, expr), now_ms, tz)).otherwise(next_run(kind, at_ms, every_ms, now_ms))


def tick(jobs: DataFrame, now_ms: Column) -> DataFrame:
    """One turn of the scheduler over jobs (enabled, kind, at_ms, every_ms, expr, tz, next_ms): due jobs have run at
    ``now_ms``; a one-off is disabled then, the others get their next run. ``ran`` tells which. Started again and again by
    a trigger or an outside clock, at the least next_ms."""
    ran = F.col("enabled") & F.coalesce(F.col("next_ms") <= now_ms, F.lit(False))
    off = ran & (F.col("kind") == "at")
    again = next_of(F.col("kind"), F.col("at_ms"), F.col("every_ms"), F.col("expr"), F.col("tz"), now_ms)
    return jobs.withColumns({"ran": ran, "next_ms": F.when(off, F.lit(None).cast("long")).when(ran, again).otherwise(F.col("next_ms")), "enabled": F.col("enabled") & ~off})
