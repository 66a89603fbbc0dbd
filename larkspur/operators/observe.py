"""Run log analytics: the lifecycle of runs as a log, usage, a window's overview, dense hourly buckets, keyset pages."""

from __future__ import annotations

import base64
import binascii
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG = "run_id string, kind string, at timestamp_ntz, body struct<session_key:string,channel:string,model:string,status:string,stop_reason:string,error:string,duration_ms:double,prompt_tokens:bigint,completion_tokens:bigint,reported:boolean>"


def _entry(rows: DataFrame, kind: str, at: str, fields: dict[str, Column]) -> DataFrame:
    types = dict(f.split(":") for f in LOG.partition("struct<")[2].rstrip(">").split(","))
    body = F.struct(*(fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in types.items()))
    return rows.where("run_id is not null").select("run_id", F.lit(kind).alias("kind"), F.col(at).cast("timestamp_ntz").alias("at"), body.alias("body"))


def started(rows: DataFrame) -> DataFrame:
    """Log entries of runs that start: (run_id, session_key, channel, model, started_at)."""
    return _entry(rows, "start", "started_at", {c: F.col(c) for c in ("session_key", "channel", "model")})


def finished(rows: DataFrame) -> DataFrame:
    """Log entries of runs that end: (run_id, status, stop_reason, error, duration_ms, finished_at)."""
    return _entry(rows, "finish", "finished_at", {c: F.col(c) for c in ("status", "stop_reason", "error", "duration_ms")})


def used(rows: DataFrame, at: str = "logged_at") -> DataFrame:
    """Log entries of usage: (run_id, prompt_tokens, completion_tokens, usage_reported)."""
    return _entry(rows, "usage", at, {"prompt_tokens": F.coalesce("prompt_tokens", F.lit(0)), "completion_tokens": F.coalesce("completion_tokens", F.lit(0)), "reported": F.coalesce("usage_reported", F.lit(False))})


def fold_runs(log: DataFrame) -> DataFrame:
    """One row a run out of its log: the first start, the last finish (status ``running`` without one), the sums of its
    usage and whether any was reported. The log is only appended to; this aggregate, combined map-side, is the table."""
    of = lambda kind: F.when(F.col("kind") == kind, F.struct("at", "body"))
    s, f = F.min(of("start")), F.max(of("finish"))
    usage = lambda c: F.sum(F.when(F.col("kind") == "usage", F.col(f"body.{c}")))
    r = log.groupBy("run_id").agg(s.alias("s"), f.alias("f"), F.coalesce(usage("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(usage("completion_tokens"), F.lit(0)).alias("completion_tokens"), F.coalesce(F.max(F.when(F.col("kind") == "usage", F.col("body.reported"))), F.lit(False)).alias("usage_reported"))
    return r.select("run_id", "s.body.session_key", "s.body.channel", "s.body.model", F.col("s.at").alias("started_at"), F.col("f.at").alias("finished_at"), "f.body.duration_ms", F.coalesce("f.body.status", F.lit("running")).alias("status"), "f.body.stop_reason", "f.body.error", "prompt_tokens", "completion_tokens", "usage_reported")


def usage_rollup(rows: DataFrame) -> DataFrame:
    """(run_id, prompt_tokens, completion_tokens, usage_reported): sums of all rows of a run, and whether any reported."""
    return rows.where("run_id is not null").groupBy("run_id").agg(F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"), F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"), F.max(F.coalesce("usage_reported", F.lit(False))).alias("usage_reported"))


def in_window(now: Column, hours: int = 24) -> Column:
    at = F.col("started_at")
    return (at >= now - F.expr(f"interval {hours} hours")) & (at < now)


def call_errors(events: DataFrame, runs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """(run_id, errors): calls with the status error in the events of kind ``tools`` of the window's runs. ``events`` has
    run_id, kind and data, a JSON object with an array ``calls``; data that isn't one has no calls."""
    calls = F.from_json("data", "calls array<struct<status:string>>")["calls"]
    asked = runs.where(in_window(now, hours)).select("run_id").distinct()
    rows = events.where("kind = 'tools'").join(asked, "run_id", "left_semi").select("run_id", F.explode(calls).alias("c"))
    return rows.where("c.status = 'error'").groupBy("run_id").agg(F.count("*").alias("errors"))


def overview(runs: DataFrame, now: Column, hours: int = 24, events: DataFrame | None = None) -> DataFrame:
    """One row: runs of the window; of the ended ones the share of successes, the mean duration and its nearest-rank 95th
    percentile; the calls that failed. An empty window gives 0 and nulls."""
    ended, good = F.col("status") != "running", (F.col("status") == "completed") & (F.col("stop_reason") == "completed")
    took = F.when(ended, F.col("duration_ms"))
    told = runs.where(in_window(now, hours)).agg(
        F.count("*").alias("runs"), F.round(F.avg(F.when(ended, F.coalesce(good, F.lit(False)).cast("double"))), 6).alias("success_rate"),
        F.round(F.avg(took), 4).alias("avg_ms"), F.expr("percentile_disc(0.95) within group (order by case when status <> 'running' then duration_ms end)").alias("p95_ms"),
    )
    if events is None:
        return told.withColumn("tool_errors", F.lit(0).cast("bigint"))
    failed = call_errors(events, runs, now, hours).agg(F.sum("errors"))
    return told.select("*", F.coalesce(failed.scalar(), F.lit(0)).alias("tool_errors"))


def hourly_buckets(runs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """(hour, runs, avg_ms) for each of the last ``hours`` clock hours, empty ones included. The first bucket begins later
    than the overview's window, which ends at ``now`` sharp; what lies between is in no bucket."""
    spark = runs.sparkSession
    last = F.date_trunc("hour", now)
    calendar = spark.range(1).select(F.explode(F.sequence(last - F.expr(f"interval {hours - 1} hours"), last, F.expr("interval 1 hour"))).alias("hour")).select(F.col("hour").cast("timestamp_ntz").alias("hour"))
    counts = runs.where(in_window(now, hours)).groupBy(F.date_trunc("hour", "started_at").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("runs"), F.round(F.avg("duration_ms"), 4).alias("avg_ms"))
    return calendar.join(counts, "hour", "left").select("hour", F.coalesce("runs", F.lit(0)).alias("runs"), "avg_ms")


def encode_cursor(started_at: str, run_id: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([started_at, run_id]).encode()).decode()


def decode_cursor(cursor: str) -> tuple[str, str]:
    try:
        values = json.loads(base64.urlsafe_b64decode(cursor.encode()).decode())
    except (ValueError, binascii.Error) as e:
        raise ValueError("bad cursor") from e
    if not (isinstance(values, list) and len(values) == 2 and all(isinstance(v, str) for v in values)):
        raise ValueError("bad cursor")
    return values[0], values[1]


def checked_limit(limit: int, most: int = 100) -> int:
    """An explicit limit may be tighter than the greatest one, never beyond it."""
    if not 1 <= limit <= most:
        raise ValueError(f"a limit is between 1 and {most}")
    return limit


def keyset_rows(runs: DataFrame, after: tuple[Column, Column] | None = None) -> DataFrame:
    """Runs behind the one that ``after`` names, newest first, by one comparison that reaches the scan."""
    rows = runs.where("started_at is not null and run_id is not null")
    if after is not None:
        rows = rows.where((F.col("started_at") < after[0]) | ((F.col("started_at") == after[0]) & (F.col("run_id") < after[1])))
    return rows.orderBy(F.col("started_at").desc(), F.col("run_id").desc())


def keyset_page(runs: DataFrame, limit: int = 50, cursor: str | None = None) -> tuple[list, str | None]:
    """(up to ``limit`` runs, the cursor of the next page or None). One row more is read to tell whether there is one."""
    checked_limit(limit)
    after = None
    if cursor:
        at, run = decode_cursor(cursor)
        after = (F.lit(at).cast("timestamp_ntz"), F.lit(run))
    rows = keyset_rows(runs, after).limit(limit + 1).collect()
    last = rows[limit - 1] if len(rows) > limit else None
    return rows[:limit], encode_cursor(last["started_at"].isoformat(), last["run_id"]) if last else None
