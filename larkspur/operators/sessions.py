"""Activity sessions: an incremental session table whose affected rows are replaced atomically.

Two facts keep every group small. Runs of one key that start within one cell of the width of the gap are always in one
session, so rows are aggregated to (key, cell) before any window, with map-side combining; a window then sees at most
one row per cell, which is bounded by the calendar (48 a day for half an hour), never by the number of runs.

The table is a log of segments: a batch appends the runs and the sessions that it changed and nothing else; a session
that it merged away or moved is appended as gone. Segments of a level are merged into one of the next level when there
are ``fan`` of them, so what is written for a batch grows with the batch, and with the logarithm of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators.segments import SegmentStore
from larkspur.session import new_path

RUNS = "run_id string, session_key string, start_us long, end_us long"
CHANGED = RUNS + ", old_key string, old_start long"
SESSIONS = "session_key string, start_us long, end_us long, n_runs long"
VERSIONS = SESSIONS + ", live boolean, batch long"


def clean_key(key: Column) -> Column:
    """Lower case without surrounding white space of any kind."""
    return F.lower(F.regexp_replace(key, r"(?U)^\s+|\s+$", ""))


def run_intervals(runs: DataFrame) -> DataFrame:
    """One row a run: from its earliest start to its latest end.

    Rows without a key (null or blank) or start are left out. An end that is null or before its start counts as the
    start. Rows of one run_id are one run under its least key. Rows without run_id are one run if they are equal in all
    columns: their contents, in 128 bits, stand for the id, so that a row that comes again is known.
    """
    contents = F.md5(F.to_json(F.struct(*(F.col(f"`{c}`") for c in runs.columns)), {"ignoreNullFields": "false"}))
    start, end = F.unix_micros(F.col("started_at").cast("timestamp")), F.unix_micros(F.col("finished_at").cast("timestamp"))
    rows = (
        runs.select(F.coalesce(F.concat(F.lit("r"), "run_id"), F.concat(F.lit("n"), contents)).alias("run_id"), clean_key(F.col("session_key")).alias("session_key"), start.alias("start_us"), end.alias("end_us"))
        .where("session_key <> '' and start_us is not null")
        .withColumn("end_us", F.greatest("start_us", "end_us"))
    )
    return rows.groupBy("run_id").agg(F.min("session_key").alias("session_key"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))


def sessionize(intervals: DataFrame, gap_us: int) -> DataFrame:
    """Sessions of intervals (session_key, start_us, end_us, n_runs): a new one begins ``gap_us`` or more after the
    latest end of all earlier intervals of its key. An empty input gives no sessions."""
    cells = intervals.groupBy("session_key", F.expr(f"floor(start_us / {gap_us})").alias("cell")).agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_runs").alias("n_runs"))
    by_key = Window.partitionBy("session_key").orderBy("start_us")
    before = F.max("end_us").over(by_key.rowsBetween(Window.unboundedPreceding, -1))
    opened = cells.withColumn("opens", F.coalesce((F.col("start_us") >= before + F.lit(gap_us)).cast("int"), F.lit(1)))
    numbered = opened.withColumn("nth", F.sum("opens").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("session_key", "nth").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_runs").alias("n_runs")).select("session_key", "start_us", "end_us", "n_runs")


class SessionTable(SegmentStore):
    """Run states and sessions as two logs of segments.

    What is known of a run only ever grows: its least key, earliest start and latest end, whatever the order in which its
    rows come. A run whose least key changes leaves its session, which is then rebuilt from the runs in it.
    """

    TABLES = ("runs", "sessions")

    def __init__(self, spark: SparkSession, path: str, gap_us: int = 30 * 60 * 1_000_000, fan: int = 8):
        super().__init__(spark, path, fan)
        self.gap_us = gap_us

    def _latest(self, segments: list) -> DataFrame:
        versions = self.read(segments, VERSIONS)
        return versions.groupBy("session_key", "start_us").agg(F.max_by(F.struct("end_us", "n_runs", "live", "batch"), "batch").alias("v")).select("session_key", "start_us", "v.*")

    def _live(self, segments: list) -> DataFrame:
        return self._latest(segments).where("live").select("session_key", "start_us", "end_us", "n_runs")

    def sessions(self) -> DataFrame:
        """The sessions as last published."""
        return self._live(self.manifest()["sessions"])

    def update(self, runs: DataFrame) -> None:
        """Take in one batch of run rows. Rows seen before, in any order or number, change nothing."""
        old = self.manifest()
        number, dropped = old["version"] + 1, []
        self.claim(number)
        batch = run_intervals(runs)
        if old["runs"]:
            kept = self.write(batch, "batch")
            dropped.append(kept)
            batch = self.spark.read.schema(RUNS).parquet(kept)
            before = states(self.read(old["runs"], RUNS).join(batch.select("run_id"), "run_id", "left_semi"))
            b = before.toDF("run_id", "old_key", "old_start", "old_end")
            both = batch.join(b, "run_id", "left")
            grown = both.select("run_id", F.least("session_key", "old_key").alias("session_key"), F.least("start_us", "old_start").alias("start_us"), F.greatest("end_us", "old_end").alias("end_us"), "old_key", "old_start", "old_end")
            changed = grown.where("old_key is null or session_key <> old_key or start_us <> old_start or end_us <> old_end").drop("old_end")
        else:
            changed = batch.select("*", F.lit(None).cast("string").alias("old_key"), F.lit(None).cast("long").alias("old_start"))
        folder = self.write(changed, "runs")
        changed = self.spark.read.schema(CHANGED).parquet(folder)
        log = [*old["runs"], [0, folder]]
        new = F.col("old_key").isNull() | (F.col("old_key") != F.col("session_key"))
        local = changed.select("session_key", "start_us", "end_us", new.cast("long").alias("n_runs"))
        if old["sessions"]:
            keys = changed.select(F.explode(F.array("session_key", "old_key")).alias("session_key")).where("session_key is not null").distinct()
            near = self._live(old["sessions"]).join(keys, "session_key", "left_semi")
            stay, again = near, local
            moved = changed.where("old_key <> session_key")
            if not moved.isEmpty():
                at = moved.select(F.col("old_key").alias("session_key"), "old_start")
                left = near.join(at, "session_key").where("old_start between start_us and end_us").select("session_key", "start_us", "end_us").distinct()
                left = self.spark.read.schema("session_key string, start_us long, end_us long").parquet(kept_left := self.write(left, "left"))
                dropped.append(kept_left)
                stay = near.join(left, ["session_key", "start_us", "end_us"], "left_anti")
                inside = lambda df: df.join(left.toDF("session_key", "s", "e"), "session_key").where("start_us between s and e").drop("s", "e")
                was = self.read(old["runs"], RUNS)
                members = inside(states(was.join(inside(was).select("run_id").distinct(), "run_id", "left_semi"))).select("run_id")
                stayed = members.join(changed.where(new).select("run_id"), "run_id", "left_anti")
                now = states(self.read(log, RUNS).join(stayed, "run_id", "left_semi"))
                again = local.unionByName(now.select("session_key", "start_us", "end_us", F.lit(1).cast("long").alias("n_runs")))
            after = sessionize(stay.unionByName(again), self.gap_us)
            versions = near.toDF("session_key", "start_us", "e", "n").join(after, ["session_key", "start_us"], "full").where("not (end_us <=> e and n_runs <=> n)")
        else:
            versions = sessionize(local, self.gap_us)
        versions = versions.select("session_key", "start_us", "end_us", "n_runs", F.col("end_us").isNotNull().alias("live"), F.lit(number).cast("long").alias("batch"))
        sessions = [*old["sessions"], [0, self.write(versions, "sessions")]]
        runs_now = self.merged(log, "runs", dropped, lambda last, _: states(self.read(last, RUNS)))
        # sessions that are gone are forgotten once nothing older is left
        sessions_now = self.merged(sessions, "sessions", dropped, lambda last, oldest: self._latest(last).where("live") if oldest else self._latest(last))
        self.publish({"version": number, "runs": runs_now, "sessions": sessions_now, "dropped": dropped}, old)


def states(rows: DataFrame) -> DataFrame:
    """One row a run out of all that was logged of it."""
    return rows.groupBy("run_id").agg(F.min("session_key").alias("session_key"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))


def incremental_sessions(runs: DataFrame, batches: int = 3, gap_us: int = 30 * 60 * 1_000_000) -> DataFrame:
    """Feed ``runs`` in ``batches`` spans of logged_at, in order, through a session table; gives its sessions with their
    duration. Rows without logged_at come with the first batch. The result doesn't depend on the batches."""
    spark = runs.sparkSession
    table = SessionTable(spark, new_path(spark, "sessions"), gap_us)
    at = F.unix_micros(F.col("logged_at").cast("timestamp"))
    low, high = runs.agg(F.min(at), F.max(at)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // batches))
    nth = F.coalesce(F.floor((at - F.lit(low or 0)) / F.lit(width)), F.lit(0))
    for k in range(batches):
        table.update(runs.where(nth == k))
    return table.sessions().withColumn("duration_us", F.col("end_us") - F.col("start_us"))
