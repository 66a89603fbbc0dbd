"""Queries over the run log, the event stream and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import schedule as S
from larkspur.functions import text as T
from larkspur.operators import observe as O
from larkspur.operators import sequences as Q
from larkspur.operators.sessions import sessionize
from larkspur.plans import data
from larkspur.plans.registry import query
from larkspur.streaming import operators as ST

_R = "r AS (SELECT run_id, x.* FROM (SELECT run_id, arg_max({'session_key': session_key, 'channel': channel, 'model': model, 'started_at': started_at, 'finished_at': finished_at, 'duration_ms': duration_ms, 'status': status, 'stop_reason': stop_reason, 'error': error}, logged_at) AS x FROM runs WHERE run_id IS NOT NULL AND logged_at IS NOT NULL GROUP BY 1)), now AS (SELECT max(started_at) AS now FROM r)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return data.runs(spark, d)


def _now(runs: DataFrame):
    """The last start of the log stands for the present: one value for the driver."""
    return F.lit(runs.agg(F.max("started_at")).first()[0]).cast("timestamp_ntz")


@query("SELECT run_id, CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(completion_tokens, 0)) AS BIGINT) AS completion_tokens, bool_or(coalesce(usage_reported, false)) AS usage_reported FROM runs WHERE run_id IS NOT NULL GROUP BY 1")
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return O.usage_rollup(data.read_table(spark, d, "runs"))


_CALLS = "ev AS (SELECT run_id, (error IS NOT NULL)::INT + (status IS NOT DISTINCT FROM 'error')::INT AS bad FROM runs WHERE run_id IS NOT NULL), er AS (SELECT run_id, CAST(sum(bad) AS BIGINT) AS errors FROM ev WHERE run_id IN (SELECT run_id FROM r, now WHERE started_at >= now - INTERVAL 24 HOUR AND started_at < now) GROUP BY 1 HAVING sum(bad) > 0)"


def _call_events(spark: SparkSession, d: str) -> DataFrame:
    """Each row of the log as an event of two calls, nested as events keep them: the step and the whole run."""
    call = lambda name, bad: F.struct(name.alias("name"), F.when(bad, "error").otherwise("ok").alias("status"))
    calls = F.array(call(F.col("channel"), F.col("error").isNotNull()), call(F.lit("run"), F.coalesce(F.col("status") == "error", F.lit(False))))
    return data.read_table(spark, d, "runs").where("run_id is not null").select("run_id", F.lit("tools").alias("kind"), F.to_json(F.struct(calls.alias("calls"), "logged_at")).alias("data"))


@query(f"WITH {_R}, {_CALLS} SELECT count(*) AS runs, round(avg(CASE WHEN status <> 'running' THEN coalesce(status = 'completed' AND stop_reason = 'completed', false)::INT END), 6) AS success_rate, round(avg(CASE WHEN status <> 'running' THEN duration_ms END), 4) AS avg_ms, quantile_disc(CASE WHEN status <> 'running' THEN duration_ms END, 0.95) AS p95_ms, (SELECT coalesce(CAST(sum(errors) AS BIGINT), 0) FROM er) AS tool_errors FROM r, now WHERE started_at >= now - INTERVAL 24 HOUR AND started_at < now")
def overview_24h(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d)
    return O.overview(runs, _now(runs), events=_call_events(spark, d))


@query(f"WITH {_R}, {_CALLS} SELECT run_id, errors FROM er")
def tool_errors_24h(spark: SparkSession, d: str) -> DataFrame:
    """Failed calls of the runs of the last day, out of the nested calls of their events."""
    runs = _runs(spark, d)
    return O.call_errors(_call_events(spark, d), runs, _now(runs))


@query("SELECT run_id, min(started_at) AS started_at, max(finished_at) AS finished_at, CASE WHEN max(finished_at) IS NULL THEN 'running' ELSE 'ended' END AS state, CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(completion_tokens, 0)) AS BIGINT) AS completion_tokens, bool_or(coalesce(usage_reported, false)) AS usage_reported FROM runs WHERE run_id IS NOT NULL GROUP BY 1")
def run_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """The log of starts, ends and usage, folded to one row a run."""
    rows = data.read_table(spark, d, "runs")
    log = O.started(rows.where("started_at is not null")).unionByName(O.finished(rows.where("finished_at is not null"))).unionByName(O.used(rows))
    r = O.fold_runs(log)
    return r.select("run_id", "started_at", "finished_at", F.when(F.col("finished_at").isNull(), "running").otherwise("ended").alias("state"), "prompt_tokens", "completion_tokens", "usage_reported")


@query(f"WITH {_R}, c AS (SELECT unnest(generate_series(date_trunc('hour', now) - INTERVAL 23 HOUR, date_trunc('hour', now), INTERVAL 1 HOUR)) AS hour FROM now), n AS (SELECT date_trunc('hour', started_at) AS hour, count(*) AS runs, round(avg(duration_ms), 4) AS avg_ms FROM r, now WHERE started_at >= now - INTERVAL 24 HOUR AND started_at < now GROUP BY 1) SELECT c.hour, coalesce(runs, 0) AS runs, avg_ms FROM c LEFT JOIN n USING (hour)")
def hourly_buckets(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d)
    return O.hourly_buckets(runs, _now(runs))


@query(f"WITH {_R}, c AS (SELECT started_at AS a, run_id AS b FROM r WHERE started_at IS NOT NULL ORDER BY started_at, run_id LIMIT 1 OFFSET 150), p AS (SELECT run_id, started_at, status FROM r, c WHERE started_at < a OR (started_at = a AND run_id < b) ORDER BY started_at DESC, run_id DESC LIMIT 101) SELECT run_id, started_at, status, (SELECT count(*) FROM p) > 100 AS has_next FROM p ORDER BY started_at DESC, run_id DESC LIMIT 100")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """The page of 100 behind the run that is the 151st by age, by its cursor, and whether another page follows."""
    runs = _runs(spark, d)
    at = runs.where("started_at is not null").orderBy("started_at", "run_id").select("started_at", "run_id").limit(151).orderBy(F.col("started_at").desc(), F.col("run_id").desc()).first()
    page, cursor = O.keyset_page(runs.select("run_id", "started_at", "status"), 100, O.encode_cursor(at["started_at"].isoformat(), at["run_id"])) if at else ([], None)
    return spark.createDataFrame([(*r, cursor is not None) for r in page], "run_id string, started_at timestamp_ntz, status string, has_next boolean")


@query(f"WITH {_R}, t AS (SELECT round(avg(duration_ms), 4) AS mean FROM r) SELECT run_id, duration_ms, mean FROM r, t WHERE duration_ms IS NOT NULL ORDER BY duration_ms DESC, run_id LIMIT 5")
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    """The mean and the five slowest."""
    runs = _runs(spark, d)
    mean = runs.agg(F.round(F.avg("duration_ms"), 4)).first()[0]
    return runs.where("duration_ms is not null").orderBy(F.col("duration_ms").desc(), "run_id").limit(5).select("run_id", "duration_ms", F.lit(mean).alias("mean"))


@query(f"WITH {_R} SELECT run_id, coalesce(regexp_matches(lower(error), '429|rate limit|500|502|503|504|overloaded|timeout|timed out|connection|server error|temporarily unavailable'), false) AS transient FROM r WHERE error IS NOT NULL")
def transient_classify(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).where("error is not null").select("run_id", T.is_transient(F.col("error")).alias("transient"))


@query("SELECT event_id, ts, user_id, event_type FROM events")
def event_log(spark: SparkSession, d: str) -> DataFrame:
    return data.read_table(spark, d, "events").select("event_id", "ts", "user_id", "event_type").orderBy("ts", "event_id")


@query(f"WITH {_R} SELECT channel, arg_max(session_key, {{'a': started_at, 'b': session_key}}) AS session_key FROM r WHERE started_at IS NOT NULL AND session_key IS NOT NULL GROUP BY 1")
def latest_session(spark: SparkSession, d: str) -> DataFrame:
    rows = _runs(spark, d).where("started_at is not null and session_key is not null")
    return rows.groupBy("channel").agg(F.max_by("session_key", F.struct("started_at", "session_key")).alias("session_key"))


@query("WITH w AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20') SELECT user_id, event_id, ts, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM w) WHERE nth <= 20")
def range_scan_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last 20 events of each user in a half-open range of dates; the range reaches the scan."""
    w = data.read_table(spark, d, "events").where("ts >= timestamp_ntz '2024-01-05' and ts < timestamp_ntz '2024-01-20'")
    return Q.last_n(w, ["user_id"], ["ts", "event_id"], 20).select("user_id", "event_id", "ts", "nth")


@query(f"WITH {_R} SELECT session_key, run_id, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY started_at DESC, run_id DESC) AS nth FROM r WHERE session_key IS NOT NULL AND started_at IS NOT NULL) WHERE nth <= 20")
def ring_last_n(spark: SparkSession, d: str) -> DataFrame:
    rows = _runs(spark, d).where("session_key is not null and started_at is not null")
    return Q.last_n(rows, ["session_key"], ["started_at", "run_id"], 20).select("session_key", "run_id", "nth")


# --- schedules: an event is an entry of a schedule ---

def _sql_cron(now: str) -> str:
    """The next time of ``minute hour * * weekday`` in UTC: one of the eight days from today on."""
    t = f"({now} - {now} % 86400000 + d * 86400000 + (job_id % 24) * 3600000 + (job_id % 60) * 60000)"
    return f"list_min(list_filter(list_transform(range(0, 8), lambda d: CASE WHEN {t} > {now} AND ({now} // 86400000 + d + 4) % 7 = job_id % 7 THEN {t} END), lambda t: t IS NOT NULL))"


def _sql_next(now: str) -> str:
    return f"CASE WHEN kind = 'at' AND at_ms > {now} THEN at_ms WHEN kind = 'every' AND every_ms > 0 THEN {now} + every_ms WHEN kind = 'cron' THEN {_sql_cron(now)} END"


_J = f"j AS (SELECT event_id AS job_id, CASE event_type WHEN 'view' THEN 'at' WHEN 'click' THEN 'every' WHEN 'signup' THEN 'every' WHEN 'purchase' THEN 'cron' ELSE 'off' END AS kind, (epoch_us(ts) // 1000) AS at_ms, CAST(CAST(props->>'k' AS BIGINT) * CASE WHEN event_type = 'click' THEN 60000 ELSE 1500 END AS BIGINT) AS every_ms FROM events), n AS (SELECT (epoch_us(max(ts)) // 1000) - 432000000 AS now_ms FROM events), nr AS (SELECT job_id, kind, at_ms, every_ms, now_ms, {_sql_next('now_ms')} AS next_ms FROM j, n)"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    e = data.read_table(spark, d, "events")
    t = F.col("event_type")
    kind = F.when(t == "view", "at").when(t.isin("click", "signup"), "every").when(t == "purchase", "cron").otherwise("off")
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    now = e.agg(F.max(ms("ts"))).first()[0] - 432_000_000
    every = F.get_json_object("props", "$.k").cast("long") * F.when(t == "click", 60_000).otherwise(1500)
    job = F.col("event_id")
    expr = F.when(t == "purchase", F.concat_ws(" ", (job % 60).cast("string"), (job % 24).cast("string"), F.lit("* *"), (job % 7).cast("string")))
    rows = e.select(job.alias("job_id"), (kind != "off").alias("enabled"), kind.alias("kind"), ms("ts").alias("at_ms"), every.alias("every_ms"), expr.alias("expr"), F.lit("UTC").alias("tz"), F.lit(now).alias("now_ms"))
    return rows.withColumn("next_ms", S.next_of(F.col("kind"), F.col("at_ms"), F.col("every_ms"), F.col("expr"), F.col("tz"), F.col("now_ms")))


@query(f"WITH {_J} SELECT job_id, kind, next_ms FROM nr")
def next_run(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).select("job_id", "kind", "next_ms")


@query(f"WITH {_J} SELECT job_id, next_ms FROM nr WHERE kind = 'cron'")
def next_cron(spark: SparkSession, d: str) -> DataFrame:
    """Cron entries at an expression that depends on the job."""
    return _jobs(spark, d).where("kind = 'cron'").select("job_id", "next_ms")


@query(f"WITH {_J}, t AS (SELECT *, now_ms + 3600000 AS later, kind <> 'off' AND coalesce(next_ms <= now_ms + 3600000, false) AS ran FROM nr) SELECT job_id, ran, kind <> 'off' AND NOT (ran AND kind = 'at') AS enabled, CASE WHEN ran AND kind = 'at' THEN NULL WHEN ran THEN {_sql_next('later')} ELSE next_ms END AS next_ms FROM t")
def cron_tick(spark: SparkSession, d: str) -> DataFrame:
    """The jobs after a turn of the scheduler an hour on."""
    return S.tick(_jobs(spark, d), F.col("now_ms") + 3_600_000).select("job_id", "ran", "enabled", "next_ms")


@query(f"WITH {_J} SELECT min(next_ms) AS next_ms FROM nr")
def next_wake(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).agg(F.min("next_ms").alias("next_ms"))


@query(f"WITH {_J} SELECT job_id FROM nr WHERE next_ms <= now_ms + 3600000")
def due_jobs(spark: SparkSession, d: str) -> DataFrame:
    """What is due an hour on."""
    return _jobs(spark, d).where("next_ms <= now_ms + 3600000").select("job_id")


@query(f"WITH {_J} SELECT job_id, next_ms, row_number() OVER (ORDER BY next_ms ASC NULLS LAST, job_id) AS nth FROM nr ORDER BY nth LIMIT 100")
def jobs_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred by next run, entries without one last. A number is given to the hundred only."""
    top = _jobs(spark, d).orderBy(F.col("next_ms").asc_nulls_last(), "job_id").limit(100)
    from pyspark.sql import Window

    return top.select("job_id", "next_ms", F.row_number().over(Window.orderBy(F.col("next_ms").asc_nulls_last(), "job_id")).cast("bigint").alias("nth"))


@query(f"WITH {_J} SELECT job_id, CASE WHEN kind = 'cron' THEN 'cron: 0 9 * * * (UTC)' WHEN kind = 'every' AND every_ms > 0 THEN 'every ' || CASE WHEN every_ms % 3600000 = 0 THEN every_ms // 3600000 || 'h' WHEN every_ms % 60000 = 0 THEN every_ms // 60000 || 'm' WHEN every_ms % 1000 = 0 THEN every_ms // 1000 || 's' ELSE every_ms || 'ms' END ELSE kind END AS timing FROM nr")
def fmt_schedule(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).select("job_id", S.timing(F.col("kind"), F.col("every_ms"), F.lit("0 9 * * *"), F.lit("UTC")).alias("timing"))


@query("SELECT event_id, (epoch_us(ts) // 1000) AS ms, (epoch_us(date_trunc('day', ts)) // 1000) + 15000 * (event_id % 100) AS shifted_ms FROM events")
def ts_materialize(spark: SparkSession, d: str) -> DataFrame:
    """ISO text to epoch milliseconds, and the day's start plus 15 seconds for each place in a batch."""
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    ms = F.unix_millis(F.try_to_timestamp(iso))
    day = F.unix_millis(F.date_trunc("day", F.col("ts").cast("timestamp")))
    return data.read_table(spark, d, "events").select("event_id", ms.alias("ms"), (day + 15_000 * (F.col("event_id") % 100)).alias("shifted_ms"))


@query("SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M') AS local FROM events")
def tz_render(spark: SparkSession, d: str) -> DataFrame:
    return data.read_table(spark, d, "events").select("event_id", F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Kolkata"), "yyyy-MM-dd HH:mm").alias("local"))


# --- streams in batch form ---


@query("WITH g AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 120 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) SELECT CAST(user_id AS VARCHAR) AS user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS entries FROM g GROUP BY user_id, nth")
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    """A buffer that each entry holds open for two hours: bursts parted by a quiet gap, cell by cell as sessions are."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = data.read_table(spark, d, "events").select(F.col("user_id").cast("string").alias("session_key"), us.alias("start_us"), us.alias("end_us"), F.lit(1).cast("long").alias("n_runs"))
    return sessionize(rows, 7_200_000_000).select(F.col("session_key").alias("user_id"), "start_us", "end_us", F.col("n_runs").alias("entries"))


_T = "t AS (SELECT case_id, turn - 1 AS turn, m.role AS role, coalesce(m.content, '') AS content, m.timestamp AS ts FROM (SELECT DISTINCT case_id, conversation FROM cases WHERE case_id IS NOT NULL), LATERAL (SELECT unnest(conversation) AS m, unnest(range(1, len(conversation) + 1)) AS turn))"
_COST = "c AS (SELECT case_id, turn, role, length(content) // 4 + 4 AS cost FROM t)"


def _costs(spark: SparkSession, d: str) -> DataFrame:
    return data.turns(spark, d).select("case_id", "turn", "role", T.token_estimate(F.col("content")).alias("cost"))


@query(f"WITH {_T}, f AS (SELECT *, trim(content) <> '' AS d, suffix(content, '?') AS e FROM t), s AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND d AND lag(d) OVER w AND NOT lag(e) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS b FROM f WINDOW w AS (PARTITION BY case_id ORDER BY turn)), i AS (SELECT *, sum(b) OVER (PARTITION BY case_id ORDER BY turn) AS island FROM s) SELECT case_id, CAST(island AS BIGINT) AS island, any_value(role) AS role, string_agg(content, '' ORDER BY turn) AS content, bool_or(e) AS ended FROM i GROUP BY 1, 2")
def coalesce_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring turns of one role joined to one message; a turn without text joins none, a question ends its message."""
    t = data.turns(spark, d).select("case_id", "turn", "role", "content", (F.trim("content") != "").alias("delta"), F.col("content").endswith("?").alias("end"))
    parts = ST.coalesced(t, ["case_id"], "turn", ["role"], "content", "delta", "end")
    return parts.select("case_id", "island", "role", "content", "ended")


@query("WITH c AS (SELECT event_id, user_id, CAST(props->>'k' AS BIGINT) AS k, max(CAST(props->>'k' AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS cursor FROM events) SELECT event_id, user_id, cursor, k < cursor AS rejected FROM c")
def cursor_running_max(spark: SparkSession, d: str) -> DataFrame:
    """A cursor that never goes back, and which places it rejects."""
    rows = data.read_table(spark, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return Q.running_max(rows, ["user_id"], "event_id", "k", "cursor").select("event_id", "user_id", "cursor", (F.col("k") < F.col("cursor")).alias("rejected"))


@query("WITH e AS (SELECT user_id, event_id, CAST(props->>'k' AS BIGINT) AS seq, event_id % 2 AS half FROM events), c AS (SELECT user_id, max(seq) AS cursor FROM e WHERE half = 0 GROUP BY 1) SELECT event_id, e.user_id FROM e JOIN c USING (user_id) WHERE half = 1 AND seq > cursor")
def cursor_accepted(spark: SparkSession, d: str) -> DataFrame:
    """Of the second half of the events those that the cursors set by the first half take; users new in it are skipped."""
    e = data.read_table(spark, d, "events").select("event_id", F.col("user_id").alias("key"), F.get_json_object("props", "$.k").cast("long").alias("seq"))
    cursors, _ = ST.advance_cursors(spark.createDataFrame([], "key bigint, cursor bigint"), e.where("event_id % 2 = 0"))
    _, taken = ST.advance_cursors(cursors, e.where("event_id % 2 = 1"))
    return taken.select("event_id", F.col("key").alias("user_id"))


@query(f"WITH {_T}, {_COST}, r AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY case_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS removed FROM c), b AS (SELECT * FROM r WHERE turn > 0 AND role = 'user') SELECT case_id, CAST(coalesce(min(turn) FILTER (removed >= 100), max(turn)) AS INT) AS boundary, CAST(coalesce(min(removed) FILTER (removed >= 100), max(removed)) AS BIGINT) AS removed FROM b GROUP BY 1")
def consolidation_boundary(spark: SparkSession, d: str) -> DataFrame:
    return Q.consolidation_boundary(_costs(spark, d), "case_id", 100).select("case_id", "boundary", "removed")


@query(f"WITH {_T}, n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY turn DESC) AS n FROM t), c AS (SELECT * FROM n WHERE n <= 4), f AS (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY case_id) AS first FROM c) SELECT case_id, CAST(turn AS INT) AS turn, role FROM f WHERE first IS NULL OR turn >= first")
def history_suffix(spark: SparkSession, d: str) -> DataFrame:
    return Q.history_suffix(data.turns(spark, d), "case_id", 4).select("case_id", "turn", "role")


@query(f"WITH {_T}, n AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS n, row_number() OVER (PARTITION BY case_id ORDER BY turn) AS nth FROM t), f AS (SELECT *, CASE WHEN n <= 4 THEN 1 ELSE coalesce(max(nth) FILTER (role = 'user' AND nth <= greatest(n - 3, 1)) OVER (PARTITION BY case_id), 1) END AS first FROM n) SELECT case_id, CAST(turn AS INT) AS turn, role FROM f WHERE nth >= first")
def retain_suffix(spark: SparkSession, d: str) -> DataFrame:
    return Q.retain_suffix(data.turns(spark, d), "case_id", 4).select("case_id", "turn", "role")


@query(f"WITH {_T} SELECT case_id, string_agg('[' || coalesce(strftime(ts, '%Y-%m-%dT%H:%M'), '?') || '] ' || upper(coalesce(role, '?')) || ': ' || content, chr(10) ORDER BY turn) AS log FROM t WHERE content <> '' GROUP BY 1")
def format_messages(spark: SparkSession, d: str) -> DataFrame:
    t = data.turns(spark, d).where("content <> ''")
    line = T.message_line(F.col("ts"), F.col("role"), F.array().cast("array<string>"), F.col("content"))
    return t.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l")).select("case_id", F.array_join(F.col("l.line"), "\n").alias("log"))


@query(f"WITH {_T} SELECT case_id, string_agg(content, chr(10) || chr(10) ORDER BY ts NULLS LAST, turn) AS history FROM t WHERE trim(content) <> '' GROUP BY 1")
def history_render(spark: SparkSession, d: str) -> DataFrame:
    """The history in the order of time, blank entries left out, entries without a time last."""
    t = data.turns(spark, d).where(F.trim("content") != "")
    item = F.struct(F.col("ts").isNull().alias("z"), "ts", "turn", "content")
    return t.groupBy("case_id").agg(F.array_sort(F.collect_list(item)).alias("l")).select("case_id", F.array_join(F.col("l.content"), "\n\n").alias("history"))
