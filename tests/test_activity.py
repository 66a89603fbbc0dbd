from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from larkspur.functions import schedule as S
from larkspur.operators import observe as O
from larkspur.operators import sequences as Q
from larkspur.operators import upsert as U

RUNS = "run_id string, started_at timestamp_ntz, duration_ms double, status string, stop_reason string"


def runs(spark, rows):
    return spark.createDataFrame(rows, RUNS)


def test_overview(spark):
    now = datetime(2024, 1, 2)
    at = datetime(2024, 1, 1, 12)
    rows = [("a", at, 10.0, "completed", "completed"), ("b", at, 11.0, "completed", "completed"), ("c", at, 12.0, "completed", "tool_error"), ("d", now, 99.0, "completed", "completed"), ("e", at, 500.0, "running", None)]
    calls = '{"calls": [{"name": "x", "status": "error"}, {"name": "y", "status": "ok"}, {"status": "error"}]}'
    events = spark.createDataFrame([("a", "tools", calls), ("d", "tools", calls), ("b", "tools", "broken"), ("b", "tools", None), ("c", "usage", calls)], "run_id string, kind string, data string")
    r = O.overview(runs(spark, rows), F.lit(now).cast("timestamp_ntz"), events=events).first()
    assert (r.runs, r.success_rate, r.avg_ms, r.p95_ms, r.tool_errors) == (4, round(2 / 3, 6), 11.0, 12.0, 2)
    empty = O.overview(runs(spark, []), F.lit(now).cast("timestamp_ntz")).first()
    assert (empty.runs, empty.success_rate, empty.p95_ms) == (0, None, None)
    buckets = O.hourly_buckets(runs(spark, rows), F.lit(now).cast("timestamp_ntz")).collect()
    assert len(buckets) == 24 and sum(b.runs for b in buckets) == 4


def test_pages_overlap_nowhere(spark):
    at = datetime(2024, 1, 1)
    df = runs(spark, [(k, at, 1.0, "completed", "completed") for k in "abcde"])
    seen, cursor, pages = [], None, 0
    while pages == 0 or cursor:
        page, cursor = O.keyset_page(df, 2, cursor)
        seen += [r.run_id for r in page]
        pages += 1
    assert seen == list("edcba") and pages == 3
    for bad in ("?", O.encode_cursor("x", "y")[:-4], "WzFd"):
        with pytest.raises(ValueError):
            O.decode_cursor(bad)
    for bad in (0, 101):
        with pytest.raises(ValueError):
            O.keyset_page(df, bad)


def test_runs_fold_out_of_their_log(spark):
    rows = spark.createDataFrame([("a", "k", "c", "m", datetime(2024, 1, 1), None, None, None, None, None, 5, None, False, datetime(2024, 1, 1)), ("a", "k", "c", "m", None, datetime(2024, 1, 2), 7.0, "completed", "completed", None, None, 3, True, datetime(2024, 1, 2)), ("b", "k", "c", "m", datetime(2024, 1, 1), None, None, None, None, None, None, None, None, None)], "run_id string, session_key string, channel string, model string, started_at timestamp_ntz, finished_at timestamp_ntz, duration_ms double, status string, stop_reason string, error string, prompt_tokens long, completion_tokens long, usage_reported boolean, logged_at timestamp_ntz")
    log = O.started(rows.where("started_at is not null")).unionByName(O.finished(rows.where("finished_at is not null"))).unionByName(O.used(rows))
    got = {r.run_id: r for r in O.fold_runs(log).collect()}
    assert (got["a"].status, got["a"].prompt_tokens, got["a"].completion_tokens, got["a"].usage_reported, got["a"].duration_ms) == ("completed", 5, 3, True, 7.0)
    assert (got["b"].status, got["b"].finished_at, got["b"].usage_reported) == ("running", None, False)


def test_tick(spark):
    schema = "id int, enabled boolean, kind string, at_ms long, every_ms long, expr string, tz string, next_ms long"
    df = spark.createDataFrame([(1, True, "at", 50, None, None, None, 50), (2, True, "every", None, 30, None, None, 90), (3, True, "every", None, 30, None, None, 200), (4, True, "cron", None, None, "0 0 * * *", "UTC", 100), (5, False, "every", None, 30, None, None, 1), (6, True, "cron", None, None, "bad", "UTC", None)], schema)
    got = {r.id: (r.ran, r.enabled, r.next_ms) for r in S.tick(df, F.lit(100).cast("long")).collect()}
    assert got == {1: (True, False, None), 2: (True, True, 130), 3: (False, True, 200), 4: (True, True, 86_400_000), 5: (False, False, 1), 6: (False, True, None)}


def test_cron():
    utc = lambda t: datetime.fromtimestamp(t / 1000, UTC).replace(tzinfo=None)
    base = 1704067200000  # 2024-01-01 00:00 UTC, a Monday
    assert utc(S.next_cron("30 9 * * *", base)) == datetime(2024, 1, 1, 9, 30)
    assert utc(S.next_cron("0 0 * * 0", base)) == datetime(2024, 1, 7)
    assert utc(S.next_cron("0 9 * * *", base, "Europe/Berlin")) == datetime(2024, 1, 1, 8)
    assert utc(S.next_cron("*/15 * 1 * *", base)) == datetime(2024, 1, 1, 0, 15)
    assert S.next_cron("bad", base) is None and S.next_cron("0 9 * * *", base, "No/Where") is None


def turns(spark, roles, cost=120):
    return spark.createDataFrame([("s", k, r, cost) for k, r in enumerate(roles)], "key string, turn int, role string, cost int")


def test_consolidation_boundary(spark):
    t = turns(spark, ["user", "assistant", "user", "assistant", "user"])
    r = Q.consolidation_boundary(t, "key", 400).first()
    assert (r.boundary, r.removed) == (4, 480)
    assert Q.consolidation_boundary(turns(spark, ["user", "assistant"]), "key", 1).count() == 0


def test_suffixes(spark):
    t = turns(spark, ["user"] * 10)
    assert [r.turn for r in Q.retain_suffix(t, "key", 4).orderBy("turn").collect()] == [6, 7, 8, 9]
    mixed = turns(spark, ["user", "assistant", "assistant", "user", "assistant"])
    assert [r.turn for r in Q.retain_suffix(mixed, "key", 3).orderBy("turn").collect()] == [0, 1, 2, 3, 4]
    assert [r.turn for r in Q.history_suffix(mixed, "key", 3).orderBy("turn").collect()] == [3, 4]
    assert Q.history_suffix(mixed, "key", 0).count() == 5


TALK = "key string, turn int, role string, tool_calls array<struct<id:string>>, tool_call_id string"


def talk(spark, *conversations):
    rows = []
    for name, entries in conversations:
        for k, e in enumerate(entries):
            calls = [(i,) for i in e[1:].split()] if e.startswith("c") else None
            rows.append((name, k, {"c": "assistant", "r": "tool", "u": "user"}[e[0]], calls, e[1:].strip() if e[0] == "r" else None))
    return spark.createDataFrame(rows, TALK)


def slow_start(entries):
    """By trying every start: the first from which each result's latest call is not cut off."""
    for start in range(len(entries) + 1):
        known = lambda k, i: max((j for j in range(k) if entries[j][0] == "c" and i in entries[j][1:].split()), default=-1)
        if all(known(k, e[1:].strip()) >= start for k, e in enumerate(entries) if k >= start and e[0] == "r"):
            return start


def test_legal_starts_match_every_start_tried(spark):
    from random import Random

    r = Random(11)
    made = [(f"k{n}", [r.choice(["u", f"c {r.choice('abc')}", f"c {r.choice('ab')} {r.choice('cd')}", f"r {r.choice('abcd')}"]) for _ in range(r.randint(1, 14))]) for n in range(120)]
    got = {x.key: x.legal_from for x in Q.legal_starts(talk(spark, *made), "key").collect()}
    assert got == {k: (s if (s := slow_start(e)) < len(e) else None) for k, e in made}


def test_suffixes_drop_results_without_their_call(spark):
    rows = [("a", ["u", "c x", "r x", "u", "c y z", "r y", "r z", "c"]), ("b", ["u", "c x", "u", "r x", "u"])]
    left = {k: [x.turn for x in Q.history_suffix(talk(spark, *rows), "key", 3).where(F.col("key") == k).orderBy("turn").collect()] for k in "ab"}
    assert left == {"a": [7], "b": [4]}
    kept = Q.retain_suffix(talk(spark, *rows), "key", 3).orderBy("key", "turn").collect()
    assert [(x.key, x.turn, x.dropped) for x in kept] == [*(("a", k, 3) for k in range(3, 8)), ("b", 4, 4)]


def test_islands_match_a_plain_window(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("g"), "id", (F.floor(F.col("id") / 7) % 3).cast("int").alias("v"), F.when(F.col("id") % 50 < 40, "a").alias("s"))
    got = {(r.g, r.id): r.island for r in Q.islands(df, ["g"], "id", ["v", "s"], width=30).collect()}
    for g in (0, 1):
        last, n = object(), 0
        for r in df.where(F.col("g") == g).orderBy("id").collect():
            n += (r.v, r.s) != last
            last = (r.v, r.s)
            assert got[g, r.id] == n


def test_running_operators_match_plain_windows(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), "id", (F.col("id") * 7 % 11).alias("v"))
    got = Q.running_sum(df, ["g"], "id", "v", "s", 100).join(Q.running_max(df, ["g"], "id", "v", "m", 100).select("id", "m"), "id")
    from pyspark.sql import Window

    w = Window.partitionBy("g").orderBy("id")
    want = df.withColumns({"s2": F.sum("v").over(w), "m2": F.max("v").over(w)}).select("id", "s2", "m2")
    assert got.join(want, "id").where("s <> s2 or m <> m2").count() == 0 and got.count() == 5000
    assert Q.last_n(df, ["g"], ["id"], 20).count() == 60


def test_upsert(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), (None, "1")], "final_url string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("c", None)], "final_url string, content_hash string")
    got = {r.final_url: r.status for r in U.upsert_status(old, new).collect()}
    assert got == {"a": "unchanged", "b": "updated", "c": "unchanged", "d": "inserted"}
