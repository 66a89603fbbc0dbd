from datetime import datetime, timedelta
from random import Random

import pytest

from larkspur.operators.components import connected_components
from larkspur.operators.sessions import SessionTable, incremental_sessions, run_intervals, sessionize

SCHEMA = "run_id string, session_key string, started_at timestamp_ntz, finished_at timestamp_ntz, logged_at timestamp_ntz, count int"
GAP = timedelta(minutes=30)
T0 = datetime(2024, 1, 1)


def brute(rows):
    runs = {}
    for k, (rid, key, s, e, *_) in enumerate(rows):
        key = key.strip().lower() if key else ""
        if not key or s is None:
            continue
        e = max(s, e) if e else s
        rid = ("r", rid) if rid is not None else ("n", *rows[k])
        old = runs.get(rid)
        runs[rid] = (min(key, old[0]), min(s, old[1]), max(e, old[2])) if old else (key, s, e)
    out, keys = [], {}
    for key, s, e in sorted(runs.values(), key=lambda r: (r[0], r[1])):
        if key in keys and s < keys[key][1] + GAP:
            keys[key][1] = max(keys[key][1], e)
            keys[key][2] += 1
        else:
            if key in keys:
                out.append((key, *keys[key]))
            keys[key] = [s, e, 1]
    return sorted(out + [(k, *v) for k, v in keys.items()])


def us(t):
    return round((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def test_any_batches_give_the_brute_force_sessions(spark):
    r = Random(5)
    rows = []
    for k in range(400):
        s = T0 + timedelta(minutes=r.randint(0, 6000)) if r.random() > 0.05 else None
        e = s + timedelta(minutes=r.choice([-5, 0, 5, 29, 30, 200])) if s and r.random() > 0.2 else None
        rows.append((f"r{r.randint(0, 300)}" if r.random() > 0.05 else None, r.choice(["A ", "a", " b", "hot", "hot", "", None]), s, e, T0 + timedelta(minutes=r.randint(0, 900)) if r.random() > 0.05 else None, k))
    rows += rows[::9]  # repeated rows, without a run_id too
    want = [(k, us(s), us(e), n) for k, s, e, n in brute(rows)]
    df = spark.createDataFrame(rows, SCHEMA)
    for batches in (1, 4):
        got = sorted((x.session_key, x.start_us, x.end_us, x.n_runs) for x in incremental_sessions(df, batches).collect())
        assert got == want


def test_a_late_run_bridges_stored_sessions(spark, tmp_path):
    table = SessionTable(spark, str(tmp_path / "t"))
    row = lambda i, minute, end=None: (i, "k", T0 + timedelta(minutes=minute), T0 + timedelta(minutes=end or minute), T0, 0)
    df = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    table.update(df(row("a", 0), row("b", 60)))
    assert table.sessions().count() == 2
    table.update(df(row("c", 29, 31)))
    assert [(r.start_us, r.end_us, r.n_runs) for r in table.sessions().collect()] == [(us(T0), us(T0 + timedelta(minutes=60)), 3)]
    table.update(df(row("c", 29, 31)))  # seen before
    assert table.sessions().first().n_runs == 3
    table.update(df())
    assert table.sessions().count() == 1


def entry(i, key, minute, end=None):
    return (i, key, T0 + timedelta(minutes=minute), T0 + timedelta(minutes=minute if end is None else end), T0, 0)


def stored(table):
    return sorted((r.session_key, (r.start_us - us(T0)) // 60_000_000, (r.end_us - us(T0)) // 60_000_000, r.n_runs) for r in table.sessions().collect())


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_a_run_under_two_keys_takes_the_least_in_any_order(spark, tmp_path, order):
    """The run in the middle joins b's runs to one session until it is known to be a's."""
    batches = [[entry("x", "b", 20), entry("p", "b", 0), entry("q", "b", 45)], [entry("x", "a", 25)], [entry("r", "a", 40), entry("x", "c", 26)]]
    table = SessionTable(spark, str(tmp_path / "t"))
    for k in order:
        table.update(spark.createDataFrame(batches[k], SCHEMA))
    assert stored(table) == [("a", 20, 40, 2), ("b", 0, 0, 1), ("b", 45, 45, 1)]


def test_a_batch_fed_twice_changes_nothing(spark, tmp_path):
    table = SessionTable(spark, str(tmp_path / "t"))
    rows = [entry(None, "k", 0), entry(None, "k", 5), entry(None, "k", 5), entry("a", "k", 7)]
    df = spark.createDataFrame(rows, SCHEMA)
    for _ in range(3):
        table.update(df)
        assert stored(table) == [("k", 0, 7, 3)]


def test_many_batches_are_merged_and_old_segments_deleted(spark, tmp_path):
    import os

    table, rows = SessionTable(spark, str(tmp_path / "t"), fan=2), []
    r = Random(8)
    for n in range(7):
        batch = [entry(f"r{r.randint(0, 30)}", r.choice("abc"), r.randint(0, 900)) for _ in range(12)]
        rows += batch
        table.update(spark.createDataFrame(batch, SCHEMA))
    want = [(k, us(s), us(e), n) for k, s, e, n in brute(rows)]
    assert sorted(tuple(x) for x in table.sessions().select("session_key", "start_us", "end_us", "n_runs").collect()) == want
    assert len(table.manifest()["runs"]) <= 3 and len(table.manifest()["sessions"]) <= 3
    assert len([f for f in os.listdir(tmp_path / "t") if "-" in f]) <= 14


def test_what_a_batch_writes_follows_the_batch(spark, tmp_path):
    table = SessionTable(spark, str(tmp_path / "t"))
    table.update(spark.createDataFrame([entry(f"r{k}", f"k{k % 40}", k * 7) for k in range(4000)], SCHEMA))
    table.update(spark.createDataFrame([entry("new", "k1", 90_000), entry("r5", "k5", 35)], SCHEMA))
    size = lambda name: sum(spark.read.parquet(f).count() for _, f in table.manifest()[name][1:])
    assert size("runs") == 1 and size("sessions") == 1


def test_exactly_the_gap_opens(spark):
    gap = 30
    df = spark.createDataFrame([("k", 0, 0, 1), ("k", 30, 30, 1), ("k", 59, 59, 1)], "session_key string, start_us long, end_us long, n_runs long")
    assert sorted((r.start_us, r.end_us) for r in sessionize(df, gap).collect()) == [(0, 0), (30, 59)]


def test_empty(spark):
    assert incremental_sessions(spark.createDataFrame([], SCHEMA)).count() == 0
    assert run_intervals(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [1, 40])
def test_components(spark, n):
    chain = [(k, k + 1) for k in range(n)] + [(100, 200), (200, 100), (300, 300), (None, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert all(got[k] == 0 for k in range(n + 1)) and got[100] == got[200] == 100 and got[300] == 300
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_of_random_graphs(spark):
    r = Random(2)
    links = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
