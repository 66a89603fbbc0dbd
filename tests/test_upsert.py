from datetime import datetime

import pytest
from pyspark.sql import functions as F

from larkspur.operators import upsert as U

IN = "final_url string, title string, text string, content_hash string, status int, seen_at timestamp_ntz"


def lines(pages):
    return pages.select("final_url", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("nth", "word"))


def at(day):
    return datetime(2024, 1, day)


@pytest.fixture
def store(spark, tmp_path):
    return U.PageStore(spark, str(tmp_path / "pages"), lines, "final_url string, nth int, word string", fan=2)


def test_pages_are_replaced_touched_and_kept(spark, store):
    make = lambda *rows: spark.createDataFrame(list(rows), IN)
    status = {r.final_url: r.status for r in store.apply(make(("a", "A", "x y", "1", 200, at(1)), ("b", None, None, None, 200, at(1)), (None, "n", "n", "n", 200, at(1)), ("c", "C", "old", "0", 200, at(1)), ("c", "C", "p q r", "1", 200, at(2)))).collect()}
    assert status == dict.fromkeys("abc", "inserted")
    status = {r.final_url: r.status for r in store.apply(make(("a", "A2", "x y", "1", 200, at(5)), ("b", "B", "new", "2", 200, at(5)))).collect()}
    assert status == {"a": "unchanged", "b": "updated"}
    got = {r.final_url: r for r in store.pages().collect()}
    assert (got["a"].title, got["a"].updated_at, got["a"].last_seen_at, got["a"].created_at) == ("A2", at(1), at(5), at(1))
    assert (got["b"].updated_at, got["b"].created_at) == (at(5), at(1)) and got["c"].last_seen_at == at(2)
    words = {}
    for r in store.dependants().collect():
        words.setdefault(r.final_url, []).append(r.word)
    assert {k: sorted(v) for k, v in words.items()} == {"a": ["x", "y"], "b": ["new"], "c": ["p", "q", "r"]}
    store.apply(make(("b", "B", "new", "2", 200, at(5))))  # again: nothing but a version changes
    assert {r.final_url: r.updated_at for r in store.pages().collect()} == {"a": at(1), "b": at(5), "c": at(2)} and store.dependants().count() == 6


def test_seen_pages_are_touched_or_refused(spark, store):
    store.apply(spark.createDataFrame([("a", "A", "x", "1", 200, at(3))], IN))
    seen = lambda url, day: spark.createDataFrame([(url, at(day))], "final_url string, seen_at timestamp_ntz")
    store.mark_seen(seen("a", 9))
    store.mark_seen(seen("a", 4))
    r = store.pages().first()
    assert (r.last_seen_at, r.updated_at) == (at(9), at(3)) and store.dependants().count() == 1
    with pytest.raises(KeyError):
        store.mark_seen(seen("unknown", 9))
    assert store.version() == 3


def test_empty_batches(spark, store):
    assert store.apply(spark.createDataFrame([], IN)).count() == 0 and store.pages().count() == 0
