import sys

import pytest
from pyspark import cloudpickle

from larkspur.functions import backends as B


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Wrong:
    dimension = 3

    def embed(self, texts):
        return [[0.0] * 2 for _ in texts]


class Counting(B.HashEmbedder):
    def embed(self, texts):
        assert len(texts) <= 10
        return super().embed(texts)


def test_embed(spark):
    df = spark.createDataFrame([(k, f"word {k}") for k in range(25)] + [(99, None), (None, "x")], "id long, text string")
    rows = B.embed(df, "id", "text", Counting(8)).collect()
    assert len(rows) == 25 and all(len(r.v) == 8 for r in rows)
    with pytest.raises(Exception, match="reply"):
        B.embed(df, "id", "text", Wrong()).collect()


def test_rerank(spark):
    df = spark.createDataFrame([(1, "a b", 1, "a b c"), (1, "a b", 2, "b"), (2, "", 1, "x"), (2, None, 3, "x")], "query_id long, query string, key long, text string")
    got = {(r.query_id, r.key): r.rerank_score for r in B.rerank(df, B.OverlapReranker()).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.5, (2, 1): 0.0}


def test_a_query_makes_one_call(spark):
    class Whole:
        def score(self, query, texts):
            assert len(texts) == 40
            return [float(len(t)) for t in texts]

    df = spark.createDataFrame([(q, "q", k, "x" * k) for q in range(3) for k in range(40)], "query_id long, query string, key long, text string").repartition(7)
    assert B.rerank(df, Whole()).where("rerank_score = key").count() == 120


def test_assessor(spark):
    import time

    def judge(query, texts):
        return {"good": {"status": "sufficient", "reason": "all there"}, "odd": {"status": "maybe"}, "bad": "no", "slow": None}[query] if query != "slow" else time.sleep(3)

    def broken(query, texts):
        return 1 / 0 if query == "fails" else judge(query, texts)

    df = spark.createDataFrame([(1, "good", ["a"]), (2, "odd", ["a"]), (3, "bad", ["a"]), (4, "good", []), (5, "fails", ["a"]), (6, "slow", ["a"]), (7, "good", None)], "query_id long, query string, texts array<string>")
    got = {r.query_id: (r.status, r.reason) for r in B.assess(df, broken, 0.5).collect()}
    assert got[1] == ("sufficient", "all there") and got[4][0] == got[7][0] == "no_evidence"
    assert {k: got[k][0] for k in (2, 3, 5, 6)} == dict.fromkeys((2, 3, 5, 6), "assessment_error") and got[6][1] == "timeout"


def test_tools():
    t = B.Tools()
    schema = {"properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["integer", "null"]}}, "required": ["a"]}
    t.add("add", lambda a, b=0: a + (b or 0), schema)
    assert t.run("add", a="1", b=2) == 3 and t.run("add", a=1, b=None) == 1
    for bad in ({"b": 1}, {"a": -1}, {"a": "x"}):
        with pytest.raises(ValueError):
            t.run("add", **bad)
    with pytest.raises(ValueError):
        t.add("add", print, schema)
    with pytest.raises(KeyError):
        t.run("none")


def test_plug_ins():
    found = B.plug_ins("console_scripts")
    assert found and all(callable(x) for x in found.values())
    assert B.plug_ins("no such group") == {}


def test_observers_fail_alone():
    seen = []
    p = B.Progress(lambda e: 1 / 0, seen.append)
    p.onQueryProgress("e")
    assert seen == ["e"] and p.failures == 1
