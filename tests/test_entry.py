import __spark_entry__ as entry


def test_every_sql_has_its_query():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 80
    assert "bm25_topk" in q and "p1_found" in q
