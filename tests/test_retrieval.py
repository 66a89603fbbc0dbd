import math

import pytest
from pyspark.sql import functions as F

from larkspur.operators import retrieval as R


def test_bm25_against_the_formula(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "red red pear tree"), (3, "plum"), (4, None), (None, "x"), (5, "")], "doc_id long, text string")
    index = R.postings(docs)
    terms = R.query_postings(spark.createDataFrame([(7, "apple")], "query_id long, query string"))
    got = {(r.query_id, r.doc_id): r.bm25 for r in R.bm25(index, terms).collect()}
    n, avgdl = 3, (2 + 3 + 1) / 3
    idf = math.log((n - 1 + 0.5) / 1.5)
    assert got == {(7, 1): round(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / avgdl)), 6)}


def test_fusion_ties_go_to_the_smaller_key(spark):
    fts = spark.createDataFrame([(1, 2, 1), (1, 1, 2)], "query_id long, k long, rank int")
    vec = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id long, k long, rank int")
    rows = R.ranked(R.rrf([("fts", fts), ("vec", vec)], "k"), "rrf_score", "k", None).orderBy("rank").collect()
    assert [r.k for r in rows] == [1, 2] and rows[0].sources == "fts,vec"


def test_vector_search(spark):
    v = spark.createDataFrame([(1, [0.6, 0.8]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, None)], "id long, v array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, v array<float>")
    rows = R.vector_search(v, q, 10).orderBy("rank").collect()
    assert [(r.id, r.similarity) for r in rows] == [(2, 1.0), (1, 0.6), (3, 0.0), (4, 0.0)]  # a vector of another length has 0
    assert [r.id for r in R.vector_search(v, q, 2).orderBy("rank").collect()] == [2, 1]
    with pytest.raises(ValueError):
        R.vector_search(v, q, 10, "l2")
    near = R.vector_search(v.where("id < 4"), q, 2, "l2").orderBy("rank").collect()
    assert [(r.id, r.distance) for r in near] == [(2, 0.0), (1, round((0.4**2 + 0.8**2) ** 0.5, 6))]
    assert R.vector_search(v, q.where("false"), 10).count() == 0
    assert R.vector_search(v.where("false"), q, 10).count() == 0


def test_parent_bonus(spark):
    kids = spark.createDataFrame([(1, 10, 0.91), (1, 10, 0.80), (1, 20, 0.95)], "query_id long, parent_id long, rerank_score double")
    rows = R.parent_aggregate(kids).orderBy("parent_rank").collect()
    assert [r.parent_id for r in rows] == [20, 10] and 0.91 < rows[1].parent_score < 0.92 and rows[1].best == 0.91


def test_rejected_evidence_takes_no_slot(spark):
    rows = [(1, k, p, pr, k, s, cost, 10) for k, p, pr, s, cost in [(1, 1, 1, 0.9, 10), (2, 1, 1, 0.1, 10), (3, 1, 1, 0.8, 5000), (4, 1, 1, 0.7, 10), (5, 1, 1, 0.6, 10), (6, 2, 2, 0.5, 10)]]
    df = spark.createDataFrame(rows, "query_id long, child_id long, parent_id long, parent_rank int, rerank_rank int, rerank_score double, child_cost long, parent_cost long")
    assert [r.child_id for r in R.evidence_select(df).orderBy("nth").collect()] == [1, 4, 6]


def test_search_in_blocks_is_exact(spark):
    import numpy as np

    r = np.random.default_rng(4)
    v = np.round(r.normal(size=(300, 8)), 2).astype(np.float32)
    v[7] = v[3]  # a tie
    df = spark.createDataFrame([(k, [float(y) for y in x]) for k, x in enumerate(v)], "id long, v array<float>")
    q = df.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    got = {}
    for x in R.vector_search(df, q, 6, block=16).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.id)
    w = v.astype(float)
    cos = np.round(w @ w.T / np.sqrt((w * w).sum(1))[:, None] / np.sqrt((w * w).sum(1))[None, :], 6)
    assert got == {k: [int(j) for j in np.lexsort((np.arange(300), -cos[k]))[:6]] for k in range(0, 300, 5)}


def test_guarded_cosine_and_normalising(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(R.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0]
    assert spark.createDataFrame([([3.0, 4.0],)], "v array<double>").select(R.normalized(F.col("v"))).first()[0] == [0.6, 0.8]
    with pytest.raises(Exception, match="zero vector"):
        spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(R.normalized(F.col("v")).alias("n")).collect()


def test_budget_counts_the_block_and_goes_on(spark):
    df = spark.createDataFrame([("a", k, "x" * n) for k, n in enumerate([20, 400, 40, 8])], "g string, k long, line string")
    r = R.budget_pack(df, ["g"], ["k"], "line", 20, "k", head=10).first()
    # 10 + 1 + 20 and 1 + 8 characters; 1 + 40 more would be 21 tokens
    assert (r.used, r.n_kept, r.kept) == ((31 + 9) // 4 + 4, 2, [0, 3])
    assert R.budget_pack(df, ["g"], ["k"], "line", 4, "k").first().used == 0


def test_requests_lose_facts_then_evidence(spark):
    ev = [(1, 10, 20, 30), (2, 10, 20, 30), (3, 11, 20, 30)]  # 60 and 60 in all
    rows = [(1, 100, [10, 10], ev, "sufficient"), (2, 265, [10, 10], ev, "sufficient"), (3, 300, [10], ev, "insufficient"), (4, 380, [], ev, "sufficient"), (5, 400, None, ev, "error"), (6, 401, None, None, "no_evidence"), (7, 350, [], ev, "no_evidence")]
    df = spark.createDataFrame(rows, "query_id long, core long, facts array<long>, evidence array<struct<child_id:long,parent_id:long,child_cost:long,parent_cost:long>>, status string")
    got = {r.query_id: (r.n_facts, r.children, r.parents, r.status, r.fits) for r in R.fit_request(df, 400).collect()}
    assert got[1] == (2, [1, 2, 3], [10, 11], "sufficient", True)
    assert got[2] == (1, [1, 2, 3], [10, 11], "sufficient", True)  # 265 + 10 + 120, a second fact would be too much
    assert got[3] == (0, [1, 2], [10], "insufficient", True)
    assert got[4] == (0, [], [], "insufficient", True) and got[5] == (0, [], [], "error", True)
    assert got[6] == (0, [], [], "no_evidence", False) and got[7] == (0, [1], [10], "no_evidence", True)


@pytest.mark.parametrize("lane,block", [(1 << 20, 1 << 17), (40, 5)])
def test_best_of_lanes_are_the_best_of_all(spark, lane, block):
    import random

    r = random.Random(5)
    words = [f"w{k}" for k in range(40)] + ["a_b", "a_a_b", "_x", "running", "runs", "漢字", "漢字語"]
    rows = [(k, " ".join(r.choices(words, [1 / (x + 1) for x in range(len(words))], k=r.randint(1, 12)))) for k in range(150)]
    docs = spark.createDataFrame([*rows, *((k + 1000, t) for k, t in rows[:60]), (5000, None), (None, "w1"), (5001, "_ !")], "doc_id long, text string")  # copies tie
    queries = spark.createDataFrame([(k, " ".join(r.choices(words, k=4))) for k in range(30)] + [(99, "unheard"), (100, "")], "query_id long, query string")
    terms = R.query_postings(queries)
    want = R.ranked(R.bm25(R.postings(docs), terms), "bm25", "doc_id", 7)
    got = R.bm25_top(R.entries(docs), terms, 7, lane=lane, block=block)
    rows_of = lambda df: sorted((r.query_id, r.rank, r.doc_id, r.bm25) for r in df.collect())
    assert rows_of(got) == rows_of(want) and got.schema["doc_id"].dataType == want.schema["doc_id"].dataType


def test_entries_have_the_tokens_of_the_expression(spark):
    from larkspur.functions import text as T

    texts = ["Running runs_ed _x__ ab_ab_ab s ss Ass 漢字語A 語", "snake_case_ing cases_", "___", "", "ÄRunnings été", "a A a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {}
    for r in df.select("doc_id", T.index_text(F.col("text")).alias("t")).collect():
        parts = [p for p in r.t.replace("_", " ").split(" ") if p]
        want |= {(r.doc_id, p): (parts.count(p), len(parts)) for p in parts}
    assert {(r.doc_id, r.token): (r.tf, r.dl) for r in R.postings(df).collect()} == want


SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["bm25_topk", "consistency_matrix", "fit_request", "rrf_fuse", "beir_diagnostics", "doc_dedupe_rank", "parent_aggregate", "search_local", "lexical_gate", "rerank_rank"])
def test_pairs_of_queries_and_documents_are_no_rows(spark, monkeypatch, name):
    from larkspur.plans import catalog

    def pairs(*a, **k):
        raise AssertionError("a row for each query and document that share a term")

    monkeypatch.setattr(R, "bm25", pairs)
    assert catalog.queries()[name](spark, SMALL).count() > 0


def test_only_chosen_children_are_tokenized(spark):
    from larkspur.plans import search

    chosen = spark.createDataFrame([(50, 1)], "query_id long, child_id long")
    plan = search._status(spark, SMALL, chosen)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    scan = next(k for k, line in enumerate(plan) if "Relation" in line and "child_id" in line)
    join = max(k for k, line in enumerate(plan[:scan]) if "Join" in line and "child_id" in line)
    assert any("regexp_extract_all" in line for line in plan[:join]) and not any("regexp_extract_all" in line for line in plan[join:scan])

def test_only_terms_asked_for_are_indexed(spark, monkeypatch):
    from larkspur.plans import catalog, data, search

    made = {}

    def kept(df, name):
        made[name] = R.keep(df, name)
        return made[name]

    monkeypatch.setattr(search, "keep", kept)
    assert catalog.queries()["rrf_fuse"](spark, SMALL).count() > 0
    terms = {r.token for r in R.query_postings(data.queries(spark, SMALL)).collect()}
    assert {r.token for r in R.flat(made["entries"], "child_id").select("token").distinct().collect()} <= terms


@pytest.mark.parametrize("few", [100, 1])
def test_entries_asked_for_rank_as_all_do(spark, few):
    docs = spark.createDataFrame([(1, "red Apples a_b"), (1, "red Apples a_b"), (2, "red pear 漢字"), (3, "plum of all apples")], "doc_id long, text string")
    terms = R.query_postings(spark.createDataFrame([(7, "red apples"), (8, "b 漢字")], "query_id long, query string"))
    asked = R.asked_for(terms, few)
    some, every = (R.entries(docs, asked=x, repeats=True) for x in (asked, None))
    assert isinstance(asked, bytes) == (few == 1) and some.count() == 3
    assert {r.token for r in R.flat(some).collect()} == {"red", "apples", "apple", "appl", "b", "漢字"}
    rows_of = lambda index: sorted((r.query_id, r.rank, r.doc_id, r.bm25) for r in R.bm25_top(index, terms, 2).collect())
    assert rows_of(some) == rows_of(every) == rows_of(R.entries(docs.distinct()))


def test_sums_of_common_terms_are_shared_rightly(spark):
    import random

    r = random.Random(8)
    common, rare = ["the", "of", "in", "to"], [f"n{k}" for k in range(60)]
    rows = [(k, " ".join(r.sample(common, r.randint(0, 4)) + r.choices(rare, k=r.randint(0, 3)))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asks = [(k, " ".join(r.sample(common, r.randint(0, 3)) + r.choices(rare, k=r.randint(0, 40)))) for k in range(60)]  # many rare terms touch all of the best
    terms = R.query_postings(spark.createDataFrame(asks, "query_id long, query string"))
    rows_of = lambda df: sorted((r.query_id, r.rank, r.doc_id, r.bm25) for r in df.collect())
    assert rows_of(R.bm25_top(R.entries(docs), terms, 3)) == rows_of(R.ranked(R.bm25(R.postings(docs), terms), "bm25", "doc_id", 3))


def test_terms_found_are_the_tokens_in_common(spark):
    from larkspur.functions import text as T

    texts = ["Running runs_ed _x__ ab_ab_ab s ss 漢字語A 語", "plain Words, with endings: running walked", "", None, "ÄRunnings été naïvely"]
    asks = ["running run runs ed x ab 漢字 語", "word walk ending plain none", "漢", "a"]
    rows = spark.createDataFrame([(q, t) for q in asks for t in texts], "query string, text string").withColumn("terms", T.query_terms(F.col("query")))
    got = R.with_found(rows).select(F.sort_array("found"), F.sort_array(F.array_intersect("terms", T.tokens(F.col("text"))))).collect()
    assert len(got) == len(asks) * len(texts) and all(a == b for a, b in got)


def tokens_of_queries_only(spark, monkeypatch, name):
    from larkspur.functions import text as T
    from larkspur.plans import catalog

    made = T.tokens

    def tokens(text):
        assert "query" in str(text), "children cut by an expression"
        return made(text)

    monkeypatch.setattr(T, "tokens", tokens)
    return catalog.queries()[name](spark, SMALL)


def test_rerank_rank_cuts_the_pool_in_arrow(spark, monkeypatch):
    assert tokens_of_queries_only(spark, monkeypatch, "rerank_rank").count() > 0


def test_search_local_cuts_the_pool_in_arrow(spark, monkeypatch):
    assert tokens_of_queries_only(spark, monkeypatch, "search_local").count() > 0


def test_parent_aggregate_cuts_the_pool_in_arrow(spark, monkeypatch):
    assert tokens_of_queries_only(spark, monkeypatch, "parent_aggregate").count() > 0


def test_lexical_gate_cuts_what_is_found_in_arrow(spark, monkeypatch):
    assert tokens_of_queries_only(spark, monkeypatch, "lexical_gate").count() > 0


def test_doc_dedupe_rank_cuts_the_pool_in_arrow(spark, monkeypatch):
    assert tokens_of_queries_only(spark, monkeypatch, "doc_dedupe_rank").count() > 0


def test_beir_diagnostics_cuts_the_pool_in_arrow(spark, monkeypatch):
    assert tokens_of_queries_only(spark, monkeypatch, "beir_diagnostics").count() > 0


def test_fit_request_cuts_the_evidence_in_arrow(spark, monkeypatch):
    assert tokens_of_queries_only(spark, monkeypatch, "fit_request").count() > 0


def test_texts_without_cjk_are_cut_together(spark, monkeypatch):
    def one_by_one(cjk, suffixes):
        def start():
            def tokens(text):
                raise AssertionError("a text cut alone")

            return tokens

        return start

    monkeypatch.setattr(R, "_tokenizer", one_by_one)
    docs = spark.createDataFrame([(1, "Été: Running a_b_a"), (2, ""), (3, "two  words")], "doc_id long, text string")
    got = {(r.doc_id, r.token): (r.tf, r.dl) for r in R.postings(docs).collect()}
    assert got == {(1, "t"): (1, 6), (1, "running"): (1, 6), (1, "runn"): (1, 6), (1, "a"): (2, 6), (1, "b"): (1, 6), (3, "two"): (1, 3), (3, "words"): (1, 3), (3, "word"): (1, 3)}


@pytest.mark.parametrize("width", [1, 200, 1 << 22])
def test_cut_together_or_alone_texts_have_the_same_entries(width):
    import random
    from collections import Counter

    import pyarrow as pa

    from larkspur.functions import text as T

    r = random.Random(3)
    signs = "abSseEdgiIngly_ _-.漢字語éÄ0 9\n\tß日本K~"
    texts = ["".join(r.choices(signs if k % 3 else signs.replace("漢字語", "").replace("日本", ""), k=r.randint(0, 40))) for k in range(400)]
    start = R._tokenizer(T.CJK, T.SUFFIXES)
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(range(400)), pa.array(texts)], ["doc_id", "row", "text"])
    for asked in (None, frozenset([b"ing", b"s", "漢".encode()])):
        got = {}
        for b in R._entries("doc_id", start, asked, width=width)(iter([batch.slice(0, 150), batch.slice(150)])):
            got |= {k: (dl, {x["token"]: x["tf"] for x in e}) for k, dl, e in zip(*(b.column(c).to_pylist() for c in ("doc_id", "dl", "e")))}
        for k, text in enumerate(texts):
            parts = Counter(x for t in start()(text.encode()) for x in t.split(b"_") if x)
            assert got[k] == (sum(parts.values()), {t.decode(): n for t, n in parts.items() if asked is None or t in asked})


@pytest.mark.parametrize("few", [100, 0])
def test_repeated_rows_count_once_without_a_shuffle_of_entries(spark, few):
    docs = spark.createDataFrame([(1, "red apple"), (1, "red apple"), (1, "red apple"), (2, "plum"), (2, "pear"), (3, "plum")], "doc_id long, text string").repartition(4)
    places = R.places(docs)
    assert "Exchange" not in places._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    rows_of = lambda index: sorted((r.doc_id, r.dl, sorted(x.token for x in r.e)) for r in index.collect())
    assert rows_of(R.once(R.keep(places, "entries"), few=few)) == rows_of(R.entries(docs, repeats=True)) == rows_of(R.entries(docs.distinct()))


def test_terms_in_arrow_are_those_of_the_expression(spark):
    from larkspur.functions import text as T

    asks = ["Running runs_ed _x__ ab_ab s ss 漢字語A 語", "漢", "湖水 x", "", None, "___", "Words, words: ÄRunnings été", "é漢 b 漢"]
    df = R.with_terms(spark.createDataFrame([(q,) for q in asks], "query string"))
    assert all(r[0] == r[1] for r in df.select("terms", T.query_terms(F.col("query"))).collect())


def test_parents_of_children_are_those_of_the_aggregate(spark):
    rows = [(1, 10, 1, 0.9), (1, 10, 3, 0.5), (1, 20, 2, 0.9), (1, None, 4, 0.4), (1, 30, 5, 0.4), (1, 10, 6, 0.0), (2, 20, 1, 0.0), (2, 10, 2, 0.0)]
    kids = spark.createDataFrame(rows, "query_id long, parent_id long, rerank_rank int, rerank_score double")
    want = kids.join(R.parent_aggregate(kids).drop("best"), ["query_id", "parent_id"])
    rows_of = lambda df: sorted((r.query_id, r.parent_id, r.rerank_rank, r.rerank_score, r.parent_score, r.parent_rank) for r in df.collect())
    assert rows_of(R.with_parents(kids)) == rows_of(want)


def terms_and_tables(spark, monkeypatch, name):
    from larkspur.functions import text as T
    from larkspur.plans import catalog, search

    made = []

    def terms(query):
        raise AssertionError("terms of queries by an expression")

    def kept(df, name):
        made.append(name)
        return R.keep(df, name)

    monkeypatch.setattr(T, "query_terms", terms)
    monkeypatch.setattr(search, "keep", kept)
    assert catalog.queries()[name](spark, SMALL).count() > 0
    return made


def test_search_local_makes_terms_once_and_no_table_of_its_pool(spark, monkeypatch):
    made = terms_and_tables(spark, monkeypatch, "search_local")
    assert made.count("queries") == 1 and "pool" not in made


def test_parent_aggregate_makes_terms_once_and_no_table_of_its_pool(spark, monkeypatch):
    made = terms_and_tables(spark, monkeypatch, "parent_aggregate")
    assert made.count("queries") == 1 and "pool" not in made
