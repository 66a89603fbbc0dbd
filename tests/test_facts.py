import pytest
from pyspark.sql import functions as F

from larkspur.operators import evaluate as E
from larkspur.operators import facts as K
from larkspur.operators import matching as M


FACT = "memory_id string, main_class string, sub_class string, text string"


def test_render_and_parse_round_trip(spark):
    facts = [("projects", "b", "two: parts"), ("projects", "a", "one"), ("preferences", "x", "y")]
    df = spark.createDataFrame([([(*f, f"m{k}") for k, f in enumerate(facts)],), ([],)], "f array<struct<main_class:string,sub_class:string,text:string,memory_id:string>>")
    full, bare = (r[0] for r in df.select(K.render(F.col("f"))).collect())
    assert sorted(K.parse(full)) == sorted(facts) and K.parse(bare) == []
    assert full.splitlines()[0] == K.HEAD[0] and full.index("## Projects\n\n- a: one\n- b: two: parts\n\n## Daily Life\n\n(Daily") > 0
    assert full.splitlines()[-3] == "---" and bare.count("(") == 6


def test_facts_of_one_slot_are_in_the_order_of_their_ids(spark):
    df = spark.createDataFrame([([("projects", "a", "1", "z"), ("projects", "a", "2", "b")],)], "f array<struct<main_class:string,sub_class:string,text:string,memory_id:string>>")
    assert "- a: 2\n- a: 1" in df.select(K.render(F.col("f"))).first()[0]


def test_parse_names_the_first_bad_line():
    top = "## Personal Profile\n\n"
    for text, line in ((top + "- broken", 3), ("# Other", 1), ("- a: b", 1), (top + "- a: b\n- a: b", 4), ("## Projects", 1), (top + "## Personal Profile", 3), (top + f"{K.SECTIONS[0][2]}\n- a: b", 4), (top + f"- a: b\n{K.SECTIONS[0][2]}", 4), (top, 3), ("", 1)):
        with pytest.raises(K.ParseError) as e:
            K.parse(text)
        assert e.value.line == line, text


def test_context_block(spark):
    df = spark.createDataFrame([([("preferences", "a", "b")], [("projects", "c", "d"), ("projects", "e", "f")]), ([], [("projects", "c", "d")]), ([], [])], "c array<struct<main_class:string,sub_class:string,text:string>>, r array<struct<main_class:string,sub_class:string,text:string>>")
    got = [r[0] for r in df.select(K.context_block(F.col("c"), F.col("r"))).collect()]
    assert got == ["# Memory\n\n## Core Memory\n- [preferences/a] b\n\n## Retrieved Memory\n- [projects/c] d\n- [projects/e] f", "# Memory\n\n## Retrieved Memory\n- [projects/c] d", ""]


def vectors(spark, *ids):
    return spark.createDataFrame([(i, [1.0, 0.0]) for i in ids], "memory_id string, v array<float>")


def test_commits_keep_facts_index_and_history(spark, tmp_path):
    store = K.FactStore(spark, str(tmp_path / "s"), fan=2)
    make = lambda *rows: spark.createDataFrame(list(rows), FACT)
    assert store.facts().count() == 0
    assert store.commit(make(("1", "projects", "a", "red kite"), ("2", "preferences", "b", "tea")), 0, vectors(spark, "1"), "first") == 1
    for facts, expected, given, error in (
        (make(("1", "projects", "a", "x")), 0, vectors(spark, "1"), K.StaleVersion),
        (make(("1", "projects", "a", "x")), 1, None, ValueError),
        (make(("1", "projects", "a", "red kite"), ("3", "preferences", "b", "c")), 1, vectors(spark, "3"), ValueError),
        (make(("1", "projects", "a", "x"), ("1", "projects", "a", "y")), 1, vectors(spark, "1"), ValueError),
        (make(("1", "nothing", "a", "x")), 1, None, ValueError),
    ):
        with pytest.raises(error):
            store.commit(facts, expected, given)
    assert store.version() == 1
    # 1 becomes core and loses its index, 2 goes, 4 comes
    assert store.commit(make(("1", "preferences", "a", "red kite"), ("4", "daily_life", "d", "swims daily")), 1, vectors(spark, "4"), "second") == 2
    assert {r.memory_id for r in store.facts().collect()} == {"1", "4"}
    assert {r.memory_id for r in store.vectors().collect()} == {"4"} == {r.memory_id for r in store.postings().collect()}
    assert [(r.version, r.reason, r.added, r.removed, r.changed) for r in store.events().orderBy("version").collect()] == [(1, "first", 2, 0, 0), (2, "second", 1, 1, 1)]
    store.commit(make(("1", "projects", "a", "red kite"), ("4", "daily_life", "d", "swims daily")), 2, vectors(spark, "1"))
    assert {r.memory_id for r in store.vectors().collect()} == {"1", "4"}


def test_of_two_writers_one_wins(spark, tmp_path):
    a, b = (K.FactStore(spark, str(tmp_path / "s")) for _ in range(2))
    a.claim(1)
    with pytest.raises(K.StaleVersion):
        b.claim(1)
    b.recover()
    b.claim(1)


def test_conversion(spark, tmp_path):
    good = spark.createDataFrame([("1", "projects", "a", "b"), ("1", "projects", "a", "b"), ("2", "preferences", "c", "d")], FACT)
    bad = good.unionByName(spark.createDataFrame([("1", "projects", "a", "other"), ("3", "none", "a", "b")], FACT))
    report = K.convert_workspace(spark, bad, str(tmp_path / "s"), None, dry_run=True)
    assert report == {"facts": 4, "broken": 1, "conflicts": 1, "exists": False}
    embed = lambda df: df.select("memory_id", F.array(F.lit(1.0)).alias("v"))
    with pytest.raises(ValueError):
        K.convert_workspace(spark, bad, str(tmp_path / "s"), embed)
    K.convert_workspace(spark, good, str(tmp_path / "s"), embed)
    assert K.FactStore(spark, str(tmp_path / "s")).facts().count() == 2 and not (tmp_path / "s" / "REBUILD_REQUIRED").exists()
    with pytest.raises(ValueError):
        K.convert_workspace(spark, good, str(tmp_path / "s"), embed)


def test_diff_and_plan(spark):
    s = "case_id string, main_class string, sub_class string, text string"
    old = spark.createDataFrame([("c", "projects", "a", "1"), ("c", "preferences", "b", "2")], s)
    new = spark.createDataFrame([("c", "projects", "a", "1"), ("c", "projects", "a", "3")], s)
    plan = {(r.text, r.store, r["index"]) for r in K.commit_plan(K.snapshot_diff(old, new, ["case_id"])).collect()}
    assert plan == {("3", "insert", "embed"), ("2", "delete", "none")}


def test_assignment_is_the_best_of_all():
    from itertools import permutations
    from random import Random

    r = Random(1)
    for _ in range(60):
        n, m = r.randint(1, 5), r.randint(1, 5)
        c = [[r.random() for _ in range(m)] for _ in range(n)]
        got = sum(c[i][j] for i, j in M.best_assignment(c))
        small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
        cell = (lambda i, j: c[i][j]) if n <= m else (lambda i, j: c[j][i])
        assert got == pytest.approx(min(sum(cell(i, j) for i, j in zip(small, p, strict=True)) for p in permutations(large, len(small))))


def test_matching_stays_within_classes_and_is_one_to_one(spark):
    rows = [("c", "projects", 0, "red apple"), ("c", "projects", 0, "red apple pie"), ("c", "projects", 1, "red apple"), ("c", "preferences", 1, "red apple pie")]
    df = spark.createDataFrame(rows, "case_id string, main_class string, side int, text string")
    assert [(r.left_text, r.right_text) for r in M.assignment_match(df).collect()] == [("red apple", "red apple")]
    assert M.greedy_match(df).count() == 1


def test_equal_texts_pair_off_before_the_assignment(spark):
    rows = [("c", "p", 0, "a b", "a b", "1"), ("c", "p", 0, "A  b", "a b", "2"), ("c", "p", 0, "x y", "x y", "3"), ("c", "p", 1, "a b", "a b", "4"), ("c", "p", 1, "a b x", "a b x", "5")]
    df = spark.createDataFrame(rows, "case_id string, main_class string, side int, text string, norm string, id string")
    got = sorted((r.left_text, r.right_text, r.stage) for r in M.staged_match(df, ["norm"], "id").collect())
    assert got == [("A  b", "a b x", "assigned"), ("a b", "a b", "exact")]


def test_ranked_documents_and_diagnostics(spark):
    rows = [(1, 1, "beir://set/a%2Fb"), (1, 2, "beir://set/c+d"), (1, 3, "beir://set/a%2Fb"), (1, 4, "beir://other/x"), (1, 5, "https://set/x"), (1, 6, "beir://set/")]
    df = spark.createDataFrame(rows, "query_id long, parent_rank int, url string")
    assert [(r.doc_id, r["rank"], r.score) for r in E.ranked_documents(df, "set").orderBy("rank").collect()] == [("a/b", 1, 1.0), ("c+d", 2, 0.5)]
    q = spark.createDataFrame([(1, ["a", "b"], ["a", "x"], None), (2, [], None, ["z"])], "query_id long, gold array<string>, retrieved array<string>, evidence array<string>")
    assert [tuple(r) for r in E.diagnostics(q).orderBy("query_id").collect()] == [(1, 2, 0, 1, 0, 0.5), (2, 0, 1, 0, 0, 1.0)]


def test_empty_sets_score_one(spark):
    empty = spark.createDataFrame([], "case_id string, main_class string, sub_class string, text string")
    cases = spark.createDataFrame([("c",)], "case_id string")
    r = E.snapshot_score(empty, empty, empty, cases).first()
    assert (r.precision, r.recall, r.f1, r.exact, r.addition_recall, r.no_op_accuracy) == (1.0, 1.0, 1.0, True, None, 1.0)


def test_ranking_metrics(spark):
    run = spark.createDataFrame([(1, k, k) for k in range(1, 11)], "query_id long, item long, rank int")
    gold = spark.createDataFrame([(1, 1, 1), (1, 21, 1), (2, 5, 1)], "query_id long, item long, relevance int")
    rows = {r.query_id: r for r in E.ranking_metrics(run, gold).collect()}
    assert rows[1].recall_10 == 0.5 and rows[1].mrr_10 == 1.0 and rows[1].precision_10 == 0.1 and rows[1].map_10 == 0.5
    assert rows[2].ndcg_10 == 0.0 and rows[2].mrr_10 == 0.0


def test_publication(spark, tmp_path):
    p = K.Publication(spark, str(tmp_path / "state"))
    r = p.stage("", "new")
    assert p.state()["pending"]["target"] == "new" and p.state()["text"] == ""
    with pytest.raises(ValueError):
        p.stage("", "other")
    with pytest.raises(K.StaleVersion):
        p.confirm(r + 1)
    p.confirm(r)
    assert p.state() == {"revision": 1, "text": "new", "pending": None}
    with pytest.raises(ValueError):
        p.stage("other", "x")
    assert p.baseline("outside") == 2
