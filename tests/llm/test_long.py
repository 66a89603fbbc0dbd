"""Very long texts pass whole through every text operator."""

from random import Random

from larkspur.llm import body, lines, neardup, pii, spans, split, tokens

N = 400_000


def long_text(seed):
    r = Random(seed)
    words = [f"word{k}" for k in range(5000)]
    return " ".join(r.choice(words) for _ in range(N // 8))


def test_long_texts(spark):
    a, b = long_text(1), long_text(2)
    df = spark.createDataFrame([(1, a), (2, a + " end"), (3, b), (4, "\n".join(b.split(" ")))], "doc_id long, text string")
    pairs = {(r.id_a, r.id_b) for r in neardup.similar_rows([("t", df, "doc_id", "text")]).collect()}
    assert pairs == {(1, 2), (3, 4)}
    assert {(r.doc_a, r.doc_b) for r in spans.sharing_pairs(df).collect()} == {(1, 2)}
    share = {r.doc_id: r.shared_share for r in spans.shared_shares(df).collect()}
    assert share[1] == 1.0 and share[2] > 0.99 and share[3] == 0.0
    rows = split.split_oversized([("t", df, "doc_id", "text", 3200, 300)]).collect()
    assert max(len(r.piece) for r in rows) <= 3200 and {r.doc_id if "doc_id" in r else r.item_id for r in rows} == {1, 2, 3, 4}
    assert {r.doc_id for r in tokens.token_counts(df.selectExpr("*", "'s' as source")).collect()} == {1, 2, 3, 4}
    pages = df.selectExpr("doc_id as page_id", "text as raw_text", "'https://a.example/x' as final_url", "cast(null as string) as title")
    assert lines.repeated_lines(pages).count() == 0
    assert body.main_body(pages).where("page_id = 1").count() == 1
    memories = df.selectExpr("doc_id as record_id", "concat(text, ' mail me@a.example') as text")
    cases = spark.createDataFrame([], "case_id string, conversation array<struct<role:string,content:string>>")
    parts = spark.createDataFrame([], "name_part string, part_kind string")
    assert {r.found_text for r in pii.found_items(memories, cases, parts).collect()} == {"me@a.example"}
