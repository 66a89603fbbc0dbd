"""Evaluation queries: the predicted snapshot of a case is what was kept and what was extracted; the relevant sections of a
page's title are the sections of that page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import evaluate as E
from larkspur.operators import matching as M
from larkspur.operators import retrieval as R
from larkspur.plans import data, search
from larkspur.plans.memory import SNAP
from larkspur.plans.registry import query
from larkspur.session import keep

_SETS = f"""
p AS ({SNAP.format(c='prior_snapshot')}), g AS ({SNAP.format(c='gold_final_snapshot')}), q AS ({SNAP.format(c='list_concat(gold_preserved_snapshot, gold_extracted_snapshot)')}),
u AS (SELECT case_id, main_class, sub_class, text, max(a) AS p, max(b) AS q, max(c) AS g FROM (SELECT *, 1 AS a, 0 AS b, 0 AS c FROM p UNION ALL SELECT *, 0, 1, 0 FROM q UNION ALL SELECT *, 0, 0, 1 FROM g) GROUP BY ALL),
c AS (SELECT case_id, count(*) FILTER (q = 1 AND g = 1) AS tp, count(*) FILTER (q = 1 AND g = 0) AS fp, count(*) FILTER (g = 1 AND q = 0) AS fn, count(*) FILTER (g = 1 AND p = 0) AS to_add, count(*) FILTER (p = 1 AND g = 0) AS to_remove,
      count(*) FILTER (g = 1 AND p = 0 AND q = 1) AS added, count(*) FILTER (p = 1 AND g = 0 AND q = 0) AS removed FROM u GROUP BY 1),
sl AS (SELECT case_id, max(p) AS sp, sum(g) AS sg, count(*) FILTER (p <> g) AS moved, count(*) FILTER (q <> g) AS wrong FROM u GROUP BY case_id, main_class, sub_class),
s AS (SELECT case_id, count(*) FILTER (sp = 1 AND sg > 0 AND moved > 0) AS n_updated, count(*) FILTER (sp = 1 AND sg > 0 AND moved > 0 AND wrong > 0) AS bad_updated, count(*) FILTER (sg > 1) AS n_multi, count(*) FILTER (sg > 1 AND wrong > 0) AS bad_multi FROM sl GROUP BY 1),
r AS (SELECT case_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(to_add, 0) AS to_add, coalesce(to_remove, 0) AS to_remove, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(n_updated, 0) AS n_updated, coalesce(bad_updated, 0) AS bad_updated, coalesce(n_multi, 0) AS n_multi, coalesce(bad_multi, 0) AS bad_multi
      FROM (SELECT DISTINCT case_id FROM cases WHERE case_id IS NOT NULL) LEFT JOIN c USING (case_id) LEFT JOIN s USING (case_id)),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE round(tp / (tp + fn), 6) END AS recall FROM r),
sc AS (SELECT case_id, tp, fp, fn, precision, recall, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE round(2 * precision * recall / (precision + recall), 6) END AS f1, fp = 0 AND fn = 0 AS exact,
  CASE WHEN to_add > 0 THEN round(added / to_add, 6) END AS addition_recall, CASE WHEN to_remove > 0 THEN round(removed / to_remove, 6) END AS deletion_accuracy,
  CASE WHEN to_remove > 0 THEN round((to_remove - removed) / to_remove, 6) END AS stale_retention, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE round(fp / (tp + fp), 6) END AS false_insertion,
  CASE WHEN to_add = 0 AND to_remove = 0 THEN (fp = 0 AND fn = 0)::INT::DOUBLE END AS no_op_accuracy, CASE WHEN n_updated > 0 THEN (bad_updated = 0)::INT::DOUBLE END AS update_accuracy, CASE WHEN n_multi > 0 THEN (bad_multi = 0)::INT::DOUBLE END AS multi_preservation FROM pr)
"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    cases = data.read_table(spark, d, "cases").where("case_id is not null").select("case_id")
    return E.snapshot_score(data.snapshot(spark, d, "prior_snapshot"), data.snapshot(spark, d, "gold_preserved_snapshot", "gold_extracted_snapshot"), data.snapshot(spark, d, "gold_final_snapshot"), cases)


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return data.read_table(spark, d, "cases").where("case_id is not null").groupBy("case_id").agg(F.max("level").alias("level"), F.max("scenario").alias("scenario"))


@query(f"WITH {_SETS} SELECT * FROM sc")
def snapshot_score(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


@query(f"WITH {_SETS}, t AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM sc) SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM t")
def micro_prf(spark: SparkSession, d: str) -> DataFrame:
    t = _scores(spark, d).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return t.select("tp", "fp", "fn", E.ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0).alias("precision"), E.ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0).alias("recall"))


_RATES = ("precision", "recall", "f1", "addition_recall", "deletion_accuracy", "stale_retention", "false_insertion", "no_op_accuracy", "update_accuracy", "multi_preservation")


@query(f"WITH {_SETS} SELECT count(*) AS cases, round(avg(exact::INT), 6) AS exact_rate, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _RATES)} FROM sc")
def eval_rates(spark: SparkSession, d: str) -> DataFrame:
    """Means over the cases that have a value."""
    return _scores(spark, d).agg(F.count("*").alias("cases"), F.round(F.avg(F.col("exact").cast("int")), 6).alias("exact_rate"), *(F.round(F.avg(c), 6).alias(c) for c in _RATES))


@query(
    f"WITH {_SETS}, l AS (SELECT case_id, max(level) AS level, max(scenario) AS scenario FROM cases GROUP BY 1) "
    "SELECT grouping(level) AS all_levels, grouping(scenario) AS all_scenarios, level, scenario, count(*) AS cases, round(avg(exact::INT), 6) AS exact_rate, round(avg(f1), 6) AS f1 FROM sc JOIN l USING (case_id) GROUP BY GROUPING SETS ((), (level), (scenario), (level, scenario))"
)
def eval_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Overall, by level, by scenario and by both, in one pass over grouping sets."""
    rows = _scores(spark, d).join(_labels(spark, d), "case_id")
    sets = rows.groupingSets([(), ("level",), ("scenario",), ("level", "scenario")], "level", "scenario")
    g = lambda c: F.grouping(c).cast("bigint")
    return sets.agg(g("level").alias("all_levels"), g("scenario").alias("all_scenarios"), F.count("*").alias("cases"), F.round(F.avg(F.col("exact").cast("int")), 6).alias("exact_rate"), F.round(F.avg("f1"), 6).alias("f1")).select("all_levels", "all_scenarios", "level", "scenario", "cases", "exact_rate", "f1")


@query(
    f"WITH {_SETS}, l AS (SELECT case_id, coalesce(max(level), '?') AS mode, bool_or(gold_final_snapshot IS NOT NULL) AS told FROM cases WHERE case_id IS NOT NULL GROUP BY 1), t AS (SELECT mode, CASE WHEN NOT told THEN 'not_implemented' WHEN exact THEN 'passed' ELSE 'failed' END AS status FROM sc JOIN l USING (case_id)) "
    "SELECT mode, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'not_implemented') AS not_implemented, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (status = 'passed') > 0 THEN 'passed' ELSE 'not_implemented' END AS status FROM t GROUP BY 1"
)
def mode_summary(spark: SparkSession, d: str) -> DataFrame:
    """Cases by level: passed if the predicted snapshot is the gold one, not implemented without a gold one."""
    told = data.read_table(spark, d, "cases").where("case_id is not null").groupBy("case_id").agg(F.coalesce(F.max("level"), F.lit("?")).alias("mode"), F.max(F.col("gold_final_snapshot").isNotNull()).alias("told"))
    rows = _scores(spark, d).join(told, "case_id")
    return E.status_summary(rows.select("mode", F.when(~F.col("told"), "not_implemented").when(F.col("exact"), "passed").otherwise("failed").alias("status")), "mode")


_RUN = search._with(search._DOCS, search._QUERY, search._BM25, search._VEC, search._FUSED, search._POOL)
_GOLD = "gold AS (SELECT DISTINCT page_id AS query_id, parent_id AS item FROM page_parents WHERE page_id % 50 = 0 AND text IS NOT NULL AND page_id IN (SELECT query_id FROM qs)), run AS (SELECT query_id, parent_id AS item, parent_rank AS rank FROM prk WHERE parent_rank <= 10)"
_CUTS = (1, 3, 5, 10)
_METRICS = f"""{_RUN}, {_GOLD},
h AS (SELECT query_id, rank, (g.item IS NOT NULL)::INT AS rel FROM run LEFT JOIN gold g USING (query_id, item)),
h2 AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS so_far FROM h),
a AS (SELECT query_id, min(CASE WHEN rel > 0 THEN rank END) AS first, {', '.join(f'sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0 END) AS dcg_{k}, count(*) FILTER (rank <= {k} AND rel > 0) AS hits_{k}, sum(CASE WHEN rank <= {k} AND rel > 0 THEN so_far / rank ELSE 0 END) AS ap_{k}' for k in _CUTS)} FROM h2 GROUP BY 1),
ng AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1),
m AS (SELECT query_id, n_gold, first, {', '.join(f'coalesce(dcg_{k}, 0) AS dcg_{k}, coalesce(hits_{k}, 0) AS hits_{k}, coalesce(ap_{k}, 0) AS ap_{k}, list_sum(list_transform(range(1, least({k}, n_gold) + 1), lambda i: 1 / log2(i + 1))) AS idcg_{k}' for k in _CUTS)} FROM ng LEFT JOIN a USING (query_id))
"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    run = R.parent_aggregate(search._reranked(spark, d)).select("query_id", F.col("parent_id").alias("item"), F.col("parent_rank").alias("rank"))
    asked = data.queries(spark, d).select("query_id")
    gold = data.parents(spark, d).where("page_id % 50 = 0").select(F.col("page_id").alias("query_id"), F.col("parent_id").alias("item"), F.lit(1).alias("relevance")).distinct().join(asked, "query_id", "left_semi")
    return E.ranking_metrics(run, gold, _CUTS)


@query(_METRICS + f"SELECT query_id, {', '.join(f'round(dcg_{k} / idcg_{k}, 6) AS ndcg_{k}' for k in _CUTS)} FROM m")
def ir_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("query_id", *(f"ndcg_{k}" for k in _CUTS))


@query(_METRICS + f"SELECT query_id, {', '.join(f'round(ap_{k} / n_gold, 6) AS map_{k}' for k in _CUTS)} FROM m")
def ir_map(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("query_id", *(f"map_{k}" for k in _CUTS))


@query(_METRICS + f"SELECT query_id, {', '.join(f'round(hits_{k} / n_gold, 6) AS recall_{k}, round(hits_{k} / {k}, 6) AS precision_{k}' for k in _CUTS)} FROM m")
def ir_recall_precision(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("query_id", *(f"{m}_{k}" for k in _CUTS for m in ("recall", "precision")))


@query(_METRICS + "SELECT query_id, CASE WHEN first IS NULL THEN 0.0::DOUBLE ELSE round(1 / first, 6) END AS mrr_10 FROM m")
def ir_mrr(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("query_id", "mrr_10")


_DOC = "dr AS (SELECT query_id, page_id, min(parent_rank) AS r FROM prk JOIN (SELECT DISTINCT parent_id, page_id FROM docs) USING (parent_id) GROUP BY 1, 2), dd AS (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY r, page_id) AS rank FROM dr)"


def _ranked_docs(spark: SparkSession, d: str, pool: DataFrame) -> DataFrame:
    pages = search.only(data.child_rows(spark, d).select("parent_id", "page_id"), pool, "parent_id").distinct()
    url = F.concat(F.lit("beir://pages/"), F.url_encode(F.col("page_id").cast("string")))
    rows = R.parent_aggregate(pool).join(pages, "parent_id").select("query_id", "parent_rank", F.lpad(F.col("page_id").cast("string"), 12, "0").alias("doc"), url.alias("url"))
    return E.ranked_documents(rows, "pages")


@query(f"{_RUN}, {_DOC} SELECT query_id, page_id, CAST(rank AS INT) AS rank, round(1 / rank, 6) AS score FROM dd")
def doc_dedupe_rank(spark: SparkSession, d: str) -> DataFrame:
    """Ranked sections to ranked pages by their addresses: a page's first section counts."""
    return _ranked_docs(spark, d, search._reranked(spark, d)).select("query_id", F.col("doc_id").cast("long").alias("page_id"), "rank", "score")


_DIAG = f"""{search._EVIDENCE}, {_DOC}, got AS (SELECT query_id, list(page_id) AS got FROM dd WHERE rank <= 10 GROUP BY 1), evd AS (SELECT query_id, list(DISTINCT page_id) AS evd FROM ev JOIN (SELECT DISTINCT child_id, page_id FROM docs) USING (child_id) GROUP BY 1),
dg AS (SELECT query_id, len(coalesce(got, []::BIGINT[])) AS retrieved, len(coalesce(evd, []::BIGINT[])) AS in_evidence, list_contains(coalesce(got, []::BIGINT[]), query_id)::INT AS hits, list_contains(coalesce(evd, []::BIGINT[]), query_id)::INT AS evidence_hits FROM qs LEFT JOIN got USING (query_id) LEFT JOIN evd USING (query_id))"""


@query(_DIAG + " SELECT query_id, CAST(retrieved AS INT) AS retrieved, CAST(in_evidence AS INT) AS in_evidence, hits, evidence_hits, hits::DOUBLE AS recall FROM dg")
def beir_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Gold pages among the retrieved ones and among those of the evidence, query by query."""
    return _diagnosed(spark, d).select("query_id", "retrieved", "in_evidence", "hits", "evidence_hits", "recall")


def _diagnosed(spark: SparkSession, d: str) -> DataFrame:
    pool = search._reranked(spark, d)
    got = _ranked_docs(spark, d, pool).where("rank <= 10").groupBy("query_id").agg(F.collect_set(F.col("doc_id").cast("long")).alias("retrieved"))
    kids = search.only(data.child_rows(spark, d).select("child_id", "page_id"), pool, "child_id").distinct()
    evidence = search.evidence_of(spark, d, pool).join(kids, "child_id").groupBy("query_id").agg(F.collect_set("page_id").alias("evidence"))
    rows = data.queries(spark, d).select("query_id", F.array("query_id").alias("gold")).join(got, "query_id", "left").join(evidence, "query_id", "left")
    return E.diagnostics(rows)


@query(_DIAG + " SELECT count(*) AS queries, round(avg(retrieved), 6) AS avg_retrieved, round(avg(in_evidence), 6) AS avg_evidence, round(avg(hits), 6) AS in_candidates_rate, round(avg(evidence_hits), 6) AS in_evidence_rate FROM dg")
def beir_averages(spark: SparkSession, d: str) -> DataFrame:
    """The averages of the diagnostics."""
    r = _diagnosed(spark, d)
    return r.agg(F.count("*").alias("queries"), *(F.round(F.avg(c), 6).alias(n) for c, n in (("retrieved", "avg_retrieved"), ("in_evidence", "avg_evidence"))), F.round(F.avg((F.col("hits") > 0).cast("int")), 6).alias("in_candidates_rate"), F.round(F.avg((F.col("evidence_hits") > 0).cast("int")), 6).alias("in_evidence_rate"))


_STATUS = "cov2 AS (SELECT e.query_id, list_distinct(flatten(list(d.toks))) AS toks FROM ev e JOIN dtok d USING (child_id) GROUP BY 1), ok AS (SELECT q.query_id, coalesce(len(terms) > 0 AND len(list_intersect(terms, toks)) >= 0.5 * len(terms), false) AS correct FROM qterm q LEFT JOIN cov2 USING (query_id))"


@query(_DIAG + f", {_STATUS} SELECT count(*) FILTER (hits > 0 AND correct) AS hit_correct, count(*) FILTER (hits > 0 AND NOT correct) AS hit_wrong, count(*) FILTER (hits = 0 AND correct) AS miss_correct, count(*) FILTER (hits = 0 AND NOT correct) AS miss_wrong FROM dg JOIN ok USING (query_id)")
def consistency_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval against answer: whether the gold page was retrieved, and whether the evidence covers the question."""
    pool = search._reranked(spark, d)
    got = _ranked_docs(spark, d, pool).where("rank <= 10").select("query_id", (F.col("doc_id").cast("long") == F.col("query_id")).alias("hit")).groupBy("query_id").agg(F.max("hit").alias("hit"))
    told = search._status(spark, d, keep(search.evidence_of(spark, d, pool), "evidence")).join(got, "query_id", "left")
    return E.consistency(told.select(F.coalesce("hit", F.lit(False)).alias("hit"), (F.col("status") == "sufficient").alias("correct")))


@query(
    f"""WITH {_SETS}, x AS ({SNAP.format(c='gold_extracted_snapshot')}), k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY main_class, sub_class, text) AS rank FROM q),
    h AS (SELECT k.case_id, k.rank FROM k JOIN x USING (case_id, main_class, sub_class, text)), n AS (SELECT case_id, count(*) AS n FROM x GROUP BY 1),
    st AS (SELECT q.case_id, count(*) AS stale FROM q JOIN p USING (case_id, main_class, sub_class, text) ANTI JOIN g USING (case_id, main_class, sub_class, text) GROUP BY 1)
    SELECT n.case_id, coalesce(min(rank) = 1, false) AS hit_1, count(rank) FILTER (rank <= 5) > 0 AS hit_5, round(count(rank) FILTER (rank <= 5) / n.n, 6) AS recall_5, CASE WHEN min(rank) IS NULL THEN 0.0::DOUBLE ELSE round(1 / min(rank), 6) END AS mrr, coalesce(any_value(stale), 0) AS stale_exposed
    FROM n LEFT JOIN h USING (case_id) LEFT JOIN st USING (case_id) GROUP BY n.case_id, n.n"""
)
def support_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the extracted facts among the predicted ones. The order is that of the normalised facts, not of a
    retrieval, as the metric has it."""
    from pyspark.sql import Window

    q = data.snapshot(spark, d, "gold_preserved_snapshot", "gold_extracted_snapshot")
    x, p, g = (data.snapshot(spark, d, c) for c in ("gold_extracted_snapshot", "prior_snapshot", "gold_final_snapshot"))
    on = ["case_id", *E.TRIPLE]
    ranks = q.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(*E.TRIPLE))).join(x, on).select("case_id", "rank")
    stale = q.join(p, on, "left_semi").join(g, on, "left_anti").groupBy("case_id").agg(F.count("*").alias("stale"))
    hits = ranks.groupBy("case_id").agg(F.min("rank").alias("first"), F.count_if(F.col("rank") <= 5).alias("h5"))
    r = x.groupBy("case_id").agg(F.count("*").alias("n")).join(hits, "case_id", "left").join(stale, "case_id", "left")
    h5 = F.coalesce("h5", F.lit(0))
    return r.select("case_id", F.coalesce(F.col("first") == 1, F.lit(False)).alias("hit_1"), (h5 > 0).alias("hit_5"), F.round(h5 / F.col("n"), 6).alias("recall_5"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.coalesce("stale", F.lit(0)).alias("stale_exposed"))


_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(lower(trim({x})), '’', ''''), '“', '"'), '”', '"'), '[$,]', '', 'g'), '\b(\d+)\s*:\s*(\d+)\b', '\1:\2', 'g'), '\b(\d+)\s+(?:minutes?|mins?)\s+and\s+(\d+)\s+(?:seconds?|secs?)\b', '\1:\2', 'g'), '\b(\d+)\s+(?:minutes?|mins?)\b', '\1 min', 'g'), '[^\p{{L}}\p{{N}}_\s:]', ' ', 'g'), '[\s\x{{a0}}\x{{2009}}]+', ' ', 'g'))"""


@query(f"WITH r AS (SELECT DISTINCT record_id, memory_id, text FROM canonical_memories WHERE record_id IS NOT NULL AND text IS NOT NULL AND memory_id IS NOT NULL), g AS (SELECT memory_id, max(text) AS gold, min(text) AS alias FROM r GROUP BY 1), n AS (SELECT record_id, {_NORM.format(x='text')} AS answer, {_NORM.format(x='gold')} AS gold, {_NORM.format(x='alias')} AS alias FROM r JOIN g USING (memory_id)) SELECT record_id, answer, answer <> '' AND (answer = gold OR answer = alias) AS matches FROM n")
def answer_match(spark: SparkSession, d: str) -> DataFrame:
    """Each text against the greatest text of its id as the answer, with the least one as an alias."""
    r = data.read_table(spark, d, "canonical_memories").where("record_id is not null and text is not null and memory_id is not null").select("record_id", "memory_id", "text").distinct()
    g = r.groupBy("memory_id").agg(F.max("text").alias("gold"), F.min("text").alias("alias"))
    return r.join(g, "memory_id").select("record_id", T.normalize_answer(F.col("text")).alias("answer"), T.answers_match(F.col("text"), F.col("gold"), F.array("alias")).alias("matches"))


@query("WITH r AS (SELECT 'd' || doc_id AS id, text AS t FROM documents UNION ALL SELECT 'e' || event_id, CASE WHEN event_type = 'view' THEN '{\"verdict\": \" Correct\", \"k\": ' || (props->>'k') || '}' ELSE props END FROM events) SELECT id, CASE WHEN starts_with(trim(t, ' '), '{') AND json_valid(t) THEN coalesce(lower(trim(t->>'verdict')) = 'correct', false) ELSE NOT contains(lower(coalesce(t, '')), 'incorrect') AND contains(lower(coalesce(t, '')), 'correct') END AS correct FROM r")
def judge_parse(spark: SparkSession, d: str) -> DataFrame:
    """Texts as the replies of a judge, by their words; payloads as replies in JSON, those of views with a verdict."""
    docs = data.read_table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("t"))
    e = data.read_table(spark, d, "events")
    told = F.when(F.col("event_type") == "view", F.concat(F.lit('{"verdict": " Correct", "k": '), F.get_json_object("props", "$.k"), F.lit("}"))).otherwise(F.col("props"))
    return docs.unionByName(e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), told.alias("t"))).select("id", T.verdict_of(F.col("t")).alias("correct"))


_SIDE = "SELECT case_id, main_class, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm, text, row_number() OVER (PARTITION BY case_id, main_class, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY text, sub_class) AS nth FROM {x}"


@query(f"WITH {_SETS}, a AS ({_SIDE.format(x='q')}), b AS ({_SIDE.format(x='g')}) SELECT case_id, main_class, norm, count(*) AS pairs FROM a JOIN b USING (case_id, main_class, norm, nth) GROUP BY 1, 2, 3")
def exact_match_stage(spark: SparkSession, d: str) -> DataFrame:
    norm = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    side = lambda *c: data.snapshot(spark, d, *c).select("case_id", "main_class", norm.alias("norm"), F.concat_ws("\n", "text", "sub_class").alias("id"))
    pairs = M.exact_matches(side("gold_preserved_snapshot", "gold_extracted_snapshot"), side("gold_final_snapshot"), ["case_id", "main_class", "norm"], "id")
    return pairs.groupBy("case_id", "main_class", "norm").agg(F.count("*").alias("pairs"))


def _sides(spark: SparkSession, d: str) -> DataFrame:
    norm = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    side = lambda k, *c: data.snapshot(spark, d, *c).select("case_id", "main_class", F.lit(k).alias("side"), "text", norm.alias("norm"), F.concat_ws("\n", "text", "sub_class").alias("id"))
    return side(0, "prior_snapshot").unionByName(side(1, "gold_final_snapshot"))


@query()
def assignment_match(spark: SparkSession, d: str) -> DataFrame:
    """Equal texts pair off, the rest is assigned."""
    return M.staged_match(_sides(spark, d), ["norm"], "id")


@query()
def greedy_pairs(spark: SparkSession, d: str) -> DataFrame:
    return M.greedy_match(_sides(spark, d).select("case_id", "main_class", "side", "text").distinct())
