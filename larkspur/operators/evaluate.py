"""Evaluation: snapshot scores, set metrics with conventions for empty sets, ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRIPLE = ["main_class", "sub_class", "text"]


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b to six places; ``empty`` (or null) where b is 0."""
    return F.round(F.when(b == 0, F.lit(empty).cast("double")).otherwise(a / b), 6)


def f1(p: Column, r: Column) -> Column:
    return F.round(F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)), 6)


def snapshot_score(prior: DataFrame, predicted: DataFrame, gold: DataFrame, cases: DataFrame) -> DataFrame:
    """One row a case: counts and rates of a predicted snapshot against the gold one, seen from the prior one.

    Facts are flagged by membership in one aggregation over the union of the three, so no join is needed. Rates without
    a case to tell of are null; precision and recall of nothing are 1.
    """
    tag = lambda df, k: df.select("case_id", *TRIPLE, F.lit(k).alias("k"))
    m = lambda k: F.max((F.col("k") == k).cast("int"))
    facts = tag(prior, "p").unionByName(tag(predicted, "q")).unionByName(tag(gold, "g")).groupBy("case_id", *TRIPLE).agg(m("p").alias("p"), m("q").alias("q"), m("g").alias("g"))
    p, q, g = F.col("p") == 1, F.col("q") == 1, F.col("g") == 1
    slots = facts.groupBy("case_id", "main_class", "sub_class").agg(F.max("p").alias("sp"), F.sum("g").alias("sg"), F.count_if(p != g).alias("moved"), F.count_if(q != g).alias("wrong"))
    updated, multi = (F.col("sp") == 1) & (F.col("sg") > 0) & (F.col("moved") > 0), F.col("sg") > 1
    by_slot = slots.groupBy("case_id").agg(F.count_if(updated).alias("n_updated"), F.count_if(updated & (F.col("wrong") > 0)).alias("bad_updated"), F.count_if(multi).alias("n_multi"), F.count_if(multi & (F.col("wrong") > 0)).alias("bad_multi"))
    c = facts.groupBy("case_id").agg(
        F.count_if(q & g).alias("tp"), F.count_if(q & ~g).alias("fp"), F.count_if(g & ~q).alias("fn"),
        F.count_if(g & ~p).alias("to_add"), F.count_if(p & ~g).alias("to_remove"), F.count_if(g & ~p & q).alias("added"), F.count_if(p & ~g & ~q).alias("removed"),
    )
    r = cases.select("case_id").distinct().join(c, "case_id", "left").join(by_slot, "case_id", "left").fillna(0)
    col = F.col
    scored = r.withColumns({"precision": ratio(col("tp"), col("tp") + col("fp"), 1.0), "recall": ratio(col("tp"), col("tp") + col("fn"), 1.0)})
    return scored.select(
        "case_id", "tp", "fp", "fn", "precision", "recall", f1(col("precision"), col("recall")).alias("f1"),
        ((col("fp") == 0) & (col("fn") == 0)).alias("exact"),
        ratio(col("added"), col("to_add")).alias("addition_recall"), ratio(col("removed"), col("to_remove")).alias("deletion_accuracy"),
        ratio(col("to_remove") - col("removed"), col("to_remove")).alias("stale_retention"), ratio(col("fp"), col("tp") + col("fp"), 0.0).alias("false_insertion"),
        F.when((col("to_add") == 0) & (col("to_remove") == 0), ((col("fp") == 0) & (col("fn") == 0)).cast("double")).alias("no_op_accuracy"),
        F.when(col("n_updated") > 0, (col("bad_updated") == 0).cast("double")).alias("update_accuracy"),
        F.when(col("n_multi") > 0, (col("bad_multi") == 0).cast("double")).alias("multi_preservation"),
    )


def ranking_metrics(run: DataFrame, gold: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row a query of ``gold``: nDCG, MAP, recall and precision at each cutoff and MRR at the last, for ``run``
    (query_id, item, rank) and ``gold`` (query_id, item, relevance). Queries without results score 0."""
    last = max(cutoffs)
    hits = run.where(F.col("rank") <= last).join(gold, ["query_id", "item"], "left").withColumn("rel", F.coalesce("relevance", F.lit(0)))
    hits = hits.withColumn("so_far", F.sum((F.col("rel") > 0).cast("int")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    gain = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("rank") + 1.0)
    aggs, good = [F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first")], F.col("rel") > 0
    for k in cutoffs:
        top = F.col("rank") <= k
        aggs += [F.sum(F.when(top, gain).otherwise(0.0)).alias(f"dcg_{k}"), F.count_if(top & good).alias(f"hits_{k}"), F.sum(F.when(top & good, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias(f"ap_{k}")]
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "item"))
    ideal = gold.where("relevance > 0").withColumn("r", ideal_rank)
    igain = (F.pow(F.lit(2.0), F.col("relevance")) - 1) / F.log2(F.col("r") + 1.0)
    ideal = ideal.groupBy("query_id").agg(F.count("*").alias("n_gold"), *(F.sum(F.when(F.col("r") <= k, igain).otherwise(0.0)).alias(f"idcg_{k}") for k in cutoffs))
    j = ideal.join(hits.groupBy("query_id").agg(*aggs), "query_id", "left").fillna(0)
    out = [F.round(F.when(F.col("first") > 0, 1 / F.col("first")).otherwise(0.0), 6).alias(f"mrr_{last}")]
    for k in cutoffs:
        out += [ratio(F.col(f"dcg_{k}"), F.col(f"idcg_{k}"), 0.0).alias(f"ndcg_{k}"), ratio(F.col(f"ap_{k}"), F.col("n_gold"), 0.0).alias(f"map_{k}"), ratio(F.col(f"hits_{k}"), F.col("n_gold"), 0.0).alias(f"recall_{k}"), F.round(F.col(f"hits_{k}") / k, 6).alias(f"precision_{k}")]
    return j.select("query_id", *out)


def document_id(url: Column, dataset: str) -> Column:
    """The document that an address ``beir://dataset/quoted-id`` names; null for any other address and for an empty id."""
    quoted = F.regexp_extract(url, rf"^beir://{dataset}/+([^?#]*)", 1)
    return F.when(quoted != "", F.try_url_decode(F.replace(quoted, F.lit("+"), F.lit("%2B"))))


def ranked_documents(sections: DataFrame, dataset: str) -> DataFrame:
    """(query_id, doc_id, rank, score) of ranked sections (query_id, parent_rank, url): a document stands where its first
    section does, and scores one over its rank. Addresses that name no document of the dataset are left out; ties of
    rank are in the order of ``doc`` if there is such a column, else of the id."""
    tie = F.col("doc") if "doc" in sections.columns else F.col("doc_id")
    rows = sections.withColumn("doc_id", document_id(F.col("url"), dataset)).where("doc_id is not null")
    best = rows.groupBy("query_id", "doc_id").agg(F.min(F.struct("parent_rank", tie.alias("tie"))).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at")
    return best.select("query_id", "doc_id", F.row_number().over(w).alias("rank")).withColumn("score", F.round(1 / F.col("rank"), 6))


def diagnostics(queries: DataFrame) -> DataFrame:
    """(query_id, retrieved, in_evidence, hits, evidence_hits, recall) of (query_id, gold, retrieved, evidence), arrays of
    documents: how many were retrieved and used, how many of them are gold, and the share of the gold ones retrieved,
    1 where there is none. A null array is empty."""
    of = lambda c: F.coalesce(c, F.array().cast(queries.schema[c].dataType))
    both = lambda c: F.size(F.array_intersect(of("gold"), of(c)))
    n = F.size(F.array_distinct(of("gold")))
    return queries.select("query_id", F.size(of("retrieved")).alias("retrieved"), F.size(of("evidence")).alias("in_evidence"), both("retrieved").alias("hits"), both("evidence").alias("evidence_hits"), F.when(n == 0, F.lit(1.0)).otherwise(F.round(both("retrieved") / n, 6)).alias("recall"))


def consistency(rows: DataFrame) -> DataFrame:
    """One row: how many of (hit, correct) are of each of the four kinds."""
    hit, correct = F.col("hit"), F.col("correct")
    return rows.agg(F.count_if(hit & correct).alias("hit_correct"), F.count_if(hit & ~correct).alias("hit_wrong"), F.count_if(~hit & correct).alias("miss_correct"), F.count_if(~hit & ~correct).alias("miss_wrong"))


def status_summary(rows: DataFrame, by: str) -> DataFrame:
    """(by, passed, failed, not_implemented, status): counts of (by, status) and the worst of them, where passed is better
    than failed and what isn't implemented only counts where nothing else is."""
    n = lambda s: F.count_if(F.col("status") == s)
    return rows.groupBy(by).agg(*(n(s).alias(s) for s in ("passed", "failed", "not_implemented")), F.when(n("failed") > 0, "failed").when(n("passed") > 0, "passed").otherwise("not_implemented").alias("worst")).withColumnRenamed("worst", "status")
