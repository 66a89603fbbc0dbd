"""How the test tables stand in for the entities: distinct rows of each table, and the queries of a search (every page
whose id is divisible by 50 asks with its title)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.session import read_table


def child_rows(spark: SparkSession, d: str) -> DataFrame:
    """The children as they stand, repeated rows too. Who needs those of a few keys joins first and drops repeats then."""
    return read_table(spark, d, "parent_children").where("text is not null").select("child_id", "parent_id", "page_id", "child_index", "text")


def children(spark: SparkSession, d: str) -> DataFrame:
    return child_rows(spark, d).distinct()


def parents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "page_parents").where("text is not null").select("parent_id", "page_id", "parent_index", "text").distinct()


def parent_rows(spark: SparkSession, d: str) -> DataFrame:
    """The parents as they stand, repeated rows too."""
    return read_table(spark, d, "page_parents").where("text is not null").select("parent_id", "text")


def parent_costs(parents: DataFrame) -> DataFrame:
    """(parent_id, parent_cost): the token estimate of each parent's text; repeated rows change no maximum."""
    rows = parents.select("parent_id", F.length("text").alias("n"))
    return rows.groupBy("parent_id").agg(F.max("n").alias("n")).select("parent_id", (F.floor(F.col("n") / 4) + 4).alias("parent_cost"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """One row a page_id, the one last seen."""
    rows = read_table(spark, d, "web_pages").where("page_id is not null")
    return rows.groupBy("page_id").agg(F.max_by(F.struct("final_url", "title", "content_hash", "raw_text", "is_partial", "status"), "last_seen_at").alias("x"), F.max("last_seen_at").alias("last_seen_at")).select("page_id", "x.*", "last_seen_at")


def queries(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "web_pages").where("page_id % 50 = 0 and title is not null").groupBy(F.col("page_id").alias("query_id")).agg(F.max("title").alias("query"))


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """One row a record, trimmed."""
    rows = read_table(spark, d, "canonical_memories").where("record_id is not null and text is not null and main_class is not null")
    return rows.select("record_id", "workspace", "memory_id", "main_class", T.strip(F.coalesce("sub_class", F.lit(""))).alias("sub_class"), T.strip(F.col("text")).alias("text")).distinct()


def runs(spark: SparkSession, d: str) -> DataFrame:
    """One row a run: the row logged last."""
    rows = read_table(spark, d, "runs").where("run_id is not null")
    cols = [c for c in rows.columns if c not in ("run_id", "logged_at")]
    last = F.struct("logged_at", F.coalesce("finished_at", F.lit("1970-01-01").cast("timestamp_ntz")), F.xxhash64(*cols))
    return rows.groupBy("run_id").agg(F.max_by(F.struct(*cols), last).alias("x")).select("run_id", "x.*")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """(case_id, turn, role, content, ts): the turns of the conversations, from 0, with null content as empty."""
    rows = read_table(spark, d, "cases").where("case_id is not null").select("case_id", "conversation").distinct()
    t = rows.select("case_id", F.posexplode("conversation").alias("turn", "m"))
    return t.select("case_id", "turn", F.col("m.role").alias("role"), F.coalesce("m.content", F.lit("")).alias("content"), F.col("m.timestamp").alias("ts"))


def snapshot(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """(case_id, main_class, sub_class, text) of the facts of one or several snapshot columns, distinct."""
    rows = read_table(spark, d, "cases").where("case_id is not null").select("case_id", F.explode(F.flatten(F.array(*(F.coalesce(c, F.array().cast("array<struct<main_class:string,sub_class:string,text:string>>")) for c in columns)))).alias("f"))
    return rows.select("case_id", F.coalesce("f.main_class", F.lit("")).alias("main_class"), F.coalesce("f.sub_class", F.lit("")).alias("sub_class"), F.coalesce("f.text", F.lit("")).alias("text")).distinct()
