"""Queries through files and streams: tables written as the logs, jobs and cases that the sources read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators import upsert as U
from larkspur.plans import activity, data
from larkspur.plans.registry import query
from larkspur.plans.texts import page_lines
from larkspur.session import new_path, read_table
from larkspur.sources import files, sinks
from larkspur.streaming import operators as S


@query(f"WITH {activity._T} SELECT case_id AS key, CAST(count(*) AS BIGINT) AS messages, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS asked, CAST(sum(length(content)) AS BIGINT) AS chars FROM t GROUP BY 1")
def sessions_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Conversations written as session logs, one file each, and read again."""
    t = data.turns(spark, d)
    path = new_path(spark, "sessions-jsonl")
    sinks.write_sessions(t.select(F.col("case_id").alias("key")).distinct(), t.select(F.col("case_id").alias("key"), F.col("turn").alias("nth"), F.coalesce("role", F.lit("?")).alias("role"), "content"), path)
    heads = files.session_headers(spark, path).select("file", "key")
    msgs = files.session_messages(spark, path).where("ok")
    return msgs.join(heads, "file").groupBy("key").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.length("content")).alias("chars"))


@query("SELECT DISTINCT case_id, level, scenario, CAST(len(prior_snapshot) AS INT) AS prior, CAST(len(gold_final_snapshot) AS INT) AS final, CAST(len(conversation) AS INT) AS turns FROM cases WHERE case_id IS NOT NULL")
def eval_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases written as files of cases and read again by the loader."""
    path = new_path(spark, "cases-json")
    rows = read_table(spark, d, "cases").where("case_id is not null").distinct()
    body = rows.select(F.pmod(F.xxhash64("case_id"), F.lit(16)).alias("lane"), F.struct("case_id", "level", "scenario", "notes", "prior_snapshot", "gold_final_snapshot", "conversation").alias("c"))
    # the files of a loader hold a bounded list each
    nth = F.floor(F.pmod(F.xxhash64("c.case_id", F.lit(1)), F.lit(64)))
    body.groupBy("lane", nth.alias("nth")).agg(F.collect_list("c").alias("cases")).select("cases").write.option("maxRecordsPerFile", 1).json(path)
    return files.eval_cases(spark, path).select("case_id", "level", "scenario", F.size("prior_snapshot").alias("prior"), F.size("gold_final_snapshot").alias("final"), F.size("conversation").alias("turns"))


@query(f"WITH {activity._J} SELECT CAST(job_id AS VARCHAR) AS id, kind, next_ms FROM nr WHERE kind <> 'off'")
def jobs_scan(spark: SparkSession, d: str) -> DataFrame:
    """Schedule entries written as job files and read again."""
    path = new_path(spark, "jobs-json")
    j = activity._jobs(spark, d).select(F.struct(F.col("job_id").cast("string").alias("id"), "enabled", F.struct("kind", "at_ms", "every_ms", "expr", "tz").alias("schedule"), F.struct(F.col("next_ms").alias("next_run_at_ms")).alias("state")).alias("j"))
    # job files of a bounded number of jobs each, one a JSON object
    j.groupBy(F.pmod(F.xxhash64("j.id"), F.lit(64)).alias("lane")).agg(F.collect_list("j").alias("jobs")).select("jobs").write.option("maxRecordsPerFile", 1).json(path)
    return files.jobs(spark, path).where("enabled").select("id", "schedule.kind", F.col("state.next_run_at_ms").alias("next_ms"))


@query(f"WITH {activity._R} SELECT session_key, max(started_at) AS updated_at FROM r WHERE session_key IS NOT NULL AND started_at IS NOT NULL GROUP BY 1")
def session_list(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by the header lines of their logs, the last updated first."""
    runs = activity._runs(spark, d).where("session_key is not null and started_at is not null")
    heads = runs.groupBy(F.col("session_key").alias("key")).agg(F.date_format(F.max("started_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("updated_at"))
    lines = runs.select(F.col("session_key").alias("key"), F.row_number().over(Window.partitionBy("session_key").orderBy("started_at", "run_id")).alias("nth"), F.lit("user").alias("role"), F.col("run_id").alias("content"))
    path = new_path(spark, "sessions-list")
    sinks.write_sessions(heads, lines, path)
    return files.session_headers(spark, path).select(F.col("key").alias("session_key"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT page_id FROM web_pages WHERE page_id IS NOT NULL AND raw_text IS NOT NULL)) AS docs, (SELECT count(*) FROM (SELECT page_id FROM web_pages WHERE page_id % 50 = 0 AND title IS NOT NULL AND page_id IN (SELECT page_id FROM page_parents) GROUP BY 1)) AS queries, (SELECT count(DISTINCT (page_id, parent_id)) FROM page_parents WHERE page_id % 50 = 0 AND page_id IN (SELECT page_id FROM web_pages WHERE title IS NOT NULL)) AS judgements")
def beir_load(spark: SparkSession, d: str) -> DataFrame:
    """Pages, titles and their sections written as a benchmark's folder and read again."""
    path = new_path(spark, "beir")
    pages = read_table(spark, d, "web_pages").where("page_id is not null and raw_text is not null").groupBy("page_id").agg(F.max("title").alias("title"), F.max("raw_text").alias("text"))
    pages.select(F.col("page_id").cast("string").alias("_id"), "title", "text").write.json(f"{path}/corpus.jsonl")
    asked = data.queries(spark, d)
    asked.select(F.col("query_id").cast("string").alias("_id"), F.col("query").alias("text")).write.json(f"{path}/queries.jsonl")
    told = read_table(spark, d, "page_parents").where("page_id % 50 = 0").join(asked.select(F.col("query_id").alias("page_id")), "page_id", "left_semi").select("page_id", "parent_id").distinct()
    told.select(F.col("page_id").cast("string").alias("query-id"), F.col("parent_id").cast("string").alias("corpus-id"), F.lit(1).alias("score")).write.csv(f"{path}/qrels/test.tsv", sep="\t", header=True)
    corpus, queries, judgements = files.beir(spark, path)
    n = lambda df: df.agg(F.count("*")).scalar()
    return spark.range(1).select(n(corpus).alias("docs"), n(queries).alias("queries"), n(judgements).alias("judgements"))


def _as_stream(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A table as a stream: written to a folder, and that folder read as it comes."""
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _run_stream(spark: SparkSession, out: DataFrame, name: str) -> DataFrame:
    path = new_path(spark, name)
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path)
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


@query(
    "WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events), "
    "w AS (SELECT a.user_id, a.nth, a.event_id, (SELECT min(b.nth) FROM e b WHERE b.user_id = a.user_id AND b.nth > a.nth AND epoch_us(b.ts) // 1000 - epoch_us(a.ts) // 1000 >= 21600000) AS next FROM e a), "
    "r AS (SELECT user_id, nth, event_id, next FROM w WHERE nth = 1 UNION ALL SELECT w.user_id, w.nth, w.event_id, w.next FROM r JOIN w ON w.user_id = r.user_id AND w.nth = r.next) "
    "SELECT CAST(user_id AS VARCHAR) AS key, CAST(event_id AS VARCHAR) AS id FROM r"
)
def throttle(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user at least six hours after the last one let through, by a stream with state per user."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    S.use_rocksdb(spark)
    try:
        src = _as_stream(spark, read_table(spark, d, "events"), "events")
        rows = src.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("body"))
        return _run_stream(spark, S.throttle(rows, 21_600_000), "throttle").select("key", "id")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@query("SELECT DISTINCT coalesce(session_key, '') AS key, run_id AS id FROM runs WHERE run_id IS NOT NULL")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The runs of each session by a stream that lets an id through once; its memory, 100,000 ids a key, is beyond what a
    session has here."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    S.use_rocksdb(spark)
    try:
        src = _as_stream(spark, read_table(spark, d, "runs").where("run_id is not null").select(F.coalesce("session_key", F.lit("")).alias("key"), F.col("run_id").alias("id"), "status"), "runs")
        return _run_stream(spark, S.dedup_last(src.select("key", "id", F.lit(None).cast("timestamp").alias("ts"), F.col("status").alias("body")), 100_000), "dedup").select("key", "id")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@query("SELECT final_url, arg_max(content_hash, {'a': last_seen_at, 'b': content_hash}) AS content_hash, CAST(len(string_split(arg_max(raw_text, {'a': last_seen_at, 'b': content_hash}), chr(10))) AS BIGINT) AS n_lines FROM web_pages WHERE final_url IS NOT NULL AND content_hash IS NOT NULL AND last_seen_at IS NOT NULL AND trim(raw_text) <> '' AND status < 400 GROUP BY 1")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Fetched pages as JSON payloads through a stream into the page store, and what is stored of them then."""
    rows = read_table(spark, d, "web_pages").where("final_url is not null and content_hash is not null and last_seen_at is not null and trim(raw_text) <> ''")
    payload = F.to_json(F.struct(F.col("source_url").alias("url"), F.col("final_url").alias("finalUrl"), "status", "extractor", F.col("raw_text").alias("text"), F.col("is_partial").alias("truncated"), "title", "content_hash", "last_seen_at"))
    src = _as_stream(spark, rows.where("status < 400").select(payload.alias("value")), "payloads")
    store = U.PageStore(spark, new_path(spark, "pages"), page_lines, "final_url string, nth int, line string")

    def upsert(batch: DataFrame, epoch: int) -> None:
        meta = F.from_json("value", "title string, content_hash string, last_seen_at timestamp_ntz")
        both = batch.select("value", meta.alias("m"), F.from_json("value", files.PAYLOAD).alias("j"))
        pages = both.where(F.coalesce("j.error", F.lit("")) == "").select(F.coalesce("j.finalUrl", "j.url").alias("final_url"), "m.title", "j.text", "m.content_hash", "j.status", F.col("m.last_seen_at").alias("seen_at"))
        store.apply(pages.groupBy("final_url").agg(F.max_by(F.struct("title", "text", "content_hash", "status", "seen_at"), F.struct("seen_at", "content_hash")).alias("x")).select("final_url", "x.*"))

    S.ingest(src, upsert, new_path(spark, "ingest-checkpoint"), once=True).awaitTermination()
    lines = store.dependants().groupBy("final_url").agg(F.count("*").alias("n_lines"))
    return store.pages().join(lines, "final_url").select("final_url", "content_hash", "n_lines")
