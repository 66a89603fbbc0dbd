"""File sources: session logs, job files, evaluation cases, directory listings, and fetched pages as a data source."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from larkspur.functions.text import is_allowed

MESSAGE = "role string, content string, timestamp string, tool_call_id string, name string, tool_calls array<struct<id:string>>"
HEADER = "_type string, key string, created_at string, updated_at string, last_consolidated int"
FACT = "array<struct<main_class:string,sub_class:string,text:string>>"
CASE = f"case_id string, level string, scenario string, notes string, prior_snapshot {FACT}, gold_final_snapshot {FACT}, gold_extracted_snapshot {FACT}, gold_preserved_snapshot {FACT}, conversation array<struct<role:string,content:string,timestamp:string>>"
JOB = "id string, name string, enabled boolean, schedule struct<kind:string,at_ms:long,every_ms:long,expr:string,tz:string>, state struct<next_run_at_ms:long,last_run_at_ms:long,last_status:string>"


def _log_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value")
    return lines.withColumn("header", F.from_json("value", HEADER))


def session_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, created_at, updated_at, last_consolidated) out of the header lines of session logs, newest first."""
    return _log_lines(spark, path).where("header._type = 'metadata'").select("file", "header.key", "header.created_at", "header.updated_at", "header.last_consolidated").orderBy(F.col("updated_at").desc_nulls_last())


def session_messages(spark: SparkSession, path: str) -> DataFrame:
    """(file, nth, role, content, ..., ok) of the other lines, in the order of the file. A line that isn't JSON is kept
    with ok = false; blank lines are not there."""
    rows = _log_lines(spark, path).where("coalesce(header._type, '') <> 'metadata'").withColumn("m", F.from_json("value", MESSAGE))
    return rows.select("file", "nth", "m.*", F.col("m.role").isNotNull().alias("ok"))


def session_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, messages, error): one row a session log. One with a line that isn't JSON, or without a header, has no
    messages (null) but an error that says so."""
    lines = _log_lines(spark, path).withColumn("m", F.from_json("value", MESSAGE))
    head = F.col("header._type") == "metadata"
    bad = F.count_if(~F.coalesce(head, F.lit(False)) & F.col("m.role").isNull())
    r = lines.groupBy("file").agg(F.max("header.key").alias("key"), F.count_if(F.col("m.role").isNotNull()).alias("n"), bad.alias("bad"), F.count_if(head).alias("heads"))
    error = F.when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" broken lines"))).when(F.col("heads") == 0, "no header")
    return r.select("file", "key", F.when(error.isNull(), F.col("n")).alias("messages"), error.alias("error"))


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """The jobs of job files ``{"jobs": [...]}``, with the time at which their file was written."""
    rows = spark.read.schema(f"jobs array<struct<{JOB}>>").json(path, multiLine=True)
    return rows.select(F.explode("jobs").alias("j"), F.col("_metadata.file_modification_time").alias("modified_at")).select("j.*", "modified_at")


class JobFile:
    """The jobs of one job file, listed anew only when the file has been written since."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._seen, self._jobs = spark, path, None, None
        self._p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def load(self) -> DataFrame:
        """A missing file has no jobs."""
        at = self._fs.getFileStatus(self._p).getModificationTime() if self._fs.exists(self._p) else None
        if self._jobs is None or at != self._seen:
            self._seen = at
            self._jobs = self.spark.createDataFrame([], f"{JOB}, modified_at timestamp") if at is None else jobs(self.spark, self.path)
        return self._jobs


def beir(spark: SparkSession, path: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus (doc_id, title, text), queries (query_id, query), judgements (query_id, doc_id, relevance)) of a retrieval
    benchmark's folder: corpus.jsonl, queries.jsonl and qrels/<split>.tsv. Queries without a judgement in the split, and
    lines without an id, are left out; a missing title is empty."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{path}/corpus.jsonl").where("_id is not null")
    asked = spark.read.schema("_id string, text string").json(f"{path}/queries.jsonl").where("_id is not null")
    told = spark.read.csv(f"{path}/qrels/{split}.tsv", sep="\t", header=True, schema="`query-id` string, `corpus-id` string, score int")
    told = told.select(F.col("`query-id`").alias("query_id"), F.col("`corpus-id`").alias("doc_id"), F.col("score").alias("relevance")).where("query_id is not null and doc_id is not null")
    asked = asked.select(F.col("_id").alias("query_id"), F.col("text").alias("query")).join(told.select("query_id").distinct(), "query_id", "left_semi")
    return corpus.select(F.col("_id").alias("doc_id"), F.trim(F.coalesce("title", F.lit(""))).alias("title"), "text"), asked, told


def eval_cases(spark: SparkSession, path: str, levels: list[str] | None = None, scenarios: list[str] | None = None) -> DataFrame:
    """Cases of a file or, recursively, of a folder of ``*.json``: a list, ``{"cases": [...]}`` or one object a file.
    Nothing that matches is an error."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    v = F.trim("value")
    as_list = F.from_json(v, f"array<struct<{CASE}>>")
    wrapped = F.from_json(v, f"cases array<struct<{CASE}>>")["cases"]
    one = F.array(F.from_json(v, CASE))
    cases = text.select(F.explode(F.when(v.startswith("["), as_list).otherwise(F.coalesce(wrapped, one))).alias("c")).select("c.*").where("case_id is not null")
    if levels:
        cases = cases.where(F.col("level").isin(*levels))
    if scenarios:
        cases = cases.where(F.col("scenario").isin(*scenarios))
    if cases.isEmpty():
        raise ValueError(f"no case in {path} matches")
    return cases


def listing(spark: SparkSession, path: str, ignore: tuple[str, ...] = (".git", "node_modules", "__pycache__"), limit: int = 200) -> tuple[list[str], int]:
    """(the first ``limit`` files by name, how many there are) below a folder, without ignored folders. Contents aren't
    read, and the files are listed once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    for name in ignore:
        files = files.where(~F.col("path").contains(f"/{name}/"))
    first = files.orderBy("path").limit(limit).agg(F.sort_array(F.collect_list("path")).alias("names"))
    row = first.select("names", files.agg(F.count("*")).scalar().alias("n")).first()
    return row["names"], row["n"]


CHANNEL_MESSAGE = "channel string, chat_id string, sender string, id string, ts timestamp, content string, media array<string>"


def message_stream(spark: SparkSession, path: str, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """The messages of chat channels as a stream: every channel's adapter, outside, appends JSON lines to its folder below
    ``path``. Messages without an id or chat are left out, and so are senders whom the channel's list doesn't allow (a
    channel without a list lets nobody in); without lists everybody is let in. ``key`` is channel and chat, as the
    streaming operators want it."""
    rows = spark.readStream.schema(CHANNEL_MESSAGE).option("recursiveFileLookup", "true").json(path).where("id is not null and chat_id is not null and channel is not null")
    if allowed is not None:
        let_in = F.lit(False)
        for channel, names in allowed.items():
            let_in = let_in | ((F.col("channel") == channel) & is_allowed(F.col("sender"), names))
        rows = rows.where(let_in)
    return rows.select(F.concat_ws(":", "channel", "chat_id").alias("key"), "id", "ts", F.col("content").alias("body"), "media", "sender")


PAYLOAD = "url string, finalUrl string, status int, extractor string, text string, truncated boolean, error string"


def fetched_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages, rejects) of a folder of what a fetcher brought, one JSON object a line: pages are (source_url, final_url,
    status, extractor, text, is_partial), rejects (reason, n). No JSON, an error, a status of 400 or more and a blank text
    are reasons. As a stream, read the folder's text and apply ``accepted_page``."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    told = accepted_page(rows)
    return told.where("reason is null").select("page.*"), told.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def accepted_page(rows: DataFrame) -> DataFrame:
    """(page, reason) of JSON payloads (value): the page, or why there is none."""
    j = rows.select(F.from_json("value", PAYLOAD).alias("j"), F.try_parse_json("value").isNotNull().alias("is_json")).select("j.*", "is_json")
    reason = F.when(~F.col("is_json"), "json").when(F.coalesce("error", F.lit("")) != "", "error").when(F.coalesce("status", F.lit(0)) >= 400, "status").when(~F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False)), "text")
    page = F.struct(F.col("url").alias("source_url"), F.coalesce("finalUrl", "url").alias("final_url"), F.coalesce("status", F.lit(0)).alias("status"), "extractor", "text", F.coalesce("truncated", F.lit(False)).alias("is_partial"))
    return j.select(page.alias("page"), reason.alias("reason"))


class _Folder(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.lanes = options["path"], int(options.get("lanes", "8"))

    def partitions(self) -> list[InputPartition]:
        import glob

        found = sorted(f for f in glob.glob(f"{self.path}/**", recursive=True) if f.endswith((".json", ".jsonl")))
        return [_Folder(found[k :: self.lanes]) for k in range(min(self.lanes, len(found)) or 1)]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        for name in partition.files:
            with open(name, encoding="utf-8", errors="replace") as lines:
                for line in lines:
                    try:
                        d = json.loads(line)
                    except ValueError:
                        continue
                    if isinstance(d, dict) and not d.get("error") and str(d.get("text") or "").strip() and int(d.get("status") or 0) < 400:
                        yield d.get("url"), d.get("finalUrl") or d.get("url"), int(d.get("status") or 0), d.get("extractor"), d["text"], bool(d.get("truncated"))


class FetchedPages(DataSource):
    """``spark.read.format("fetched_pages").load(folder)``: the accepted pages of a folder that all executors share, one JSON
    object a line, read where they lie; a task takes whole files. ``fetched_pages`` has the rejects too."""

    @classmethod
    def name(cls) -> str:
        return "fetched_pages"

    def schema(self) -> str:
        return "source_url string, final_url string, status int, extractor string, text string, is_partial boolean"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)
