import json

import pytest

from larkspur.sources import files, sinks


def test_session_logs_round_trip(spark, tmp_path):
    heads = spark.createDataFrame([("a:1", "2024-01-02"), ("b", "2024-01-01")], "key string, updated_at string")
    msgs = spark.createDataFrame([("a:1", 0, "user", "hi"), ("a:1", 1, "assistant", "yes"), ("b", 0, "user", "x")], "key string, nth long, role string, content string")
    sinks.write_sessions(heads, msgs, str(tmp_path / "s"))
    assert [r.key for r in files.session_headers(spark, str(tmp_path / "s")).collect()] == ["a:1", "b"]
    back = files.session_messages(spark, str(tmp_path / "s")).orderBy("file", "nth").collect()
    assert [(r.role, r.content) for r in back] == [("user", "hi"), ("assistant", "yes"), ("user", "x")]


def test_bad_lines_are_marked(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"_type": "metadata", "key": "k"}\n\n{"role": "user", "content": "a"}\nnot json\n')
    assert [r.ok for r in files.session_messages(spark, str(tmp_path)).orderBy("nth").collect()] == [True, False]


def test_eval_cases(spark, tmp_path):
    case = {"case_id": "c1", "level": "L0", "scenario": "s", "prior_snapshot": [{"main_class": "projects", "sub_class": "a", "text": "b"}]}
    (tmp_path / "d").mkdir()
    (tmp_path / "a.json").write_text(json.dumps([case]))
    (tmp_path / "d" / "b.json").write_text(json.dumps({"cases": [case | {"case_id": "c2", "level": "L1"}]}))
    (tmp_path / "d" / "c.json").write_text(json.dumps(case | {"case_id": "c3"}))
    assert {r.case_id for r in files.eval_cases(spark, str(tmp_path)).collect()} == {"c1", "c2", "c3"}
    assert {r.case_id for r in files.eval_cases(spark, str(tmp_path), levels=["L1"]).collect()} == {"c2"}
    with pytest.raises(ValueError):
        files.eval_cases(spark, str(tmp_path), levels=["L9"])


def test_jobs_and_listing(spark, tmp_path):
    (tmp_path / "jobs.json").write_text(json.dumps({"jobs": [{"id": "1", "enabled": True, "schedule": {"kind": "every", "every_ms": 1000}}]}, indent=1))
    assert files.jobs(spark, str(tmp_path / "jobs.json")).select("schedule.every_ms").first()[0] == 1000
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x").write_text("")
    names, n = files.listing(spark, str(tmp_path))
    assert n == 1 and names[0].endswith("jobs.json")


def test_fetched_pages(spark, tmp_path):
    spark.dataSource.register(files.FetchedPages)
    good = {"url": "u", "finalUrl": "f", "status": 200, "extractor": "raw", "truncated": False, "text": "t"}
    lines = [json.dumps(p) for p in (good, good | {"status": 404}, good | {"error": "e"}, good | {"text": " "}, {"url": "only", "text": "x"})] + ["nothing", ""]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    rows = spark.read.format("fetched_pages").load(str(tmp_path)).collect()
    assert [(r.final_url, r.status) for r in rows] == [("f", 200), ("only", 0)]
    pages, rejects = files.fetched_pages(spark, str(tmp_path))
    assert sorted(map(tuple, pages.collect())) == sorted(map(tuple, rows))
    assert {r.reason: r.n for r in rejects.collect()} == {"status": 1, "error": 1, "text": 1, "json": 1}


def test_a_broken_session_is_told(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"_type": "metadata", "key": "k"}\n{"role": "user", "content": "a"}\n')
    (tmp_path / "bad.jsonl").write_text('{"_type": "metadata", "key": "b"}\n{"role": "user", "content": "a"}\nbroken\n')
    (tmp_path / "bare.jsonl").write_text('{"role": "user", "content": "a"}\n')
    got = {r.file.rpartition("/")[2]: (r.key, r.messages, r.error) for r in files.session_files(spark, str(tmp_path)).collect()}
    assert got == {"good.jsonl": ("k", 1, None), "bad.jsonl": ("b", None, "1 broken lines"), "bare.jsonl": (None, None, "no header")}


def test_keys_that_look_alike_get_files_of_their_own(spark, tmp_path):
    heads = spark.createDataFrame([("a:b",), ("a_b",)], "key string")
    msgs = spark.createDataFrame([("a:b", 0, "1"), ("a_b", 0, "2")], "key string, nth long, content string")
    sinks.write_sessions(heads, msgs, str(tmp_path / "s"))
    assert files.session_headers(spark, str(tmp_path / "s")).select("file").distinct().count() == 2


def test_a_job_file_is_listed_anew_only_when_written(spark, tmp_path):
    import os

    p = tmp_path / "jobs.json"
    job = files.JobFile(spark, str(p))
    assert job.load().count() == 0
    p.write_text(json.dumps({"jobs": [{"id": "1"}]}))
    first = job.load()
    assert first.count() == 1 and job.load() is first and first.first().modified_at is not None
    p.write_text(json.dumps({"jobs": [{"id": "1"}, {"id": "2"}]}))
    os.utime(p, (2_000_000_000, 2_000_000_000))
    assert job.load().count() == 2


def test_beir(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "1", "title": " T ", "text": "a"}\n{"_id": "2", "text": "b"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q", "text": "x"}\n{"_id": "r", "text": "y"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq\t1\t1\n")
    corpus, queries, told = files.beir(spark, str(tmp_path))
    assert [tuple(r) for r in corpus.orderBy("doc_id").collect()] == [("1", "T", "a"), ("2", "", "b")]
    assert [tuple(r) for r in queries.collect()] == [("q", "x")] and [tuple(r) for r in told.collect()] == [("q", "1", 1)]


def test_replace_file(tmp_path):
    p = str(tmp_path / "f")
    sinks.replace_file(p, "a")
    sinks.replace_file(p, "b", expected="a")
    with pytest.raises(ValueError):
        sinks.replace_file(p, "c", expected="a")
    assert open(p).read() == "b"


def test_report(spark):
    df = spark.createDataFrame([("x|y", 0.5)], "a string, b double")
    js, md = sinks.report(df, "T")
    assert json.loads(js)["rows"] == [{"a": "x|y", "b": 0.5}] and "| x\\|y | 0.5000 |" in md
    with pytest.raises(ValueError):
        sinks.report(df.union(df), "T", 1)


def test_messages_of_allowed_senders_stream_in(spark, tmp_path):
    (tmp_path / "in" / "cli").mkdir(parents=True)
    rows = [{"channel": c, "chat_id": "1", "sender": s, "id": f"{c}{s}", "content": "x"} for c in ("cli", "slack", "none") for s in "ab"] + [{"channel": "cli", "sender": "a"}]
    (tmp_path / "in" / "cli" / "m.json").write_text("\n".join(map(json.dumps, rows)))
    q = files.message_stream(spark, str(tmp_path / "in"), {"cli": ["*"], "slack": ["a"], "none": []}).writeStream.format("memory").queryName("messages").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.key, r.id) for r in spark.sql("select * from messages").collect()} == {("cli:1", "clia"), ("cli:1", "clib"), ("slack:1", "slacka")}
