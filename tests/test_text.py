import json

from pyspark.sql import functions as F

from larkspur.functions import text as T


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(make(*(F.col(c) for c in df.columns)).alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.tokens, "GPU 数据湖 v2_x") == ["gpu", "数据", "据湖", "数", "据", "湖", "v2_x"]
    assert one(spark, T.index_text, "书") == "书"
    assert one(spark, T.tokens, "Mapped boxes") == ["mapped", "mapp", "boxes", "box", "boxe"]
    assert one(spark, T.tokens, "__init__ a_") == ["init", "a"]
    assert one(spark, T.tokens, "") == []
    assert one(spark, T.tokens, None) is None
    assert one(spark, T.query_terms, "湖") == ["湖"]
    assert one(spark, T.query_terms, "湖水 x") == ["湖水", "x"]


def test_lexical_gate(spark):
    gate = lambda q, d: T.lexical_gate(T.query_terms(q), T.tokens(d))
    table = [("red kite", "a kite", True), ("red kite string", "kite", False), ("kites", "the kite", False), ("山水画", "山下有水", False), ("山水画", "一幅山水画", True), ("山", "山下", True), ("!?", "anything", False), ("red", "", False)]
    for q, d, want in table:
        assert one(spark, gate, q, d) is want, (q, d)


def test_cleaning(spark):
    assert one(spark, T.clean_text, f"{T.BANNER}\n\na\r\n\n\n\nb ") == "a\n\nb"
    assert one(spark, T.normalize_url, " HTTP://Ex.COM?q=1#f") == "http://ex.com/?q=1"
    assert one(spark, T.normalize_url, "nothing") == ""
    assert tuple(one(spark, T.split_title, "# A b\nrest\n")) == ("A b", "rest")
    assert one(spark, T.strip_html, "<p>a &lt; b</p><script>x</script>") == "a < b"
    assert one(spark, T.strip_think, "a<think>b</think>c<think>d") == "ac"
    assert one(spark, T.safe_filename, ' a:b/c*" ') == "a_b_c__"
    assert one(spark, T.token_estimate, "12345678") == 6


def test_redaction(spark):
    redact = lambda s: one(spark, T.redact_text, s)
    assert redact("prompt_tokens=5 api_key='a b'") == "prompt_tokens=5 api_key='[REDACTED]'"
    assert redact("Authorization: Bearer abc") == "Authorization: Bearer [REDACTED]"
    assert redact("Cookie: a=b; c=d") == "Cookie: [REDACTED]"
    assert redact("x data:image/png;base64,AAAA y") == "x [BINARY DATA] y"
    assert redact("password=[REDACTED]") == "password=[REDACTED]"


def test_redaction_of_json(spark):
    redact = lambda s: one(spark, T.redact_text, s)
    inner = json.dumps({"Client-Secret": "s3", "n": 1, "note": "api_key=abc é"}, ensure_ascii=False)
    given = {"api_key": "x", "a": [{"Set-Cookie": ["c"], "token_count": 5}, inner, "password: hunter2", None, True, 1.5], "token": {"b": 1}, "prompt_tokens": "7"}
    safe = json.dumps({"Client-Secret": "[REDACTED]", "n": 1, "note": "api_key=[REDACTED] é"}, ensure_ascii=False)
    want = {"api_key": "[REDACTED]", "a": [{"Set-Cookie": "[REDACTED]", "token_count": 5}, safe, "password: [REDACTED]", None, True, 1.5], "token": "[REDACTED]", "prompt_tokens": "7"}
    assert redact(" \n" + json.dumps(given)) == json.dumps(want, ensure_ascii=False)
    assert redact('["Authorization: Bearer abc"]') == '["Authorization: Bearer [REDACTED]"]'
    assert redact("{token: abc") == "{token: [REDACTED]"
    assert redact("[" * 200_000 + '{"token": "abc"}' + "]" * 200_000) == "[REDACTED]"
    assert redact('["\\ud800"]') == '["?"]'
    assert redact(None) is None


def test_clip_keeps_whole_characters(spark):
    assert tuple(one(spark, lambda c: T.clip_bytes(c, 3), "aéé")) == ("aé", True)
    assert tuple(one(spark, lambda c: T.clip_bytes(c, 4), "aéé")) == ("aé", True)
    assert tuple(one(spark, lambda c: T.clip_bytes(c, 5), "aéé")) == ("aéé", False)


def test_preview_redacts_and_clips_any_text(spark):
    texts = ["aé中😀b\ufffd" * 3, "\ufffd\ufffd\ufffd\ufffd", "中文 token=abc 中文中文", '{"token": "中", "b": "é"}']
    safe = [*texts[:2], "中文 token=[REDACTED] 中文中文", '{"token": "[REDACTED]", "b": "é"}']
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    limits = range(1, 50)
    got = df.select("k", *(T.preview(F.col("x"), n).alias(f"n{n}") for n in limits)).collect()
    for r in got:
        raw = safe[r.k].encode()
        for n in limits:
            assert tuple(r[f"n{n}"]) == (raw[:n].decode(errors="ignore"), len(raw) > n)


def test_answers(spark):
    assert one(spark, T.normalize_answer, "18:40") == one(spark, T.normalize_answer, "18 minutes and 40 seconds")


def test_line_kinds(spark):
    kinds = {"## Setup": "heading", "- a": "list", "| a | b |": "table", "Q: what": "question", "Is it so?": "question", "A: yes": "answer", "Overview": "probable_heading", "It is so.": "text", "  ": "blank"}
    for line, kind in kinds.items():
        assert one(spark, T.line_kind, line) == kind


def test_url_safety(spark):
    private = ["http://10.0.0.1/", "http://localhost/", "http://[::1]/", "https://u@[0:0::1]:80/", "http://[fc00::1]/", "http://[fd12:3456::1%25eth0]/", "http://[FE80::1]/", "http://100.64.1.1/", "http://0.1.2.3"]
    fine = ["https://8.8.8.8/", "http://[2001:db8::1]/", "http://[fe00::1]/", "http://fc00.example/", "http://100.128.0.1/", "http://[::2]/"]
    for url, want in {**dict.fromkeys(private, "private"), **dict.fromkeys(fine, "ok"), "ftp://a/": "bad_scheme", "http:///x": "no_host", "http://[]/": "no_host", "": "bad_scheme"}.items():
        assert one(spark, T.url_safety, url) == want, url


def test_commands(spark):
    denied = lambda c, *allowed: one(spark, lambda x: T.denied_command(x, list(allowed)), c)
    for c in ("rm -rf /tmp/x", "ls; Shutdown now", "dd if=/dev/zero", "curl http://10.1.2.3/a", "curl 'http://[::1]/'"):
        assert denied(c) is True
    assert denied("echo format") is False and denied("curl https://8.8.8.8/x") is False
    assert denied("ls -l", "^ls") is False and denied("cat x", "^ls") is True and denied("ls; reboot", "^ls") is True
    for allowed, want in (([], False), (["*"], True), (["a"], True), (["b"], False)):
        assert one(spark, lambda c, allowed=allowed: T.is_allowed(c, allowed), "a") is want


def test_entities_and_cuts(spark):
    assert one(spark, T.strip_html, "<b>caf&eacute; &#65;&#x42; &lt;i&gt; &amp;amp; a&b</b>") == "café AB <i> &amp; a&b"
    assert one(spark, T.truncate_middle, "x" * 1_012_345) == "x" * 5000 + "\n\n... (1,002,345 chars truncated) ...\n\n" + "x" * 5000
    assert one(spark, T.truncate_result, "y" * 16_001) == "y" * 16_000 + "\n... (truncated)" and one(spark, T.truncate_result, "y" * 16_000) == "y" * 16_000


def test_answers_and_verdicts(spark):
    match = lambda a, g, *al: one(spark, lambda x, y: T.answers_match(x, y, F.array(*map(F.lit, al)).cast("array<string>")), a, g)
    assert match("18 minutes and 40 seconds", "18:40") and match("$1,000.", "no", "1000") and not match("a", "b", "c") and not match("?!", "!?") and not match(None, "a")
    for reply, want in {'{"verdict": " Correct "}': True, '{"verdict": "wrong", "why": "correct"}': False, '{"a": 1}': False, "it is correct": True, "INCORRECT, not correct": False, "": False, '["correct"]': True, '{"broken correct': True}.items():
        assert one(spark, T.verdict_of, reply) is want, reply
    assert one(spark, T.verdict_of, None) is False


def test_table_as_list(spark):
    show = lambda *lines: spark.createDataFrame([(list(lines),)], "l array<string>").select(T.table_as_list(F.col("l"))).first()[0]
    assert show("| a | b |", "|---|:--|", "| 1 | 2 |", "| | 3 | 9 |", "| | |") == "**a**: 1 · **b**: 2\n**b**: 3"
    assert show("| a |", "| 1 |") == "**a**: 1" and show("| a |") == "| a |"


def test_messages_requirements_and_unions(spark):
    line = spark.range(1).select(T.message_line(F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"), F.lit("user"), F.array(F.lit("a"), F.lit("b")), F.lit("x")).alias("l")).first().l
    assert line == "[2024-01-02T03:04] USER [tools: a, b]: x"
    met = lambda bins, env: spark.createDataFrame([(bins, env)], "b array<string>, e array<string>").select(T.requirements_met(F.col("b"), F.col("e"), ["git"], ["HOME"])).first()[0]
    assert met(["git"], ["HOME"]) and met(None, None) and not met(["gh"], []) and not met([], ["KEY"])
    assert spark.createDataFrame([([[3, 1], [1, 2]],)], "l array<array<int>>").select(T.ordered_union(F.col("l"))).first()[0] == [3, 1, 2]


def test_token_count(spark):
    from larkspur.functions.text import token_count

    ranks = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    got = spark.createDataFrame([("hello world",), ("",), (None,)], "t string").select(token_count(F.col("t"), ranks, r"\s*\S+").alias("n")).collect()
    assert [r.n for r in got][1:] == [4, None] and 5 <= got[0].n <= 9
