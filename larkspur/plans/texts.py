"""Queries over texts: cleaning, classification, splitting, and the page store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import validate as V
from larkspur.operators import chunk as C
from larkspur.operators import upsert as U
from larkspur.plans import data
from larkspur.plans.memory import SQL_STRIP
from larkspur.plans.registry import query
from larkspur.session import new_path

_WS = r"[\s\x{a0}\x{2009}\x{3000}]"
_PAGES = "pg AS (SELECT DISTINCT page_id, source_url, final_url, title, raw_text, content_hash, is_partial, status FROM web_pages WHERE page_id IS NOT NULL)"
_LINES = "ln AS (SELECT parent_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT DISTINCT parent_id, string_split(text, chr(10)) AS l FROM page_parents WHERE text IS NOT NULL AND parent_id IS NOT NULL))"


def _strip(x: str) -> str:
    return SQL_STRIP.format(x=x)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return data.read_table(spark, d, "web_pages").where("page_id is not null").select("page_id", "source_url", "final_url", "title", "raw_text", "content_hash", "is_partial", "status").distinct()


def _lines(spark: SparkSession, d: str) -> DataFrame:
    rows = data.parents(spark, d).where("parent_id is not null").select("parent_id", "text").distinct()
    return rows.select("parent_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("parent_id", (F.col("pos") + 1).alias("line_no"), "line")


@query("SELECT DISTINCT parent_id, page_id, length(text) AS n FROM page_parents WHERE parent_index = 0 AND text IS NOT NULL")
def scan_filtered(spark: SparkSession, d: str) -> DataFrame:
    return data.parents(spark, d).where("parent_index = 0").select("parent_id", "page_id", F.length("text").alias("n")).distinct().orderBy("page_id", "parent_id")


@query("SELECT page_id, final_url, title FROM web_pages WHERE final_url = (SELECT min(final_url) FROM web_pages) ORDER BY page_id, last_seen_at LIMIT 1")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One page by its address; the address reaches the scan as a filter."""
    pages = data.read_table(spark, d, "web_pages")
    url = pages.agg(F.min("final_url")).first()[0]
    return pages.where(F.col("final_url") == url).orderBy("page_id", "last_seen_at").limit(1).select("page_id", "final_url", "title")


@query(f"WITH {_LINES} SELECT parent_id, CAST(line_no AS INT) AS line_no, line FROM ln WHERE line_no BETWEEN 5 AND 14")
def line_page(spark: SparkSession, d: str) -> DataFrame:
    """Ten lines of each section from its fifth on."""
    return _lines(spark, d).where("line_no between 5 and 14")


_KIND = rf"""CASE WHEN s = '' THEN 'blank' WHEN regexp_matches(s, '^#{{1,3}}\s+\S') THEN 'heading' WHEN regexp_matches(s, '{T.LIST_ITEM}') THEN 'list'
 WHEN length(s) - length(replace(s, '|', '')) >= 2 OR regexp_matches(s, '{T.TABLE_RULE}') THEN 'table'
 WHEN regexp_matches(s, '{T.FAQ_PREFIX}') OR (suffix(s, '?') AND length(s) <= 100 AND len(string_split_regex(s, '{_WS}+')) <= 12) THEN 'question'
 WHEN regexp_matches(s, '{T.ANSWER_PREFIX}') THEN 'answer'
 WHEN NOT regexp_matches(s, '[.!?,;:。！？；：]$') AND length(s) <= 90 AND len(string_split_regex(s, '{_WS}+')) <= 10 AND regexp_matches(s, '{T.TITLE_HINT.replace("'", "''")}') THEN 'probable_heading' ELSE 'text' END"""


@query(f"WITH {_LINES}, st AS (SELECT parent_id, line_no, {_strip('line')} AS s FROM ln), k AS (SELECT parent_id, {_KIND} AS kind FROM st) SELECT parent_id, kind, count(*) AS n FROM k GROUP BY 1, 2")
def line_classify(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("parent_id", T.line_kind(F.col("line")).alias("kind")).groupBy("parent_id", "kind").agg(F.count("*").alias("n"))


@query(rf"WITH {_PAGES}, n AS (SELECT page_id, regexp_extract({_strip('source_url')}, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$', ['a', 'b', 'c', 'd']) AS p FROM pg) SELECT DISTINCT page_id, CASE WHEN p.a IS NULL OR p.a = '' THEN '' ELSE lower(p.a) || '://' || lower(p.b) || CASE WHEN p.c = '' THEN '/' ELSE p.c END || CASE WHEN p.d = '?' THEN '' ELSE coalesce(p.d, '') END END AS url FROM n WHERE p IS NOT NULL")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where("source_url is not null").select("page_id", T.normalize_url(F.col("source_url")).alias("url")).distinct()


@query(f"WITH {_PAGES} SELECT DISTINCT page_id, md5({_strip(r'''regexp_replace(replace(raw_text, chr(13) || chr(10), chr(10)), chr(10) || '{3,}', chr(10) || chr(10), 'g')''')}) AS cleaned FROM pg WHERE raw_text IS NOT NULL")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where("raw_text is not null").select("page_id", F.md5(T.clean_text(F.col("raw_text"))).alias("cleaned")).distinct()


@query(f"WITH t AS (SELECT DISTINCT parent_id, text FROM page_parents WHERE text IS NOT NULL) SELECT parent_id, CASE WHEN starts_with(text, '# ') THEN {_strip('''regexp_extract(text, '^# ([^' || chr(10) || ']*)', 1)''')} ELSE '' END AS title, length(CASE WHEN starts_with(text, '# ') THEN {_strip('''regexp_replace(text, '^# [^' || chr(10) || ']*(' || chr(10) || '|$)', '')''')} ELSE {_strip('text')} END) AS body_chars FROM t")
def title_split(spark: SparkSession, d: str) -> DataFrame:
    rows = data.parents(spark, d).select("parent_id", "text").distinct().withColumn("s", T.split_title(F.col("text")))
    return rows.select("parent_id", "s.title", F.length("s.body").alias("body_chars"))


@query(f"WITH {_PAGES} SELECT DISTINCT page_id, sha1(coalesce(title, '') || chr(10) || chr(10) || raw_text) AS hash FROM pg WHERE raw_text IS NOT NULL")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where("raw_text is not null").select("page_id", T.content_hash(F.col("title"), F.col("raw_text")).alias("hash")).distinct()


_WRAP = "'<p>' || replace(raw_text, chr(10), '<br/>') || '</p><script>var a = 1;</script><b>a &amp; b &lt; c</b>'"


@query(f"WITH {_PAGES}, h AS (SELECT DISTINCT page_id, {_WRAP} AS h FROM pg WHERE raw_text IS NOT NULL) SELECT page_id, md5({_strip('''replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')''')}) AS plain FROM h")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    """Page texts put into HTML and out again."""
    h = F.concat(F.lit("<p>"), F.replace("raw_text", F.lit("\n"), F.lit("<br/>")), F.lit("</p><script>var a = 1;</script><b>a &amp; b &lt; c</b>"))
    return _pages(spark, d).where("raw_text is not null").select("page_id", F.md5(T.strip_html(h)).alias("plain")).distinct()


@query(f"WITH t AS (SELECT DISTINCT record_id, '<think>' || memory_id || '</think> ' || text || CASE WHEN record_id % 2 = 0 THEN '<think>rest' ELSE '' END AS t FROM canonical_memories WHERE text IS NOT NULL AND memory_id IS NOT NULL) SELECT record_id, {_strip('''regexp_replace(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*$', '')''')} AS said FROM t")
def strip_think(spark: SparkSession, d: str) -> DataFrame:
    rows = data.read_table(spark, d, "canonical_memories").where("text is not null and memory_id is not null").select("record_id", F.concat(F.lit("<think>"), "memory_id", F.lit("</think> "), "text", F.when(F.col("record_id") % 2 == 0, F.lit("<think>rest")).otherwise(F.lit(""))).alias("t")).distinct()
    return rows.select("record_id", T.strip_think(F.col("t")).alias("said"))


@query(f"""WITH {_PAGES} SELECT DISTINCT page_id, {_strip('''regexp_replace(coalesce(title, 'none') || ' / ' || final_url, '[<>:"/' || chr(92) || chr(92) || '|?*]', '_', 'g')''')} AS name FROM pg WHERE final_url IS NOT NULL""")
def safe_filename(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where("final_url is not null").select("page_id", T.safe_filename(F.concat(F.coalesce("title", F.lit("none")), F.lit(" / "), "final_url")).alias("name")).distinct()


@query("SELECT doc_id, CAST(length(text) // 4 + 4 AS INT) AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return data.read_table(spark, d, "documents").where("text is not null").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


_SECRET = "'api_key=' || memory_id || ' token: ' || record_id || chr(10) || 'Authorization: Bearer ' || memory_id || chr(10) || 'prompt_tokens=5 ' || text"


@query(rf"WITH t AS (SELECT DISTINCT record_id, {_SECRET} AS t FROM canonical_memories WHERE text IS NOT NULL AND memory_id IS NOT NULL) SELECT record_id, regexp_replace(regexp_replace(t, '(api_key=|token: )[^\s,;}}\]]+', '\1[REDACTED]', 'g'), '(Authorization: Bearer )[^\r\n]+', '\1[REDACTED]') AS safe FROM t")
def redact_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("api_key="), "memory_id", F.lit(" token: "), F.col("record_id").cast("string"), F.lit("\nAuthorization: Bearer "), "memory_id", F.lit("\nprompt_tokens=5 "), "text")
    rows = data.read_table(spark, d, "canonical_memories").where("text is not null and memory_id is not null").select("record_id", t.alias("t")).distinct()
    return rows.select("record_id", T.redact_text(F.col("t")).alias("safe"))


@query("WITH t AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7f]', '', 'g') AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(left(t, 4096)) AS clipped, strlen(t) > 4096 AS truncated FROM t")
def preview_clip(spark: SparkSession, d: str) -> DataFrame:
    rows = data.read_table(spark, d, "documents").where("text is not null").select("doc_id", T.clip_bytes(F.regexp_replace("text", r"[^\x00-\x7f]", ""), 4096).alias("c"))
    return rows.select("doc_id", F.md5("c.text").alias("clipped"), "c.truncated")


@query()
def preview(spark: SparkSession, d: str) -> DataFrame:
    """The documents as stored, redacted and clipped; ``preview_clip`` is the clip of their ASCII characters."""
    rows = data.read_table(spark, d, "documents").where("text is not null").select("doc_id", T.preview(F.col("text")).alias("p"))
    return rows.select("doc_id", F.col("p.text").alias("text"), "p.truncated")


@query("SELECT doc_id, md5(CASE WHEN length(text) > 10000 THEN left(text, 5000) || chr(10) || chr(10) || '... (' || format('{:,}', length(text) - 10000) || ' chars truncated) ...' || chr(10) || chr(10) || right(text, 5000) ELSE text END) AS clipped FROM documents WHERE text IS NOT NULL")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return data.read_table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.truncate_middle(F.col("text"))).alias("clipped"))


@query(f"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '---' || chr(10) || 'name: x' || chr(10) || '---' || chr(10) || text ELSE text END AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(CASE WHEN regexp_matches(t, '(?s)^---' || chr(10) || '.*?' || chr(10) || '---' || chr(10)) THEN {_strip('''regexp_replace(t, '(?s)^---' || chr(10) || '.*?' || chr(10) || '---' || chr(10), '')''')} ELSE t END) AS body FROM t")
def frontmatter_strip(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("---\nname: x\n---\n"), "text")).otherwise(F.col("text"))
    return data.read_table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.strip_frontmatter(t)).alias("body"))


@query(f"WITH {_LINES} SELECT parent_id, CAST(line_no AS INT) AS line_no, array_to_string(list_transform(string_split(regexp_replace({_strip('line')}, '^\\||\\|$', '', 'g'), '|'), lambda x: trim(x)), '~') AS cells FROM ln WHERE starts_with(line, '|')")
def md_table_parse(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).where("line like '|%'").select("parent_id", "line_no", F.array_join(T.table_cells(F.col("line")), "~").alias("cells"))


@query(f"WITH {_LINES}, s AS (SELECT parent_id, line_no, starts_with(line, '|') AND NOT coalesce(lag(starts_with(line, '|')) OVER (PARTITION BY parent_id ORDER BY line_no), false) AS starts FROM ln), g AS (SELECT parent_id, line_no, sum(starts::INT) OVER (PARTITION BY parent_id ORDER BY line_no) AS tables FROM s) SELECT parent_id, CAST(greatest(tables, 1) AS BIGINT) AS grp, count(*) AS n FROM g GROUP BY 1, 2")
def table_groups(spark: SparkSession, d: str) -> DataFrame:
    """Lines in groups of at most one table: the second and each later table begins a group. The lines of a section are
    bounded by its text."""
    from pyspark.sql import Window

    w = Window.partitionBy("parent_id").orderBy("line_no")
    is_table = F.col("line").startswith("|")
    starts = (is_table & ~F.coalesce(F.lag(is_table).over(w), F.lit(False))).cast("int")
    rows = _lines(spark, d).withColumn("starts", starts).withColumn("tables", F.sum("starts").over(w))
    return rows.groupBy("parent_id", F.greatest("tables", F.lit(1)).cast("bigint").alias("grp")).agg(F.count("*").alias("n"))


@query(f"WITH {_PAGES} SELECT DISTINCT page_id, status < 400 AND trim(raw_text) <> '' AND raw_text IS NOT NULL AS accepted FROM pg WHERE status IS NOT NULL")
def fetch_accept(spark: SparkSession, d: str) -> DataFrame:
    """A fetched page, as the JSON that a fetcher gives, counts if it has text, no error and a status below 400."""
    j = F.to_json(F.struct("status", F.col("raw_text").alias("text")))
    rows = _pages(spark, d).where("status is not null").select("page_id", j.alias("j"))
    get = lambda k: F.get_json_object("j", f"$.{k}")
    return rows.select("page_id", (get("error").isNull() & (get("status").cast("int") < 400) & F.coalesce(F.trim(get("text")) != "", F.lit(False))).alias("accepted")).distinct()


def _sql_private() -> str:
    """Whether the IPv4 number ``ip`` or the bracketed host ``six`` lies in a private network."""
    parts = []
    for net in T.PRIVATE_NETS:
        base, bits = net.split("/")
        low = sum(int(x) * 256 ** (3 - k) for k, x in enumerate(base.split(".")))
        parts.append(f"coalesce(ip BETWEEN {low} AND {low + 2 ** (32 - int(bits)) - 1}, false)")
    return " OR ".join([*parts, "regexp_matches(six, '^[0:]*:0{0,3}1$')", "regexp_matches(six, '^f[cd][0-9a-f]{2}:')", "regexp_matches(six, '^fe[89ab][0-9a-f]:')"])


_VERDICT = rf"""h AS (SELECT url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)) AS host FROM u),
n AS (SELECT *, regexp_extract(host, '^\[([0-9a-f:.]*:[0-9a-f:.]*)', 1) AS six, CASE WHEN regexp_matches(host, '^\d{{1,3}}(\.\d{{1,3}}){{3}}$') THEN list_sum(list_transform(string_split(host, '.'), lambda x, i: CAST(x AS BIGINT) * (256 ** (4 - i))::BIGINT)) END AS ip FROM h),
v AS (SELECT url, CASE WHEN scheme NOT IN ('http', 'https') THEN 'bad_scheme' WHEN host IN ('', '[]') THEN 'no_host' WHEN host = 'localhost' OR {_sql_private()} THEN 'private' ELSE 'ok' END AS verdict FROM n)"""


@query(f"WITH u AS (SELECT source_url AS url FROM web_pages WHERE source_url IS NOT NULL UNION SELECT final_url FROM web_pages WHERE final_url IS NOT NULL), {_VERDICT} SELECT url, verdict FROM v")
def url_safety(spark: SparkSession, d: str) -> DataFrame:
    """Every address of the pages, as asked for and as found."""
    pages = data.read_table(spark, d, "web_pages")
    urls = pages.select(F.explode(F.array("source_url", "final_url")).alias("url")).where("url is not null").distinct()
    return urls.select("url", T.url_safety(F.col("url")).alias("verdict"))


_DENIED = " OR ".join(f"regexp_matches(l, '{p}')" for p in T.DENIED)


@query(rf"WITH {_PAGES}, ln AS (SELECT DISTINCT page_id, unnest(string_split(raw_text, chr(10))) AS line FROM pg WHERE raw_text IS NOT NULL), t AS (SELECT page_id, line, lower({_strip('line')}) AS l FROM ln), u AS (SELECT DISTINCT unnest(regexp_extract_all(line, '(?i)https?://[^\s\x22''`;|<>]+')) AS url FROM ln), {_VERDICT}, bad AS (SELECT url FROM v WHERE verdict <> 'ok') SELECT page_id, count(*) FILTER ({_DENIED} OR list_has_any(regexp_extract_all(line, '(?i)https?://[^\s\x22''`;|<>]+'), (SELECT coalesce(list(url), []) FROM bad))) AS denied FROM t GROUP BY 1")
def regex_guard(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of each page would be refused as commands."""
    lines = _pages(spark, d).where("raw_text is not null").select("page_id", F.explode(F.split("raw_text", "\n")).alias("line")).distinct()
    return lines.groupBy("page_id").agg(F.count_if(T.denied_command(F.col("line"))).alias("denied"))


@query("SELECT event_id, array_to_string(list_filter([CASE WHEN TRY_CAST(props->>'k' AS BIGINT) IS NULL THEN 'k: integer' ELSE '' END, CASE WHEN TRY_CAST(props->>'k' AS BIGINT) > 90 THEN 'k: maximum' ELSE '' END, CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'error') THEN 'event_type: enum' ELSE '' END], lambda x: x <> ''), ',') AS errors FROM events")
def schema_validate(spark: SparkSession, d: str) -> DataFrame:
    """Payloads cast to their types and held against a schema: k an integer of at most 90, the type one of a list."""
    schema = {"type": "object", "properties": {"k": {"type": "integer", "maximum": 90}, "event_type": {"enum": ["view", "click", "purchase", "error"]}}}
    payload = F.to_json(F.struct(F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"), "event_type"))
    rows = data.read_table(spark, d, "events").select("event_id", payload.alias("payload"))
    return V.validated(rows, "event_id", "payload", schema).select("event_id", F.array_join("errors", ",").alias("errors"))


_UP = "up AS (SELECT final_url, arg_max(content_hash, {'a': last_seen_at, 'b': page_id}) AS h, min(page_id) AS id FROM web_pages WHERE final_url IS NOT NULL AND content_hash IS NOT NULL AND last_seen_at IS NOT NULL GROUP BY 1), old AS (SELECT final_url, CASE WHEN id % 5 = 0 THEN 'stale' ELSE h END AS h FROM up WHERE id % 3 <> 0), new AS (SELECT final_url, h FROM up WHERE id % 7 <> 0), st AS (SELECT final_url, CASE WHEN new.h IS NULL THEN 'kept' WHEN old.h IS NULL THEN 'inserted' WHEN old.h = new.h THEN 'unchanged' ELSE 'updated' END AS status FROM old FULL JOIN new USING (final_url))"


def _upserts(spark: SparkSession, d: str) -> DataFrame:
    """The last hash of each address, as a store that has two thirds of them, some outdated, and a batch of most."""
    rows = data.read_table(spark, d, "web_pages").where("final_url is not null and content_hash is not null and last_seen_at is not null")
    up = rows.groupBy("final_url").agg(F.max_by("content_hash", F.struct("last_seen_at", "page_id")).alias("content_hash"), F.min("page_id").alias("id"))
    old = up.where("id % 3 <> 0").select("final_url", F.when(F.col("id") % 5 == 0, "stale").otherwise(F.col("content_hash")).alias("content_hash"))
    return U.upsert_status(old, up.where("id % 7 <> 0"))


@query(f"WITH {_UP} SELECT * FROM st")
def page_upsert_status(spark: SparkSession, d: str) -> DataFrame:
    return _upserts(spark, d)


@query(f"WITH {_UP} SELECT status, count(*) AS n FROM st GROUP BY 1")
def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    return _upserts(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {_UP} SELECT DISTINCT child_id, page_id FROM parent_children WHERE page_id IS NOT NULL AND page_id NOT IN (SELECT page_id FROM web_pages JOIN st USING (final_url) WHERE st.status = 'updated' AND page_id IS NOT NULL)")
def cascade_anti(spark: SparkSession, d: str) -> DataFrame:
    """Children that stay when the pages with new content lose theirs."""
    pages = data.read_table(spark, d, "web_pages").where("page_id is not null").select("page_id", "final_url")
    changed = pages.join(_upserts(spark, d).where("status = 'updated'"), "final_url", "left_semi")
    return U.surviving(data.read_table(spark, d, "parent_children").where("page_id is not null").select("child_id", "page_id"), changed, "page_id").distinct().select("child_id", "page_id")


@query("SELECT run_id, channel = 'slack' OR channel = 'cli' AS allowed FROM (SELECT run_id, max(channel) AS channel FROM runs WHERE run_id IS NOT NULL AND channel IS NOT NULL GROUP BY 1)")
def allow_list(spark: SparkSession, d: str) -> DataFrame:
    """Runs by whether their channel is on the list."""
    rows = data.read_table(spark, d, "runs").where("run_id is not null and channel is not null").groupBy("run_id").agg(F.max("channel").alias("channel"))
    return rows.select("run_id", T.is_allowed(F.col("channel"), ["slack", "cli"]).alias("allowed"))


_PAGE_STATE = f"""up1 AS (SELECT final_url, arg_max({{'h': content_hash, 't': raw_text, 's': last_seen_at}}, {{'a': last_seen_at, 'b': content_hash}}) AS x FROM web_pages WHERE final_url IS NOT NULL AND content_hash IS NOT NULL AND last_seen_at IS NOT NULL AND page_id % 3 <> 0 GROUP BY 1),
up2 AS (SELECT final_url, arg_max({{'h': content_hash, 't': raw_text, 's': last_seen_at}}, {{'a': last_seen_at, 'b': content_hash}}) AS x FROM web_pages WHERE final_url IS NOT NULL AND content_hash IS NOT NULL AND last_seen_at IS NOT NULL AND page_id % 7 <> 0 GROUP BY 1)
SELECT final_url, CASE WHEN b.x IS NULL THEN 'kept' WHEN a.x IS NULL THEN 'inserted' WHEN a.x.h = b.x.h THEN 'unchanged' ELSE 'updated' END AS status, coalesce(b.x.h, a.x.h) AS content_hash,
  CASE WHEN a.x.h = b.x.h OR b.x IS NULL THEN a.x.s ELSE b.x.s END AS updated_at, greatest(a.x.s, b.x.s) AS last_seen_at, coalesce(a.x.s, b.x.s) AS created_at,
  CAST(CASE WHEN a.x.h = b.x.h OR b.x IS NULL THEN len(string_split(coalesce(a.x.t, ''), chr(10))) ELSE len(string_split(coalesce(b.x.t, ''), chr(10))) END AS BIGINT) AS n_lines
FROM up1 a FULL JOIN up2 b USING (final_url)"""


def page_lines(pages: DataFrame) -> DataFrame:
    """A stand-in for what is made of a page's text: its lines, numbered."""
    return pages.select("final_url", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("nth", "line"))


@query("WITH " + _PAGE_STATE)
def page_store(spark: SparkSession, d: str) -> DataFrame:
    """Two batches of pages through the store: what became of each address, and what is stored of it then."""
    rows = data.read_table(spark, d, "web_pages").where("final_url is not null and content_hash is not null and last_seen_at is not null")
    cols = ["final_url", "title", F.col("raw_text").alias("text"), "content_hash", F.col("status").cast("int").alias("status"), F.col("last_seen_at").alias("seen_at")]
    store = U.PageStore(spark, new_path(spark, "pages"), page_lines, "final_url string, nth int, line string")
    # of rows of one address seen at one time the greatest hash counts
    best = lambda df: df.select(*cols).groupBy("final_url").agg(F.max_by(F.struct("title", "text", "content_hash", "status", "seen_at"), F.struct("seen_at", "content_hash")).alias("x")).select("final_url", "x.*")
    store.apply(best(rows.where("page_id % 3 <> 0")))
    status = store.apply(best(rows.where("page_id % 7 <> 0")))
    lines = store.dependants().groupBy("final_url").agg(F.count("*").alias("n_lines"))
    out = store.pages().join(status, "final_url", "left").join(lines, "final_url", "left")
    return out.select("final_url", F.coalesce(status["status"], F.lit("kept")).alias("status"), "content_hash", "updated_at", "last_seen_at", "created_at", "n_lines")


_TABLES = r"(?m)^\|[^\n]*(?:\n\|[^\n]*)*"
_CELLS = r"list_transform(string_split(regexp_replace({x}, '^\|+|\|+$', '', 'g'), '|'), lambda c: trim(c, ' '))"


@query(
    rf"""WITH p AS (SELECT DISTINCT parent_id, text FROM page_parents WHERE text IS NOT NULL AND parent_id IS NOT NULL), t AS (SELECT parent_id, unnest(regexp_extract_all(replace(text, chr(13), ''), '{_TABLES}')) AS t, unnest(range(1, len(regexp_extract_all(replace(text, chr(13), ''), '{_TABLES}')) + 1)) AS nth FROM p),
    l AS (SELECT parent_id, nth, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM t),
    h AS (SELECT *, {_CELLS.format(x='l[1]')} AS head, CASE WHEN regexp_matches(coalesce(l[2], ''), '^[|\s:\-]+$') THEN l[3:] ELSE l[2:] END AS body FROM l WHERE len(l) >= 2)
    SELECT parent_id, CAST(nth AS INT) AS nth, array_to_string(list_filter(list_transform(body, lambda r: array_to_string(list_filter(list_transform(range(1, len(head) + 1), lambda i: CASE WHEN coalesce(({_CELLS.format(x='r')})[i], '') <> '' THEN '**' || head[i] || '**: ' || ({_CELLS.format(x='r')})[i] END), lambda x: x IS NOT NULL), ' · ')), lambda x: x <> ''), chr(10)) AS listed FROM h"""
)
def md_table_list(spark: SparkSession, d: str) -> DataFrame:
    """The tables of each section as lists."""
    rows = data.parents(spark, d).where("parent_id is not null").select("parent_id", F.replace("text", F.lit("\r"), F.lit("")).alias("text")).distinct()
    tables = rows.select("parent_id", F.posexplode(F.regexp_extract_all("text", F.lit(_TABLES), F.lit(0))).alias("pos", "t")).select("parent_id", (F.col("pos") + 1).alias("nth"), F.split("t", "\n").alias("l"))
    return tables.where(F.size(F.filter("l", lambda x: F.trim(x) != "")) >= 2).select("parent_id", "nth", T.table_as_list(F.col("l")).alias("listed"))


# --- sequential splitting, rows only ---


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where("raw_text is not null").select("page_id", "raw_text").distinct()


def _recursive(rows: str, key: str, text: str, end: str, back: int, strip: bool) -> str:
    """Pieces of texts, one after another: ``end`` is the end of a piece that begins at ``pos``."""
    piece = _strip("substr(body, pos + 1, stop - pos)") if strip else "substr(body, pos + 1, stop - pos)"
    start = f"(CASE WHEN stop - {back} > pos THEN stop - {back} ELSE stop END)"
    return rf"""WITH RECURSIVE b AS (SELECT DISTINCT {key}, {_strip(text) if strip else text} AS body FROM {rows} WHERE {key} IS NOT NULL AND {text} IS NOT NULL),
    s AS (SELECT {key}, body, 0 AS pos, 0 AS nth FROM b WHERE body <> '' UNION ALL SELECT {key}, body, CAST({start} + length(regexp_extract(substr(body, {start} + 1), '^{_WS}*')) AS INT), nth + 1 FROM (SELECT *, {end} AS stop FROM s) WHERE stop < length(body) AND {start} + length(regexp_extract(substr(body, {start} + 1), '^{_WS}*')) < length(body))
    SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY pos) - 1 AS INT) AS nth, piece FROM (SELECT {key}, pos, {piece} AS piece FROM (SELECT *, {end} AS stop FROM s)) WHERE piece <> ''"""


_WINDOW_END = r"CASE WHEN pos + 800 < length(body) THEN CAST(pos + 800 - CASE WHEN length(regexp_extract(substr(body, pos + 401, 400), '[^ \n]*$')) < 400 THEN length(regexp_extract(substr(body, pos + 401, 400), '[^ \n]*$')) + 1 ELSE 0 END AS INT) ELSE length(body) END"
_MESSAGE_END = r"CASE WHEN pos + 2000 < length(body) THEN CAST(pos + CASE WHEN contains(substr(body, pos + 2, 1999), chr(10)) THEN 2000 - length(regexp_extract(substr(body, pos + 2, 1999), '[^\n]*$')) - 1 WHEN contains(substr(body, pos + 2, 1999), ' ') THEN 2000 - length(regexp_extract(substr(body, pos + 2, 1999), '[^ ]*$')) - 1 ELSE 2000 END AS INT) ELSE length(body) END"


@query(_recursive("page_parents", "parent_id", "text", _WINDOW_END, 150, True))
def chunk_children(spark: SparkSession, d: str) -> DataFrame:
    return C.pieces(data.parents(spark, d).select("parent_id", "text").distinct(), "parent_id", "text", lambda t: C.windows(t, 800, 150))


@query()
def structure_blocks(spark: SparkSession, d: str) -> DataFrame:
    return C.pieces(_bodies(spark, d), "page_id", "raw_text", C.structure)


@query()
def chunk_parents(spark: SparkSession, d: str) -> DataFrame:
    """Sections of each page, the first of which begins with the page's title."""
    rows = _pages(spark, d).where("raw_text is not null").select("page_id", F.concat(F.coalesce("title", F.lit("")), F.lit("\0"), "raw_text").alias("both")).distinct()
    return C.pieces(rows, "page_id", "both", lambda t: C.parent_blocks(t.partition("\0")[2], t.partition("\0")[0]))


@query(_recursive("web_pages", "page_id", "raw_text", _MESSAGE_END, 0, False))
def split_message(spark: SparkSession, d: str) -> DataFrame:
    return C.pieces(_bodies(spark, d), "page_id", "raw_text", C.split_message)


@query()
def html_to_md(spark: SparkSession, d: str) -> DataFrame:
    h = F.concat(F.lit("<h2>"), F.coalesce("title", F.lit("")), F.lit('</h2><a href="'), "final_url", F.lit('">here</a><p>'), F.replace("raw_text", F.lit("\n"), F.lit("<br/>")), F.lit("</p>"))
    rows = _pages(spark, d).select("page_id", h.alias("h")).distinct()
    return C.pieces(rows, "page_id", "h", lambda t: [C.html_to_markdown(t)])


@query()
def fuzzy_block(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each section that are most like its own first three, one of them misspelt."""

    def find(text: str) -> list[str]:
        lines = text.splitlines()[:3]
        found = C.fuzzy_block(text, "\n".join(lines).replace("e", "3", 1)) if lines else None
        return [found[0]] if found else []

    return C.pieces(data.parents(spark, d).select("parent_id", "text").distinct(), "parent_id", "text", find)
