"""Queries over fact snapshots and the fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions.backends import HashEmbedder, embed
from larkspur.operators import facts as K
from larkspur.plans import data
from larkspur.plans.registry import query
from larkspur.session import keep, new_path

SQL_STRIP = r"regexp_replace({x}, '^[\s\x{{a0}}\x{{2009}}\x{{3000}}]+|[\s\x{{a0}}\x{{2009}}\x{{3000}}]+$', '', 'g')"
_F = f"f AS (SELECT DISTINCT record_id, workspace, memory_id, main_class, {SQL_STRIP.format(x='coalesce(sub_class, chr(32))')} AS sub_class, {SQL_STRIP.format(x='text')} AS text FROM canonical_memories WHERE record_id IS NOT NULL AND text IS NOT NULL AND main_class IS NOT NULL)"
_CLASSES = "[" + ", ".join(f"'{c}'" for c in K.CLASSES) + "]"
_CORE = ", ".join(f"'{c}'" for c in K.CORE)
SNAP = "SELECT DISTINCT case_id, coalesce(f.main_class, '') AS main_class, coalesce(f.sub_class, '') AS sub_class, coalesce(f.text, '') AS text FROM (SELECT case_id, unnest({c}) AS f FROM cases WHERE case_id IS NOT NULL)"
_OLD, _NEW = SNAP.format(c="prior_snapshot"), SNAP.format(c="gold_final_snapshot")
_DIFF = f"o AS ({_OLD}), n AS ({_NEW}), diff AS (SELECT case_id, main_class, sub_class, text, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'unchanged' END AS status FROM (SELECT *, 1 AS a FROM o) FULL JOIN (SELECT *, 1 AS b FROM n) USING (case_id, main_class, sub_class, text))"


def _diff(spark: SparkSession, d: str) -> DataFrame:
    return K.snapshot_diff(data.snapshot(spark, d, "prior_snapshot"), data.snapshot(spark, d, "gold_final_snapshot"), ["case_id"])


@query(f"WITH {_F} SELECT record_id, memory_id, main_class, sub_class, text FROM f ORDER BY main_class, sub_class, record_id")
def fact_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return data.facts(spark, d).select("record_id", "memory_id", "main_class", "sub_class", "text").orderBy("main_class", "sub_class", "record_id")


@query(f"WITH {_F} SELECT record_id, main_class, CAST(list_position({_CLASSES}, main_class) AS INT) AS class_rank, text FROM f WHERE main_class IN ({_CORE})")
def core_facts(spark: SparkSession, d: str) -> DataFrame:
    rows = data.facts(spark, d).where(F.col("main_class").isin(*K.CORE))
    return rows.select("record_id", "main_class", K.class_rank(F.col("main_class")).alias("class_rank"), "text").orderBy("class_rank", "record_id")


@query(f"WITH {_F}, c AS (SELECT unnest({_CLASSES}) AS main_class) SELECT c.main_class, count(f.record_id) AS n FROM c LEFT JOIN f USING (main_class) GROUP BY 1")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    domain = spark.createDataFrame([(c,) for c in K.CLASSES], "main_class string")
    counts = data.facts(spark, d).groupBy("main_class").agg(F.count("*").alias("n"))
    return domain.join(counts, "main_class", "left").select("main_class", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    f"""WITH r AS (SELECT DISTINCT record_id, main_class, sub_class, text FROM canonical_memories WHERE record_id IS NOT NULL),
    v AS (SELECT record_id, list_filter([
      CASE WHEN coalesce(main_class, '') NOT IN (SELECT unnest({_CLASSES})) THEN 'class' ELSE '' END,
      CASE WHEN {SQL_STRIP.format(x="coalesce(sub_class, '')")} = '' THEN 'sub_class_empty' ELSE '' END,
      CASE WHEN {SQL_STRIP.format(x="coalesce(text, '')")} = '' THEN 'text_empty' ELSE '' END,
      CASE WHEN regexp_matches(coalesce(sub_class, '') || coalesce(text, ''), '[\\r\\n]') THEN 'line_break' ELSE '' END,
      CASE WHEN coalesce({SQL_STRIP.format(x='text')} <> text OR {SQL_STRIP.format(x='sub_class')} <> sub_class, false) THEN 'untrimmed' ELSE '' END,
      CASE WHEN contains(coalesce(sub_class, ''), ': ') THEN 'separator' ELSE '' END], lambda x: x <> '') AS l FROM r)
    SELECT record_id, array_to_string(l, ',') AS violations FROM v"""
)
def fact_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = data.read_table(spark, d, "canonical_memories").where("record_id is not null").select("record_id", "main_class", "sub_class", "text").distinct()
    return rows.select("record_id", K.violations(F.col("main_class"), F.col("sub_class"), F.col("text")).alias("violations"))


@query(f"WITH {_DIFF} SELECT * FROM diff")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d)


@query(f"WITH {_DIFF} SELECT *, CASE WHEN status = 'added' THEN 'insert' ELSE 'delete' END AS store, CASE WHEN main_class IN ({_CORE}) THEN 'none' WHEN status = 'added' THEN 'embed' ELSE 'unindex' END AS index FROM diff WHERE status <> 'unchanged'")
def snapshot_commit_plan(spark: SparkSession, d: str) -> DataFrame:
    return K.commit_plan(_diff(spark, d))


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT 'both' AS part, * FROM (SELECT * FROM o INTERSECT SELECT * FROM n) UNION ALL SELECT 'old', * FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT 'new', * FROM (SELECT * FROM n EXCEPT SELECT * FROM o)")
def snapshot_setops(spark: SparkSession, d: str) -> DataFrame:
    o, n = data.snapshot(spark, d, "prior_snapshot"), data.snapshot(spark, d, "gold_final_snapshot")
    tag = lambda name, df: df.select(F.lit(name).alias("part"), "*")
    return tag("both", o.intersect(n)).unionByName(tag("old", o.subtract(n))).unionByName(tag("new", n.subtract(o)))


@query(
    r"""WITH r AS (SELECT main_class, trim(regexp_replace(sub_class, '[\s\x{a0}\x{2009}\x{3000}]+', ' ', 'g')) AS sub_class, trim(regexp_replace(text, '[\s\x{a0}\x{2009}\x{3000}]+', ' ', 'g')) AS text FROM canonical_memories)
    SELECT DISTINCT main_class, sub_class, text FROM r WHERE main_class <> '' AND sub_class <> '' AND text <> ''"""
)
def snapshot_normalize(spark: SparkSession, d: str) -> DataFrame:
    flat = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " ")).alias(c)
    return data.read_table(spark, d, "canonical_memories").select("main_class", flat("sub_class"), flat("text")).where("main_class <> '' and sub_class <> '' and text <> ''").distinct()


@query("SELECT memory_id, arg_max(text, {'a': stored_at, 'b': record_id}) AS text, min(record_id) AS first_record FROM canonical_memories WHERE memory_id IS NOT NULL AND text IS NOT NULL AND stored_at IS NOT NULL GROUP BY 1")
def last_write_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The last text of each memory_id at the place of its first record."""
    rows = data.read_table(spark, d, "canonical_memories").where("memory_id is not null and text is not null and stored_at is not null")
    return rows.groupBy("memory_id").agg(F.max_by("text", F.struct("stored_at", "record_id")).alias("text"), F.min("record_id").alias("first_record"))


@query(f"WITH {_F} SELECT record_id, main_class || ':' || regexp_replace(lower(sub_class), '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') || ':' || left(sha1(text), 12) AS canonical_id FROM f")
def canonical_id(spark: SparkSession, d: str) -> DataFrame:
    return data.facts(spark, d).select("record_id", T.canonical_id(F.col("main_class"), F.col("sub_class"), F.col("text")).alias("canonical_id"))


@query(f"WITH {_F}, m AS (SELECT workspace, memory_id, count(*) AS n, count(DISTINCT text) AS texts FROM f WHERE workspace IS NOT NULL GROUP BY 1, 2) SELECT workspace, CAST(sum(n) AS BIGINT) AS records, CAST(count(*) FILTER (n > 1) AS BIGINT) AS repeated_ids, CAST(count(*) FILTER (texts > 1) AS BIGINT) AS conflicts FROM m GROUP BY 1")
def conversion_report(spark: SparkSession, d: str) -> DataFrame:
    """What a conversion of each workspace would find."""
    m = data.facts(spark, d).where("workspace is not null").groupBy("workspace", "memory_id").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"))
    return m.groupBy("workspace").agg(F.sum("n").alias("records"), F.count_if(F.col("n") > 1).alias("repeated_ids"), F.count_if(F.col("texts") > 1).alias("conflicts"))


_SECTIONS = ", ".join(
    f"'## {title}' || chr(10) || chr(10) || CASE WHEN len(list_filter(s, lambda x: x.main_class = '{c}')) > 0 THEN array_to_string(list_transform(list_sort(list_transform(list_filter(s, lambda x: x.main_class = '{c}'), lambda x: {{'s': x.sub_class, 'i': x.memory_id, 't': x.text}})), lambda x: '- ' || x.s || ': ' || x.t), chr(10)) ELSE '{empty}' END"
    for c, title, empty in K.SECTIONS
)
_HEAD = ", ".join(f"'{x}'" for x in K.HEAD)


@query(f"WITH w AS (SELECT workspace, list({{'main_class': main_class, 'sub_class': sub_class, 'text': text, 'memory_id': coalesce(memory_id, '')}}) AS s FROM (SELECT DISTINCT workspace, main_class, {SQL_STRIP.format(x='coalesce(sub_class, chr(32))')} AS sub_class, {SQL_STRIP.format(x='text')} AS text, memory_id FROM canonical_memories WHERE workspace IS NOT NULL AND record_id IS NOT NULL AND text IS NOT NULL AND main_class IS NOT NULL) GROUP BY 1) SELECT workspace, md5(concat_ws(chr(10) || chr(10), {_HEAD}, {_SECTIONS}, '---', '{K.FOOT.format(writer='the engine')}')) AS document FROM w")
def render_md(spark: SparkSession, d: str) -> DataFrame:
    """The document of each workspace. A document is one row by its nature."""
    f = data.facts(spark, d).where("workspace is not null").select("workspace", "main_class", "sub_class", "text", F.coalesce("memory_id", F.lit("")).alias("memory_id")).distinct()
    s = f.groupBy("workspace").agg(F.collect_list(F.struct("main_class", "sub_class", "text", "memory_id")).alias("s"))
    return s.select("workspace", F.md5(K.render(F.col("s"))).alias("document"))


_LINE = "'- [' || main_class || '/' || sub_class || '] ' || text"


@query(
    f"""WITH s AS ({_NEW}), l AS (SELECT case_id, string_agg({_LINE}, chr(10) ORDER BY list_position({_CLASSES}, main_class), sub_class, text) FILTER (main_class IN ({_CORE})) AS core,
    string_agg({_LINE}, chr(10) ORDER BY list_position({_CLASSES}, main_class), sub_class, text) FILTER (main_class NOT IN ({_CORE})) AS found FROM s GROUP BY 1)
    SELECT case_id, '# Memory' || chr(10) || chr(10) || concat_ws(chr(10) || chr(10), '## Core Memory' || chr(10) || core, '## Retrieved Memory' || chr(10) || found) AS block FROM l"""
)
def context_block(spark: SparkSession, d: str) -> DataFrame:
    """Core facts, then the retrieved ones, as the text of a prompt. A snapshot is one row's array, so groups are small."""
    s = data.snapshot(spark, d, "gold_final_snapshot")
    item = F.struct(K.class_rank(F.col("main_class")).alias("r"), "sub_class", "text", "main_class")
    lists = s.groupBy("case_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("main_class").isin(*K.CORE) == core, item))).alias(name) for name, core in (("core", True), ("found", False))))
    return lists.select("case_id", K.context_block(F.col("core"), F.col("found")).alias("block"))


@query(
    f"""WITH {_DIFF}, c AS (SELECT 1 AS version, count(*) AS added, 0 AS removed, count(*) FILTER (main_class NOT IN ({_CORE})) AS indexed FROM o UNION ALL
    SELECT 2, count(*) FILTER (status = 'added'), count(*) FILTER (status = 'removed'), (SELECT count(*) FROM n WHERE main_class NOT IN ({_CORE})) FROM diff)
    SELECT CAST(version AS BIGINT) AS version, CAST(added AS BIGINT) AS added, CAST(removed AS BIGINT) AS removed, CAST(indexed AS BIGINT) AS indexed FROM c"""
)
def snapshot_commit(spark: SparkSession, d: str) -> DataFrame:
    """The prior snapshots of all cases committed to a store, then the final ones from the version so made: the events, and
    how many facts each version had in its index. Broken facts are left out before."""
    store = K.FactStore(spark, new_path(spark, "facts"))
    embedder, out = HashEmbedder(16), []
    for column in ("prior_snapshot", "gold_final_snapshot"):
        s = data.snapshot(spark, d, column)
        facts = keep(s.select(F.md5(F.to_json(F.struct("case_id", *K.TRIPLE))).alias("memory_id"), *K.TRIPLE), "facts")
        had = store.facts().select("memory_id")
        fresh = facts.where(~F.col("main_class").isin(*K.CORE)).join(had, "memory_id", "left_anti")
        version = store.commit(facts, store.version(), embed(fresh, "memory_id", "text", embedder, key_type="string"), column)
        out.append((version, store.vectors().count()))
    indexed = spark.createDataFrame(out, "version bigint, indexed bigint")
    return store.events().join(indexed, "version").select("version", "added", "removed", "indexed")
