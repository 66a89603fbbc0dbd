"""The queries over the texts, by problem. Every query runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm import body, copies, lines, mix, neardup, pack, pii, spans, split, tokens
from larkspur.session import keep, read_table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(read_table(spark, sf_dir, "web_pages")).select("page_id", "line_no")


def p2_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "web_pages")
    return lines.without_lines(pages, lines.repeated_lines(pages))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.redundant_records(read_table(spark, sf_dir, "canonical_memories"))


def p3_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.collapsed_records(read_table(spark, sf_dir, "canonical_memories"))


def _private(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [read_table(spark, sf_dir, t) for t in ("canonical_memories", "cases", "name_parts")]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_items(*_private(spark, sf_dir)).select("origin", "row_key", "turn_no", "kind", "found_text").distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted_texts(*_private(spark, sf_dir))


def _near_tables(spark: SparkSession, sf_dir: str) -> list:
    return [("web_pages", read_table(spark, sf_dir, "web_pages"), "page_id", "raw_text"), ("page_parents", read_table(spark, sf_dir, "page_parents"), "parent_id", "text")]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_rows(_near_tables(spark, sf_dir)).select("origin", "id_a", "id_b")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, id, group_id, copies, links) of every row that has a copy or a near duplicate."""
    return neardup.similar_groups(_near_tables(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body.main_body(read_table(spark, sf_dir, "web_pages"))


def p6_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, body): the main body of each page as text."""
    pages = read_table(spark, sf_dir, "web_pages")
    kept = body.main_body(pages).groupBy("page_id").agg(F.array_sort(F.collect_set("line_no")).alias("nos"))
    rows = pages.where("page_id is not null").select("page_id", F.split("raw_text", "\r?\n").alias("lines")).join(kept, "page_id")
    return rows.select("page_id", F.array_join(F.transform("nos", lambda k: F.element_at("lines", k)), "\n").alias("body")).distinct()


def _limits(spark: SparkSession, sf_dir: str) -> list:
    return [
        ("web_pages", read_table(spark, sf_dir, "web_pages"), "page_id", "raw_text", 6400, 300),
        ("page_parents", read_table(spark, sf_dir, "page_parents"), "parent_id", "text", 3200, 300),
        ("parent_children", read_table(spark, sf_dir, "parent_children"), "child_id", "text", 800, 150),
    ]


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_oversized(_limits(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that the splitter cut in two or more."""
    return p7_pieces(spark, sf_dir).where("piece_no = 1").select("origin", "item_id").distinct()


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, item_id, within, covered, overlapping): whether an item's pieces keep the limit, cover its text in order and
    overlap by no more than they may."""
    tables = _limits(spark, sf_dir)
    most = F.create_map(*(F.lit(x) for origin, *_, limit, overlap in tables for x in (origin, limit))), F.create_map(*(F.lit(x) for origin, *_, limit, overlap in tables for x in (origin, overlap)))
    lengths = None
    for origin, df, key, text, _, _ in tables:
        d = df.where(F.col(key).isNotNull()).select(F.lit(origin).alias("origin"), F.col(key).cast("long").alias("item_id"), F.length(text).alias("n")).groupBy("origin", "item_id").agg(F.max("n").alias("n"))
        lengths = d if lengths is None else lengths.unionByName(d)
    w = Window.partitionBy("origin", "item_id").orderBy("piece_no")
    p = p7_pieces(spark, sf_dir).withColumns({"last": F.lag("end").over(w), "limit": most[0][F.col("origin")], "overlap": most[1][F.col("origin")]})
    ok = F.coalesce((F.col("start") <= F.col("last")) & (F.col("end") > F.col("last")) & (F.col("start") >= F.col("last") - F.col("overlap")), F.col("start") == 0)
    told = p.groupBy("origin", "item_id").agg(F.min((F.length("piece") <= F.col("limit")) & (F.length("piece") == F.col("end") - F.col("start"))).alias("within"), F.min(ok).alias("overlapping"), F.max("end").alias("till"))
    return told.join(lengths, ["origin", "item_id"]).select("origin", "item_id", "within", (F.col("overlapping") & (F.col("till") == F.col("n"))).alias("covered"), "overlapping")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack_documents(tokens.token_counts(read_table(spark, sf_dir, "documents")), 2048)


def p8_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the documents packed, and whether each of their tokens is in a container once, no container holds more than
    2,048, and only documents that exceed it are split."""
    counts = keep(tokens.token_counts(read_table(spark, sf_dir, "documents")), "p8-counts")
    packed = keep(pack.pack_documents(counts, 2048), "p8-packed")
    w = Window.partitionBy("doc_id").orderBy("first_token")
    joined = packed.withColumn("from", F.coalesce(F.lag(F.col("first_token") + F.col("n_tokens")).over(w), F.lit(0)) == F.col("first_token"))
    docs = joined.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("pieces"), F.min("from").alias("in_order")).join(counts, "doc_id", "full")
    full = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items"), F.max("place").alias("last"), F.count_distinct("place").alias("places"))
    whole = F.min(F.coalesce((F.col("placed") == F.col("n_tokens")) & F.col("in_order"), F.lit(False)))
    fits = full.agg(F.coalesce(F.min((F.col("n") <= 2048) & (F.col("items") == F.col("places"))), F.lit(True)))
    return docs.agg(F.count("*").alias("docs"), F.coalesce(whole, F.lit(True)).alias("whole"), F.coalesce(F.min((F.col("pieces") == 1) | (F.col("n_tokens") > 2048)), F.lit(True)).alias("unsplit")).select("docs", "whole", fits.scalar().alias("within"), "unsplit")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix.mix_sources(tokens.token_counts(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "source_targets"))


def p9_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uses of each document with the target and the reached share of its source."""
    uses, shares = _mixed(spark, sf_dir)
    return uses.join(F.broadcast(shares.select("source", "target_share", "reached_share")), "source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p9_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target_share, reached, within): whether each source came within half a percentage point of its target and no
    document was used more than it may."""
    most = read_table(spark, sf_dir, "source_targets").select("source", "max_repeats")
    r = _mixed(spark, sf_dir)[1].join(F.broadcast(most), "source")  # one row a source
    return r.select("source", "target_share", (F.abs(F.col("reached_share") - F.col("target_share")) <= 0.005).alias("reached"), (F.col("most_uses") <= F.col("max_repeats")).alias("within"))


def p9_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, natural_share, weight, exponent): the exponent at which the entropy of the sources' weights is halfway
    between that of their natural shares and that of equal shares."""
    counts = tokens.token_counts(read_table(spark, sf_dir, "documents")).where("source is not null")
    have = {r[0]: float(r[1]) for r in counts.groupBy("source").agg(F.sum("n_tokens")).collect()}  # one row a source
    goal = (mix.entropy(mix.temperature_weights(have, 1.0)) + mix.entropy(mix.temperature_weights(have, 0.0))) / 2
    x = mix.bisect_exponent(have, target_entropy=goal)
    w, natural = mix.temperature_weights(have, x), mix.temperature_weights(have, 1.0)
    return spark.createDataFrame([(k, natural[k], w[k], x) for k in sorted(have)], "source string, natural_share double, weight double, exponent double")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.sharing_pairs(read_table(spark, sf_dir, "documents"))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_shares(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("p") and "_" in k and k[1].isdigit() and callable(f)}
