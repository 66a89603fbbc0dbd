"""Lines repeated across the documents of one source.

Lines are parsed into templates by token trees of fixed depth: the path of a line is its number of tokens and its first
``DEPTH`` tokens, with tokens that hold digits as wildcards. Each task counts the nodes of its own trees (map-side
combining) and the shuffle merges the trees, so no task ever holds the lines of a source. Below a leaf that covers
enough documents, the slots of a template keep the tokens that cover enough documents there and are wildcards otherwise.
A source has few leaves that cover a given share of its documents, so everything after the first merge is small.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.text import site
from larkspur.session import keep

DEPTH = 3
LINES = "site string, page_id long, line_no int, leaf long, line string"


def plain(line: str) -> str | None:
    """A line without regard to case and to the kind and length of white space; None with fewer than three letters."""
    x = " ".join(line.split()).casefold()
    return x if sum(map(str.isalpha, x)) >= 3 else None


def leaf(line: str) -> int:
    """The node of fixed depth that a line comes to."""
    import xxhash

    tokens = line.split(" ")
    path = ["<*>" if any(map(str.isnumeric, t)) else t for t in tokens[:DEPTH]]
    return xxhash.xxh3_64_intdigest(f"{len(tokens)} {' '.join(path)}") - 2**63


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[int, str] | None] = {}
    for batch in batches:
        sites, pages, numbers, leaves, out = [], [], [], [], []
        for host, page, text in zip(*(batch.column(c).to_pylist() for c in ("site", "page_id", "raw_text")), strict=True):
            if len(known) > 200_000:  # repeated lines are parsed once; the cache is filled anew
                known.clear()
            for n, raw in enumerate(text.split("\n"), 1):
                if raw in known:
                    parsed = known[raw]
                else:
                    x = plain(raw)
                    parsed = known[raw] = None if x is None else (leaf(x), x)
                if parsed:
                    sites.append(host)
                    pages.append(page)
                    numbers.append(n)
                    leaves.append(parsed[0])
                    out.append(parsed[1])
        yield pa.RecordBatch.from_arrays([pa.array(sites, pa.string()), pa.array(pages, pa.int64()), pa.array(numbers, pa.int32()), pa.array(leaves, pa.int64()), pa.array(out, pa.string())], ["site", "page_id", "line_no", "leaf", "line"])


def line_rows(pages: DataFrame) -> DataFrame:
    """(site, page_id, line_no, leaf, line) of every line with at least three letters. Pages without id, host or text have
    none. One Python pass over Arrow batches costs a third of the regular expressions that the JVM would need."""
    rows = pages.where("page_id is not null and raw_text <> ''").select(site(F.col("final_url")).alias("site"), "page_id", "raw_text").where("site <> ''")
    return rows.mapInArrow(_parse, LINES)


def needed_pages(pages: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """(site, need): on how many pages of its site a line must stand."""
    rows = pages.where("page_id is not null and raw_text <> ''").select(site(F.col("final_url")).alias("site"), "page_id").where("site <> ''")
    return rows.distinct().groupBy("site").agg(F.greatest(F.lit(min_pages), F.ceil(F.count("*") * F.lit(min_share))).cast("long").alias("need"))


def line_templates(pages: DataFrame, min_pages: int = 6, min_share: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(lines under the leaves that cover enough pages, templates that cover enough pages with the lines they cover)."""
    rows = keep(line_rows(pages), "p2-parsed")
    need = needed_pages(pages, min_pages, min_share)
    covered = rows.select("site", "leaf", "page_id").distinct().groupBy("site", "leaf").agg(F.count("*").alias("pages"))
    leaves = keep(covered.join(need, "site").where("pages >= need").select("site", "leaf", "need"), "p2-leaves")
    under = keep(rows.join(leaves, ["site", "leaf"]), "p2-lines")
    counted = under.select("site", "leaf", "need", "line", "page_id").distinct().groupBy("site", "leaf", "need", "line").agg(F.count("*").alias("pages"))
    counted = keep(counted, "p2-counted")
    slots = counted.select("site", "leaf", "need", "pages", F.posexplode(F.split("line", " ")).alias("at", "token")).groupBy("site", "leaf", "need", "at", "token").agg(F.sum("pages").alias("n"))
    # at most 1/min_share times the leaf's lines a page survive at each place, so the list of a leaf is bounded
    fixed = slots.where("n >= need").groupBy("site", "leaf").agg(F.collect_list(F.struct("at", "token")).alias("fixed"))
    with_slots = counted.join(fixed, ["site", "leaf"], "left")
    template = F.array_join(F.transform(F.split("line", " "), lambda t, i: F.when(F.array_contains("fixed", F.struct(i.alias("at"), t.alias("token"))), t).otherwise(F.lit("<*>"))), " ")
    lined = with_slots.select("site", "leaf", "need", "line", "pages", F.coalesce(template, F.lit("<*>")).alias("template"))
    cover = lined.groupBy("site", "leaf", "template").agg(F.sum("pages").alias("cover"), F.count("*").alias("n_lines"))
    return under, lined.join(cover, ["site", "leaf", "template"]).where("cover >= need")


def repeated_lines(pages: DataFrame, min_pages: int = 6, min_share: float = 0.25) -> DataFrame:
    """(page_id, line_no, line) of the lines that stand, as they are, on at least ``min_pages`` pages and ``min_share``
    of the pages of their site. Candidates are the lines of templates that cover as many; an exact count follows.
    Repeated rows of a page count once. Lines of blank or null texts, or without three letters, are never removed."""
    under, templates = line_templates(pages, min_pages, min_share)
    hits = templates.where("pages >= need").select("site", "leaf", "line")
    return under.join(hits, ["site", "leaf", "line"], "left_semi").select("page_id", F.col("line_no").cast("int").alias("line_no"), "line").distinct()


def without_lines(pages: DataFrame, removed: DataFrame) -> DataFrame:
    """(page_id, kept_text): each page's text without its removed lines; texts without any stay as they are. Removed
    line numbers are one short list a page, so texts move once, on page_id."""
    numbers = removed.groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))
    rows = pages.where("page_id is not null").select("page_id", "raw_text").join(numbers, "page_id", "left")
    kept = F.array_join(F.filter(F.split("raw_text", "\n"), lambda x, i: ~F.array_contains("gone", (i + 1).cast("int"))), "\n")
    return rows.select("page_id", F.when(F.col("gone").isNull(), F.col("raw_text")).otherwise(kept).alias("kept_text")).distinct()
