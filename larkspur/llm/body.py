"""The main body of web pages: long substrings repeated across the pages of a host are boilerplate.

Of the suffix array of all pages of a host only the suffixes that begin at a line are needed, and of each what it has in
common with its neighbours up to the end of the line, since boilerplate is repeated by whole lines. The suffixes of all
hosts are sorted at once, by host, line and page, in ranges whose bounds Spark samples; neighbours that share their line
are a run, and the pages of a run are counted as it streams by. A range may cut a run, never the suffixes of one page in
it, so the counts of its parts add up and a host, or a line on a third of all pages, is never gathered. Digits count as
equal. A run that has many pages of its host is boilerplate there, a long line only with more of them. Small hosts learn
from the others: a template (the line without digits, proper names and the name of the site) is boilerplate if, on hosts
large enough to tell, most of its lines were repeated. That keeps headings and list items, which are alike but not
repeated, in the body.

Repetition alone misses what differs from page to page, so the layout of a page decides the rest: what stands above
the title line isn't body; links to other articles are lines made like the titles of pages, under a repeated line;
what comes after the last line of the body isn't body.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.text import site
from larkspur.session import keep

LONG = 200  # a longer line may be a passage of a copied article: it must stand on more pages to be boilerplate
BIG_SITE = 10
_MARK = re.compile(r"^\s*(?:[#>*+\-•·–]+\s+|#+\s*)+")
_SPLIT = re.compile(r"\r?\n")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}")
LINES = "site string, page_id long, line_no int, title boolean, prefix long, template long, like1 long, like2 long, long boolean"


def _h(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - 2**63


def _letters(line: str) -> bool:
    n = 0
    for c in line:
        n += c.isalpha()
        if n == 3:
            return True
    return False


def _masks(words: list[str], names: list[str]) -> tuple[str, str]:
    """The words without digits, site name and names within; then also without their first word, if it is capitalised."""
    upper = sum(w[:1].isupper() for w in words)
    shouting = upper == len(words) and len(words) > 1
    out = [w if k == 0 or shouting or not w[:1].isupper() else "<n>" + w[len(w.rstrip(".,;:!?)")) :] for k, w in enumerate(words)]
    text = re.sub(r"\d+", "0", " ".join(out).casefold())
    rest = re.sub(r"\d+", "0", " ".join(["<n>" + words[0][len(words[0].rstrip(".,;:!?)")) :], *out[1:]]).casefold()) if words[0][:1].isupper() else text
    return text, rest


def site_names(host: str) -> list[str]:
    labels = host.split(".")
    name = (labels[-2] if len(labels) > 1 else labels[0]).replace("-", " ")
    return [name, name.removeprefix("the ")] if name.startswith("the ") else [name]


def _line_features(host: str, line: str) -> tuple[int, int, int, int]:
    words = _MARK.sub("", line).split()
    plain = re.sub(r"\d+", "0", " ".join(words).casefold())
    names = site_names(host)
    own = " ".join(words)
    for n in names:
        own = re.sub(re.escape(n), "<site>", own, flags=re.I)
    template, _ = _masks(own.split() or words, names)
    like1, like2 = _masks(words, names)
    return _h(plain), _h(template), _h(like1), _h(like2)


def _candidates(text: str) -> Iterator[tuple[int, str]]:
    """(line number, line) of the lines that may be boilerplate: with letters, outside code and tables."""
    fenced = False
    for k, line in enumerate(_SPLIT.split(text), 1):
        s = line.strip()
        if s.startswith("```"):
            fenced = not fenced
        elif not fenced and s and s[0] != "|" and _letters(s):
            yield k, s


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    names = [c.split()[0] for c in LINES.split(", ")]
    cache: dict[tuple[str, str], tuple] = {}
    for batch in batches:
        d = batch.to_pydict()
        rows: list[tuple] = []
        for host, page, title, text in zip(d["site"], d["page_id"], d["title"], d["raw_text"], strict=True):
            if title and title.strip():
                rows.append((host, page, 0, True, *_line_features(host, title), False))
            if len(cache) > 200_000:  # repeated lines are what costs; the cache is filled anew
                cache.clear()
            for k, line in _candidates(text):
                if len(line) > LONG:  # mostly met once, and never a link: only its own repetition tells
                    h = _h(re.sub(r"\d+", "0", " ".join(_MARK.sub("", line).split()).casefold()))
                    rows.append((host, page, k, False, h, 0, 0, 0, True))
                    continue
                f = cache.get((host, line))
                if f is None:
                    f = cache[host, line] = _line_features(host, line)
                rows.append((host, page, k, False, *f, False))
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


RUN = ["site", "prefix", "template", "long"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, pages) of sorted suffixes, a row for each run or part of one that lies in a batch."""
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        opens = np.zeros(n, bool)
        opens[0] = True
        for c in RUN:
            opens[1:] |= pc.not_equal(batch.column(c).slice(1), batch.column(c).slice(0, n - 1)).to_numpy(zero_copy_only=False)
        page = batch.column("page_id").to_numpy()
        fresh = opens.copy()
        fresh[1:] |= page[1:] != page[:-1]
        ends = [tuple(batch.column(c)[k].as_py() for c in (*RUN, "page_id")) for k in (0, n - 1)]
        if ends[0] == last:  # the page was counted in the batch before
            fresh[0] = False
        last = ends[1]
        first = np.flatnonzero(opens)
        runs = batch.select(RUN).take(pa.array(first))
        yield pa.RecordBatch.from_arrays([*runs.columns, pa.array(np.add.reduceat(fresh.astype(np.int64), first))], [*RUN, "pages"])


def repeated_runs(lines: DataFrame) -> DataFrame:
    """(site, prefix, template, long, pages): the runs of the suffix array with the number of their pages."""
    order = [*RUN, "page_id"]
    sorted_ = lines.where("not title").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = sorted_.mapInArrow(_runs, "site string, prefix long, template long, long boolean, pages long")
    return parts.groupBy(*RUN).agg(F.sum("pages").alias("pages"))


def _same(line: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", line.casefold()))


def _byline(lines: list[str], k: int) -> bool:
    """A short line under the title that is no sentence, heading, list or table, with nothing of the kind below it."""
    x = lines[k]
    if len(x) >= 60 or _MARK.match(x) or re.match(r"\d+[.)] |[QAFR]\s?:|\||```", x):
        return False
    below = lines[k + 1] if k + 1 < len(lines) else ""
    return bool(_DATE.search(x)) or x[-1] not in ".:?!;," and (not below or len(below) < 60 and _DATE.search(below) is not None)


def body_lines(text: str, title: str | None, url: str, repeated: set[int], linklike: set[int]) -> list[int]:
    """Numbers of the non-blank lines of the main body of one page."""
    lines = [x.strip() for x in _SPLIT.split(text)]
    n = len(lines)
    role = ["body" if x else "blank" for x in lines]
    # the title line: like the title, else like the address, else the first heading of first order
    goals = [g for g in (_same(title or ""), re.sub(r" [0-9a-f]{1,4}$", "", _same(url.rstrip("/").rpartition("/")[2]))) if g]
    at = next((k for g in goals for k, x in enumerate(lines) if x and _same(x) == g), None)
    if at is None:
        at = next((k for k, x in enumerate(lines) if re.match(r"# \S", x)), None)
    if at is None:  # no title line: the body begins with the first line that isn't repeated
        at = next((k for k, x in enumerate(lines) if x and k + 1 not in repeated and len(x) > 60), 0)
    for k in range(at):
        role[k] = "out" if lines[k] else "blank"
    fenced = False
    k = at + 1
    while k < n:
        x = lines[k]
        if x.startswith("```"):
            fenced = not fenced
        elif not fenced and x:
            if k + 1 in repeated:
                heading = bool(re.match(r"#{1,6} ", x))  # a section may have the same heading on every page
                role[k] = "body" if heading else "out"
                # links to other articles under a repeated line, with their teasers, up to a blank line
                j = k + 1
                while j < n and lines[j]:
                    j += 1
                links = sum(i + 1 in linklike for i in range(k + 1, j))
                if links and (k + 2 in linklike or links >= 2):
                    for i in range(k, j):
                        role[i] = "out"
                    k = j
                    continue
            elif role[k - 1] != "blank" and k > at and all(r == "out" for r in role[at + 1 : k]) and _byline(lines, k):
                role[k] = "out"
        k += 1
    # after the body: what is left below its last real line
    end = n - 1
    while end > at and (role[end] != "body" or end + 1 in linklike or not _letters(lines[end]) and not re.match(r"```|\|", lines[end])):
        if role[end] == "body":
            role[end] = "out"
        end -= 1
    return [k + 1 for k in range(n) if role[k] == "body"]


def _layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = batch.to_pydict()
        pages, numbers = [], []
        for page, title, url, text, repeated, linklike in zip(d["page_id"], d["title"], d["final_url"], d["raw_text"], d["repeated"], d["linklike"], strict=True):
            kept = body_lines(text, title, url or "", set(repeated or ()), set(linklike or ()))
            pages += [page] * len(kept)
            numbers += kept
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(numbers, pa.int32())], ["page_id", "line_no"])


def main_body(pages: DataFrame, min_share: float = 0.08, trust: float = 0.5) -> DataFrame:
    """(page_id, line_no) of every non-blank line of each page's main body.

    Pages with a null id or a null or empty text have none; a null title or address is done without; repeated rows of a
    page give its lines once. A page without any repeated line keeps everything from its title line on.
    """
    rows = pages.where("page_id is not null and raw_text <> ''").select(F.coalesce(site(F.col("final_url")), F.lit("")).alias("site"), "page_id", "title", "final_url", "raw_text")
    lines = keep(rows.select("site", "page_id", "title", "raw_text").mapInArrow(_features, LINES), "p6-lines")
    sizes = lines.select("site", "page_id").distinct().groupBy("site").agg(F.count("*").alias("site_pages"))
    prefixes = repeated_runs(lines).join(sizes, "site")
    # a long line is told by a quarter of the pages and at least six
    least = F.when(F.col("long"), F.greatest(F.lit(6), F.col("site_pages") * F.lit(0.25))).otherwise(F.greatest(F.lit(3), F.col("site_pages") * F.lit(min_share)))
    prefixes = prefixes.withColumn("often", (F.col("pages") >= least).cast("int"))
    prefixes = keep(prefixes, "p6-prefixes")
    big = prefixes.where((F.col("site_pages") >= BIG_SITE) & ~F.col("long"))
    templates = big.groupBy("template").agg(F.sum("pages").alias("seen"), F.sum(F.col("pages") * F.col("often")).alias("repeated")).where("seen >= 3")
    told = prefixes.join(templates, "template", "left")
    bad = F.when(F.col("seen") >= 20, F.col("repeated") >= F.col("seen") * F.lit(trust)).otherwise((F.col("often") == 1) & (F.col("pages") >= F.col("site_pages") * F.lit(2 * min_share)))
    bad = F.when(F.col("long"), F.col("often") == 1).otherwise(bad)
    repeated = told.where(bad).select("site", "prefix", F.lit(1).alias("bad")).distinct()
    titles = lines.where("title").groupBy(F.col("like2").alias("like")).agg(F.count("*").alias("n")).where("n >= 3").select("like")
    liked = lines.where("not title and not long").select("page_id", "line_no", F.explode(F.array_distinct(F.array("like1", "like2"))).alias("like")).join(titles, "like", "left_semi").select("page_id", "line_no", F.lit(False).alias("bad"))
    marks = lines.where("not title").join(repeated.select("site", "prefix"), ["site", "prefix"], "left_semi").select("page_id", "line_no", F.lit(True).alias("bad")).unionByName(liked)
    of_page = marks.groupBy("page_id").agg(F.collect_set(F.when(F.col("bad"), F.col("line_no"))).alias("repeated"), F.collect_set(F.when(~F.col("bad"), F.col("line_no"))).alias("linklike"))
    done = rows.select("page_id", "title", "final_url", "raw_text").join(of_page, "page_id", "left")
    return done.mapInArrow(_layout, "page_id long, line_no int").distinct()
