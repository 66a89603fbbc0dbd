"""Duplicates hidden by formatting: canonical form, 128-bit hash, counts with map-side combining, collision check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.text import WORD, blank, fold
from larkspur.session import keep


def _plain(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), " ")


def canonical(main_class: Column, sub_class: Column, text: Column) -> Column:
    """One string for all ways to write a record: folded words only, the pieces between ``;`` and ``|`` in sorted order."""
    pieces = F.array_sort(F.filter(F.transform(F.split(fold(text), r"[;|]"), _plain), lambda p: p != ""))
    return F.concat_ws("\n", main_class, _plain(fold(F.coalesce(sub_class, F.lit("")))), F.array_join(pieces, ";"))


HOT = 1000  # a group of more than one in so many of all rows is hot; there are fewer than this many


def hashed(records: DataFrame) -> DataFrame:
    """(hash, check, record_id), distinct and kept: the canonical form of every record is made once, and from here on 128
    bits stand for it. check is a second, unlike hash of the form with its length. Records with a null id or class or a
    blank class or text are left out."""
    form = canonical(F.col("main_class"), F.col("sub_class"), F.col("text"))
    rows = records.where(F.col("record_id").isNotNull() & F.col("main_class").isNotNull() & ~blank(F.col("main_class")) & ~blank(F.col("text"))).select("record_id", form.alias("form"))
    return keep(rows.select(F.unhex(F.md5("form")).alias("hash"), F.xxhash64("form", F.length("form")).alias("check"), "record_id").distinct(), "p3-hashed")


def copy_groups(rows: DataFrame) -> DataFrame:
    """(hash, check, kept_id, copies) of ``hashed`` rows, counted with map-side combining, so that a group that holds a third
    of all rows reaches the shuffle as one row a task. Two canonical forms of one hash differ in their check, which
    parts them."""
    return rows.groupBy("hash", "check").agg(F.min("record_id").alias("kept_id"), F.count("*").alias("copies"))


def redundant_records(records: DataFrame) -> DataFrame:
    """(kept_id, record_id) of every record that repeats another one, kept_id being the least of its group. Hot groups,
    fewer than ``HOT``, are broadcast, so that their members stay where they are; the others are joined by hash."""
    rows = hashed(records)
    groups = keep(copy_groups(rows).where("copies > 1"), "p3-groups")
    hot = F.broadcast(groups.where(F.col("copies") > rows.count() / HOT))
    in_hot = rows.join(hot, ["hash", "check"])
    rest = rows.join(hot, ["hash", "check"], "left_anti").join(groups, ["hash", "check"])
    return in_hot.unionByName(rest).where("record_id <> kept_id").select("kept_id", "record_id").distinct()


def collapsed_records(records: DataFrame) -> DataFrame:
    """One row a fact: (kept_id, copies)."""
    return copy_groups(hashed(records)).select("kept_id", "copies")
