"""Text expressions shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def fold(text: Column) -> Column:
    """Without regard to case: lower case, with sharp s as its pair and final sigma as sigma, as case folding has it."""
    return F.replace(F.translate(F.lower(text), "ς", "σ"), F.lit("ß"), F.lit("ss"))


def words(text: Column) -> Column:
    """The longest runs of letters or digits of any script, folded, in order."""
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))


def blank(text: Column) -> Column:
    """Null, empty or nothing but white space."""
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def site(url: Column) -> Column:
    """The host of an address in lower case, without user, port or a leading ``www.``; empty where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def lines(text: Column) -> Column:
    """Lines end at LF; a CR before it belongs to the line end."""
    return F.split(text, "\r?\n")


def plain_line(line: Column) -> Column:
    """A line without regard to case and to the kind and length of white space."""
    return F.trim(F.regexp_replace(fold(line), r"(?U)[\s\x{1c}-\x{1f}]+", " "))
