"""Cutting oversized texts by content-defined chunking.

The place of a cut is a landmark: the least value of a rolling hash within the window that the size limits allow. It
snaps to the nearest natural boundary of the best kind in the window (paragraph, line, sentence, word); where there is
none, the landmark itself is the cut. Landmarks depend on the text around them only, so an edit moves the cuts near it
and later cuts fall into place again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 32
_KINDS = (re.compile(r"\n[^\S\n]*\n\s*"), re.compile(r"\n\s*"), re.compile(r"[.!?。！？…][\"'”’»)\]]*\s+|[。！？]"), re.compile(r"\s+"))


def rolling_hash(text: str) -> np.ndarray:
    """h[i]: a hash of the SPAN characters before place i, for i from SPAN to the text's length."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes) + 1, np.uint64)
        base, power = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
        for k in range(min(SPAN, len(codes))):
            h[SPAN:] += codes[SPAN - 1 - k : len(codes) - k] * power
            power *= base
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def cut_places(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """[(start, end)] of the pieces of a text, in order. No piece is longer than ``limit``; each but the first begins
    with up to ``overlap`` characters of the one before, from a natural boundary where there is one. A text within the
    limit is one piece; an empty text has none."""
    n = len(text)
    if n == 0:
        return []
    if n <= limit:
        return [(0, n)]
    overlap = max(0, min(overlap, limit // 2 - 1))
    most = max(1, limit - overlap)
    least = max(1, most // 2)
    h = rolling_hash(text)
    bounds = [np.fromiter((m.end() for m in kind.finditer(text)), np.int64) for kind in _KINDS]
    cuts, at = [], 0
    while n - at > most:
        low, high = at + least, at + most
        mark = low + int(np.argmin(h[low : high + 1]))
        cut = mark
        for b in bounds:
            i, j = np.searchsorted(b, (low, high + 1))
            if i < j:
                near = b[i:j]
                cut = int(near[np.argmin(np.abs(near - mark))])
                break
        cuts.append(cut)
        at = cut
    pieces, begin = [], 0
    for cut in [*cuts, n]:
        pieces.append((begin, cut))
        begin = max(cut - overlap, 0)
        for b in bounds[1:]:
            i, j = np.searchsorted(b, (begin, cut))
            if i < j:
                begin = int(b[i])
                break
    return pieces


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = batch.to_pydict()
        out: list[tuple] = []
        for origin, item, text, limit, overlap in zip(d["origin"], d["item_id"], d["text"], d["limit"], d["overlap"], strict=True):
            for k, (s, e) in enumerate(cut_places(text, limit, overlap)):
                out.append((origin, item, k, s, e, text[s:e]))
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["origin", "item_id", "piece_no", "start", "end", "piece"])


def split_oversized(tables: list[tuple[str, DataFrame, str, str, int, int]]) -> DataFrame:
    """(origin, item_id, piece_no, start, end, piece) of the items longer than their limit; tables are (origin, rows, id
    column, text column, limit, overlap). Only texts over the limit leave the JVM. Null ids and texts have no pieces;
    repeated rows give repeated pieces once."""
    out = None
    for origin, df, key, text, limit, overlap in tables:
        d = df.where(F.col(key).isNotNull() & (F.length(text) > limit)).select(F.lit(origin).alias("origin"), F.col(key).cast("long").alias("item_id"), F.col(text).alias("text"), F.lit(limit).alias("limit"), F.lit(overlap).alias("overlap"))
        out = d if out is None else out.unionByName(d)
    return out.mapInArrow(_cutter, "origin string, item_id long, piece_no int, start int, end int, piece string").distinct()
