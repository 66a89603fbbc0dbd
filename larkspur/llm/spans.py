"""Long spans that stand word for word in more than one document.

The "paragraph" is every window of ``span`` consecutive characters, and its MinHash is the least hash of the character
runs of length ``GRAM`` within it. Equal windows have equal MinHashes, so one band of one row has a recall of 1 for what
is asked, identical spans of at least ``span`` characters wherever they begin; neighbouring windows mostly share their
minimum, so a text has about 2 / (span - GRAM) of them a character. Real paragraphs would miss spans that begin or end
within one, and more rows a band would lose recall. Colliding windows are joined and the texts around them compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.components import connected_components
from larkspur.session import keep

GRAM = 150
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64))))[:n]


class WindowHasher:
    """Places and hashes of the runs of ``gram`` characters that are the least of some window of ``span`` characters."""

    def __init__(self, span: int, gram: int):
        self.span, self.gram = span, gram
        self.up, self.down = _powers(_BASE, 1), _powers(_INVERSE, 1)

    def gram_hashes(self, codes: np.ndarray) -> np.ndarray:
        n, q = len(codes), self.gram
        if len(self.up) < n + 1:
            self.up, self.down = _powers(_BASE, 2 * n + 1), _powers(_INVERSE, 2 * n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((codes + np.uint64(1)) * self.up[:n], out=sums[1:])
            h = (sums[q:] - sums[:-q]) * self.down[: n - q + 1]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        return h

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if len(text) < self.span:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h = self.gram_hashes(codes)
        w = self.span - self.gram + 1
        least = _sliding(h, w, np.minimum, np.uint64(2**64 - 1))
        # a place counts if it holds the minimum of any window over it
        most = _sliding(np.concatenate((np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64))), w, np.maximum, np.uint64(0))
        at = np.flatnonzero(h == most)
        return at.astype(np.int32), h[at].view(np.int64)


def _sliding(x: np.ndarray, w: int, best, fill: np.uint64) -> np.ndarray:
    """best of each window of w values, by running bests from both ends of blocks of w."""
    n = len(x)
    pad = -n % w
    blocks = np.concatenate((x, np.full(pad, fill, np.uint64))).reshape(-1, w)
    left = best.accumulate(blocks, axis=1).ravel()
    right = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(right[: n - w + 1], left[w - 1 : n])


def _prints(span: int, gram: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WindowHasher(span, gram), set()
        for batch in batches:
            fps, places, hashes = [], [], []
            for fp, text in zip(batch.column("fp").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if fp in seen:  # copies within a task are sent once
                    continue
                if len(seen) < 2_000_000:
                    seen.add(fp)
                at, h = hasher(text)
                fps.append(np.full(len(at), fp, np.int64))
                places.append(at)
                hashes.append(h)
            whole = [np.concatenate(x) if x else np.empty(0, t) for x, t in ((fps, np.int64), (places, np.int32), (hashes, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in whole], ["fp", "at", "hash"])

    return of


def _snippets(span: int, gram: int):
    """Each met run with the text on both sides of it, as far as a span of ``span`` characters over it can reach."""
    side = span - gram

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            out = [(fp, at, h, text[max(0, at - side) : at][::-1], text[at : at + gram + side]) for fp, text, met in zip(d["fp"], d["text"], d["met"], strict=True) for at, h in ((m["at"], m["hash"]) for m in met)]
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True)], ["fp", "at", "hash", "back", "on"])

    return of


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # the first low characters agree, the first high don't
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def _compare(span: int, gram: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in ("fp_a", "at_a", "back_a", "on_a", "fp_b", "at_b", "back_b", "on_b")]
            out = []
            for fa, pa_, ba, oa, fb, pb, bb, ob in zip(*cols, strict=True):
                on = _common(oa, ob)
                if on < gram:
                    continue
                back = _common(ba, bb)
                if back + on >= span:
                    out.append((fa, fb, pa_ - back, pb - back, back + on))
            res = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(res, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["fp_a", "fp_b", "start_a", "start_b", "length"])

    return of


def texts_of(docs: DataFrame, span: int) -> DataFrame:
    """(doc_id, fp, text) of texts long enough to hold a span; fp stands for the exact text."""
    return docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= span)).select("doc_id", F.xxhash64("text").alias("fp"), "text")


def shared_spans(docs: DataFrame, span: int = 250, gram: int = GRAM) -> DataFrame:
    """(fp_a, fp_b, start_a, start_b, length) of stretches of at least ``span`` characters that two different texts have
    in common, fp_a < fp_b. The stretches around the common runs cover every common span; one long common span comes as
    several overlapping stretches."""
    texts = texts_of(docs, span).select("fp", "text")
    prints = texts.mapInArrow(_prints(span, gram), "fp long, at int, hash long")
    prints = keep(prints, "p10-prints")
    # a run met in one text only ends here; hashes are counted with map-side combining
    shared = prints.groupBy("hash").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most").select("hash")
    met = prints.join(shared, "hash", "left_semi").groupBy("fp").agg(F.collect_set(F.struct("at", "hash")).alias("met"))  # bounded by one text
    found = texts.join(met, "fp").dropDuplicates(["fp"])
    around = keep(found.mapInArrow(_snippets(span, gram), "fp long, at int, hash long, back string, on string"), "p10-around")
    a = around.select("hash", *(F.col(c).alias(f"{c}_a") for c in ("fp", "at", "back", "on")))
    b = around.select("hash", *(F.col(c).alias(f"{c}_b") for c in ("fp", "at", "back", "on")))
    return a.join(b, "hash").where("fp_a < fp_b").drop("hash").mapInArrow(_compare(span, gram), "fp_a long, fp_b long, start_a int, start_b int, length int")


def sharing_pairs(docs: DataFrame, span: int = 250, gram: int = GRAM) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b, of documents whose texts both hold one and the same span of ``span`` or more
    consecutive characters, exact copies included. Null ids and null or shorter texts are in no pair; repeated rows
    count once."""
    pairs = keep(shared_spans(docs, span, gram).select("fp_a", "fp_b").distinct(), "p10-pairs")
    ids = keep(texts_of(docs, span).select("doc_id", "fp").distinct(), "p10-ids")
    across = pairs.join(ids.select(F.col("doc_id").alias("x"), F.col("fp").alias("fp_a")), "fp_a").join(ids.select(F.col("doc_id").alias("y"), F.col("fp").alias("fp_b")), "fp_b").select("x", "y")
    copies = ids.join(ids.groupBy("fp").count().where("count > 1").select("fp"), "fp", "left_semi")
    same = copies.select("fp", F.col("doc_id").alias("x")).join(copies.select("fp", F.col("doc_id").alias("y")), "fp").where("x < y").select("x", "y")
    return across.unionByName(same).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).where("doc_a < doc_b").distinct()


def shared_shares(docs: DataFrame, span: int = 250, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share, cluster_id) of every document with a text: how many of its
    characters lie in spans of at least ``span`` that also stand in another document (a copy shares all of it), and the
    component of sharing documents that it belongs to, named by its least doc_id."""
    spans = keep(shared_spans(docs, span, gram), "p10-spans")
    ends = spans.select(F.col("fp_a").alias("fp"), F.col("start_a").alias("start"), (F.col("start_a") + F.col("length")).alias("end")).unionByName(spans.select(F.col("fp_b").alias("fp"), F.col("start_b").alias("start"), (F.col("start_b") + F.col("length")).alias("end"))).distinct()
    # stretches of one text, merged in order: bounded by the text's own prints after this distinct
    lists = ends.groupBy("fp").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    covered = lists.select("fp", F.aggregate("spans", F.struct(F.lit(0).alias("till"), F.lit(0).alias("sum")), lambda s, x: F.struct(F.greatest(s["till"], x["end"]).alias("till"), (s["sum"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["till"]))).alias("sum")), lambda s: s["sum"]).alias("covered"))
    ids = docs.where("doc_id is not null and text is not null").select("doc_id", F.length("text").alias("n"), F.xxhash64("text").alias("fp")).groupBy("doc_id").agg(F.max(F.struct("n", "fp")).alias("m")).select("doc_id", "m.n", "m.fp")
    ids = keep(ids, "p10-docs")
    copies = ids.where(F.col("n") >= span).groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("kept"))
    links = copies.select("fp", "kept").join(ids.select("fp", "doc_id"), "fp").select(F.col("kept").alias("src"), F.col("doc_id").alias("dst"))
    pairs = spans.select("fp_a", "fp_b").distinct().join(copies.select(F.col("fp").alias("fp_a"), F.col("kept").alias("src")), "fp_a").join(copies.select(F.col("fp").alias("fp_b"), F.col("kept").alias("dst")), "fp_b").select("src", "dst")
    parts = connected_components(links.unionByName(pairs)).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster_id"))
    out = ids.join(copies.select("fp", "copies"), "fp", "left").join(covered, "fp", "left").join(parts, "doc_id", "left")
    shared = F.when(F.col("copies") > 1, F.col("n")).otherwise(F.coalesce("covered", F.lit(0)))
    return out.select("doc_id", F.col("n").alias("n_chars"), shared.alias("shared_chars"), F.when(F.col("n") > 0, F.round(shared / F.col("n"), 6)).otherwise(F.lit(0.0)).alias("shared_share"), F.coalesce("cluster_id", "doc_id").alias("cluster_id"))
