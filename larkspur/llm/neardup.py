"""Near-duplicate texts by a parity-sketch join.

A text is the set of the 64-bit hashes of its word runs. The hashes are dealt into the blocks of a sketch, and a block
holds the XOR (the parity, bit by bit) of its hashes: a rare run has a block of its own, common runs share a number of
blocks that is fixed for a size band, so that even texts of common runs have telling blocks. A text with J >= t to
another differs from it in a bounded number of runs, and a run alters at most one block; from the size and the number of
filled common blocks follows how many blocks of the text can be altered at most (``altered``). By the pigeonhole
principle a text with ``agree`` filled blocks more than that is met again, in so many untouched blocks, in the other
text: blocks are the keys of an equi-join. It is enough to send the first altered + agree blocks of an order that is the
same for all texts (most telling content first): of the blocks that two texts have in common, the first ones stand
behind no more than ``altered`` others in either. A text with too few filled blocks is sketched again with four times the
common blocks, and again, until it has enough; a pair meets at the first level at which one of the two is through.
Hence no pair is lost.

Pairs that met are held against a bound before their texts are fetched: the Hamming distance of two parity bit sketches
is never more than the runs they differ in. What is left is verified on the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.components import connected_components
from larkspur.session import keep

COUNTERS = 1 << 20  # counters of the frequent-items summary of a task, 16 MB
COMMON = 1 << 18  # runs that are told to be common, 4 MB
SHARE = 0.15  # common blocks of a band, as a share of the runs of its largest text
SIEVE = 1 << 18  # residues that tell most of the texts that aren't needed, 2 MB
GROUP = 64  # texts of one key that a task pairs itself; larger groups are left to a join
SLICE = 300_000  # characters that are hashed at a time
MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the runs of ``run`` consecutive folded words of texts, many texts at a time."""

    def __init__(self, run: int):
        self.run = run
        self.of_word = np.zeros(0x110000, bool)
        every = np.arange(0x110000, dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        for m in re.finditer(r"[^\W_]+", every):  # letters and digits lie in some hundred stretches
            self.of_word[m.start() : m.end()] = True
        self.up = self.down = np.ones(1, np.uint64)

    def _word_hashes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(codes)
        if len(self.up) <= n:
            self.up = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(2 * n, _BASE, np.uint64))))
            self.down = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(2 * n, pow(_BASE, -1, 2**64), np.uint64))))
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = self.of_word[codes]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(7)) * self.up[:n], out=sums[1:])
        return starts, mix64((sums[ends] - sums[starts]) * self.down[starts])

    def _slice(self, texts: list[str]) -> list[np.ndarray]:
        folded = [t.casefold() for t in texts]
        codes = np.frombuffer("\n".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.cumsum([len(t) + 1 for t in folded])
        with np.errstate(over="ignore"):
            starts, words = self._word_hashes(codes)
            n = max(len(words) - self.run + 1, 0)
            h = words[:n].copy()
            for k in range(1, self.run):
                h = mix64(h * MIX + words[k : n + k])
        owner = np.searchsorted(bounds, starts, side="right")
        whole = owner[:n] == owner[self.run - 1 : self.run - 1 + n]
        h, owner = h[whole], owner[:n][whole]
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            x = np.sort(h[a:b])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x)
        return out

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        part, size = [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size >= SLICE:
                yield from self._slice(part)
                part, size = [], 0
        if part:
            yield from self._slice(part)


class FrequentItems:
    """A mergeable summary of at most ``counters`` items (Misra and Gries): an item that occurs more than total / counters
    times is always in it, with a count that is never too great."""

    def __init__(self, counters: int):
        self.counters, self.items, self.counts = counters, np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, items: np.ndarray) -> None:
        self.waiting.append(items)
        self.size += len(items)
        if self.size > 1 << 20:
            self.fold()

    def fold(self) -> None:
        new, n = np.unique(np.concatenate([np.empty(0, np.uint64), *self.waiting]), return_counts=True)
        self.waiting, self.size = [], 0
        x, at = np.unique(np.concatenate((self.items, new)), return_inverse=True)
        c = np.bincount(at, np.concatenate((self.counts, n)), len(x)).astype(np.int64)
        if len(c) > self.counters:
            c -= np.partition(c, len(c) - self.counters - 1)[len(c) - self.counters - 1]
        self.items, self.counts = x[c > 0], c[c > 0]


def _first_pass(run: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, summary = Shingler(run), FrequentItems(COUNTERS)
        names = ["kind", "a", "b", "n", "sketch"]
        for batch in batches:
            sizes, bits, good = [], [], []
            for h in shingle(batch.column("text").to_pylist()):
                good.append(len(h) > 0)
                if len(h):
                    summary.add(h)
                    sizes.append(len(h))
                    with np.errstate(over="ignore"):
                        bits.append(bit_sketch(h))
            kept = batch.filter(pa.array(good, pa.bool_()))
            offsets = np.concatenate(([0], np.cumsum([len(b) for b in bits]))).astype(np.int32)
            sketches = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bits) if bits else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), np.int32)), kept.column("fp"), kept.column("check"), pa.array(sizes, pa.int64()), sketches], names)
        summary.fold()
        items, counts = summary.items, summary.counts
        most = np.argsort(-counts, kind="stable")[:COMMON]
        most = most[counts[most] > 2]
        n = len(most)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(items[most].view(np.int64)), pa.nulls(n, pa.int64()), pa.array(counts[most]), pa.nulls(n, pa.list_(pa.int64()))], names)

    return of


def first_pass(texts: DataFrame, run: int) -> tuple[DataFrame, Worth]:
    """((fp, check, size, sketch) of each text with a run, the worth of runs). Of at most ``COMMON`` runs that are frequent
    in all texts the counts are known: the tasks' summaries are added up. They decide how many texts meet, never whether
    a pair is found."""
    out = keep(texts.select("fp", "check", "text").mapInArrow(_first_pass(run), "kind int, a long, b long, n long, sketch array<long>"), "p5-first")
    found = out.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(COMMON).toArrow()
    h, n = found.column("a").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    sketches = out.where("kind = 0").select(F.col("a").alias("fp"), F.col("b").alias("check"), F.col("n").cast("int").alias("size"), "sketch")
    return sketches, Worth(h[order], n[order], out.where("kind = 0").count())


def band_of(size: int) -> int:
    """Bands are [4^i, 4^(i + 1))."""
    return (size.bit_length() - 1) // 2


def blocks_of(band: int, level: int) -> int:
    """Blocks of a band that common runs share."""
    return min(2**32, max(1, int(4 ** (band + 1) * SHARE)) * 4**level)


def agreeing(size: int) -> int:
    """Blocks in which a pair agrees at least, by the size of its smaller text."""
    return 1 if size < 16 else 3 if size < 64 else 6


def altered(size: int, shared: int, t: float, cap: int | None = None) -> int:
    """Blocks of a text of ``size`` runs and ``shared`` filled common blocks that differ at most from those of any text
    (of at most ``cap`` runs) with J >= t. With x runs of its own and y runs of the other one alone J is (size - x) /
    (size + y); each of the x alters one block, and the y can alter no more than the shared ones."""
    x = np.arange(int(size * (1 - t) + 1e-9) + 1)
    y = np.floor((size - x) / t - size + 1e-9)
    if cap is not None:
        y = np.minimum(y, cap - size + x)
    good = y >= 0
    return int((x + np.minimum(y, shared))[good].max()) if good.any() else -1


def roles(size: int, t: float) -> list[tuple[int, int | None]]:
    """[(band, cap)] of a text: its own band, and the next lower one if texts of it are large enough to match. A pair meets
    in the band of the smaller text."""
    own = band_of(size)
    below = 4**own - 1
    return [(own, None), (own - 1, below)] if own and below >= size * t - 1e-9 else [(own, None)]


def sketch_keys(h: np.ndarray, t: float, salt: int, worth: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """The keys of one text: ``h`` are its sorted run hashes, ``worth`` how telling each is, ``rare`` whether it isn't
    known to be common."""
    keys = []
    with np.errstate(over="ignore"):
        names = mix64(h[rare] * MIX + np.uint64(salt))
        own_worth, common, worth = worth[rare], h[~rare], worth[~rare]
        for band, cap in roles(len(h), t):
            level = 0
            while True:
                x, w, place = common, worth, common
                if level:
                    place = mix64(common + MIX * np.uint64(level))
                    order = np.argsort(place)
                    x, w, place = common[order], worth[order], place[order]
                block = ((place >> np.uint64(32)) * np.uint64(blocks_of(band, level))) >> np.uint64(32)
                name, told = names, own_worth
                first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(x) else np.empty(0, np.int64)
                if len(first):
                    xor = np.bitwise_xor.reduceat(x, first)
                    shared = mix64(xor * MIX + mix64(block[first] + np.uint64((salt * 64 + band) * 64 + level + 1)))
                    name, told = np.concatenate((names, shared)), np.concatenate((own_worth, np.add.reduceat(w, first)))
                most = altered(len(h), len(first), t, cap)
                if most < 0:
                    break
                last = most + agreeing(len(h)) - 1
                through = len(name) > last
                if last + 1 < len(name):  # a rule of the content, so the same for every text; ties are all sent
                    rank = ((np.uint64(65_535) - np.minimum(told, np.uint64(65_535))) << np.uint64(48)) | (name >> np.uint64(16))
                    name = name[rank <= np.partition(rank, last)[last]]
                keys.append(name)
                if through or blocks_of(band, level) == 2**32:
                    break
                level += 1
    return np.unique(np.concatenate(keys)).view(np.int64)


class Worth:
    """How telling runs are, in sixteenths of a bit: the logarithm of one in how many texts has them."""

    def __init__(self, common: np.ndarray, counts: np.ndarray, texts: int):
        bits = lambda n: np.log2(np.maximum(texts, 2) / np.minimum(np.maximum(n, 1), max(texts, 2)))
        self.common, self.known = common, (16 * bits(counts)).astype(np.uint64)
        self.unknown = np.uint64(16 * bits(np.array(counts.min() if len(counts) else 1)))

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.common):
            return np.full(len(h), self.unknown), np.ones(len(h), bool)
        at = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
        rare = self.common[at] != h
        return np.where(rare, self.unknown, self.known[at]), rare


def _keys(t: float, run: int, worth: Worth):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = Shingler(run), set()
        for batch in batches:
            fp, check, salt, text = (batch.column(c).to_pylist() for c in ("fp", "check", "salt", "text"))
            new = []
            for k, pair in enumerate(zip(fp, check, strict=True)):  # copies within a task are sent once
                if pair not in seen:
                    seen.add(pair)
                    new.append(k)
            if len(seen) > 1_000_000:
                seen.clear()
            fps, sizes, keys, offsets = [], [], [], [0]
            for k, h in zip(new, shingle([text[k] for k in new]), strict=True):
                if len(h):
                    own = sketch_keys(h, t, salt[k], *worth(h))
                    fps.append(fp[k])
                    sizes.append(len(h))
                    keys.append(own)
                    offsets.append(offsets[-1] + len(own))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["fp", "size", "keys"])

    return of


def _met(t: float):
    """Of rows sorted by (key, size, fp) the pairs of different texts that have a key in common and sizes that can match, as
    (null, fp, fp, smaller size). Groups of more than ``GROUP`` texts are passed on as rows (key, fp, null, size)."""

    def pairs(size: np.ndarray, fp: np.ndarray, first: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
        for far in range(1, GROUP):  # each text with the far-th one behind it in its group
            first, n = first[n > far], n[n > far]
            if not len(n):
                return
            at = np.repeat(first - np.concatenate(([0], np.cumsum(n - far)[:-1])), n - far) + np.arange((n - far).sum())
            at = at[size[at] >= size[at + far] * t - 1e-9]
            yield np.minimum(fp[at], fp[at + far]), np.maximum(fp[at], fp[at + far]), size[at]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "fp_a", "fp_b", "size"]
        held = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)]
        within = 0  # rows of the held group that were passed on already: it is a large one

        def told(key, size, fp, end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, within
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
            n = np.diff(np.append(first, len(key)))
            large = n > GROUP
            if within and len(n):
                large[0] = True
            if len(n) and not end:  # the last group may go on in the next batch
                a = first[-1]
                if large[-1]:
                    within, held = 1, [x[-1:] for x in (key, size, fp)]
                else:
                    within, held = 0, [x[a:] for x in (key, size, fp)]
                    first, n, large = first[:-1], n[:-1], large[:-1]
            found = list(pairs(size, fp, first[~large], n[~large]))
            if found:
                a, b, least = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b), pa.array(least)], names)
            if large.any():
                at = np.repeat(first[large] - np.concatenate(([0], np.cumsum(n[large])[:-1])), n[large]) + np.arange(n[large].sum())
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(fp[at]), pa.nulls(len(at), pa.int64()), pa.array(size[at])], names)

        for batch in batches:
            key, size, fp = (np.concatenate((h, batch.column(c).to_numpy())) for h, c in zip(held, ("key", "size", "fp"), strict=True))
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1]))) if len(key) else np.empty(0, bool)
            yield from told(key[new], size[new], fp[new], False)
        yield from told(*held, True)

    return of


def texts_of(tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(origin, id, text, fp, check) of several tables; null ids and texts are left out. fp and check together, 128 bits,
    stand for the exact text."""
    out = None
    for origin, df, key, text in tables:
        d = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.lit(origin).alias("origin"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
        out = d if out is None else out.unionByName(d)
    return out.withColumns({"fp": F.xxhash64("origin", "text"), "check": F.xxhash64(F.lit(11), "text")})


def candidate_pairs(texts: DataFrame, t: float, run: int, worth: Worth) -> DataFrame:
    """(fp_a, fp_b) of different texts that met in enough blocks and whose sizes allow J >= t; all that have it are there. Only
    numbers are shuffled; a key that many texts have is split by the adaptive join."""
    salted = texts.select("fp", "check", F.pmod(F.xxhash64("origin"), F.lit(1_000_003)).alias("salt"), "text")
    rows = salted.mapInArrow(_keys(t, run, worth), "fp long, size int, keys array<long>")
    rows = rows.select(F.explode("keys").alias("key"), "fp", "size")
    # most blocks are met by one text only; they end here, behind the one large shuffle
    met = rows.repartition("key").sortWithinPartitions("key", "size", "fp").mapInArrow(_met(t), "key long, fp_a long, fp_b long, size int")
    met = keep(met, "p5-met")
    small = met.where("fp_b is not null").select("fp_a", "fp_b", "size")
    large = met.where("fp_b is null").select("key", "fp_a", "size").distinct()
    x, y = F.col("x"), F.col("y")
    pairs = large.toDF("key", "fp_a", "x").join(large.toDF("key", "fp_b", "y"), "key").where("fp_a < fp_b").where(F.least(x, y) >= F.greatest(x, y) * F.lit(t) - 1e-9)
    both = small.unionByName(pairs.select("fp_a", "fp_b", F.least(x, y).alias("size"))).groupBy("fp_a", "fp_b").agg(F.count("*").alias("blocks"), F.min("size").alias("size"))
    enough = F.when(F.col("size") < 16, agreeing(15)).when(F.col("size") < 64, agreeing(63)).otherwise(agreeing(64))
    return both.where(F.col("blocks") >= enough).select("fp_a", "fp_b")


def sketch_words(size: int) -> int:
    """64-bit words of the bit sketch of a text: two bits for each run of the largest text of its band."""
    return max(1, 4 ** (band_of(size) + 1) * 2 // 64)


def bit_sketch(h: np.ndarray) -> np.ndarray:
    """Parities: bit b is set if an odd number of runs falls on it. A larger sketch folds to a smaller one by XOR."""
    words = sketch_words(len(h))
    bit = mix64(h) & np.uint64(words * 64 - 1)
    odd = np.bincount(bit.astype(np.int64), minlength=words * 64).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def hamming(a: str, b: str):
    """Distance of two bit sketches, the larger folded to the size of the smaller."""
    n = F.least(F.size(a), F.size(b))
    fold = lambda s, j: F.aggregate(F.sequence(F.lit(0), (F.size(s) / n).cast("int") - 1), F.lit(0).cast("long"), lambda acc, q: acc.bitwiseXOR(F.get(F.col(s), j + q * n)))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, j: acc + F.bit_count(fold(a, j).bitwiseXOR(fold(b, j))))


def asked_rows(rows: DataFrame, asked: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose ``on``, which begins with fp, is among the asked ones, once each. At most ``SIEVE`` residues of fp are
    broadcast, so that rows with a large column are mostly dropped before they would be shuffled."""
    residue = F.pmod(F.col("fp"), F.lit(SIEVE)).alias("residue")
    near = rows.withColumn("residue", residue).join(F.broadcast(asked.select(residue).distinct()), "residue", "left_semi").drop("residue")
    return near.join(asked, on, "left_semi").dropDuplicates(["fp", "check"])


def near_pairs(texts: DataFrame, t: float, run: int, bits: DataFrame, worth: Worth) -> DataFrame:
    """(fp_a, check_a, fp_b, check_b): the candidates whose bit sketches are as near as texts with J >= t are."""
    pairs = keep(candidate_pairs(texts, t, run, worth), "p5-pairs")
    met = pairs.select(F.explode(F.array("fp_a", "fp_b")).alias("fp")).distinct()
    bits = keep(asked_rows(bits, met, ["fp"]), "p5-sketches")
    both = pairs.join(bits.toDF("fp_a", "check_a", "size_a", "sketch_a"), "fp_a").join(bits.toDF("fp_b", "check_b", "size_b", "sketch_b"), "fp_b")
    far = F.floor(F.lit((1 - t) / (1 + t)) * (F.col("size_a") + F.col("size_b")) + F.lit(1e-9))
    return both.where(hamming("sketch_a", "sketch_b") <= far).select("fp_a", "check_a", "fp_b", "check_b")


def _verify(t: float, run: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(run)
        names = ("fp_a", "check_a", "fp_b", "check_b")
        for whole in batches:
            for at in range(0, whole.num_rows, 64):  # texts may be long: few at a time
                batch = whole.slice(at, 64)
                a, b = (list(shingle(batch.column(c).to_pylist())) for c in ("text_a", "text_b"))
                both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)]
                sims = [n / (len(x) + len(y) - n) if n else 0.0 for n, x, y in zip(both, a, b, strict=True)]
                good = pa.array([n > 0 and n >= t * (len(x) + len(y) - n) - 1e-9 for n, x, y in zip(both, a, b, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sims, pa.float64())], [*names, "similarity"]).filter(good)

    return of


def similar_texts(texts: DataFrame, t: float = 0.7, run: int = 3) -> tuple[DataFrame, DataFrame]:
    """((fp_a, check_a, fp_b, check_b, similarity) of the pairs of different texts of one origin with Jaccard similarity
    >= t over their runs of ``run`` words, verified on the texts; (fp, check) of all texts with at least one run)."""
    bits, worth = first_pass(texts, run)
    pairs = keep(near_pairs(texts, t, run, bits, worth), "p5-near")
    asked = pairs.select(F.explode(F.array(F.struct(F.col("fp_a").alias("fp"), F.col("check_a").alias("check")), F.struct(F.col("fp_b").alias("fp"), F.col("check_b").alias("check")))).alias("x")).select("x.fp", "x.check").distinct()
    found = keep(asked_rows(texts.select("fp", "check", "text"), keep(asked, "p5-asked"), ["fp", "check"]), "p5-texts")
    with_a = pairs.join(found.toDF("fp_a", "check_a", "text_a"), ["fp_a", "check_a"])
    both = with_a.join(found.toDF("fp_b", "check_b", "text_b"), ["fp_b", "check_b"])
    similar = both.mapInArrow(_verify(t, run), "fp_a long, check_a long, fp_b long, check_b long, similarity double")
    return keep(similar, "p5-similar"), bits.select("fp", "check")


def similar_rows(tables: list[tuple[str, DataFrame, str, str]], t: float = 0.7, run: int = 3) -> DataFrame:
    """(origin, id_a, id_b, similarity), id_a < id_b, of all pairs of rows of one table whose texts have a Jaccard
    similarity of t or more, exact copies included: where every pair is asked for. ``similar_groups`` has the groups
    without writing out the pairs of copies. Repeated rows count once; null texts and texts of fewer than ``run`` words
    are in no pair."""
    texts = texts_of(tables)
    pairs, told = similar_texts(texts, t, run)
    ids = keep(texts.select("origin", "id", "fp", "check").distinct(), "p5-ids")
    a = ids.select("origin", F.col("id").alias("id_1"), F.col("fp").alias("fp_a"), F.col("check").alias("check_a"))
    b = ids.select(F.col("id").alias("id_2"), F.col("fp").alias("fp_b"), F.col("check").alias("check_b"))
    across = pairs.join(a, ["fp_a", "check_a"]).join(b, ["fp_b", "check_b"]).select("origin", "id_1", "id_2", "similarity")
    copies = ids.groupBy("origin", "fp", "check").count().where("count > 1").drop("count").join(told, ["fp", "check"], "left_semi")
    same = ids.join(copies, ["origin", "fp", "check"], "left_semi")
    within = same.withColumnRenamed("id", "id_1").join(same.withColumnRenamed("id", "id_2"), ["origin", "fp", "check"]).where("id_1 < id_2").select("origin", "id_1", "id_2", F.lit(1.0).alias("similarity"))
    return across.unionByName(within).select("origin", F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"), "similarity").where("id_a < id_b").distinct()


def similar_groups(tables: list[tuple[str, DataFrame, str, str]], t: float = 0.7, run: int = 3) -> DataFrame:
    """(origin, id, group_id, copies, links) of every row that has a copy or a near duplicate. The group is the component
    of linked texts, named by its least id; copies is the number of ids with the row's exact text, itself included; links
    is the number of other texts that its text is near to. Copies meet their text's row, never each other."""
    texts = texts_of(tables)
    pairs, told = similar_texts(texts, t, run)
    ids = keep(texts.select("origin", "id", "fp", "check").distinct().join(told, ["fp", "check"], "left_semi"), "p5-ids")
    text = ["origin", "fp", "check"]
    classes = keep(ids.groupBy(*text).agg(F.min("id").alias("least"), F.count("*").alias("copies")), "p5-classes")
    name = F.concat_ws(":", "origin", F.lpad(F.col("least").cast("string"), 20, "0"))
    named = classes.select("fp", "check", name.alias("name"))
    links = keep(pairs.join(named.toDF("fp_a", "check_a", "src"), ["fp_a", "check_a"]).join(named.toDF("fp_b", "check_b", "dst"), ["fp_b", "check_b"]).where("substring_index(src, ':', 1) = substring_index(dst, ':', 1) and src <> dst").select("src", "dst").distinct(), "p5-links")
    count = links.select(F.explode(F.array("src", "dst")).alias("name")).groupBy("name").agg(F.count("*").alias("links"))
    parts = connected_components(links).select(F.col("node").alias("name"), "component")
    told = classes.withColumn("name", name).join(count, "name", "left").join(parts, "name", "left").where("copies > 1 or links > 0")
    told = told.select(*text, F.coalesce(F.substring_index("component", ":", -1).cast("long"), "least").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return ids.join(told, text).select("origin", "id", "group_id", "copies", "links")
