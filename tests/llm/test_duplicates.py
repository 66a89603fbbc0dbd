"""Copies, near duplicates and shared spans against brute force on small inputs."""

import re
from random import Random

import pytest

from larkspur.llm import copies, neardup, spans

RECORD = "record_id long, main_class string, sub_class string, text string, kept_id int"


def plain_words(x):
    return tuple(re.findall(r"[^\W_]+", (x or "").casefold()))


def test_copies_match_brute_force(spark):
    r = Random(4)
    words = ["Straße", "STRASSE", "a", "B", "b", "editor", "x1", "中文"]
    rows = []
    for k in range(300):
        pieces = [" ".join(r.choice(words) for _ in range(r.randint(0, 2))) for _ in range(r.randint(1, 3))]
        rows.append((k // 2 if r.random() < 0.1 else k, r.choice(["p", "q", None, " "]), r.choice(["home base", "Home_Base", "", None]), r.choice([";", "|", " ; "]).join(pieces), k))
    rows += [(900, "p", "s", None, 0), (901, "p", "s", "", 0), (902, "p", "s", " ", 0), (None, "p", "s", "a", 0)]
    rows = [row for k, row in enumerate(rows) if row[0] is None or all(row[0] != other[0] for other in rows[:k])]
    rows += rows[:5]  # repeated rows
    groups = {}
    for i, m, s, t, _ in set(rows):
        if i is None or not (m or "").strip() or not (t or "").strip():
            continue
        key = (m, plain_words(s), tuple(sorted(w for w in map(plain_words, re.split("[;|]", t)) if w)))
        groups.setdefault(key, set()).add(i)
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    df = spark.createDataFrame(rows, RECORD)
    assert {(x.kept_id, x.record_id) for x in copies.redundant_records(df).collect()} == want and want
    counts = {x.kept_id: x.copies for x in copies.collapsed_records(df).collect()}
    assert counts == {min(g): len(g) for g in groups.values()}
    assert copies.redundant_records(df.where("false")).count() == 0


def shingles(text, run=3):
    w = re.findall(r"[^\W_]+", (text or "").casefold())
    return {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}


def near_corpus():
    r = Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for size in (1, 2, 3, 4, 6, 9, 15, 30, 60, 120, 250, 600):
        for _ in range(3):
            base = [r.choice(vocabulary) for _ in range(size)]
            texts.append(" ".join(base))
            for share in (0.0, 0.02, 0.05, 0.1, 0.2):
                edited = [w if r.random() >= share else r.choice(vocabulary) for w in base]
                cut = r.randint(0, len(edited))
                texts.append(r.choice([" ", ", ", "\n"]).join(edited[cut:] + edited[:cut] if r.random() < 0.3 else edited))
    return texts + ["", " ", "one", texts[40], texts[40]]


def test_near_duplicates_match_brute_force(spark):
    texts = near_corpus()
    rows = [(k, t, k) for k, t in enumerate(texts)] + [(7000, None, 1), (None, "w1 w2 w3 w4", 1)]
    rows += rows[:9]
    df = spark.createDataFrame(rows, "id long, text string, fp int")  # fp clashes with a column of the operator
    s = {k: shingles(t) for k, t in enumerate(texts)}
    want = {(a, b) for a in s for b in s if a < b and s[a] and s[b] and len(s[a] & s[b]) >= 0.7 * len(s[a] | s[b])}
    got = {(r.id_a, r.id_b) for r in neardup.similar_rows([("t", df, "id", "text")]).collect()}
    assert got == want and len(want) > 40
    assert neardup.similar_rows([("t", df.where("false"), "id", "text")]).count() == 0


def test_a_hot_group_of_copies_is_whole(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(k, text) for k in range(60)] + [(100, text + " more")], "id long, text string")
    got = neardup.similar_rows([("t", df, "id", "text")])
    assert got.count() == 61 * 60 // 2


def test_thin_sketches_are_drawn_finer(spark, monkeypatch):
    """With far too few blocks every text is thin at first; no pair is lost by it."""
    import random

    r = random.Random(3)
    texts = []
    for size in (70, 150, 300, 900):
        base = [f"w{r.randrange(10_000)}" for _ in range(size)]
        texts += [" ".join(base), " ".join(base[: int(size * 0.75)]), " ".join("x" if k % 23 == 0 else w for k, w in enumerate(base))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    s = {k: shingles(t) for k, t in enumerate(texts)}
    want = {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.7 * len(s[a] | s[b])}
    monkeypatch.setattr(neardup, "SHARE", 0.001)
    monkeypatch.setattr(neardup.Worth, "__call__", lambda self, h: (h * 0 + 1, h != h))  # all runs are common
    assert {(r.id_a, r.id_b) for r in neardup.similar_rows([("t", df, "id", "text")]).collect()} == want and len(want) >= 8


@pytest.mark.parametrize("rows", [1, 7, 64, 1000])
def test_pairs_of_sorted_keys_match_brute_force(rows):
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(rows)
    sizes = r.integers(3, 30, 400)
    data = sorted({(int(k), int(sizes[f]), int(f)) for k, g in enumerate(r.choice([1, 2, 5, 63, 64, 65, 66, 200], 60)) for f in r.integers(0, 400, g)})
    data = sorted(data + data[::5])
    cols = [np.array(c) for c in zip(*data, strict=True)]
    batches = [pa.RecordBatch.from_arrays([pa.array(cols[0][k : k + rows]), pa.array(cols[1][k : k + rows].astype(np.int32)), pa.array(cols[2][k : k + rows])], ["key", "size", "fp"]) for k in range(0, len(data), rows)]
    by_key = {}
    for k, s, f in data:
        by_key.setdefault(k, set()).add((s, f))
    want, passed = [], set()
    for k, g in by_key.items():
        if len(g) > neardup.GROUP:
            passed |= {(k, f) for _, f in g}
        else:
            want += [(min(f, q), max(f, q), min(s, p)) for s, f in g for p, q in g if f < q and min(s, p) >= 0.7 * max(s, p) - 1e-9]
    out = [x for b in neardup._met(0.7)(iter(batches)) for x in b.to_pylist()]
    assert sorted((x["fp_a"], x["fp_b"], x["size"]) for x in out if x["fp_b"] is not None) == sorted(want)
    assert {(x["key"], x["fp_a"]) for x in out if x["fp_b"] is None} == passed


def test_no_pair_alters_more_blocks_than_stated():
    import numpy as np

    r = np.random.default_rng(9)
    for _ in range(400):
        both, x, y, t = int(r.integers(1, 200)), int(r.integers(0, 80)), int(r.integers(0, 80)), float(r.choice([0.5, 0.7, 0.8]))
        if both < t * (both + x + y):
            continue
        blocks = int(r.integers(1, 60))
        place = r.integers(0, blocks, both + x + y)
        sets = [np.r_[0 : both + x], np.r_[0:both, both + x : both + x + y]]
        content = [{int(b): frozenset(s[place[s] == b].tolist()) for b in np.unique(place[s])} for s in sets]
        for mine, other, s, o in ((content[0], content[1], sets[0], sets[1]), (content[1], content[0], sets[1], sets[0])):
            differ = sum(other.get(b) != c for b, c in mine.items())
            assert differ <= neardup.altered(len(s), len(mine), t)
            if len(o) < len(s):
                assert differ <= neardup.altered(len(s), len(mine), t, len(o))


def test_hamming_distance_never_exceeds_the_difference(spark):
    import numpy as np

    r = np.random.default_rng(5)
    rows = []
    for a, b, both in ((10, 12, 8), (60, 70, 50), (500, 300, 280), (1100, 1000, 990), (4000, 5000, 3900)):
        x = r.integers(0, 2**63, a + b, dtype=np.uint64)
        left, right = np.unique(x[:a]), np.unique(np.concatenate((x[:both], x[a : a + b - both])))
        with np.errstate(over="ignore"):
            rows.append((neardup.bit_sketch(left).tolist(), neardup.bit_sketch(right).tolist(), len(np.setxor1d(left, right))))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, most int")
    for x in df.select("most", neardup.hamming("a", "b").alias("d")).collect():
        assert 0.5 * x.most <= x.d <= x.most or x.most < 20 and x.d <= x.most


def test_frequent_items_are_all_there():
    import numpy as np

    r = np.random.default_rng(2)
    summary = neardup.FrequentItems(200)
    for k in range(300):  # 20 items stand in all of 300 sets, more often than 36,000 / 200
        summary.add(np.unique(np.concatenate((r.integers(100, 2**60, 100).astype(np.uint64), np.arange(20, dtype=np.uint64)))))
        if k % 10 == 9:
            summary.fold()
    assert set(range(20)) <= set(summary.items.tolist())
    assert len(summary.items) <= 200 and summary.counts.max() <= 300


def test_groups_name_copies_and_links(spark):
    base = [f"w{k}" for k in range(60)]
    near, far = " ".join([*base[:57], "x", "y", "z"]), " ".join(f"v{k}" for k in range(60))
    df = spark.createDataFrame([(5, " ".join(base)), (6, " ".join(base)), (6, " ".join(base)), (9, near), (10, far), (11, far), (12, "one two"), (13, "one two"), (None, "a b c"), (14, None)], "id long, text string")
    got = {x.id: (x.group_id, x.copies, x.links) for x in neardup.similar_groups([("t", df, "id", "text")]).collect()}
    assert got == {5: (5, 2, 1), 6: (5, 2, 1), 9: (5, 1, 1), 10: (10, 2, 0), 11: (10, 2, 0)}
    assert neardup.similar_groups([("t", df.where("false"), "id", "text")]).count() == 0


def extended(sizes, tries):
    """Texts of the smaller and the larger number of runs, the larger one the smaller with words added at its end."""
    texts = []
    for small, large in sizes:
        for k in range(tries):
            words = [f"v{small}x{k}x{j}" for j in range(large + 2)]
            texts += [" ".join(words[: small + 2]), " ".join(words)]
    return texts


def test_short_extended_texts_are_all_found(spark):
    texts = extended([(3, 4), (5, 7), (6, 8), (7, 10), (14, 20), (15, 21)], 40)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.id_a, r.id_b) for r in neardup.similar_rows([("t", df, "id", "text")]).collect()}
    assert got == {(k, k + 1) for k in range(0, len(texts), 2)}


def test_long_extended_texts_are_all_found(spark):
    texts = []
    for k in (27, 76, 98, 138):  # met in fewer than two blocks of the former sketch
        words = [f"v2047x{k}x{j}" for j in range(2926)]
        texts += [" ".join(words[:2049]), " ".join(words)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.id_a, r.id_b) for r in neardup.similar_rows([("t", df, "id", "text")]).collect()}
    assert got == {(k, k + 1) for k in range(0, len(texts), 2)}


def span_corpus():
    r = Random(6)
    letters = "abcdefgh \n中é"
    fresh = lambda n: "".join(r.choice(letters) for _ in range(n))
    quotes = [fresh(n) for n in (249, 250, 251, 400, 1200)]
    docs = [fresh(r.randint(0, 300)) for _ in range(10)]
    for q in quotes:
        for _ in range(3):
            docs.append(fresh(r.randint(0, 500)) + q + fresh(r.randint(0, 500)))
    docs += [docs[-1], "a" * 700, "a" * 300, "ab" * 300, "", None]
    return docs


def test_shared_spans_match_brute_force(spark):
    docs = span_corpus()
    rows = [(k, t, k) for k, t in enumerate(docs)] + [(None, "a" * 300, 0)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, hash int")
    seen = {}
    for k, t in enumerate(docs):
        for p in range(len(t or "") - 249):
            seen.setdefault(t[p : p + 250], set()).add(k)
    want = {(a, b) for s in seen.values() for a in s for b in s if a < b}
    assert {(r.doc_a, r.doc_b) for r in spans.sharing_pairs(df).collect()} == want and len(want) >= 13
    covered = {}
    for k, t in enumerate(docs):
        marks = set()
        for p in range(len(t or "") - 249):
            if len(seen[t[p : p + 250]]) > 1:
                marks.update(range(p, p + 250))
        covered[k] = len(marks)
    shares = {r.doc_id: r for r in spans.shared_shares(df).collect()}
    assert {k: shares[k].shared_chars for k in shares} == {k: covered[k] for k, t in enumerate(docs) if t is not None}
    for a, b in want:
        assert shares[a].cluster_id == shares[b].cluster_id
    assert spans.sharing_pairs(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [250, 300, 1000])
def test_every_window_keeps_its_minimum(n):
    hasher = spans.WindowHasher(250, spans.GRAM)
    r = Random(n)
    text = "".join(r.choice("ab") for _ in range(n))
    at, h = hasher(text)
    for p in range(n - 249):  # some kept run lies in each window
        assert any(p <= a <= p + 250 - spans.GRAM for a in at)
    again, h2 = hasher("zz" + text)
    assert set(h) <= set(h2) or len(set(h) - set(h2)) <= 2
