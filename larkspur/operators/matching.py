"""One-to-one matching: exact first, then the best assignment or the best pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_matches(left: DataFrame, right: DataFrame, key: list[str], id_: str) -> DataFrame:
    """(key, left_id, right_id): rows equal in ``key`` pair off in the order of their ids, each once."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(id_))
    side = lambda df, name: df.withColumn("nth", nth).select(*key, "nth", F.col(id_).alias(name))
    return side(left, "left_id").join(side(right, "right_id"), [*key, "nth"]).select(*key, "left_id", "right_id")


def bag_cosine(a: str, b: str) -> float:
    """The default similarity: cosine of word counts."""
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    norm = sqrt(sum(v * v for v in x.values())) * sqrt(sum(v * v for v in y.values()))
    return sum(v * y[w] for w, v in x.items()) / norm if norm else 0.0


def best_assignment(cost: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs of least total cost that use every row and column of the shorter side: one shortest augmenting path a row,
    each step over a whole row of reduced costs at once."""
    if not cost or not cost[0]:
        return []
    c = np.asarray(cost, float)
    turned = c.shape[0] > c.shape[1]
    c = c.T if turned else c
    n, m = c.shape
    price, owner = np.zeros(m), np.full(m, -1)
    row_price = np.zeros(n)
    for row in range(n):
        reach, came, open_ = np.full(m, np.inf), np.full(m, -1), np.ones(m, bool)
        i, via, base = row, -1, 0.0
        while True:
            d = base + c[i] - row_price[i] - price
            better = open_ & (d < reach)
            reach[better], came[better] = d[better], via
            at = int(np.argmin(np.where(open_, reach, np.inf)))
            base, open_[at] = reach[at], False
            if owner[at] < 0:
                break
            i, via = owner[at], at
        done = np.flatnonzero(~open_)
        shift = base - reach[done]
        held = owner[done] >= 0
        row_price[owner[done[held]]] += shift[held]
        price[done] -= shift
        row_price[row] += base
        while at >= 0:
            owner[at] = row if came[at] < 0 else owner[came[at]]
            at = int(came[at])
    pairs = [(int(i), int(j)) for j, i in enumerate(owner) if i >= 0]
    return sorted((j, i) for i, j in pairs) if turned else sorted(pairs)


def greedy_best(pairs: list[tuple[float, object, object]]) -> list[tuple[object, object, float]]:
    """Pairs taken best first, each side once; ties by the ids."""
    used_a, used_b, out = set(), set(), []
    for s, a, b in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.append((a, b, s))
    return out


def assignment_match(rows: DataFrame, threshold: float = 0.5, similarity: Callable[[str, str], float] = bag_cosine) -> DataFrame:
    """(case_id, main_class, left_text, right_text, similarity) of the assignment of greatest total similarity between the
    two sides of each (case_id, main_class); pairs under the threshold are dropped. ``rows`` is (case_id, main_class,
    side, text), side 0 or 1; a group is the facts of one class of one case."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = sorted(pdf.loc[pdf.side == 0, "text"]), sorted(pdf.loc[pdf.side == 1, "text"])
        sims = [[similarity(a, b) for b in right] for a in left]
        found = [(left[i], right[j], round(sims[i][j], 6)) for i, j in best_assignment([[-s for s in r] for r in sims]) if sims[i][j] >= threshold]
        out = pd.DataFrame(found, columns=["left_text", "right_text", "similarity"])
        out.insert(0, "main_class", pdf.main_class.iloc[0])
        out.insert(0, "case_id", pdf.case_id.iloc[0])
        return out

    return rows.groupBy("case_id", "main_class").applyInPandas(match, "case_id string, main_class string, left_text string, right_text string, similarity double")


def greedy_match(rows: DataFrame, floor: float = 0.55, top: int = 3, similarity: Callable[[str, str], float] = bag_cosine) -> DataFrame:
    """As ``assignment_match``, but best pairs first out of each left text's ``top`` candidates of at least ``floor``."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = sorted(pdf.loc[pdf.side == 0, "text"]), sorted(pdf.loc[pdf.side == 1, "text"])
        pairs = []
        for a in left:
            best = sorted(((similarity(a, b), b) for b in right), key=lambda x: (-x[0], x[1]))[:top]
            pairs += [(s, a, b) for s, b in best if s >= floor]
        out = pd.DataFrame([(a, b, round(s, 6)) for a, b, s in greedy_best(pairs)], columns=["left_text", "right_text", "similarity"])
        out.insert(0, "main_class", pdf.main_class.iloc[0])
        out.insert(0, "case_id", pdf.case_id.iloc[0])
        return out

    return rows.groupBy("case_id", "main_class").applyInPandas(match, "case_id string, main_class string, left_text string, right_text string, similarity double")


def staged_match(rows: DataFrame, key: list[str], id_: str, threshold: float = 0.5, similarity: Callable[[str, str], float] = bag_cosine) -> DataFrame:
    """(case_id, main_class, left_text, right_text, similarity, stage): rows equal in ``key`` pair off first, each once; only
    what is left of both sides goes on to the assignment. ``rows`` is (case_id, main_class, side, text, ...) with an id
    that tells repeated texts apart."""
    side = lambda k: rows.where(F.col("side") == k)
    group = ["case_id", "main_class"]
    exact = exact_matches(side(0), side(1), [*group, *key], id_)
    name = lambda c, new: F.col(c).alias(new)
    lefts, rights = side(0).select(*group, name(id_, "left_id"), name("text", "left_text")), side(1).select(*group, name(id_, "right_id"), name("text", "right_text"))
    pairs = exact.join(lefts, [*group, "left_id"]).join(rights, [*group, "right_id"]).select(*group, "left_text", "right_text", F.lit(1.0).alias("similarity"), F.lit("exact").alias("stage"))
    gone = exact.select(*group, F.lit(0).alias("side"), name("left_id", id_)).unionByName(exact.select(*group, F.lit(1).alias("side"), name("right_id", id_)))
    rest = rows.join(gone, [*group, "side", id_], "left_anti").select(*group, "side", "text")
    return pairs.unionByName(assignment_match(rest, threshold, similarity).withColumn("stage", F.lit("assigned")))
