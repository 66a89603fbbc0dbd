"""Mixing sources to target weights under a cap on repetition.

Weights lie on a path from the natural token shares q to the target shares p: w(x) is q^(1 - x) p^x, normalised. With
equal targets that is temperature mixing, q raised to the exponent 1 - x. x is bisected: to a target entropy, or to the
most that the repetition limits allow for a given budget; where the limits allow the targets themselves x is 1 and every
source gets its target share. Weights are realised as budgeted block permutations: a source's documents lie in an order
given by a hash of the id; the budget is spent in whole passes and then along the order. The place where it ends is
found digit by digit of the hash, from token sums by digit, and only the documents of that one hash value are looked at
row by row. What is then left of the budget is filled with documents that fit, longest first, out of the histogram of
the lengths of all unused documents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.sequences import last_n
from larkspur.session import keep

DIGIT, DIGITS = 256, 4  # the order's hash value has DIGITS digits of base DIGIT


def _normal(log_weights: dict[str, float]) -> dict[str, float]:
    top = max(log_weights.values(), default=0.0)
    raised = {k: math.exp(v - top) for k, v in log_weights.items()}
    whole = sum(raised.values())
    return {k: v / whole for k, v in raised.items()}


def tilted_weights(tokens: dict[str, float], targets: dict[str, float], x: float) -> dict[str, float]:
    """q^(1 - x) p^x, normalised, of the sources with tokens and a target share; 0 for the others."""
    both = [k for k in targets if tokens.get(k, 0) > 0 and targets[k] > 0]
    log = {k: (1 - x) * math.log(tokens[k]) + x * math.log(targets[k]) for k in both}
    return dict.fromkeys(targets, 0.0) | (_normal(log) if log else {})


def temperature_weights(tokens: dict[str, float], exponent: float) -> dict[str, float]:
    """Natural shares to the power ``exponent``, normalised; sources without tokens have weight 0."""
    return tilted_weights(tokens, dict.fromkeys(tokens, 1.0), 1 - exponent)


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def _bisect(good, low: float, high: float, steps: int = 80) -> float:
    """The end of what is good between a good ``low`` and a bad ``high``, to the last place that is good."""
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if good(mid) else (low, mid)
    return low


def tilt_within(tokens: dict[str, float], targets: dict[str, float], limits: dict[str, float], budget: float) -> float:
    """The greatest x in [0, 1] at which no source is used more than ``limits`` allows for ``budget`` tokens. A source's use
    is a log-concave function of x: one that is too high at an x and isn't at 0 crosses its limit just once between,
    and one that is too high at both is so everywhere between, which is a ValueError."""
    over = lambda x: [k for k, w in tilted_weights(tokens, targets, x).items() if w * budget > limits.get(k, math.inf) * tokens.get(k, 0) * (1 + 1e-9)]
    x, never = 1.0, set(over(0.0))
    while bad := over(x):
        if never & set(bad):
            raise ValueError(f"{', '.join(sorted(never & set(bad)))} would be repeated more than the limits allow for {budget:g} tokens")
        x = min(_bisect(lambda m, k=k: k not in over(m), 0.0, x) for k in bad)
    return x


def bisect_exponent(tokens: dict[str, float], target_entropy: float | None = None, max_repeats: dict[str, float] | None = None, budget: float | None = None) -> float:
    """The exponent of the natural shares whose weights have the target entropy (it may be above 1, where that is below the
    natural one), or the least in [0, 1] under which no source is used more than its limit for the budget. Exactly one
    of the two must be given; one that can't be met is a ValueError."""
    have = {k: v for k, v in tokens.items() if v > 0}
    if (target_entropy is None) == (max_repeats is None) or (max_repeats is not None and budget is None) or not have:
        raise ValueError("give either an entropy or limits with a budget, and sources with tokens")
    if max_repeats is not None:
        return 1 - tilt_within(have, dict.fromkeys(have, 1.0), max_repeats, budget)
    at = lambda e: entropy(temperature_weights(have, e))
    floor = math.log(sum(v == max(have.values()) for v in have.values()))
    if not floor - 1e-12 <= target_entropy <= math.log(len(have)) + 1e-12:
        raise ValueError(f"entropy must be between {floor:.6g} and {math.log(len(have)):.6g}")
    high = 1.0
    while at(high) > target_entropy + 1e-9 and high < 1e6:
        high *= 2
    return _bisect(lambda e: at(e) >= target_entropy, 0.0, high)


def budgets(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> tuple[float, float, dict[str, float]]:
    """(x, whole budget, budget of each source). Without ``total`` the whole is the most that the limits allow at the target
    shares; with it the weights are tilted as far to the targets as the limits allow. A source with a share but no tokens
    makes the target shares impossible: without ``total`` the budget is 0 then."""
    shares = {s: share for s, (share, _) in targets.items() if share > 0}
    limits = {s: limit for s, (_, limit) in targets.items()}
    most = min((limits[s] * tokens.get(s, 0) / share for s, share in shares.items()), default=0.0) * sum(shares.values())
    whole = most if total is None else total
    if whole <= 0 or not any(tokens.get(s, 0) > 0 for s in shares):
        return 1.0, 0.0, dict.fromkeys(targets, 0.0)
    if total is not None and any(tokens.get(s, 0) <= 0 for s in shares):
        raise ValueError("a source with a target share has no tokens")
    x = tilt_within(tokens, shares, limits, whole)
    return x, whole, dict.fromkeys(targets, 0.0) | {s: w * whole for s, w in tilted_weights(tokens, shares, x).items()}


def _cut_places(rows: DataFrame, rest: dict[str, float]) -> dict[str, tuple[int, float]]:
    """{source: (hash value at which its rest of the budget ends, what is left of it there)}. Each step reads the sums of
    one digit: at most ``DIGIT`` numbers a source reach the driver."""
    at = {s: (0, r) for s, r in rest.items()}
    for k in range(DIGITS - 1, -1, -1):
        width = DIGIT**k
        begun = rows.sparkSession.createDataFrame([(s, v // (width * DIGIT)) for s, (v, _) in at.items()], "source string, _head long")
        here = rows.join(F.broadcast(begun), "source").where(F.floor(F.col("place") / (width * DIGIT)) == F.col("_head"))
        sums: dict[str, dict[int, int]] = {}
        for s, digit, n in here.groupBy("source", F.pmod(F.floor(F.col("place") / width), F.lit(DIGIT)).alias("digit")).agg(F.sum("n_tokens").alias("n")).collect():
            sums.setdefault(s, {})[digit] = n
        for s, (v, left) in at.items():
            d = 0
            while d < DIGIT - 1 and sums.get(s, {}).get(d, 0) <= left:
                left -= sums.get(s, {}).get(d, 0)
                d += 1
            at[s] = (v + d * width, left)
    return at


def mix_sources(counts: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, uses) of the documents that are used, and (source, target_share, reached_share,
    available_tokens, used_tokens, most_uses, tilt) of each listed source; tilt is 1 where the target shares themselves
    are the weights.

    ``counts`` is (doc_id, source, n_tokens), a row a document. ``targets`` is a small fixed table with one row a source;
    the driver sees its rows and sums by source and digit. Documents of unlisted or null sources are not used. A
    ``total`` beyond what the limits allow at the natural shares is a ValueError.
    """
    spark = counts.sparkSession
    want = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source is not null and target_share is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.coalesce(F.min("max_repeats"), F.lit(1)).alias("max_repeats")).collect()}
    listed = spark.createDataFrame([(k,) for k in want], "source string")
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(DIGIT**DIGITS))
    rows = keep(counts.where("n_tokens > 0").join(F.broadcast(listed), "source", "left_semi").select("doc_id", "source", "n_tokens", place.alias("place")), "p9-rows")
    have = {r[0]: r[1] for r in rows.groupBy("source").agg(F.sum("n_tokens")).collect()}
    tilt, whole, budget = budgets(have, want, total)
    passes = {s: min(int(budget[s] / n + 1e-9), want[s][1]) for s, n in have.items()}
    rest = {s: max(0.0, budget[s] - passes[s] * n) if passes[s] < want[s][1] else 0.0 for s, n in have.items()}
    cuts = _cut_places(rows, rest)
    plan = F.broadcast(spark.createDataFrame([(s, passes[s], *cuts[s]) for s in have], "source string, passes int, cut long, left double"))
    placed = rows.join(plan, "source")
    cols = ["doc_id", "source", "n_tokens", "passes"]
    easy = placed.where("place <> cut").select(*cols, (F.col("place") < F.col("cut")).cast("int").alias("extra"))
    run = F.sum("n_tokens").over(Window.partitionBy("source").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    hard = placed.where("place = cut").select(*cols, (run <= F.col("left")).cast("int").alias("extra"))  # one hash value a source
    chosen = keep(easy.unionByName(hard), "p9-chosen")
    # what is left is less than one document: documents that fit are taken longest first from the histogram of lengths
    spent = {r[0]: r[1] for r in chosen.where("extra = 1").groupBy("source").agg(F.sum("n_tokens")).collect()}
    left = spark.createDataFrame([(s, int(r - spent.get(s, 0))) for s, r in rest.items()], "source string, left long")
    spare = chosen.where("extra = 0").join(F.broadcast(left), "source").where("n_tokens <= left")
    lengths = spare.groupBy("source", "n_tokens").agg(F.count("*").alias("n"), F.max("left").alias("left"))
    lists = lengths.groupBy("source").agg(F.max("left").alias("left"), F.sort_array(F.collect_list(F.struct("n_tokens", "n")), asc=False).alias("l"))  # one entry a length
    start = F.struct(F.col("left"), F.array().cast("array<struct<n_tokens:bigint,take:bigint>>").alias("taken"))
    fit = lambda a, b: F.least(b["n"], F.floor(a["left"] / b["n_tokens"])).cast("bigint")
    step = lambda a, b: F.when(fit(a, b) > 0, F.struct((a["left"] - fit(a, b) * b["n_tokens"]).alias("left"), F.concat(a["taken"], F.array(F.struct(b["n_tokens"].alias("n_tokens"), fit(a, b).alias("take")))).alias("taken"))).otherwise(a)
    takes = keep(lists.select("source", F.explode(F.aggregate("l", start, step)["taken"]).alias("x")).select("source", "x.n_tokens", "x.take"), "p9-takes")
    most = takes.agg(F.max("take")).first()[0] or 0
    # after a length is taken less than that is left, so few are taken and each a few times
    firsts = last_n(spare.join(takes, ["source", "n_tokens"]).withColumn("order", F.xxhash64("doc_id", F.lit(seed))), ["source", "n_tokens"], ["order", "doc_id"], int(most)) if most else None
    uses = chosen
    if firsts is not None:
        fill = firsts.where("nth <= take").select("doc_id", "source", F.lit(1).alias("fill"))
        uses = uses.join(fill, ["source", "doc_id"], "left").withColumn("extra", F.col("extra") + F.coalesce("fill", F.lit(0)))
    uses = keep(uses.select("doc_id", "source", "n_tokens", (F.col("passes") + F.col("extra")).alias("uses")).where("uses > 0"), "p9-uses")
    used = uses.groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("used_tokens"), F.max("uses").alias("most_uses"))
    total_used = uses.agg(F.sum(F.col("uses") * F.col("n_tokens"))).first()[0] or 0
    shares = spark.createDataFrame([(s, share, have.get(s, 0), tilt) for s, (share, _) in want.items()], "source string, target_share double, available_tokens long, tilt double").join(used, "source", "left")
    shares = shares.select("source", "target_share", (F.coalesce("used_tokens", F.lit(0)) / F.lit(max(total_used, 1))).alias("reached_share"), "available_tokens", F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "tilt")
    return uses, shares
