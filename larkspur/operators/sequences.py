"""Ordered operators over long groups: running sums, boundaries and islands, without a task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, group: list[str], order: str, value: str, name: str, width: int = 1000) -> DataFrame:
    """Inclusive running sum of ``value`` along the integer column ``order``. Blocks of ``width`` values of the order are
    summed first with map-side combining; a row then needs only its block and the sums of the blocks before."""
    block = F.floor(F.col(order) / F.lit(width))
    blocked = rows.withColumn("_block", block)
    sums = blocked.groupBy(*group, "_block").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select(*group, "_block", before.alias("_before"))
    within = F.sum(value).over(Window.partitionBy(*group, "_block").orderBy(order))
    return blocked.withColumn("_within", within).join(base, [*group, "_block"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_block", "_within", "_before")


def running_max(rows: DataFrame, group: list[str], order: str, value: str, name: str, width: int = 1000) -> DataFrame:
    """Inclusive running maximum of ``value`` along the integer column ``order``, in blocks like ``running_sum``."""
    blocked = rows.withColumn("_block", F.floor(F.col(order) / F.lit(width)))
    tops = blocked.groupBy(*group, "_block").agg(F.max(value).alias("_top"))
    before = F.max("_top").over(Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    base = tops.select(*group, "_block", before.alias("_before"))
    within = F.max(value).over(Window.partitionBy(*group, "_block").orderBy(order))
    return blocked.withColumn("_within", within).join(base, [*group, "_block"]).withColumn(name, F.greatest("_before", "_within")).drop("_block", "_within", "_before")


def last_n(rows: DataFrame, group: list[str], order: list[str], n: int, salts: int = 16) -> DataFrame:
    """The last n rows of each group with ``nth`` from the newest, 1. Each of ``salts`` parts of a group gives its own
    last n first, so a hot group is cut down before it meets in one task."""
    newest = [F.col(c).desc() for c in order]
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    part = rows.withColumn("_salt", salt).withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*newest))).where(F.col("_r") <= n)
    return part.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(*newest))).where(F.col("nth") <= n).drop("_salt", "_r")


def islands(rows: DataFrame, group: list[str], order: str, same: list[str], joins: str | None = None, ends: str | None = None, width: int = 1000) -> DataFrame:
    """``island``: the number, within the group, of the stretch of neighbouring rows that are equal in ``same``. With
    ``joins`` only rows that have it join a neighbour; a row with ``ends`` is the last of its stretch. Rows look at the one
    before within their block; the first row of a block looks at the last row of the block before; the numbers are a
    running sum by blocks. ``order`` is an integer column without ties."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c else None
    here = F.struct(*same, (flag(joins) if joins else F.lit(True)).alias("_joins"), (flag(ends) if ends else F.lit(False)).alias("_ends"))
    blocked = rows.withColumns({"_block": F.floor(F.col(order) / F.lit(width)), "_here": here})
    tails = blocked.groupBy(*group, "_block").agg(F.max_by("_here", F.col(order)).alias("_tail"))
    before = tails.withColumn("_tail", F.lag("_tail").over(Window.partitionBy(*group).orderBy("_block")))
    w = Window.partitionBy(*group, "_block").orderBy(order)
    at = blocked.withColumn("_prev", F.lag("_here").over(w)).join(before, [*group, "_block"])
    prev, alike = F.coalesce("_prev", "_tail"), F.lit(True)
    for c in same:
        alike = alike & F.col("_here")[c].eqNullSafe(prev[c])
    goes_on = prev.isNotNull() & alike & F.col("_here")["_joins"] & prev["_joins"] & ~prev["_ends"]
    flagged = at.withColumn("_start", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).drop("_here", "_prev", "_tail", "_block")
    return running_sum(flagged, group, order, "_start", "island", width).drop("_start")


def consolidation_boundary(turns: DataFrame, key: str, remove: int, offset: int = 0) -> DataFrame:
    """(key, boundary, removed) of turns (key, turn, role, cost) from turn ``offset`` on: the first later ``user`` turn by
    which at least ``remove`` has gone, else the last ``user`` turn but the first row; no such turn gives no row. Sums come
    by blocks and the choice is an aggregate, so a long conversation is never one task's."""
    rows = turns.where(F.col("turn") >= offset)
    first = rows.groupBy(key).agg(F.min("turn").alias("_first"))
    summed = running_sum(rows, [key], "turn", "cost", "_upto").withColumn("removed", F.col("_upto") - F.col("cost"))
    b = summed.where("role = 'user'").join(first, key).where("turn > _first")
    enough = F.min(F.when(F.col("removed") >= remove, F.struct("turn", "removed")))
    return b.groupBy(key).agg(F.coalesce(enough, F.max(F.struct("turn", "removed"))).alias("x")).select(key, F.col("x.turn").alias("boundary"), F.col("x.removed").alias("removed"))


def legal_starts(turns: DataFrame, key: str) -> DataFrame:
    """(key, legal_from): the first turn from which on every tool result has its call, null if there is no such turn.

    ``turns`` has ``turn``, ``role``, ``tool_calls`` (an array of structs with ``id``) and ``tool_call_id``. A result and
    its latest call before it span the turns between; a start is legal if no result lies at or behind it whose call lies
    before it (or nowhere). So a turn is legal if the least call place of the results from there on isn't before it: a
    running minimum from the end. A result without an id asks for no call.
    """
    calls = turns.where("role = 'assistant'").select(key, "turn", F.explode("tool_calls.id").alias("_id"), F.lit(0).alias("_result"))
    results = turns.where("role = 'tool' and tool_call_id <> ''").select(key, "turn", F.col("tool_call_id").alias("_id"), F.lit(1).alias("_result"))
    by_id = Window.partitionBy(key, "_id").orderBy("turn", "_result")  # the uses of one id
    called = F.max(F.when(F.col("_result") == 0, F.col("turn"))).over(by_id)
    needs = calls.unionByName(results).withColumn("_called", called).where("_result = 1").select(key, "turn", F.coalesce("_called", F.lit(-(2**31))).alias("_called"))
    marked = turns.select(key, "turn").join(needs, [key, "turn"], "left").select(key, "turn", (-F.col("turn")).alias("_back"), (-F.col("_called").cast("long")).alias("_least"))
    spanned = running_max(marked, [key], "_back", "_least", "_worst")
    return spanned.groupBy(key).agg(F.min(F.when(F.coalesce(-F.col("_worst") >= F.col("turn"), F.lit(True)), F.col("turn"))).alias("legal_from"))


def _legal(turns: DataFrame, key: str) -> DataFrame:
    if not {"tool_calls", "tool_call_id"} <= set(turns.columns):
        return turns
    return turns.join(legal_starts(turns, key), key).where("turn >= legal_from").drop("legal_from")


def history_suffix(turns: DataFrame, key: str, last: int, offset: int = 0) -> DataFrame:
    """Of the turns from ``offset`` on the last ``last`` (all for 0) from their first ``user`` turn on, if there is one, and
    from there behind the last tool result whose call is cut off. Without the columns tool_calls and tool_call_id there
    are no tool results. The last n come from salted parts, the first user turn from an aggregate."""
    rows = turns.where(F.col("turn") >= offset)
    cut = rows if last == 0 else last_n(rows, [key], ["turn"], last).drop("nth")
    first = cut.groupBy(key).agg(F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("_first"))
    return _legal(cut.join(first, key).where("_first is null or turn >= _first").drop("_first"), key)


def retain_suffix(turns: DataFrame, key: str, last: int) -> DataFrame:
    """The last ``last`` turns, stretched back to the ``user`` turn before the cut (to the beginning without one), without
    what lies before the last tool result whose call is cut off; ``dropped`` is how many turns of the key went, by which
    an offset into them moves."""
    edge = last_n(turns.select(key, "turn"), [key], ["turn"], last).where(F.col("nth") == last).select(key, F.col("turn").alias("_edge"))
    users = turns.where("role = 'user'").select(key, F.col("turn").alias("_user")).join(edge, key).where("_user <= _edge").groupBy(key).agg(F.max("_user").alias("_from"))
    kept = _legal(turns.join(users, key, "left").where("_from is null or turn >= _from").drop("_from"), key)
    sizes = turns.groupBy(key).agg(F.count("*").alias("_n")).join(kept.groupBy(key).agg(F.count("*").alias("_kept")), key)
    return kept.join(sizes.select(key, (F.col("_n") - F.col("_kept")).alias("dropped")), key)
