"""Filling containers of fixed capacity: shortest-pack-first over the histogram of lengths.

Only the histogram (at most ``capacity`` rows) reaches the driver. Lengths are placed longest first; each goes to the
shortest pack with room for it, whole groups of equal packs at a time. The patterns are then joined back to the documents by the
rank of a document among those of its length.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import keep

SALTS = 1024


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(count, [(length, how many)])]: patterns of packs. Every length is placed exactly as often as it occurs."""
    by_room: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []  # heap of the rooms that have packs, roomiest (the shortest packs) first

    def put(room: int, count: int, pattern: tuple) -> None:
        if room not in by_room:
            by_room[room] = []
            heapq.heappush(rooms, -room)
        by_room[room].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = -rooms[0] if rooms else 0
            if room < length:
                fit = capacity // length
                if left >= fit:
                    put(capacity - fit * length, left // fit, ((length, fit),))
                if left % fit:
                    put(capacity - (left % fit) * length, 1, ((length, left % fit),))
                break
            groups = by_room[room]
            count, pattern = groups.pop()
            if not groups:
                del by_room[room]
                heapq.heappop(rooms)
            each = min(room // length, -(-left // count))  # as many of this length a pack as go in and are needed
            if each * count > left and each > 1:
                each = max(1, left // count)
            taken = min(count, left // each) if left >= each else 1
            each = min(each, left)
            if count > taken:
                put(room, count - taken, pattern)
            put(room - each * length, taken, (*pattern, (length, each)))
            left -= each * taken
    return [(count, list(pattern)) for groups in by_room.values() for count, pattern in groups]


def slots_of(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first container, place): documents of a length take ranks in order."""
    used: dict[int, int] = {}
    slots, container = [], 0
    for count, pattern in patterns:
        place = 0
        for length, each in pattern:
            for _ in range(each):
                first = used.get(length, 0)
                slots.append((length, first, first + count, container, place))
                used[length] = first + count
                place += 1
        container += count
    return slots


def pack_documents(counts: DataFrame, capacity: int = 2048) -> DataFrame:
    """(container_id, place, doc_id, piece_no, first_token, n_tokens) of every document of (doc_id, n_tokens).

    Documents of no tokens are in no container. A document larger than a container is split into full containers and a
    rest, and no other is split. Rank among equal lengths comes from salted parts (by a hash of the id) and the sums of
    the parts before, so no task ever holds all documents of a length.
    """
    whole = F.expr(f"cast(floor((n_tokens - 1) / {capacity}) as int)")
    pieces = counts.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), whole)).alias("piece_no"))
    pieces = pieces.select("doc_id", "piece_no", (F.col("piece_no") * capacity).cast("long").alias("first_token"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no") * capacity).cast("int").alias("length"), F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(SALTS)).alias("salt"))
    pieces = keep(pieces, "p8-pieces")
    salted = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = salted.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    slots = slots_of(pack_histogram(histogram, capacity))
    # a pattern step ends a length or a group of packs, so slots grow with the capacity, not with the documents; their size
    # decides whether they are broadcast
    table = pieces.sparkSession.createDataFrame(slots, "length int, low long, high long, container long, place int")
    ranked = pieces.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece_no"))).join(before.select("length", "salt", "before"), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth") - 1)
    placed = ranked.join(table, "length").where("rank >= low and rank < high")
    return placed.select((F.col("container") + F.col("rank") - F.col("low")).alias("container_id"), "place", "doc_id", "piece_no", "first_token", F.col("length").alias("n_tokens"))
