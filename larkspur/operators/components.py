"""Connected components of a graph whose links never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import keep


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of a link, named by the component's least node.

    Alternating star rounds: first each node hands its larger neighbours to its least one, then each node hands all
    smaller ones to the least. Both steps are a minimum with map-side combining and an equi-join, so a hub's links are
    never gathered in one task. Each round is written to the shared folder. Null ends are dropped and a self-link keeps
    its node; no links give no rows. It ends when a round changes nothing, and fails loudly after ``rounds``.
    """
    e = links.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    nodes = keep(e.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "cc-nodes")
    e = keep(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-links")
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_min = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_min, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        e = keep(small, "cc-round")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        seen = now
    raise RuntimeError("components did not settle")
