"""Connected components of an edge table, without moving the graph to one task or the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, release


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step (Kiveris et al., 2014) on edges (hi > lo)."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    root = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(root, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return small.unionAll(root.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component), component being the smallest node that can be reached.

    Edges may come in any direction, repeated, or as loops; an edge with a null end is ignored. A
    node that stands only in a loop is its own component. No edges give no rows. Each round is
    written to the shared folder, so the lineage stays one round long and a lost executor costs
    at most one round. The hub of a large star is split by the skew join of adaptive execution,
    as only joins and partial aggregates meet at a key."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    e = materialize(e.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    loops = e.where("hi = lo").select(F.col("hi").alias("node"))
    now, sign = e.where("hi <> lo"), None
    tables = [e]
    for _ in range(max_rounds):
        row = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if not row[0] or tuple(row) == sign:
            break
        sign = tuple(row)
        now = materialize(_stars(now), "stars")
        if len(tables) > 1:
            release(tables.pop())
        tables.append(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    alone = loops.join(now.select(F.explode(F.array("hi", "lo")).alias("node")).distinct(), "node", "left_anti")
    return found.unionAll(roots).unionAll(alone.select("node", F.col("node").alias("component")))
