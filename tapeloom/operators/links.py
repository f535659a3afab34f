"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.staging import discard, staged


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` -> ``(node, root)``: root is the smallest node of the component; nodes
    without a link to another node are absent.

    Each round keeps at most one link per node and neighbour, pre-aggregates the minima and
    writes every step to the shared folder, so that the joins read two plain exchanges, of
    which AQE splits those of hub nodes. The number of rounds grows with the logarithm of the
    longest chain. Nulls in ``a`` or ``b`` and links of a node with itself are ignored; an
    empty table gives an empty result; repeated links count once.
    """
    edges = staged(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "large-min")
        large = staged(
            both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "large",
        )
        least2 = staged(large.groupBy("u").agg(F.min("v").alias("m")), "small-min")
        small = staged(
            large.join(least2, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least2.select("u", F.col("m").alias("v")))
            .distinct(),
            "small",
        )
        new_mark = _mark(small)
        discard(edges, least, large, least2)
        edges, done, mark = small, new_mark == mark, new_mark
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
