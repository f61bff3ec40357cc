"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links(a, b), two longs a row: root is the least node that it reaches.

    A round joins each node's neighbours to the least of them. Rounds are tables in the shared folder, so a lost executor
    costs one round at most; a star's centre with many neighbours is dealt out by the skew handling of the join.
    """
    edges = common.written(_ordered(links), "links")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _ordered(both.join(least, "a").where("b > a").select("b", "m"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _ordered(large.join(least, "a").select("b", "m").union(least))
        after = common.written(small, "links")
        state = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        common.remove_written(edges)
        edges = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("links did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links (a, b) with a over b."""
    x, y = (F.col(c) for c in links.columns)
    return links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a != b").distinct()
