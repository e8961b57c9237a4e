"""Connected components of an undirected graph by repeated contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (id long, root long): every vertex of an edge, and one
    vertex of its component that is the same for the whole component.

    Each round sends a vertex to the vertex at most two edges away (or itself) that comes
    first in a random order drawn anew for the round, and rewrites the edges; a constant
    share of the vertices goes each round, also on long paths, and a star goes in one.
    Minima are pre-aggregated, so a hub with very many edges costs no task more than its
    share. Loops and repeated edges are harmless; no edges give no rows; null ends are
    ignored.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    live = cut(pairs.where("a is not null and b is not null and a <> b").distinct(), "edges")
    roots, turn = None, 0
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select("b", "a"))
        rank = lambda c, t=turn: F.struct(F.xxhash64(F.col(c), F.lit(t)).alias("h"), F.col(c).alias("v"))
        first = both.groupBy(F.col("a").alias("id")).agg(F.min(rank("b")).alias("n"))
        near = cut(first.select("id", F.least("n", rank("id"))["v"].alias("to")), "near")
        second = both.join(near.toDF("b", "to"), "b").select(F.col("a").alias("id"), "to").union(near)
        step = cut(second.groupBy("id").agg(F.min(rank("to"))["v"].alias("to")), "step")
        ends = live.join(step.toDF("a", "pa"), "a").join(step.toDF("b", "pb"), "b")
        left = ends.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        after = cut(left.distinct(), "edges")
        if roots is None:
            merged = step.select("id", F.col("to").alias("root"))
        else:
            merged = roots.join(step.toDF("root", "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        grown = cut(merged, "roots")
        for old in (live, near, step, roots):
            if old is not None:
                drop(old)
        live, roots, turn = after, grown, turn + 1
    drop(live)
    return roots if roots is not None else edges.sparkSession.range(0).select("id", F.col("id").alias("root"))  # createDataFrame would start Python workers of another kind
