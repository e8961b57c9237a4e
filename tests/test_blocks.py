"""Rounds on a graph in blocks give what plain joins give, and shuffle values, not edges or votes."""

import random
from functools import partial

import numpy as np
from pyspark.sql import functions as F

from peeratlas.jobs import driver_queries, driver_views, iterate
from peeratlas.operators import blocks, community
from peeratlas.sources.storage import bucketed, cut


def some_edges(nodes, many, seed):
    """Edges with repeats, in either direction, of weights that are sums of parts."""
    rng = random.Random(seed)
    return [(rng.randrange(nodes), rng.randrange(nodes), 1.0 / rng.randint(1, 7)) for _ in range(many)]


def test_rounds_in_blocks_equal_rounds_by_joins(spark, monkeypatch):
    """label propagation, also with rows of few edges, repeats, a hub, and edges with equal ends."""
    monkeypatch.setattr(blocks, "ROW", 40)
    rows = [(f"A{a}", f"A{b}", w) for a, b, w in some_edges(60, 300, 1) + [(0, n, 0.5) for n in range(1, 60, 2)]]
    table = spark.createDataFrame(rows, "src string, dst string, weight double")
    pairs = bucketed(community.both_ways(table), "pairs", "other", 4)
    labels = cut(pairs.select("node").distinct().withColumn("label", F.col("node")), "labels")
    for _ in range(3):
        labels = cut(community.vote_round(pairs, labels), "labels")
    assert sorted(community.propagate_labels(table, 3).collect()) == sorted(labels.select("node", "label").collect())


def test_moves_in_blocks_equal_moves_by_joins(spark):
    """a round of moves, and whether nodes want to move, by blocks and by move_choices()."""
    ways = {}
    for a, b, w in some_edges(50, 400, 2):
        for pair in ((a, b), (b, a)) if a != b else ():
            ways[pair] = ways.get(pair, 0) + round(w * 1e6)
    degree = {}
    for (a, _), w in ways.items():
        degree[a] = degree.get(a, 0) + w
    twice, of = sum(degree.values()), {n: n % 9 if n % 3 else n for n in degree}
    total = {c: sum(d for n, d in degree.items() if of[n] == c) for c in of.values()}
    pairs = spark.createDataFrame([(a, b, w, degree[a]) for (a, b), w in ways.items()], "node int, other int, w long, degree long")
    state = spark.createDataFrame([(n, of[n], d, total[of[n]], of[n] % 2 == 0) for n, d in degree.items()], "node int, community int, degree long, total long, open boolean")
    plain = community.move_choices(bucketed(pairs, "pairs", "other", 4), state, twice)
    graph = blocks.Blocks(pairs.where("node < other").select(F.col("node").alias("src"), F.col("other").alias("dst"), (F.col("w") / 1e6).alias("weight")), 3)
    for full in (False, True):
        found = graph.round(state.withColumnRenamed("community", "value"), partial(community._move, 1e-6, float(twice), 1.0, full), community.MOVED, full)
        columns = ["node", "community", "degree"] + ["wants"] * full
        assert sorted(found.select(columns).collect()) == sorted(plain.select(columns).collect())
    assert found.where("moved").count() > 5


def test_a_round_sends_a_value_once_a_part(spark):
    """not a vote for each edge. Every part has the same number of nodes."""
    table = spark.createDataFrame([(a, b, 1.0) for a in range(40) for b in range(a)], "src int, dst int, weight double")
    graph = blocks.Blocks(table, 4)
    routes = graph.routes.select(F.sum(F.length("route") / 4), F.count("*")).first()
    assert tuple(routes) == (40 * 4, 4 * 4)  # 1560 edges from either end
    text = community.label_round(graph, graph.nodes().select("node", F.col("node").alias("label")))._jdf.queryExecution().executedPlan().toString()
    scans = [n for n, line in enumerate(text.splitlines()) if "FileScan" in line and "others" in line]
    above = text.splitlines()[scans[0] - 5 : scans[0]]
    assert len(scans) == 1 and "Exchange" not in "".join(above[-3:])  # edges are read where they lie
    assert len(set(blocks.part_keys(7))) == 7


def test_ends_of_an_edge_get_the_same_sum():
    rng = np.random.default_rng(1)
    w = 1 / rng.integers(1, 50, 200)
    one = list(blocks._block(1, 0, 0, [(np.full(200, 5), w)]))
    other = list(blocks._block(1, 0, 0, [(np.full(200, 5), w[::-1])]))
    assert one[0]["weights"] == other[0]["weights"]


def test_driver_queries_write_no_graph(spark, monkeypatch):
    """the pairs of works go into the blocks without an exchange by pair or a table of edges."""
    monkeypatch.setattr(driver_views, "coded_graph", None)
    for name in ("label_propagation", "detect_communities", "resume_iterations"):
        assert driver_queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_rounds_go_on_with_the_blocks_that_are_there(spark, tmp_path, monkeypatch):
    """a run that goes on writes and counts no edges."""
    table = spark.createDataFrame([(f"A{a}", f"A{b}", w) for a, b, w in some_edges(30, 90, 3)], "src string, dst string, weight double")
    folder = f"file://{tmp_path}/rounds"
    iterate.label_rounds(table, folder, 1)
    built = []
    monkeypatch.setattr(iterate, "part_count", lambda rows: built.append(rows))
    monkeypatch.setattr(iterate, "numbered", lambda edges: built.append(edges))
    found = iterate.label_rounds(table, folder, 3)
    assert not built
    assert sorted(found.collect()) == sorted(community.propagate_labels(table, 3).collect())
