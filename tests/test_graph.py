import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peeratlas.jobs import iterate
from peeratlas.operators import community, edges, export, quantiles
from peeratlas.sources import snapshot
from peeratlas.sources.storage import bucketed, cut
from peeratlas.streaming.extract import extract_new_files

WORKS = "work_id string, n_authors int, author_ids array<string>"


def graph(spark, works, ids, max_authors=50):
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    found = edges.coauthor_edges(spark.createDataFrame(works, WORKS), nodes, max_authors).collect()
    return {(r.src, r.dst): round(r.weight, 9) for r in found}


@pytest.mark.parametrize(
    ("works", "ids", "expected"),
    [
        ([("W1", 3, ["A", "B", "C"])], "ABC", {("A", "B"): 0.5, ("A", "C"): 0.5, ("B", "C"): 0.5}),
        ([("W1", 2, ["A", "B"]), ("W2", 2, ["A", "B"])], "AB", {("A", "B"): 2.0}),
        ([("W1", 3, ["A", "B", "C"])], "AB", {("A", "B"): 0.5}),
        ([("W1", 1, ["A"])], "A", {}),
        ([("W1", 3, ["A", "A", "B"])], "AB", {("A", "B"): 0.5}),
        ([("W1", 2, ["A", "B"]), ("W1", 2, ["A", "B"])], "AB", {("A", "B"): 1.0}),
        ([("W1", 2, None), ("W2", None, ["A", "B"])], "AB", {}),
    ],
)
def test_coauthor_weights(spark, works, ids, expected):
    assert graph(spark, works, ids) == expected


@pytest.mark.parametrize(("authors", "count"), [(51, 0), (50, 1225)])
def test_works_with_too_many_authors_make_no_edges(spark, authors, count):
    ids = [f"A{i:02d}" for i in range(authors)]
    assert len(graph(spark, [("W", authors, ids)], ids)) == count


def test_numbering_is_dense_sorted_and_independent_of_partitions(spark):
    names = [f"A{i * 7919 % 1000}" for i in range(500)]
    nodes = spark.createDataFrame([(n,) for n in names], "id string")
    for parts in (1, 4, 37):
        found = edges.number_nodes(nodes.repartition(parts)).collect()
        assert [r.id for r in sorted(found, key=lambda r: r.node_idx)] == sorted(names)
        assert sorted(r.node_idx for r in found) == list(range(500))


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_many_wide_rows_are_numbered_whole(spark, tmp_path, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        wide = spark.range(300_000).select(F.concat(F.lit("A"), F.col("id") * 7919 % 300_007).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("name"), F.col("id").alias("n"))
        wide.repartition(6).write.parquet(str(tmp_path / "wide"))
        read = spark.read.parquet(str(tmp_path / "wide"))
        for table in (read, read.groupBy("id").agg(F.max("name").alias("name"), F.max("n").alias("n"))):  # also after a shuffle
            found = edges.number_nodes(table)
            rows, numbers, low, high = found.agg(F.count("*"), F.count_distinct("node_idx"), F.min("node_idx"), F.max("node_idx")).first()
            assert (rows, numbers, low, high) == (300_000, 300_000, 0, 299_999)
            order = found.orderBy("node_idx").select("id", "name").toPandas()
            expected = table.select("id", "name").toPandas().sort_values("id")
            assert order["id"].tolist() == expected["id"].tolist() and order["name"].tolist() == expected["name"].tolist()
        ordered = export.export_order_edges(read.select(F.col("id").alias("src"), F.col("name").alias("dst"), (F.col("n") % 1000).alias("weight"), "n"))
        got = ordered.orderBy("row").toPandas()
        assert got["row"].tolist() == list(range(300_000)) and got["weight"].is_monotonic_decreasing
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_repeated_works_leave_the_same_row_in_any_order(spark):
    rows = [("W", 2, ["c", "d"]), ("W", 2, ["b", "a"]), ("W", 2, ["a", "b"]), ("W", None, ["a", "a", "a"]), ("W", 1, None), ("V", None, None)]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        found = {r.work_id: (r.n_authors, r.author_ids) for r in edges.dedup_works(spark.createDataFrame(order, WORKS)).collect()}
        assert found == {"W": (2, ["a", "b"]), "V": (None, None)}


def test_edges_between_numbers_say_the_same(spark):
    works = spark.createDataFrame([("W1", 3, ["C", "A", "B"]), ("W2", 2, ["B", "C"]), ("W3", 2, ["A", "Z"])], WORKS)
    numbered = edges.number_nodes(spark.createDataFrame([(i,) for i in "CBAX"], "id string"))
    found = edges.coauthor_edges(works, numbered)
    assert [f.dataType.simpleString() for f in found.schema][:2] == ["int", "int"]
    named = {(r.src, r.dst): r.weight for r in edges.named_edges(found, numbered).collect()}
    assert named == {("A", "B"): 0.5, ("A", "C"): 0.5, ("B", "C"): 1.5}


@pytest.mark.parametrize("most", [10_000, 40])
def test_exact_percentiles_without_one_task(spark, most):
    import numpy as np

    rng = np.random.default_rng(1)
    for values in (rng.normal(size=3001), np.round(rng.normal(size=3000) * 3), np.concatenate([np.zeros(2990), 1e9 * rng.random(10)]), np.array([5.0])):
        table = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        shares = [0.0, 0.25, 0.5, 0.99, 0.9999, 1.0]
        assert np.allclose(quantiles.exact_quantiles(table, "v", shares, most, 50), np.quantile(values, shares), rtol=1e-12)
    assert quantiles.exact_quantiles(table.limit(0), "v", [0.5, 1.0]) == [None, None]


def test_share_of_authors_with_a_coauthor_near(spark):
    web = spark.createDataFrame([("a", 0.1, 0.1), ("b", 0.11, 0.1), ("c", 0.9, 0.9), ("d", None, None)], "id string, xw double, yw double")
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d")], "src string, dst string")
    assert tuple(export.near_coauthor_share(links, web).first()) == (3, pytest.approx(2 / 3))


def test_renumbered_edges_drop_light_ones(spark):
    nodes = spark.createDataFrame([("B",), ("A",), ("C",)], "id string")
    table = spark.createDataFrame([("A", "B", 2.0), ("B", "C", 0.25)], "src string, dst string, weight double")
    found = edges.renumber_edges(table, edges.number_nodes(nodes), 0.34)
    assert [tuple(r) for r in found.collect()] == [(0, 1, 2.0)]
    assert [f.dataType.simpleString() for f in found.schema] == ["int", "int", "float"]


def test_drawable_edges(spark):
    web = spark.createDataFrame([("A", 0.5, 0.5, False), ("B", 0.5005, 0.5, False), ("C", 0.9, 0.9, False), ("D", 0.5, 0.5, True)], "id string, xw double, yw double, is_ring boolean")
    table = spark.createDataFrame([("A", "B", 3.0), ("A", "C", 3.0), ("A", "B", 1.0), ("A", "D", 9.0)], "src string, dst string, weight double")
    assert edges.drawable_edges(table, web, 2, None, 768).count() == 1
    assert edges.drawable_edges(table, web, 1, 2, 768).count() == 1
    assert edges.drawable_edges(table, web, 2, None, 1e9).count() == 2


def test_modularity_of_two_triangles(spark):
    triples = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]
    table = spark.createDataFrame([(s, d, 1.0) for s, d in triples], "src string, dst string, weight double")
    labels = spark.createDataFrame([(n, int(n > "c")) for n in "abcdef"], "node string, label int")
    assert community.edge_modularity(table, labels).first()[0] == pytest.approx(2 * (3 / 7 - (7 / 14) ** 2))
    found = {r.node: r.label for r in community.propagate_labels(table, 3).collect()}
    assert len({found[n] for n in "abc"}) == 1


def test_rounds_resume_and_ignore_junk(spark, tmp_path):
    table = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], "src string, dst string, weight double")
    folder = f"file://{tmp_path}/rounds"
    assert iterate.latest_round(folder) is None
    once = iterate.label_rounds(table, folder, 1)
    (place,) = os.listdir(tmp_path / "rounds")
    for junk in ("round=x", "round=9", "other"):
        (tmp_path / "rounds" / place / junk).mkdir()
    assert iterate.latest_round(f"{folder}/{place}")[0] == 1
    written = os.path.getmtime(tmp_path / "rounds" / place / "round=1" / "_SUCCESS")
    assert iterate.label_rounds(table, folder, 2).count() == once.count() == 3
    assert os.path.getmtime(tmp_path / "rounds" / place / "round=1" / "_SUCCESS") == written
    assert len(os.listdir(tmp_path / "rounds")) == 1
    iterate.label_rounds(table, folder, 1, {"resolution": 2})
    assert len(os.listdir(tmp_path / "rounds")) == 2


AUTHOR = "id string, display_name string, works_count int, cited_by_count int, last_known_institutions array<struct<display_name:string>>, topics array<struct<display_name:string,field:struct<display_name:string>>>, updated_date string"


def test_authors_of_the_snapshot(spark, tmp_path):
    inst, topic = [("MIT",)], [("Topology", ("Mathematics",))]
    rows = [("A1", "x", 2, 1, inst, topic, "2026-01-01"), ("A2", "y", 5, 1, inst, topic, "2026-01-01"), ("A3", "z", 100, 1, [], None, "2026-01-02")]
    spark.createDataFrame(rows, AUTHOR).write.partitionBy("updated_date").parquet(str(tmp_path / "a"))
    authors = snapshot.read_authors(spark, str(tmp_path / "a"))
    found = {r.id: (r.institution, r.field) for r in snapshot.filter_authors(authors).collect()}
    assert found == {"A2": ("MIT", "Mathematics"), "A3": (None, None)}
    assert [r[0] for r in snapshot.list_partitions(authors).collect()] == ["2026-01-01", "2026-01-02"]


def test_incremental_extracts(spark, tmp_path):
    schema = "id string, authors_count int, authorships array<struct<author:struct<id:string>>>, updated_date string"
    one = [("W1", 2, [(("A1",),), (("A2",),)], "2026-01-01"), ("W2", 1, [], "2026-01-02")]
    root, out = str(tmp_path / "w"), str(tmp_path / "out")
    spark.createDataFrame(one, schema).write.partitionBy("updated_date").parquet(root)
    assert snapshot.extract_incremental(snapshot.read_works(spark, root), out) == ["2026-01-01", "2026-01-02"]
    assert snapshot.extract_incremental(snapshot.read_works(spark, root), out) == []
    for _ in range(2):
        extract_new_files(spark, root, str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    for place in (out, str(tmp_path / "s")):
        found = {r.work_id: (r.n_authors, r.author_ids) for r in spark.read.parquet(place).collect()}
        assert found == {"W1": (2, ["A1", "A2"]), "W2": (1, [])}


def test_samples_do_not_depend_on_partitions(spark):
    table = spark.range(1000).select(F.concat(F.lit("A"), "id").alias("id"), F.when(F.col("id") % 10 > 0, 1.0).alias("x"))
    first, again = (sorted(r.id for r in export.sample_rows(table.repartition(n), 50).collect()) for n in (2, 9))
    assert first == again and len(first) == 50


def planted(groups, size, seed):
    """Edges of groups of nodes, three of four within a group."""
    rng, pairs = random.Random(seed), set()
    for i in range(groups * size):
        for _ in range(6):
            j = rng.randrange(size) + i // size * size if rng.random() < 0.75 else rng.randrange(groups * size)
            if i != j:
                pairs.add((min(i, j), max(i, j)))
    return [(a, b, 1.0, 0) for a, b in sorted(pairs)]


def test_communities_reach_the_planted_modularity(spark):
    table = spark.createDataFrame(planted(8, 30, 1), "src long, dst long, weight double, label int")
    truth = spark.createDataFrame([(i, i // 30) for i in range(240)], "node long, label long")
    best = community.edge_modularity(table, truth).first()[0]
    labels = community.modularity_communities(table, buckets=4).cache()
    assert community.edge_modularity(table, labels).first()[0] >= 0.98 * best
    assert labels.count() == 240 and labels.where("label > node").count() == 0
    again = community.modularity_communities(table.repartition(3), buckets=2)
    assert again.exceptAll(labels).count() == 0


def test_communities_of_no_edges_and_of_edges_without_weight(spark):
    schema = "src long, dst long, weight double"
    assert community.modularity_communities(spark.createDataFrame([], schema)).count() == 0
    odd = spark.createDataFrame([(1, 2, 0.0), (3, 3, 5.0), (4, 5, 1.0), (6, 7, None)], schema)
    assert sorted(tuple(r) for r in community.modularity_communities(odd).collect()) == [(4, 4), (5, 4)]


def exchanges_over(df, column):
    """How often rows of a scan that holds this column are shuffled before they are summed."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    found = 0
    for n, line in enumerate(lines):
        if "FileScan" in line and column in line:
            at = depth(line)
            for above in reversed(lines[:n]):
                if depth(above) < at:
                    at = depth(above)
                    if "Aggregate" in above:
                        break
                    found += "Exchange" in above
    return found


def test_rounds_never_shuffle_the_edges(spark, tmp_path):
    table = spark.createDataFrame(planted(3, 20, 1), "src long, dst long, weight double, x int")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = bucketed(community.both_ways(table), "pairs", "other", 4, str(tmp_path / "pairs"))
        labels = cut(pairs.select("node").distinct().withColumn("label", F.col("node")), "labels")
        assert exchanges_over(community.vote_round(pairs, labels), "weight") == 0
        assert exchanges_over(community.vote_round(cut(pairs, "plain"), labels), "weight") == 1
        taken = bucketed(community.both_ways(table).where("false"), "pairs", "other", 4, str(tmp_path / "pairs"))
        assert taken.count() == 2 * table.count()  # written before, so taken as it is
        assert exchanges_over(community.vote_round(taken, labels), "weight") == 0
        graph = bucketed(pairs.selectExpr("node", "other", "1L AS w", "6L AS degree"), "graph", "other", 4)
        state = bucketed(labels.selectExpr("node", "label AS community", "6L AS degree", "6L AS total", "true AS open"), "state", "node", 4)
        assert exchanges_over(community.move_choices(graph, state, 100), "w#") == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_all_ranks_are_found_in_four_passes(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-200, 200, size=3000), [0.0, -0.0, np.inf, -np.inf], np.repeat(7.5, 900)])
    y = rng.integers(0, 5, size=len(x)).astype(float)
    table = spark.createDataFrame([(float(a), None if n % 3 == 0 else float(b)) for n, (a, b) in enumerate(zip(x, y, strict=True))], "x double, y double").repartition(5)
    shares = [0.001, 0.2, 0.5, 0.7, 0.75, 0.999]
    passes = []
    kind = type(table)
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **k: passes.append(1) or real(self, *a, **k))
    found = quantiles.exact_quantiles_of(table, {"x": shares, "y": shares}, most=10)
    assert len(passes) == 4
    assert np.allclose(found["x"], np.quantile(x, shares), rtol=1e-12)
    assert found["y"] == np.quantile([b for n, b in enumerate(y) if n % 3], shares).tolist()
    assert all(quantiles.value_of(int(quantiles.image(np.array([v]))[0])) == v for v in (0.0, -1.5, 1e300, -np.inf))
