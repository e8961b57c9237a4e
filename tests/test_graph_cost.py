"""What the graph's queries read, sort and shuffle."""

from pyspark.sql import functions as F

from peeratlas.functions.expressions import code_id, id_code
from peeratlas.operators import community, edges, export
from peeratlas.sources.storage import bucketed, buckets_for, cut

TABLE = [("A1", "A2", 1.0), ("A2", "A30", 2.0), ("A1", "A30", 0.5)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_codes_keep_the_order_of_ids_and_give_them_back(spark):
    ids = ["A0", "A1", "A10", "A100", "A11", "A2", "A20", "A9", "A99999999999999999", "A12345678901234567"]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").withColumn("code", id_code("id"))
    found = rows.withColumn("again", code_id("code")).collect()
    assert all(r.id == r.again for r in found)
    assert [r.id for r in sorted(found, key=lambda r: r.code)] == sorted(ids)


def test_pairs_of_listed_authors(spark):
    """a row per authorship is shuffled by author and by work, without a further distinct."""
    rows = spark.createDataFrame([("W1", 1), ("W1", 2), ("W1", 2), ("W1", 3), ("W2", 1), ("W3", 1), ("W3", 9)], "work_id string, author int")
    chosen = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "author int, author_id int")
    lists = edges.selected_lists(rows, chosen, 4)
    assert {r.work_id: (r.n_authors, sorted(r.author_ids)) for r in lists.collect()} == {"W1": (4, [10, 20, 30]), "W3": (2, [10])}
    found = sorted((r.work_id, r.src, r.dst, round(r.w, 6)) for r in edges.author_pairs(lists).collect())
    assert found == [("W1", 10, 20, 0.333333), ("W1", 10, 30, 0.333333), ("W1", 20, 30, 0.333333)]


def test_edges_are_read_once(spark):
    """the edges of a query need no table of their own."""
    table = cut(spark.createDataFrame(TABLE, "src string, dst string, weight double"), "edges")
    labels = spark.createDataFrame([("A1", 1), ("A2", 1), ("A30", 2)], "node string, label int")
    web = spark.createDataFrame([("A1", 0.1, 0.1), ("A2", 0.11, 0.1), ("A30", 0.9, 0.9)], "id string, xw double, yw double")
    for found in (community.edge_modularity(table, labels), community.weighted_degree(table), export.near_coauthor_share(table, web)):
        assert plan(found).count("FileScan") == 1


def test_rounds_of_votes_sort_no_edges(spark):
    """one sort a round, of the sums by node, and none before an exchange."""
    table = spark.createDataFrame(TABLE, "src string, dst string, weight double")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = bucketed(community.both_ways(table), "pairs", "other", 4)
        labels = cut(pairs.select("node").distinct().withColumn("label", F.col("node")), "labels")
        text = plan(community.vote_round(pairs, labels))
        assert "SortMergeJoin" not in text and sum(" Sort [" in line for line in text.splitlines()) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_small_tables_have_few_buckets(spark):
    """a task a bucket writes a block for each partition of the next shuffle."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert buckets_for(10) == spark.sparkContext.defaultParallelism
        assert buckets_for(50_000_000) == 100 and buckets_for(10**10) == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_communities_of_codes_are_those_of_ids(spark):
    """communities are drawn by the ids, so codes give the same result."""
    ring = [(i, (i + k) % 24, 1.0 + (i // 8 == (i + k) % 24 // 8)) for i in range(24) for k in (1, 2, 3)]
    rows = spark.createDataFrame([(f"A{a}", f"A{b}", w) for a, b, w in ring], "src string, dst string, weight double")
    coded = rows.withColumns({"src": id_code("src"), "dst": id_code("dst")})
    plain = community.modularity_communities(rows, 2, 3, 3, buckets=2)
    found = community.modularity_communities(coded, 2, 3, 3, buckets=2, text=code_id)
    assert sorted(map(tuple, found.select(code_id("node"), code_id("label")).collect())) == sorted(map(tuple, plain.collect()))


def test_lines_write_no_graph(spark, monkeypatch):
    """F5, F8: edges are drawn from codes and never written with ids."""
    from peeratlas.jobs import driver_queries, driver_views

    written = []
    monkeypatch.setattr(driver_views, "cut", lambda df, name: written.append(name) or cut(df, name))
    driver_queries.QUERIES["drawable_edges"](spark, "/root/testdata/sf0.001")
    assert "graph" not in written and "web" in written
