"""The stages one after the other, from a snapshot to the files that serve the map."""

import json
import math
import os

import numpy as np
import pytest

from peeratlas.jobs import stages

AUTHOR = "id string, display_name string, works_count int, cited_by_count int, last_known_institutions array<struct<display_name:string>>, topics array<struct<display_name:string,field:struct<display_name:string>>>, updated_date string"
WORK = "id string, authors_count int, authorships array<struct<author:struct<id:string>>>, updated_date string"


def works(spark, root, rows):
    spark.createDataFrame([(w, n, [((a,),) for a in ids], "2026-01-01") for w, n, ids in rows], WORK).write.partitionBy("updated_date").parquet(root)


def test_from_snapshot_to_weighted_edges(spark, tmp_path):
    """Two days of records: a work that stands in both, one over the author limit, one whose
    authors were mostly left out, and authors on either side of the least number of works."""
    people = [(f"A{i}", f"Person {i}", works_, 10 * i, [], [], "2026-03-0" + "12"[i % 2]) for i, works_ in enumerate([7, 6, 4, 9, 5, 30, 2])]
    spark.createDataFrame(people, AUTHOR).write.partitionBy("updated_date").parquet(f"{tmp_path}/people")
    crowd = [f"A{i}" for i in range(7)]
    papers = [("P1", 4, ["A0", "A1", "A3", "X9"], "2026-03-01"), ("P2", 2, ["A3", "A5"], "2026-03-01"), ("P3", 7, crowd, "2026-03-02"), ("P2", 2, ["A3", "A5"], "2026-03-02"), ("P4", 3, ["A2", "A6", "A0"], "2026-03-02"), ("P5", 5, ["A5", "A3", "A4", "A1", "A6"], "2026-03-02")]
    spark.createDataFrame([(w, n, [((a,),) for a in ids], day) for w, n, ids, day in papers], WORK).write.partitionBy("updated_date").parquet(f"{tmp_path}/papers")
    assert stages.run_extract(spark, f"{tmp_path}/papers", f"{tmp_path}/lists") == ["2026-03-01", "2026-03-02"]
    assert stages.run_filter(spark, f"{tmp_path}/people", f"{tmp_path}/kept", 5) == 5  # not A2, A6
    assert stages.run_edges(spark, f"{tmp_path}/lists", f"{tmp_path}/kept", f"{tmp_path}/links", 6) == 8
    found = {(r.src, r.dst): round(r.weight, 9) for r in spark.read.parquet(f"{tmp_path}/links").collect()}
    third, quarter = round(1 / 3, 9), 0.25
    assert found == {("A0", "A1"): third, ("A0", "A3"): third, ("A1", "A3"): round(1 / 3 + quarter, 9), ("A3", "A5"): 1.25, ("A4", "A5"): quarter, ("A1", "A5"): quarter, ("A3", "A4"): quarter, ("A1", "A4"): quarter}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """60 authors in two groups of collaborators, and one without a coauthor."""
    root = tmp_path_factory.mktemp("map")
    topic = lambda t: [(t, ("Field",))]
    authors = [(f"A{i}", f"Anna Numero{chr(97 + i % 26)} Smith{i}", 20 + i, 1000 * i, [("Inst",)], topic("Optics" if i < 30 else "Algebra"), "2026-01-01") for i in range(61)]
    spark.createDataFrame(authors, AUTHOR).write.partitionBy("updated_date").parquet(f"{root}/authors")
    pairs = [(i, 30 * (i // 30) + (i + k) % 30) for i in range(60) for k in (1, 2, 3) for _ in range(3)]
    works(spark, f"{root}/works", [(f"W{n}", 2, [f"A{a}", f"A{b}"]) for n, (a, b) in enumerate(pairs)])
    names = sorted(f"A{i}" for i in range(61))
    spots = [(names.index(f"A{i}"), 10.0 * (1 if i < 30 else -1) + math.cos(i), math.sin(i)) for i in range(60)]
    spark.createDataFrame(spots, "vertex int, x float, y float").write.parquet(f"{root}/positions")
    report = stages.run_map(spark, f"{root}/works", f"{root}/authors", f"{root}/positions", f"file://{root}/out", big=4, ring_comm_max=0, lowest=8)
    return root / "out", report


def test_graph_tables(spark, built):
    out, report = built
    nodes = spark.read.parquet(f"{out}/graph/nodes_int32").collect()
    assert [r.node_idx for r in nodes] == list(range(61)) and [r.id for r in nodes] == sorted(r.id for r in nodes)
    assert report["prep"] == {"nodes": 61, "edges": 180} and report["edges"] == 180
    assert [f.dataType.simpleString() for f in spark.read.parquet(f"{out}/graph/edges_int32").schema] == ["int", "int", "float"]
    assert json.loads((out / "communities" / "communities.json").read_text())["modularity"] == report["communities"]["modularity"]
    assert report["web"]["n"] == 61 and set(report["web"]) == {"n", "cx", "cy", "s", "r2max", "ring_n", "spread"}


def test_exports_stand_in_one_order(spark, built):
    out, report = built
    records = lambda name, kind: np.frombuffer((out / "export" / name).read_bytes(), kind)
    ids, spots = records("ids.bin", "<u8"), records("positions.bin", "<u2").reshape(-1, 2) / 65535
    assert ids.tolist() == list(range(59, -1, -1))  # the one without a coauthor has no place
    web = {int(r.id[1:]): (r.xw, r.yw) for r in spark.read.parquet(f"{out}/coords_web").where("xw is not null").collect()}
    for i, spot in zip(ids.tolist(), spots, strict=True):
        if i in web:
            assert np.abs(spot - web[i]).max() <= 1 / 65535
    meta = json.loads((out / "export" / "meta.json").read_text())
    assert meta["generated_from"].endswith("coords_web") and meta["filters"] == {"is_ring": False, "sample": None}
    assert meta["count"] == meta["ids"]["count"] == len(ids) and meta["files"] == {"positions": "positions.bin", "attrs": "attrs.bin"}
    edges = json.loads((out / "export" / "edges_meta.json").read_text())
    assert edges["count"] == 180 == len(records("edges_pos.bin", "<u2")) // 4 and "pos_top" not in edges["files"]
    more = stages.run_export_edges(spark, f"{out}/edges", f"{out}/coords_web", f"file://{out}/export2", 2, 20, companion_bytes=100, companion_edges=7)
    assert more["top_cap_edges"] == 7 and len(records("../export2/edges_attr_top.bin", "u1")) == 7 * 8
    assert records("../export2/edges_pos_top.bin", "<u2").tolist() == records("../export2/edges_pos.bin", "<u2").tolist()[:28]


def test_index_documents(spark, built):
    out, report = built
    site = out / "site"
    shards = {p.stem: json.loads(p.read_text()) for p in (site / "search").iterdir()}
    assert {e[2] for rows in shards.values() for e in rows} == {f"A{i}" for i in range(61)}
    assert [e[5] for e in shards["an"]] == sorted((e[5] for e in shards["an"]), reverse=True)
    ids = {k: v for p in (site / "ids").iterdir() for k, v in json.loads(p.read_text()).items()}
    assert len(ids) == 61 and all(v is None or v == round(v, 6) for at in ids.values() for v in at)
    lists = json.loads((site / "lists" / "top_authors" / "top_authors.json").read_text())
    assert [e[1] for e in lists[-3:]] == ["A2", "A1", "A0"] and len(lists) == 61
    assert json.loads((site / "boundaries.json").read_text())["type"] == "FeatureCollection"
    named = {r["name"] for r in json.loads((site / "regions.json").read_text())}
    assert {"Optics", "Algebra"} <= named
    assert report["index"]["labels"] > 0 and json.loads((site / "legend.json").read_text())


def test_tiles_are_drawn_once(spark, built):
    out, report = built
    drawn = {int(p.name): sum(1 for _ in p.rglob("*.png")) for p in (out / "site" / "tiles").iterdir()}
    assert drawn == report["tiles"] and set(drawn) == {8, 9, 10} and drawn[8] > 1
    first = next((out / "site" / "tiles" / "9").rglob("*.png"))
    os.remove(first)
    again = stages.run_tiles(spark, f"{out}/coords_web", f"file://{out}/site", f"{out}/edges_px", None, f"file://{out}/site/regions.json", big=4, lowest=8)
    assert again == {8: 0, 9: 1, 10: 0} and first.exists()


def test_topics_of_authors_once(spark):
    from peeratlas.operators import regions

    web = spark.createDataFrame([("A", 1)], "id string, community int")
    authors = spark.createDataFrame([("A", [("old",)], "1"), ("A", [("new",)], "2")], "id string, topics array<struct<display_name:string>>, updated_date string")
    topics = lambda once: sorted(r.topic for r in regions.member_topics(web, authors, web, once).collect())
    assert topics(False) == ["new", "old"] and topics(True) == ["new"]


def test_command_line_names_all_stages():
    with pytest.raises(SystemExit):
        stages.main(["--help"])
    assert {"extract", "filter", "edges", "prep", "webcoords", "edgepx", "tiles", "regions", "index", "export_points", "export_ids", "export_edges", "map"} <= set(stages.STAGES)
