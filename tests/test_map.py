import json
import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from peeratlas.functions.expressions import byte_of, id_number
from peeratlas.functions.names import normalize_name
from peeratlas.operators import boundary, community, coords, export, index, raster, regions
from peeratlas.sources import sinks
from peeratlas.sources.storage import cut

COORDS = "id string, display_name string, x double, y double, community int, works_count int, cited_by_count int, institution string, field string"
WEB = "id string, display_name string, xw double, yw double, community int, works_count int, cited_by_count int, institution string, field string, is_ring boolean"


def layout(spark, points):
    return spark.createDataFrame([(f"A{i}", f"n{i}", float(x), float(y), c, 1, 1, None, None) for i, (x, y, c) in enumerate(points)], COORDS)


def web(spark, rows):
    """rows of (id, xw, yw, community, cited, is_ring)"""
    return spark.createDataFrame([(i, f"Name {i}", float(x), float(y), c, 1, n, None, None, ring) for i, x, y, c, n, ring in rows], WEB)


def test_transform_keeps_angles_and_order(spark):
    points = [(0, 0, 1), (10, 0, 1), (-10, 0, 1), (0, 10, 1), (0, -10, 1), (1000, 0, 1), (0, -1000, 1)]
    found = {r.id: (r.xw, r.yw) for r in coords.web_coords(layout(spark, points), ring_comm_max=0).collect()}
    assert all(0.02 - 1e-9 <= v <= 0.98 + 1e-9 for p in found.values() for v in p)
    radius = {i: math.dist(p, (0.5, 0.5)) for i, p in found.items()}
    assert radius["A0"] < radius["A1"] < radius["A5"] < 10 * radius["A1"]
    assert math.atan2(found["A6"][1] - 0.5, found["A6"][0] - 0.5) == pytest.approx(-math.pi / 2)
    stats = coords.transformed(layout(spark, points), ring_comm_max=0)[1].first()
    assert set(stats.asDict()) == {"n", "cx", "cy", "s", "r2max", "ring_n", "spread"} and stats.ring_n == 0


def test_dust_goes_to_the_ring(spark):
    core = [(math.cos(i) * (1 + i % 10), math.sin(i) * (1 + i % 10), 1) for i in range(150)]
    table = layout(spark, core + [(5000, 0, 2), (0, 5000, 2), (1, 1, 3), (2, 1, 3)])
    first, again = ({r.id: (r.xw, r.yw, r.is_ring) for r in coords.web_coords(t).collect()} for t in (table, table.repartition(5)))
    assert first.keys() == again.keys() and all(first[k] == pytest.approx(again[k]) for k in first)
    dust = [k for k, v in first.items() if v[2]]
    assert sorted(dust) == ["A150", "A151"]
    assert all(0.60 <= math.dist(first[k][:2], (0.5, 0.5)) / 0.48 < 0.98 for k in dust)


def test_missing_positions_stay_missing(spark):
    table = layout(spark, [(i % 7, i % 5, 1) for i in range(150)]).union(spark.createDataFrame([("N", "n", None, None, 1, 1, 1, None, None)], COORDS))
    found = coords.web_coords(table)
    assert found.where("id = 'N' and xw is null").count() == 1 and found.count() == 151


def test_pixels_pyramid_and_tiles(spark):
    table = web(spark, [("a", 0.25, 0.25, 1, 1, False), ("b", 0.25, 0.25, 1, 1, True), ("c", 0.25, 0.25, 2, 1, False), ("d", 0.75, 0.75, 2, 1, False), ("e", 1.0, 0.0, 3, 1, False)])
    pixels = raster.pixel_majority(table)
    assert sorted((r.cnt, r.community) for r in pixels.collect()) == [(1, 2), (1, 3), (3, 1)]
    levels = raster.pyramid(pixels).cache()
    assert {r.z: r["sum(cnt)"] for r in levels.groupBy("z").sum("cnt").collect()} == {z: 5 for z in range(11)}
    assert levels.where("z = 0").select(F.max("px")).first()[0] < 256
    placed = {(r.tx, r.ty) for r in raster.tile_xyz(levels.where("z = 1").drop("z"), 1).collect()}
    assert placed == {(0, 1), (1, 0), (1, 1)}


def test_pyramid_ties(spark):
    level = spark.createDataFrame([(0, 1, 5, 7), (1, 0, 5, 8)], "px int, py int, cnt long, community int")
    assert raster.pyramid_level(level, True).first().community == 8  # by row first
    assert raster.pyramid_level(level).first().community == 7  # by column first


def test_splats(spark):
    table = web(spark, [("a", 0.5001, 0.5001, 1, 6_000, False), ("b", 0.5002, 0.6002, 1, 100_000, False), ("c", 0.3003, 0.3003, 1, 250_000, False), ("d", 0.1, 0.1, 1, 100, False), ("e", 0.1, 0.1, 1, 999_999, True)])
    splats = raster.splat_tiers(table)
    assert {r.id: r.rad0 for r in splats.collect()} == {"a": 1, "b": 2, "c": 3}
    assert {r.id for r in raster.splat_radius_at_zoom(splats, 9).collect()} == {"b", "c"}
    assert raster.splat_radius_at_zoom(splats, 8).count() == 0
    palette = spark.createDataFrame([(1, 1.0, 0.5, 0.25)], "community int, r double, g double, b double")
    sizes = {r.id: raster.splat_pixels(splats.where(F.col("id") == r.id), palette, 10).count() for r in splats.collect()}
    assert sizes == {"a": 5, "b": 13, "c": 29}


def test_edge_layer_and_glow(spark):
    lines = spark.createDataFrame([(0, 0, 40, 0)] * 4 + [(8, 8, 8, 8)], "x0 int, y0 int, x1 int, y1 int")
    tiles = spark.createDataFrame([(0, 255)], "tx int, ty int")
    found = {(r.ix, r.iy): r.alpha for r in raster.edge_pixels(lines, tiles, 8, 0.08).collect()}
    assert found[(2, 253)] == pytest.approx(0.16)  # a line without length has two samples
    assert found[(5, 255)] == pytest.approx(0.32)
    sums = spark.createDataFrame([(0, 255, 5, 255, 0.32)], "tx int, ty int, ix int, iy int, alpha double")
    assert raster.edge_layer(sums).first().b == pytest.approx(0.15)
    one = spark.createDataFrame([(0, 0, 0, 128, 1.0, 1.0, 1.0)], "tx int, ty int, ix int, iy int, r double, g double, b double")
    assert sorted(round(r.r, 2) for r in raster.bloom(one).collect()) == [0.06, 0.06, 0.12, 0.12, 0.12]


def test_images_are_png(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 3, 4, 255, 128, 0)], "tx int, ty int, ix int, iy int, r int, g int, b int")
    body = bytes(raster.render_tiles(rows).first().png)
    assert body[:8] == b"\x89PNG\r\n\x1a\n"
    raw = zlib.decompress(body[41 : 41 + int.from_bytes(body[33:37], "big")])
    image = np.frombuffer(raw, np.uint8).reshape(256, 769)[:, 1:].reshape(256, 256, 3)
    assert image[4, 3].tolist() == [255, 128, 0] and image.sum() == 383


def test_colors(spark):
    stats = spark.createDataFrame([(1, 2000, 0.9, 0.5), (2, 2000, 0.5, 0.9), (3, 10, 0.1, 0.1)], "community int, members long, cx double, cy double")
    import colorsys

    found = {r.community: colorsys.rgb_to_hls(r.r, r.g, r.b) for r in community.community_palette(stats).collect()}
    for c, hue in ((1, 0), (2, 90)):
        h, light, s = found[c]
        assert (h * 360 - hue + 180) % 360 - 180 == pytest.approx(0, abs=8.01) and 0.62 <= s <= 0.78 and 0.50 <= light <= 0.66
    assert found[3][2] == pytest.approx(0.03) and 0.24 <= found[3][1] <= 0.36
    fields = spark.createDataFrame([(5, "Medicine"), (5, "Nowhere"), (5, None)], "community int, field string")
    rows = {r.field: (r.r, r.g, r.b) for r in community.field_palette(fields).collect()}
    assert rows["Nowhere"] == rows[None] and rows["Medicine"][0] > rows["Medicine"][1]


def test_majority_field(spark):
    rows = [("Medicine", 1)] * 6 + [("Chemistry", 1)] * 4 + [("Medicine", 2)] * 5 + [("Chemistry", 2)] * 5 + [("Medicine", 3)] * 2 + [(None, 3)] * 8 + [("Zoo", 4), (None, 4)]
    table = spark.createDataFrame([(c, f, 0.5, 0.5) for f, c in rows], "community int, field string, xw double, yw double")
    assert {r.community: r.majority_field for r in community.community_stats(table).collect()} == {1: "Medicine", 2: "Chemistry", 3: None, 4: "Zoo"}


def test_labels_and_rosters(spark):
    table = web(spark, [(f"R{i:03d}", 0.7305, 0.2205, 5, 3 * i, i % 100 == 99) for i in range(430)] + [("edge", 0.02, 0.98, 6, 8, False)])
    labels = index.label_tiles(table)
    near = {r.z: r["count"] for r in labels.where("id <> 'edge'").groupBy("z").count().collect()}
    assert near == {6: 50, 7: 50, 8: 200, 9: 426}  # dust has no label
    first = labels.where("z = 7 and id <> 'edge'").orderBy("rn").first()
    assert (first.id, first.tx, first.ty) == ("R429", 93, 99)
    stats = community.community_stats(table)
    roster = index.community_roster(table.where("id >= 'R398'"), stats, 4, 300).orderBy("rn").collect()
    assert [(r.id, r.community) for r in roster] == [("R429", 5), ("R428", 5), ("R427", 5), ("R426", 5)]
    assert index.community_roster(table, stats, 4, 431).count() == 0
    assert [r.id for r in index.top_authors(table.where("id < 'R401'"), 3).collect()] == ["R400", "R398", "R397"]


def test_names_and_shards(spark):
    names = ["Fatima Haddad", "farid okafor", "李明", "Björn  Sjö-Håkansson", "Hypatia", "Kano Kano", "Ines V", "", None, "D'Arco"]
    table = spark.createDataFrame([(f"A{i}", n, 0.5, 0.5, 100 - i) for i, n in enumerate(names)], "id string, display_name string, xw double, yw double, cited_by_count int")
    norm = [r[0] for r in table.orderBy("cited_by_count").select(normalize_name("display_name")).collect()][::-1]
    assert norm == ["fatima haddad", "farid okafor", "李明", "bjorn sjo hakansson", "hypatia", "kano kano", "ines v", "", "", "d arco"]
    entries = index.name_entries(table)
    tokens = {}
    for r in entries.collect():
        tokens.setdefault(r.id, set()).add(r.token)
    assert tokens["A0"] == {"fatima", "haddad"} and tokens["A5"] == {"kano"} and tokens["A6"] == {"ines"} and tokens["A7"] == {""}
    whole = {(r.id, r.token): r.shard for r in index.search_shards(entries).collect()}
    assert whole["A0", "haddad"] == "ha" and whole["A2", "李明"] == "_" and whole["A9", "d"] == "_"
    split = index.search_shards(entries, 100)
    keys = {(r.id, r.token): r.shard for r in split.collect()}
    assert keys["A0", "fatima"] == "fat" and keys["A1", "farid"] == "far" and keys["A2", "李明"] == f"_{ord('李') % 128}" and keys["A7", ""] == "_"
    assert {r.id for r in split.collect()} == {f"A{i}" for i in range(len(names))}
    assert {r.shard: r.entries for r in index.shard_sizes(split).collect()}["fa"] == 0
    asked = spark.createDataFrame([("fa",), ("Haddad",), ("sjo",), ("bjorn hak",), ("李",), ("nobody",)], "query string")
    hits = {}
    for r in index.search_lookup(asked, index.search_shards(entries)).orderBy("query", "rn").collect():
        hits.setdefault(r.query, []).append(r.id)
    assert hits == {"fa": ["A0", "A1"], "Haddad": ["A0"], "bjorn hak": ["A3"], "李": ["A2"]}


def test_id_shards(spark):
    table = spark.createDataFrame([("https://x/A123963", 0.1234567, 0.5), ("A913", 0.1, 0.2), ("none", 0.1, 0.2)], "id string, xw double, yw double")
    found = {r.id: (r.shard, r.xw) for r in index.id_shards(table).collect()}
    assert found == {"https://x/A123963": (963, 0.123457), "A913": (913, 0.1), "none": (0, 0.1)}


def test_region_names(spark):
    topics = [(1, "common")] * 10 + [(1, "one")] * 9 + [(2, "common")] * 8 + [(2, "two")] * 5 + [(3, "common")] * 3
    table = web(spark, [(f"A{i}", 0.5, 0.5, c, 1, False) for i, (c, _) in enumerate(topics)])
    authors = spark.createDataFrame([(f"A{i}", [(t,)]) for i, (_, t) in enumerate(topics)] + [("A0x", [])], "id string, topics array<struct<display_name:string>>")
    found = {r.community: r for r in regions.regions(table, authors).collect()}
    assert found[1].name == "one" and found[2].name == "two" and found[3].name == "common"
    assert [found[c]["rank"] for c in (1, 2, 3)] == [1, 2, 3] and found[1].zmin == 2 and found[1].zmax == 4
    top = spark.createDataFrame([(c, c) for c in range(1, 4)], "community int, rank int")
    ranked = spark.createDataFrame([(1, "t", 1), (2, "t", 1)], "community int, topic string, rn int")
    assert {r.community: r.name for r in regions.region_names(top, ranked).collect()} == {1: "t", 2: "t (2)", 3: "Unnamed (3)"}


def grid(spark, values):
    return spark.createDataFrame([(x, y, c) for x, column in enumerate(values) for y, c in enumerate(column) if c is not None], "cx int, cy int, community int")


def test_smoothing(spark):
    one = boundary.smooth_majority(grid(spark, [[1, 1, 1], [1, 2, 1], [1, 1, 1]]))
    assert {r.community for r in one.collect()} == {1}
    tie = boundary.smooth_majority(grid(spark, [[1, None, None], [None, 2, None], [None, None, 3]]))
    assert tie.where("cx = 1").first().community == 2


def test_boundary_of_two_halves(spark):
    cells = grid(spark, [[1] * 4] * 2 + [[2] * 4] * 2)
    (run,) = boundary.boundary_runs(cells, 4).collect()
    assert (run.dir, run.line, run.a, run.b) == ("h", 2, 0, 4)
    (seg,) = boundary.segments(boundary.boundary_runs(cells, 4), 4).collect()
    assert (seg.x0, seg.y0, seg.x1, seg.y1) == (0.5, 0.0, 0.5, 1.0)


def test_short_boundaries_are_dropped(spark):
    rows = [(f"A{x}-{y}", (x + 0.5) / 20, (y + 0.5) / 20, 3 if (x, y) == (3, 3) else 1 if x < 10 else 2, 1, False) for x in range(20) for y in range(20)]
    found = boundary.boundary_polylines(web(spark, rows), 20, 1, 0, 0.25)
    (line,) = found.collect()
    assert line.points[0] == [0.5, 0.0] and line.points[-1] == [0.5, 1.0] and line.length == pytest.approx(1)
    shape = boundary.boundary_document(found)
    assert shape["features"][0]["geometry"] == {"type": "MultiLineString", "coordinates": [[[0.5, 0.0], [0.5, 1.0]]]}
    ring = max(boundary.boundary_polylines(web(spark, rows), 20, 1, 0, 0).collect(), key=lambda r: len(r.points))
    assert ring.points[0] == ring.points[-1] == [0.15, 0.15] and ring.length == pytest.approx(0.2)


def test_paths_and_corners():
    lines = np.array([[(0, 0), (0, 1)], [(0, 1), (1, 1)], [(1, 0), (0, 0)]], float)
    assert boundary.path_points(lines).tolist() == [[1, 0], [0, 0], [0, 1], [1, 1]]
    square = np.array([[(1, 1), (0, 1)], [(0, 0), (1, 0)], [(1, 0), (1, 1)], [(0, 1), (0, 0)]], float)
    assert boundary.path_points(square).tolist() == [[0, 0], [0, 1], [1, 1], [1, 0], [0, 0]]
    corner = np.array([(0, 0), (1, 0), (1, 1)], float)
    assert boundary.cut_corners(corner[:2]).tolist() == corner[:2].tolist()
    assert boundary.cut_corners(corner, 1).tolist() == [[0, 0], [0.25, 0], [0.75, 0], [1, 0.25], [1, 0.75], [1, 1]]


def test_binary_records_in_order(spark, tmp_path):
    table = web(spark, [(f"A{i}", i / 9, 1 - i / 9, 1, i * 60_000, i == 9) for i in range(10)])
    stats = community.community_stats(table)
    points = export.export_order_points(table)
    records = export.quantize_points(points, community.color_lut(stats))
    parts = sinks.write_binary(records, f"file://{tmp_path}/pos", {"x": "u2", "y": "u2"}, rows_a_part=4).collect()
    assert sorted((r.part, r.records) for r in parts) == [(0, 4), (1, 4), (2, 1)]
    body = (tmp_path / "pos").read_bytes()
    x = np.frombuffer(body, "<u2").reshape(-1, 2)[:, 0] / 65535
    assert np.abs(x - np.arange(8, -1, -1) / 9).max() <= 1 / 65535
    assert [r.number for r in export.id_numbers(points).orderBy("row").collect()] == list(range(8, -1, -1))
    sizes = {r.id: r.s for r in records.collect()}
    assert sizes["A0"] == 0 and sizes["A8"] == round(math.sqrt(480_000) / 700 * 255)


def test_malformed_id_is_an_error(spark):
    with pytest.raises(Exception, match="malformed author id"):
        spark.createDataFrame([("W12",)], "id string").select(id_number("id")).collect()


def test_bytes_round_half_to_even(spark):
    found = spark.createDataFrame([(0.5,), (1.5,), (-3.0,), (300.0,)], "v double").select(byte_of(F.col("v")).alias("b")).collect()
    assert [r.b for r in found] == [0, 2, 0, 255]


def test_shards_documents_and_images_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, "y", None), ("a", 1, "x", 1.5), ("b", 1, "ü", 2.0)], "k string, rn int, name string, v double")
    folder = f"file://{tmp_path}/shards"
    (tmp_path / "shards").mkdir()
    (tmp_path / "shards" / "stale.json").write_text("[]")
    assert {r.entries for r in sinks.write_json_shards(rows, folder, ["k"], ["rn"], ["name", "v"]).collect()} == {1, 2}
    assert sorted(os.listdir(tmp_path / "shards")) == ["a.json", "b.json"]
    assert json.loads((tmp_path / "shards" / "a.json").read_text()) == [["x", 1.5], ["y", None]]
    assert sinks.write_json_doc(rows, f"file://{tmp_path}/doc.json", ["k", "rn"]) == 3
    assert [r["name"] for r in json.loads((tmp_path / "doc.json").read_text())] == ["x", "y", "ü"]
    with pytest.raises(ValueError):
        sinks.write_json_doc(rows, f"file://{tmp_path}/doc.json", ["k"], most_rows=2)
    assert sinks.read_regions(spark, f"file://{tmp_path}/none.json").count() == 0
    more = spark.createDataFrame([("a",), ("c",)], "key string")
    assert {r.entries for r in sinks.write_json_shards(rows, folder, ["k"], ["rn"], ["name", "v"], named=True, empty=more).collect()} == {0, 1, 2}
    assert [json.loads((tmp_path / "shards" / f"{k}.json").read_text()) for k in "abc"] == [{"x": [1.5], "y": [None]}, {"ü": [2.0]}, {}]
    sinks.write_json(f"file://{tmp_path}/one.json", {"a": 1})
    assert sinks.read_json(spark, f"file://{tmp_path}/one.json") == {"a": 1} and sinks.read_json(spark, f"file://{tmp_path}/no.json") is None
    tiles = spark.createDataFrame([(0, 1, bytearray(b"png"))], "tx int, ty int, png binary")
    assert [[r.written for r in sinks.write_png_tiles(tiles, f"file://{tmp_path}/t", 3).collect()] for _ in range(2)] == [[True], [False]]
    two = spark.createDataFrame([(0, 1), (1, 1)], "tx int, ty int")
    assert [tuple(r) for r in sinks.tiles_without_image(two, f"file://{tmp_path}/t", 3).collect()] == [(1, 1)]
    assert sinks.write_table(rows, str(tmp_path / "table")) == 3


def test_lines_by_chunks_equal_all_samples(spark, monkeypatch):
    """Tiles with few chunks, and dense ones whose chunks are summed in several groups."""
    rng = np.random.default_rng(2)
    a, d = rng.integers(0, 3000, size=(400, 2)), rng.integers(-900, 900, size=(400, 2))
    d[:40] = 0
    ends = np.concatenate([a, np.clip(a + d, 0, 4000)], axis=1).tolist()
    lines = spark.createDataFrame([tuple(r) for r in ends], "x0 int, y0 int, x1 int, y1 int")
    want = {}
    for x0, y0, x1, y1 in ends:
        x0, y0, x1, y1 = x0 >> 1, y0 >> 1, x1 >> 1, y1 >> 1
        n = max(1, abs(x1 - x0), abs(y1 - y0))
        for px, py in zip(np.rint(x0 + np.arange(n + 1) * ((x1 - x0) / n)), np.rint(y0 + np.arange(n + 1) * ((y1 - y0) / n)), strict=True):
            key = (int(px) // 256, 511 - int(py) // 256, int(px) % 256, 255 - int(py) % 256)
            want[key] = want.get(key, 0) + 1
    tiles = sorted({k[:2] for k in want})
    occupied = spark.createDataFrame(tiles[::2], "tx int, ty int")
    for most in (raster.MOST_CHUNKS, 30):
        monkeypatch.setattr(raster, "MOST_CHUNKS", most)
        got = {(r.tx, r.ty, r.ix, r.iy): round(r.alpha) for r in raster.edge_pixels(lines, occupied, 9, 1.0).collect()}
        assert got == {k: v for k, v in want.items() if k[:2] in set(tiles[::2])}
    chunks = raster.edge_chunks(lines, 9)
    assert chunks.count() <= 4 * 400 * 4 and chunks.where("k1 - k0 >= 256").count() == 0


def test_a_zoom_is_one_exchange_by_tile(spark):
    web = spark.createDataFrame([(i, i / 100, i / 100, i % 3, 9_000, False) for i in range(1, 100)], "id int, xw double, yw double, community int, cited_by_count int, is_ring boolean")
    levels = cut(raster.pyramid(raster.pixel_majority(web), 9), "levels")
    palette = spark.createDataFrame([(0, 1.0, 0.5, 0.2)], "community int, r double, g double, b double")
    lines = spark.createDataFrame([(0, 0, 2000, 2000)], "x0 int, y0 int, x1 int, y1 int")
    drawn = raster.render_zoom(levels, palette, 9, raster.splat_tiers(web), lines)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(tx" in line for line in plan.splitlines()) == 1
    assert drawn.count() == 99


def test_lookups_equal_all_names(spark):
    """Prefixes of every width over thousands of tokens, against every name."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abc"), size=rng.integers(1, 9)))
    names = [" ".join(word() for _ in range(rng.integers(1, 4))) for _ in range(3000)]
    table = spark.createDataFrame([(f"A{i:04d}", n, 0.5, 0.5, int(rng.integers(0, 40))) for i, n in enumerate(names)], "id string, display_name string, xw double, yw double, cited_by_count int")
    cited = {r.id: r.cited_by_count for r in table.collect()}
    asked = ["a", "ab", "bca", "cc", "abcabc", "zz", "a b", "ab c", "b a a", "", *names[:25]]
    found = {}
    for r in index.search_lookup(spark.createDataFrame([(q,) for q in asked], "query string"), index.name_entries(table)).orderBy("query", "rn").collect():
        found.setdefault(r.query, []).append(r.id)
    for q in set(asked):
        words, hits = q.split(), []
        for i, n in enumerate(names):
            own, at = n.split(), 0
            ends = {own[0], own[-1]} if len(own[-1]) >= 2 else {own[0]}
            for w in own:
                at += at < len(words) and w.startswith(words[at])
            if words and at == len(words) and any(t.startswith(words[0]) for t in ends):
                hits.append((0 if n.startswith(q) else 1 if n.startswith(words[0]) else 2, -cited[f"A{i:04d}"], f"A{i:04d}"))
        assert found.get(q, []) == [h[2] for h in sorted(hits)[:12]], q


def test_blocks_make_up_their_range(spark):
    rows = [(a, b) for a in (-1, 0, 62, 63, 64, 700, 5000) for b in (0, 1, 64, 65, 900, 4097, 20_000) if a < b]
    table = spark.createDataFrame(rows, "low long, high long")
    for r in table.withColumn("b", index.blocks_of(F.col("low"), F.col("high"), 3)).collect():
        covered = [p for level, block in r.b for p in range(block * 64**level, (block + 1) * 64**level)]
        assert sorted(covered) == list(range(r.low + 1, r.high)) and len(r.b) < 3 * 128


def test_shards_are_written_to_the_byte(spark, tmp_path):
    rows = [("k/1", 3, 'say "hi"\n\x01', 0.25, None), ("k/1", 1, "Zoë 李 \\ /", 0.123456, 7), ("k/1", 2, None, 0.5, 10**12), ("j", 1, "", 0.75, 0)]
    table = spark.createDataFrame(rows, "key string, o int, name string, x double, n long")
    fields = ["name", "x", "n"]
    sized = {r.key: r.b for r in table.groupBy("key").agg(F.sum(sinks.json_bytes(fields)).alias("b")).collect()}
    done = sinks.write_json_shards(table, f"file://{tmp_path}/s", ["key"], ["o"], fields, empty=spark.createDataFrame([("none",), ("j",)], "key string"))
    assert sorted((os.path.basename(r.path), r.entries) for r in done.collect()) == [("1.json", 3), ("j.json", 1), ("none.json", 0)]
    text = (tmp_path / "s" / "k" / "1.json").read_text()
    assert text == json.dumps([list(r[2:]) for r in sorted(rows[:3], key=lambda r: r[1])], ensure_ascii=False)
    assert len(text.encode()) == sized["k/1"] and len((tmp_path / "s" / "j.json").read_bytes()) == sized["j"]
    assert (tmp_path / "s" / "none.json").read_text() == "[]" and not list((tmp_path / "s").rglob("*.part"))
    sinks.write_json_shards(table, f"file://{tmp_path}/m", ["key"], ["name", "o"], ["name", "n"], named=True).collect()
    assert json.loads((tmp_path / "m" / "k" / "1.json").read_text()) == {'say "hi"\n\x01': [None], "Zoë 李 \\ /": [7], "null": [10**12]}
    sinks.write_json_shards(table, f"file://{tmp_path}/w", ["key"], ["o"], ["n"], wrap="l").collect()
    assert (tmp_path / "w" / "j.json").read_text() == '{"l": [[0]]}'


@pytest.mark.parametrize("in_place", [True, False])
def test_binary_is_one_file_however_often_it_is_written(spark, tmp_path, in_place):
    table = spark.range(1000).selectExpr("id AS row", "id * 7 AS x", "id % 200 AS b").repartition(5)
    path = f"file://{tmp_path}/d/x.bin"
    for _ in range(2):
        done = sinks.write_binary(table, path, {"x": "u2", "b": "u1"}, rows_a_part=64, in_place=in_place)
        assert done.agg(F.sum("records")).first()[0] == 1000
        assert os.listdir(tmp_path / "d") == ["x.bin"]
        records = np.frombuffer((tmp_path / "d" / "x.bin").read_bytes(), [("x", "<u2"), ("b", "u1")])
        assert records["x"].tolist() == [7 * i for i in range(1000)] and records["b"].tolist() == [i % 200 for i in range(1000)]
    with pytest.raises(ValueError):
        sinks.write_binary(table.where("row <> 999 and row <> 5").withColumn("row", F.col("row") * 2), path, {"x": "u2"}, in_place=True)
    assert len((tmp_path / "d" / "x.bin").read_bytes()) == 3000
    sinks.write_binary(table.limit(0), path, {"x": "u2"}, in_place=in_place)
    assert (tmp_path / "d" / "x.bin").read_bytes() == b""
