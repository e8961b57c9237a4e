"""Registered queries over the driver's tables, with the SQL each one must equal.

Floats are rounded to six digits on both sides.
"""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import code_id, id_code, id_number
from ..functions.names import normalize_name as plain_name
from ..functions.names import search_tokens
from ..operators import boundary, community, coords, edges, export, index, raster, regions
from ..sources import sinks, snapshot
from ..sources.storage import cut, new_path
from ..streaming.extract import extract_new_files
from . import driver_views as views
from . import iterate
from .oracle import _byte, _cell, _colors, communities_sql, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
BIG = views.BIG


def query(oracle: str | None = None):
    """Register under the function's name, with its SQL."""

    def keep(run: Callable) -> Callable:
        QUERIES[run.__name__] = run
        if oracle:
            ORACLE_SQL[run.__name__] = sql(oracle)
        return run

    return keep


def six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def _web_palette(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    web = views.web(spark, sf_dir)
    return web, cut(community.community_palette(views.stats(web), BIG), "palette")


# --- sources and sinks


@query("SELECT id, display_name, works_count, cited_by_count, institution, field, CAST('2026-01-0' || (p_partkey % 3 + 1) AS VARCHAR) AS updated_date FROM authors")
def read_authors(spark, sf_dir):
    root = new_path(spark, "authors")
    views.authors(spark, sf_dir).write.partitionBy("updated_date").parquet(root)
    rows = snapshot.first_affiliation(snapshot.read_authors(spark, root))
    return rows.select("id", "display_name", "works_count", "cited_by_count", "institution", "field", "updated_date")


def _works_root(spark, sf_dir):
    root = new_path(spark, "works")
    views.snapshot_works(spark, sf_dir).write.partitionBy("updated_date").parquet(root)
    return root


@query("SELECT CAST(work_id AS VARCHAR) AS id, CAST(n_authors AS INTEGER) AS authors_count, CAST(len(author_ids) AS INTEGER) AS listed FROM works")
def read_works(spark, sf_dir):
    return snapshot.read_works(spark, _works_root(spark, sf_dir)).select("id", "authors_count", F.size("authorships").alias("listed"))


@query("SELECT DISTINCT '2026-01-0' || (work_id % 3 + 1) AS updated_date FROM works")
def list_partitions(spark, sf_dir):
    return snapshot.list_partitions(snapshot.read_works(spark, _works_root(spark, sf_dir)))


_EXTRACTED = "SELECT CAST(work_id AS VARCHAR) AS work_id, CAST(n_authors AS INTEGER) AS n_authors, array_to_string(list_sort(author_ids), ',') AS author_ids, '2026-01-0' || (work_id % 3 + 1) AS updated_date FROM works"


@query(_EXTRACTED)
def extract_incremental(spark, sf_dir):
    works, out = snapshot.read_works(spark, _works_root(spark, sf_dir)), new_path(spark, "extract")
    snapshot.extract_incremental(works.where("updated_date < '2026-01-02'"), out)
    snapshot.extract_incremental(works, out)
    return spark.read.parquet(out).select("work_id", "n_authors", F.array_join(F.sort_array("author_ids"), ",").alias("author_ids"), F.col("updated_date").cast("string").alias("updated_date"))


@query(_EXTRACTED)
def extract_stream(spark, sf_dir):
    root, out, checkpoint = _works_root(spark, sf_dir), new_path(spark, "stream"), new_path(spark, "progress")
    for _ in range(2):  # the second run finds nothing new
        extract_new_files(spark, root, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("work_id", "n_authors", F.array_join(F.sort_array("author_ids"), ",").alias("author_ids"), F.col("updated_date").cast("string").alias("updated_date"))


@query("SELECT count(*) AS written, count(*) AS kept FROM nodes")
def write_table(spark, sf_dir):
    out = new_path(spark, "nodes")
    written = sinks.write_table(views.nodes(spark, sf_dir), out)
    return spark.read.parquet(out).agg(F.lit(written).cast("long").alias("written"), F.count("*").alias("kept"))


@query("SELECT z || '/' || tx || '/' || ty AS tile, count(*) AS labels FROM (" + f"SELECT 6 AS z, {_cell('xw', 64)} AS tx, 63 - {_cell('yw', 64)} AS ty FROM web WHERE NOT is_ring" + ") GROUP BY 1")
def write_json_shards(spark, sf_dir):
    labels = index.label_tiles(views.web(spark, sf_dir), {6: 50_000})
    folder = new_path(spark, "labels")
    cut(sinks.write_json_shards(labels, folder, ["z", "tx", "ty"], ["rn"], ["display_name", "id", "xw", "yw", "cited_by_count", "community"], "l"), "written")
    back = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select("value", F.input_file_name().alias("path"))
    rows = F.from_json("value", "l array<array<string>>")
    return back.select(F.regexp_extract("path", r"(\d+/\d+/\d+)\.json$", 1).alias("tile"), F.size(rows["l"]).cast("long").alias("labels"))


def _regions(spark, sf_dir):
    return regions.regions(views.web(spark, sf_dir), views.authors(spark, sf_dir), 12, 10)


_REGIONS = "SELECT name, round(xw, 6) AS xw, round(yw, 6) AS yw, round(spread, 6) AS spread, members, CAST(rank AS INTEGER) AS rank, CAST(community AS BIGINT) AS community, CAST(CASE WHEN rank <= 30 THEN 2 ELSE 4 END AS INTEGER) AS zmin, CAST(CASE WHEN rank <= 30 THEN 4 ELSE 6 END AS INTEGER) AS zmax FROM top JOIN named USING (community)"


@query(_REGIONS)
def write_json_doc(spark, sf_dir):
    path = new_path(spark, "doc") + "/regions.json"
    sinks.write_json_doc(_regions(spark, sf_dir), path, ["rank"])
    return six(sinks.read_regions(spark, path), "xw", "yw", "spread")


@query("SELECT community, name FROM (SELECT CAST(community AS BIGINT) AS community, name FROM named)")
def read_regions(spark, sf_dir):
    path = new_path(spark, "doc") + "/regions.json"
    missing = sinks.read_regions(spark, path)
    sinks.write_json_doc(_regions(spark, sf_dir), path, ["rank"])
    return missing.union(sinks.read_regions(spark, path)).select("community", "name")


@query("SELECT CAST(row_number() OVER (ORDER BY cited_by_count DESC, id) - 1 AS BIGINT) // 1000 AS part, id FROM web WHERE NOT is_ring".join(["SELECT part, count(*) AS records, count(*) * 8 AS bytes FROM (", ") GROUP BY part"]))
def write_binary(spark, sf_dir):
    path, numbers = new_path(spark, "ids") + ".bin", export.id_numbers(export.export_order_points(views.web(spark, sf_dir)))
    parts = sinks.write_binary(numbers, path, {"number": "u8"}, rows_a_part=1000)

    def read_back(batches):
        for batch in batches:
            files, inside = sinks.filesystem(path)
            with files.open_input_file(inside) as file:
                sizes = [len(file.read_at(8 * n, 8000 * part)) for part, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], ["part", "records", "bytes"])

    return parts.select("part", "records").mapInArrow(read_back, "part long, records long, bytes long")


@query("SELECT '4/' || tx || '/' || ty AS tile, true AS first, false AS again, '89504E470D0A1A0A' AS head FROM (SELECT DISTINCT tx, ty FROM base WHERE z = 4)")
def write_png_tiles(spark, sf_dir):
    web, palette = _web_palette(spark, sf_dir)
    levels = cut(raster.pyramid(raster.pixel_majority(web), 4), "levels")
    tiles, folder = cut(raster.render_zoom(levels, palette, 4), "tiles"), new_path(spark, "png")
    first = cut(sinks.write_png_tiles(tiles, folder, 4), "first")
    again = sinks.write_png_tiles(tiles, folder, 4)
    back = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    sizes = back.select(F.regexp_extract("path", r"(\d+/\d+/\d+)\.png$", 1).alias("tile"), F.hex(F.substring("content", 1, 8)).alias("head"))
    tile = F.regexp_extract("path", r"(\d+/\d+/\d+)\.png$", 1).alias("tile")
    return first.select(tile, F.col("written").alias("first")).join(again.select(tile, F.col("written").alias("again")), "tile").join(sizes, "tile")


# --- projections and predicates


@query("SELECT id, display_name, works_count, cited_by_count, institution, field FROM nodes")
def filter_authors(spark, sf_dir):
    return views.nodes(spark, sf_dir)


@query("SELECT id, institution, field FROM authors")
def first_affiliation(spark, sf_dir):
    return snapshot.first_affiliation(views.authors(spark, sf_dir)).select("id", "institution", "field")


@query(_EXTRACTED)
def extract_authorships(spark, sf_dir):
    rows = snapshot.extract_authorships(views.snapshot_works(spark, sf_dir))
    return rows.withColumn("author_ids", F.array_join(F.sort_array("author_ids"), ","))


@query(f"SELECT id, {_cell('xw', 262144)} AS px, {_cell('yw', 262144)} AS py FROM web")
def pixel_bin(spark, sf_dir):
    return raster.pixel_bin(views.web(spark, sf_dir)).select("id", "px", "py")


@query(f"SELECT id, px // 256 AS tx, 1023 - py // 256 AS ty, px % 256 AS ix, 255 - py % 256 AS iy FROM (SELECT id, {_cell('xw', 262144)} AS px, {_cell('yw', 262144)} AS py FROM web)")
def tile_xyz(spark, sf_dir):
    return raster.tile_xyz(raster.pixel_bin(views.web(spark, sf_dir)), 10).select("id", "tx", "ty", "ix", "iy")


@query(f"SELECT src, dst, {r6('weight')} FROM edges WHERE weight >= 0.5 AND weight < 1")
def edge_weight_band(spark, sf_dir):
    return six(views.named(edges.weight_band(views.coded_edges(spark, sf_dir), 0.5, 1), "src", "dst"), "weight")


@query("SELECT id, px, py, community, CAST(rad0 AS INTEGER) AS rad0 FROM splats")
def splat_tiers(spark, sf_dir):
    return raster.splat_tiers(views.web(spark, sf_dir), 800)


@query("SELECT 10 AS z, id, rad0 AS rad FROM splats WHERE rad0 > 0 UNION ALL SELECT 9, id, rad0 - 1 FROM splats WHERE rad0 > 1")
def splat_radius_at_zoom(spark, sf_dir):
    splats = cut(raster.splat_tiers(views.web(spark, sf_dir), 800), "splats")
    at = lambda z: raster.splat_radius_at_zoom(splats, z).select(F.lit(z).alias("z"), "id", "rad")
    return at(10).union(at(9)).union(at(8))


@query(f"SELECT id, {_byte('xw * 65535', 65535)} AS x, {_byte('yw * 65535', 65535)} AS y, r, g, b, {_byte('sqrt(cited_by_count) / 700 * 255')} AS s FROM web JOIN lut USING (community) WHERE NOT is_ring")
def quantize_points(spark, sf_dir):
    web = views.web(spark, sf_dir)
    return export.quantize_points(export.export_order_points(web), community.color_lut(views.stats(web), BIG)).drop("row")


@query("SELECT id, CAST(substr(id, 2) AS BIGINT) AS number FROM nodes")
def id_to_number(spark, sf_dir):
    return views.nodes(spark, sf_dir).select("id", id_number("id").alias("number"))


@query(f"SELECT * FROM (WITH l AS MATERIALIZED (SELECT id, x, y, community FROM layout), m AS MATERIALIZED (SELECT median(x) AS mx, median(y) AS my, stddev_samp(x) AS dx, stddev_samp(y) AS dy FROM l) SELECT id, {r6('x', 'y')}, community % 40 AS hue FROM l, m WHERE x BETWEEN mx - 0.15::DOUBLE * dx AND mx + 0.15::DOUBLE * dx AND y BETWEEN my - 0.15::DOUBLE * dy AND my + 0.15::DOUBLE * dy)")
def qa_window(spark, sf_dir):
    return six(export.qa_window(views.layout(spark, sf_dir)), "x", "y")


# --- joins


@query("SELECT work_id, author_id, n_authors FROM chosen")
def keep_selected_authors(spark, sf_dir):
    rows = edges.distinct_work_authors(views.works(spark, sf_dir), views.MAX_AUTHORS)
    return edges.keep_selected_authors(rows, views.nodes(spark, sf_dir)).select("work_id", "author_id", "n_authors")


@query(f"SELECT work_id, src, dst, {r6('w')} FROM pairs")
def author_pairs(spark, sf_dir):
    return six(views.named(edges.author_pairs(views.coded_works(spark, sf_dir)), "src", "dst"), "w")


@query("SELECT a.node_idx AS src, b.node_idx AS dst, round(weight, 5) AS weight FROM edges JOIN numbered a ON a.id = src JOIN numbered b ON b.id = dst WHERE weight >= 0.3")
def renumber_edges(spark, sf_dir):
    found = edges.renumber_edges(views.graph(spark, sf_dir), edges.number_nodes(views.nodes(spark, sf_dir)), 0.3)
    return found.withColumn("weight", F.round(F.col("weight").cast("double"), 5))


@query(f"SELECT n.id, {r6('x', 'y')}, community FROM numbered n LEFT JOIN (SELECT node_idx, x, y, l.community FROM numbered JOIN layout l USING (id)) p USING (node_idx)")
def assemble_coords(spark, sf_dir):
    numbered = cut(edges.number_nodes(views.nodes(spark, sf_dir)), "numbered")
    found = views.layout(spark, sf_dir).join(numbered.select("id", "node_idx"), "id")
    positions = found.select(F.col("node_idx").alias("vertex"), "x", "y")
    parts = found.select(F.col("node_idx").alias("vertex"), F.col("community").alias("partition"))
    return six(coords.assemble_coords(numbered, positions, parts), "x", "y").select("id", "x", "y", "community")


@query("SELECT x0, y0, x1, y1 FROM lines")
def drawable_edges(spark, sf_dir):
    web = views.web(spark, sf_dir).withColumn("id", id_code("id"))
    return edges.drawable_edges(views.coded_edges(spark, sf_dir), web, 0.5, None, 4_000)


@query(f"SELECT src, dst, community0, community1, cited0, cited1, {r6('weight', 'xw0', 'yw0', 'xw1', 'yw1')} FROM ends")
def edge_endpoints(spark, sf_dir):
    found = edges.edge_endpoints(views.graph(spark, sf_dir), views.web(spark, sf_dir), 0.5)
    return six(found, "weight", "xw0", "yw0", "xw1", "yw1")


def _quantized(spark, sf_dir):
    web = views.web(spark, sf_dir)
    graph = views.graph(spark, sf_dir).withColumn("weight", F.round("weight", 9))
    ends = edges.edge_endpoints(graph, web, 0.5)
    return edges.quantize_edges(ends, community.color_lut(views.stats(web), BIG))


@query("SELECT * REPLACE (round(weight, 6) AS weight) FROM qedges")
def quantize_edges(spark, sf_dir):
    return six(_quantized(spark, sf_dir), "weight")


@query("SELECT community, topic, count(*) AS n FROM topics GROUP BY ALL")
def member_topics(spark, sf_dir):
    web = views.web(spark, sf_dir)
    found = regions.member_topics(web, views.authors(spark, sf_dir), regions.top_communities(web, 12))
    return found.groupBy("community", "topic").agg(F.count("*").alias("n"))


@query("SELECT community, name, majority_field AS field, members, printf('#%02x%02x%02x', CAST(floor(r * 255) AS INTEGER), CAST(floor(g * 255) AS INTEGER), CAST(floor(b * 255) AS INTEGER)) AS color FROM stats JOIN palette USING (community) LEFT JOIN named USING (community) WHERE members >= 180")
def legend(spark, sf_dir):
    return community.legend(views.stats(views.web(spark, sf_dir)), _regions(spark, sf_dir), BIG)


# --- aggregates


@query("SELECT work_id, n_authors, CAST(len(author_ids) AS INTEGER) AS listed FROM works")
def dedup_works(spark, sf_dir):
    works = views.works(spark, sf_dir)
    shorter = works.where("work_id % 3 = 0").withColumn("author_ids", F.slice("author_ids", 1, 1)).withColumn("n_authors", F.lit(0).cast("long"))
    return edges.dedup_works(works.union(shorter)).select("work_id", "n_authors", F.size("author_ids").alias("listed"))


@query("SELECT work_id, author_id, n_authors FROM wa")
def distinct_work_authors(spark, sf_dir):
    return edges.distinct_work_authors(views.works(spark, sf_dir), views.MAX_AUTHORS)


@query(f"SELECT src, dst, {r6('weight')} FROM edges")
def coauthor_edges(spark, sf_dir):
    return six(edges.coauthor_edges(views.works(spark, sf_dir), views.nodes(spark, sf_dir), views.MAX_AUTHORS), "weight")


@query("SELECT CAST(CASE WHEN weight >= 3 THEN 3 WHEN weight >= 2 THEN 2 ELSE 1 END AS INTEGER) AS weight_class, count(*) AS edges FROM edges GROUP BY 1")
def edge_weight_histogram(spark, sf_dir):
    return edges.edge_weight_histogram(views.graph(spark, sf_dir))


@query("""SELECT round(sum(coalesce(inside, 0)) / (sum(total) / 2) - sum(total * total) / (sum(total) * sum(total)), 6) AS modularity FROM
  (SELECT community, sum(weight) AS total FROM (SELECT p.community, weight FROM edges JOIN layout p ON p.id = src JOIN layout q ON q.id = dst UNION ALL SELECT q.community, weight FROM edges JOIN layout p ON p.id = src JOIN layout q ON q.id = dst) GROUP BY 1)
  LEFT JOIN (SELECT p.community, sum(weight) AS inside FROM edges JOIN layout p ON p.id = src JOIN layout q ON q.id = dst WHERE p.community = q.community GROUP BY 1) USING (community)""")
def edge_modularity(spark, sf_dir):
    labels = views.layout(spark, sf_dir).select(id_code("id").alias("node"), F.col("community").alias("label"))
    return six(community.edge_modularity(views.coded_edges(spark, sf_dir), labels), "modularity")


@query("SELECT count(DISTINCT community) AS communities FROM layout")
def community_count(spark, sf_dir):
    return community.community_count(views.layout(spark, sf_dir), "community")


@query("SELECT count(*) FILTER (n >= 180) AS communities, round(coalesce(sum(n) FILTER (n >= 180), 0) / sum(n), 6) AS share FROM (SELECT count(*) AS n FROM layout GROUP BY community)")
def community_coverage(spark, sf_dir):
    return six(community.community_coverage(views.layout(spark, sf_dir), BIG), "share")


@query("SELECT " + ", ".join(f"round(quantile_cont(cited_by_count, {p}::DOUBLE), 6) AS {n}" for p, n in ((0.5, "p50"), (0.99, "p99"), (0.999, "p999"), (0.9999, "p9999"))) + " FROM layout")
def citation_percentiles(spark, sf_dir):
    return six(export.citation_percentiles(views.layout(spark, sf_dir)), "p50", "p99", "p999", "p9999")


@query("SELECT z, count(*) AS pixels, count(DISTINCT px // 256 * 2048 + py // 256) AS tiles FROM levels GROUP BY z")
def tile_occupancy(spark, sf_dir):
    return raster.tile_occupancy(cut(raster.pyramid(cut(raster.pixel_majority(views.web(spark, sf_dir)), "pixels")), "levels"))


@query("SELECT px, py, cnt, community FROM level10")
def pixel_majority(spark, sf_dir):
    return raster.pixel_majority(views.web(spark, sf_dir))


@query("SELECT z, px, py, cnt, community FROM levels")
def pyramid_level(spark, sf_dir):
    return raster.pyramid(cut(raster.pixel_majority(views.web(spark, sf_dir)), "pixels"))


@query(f"SELECT community, majority_field, members, {r6('cx', 'cy')} FROM stats")
def community_stats(spark, sf_dir):
    return six(community.community_stats(views.web(spark, sf_dir)), "cx", "cy")


@query(f"SELECT community, members, {r6('xw', 'yw', 'spread')}, CAST(rank AS INTEGER) AS rank FROM top")
def top_communities(spark, sf_dir):
    return six(regions.top_communities(views.web(spark, sf_dir), 12), "xw", "yw", "spread")


def _scores(spark, sf_dir):
    web = views.web(spark, sf_dir)
    return regions.topic_scores(regions.member_topics(web, views.authors(spark, sf_dir), regions.top_communities(web, 12)))


@query(f"SELECT community, topic, c, {r6('score')} FROM scores")
def topic_scores(spark, sf_dir):
    return six(_scores(spark, sf_dir), "score")


@query("SELECT cx, cy, community FROM cells")
def grid_majority(spark, sf_dir):
    return boundary.grid_majority(views.web(spark, sf_dir), 32, 2)


@query("""SELECT kind, count(*) AS pairs, round(median(d), 6) AS median_distance, round(avg(CASE WHEN c0 = c1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS same_community, round(avg(CASE WHEN d <= 0.02::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 6) AS near FROM (
  SELECT kind, p.community AS c0, q.community AS c1, sqrt((q.xw - p.xw) * (q.xw - p.xw) + (q.yw - p.yw) * (q.yw - p.yw)) AS d FROM (
    SELECT 'strong' AS kind, src AS id0, dst AS id1 FROM edges WHERE weight >= 0.5 UNION ALL
    SELECT 'random', id, lead(id) OVER (PARTITION BY substr(md5('pair-' || id), 1, 3) ORDER BY md5('pair-' || id)) FROM web)
  JOIN web p ON p.id = id0 JOIN web q ON q.id = id1) GROUP BY kind""")
def weight_distance_report(spark, sf_dir):
    found = export.weight_distance_report(views.graph(spark, sf_dir), views.web(spark, sf_dir), 0.5)
    return six(found, "median_distance", "same_community", "near")


@query("""SELECT count(*) AS authors, round(avg(CASE WHEN d <= 0.02::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM (
  SELECT node, min(sqrt((q.xw - p.xw) * (q.xw - p.xw) + (q.yw - p.yw) * (q.yw - p.yw))) AS d FROM twoway JOIN web p ON p.id = node JOIN web q ON q.id = other GROUP BY node)""")
def near_coauthor_share(spark, sf_dir):
    web = views.web(spark, sf_dir).withColumn("id", id_code("id"))
    return six(export.near_coauthor_share(views.coded_edges(spark, sf_dir), web), "share")


# --- windows, order, sets


@query("SELECT * FROM numbered")
def number_nodes(spark, sf_dir):
    return edges.number_nodes(views.nodes(spark, sf_dir))


_LABELS = " UNION ALL ".join(
    f"SELECT * FROM (SELECT {z} AS z, {_cell('xw', 1 << z)} AS tx, {(1 << z) - 1} - {_cell('yw', 1 << z)} AS ty, id, row_number() OVER (PARTITION BY {_cell('xw', 1 << z)}, {_cell('yw', 1 << z)} ORDER BY cited_by_count DESC, id) AS rn FROM web WHERE NOT is_ring) WHERE rn <= {k}"
    for z, k in ((6, 2), (7, 2), (8, 3), (9, 4000))
)


@query(f"SELECT z, tx, ty, id, CAST(rn AS INTEGER) AS rn FROM ({_LABELS})")
def label_tiles(spark, sf_dir):
    return index.label_tiles(views.web(spark, sf_dir), {6: 2, 7: 2, 8: 3, 9: 4000}).select("z", "tx", "ty", "id", "rn")


@query("SELECT community, id, CAST(rn AS INTEGER) AS rn FROM (SELECT community, id, row_number() OVER (PARTITION BY community ORDER BY cited_by_count DESC, id) AS rn FROM web WHERE NOT is_ring AND community IN (SELECT community FROM stats WHERE members >= 180)) WHERE rn <= 50")
def community_roster(spark, sf_dir):
    web = views.web(spark, sf_dir)
    return index.community_roster(web, views.stats(web), 50, BIG).select("community", "id", "rn")


@query(f"SELECT community, topic, CAST(rn AS INTEGER) AS rn, {r6('score')} FROM best")
def topic_ranking(spark, sf_dir):
    return six(regions.topic_ranking(_scores(spark, sf_dir)), "score").select("community", "topic", "rn", "score")


@query(f"SELECT DISTINCT z, cnt, {r6('bright')} FROM lit")
def brightness_equalize(spark, sf_dir):
    levels = raster.pyramid(cut(raster.pixel_majority(views.web(spark, sf_dir)), "pixels"))
    return six(raster.brightness(levels), "bright")


@query("SELECT id, comm_n FROM sized")
def community_size(spark, sf_dir):
    return community.community_size(views.layout(spark, sf_dir)).select("id", "comm_n")


@query(f"SELECT id, {r6('sx', 'sy')} FROM shifted")
def spread_communities(spark, sf_dir):
    placed = coords.radial(views.layout(spark, sf_dir), views.RING)
    return six(coords.spread_communities(placed, views.SPREAD, BIG), "sx", "sy").select("id", "sx", "sy")


@query("SELECT dir, line, min(pos) AS a, max(pos) + 1 AS b FROM (SELECT *, pos - row_number() OVER (PARTITION BY dir, line ORDER BY pos) AS g FROM steps) GROUP BY dir, line, g")
def boundary_runs(spark, sf_dir):
    return boundary.boundary_runs(boundary.grid_majority(views.web(spark, sf_dir), 32, 2), 32)


@query("SELECT display_name, id, cited_by_count, community FROM web WHERE NOT is_ring ORDER BY cited_by_count DESC, id LIMIT 500")
def top_authors(spark, sf_dir):
    return index.top_authors(views.web(spark, sf_dir), 500).select("display_name", "id", "cited_by_count", "community")


@query(f"SELECT * REPLACE ({r6('xw', 'yw')}), CAST(row_number() OVER (ORDER BY cited_by_count DESC, id) - 1 AS BIGINT) AS row FROM web WHERE NOT is_ring")
def export_order_points(spark, sf_dir):
    return six(export.export_order_points(views.web(spark, sf_dir)), "xw", "yw")


@query("SELECT * REPLACE (round(weight, 6) AS weight), CAST(row_number() OVER (ORDER BY round(weight, 9) DESC, src, dst) - 1 AS BIGINT) AS row FROM qedges")
def export_order_edges(spark, sf_dir):
    return six(export.export_order_edges(_quantized(spark, sf_dir)), "weight")


@query("SELECT id FROM layout WHERE x IS NOT NULL ORDER BY md5('42-' || id), id LIMIT 100")
def sample_rows(spark, sf_dir):
    return export.sample_rows(views.layout(spark, sf_dir), 100).select("id")


@query("SELECT id, round(ru * cos(th), 6) AS xw, round(ru * sin(th), 6) AS yw, is_ring FROM placed")
def core_dust_union(spark, sf_dir):
    placed = coords.radial(views.layout(spark, sf_dir), views.RING).withColumns({"xw": F.col("ru") * F.cos("th"), "yw": F.col("ru") * F.sin("th")})
    found = coords.core_dust_union(placed.where("not is_ring"), placed.where("is_ring"))
    return six(found, "xw", "yw").select("id", "xw", "yw", "is_ring")


# --- scalar functions


@query(f"SELECT {r6('cx', 'cy', 's')} FROM cs")
def center_scale(spark, sf_dir):
    return six(coords.center_scale(views.layout(spark, sf_dir)), "cx", "cy", "s")


@query(f"SELECT id, {r6('a', 'ru')} FROM placed WHERE NOT is_ring")
def radial_compress(spark, sf_dir):
    return six(coords.radial(views.layout(spark, sf_dir), views.RING).where("not is_ring"), "a", "ru").select("id", "a", "ru")


@query("SELECT id, is_ring FROM flagged")
def ring_flag(spark, sf_dir):
    return coords.radial(views.layout(spark, sf_dir), views.RING).select("id", "is_ring")


@query(f"SELECT id, {r6('ru', 'th')} FROM placed WHERE is_ring")
def ring_scatter(spark, sf_dir):
    return six(coords.radial(views.layout(spark, sf_dir), views.RING).where("is_ring"), "ru", "th").select("id", "ru", "th")


@query(f"SELECT id, display_name, {r6('xw', 'yw')}, community, works_count, cited_by_count, institution, field, is_ring FROM web")
def web_coords(spark, sf_dir):
    return six(coords.web_coords(views.layout(spark, sf_dir), views.SPREAD, views.RING, BIG), "xw", "yw")


@query("SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS norm FROM documents WHERE text IS NOT NULL")
def normalize_name(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", plain_name("text").alias("norm"))


@query("SELECT id, token FROM entries")
def name_tokens(spark, sf_dir):
    return views.web(spark, sf_dir).select("id", F.explode(search_tokens(plain_name("display_name"))).alias("token"))


def _sharded(spark, sf_dir):
    return cut(index.search_shards(index.name_entries(views.web(spark, sf_dir)), 20_000), "sharded")


@query("SELECT shard, token, id, norm FROM sharded")
def search_shards(spark, sf_dir):
    return _sharded(spark, sf_dir).select("shard", "token", "id", "norm")


@query("""SELECT query, CAST(rn AS INTEGER) AS rn, id, norm, cited_by_count FROM (
  SELECT query, id, norm, cited_by_count, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN starts_with(norm, query) THEN 0 WHEN starts_with(norm, qw[1]) THEN 1 ELSE 2 END, cited_by_count DESC, id) AS rn FROM (
    SELECT DISTINCT query, qw, id, norm, cited_by_count FROM (
      SELECT q.*, n.id, n.norm, n.cited_by_count, n.nw FROM (SELECT DISTINCT left(norm, 3) AS query, [left(norm, 3)] AS qw FROM norms UNION SELECT DISTINCT norm, string_split(norm, ' ') FROM norms) q
      JOIN (SELECT *, string_split(norm, ' ') AS nw FROM norms) n ON starts_with(n.nw[1], qw[1]) AND (len(qw) = 1 OR starts_with(n.nw[2], qw[2])) OR len(qw) = 1 AND starts_with(n.nw[2], qw[1])))) WHERE rn <= 12""")
def search_lookup(spark, sf_dir):
    sharded = _sharded(spark, sf_dir)
    asked = sharded.select(F.substring("norm", 1, 3).alias("query")).union(sharded.select("norm")).distinct()
    return index.search_lookup(asked, sharded)


@query(f"SELECT CAST(CAST(substr(id, 2) AS BIGINT) % 1000 AS INTEGER) AS shard, id, {r6('xw', 'yw')} FROM web")
def id_shards(spark, sf_dir):
    return index.id_shards(views.web(spark, sf_dir))


@query(f"SELECT id, {r6('xw', 'yw')} FROM web")
def round_coords(spark, sf_dir):
    folder = new_path(spark, "ids")
    rounded = index.round_coords(views.web(spark, sf_dir)).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(16)))
    cut(sinks.write_json_shards(rounded, folder, ["shard"], ["id"], ["id", "xw", "yw"], named=True), "files")
    back = spark.read.text(folder, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<double>>")).alias("id", "at"))
    return back.select("id", F.get("at", F.lit(0)).alias("xw"), F.get("at", F.lit(1)).alias("yw"))


@query(f"SELECT community, {r6('r', 'g', 'b')} FROM palette")
def community_color(spark, sf_dir):
    return six(_web_palette(spark, sf_dir)[1], "r", "g", "b")


@query("SELECT community, r, g, b FROM lut")
def color_lut(spark, sf_dir):
    return community.color_lut(views.stats(views.web(spark, sf_dir)), BIG)


_FIELDS = "CASE p_type WHEN 'STANDARD' THEN 'Medicine' WHEN 'ECONOMY' THEN 'Chemistry' WHEN 'PROMO' THEN 'Veterinary' ELSE p_type END"


@query(
    "SELECT community, field, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM ("
    + _colors(
        f"SELECT p_partkey AS community, {_FIELDS} AS field, CASE p_type WHEN 'STANDARD' THEN 0.0::DOUBLE WHEN 'ECONOMY' THEN 249.2::DOUBLE WHEN 'PROMO' THEN 263.1::DOUBLE END AS fh FROM part",
        "CASE WHEN fh IS NULL THEN 0 ELSE fmod(fmod(fh + 9 * j1, 360) + 360, 360) END",
        "CASE WHEN fh IS NULL THEN 0.62::DOUBLE + 0.18::DOUBLE * j1 ELSE least(0.58::DOUBLE, greatest(0.40::DOUBLE, 0.48::DOUBLE + 0.08::DOUBLE * j2)) END",
        "CASE WHEN fh IS NULL THEN 0.03::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.80::DOUBLE, 0.90::DOUBLE + 0.10::DOUBLE * j2)) END",
    )
    + ")"
)
def field_color(spark, sf_dir):
    rows = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("community"), F.expr(_FIELDS).alias("field"))
    return six(community.field_palette(rows), "r", "g", "b")


@query("SELECT community, name FROM named")
def region_names(spark, sf_dir):
    web = views.web(spark, sf_dir)
    top = cut(regions.top_communities(web, 12), "top")
    ranked = regions.topic_ranking(regions.topic_scores(regions.member_topics(web, views.authors(spark, sf_dir), top)))
    return regions.region_names(top, ranked, 10).withColumn("community", F.col("community").cast("int"))


# --- rasters and lines


@query(f"SELECT z, tx, ty, ix, iy, {r6('r', 'g', 'b')} FROM base")
def tile_pixels(spark, sf_dir):
    web, palette = _web_palette(spark, sf_dir)
    levels = cut(raster.pyramid(raster.pixel_majority(web)), "levels")
    return six(raster.tile_pixels(levels, palette), "r", "g", "b")


@query(f"SELECT tx, ty, ix, iy, {r6('r', 'g', 'b')} FROM spots")
def splat_pixels(spark, sf_dir):
    web, palette = _web_palette(spark, sf_dir)
    return six(raster.splat_pixels(raster.splat_tiers(web, 800), palette, 10), "r", "g", "b")


@query("""SELECT tx, ty, ix, iy, round(n * 0.08::DOUBLE, 6) AS alpha FROM (SELECT px // 256 AS tx, 255 - py // 256 AS ty, px % 256 AS ix, 255 - py % 256 AS iy, count(*) AS n FROM samples GROUP BY ALL)
  WHERE (tx, ty) IN (SELECT (px // 256, 255 - py // 256) FROM level8)""")
def edge_pixels(spark, sf_dir):
    web = views.web(spark, sf_dir)
    levels = raster.pyramid(cut(raster.pixel_majority(web), "pixels"), 8).where("z = 8")
    lines = edges.drawable_edges(views.coded_edges(spark, sf_dir), web.withColumn("id", id_code("id")), 0.5, None, 4_000)
    occupied = raster.tile_xyz(levels, 8).select("tx", "ty").distinct()
    return six(raster.edge_pixels(lines, occupied, 8, 0.08), "alpha")


@query(f"""SELECT tx, ty, x AS ix, y AS iy, round(sum(r * w), 6) AS r, round(sum(g * w), 6) AS g, round(sum(b * w), 6) AS b FROM (
  SELECT tx, ty, ix + dx AS x, iy + dy AS y, CASE WHEN dx <> 0 AND dy <> 0 THEN 0.06::DOUBLE ELSE 0.12::DOUBLE END AS w, r, g, b FROM base, around WHERE z = 9 AND (dx <> 0 OR dy <> 0)) WHERE x BETWEEN 0 AND 255 AND y BETWEEN 0 AND 255 GROUP BY ALL""")
def bloom(spark, sf_dir):
    web, palette = _web_palette(spark, sf_dir)
    levels = cut(raster.pyramid(raster.pixel_majority(web), 9), "levels")
    return six(raster.bloom(raster.tile_pixels(levels, palette).where("z = 9")), "r", "g", "b")


@query("SELECT 10 AS z, tx, ty, ix, iy, r, g, b FROM drawn WHERE r + g + b > 0")
def render_tiles(spark, sf_dir):
    web, palette = _web_palette(spark, sf_dir)
    levels = cut(raster.pyramid(cut(raster.pixel_majority(web), "pixels"), 10), "levels")
    lines = cut(edges.drawable_edges(views.coded_edges(spark, sf_dir), web.withColumn("id", id_code("id")), 0.5, None, 4_000), "lines")
    tiles = cut(raster.render_zoom(levels, palette, 10, raster.splat_tiers(web, 800), None, lines), "tiles")
    return raster.tile_bytes(tiles).select(F.lit(10).alias("z"), "tx", "ty", "ix", "iy", "r", "g", "b")


@query("SELECT cx, cy, community FROM smooth")
def smooth_majority(spark, sf_dir):
    return boundary.smooth_majority(cut(boundary.grid_majority(views.web(spark, sf_dir), 32, 2), "cells"))


@query("""SELECT CAST(pos - 1 AS INTEGER) AS pos, round(pt.x, 6) AS x, round(pt.y, 6) AS y, round(length, 6) AS length FROM (
  SELECT length, unnest(pts) AS pt, unnest(range(1, len(pts) + 1)) AS pos FROM curved WHERE length >= 0.04::DOUBLE)""")
def boundary_polylines(spark, sf_dir):
    found = boundary.boundary_polylines(views.web(spark, sf_dir), 32, 2, 3, 0.04)
    rows = found.select(F.posexplode("points").alias("pos", "p"), "length")
    return six(rows.select("pos", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"), "length"), "length")


# --- graph


@query("SELECT node, round(sum(weight), 6) AS degree, count(*) AS neighbours FROM twoway GROUP BY node")
def weighted_degree(spark, sf_dir):
    return six(views.named(community.weighted_degree(views.coded_edges(spark, sf_dir)), "node"), "degree")


@query(communities_sql(2, 5, 5))
def detect_communities(spark, sf_dir):
    pairs, names = views.numbered_pairs(spark, sf_dir)
    labels, modularity = community.found_communities(pairs, 2, 5, 5, text=code_id, names=names)
    return views.named(labels, "node", "label").crossJoin(F.broadcast(six(modularity, "modularity")))  # one row


@query("SELECT node, label FROM label3")
def label_propagation(spark, sf_dir):
    pairs, names = views.numbered_pairs(spark, sf_dir)
    return views.named(community.propagate_labels(pairs, 3, names), "node", "label")


@query("SELECT node, label FROM label3")
def resume_iterations(spark, sf_dir):
    folder = new_path(spark, "rounds")
    pairs, names = views.numbered_pairs(spark, sf_dir)
    iterate.label_rounds(pairs, folder, 2, names=names)
    return views.named(iterate.label_rounds(pairs, folder, 3, names=names), "node", "label")
