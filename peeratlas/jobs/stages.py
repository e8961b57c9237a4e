"""The map's stages, from the snapshot to the files that serve it.

Each stage reads the tables before it and replaces its own; `python -m
peeratlas.jobs.stages STAGE --name value ...` runs one, `run_map` all of them.
"""

import argparse
import inspect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import MAX_ZOOM
from ..operators import boundary, community, coords, edges, export, index, raster, regions
from ..sources import sinks, snapshot
from ..sources.storage import cut
from .iterate import label_rounds

QUANTIZED, SIZE_SCALE, WEIGHT_CAP = 65535, 700, 20
#: The edge export has a companion with its heaviest edges beyond so many bytes and edges.
COMPANION_BYTES, COMPANION_EDGES = 300 << 20, 3_000_000


def run_extract(spark: SparkSession, works: str, out: str) -> list[str]:
    """Author lists of the works in partitions that out lacks; the partitions' names."""
    return snapshot.extract_incremental(snapshot.read_works(spark, works), out)


def run_filter(spark: SparkSession, authors: str, out: str, min_works: int = 5) -> int:
    """Nodes: authors with enough works."""
    return sinks.write_table(snapshot.filter_authors(snapshot.read_authors(spark, authors), min_works), out)


def run_edges(spark: SparkSession, works: str, nodes: str, out: str, max_authors: int = 50) -> int:
    """Coauthor edges between ids; pairs are summed by node numbers on the way."""
    numbered = cut(edges.number_nodes(spark.read.parquet(nodes).select("id")), "numbered")
    found = cut(edges.coauthor_edges(spark.read.parquet(works), numbered, max_authors), "numbered-edges")
    return sinks.write_table(edges.named_edges(found, numbered), out)


def run_prep(spark: SparkSession, nodes: str, edges_in: str, out: str, min_weight: float = 0.0) -> dict[str, int]:
    """out/nodes_int32 in the order of node_idx, and out/edges_int32."""
    numbered = cut(edges.number_nodes(spark.read.parquet(nodes)), "numbered")
    ordered = numbered.repartitionByRange("node_idx").sortWithinPartitions("node_idx")
    kept = edges.renumber_edges(spark.read.parquet(edges_in), numbered, min_weight)
    return {"nodes": sinks.write_table(ordered, f"{out}/nodes_int32"), "edges": sinks.write_table(kept, f"{out}/edges_int32")}


def run_communities(spark: SparkSession, graph: str, out: str, rounds: int = 12, levels: int = 2) -> dict:
    """out/parts (vertex, partition) and out/communities.json with their number and
    modularity. Communities by rounds of moves that raise modularity, on so many levels;
    with levels 0 by label propagation that resumes where an earlier run ended."""
    links = spark.read.parquet(f"{graph}/edges_int32")
    if levels:
        labels = cut(community.modularity_communities(links, levels, rounds, rounds), "communities")
    else:
        labels = label_rounds(links, f"{out}/rounds", rounds, {"graph": graph})
    sinks.write_table(labels.select(F.col("node").alias("vertex"), F.col("label").alias("partition")), f"{out}/parts")
    report = {"communities": community.community_count(labels).first()[0], "modularity": community.edge_modularity(links, labels).first()[0], "rounds": rounds}
    sinks.write_json(f"{out}/communities.json", report)
    return report


def run_coords(spark: SparkSession, graph: str, positions: str, parts: str, out: str) -> int:
    """Nodes with the layout's positions(vertex, x, y) and parts(vertex, partition)."""
    return sinks.write_table(coords.assemble_coords(*(spark.read.parquet(p) for p in (f"{graph}/nodes_int32", positions, parts))), out)


def run_webcoords(spark: SparkSession, coords_in: str, out: str, spread: float = 1.35, ring_comm_max: int = 100, big: int = 1000) -> dict:
    """Coordinates of the unit square; figures of the transform beside them in out.json."""
    web, stats = coords.transformed(spark.read.parquet(coords_in), spread, ring_comm_max, big)
    sinks.write_table(web, out)
    figures = stats.first().asDict()
    sinks.write_json(f"{out}.json", figures)
    return figures


def run_edgepx(spark: SparkSession, edges_in: str, web: str, out: str, min_weight: float = 2, max_weight: float | None = None, max_len_px: float = 1536) -> int:
    """Drawable edges in pixels."""
    return sinks.write_table(edges.drawable_edges(spark.read.parquet(edges_in), spark.read.parquet(web), min_weight, max_weight, max_len_px), out)


def run_tiles(spark: SparkSession, web: str, out: str, lines: str | None = None, one_off: str | None = None, regions_in: str | None = None, bottom: int = 5_000, big: int = 1000, lowest: int = 0) -> dict[int, int]:
    """Images of all zooms and legend.json; the images drawn a zoom. Tiles that have an
    image aren't drawn again."""
    points = spark.read.parquet(web)
    levels = cut(raster.pyramid(cut(raster.pixel_majority(points), "pixels"), lowest), "levels")
    stats = cut(community.community_stats(points), "stats")
    palette = cut(community.community_palette(stats, big), "palette")
    names = sinks.read_regions(spark, regions_in) if regions_in else spark.createDataFrame([], "community long, name string")
    sinks.write_json_doc(community.legend(stats, names, big), f"{out}/legend.json", [F.col("members").desc(), "community"])
    drawn, splats = {}, cut(raster.splat_tiers(points, bottom), "splats")
    read = lambda path: spark.read.parquet(path) if path else None
    for zoom in range(lowest, MAX_ZOOM + 1):
        occupied = raster.tile_xyz(levels.where(F.col("z") == zoom), zoom).select("tx", "ty").distinct()
        missing = cut(sinks.tiles_without_image(occupied, f"{out}/tiles", zoom), "missing")
        images = raster.render_zoom(levels, palette, zoom, splats, read(lines), read(one_off), missing)
        drawn[zoom] = cut(sinks.write_png_tiles(images, f"{out}/tiles", zoom), "drawn").where("written").count()
    return drawn


def run_regions(spark: SparkSession, web: str, authors: str, out: str, top_n: int = 300, keep: int = 120, once: bool = False) -> int:
    """regions.json: names of the largest communities."""
    found = regions.regions(spark.read.parquet(web), snapshot.read_authors(spark, authors), top_n, keep, once)
    return sinks.write_json_doc(index.round_coords(found, "xw", "yw", "spread"), out, ["rank"])


def run_index(spark: SparkSession, web: str, out: str, big: int = 1000, roster: int = 20_000, top: tuple[int, int] = (50_000, 300_000), most_bytes: int = 4_000_000, grid: int = 512, min_cell: int = 6) -> dict[str, int]:
    """Label tiles, search and id shards, rosters, top lists and boundaries; files of each."""
    points = index.round_coords(spark.read.parquet(web))
    entry = ["display_name", "id", "xw", "yw", "cited_by_count"]
    files = {}

    def put(name: str, rows: DataFrame, *args, **more) -> None:
        files[name] = cut(sinks.write_json_shards(rows, f"{out}/{name}", *args, **more), "files").count()

    put("labels", index.label_tiles(points), ["z", "tx", "ty"], ["rn"], [*entry, "community"], wrap="l")
    sharded = cut(index.search_shards(index.name_entries(points), most_bytes), "sharded").withColumns({"place": -F.col("cited_by_count"), "display_name": F.col("name")})
    parents = index.shard_sizes(sharded).select(F.col("shard").alias("key"))
    put("search", sharded.dropDuplicates(["shard", "id"]), ["shard"], ["place", "id"], ["norm", *entry], empty=parents)
    put("ids", index.id_shards(points), ["shard"], ["id"], ["id", "xw", "yw"], named=True)
    stats = community.community_stats(points)
    put("communities", index.community_roster(points, stats, roster, big), ["community"], ["rn"], entry)
    for name, n in zip(("top_authors", "top_authors.xl"), top, strict=True):
        rows = index.top_authors(points, n).withColumns({"key": F.lit(name), "place": -F.col("cited_by_count")})
        put(f"lists/{name}", rows, ["key"], ["place", "id"], [*entry, "community"])
    shape = boundary.boundary_document(boundary.boundary_polylines(spark.read.parquet(web), grid, min_cell))
    sinks.write_json(f"{out}/boundaries.json", shape)
    return files


def _pair(records: DataFrame, out: str, names: tuple[str, str], first: dict[str, str], second: dict[str, str]) -> int:
    """Two files of aligned records; their number."""
    done = [sinks.write_binary(records, f"{out}/{name}", fields) for name, fields in zip(names, (first, second), strict=True)]
    return done[0].agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]


def run_export_points(spark: SparkSession, web: str, out: str, big: int = 1000, sample: int | None = None) -> dict:
    """positions and attrs, and meta.json."""
    points = spark.read.parquet(web)
    lut = community.color_lut(cut(community.community_stats(points), "stats"), big)
    records = cut(export.quantize_points(export.export_order_points(points, sample), lut), "records")
    n = _pair(records, out, ("positions.bin", "attrs.bin"), {"x": "u2", "y": "u2"}, dict.fromkeys("rgbs", "u1"))
    filters = {"is_ring": False, "sample": sample}
    meta = {"count": n, "generated_from": web, "filters": filters, "files": {"positions": "positions.bin", "attrs": "attrs.bin"}, "quantization": QUANTIZED, "size_scale": SIZE_SCALE}
    meta["record_layout"] = {"positions.bin": "little-endian uint16 x, y", "attrs.bin": "uint8 r, g, b, s"}
    sinks.write_json(f"{out}/meta.json", meta)
    return meta


def run_export_ids(spark: SparkSession, web: str, out: str, sample: int | None = None) -> dict:
    """ids in the rows of the point export; added to its meta.json."""
    numbers = export.id_numbers(export.export_order_points(spark.read.parquet(web).select("id", "xw", "yw", "is_ring", "cited_by_count"), sample))
    done = sinks.write_binary(numbers, f"{out}/ids.bin", {"number": "u8"})
    meta = sinks.read_json(spark, f"{out}/meta.json") or {}
    n = done.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    meta["ids"] = {"count": n, "file": "ids.bin", "record_layout": "little-endian uint64, the digits of the id", "id_prefix": "A"}
    sinks.write_json(f"{out}/meta.json", meta)
    return meta


def run_export_edges(spark: SparkSession, edges_in: str, web: str, out: str, min_weight: float = 2, big: int = 1000, companion_bytes: int = COMPANION_BYTES, companion_edges: int = COMPANION_EDGES) -> dict:
    """edges_pos and edges_attr, heaviest first, edges_meta.json, and a companion pair of
    the heaviest edges where the files are large."""
    points = spark.read.parquet(web)
    lut = community.color_lut(cut(community.community_stats(points), "stats"), big)
    records = cut(export.export_order_edges(edges.quantize_edges(edges.edge_endpoints(spark.read.parquet(edges_in), points, min_weight), lut, WEIGHT_CAP)), "records")
    kinds = (dict.fromkeys(("x0", "y0", "x1", "y1"), "u2"), dict.fromkeys(("r0", "g0", "b0", "r1", "g1", "b1", "w", "s"), "u1"))
    n = _pair(records, out, ("edges_pos.bin", "edges_attr.bin"), *kinds)
    meta = {"count": n, "files": {"pos": "edges_pos.bin", "attr": "edges_attr.bin"}, "quantization": QUANTIZED, "size_scale": SIZE_SCALE, "weight_cap": WEIGHT_CAP, "min_weight": min_weight}
    meta["layout"] = {"edges_pos.bin": "little-endian uint16 x0, y0, x1, y1", "edges_attr.bin": "uint8 r0, g0, b0, r1, g1, b1, w, s"}
    if 16 * n > companion_bytes and n > companion_edges:
        _pair(records.where(F.col("row") < companion_edges), out, ("edges_pos_top.bin", "edges_attr_top.bin"), *kinds)
        meta["files"] |= {"pos_top": "edges_pos_top.bin", "attr_top": "edges_attr_top.bin"}
        meta["top_cap_edges"] = companion_edges
    sinks.write_json(f"{out}/edges_meta.json", meta)
    return meta


def run_map(spark: SparkSession, works: str, authors: str, positions: str, out: str, min_works: int = 15, max_authors: int = 50, big: int = 1000, min_weight: float = 2, spread: float = 1.6, ring_comm_max: int = 100, lowest: int = 0) -> dict:
    """All stages. The layout's positions(vertex, x, y) are an input: placing the graph is
    another program's work."""
    at = lambda name: f"{out}/{name}"
    report = {"partitions": run_extract(spark, works, at("works_authorships")), "nodes": run_filter(spark, authors, at("nodes"), min_works)}
    report["edges"] = run_edges(spark, at("works_authorships"), at("nodes"), at("edges"), max_authors)
    report["prep"] = run_prep(spark, at("nodes"), at("edges"), at("graph"))
    report["communities"] = run_communities(spark, at("graph"), at("communities"))
    report["coords"] = run_coords(spark, at("graph"), positions, at("communities/parts"), at("coords"))
    report["web"] = run_webcoords(spark, at("coords"), at("coords_web"), spread, ring_comm_max, big)
    report["lines"] = run_edgepx(spark, at("edges"), at("coords_web"), at("edges_px"), min_weight)
    report["regions"] = run_regions(spark, at("coords_web"), authors, at("site/regions.json"))
    report["tiles"] = run_tiles(spark, at("coords_web"), at("site"), at("edges_px"), None, at("site/regions.json"), big=big, lowest=lowest)
    report["index"] = run_index(spark, at("coords_web"), at("site"), big)
    report["points"] = run_export_points(spark, at("coords_web"), at("export"), big)
    report["ids"] = run_export_ids(spark, at("coords_web"), at("export"))
    report["records"] = run_export_edges(spark, at("edges"), at("coords_web"), at("export"), min_weight, big)
    return report


STAGES = {name.removeprefix("run_"): run for name, run in list(globals().items()) if name.startswith("run_")}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="peeratlas.jobs.stages", description=__doc__)
    chosen = parser.add_subparsers(dest="stage", required=True)
    for name, run in STAGES.items():
        own = chosen.add_parser(name, help=run.__doc__)
        for p in list(inspect.signature(run).parameters.values())[1:]:
            kind = type(p.default) if p.default is not p.empty and p.default is not None else str
            if kind is not tuple:
                own.add_argument(f"--{p.name}", required=p.default is p.empty, default=p.default, type=(lambda v: v == "true") if kind is bool else kind)
    args = vars(parser.parse_args(argv))
    run = STAGES[args.pop("stage")]
    print(run(SparkSession.builder.getOrCreate(), **args))


if __name__ == "__main__":
    main()
