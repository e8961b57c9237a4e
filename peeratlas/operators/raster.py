"""Pixels, pyramid and tile layers."""

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import MAX_ZOOM, PIXELS, TILE, cell, citation_tier, placed
from ..sources.storage import checked, cut

MISSING = (0.35, 0.35, 0.35)
MISSING_SPLAT = (0.6, 0.6, 0.6)
EDGE_RGB = (0.45, 0.50, 0.60)
EDGE_CEILING = 0.25
FLOOR, GAMMA = 0.05, 1.25
GLOW_SIDE, GLOW_CORNER = 0.12, 0.06


def pixel_bin(web: DataFrame, pixels: int = PIXELS) -> DataFrame:
    return web.withColumns({"px": cell("xw", pixels), "py": cell("yw", pixels)})


def tile_xyz(pixels: DataFrame, zoom: int) -> DataFrame:
    """px, py of a zoom to tile and place in it, rows counted from the top."""
    down = lambda c: (F.col(c) / TILE).cast("int")
    flip = (1 << zoom) - 1
    return pixels.withColumns({"tx": down("px"), "ty": F.lit(flip) - down("py"), "ix": F.col("px") % TILE, "iy": F.lit(TILE - 1) - F.col("py") % TILE})


def pixel_majority(web: DataFrame, pixels: int = PIXELS) -> DataFrame:
    """px, py, cnt and the community most rows of the pixel have (ties: the smallest).
    Both steps are plain aggregates, pre-summed before the shuffle."""
    each = pixel_bin(web.where(placed()), pixels).groupBy("px", "py", "community").agg(F.count("*").alias("c"))
    first = F.max_by("community", F.struct("c", -F.col("community")))
    return each.groupBy("px", "py").agg(F.sum("c").alias("cnt"), first.alias("community"))


def pyramid_level(level: DataFrame, from_pixels: bool = False) -> DataFrame:
    """One zoom less: counts of 2 x 2 pixels summed, the community of the heaviest (not of
    the raw counts). Of equal ones the first by row and column from the pixel table
    (from_pixels), by column and row from a level made here."""
    tie = ("py", "px") if from_pixels else ("px", "py")
    order = F.struct("cnt", *[-F.col(c) for c in tie])
    half = lambda c: F.shiftright(c, 1).alias(c)
    return level.groupBy(half("px"), half("py")).agg(F.sum("cnt").alias("cnt"), F.max_by("community", order).alias("community"))


def pyramid(pixels: DataFrame, lowest: int = 0, highest: int = MAX_ZOOM) -> DataFrame:
    """All zooms in one table: z, px, py, cnt, community. Each level is written once and
    makes the next, so no plan holds more than one of the steps."""
    level, levels = pixels, [pixels.withColumn("z", F.lit(highest))]
    for z in range(highest - 1, lowest - 1, -1):
        level = cut(pyramid_level(level, z == highest - 1), f"level-{z}")
        levels.append(level.withColumn("z", F.lit(z)))
    out = levels[0]
    for one in levels[1:]:
        out = out.unionByName(one)
    return out


def brightness(levels: DataFrame) -> DataFrame:
    """(z, cnt) to bright: the share of the zoom's pixels with at most that count, shaped.
    The window runs over a zoom's different counts, not over its pixels."""
    counts = levels.groupBy("z", "cnt").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("z").orderBy("cnt"))
    share = upto / F.sum("n").over(Window.partitionBy("z"))
    return counts.select("z", "cnt", (FLOOR + (1 - FLOOR) * F.pow(share, F.lit(GAMMA))).alias("bright"))


def tile_pixels(levels: DataFrame, palette: DataFrame) -> DataFrame:
    """The base layer of z: tx, ty, ix, iy and colour."""
    lit = levels.join(brightness(levels), ["z", "cnt"]).join(palette, "community", "left")
    shade = lambda c, other: (F.coalesce(F.col(c), F.lit(other)) * F.col("bright")).alias(c)
    flip = F.expr("shiftleft(1, z)") - 1
    place = [(F.col("px") / TILE).cast("int").alias("tx"), (flip - (F.col("py") / TILE).cast("int")).alias("ty"), (F.col("px") % TILE).alias("ix"), (TILE - 1 - F.col("py") % TILE).alias("iy")]
    return lit.select("z", *place, *[shade(c, o) for c, o in zip("rgb", MISSING, strict=True)])


def splat_tiers(web: DataFrame, bottom: int = 5_000) -> DataFrame:
    """Much cited authors, dust left out: px, py at the largest zoom, community, rad0."""
    much = web.where(placed() & ~F.col("is_ring") & (F.col("cited_by_count") >= bottom))
    return pixel_bin(much).select("id", "px", "py", "community", citation_tier(F.col("cited_by_count"), bottom).alias("rad0"))


def splat_radius_at_zoom(splats: DataFrame, zoom: int) -> DataFrame:
    """Splats that show at a zoom, with their radius and pixel there; none below 9."""
    shift = MAX_ZOOM - zoom
    rows = splats.withColumn("rad", F.col("rad0") - shift).where(F.col("rad") > 0)
    rows = rows if zoom >= MAX_ZOOM - 1 else rows.where(F.lit(False))
    return rows.withColumns({"px": F.shiftright("px", shift), "py": F.shiftright("py", shift)})


def splat_colors(splats: DataFrame, palette: DataFrame, zoom: int) -> DataFrame:
    rows = splat_radius_at_zoom(splats, zoom).join(palette, "community", "left")
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(other)) for c, other in zip("rgb", MISSING_SPLAT, strict=True)})


def splat_pixels(splats: DataFrame, palette: DataFrame, zoom: int) -> DataFrame:
    """Discs around the splats, within the splat's own tile, largest value per channel."""
    line = F.sequence(-F.col("rad"), F.col("rad"))
    rows = splat_colors(splats, palette, zoom)
    rows = rows.withColumn("dx", F.explode(line)).withColumn("dy", F.explode(line))
    rows = rows.where(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") <= F.col("rad") * F.col("rad"))
    own = lambda p, d: (F.floor((F.col(p) + F.col(d)) / TILE) == F.floor(F.col(p) / TILE))
    rows = rows.where(own("px", "dx") & own("py", "dy")).withColumns({"px": F.col("px") + F.col("dx"), "py": F.col("py") + F.col("dy")})
    return tile_xyz(rows, zoom).groupBy("tx", "ty", "ix", "iy").agg(*[F.max(c).alias(c) for c in "rgb"])


#: Samples of a line that go to tiles together: so few touch two columns and rows of tiles at most.
CHUNK = 256
#: Chunks of lines in one group of a task; tiles with more are summed in several groups first.
MOST_CHUNKS = 100_000
_LINE = ["x0", "y0", "x1", "y1", "k0", "k1"]


def edge_chunks(lines: DataFrame, zoom: int) -> DataFrame:
    """tx, ty, x0, y0, x1, y1, k0, k1: lines in pixels of a zoom, a row for each tile and
    chunk of samples k0 to k1 that may touch it."""
    shift, flip = MAX_ZOOM - zoom, (1 << zoom) - 1
    ends = lines.select(*[F.shiftright(c, shift).alias(c) for c in _LINE[:4]])
    ends = ends.withColumn("steps", F.greatest(F.lit(1), F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))))
    rows = ends.withColumn("k0", F.explode(F.sequence(F.lit(0), "steps", F.lit(CHUNK)))).withColumn("k1", F.least("steps", F.col("k0") + CHUNK - 1))
    tile = lambda a, b, k: F.shiftright(F.rint(F.col(a) + F.col(k) * ((F.col(b) - F.col(a)) / F.col("steps"))).cast("int"), 8)
    rows = rows.withColumns({"tx": F.array(tile("x0", "x1", "k0"), tile("x0", "x1", "k1")), "ty": F.array(tile("y0", "y1", "k0"), tile("y0", "y1", "k1"))})
    rows = rows.withColumn("tx", F.explode(F.array_distinct("tx"))).withColumn("ty", F.explode(F.array_distinct("ty")))
    return rows.select("tx", (F.lit(flip) - F.col("ty")).alias("ty"), *_LINE)


def add_samples(hits: np.ndarray, tx: int, ty_up: int, x0, y0, x1, y1, k0, k1, at_once: int = 4096) -> None:
    """Add the samples of chunks that lie in a tile to its counts (iy, ix from the top). A
    line is sampled at as many points as its longer side has pixels (two at least), rounded
    half to even."""
    steps = np.maximum(1, np.maximum(np.abs(x1 - x0), np.abs(y1 - y0))).astype(float)
    for i in range(0, len(x0), at_once):
        some = slice(i, i + at_once)
        n = k1[some] - k0[some] + 1
        row = np.repeat(np.arange(i, i + len(n)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + k0[row]
        px = np.rint(x0[row] + k * ((x1 - x0) / steps)[row]).astype(np.int64)
        py = np.rint(y0[row] + k * ((y1 - y0) / steps)[row]).astype(np.int64)
        inside = (px >> 8 == tx) & (py >> 8 == ty_up)
        hits += np.bincount((255 - (py[inside] & 255)) << 8 | px[inside] & 255, minlength=TILE * TILE).reshape(TILE, TILE)


def _hits_of(rows: pd.DataFrame, zoom: int) -> np.ndarray:
    """A tile's sample counts from its chunks and from counts that were summed before."""
    hits = np.zeros((TILE, TILE), np.int64)
    done = rows["body"].notna().to_numpy()
    for body in rows["body"][done]:
        hits += np.frombuffer(zlib.decompress(body), "<i8").reshape(TILE, TILE)
    if not done.all():
        add_samples(hits, int(rows["tx"].iloc[0]), (1 << zoom) - 1 - int(rows["ty"].iloc[0]), *(rows[c].to_numpy(np.int64)[~done] for c in _LINE))
    return hits


def edge_parts(lines: DataFrame, zoom: int, occupied: DataFrame | None = None) -> DataFrame:
    """Chunks of lines, and for tiles with more than MOST_CHUNKS the counts of groups of
    them (dealt by a hash of the line) in their place: tx, ty, x0 .. k1, body. So a group
    is bounded wherever the lines lie. occupied: only these tiles (tx, ty)."""
    chunks = edge_chunks(lines, zoom)
    if occupied is not None:
        chunks = chunks.join(occupied, ["tx", "ty"], "left_semi")
    plain = chunks.withColumn("body", F.lit(None).cast("binary"))
    many = chunks.groupBy("tx", "ty").count().where(F.col("count") > MOST_CHUNKS)
    many = cut(many.select("tx", "ty", F.ceil(F.col("count") / MOST_CHUNKS).alias("parts")), "dense-tiles")
    if many.isEmpty():
        return plain

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        body = zlib.compress(_hits_of(rows.assign(body=None), zoom).astype("<i8").tobytes(), 1)
        return rows[["tx", "ty", *_LINE]].iloc[:1].assign(body=[body])

    dense = plain.drop("body").join(checked(many), ["tx", "ty"]).withColumn("part", F.pmod(F.xxhash64(*_LINE), F.col("parts")))
    kinds = "tx int, ty int, " + ", ".join(f"{c} int" for c in _LINE) + ", body binary"
    summed = dense.groupBy("tx", "ty", "part").applyInPandas(add, kinds)
    return plain.join(checked(many.select("tx", "ty")), ["tx", "ty"], "left_anti").unionByName(summed)


def edge_pixels(lines: DataFrame, occupied: DataFrame, zoom: int, alpha: float) -> DataFrame:
    """Alpha of edges per pixel of a zoom: tx, ty, ix, iy, alpha; in occupied tiles (tx, ty)
    only. A row is shuffled for each tile and chunk of a line, not one for each sample; a
    task adds the samples up in the tile's array."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        hits = _hits_of(rows, zoom)
        iy, ix = np.nonzero(hits)
        return pd.DataFrame({"tx": rows["tx"].iloc[0], "ty": rows["ty"].iloc[0], "ix": ix.astype(np.int32), "iy": iy.astype(np.int32), "alpha": hits[iy, ix] * alpha})

    return by_tile(edge_parts(lines, zoom, occupied)).applyInPandas(add, "tx int, ty int, ix int, iy int, alpha double")


def edge_layer(sums: DataFrame) -> DataFrame:
    """Colour of the edge layer: summed alpha up to a ceiling, times grey."""
    light = F.least(F.col("alpha"), F.lit(EDGE_CEILING))
    return sums.select("tx", "ty", "ix", "iy", *[(light * v).alias(c) for c, v in zip("rgb", EDGE_RGB, strict=True)])


def glow_of(layer: np.ndarray) -> np.ndarray:
    """What each pixel of a tile gets from its neighbours in the tile: the layer's eight
    shifted copies, weighed and summed, in the box that holds all light."""
    lit, out = layer.any(axis=2), np.zeros_like(layer)
    rows, columns = np.flatnonzero(lit.any(axis=1)), np.flatnonzero(lit.any(axis=0))
    if not len(rows):
        return out
    top, bottom, left, right = max(0, rows[0] - 1), min(TILE, rows[-1] + 2), max(0, columns[0] - 1), min(TILE, columns[-1] + 2)
    wide, box = np.pad(layer[top:bottom, left:right], ((1, 1), (1, 1), (0, 0))), out[top:bottom, left:right]
    height, width = box.shape[:2]
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dx or dy:
                box += (GLOW_CORNER if dx and dy else GLOW_SIDE) * wide[1 - dy : 1 - dy + height, 1 - dx : 1 - dx + width]
    return out


def by_tile(rows: DataFrame):
    """Rows grouped by tile, in as many tasks as the session's shuffles have: a tile costs
    an array's work however few its rows are, so tasks aren't to be merged by their bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tx", "ty").groupBy("tx", "ty")


def bloom(layer: DataFrame) -> DataFrame:
    """The glow that a layer's pixels give to their neighbours in the same tile; a tile is
    one group of 65,536 rows at most, and its glow one convolution."""

    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        lit = np.zeros((TILE, TILE, 4))
        lit[rows["iy"], rows["ix"]] = np.column_stack([rows[["r", "g", "b"]].to_numpy(float), np.ones(len(rows))])
        glow = glow_of(lit)
        iy, ix = np.nonzero(glow[:, :, 3])
        r, g, b = glow[iy, ix, :3].T
        return pd.DataFrame({"tx": rows["tx"].iloc[0], "ty": rows["ty"].iloc[0], "ix": ix.astype(np.int32), "iy": iy.astype(np.int32), "r": r, "g": g, "b": b})

    return by_tile(layer.select("tx", "ty", "ix", "iy", "r", "g", "b")).applyInPandas(spread, "tx int, ty int, ix int, iy int, r double, g double, b double")


def compose(rows: pd.DataFrame, zoom: int, alpha: float, glow: bool) -> np.ndarray | None:
    """A tile's image from its rows of tile_layers(); None without a node pixel. Edges (their
    summed alpha up to a ceiling, times grey) under nodes, which replace them, under splats,
    which take the larger value; then the glow, clipped and cut off to bytes."""
    kind = rows["kind"].to_numpy()
    nodes, lines, spots = (rows[kind == k] for k in (NODES, EDGES, SPLATS))
    if not len(nodes):
        return None
    layer = np.zeros((TILE, TILE, 3))
    if len(lines):
        light = np.minimum(_hits_of(lines, zoom) * alpha, EDGE_CEILING)
        layer[:] = light[:, :, None] * np.array(EDGE_RGB)
    layer[nodes["y0"].to_numpy(np.int64), nodes["x0"].to_numpy(np.int64)] = nodes[["r", "g", "b"]].to_numpy(float)
    for (ix, iy, rad), rgb in zip(spots[["x0", "y0", "k0"]].to_numpy(np.int64).tolist(), spots[["r", "g", "b"]].to_numpy(float), strict=True):
        left, right, top, bottom = max(0, ix - rad), min(TILE, ix + rad + 1), max(0, iy - rad), min(TILE, iy + rad + 1)
        y, x = np.ogrid[top - iy : bottom - iy, left - ix : right - ix]
        within = (x * x + y * y <= rad * rad)[:, :, None]
        disc = layer[top:bottom, left:right]
        disc[:] = np.where(within, np.maximum(disc, rgb), disc)
    if glow:
        layer = layer + glow_of(layer)
    return (np.clip(layer, 0, 1) * 255).astype(np.uint8)  # cut off


def png(image: np.ndarray) -> bytes:
    """An RGB image as PNG."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height, width = image.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 9)) + chunk(b"IEND", b"")


def render_tiles(pixels: DataFrame) -> DataFrame:
    """tx, ty, png: one image a tile from byte pixels; a group has 65,536 rows at most."""

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((TILE, TILE, 3), np.uint8)
        image[rows["iy"], rows["ix"]] = rows[["r", "g", "b"]].to_numpy(np.uint8)
        return pd.DataFrame({"tx": rows["tx"].iloc[:1], "ty": rows["ty"].iloc[:1], "png": [png(image)]})

    return pixels.groupBy("tx", "ty").applyInPandas(draw, "tx int, ty int, png binary")


def tile_image(body: bytes) -> np.ndarray:
    """The pixels of an image that png() made."""
    raw, at = b"", 8
    while at < len(body):
        n = int.from_bytes(body[at : at + 4], "big")
        if body[at + 4 : at + 8] == b"IDAT":
            raw += body[at + 8 : at + 8 + n]
        at += 12 + n
    width = int.from_bytes(body[16:20], "big")
    return np.frombuffer(zlib.decompress(raw), np.uint8).reshape(-1, 1 + 3 * width)[:, 1:].reshape(-1, width, 3)


def tile_bytes(tiles: DataFrame) -> DataFrame:
    """tx, ty, ix, iy, r, g, b of the pixels of tiles(tx, ty, png) that aren't black."""

    def read(batches):
        for batch in batches:
            for tx, ty, body in zip(batch["tx"], batch["ty"], batch["png"], strict=True):
                image = tile_image(body)
                iy, ix = np.nonzero(image.any(axis=2))
                r, g, b = image[iy, ix].astype(np.int32).T
                yield pd.DataFrame({"tx": np.int32(tx), "ty": np.int32(ty), "ix": ix.astype(np.int32), "iy": iy.astype(np.int32), "r": r, "g": g, "b": b})

    return tiles.mapInPandas(read, "tx int, ty int, ix int, iy int, r int, g int, b int")


NODES, EDGES, SPLATS = 0, 1, 2


def tile_layers(nodes: DataFrame, zoom: int, lines: DataFrame | None = None, splats: DataFrame | None = None) -> DataFrame:
    """Rows of all layers in one shape, ready for one exchange by tile: node pixels (place
    in x0, y0; colour), edges as in edge_parts(), splats (centre in x0, y0; radius in k0)."""
    none = lambda kind, *names: {c: F.lit(None).cast(kind) for c in names}
    columns = ["tx", "ty", "kind", *_LINE, "body", "r", "g", "b"]
    place = {"x0": F.col("ix").cast("int"), "y0": F.col("iy").cast("int")}
    rows = nodes.withColumns({"kind": F.lit(NODES), **place, **none("int", *_LINE[2:]), **none("binary", "body")}).select(*columns)
    if lines is not None:
        rows = rows.union(edge_parts(lines, zoom).withColumns({"kind": F.lit(EDGES), **none("double", "r", "g", "b")}).select(*columns))
    if splats is not None:
        spots = splats.withColumns({"kind": F.lit(SPLATS), **place, **none("int", "x1", "y1", "k1"), "k0": F.col("rad").cast("int"), **none("binary", "body")})
        rows = rows.union(spots.select(*columns))
    return rows


def render_zoom(levels: DataFrame, palette: DataFrame, zoom: int, splats: DataFrame | None = None, lines: DataFrame | None = None, one_off: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """Images of a zoom's occupied tiles, or of those in only(tx, ty): tx, ty, png. Edges
    show at 8 and 9, one-off edges at 10, splats and glow from 9 on.

    All layers meet in one exchange by tile; composition, glow and PNG are one step on the
    tile's array. A group has 65,536 node pixels, MOST_CHUNKS chunks of lines and the
    tile's splats at most. Tiles without a node pixel have no image.
    """
    nodes = tile_pixels(levels.where(F.col("z") == zoom), palette).drop("z")
    drawn = lines if zoom in (MAX_ZOOM - 2, MAX_ZOOM - 1) else one_off if zoom == MAX_ZOOM else None
    spots = None if splats is None or zoom < MAX_ZOOM - 1 else tile_xyz(splat_colors(splats, palette, zoom), zoom)
    rows = tile_layers(nodes, zoom, drawn, spots)
    if only is not None:  # brightness is that of the whole zoom
        rows = rows.join(only, ["tx", "ty"], "left_semi")
    alpha, glow = 0.05 if zoom == MAX_ZOOM else 0.08, zoom >= MAX_ZOOM - 1

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        image = compose(rows, zoom, alpha, glow)
        return pd.DataFrame({"tx": rows["tx"].iloc[:1], "ty": rows["ty"].iloc[:1], "png": [png(image)]} if image is not None else {"tx": [], "ty": [], "png": []})

    return by_tile(rows).applyInPandas(draw, "tx int, ty int, png binary")


def tile_occupancy(levels: DataFrame) -> DataFrame:
    """z, pixels, tiles: how many of the pyramid's levels(z, px, py) are occupied."""
    by_tile = levels.groupBy("z", F.shiftright("px", 8).alias("tx"), F.shiftright("py", 8).alias("ty")).agg(F.count("*").alias("n"))
    return by_tile.groupBy("z").agg(F.sum("n").alias("pixels"), F.count("*").alias("tiles"))
