"""Curves between the communities of the map."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import cell, placed
from ..sources.storage import cut, drop


def grid_majority(web: DataFrame, grid: int = 512, min_cell: int = 6) -> DataFrame:
    """cx, cy, community: the majority of cells with enough members, dust left out."""
    rows = web.where(placed() & ~F.col("is_ring")).select(cell("xw", grid).alias("cx"), cell("yw", grid).alias("cy"), "community")
    each = rows.groupBy("cx", "cy", "community").agg(F.count("*").alias("c"))
    first = F.max_by("community", F.struct("c", -F.col("community"))).alias("community")
    cells = each.groupBy("cx", "cy").agg(F.sum("c").alias("n"), first)
    return cells.where(F.col("n") >= min_cell).select("cx", "cy", "community")


def smooth_majority(cells: DataFrame) -> DataFrame:
    """Each cell takes the community most of its 3 x 3 neighbourhood has; on a tie it
    stays as it is. Empty cells stay empty."""
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    votes = cells.withColumn("o", around).select((F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"), "community")
    counts = votes.groupBy("cx", "cy", "community").agg(F.count("*").alias("n"))
    best = counts.groupBy("cx", "cy").agg(F.max("n").alias("top"), F.collect_list(F.struct("n", "community")).alias("l"))  # nine at most
    winners = best.select("cx", "cy", F.filter("l", lambda x: x["n"] == F.col("top")).alias("w"))
    met = cells.join(winners, ["cx", "cy"])
    return met.select("cx", "cy", F.when(F.size("w") == 1, F.get("w", F.lit(0))["community"]).otherwise(F.col("community")).alias("community"))


def boundary_runs(cells: DataFrame, grid: int = 512) -> DataFrame:
    """Segments between different neighbours, runs on a grid line merged: dir (h: along a
    column's right side, v: along a row's upper side), line, a, b in cells."""
    other = cells.withColumnRenamed("community", "_c")
    right = cells.join(other.withColumn("cx", F.col("cx") - 1), ["cx", "cy"]).where("community <> _c").select(F.lit("h").alias("dir"), (F.col("cx") + 1).alias("line"), F.col("cy").alias("pos"))
    above = cells.join(other.withColumn("cy", F.col("cy") - 1), ["cx", "cy"]).where("community <> _c").select(F.lit("v").alias("dir"), (F.col("cy") + 1).alias("line"), F.col("cx").alias("pos"))
    island = F.col("pos") - F.row_number().over(Window.partitionBy("dir", "line").orderBy("pos"))  # a grid line: grid rows at most
    return right.union(above).withColumn("g", island).groupBy("dir", "line", "g").agg(F.min("pos").alias("a"), (F.max("pos") + 1).alias("b")).drop("g")


def segments(runs: DataFrame, grid: int) -> DataFrame:
    """Runs as ordered end points: n (their order), x0, y0, x1, y1."""
    at = lambda c: F.round(F.col(c) / grid, 6)
    h = F.col("dir") == "h"
    return runs.select("dir", "line", "a", F.when(h, at("line")).otherwise(at("a")).alias("x0"), F.when(h, at("a")).otherwise(at("line")).alias("y0"), F.when(h, at("line")).otherwise(at("b")).alias("x1"), F.when(h, at("b")).otherwise(at("line")).alias("y1"))


def joined_groups(lines: DataFrame) -> DataFrame:
    """lines with grp: equal for segments that hang together by end points. Smallest
    labels travel along shared points until nothing changes; rounds are written."""
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    keyed = cut(lines.withColumn("seg", F.struct("dir", "line", "a")), "segments")
    ends = keyed.select("seg", point("x0", "y0").alias("p")).union(keyed.select("seg", point("x1", "y1").alias("p")))
    labels = cut(keyed.select("seg", F.col("seg").alias("grp")), "groups")
    while True:
        near = ends.join(labels, "seg").groupBy("p").agg(F.min("grp").alias("low"))
        moved = ends.join(near, "p").groupBy("seg").agg(F.min("low").alias("low"))
        jump = moved.join(labels.withColumnsRenamed({"seg": "low", "grp": "far"}), "low").select("seg", F.least("low", "far").alias("grp"))
        after = cut(jump, "groups")
        changed = not after.join(labels.withColumnRenamed("grp", "old"), "seg").where("grp <> old").isEmpty()
        drop(labels)
        labels = after
        if not changed:
            return keyed.join(labels, "seg").drop("seg")


def path_points(ends: np.ndarray) -> np.ndarray:
    """The points along one path or ring, from its segments' end points (n, 2, 2).

    At a point two segments meet at most. A path runs from that of its two ends that
    comes first by x and y; a ring from its first point towards the first of the two next
    to it, and ends where it began.
    """
    points, at = np.unique(ends.reshape(-1, 2), axis=0, return_inverse=True)
    at = at.reshape(-1)  # the point of each half: 2 * segment and 2 * segment + 1
    order = np.argsort(at, kind="stable")
    met = np.flatnonzero(at[order][1:] == at[order][:-1])
    partner = np.full(len(at), -1)
    partner[order[met]], partner[order[met + 1]] = order[met + 1], order[met]
    open_ = np.flatnonzero(partner < 0)
    if len(open_):
        half = open_[np.argmin(at[open_])]
    else:
        two = np.flatnonzero(at == 0)
        half = two[np.argmin(at[two ^ 1])]
    visited = [at[half]]
    for _ in range(len(ends)):
        visited.append(at[half ^ 1])
        half = partner[half ^ 1]
    return points[visited]


def cut_corners(points: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Inner corners replaced by points at 1/4 and 3/4 of the segments; ends stay."""
    for _ in range(rounds if len(points) > 2 else 0):
        a, b = points[:-1], points[1:]
        inner = np.stack([a * 0.75 + b * 0.25, a * 0.25 + b * 0.75], axis=1).reshape(-1, 2)
        points = np.concatenate([points[:1], inner, points[-1:]])
    return points


def boundary_polylines(web: DataFrame, grid: int = 512, min_cell: int = 6, smooth_passes: int = 3, min_len: float = 0.02) -> DataFrame:
    """points (to six digits) and length of the map's smoothed boundary curves that are
    long enough.

    Runs on a grid line are merged, so at a point end one run along the column and one
    along the row at most: what hangs together by end points is a path or a ring, and each
    is drawn as a group of its own (at most 2 grid^2 segments in all).
    """
    cells = grid_majority(web, grid, min_cell)
    for _ in range(smooth_passes):
        cells = smooth_majority(cells)
    grouped = joined_groups(segments(boundary_runs(cells, grid), grid))

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        path = path_points(rows[["x0", "y0", "x1", "y1"]].to_numpy(float).reshape(-1, 2, 2))
        length = float(np.abs(np.diff(path, axis=0)).sum())  # all segments lie along the grid
        return pd.DataFrame({"points": [cut_corners(path).tolist()], "length": [length]}).loc[[length >= min_len]]

    keyed = grouped.withColumn("key", F.to_json("grp")).drop("grp")
    drawn = keyed.groupBy("key").applyInPandas(lambda rows: draw(rows), "points array<array<double>>, length double")
    return drawn.withColumn("points", F.transform("points", lambda p: F.transform(p, lambda v: F.round(v, 6))))


def boundary_document(lines: DataFrame, most_lines: int = 1_000_000) -> dict:
    """The curves as a GeoJSON collection of one MultiLineString; there are at most as many
    as the grid has segments, and more than most_lines are an error."""
    rows = lines.select("points").orderBy("points").limit(most_lines + 1).collect()
    if len(rows) > most_lines:
        raise ValueError(f"more than {most_lines} curves for one document")
    shape = {"type": "MultiLineString", "coordinates": [r["points"] for r in rows]}
    return {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": shape}] if rows else []}
