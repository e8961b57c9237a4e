"""Fixed-width exports and quality figures."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import byte_of, id_number, placed, size_byte
from ..sources.storage import cut
from .edges import with_row_index
from .quantiles import exact_quantiles, exact_quantiles_of


def export_order_points(web: DataFrame, sample: int | None = None) -> DataFrame:
    """Placed authors that aren't dust with row: most cited first, then by id; the first
    sample. All files of points stand in this order."""
    rows = web.where(placed() & ~F.col("is_ring"))
    if sample:
        rows = rows.orderBy(F.col("cited_by_count").desc(), "id").limit(sample)
    return with_row_index(rows, [F.col("cited_by_count").desc(), F.col("id").asc()], "row")


def quantize_points(points: DataFrame, lut: DataFrame) -> DataFrame:
    """Records of the point export: 16-bit positions, colour and size byte."""
    place = lambda c: byte_of(F.col(c) * 65535, 65535)
    size = size_byte(F.col("cited_by_count"))
    met = points.join(lut.withColumnRenamed("community", "_of"), F.col("community").eqNullSafe(F.col("_of")))
    return met.select("row", "id", place("xw").alias("x"), place("yw").alias("y"), "r", "g", "b", size.alias("s"))


def id_numbers(points: DataFrame) -> DataFrame:
    return points.select("row", "id", id_number("id").alias("number"))


def export_order_edges(quantized: DataFrame, sample: int | None = None) -> DataFrame:
    """Edges with row: heaviest first, then by src and dst; the first sample."""
    order = [F.col("weight").desc(), F.col("src").asc(), F.col("dst").asc()]
    rows = quantized.orderBy(*order).limit(sample) if sample else quantized
    return with_row_index(rows, order, "row")


def sample_rows(coords: DataFrame, rows: int = 2_000_000, seed: int = 42) -> DataFrame:
    """A fixed number of rows with positions: those with the smallest hashes of their ids,
    the same in every run and partitioning, found without a global sort."""
    return coords.where("x is not null").orderBy(F.md5(F.concat(F.lit(f"{seed}-"), "id")), "id").limit(rows)


def qa_window(coords: DataFrame, width: float = 0.15) -> DataFrame:
    """id, x, y, hue of rows within width standard deviations of the median point."""
    rows = coords.where("x is not null")
    middle = exact_quantiles_of(rows, {"x": [0.5], "y": [0.5]})
    (mx,), (my,) = middle["x"], middle["y"]
    sx, sy = rows.agg(F.stddev_samp("x"), F.stddev_samp("y")).first()
    near = lambda v, m, s: F.col(v).between(F.lit(m) - width * F.lit(s), F.lit(m) + width * F.lit(s))
    return rows.where(near("x", mx, sx) & near("y", my, sy)).select("id", "x", "y", (F.col("community") % 40).alias("hue"))


def citation_percentiles(web: DataFrame, exact: bool = True) -> DataFrame:
    """p50, p99, p999, p9999 of citations: exact, or approximate in one pass."""
    shares, names = [0.5, 0.99, 0.999, 0.9999], ["p50", "p99", "p999", "p9999"]
    if exact:
        return web.sparkSession.createDataFrame([tuple(exact_quantiles(web, "cited_by_count", shares))], ", ".join(f"{n} double" for n in names))
    values = F.percentile_approx("cited_by_count", F.array(*[F.lit(p) for p in shares]), F.lit(100_000))
    return web.agg(values.alias("p")).select(*[F.col("p")[i].cast("double").alias(n) for i, n in enumerate(names)])


def weight_distance_report(edges: DataFrame, web: DataFrame, least: float = 5.0, near: float = 0.02) -> DataFrame:
    """How well the map keeps collaboration together: kind (strong or random), pairs,
    median distance, share in the same community, share within near.

    Random pairs: each author with the one whose hash comes next, by ranges of hashes.
    """
    points = web.select("id", "xw", "yw", "community")
    end = lambda n: points.toDF(f"id{n}", f"x{n}", f"y{n}", f"c{n}")
    strong = edges.where(F.col("weight") >= least).select(F.col("src").alias("id0"), F.col("dst").alias("id1"), F.lit("strong").alias("kind"))
    mark = F.md5(F.concat(F.lit("pair-"), "id"))
    slice_ = F.substring("m", 1, 3)  # 4,096 ranges of hashes
    order = Window.partitionBy("slice").orderBy("m")
    shuffled = points.select("id", mark.alias("m")).withColumn("slice", slice_).withColumn("id1", F.lead("id").over(order))
    chance = shuffled.where("id1 is not null").select(F.col("id").alias("id0"), "id1", F.lit("random").alias("kind"))
    met = strong.union(chance).join(end(0), "id0").join(end(1), "id1")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rows = cut(met.select("kind", F.sqrt(dx * dx + dy * dy).alias("d"), (F.col("c0") == F.col("c1")).alias("same")), "distances")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    found = rows.groupBy("kind").agg(F.count("*").alias("pairs"), share(F.col("same")).alias("same_community"), share(F.col("d") <= near).alias("near"))
    kinds = {kind: [0.5] for kind in ("strong", "random")}
    distances = rows.select(*[F.when(F.col("kind") == kind, F.col("d")).alias(kind) for kind in kinds])
    medians = [(kind, value) for kind, (value,) in exact_quantiles_of(distances, kinds).items()]
    return found.join(F.broadcast(web.sparkSession.createDataFrame(medians, "kind string, median_distance double")), "kind")  # two rows


def near_coauthor_share(edges: DataFrame, web: DataFrame, near: float = 0.02) -> DataFrame:
    """authors (placed ones that have a placed coauthor) and the share of them that have
    one within near. Each author's flag is pre-aggregated before it is shuffled."""
    points = web.where(placed()).select("id", "xw", "yw")
    met = edges.select("src", "dst").join(points.toDF("src", "x0", "y0"), "src").join(points.toDF("dst", "x1", "y1"), "dst")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    ends = met.select(F.explode(F.array("src", "dst")).alias("id"), (F.sqrt(dx * dx + dy * dy) <= near).alias("near"))
    each = ends.groupBy("id").agg(F.max("near").alias("near"))
    return each.agg(F.count("*").alias("authors"), F.avg(F.when(F.col("near"), 1.0).otherwise(0.0)).alias("share"))
