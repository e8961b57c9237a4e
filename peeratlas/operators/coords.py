"""Layout coordinates to the unit square."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import unit_hash
from ..sources.storage import cut
from .community import community_size
from .quantiles import exact_quantiles, exact_quantiles_of

MARGIN = 0.02
COLUMNS = ["id", "display_name", "xw", "yw", "community", "works_count", "cited_by_count", "institution", "field", "is_ring"]


def assemble_coords(numbered: DataFrame, positions: DataFrame, parts: DataFrame) -> DataFrame:
    """Nodes with the positions and communities of their numbers, null where they have none."""
    met = numbered.join(positions.withColumnRenamed("vertex", "node_idx"), "node_idx", "left").join(parts.withColumnsRenamed({"vertex": "node_idx", "partition": "community"}), "node_idx", "left")
    return met.select("id", "display_name", "x", "y", "community", "works_count", "cited_by_count", "institution", "field")


def center_scale(coords: DataFrame) -> DataFrame:
    """One row: medians of x and y, and the median distance from there (1e-9 at least);
    nulls where no row has a position."""
    xy = coords.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    middle = exact_quantiles_of(xy, {"x": [0.5], "y": [0.5]})
    (cx,), (cy,) = middle["x"], middle["y"]
    dx, dy = F.col("x") - F.lit(cx), F.col("y") - F.lit(cy)
    (s,) = exact_quantiles(xy.select(F.sqrt(dx * dx + dy * dy).alias("r")), "r", [0.5]) if cx is not None and cy is not None else (None,)
    return coords.sparkSession.createDataFrame([(cx, cy, None if s is None else max(s, 1e-9))], "cx double, cy double, s double")


def radial(coords: DataFrame, ring_comm_max: int = 100, center: DataFrame | None = None) -> DataFrame:
    """coords with comm_n, a (compressed radius), theta, is_ring, ru and th. Scalars of the
    whole map (one row each) come to the driver; the polar form is written once.

    Dust: members of communities smaller than ring_comm_max that lie beyond 0.9 of the
    largest radius (0: no dust). ru: radius over the largest of the rest, 1 at most;
    dust is scattered over a ring by hashes of its id.
    """
    center = (center_scale(coords) if center is None else center).first()
    sized = community_size(coords.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")}))
    dx, dy = F.col("x") - F.lit(center["cx"]), F.col("y") - F.lit(center["cy"])
    radius = F.asinh(F.sqrt(dx * dx + dy * dy) / F.lit(center["s"]))
    polar = cut(sized.withColumns({"a": radius, "theta": F.atan2(dy, dx)}), "polar")  # read four times from here on
    largest = lambda df: df.agg(F.max("a")).first()[0] or 1e-9
    ring = (F.col("comm_n") < ring_comm_max) & (F.col("a") > 0.9 * largest(polar)) if ring_comm_max > 0 else F.lit(False)
    flagged = polar.withColumn("is_ring", ring)
    core = largest(flagged.where("not is_ring"))
    ru = F.when(F.col("is_ring"), 0.60 + 0.38 * unit_hash(F.col("id"))).otherwise(F.least(F.col("a") / core, F.lit(1.0)))
    th = F.when(F.col("is_ring"), 2 * F.pi() * unit_hash(F.concat("id", F.lit("/t")))).otherwise(F.col("theta"))
    return flagged.withColumns({"ru": ru, "th": th})


def spread_communities(placed: DataFrame, spread: float = 1.35, big: int = 1000) -> DataFrame:
    """Core rows with sx, sy: large communities move outward by (spread - 1) of their mean."""
    core = placed.where("not is_ring").withColumns({"ex": F.col("ru") * F.cos("th"), "ey": F.col("ru") * F.sin("th")})
    means = core.where(F.col("comm_n") >= big).groupBy("community").agg(F.avg("ex").alias("mx"), F.avg("ey").alias("my"))
    met = core.join(means.withColumnRenamed("community", "_of"), F.col("community").eqNullSafe(F.col("_of")), "left").drop("_of")
    shift = lambda e, m: F.col(e) + F.coalesce((spread - 1.0) * F.col(m), F.lit(0.0))
    return met.withColumns({"sx": shift("ex", "mx"), "sy": shift("ey", "my")}).drop("mx", "my")


def web_coords(coords: DataFrame, spread: float = 1.35, ring_comm_max: int = 100, big: int = 1000) -> DataFrame:
    """The whole transform: xw, yw in [MARGIN, 1 - MARGIN] and is_ring."""
    return _on_the_square(radial(coords, ring_comm_max), spread, big)


def _on_the_square(placed: DataFrame, spread: float, big: int) -> DataFrame:
    shifted = spread_communities(placed, spread, big)
    longest = shifted.agg(F.max(F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")))).first()[0]
    half, smax = 0.5 - MARGIN, max(longest or 0.0, 1e-9)
    core = shifted.withColumns({"xw": 0.5 + half * F.col("sx") / smax, "yw": 0.5 + half * F.col("sy") / smax})
    dust = placed.where("is_ring").withColumns({"xw": 0.5 + half * F.col("ru") * F.cos("th"), "yw": 0.5 + half * F.col("ru") * F.sin("th")})
    return core_dust_union(core, dust)


def core_dust_union(core: DataFrame, dust: DataFrame) -> DataFrame:
    """The placed rows of both kinds as one table of the web columns; other columns go."""
    return core.select(*COLUMNS).unionByName(dust.select(*COLUMNS))


def transformed(coords: DataFrame, spread: float = 1.35, ring_comm_max: int = 100, big: int = 1000) -> tuple[DataFrame, DataFrame]:
    """web_coords and one row of figures for the document beside it: n, cx, cy, s, r2max,
    ring_n, spread."""
    center = center_scale(coords)
    placed = radial(coords, ring_comm_max, center)
    sums = placed.agg(F.count("*").alias("n"), F.max(F.when(~F.col("is_ring"), F.col("a"))).alias("r2max"), F.count(F.when(F.col("is_ring"), 1)).alias("ring_n"))
    return _on_the_square(placed, spread, big), sums.crossJoin(F.broadcast(center)).withColumn("spread", F.lit(float(spread)))
