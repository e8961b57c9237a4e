"""Nearest neighbours by inner product with randomly rotated one-bit codes."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import checked, cut, drop
from .vectors import dimensions, padded, usable

#: Bits that a query's rotated coordinates are rounded to.
QUERY_BITS = 4


def rotation(dims: int, bits: int, seed: int) -> np.ndarray:
    """Orthonormal columns: vectors keep lengths and inner products in bits coordinates."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(max(bits, dims), dims)))[0].T


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated vectors (64 a word), their lengths, and the cosine of
    each vector and its code: the correction of estimates and their error."""
    turned = x @ turn
    length = np.linalg.norm(turned, axis=1)
    fit = np.abs(turned).sum(1) / np.maximum(1e-300, length) / np.sqrt(turned.shape[1])
    packed = np.packbits(turned > 0, axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64), length, np.where(length > 0, fit, 1.0)


def query_planes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rotated queries as whole numbers of QUERY_BITS bits: bit planes packed like codes
    (planes, queries, words), the least value and step of each query, and its numbers' sum."""
    least = turned.min(1)
    step = np.maximum((turned.max(1) - least) / (2**QUERY_BITS - 1), 1e-300)
    whole = np.rint((turned - least[:, None]) / step[:, None]).astype(np.uint8)
    planes = [np.packbits((whole >> p) & 1, axis=1, bitorder="little").view(np.uint64) for p in range(QUERY_BITS)]
    return np.stack(planes), least, step, whole.sum(1, dtype=np.int64)


def shared_bits(planes: np.ndarray, codes: np.ndarray, tile: int = 4096) -> np.ndarray:
    """For each query and code the weighted number of bits that the query's planes share
    with the code, in tiles that stay in a core's cache."""
    found = np.empty((planes.shape[1], len(codes)), np.int32)
    for start in range(0, len(codes), tile):
        words = np.ascontiguousarray(codes[start : start + tile].T)
        total = np.zeros((planes.shape[1], words.shape[1]), np.int32)
        for p, plane in enumerate(planes):
            bits = np.zeros(total.shape, np.uint16 if len(words) < 1024 else np.uint32)
            for w, word in enumerate(words):
                bits += np.bitwise_count(plane[:, w, None] & word[None])
            total += bits.astype(np.int32) << p
        found[:, start : start + tile] = total
    return found


def estimates(turned: np.ndarray, codes: np.ndarray, length: np.ndarray, fit: np.ndarray, width: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of rotated queries and coded vectors, and how far off they
    may be: width standard deviations of the part of a vector that its code doesn't tell
    and of the queries' rounding. With width None the bound is certain: by Cauchy-Schwarz
    the length of that part, and half a step in every coordinate.

    A product with signs is twice the sum over bits that are set less the sum over all;
    the sum over set bits is the bits that codes and planes share, weighed by plane.
    """
    bits = turned.shape[1]
    planes, least, step, total = query_planes(turned)
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
    signed = step[:, None] * (2 * shared_bits(planes, codes) - total[:, None]) + least[:, None] * (2 * ones - bits)[None, :]
    scale = length / fit / np.sqrt(bits)
    untold = np.linalg.norm(turned, axis=1)[:, None] * (length * np.sqrt(np.maximum(0, 1 - fit**2)) / fit)[None, :]
    if width is None:
        slack = 1e-9 * np.linalg.norm(turned, axis=1)[:, None] * (length + 1)[None, :]  # of floating point
        return signed * scale, untold + step[:, None] * bits / 2 * scale[None, :] + slack
    rounding = step[:, None] * np.sqrt(bits / 12) * scale[None, :]
    return signed * scale, width * np.sqrt(untold**2 / (bits - 1) + rounding**2)


def group_centers(x: np.ndarray, groups: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centers of so many cells of a sample, by Lloyd's rounds from members of it."""
    if len(x) == 0:
        return np.zeros((1, x.shape[1]))
    centers = x[np.random.default_rng(seed).permutation(len(x))[: max(1, min(groups, len(x)))]]
    for _ in range(rounds if len(centers) > 1 else 1):
        cell = nearest_center(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, cell, x)
        counts = np.bincount(cell, minlength=len(centers))[:, None]
        centers = np.where(counts > 0, sums / np.maximum(1, counts), centers)
    return centers


def nearest_center(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centers.T - (centers**2).sum(1) / 2, axis=1)


def needed_probes(sample: np.ndarray, centers: np.ndarray, k: int, share: float, queries: int = 256) -> int:
    """How many cells a query must see, those with the largest inner products of their
    centers first, to hold this share of its k nearest: measured within the sample. With
    more rows the nearest are nearer, so the share grows."""
    if len(centers) == 1 or len(sample) < 2:
        return len(centers)
    asked = sample[:queries]
    products = asked @ sample.T
    np.fill_diagonal(products, -np.inf)
    best = np.argsort(-products, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    place = np.argsort(np.argsort(-(asked @ centers.T), axis=1, kind="stable"), axis=1)
    at = np.take_along_axis(place, nearest_center(sample, centers)[best], 1)
    return int(np.quantile(at, share, method="higher")) + 1


SCAN = "query long, row long, guess double"


def scan_block(queries: pd.DataFrame, rows: pd.DataFrame, turn: np.ndarray, center: np.ndarray, k: int | None, width: float | None, at_once: int = 16) -> pd.DataFrame:
    """Of one block of rows, for each query: the k with the largest estimates; without k
    all whose upper bound reaches the query's floor."""
    parts = []
    if len(queries) and len(rows):
        ids, numbers = rows["vec_id"].to_numpy(), rows["row"].to_numpy()
        codes = np.frombuffer(b"".join(rows["code"]), np.uint64).reshape(len(rows), -1)
        length, fit = rows["length"].to_numpy(), rows["fit"].to_numpy()
        names, keys, floors = (queries[c].to_numpy() for c in ("query_id", "query", "floor"))
        wanted = np.stack(queries["vec"].to_numpy()).astype(float)
        for i in range(0, len(keys), at_once):
            query = wanted[i : i + at_once]
            guess, off = estimates(query @ turn, codes, length, fit, width)
            guess += (query @ center)[:, None]
            guess[ids[None, :] == names[i : i + at_once, None]] = -np.inf
            if k is None:
                q, r = np.nonzero(guess + off >= floors[i : i + at_once, None])
            else:
                best = np.argpartition(-guess, min(k, len(rows)) - 1, axis=1)[:, : min(k, len(rows))]
                q, r = np.repeat(np.arange(len(query)), best.shape[1]), best.ravel()
            some = np.isfinite(guess[q, r])
            parts.append((keys[i + q[some]], numbers[r[some]], guess[q[some], r[some]]))
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.array([], t) for t in (np.int64, np.int64, float)]
    return pd.DataFrame(dict(zip(("query", "row", "guess"), columns, strict=True)))


def exact_products(pairs: DataFrame, dims: int) -> DataFrame:
    """pairs(..., q, v) with score: inner products in double precision, in the order of components."""

    def of(batches):
        for batch in batches:
            q, v = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, dims) for c in ("q", "v"))
            score = np.add.accumulate(q * v, axis=1)[:, -1] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score)], [*kept, "score"])

    kept = [c for c in pairs.columns if c not in ("q", "v")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema if f.name in kept)
    return pairs.mapInArrow(of, f"{kinds}, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", bits: int = 1024, width: float | None = 3.5, cells: int | None = None, probes: int | None = None, sample_rows: int = 8192, block_rows: int = 65_536, block_queries: int = 512, share: float = 0.98, seed: int = 9) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows by inner product in
    double precision, ties to the smaller id, rows with the query's own id left out; all
    rows where there are fewer than k.

    Every row gets the nearest of `cells` centers (one for each two blocks of rows, 1,024
    at most) and a code of `bits` signs of its rotated difference from there. Centers come
    from the sample_rows rows with the smallest hashes; so does the number of cells that a
    query sees (`probes`; all cells where probes = cells). Blocks of a cell's codes,
    without vectors, meet blocks of the queries that see it, in groups of bounded size,
    twice. The first time each block names the k rows with the largest estimates; the best
    k of all blocks are computed exactly, and their k-th product is the query's floor. The
    second time a row passes if its upper bound reaches the floor. Vectors are joined only
    to the rows that passed, and reranked exactly.

    The floor is exact and never above the k-th nearest, so a neighbour in a seen cell is
    lost only where its estimate is more than `width` standard deviations too low: for the
    neighbour that lies at the floor 2 in 10,000 at 3.5, for nearer ones less. `width=None`
    with `probes` = `cells` is exact: bounds are then certain, and cost most of the pruning.

    Of rows with equal vectors the k + 1 smallest ids count, as no others can be among the
    nearest: a vector that stands on very many rows costs no more. Vectors that are null,
    empty, zero or hold null or non-finite components take no part (nor do null ids);
    shorter ones count as followed by zeros; of rows that repeat id and vector one counts.
    Rows with one id and different vectors count each: as queries they are ranked apart, as
    candidates both may appear. Empty tables give no rows; other columns are ignored.
    """
    dims = max(dimensions(vectors, vec_col), dimensions(queries, vec_col))
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).where(usable(F.col("vec"))).where("vec_id is not null").withColumn("vec", padded(F.col("vec"), dims))
    numbered = lambda df: df.distinct().withColumn("row", F.monotonically_increasing_id())
    of_equal = F.dense_rank().over(Window.partitionBy("vec").orderBy("vec_id"))
    rows, asked = cut(numbered(clean(vectors).withColumn("n", of_equal).where(F.col("n") <= k + 1).drop("n")), "rows"), cut(numbered(clean(queries)), "queries")
    n_rows, n_asked = rows.count(), asked.count()
    drawn = F.xxhash64("vec_id", F.lit(seed))
    likely = rows if n_rows <= 4 * sample_rows else rows.where(drawn.bitwiseAND((1 << 52) - 1) < int((1 << 52) * 2.0 * sample_rows / n_rows))
    few = likely.orderBy(drawn.bitwiseAND((1 << 52) - 1), "vec_id", "row").limit(sample_rows).select("vec_id", "vec").toArrow()
    sample = few.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
    centers = group_centers(sample, cells or min(1024, max(1, n_rows // (2 * block_rows))), seed=seed)
    seen = min(probes or needed_probes(sample, centers, k, share), len(centers))
    words = -(-max(bits, dims, 64) // 64) * 64
    turn = rotation(dims, words, seed)
    matrix = lambda column: column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dims)

    def coded(batches):
        for batch in batches:
            x = matrix(batch.column(2))
            cell = nearest_center(x, centers)
            codes, length, fit = encode(x - centers[cell], turn)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(fit)], ["row", "vec_id", "cell", "code", "length", "fit"])

    index = cut(rows.select("row", "vec_id", "vec").mapInArrow(coded, "row long, vec_id long, cell int, code binary, length double, fit double"), "index")
    sizes = np.zeros(len(centers), np.int64)
    for r in index.groupBy("cell").count().collect():  # a row a cell
        sizes[r["cell"]] = r["count"]
    blocks = np.maximum(1, -(-sizes // block_rows))

    def placed(batches):
        for batch in batches:
            x = matrix(batch.column(2))
            order = np.argsort(-(x @ centers.T), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            fewest = 1 + (held < 8 * k).sum(1)  # cells with hardly a row don't count
            stops = np.minimum(np.maximum(seen, fewest), len(centers))
            lists = [o[:n].tolist() for o, n in zip(order, stops, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lists, pa.list_(pa.int32()))], ["query", "query_id", "vec", "cells"])

    kind = asked.schema["vec"].dataType.simpleString()
    wanted = cut(asked.select("row", "vec_id", "vec").mapInArrow(placed, f"query long, query_id long, vec {kind}, cells array<int>"), "wanted")
    rounds = np.zeros(len(centers), np.int64)  # blocks of queries by the cell that they see
    for r in wanted.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect():
        rounds[r["cell"]] = -(-r["count"] // block_queries)
    of_cell = lambda counts: F.get(F.array(*[F.lit(int(c)) for c in counts]), F.col("cell"))
    part = lambda key, n: F.pmod(F.xxhash64(key, F.lit(seed + 1)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    right = index.where(of_cell(rounds) > 0).withColumn("r", part("row", of_cell(blocks))).withColumn("q", each(of_cell(rounds)))
    key = ["cell", "r", "q"]

    def scanned(floors: DataFrame | None) -> DataFrame:
        asking = wanted.withColumn("floor", F.lit(float("-inf"))) if floors is None else wanted.join(floors, "query", "left")
        left = asking.withColumn("cell", F.explode("cells")).drop("cells").withColumn("r", each(of_cell(blocks))).withColumn("q", part("query", of_cell(rounds)))
        best = k if floors is None else None

        def scan(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            cell = int((a if len(a) else b)["cell"].iloc[0])
            return scan_block(a, b, turn, centers[cell], best, width)

        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(scan, SCAN)

    vec = F.col("vec")
    few_queries = F.broadcast if n_asked * dims <= 1 << 22 else lambda table: table  # at most 32 MB of doubles

    def products(pairs: DataFrame) -> DataFrame:
        named = pairs.join(rows.select("row", "vec_id", vec.alias("v")), "row")
        met = named.join(few_queries(asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), vec.alias("q"))), "query")
        return exact_products(met.select("query", "query_id", "vec_id", "row", "q", "v"), dims)

    first = lambda n, *order: F.row_number().over(Window.partitionBy("query").orderBy(*order)) <= n
    likely = cut(scanned(None).withColumn("first", first(k, F.col("guess").desc(), "row")).where("first").select("query", "row"), "likely")
    kth = F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf"))
    floors = cut(products(likely).groupBy("query").agg(kth.alias("floor")), "floors")
    maybe = cut(scanned(checked(floors, 100_000)).select("query", "row"), "maybe")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "row"))
    found = cut(products(maybe).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    for table in (rows, asked, index, wanted, likely, floors, maybe):
        drop(table)
    return found
