"""Near-duplicate embeddings by spherical-cap filters."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import cut, drop
from .vectors import dimensions, padded, usable


def product_code(dims: int, codewords: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation, and unit codewords for either half of the rotated coordinates.
    A filter direction is one codeword of each half after the other."""
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    halves = [rng.normal(size=(codewords, n)) for n in (dims - dims // 2, dims // 2)]
    return rotation, [h / np.maximum(1e-12, np.linalg.norm(h, axis=1, keepdims=True)) for h in halves]


def half_scores(rows: np.ndarray, halves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Products of the rows' halves with all codewords of theirs; their sum is the row's
    product with a direction."""
    n = halves[0].shape[1]
    return rows[:, :n] @ halves[0].T, rows[:, n:] @ halves[1].T


def best_sums(first: np.ndarray, second: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in two descending lists, and the n largest sums of one number of each. They
    stand at places whose product (from 1) is at most n, so only those are summed."""
    keep = min(n, len(first))
    i, j = np.array([(a, b) for a in range(keep) for b in range(keep) if (a + 1) * (b + 1) <= n]).T
    sums = first[i] + second[j]
    top = np.argsort(-sums, kind="stable")[:n]
    return i[top], j[top], sums[top]


def cap_height(dims: int, code: tuple, filters: int, trials: int = 256) -> float:
    """The height over which the median random unit vector has so many filter directions."""
    rotation, halves = code
    x = np.random.default_rng(0).normal(size=(trials, dims))
    scores = half_scores(x / np.linalg.norm(x, axis=1, keepdims=True) @ rotation, halves)
    first, second = (-np.sort(-s, axis=1)[:, :filters] for s in scores)
    return float(np.median([best_sums(a, b, filters)[2][-1] for a, b in zip(first, second, strict=True)]))


def list_decode(rows: np.ndarray, halves: list[np.ndarray], height: float, fewest: int) -> tuple[np.ndarray, np.ndarray]:
    """All filter directions whose caps of this height hold each row, as numbers, and how
    many a row has. A row in fewer than fewest caps gets its fewest nearest directions.

    A codeword that can't reach the height with the best of the other half is dropped by
    one comparison; some dozens of each half remain, and their sums are compared. Rows are
    taken in tiles, so that a tile's scores are some 32 MB whatever the number of codewords.
    """
    codewords = len(halves[0])
    tile = max(1, (1 << 22) // codewords)
    found, counts = [], np.zeros(len(rows), np.int64)
    for start in range(0, len(rows), tile):
        scores = half_scores(rows[start : start + tile], halves)
        tops = [s.max(axis=1) for s in scores]
        places = [np.nonzero(s >= (height - other)[:, None] - 1e-12) for s, other in zip(scores, tops[::-1], strict=True)]
        ends = [np.searchsorted(p[0], np.arange(len(scores[0]) + 1)) for p in places]
        for row in range(len(scores[0])):
            one, two = (p[1][e[row] : e[row + 1]] for p, e in zip(places, ends, strict=True))
            a, b = scores[0][row, one], scores[1][row, two]
            i, j = np.nonzero(b[None, :] >= (height - a)[:, None])
            if len(i) >= fewest:
                numbers = one[i].astype(np.int64) * codewords + two[j]
            else:
                heads = [_largest(s[row], fewest) for s in scores]
                i, j, _ = best_sums(scores[0][row, heads[0]], scores[1][row, heads[1]], fewest)
                numbers = heads[0][i].astype(np.int64) * codewords + heads[1][j]
            counts[start + row] = len(numbers)
            found.append(numbers)
    return (np.concatenate(found) if found else np.zeros(0, np.int64)), counts


def _largest(scores: np.ndarray, n: int) -> np.ndarray:
    """The places of the n largest, in descending order."""
    n = min(n, len(scores))
    some = np.argpartition(-scores, n - 1)[:n]
    return some[np.argsort(-scores[some], kind="stable")]


def codewords_for(n: int) -> int:
    """Codewords a half, so that there are some 16 filters a vector: a filter then holds
    about one or two unrelated vectors, up to 2**17 codewords (a billion vectors; filters
    fill up beyond, and the work grows with it)."""
    return int(min(1 << 17, max(64, 2 ** np.ceil(np.log2(max(2, 16 * n)) / 2))))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision, summed in the order of components."""
    dot = lambda x, y: np.add.accumulate(x * y, axis=1)[:, -1]
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def near_tile(one: np.ndarray, other: np.ndarray, least: float) -> np.ndarray:
    """Which rows of one and other have a cosine of at least least: matrix products, and
    the exact sum where rounding could decide."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    found = unit(one) @ unit(other).T
    i, j = np.nonzero(np.abs(found - least) < 1e-12)
    found[i, j] = cosines(one[i], other[j])
    return found >= least


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dims)


def decoded(classes: DataFrame, dims: int, filters: int, codes: int, seed: int) -> DataFrame:
    """(cls, signs, f): the filters of each vector, and 64 signs of random projections."""
    codebooks = [product_code(dims, codewords_for(classes.count()), seed + c) for c in range(codes)]
    heights = [cap_height(dims, code, filters) for code in codebooks]
    planes = np.random.default_rng(seed - 1).normal(size=(dims, 64))
    at_once = max(16, (1 << 21) // len(codebooks[0][1][0]))
    shared = classes.sparkSession.sparkContext.broadcast((codebooks, planes))  # 2 * codes * codewords * dims numbers: 270 MB at the most codewords, a few here

    def of(batches):
        codebooks, planes = shared.value
        for batch in batches:
            all_rows = _matrix(batch.column(1), dims)
            for i in range(0, len(all_rows), at_once):
                x = all_rows[i : i + at_once]
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                signs = np.packbits(x @ planes > 0, axis=1, bitorder="little").view(np.int64)[:, 0]
                for c, ((rotation, halves), height) in enumerate(zip(codebooks, heights, strict=True)):
                    numbers, counts = list_decode(x @ rotation, halves, height, filters * 2 // 3)
                    row = np.repeat(np.arange(len(x)), counts)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + row)), pa.array(signs[row]), pa.array(numbers * codes + c)], ["cls", "signs", "f"])

    return classes.select("cls", "vec").mapInArrow(of, "cls long, signs long, f long")


def verified(pairs: DataFrame, classes: DataFrame, least: float, dims: int) -> DataFrame:
    """The rows of pairs(a, b, ...) whose vectors have a cosine of at least least."""

    def of(batches):
        for batch in batches:
            a, b = (_matrix(batch.column(c), dims) for c in ("va", "vb"))
            yield batch.drop_columns(["va", "vb"]).filter(pa.array(cosines(a, b) >= least, pa.bool_()))

    known = classes.select("cls", "vec")
    both = pairs.join(known.toDF("a", "va"), "a").join(known.toDF("b", "vb"), "b")
    return both.select(*pairs.columns, "va", "vb").mapInArrow(of, pairs.schema)


def linked_classes(classes: DataFrame, least: float, dims: int, filters: int = 24, codes: int = 2, seed: int = 3, most_flips: int = 24, star_rounds: int = 2) -> DataFrame:
    """(id, root) for the classes(cls, vec) that are linked with another one.

    Vectors that share a filter meet in joins that carry numbers and signs; pairs with
    more than most_flips different signs of 64 are left out (at cosine 0.95, 6.5 differ on
    average, 24 is over seven standard deviations more), the rest is verified. In star
    rounds only one member of a filter is compared with the others, which joins a group of
    near vectors with one pair a member. Then pairs of different classes are compared, one
    of them outside the filter's largest class.
    """
    every = cut(decoded(classes, dims, filters, codes, seed), "filters")
    shared = every.groupBy("f").agg(F.count("*").alias("rows")).where("rows > 1").select("f")
    blocks = cut(every.join(shared, "f"), "blocks")
    drop(every)
    roots = cut(classes.select("cls", F.col("cls").alias("root")), "roots")
    for turn in range(star_rounds + 1):
        held = blocks.join(roots, "cls").select("f", F.struct("cls", "root", "signs").alias("m"))
        pivot = F.max(F.struct(F.xxhash64("m.cls", F.lit(turn)).alias("h"), "m"))["m"]
        mixed = held.groupBy("f").agg(F.min("m.root").alias("lo"), F.max("m.root").alias("hi"), pivot.alias("p")).where("lo < hi").select("f", "p")
        if turn == star_rounds:
            sizes = held.groupBy("f", F.col("m.root").alias("root")).agg(F.count("*").alias("rows"))
            most = sizes.groupBy("f").agg(F.max(F.struct("rows", "root"))["root"].alias("most"))
            mixed = held.join(mixed.select("f"), "f").join(most, "f").where("m.root <> most").select("f", F.col("m").alias("p"))
        near = F.bit_count(F.col("m.signs").bitwiseXOR(F.col("p.signs"))) <= most_flips
        pairs = held.join(mixed, "f").where((F.col("m.root") != F.col("p.root")) & near)
        turned = F.col("m.cls") < F.col("p.cls")
        ends = [F.when(turned, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")) for c in ("cls", "root") for x, y in (("m", "p"), ("p", "m"))]
        pairs = cut(pairs.select(*ends).toDF("a", "b", "ra", "rb").distinct(), "pairs")
        joined = components(verified(pairs, classes, least, dims).select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        after = cut(roots.join(joined.toDF("root", "to"), "root", "left").select("cls", F.coalesce("to", "root").alias("root")), "roots")
        drop(pairs)
        drop(roots)
        roots = after
    drop(blocks)
    many = roots.groupBy("root").agg(F.count("*").alias("members")).where("members > 1")
    return roots.join(many, "root").select("cls", "root", "members")


def count_tile(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """(cls, links) within one bundle of small components, or between two blocks (part i
    and part j) of a large one: links of a class count the rows of the other."""
    out = []
    for _, own in rows.groupby("root", sort=False):
        i, j = int(own["i"].iloc[0]), int(own["j"].iloc[0])
        left, right = own[own["part"] == i], own[own["part"] == j]
        near = near_tile(np.stack(left["vec"].to_numpy()).astype(float), np.stack(right["vec"].to_numpy()).astype(float), least)
        if i == j:
            np.fill_diagonal(near, False)
        out.append(pd.DataFrame({"cls": left["cls"], "links": near @ right["n"].to_numpy(np.int64)}))
        if i != j:
            out.append(pd.DataFrame({"cls": right["cls"], "links": left["n"].to_numpy(np.int64) @ near}))
    return pd.concat(out)


def link_counts(classes: DataFrame, linked: DataFrame, least: float, block: int = 1024, bundle: int = 4096) -> DataFrame:
    """(cls, others): how many rows of other classes each class is linked with. All links
    of a class are in its component, so products of the component's members count them:
    small components go together in bundles, large ones are cut into blocks, and each
    pair of blocks is a group of bounded size. Only counts leave a group, never pairs."""
    members = linked.join(classes.select("cls", "vec", "n"), "cls")
    parts = F.ceil(F.col("members") / block).cast("int")
    members = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    bundles = max(1, -(-linked.count() // bundle))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    tiles = members.withColumn("to", other).withColumns({"i": F.least("part", "to"), "j": F.greatest("part", "to")})
    key = F.when(F.col("parts") > 1, F.col("root")).otherwise(-1 - F.pmod(F.xxhash64("root"), F.lit(bundles)))
    tiles = tiles.select(key.alias("key"), "i", "j", "root", "part", "cls", "n", "vec")
    found = tiles.groupBy("key", "i", "j").applyInPandas(lambda rows: count_tile(rows, least), "cls long, links long")
    return found.groupBy("cls").agg(F.sum("links").alias("others"))


def near_duplicates(vectors: DataFrame, least_cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", filters: int = 24, codes: int = 2, seed: int = 3) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Equal vectors form a class with a number of its own, whatever their ids; a row's links
    are all other rows with a cosine of least_cosine or more. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing: 0 links, their
    own component. Shorter vectors count as followed by zeros. Each repeated row gives a
    row; rows with one id and different vectors each count for themselves. A row without
    an id links too but names no component unless it is alone with such. An empty table
    gives no rows. Other columns are ignored.
    """
    dims = dimensions(vectors, vec_col)
    vec = F.when(usable(F.col(vec_col)), padded(F.col(vec_col), dims))
    rows = cut(vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"), F.xxhash64(F.lit(1), vec).alias("k1"), F.xxhash64(F.lit(2), vec).alias("k2")), "vectors")
    good = rows.where("vec is not null")
    classes = cut(good.groupBy("k1", "k2", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    linked = cut(linked_classes(classes, least_cosine, dims, filters, codes, seed), "linked")
    others = link_counts(classes, linked, least_cosine)
    names = classes.select("cls", "id").join(linked.select("cls", "root"), "cls").groupBy("root").agg(F.min("id").alias("component"))
    known = classes.select("k1", "k2", "cls", "id", "n").join(others, "cls", "left").join(linked.select("cls", "root"), "cls", "left").join(names, "root", "left")
    known = cut(known.select("k1", "k2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "known")
    met = good.select("vec_id", "k1", "k2").join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")  # 128 bits stand for the vector
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
