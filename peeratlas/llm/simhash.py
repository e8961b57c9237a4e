"""Near-duplicate texts by 64-bit SimHash and pigeonhole blocks."""

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import text_slices
from .components import components
from .storage import cut, drop

BITS = 64


def fingerprint(text: bytes, shingle_words: int = 4, seed: int = 42, at_once: int = 1 << 16) -> int:
    """SimHash of one text, as a signed 64-bit number.

    Words are runs of other bytes than ASCII white space after lower-casing A-Z; every
    place of a shingle counts. A text with fewer words than a shingle is one shingle, a
    text without words has fingerprint 0. A bit is 1 if more than half the hashes set it.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: max(1, len(words) - shingle_words + 1)], ends[shingle_words - 1 :]
    if not len(ends):
        ends = np.array([len(joined)])
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, len(starts), at_once):
        spans = zip(starts[i : i + at_once].tolist(), ends[i : i + at_once].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * set_bits > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp long) for every row; a null text counts as empty. One pass, no shuffle."""

    def of(batches):
        for rows, texts in text_slices(batches):
            found = [fingerprint(t, shingle_words, seed) for t in texts.cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(of, f"id {kind}, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """Signed masks of all choices of blocks - distance of the blocks that 64 bits split
    into. Two numbers that differ in at most distance bits leave that many blocks alone,
    so they agree under one of the masks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(one, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def choose_blocks(n: int, distance: int) -> int:
    """The number of blocks with the least expected rows plus candidate pairs for n
    different fingerprints. The links found are the same for any number."""

    def cost(blocks: int) -> float:
        keys = comb(blocks, distance)
        return keys * n * (1 + n / 2.0 ** (1 + BITS * (blocks - distance) / blocks))

    return min(range(distance + 1, distance + 6), key=cost)


def by_blocks(rows: DataFrame, blocks: int, distance: int, code: str = "fp") -> DataFrame:
    """Each row once a block mask, with mask and key: its code under the mask."""
    masks = F.array(*[F.lit(m) for m in block_masks(blocks, distance)])
    return rows.select("*", F.explode(masks).alias("mask")).withColumn("key", F.col(code).bitwiseAND(F.col("mask")))


def block_sizes(held: DataFrame) -> DataFrame:
    """held(mask, key, cls, ...) -> the blocks of several classes: mask, key, rows, most (the
    class with most rows) and outside (the rows of the others), counted class by class."""
    by_class = held.groupBy("mask", "key", "cls").agg(F.count("*").alias("rows"))
    blocks = by_class.groupBy("mask", "key").agg(F.sum("rows").alias("rows"), F.max(F.struct("rows", "cls")).alias("top"))
    return blocks.select("mask", "key", "rows", F.col("top.cls").alias("most"), (F.col("rows") - F.col("top.rows")).alias("outside")).where("outside > 0")


def link_components(prints: DataFrame, distance: int = 4, blocks: int | None = None, star_rounds: int = 1, most_outside: int = 4) -> DataFrame:
    """prints(fp long, n long), fp unique -> (fp, root): components under links of at
    most distance differing bits. Exact for any input.

    Pairs are never listed within a group of near copies. First every block's most
    frequent fingerprint is linked with the block's others within the distance, which
    joins a group of copies into one class with one row per member; star_rounds more do
    so with other members of blocks that hold several classes. Then the fingerprints
    outside a block's largest class are compared with all others of other classes, so
    pairs within the largest are never listed.

    Fingerprints of one template share most bits, so that blocks which would tell random
    ones apart are large. Where more than most_outside are outside a block's largest
    class, its members are taken again with one block more, that is with longer and more
    keys: two within the distance share one of those too. This goes on while it costs
    fewer rows than the pairs it saves; the links are the same at any level. Counts and
    pivots are pre-aggregated; the joins can be split by AQE where a block is hot.
    """
    level = blocks or choose_blocks(prints.count(), distance)
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance

    def joined(before, pairs):
        """before(fp, cls) with the classes that pairs(a, b) link made one."""
        roots = components(pairs)
        after = cut(before.join(roots.withColumnRenamed("id", "cls"), "cls", "left").select("fp", F.coalesce("root", "cls").alias("cls")), "classed")
        drop(roots)
        drop(before)
        return after

    every = by_blocks(prints, level, distance)
    pivots = every.groupBy("mask", "key").agg(F.count("*").alias("size"), F.max(F.struct("n", "fp"))["fp"].alias("pivot")).where("size > 1").select("mask", "key", "pivot")
    stars = every.join(pivots, ["mask", "key"]).where((F.col("fp") != F.col("pivot")) & near("fp", "pivot")).select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    classed = joined(prints.select("fp", F.col("fp").alias("cls")), stars)

    for turn in range(star_rounds):
        every = by_blocks(classed, level, distance)
        drawn = F.max(F.struct(F.xxhash64("fp", F.lit(turn)).alias("h"), "fp", "cls"))
        mixed = every.groupBy("mask", "key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), drawn.alias("p")).where("lo < hi")
        pairs = every.join(mixed.select("mask", "key", F.col("p.fp").alias("fb"), F.col("p.cls").alias("cb")), ["mask", "key"]).where((F.col("cls") != F.col("cb")) & near("fp", "fb"))
        classed = joined(classed, pairs.select(F.col("cls").alias("a"), F.col("cb").alias("b")))

    members = classed
    while members is not None:
        every = by_blocks(members, level, distance)
        sized = cut(block_sizes(every), "sized")
        held = cut(every.join(sized.select("mask", "key"), ["mask", "key"]).select("mask", "key", "fp", "cls"), "mixed")
        hot = sized.where(F.col("outside") > most_outside)
        saved = hot.agg(F.sum(F.col("rows") * F.col("outside"))).first()[0] or 0
        again, now = None, sized
        if saved:
            again = cut(held.join(hot.select("mask", "key"), ["mask", "key"]).select("fp").distinct(), "again")
            if saved > 2 * comb(level + 1, distance) * again.count():
                now = sized.where(F.col("outside") <= most_outside)
            else:
                drop(again)
                again = None
        other = held.join(now.select("mask", "key", "most"), ["mask", "key"]).where("cls <> most").select("mask", "key", F.col("fp").alias("fb"), F.col("cls").alias("cb"))
        pairs = held.join(other, ["mask", "key"]).where((F.col("cls") != F.col("cb")) & near("fp", "fb"))
        classed = joined(classed, pairs.select(F.col("cls").alias("a"), F.col("cb").alias("b")))
        members = None
        if again is not None:
            level += 1
            members = cut(classed.join(again, "fp"), "members")
            drop(again)
        drop(held)
        drop(sized)
    found = classed.withColumnRenamed("cls", "root")
    found._shared_path = classed._shared_path
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, seed: int = 42, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """One row per input row: id, fp long, component_id (the smallest id reachable by links).

    Null and empty texts have fingerprint 0 and link like any other; rows with a repeated
    id each give a row; a null id takes part but never names a component unless alone
    with nulls. An empty table gives no rows. Other columns are ignored.
    """
    marked = cut(fingerprints(docs, id_col, text_col, shingle_words, seed), "prints")
    prints = cut(marked.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("first")), "distinct-prints")
    roots = link_components(prints.select("fp", "n"), distance, blocks)
    rooted = cut(prints.select("fp", "first").join(roots, "fp"), "rooted")
    drop(prints)
    drop(roots)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("id", "fp", "component_id")
