"""Near copies of texts: exact Jaccard similarity of word shingles on candidates of SimHash blocks and MinHash bands."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import text_slices
from .components import components
from .simhash import BITS, by_blocks, choose_blocks, link_components
from .storage import checked, cut, drop

#: Two sets of Jaccard similarity s share a band with probability 1 - (1 - s^5)^32: all but 3 in a million at 0.8.
BANDS, ROWS = 32, 5
#: Least similarity of a link, as a fraction: whole numbers decide it exactly.
LEAST = (4, 5)
#: Most bits in which the SimHashes of two sets differ that are candidates by these alone.
DISTANCE = 4
#: Longs of parity bits a set.
PARITY = 8


def shingles(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """The set of the text's shingles as ascending 64-bit hashes. Words and short texts
    are those of simhash.fingerprint; a text without words has no shingles."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(found[i : i + words]), seed) for i in range(max(1, len(found) - words + 1))), np.uint64))


def band_keys(hashes: np.ndarray, at_once: int = 1 << 10) -> list[int]:
    """One signed 64-bit key a band: the hash of its ROWS minima and its number."""
    draw = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
    flip, times = draw[0] * np.uint64(2) + np.uint64(1), draw[1] * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), at_once):
        mixed = (hashes[i : i + at_once] ^ flip) * times
        np.minimum(least, mixed.min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def parity(hashes: np.ndarray) -> list[int]:
    """For each of 64 * PARITY classes of hashes whether the set has an odd number of them:
    two sets differ in at least as many elements as their parities in bits."""
    odd = np.bincount((hashes % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def may_link(a: str, b: str):
    """False only for sets whose sizes and parities rule out a similarity of LEAST: sets
    that reach it differ in at most (1 - t) / (1 + t) of their sizes' sum."""
    part, whole = LEAST
    apart = sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(PARITY)), F.lit(0))
    sizes = F.col(f"{a}.size") + F.col(f"{b}.size")
    return (F.least(f"{a}.size", f"{b}.size") * whole >= F.greatest(f"{a}.size", f"{b}.size") * part) & (apart * (whole + part) <= sizes * (whole - part))


def set_print(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of the set: equal for equal sets."""
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes(), 7)], np.uint64).view(np.int64)[0])


def sim_print(hashes: np.ndarray, at_once: int = 1 << 16) -> int:
    """SimHash of the set, signed: a bit is 1 if more than half the shingles set it."""
    set_bits = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), at_once):
        set_bits += np.unpackbits(hashes[i : i + at_once].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.int64)[0])


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, size int, sim long, bits and keys array<long>) for every row; a null text counts as empty."""

    def of(batches):
        for rows, texts in text_slices(batches):
            sets = [shingles(t) for t in texts.cast(pa.large_binary()).to_pylist()]
            longs = lambda of_set, sets=sets: pa.array([of_set(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(map(set_print, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(map(sim_print, sets), pa.int64()), longs(parity), longs(band_keys)], ["id", "fp", "size", "sim", "bits", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(of, f"id {kind}, fp long, size int, sim long, bits array<long>, keys array<long>")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) for every row: the hash of its set of shingles."""

    def of(batches):
        for rows, texts in text_slices(batches):
            found = [set_print(shingles(t)) for t in texts.cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(of, f"id {kind}, fp long")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, body binary) of the sets in wanted(fp, first); first is a doc_id with the set, or
    null. Texts are filtered by these ids where they are read."""

    def of(batches):
        for _, texts in text_slices(batches):
            sets = [shingles(t) for t in texts.cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_print, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "body"])

    ids = checked(wanted.where("first is not null").select(F.col("first").alias("doc_id")).distinct())
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").select("text")
    if not wanted.where("first is null").isEmpty():
        texts = texts.union(docs.where("doc_id is null").select("text"))
    return texts.mapInArrow(of, "fp long, body binary").join(checked(wanted.select("fp")), "fp", "left_semi").dropDuplicates(["fp"])


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of pairs(fa, fb, ...) whose sets have a Jaccard similarity of at least LEAST."""
    part, whole = LEAST

    def of(batches):
        for batch in batches:
            keep = []
            for one, other in zip(batch.column("body_a"), batch.column("body_b"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (one, other))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(whole * both >= part * (len(a) + len(b) - both))
            yield batch.drop_columns(["body_a", "body_b"]).filter(pa.array(keep, pa.bool_()))

    bodies = pairs.join(sets.toDF("fa", "body_a"), "fa").join(sets.toDF("fb", "body_b"), "fb")
    return bodies.select(*pairs.columns, "body_a", "body_b").mapInArrow(of, pairs.schema)


def sim_blocks(prints: DataFrame) -> DataFrame:
    """prints(fp, sim) -> (fp, key): the SimHash blocks of sets that links of at most
    DISTANCE bits join with other sets, within what they join. Two sets whose SimHashes
    differ in so few bits share a key."""
    codes = cut(prints.groupBy("sim").agg(F.count("*").alias("n")), "codes")
    roots = link_components(codes.select(F.col("sim").alias("fp"), "n"), DISTANCE)
    alike = cut(prints.join(roots.toDF("sim", "joined"), "sim").select("fp", "sim", "joined"), "alike")
    several = alike.groupBy("joined").agg(F.count("*").alias("sets")).where("sets > 1").select("joined")
    held = cut(alike.join(several, "joined"), "held")
    for old in (codes, roots, alike):
        drop(old)
    keyed = by_blocks(held, choose_blocks(held.count(), DISTANCE), DISTANCE, "sim").select("fp", F.xxhash64("joined", "mask", "key").alias("key"))
    kept = cut(keyed, "sim-blocks")
    drop(held)
    return kept


def near_copies(docs: DataFrame, star_rounds: int = 2) -> DataFrame:
    """One row per input row: id, fp long, root long (the component), component_id (its smallest id).

    A link: the sets of 5-word shingles have a Jaccard similarity of at least 0.8, checked
    exactly. Candidates share a block of SimHashes that differ in at most 4 bits (sim_blocks),
    or, for what differs in more, one of 32 bands; they pass may_link, which loses none.
    Equal sets are one row from the start. In star rounds only one member of a band's block is compared with the others, which joins
    a group of near copies with one pair a member; then all pairs of different classes.
    Ids, nulls and empty texts count as in simhash.near_duplicates.
    """
    marked = cut(sketches(docs), "sketches")
    same = [F.first(c).alias(c) for c in ("size", "sim", "bits", "keys")]
    prints = cut(marked.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("first"), *same), "sets")
    close = sim_blocks(prints.select("fp", "sim"))
    every = prints.select("fp", F.explode("keys").alias("key")).union(close)
    shared = every.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    blocks = cut(every.join(shared, "key").select("fp", "key"), "blocks")
    drop(close)
    wanted = cut(prints.join(blocks.select("fp").distinct(), "fp", "left_semi").select("fp", "first", "n", "size", "bits"), "wanted")
    sets = cut(shingle_sets(docs, wanted.select("fp", "first")), "bodies")
    classes = cut(wanted.select("fp", F.col("fp").alias("cls")), "classes")
    tried = None
    for turn in range(star_rounds + 1):
        held = blocks.join(wanted.join(classes, "fp"), "fp").select("key", "cls", F.struct("fp", "cls", "size", "bits").alias("m"), (F.col("n") if turn == 0 else F.xxhash64("fp", F.lit(turn))).alias("rank"))
        mixed = held.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.max(F.struct("rank", "m"))["m"].alias("p")).where("lo < hi")
        if turn < star_rounds:
            pairs = held.join(mixed.select("key", "p"), "key")
        else:  # of two classes of a block one at least is not its largest: pairs within that one are never compared
            largest = held.groupBy("key", "cls").agg(F.count("*").alias("rows")).groupBy("key").agg(F.max(F.struct("rows", "cls"))["cls"].alias("most"))
            one = held.join(mixed.select("key"), "key").join(largest, "key").where("cls <> most").select("key", F.col("m").alias("p"))
            pairs = held.join(one, "key")
        pairs = pairs.where((F.col("m.cls") != F.col("p.cls")) & may_link("m", "p"))
        pairs = pairs.select(F.col("m.fp").alias("fa"), F.col("p.fp").alias("fb"), F.col("m.cls").alias("ca"), F.col("p.cls").alias("cb"))
        ordered = F.col("fa") < F.col("fb")
        pairs = pairs.select(F.least("fa", "fb").alias("fa"), F.greatest("fa", "fb").alias("fb"), F.when(ordered, F.col("ca")).otherwise(F.col("cb")).alias("ca"), F.when(ordered, F.col("cb")).otherwise(F.col("ca")).alias("cb")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["fa", "fb"], "left_anti")
        pairs = cut(pairs, "candidates")
        roots = components(linked(pairs, sets).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        after = cut(classes.join(roots.withColumnRenamed("id", "cls"), "cls", "left").select("fp", F.coalesce("root", "cls").alias("cls")), "classes")
        drop(classes)
        classes, tried = after, pairs.select("fa", "fb") if tried is None else tried.union(pairs.select("fa", "fb"))
    drop(sets)
    drop(blocks)
    rooted = cut(prints.select("fp", "first").join(classes, "fp", "left").select("fp", "first", F.coalesce("cls", "fp").alias("root")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.select("id", "fp").join(rooted.join(smallest, "root").select("fp", "root", "component_id"), "fp").select("id", "fp", "root", "component_id")
