from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from peeratlas.llm import simhash
from peeratlas.llm.components import components

DOCS = "doc_id long, text string, id string, fp int"


def brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, distance=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_components_equal_brute_force(spark):
    long = " ".join(f"word{i % 700} and{i}" for i in range(5000))
    texts = [None, "", " \t\n", "One two", "one TWO", "a b c d e f g", "a b c d e f h", long, long + " tail", long, "É é", "é É", "x\x0by z\x0cw v"]
    rows = [(100 - i if i < 3 else i, t, "clash", 1) for i, t in enumerate(texts)]
    found = simhash.near_duplicates(spark.createDataFrame(rows + rows[-1:], DOCS)).collect()
    assert len(found) == len(rows) + 1
    order = sorted(rows, key=lambda r: r[0])
    prints = [brute(t) for _, t, *_ in order]
    expected = {i: (p, order[c][0]) for (i, *_), p, c in zip(order, prints, classes(prints), strict=True)}
    assert {r.id: (r.fp % (1 << 64), r.component_id) for r in found} == expected


@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_links_of_close_fingerprints_are_exact(spark, blocks):
    import random

    rng = random.Random(blocks)
    bases = [rng.getrandbits(64) for _ in range(20)]
    prints = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 7))) for b in bases for _ in range(15)} | {0, (1 << 64) - 1, 1 << 63})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p, 1) for p in signed], "fp long, n long")
    found = {r.fp: r.root for r in simhash.link_components(table, 4, blocks).collect()}
    expected = classes(prints)
    groups = {}
    for p, c in zip(signed, expected, strict=True):
        groups.setdefault(c, set()).add(found[p])
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_crowded_blocks_of_one_template_are_split_exactly(spark):
    import random

    rng = random.Random(2)
    base = rng.getrandbits(64)
    prints = list({base ^ sum(1 << k for k in range(64) if rng.random() < 0.12) for _ in range(700)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p, 1) for p in signed], "fp long, n long")
    sizes = simhash.block_sizes(simhash.by_blocks(table.withColumn("cls", F.col("fp")), 5, 4))
    assert sizes.where("outside > 4").count() > 50
    expected, groups = classes(prints), {}
    for p, c in zip(signed, expected, strict=True):
        groups.setdefault(c, set()).add(p)
    for most in (0, 4):
        found = {}
        for r in simhash.link_components(table, 4, 5, most_outside=most).collect():
            found.setdefault(r.root, set()).add(r.fp)
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))
    assert 1 < len(groups) < len(prints)


def test_large_group_of_near_copies_is_one_class(spark):
    table = spark.range(63).select(F.expr("shiftleft(1L, int(id))").alias("fp"), F.lit(1).cast("long").alias("n"))
    assert simhash.link_components(table).select("root").distinct().count() == 1


def test_block_masks_cover_all_small_differences():
    for blocks in (5, 6, 7):
        masks = simhash.block_masks(blocks, 4)
        for flips in ([0, 1, 2, 3], [0, 20, 40, 63], [5, 13, 31, 50]):
            bits = sum(1 << f for f in flips)
            assert any(bits & m == 0 for m in masks)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_paths_loops_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    sizes = Counter(Counter(r.root for r in found).values())
    assert sizes == {51: 1, 50: 1, 2: 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
