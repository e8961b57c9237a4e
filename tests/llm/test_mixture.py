import re

import numpy as np

from peeratlas.llm import mixture

DOCS = "doc_id long, text string, source string, size int, kind string"
WORD = re.compile(mixture.WORD)


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


def rows():
    out = [(i, words(1 + i * 7 % 90), f"s{i % 4}", 0, "x") for i in range(200)]
    out += [(1000 + i, words(3 + i), None, 0, "x") for i in range(20)]
    out += [(2000, None, "s0", 0, "x"), (2001, "", "empty", 0, "x"), (2002, words(20_000), "s1", 0, "x"), (2003, "a\x0bb c", "tiny", 0, "x"), (None, "no id", "s2", 0, "x")]
    return out + out[:3]  # repeated rows


def water(sizes, weights):
    """Targets by raising all levels together until sources fill up."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_are_met_to_the_word_and_reruns_agree(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    found = mixture.mixed(docs).collect()
    again = mixture.mixed(docs.repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert len(found) == len(rows())
    sizes, taken = {}, {}
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    target = water(sizes, (5, 2, 1))
    by_id = {i: len(WORD.findall(t or "")) for i, t, *_ in rows()}
    for r in found:
        assert r.size == by_id[r.id] and r.source_size == sizes[r.source]
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
    for s, t in target.items():
        assert abs(taken[s] - t) <= 4  # tied rows share what is left in whole words


def test_the_mix_holds_what_was_taken(spark):
    docs = spark.createDataFrame([r for r in rows() if r[0] is not None][:-3], DOCS)
    takes = {r.id: r.taken for r in mixture.mixed(docs).collect()}
    mix = mixture.mix(docs)
    assert mix.columns == docs.columns
    got = {}
    for r in mix.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert got == {i: n for i, n in takes.items() if n}


def test_tilts_equal_bisection(spark):
    rng = np.random.default_rng(0)
    sizes = {"a": rng.integers(1, 50, 300), "b": np.concatenate([rng.integers(1, 9, 50), [20_000]]), None: rng.integers(0, 3, 900), "c": np.array([7])}
    rows = [(s, int(n)) for s, found in sizes.items() for n in found]
    found = {r.source: r for r in mixture._tilts(spark.createDataFrame(rows, "source string, size long").repartition(5), (5, 2, 1), 3).collect()}
    assert set(found) == set(sizes)
    for source, r in found.items():
        n = sizes[source].astype(float)
        words = lambda t, n=n: (n * np.minimum(3, np.exp(np.minimum(t * n / n.mean(), 2)))).sum()
        if r.target >= 3 * n.sum():
            assert r.tilt == np.inf
            continue
        low, high = -200.0, 200.0
        for _ in range(200):
            low, high = ((low + high) / 2, high) if words((low + high) / 2) < r.target else (low, (low + high) / 2)
        assert abs(words(r.tilt) - r.target) <= 1.1e-6 * r.target and abs(words(low) - words(r.tilt)) <= 1.1e-6 * r.target


def test_no_documents_and_no_words(spark):
    assert mixture.mixed(spark.createDataFrame([], DOCS)).count() == 0
    assert mixture.mix(spark.createDataFrame([], DOCS)).count() == 0
    only = mixture.mixed(spark.createDataFrame([(1, None, "a", 0, ""), (2, "", None, 0, "")], DOCS)).collect()
    assert [(r.size, r.target, r.taken) for r in only] == [(0, 0.0, 0)] * 2
