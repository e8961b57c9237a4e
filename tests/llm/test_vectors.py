import numpy as np

from peeratlas.llm import cap_filters, onebit_ann

VECTORS = "vec_id long, embedding array<float>, label int, id long, vec string"


def rows(n=600, dims=32, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).astype(np.float32)
    for i in range(0, n, 6):
        x[i + 1] = x[i] + 0.2 * rng.normal(size=dims)  # near
        x[i + 2] = x[i]  # equal
    x[10:40] = x[0] + 0.02 * rng.normal(size=(30, dims))  # a cluster
    out = [(i, [float(v) for v in r], 0, 7, "c") for i, r in enumerate(x)]
    bad = [None, [], [0.0] * dims, [float("nan")] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [float("inf")] + [0.0] * (dims - 1)]
    return out, [(10_000 + i, b, 0, 7, "c") for i, b in enumerate(bad)]


def test_near_duplicates_equal_brute_force(spark):
    good, bad = rows()
    short = [(20_000, [1.0, 2.0], 0, 7, "c"), (20_001, [2.0, 4.0], 0, 7, "c")]
    found = {r.vec_id: r for r in cap_filters.near_duplicates(spark.createDataFrame(good + bad + short, VECTORS)).collect()}
    ids = [g[0] for g in good + short]
    x = np.array([(g[1] + [0.0] * 32)[:32] for g in good + short], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    component = list(range(len(ids)))
    for _ in range(len(ids)):
        after = [min([component[i], *(component[j] for j in np.flatnonzero(near[i]))]) for i in range(len(ids))]
        if after == component:
            break
        component = after
    for i, name in enumerate(ids):
        r = found[name]
        assert (r.n_links, r.component_id, r.kept) == (near[i].sum(), ids[component[i]], component[i] == i)
    for name, *_ in bad:
        assert (found[name].n_links, found[name].component_id, found[name].kept) == (0, name, True)
    assert len(found) == len(ids) + len(bad)


def test_nearest_equal_brute_force(spark):
    good, bad = rows(400)
    table = spark.createDataFrame(good + bad + good[:2], VECTORS)
    found = onebit_ann.nearest(table, table.where("vec_id % 20 = 0"), block_rows=32, block_queries=8, sample_rows=100).collect()
    ids, x = np.array([g[0] for g in good]), np.array([g[1] for g in good], np.float32).astype(float)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {i for i in ids if i % 20 == 0}
    hit = 0
    for q, answers in got.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        best = np.lexsort((ids, -scores))[:20]
        hit += len(set(ids[best].tolist()) & {a for a, _ in answers})
        assert np.allclose([s for _, s in answers], [scores[a] for a, _ in answers])
        assert len(answers) == 20
    assert hit >= 0.99 * 20 * len(got)


def test_few_rows_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0, 0, ""), (1, [1.0, 0.0], 0, 0, ""), (2, [0.5, 1.0], 0, 0, "")], VECTORS)
    found = [(r.rank, r.vec_id, r.score) for r in onebit_ann.nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()]
    assert found == [(1, 1, 1.0), (2, 2, 0.5)]
    none = spark.createDataFrame([], VECTORS)
    assert onebit_ann.nearest(none, none).count() == 0
    assert cap_filters.near_duplicates(none).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, q, turn = rng.normal(size=(500, 32)), rng.normal(size=(20, 32)), onebit_ann.rotation(32, 256, 1)
    guess, off = onebit_ann.estimates(q @ turn, *onebit_ann.encode(x, turn), 2.5)
    assert (np.abs(guess - q @ x.T) <= off).mean() > 0.97 and off.mean() < 5


def test_packed_products_equal_plain_ones():
    rng = np.random.default_rng(1)
    x, q, turn = rng.normal(size=(30, 16)), rng.normal(size=(5, 16)), onebit_ann.rotation(16, 128, 2)
    codes, length, fit = onebit_ann.encode(x, turn)
    signs = np.where(x @ turn > 0, 1.0, -1.0)
    planes, least, step, _ = onebit_ann.query_planes(q @ turn)
    whole = sum(np.unpackbits(p.view(np.uint8), axis=1, bitorder="little").astype(float) * 2**b for b, p in enumerate(planes))
    rounded = whole * step[:, None] + least[:, None]
    assert np.abs(rounded - q @ turn).max() <= step.max() / 2 + 1e-12
    assert np.allclose(onebit_ann.estimates(q @ turn, codes, length, fit, 1.0)[0], (rounded @ signs.T) * length / fit / np.sqrt(128))


def test_few_cells_find_the_nearest_of_clustered_rows(spark):
    rng = np.random.default_rng(3)
    middles = 5 * rng.normal(size=(8, 16))
    x = np.repeat(middles, 60, axis=0) + rng.normal(size=(480, 16))
    table = spark.createDataFrame([(i, [float(v) for v in r], 0, 0, "") for i, r in enumerate(x)], VECTORS.replace("float", "double"))
    exact, some = ({(r.query_id, r.rank): r.vec_id for r in onebit_ann.nearest(table, table.where("vec_id % 20 = 0"), k=5, cells=8, probes=p, sample_rows=200, block_rows=40).collect()} for p in (8, None))
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    best = {(q, n + 1): v for q in range(0, 480, 20) for n, v in enumerate(np.argsort(-scores[q])[:5].tolist())}
    assert np.mean([exact[at] == v for at, v in best.items()]) > 0.97
    assert np.mean([some.get(at) == v for at, v in best.items()]) > 0.9
    assert onebit_ann.needed_probes(x, onebit_ann.group_centers(x, 8), 5, 0.98) < 8


def test_one_id_with_two_vectors_is_asked_and_found_apart(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0], 0, 0, ""), (0, [0.0, 1.0], 0, 0, ""), (0, [0.0, 1.0], 0, 0, ""), (1, [2.0, 0.0], 0, 0, ""), (1, [0.0, 3.0], 0, 0, "")], VECTORS)
    found = onebit_ann.nearest(table, table.where("vec_id = 0")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == [(0, 1, 1, 2.0), (0, 1, 1, 3.0), (0, 2, 1, 0.0), (0, 2, 1, 0.0)]


def test_list_decode_finds_all_caps():
    code = cap_filters.product_code(16, 32, 0)
    rotation, halves = code
    v = np.random.default_rng(2).normal(size=(50, 16))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) @ rotation
    height = cap_filters.cap_height(16, code, 12)
    numbers, counts = cap_filters.list_decode(v, halves, height, 8)
    sums = ((v[:, :8] @ halves[0].T)[:, :, None] + (v[:, 8:] @ halves[1].T)[:, None, :]).reshape(50, -1)
    assert 4 <= np.median((sums >= height).sum(1)) <= 24 and (counts > 12).any() and (counts == 8).any()
    for got, all_sums in zip(np.split(numbers, np.cumsum(counts)[:-1]), sums, strict=True):
        exceed = set(np.flatnonzero(all_sums >= height).tolist())
        assert set(got.tolist()) == (exceed if len(exceed) >= 8 else set(np.argsort(-all_sums)[:8].tolist()))


def test_one_id_with_two_vectors(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], 0, 0, ""), (1, [0.0, 1.0, 0.0, 0.0], 0, 0, ""), (2, [1.0, 0.01, 0.0, 0.0], 0, 0, ""), (7, [0.0, 0.0, 1.0, 0.0], 0, 0, ""), (7, [0.0, 0.0, 1.0, 0.1], 0, 0, ""), (None, [0.0, 0.0, 0.0, 1.0], 0, 0, "")], VECTORS)
    found = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in cap_filters.near_duplicates(table).collect())
    assert found == [(0, 0, 0, True), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (7, 1, 7, True), (7, 1, 7, True)]


def test_large_components_are_counted_in_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=8) + 0.05 * rng.normal(size=(90, 8))
    ids = [(n, [float(v) for v in r], 1) for n, r in enumerate(x)]
    classes = spark.createDataFrame(ids, "cls long, vec array<double>, n long")
    linked = spark.createDataFrame([(n, 0, 70) for n in range(70)] + [(n, 70, 20) for n in range(70, 90)], "cls long, root long, members long")
    found = {r.cls: r.others for r in cap_filters.link_counts(classes, linked, 0.995, block=16).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.995
    near[:70, 70:] = near[70:, :70] = False
    assert 0 < near.mean() < 1 and found == dict(enumerate((near.sum(1) - 1).tolist()))


def test_nearest_at_defaults_and_with_certain_bounds_equal_brute_force(spark):
    """Vectors of the driver's kind, the parameters of the registered query; then the exact
    way on few bits and many small blocks, which the default bounds could not survive."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1500:1700] = x[3]  # equal rows: ties by id, only the first k + 1 matter
    table = spark.createDataFrame([(i, [float(v) for v in r], 0, 0, "") for i, r in enumerate(x)], VECTORS)
    scores = np.add.accumulate(x.astype(float)[:, None, :] * x.astype(float)[None, ::20].swapaxes(0, 1).reshape(1, -1, 64), axis=2)[:, :, -1].T
    best = {}
    for n, q in enumerate(range(0, 2000, 20)):
        own = scores[n].copy()
        own[q] = -np.inf
        best |= {(q, r + 1): int(v) for r, v in enumerate(np.lexsort((np.arange(2000), -own))[:20])}
    asked = table.where("vec_id % 20 = 0")
    for options in ({}, {"width": None, "bits": 64, "cells": 3, "probes": 3, "block_rows": 300, "block_queries": 16, "sample_rows": 400}):
        found = onebit_ann.nearest(table, asked, **options).collect()
        assert {(r.query_id, r.rank): r.vec_id for r in found} == best
        assert all(r.score == scores[r.query_id // 20, r.vec_id] for r in found)
