import hashlib

import numpy as np
import pytest

from peeratlas.llm import periodic_runs, queries


def plain_runs(words, least=12):
    """All maximal runs by trying every period at every place."""
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j - i >= p and length >= least:
                best.setdefault((i, length), p)
            i = max(j, i + 1)
    return sorted((s, length, p) for (s, length), p in best.items())


def collapsed(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_runs_of_several_texts_equal_brute_force(letters):
    rng = np.random.default_rng(letters)
    texts = []
    for _ in range(40):
        w = rng.integers(0, letters, size=rng.integers(0, 70)).tolist()
        if rng.random() < 0.6 and w:
            a, p = rng.integers(0, len(w)), rng.integers(1, 9)
            w = w[:a] + (w[a : a + p] * 9)[: rng.integers(1, 60)] + w[a:]
        texts.append(w)
    ends = np.cumsum([0, *map(len, texts)])
    codes = np.array([c for w in texts for c in w], np.int64)
    for at_once in (7, 1 << 20):
        found = periodic_runs.find_runs(codes, ends, at_once=at_once)
        got = [[(int(s - ends[t]), int(e - s), int(q)) for u, s, e, q in found if u == t] for t in range(len(texts))]
        assert got == [plain_runs(w) for w in texts]


def test_common_extensions_stay_within_their_text():
    codes, ends = np.array([1, 2, 1, 2, 1, 2, 1, 2]), np.array([0, 4, 8])
    levels = periodic_runs.power_names(codes, ends)
    at = np.array([0]), np.array([2])
    assert periodic_runs.forward(levels, *at).tolist() == [2]
    assert periodic_runs.backward(levels, np.array([6]), np.array([8])).tolist() == [2]


def test_edge_cases(spark):
    long = " ".join(f"w{i % 7}" for i in range(150_000))
    wide = " ".join(f"u{i}" for i in range(150_000))
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (None, "a " * 20, 0), (5, "x\x0by " * 6, 0), (5, "x\x0by " * 6, 0), (6, long, 0), (7, wide, 0), (8, "a b c d e f g", 0), (9, "b " * 11, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, id long").withColumnRenamed("id", "runs")
    found = sorted(((r.id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(table).collect()), key=lambda r: r[:2])
    assert found == [
        (0, 20, [(0, 20, 1)], "a"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (5, 12, [(0, 12, 2)], "x y"), (5, 12, [(0, 12, 2)], "x y"),
        (6, 150_000, [(0, 150_000, 7)], "w0 w1 w2 w3 w4 w5 w6"), (7, 150_000, [], wide), (8, 7, [], "a b c d e f g"), (9, 11, [], "b " * 10 + "b"),
    ]
    assert periodic_runs.periodic_runs(table.limit(0)).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    """The registered query with the planted repeats, word by word."""
    import zlib

    rng = np.random.default_rng(3)
    texts = {i: " ".join(rng.choice(["a", "b", "c", "É.", "d"], size=rng.integers(0, 80))) for i in range(120)}
    texts |= {500: None, 501: "", 502: "one two " * 30}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    planted = 0
    for i, text in texts.items():
        w = (text or "").split()
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w)
        top = min(((-length, s, q) for s, length, q in runs), default=None)
        said = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want = (len(runs), *((top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest())
        r = got.pop(i)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want
    assert not got and planted > 5
