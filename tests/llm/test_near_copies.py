import random

import corpus_pipeline
from peeratlas.llm import near_copies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts):
    """For each text the smallest place in its component under links of similarity >= 0.8."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def near_texts():
    """Texts with some words replaced: similarities on both sides of 0.8, in chains and stars."""
    rng = random.Random(11)
    texts = [None, "", " \t", "One two", "one TWO", "three words here"]
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(base))
        for _ in range(10):
            edited = list(rng.choice([base, texts[-1].split()]))
            for at in rng.sample(range(len(edited)), rng.randint(0, 5)):
                edited[at] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(edited))
    return texts


def test_components_equal_brute_force(spark):
    texts = near_texts()
    expected = brute_components(texts)
    found = near_copies.near_copies(spark.createDataFrame([(i, t, "x", "s", 1) for i, t in enumerate(texts)], DOCS))
    assert {r.id: r.component_id for r in found.collect()} == dict(enumerate(expected))
    assert len(set(expected)) < len(texts) - 40


def test_close_simhashes_of_sets_share_a_block(spark):
    texts = near_texts() + [" ".join(f"long{i}" for i in range(k, 600 + 2 * k)) for k in range(12)]
    sets = [near_copies.shingles((t or "").encode()) for t in texts]
    prints = {near_copies.set_print(s): near_copies.sim_print(s) for s in sets}
    bits = [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in s.tolist()) > len(s)) for s in sets]
    assert [near_copies.sim_print(s) % (1 << 64) for s in sets] == bits
    table = spark.createDataFrame(list(prints.items()), "fp long, sim long")
    keys = {}
    for r in near_copies.sim_blocks(table).collect():
        keys.setdefault(r.fp, set()).add(r.key)
    near = [(a, b) for a in prints for b in prints if a < b and ((prints[a] ^ prints[b]) % (1 << 64)).bit_count() <= 4]
    assert len(near) > 10 and all(keys[a] & keys[b] for a, b in near)


def test_stage_keeps_one_of_near_copies(spark):
    base = [f"word{i}" for i in range(120)]
    near = [" ".join(base), " ".join(base[:30] + ["other"] + base[31:]), " ".join(base[:90] + ["else"] + base[91:])]
    other = " ".join(base[:60] + [f"new{i}" for i in range(60)])
    docs = spark.createDataFrame([(i, t, "x", "s", 1) for i, t in enumerate([*near, other])], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.dedup(spark, docs, "").collect()) == [0, 3]


def test_no_documents_and_null_ids(spark):
    assert near_copies.near_copies(spark.createDataFrame([], DOCS)).count() == 0
    text = " ".join(f"word{i}" for i in range(100))
    docs = spark.createDataFrame([(None, text, "x", "s", 1), (None, text + " tail", "x", "s", 1), (5, text + " end", "x", "s", 1)], DOCS)
    assert {r.component_id for r in near_copies.near_copies(docs).collect()} == {5}


def test_clashing_ids_lose_only_rows_with_another_representative(spark):
    text = " ".join(f"word{i}" for i in range(100))
    rows = [(1, text), (2, text + " tail"), (2, "a clean text of its own"), (3, "one more text of id three"), (3, "and one quite different"), (3, "and one quite different"), (4, None)]
    docs = spark.createDataFrame([(i, t, "x", "s", 1) for i, t in rows], DOCS)
    found = corpus_pipeline.dedup(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text or "") for r in found) == [(1, text), (2, rows[2][1]), (3, rows[4][1]), (3, rows[3][1]), (4, "")]
