import random

import pytest

from peeratlas.llm import license_scan
from peeratlas.llm.license_texts import TEXTS

DOCS = "doc_id long, text string"
FILLER = " some other words of a file " * 20


@pytest.fixture(scope="module")
def single(spark):
    """The labels of each text alone."""
    rows = license_scan.scanned(spark.createDataFrame([(n, t) for n, (_, t, _) in enumerate(TEXTS)], DOCS)).collect()
    return {r.id: set(r.labels.split(",")) for r in rows}


def test_each_text_is_found(single):
    assert all(label in single[n] for n, (label, *_) in enumerate(TEXTS))
    named = {label: single[n] for n, (label, *_) in enumerate(TEXTS)}  # whole texts come last
    assert named["zlib"] == {"zlib"} and named["boost"] == {"boost"} and named["0bsd"] == {"0bsd"} and named["isc"] == {"isc"}
    assert named["bsd-2-clause"] == {"bsd", "bsd-2-clause"} and named["bsd-3-clause"] == {"bsd", "bsd-3-clause"}
    assert named["mit"] == {"mit"} and named["unlicense"] == {"unlicense"}


def test_files_with_several_texts_have_the_labels_of_each(spark, single):
    rng, groups = random.Random(2), [list(range(len(TEXTS))), list(range(9))]
    groups += [rng.sample(range(len(TEXTS)), n) for n in (2, 2, 2, 3, 3, 4, 6, 9, 9) for _ in range(3)]
    files = [(i, joint.join(TEXTS[n][1] for n in g)) for i, (g, joint) in enumerate((g, j) for g in groups for j in (FILLER, "\n\n", " "))]
    found = {r.id: r for r in license_scan.scanned(spark.createDataFrame(files, DOCS)).collect()}
    for i, group in enumerate(g for g in groups for _ in range(3)):
        assert set().union(*(single[n] for n in group)) <= set(found[i].labels.split(",")), group


def test_edited_text_beside_other_licence_words(spark):
    words = license_scan.plain_words(next(t for n, t, _ in TEXTS if n == "isc"))
    words[20], words[30] = "x", "y"
    text = " ".join(words) + " z" * 50 + " " + " ".join(" ".join(license_scan.plain_words(t)[::-1]) for _, t, _ in TEXTS)
    row = license_scan.scanned(spark.createDataFrame([(1, text)], DOCS)).first()
    assert row.labels == "isc" and 0.8 < row.score < 1


@pytest.fixture(scope="module")
def index():
    import numpy as np

    made = license_scan.build_index()
    made.idf = np.ones(len(made.vocabulary))
    counts = np.zeros(len(made.vocabulary))
    for body in made.templates:
        counts[np.unique(body)] += 1
    made.idf = np.log((len(TEXTS) + 1) / (counts + 1)) + 1
    return made


def labels_of(index, words):
    import numpy as np

    number = {w: i for i, w in enumerate(index.vocabulary)}
    return {label for label, _ in license_scan.match_templates(np.array([number.get(w, -1) for w in words], np.int32), index)}


@pytest.mark.parametrize("where", [(0.25,), (0.5,), (0.75,), (0.25, 0.5, 0.75)])
def test_words_put_in_lose_no_label(index, where):
    """Eight words within each text, but not within a mandatory phrase."""
    lost = []
    for label, text, keys in TEXTS:
        words = license_scan.plain_words(text)
        whole = labels_of(index, words)
        for share in sorted(where, reverse=True):
            at = int(len(words) * share)
            inside = lambda at: any(words[at - k : at - k + len(p)] == p for p in map(license_scan.plain_words, keys) for k in range(1, len(p)))  # noqa: B023, E731
            while inside(at):
                at += 1
            words[at:at] = "inserted by some careful person or other here".split()
        now = labels_of(index, words)
        if label in whole and label not in now:
            lost.append((label, len(license_scan.plain_words(text))))
        assert now <= whole | {label}
    assert not [x for x in lost if x[1] >= 40 or len(where) == 1], lost


def test_holders_of_many_words_keep_the_label(index):
    for label, text, _ in TEXTS:
        words = license_scan.plain_words(text)
        if label in ("bsd-2-clause", "bsd-3-clause", "mit", "isc", "zlib"):
            whole = labels_of(index, words)
            for n in (1, 4, 8, 12):
                named = [w for x in words for w in ([x] if x not in ("holder", "holders") else [x, *[f"name{k}" for k in range(n)]])]
                assert labels_of(index, named) >= whole - {"bsd"}, (label, n)


def test_no_words_and_very_long_texts(spark):
    mit = next(t for n, t, _ in TEXTS if n == "mit")
    rows = [(1, ""), (2, None), (3, FILLER * 2000 + mit + FILLER * 2000)]
    found = {r.id: (r.n_words, r.labels) for r in license_scan.scanned(spark.createDataFrame(rows, DOCS)).collect()}
    assert found[1] == found[2] == (0, "") and "mit" in found[3][1].split(",")
    assert license_scan.scanned(spark.createDataFrame([], DOCS)).count() == 0
