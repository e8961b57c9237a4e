import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peeratlas.llm import fm_quality, kernel_lid, license_scan

DOCS = "doc_id long, text string, lang string, score string, lang_pred string"


def corpus(n=400):
    rng = random.Random(3)
    parts = {"aa": ["thou", "gre", "ing", "wh"], "bb": ["ção", "lle", "ñi", "osa"], "cc": ["sch", "keit", "äu", "ung"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 200)))
        bad = i % 4 == 0
        rows.append((i, text.replace(" ", "$$$ ") if bad else text, lang, "s", "l", int(not bad)))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(9000, None, "aa", "", ""), (9001, "", None, "", ""), (9002, "123 $$ !", "bb", "", ""), (9003, "Ø", "aa", "", ""), (9004, "thou " * 200_000, "aa", "", ""), (None, "gre ing", None, "", "")]
    return spark.createDataFrame([r[:5] for r in corpus()] + extra + extra[-1:], DOCS)


def test_language(docs):
    held = F.coalesce(fm_quality.fold("doc_id", 4) == 2, F.lit(False))
    model = kernel_lid.learned(docs.where(~held), per_language=60, landmarks=50)
    found = kernel_lid.identified(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    rows = found.join(docs.select("doc_id", held.alias("held")).distinct(), "doc_id").where("held and doc_id < 9000").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    odd = {r.doc_id: r for r in found.where("doc_id >= 9000 or doc_id is null").collect()}
    assert [odd[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3 and odd[9003].lang_pred != "und" and odd[9004].lang_pred == "aa"
    assert found.where("score < 0 or score > 1 or isnan(score)").count() == 0
    assert found.where("doc_id is null").count() == 2


def test_language_without_rows(spark, docs):
    assert kernel_lid.learned(spark.createDataFrame([], DOCS)) is None
    assert kernel_lid.identified(docs, None).select("lang_pred").distinct().collect()[0][0] == "und"
    assert kernel_lid.identified(spark.createDataFrame([], DOCS), None).count() == 0


def test_kernel_counts_shared_grams():
    kernel = kernel_lid.Kernel(bits=18, longest=2)
    a, b = kernel.rows([b"ab", b"Ab!"])
    assert np.allclose(a, b) and np.isclose(a @ a, 1)
    x, y = kernel.rows([b"ab", b"bc"])
    grams = lambda t: {t[i : i + n] for n in (1, 2) for i in range(len(t) - n + 1)}
    p, q = grams(b" ab "), grams(b" bc ")
    assert np.isclose(x @ y, len(p & q) / np.sqrt(len(p) * len(q)))


def test_quality(spark, docs):
    labels = spark.createDataFrame([(r[0], r[5], 0) for r in corpus()] + [(None, 1, 0), (5, None, 0), (77777, 1, 0)], "doc_id long, quality int, toxic int")
    model = fm_quality.fitted(docs, labels, epochs=15)
    found = fm_quality.scored(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and found.count() == docs.count()
    rows = found.join(labels, "doc_id").where(fm_quality.fold("doc_id", 5) == 0).where("quality is not null").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean(np.array(good)[:, None] > np.array(bad)) > 0.97
    assert found.where("score < 0 or score > 1 or isnan(score)").count() == 0


def test_quality_without_labels(spark, docs):
    model = fm_quality.fitted(docs, spark.createDataFrame([], "doc_id long, quality int"))
    rows = fm_quality.scored(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert not model.word_w.any() and model.bias == 0
    assert fm_quality.scored(spark.createDataFrame([], DOCS), model).count() == 0


def test_gradient_equals_differences():
    rng = np.random.default_rng(4)
    stats = fm_quality.STATISTICS
    p = {"b": rng.normal(size=1), "w": rng.normal(size=8), "v": rng.normal(size=(8, 2)), "sw": rng.normal(size=stats) / 9, "sv": rng.normal(size=(stats, 2)) / 9}
    rows = [(1, [0, 3], [2, 1], None), (0, [], [], None), (1, [5], [4], None), (0, [1, 3, 7], [1, 1, 1], None)]
    z, label = rng.normal(size=(4, stats)), np.array([r[0] for r in rows], float)
    _, grad = fm_quality.loss_and_gradient(p, rows, z, label)
    for name, values in p.items():
        for at in np.ndindex(values.shape):
            ends = []
            for step in (1e-5, -1e-5):
                moved = {k: v.copy() for k, v in p.items()}
                moved[name][at] += step
                ends.append(fm_quality.loss_and_gradient(moved, rows, z, label)[0])
            assert np.isclose(grad[name][at], (ends[0] - ends[1]) / 2e-5, atol=1e-7), (name, at)


def test_ridge_in_landmark_features_equals_plain_algebra():
    rng = np.random.default_rng(6)
    kernel = kernel_lid.Kernel(bits=8, longest=2)
    texts = ["".join(rng.choice(list("abcdxyz "), 30)) for _ in range(60)]
    langs = [("p", "q", "r")[i % 3] for i in range(60)]
    bits = np.zeros((60, 256), np.uint8)
    for row, text in zip(bits, texts, strict=True):
        kernel.presence(text.encode(), row)
    model = kernel_lid.fit(kernel, [np.packbits(r).tobytes() for r in bits], langs, landmarks=20, ridge=1e-2, seed=5)
    x = bits / np.sqrt(bits.sum(1, keepdims=True))
    k = lambda a, b: np.array([[(p * q).sum() for q in b] for p in a])
    marks = x[np.sort(np.random.default_rng(5).permutation(60)[:20])]
    low_rank = k(x, marks) @ np.linalg.pinv(k(marks, marks), rcond=1e-6, hermitian=True) @ k(marks, x)  # Nystrom kernel matrix
    wanted = np.where(np.array(langs)[:, None] == np.array(["p", "q", "r"]), 1.0, -1.0)
    middle = np.eye(60) - 1 / 60  # languages are equally frequent here
    centered = middle @ low_rank @ middle
    dual = np.linalg.solve(centered + 1e-2 * 60 * np.eye(60), wanted - wanted.mean(0))
    assert np.allclose(x.astype(np.float32) @ model.weights + model.bias, centered @ dual + wanted.mean(0), atol=2e-3)


def test_samples_are_bounded(spark):
    hot = [(1, f"thou text {i}", "aa") for i in range(500)] + [(1, "same text", "bb")] * 500 + [(i, f"w{i} x", f"junk{i}") for i in range(300)]
    docs = spark.createDataFrame(hot, "doc_id long, text string, lang string")
    model = kernel_lid.learned(docs, per_language=20, most_languages=5, landmarks=30)
    assert len(model.languages) <= 5 and {"aa", "bb"} <= set(model.languages)
    labels = spark.createDataFrame([(1, 1)] * 400 + [(i, i % 2) for i in range(100, 140)], "doc_id long, quality int")
    rows = fm_quality.labelled_sample(docs, labels, most_rows=30)
    assert 0 < len(rows) <= 30
    once = fm_quality.labelled_sample(docs.where("lang = 'bb'"), labels, most_rows=30)
    assert len(once) == 1


def test_columns_of_the_results_can_be_named(spark, docs):
    model = fm_quality.fitted(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert fm_quality.scored(docs, model, score_col="mine").where("score = 's' and mine is not null").count() == 400
    found = kernel_lid.identified(docs, None, lang_col="l", score_col="p")
    assert found.columns == [*docs.columns, "l", "p"] and found.where("lang_pred = 'l'").count() == 400


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(0)
    stats = fm_quality.STATISTICS
    model = fm_quality.Machine(0.1, rng.normal(size=16), rng.normal(size=(16, 3)), rng.normal(size=stats), rng.normal(size=(stats, 3)), np.zeros(stats), np.ones(stats))
    buckets, z = np.array([3, 3, 7, 1]), rng.normal(size=(1, stats))
    fields = [(1 / 4, model.word_w[b], model.word_v[b]) for b in buckets] + [(z[0, i], model.stat_w[i], model.stat_v[i]) for i in range(stats)]
    line = 0.1 + sum(x * w for x, w, _ in fields) + sum(fields[i][0] * fields[j][0] * fields[i][2] @ fields[j][2] for i in range(len(fields)) for j in range(i))
    assert np.isclose(fm_quality.scores(model, buckets, np.array([0, 4]), z)[0], 1 / (1 + np.exp(-line)))


def test_licenses_equal_patterns(spark):
    base = ["", None, "The MIT License. mit-license MITLICENSE mit é license", "GNU General\nPublic...License; Apache   License", "apache license " * 3000, "x " * 50_000 + "MIT LICENSE", "summit license", "mit licenseé"]
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"
    texts = [*base, mit, "Permission is granted to nobody " * 4, "Licensed under CC BY-NC 4.0.", "some words " + mit.replace("person", "human being")]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(2, texts[2], "x", 1)], "doc_id long, text string, id string, n_words int")
    rows = license_scan.scanned(table).collect()
    assert len(rows) == len(texts) + 1
    found = {r.id: r for r in rows}
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words, hits, labels = word.findall(low), [], set()
        for phrase, label in license_scan.BASE_PHRASES:
            p = phrase.split()
            at = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            assert len(at) == len(license_scan.base_pattern(phrase).findall(low))
            hits += at
            labels |= {label} if at else set()
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(labels)))
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
    assert found[8].labels == "mit" and found[9].labels == "" and found[10].labels == "cc-by-nc" and found[11].labels == "mit"
    assert license_scan.scanned(table.limit(0)).count() == 0
