import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from peeratlas.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, id string, part int, cls int"
ODD = ["a", "B", "É", "é", "ß", "İ", "Σ", "ς", "'", "s", "'S", "'ll", "1", "²", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", ".", ",", "…", " ", "\n", "\x0b", "́", "漢", "😀", "\x00", "_", "÷", " "]


def test_word_ids_equal_the_tokenizer():
    rng, encoder, direct = random.Random(4), packing.WordIds(PATH, most_words=50), Tokenizer.from_file(PATH)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        ids, at = encoder.encode(pa.array(part))
        for n, text in enumerate(part):
            assert ids[at[n] : at[n + 1]].tolist() == direct.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_lie_whole_in_dense_sequences(spark):
    direct = Tokenizer.from_file(PATH)
    texts = {i: " ".join(f"token{i} of the text {j}" for j in range(i * 3 % 900)) for i in range(60)} | {100: None, 101: "", 102: "word " * 9000}
    rows = [(i, t, "x", 1, 2) for i, t in texts.items()]
    found = packing.packed(spark.createDataFrame(rows + [rows[5]], DOCS), PATH).toPandas()
    for i, t in texts.items():
        ids = np.array([*direct.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = found[found.id == i].drop_duplicates("start").sort_values("start")
        assert own.start.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() == len(ids)
        assert (own.doc_tokens == len(ids)).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)]
    assert found[found.id == 5].length.sum() == 2 * found[found.id == 5].doc_tokens.iloc[0]  # the repeated row
    ordered = found.sort_values(["sequence_id", "offset"])
    fill = ordered.groupby("sequence_id").length
    assert (ordered.offset == fill.cumsum() - ordered.length).all() and fill.sum().max() <= 2048
    assert fill.sum().sum() > 0.95 * 2048 * (len(fill.sum()) - 1)


def test_cuts_have_the_least_padding_and_pieces():
    capacity, cost = 60, 4.0
    first, count = packing.cut_table(capacity, cost)

    @functools.cache
    def best(rest):  # over all cuts
        padding = lambda n: capacity / (capacity // n) - n
        exact = [n for n in range(1, rest) if capacity // (capacity // n) == n]
        return min([padding(rest), *(padding(n) + cost + best(rest - n) for n in exact)])

    for rest in range(1, capacity):
        lengths, left = [], rest
        while left:
            lengths.append(int(first[left]))
            left -= lengths[-1]
        assert sum(lengths) == rest and len(lengths) == count[rest]
        assert np.isclose(sum(capacity / (capacity // n) - n for n in lengths) + cost * (len(lengths) - 1), best(rest))


def test_cut_all_equals_one_by_one():
    tokens = np.array([1, 2048, 2047, 700, 5000, 4096, 2])
    row, start, length = packing.cut_all(tokens, 2048)
    first, _ = packing.cut_table(2048)
    expected = []
    for n, total in enumerate(tokens.tolist()):
        at = 0
        while at < total:
            step = 2048 if total - at >= 2048 else int(first[total - at])
            expected.append((n, at, step))
            at += step
    assert list(zip(row.tolist(), start.tolist(), length.tolist(), strict=True)) == expected


def test_another_tokenizer_encodes_whole_texts(tmp_path):
    from tokenizers.models import WordLevel

    other = Tokenizer(WordLevel({"a": 0, "b": 1, "[U]": 2}, unk_token="[U]"))
    other.save(str(tmp_path / "t.json"))
    ids, at = packing.WordIds(str(tmp_path / "t.json")).encode(pa.array(["a", "a b", ""]))
    assert ids.tolist() == [0, 2] and at.tolist() == [0, 1, 2, 2]


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], DOCS), PATH).count() == 0
