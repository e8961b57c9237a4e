import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from peeratlas.llm import queries, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.integers(65_000, 66_000), max_size=60))
@settings(max_examples=200, deadline=None)
def test_ranks_survive_their_bytes(values):
    control, data = token_files.pack_ranks(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert token_files.unpack_ranks(control, data)[: len(values)].tolist() == values
    assert len(data) == sum(1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF) for v in values) + -len(values) % 4


@pytest.mark.parametrize("most", [3, 400, 2**32])
def test_file_round_trip_and_range_reads(tmp_path, most):
    rng = np.random.default_rng(most % 97)
    counts = rng.integers(0, 40, size=50)
    tokens = np.minimum(rng.geometric(2 / most, size=counts.sum()), most - 1).astype(np.uint32) if most < 2**32 else rng.integers(0, most, size=counts.sum(), dtype=np.uint64).astype(np.uint32)
    names = pa.array([None, *(f"d{n}" for n in range(49))])
    size = token_files.write_file(f"file://{tmp_path}/x.tok", names, counts, tokens, block=64)
    assert size == (tmp_path / "x.tok").stat().st_size and not list(tmp_path.glob("*.part"))
    ends = np.cumsum([0, *counts])
    with token_files.TokenFile(f"file://{tmp_path}/x.tok") as file:
        assert file.names.to_pylist() == names.to_pylist() and file.counts.tolist() == counts.tolist()
        assert file.tokens(0, len(tokens)).tolist() == tokens.tolist()
        assert all(file.document(n).tolist() == tokens[ends[n] : ends[n + 1]].tolist() for n in range(50))
        found = {int(v): int((tokens == v).sum()) for v in file.order}
        assert list(found) == sorted(found, key=lambda v: (-found[v], v))
    raw = (tmp_path / "x.tok").read_bytes()
    (tmp_path / "short.tok").write_bytes(raw[:-1])
    with pytest.raises(ValueError):
        token_files.TokenFile(f"file://{tmp_path}/short.tok")


def test_query_equals_the_tokenizer(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = ["the", "naïve", "UPPER", "don't", "x1y2", "漢字", "supercalifragilistic", "…"]
    texts = {i: " ".join(rng.choice(words, size=rng.integers(0, 200))) for i in rng.permutation(300).tolist()}
    texts |= {-7: None, 1000: "", 1001: "word " * 60_000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op12_token_files"](spark, str(tmp_path)).orderBy("doc_id").collect()
    model, start = Tokenizer.from_file(PATH), 0
    for r, i in zip(got, sorted(texts), strict=True):
        ids = np.array([*model.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_edge_cases(spark):
    rows = [(None, "a b", 1), (None, None, 1), ("k", "same", 1), ("k", "same", 2), ("k", "other", 3), ("b", "", 4)]
    table = spark.createDataFrame(rows, "doc string, text string, start long")
    files = token_files.write_tokens(table, PATH, id_col="doc", file_tokens=2)
    assert files.agg({"documents": "sum"}).first()[0] == 6
    found = token_files.read_tokens(spark, files, "string").orderBy("start").collect()
    assert [r.id for r in found] == [None, None, "b", "k", "k", "k"]
    starts = np.cumsum([0, *(r.n_tokens for r in found)])
    assert [r.start for r in found] == starts[:-1].tolist() and all(len(r.ids) == 4 * r.n_tokens and r.ids.endswith(b"\1\0\0\0") for r in found)
    none = token_files.write_tokens(table.limit(0), PATH, id_col="doc")
    assert none.count() == 0 and token_files.read_tokens(spark, none, "string").count() == 0
