"""Token ids in binary files: frequency-ranked, byte-aligned, with separate control bytes."""

import os
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.sinks import filesystem
from .batches import text_slices
from .packing import word_ids
from .storage import cut, new_path

#: A file, little-endian: header; its ids by falling frequency (u32); tokens of each document
#: (u32); the documents' names (an Arrow stream of one column); where each block's data begin
#: (u64, with a last end); control bytes; data. Ids are written as ranks of 1 to 4 bytes. A
#: control byte says the lengths of four ranks, two bits each, the first in the lowest bits.
MAGIC = b"RANKVB01"
_HEADER = struct.Struct("<8s6Q")  # magic, documents, tokens, different ids, tokens a block, bytes of names, bytes of data

#: For each control byte which of the 16 bytes of four 32-bit ranks are written.
WRITTEN = np.arange(4)[None, None, :] <= ((np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3)[:, :, None]


def ranked(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids by falling frequency (ties: the smaller first), and each token's
    place in that list."""
    if not len(tokens):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    if int(tokens.max()) < 1 << 22:
        counts = np.bincount(tokens)
        used = np.flatnonzero(counts)
        order = used[np.argsort(-counts[used], kind="stable")]
        place = np.zeros(len(counts), np.uint32)
        place[order] = np.arange(len(order))
        return order.astype(np.uint32), place[tokens]
    used, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    place = np.zeros(len(used), np.uint32)
    place[order] = np.arange(len(order))
    return used[order].astype(np.uint32), place[inverse]


def pack_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data of ranks; the last four are filled up with zeros."""
    whole = np.zeros(-(-len(ranks) // 4) * 4, "<u4")
    whole[: len(ranks)] = ranks
    code = ((whole >= 1 << 8).astype(np.uint8) + (whole >= 1 << 16) + (whole >= 1 << 24)).reshape(-1, 4)
    control = (code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6).astype(np.uint8)
    return control, whole.view(np.uint8)[WRITTEN[control].ravel()]


def unpack_ranks(control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Ranks from control bytes and data: a table tells where each byte goes."""
    raw = np.zeros(16 * len(control), np.uint8)
    raw[WRITTEN[control].ravel()] = data
    return raw.view("<u4")


def write_file(uri: str, names: pa.Array, counts: np.ndarray, tokens: np.ndarray, block: int = 1 << 16) -> int:
    """One file of documents' tokens; its bytes. It gets its name when it is complete, so a
    task that is tried again never shows half a file."""
    order, ranks = ranked(tokens)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("name", names.type)])) as stream:
        stream.write_batch(pa.record_batch([names], names=["name"]))
    listed = sink.getvalue()
    packed = [pack_ranks(ranks[i : i + block]) for i in range(0, len(ranks), block)]
    starts = np.cumsum([0, *(len(data) for _, data in packed)])
    parts = [_HEADER.pack(MAGIC, len(counts), len(ranks), len(order), block, len(listed), int(starts[-1])), order.astype("<u4"), counts.astype("<u4"), listed, starts.astype("<u8")]
    parts += [control for control, _ in packed] + [data for _, data in packed]
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    unfinished = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(unfinished) as out:
        for part in parts:
            out.write(memoryview(part).cast("B") if len(part) else b"")
    fs.move(unfinished, path)
    return sum(memoryview(part).nbytes for part in parts)


class TokenFile:
    """A file opened for range reads: the tables in front are read at once, tokens by blocks."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        magic, documents, self.n_tokens, different, self.block, named, data = _HEADER.unpack(self.file.read_at(_HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{uri}: not a token file")
        at = _HEADER.size
        blocks = -(-self.n_tokens // self.block)
        tables = []
        for kind, n in (("<u4", different), ("<u4", documents), (np.uint8, named), ("<u8", blocks + 1)):
            size = np.dtype(kind).itemsize * n
            tables.append(np.frombuffer(self.file.read_at(size, at), kind))
            at += size
        self.order, self.counts, listed, self.starts = tables
        self.control, self.data = at, at + -(-self.n_tokens // 4)
        if self.file.size() != self.data + data:
            raise ValueError(f"{uri}: cut short or damaged")
        self.names = pa.ipc.open_stream(pa.py_buffer(listed)).read_all().column(0).combine_chunks()
        self.ends = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file; only the blocks that hold them are read."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        lo, hi = first * self.block // 4, -(-min(self.n_tokens, (last + 1) * self.block) // 4)
        control = np.frombuffer(self.file.read_at(hi - lo, self.control + lo), np.uint8)
        a, b = int(self.starts[first]), int(self.starts[last + 1])
        ranks = unpack_ranks(control, np.frombuffer(self.file.read_at(b - a, self.data + a), np.uint8))
        return self.order[ranks[start - first * self.block : stop - first * self.block]]

    def document(self, n: int) -> np.ndarray:
        return self.tokens(int(self.ends[n]), int(self.ends[n + 1]))


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, file_tokens: int = 1 << 23) -> DataFrame:
    """Write all documents' ids in ascending order of id_col (null first): path, documents,
    tokens and start, the tokens in the files before.

    Rows are dealt by ranges of the id and, so that an id which stands on very many rows
    spreads, of the text's hash; a task encodes its range in order and writes a file when
    file_tokens have come together (what one slice of texts adds on top stays in the same
    file). Frequencies are counted over all of a file, whose own table makes it readable
    alone. Ids end with end_id. Only one row a file goes through the window of starts.

    Null and empty texts hold only the end id; rows that repeat an id are written one by
    one, ordered by the hash of their texts, then the texts; an empty table gives no files;
    other columns are ignored.
    """
    folder = folder or new_path(docs.sparkSession, "token-files")
    kind = docs.schema[id_col].dataType.simpleString()
    tie = F.xxhash64(F.coalesce(text_col, F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), tie.alias("tie"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text")
    columns = ["path", "id", "tie", "n", "documents", "tokens", "bytes"]

    def of(batches):
        encoder, part, n = word_ids(tokenizer), TaskContext.get().partitionId(), 0
        names, ties, counts, tokens, held = [], [], [], [], 0

        def written():
            path = f"{folder}/part-{part:06d}-{n:04d}.tok"
            joined = np.concatenate(tokens)
            tokens.clear()
            size = write_file(path, pa.concat_arrays(names), np.concatenate(counts), joined)
            row = [[path], names[0].slice(0, 1), ties[0].slice(0, 1), [n], [sum(map(len, counts))], [len(joined)], [size]]
            names.clear()
            ties.clear()
            counts.clear()
            return pa.RecordBatch.from_arrays([r if isinstance(r, pa.Array) else pa.array(r) for r in row], columns)

        for slice_, texts in text_slices(batches):
            ids, at = encoder.encode(texts)
            tokens.append(np.insert(ids, at[1:], end_id))
            names.append(slice_.column(0))
            ties.append(slice_.column(1))
            counts.append(np.diff(at) + 1)
            held += len(tokens[-1])
            if held >= file_tokens:
                yield written()
                n, held = n + 1, 0
        if names:
            yield written()

    files = cut(dealt.mapInArrow(of, f"path string, id {kind}, tie long, n long, documents long, tokens long, bytes long"), "token-manifest")
    before = Window.orderBy(F.col("id").asc_nulls_first(), "tie", "n").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("path", "documents", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"), "bytes")


def read_tokens(spark: SparkSession, files: DataFrame, id_type: str = "long", most_tokens: int = 1 << 19) -> DataFrame:
    """All documents of the files (path, start): id, start (tokens before it), n_tokens and
    ids (little-endian unsigned 32-bit). Files are dealt to tasks; a task holds some
    most_tokens decoded ids at a time, or one document's."""

    def of(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with TokenFile(path) as file:
                    a = 0
                    while a < len(file.counts):
                        b = max(a + 1, int(np.searchsorted(file.ends, file.ends[a] + most_tokens, "right")) - 1)
                        body = file.tokens(int(file.ends[a]), int(file.ends[b])).astype("<u4")
                        bounds = (4 * (file.ends[a : b + 1] - file.ends[a])).astype(np.int32)
                        ids = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(bounds), pa.py_buffer(body)])
                        yield pa.RecordBatch.from_arrays([file.names.slice(a, b - a), pa.array(start + file.ends[a:b]), pa.array(file.counts[a:b].astype(np.int64)), ids], ["id", "start", "n_tokens", "ids"])
                        a = b

    dealt = files.select("path", "start").repartition(max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism)), "path")
    return dealt.mapInArrow(of, f"id {id_type}, start long, n_tokens long, ids binary")
