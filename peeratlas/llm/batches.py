"""Arrow batches of texts inside tasks."""

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_slices(batches, column="text", most_bytes=2 << 20):
    """Batches cut into slices of at most most_bytes of text each (a longer single text
    stays whole), with nulls as empty texts: memory follows the slice, not the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        texts = batch.column(at).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(start, stop - start), texts.slice(start, stop - start)
            start = stop
    give_back()  # workers live on; the next task may need the room elsewhere


def give_back() -> None:
    """Return to the system what Arrow and the C library keep of freed memory (the latter
    where it is glibc: numpy's arrays and Python's larger objects)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(spark, most_bytes: int = 1 << 20, most_rows: int = 500) -> None:
    """Let Spark read texts and hand them to Python in batches of about a MB: JVM and worker
    hold several copies of each. A session that has values of its own keeps them."""
    arrow = "spark.sql.execution.arrow."
    for key, usual, value in ((f"{arrow}maxBytesPerBatch", "67108864b", f"{most_bytes}b"), (f"{arrow}maxRecordsPerBatch", "10000", str(most_rows)), ("spark.sql.parquet.columnarReaderBatchSize", "4096", str(most_rows))):
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, value)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (maximal runs of other characters than blank and
    \\t\\n\\v\\f\\r) in order, and each text's first word's index plus a last end."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.cast(pa.large_string())))
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    words = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    counts = np.diff(offsets)
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # only of texts without words
        words = words.filter(pa.array(~empty))
        counts = counts - np.add.reduceat(np.append(empty, False).astype(np.int64), offsets[:-1])[: len(counts)]
    return words, np.concatenate([[0], np.cumsum(counts)])
