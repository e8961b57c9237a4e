"""Document quality by a factorisation machine over hashed words and text statistics."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import split_words, text_slices

#: Byte classes of the structure statistics.
_CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t\r\v\f", "line": b"\n", "stop": b".,;:?", "mark": b"!", "other": b""}
_CLASS_OF = np.full(256, 7, np.uint8)
for _n, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_bytes)] = _n
_CLASS_OF[128:] = 0  # letters of UTF-8 beyond ASCII, mostly
STATISTICS = len(_CLASSES) + 4


@dataclass
class Machine:
    """score = sigmoid(bias + w.x + (|sum v x|^2 - sum |v|^2 x^2) / 2); the fields of x are
    every word of the text, each 1 / words, and the standardised statistics."""

    bias: float
    word_w: np.ndarray  # (buckets,)
    word_v: np.ndarray  # (buckets, rank)
    stat_w: np.ndarray
    stat_v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def statistics(texts: pa.Array, ends: np.ndarray) -> np.ndarray:
    """Structure and metadata of each text: shares of byte classes, and logarithms of its
    bytes, words, and lines, and its mean word length. A text without bytes has zeros."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    body = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    sizes, words = np.diff(offsets), np.diff(ends)
    rows = np.repeat(np.arange(len(raw)) * len(_CLASSES), sizes)
    counts = np.bincount(rows + _CLASS_OF[body], minlength=len(raw) * len(_CLASSES)).reshape(-1, len(_CLASSES))
    letters = sizes - counts[:, 3] - counts[:, 4]
    rest = [np.log1p(sizes), np.log1p(words), np.log1p(counts[:, 4]), letters / np.maximum(1, words)]
    return np.column_stack([counts / np.maximum(1, sizes)[:, None], *rest])


def word_buckets(words: pa.Array, buckets: int) -> np.ndarray:
    coded = words.dictionary_encode()
    hashes = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), dtype=object), categorize=False)
    return (hashes % np.uint64(buckets)).astype(np.int32)[coded.indices.to_numpy()]


def segment_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values' rows between neighbouring ends; empty segments give 0."""
    sums = np.add.reduceat(np.concatenate([values, np.zeros_like(values[:1])]) if len(values) else np.zeros((1, *values.shape[1:])), np.minimum(ends[:-1], len(values)), axis=0)
    sums[np.diff(ends) == 0] = 0
    return sums


def scores(model: Machine, buckets: np.ndarray, ends: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Probabilities of quality, in time linear in the words."""
    words = np.maximum(1, np.diff(ends))[:, None].astype(float)
    table = np.column_stack([model.word_w, (model.word_v**2).sum(1), model.word_v])
    sums = segment_sums(table[buckets], ends)
    z = np.clip((stats - model.mean) / model.scale, -6, 6)
    linear = model.bias + sums[:, 0] / words[:, 0] + z @ model.stat_w
    total = sums[:, 2:] / words + z @ model.stat_v
    square = sums[:, 1] / words[:, 0] ** 2 + (z**2) @ (model.stat_v**2).sum(1)
    return 1 / (1 + np.exp(-np.clip(linear + ((total**2).sum(1) - square) / 2, -30, 30)))


def loss_and_gradient(p: dict, rows: list, z: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
    """The mean log loss of rows (label, word buckets, their counts, statistics) with
    standardised statistics z, and its gradient by the parameters b, w, v, sw and sv."""
    buckets, rank = p["v"].shape
    counts = [np.asarray(r[2], float) for r in rows]
    field = np.concatenate([np.asarray(r[1], np.int64) for r in rows])
    ends = np.concatenate([[0], np.cumsum([len(c) for c in counts])])
    n = np.array([max(1.0, c.sum()) for c in counts])
    of = np.repeat(np.arange(len(rows)), np.diff(ends))
    x = np.concatenate(counts) / n[of]
    x2 = x / n[of]  # every occurrence is a field of its own
    v = p["v"][field]
    total = segment_sums(v * x[:, None], ends) + z @ p["sv"]
    square = segment_sums((v**2).sum(1) * x2, ends) + (z**2) @ (p["sv"] ** 2).sum(1)
    line = p["b"][0] + segment_sums(p["w"][field] * x, ends) + z @ p["sw"] + ((total**2).sum(1) - square) / 2
    line = np.clip(line, -30, 30)
    loss = float(np.mean(np.log1p(np.exp(line)) - label * line))
    g = (1 / (1 + np.exp(-line)) - label) / len(rows)
    each = g[of, None] * (x[:, None] * total[of] - x2[:, None] * v)
    grad = {
        "b": np.array([g.sum()]),
        "w": np.bincount(field, g[of] * x, minlength=buckets),
        "v": np.column_stack([np.bincount(field, each[:, c], minlength=buckets) for c in range(rank)]),
        "sw": z.T @ g,
        "sv": z.T @ (g[:, None] * total) - (z**2).T @ g[:, None] * p["sv"],
    }
    return loss, grad


def train(rows: list, buckets: int = 1 << 14, rank: int = 8, epochs: int = 25, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adam on the log loss. rows: (label, word buckets, their counts, statistics)."""
    rng = np.random.default_rng(seed)
    label = np.array([r[0] for r in rows], float)
    stats = np.array([r[3] for r in rows], float).reshape(len(rows), STATISTICS)
    mean, scale = (stats.mean(0), stats.std(0) + 1e-6) if len(rows) else (np.zeros(STATISTICS), np.ones(STATISTICS))
    z_all = np.clip((stats - mean) / scale, -6, 6)
    prior = np.clip(label.mean(), 0.01, 0.99) if len(rows) else 0.5
    p = {"b": np.array([np.log(prior / (1 - prior))]), "w": np.zeros(buckets), "v": rng.normal(0, 0.05, (buckets, rank)), "sw": np.zeros(STATISTICS), "sv": rng.normal(0, 0.05, (STATISTICS, rank))}
    m = {k: np.zeros_like(x) for k, x in p.items()}
    s = {k: np.zeros_like(x) for k, x in p.items()}
    step = 0
    for _ in range(epochs if len(set(label)) > 1 else 0):
        order = rng.permutation(len(rows))
        for i in range(0, len(rows), 256):
            pick = order[i : i + 256]
            _, grad = loss_and_gradient(p, [rows[j] for j in pick], z_all[pick], label[pick])
            step += 1
            for k in p:
                d = grad[k] + (decay * p[k] if k != "b" else 0)
                m[k] = 0.9 * m[k] + 0.1 * d
                s[k] = 0.999 * s[k] + 0.001 * d * d
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(p["b"][0]), p["w"], p["v"], p["sw"], p["sv"], mean, scale)


def labelled_sample(docs: DataFrame, labels: DataFrame, most_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = 1 << 14) -> list:
    """Training rows of at most most_rows labelled documents: those with the smallest
    hashes of their ids, whatever the size of the tables. Rows that repeat id, label and
    text count once; where an id stands on several texts or labels, each is a row, and the
    bound is on all rows. Only word counts by bucket and statistics leave the tasks."""
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = chosen.distinct().orderBy(F.xxhash64("id"), "id", "label").limit(most_rows)

    def of(batches):
        for rows, texts in text_slices(batches):
            words, ends = split_words(texts)
            found, stats = word_buckets(words, buckets), statistics(texts, ends)
            each = [np.unique(found[a:b], return_counts=True) for a, b in zip(ends, ends[1:], strict=False)]
            columns = [*(rows.column(rows.schema.get_field_index(c)) for c in ("id", "label", "h")), pa.array([e[0] for e in each], pa.list_(pa.int32())), pa.array([e[1] for e in each], pa.list_(pa.int32())), pa.array(list(stats), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "h", "bucket", "n", "stats"])

    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).join(F.broadcast(chosen), "id")  # chosen: most_rows rows of two numbers
    kind = wanted.schema["id"].dataType.simpleString()
    counted = wanted.mapInArrow(of, f"id {kind}, label int, h long, bucket array<int>, n array<int>, stats array<double>")
    once = counted.groupBy("id", "label", "h").agg(*[F.first(c).alias(c) for c in ("bucket", "n", "stats")])
    rows = once.orderBy(F.xxhash64("id"), "id", "label", "h").limit(most_rows).toArrow().sort_by([(c, "ascending") for c in ("id", "label", "h")])
    lists = {c: rows.column(c).combine_chunks() for c in ("bucket", "n", "stats")}
    cut = {c: np.split(x.flatten().to_numpy(), x.offsets.to_numpy()[1:-1] - x.offsets.to_numpy()[0]) for c, x in lists.items()} if rows.num_rows else {}
    return [(label, *(cut[c][i] for c in ("bucket", "n", "stats"))) for i, label in enumerate(rows.column("label").to_pylist())]


def scored(docs: DataFrame, model: Machine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a column score (0 to 1), from whole texts alone, in one pass without a
    shuffle. Null and empty texts get the score of a text without words; repeated rows
    the same score each. Columns of docs pass unread; one named score_col is replaced."""
    kept = docs.drop(score_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(score_col, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets * (rank + 1) numbers

    def of(batches):
        for rows, texts in text_slices(batches, text_col):
            words, ends = split_words(texts)
            found = scores(shared.value, word_buckets(words, len(shared.value.word_w)), ends, statistics(texts, ends))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found)], [*rows.schema.names, score_col])

    return kept.mapInArrow(of, schema)


def fitted(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", **train_args) -> Machine:
    """A machine from labels of documents whose crc32(id as text) mod folds is not held."""
    learn = labels.where(fold(id_col, folds) != held)
    return train(labelled_sample(docs, learn, id_col=id_col, text_col=text_col), **train_args)


def fold(id_col: str, folds: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
