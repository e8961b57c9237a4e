"""Language identification with a string kernel."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import text_slices

_LETTERS_ONLY = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Odd multipliers that spread n-grams of bytes over the buckets.
_SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


@dataclass
class Kernel:
    """Blended-spectrum presence kernel: the n-grams of bytes for n = 1 to longest that
    two texts share, over the root of the product of their numbers, on hashed n-grams."""

    bits: int = 15
    longest: int = 4

    def presence(self, text: bytes, out: np.ndarray) -> None:
        """Mark the buckets of the whole text's n-grams (case-folded, runs of other ASCII
        than letters as one blank) in a row of zeros."""
        raw = np.frombuffer(b" " + b" ".join(text.translate(_LETTERS_ONLY).split()) + b" ", np.uint8).astype(np.uint64)
        code, shift = np.zeros(len(raw), np.uint64), np.uint64(64 - self.bits)
        for n in range(1, self.longest + 1):
            if len(raw) < n:
                break
            code = code[: len(raw) - n + 1] * np.uint64(256) + raw[n - 1 :]
            out[((code * np.uint64(_SPREAD[n % 4]) + np.uint64(n)) * np.uint64(_SPREAD[0]) >> shift).astype(np.int64)] = 1

    def rows(self, texts: list[bytes]) -> np.ndarray:
        """Presence rows of unit length: their products are the kernel's values."""
        found = np.zeros((len(texts), 1 << self.bits), np.float32)
        for row, text in zip(found, texts, strict=True):
            self.presence(text, row)
        found /= np.sqrt(np.maximum(1, found.sum(1)))[:, None]
        return found

    def packed(self, text: bytes) -> bytes:
        """The text's presence as bits."""
        row = np.zeros(1 << self.bits, np.uint8)
        self.presence(text, row)
        return np.packbits(row).tobytes()


@dataclass
class Model:
    kernel: Kernel
    languages: list[str]
    weights: np.ndarray  # (buckets, languages): landmarks times their coefficients
    bias: np.ndarray


def fit(kernel: Kernel, packed: list[bytes], langs: list[str], landmarks: int = 256, ridge: float = 1e-3, seed: int = 5) -> Model:
    """One-versus-rest kernel ridge regression in the Nystrom features of landmarks drawn
    from the sample. packed: presence bits of the sampled texts."""
    languages = sorted(set(langs))

    def unit_rows(bits: list[bytes]) -> np.ndarray:
        x = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(1, x.sum(1)))[:, None]

    marks = unit_rows([packed[i] for i in np.sort(np.random.default_rng(seed).permutation(len(packed))[:landmarks])])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = np.concatenate([(unit_rows(packed[i : i + 64]) @ marks.T).astype(float) @ root for i in range(0, len(packed), 64)])
    wanted = 2.0 * (np.array(langs)[:, None] == np.array(languages)) - 1
    share = 1 / np.maximum(1, (wanted > 0).sum(0))[[languages.index(a) for a in langs]]  # languages weigh alike
    share = share * len(langs) / share.sum()
    center = np.average(features, axis=0, weights=share)
    offset = np.average(wanted, axis=0, weights=share)
    f = features - center
    solved = np.linalg.solve(f.T @ (f * share[:, None]) + ridge * len(langs) * np.eye(f.shape[1]), f.T @ ((wanted - offset) * share[:, None]))
    return Model(kernel, languages, marks.T @ (root @ solved).astype(np.float32), offset - center @ solved)


def learned(docs: DataFrame, per_language: int = 400, most_languages: int = 64, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", kernel: Kernel | None = None, **fit_args) -> Model | None:
    """A model from a bounded sample: about per_language documents of each of the
    most_languages most frequent languages, per_language * most_languages at most. A hash
    of id and text picks them at a rate of per_language / their (estimated) number; rows
    that repeat id, text and language count once, so neither a repeated id nor a column with
    very many values brings more to the driver. Rows with null language or null text teach
    nothing; None if no row is left."""
    kernel = kernel or Kernel()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    drawn = F.xxhash64("id", "text", F.lit(11))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(drawn).alias("count")).orderBy(F.col("count").desc(), "lang").limit(most_languages).collect()
    rate = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, per_language / r["count"]))]) if counts else None
    if rate is None:
        return None
    u = drawn.bitwiseAND((1 << 52) - 1) / float(1 << 52)

    def of(batches):
        for part, texts in text_slices(batches):
            bits = [kernel.packed(text) for text in texts.cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(bits, pa.binary())], ["drawn", "lang", "bits"])

    picked = rows.where(u < rate[F.col("lang")]).select(drawn.alias("drawn"), "text", "lang").mapInArrow(of, "drawn long, lang string, bits binary")
    once = picked.groupBy("drawn", "lang").agg(F.first("bits").alias("bits"))
    sample = once.orderBy("drawn", "lang").limit(per_language * len(counts)).toArrow().sort_by([("drawn", "ascending"), ("lang", "ascending")])
    if not sample.num_rows:
        return None
    return fit(kernel, sample.column("bits").to_pylist(), sample.column("lang").to_pylist(), **fit_args)


def _no_letter(text: bytes) -> bool:
    if text.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") != text:
        return False
    return text.isascii() or not any(map(str.isalpha, text.decode()))


def identified(docs: DataFrame, model: Model | None, text_col: str = "text", at_once: int = 128, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with lang_pred and score (0 to 1) from whole texts alone, without a shuffle.

    `und` with score 0: the text is null, has no letter, or there is no model. Else the
    language with the highest score; ties go to the first by name. Columns of docs pass
    unread; ones named lang_col or score_col are replaced.
    """
    kept = docs.drop(lang_col, score_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets * languages numbers

    def of(batches):
        know = shared.value
        for rows, texts in text_slices(batches, text_col):
            raw = texts.cast(pa.large_binary()).to_pylist()
            lang, score = np.full(len(raw), "und", object), np.zeros(len(raw))
            some = [i for i, t in enumerate(raw) if know is not None and not _no_letter(t)]
            for i in range(0, len(some), at_once):
                pick = some[i : i + at_once]
                sides = know.kernel.rows([raw[j] for j in pick]) @ know.weights + know.bias
                e = np.exp(4 * np.clip(sides - sides.max(1, keepdims=True), -20, 0))
                lang[pick], score[pick] = np.array(know.languages, object)[sides.argmax(1)], (e / e.sum(1, keepdims=True)).max(1)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lang, pa.string()), pa.array(score)], schema.names)

    return kept.mapInArrow(of, schema)
