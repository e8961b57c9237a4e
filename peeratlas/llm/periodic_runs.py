"""Periodic runs of words in texts, by Karp-Miller-Rosenberg names."""

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import split_words, text_slices

RUNS = "id {id}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def power_names(codes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Names of the 2**k words from each place, for k = 0, 1, ...: two places of one text
    have the same name exactly if these words are the same.

    codes: all texts' words as numbers; ends: where texts begin, with a last end. A name
    of level k + 1 is the pair of two names of level k. What occurs once in its text has
    the name -1 - place, which no other place has, and is left out of the next level, as
    is what reaches beyond its text; so levels end where nothing occurs twice. Each level
    has one more place, the end of all, whose name is no other's.
    """
    sizes, n = np.diff(ends), len(codes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    stop = np.repeat(ends[1:], sizes)
    at = np.arange(n)
    pairs = text * (int(codes.max()) + 1 if n else 1) + codes
    levels: list[np.ndarray] = []
    while True:
        _, inverse, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        if levels and not again.any():
            return levels
        name = (-1 - np.arange(n + 1)).astype(np.int32)
        name[at[again]] = inverse[again]
        half = 1 << len(levels)
        levels.append(name)
        at = at[again]
        at = at[at + 2 * half <= stop[at]]
        at = at[name[at + half] >= 0]
        pairs = name[at].astype(np.int64) * (len(counts) + 1) + name[at + half]


def forward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i equal those from j, by descending levels."""
    i, j, first = i.copy(), j.copy(), i
    for k in range(len(levels) - 1, -1, -1):
        step = (levels[k][i] == levels[k][j]).astype(np.int64) << k
        i += step
        j += step
    return i - first


def backward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i equal those before j (i < j)."""
    i, j, first = i.copy(), j.copy(), i
    for k in range(len(levels) - 1, -1, -1):
        room = i >= 1 << k
        step = (room & (levels[k][np.where(room, i - (1 << k), 0)] == levels[k][j - (1 << k)])).astype(np.int64) << k
        i -= step
        j -= step
    return first - i


def find_runs(codes: np.ndarray, ends: np.ndarray, least: int = 12, at_once: int = 1 << 20) -> np.ndarray:
    """(text, start, end, period) of all maximal runs of smallest period q and length
    max(least, 2 q) or more, by text, start and period; places count over all texts.

    A run of period p holds a place of every grid of step max(p, least - p) along with the
    place p further on. Pairs of such places that hold the same word are extended both ways
    by their names; their count is n log n for a text of n words, taken at_once at a time.
    Of periods that give the same stretch the smallest is its period.
    """
    levels, sizes = power_names(codes, ends), np.diff(ends)
    found = [np.zeros((0, 3), np.int64)]
    half = np.where(sizes >= least, sizes // 2, 0)
    text = np.repeat(np.arange(len(sizes)), half)
    period = np.arange(1, len(text) + 1) - np.repeat(np.cumsum(half) - half, half)
    step = np.maximum(period, least - period)
    counts = -(-(sizes[text] - period) // step)
    stops = np.cumsum(counts)
    lo = 0
    while lo < len(text):
        before = stops[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(stops, before + at_once, "right")))
        c = counts[lo:hi]
        nth = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        p = np.repeat(period[lo:hi], c)
        i = np.repeat(ends[text[lo:hi]], c) + nth * np.repeat(step[lo:hi], c)
        same = np.flatnonzero(levels[0][i] == levels[0][i + p])
        i, p = i[same], p[same]
        more, less = forward(levels, i, i + p), backward(levels, i, i + p)
        run = (more + less >= p) & (more + less + p >= least)
        found.append(np.unique(np.column_stack([i - less, i + p + more, p])[run], axis=0))
        lo = hi
    runs = np.unique(np.concatenate(found), axis=0)
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[first]
    where = np.searchsorted(ends, runs[:, 0], "right") - 1
    order = np.lexsort((runs[:, 2], runs[:, 0], where))
    return np.column_stack([where, runs])[order]


def repeats_dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words stay where every run keeps its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 1] + runs[:, 3], 1)
    np.add.at(depth, runs[:, 2], -1)
    return np.cumsum(depth)[:n] == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, rearrange: Callable | None = None) -> DataFrame:
    """id, n_words, runs (start, length, period in words from 0, by start and period) and
    the collapsed text: words joined by a blank, without those that a run contains after
    its first period.

    Whole texts, each on its own, in slices of some MB (a longer text is a slice), so there
    is no shuffle, and memory follows the slice. rearrange(ids, ends) may give, for all
    words of a slice, the places that they are taken from, within their texts.

    Null and empty texts and those without words have no runs and collapse to an empty
    text; null and repeated ids and repeated rows are answered row by row; an empty table
    gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches):
        for rows, texts in text_slices(batches):
            words, ends = split_words(texts)
            ids = rows.column(0)
            if rearrange is not None:
                places = rearrange(ids, ends)
                words = words if places is None else words.take(pa.array(places))
            codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            runs = find_runs(codes, ends, least)
            kept = repeats_dropped(runs, len(codes))
            own = [pa.array(runs[:, 1] - ends[runs[:, 0]]), pa.array(runs[:, 2] - runs[:, 1]), pa.array(runs[:, 3])]
            lists = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
            structs = pa.StructArray.from_arrays(own, ["start", "length", "period"])
            offsets = np.concatenate([[0], np.cumsum(kept)])[ends].astype(np.int32)
            words = words if kept.all() else words.filter(pa.array(kept))
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words.cast(pa.string())), " ")
            columns = [ids, pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(lists), structs), collapsed]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(of, RUNS.format(id=kind))


def planted_repeats(ids: pa.Array, ends: np.ndarray) -> np.ndarray | None:
    """The places of the registered query: one document in ten, drawn by the checksum of
    its id, repeats some of its words to its end. Documents without an id stay."""
    places = None
    for n, name in enumerate(ids.to_pylist()):
        size = int(ends[n + 1] - ends[n])
        h = 1 if name is None else zlib.crc32(str(name).encode())
        if h % 10 == 0 and size:
            places = np.arange(ends[-1]) if places is None else places
            g = h // 10
            a = g % size
            period = 1 + (size - a) // (3 + g % 8)
            places[ends[n] + a : ends[n + 1]] = ends[n] + a + np.arange(size - a) % period
    return places
