"""Packing token sequences: harmonic classes of reciprocal capacity."""

import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .batches import split_words, text_slices
from .storage import cut

PIECE = "id {id}, start long, length long, ids_crc32 long, doc_tokens long, part int, cls int, idx long"
#: Words that the normaliser and splitter of word_bpe_49k.json leave as they are.
_PLAIN = re.compile(r"[a-zß-öø-ÿ]+\Z")
_BYTES = ByteLevel(add_prefix_space=False, use_regex=False)
#: The characters of plain words as the model spells them.
_SPELT = {c: _BYTES.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}
#: Byte kinds: 1 letters and digits of ASCII, 2 marks of ASCII but 3 the apostrophe, 0 others.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[ord("'")] = 3
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _KIND[_a:_b] = 1
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A tokenizer that gives these other ids by words than by whole texts is used by whole texts.
PROBE = ("A plain text, it's 1st and we'll SEE.", "Été ß÷ naïve\t\tx1y2 a.b-c (d) … 漢字", "don't\nUPPER'S <|x|> 3.14 _under_ é İ")


class WordIds:
    """Ids of texts, for a tokenizer whose splitter never joins across white space and
    takes a word of a-z as it is: a different word is encoded once in a worker (up to
    most_words at a time), and texts are put together from word ids by array operations.
    A tokenizer with other rules, as the probe tells, encodes whole texts."""

    def __init__(self, path: str, most_words: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.full = Tokenizer.from_file(path)
        self.specials = [t.content.encode().lower() for t in self.full.get_added_tokens_decoder().values()]
        self.most_words = most_words
        self._empty()
        self.by_words = True
        ids, at = self.encode(pa.array(PROBE))
        self.by_words = all(ids[at[n] : at[n + 1]].tolist() == self.full.encode(text, add_special_tokens=False).ids for n, text in enumerate(PROBE))

    def _empty(self) -> None:
        self.known, self.ids, self.starts, self.counts = {}, array("i"), array("q"), array("i")

    def _learn(self, words: list[str]) -> None:
        spell = self.full.model.tokenize
        plain = [w for w in words if _PLAIN.match(w)]
        for word in plain:
            self._keep(word, [t.id for t in spell(word if word.isascii() else word.translate(_SPELT))])
        other = list(set(words).difference(plain))
        for i in range(0, len(other), 20_000):
            block = other[i : i + 20_000]
            for word, got in zip(block, self.full.encode_batch_fast(block, add_special_tokens=False), strict=True):
                self._keep(word, got.ids)

    def _keep(self, word: str, ids: list[int]) -> None:
        self.known[word] = len(self.starts)
        self.starts.append(len(self.ids))
        self.counts.append(len(ids))
        self.ids.extend(ids)

    def _spaced(self, texts: pa.Array) -> pa.Array:
        """Texts with A-Z lower-cased and a blank where letters or digits meet a mark: the
        splitter ends a piece there in any case, and there are fewer different words. (Not
        after an apostrophe, as in 's. A text with a special token stays as it is.)"""
        raw = texts.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        body = bytes(memoryview(raw.buffers()[2] or b"")[offsets[0] : offsets[-1]])
        offsets = offsets - offsets[0]
        low = np.frombuffer(body.translate(_LOWER), np.uint8)
        kind = _KIND[low]
        split = np.zeros(len(low) + 1, bool)  # whether a blank goes before each byte
        if len(low):
            split[1:-1] = ((kind[:-1] == 1) & (kind[1:] >= 2)) | ((kind[:-1] == 2) & (kind[1:] == 1))
        if b"<|" in body:
            low = low.copy()
            for row in range(len(raw)):
                a, b = offsets[row], offsets[row + 1]
                if any(s in bytes(low[a:b]) for s in self.specials):
                    low[a:b] = np.frombuffer(body[a:b], np.uint8)
                    split[a : b + 1] = False
        at = np.flatnonzero(split)
        out = np.insert(low, at, 32)
        ends = offsets + np.searchsorted(at, offsets, "right")
        return pa.Array.from_buffers(pa.large_string(), len(raw), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's begin (with a last end)."""
        if not self.by_words:
            found = [e.ids for e in self.full.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.int32), np.cumsum([0, *map(len, found)])
        words, ends = split_words(self._spaced(texts))
        coded = words.dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if not different:
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        if len(self.known) > self.most_words:
            self._empty()
        self._learn([w for w in different if w not in self.known])
        numbers = np.fromiter(map(self.known.__getitem__, different), np.int32, len(different))
        use = numbers[coded.indices.to_numpy()]
        counts = np.frombuffer(self.counts, np.int32)[use]
        stops = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        shift = (np.frombuffer(self.starts, np.int64)[use] - stops[:-1]).astype(np.int32)  # both are under 2**31 for a slice
        place = np.arange(stops[-1], dtype=np.int32) + np.repeat(shift, counts)
        return np.frombuffer(self.ids, np.int32)[place], stops[ends]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for all tasks of a worker: words learned for one task serve the next."""
    return WordIds(path)


@lru_cache(maxsize=4)
def cut_table(capacity: int, piece_cost: float = 32.0) -> tuple[np.ndarray, np.ndarray]:
    """How rests of 0 to capacity - 1 ids are cut: the first piece of each rest, and how
    many pieces it makes.

    A piece of length l is of class k = capacity // l: k of them fill one sequence. Its
    padding is its share of the sequence, capacity / k, less l. Cuts have the least
    padding plus piece_cost for each piece, so a document stays whole where cutting it
    saves less than piece_cost ids. A first piece that isn't the last has the full length
    of its class.
    """
    exact = np.unique(capacity // np.arange(1, capacity + 1))
    padding = capacity / (capacity // exact) - exact
    cost, first, pieces = np.zeros(capacity), np.zeros(capacity, np.int64), np.zeros(capacity, np.int64)
    for rest in range(1, capacity):
        cost[rest], first[rest], pieces[rest] = capacity / (capacity // rest) - rest, rest, 1
        some = exact[: np.searchsorted(exact, rest)]
        if len(some):
            cut_costs = padding[: len(some)] + piece_cost + cost[rest - some]
            best = len(some) - 1 - int(np.argmin(cut_costs[::-1]))  # of equal ones the longest
            if cut_costs[best] < cost[rest]:
                cost[rest], first[rest], pieces[rest] = cut_costs[best], some[best], 1 + pieces[rest - some[best]]
    return first, pieces


def cut_all(tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of all pieces of documents of these lengths: full sequences,
    then the rest by cut_table."""
    first, pieces = cut_table(capacity)
    whole, rest = tokens // capacity, tokens % capacity
    each = whole + pieces[rest]
    row = np.repeat(np.arange(len(tokens)), each)
    place = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    length = np.full(len(row), capacity, np.int64)
    left, at = rest.copy(), np.cumsum(each) - each + whole
    while (open_ := np.flatnonzero(left)).size:  # as often as a rest has pieces, a few times
        length[at[open_]] = first[left[open_]]
        left[open_] -= first[left[open_]]
        at[open_] += 1
    before = np.cumsum(length) - length
    return row, before - np.repeat(before[np.flatnonzero(place == 0)], each[each > 0]), length


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece, with its harmonic class (how many fill a sequence) and its
    number among the task's pieces of the class. A null text counts as empty: only the
    end id."""
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches):
        encoder, part, seen = word_ids(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows, texts in text_slices(batches):
            ids, at = encoder.encode(texts)
            own = memoryview(np.insert(ids, at[1:], end_id).astype("<u4").tobytes())
            tokens = np.diff(at) + 1
            row, start, length = cut_all(tokens, capacity)
            lo = 4 * ((np.cumsum(tokens) - tokens)[row] + start)
            crc = [zlib.crc32(own[a:b]) for a, b in zip(lo.tolist(), (lo + 4 * length).tolist(), strict=True)]
            cls = capacity // length
            order = np.argsort(cls, kind="stable")
            counts = np.bincount(cls, minlength=capacity + 1)
            idx = np.empty(len(cls), np.int64)
            idx[order] = np.arange(len(cls)) + (seen + counts - np.cumsum(counts))[cls[order]]
            seen += counts
            columns = [rows.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[row]), pa.array(np.full(len(row), part, np.int32)), pa.array(cls.astype(np.int32)), pa.array(idx)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PIECE.split(", ")])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(of, PIECE.format(id=kind))


def fill_rest(rows: pd.DataFrame, capacity: int, first: int) -> pd.DataFrame:
    """First-fit decreasing for the pieces that fill no sequence of their class. Per class
    these are fewer than one sequence takes, so all of them fit in less than one sequence
    a class: a bound that depends on the capacity alone."""
    rows = rows.sort_values(["length", "part", "idx"], ascending=[False, True, True])
    rooms: list[int] = []
    bins, offsets = [], []
    for length in rows["length"]:
        at = next((i for i, room in enumerate(rooms) if room >= length), len(rooms))
        if at == len(rooms):
            rooms.append(capacity)
        bins.append(at)
        offsets.append(capacity - rooms[at])
        rooms[at] -= length
    return rows.assign(sequence_id=first + np.array(bins, np.int64), offset=np.array(offsets, np.int64))


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces in sequences: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A piece of length l is of class k = capacity // l, and k pieces of a class fill one
    sequence; cut_table cuts documents so that little is padded. Tasks number their own
    pieces while they encode; a running sum over tasks (one row per task and class) turns
    these numbers into sequence numbers, so that no class meets in one task however many
    pieces it holds. What fills no sequence, at most one sequence a class, is packed
    together at the end.

    Null and empty texts give one id each; repeated rows and ids are packed as often as
    they come; an empty table gives no rows. Other columns are ignored.
    """
    cutting = cut(pieces(docs, tokenizer, id_col, text_col, capacity, end_id), "pieces")
    counts = cutting.groupBy("cls", "part").agg((F.max("idx") + 1).alias("n"))
    earlier = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "counts")
    classes = counts.groupBy("cls").agg(F.sum("n").alias("total"))
    lower = Window.orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)  # a row per class: at most capacity rows
    classes = classes.withColumn("bins", F.floor(F.col("total") / F.col("cls")))
    classes = cut(classes.withColumn("first", F.coalesce(F.sum("bins").over(lower), F.lit(0))), "classes")
    first_rest = classes.agg(F.sum("bins")).first()[0] or 0
    offsets = counts.join(classes, "cls").select("cls", "part", "before", "bins", "first")
    numbered = cutting.join(offsets, ["cls", "part"]).withColumn("g", F.col("before") + F.col("idx")).withColumn("bin", F.floor(F.col("g") / F.col("cls")))
    wanted = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    inside = Window.partitionBy("sequence_id").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # k rows of class k
    full = numbered.where("bin < bins").withColumn("sequence_id", F.col("first") + F.col("bin")).withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).select(*wanted)
    rest = numbered.where("bin >= bins").select(*cutting.columns)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema) + ", sequence_id long, offset long"
    ends = rest.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda rows: fill_rest(rows.drop(columns="all"), capacity, first_rest), kinds)
    return full.unionByName(ends.select(*wanted))
