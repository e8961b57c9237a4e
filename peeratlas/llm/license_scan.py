"""Licence detection by the rarest words of mandatory phrases and votes of the words around them."""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import split_words, text_slices
from .license_texts import TEXTS

# Phrases whose words name a licence, with their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Byte map of the word rule: 0-9, a-z (A-Z lower-cased) and bytes of other than ASCII stay.
_WORDS_ONLY = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


@dataclass
class Index:
    """The templates and phrases as numbers of the vocabulary's words."""

    vocabulary: list[str]
    templates: list[np.ndarray]
    labels: list[str]
    mandatory: list[list[np.ndarray]]
    phrases: list[tuple[np.ndarray, str]]
    idf: np.ndarray | None = None


def plain_words(text: str) -> list[str]:
    """The words of a text by the rule of the scan."""
    return text.encode().translate(_WORDS_ONLY).decode().split()


def build_index(templates=TEXTS, phrases=BASE_PHRASES) -> Index:
    words = plain_words
    vocabulary = sorted({w for _, text, keys in templates for part in (text, *keys) for w in words(part)} | {w for p, _ in phrases for w in words(p)})
    number = {w: i for i, w in enumerate(vocabulary)}
    coded = lambda text: np.array([number[w] for w in words(text)], np.int32)
    return Index(vocabulary, [coded(t) for _, t, _ in templates], [n for n, _, _ in templates], [[coded(k) for k in keys] for _, _, keys in templates], [(coded(p), label) for p, label in phrases])


def coded_words(texts: pa.Array, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of the texts as vocabulary numbers (-1: another word), and text ends."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    body = bytes(memoryview(raw.buffers()[2] or b"")[offsets[0] : offsets[-1]]).translate(_WORDS_ONLY)
    plain = pa.Array.from_buffers(pa.large_string(), len(raw), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(body)])
    words, ends = split_words(plain)
    codes = pc.index_in(words, pa.array(vocabulary, pa.large_string())).fill_null(-1).to_numpy(zero_copy_only=False)
    return codes.astype(np.int32), ends


def phrase_places(codes: np.ndarray, ends: np.ndarray, phrase: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Starts of the phrase's words in a row within one text, ascending: the postings of
    its rarest word, kept where the others stand at their relative positions."""
    anchor = int(np.argmax(idf[phrase]))
    at = np.flatnonzero(codes == phrase[anchor]) - anchor
    at = at[(at >= 0) & (at + len(phrase) <= len(codes))]
    for i, word in enumerate(phrase.tolist()):
        if i != anchor:
            at = at[codes[at + i] == word]
    return at[np.searchsorted(ends, at, "right") == np.searchsorted(ends, at + len(phrase) - 1, "right")]


def aligned(codes: np.ndarray, body: np.ndarray, start: int, band: int, jump: float = 1.0) -> float:
    """The most words of a template that stand in order in a text, less jump for each place
    where words were put in: the template's word t may stand at start + t + shift for shifts
    up to band either way, and the shift grows where the text has words of its own, and
    falls by one with each word of the template that the text leaves out."""
    lo = start - band
    window = np.full(len(body) + 2 * band, -2, np.int64)
    a, b = max(0, lo), min(len(codes), lo + len(window))
    window[a - lo : b - lo] = codes[a:b]
    hit = np.lib.stride_tricks.sliding_window_view(window, 2 * band + 1)[: len(body)] == body[:, None]
    if hit.any(axis=1).sum() < 0.5 * len(body):
        return 0.0
    best = hit[0].astype(float)
    for row in hit[1:]:
        from_lower = np.maximum.accumulate(best) - jump
        stay = np.maximum(best, from_lower) + row
        stay[:-1] = np.maximum(stay[:-1], best[1:])  # the word is left out
        best = stay
    return float(best.max())


def match_templates(codes: np.ndarray, index: Index, slack: int = 3, least_share: float = 0.6, band: int = 40) -> list[tuple[str, float]]:
    """(label, share) of the templates in one text.

    A template can stand only where its rarest mandatory phrase does. There the places of
    all its words less their places in the template vote for where it begins. A beginning
    counts if all mandatory phrases stand in its window, and least_share of the words at
    their place within slack words (for edits); fewer votes than that share are no match.

    A template that no beginning shows is aligned around each place of that phrase: words
    put in or left out shift what follows, by up to band words either way, and votes on
    both sides add up. So found, it counts unless a template with more words in place
    stands over half of the same text: the text of a licence holds those of shorter ones
    with words put in.
    """
    straight, spans, open_ = [], [], []
    whole = np.array([0, len(codes)])
    for template, body in enumerate(index.templates):
        keys = index.mandatory[template]
        reach = len(body) + 2 * slack
        rarest = max(keys, key=lambda k: index.idf[k].max())
        anchors = phrase_places(codes, whole, rarest, index.idf)
        if not len(anchors):
            continue
        edges = np.zeros(len(codes) + 1, np.int64)
        np.add.at(edges, np.maximum(anchors - reach, 0), 1)
        np.add.at(edges, np.minimum(anchors + reach, len(codes)), -1)
        near = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
        votes = np.sort(np.concatenate([near[codes[near] == word] - place for place, word in enumerate(body.tolist())]))
        begins = np.unique(votes)
        cast = np.searchsorted(votes, begins + slack, "right") - np.searchsorted(votes, begins - slack, "left")
        best = 0.0
        for begin in begins[cast >= least_share * len(body)].tolist():
            window = codes[max(0, begin - slack) : max(0, begin + len(body) + slack)]
            one = np.array([0, len(window)])
            if any(not len(phrase_places(window, one, key, index.idf)) for key in keys):
                continue
            hit = np.zeros(len(body), bool)
            for shift in range(-slack, slack + 1):
                at = begin + shift + np.arange(len(body))
                inside = (at >= 0) & (at < len(codes))
                hit[inside] |= codes[at[inside]] == body[inside]
            best = max(best, float(hit.mean()))
            if hit.mean() >= least_share:
                spans.append((begin, begin + len(body), int(hit.sum()), template))
        if best >= least_share:
            straight.append((index.labels[template], best))
        else:
            open_.append((template, rarest, anchors))
    shifted = []
    for template, rarest, anchors in open_:
        body, keys = index.templates[template], index.mandatory[template]
        inner = phrase_places(body, np.array([0, len(body)]), rarest, index.idf)
        for start in np.unique(np.add.outer(anchors, -(inner if len(inner) else np.array([0])))).tolist():
            window = codes[max(0, start - band) : max(0, start + len(body) + band)]
            one = np.array([0, len(window)])
            if any(not len(phrase_places(window, one, key, index.idf)) for key in keys):
                continue
            words = aligned(codes, body, start, band)
            if words >= least_share * len(body):
                shifted.append((start, start + len(body), words, template))
    spans += shifted
    found = dict(straight)
    for start, stop, words, template in shifted:
        half = (stop - start) / 2
        if not any(other != template and more > words and min(stop, b) - max(start, a) >= half for a, b, more, other in spans):
            label = index.labels[template]
            found[label] = max(found.get(label, 0.0), words / len(index.templates[template]))
    return list(found.items())


def word_idf(docs: DataFrame, index: Index, text_col: str = "text") -> np.ndarray:
    """ln((documents + 1) / (documents with the word + 1)) of the vocabulary's words over
    all documents: one row of counts a task, then their sum."""
    size = len(index.vocabulary)
    vocabulary = index.vocabulary

    def of(batches):
        total = np.zeros(size + 1, np.int64)
        for _, texts in text_slices(batches):
            codes, ends = coded_words(texts, vocabulary)
            use = np.flatnonzero(codes >= 0)
            rows = np.searchsorted(ends, use, "right") - 1
            pairs = np.unique(rows * np.int64(size) + codes[use])
            total[:size] += np.bincount(pairs % size, minlength=size)
            total[size] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), pa.array(total)], ["word", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(of, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size + 1)
    for r in rows:
        counts[r["word"]] = r["n"]
    return np.log((counts[size] + 1) / (counts[:size] + 1))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEXTS, phrases=BASE_PHRASES) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score per row.

    Words: runs of 0-9, a-z and other than ASCII after lower-casing A-Z; whole texts. A
    null text counts as empty: no words, no labels, score 0, first and last null. score:
    1 for a base phrase, else the best template's share of words in place. Repeated rows
    each give a row; other columns are ignored; an empty table gives no rows. Two passes: IDF over all documents, then the scan; no shuffle of texts.
    """
    index = build_index(templates, phrases)
    index.idf = word_idf(docs, index, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # the templates: fixed size
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches):
        know = shared.value
        anchors = np.zeros(len(know.vocabulary) + 1, bool)
        for keys in know.mandatory:
            for key in keys:
                anchors[key[np.argmax(know.idf[key])]] = True  # the rarest word of each mandatory phrase
        for rows, texts in text_slices(batches):
            codes, ends = coded_words(texts, know.vocabulary)
            n = len(texts)
            count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base, more, score = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
            for phrase, label in know.phrases:
                at = phrase_places(codes, ends, phrase, know.idf)
                row = np.searchsorted(ends, at, "right") - 1
                at = at - ends[row]
                np.add.at(count, row, 1)
                np.minimum.at(first, row, at)
                np.maximum.at(last, row, at)
                for r in np.unique(row).tolist():
                    base[r].add(label)
            score[count > 0] = 1.0
            for r in np.unique(np.searchsorted(ends, np.flatnonzero(anchors[codes]), "right") - 1).tolist():
                for label, share in match_templates(codes[ends[r] : ends[r + 1]], know):
                    more[r].add(label)
                    score[r] = max(score[r], share)
            none = count == 0
            text = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(ends)), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none), text(base), text([a | b for a, b in zip(base, more, strict=True)]), pa.array(score)],
                ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(of, schema)


def base_pattern(phrase: str) -> re.Pattern:
    """The phrase as a pattern over lower-cased text; tests hold the scan against it."""
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return re.compile(r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])" + gap.join(phrase.split()) + r"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])")
