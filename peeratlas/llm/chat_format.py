"""Chat conversations as template text with a loss mask, by columnar byte assembly."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import text_slices
from .storage import cut

OPEN, CLOSE = b"<|im_start|>", b"<|im_end|>"
_TURN = re.compile(re.escape(OPEN) + rb"([^\n]*)\n(.*?)" + re.escape(CLOSE) + rb"\n", re.DOTALL)


def escape(texts: pa.Array) -> pa.Array:
    r"""No text holds "<|" afterwards: "<", any backslashes, "|" get one more backslash."""
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def unescape(raw: bytes) -> bytes:
    return re.sub(rb"<\\(\\*)\|", rb"<\1|", raw) if b"<\\" in raw else raw


def escape_role(roles: pa.Array) -> pa.Array:
    """Roles stand on one line: line ends in them are written as \\n, backslashes twice."""
    return escape(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescape_role(raw: bytes) -> bytes:
    raw = unescape(raw)
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], raw, flags=re.DOTALL) if b"\\" in raw else raw


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its offsets into them."""
    raw = column.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    return np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def assemble(segments: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows' segments one after the other in one preallocated buffer.

    segments: constants (bytes) and string columns. From the lengths of all segments
    follow their offsets, from these the scatter index of each source byte. Returns the
    buffer and each segment's start, by row (with the end of the row as a last column).
    """
    sources = [s if isinstance(s, bytes) else _bytes_of(s) for s in segments]
    rows = next(len(s[1]) - 1 for s in sources if not isinstance(s, bytes))
    lengths = np.column_stack([np.full(rows, len(s)) if isinstance(s, bytes) else np.diff(s[1]) for s in sources])
    ends = np.cumsum(lengths).reshape(lengths.shape)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if rows else 0, np.uint8)
    for n, source in enumerate(sources):
        if isinstance(source, bytes):
            out[starts[:, n, None] + np.arange(len(source))] = np.frombuffer(source, np.uint8)
        else:
            body, offsets = source
            out[np.arange(len(body)) + np.repeat(starts[:, n] - offsets[:-1], lengths[:, n])] = body
    return out, np.column_stack([starts, ends[:, -1:]])


SEGMENT = "conv_id {id}, seg long, whole boolean, n_turns long, formatted binary, loss_start array<long>, loss_end array<long>"


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """Conversations' template text in segments: conv_id, seg (their order), whole (the
    segment is the whole conversation), n_turns, formatted (UTF-8), and the loss mask as
    byte spans of the texts of trained_role.

    Rows are ordered by turn (null first), ties by role and text; null roles and texts
    are empty; null ids make one conversation. Rows are dealt by ranges of (id, turn), so
    a conversation with very many turns spreads over tasks as segments. Repeated rows are
    turns of their own; other columns are ignored; an empty table gives no rows.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")

    def of(batches):
        place, seen = TaskContext.get().partitionId() << 32, 0
        for part, texts in text_slices(batches):
            roles, ids = part.column(2), part.column(0)
            buffer, at = assemble([OPEN, escape_role(roles), b"\n", escape(texts), CLOSE + b"\n"])
            codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            last = np.concatenate([first[1:], [len(codes)]])
            trained = np.flatnonzero(pc.equal(roles, trained_role).to_numpy(zero_copy_only=False))
            n = len(first)
            bounds = np.append(at[first, 0], len(buffer)).astype(np.int32)  # a slice is far below 2 GB
            bodies = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(buffer)])
            turns_before = np.searchsorted(trained, np.append(first, len(codes))).astype(np.int32)
            own = bounds[:-1].astype(np.int64)[np.searchsorted(first, trained, "right") - 1]
            spans = lambda column, t=trained, before=turns_before, own=own, at=at: pa.ListArray.from_arrays(pa.array(before), pa.array(at[t, column] - own))
            whole = np.ones(n, bool)
            whole[[0, -1]] = False
            columns = [ids.take(pa.array(first)), pa.array(place + seen + np.arange(n)), pa.array(whole), pa.array(last - first), bodies, spans(3), spans(4)]
            seen += n
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SEGMENT.split(", ")])

    return dealt.mapInArrow(of, SEGMENT.format(id=rows.schema["conv_id"].dataType.simpleString()))


def read_turns(body: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of the turns in template text, unescaped."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(body)]


DIGEST = "conv_id {id}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_PART = "conv_id {id}, seg long, n_turns long, loss_chars long, formatted_chars long, turns binary, loss binary, turns_sha256 string, loss_sha256 string"


def digests(segments: DataFrame) -> DataFrame:
    """What template text says, read back: one row per conversation with its turns'
    number and digest, and characters and digest of all text under the loss mask.

    Conversations in one segment are finished where they are read. A digest is a chain
    over a conversation's bytes, so segments of the others meet in order; one task then
    streams through them, a segment at a time.
    """
    kind = segments.schema["conv_id"].dataType.simpleString()

    def read(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = {k: [] for k in (f.split()[0] for f in _PART.split(", "))}
            for r in rows:
                turns = b"".join(role + b"\n" + text + b"\n" for role, text in read_turns(r["formatted"]))
                loss = [unescape(r["formatted"][a:b]) for a, b in zip(r["loss_start"], r["loss_end"], strict=True)]
                loss = b"".join(loss)
                values = [r["conv_id"], r["seg"], r["n_turns"], len(loss.decode()), len(r["formatted"].decode())]
                values += [None, None, hashlib.sha256(turns).hexdigest(), hashlib.sha256(loss).hexdigest()] if r["whole"] else [turns, loss, None, None]
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
            types = [batch.schema.field("conv_id").type, *[pa.int64()] * 4, *[pa.binary()] * 2, *[pa.string()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    def chain(batches):
        now, names = None, [f.split()[0] for f in DIGEST.split(", ")]

        def row(state, type_):
            values = [state["id"], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [type_, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], names)

        type_ = None
        for batch in batches:
            type_ = batch.schema.field("conv_id").type
            for r in batch.to_pylist():
                if now is None or now["id"] != r["conv_id"]:
                    if now is not None:
                        yield row(now, type_)
                    now = {"id": r["conv_id"], "n": 0, "loss_chars": 0, "chars": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256()}
                now["n"] += r["n_turns"]
                now["loss_chars"] += r["loss_chars"]
                now["chars"] += r["formatted_chars"]
                now["turns"].update(r["turns"])
                now["loss"].update(r["loss"])
        if now is not None:
            yield row(now, type_)

    parts = cut(segments.mapInArrow(read, _PART.format(id=kind)), "turn-digests")
    wanted = [f.split()[0] for f in DIGEST.split(", ")]
    split = parts.where("turns is not null").repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return parts.where("turns is null").select(*wanted).unionByName(split.mapInArrow(chain, DIGEST.format(id=kind)))
