"""A graph in parts, for rounds in which nodes see values of their neighbours.

A node of number i is in part i % parts, at place i // parts there. A part holds its nodes' edges, seen
from either end, as arrays in rows of a table bucketed by part, so a round leaves them where they lie.
What a round shuffles is a node's value once for each part in which the node has neighbours, never more
values than edges and without ids: a part's neighbours in another part are, in order, those nodes of the
other that have neighbours in this one, so both know the places. Parts are sized by edges; the edges of
one node are in one task.
"""

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import bucketed, cut, drop
from .edges import with_row_index

#: Edges of a part, counted from either end, of a row of its table, and of what is dealt at once.
EACH, ROW, DEAL = 12_000_000, 250_000, 2_000_000

DEALT = "part long, node binary, other binary, weight binary"
EDGES = "part long, p int, first int, counts binary, others binary, weights binary, peer int, route binary"
VALUES = "part long, sender int, place binary, value binary, open binary, total binary, degree binary"


def part_count(rows: int) -> int:
    """Parts for so many edges, counted from either end: the same number for each core."""
    cores = SparkSession.active().sparkContext.defaultParallelism
    return cores * max(1, -(-rows // (EACH * cores)))


def part_keys(parts: int) -> list[int]:
    """A key for each part, such that each of so many shuffle partitions or buckets gets
    one. That only makes them even: a partition with several parts, or none, does no harm."""
    drawn = SparkSession.active().range(40 * parts, numPartitions=1).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("at")).agg(F.min("id").alias("key"))
    found = {r["at"]: r["key"] for r in drawn.collect()}
    return [found.get(p, 40 * parts + p) for p in range(parts)]


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges between numbers of their ends, and names(number, node) in the order of nodes."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).where("node IS NOT NULL").distinct()
    names = cut(with_row_index(ends, ["node"], "number").select(F.col("number").cast("int").alias("number"), "node"), "names")
    met = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), "weight")
    met = met.join(names.toDF("src", "_s"), "_s").join(names.toDF("dst", "_d"), "_d")
    return met.select("src", "dst", "weight"), names


def named(rows: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """rows with nodes in place of their numbers."""
    for c in columns:
        rows = rows.join(names.select(F.col("number").alias(c), F.col("node").alias("_name")), c).withColumn(c, F.col("_name")).drop("_name")
    return rows


class Blocks:
    """The graph of pairs(src, dst, weight) between numbers 0, 1, ..., each edge given from
    one end, or of rows that dealt() made of edges from both; the weights of repeated pairs
    are added up. Where path holds the table that an earlier run wrote to its end, it is
    taken as it is."""

    def __init__(self, pairs: DataFrame, parts: int, path: str | None = None) -> None:
        self.parts, self.keys = parts, part_keys(parts)
        if "part" not in pairs.columns:
            weight = F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight")
            pairs = pairs.select(F.col("src").cast("int"), F.col("dst").cast("int"), weight).mapInArrow(partial(_deal, parts, self.keys), DEALT)
        rows = pairs.repartition(parts, "part").mapInArrow(partial(_build, parts, self.keys), EDGES)
        self.table = bucketed(rows, "blocks", "part", parts, path, dealt=True)
        self.edges = self.table.where("counts IS NOT NULL").select("part", "p", "first", "counts", "others", "weights")
        self.routes = self.table.where("route IS NOT NULL").select("part", "peer", "route")

    def key(self, number: Column) -> Column:
        return F.expr(f"array({', '.join(f'{k}L' for k in self.keys)})")[(number % self.parts).cast("int")]

    def nodes(self, unit: float | None = None) -> DataFrame:
        """node, degree: the nodes that have edges; with a unit those with a degree, in units."""
        return self.edges.select("p", "first", "counts", "weights").mapInArrow(partial(_nodes, self.parts, unit), "node int, degree long")

    def round(self, state: DataFrame, take: Callable, schema: str, full: bool = False) -> DataFrame:
        """What take(p, own, seen, rows) makes of each part, from state(node, value) or
        state(node, value, open, total, degree) of all nodes: own and seen are arrays by
        column, of the part's nodes by place, and of their neighbours in the order that
        rows' others count. Totals of neighbours that aren't open are only sent when full."""
        own = state.withColumn("part", self.key(F.col("node")))
        told = own.groupBy("part").cogroup(self.routes.groupBy("part")).applyInArrow(partial(_send, self.parts, self.keys, full), VALUES)
        return told.groupBy("part").cogroup(self.edges.groupBy("part")).applyInArrow(partial(_receive, self.parts, self.keys, full, take), schema)

    def drop(self) -> None:
        drop(self.table)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)


def _spans(keys: np.ndarray) -> list[tuple[int, int]]:
    """From where to where sorted keys are equal."""
    at = _runs(keys).tolist()
    return list(zip(at, at[1:] + [len(keys)], strict=True)) if at else []


def dealt(parts: int, keys: list[int], node: np.ndarray, other: np.ndarray, w: np.ndarray) -> pa.Table:
    """Edges from node, as a row for each part."""
    part = node % parts
    order = np.argsort(part.astype(np.uint16 if parts < 1 << 16 else np.int64), kind="stable")
    node, other, w, part = node[order].astype(np.int32), other[order].astype(np.int32), w[order].astype(float), part[order]
    rows = [{"part": keys[part[a]], "node": node[a:b].tobytes(), "other": _planes(other[a:b]), "weight": w[a:b].tobytes()} for a, b in _spans(part)]
    return pa.Table.from_pylist(rows, _schema(DEALT))


def _deal(parts: int, keys: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read, size = [], 0
    for batch in batches:
        read.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += 2 * batch.num_rows
        if size >= DEAL:
            yield from _both_ways(parts, keys, read).to_batches()
            read, size = [], 0
    if size:
        yield from _both_ways(parts, keys, read).to_batches()


def _both_ways(parts: int, keys: list[int], read: list) -> pa.Table:
    a, b, w = (np.concatenate(c) for c in zip(*read, strict=True))
    return dealt(parts, keys, np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w]))


def _build(parts: int, keys: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = {}
    for batch in batches:
        for key, *row in zip(batch.column("part").to_pylist(), *(batch.column(c) for c in ("node", "other", "weight")), strict=True):
            node, other, weight = (v.as_buffer() for v in row)
            pair = np.frombuffer(node, np.int32).astype(np.int64) << 32
            pair |= _numbers(other, np.int32)
            read.setdefault(key, []).append((pair, np.frombuffer(weight).copy()))
    for key in list(read):
        for row in _block(parts, key, keys.index(key), read.pop(key)):
            yield pa.RecordBatch.from_pylist([row], _schema(EDGES))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def _block(parts: int, key: int, p: int, read: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[dict]:
    """The rows of one part: its edges by node, and for each peer the places of its nodes
    that have neighbours there. What is not needed is let go: a part is some hundred MB."""
    pair, w = (np.concatenate(c) for c in zip(*read, strict=True))
    read.clear()
    order = np.argsort(pair)
    pair, w = pair[order], w[order]
    del order
    starts = _runs(pair)
    if len(starts) < len(pair):  # repeats are added up from the smallest, so that both ends get the same sum
        sizes = np.diff(starts, append=len(pair))
        at = np.flatnonzero(np.repeat(sizes > 1, sizes))
        w[at] = w[at][np.lexsort((w[at], pair[at]))]
        w, pair = np.add.reduceat(w, starts), pair[starts]
        del sizes, at
    del starts
    place = ((pair >> 32) // parts).astype(np.int32)
    pair &= 0xFFFFFFFF
    peer = (pair % parts) << 32
    pair //= parts
    pair |= peer  # the neighbours, by part and place
    peer |= place
    peer.sort()
    routes = peer[_runs(peer)]
    del peer
    known = np.sort(pair)
    known = known[_runs(known)]
    others = np.empty(len(pair), np.int32)
    for n in range(0, len(pair), DEAL):
        others[n : n + DEAL] = np.searchsorted(known, pair[n : n + DEAL])
    del pair, known
    counts = np.bincount(place).astype(np.int32)
    ends = np.cumsum(counts)
    first = int(place[0])
    blank = {"part": key, "p": p}
    while first < len(counts):
        done = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + ROW, "right")))
        to = int(ends[last - 1])
        yield blank | {"first": first, "counts": counts[first:last].tobytes(), "others": others[done:to].tobytes(), "weights": w[done:to].tobytes()}
        first = last
    for a, b in _spans(routes >> 32):
        yield blank | {"peer": int(routes[a] >> 32), "route": (routes[a:b] & 0xFFFFFFFF).astype(np.int32).tobytes()}


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second, ...: what is zero in all packs well."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _numbers(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _send(parts: int, keys: list[int], full: bool, state: pa.Table, routes: pa.Table) -> pa.Table:
    """A part's own state, and the values for each peer."""
    key = (state if len(state) else routes).column("part")[0].as_py()
    moves = "open" in state.column_names
    routes = [(peer, np.frombuffer(route.as_buffer(), np.int32)) for peer, route in zip(routes.column("peer").to_pylist(), routes.column("route"), strict=True)]
    place = state.column("node").to_numpy() // parts
    size = 1 + max([int(place.max(initial=-1))] + [int(at[-1]) for _, at in routes])
    values = lambda c, kind, none: _placed(size, place, state.column(c).to_numpy().astype(kind), none)
    value = values("value", np.int32, -1)
    own = {"part": key, "sender": -1, "place": place.astype(np.int32).tobytes(), "value": value[place].tobytes()}
    if moves:
        opened, total = values("open", bool, 0), values("total", np.int64, 0)
        own |= {"open": opened[place].tobytes(), "total": total[place].tobytes(), "degree": state.column("degree").to_numpy().astype(np.int64).tobytes()}
    rows, p = [own], keys.index(key)
    for peer, at in routes:
        row = {"part": keys[peer], "sender": p, "value": _planes(value[at])}
        if moves:
            row |= {"open": np.packbits(opened[at]).tobytes(), "total": _planes(total[at] if full else total[at][opened[at]])}
        rows.append(row)
    return pa.Table.from_pylist(rows, _schema(VALUES))


def _receive(parts: int, keys: list[int], full: bool, take: Callable, told: pa.Table, edges: pa.Table) -> pa.Table:
    rows = sorted(told.to_pylist(), key=lambda r: r["sender"])
    mine, rows = rows[0], rows[1:]  # each part with edges has routes, so it has sent its state
    place = np.frombuffer(mine["place"], np.int32)
    ends = [f.as_py() + len(c.as_buffer()) // 4 for f, c in zip(edges.column("first"), edges.column("counts"), strict=True)]
    size = max([int(place.max(initial=-1)) + 1] + ends)
    own = {"place": place, "value": _placed(size, place, np.frombuffer(mine["value"], np.int32), -1)}
    seen = {"value": _joined([_numbers(r["value"], np.int32) for r in rows], np.int32)}
    if mine["open"] is not None:
        for c, kind in (("open", bool), ("total", np.int64), ("degree", np.int64)):
            own[c] = _placed(size, place, np.frombuffer(mine[c], kind), 0)
        bits = [np.unpackbits(np.frombuffer(r["open"], np.uint8), count=len(r["value"]) // 4).astype(bool) for r in rows]
        seen["open"], sent = _joined(bits, bool), _joined([_numbers(r["total"], np.int64) for r in rows], np.int64)
        seen["total"] = sent
        if not full:
            seen["total"] = np.zeros(len(seen["open"]), np.int64)
            seen["total"][seen["open"]] = sent
    return take(parts, keys.index(mine["part"]), own, seen, _rows(edges))


def _placed(size: int, place: np.ndarray, values: np.ndarray, none: int) -> np.ndarray:
    found = np.full(size, none, values.dtype)
    found[place] = values
    return found


def _joined(arrays: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def _rows(edges: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row of a part: of each edge its node's place, its neighbour's, its weight."""
    for n in range(len(edges)):
        first, counts, others, weights = (edges.column(c)[n] for c in ("first", "counts", "others", "weights"))
        counts = np.frombuffer(counts.as_buffer(), np.int32)
        place = np.repeat(np.arange(first.as_py(), first.as_py() + len(counts)), counts)
        yield place, np.frombuffer(others.as_buffer(), np.int32), np.frombuffer(weights.as_buffer(), np.float64)


def in_units(w: np.ndarray, unit: float) -> np.ndarray:
    return np.floor(w / unit + 0.5).astype(np.int64)


def _nodes(parts: int, unit: float | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n in range(batch.num_rows):
            p, first, counts, weights = (batch.column(c)[n] for c in ("p", "first", "counts", "weights"))
            counts = np.frombuffer(counts.as_buffer(), np.int32)
            at = np.flatnonzero(counts)
            degree = counts[at].astype(np.int64)
            if unit is not None:
                w = in_units(np.frombuffer(weights.as_buffer(), np.float64), unit)
                degree = np.add.reduceat(np.maximum(w, 0), (np.cumsum(counts) - counts)[at]) if len(at) else degree
                at, degree = at[degree > 0], degree[degree > 0]
            node = (p.as_py() + parts * (first.as_py() + at)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(degree)], names=["node", "degree"])


def sums(place: np.ndarray, value: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """place, value, where in the input one such is, sum of w: for each pair, in order."""
    key = place.astype(np.int64) << 32 | value
    order = np.argsort(key)
    key = key[order]
    starts = _runs(key)
    added = np.add.reduceat(w[order], starts) if len(starts) else w[:0]
    key = key[starts]
    return key >> 32, key & 0xFFFFFFFF, order[starts], added


def best(place: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The index of each place's largest score, of equal ones the first; place is sorted."""
    starts = _runs(place)
    if not len(starts):
        return starts
    top = np.repeat(np.maximum.reduceat(score, starts), np.diff(np.append(starts, len(place))))
    found = np.flatnonzero(score == top)
    return found[_runs(place[found])]


def table(schema: str, *columns: np.ndarray) -> pa.Table:
    kinds = _schema(schema)
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)
