"""Exact percentiles of tables of any size."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.storage import cut, drop

#: A pass settles so many bits of every wanted value: 64 bits take four passes.
BITS = 16


def image(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned 64-bit numbers in the same order (nan last); 0.0 and -0.0 are one."""
    raw = (np.asarray(values, np.float64) + 0.0).view(np.uint64)
    return np.where(raw >> np.uint64(63), ~raw, raw | np.uint64(1 << 63))


def value_of(number: int) -> float:
    """The double that has this image."""
    raw = number & ((1 << 63) - 1) if number >> 63 else ~number & ((1 << 64) - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def exact_quantiles(rows: DataFrame, column: str, shares: list[float], most: int = 1_000_000, at_once: int = 64) -> list[float | None]:
    """Percentiles with linear interpolation between neighbouring ranks, null for no rows.

    Up to most rows are few enough for one task and Spark's own percentile; beyond that
    values_at() finds the ranks, all of them together.
    """
    return exact_quantiles_of(rows, {column: shares}, most, at_once)[column]


def exact_quantiles_of(rows: DataFrame, shares: dict[str, list[float]], most: int = 1_000_000, at_once: int = 64) -> dict[str, list[float | None]]:
    """exact_quantiles() of several columns, in the passes of one."""
    seen = Observation()
    columns = list(shares)
    plain = rows.select(*[F.col(c).cast("double").alias(f"v{n}") for n, c in enumerate(columns)])
    values = cut(plain.observe(seen, *[F.count(f"v{n}").alias(f"n{n}") for n in range(len(columns))]), "values")
    counts = [seen.get[f"n{n}"] or 0 for n in range(len(columns))]
    found: dict[str, list[float | None]] = {c: [None] * len(shares[c]) for c in columns}
    if max(counts) <= most:
        done = values.agg(*[F.percentile(f"v{n}", F.array(*[F.lit(float(p)) for p in shares[c]])) for n, c in enumerate(columns)]).first()
        found |= {c: list(done[n]) for n, c in enumerate(columns) if done[n] is not None}
    else:
        places = {c: [p * (n - 1) for p in shares[c]] for c, n in zip(columns, counts, strict=True) if n}
        ranks = sorted({(columns.index(c), r) for c, at in places.items() for p in at for r in (math.floor(p), math.ceil(p))})
        at: dict[tuple[int, int], float] = {}
        for i in range(0, len(ranks), at_once):
            at |= values_at(values, ranks[i : i + at_once])
        for c, wanted in places.items():
            ends = [(at[columns.index(c), math.floor(p)], at[columns.index(c), math.ceil(p)], p - math.floor(p)) for p in wanted]
            found[c] = [low if low == high else low + (high - low) * part for low, high, part in ends]
    drop(values)
    return found


def values_at(values: DataFrame, ranks: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """The values with these (column number, rank from 0) among the columns' values that
    aren't null, in four passes whatever their number.

    A pass counts, for each different beginning that the wanted values are known to have,
    how many values go on with each of 2**16 next steps: tasks count in arrays, the counts
    are summed, and a running sum over one beginning's steps tells the step that holds each
    rank and how many values lie before it. Only that comes to the driver, a row a rank.
    """
    known = {r: (0, r[1]) for r in ranks}  # beginning, rank among the values that have it
    for shift in range(64 - BITS, -1, -BITS):
        slots = sorted({(column, known[column, rank][0]) for column, rank in ranks})

        def count(batches, slots=slots, shift=shift):
            sums = np.zeros((len(slots), 1 << BITS), np.int64)
            for batch in batches:
                for column in sorted({c for c, _ in slots}):
                    numbers = image(batch.column(column).drop_null().to_numpy(zero_copy_only=False))
                    high = numbers >> np.uint64(shift + BITS) if shift + BITS < 64 else np.zeros(len(numbers), np.uint64)
                    steps = ((numbers >> np.uint64(shift)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
                    for n, (c, beginning) in enumerate(slots):
                        if c == column:
                            sums[n] += np.bincount(steps[high == np.uint64(beginning)], minlength=1 << BITS)
            slot, step = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(step), pa.array(sums[slot, step])], ["slot", "step", "n"])

        counts = values.mapInArrow(count, "slot long, step long, n long").groupBy("slot", "step").agg(F.sum("n").alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("slot").orderBy("step")))  # 65,536 rows a slot
        holds = lambda slot, rank: (F.col("slot") == slot) & (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)
        asked = {r: (slots.index((r[0], known[r][0])), known[r][1]) for r in ranks}
        some = F.lit(False)
        for slot, rank in set(asked.values()):
            some |= holds(slot, rank)
        rows = upto.where(some).collect()
        for r, (slot, rank) in asked.items():
            (row,) = [x for x in rows if x["slot"] == slot and x["upto"] > rank >= x["upto"] - x["n"]]
            known[r] = (known[r][0] << BITS | row["step"], rank - row["upto"] + row["n"])
    return {r: value_of(number) for r, (number, _) in known.items()}
