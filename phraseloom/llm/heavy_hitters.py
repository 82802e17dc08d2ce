"""Most frequent values with bounded memory: a hierarchical count-sketch."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SketchShape:
    """Sizes of the sketch; its memory is levels * depth * width counters, whatever the data.

    ``bits`` are the lengths of the hash prefixes, one count-sketch each.
    """

    bits: tuple[int, ...] = (8, 16, 24, 32, 40)
    depth: int = 9
    width: int = 4096

    def cells(self) -> int:
        return len(self.bits) * self.depth * self.width

    @classmethod
    def fit(cls, one_in: int) -> SketchShape:
        """Wide enough for values that one in ``one_in`` rows hold: eight counters for each that there can be, in every row."""
        width = max(4096, 1 << (8 * one_in - 1).bit_length())
        if cls(width=width).cells() > MOST_CELLS:
            raise ValueError(f"one in {one_in} rows takes {cls(width=width).cells():,} counters; give a shape to take more than {MOST_CELLS:,}")
        return cls(width=width)


#: Counters that a task and the driver hold unless a shape is given: half a gigabyte.
MOST_CELLS = 1 << 26

#: Heavy prefixes that are compared as literals; more are joined as a broadcast table.
MOST_LITERALS = 1000


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9], np.uint64)


def _cell_and_sign(prefix: np.ndarray, level: int, row: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of each prefix in one row of one level."""
    x = (prefix + np.uint64(level * 131 + 1 + row // len(_ODD) * 65537)) * _ODD[row % len(_ODD)]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    bucket = (x & np.uint64(width - 1)).astype(np.int64)
    sign = np.where((x >> np.uint64(50)) & np.uint64(1), 1, -1)
    return bucket, sign


def _add(counts: np.ndarray, hashes: np.ndarray, shape: SketchShape) -> None:
    """Add hashed values to the counters."""
    values, times = np.unique(hashes, return_counts=True)
    for level, bits in enumerate(shape.bits):
        prefix = values >> np.uint64(64 - bits)
        for row in range(shape.depth):
            bucket, sign = _cell_and_sign(prefix, level, row, shape.width)
            counts[level, row] += np.bincount(bucket, weights=sign * times, minlength=shape.width).astype(np.int64)


def estimate(counts: np.ndarray, level: int, prefix: np.ndarray, shape: SketchShape) -> np.ndarray:
    """Median of the rows' signed counters, for each prefix."""
    rows = np.empty((shape.depth, len(prefix)))
    for row in range(shape.depth):
        bucket, sign = _cell_and_sign(prefix, level, row, shape.width)
        rows[row] = counts[level, row, bucket] * sign
    return np.median(rows, axis=0)


def sketch(df: DataFrame, value: str, shape: SketchShape) -> tuple[int, np.ndarray]:
    """Number of non-null values, and the summed counters.

    Each partition fills one sketch and emits its cells once; cells are added
    up by key with partial sums, so at most ``shape.cells()`` numbers reach the
    driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(shape.bits), shape.depth, shape.width), np.int64)
        total, held, waiting = 0, [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            waiting += batch.num_rows
            if waiting >= 1 << 18:
                _add(counts, np.concatenate(held), shape)
                total, held, waiting = total + waiting, [], 0
        if held:
            _add(counts, np.concatenate(held), shape)
            total += waiting
        flat = counts.reshape(-1)
        cells = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(cells, -1)), pa.array(np.append(flat[cells], total))], ["cell", "n"])

    hashed = df.where(F.col(value).isNotNull()).select(F.xxhash64(value).alias("h"))
    cells = hashed.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(shape.cells() + 1, np.int64)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return int(counts[-1]), counts[:-1].reshape(len(shape.bits), shape.depth, shape.width)


def descend(counts: np.ndarray, least: float, shape: SketchShape) -> dict[int, int]:
    """Heavy full-length prefixes and their estimated counts.

    At each level only the children of heavy prefixes are looked at.  A level's
    estimates are off by about sqrt(F2 / width), with F2 the sum of squared
    counts, so ``least`` is lowered by four times that, but at most to its
    half.  Where the half is what counts, many values are heavy, and one is
    lost if in most rows it meets another of about its size and opposite sign.
    """
    heavy = np.zeros(1, np.uint64)
    before = 0
    for level, bits in enumerate(shape.bits):
        step = bits - before
        second = float(np.median((counts[level].astype(np.float64) ** 2).sum(axis=1)))
        slack = 4 * math.sqrt(second / shape.width)
        floor = max(least - slack, least / 2, 1.0)
        found, guesses = [], []
        for at in range(0, len(heavy), 4096):  # a bounded number of children at a time
            part = heavy[at : at + 4096]
            children = ((part[:, None] << np.uint64(step)) | np.arange(1 << step, dtype=np.uint64)[None, :]).reshape(-1)
            guess = estimate(counts, level, children, shape)
            found.append(children[guess >= floor])
            guesses.append(guess[guess >= floor])
        heavy, before, kept = np.concatenate(found or [heavy]), bits, np.concatenate(guesses or [np.zeros(0)])
    return dict(zip(heavy.tolist(), kept.astype(np.int64).tolist()))


def frequent(df: DataFrame, value: str, one_in: int, least_rows: int = 1, shape: SketchShape | None = None) -> DataFrame:
    """(item, estimate, n): each value that at least one in ``one_in`` of the rows with a value hold, and at least ``least_rows``.

    First scan: a hierarchical count-sketch with signed hashes over prefixes
    of the values' 64-bit hashes.  The driver descends the heavy prefixes; no
    more than about 2 * ``one_in`` survive.  Second scan: only rows whose hash
    has a heavy prefix are counted exactly (with partial sums, so a value that
    a third of the rows hold is combined before the shuffle), which drops
    false candidates.  Beyond ``MOST_LITERALS`` prefixes are a broadcast table,
    which ``one_in`` bounds.

    Nulls do not count, neither as values nor as rows; the empty string is a
    value; values are compared exactly; ties are all kept; an empty table
    gives no row.
    """
    shape = shape or SketchShape.fit(one_in)
    total, counts = sketch(df, value, shape)
    least = max(least_rows, -(-total // one_in))
    heavy = descend(counts, float(least), shape) if total else {}
    prefix = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - shape.bits[-1])
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).alias("item"))
    count = lambda rows: rows.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= F.lit(least))
    if len(heavy) > MOST_LITERALS:
        known = F.broadcast(df.sparkSession.createDataFrame(list(heavy.items()), "_prefix bigint, estimate bigint"))
        found = count(rows.withColumn("_prefix", prefix("item")).join(known.select("_prefix"), "_prefix", "left_semi"))
        return found.withColumn("_prefix", prefix("item")).join(known, "_prefix").select("item", "estimate", "n")
    found = count(rows.where(prefix("item").isin(*heavy) if heavy else F.lit(False)))
    guesses = F.create_map(*[F.lit(x).cast("bigint") for pair in heavy.items() for x in pair]) if heavy else None
    return found.select("item", (F.try_element_at(guesses, prefix("item")) if heavy else F.lit(0).cast("bigint")).alias("estimate"), "n")
