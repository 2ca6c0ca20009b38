"""Correlations of panels with thousands of columns (AGG7)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from macrospark.columns import q

#: Columns of a tile, and bytes of sums that a task keeps at a time.
TILE, BUDGET = 256, 1 << 28
SUMS = ["n", "sx", "sy", "xx", "yy", "xy"]
Tiles = list[tuple[range, range]]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Values of a batch, NaN for nulls and whatever is not finite."""
    x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
    x[~np.isfinite(x)] = np.nan
    return x


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = count = None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch)
            known = ~np.isnan(x)
            total = (0 if total is None else total) + np.where(known, x, 0.0).sum(axis=0)
            count = (0 if count is None else count) + known.sum(axis=0)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(count)], ["column", "total", "n"])


def centres(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Means of the columns, 0 for one without values. One number per column reaches the driver."""
    rows = df.select(*[q(c).cast("double") for c in columns]).mapInArrow(_totals, "column int, total double, n bigint")
    out = np.zeros(len(columns))
    for r in rows.groupBy("column").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("mean")).collect():
        out[r["column"]] = r["mean"] or 0.0
    return out


def strips(width: int, tile: int = TILE, budget: int = BUDGET) -> list[Tiles]:
    """Pairs of column tiles of the upper triangle, in groups whose sums fit into the budget."""
    cuts = [range(a, min(a + tile, width)) for a in range(0, width, tile)]
    pairs = [(a, b) for i, a in enumerate(cuts) for b in cuts[i:]]
    most = max(1, budget // (8 * len(SUMS) * tile * tile))
    return [pairs[i:i + most] for i in range(0, len(pairs), most)]


def _gram(used: list[int], tiles: Tiles, centre: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    place = {c: i for i, c in enumerate(used)}
    spots = [(slice(place[a[0]], place[a[-1]] + 1), slice(place[b[0]], place[b[-1]] + 1)) for a, b in tiles]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(SUMS), len(a), len(b))) for a, b in tiles]
        for batch in batches:
            x = _matrix(batch)
            known = (~np.isnan(x)).astype(float)
            x = np.where(known > 0, x - centre, 0.0)
            x[np.abs(x) <= 4e-15 * np.abs(centre)] = 0.0  # a constant column is exactly constant
            squares = x * x
            for held, (a, b) in zip(sums, spots):
                held += [known[:, a].T @ known[:, b], x[:, a].T @ known[:, b], known[:, a].T @ x[:, b],
                         squares[:, a].T @ known[:, b], known[:, a].T @ squares[:, b], x[:, a].T @ x[:, b]]
        for held, (a, b) in zip(sums, tiles):
            left, right = np.meshgrid(np.array(a, np.int32), np.array(b, np.int32), indexing="ij")
            some = (left < right) & (held[0] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(left[some]), pa.array(right[some]), *[pa.array(h[some]) for h in held]], ["left", "right", *SUMS])

    return fold


def wide_correlations(df: DataFrame, columns: Sequence[str], tile: int = TILE, budget: int = BUDGET) -> DataFrame:
    """AGG7 for thousands of columns: left, right (in the order of `columns`), n (rows that have both) and the absolute Pearson correlation.

    Per task the products of column tiles are summed over all its rows: of the values, of their squares, and of both with the pattern of
    what is known, so that every pair counts exactly its common rows. Tiles are taken in strips whose sums fit into `budget` bytes; each strip
    is one scan of the columns it needs (one strip up to some 3,000 columns). Each task hands on one row per pair, folded again before the shuffle. No rows are
    joined and no pair is an expression of its own.

    Values are centred at the columns' means first. Nulls, not a number and infinities are holes. A pair without common rows is left out;
    a pair of one row, or with a side that is constant over the common rows, has no correlation (null)."""
    columns = list(columns)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "left string, right string, n bigint, correlation double")
    middle = centres(df, columns)
    parts = []
    for tiles in strips(len(columns), tile, budget):
        used = sorted({c for pair in tiles for side in pair for c in side})
        rows = df.select(*[q(columns[c]).cast("double") for c in used])
        parts.append(rows.mapInArrow(_gram(used, tiles, middle[used]), "left int, right int, " + ", ".join(f"{s} double" for s in SUMS)))
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    total = joined.groupBy("left", "right").agg(*[F.sum(s).alias(s) for s in SUMS])
    n, sx, sy, xx, yy, xy = [F.col(s) for s in SUMS]
    vx, vy = xx - sx * sx / n, yy - sy * sy / n
    varied = (n > 1) & (vx > 1e-12 * xx) & (vy > 1e-12 * yy)
    value = F.when(varied, F.least(F.abs(xy - sx * sy / n) / F.sqrt(vx * vy), F.lit(1.0)))
    named = F.lit(columns)
    return total.select(F.get(named, F.col("left")).alias("left"), F.get(named, F.col("right")).alias("right"),
                        n.cast("bigint").alias("n"), value.alias("correlation"))
