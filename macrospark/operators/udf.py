"""User functions over whole series (UDF1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from macrospark.columns import Names, names, q, spread

#: Rows that go back to Spark together, about.
TOGETHER = 10_000


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Neighbours of one layout end to end, so that few large frames are sent instead of one for each series."""
    held, rows, layout = [], 0, None
    for frame in frames:
        own = [*frame.columns], [*frame.dtypes]
        if held and (own != layout or rows >= TOGETHER):
            yield pd.concat(held, ignore_index=True)
            held, rows = [], 0
        held.append(frame)
        rows, layout = rows + len(frame), own
    if held:
        yield pd.concat(held, ignore_index=True)


def apply_per_series(
    df: DataFrame, key: Names, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str | None = None
) -> DataFrame:
    """UDF1: `fn` on each series as a pandas frame, moved by Arrow. Meant for period-grained
    series, which the calendar bounds; fold raw readings to periods first, or use
    `operators.blocks`. Prefer window expressions where they can say the same. The schema
    is the input's unless given.

    Many series travel in one Arrow batch and are cut apart behind it, as each series of its own would cost far more than
    its rows. Whole numbers and booleans with nulls become floats and objects in those series alone that hold a null."""
    by = [q(c) for c in names(key)]
    columns = df.columns
    loose = [f.name for f in df.schema if f.nullable and isinstance(f.dataType, (T.IntegralType, T.BooleanType))]
    whole = {f.name: F.coalesce(q(f.name), F.lit(False if isinstance(f.dataType, T.BooleanType) else 0).cast(f.dataType)) for f in df.schema if f.name in loose}
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*by)) == 1
    flat = spread(df, key).select(*[q(c) for c in columns], first.alias("__first")).select(
        *[whole.get(c, q(c)).alias(c) for c in columns], "__first", *[q(c).isNull().alias(f"__null_{i}") for i, c in enumerate(loose)])

    def alone(rows: pd.DataFrame, nulls: np.ndarray) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        for i in np.flatnonzero(nulls.any(axis=0)):
            c, none = loose[i], rows[loose[i]].dtype == bool
            rows[c] = rows[c].astype(object if none else float).mask(nulls[:, i], None if none else np.nan)
        return fn(rows)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[pd.DataFrame, np.ndarray]] = []  # pieces of a series that may go on in the next batch

        def done() -> pd.DataFrame:
            return alone(held[0][0] if len(held) == 1 else pd.concat([rows for rows, _ in held]), np.concatenate([nulls for _, nulls in held]))

        for batch in batches:
            rows, nulls = batch[columns], batch.iloc[:, len(columns) + 1:].to_numpy(dtype=bool)
            starts = np.flatnonzero(batch["__first"].to_numpy(dtype=bool)).tolist()
            edges = [0, *starts, len(batch)]
            for turn, (a, b) in enumerate(zip(edges, edges[1:])):
                if turn and held:
                    yield done()
                    held = []
                if b > a:
                    held.append((rows.iloc[a:b], nulls[a:b]))
        if held:
            yield done()

    return flat.mapInPandas(lambda batches: _joined(each(batches)), schema if schema is not None else df.schema)
