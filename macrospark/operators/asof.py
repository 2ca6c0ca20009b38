"""Point-in-time values (SRC6): what was known of a series at a given time.

Versions and questions are put into one table, in time order, and each question takes the last version before it. Validity intervals are never
spelled out day by day, and no series has to fit into one task: the table is cut into ranges of time with about equally many rows, and one small row
per series and range carries its last version on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from macrospark.columns import KEY, VALUE, Names, names, q
from macrospark.operators import blocks as B


def as_of(
    versions: DataFrame, asks: DataFrame, key: Names = KEY, start: str = "realtime_start", at: str = "as_of",
    values: Sequence[str] = (VALUE,), end: str | None = None, ties: Sequence[str] = (), ranges: int | None = None,
) -> DataFrame:
    """SRC6: every row of `asks` (key, at, any other columns) with `start` and `values` of the version of its key with the greatest `start` up to `at`; nulls if there
    is none. With `end` (the last day a version holds; null: open) a version that has ended by then counts as none, and an earlier one does not come back.

    Of versions of one key and `start` the one that is last by `ties` counts (without `ties` they must not differ). Rows of `asks` with a null key or time have no
    version; versions with one are no version. Repeated rows of `asks` are rows of their own."""
    keys = names(key)
    by = [q(c) for c in keys]
    shown = [*values, *([end] if end else [])]
    state = F.struct(q(start).alias("_start"), *[q(c).alias(f"_{i}") for i, c in enumerate(shown)])
    known = versions.na.drop(subset=[*keys, start])
    order = F.struct(*[q(c) for c in ties]) if ties else F.struct(state)
    known = known.groupBy(*by, q(start).alias("_time")).agg(F.max_by(state, order).alias("_state"))
    asked = asks.select(*by, q(at).alias("_time"), F.struct(*[q(c) for c in asks.columns]).alias("_row"))
    full = asked.na.drop(subset=[*keys, "_time"])
    both = known.select(*by, "_time", F.lit(0).alias("_ask"), "_state").unionByName(
        full.select(*by, "_time", F.lit(1).alias("_ask"), "_row"), allowMissingColumns=True)
    cut = B.add_range_block(both, "_time", ranges)
    found = B.forward_fill(cut, ["_time", "_ask"], keys, value="_state").where("_ask = 1")
    unknown = asked.where(" OR ".join(f"`{c}` IS NULL" for c in [*keys, "_time"]))
    out = found.select("_row", "_time", "_state").unionByName(unknown.select("_row", "_time"), allowMissingColumns=True)
    if end:
        out = out.withColumn("_state", F.when(F.coalesce(F.col("_time") <= F.col(f"_state._{len(values)}"), F.lit(True)), F.col("_state")))
    return out.select("_row.*", F.col("_state._start").alias(start), *[F.col(f"_state._{i}").alias(c) for i, c in enumerate(values)])
