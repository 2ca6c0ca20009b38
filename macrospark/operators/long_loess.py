"""LOESS decomposition of series of any length (TSO2), in overlapping blocks of time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from macrospark.columns import KEY, ORDER, VALUE, Names, names, q
from macrospark.constants import SEASON
from macrospark.operators.blocks import add_range_block, backward_fill, forward_fill, row_index
from macrospark.operators.decompose import INNER, INNER_ROBUST, OUTER, bisquare, stl_rounds, stl_spans
from macrospark.operators.quantiles import BROADCAST_KEYS, medians
from macrospark.session import cut_lineage

#: Rows of a block, without its halo.
SIZE = 4096
#: Windows with a smaller weighted spread are fitted by their mean. The published bound, a thousandth of the series' length, would
#: turn all fits of a long series into means.
FLAT = 0.1


def halo_rows(rounds: int, period: int, seasonal: int) -> int:
    """Rows on either side of a block on which its own results can depend: the reach of one inner round, times the rounds, and
    two more for the windows at the series' ends, which look twice as far to one side."""
    trend_span, low_span = stl_spans(period, seasonal)
    reach = (seasonal // 2) * period + period + low_span // 2 + 1 + trend_span // 2
    return (rounds + 2) * reach


def _block(size: int, rounds: int, period: int, seasonal: int) -> Callable[[pa.Table], pa.Table]:
    cache: dict = {}

    def step(table: pa.Table) -> pa.Table:
        table = table.sort_by("_t")
        y, t = table["_y"].to_numpy(), table["_t"].to_numpy()
        core = t // size == table["_block"][0].as_py()
        if not core.any():
            return table.slice(0, 0).drop_columns(["_block", "_middle"])
        season = trend = miss = np.full(len(y), np.nan)
        if len(y) >= 2 * period and not np.isnan(y.astype(float)).any():
            middle = table["_middle"][0].as_py()
            care = None if middle is None else bisquare(table["_miss"].to_numpy(), middle)
            if len(cache) > 64:  # block lengths repeat, those of short series need not
                cache.clear()
            season, trend = stl_rounds(y, table["_trend"].to_numpy(), care, rounds, period, seasonal, cache, FLAT)
            miss = np.abs(y - season - trend)
        for name, values in (("_season", season), ("_trend", trend), ("_miss", miss)):
            at = table.column_names.index(name)
            table = table.set_column(at, name, pa.array(values, pa.float64(), from_pandas=True))
        return table.filter(pa.array(core)).drop_columns(["_block", "_middle"])

    return step


def decompose_loess_long(
    df: DataFrame, period: int = SEASON, seasonal: int = 13, robust: bool = False, key: Names = KEY,
    order: Names = ORDER, value: str = VALUE, size: int = SIZE, outer: int = OUTER,
) -> DataFrame:
    """TSO2 for series of any length: key, order, value (holes filled forward, then backward), trend, seasonal, residual.

    Rows are numbered in ranges of time. A block is `size` rows and copies of the rows on either side that its results can
    depend on, so the result is that of the whole series, and no task holds more than one block at a time. Robust: after each pass the exact
    median of a series' absolute residuals, found without collecting them, gives the weights of the next one, which starts from
    the trend of the last; each pass is checkpointed.

    `order` must tell the rows of a series apart and its first column must be a time or a number; keys must not be null. Series
    under two periods, and those without any value, have no parts. Not a number and infinities are taken for holes."""
    keys, at = names(key), names(order)
    by = [q(c) for c in keys]
    number = q(value).cast("double")
    clean = df.select(*by, *[q(c) for c in at], F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number).alias("_y"))
    cut = cut_lineage(add_range_block(clean, at[0]))
    placed = row_index(backward_fill(forward_fill(cut, at, key, value="_y"), at, key, value="_y"), at, key, output="_t")
    empty = F.lit(None).cast("double")
    state = cut_lineage(placed.select(*by, *[q(c) for c in at], "_t", "_y", F.lit(0.0).alias("_trend"), empty.alias("_season"), empty.alias("_miss")))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in state.schema])
    rounds = INNER_ROBUST if robust else INNER
    halo = halo_rows(rounds, period, seasonal)
    # Blocks past a series' end have only halo rows and give nothing.
    first, last = F.floor((F.col("_t") - halo) / size), F.floor((F.col("_t") + halo) / size)
    for turn in range(outer + 1 if robust else 1):
        spread = state.withColumn("_block", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("bigint")), last)))
        if turn:
            middles = cut_lineage(medians(state, "_miss", key).withColumnRenamed("median", "_middle"))
            few = middles.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
            spread = spread.join(F.broadcast(middles) if few else middles.hint("merge"), keys, "left")
        else:
            spread = spread.withColumn("_middle", empty)
        done = spread.groupBy(*by, "_block").applyInArrow(_block(size, rounds, period, seasonal), schema)
        state = cut_lineage(done) if robust else done
    return state.select(*by, *[q(c) for c in at], F.col("_y").alias(value), F.when(F.col("_miss").isNotNull(), F.col("_trend")).alias("trend"),
                        F.col("_season").alias("seasonal"), (F.col("_y") - F.col("_trend") - F.col("_season")).alias("residual"))
