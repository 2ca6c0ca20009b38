"""Small shared helpers for column lists and windows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

Names = str | list[str] | tuple[str, ...]

KEY = "series_id"
ORDER = "date"
VALUE = "value"

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def names(cols: Names) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def q(name: str) -> Column:
    """Column by exact name; panel names start with digits, so always quote."""
    return F.col(f"`{name}`")


def ordered(key: Names, order: Names) -> WindowSpec:
    """Window of one series in time order. Series are period-grained (one row per
    key and period), so a partition holds at most as many rows as the calendar
    has periods; for raw event rows use `operators.blocks`."""
    return Window.partitionBy(*[q(c) for c in names(key)]).orderBy(*[q(c) for c in names(order)])


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def back_from_end(key: Names, order: Names) -> WindowSpec:
    """Rows from the end of the series down to the current one. With `last(..., ignorenulls)`
    it finds the next known value in one running pass; a frame that reaches forward to the
    end would be evaluated anew for every row."""
    w = Window.partitionBy(*[q(c) for c in names(key)]).orderBy(*[q(c).desc() for c in names(order)])
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


#: Bytes of files behind one partition, about. Rows folded to panels, made long and given window columns take up to a hundred times as much while they are sorted.
TASK_BYTES = 8 << 20


def _input_bytes(df: DataFrame) -> int:
    """Size of the largest table of files that a frame reads, from the file listing; no job is run."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    tables = [leaf for leaf in (leaves.apply(i) for i in range(leaves.size())) if leaf.getClass().getSimpleName() == "LogicalRelation"]
    return max((int(t.stats().sizeInBytes()) for t in tables), default=0)


def _tasks(df: DataFrame, finer: int = 1) -> int:
    given = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    session = int(given) if given.isdigit() else df.sparkSession.sparkContext.defaultParallelism
    return max(session, -(-finer * _input_bytes(df) // TASK_BYTES))


def spread(df: DataFrame, key: Names, finer: int = 1) -> DataFrame:
    """Hash partitions by key in the session's full number, or more where the input is large, so that a
    partition does not grow with the input (`finer` times as many for work that holds more per row). Adaptive execution merges
    partitions by bytes; before Python work, which is heavy per row, that would
    leave few tasks. A count given by number is kept. Put it ahead of the windows on
    the same key: they use this shuffle and add none."""
    return df.repartition(_tasks(df, finer), *[q(c) for c in names(key)])


def spread_rows(df: DataFrame, key: Names) -> DataFrame:
    """The same for a folded table of one row per key, whose rows need no company."""
    return df.repartition(_tasks(df), F.xxhash64(*[q(c) for c in names(key)]))


def numeric_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    skipped = set(skip)
    return [n for n, t in df.dtypes if t in NUMERIC and n not in skipped]


def finite(c: Column) -> Column:
    """Null for NaN and both infinities, the value otherwise."""
    inf = F.lit(float("inf"))
    return F.when(~F.isnan(c) & (F.abs(c) != inf), c)
