"""Joins and set operations (JON1-JON8, SET1-SET5)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from macrospark.columns import KEY, ORDER, VALUE, Names, names, ordered, q

def join_on_spine(spine: DataFrame, frames: Iterable[DataFrame], on: Names = ORDER) -> DataFrame:
    """JON1: left joins of one-column frames onto a spine. For many series prefer
    `widen`, which needs one shuffle."""
    for frame in frames:
        spine = spine.join(frame, names(on), "left")
    return spine


def widen(
    df: DataFrame, members: Mapping[str, str], index: Names = ORDER, key: str = KEY, value: str = VALUE
) -> DataFrame:
    """JON1 / SET4: long to wide in one aggregation. `members` maps each series to
    its column; the list is explicit, so no pass looks for it."""
    return df.groupBy(*[q(c) for c in names(index)]).agg(*[
        F.max(F.when(q(key) == s, q(value))).alias(c) for s, c in members.items()])


def lengthen(
    df: DataFrame, columns: Sequence[str], index: Names = ORDER, key: str = KEY, value: str = VALUE
) -> DataFrame:
    """SET4: wide to long."""
    return df.unpivot([q(c) for c in names(index)], [q(c) for c in columns], key, value)


def inner_on_date(left: DataFrame, right: DataFrame, on: Names = ORDER) -> DataFrame:
    """JON2."""
    return left.join(right, names(on), "inner")


def join_suffixed(
    left: DataFrame, right: DataFrame, on: Names, suffixes: tuple[str, str] = ("_x", "_y"), how: str = "inner"
) -> DataFrame:
    """JON3: columns on both sides get a suffix, before the join."""
    keys = names(on)
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in shared}) if suffixes[0] else left
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return a.join(b, keys, how)


def align_forecast(
    actual: DataFrame, forecast: DataFrame, key: Names = KEY, order: str = ORDER, value: str = VALUE
) -> DataFrame:
    """JON4: rows that both sides have, as actual and forecast."""
    on = [*names(key), order]
    return (actual.select(*[q(c) for c in on], q(value).alias("actual"))
            .join(forecast.select(*[q(c) for c in on], q(value).alias("forecast")), on, "inner"))


def concat_columns(
    left: DataFrame, right: DataFrame, key: Names = KEY, order: str = ORDER
) -> DataFrame:
    """JON5: put two frames side by side by position inside each key."""
    def numbered(df: DataFrame) -> DataFrame:
        return df.withColumn("_pos", F.row_number().over(ordered(key, order)))

    extra = numbered(right).drop(*([order] if order in left.columns else []))
    return numbered(left).join(extra, [*names(key), "_pos"], "left").drop("_pos")


def with_params(df: DataFrame, params: DataFrame, key: Names = KEY) -> DataFrame:
    """JON6: train-time parameters onto rows. One parameter row per series: broadcast
    by Spark's own size check, or co-partitioned with the windows on the key."""
    return df.join(params, names(key), "left")


def with_grid(df: DataFrame, grid: Iterable[Mapping[str, float]]) -> DataFrame:
    """JON7: every row with every configuration. The grid is a literal array in the
    plan, so this is an explode and not a product of two tables."""
    configs = [F.struct(*[F.lit(v).alias(k) for k, v in g.items()]) for g in grid]
    return df.select("*", F.inline(F.array(*configs)))


def route_models(
    base: DataFrame, other: DataFrame, routing: Mapping[str, str], key: str = KEY, order: str = ORDER,
    preferred: str = "prophet",
) -> DataFrame:
    """JON8: pick the shown forecast. `base` holds actual, hybrid, arima; `other`
    holds hybrid and prophet of the second family. A series routed to the second
    family takes its hybrid, else its plain forecast; then base hybrid, base plain
    and the other plain forecast follow."""
    on = [key, order]
    b = base.select(*on, "actual", F.col("hybrid").alias("_hybrid"), F.col("arima").alias("_arima"))
    o = other.select(*on, F.col("hybrid").alias("_hybrid2"), F.col("prophet").alias("_prophet"))
    first = [k for k, v in routing.items() if v == preferred]
    routed = F.when(q(key).isin(first), F.coalesce("_hybrid2", "_prophet"))
    return (b.join(o, on, "left")
            .select(*on, "actual",
                    F.coalesce(routed, F.col("_hybrid"), F.col("_arima"), F.col("_prophet")).alias("forecast")))


# --- sets ---------------------------------------------------------------------

def stack(parts: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """SET1: union by name; columns a part lacks are null; the part is named in `tag`."""
    out = None
    for label, part in parts.items():
        tagged = part.withColumn(tag, F.lit(label))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def append_rows(df: DataFrame, extra: DataFrame) -> DataFrame:
    """SET2: hypothetical rows after the history; columns they lack are null."""
    return df.unionByName(extra, allowMissingColumns=True)


def last_row(df: DataFrame, key: Names = KEY, order: str = ORDER) -> DataFrame:
    """TOP2: last row of every series, combined map-side (no sort)."""
    rest = [c for c in df.columns if c not in names(key)]
    picked = df.groupBy(*[q(c) for c in names(key)]).agg(
        F.max_by(F.struct(*[q(c) for c in rest]), q(order)).alias("_row"))
    return picked.select(*[q(c) for c in names(key)], *[F.col("_row")[c].alias(c) for c in rest])


def repeat_last(df: DataFrame, steps: int, key: Names = KEY, order: str = ORDER) -> DataFrame:
    """SET3: the last row of every series once per future step."""
    return (last_row(df, key, order)
            .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
            .withColumn(order, F.add_months(q(order), F.col("step"))))


def column_sets(frames: Mapping[str, Iterable[str]]) -> tuple[list[str], list[str]]:
    """SET5 on schemas: union and intersection of column lists, in first-seen order."""
    lists = [list(v) for v in frames.values()]
    union = list(dict.fromkeys(c for columns in lists for c in columns))
    return union, [c for c in union if all(c in columns for columns in lists)]


def feature_union(df: DataFrame, feature: str = "feature", target: str = "target") -> DataFrame:
    """SET5 on rows: each feature once, with its number of targets and whether all
    targets have it."""
    total = df.select(F.count_distinct(q(target))).first()[0]
    return (df.groupBy(q(feature)).agg(F.count_distinct(q(target)).alias("n_targets"))
            .withColumn("in_all", F.col("n_targets") == F.lit(total)))


