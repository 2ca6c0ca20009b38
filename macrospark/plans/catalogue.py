"""Registry of named queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from macrospark.columns import q

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def nudge(digits: int) -> float:
    """Added before rounding. Means of decimal values often lie exactly half way
    between two roundings, where the last bit of a sum would decide."""
    return 0.0037 * 10.0 ** -digits


def presentable(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded, dates as text, integers as bigint: what both engines print alike."""
    out = []
    for name, kind in df.dtypes:
        c = q(name)
        if kind in ("double", "float"):
            c = F.round(c.cast("double") + F.lit(nudge(digits)), digits)
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


def query(name: str, sql: str | None = None, digits: int = 4) -> Callable[[Run], Run]:
    """Register a query; `sql` gives the same rows in DuckDB, or None."""
    def add(run: Run) -> Run:
        if name in CATALOGUE:
            raise ValueError(f"query {name!r} is registered twice")
        CATALOGUE[name] = Query(lambda spark, sf: presentable(run(spark, sf), digits), sql)
        return run

    return add


def significant(name: str) -> list[Column]:
    """A double as mantissa (1 to 10; `presentable` rounds it) and decimal exponent: values of any size print alike."""
    e = F.floor(F.log10(F.abs(q(name))))
    return [(q(name) / F.pow(F.lit(10.0), e.cast("double"))).alias(f"{name}_mantissa"), e.alias(f"{name}_exponent")]


def significant_sql(expr: str, name: str, digits: int = 6) -> str:
    """`significant` in SQL."""
    e = f"floor(log10(abs(nullif({expr}, 0))))"
    return f"{r(f'({expr}) / pow(10.0::DOUBLE, {e})', f'{name}_mantissa', digits)}, CAST({e} AS BIGINT) AS {name}_exponent"


def r(expr: str, name: str | None = None, digits: int = 4) -> str:
    """SQL: rounded double; the + 0 turns -0.0 into 0.0."""
    return f"round(CAST({expr} AS DOUBLE) + {nudge(digits):e}::DOUBLE, {digits}) + 0 AS {name or expr}"


def d(expr: str = "date", name: str = "date") -> str:
    """SQL: date as text."""
    return f"strftime({expr}, '%Y-%m-%d') AS {name}"
