"""Scalar functions as Column expressions (FUN1-FUN15, UDF2). All stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from macrospark.columns import KEY, ORDER, Names, finite, names, q
from macrospark.constants import FOURIER_GROUPS, LABEL_CANDIDATES, LONG_TENORS, SHORT_TENORS
from macrospark.operators.blocks import number_in_order


def calendar_fields(df: DataFrame, order: str = ORDER) -> DataFrame:
    """FUN1: month, quarter, year and day of year."""
    d = q(order).cast("date")
    return df.withColumns({"month": F.month(d), "quarter": F.quarter(d),
                           "year": F.year(d), "day_of_year": F.dayofyear(d)})


def parse_date(c: Column) -> Column:
    """FUN1: text to date, null when it is not one."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")


def month_floor(c: Column) -> Column:
    """FUN2."""
    return F.trunc(c, "month")


def quarter_label(c: Column) -> Column:
    """FUN3: Q1..Q4."""
    return F.concat(F.lit("Q"), F.quarter(c).cast("string"))


def month_name(c: Column) -> Column:
    """FUN3: January..December."""
    return F.date_format(c, "MMMM")


def months_ahead(last: Column, now: Column) -> Column:
    """FUN4: calendar months from one date to the other, days ignored."""
    return (F.year(now) - F.year(last)) * 12 + F.month(now) - F.month(last)


def future_dates(last: DataFrame, steps: int, order: str = ORDER, anchor: str = "end") -> DataFrame:
    """FUN4: `steps` monthly dates after each row's date, as month ends or starts."""
    def place(k: Column) -> Column:
        moved = F.add_months(q(order), k)
        return F.last_day(moved) if anchor == "end" else F.trunc(moved, "month")

    rest = [q(c) for c in last.columns if c != order]
    grid = F.transform(F.sequence(F.lit(1), F.lit(steps)),
                       lambda k: F.struct(k.alias("step"), place(k).alias(order)))
    return last.select(*rest, F.inline(grid))


def fourier_terms(date: Column, start: Column, group: str) -> dict[str, Column]:
    """FUN5: sin/cos pairs of one group; time is in the group's own unit."""
    pairs, period = FOURIER_GROUPS[group]
    t = F.datediff(date, start) / F.lit(365.25 / period)
    terms = {}
    for k in range(1, pairs + 1):
        angle = F.lit(2 * math.pi * k / period) * t
        terms[f"fourier_{group}_sin_{k}"] = F.sin(angle)
        terms[f"fourier_{group}_cos_{k}"] = F.cos(angle)
    return terms


def logit(c: Column, epsilon: float = 1e-6) -> Column:
    """FUN6: percent to log-odds, shares clipped to [epsilon, 1 - epsilon]."""
    p = F.greatest(F.least(c / 100.0, F.lit(1.0 - epsilon)), F.lit(epsilon))
    p = F.when(c.isNotNull(), p)
    return F.ln(p / (1.0 - p))


def inverse_logit(c: Column) -> Column:
    """FUN6: log-odds to percent."""
    return F.lit(100.0) / (1.0 + F.exp(-c))


def safe_logit(c: Column) -> Column:
    """FUN6, tight variant: clip to [0, 100] first, then 1e-8."""
    return logit(clip(c, 0.0, 100.0), 1e-8)


def safe_inverse_logit(c: Column) -> Column:
    """FUN6, tight variant: clamp to +-50, clip to [0, 100]."""
    return clip(inverse_logit(clip(c, -50.0, 50.0)), 0.0, 100.0)


def box_cox(c: Column, lam: Column | float, shift: Column | float = 0.0) -> Column:
    """FUN7."""
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    x = c + shift
    return F.when(x > 0, F.when(lam == 0, F.ln(x)).otherwise(F.try_divide(F.pow(x, lam) - 1.0, lam)))


def inverse_box_cox(c: Column, lam: Column | float, shift: Column | float = 0.0) -> Column:
    """FUN7."""
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    return F.when(lam == 0, F.exp(c)).otherwise(F.pow(c * lam + 1.0, F.try_divide(F.lit(1.0), lam))) - shift


def positive_shift(lowest: Column) -> Column:
    """FUN7: what to add so that every value is positive."""
    return F.when(lowest <= 0, F.abs(lowest) + 1.0).otherwise(0.0)


def product(a: Column, b: Column) -> Column:
    """FUN8."""
    return a * b


def safe_ratio(a: Column, b: Column, guard: float = 1e-6) -> Column:
    """FUN8: a / (b + guard); null where that is 0."""
    return F.try_divide(a, b + guard)


def interactions(df: DataFrame) -> DataFrame:
    """FUN8: the five panel interactions."""
    return df.withColumns({
        "CPI_unemployment_interaction": product(q("CPI"), q("unemployment_rate")),
        "INDPRO_CPI_ratio": safe_ratio(q("INDPRO"), q("CPI")),
        "share_gdp_ratio": safe_ratio(q("share_price"), q("gdp_per_capita")),
        "PPI_CPI_diff": q("PPI") - q("CPI"),
        "interest_spread": q("10_year_rate") - q("3_months_rate"),
    })


def clip(c: Column, lower: float, upper: float) -> Column:
    """FUN9; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lower)), F.lit(upper)))


def percent_to_share(c: Column) -> Column:
    """FUN9."""
    return clip(c / 100.0, 0.0, 1.0)


def banded(c: Column, edges: Sequence[tuple[float, str]], rest: str, rising: bool) -> Column:
    """FUN10: first band whose edge is met: c >= edge when rising, c < edge otherwise."""
    out = None
    for edge, label in edges:
        test = c >= edge if rising else c < edge
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(rest)


def risk_level(percent: Column) -> Column:
    """FUN10; the percentage is rounded to one decimal before the comparison."""
    return banded(F.round(percent, 1), [(70, "High Risk"), (50, "Moderate Risk"), (30, "Elevated Risk")],
                  "Low Risk", True)


def card_level(share: Column) -> Column:
    """FUN10."""
    return banded(share, [(0.3, "low"), (0.6, "medium")], "high", False)


def forecast_grade(difference: Column) -> Column:
    """FUN10."""
    return banded(difference, [(5, "Good"), (15, "Fair")], "Poor", False)


def steepness(tenors: Sequence[Column]) -> Column:
    """FUN11: longest minus shortest available tenor; null with fewer than two."""
    known = F.filter(F.array(*tenors), lambda x: x.isNotNull())
    return F.when(F.size(known) >= 2, F.element_at(known, -1) - F.element_at(known, 1))


def steepness_class(c: Column) -> Column:
    """FUN11."""
    return (F.when(c > 1.5, "steep").when(c < -0.5, "deeply inverted")
            .when(c > 0, "normal").when(c.isNotNull(), "flat"))


def first_inversion(shorts: Mapping[str, Column], longs: Mapping[str, Column]) -> Column:
    """JON9: the first (short, long) pair, in order, with short > long; a missing or
    zero yield is no evidence. Null when the curve is not inverted."""
    tests = [F.when((s != 0) & (l != 0) & (s > l), F.lit(f"{sn} > {ln}"))
             for sn, s in shorts.items() for ln, l in longs.items()]
    return F.coalesce(*tests)


def curve_inversion() -> Column:
    """JON9 on columns named by tenor."""
    short = {t.replace(" Rate", ""): q(t) for t in SHORT_TENORS}
    long = {t.replace(" Rate", ""): q(t) for t in LONG_TENORS}
    return first_inversion(short, long)


def spread(short: Column, long: Column) -> Column:
    """FUN12: named spread with two decimals."""
    return F.round(long - short, 2)


def log_positive(c: Column) -> Column:
    """FUN13: natural log, zeros to null."""
    return F.ln(F.nullif(c, F.lit(0.0)))


def label_codes(train: DataFrame, column: str) -> DataFrame:
    """FUN14: alphabetical codes (from 0) of the train labels, null as `Unknown`.
    Distinct labels are numbered in ranges of about equally many, so even a very
    large label set, or one with a common beginning, is not ranked in one task."""
    labels = train.select(F.coalesce(q(column), F.lit("Unknown")).alias(column)).distinct()
    return number_in_order(labels, column, "code").select(q(column), "code")


def encode_labels(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """FUN14: code of each row's label, 0 for a label unseen in training."""
    filled = df.withColumn(column, F.coalesce(q(column), F.lit("Unknown")))
    return (filled.join(codes, column, "left")
            .withColumn(f"{column}_code", F.coalesce("code", F.lit(0))).drop("code"))


def from_labels(df: DataFrame, aliases: Mapping[str, str], keep: Names = ()) -> DataFrame:
    """FUN15: select display labels under their panel names."""
    return df.select(*[q(c) for c in names(keep)], *[q(a).alias(b) for a, b in aliases.items()])


def first_known(columns: Sequence[str], available: Sequence[str]) -> Column:
    """JON10: first finite value among the candidate columns that exist."""
    there = [finite(q(c).cast("double")) for c in columns if c in set(available)]
    return F.coalesce(*there) if there else F.lit(None).cast("double")


def label_values(df: DataFrame, keep: Names = (KEY, ORDER)) -> DataFrame:
    """JON10 for every display label."""
    return df.select(*[q(c) for c in names(keep)], *[
        first_known(cands, df.columns).alias(label) for label, cands in LABEL_CANDIDATES.items()])


def flag(df: DataFrame, column: str, test: Callable[[Column], Column], output: str) -> DataFrame:
    """UDF2: user predicate over a column as a 0/1 column. The predicate builds a
    Column, so no Python worker runs."""
    return df.withColumn(output, F.coalesce(test(q(column)), F.lit(False)).cast("int"))
