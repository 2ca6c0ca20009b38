"""Exact quantiles (AGG5, AGG10, MLO1).

`series_medians` is for period-grained series, whose groups are bounded by the
calendar. `exact_quantiles` is for groups of any size: the built-in exact percentile
would keep every distinct value of a group in one task, so here a sketch of bounded
size brackets each wanted rank first, and only values inside a bracket are ranked."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from macrospark.columns import KEY, Names, finite, names, q
from macrospark.session import cut_lineage

#: Sketches (some hundred bytes each) of up to so many keys are broadcast.
BROADCAST_KEYS = 10_000


def exact_quantiles(
    df: DataFrame, value: str, probs: Iterable[float], key: Names = (), accuracy: int = 20_000
) -> DataFrame:
    """Interpolated quantiles (pandas `linear`) as columns q0, q1, ... per key; one
    row in all when no key is given.

    The sketch misses a rank by at most n / accuracy, so the value of rank r lies
    between the sketch's values at r -+ 3 n / accuracy. Values below a bracket fold
    into one count, map-side; those inside are counted per distinct value. A group of
    up to `accuracy` rows, where that margin is under three ranks, is ranked whole."""
    keys, probs = names(key), list(probs)
    rows = df.select(*[q(c) for c in keys], finite(q(value).cast("double")).alias("_v"), F.lit(0).alias("_all"))
    rows = rows.filter(F.col("_v").isNotNull())
    by = [*keys, "_all"]
    slack = 3.0 / accuracy
    edges = [e for p in probs for e in (max(p - slack, 0.0), min(p + slack, 1.0))]
    sketch = rows.groupBy(*[q(c) for c in by]).agg(
        F.percentile_approx("_v", edges, accuracy).alias("_edges"), F.count(F.lit(1)).alias("_total"))
    if not keys:  # one row of known size
        marked = rows.join(F.broadcast(sketch), by)
    else:  # one row per key: sent to the rows where they are few, else Spark deals both sides and splits hot keys
        sketch = cut_lineage(sketch)
        few = sketch.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        marked = rows.join(F.broadcast(sketch), by) if few else rows.join(sketch.hint("merge"), by)

    def bucket(i: int) -> Column:
        lo, hi = F.col("_edges")[2 * i], F.col("_edges")[2 * i + 1]
        return (F.when(F.col("_total") <= accuracy, F.col("_v"))
                .when(F.col("_v") < lo, F.lit(float("-inf"))).when(F.col("_v") <= hi, F.col("_v")))

    marks = F.array(*[F.struct(F.lit(i).alias("_p"), bucket(i).alias("_b")) for i in range(len(probs))])
    counted = (marked.select(*[q(c) for c in by], "_total", F.inline(marks)).filter(F.col("_b").isNotNull())
               .groupBy(*[q(c) for c in by], "_total", "_p", "_b").agg(F.count(F.lit(1)).alias("_n")))
    w = Window.partitionBy(*[q(c) for c in by], F.col("_p")).orderBy("_b")
    ranked = counted.withColumn("_end", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # 0-based ranks around prob * (n - 1).
    at = F.get(F.array(*[F.lit(float(p)) for p in probs]), F.col("_p")) * (F.col("_total") - 1)
    start = F.col("_end") - F.col("_n")

    def holds(rank: Column) -> Column:
        return F.max(F.when((start <= rank) & (rank < F.col("_end")), F.col("_b")))

    ends = ranked.withColumn("_at", at).groupBy(*[q(c) for c in by], "_p").agg(
        holds(F.floor("_at")).alias("_low"), holds(F.ceil("_at")).alias("_high"), F.max("_at").alias("_at"))
    missed = F.raise_error(F.lit("a rank fell outside its bracket"))
    ends = ends.withColumn("_low", F.coalesce("_low", missed)).withColumn("_high", F.coalesce("_high", missed))
    blend = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))
    return (ends.withColumn("_q", blend).groupBy(*[q(c) for c in by])
            .agg(*[F.max(F.when(F.col("_p") == i, F.col("_q"))).alias(f"q{i}") for i in range(len(probs))])
            .drop("_all"))


def medians(df: DataFrame, value: str, key: Names = ()) -> DataFrame:
    """AGG5: exact median per key, for groups of any size."""
    return exact_quantiles(df, value, [0.5], key).withColumnRenamed("q0", "median")


def series_medians(df: DataFrame, value: str, key: Names = KEY) -> DataFrame:
    """AGG5: exact median of each period-grained series, in one aggregation."""
    return df.groupBy(*[q(c) for c in names(key)]).agg(F.percentile(q(value), 0.5).alias("median"))
