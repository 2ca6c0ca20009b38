"""Window work on long series, in blocks.

A plain window puts a whole series into one task. That is right for monthly
series and wrong for raw events, where one series may hold a third of all rows.
Here a series is cut into blocks by a column that grows with time: a calendar unit,
or ranges of equal row counts, whose number follows the session's tasks. The heavy
work is partitioned by (key, block); what crosses a block border is carried by one
small row per block, or by copies of the few border rows.

Keys and blocks must not be null."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from macrospark.columns import KEY, VALUE, Names, back_from_end, before, names, ordered, q, upto
from macrospark.session import cut_lineage

BLOCK = "block"
#: Chunks whose means are carried on together.
GROUP = 1024


def add_block(df: DataFrame, order: str, unit: str) -> DataFrame:
    """Block column: the timestamp cut to a calendar unit."""
    return df.withColumn(BLOCK, F.date_trunc(unit, q(order)))


def _as_number(df: DataFrame, order: str) -> Column:
    """A number that rises with a time or number."""
    kind, c = dict(df.dtypes)[order], q(order)
    if kind not in ("date", "timestamp_ntz"):
        return c.cast("double")
    day = F.unix_date(c.cast("date")) * F.lit(86400.0)
    return day if kind == "date" else day + F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), c)


def add_range_block(df: DataFrame, order: str, blocks: int | None = None) -> DataFrame:
    """Block column: `order` (a time or a number) cut into `blocks` ranges of about equally many rows, twice the
    session's shuffle partitions unless given, so that blocks grow in number with the data and not in size.

    The edges are quantiles of all rows, from a sketch of that one column; however many rows a series holds, none of
    its blocks has more than all rows / `blocks`, but for readings of one instant, which stay together."""
    if blocks is None:
        blocks = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = df.withColumn("_at", _as_number(df, order).cast("double"))
    n = max(2, blocks)
    inner = sorted(set(at.approxQuantile("_at", [k / n for k in range(1, n)], 0.1 / n)))  # none of an empty table
    cutter = Bucketizer(splits=[-math.inf, *(inner or [0.0]), math.inf], inputCol="_at", outputCol=BLOCK)
    return cutter.transform(at).withColumn(BLOCK, F.col(BLOCK).cast("int")).drop("_at")


def _carried(per_block: DataFrame, keys: list[str], block: str, **carry: Column) -> DataFrame:
    """Per block, aggregates over all earlier blocks of its series."""
    w = before(ordered(keys, block))
    return per_block.select(*[q(c) for c in keys], q(block),
                            *[c.over(w).alias(n) for n, c in carry.items()])


def row_index(
    df: DataFrame, order: Names, key: Names = KEY, block: str = BLOCK, output: str = "t"
) -> DataFrame:
    """WIN19 for long series: 0-based position, from block counts and the position
    inside the block."""
    keys = names(key)
    counts = df.groupBy(*[q(c) for c in keys], q(block)).agg(F.count(F.lit(1)).alias("_rows"))
    starts = _carried(counts, keys, block, _start=F.sum("_rows"))
    inside = F.row_number().over(ordered([*keys, block], order))
    return (df.join(starts, [*keys, block])
            .withColumn(output, (F.coalesce("_start", F.lit(0)) + inside - 1).cast("long"))
            .drop("_start"))


def number_in_order(df: DataFrame, order: Names, output: str = "number", ranges: int | None = None) -> DataFrame:
    """0-based place of every row of a whole table in the order of some columns of any type. Rows are cut into ranges at sampled edges,
    as many as the session has shuffle partitions, and kept with their range, since other edges might be drawn another
    time; each range is numbered alone and set off by the counts of those before it. Rows alike in `order` share a range."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *[q(c) for c in names(order)]).select("*", F.spark_partition_id().alias("_range"), F.lit(0).alias("_all"))
    return row_index(cut_lineage(cut), order, "_all", "_range", output).drop("_range", "_all")


def rank_in_order(
    df: DataFrame, order: Names, key: Names = KEY, output: str = "rank", ranges: int | None = None
) -> DataFrame:
    """Rank from 1 of every row within its key, in rising order of some columns; rows alike share a rank and leave a gap after it. The table is
    cut into ranges of (key, order) as in `number_in_order`, so a key with most rows, or few keys in all, do not mean few tasks.
    Only rows alike in key and order must stay together."""
    keys = names(key)
    by = [q(c) for c in keys]
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *by, *[q(c) for c in names(order)]).select("*", F.spark_partition_id().alias("_range"))
    cut = cut_lineage(cut)
    counts = cut.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    starts = _carried(counts, keys, "_range", _start=F.sum("_rows"))
    inside = F.rank().over(ordered([*keys, "_range"], order))
    return (cut.join(starts, [*keys, "_range"]).withColumn(output, (F.coalesce("_start", F.lit(0)) + inside).cast("long"))
            .drop("_start", "_range"))


def running_sum(
    df: DataFrame, order: Names, key: Names = KEY, block: str = BLOCK,
    value: str = VALUE, output: str = "running_sum",
) -> DataFrame:
    """Cumulative sum (the core of WIN17) for long series."""
    keys = names(key)
    totals = df.groupBy(*[q(c) for c in keys], q(block)).agg(F.sum(q(value)).alias("_total"))
    carry = _carried(totals, keys, block, _base=F.sum("_total"))
    inside = F.sum(q(value)).over(upto(ordered([*keys, block], order)))
    total = F.when(inside.isNotNull() | F.col("_base").isNotNull(),
                   F.coalesce(inside, F.lit(0.0)) + F.coalesce("_base", F.lit(0.0)))
    return df.join(carry, [*keys, block]).withColumn(output, total).drop("_base")


def forward_fill(
    df: DataFrame, order: Names, key: Names = KEY, block: str = BLOCK,
    value: str = VALUE, output: str | None = None,
) -> DataFrame:
    """WIN11 for long series: the last known value, carried over block borders."""
    keys = names(key)
    at = F.struct(*[q(c) for c in names(order)])
    last = (df.groupBy(*[q(c) for c in keys], q(block))
            .agg(F.max_by(q(value), F.when(q(value).isNotNull(), at)).alias("_last")))
    carry = _carried(last, keys, block, _prev=F.last("_last", ignorenulls=True))
    inside = F.last(q(value), ignorenulls=True).over(upto(ordered([*keys, block], order)))
    return (df.join(carry, [*keys, block])
            .withColumn(output or value, F.coalesce(inside, F.col("_prev"))).drop("_prev"))


def backward_fill(
    df: DataFrame, order: Names, key: Names = KEY, block: str = BLOCK,
    value: str = VALUE, output: str | None = None,
) -> DataFrame:
    """WIN12 for long series."""
    keys = names(key)
    at = F.struct(*[q(c) for c in names(order)])
    first = (df.groupBy(*[q(c) for c in keys], q(block))
             .agg(F.min_by(q(value), F.when(q(value).isNotNull(), at)).alias("_first")))
    later = Window.partitionBy(*[q(c) for c in keys]).orderBy(q(block).desc())
    carry = first.select(*[q(c) for c in keys], q(block),
                         F.last("_first", ignorenulls=True).over(before(later)).alias("_next"))
    inside = F.last(q(value), ignorenulls=True).over(back_from_end([*keys, block], order))
    return (df.join(carry, [*keys, block])
            .withColumn(output or value, F.coalesce(inside, F.col("_next"))).drop("_next"))


def with_border_rows(
    df: DataFrame, order: Names, key: Names = KEY, block: str = BLOCK, earlier: int = 0, later: int = 0
) -> DataFrame:
    """Each block plus copies of the `earlier` rows before and `later` rows after it,
    marked by `_border`. A border may reach over several short blocks.

    Only row counts and the few edge rows of each block move here (the rank filter
    is applied before the shuffle); the rows themselves are shuffled once, by the
    window that follows."""
    keys = names(key)
    by = [q(c) for c in keys]
    counts = df.groupBy(*by, q(block)).agg(F.count(F.lit(1)).alias("_rows"))
    w = ordered(keys, block)
    spans = counts.select(*by, q(block), "_rows", F.coalesce(F.sum("_rows").over(before(w)), F.lit(0)).alias("_from"))
    spans = spans.withColumn("_to", F.col("_from") + F.col("_rows") - 1)

    def copies(count: int, ahead: bool) -> DataFrame:
        # Blocks are not empty, so `count` neighbours are enough.
        span = w.rowsBetween(1, count) if ahead else w.rowsBetween(-count, -1)
        edge = "_from" if ahead else "_to"
        targets = spans.select(*by, q(block), "_from", "_to", F.collect_list(
            F.struct(q(block).alias("to"), F.col(edge).alias("edge"))).over(span).alias("_targets"))
        turned = [q(c).desc() if ahead else q(c).asc() for c in names(order)]
        rank = F.row_number().over(Window.partitionBy(*by, q(block)).orderBy(*turned))
        edges = df.withColumn("_rank", rank).filter(F.col("_rank") <= count).join(targets, [*keys, block])
        at = F.col("_to") - F.col("_rank") + 1 if ahead else F.col("_from") + F.col("_rank") - 1
        edges = edges.withColumn("_at", at).withColumn("_target", F.explode("_targets"))
        near = (F.col("_at") >= F.col("_target.edge") - count if ahead
                else F.col("_at") <= F.col("_target.edge") + count)
        return (edges.filter(near).withColumn(block, F.col("_target.to"))
                .select(*[q(c) for c in df.columns], F.lit(True).alias("_border")))

    out = df.withColumn("_border", F.lit(False))
    if earlier:
        out = out.unionByName(copies(earlier, True))
    if later:
        out = out.unionByName(copies(later, False))
    return out


def in_blocks(
    df: DataFrame, step: Callable[[DataFrame, list[str]], DataFrame], order: Names,
    key: Names = KEY, block: str = BLOCK, earlier: int = 0, later: int = 0,
) -> DataFrame:
    """Run any bounded-frame window operator per (key, block). `step` gets the frame
    and the key columns to partition by; border rows are dropped afterwards."""
    wide = with_border_rows(df, order, key, block, earlier, later)
    return step(wide, [*names(key), block]).filter(~F.col("_border")).drop("_border")


def ema(
    df: DataFrame, span: float | Sequence[float], order: Names, key: Names = KEY, value: str = VALUE,
    output: str | Sequence[str] | None = None, block: str | None = None, size: int = 128,
) -> DataFrame:
    """WIN7: exponential mean, alpha = 2 / (span + 1), seeded by the first value; one column per span.

    ema = local + (1-alpha)^(j+1) * carry, where local is a weighted running sum in
    a chunk of `size` rows and carry the ema at the end of the chunk before. Without
    `block` the position comes from one window per series; with it from block counts, and
    the ends of chunks are themselves carried in groups, so that no task sees all of them.
    Values must not be null (fill first)."""
    keys = names(key)
    by = [q(c) for c in keys]
    spans = [span] if isinstance(span, (int, float)) else list(span)
    outputs = [f"{value}_ema{s:g}" for s in spans] if output is None else names(output)
    decays = {n: 1.0 - 2.0 / (s + 1.0) for n, s in zip(outputs, spans)}
    slow = {n: d for n, d in decays.items() if d > 0}
    plain = df.withColumns({n: q(value).cast("double") for n, d in decays.items() if d <= 0})
    if not slow:
        return plain
    if block is None:
        placed = plain.withColumn("_t", F.row_number().over(ordered(key, order)) - 1)
    else:
        placed = row_index(plain, order, key, block, "_t")
    # 1 / decay^j must stay finite within a chunk
    size = max(1, min(size, *[int(600 / -math.log(d)) for d in slow.values()]))
    placed = placed.withColumn("_chunk", F.floor(F.col("_t") / size)).withColumn("_j", (F.col("_t") % size).cast("double"))
    fade = lambda d, rows: F.pow(F.lit(d), rows.cast("double"))
    w = upto(ordered([*keys, "_chunk"], "_t"))

    def local(d: float) -> Column:
        own = F.when(F.col("_t") == 0, q(value)).otherwise(q(value) * (1.0 - d))
        return fade(d, F.col("_j")) * F.sum(own / fade(d, F.col("_j"))).over(w)

    def carried(rows: DataFrame, over: list[str], at: str, step: int, most: int) -> DataFrame:
        """Means at the end of all earlier rows of `over`. Those that have faded below 1e-320 add nothing."""
        def folded(i: int, d: float) -> Column:
            reach = min(most, max(1, int(737 / (-math.log(d) * step)) + 2))
            earlier = F.collect_list(F.struct(F.col(f"_l{i}").alias("l"), "_n")).over(ordered(over, at).rowsBetween(-reach, -1))
            return F.aggregate(earlier, F.lit(0.0), lambda acc, s: s["l"] + acc * fade(d, s["_n"]))
        return rows.select("*", *[folded(i, d).alias(f"_c{i}") for i, d in enumerate(slow.values())])

    done = placed.select("*", *[local(d).alias(f"_l{i}") for i, d in enumerate(slow.values())])
    ends = done.groupBy(*by, "_chunk").agg(
        *[F.max_by(f"_l{i}", "_t").alias(f"_l{i}") for i in range(len(slow))], F.count(F.lit(1)).alias("_n"))
    means = [f"_c{i}" for i in range(len(slow))]
    if block is None:
        carry = carried(ends, keys, "_chunk", size, 1 << 30)
    else:
        grouped = [*keys, "_group"]
        inside = carried(ends.withColumn("_group", F.floor(F.col("_chunk") / GROUP)), grouped, "_chunk", size, GROUP)
        inside = inside.withColumn("_ahead", F.coalesce(F.sum("_n").over(before(ordered(grouped, "_chunk"))), F.lit(0)))
        whole = inside.groupBy(*by, "_group").agg(F.sum("_n").alias("_n"), *[
            F.max_by(F.col(f"_l{i}") + F.col(f"_c{i}") * fade(d, F.col("_n")), "_chunk").alias(f"_l{i}") for i, d in enumerate(slow.values())])
        groups = carried(whole, keys, "_group", size * GROUP, 1 << 30).select(*by, "_group", *[F.col(c).alias(f"_g{c}") for c in means])
        carry = inside.join(groups, grouped).select(*by, "_chunk", *[
            (F.col(c) + fade(d, F.col("_ahead")) * F.col(f"_g{c}")).alias(c) for c, d in zip(means, slow.values())])
    out = done.join(carry.select(*by, "_chunk", *means), [*keys, "_chunk"])
    means_out = {n: F.col(f"_l{i}") + fade(d, F.col("_j") + 1.0) * F.col(f"_c{i}") for i, (n, d) in enumerate(slow.items())}
    return out.select(*[q(c) for c in df.columns], *[means_out.get(n, q(n)).alias(n) for n in outputs])
