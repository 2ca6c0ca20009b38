"""Filter interaction audit: what each of five filters removes, and what it would remove in any other order.

Rows are dealt by ranges of (part, doc_id). Within a range and part each filter has a posting list, the ascending places of the rows
that fail it. Unions of lists (what earlier filters have removed) and differences (what this one removes of the rest) come from
galloping merges: the shorter list leaps through the longer one. Their sizes are summed over the ranges, 80 small rows (filter, earlier
filters) for each part; the 120 orders and the Shapley values are read off these sums. A part may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from macrospark.llm.common import kept, let, words

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
#: In a galloping search every so many ids one is placed by bisection; the others leap on from there.
STRIDE = 32
#: (filter, earlier filters) pairs, earlier ones in the order of FILTERS.
AFTER = [(f, "".join(s)) for f in FILTERS for n in range(len(FILTERS)) for s in combinations([x for x in FILTERS if x != f], n)]

_SUMS = ["n", "failing", "removed", "good", "toxic", "left"]
_TOP = np.iinfo(np.int64).max


def flags(text: Column) -> Column:
    """Struct of A, B, C, D: whether a whole text (null: empty) fails the filter."""
    whole = F.coalesce(text, F.lit(""))
    counted = let(words(whole), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return let(counted, lambda c: F.struct(
        (c["n"] < LEAST_WORDS).alias("A"), (100 * c["distinct"] < LEAST_DISTINCT * c["n"]).alias("B"),
        (100 * capitals > MOST_CAPITALS * F.length(whole)).alias("C"), whole.rlike(r"[#$%&*|]").alias("D")))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, doc_id, A to E, good and toxic of every row. Texts are compared by their SHA-256.

    Only a smaller doc_id makes a copy: a row without doc_id, or one that shares the smallest, passes E. Of several labels of a
    document any one counts."""
    rows = kept(docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "doc_id", flags(F.col("text")).alias("f"),
                            F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key")), "audit-flags")
    firsts = kept(rows.where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
                  .where("n > 1").drop("n"), "audit-firsts")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    out = rows.join(firsts, "key", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    out = out.join(marks, F.col("doc_id") == F.col("labelled"), "left")
    return out.select("part", "doc_id", "f.*", "E", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def leaps(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each of the ascending `wanted` the first place in the ascending `ids` whose id is not smaller. From the place of an
    earlier one the search leaps 1, 2, 4 ... places ahead and then halves the last leap; all ids move in lockstep."""
    padded = np.append(ids, _TOP)
    low = np.repeat(np.searchsorted(ids, wanted[::STRIDE]), STRIDE)[:len(wanted)]
    high, step = low.copy(), 1
    go = np.flatnonzero(padded[high] < wanted)
    while len(go):
        low[go] = high[go] + 1
        high[go] = np.minimum(high[go] + step, len(ids))
        step, go = 2 * step, go[padded[high[go]] < wanted[go]]
    go = np.flatnonzero(low < high)
    while len(go):
        middle = (low[go] + high[go]) // 2
        less = padded[middle] < wanted[go]
        low[go], high[go] = np.where(less, middle + 1, low[go]), np.where(less, high[go], middle)
        go = go[low[go] < high[go]]
    return low


def _found(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = leaps(ids, wanted)
    return at, np.append(ids, _TOP)[at] == wanted


def union(lists: list[np.ndarray]) -> np.ndarray:
    """Ids in any of the lists: the shorter ones leap through the longest and fill its gaps."""
    def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at, there = _found(a, b)
        return np.insert(a, at[~there], b[~there])
    return reduce(both, sorted(lists, key=len, reverse=True)) if lists else np.empty(0, np.int64)


def difference(ids: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Ids not in `gone`; the shorter list leaps through the longer one."""
    if len(ids) <= len(gone):
        return ids[~_found(gone, ids)[1]]
    at, there = _found(ids, gone)
    return np.delete(ids, at[there])


def common(a: np.ndarray, b: np.ndarray) -> int:
    short, long = sorted((a, b), key=len)
    return int(_found(long, short)[1].sum())


def sizes(n: int, failing: dict[str, np.ndarray], good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The sums of one range and part, a row for each of AFTER."""
    before = {s: union([failing[x] for x in s]) for s in {s for _, s in AFTER}}
    out = []
    for f, s in AFTER:
        removed = difference(failing[f], before[s])
        out.append([n, len(failing[f]), len(removed), common(removed, good), common(removed, toxic), n - len(before[s]) - len(removed)])
    return np.array(out, np.int64)


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(part, sums) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part] * len(AFTER), pa.string()), *[pa.array(x) for x in zip(*AFTER)], *map(pa.array, sums.T)],
                                          ["part", "filter", "after", *_SUMS])

    last, sums = None, None
    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        codes = parts.indices.to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]]) if len(codes) else []
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in [*FILTERS, "good", "toxic"]}
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = parts.dictionary[int(codes[a])].as_py()
            lists = {c: np.flatnonzero(x[a:b]) for c, x in columns.items()}
            own = sizes(int(b - a), lists, lists["good"], lists["toxic"])
            if part == last:
                sums += own
                continue
            if sums is not None:
                yield row(last, sums)
            last, sums = part, own
    if sums is not None:
        yield row(last, sums)


def interactions(rows: DataFrame) -> DataFrame:
    """For each part, filter and set of earlier filters (`after`): n rows, how many fail it, are removed by it, of these
    good and toxic, and how many are left."""
    dealt = kept(rows, "audit-rows").repartitionByRange("part", F.col("doc_id").asc_nulls_last()).sortWithinPartitions("part", F.col("doc_id").asc_nulls_last())
    one = dealt.mapInArrow(_audit, "part string, filter string, after string, " + ", ".join(f"{c} bigint" for c in _SUMS))
    return one.groupBy("part", "filter", "after").agg(*[F.sum(c).alias(c) for c in _SUMS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source as text; null: the empty text), order of the five filters and step, zeros included.

    kept, removed, redundant (failing the step's filter, removed before), unique_fails (failing this filter only), good_lost and
    toxic_lost (removed here), shapley (removed by the filter, summed over all orders). Null and empty texts are texts without words: they
    fail A, and E beside an earlier one. Rows count each, also where ids are missing or repeated. Texts of any length are judged whole;
    further columns, of whatever name, are left out. No documents: no rows."""
    sums = kept(interactions(judged(docs, labels)), "audit-sums")
    others = len(FILTERS) - 1
    weight = reduce(lambda c, k: c.when(F.length("after") == k, factorial(k) * factorial(others - k)), range(1, others + 1),
                    F.when(F.length("after") == 0, factorial(others)))
    filters = sums.groupBy("part", "filter").agg(
        F.sum(F.when(F.length("after") == others, F.col("removed"))).alias("unique_fails"), F.sum(weight * F.col("removed")).alias("shapley"))
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = docs.sparkSession.createDataFrame(
        [(o, k + 1, o[k], "".join(sorted(o[:k]))) for o in orders for k in range(len(FILTERS))], "filter_order string, step int, filter string, after string")
    out = sums.join(filters, ["part", "filter"]).join(F.broadcast(steps), ["filter", "after"])  # 600 fixed rows
    return out.select("part", "filter_order", "step", F.col("left").alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
                      "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")


def digest_oracle() -> str:
    """The same counts in DuckDB from one row of five bits per document."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    bit = lambda f: 1 << FILTERS.index(f)
    steps = ", ".join(f"('{o}', {k + 1}, {bit(o[k])}, {sum(map(bit, o[:k]))})" for o in orders for k in range(len(FILTERS)))
    return f"""
    WITH d AS (SELECT doc_id, coalesce(source, '') part, coalesce(text, '') t,
            list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w FROM documents),
    f AS (SELECT doc_id, part, CASE WHEN len(w) < {LEAST_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) THEN 2 ELSE 0 END
            + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MOST_CAPITALS} * length(t) THEN 4 ELSE 0 END
            + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
            + CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) THEN 16 ELSE 0 END bits FROM d),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) toxic FROM labels GROUP BY doc_id),
    c AS (SELECT part, bits, count(*) n, sum(coalesce(good, 0)) good, sum(coalesce(toxic, 0)) toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, bits),
    s(filter_order, step, own, earlier) AS (VALUES {steps}),
    r AS (SELECT part, filter_order, step, own, sum(CASE WHEN bits & (own | earlier) = 0 THEN n ELSE 0 END) AS kept,
            sum(CASE WHEN bits & own > 0 AND bits & earlier = 0 THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN bits & own > 0 AND bits & earlier > 0 THEN n ELSE 0 END) AS redundant,
            sum(CASE WHEN bits = own THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN bits & own > 0 AND bits & earlier = 0 THEN good ELSE 0 END) AS good_lost,
            sum(CASE WHEN bits & own > 0 AND bits & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY part, filter_order, step, own)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
        CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
        CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""
