"""Quality rules: an ordered decision list learned from labelled documents by sequential covering.

A rule is a conjunction of thresholds on text statistics. It is grown on two thirds of the labelled rows by taking, again and
again, the threshold with the highest information gain; pruned on the last third by dropping thresholds from its end
while that makes it no worse; kept if what it rejects there is bad nearly always. Rows it covers are taken out, and the
next rule is grown on the rest. Each step is one grouped count of (statistic, bin, label): the driver sees
some hundred counts, whatever the number of rows. The list is emitted as one CASE expression."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from macrospark.llm.common import kept, key_text, let, words

SYMBOLS = "[#*$%&|<>]"
FEATURES = ["n_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "marks_per_word"]

#: Edges per statistic, longest conjunction, longest list.
BINS, MOST_TERMS, MOST_RULES = 64, 3, 12
#: A rule stays if at least this share of what it covers among the pruning rows is bad, and it covers so many.
PRECISION, COVER = 0.95, 5
#: Base rules of the contract.
LEAST_WORDS, REPEAT_PERCENT = 50, 50


def repeated_words(found: Column) -> Column:
    """Number of words in three-word windows that stand twice or more in the same text, first ones included."""
    def spread(hashes: Column) -> Column:  # (hash, position), sorted: equal windows are neighbours
        return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(at: Column) -> Column:  # rising positions: each window adds what the next does not reach
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                           lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")))["n"]

    def count(hashes: Column) -> Column:
        again = lambda s: F.filter(F.transform(s, lambda x, i: F.when(
            (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])), lambda p: p.isNotNull())
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(F.sort_array(let(spread(hashes), again)))).otherwise(0)

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    return F.when(F.size(found) >= 4, let(windows(found), count)).otherwise(0).cast("long")


def statistics(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns in `carry`, the contract's counts, and the statistics that rules are learned on; null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda rx: (F.length("_t") - F.length(F.regexp_replace("_t", rx, ""))).cast("long")
    rows = docs.select("doc_id", *carry, text.alias("_t"), words(text).alias("_w"))
    lines = let(F.split("_t", "\n", -1), lambda ls: F.filter(ls, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    many = lambda ls: F.struct(F.size(ls).cast("long").alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup"))
    counts = rows.select(
        "doc_id", *carry, F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        without(SYMBOLS).alias("n_symbols"), let(lines, many).alias("_l"), repeated_words(F.col("_w")).alias("n_repeat_words"),
        F.size(F.array_distinct("_w")).cast("long").alias("_distinct"), without("[A-Z]+").alias("_upper"), without(r"[!?.,;:]+").alias("_marks"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counts.withColumn("n_dup_lines", F.col("_l.dup")).withColumn("_lines", F.col("_l.n")).select(
        "doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("word_length"), share("n_symbols", "n_words").alias("symbols_per_word"),
        share("n_dup_lines", "_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("_distinct", "n_words").alias("distinct_share"), share("_upper", "word_chars").alias("upper_share"),
        share("_marks", "n_words").alias("marks_per_word"))


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    edge: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.edge) if self.above else c < F.lit(self.edge)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.edge:g}"


@dataclass(frozen=True)
class Rule:
    terms: tuple[Term, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [t.column() for t in self.terms])

    def __str__(self) -> str:
        return " AND ".join(map(str, self.terms))


@dataclass(frozen=True)
class RuleList:
    """Rejecting rules, in order."""

    rules: tuple[Rule, ...]

    def fired(self) -> Column:
        """The text of the first rule that rejects a row, null if none does."""
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            out = F.when(rule.column(), F.lit(str(rule))).otherwise(out)
        return out


def _gain(p0: float, n0: float, p1: float, n1: float) -> float:
    """Information gained on bad rows (p of them, among p + n) by a further term."""
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def _edges(rows: DataFrame) -> dict[str, list[float]]:
    """Bin edges from quantiles of the bad and the good rows."""
    cut = [i / BINS for i in range(1, BINS)]
    got = rows.groupBy("bad").agg(*[F.percentile_approx(f, cut, 10_000).alias(f) for f in FEATURES]).collect()
    return {f: sorted({float(v) for r in got for v in r[f] or []}) for f in FEATURES}


def _best_term(rows: DataFrame, edges: dict[str, list[float]]) -> tuple[Term | None, float, float]:
    """The threshold of the highest gain on `rows`, and the bad and good rows left behind it."""
    bins = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"_bin_{f}").alias("b")) for f in FEATURES if edges[f]]))
    cells: dict[str, dict[int, list[float]]] = {f: {} for f in FEATURES}
    for r in rows.select(bins.alias("c"), "bad").groupBy("c").agg(F.sum("bad").alias("p"), F.count(F.lit(1)).alias("n")).collect():
        cells[r["c"]["f"]][r["c"]["b"]] = [float(r["p"]), float(r["n"] - r["p"])]
    best: tuple[Term | None, float, float] = (None, 0.0, 0.0)
    top = 0.0
    for f, by in cells.items():
        p0, n0 = (sum(c[k] for c in by.values()) for k in (0, 1))
        for i, edge in enumerate(edges[f]):
            below = [sum(c[k] for b, c in by.items() if b <= i) for k in (0, 1)]
            for above, (p, n) in ((True, (p0 - below[0], n0 - below[1])), (False, (below[0], below[1]))):
                if p + n < p0 + n0 and (g := _gain(p0, n0, p, n)) > top:
                    top, best = g, (Term(f, above, edge), p, n)
    return best


def learn(labelled: DataFrame, precision: float = PRECISION, cover: int = COVER) -> RuleList:
    """The list from rows of FEATURES, `bad` (1 or 0) and `doc_id` (which decides whether a row grows or prunes).

    Without bad or without good rows the list is empty."""
    edges = _edges(labelled)
    bin_of = lambda f: F.size(F.filter(F.array(*[F.lit(e) for e in edges[f]]), lambda e: e <= F.col(f))) if edges[f] else F.lit(0)
    grows = F.pmod(F.xxhash64(F.lit("grow"), key_text(F.col("doc_id"))), F.lit(3)) < 2
    binned = kept(labelled.select("bad", *FEATURES, *[bin_of(f).alias(f"_bin_{f}") for f in FEATURES], grows.alias("_grow")), "quality-labelled")
    rules: list[Rule] = []
    rest = binned
    while len(rules) < MOST_RULES:
        grow, terms = rest.where("_grow"), []
        while len(terms) < MOST_TERMS:
            term, _, good = _best_term(grow, edges)
            if term is None:
                break
            terms.append(term)
            grow = grow.where(term.column())
            if not good:
                break
        if not terms:
            break
        heads = [Rule(tuple(terms[:k])) for k in range(1, len(terms) + 1)]
        got = rest.where("NOT _grow").agg(*[F.coalesce(F.sum(F.when(r.column(), x)), F.lit(0)) for r in heads for x in (F.col("bad"), 1 - F.col("bad"))]).first()
        scores = [(got[2 * k], got[2 * k + 1]) for k in range(len(heads))]
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in scores]
        pick = max(range(len(heads)), key=lambda k: (worth[k], -k))
        p, n = scores[pick]
        if p + n < cover or p < precision * (p + n):
            break
        rules.append(heads[pick])
        rest = rest.where(~heads[pick].column())
    return RuleList(tuple(rules))


def labelled_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of the documents with a quality label, and bad. Labels that contradict one another count as good on a tie."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") < 0.5).cast("int").alias("bad"))
    return stats.join(one, "doc_id").select("doc_id", *FEATURES, "bad")


def judge(docs: DataFrame, labels: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of `docs`: doc_id, the columns in `carry`, the counts, base_failed, rule (the one that rejects it, null if none) and kept.

    A null or empty text has no words and fails the base. Rows without doc_id are judged but not learned from.
    Without labels only the base rejects."""
    stats = kept(statistics(docs, carry), "quality-statistics")
    rules = learn(labelled_rows(stats, labels))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return stats.withColumn("base_failed", base).withColumn("rule", rules.fired()).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
