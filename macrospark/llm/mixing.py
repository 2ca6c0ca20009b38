"""Mixing sources to target weights by a low-discrepancy schedule.

A schedule has one slot per block of words. Slot i sits at the van der Corput point of i; sources own stretches of
the unit interval as long as their share of slots, so every run of slots is close to the target weights. The r-th
slot of a source plays its r-th block: the source's documents, shuffled by a keyed hash and laid end to end, cut
into blocks of equal length; after the last block it starts again.

The points are taken on a grid of 2^k >= slots cells, where each of the first 2^k points falls into a cell of its own.
Stretches end on cell edges, so each source gets exactly its number of slots; points past the last stretch are idle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from macrospark.llm.common import before_in_group, digest_number, digest_sql, kept, key_text, words

SEED = "mix"
BLOCK_WORDS = 1024
MOST_TIMES = 3


def sizes(docs: DataFrame, text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, the columns in `carry` and size in words; a null text has none."""
    return docs.select("doc_id", "source", *carry, F.size(words(F.col(text))).cast("long").alias("size"))


def targets(sized: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = MOST_TIMES) -> DataFrame:
    """One row per source: number (0 first, in code-point order, null last), source, source_size, target.

    Weights repeat over `cycle` and share the words of all sources. A target stops at `most` times the source's size, and
    what is left over is shared again by weight: all targets are min(cap, weight x level) for one level. It is found in the order of
    cap / weight: let L(k) be the level that source k and those behind it share once all before k are full. L rises as
    long as the sources passed are below it and falls afterwards, so the level is its maximum. One row per
    source is ranked here in one task; nothing else is."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weights = F.array(*[F.lit(float(c)) for c in cycle])
    ranked = per.withColumn("number", (F.row_number().over(order) - 1).cast("int"))
    ranked = ranked.withColumn("_w", F.element_at(weights, F.col("number") % len(cycle) + 1))
    ranked = ranked.withColumn("_cap", (F.col("source_size") * most).cast("double"))
    by_fill = Window.orderBy(F.col("_cap") / F.col("_w"), "number")
    ahead = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(ahead), F.lit(0.0))
    heavy = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(ahead), F.lit(0.0))
    ranked = ranked.withColumn("_level", left / heavy)
    level = F.max("_level").over(everything)
    filled = F.least(F.col("_cap"), F.col("_w") * F.coalesce(level, F.lit(0.0)))
    return ranked.select("number", "source", "source_size", filled.alias("target"))


@dataclass(frozen=True)
class Plan:
    """sources: a row per source with its blocks, slots and first cell; bits: of the grid; block: words in a block."""

    sources: DataFrame
    bits: int
    block: int


def plan(goal: DataFrame, block: int = BLOCK_WORDS) -> Plan:
    """How many blocks a source has, how many slots it gets, and which cells are its own."""
    goal = goal.withColumn("quota", F.round("target").cast("long"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0).cast("long")
    out = goal.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long")).withColumn("_full", full)
    rest = F.col("quota") - F.col("_full") * F.col("source_size")
    out = out.withColumn("slots", F.col("_full") * F.col("blocks") + F.ceil(rest / block).cast("long")).drop("_full")
    ahead = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    out = kept(out.withColumn("first_cell", F.coalesce(F.sum("slots").over(ahead), F.lit(0))), "mix-sources")
    total = out.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    return Plan(out, max(1, (max(1, total) - 1).bit_length()), block)


def mirrored(i: Column, bits: int) -> Column:
    """The lowest `bits` (up to 62) of i in reverse order: the van der Corput point in base 2, times 2^bits."""
    def half(x: Column) -> Column:  # 32 bits
        for step, mask in ((1, 0x55555555), (2, 0x33333333), (4, 0x0F0F0F0F), (8, 0x00FF00FF), (16, 0x0000FFFF)):
            x = F.shiftright(x, step).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), step))
        return x

    low, high = i.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright(i, 32)
    if bits <= 32:
        return F.shiftright(half(low), 32 - bits)
    return F.shiftleft(half(low), bits - 32).bitwiseOR(F.shiftright(half(high), 64 - bits))


def schedule(p: Plan) -> DataFrame:
    """A row per slot: slot (its place in the mix; idle points leave gaps), number of its source, block, turn (0 for
    the first time through the source) and words (those it takes; the last slot of a source may take fewer)."""
    spark = p.sources.sparkSession
    shift = max(0, p.bits - 12)
    own = F.sequence(F.shiftright("first_cell", shift), F.shiftright(F.col("first_cell") + F.col("slots") - 1, shift))
    stretches = p.sources.where("slots > 0").select("*", F.explode(own).alias("zone"))
    cell = mirrored(F.col("id"), p.bits)
    points = spark.range(1 << p.bits).select(F.col("id").alias("slot"), cell.alias("cell"))
    points = points.withColumn("zone", F.shiftright("cell", shift))
    hit = points.join(stretches, "zone").where("cell >= first_cell AND cell < first_cell + slots")
    # a digest-like rank: slot numbers stretched over the range that before_in_group cuts up
    hit = hit.withColumn("_rank", F.shiftleft("slot", 52 - p.bits) if p.bits <= 52 else F.shiftright("slot", p.bits - 52))
    hit = hit.select("slot", "number", "blocks", "source_size", "quota", "_rank")
    ranked = before_in_group(hit, ["number"], "_rank", ["slot"], {"r": F.lit(1)})
    ranked = ranked.withColumn("block", F.col("r") % F.col("blocks")).withColumn("turn", F.floor(F.col("r") / F.col("blocks")).cast("int"))
    start = F.col("turn") * F.col("source_size") + F.col("block") * p.block
    length = F.least(F.lit(p.block), F.col("source_size") - F.col("block") * p.block, F.col("quota") - start)
    return ranked.select("slot", "number", "block", "turn", length.alias("words"))


def laid_out(sized: DataFrame, sources: DataFrame, seed: str = SEED, ties: Sequence[str] = ()) -> DataFrame:
    """Documents of each source in shuffled order, end to end: place (0 first) and start (words before it)."""
    rows = sized.join(sources.select("number", "source", "source_size", "target"),
                      sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = rows.withColumn("_rank", digest_number(seed, key_text(F.col("doc_id"))))
    return before_in_group(rows, ["number"], "_rank", ["doc_id", "size", *ties],
                           {"place": F.lit(1), "start": F.col("size")}).drop("_rank")


def pieces(laid: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The part of each document in each block: number, block, place, at (first word, counted in the block) and length."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    blocks = F.sequence(F.floor(F.col("start") / block), last)
    cut = laid.where("size > 0").select("number", "place", "start", "size", F.explode(blocks).alias("block"))
    first = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return cut.select("number", "place", "block", (first - F.col("block") * block).alias("at"), (end - first).alias("length"))


def mix(docs: DataFrame, block: int = BLOCK_WORDS, cycle: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = MOST_TIMES,
        seed: str = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of `docs`: doc_id, the columns in `carry` (which order rows alike in doc_id and size), source, size, source_size, target, taken.

    taken counts the words that the schedule plays, repeats included; the taken words of a source are its target,
    rounded. A null source is a source; documents without words are never taken; equal rows are rows of their own,
    and which of them comes first makes no difference. No document: no row."""
    sized = kept(sizes(docs, carry=carry), "mix-sizes")
    p = plan(targets(sized, cycle, most), block)
    laid = kept(laid_out(sized, p.sources, seed, carry), "mix-laid")
    played = schedule(p).join(pieces(laid, block), ["number", "block"])
    taken = F.greatest(F.lit(0), F.least(F.col("length"), F.col("words") - F.col("at")))
    sums = played.groupBy("number", "place").agg(F.sum(taken).alias("taken"))
    return laid.join(sums, ["number", "place"], "left").select(
        "doc_id", *carry, "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def digest_oracle() -> str:
    """The same numbers in DuckDB. There a document's words are laid against the quota by formula, and targets are found
    by walking over the levels."""
    return f"""
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size,
            row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 number FROM d GROUP BY source),
    w AS (SELECT *, (number % 3 + 1)::DOUBLE w, ({MOST_TIMES} * source_size)::DOUBLE cap FROM s),
    f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER ahead, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER ahead, 0)) lv FROM w
            WINDOW ahead AS (ORDER BY cap / w, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, least(cap, w * coalesce((SELECT max(lv) FROM f), 0)) target FROM f),
    q AS (SELECT *, CAST(round(target) AS BIGINT) quota,
            CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END turns FROM g),
    l AS (SELECT d.doc_id, d.size, q.source_size, q.target, turns, quota - turns * q.source_size rest,
            coalesce(sum(d.size) OVER (PARTITION BY number ORDER BY {digest_sql(f"'{SEED}/' || coalesce(CAST(doc_id AS VARCHAR), '<null>')")}, doc_id, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) start FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
    SELECT doc_id, size, source_size, target, CAST(turns * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken FROM l"""
