"""SimHash near-dedup through a segment-popcount embedding.

A 64-bit fingerprint is mapped to 32 counts, the set bits of its 2-bit segments. A changed bit changes one count by
one, so the Manhattan distance of two count vectors is a lower bound of the Hamming distance. Two vectors within
distance d have a lattice point within ceil(d / 2) of both: every fingerprint is put into the grid cells that
close, fingerprints that meet in a cell are candidates, and the exact distance decides.

Equal fingerprints are joined first; a fingerprint with a third of all documents is one row in everything that follows. Distinct
fingerprints near one another are bounded in number by the size of a Hamming ball."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from macrospark.llm.common import cut_lineage, kept

SEED = 42
SHINGLE = 3
MAX_DISTANCE = 2
SEGMENTS = 32
_BLOCK = 1 << 15  # shingles whose bits are counted at once


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of `shingle` words; of the whole sequence if there are fewer; none without words."""
    found = text.lower().split()  # of bytes: lower-cases A-Z and splits at ASCII blanks only
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e - 1], SEED) for s, e in zip(starts, ends[shingle - 1:])), np.uint64, len(found) - shingle + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if more than half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[at:at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        prints = [fingerprint(shingle_hashes(t.as_py() or b"")) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (a long) of every row; a null or empty text has fp 0."""
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_signed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def embedding(fp: str = "fp") -> Column:
    """The 32 segment counts, two bits each, packed into a long."""
    odd = 0x5555555555555555
    both = F.expr(f"({fp} & shiftrightunsigned({fp}, 1)) & {odd}L")
    one = F.expr(f"({fp} ^ shiftrightunsigned({fp}, 1)) & {odd}L")
    return F.shiftleft(both, 1).bitwiseOR(one)


def around(vector: Column, steps: int) -> Column:
    """Array of the vectors within `steps` of a packed vector. Counts are 0, 1 and 2: flipping the low bit of a segment moves
    between 0 and 1, flipping both moves between 1 and 2."""
    cells = F.array(vector)
    field = lambda v, i: F.call_function("shiftrightunsigned", v, i * 2).bitwiseAND(F.lit(3))
    move = lambda v, i, bits: v.bitwiseXOR(F.call_function("shiftleft", F.lit(bits).cast("long"), i * 2))
    segments = F.sequence(F.lit(0), F.lit(SEGMENTS - 1))
    for _ in range(steps):
        near = lambda v: F.concat(
            F.array(v),
            F.filter(F.transform(segments, lambda i: F.when(field(v, i) <= 1, move(v, i, 1))), lambda x: x.isNotNull()),
            F.filter(F.transform(segments, lambda i: F.when(field(v, i) >= 1, move(v, i, 3))), lambda x: x.isNotNull()))
        cells = F.flatten(F.transform(cells, near))
    return F.array_distinct(cells) if steps > 1 else cells


def links(prints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Pairs a < b of distinct fingerprints that differ in 1 to `distance` bits, each pair once.

    Spark takes the cells to be as small as the fingerprints they come from (an explode counts for nothing), and would broadcast some 50 to 70 rows for each; so the join
    is told to deal both sides."""
    cells = prints.select("fp", F.explode(around(embedding(), -(-distance // 2))).alias("cell"))
    left, right = cells.withColumnRenamed("fp", "a").hint("merge"), cells.withColumnRenamed("fp", "b").hint("merge")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return left.join(right, "cell").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) for every node of `edges` (a, b), by alternating large and small stars.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest node around. Rounds grow with
    the logarithm of the nodes. The edges are checkpointed after each round."""
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    stars = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    last = state(stars)
    while last[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = state(stars)
        if now == last:
            break
        last = now
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per row of `docs`: doc_id, fp, component_id (the smallest doc_id that chains of links reach) and
    n_links (other fingerprints linked to its own).

    Null and empty texts have fingerprint zero and are linked like any other. A row without doc_id has a component, but never names it;
    component_id is null where nobody in the component has a doc_id. Repeated rows are rows of their own."""
    signed = kept(fingerprints(docs), "simhash")
    prints = signed.groupBy("fp").agg(F.min("doc_id").alias("first"))
    near = kept(links(prints.select("fp"), distance), "simhash-links")
    rooted = prints.join(components(near), F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    degree = near.select(F.col("a").alias("fp")).unionByName(near.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    classes = rooted.select("fp", "root").join(named, "root").drop("root").join(degree, "fp", "left")
    return signed.join(classes, "fp").select("doc_id", "fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
