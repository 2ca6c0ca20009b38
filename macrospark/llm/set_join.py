"""Similarity join of shingle sets through PartEnum signatures: sets whose Jaccard similarity is 4/5 or more, none missed.

Sets are told apart by size into bands; a similar pair lies in one band or in two adjacent ones, and each such pair of bands is an
instance of its own with a bound k on the features in which two similar sets may differ. An instance partitions the domain of features twice: into
n first-level parts, each of these into SECOND second-level parts. Where two sets differ in at most k features, in some first-level
part they differ in at most OPEN, so that they agree in all but OPEN of its second-level parts: every choice of SECOND - OPEN of these
is enumerated, and what a set has in it, hashed, is a signature. Similar sets share a signature.

Signatures of nothing say nothing, so only parts that hold features are enumerated. A set is safe if enough of its first-level parts have
features in more than OPEN second-level ones; a pair with one safe set shares a signature that is not of nothing. Unsafe sets (mostly small ones)
also give out their first k + 1 features one by one: two unsafe similar sets have one of these in common.

Features that very many texts hold (a passage a third of all documents share) are left out of the enumeration and come last in the order
of the k + 1. Two sets differ in no more features without them, so nothing is missed, whatever list is taken; it is found by lossy counting over all texts.

Equal sets are one from the beginning. In a bucket of sets with one signature each is compared with the bucket's first, the set with the smallest
share of rare features: of a group of near copies one close to what they were made from. Sets that this does not bring into one component are
compared further, but only those that can still be similar by the order of their features (see `unsettled`). All comparisons are of the exact sets; pairs whose
parities (see `parities`) show that they differ in too many features are not compared, so their sets need not travel."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from macrospark.llm.common import kept, tasks, text_mark
from macrospark.llm.rolling import WINDOW_BASES, scramble, slices, text_buffers, window_hashes, word_hashes
from macrospark.llm.simhash import components, fingerprint

#: Similarity 4/5, of five-word shingles.
ALIKE = (4, 5)
SHINGLE = 5
#: Second-level parts of a first-level one, and how many of them a signature leaves out.
SECOND, OPEN = 3, 1
#: First-level parts for each feature of the largest set of an instance.
DENSITY = 0.15
#: A feature counts as frequent from so many in a run of texts, and in all; of the frequent ones the first HEAVY_MOST are used (one MB is broadcast).
RUN_LEAST, HEAVY_LEAST, HEAVY_MOST = 3, 50, 1 << 17
#: Bytes of text whose sets are made at once.
TEXT_BYTES = 1 << 21
#: Least number of cells whose parities are kept of a set.
LEAST_CELLS = 64
#: Bits of the filter that says which sets' features are wanted (two MB are broadcast).
FILTER_BITS = 24

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class Bands:
    """Size bands and their instances: instance i joins sets of bands i - 1 and i."""

    def __init__(self, most: int, alike: tuple[int, int] = ALIKE):
        a, b = alike
        ends = [1]
        while ends[-1] < most:
            ends.append(max((ends[-1] + 1) * b // a, ends[-1] + 1))
        ends.append((ends[-1] + 1) * b // a)
        self.ends = np.array(ends, np.int64)
        self.differ = 2 * self.ends * (b - a) // (a + b)
        self.needed = self.differ // (OPEN + 1) + 1
        self.first = np.maximum(self.needed, np.round(DENSITY * self.ends).astype(np.int64))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, sizes)


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of `width` words, and how many stand before each text. A text of fewer words is one run."""
    data, offsets = text_buffers(column)
    found, before = word_hashes(_LOWER[data], offsets)
    n = np.diff(before)
    runs = np.zeros(len(found), np.uint64)
    whole = window_hashes(found, width, WINDOW_BASES[0])
    runs[:len(whole)] = whole
    for k in np.flatnonzero((n > 0) & (n < width)):
        key = n[k:k + 1].astype(np.uint64)
        for at in range(before[k], before[k + 1]):
            key = key * np.uint64(WINDOW_BASES[1]) + found[at:at + 1]
        runs[before[k]] = scramble(key)[0]
    per = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(per)])
    at = np.arange(ends[-1]) - np.repeat(ends[:-1], per) + np.repeat(before[:-1], per)
    return runs[at], ends


def sets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (64-bit hashes) of each text's set, ascending, where each set ends, and a 64-bit name of each set."""
    runs, ends = shingles(column, SHINGLE)
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    once = np.ones(len(runs), bool)
    once[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    runs, owner = runs[once], owner[once]
    ends = np.searchsorted(owner, np.arange(len(ends)))
    names = np.zeros(len(ends) - 1, _U)
    some = np.flatnonzero(np.diff(ends))
    if len(some):
        names[some] = scramble(np.add.reduceat(scramble(runs + _U(0x9E37)), ends[some]) ^ (np.diff(ends)[some].astype(_U) << _U(40)))
    return runs, ends, names


def parities(runs: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Of each set, a bit for each of 2^k cells, its size at least, over which its features are dealt: whether a cell holds an odd number of them. Each feature in which two
    sets differ changes one bit, so they differ in as many features as bits, at least."""
    size = np.diff(ends)
    powers = _U(1) << np.arange(int(LEAST_CELLS).bit_length() - 1, 63, dtype=_U)
    cells = np.where(size > 0, powers[np.searchsorted(powers, size.astype(_U))], _U(0)).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(cells)])
    odd = np.zeros(starts[-1], np.uint8)
    np.bitwise_xor.at(odd, np.repeat(starts[:-1], size) + (runs & np.repeat(cells - 1, size).astype(_U)).astype(np.int64), 1)
    bits = np.packbits(odd, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((starts // 8).astype(np.int32)), pa.py_buffer(bits)])


def differences(one: pa.Array, two: pa.Array) -> np.ndarray:
    """In how many bits the parities of each pair of sets differ, in as many cells as the smaller set has: the upper half of the cells falls on the lower one."""
    def rows(column: pa.Array, at: np.ndarray, width: int, most: int) -> np.ndarray:
        found = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), width)
        while width > most:
            width //= 2
            found = found[:, :width] ^ found[:, width:]
        return found

    words = [np.array(pc.binary_length(c)) // 8 for c in (one, two)]
    out = np.zeros(len(one), np.int64)
    for a, b in np.unique(np.stack(words, 1), axis=0):
        at = np.flatnonzero((words[0] == a) & (words[1] == b))
        out[at] = np.bitwise_count(rows(one, at, a, min(a, b)) ^ rows(two, at, b, min(a, b))).sum(1, dtype=np.int64)
    return out


def _once(names: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the first of each distinct set with features."""
    return np.sort(np.unique(np.where(sizes > 0, names, _U(0)), return_index=True)[1][1 if (sizes == 0).any() else 0:])


def _picked(runs: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of the sets at these places, end to end, and each one's set."""
    n = np.diff(ends)[at]
    starts = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(starts, n) + np.repeat(ends[:-1][at], n)
    return runs[place], np.repeat(np.arange(len(at)), n)


@dataclass(frozen=True)
class Frequent:
    """Frequent features, ascending, and the place of each from the rarest (1) on."""
    items: np.ndarray
    places: np.ndarray

    def of(self, runs: np.ndarray) -> np.ndarray:
        """Place of each feature; 0 of one that is not frequent."""
        if not len(self.items):
            return np.zeros(len(runs), np.int64)
        at = np.minimum(np.searchsorted(self.items, runs), len(self.items) - 1)
        return np.where(self.items[at] == runs, self.places[at], 0)


def signatures(runs: np.ndarray, owner: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets (features `runs`, ascending within each set `owner`, with their `places`) and the set each belongs to."""
    bands = Bands(int(sizes.max(initial=1)))
    light, whose = runs[places == 0], owner[places == 0]
    found, of = [], []
    for shift in (0, 1):
        instance = bands.of(sizes) + shift
        first = np.where(bands.differ[instance] > 0, bands.first[instance], 0)
        base = np.cumsum(first) - first
        use = first[whose] > 0
        mine, item = whose[use], light[use]
        cell = base[mine] + (((item >> _U(32)) * first[mine].astype(_U)) >> _U(32)).astype(np.int64)
        slot = cell * SECOND + ((item & _U(0xFFFFFFFF)) % _U(SECOND)).astype(np.int64)
        total = int(first.sum())
        sums, counts = np.zeros(total * SECOND, _U), np.bincount(slot, minlength=total * SECOND)
        np.add.at(sums, slot, scramble(item + _U(0x51ED)))
        sums, counts = sums.reshape(-1, SECOND), counts.reshape(-1, SECOND)
        cells_of = np.repeat(np.arange(len(sizes)), first)
        tag = scramble((instance[cells_of].astype(_U) << _U(32)) + (np.arange(total) - base[cells_of]).astype(_U))
        for k, chosen in enumerate(combinations(range(SECOND), SECOND - OPEN)):
            some = counts[:, chosen].sum(1) > 0
            found.append(scramble(sums[:, chosen].sum(1, dtype=_U)[some] ^ scramble(tag[some] + _U(k))))
            of.append(cells_of[some])
        strong = np.bincount(cells_of, ((counts > 0).sum(1) > OPEN).astype(float), len(sizes))
        unsafe = (first > 0) & (strong < bands.needed[instance])
        if unsafe.any():
            pick = unsafe[owner]
            mine, item, rank = ordered(runs[pick], owner[pick], places[pick])
            head = rank <= bands.differ[instance[mine]]
            found.append(scramble(item[head] ^ scramble(instance[mine[head]].astype(_U) + _U(0xABCD))))
            of.append(mine[head])
    return np.concatenate(found), np.concatenate(of)


def ordered(runs: np.ndarray, owner: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets, features and their ranks (from 0) within each set, in one order for all sets, in which rare features come first."""
    order = np.lexsort((runs, places, owner))
    owner, runs = owner[order], runs[order]
    return owner, runs, np.arange(len(owner)) - np.searchsorted(owner, owner)


def _sketch(prints: bool):
    names = ["heavy", "doc_id", "mark", "set", "size", "odd", *["fp"] * prints]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", TEXT_BYTES):
                runs, ends, sets = sets_of(some.column("text"))
                size, ids = np.diff(ends), some.column("doc_id")
                fps = [pa.array([fingerprint(runs[a:b]) for a, b in zip(ends, ends[1:])], pa.int64())] if prints else []
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(size), bool)), ids, some.column("mark"), pa.array(sets.view(np.int64)), pa.array(size), parities(runs, ends), *fps], names)
                items, n = np.unique(_picked(runs, ends, _once(sets, size))[0], return_counts=True)
                items, n = items[n >= RUN_LEAST], n[n >= RUN_LEAST]
                none = [pa.nulls(len(n), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), bool)), pa.nulls(len(n), ids.type), *none, pa.array(items.view(np.int64)), pa.array(n), pa.nulls(len(n), pa.binary()), *none * prints], names)
    return sketch


def sketches(docs: DataFrame, prints: bool = False) -> tuple[DataFrame, Frequent]:
    """doc_id, mark, set (a name of the shingle set), size, odd (its `parities`) and, if wanted, fp (the set's SimHash fingerprint) of every row; the frequent features."""
    rows = docs.select("doc_id", text_mark(F.col("text")).alias("mark"), "text")
    schema = f"heavy boolean, doc_id {rows.schema['doc_id'].dataType.simpleString()}, mark bigint, set bigint, size bigint, odd binary" + ", fp bigint" * prints
    all_ = kept(rows.mapInArrow(_sketch(prints), schema), "join-sketches")
    counted = all_.where("heavy").groupBy("set").agg(F.sum("size").alias("n")).where(F.col("n") >= HEAVY_LEAST)
    top = counted.orderBy(F.desc("n"), "set").limit(HEAVY_MOST).select("set").toArrow()
    items = top.column("set").to_numpy().astype(np.int64).view(_U)
    order = np.argsort(items)
    return all_.where("NOT heavy").drop("heavy"), Frequent(items[order], len(items) - order)


#: What travels to a bucket: short names of sets (their names' low bits), their shares of rare features (of 255), how many signatures each has there (in runs
#: of RUN at most), the signatures' low halves. Between 4 and 10 bytes a signature, the more the more buckets there are.
_PACKED = ["sets", "rare", "counts", "sigs"]
RUN = 255
#: Bits of a short name. Where distinct sets share one, it stands for each of them (see `candidates`).
NAME_BITS = 32
#: Signatures in a bucket, about; one Python task holds one bucket.
BUCKET, LEAST_BUCKETS = 6_000_000, 64
#: A bucket is sorted in so many pieces.
PIECES = 8


def _packed(heavy, buckets: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", TEXT_BYTES):
                runs, ends, sets = sets_of(some.column("text"))
                size = np.diff(ends)
                at = _once(sets, size)
                if not len(at):
                    continue
                items, owner = _picked(runs, ends, at)
                places = heavy.value.of(items)
                sigs, of = signatures(items, owner, size[at], places)
                rare = (255 * np.bincount(owner[places == 0], minlength=len(at)) // size[at]).astype(np.uint8)
                bucket = ((sigs >> _U(32)) % _U(buckets)).astype(np.int64)
                order = np.lexsort((of, bucket))
                sigs, of, bucket = sigs[order].astype(np.uint32), of[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                out = {"bucket": bucket[cuts]} | {k: [] for k in _PACKED}
                for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
                    run = np.flatnonzero((np.diff(of[a:b], prepend=-1) != 0) | (np.arange(b - a) % RUN == 0))
                    who = of[a:b][run]
                    short = (sets[at[who]] & _U((1 << NAME_BITS) - 1)).astype(np.uint32)
                    for k, x in (("sets", short), ("rare", rare[who]), ("counts", np.diff(run, append=b - a).astype(np.uint8)), ("sigs", sigs[a:b])):
                        out[k].append(x.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *[pa.array(out[k], pa.binary()) for k in _PACKED]], ["bucket", *_PACKED])
    return pack


def _stars(table: pa.Table) -> pa.Table:
    """Of one bucket: each set beside the first one that has the same signature, once. Sets go by their short names."""
    joined = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
    counts, sets, rare, sigs = joined("counts", np.uint8), joined("sets", np.uint32), joined("rare", np.uint8), joined("sigs", np.uint32)
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    found = [_leads(sigs[some], sets[owner[some]], rare[owner[some]]) for some in (np.flatnonzero(sigs % PIECES == k) for k in range(PIECES))]
    pairs = np.unique(np.concatenate(found))
    return pa.table({"a": pairs["a"].astype(np.int64), "b": pairs["b"].astype(np.int64), "more": pairs["more"]})


def _leads(sigs: np.ndarray, sets: np.ndarray, rare: np.ndarray) -> np.ndarray:
    order = np.lexsort((sets, rare, sigs))
    sets, sigs = sets[order], sigs[order]
    once = np.ones(len(sigs), bool)
    once[1:] = (sigs[1:] != sigs[:-1]) | (sets[1:] != sets[:-1])
    sets, sigs = sets[once], sigs[once]
    starts = np.flatnonzero(np.diff(sigs.astype(np.int64), prepend=-1))
    n = np.diff(starts, append=len(sigs))
    lead, of = np.repeat(starts, n), np.repeat(n, n)
    rest = np.arange(len(sigs)) != lead
    return np.unique(np.rec.fromarrays([sets[lead][rest], sets[rest], of[rest] > 2], dtype=[("a", np.uint32), ("b", np.uint32), ("more", bool)]))


def candidates(docs: DataFrame, rows: DataFrame, heavy: Frequent) -> DataFrame:
    """a (the first set of a bucket), b, their sizes m and n, and whether some bucket of theirs holds more sets; `rows` are the sketches.

    A short name in a bucket may be that of several sets: its pairs are pairs of each of them, and the sets of one short name are pairs with one another, so none is missed."""
    spark = docs.sparkSession
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(min(tasks(spark), LEAST_BUCKETS), total // BUCKET)
    packed = docs.select("text").mapInArrow(_packed(spark.sparkContext.broadcast(heavy), buckets), "bucket int, " + ", ".join(f"{c} binary" for c in _PACKED))
    stars = packed.groupBy("bucket").applyInArrow(_stars, "a bigint, b bigint, more boolean").groupBy("a", "b").agg(F.max("more").alias("more"))
    sizes = rows.where("size > 0").select("set", "size").distinct().select("set", "size", F.col("set").bitwiseAND((1 << NAME_BITS) - 1).alias("short"))
    size = lambda c, n, short: sizes.select(F.col("set").alias(c), F.col("size").alias(n), F.col("short").alias(short))
    named = stars.toDF("short_a", "short_b", "more").join(size("a", "m", "short_a"), "short_a").join(size("b", "n", "short_b"), "short_b")
    shared = size("a", "m", "short").join(size("b", "n", "short"), "short").where("a < b").withColumn("more", F.lit(True))
    columns = ["a", "b", "m", "n", "more"]
    return named.select(columns).unionByName(shared.select(columns)).groupBy("a", "b", "m", "n").agg(F.max("more").alias("more"))


def _bits(wanted: DataFrame) -> np.ndarray:
    """A bit for each set in `wanted` (column set): a bounded filter, whatever their number."""
    bit = F.col("set").bitwiseAND((1 << FILTER_BITS) - 1)
    words = wanted.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))).alias("bits"))
    got = words.toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(_U)


def _wanted(docs: DataFrame, wanted: DataFrame, schema: str, give) -> DataFrame:
    """What `give` makes of the sets in `wanted` (column set), and of some others that share a filter bit: of their
    names, features end to end and each feature's set."""
    bits = docs.sparkSession.sparkContext.broadcast(_bits(wanted))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", TEXT_BYTES):
                runs, ends, sets = sets_of(some.column("text"))
                at = _once(sets, np.diff(ends))
                low = sets[at] & _U((1 << FILTER_BITS) - 1)
                at = at[(bits.value[(low >> _U(6)).astype(np.int64)] >> (low & _U(63))) & _U(1) > 0]
                yield give(sets[at], *_picked(runs, ends, at))

    return docs.select("text").mapInArrow(pick, schema)


def features(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set and runs (its features), a row for each set."""
    def give(sets: np.ndarray, items: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(sets) + 1)), pa.int32()), pa.array(items.view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(sets.view(np.int64)), lists], ["set", "runs"])

    return _wanted(docs, wanted, "set bigint, runs array<bigint>", give).dropDuplicates(["set"])


def heads(docs: DataFrame, wanted: DataFrame, heavy: Frequent, alike: tuple[int, int] = ALIKE) -> DataFrame:
    """set, feature and left (features behind it) of the first features of each set: those in which it must have one in common with any similar set."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def give(sets: np.ndarray, items: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
        of, items, rank = ordered(items, of, shared.value.of(items))
        size = np.bincount(of, minlength=len(sets))[of] if len(of) else of
        head = rank <= size * (alike[1] - alike[0]) // alike[1]
        return pa.RecordBatch.from_arrays([pa.array(sets[of[head]].view(np.int64)), pa.array(items[head].view(np.int64)), pa.array((size - rank - 1)[head])],
                                          ["set", "feature", "left"])

    return _wanted(docs, wanted, "set bigint, feature bigint, left bigint", give).distinct()


def likely(pairs: DataFrame, rows: DataFrame, alike: tuple[int, int] = ALIKE) -> DataFrame:
    """The pairs (a, b) that may be similar by their parities; `rows` are the sketches. No similar pair is lost, and what is sent is an eighth to a quarter of a byte for a feature."""
    known = rows.where("size > 0").select("set", "size", "odd").dropDuplicates(["set"])
    side = lambda s, n, o: known.select(F.col("set").alias(s), F.col("size").alias(n), F.col("odd").alias(o))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("m").to_numpy() + batch.column("n").to_numpy()
            keep = sum(alike) * differences(batch.column("odd_a"), batch.column("odd_b")) <= (alike[1] - alike[0]) * total
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    met = pairs.select("a", "b").join(side("b", "n", "odd_b"), "b").join(side("a", "m", "odd_a"), "a")
    return met.select("a", "b", "m", "n", "odd_a", "odd_b").mapInArrow(pick, "a bigint, b bigint")


def similar(docs: DataFrame, pairs: DataFrame, alike: tuple[int, int] = ALIKE) -> DataFrame:
    """The pairs (a, b) whose exact sets are similar."""
    sets = features(docs, pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))))
    one, two = sets.select(F.col("set").alias("a"), F.col("runs").alias("_a")), sets.select(F.col("set").alias("b"), F.col("runs").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b")).cast("long")
    return pairs.select("a", "b").join(two, "b").join(one, "a").where(alike[1] * both >= alike[0] * (F.size("_a") + F.size("_b") - both)).select("a", "b")


def _fit(alike: tuple[int, int] = ALIKE):
    return alike[1] * F.least("m", "n") >= alike[0] * F.greatest("m", "n")


def unsettled(docs: DataFrame, stars: DataFrame, roots: DataFrame, heavy: Frequent, alike: tuple[int, int] = ALIKE) -> DataFrame:
    """Pairs still to compare, where a bucket's sets are not all in the component of its first one: a set that is apart from that one, and
    one of another component that shares a bucket with some such first one.

    Similar sets have one of their first features (see `heads`) in common, and behind the first common one enough must be left in both to make
    them similar. Two sets with many rare features of their own fail that, whatever passage they share or whatever they were copied from."""
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    placed = stars.where("more").join(root("a"), "a", "left").join(root("b"), "b", "left").select(
        "a", "b", "m", "n", F.coalesce("a_root", "a").alias("a_root"), F.coalesce("b_root", "b").alias("b_root"))
    lost = placed.select("a", (F.col("a_root") != F.col("b_root")).alias("apart"))
    families = lost.where("apart").select("a").distinct()
    both = placed.join(families, "a")
    member = lambda s, n, apart: both.select(F.col(s).alias("set"), F.col(f"{s}_root").alias("root"), F.col(n).alias("size"), apart.alias("apart"))
    sets = member("a", "m", F.lit(False)).unionByName(member("b", "n", F.col("a_root") != F.col("b_root")))
    sets = kept(sets.groupBy("set", "root", "size").agg(F.max("apart").alias("apart")), "join-apart")
    if not sets.take(1):
        return stars.select("a", "b").limit(0)
    entries = kept(heads(docs, sets, heavy, alike).join(sets, "set"), "join-heads")
    one = entries.where("apart").select("feature", F.col("set").alias("x"), F.col("root").alias("x_root"), F.col("size").alias("m"), F.col("left").alias("x_left"))
    two = entries.select("feature", F.col("set").alias("y"), F.col("root").alias("y_root"), F.col("size").alias("n"), F.col("left").alias("y_left"))
    enough = sum(alike) * (F.least("x_left", "y_left") + 1) >= alike[0] * (F.col("m") + F.col("n"))
    met = one.alias("one").join(two.alias("two"), (F.col("one.feature") == F.col("two.feature")) & (F.col("x_root") != F.col("y_root")) & _fit() & enough)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs whose sets chains of `known` links do not bring together."""
    roots = kept(components(known), "join-known")
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    placed = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return placed.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select(*pairs.columns)


def links(docs: DataFrame, rows: DataFrame, heavy: Frequent, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between distinct sets whose components are those of all similar pairs; `rows` are the sketches of `docs`, `known` links (of pairs
    found similar before) count as found."""
    stars = kept(candidates(docs, rows, heavy), "join-stars")
    pairs = kept(likely(stars.where(_fit()), rows), "join-likely")
    if known is None:
        near = kept(similar(docs, pairs), "join-links")
    else:
        near = kept(similar(docs, _apart(pairs, known)), "join-links").unionByName(known)
    rest = kept(likely(unsettled(docs, stars, components(near), heavy), rows), "join-rest")
    return near.unionByName(similar(docs, rest)) if rest.take(1) else near


def join(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, mark (its text_mark), set (a name of its shingle set), n_shingles, root (a name of its component) and
    component_id (the smallest doc_id in it).

    Null, empty and blank texts have the empty set: no component (root is null), component_id is their own doc_id. A text of fewer than five words
    is one shingle. Texts are taken whole, whatever their length; pairs exactly at the limit are linked. Repeated rows are rows of their own. A row
    without doc_id has a component, but never names it; component_id is null where nobody in the component has a doc_id. Further
    columns, of whatever name, are left out. No documents: no rows."""
    rows, heavy = sketches(docs)
    return classes_of(rows, links(docs, rows, heavy))


def classes_of(rows: DataFrame, near: DataFrame) -> DataFrame:
    """What `join` gives, of its sketches and links."""
    rooted = kept(components(near), "join-roots")
    classes = rows.where("size > 0").groupBy("set").agg(F.min("doc_id").alias("first")).join(rooted, F.col("set") == F.col("node"), "left")
    classes = classes.select("set", "first", F.coalesce("root", "set").alias("root"))
    named = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    of = kept(classes.join(named, "root").select(F.col("set").alias("of"), "root", "component_id"), "join-classes")
    out = rows.join(of, F.col("set") == F.col("of"), "left")  # an empty set is in no class
    return out.select("doc_id", "mark", "set", F.col("size").alias("n_shingles"), "root", F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    return join(docs).select("doc_id", "n_shingles", "component_id")
