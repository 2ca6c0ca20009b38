"""Benchmark decontamination: documents that hold a benchmark item, up to a few edited words.

Texts are sequences of lower-cased words without punctuation; edits are inserted, deleted or changed words. An item that may
lose k words to edits is cut into k + 1 pieces. Each edit spoils one piece at most, so that one piece stands word for word in every
text that holds the item: the pieces are looked up at every word of every text, and none can be missed. A long item is cut into
parts first; one part has no more than its share of the edits, and its pieces are looked up.

Where a piece stands, the words of its part must be there too, all but the edits allowed and none shifted by more than
these. Then the whole item is compared with the stretch around by exact edit distance (an alignment that may start and end anywhere).

The benchmark is read in blocks of bounded size, each compared with all documents; documents are not shuffled."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from macrospark.llm.common import same_row, text_mark
from macrospark.llm.rolling import WINDOW_BASES, slices, text_buffers, word_hashes

SIMILARITY = 0.8
#: Words of a part at most, and words of a piece that are looked up at most.
PART_WORDS, SEED_WORDS = 64, 8
#: Places compared, and words laid side by side, at once.
PLACES, CELLS = 1 << 18, 1 << 22
#: A block of the benchmark ends after so many words; a longer item is a block of its own.
BLOCK_WORDS = 200_000
#: Items of fewer words are compared as exact sequences only.
LEAST_WORDS = 8

_MARKS = re.compile(rb"[!-/:-@\[-`{-~]+")
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def plain_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of lower-cased texts without ASCII punctuation, and the words before each text."""
    data, offsets = text_buffers(column)
    stay = ~_MARK[data]
    before = np.concatenate([[0], np.cumsum(stay)])
    return word_hashes(data[stay], before[offsets])


@dataclass(frozen=True)
class Seeds:
    """Hashes of the looked-up words of pieces of one length, sorted, with their part and the piece's place in the item."""

    keys: np.ndarray
    parts: np.ndarray
    offsets: np.ndarray


@dataclass(frozen=True)
class Index:
    """One block: each item's words; of each part its item, first word, words and edits; the seeds by length."""

    ids: list[int]
    items: list[np.ndarray]
    owner: np.ndarray
    first: np.ndarray
    size: np.ndarray
    most: np.ndarray
    seeds: dict[int, Seeds]


def window_keys(found: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each length up to `longest` and the hashes of the runs of so many words."""
    key = found
    for length in range(1, min(longest, len(found)) + 1):
        if length > 1:
            key = key[:-1] * np.uint64(WINDOW_BASES[0]) + found[length - 1:]
        yield length, key


def cuts(n: int, pieces: int) -> np.ndarray:
    """Ends of `pieces` even pieces of n words, 0 first."""
    return np.arange(pieces + 1) * n // pieces


def index_block(rows: list[tuple[int, str]], similarity: float = SIMILARITY) -> Index:
    found, before = plain_hashes(pa.array([t for _, t in rows], pa.string()))
    items = [found[a:b] for a, b in zip(before[:-1], before[1:])]
    parts, seeds = [], []
    for k, item in enumerate(items):
        n = len(item)
        edits, ends = allowed(n, similarity), cuts(n, -(-n // PART_WORDS)) if n else [0]
        for a, b in zip(ends[:-1], ends[1:]):
            share = int(b - a) * edits // n
            inner = cuts(int(b - a), share + 1)
            seeds += [(min(int(y - x), SEED_WORDS), len(parts), int(a + x), int(before[k] + a + x)) for x, y in zip(inner[:-1], inner[1:])]
            parts.append((k, int(a), int(b - a), share))
    table = np.array(seeds, np.int64).reshape(-1, 4)
    by = {}
    for length, key in window_keys(found, int(table[:, 0].max(initial=0))):
        some = table[table[:, 0] == length]
        if len(some):
            mine = key[some[:, 3]]
            order = np.argsort(mine, kind="stable")
            by[length] = Seeds(mine[order], some[order, 1], some[order, 2])
    return Index([i for i, _ in rows], items, *np.array(parts, np.int64).reshape(-1, 4).T, by)


def edit_distance(item: list[int], text: list[int]) -> tuple[int, int]:
    """Smallest edit distance of the item to any stretch of the text, and the end of the first such stretch.

    The columns of the alignment table are kept as two bit vectors of their differences, one bit per word of the item."""
    n = len(item)
    full = (1 << n) - 1
    spots: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item):
        spots[w] |= 1 << i
    up, down, now, best, end = full, 0, n, n, 0
    for j, w in enumerate(text):
        same = spots.get(w, 0)
        diag = (((same & up) + up) ^ up) | same | down
        plus, minus = down | ~(diag | up) & full, diag & up
        now += (plus >> (n - 1) & 1) - (minus >> (n - 1) & 1)
        plus, minus = plus << 1 & full, minus << 1 & full  # a stretch may start anywhere
        up, down = (minus | ~(diag | plus)) & full, plus & diag
        if now < best:
            best, end = now, j + 1
    return best, end


def allowed(n: int, similarity: float) -> int:
    """Edits that leave an item of n words at least so similar."""
    return int(n * (1 - similarity) + 1e-9) if n >= LEAST_WORDS else 0


def _stand(found: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, part: np.ndarray, index: Index) -> np.ndarray:
    """Whether all words of a part but its edits stand in the text (words begin to end of `found`) about where they should if
    the part began at word `at` of `found`."""
    out = np.zeros(len(at), bool)
    shapes = index.size[part] * (PART_WORDS + 1) + index.most[part]
    for shape in np.unique(shapes):
        n, most = divmod(int(shape), PART_WORDS + 1)
        rows = np.flatnonzero(shapes == shape)
        step = max(1, CELLS // (n + 2 * most))
        for some in (rows[i:i + step] for i in range(0, len(rows), step)):
            spot = at[some, None] + np.arange(-most, n + most)
            inside = (spot >= begin[some, None]) & (spot < end[some, None])
            there = np.where(inside, found[np.clip(spot, 0, len(found) - 1)], np.uint64(0))
            kinds, which = np.unique(part[some], return_inverse=True)
            words = np.stack([index.items[index.owner[p]][index.first[p]:index.first[p] + n] for p in kinds])[which]
            same = np.zeros(words.shape, bool)
            for shift in range(2 * most + 1):
                same |= there[:, shift:shift + n] == words
            out[some] = same.sum(1) >= n - most
    return out


def _marks(index: Index) -> dict[int, np.ndarray]:
    """Per length a table of the keys' low bits."""
    out = {}
    for length, seeds in index.seeds.items():
        out[length] = np.zeros(1 << 20, bool)
        out[length][seeds.keys & np.uint64((1 << 20) - 1)] = True
    return out


def _hits(found: np.ndarray, before: np.ndarray, index: Index, marks: dict[int, np.ndarray]) -> np.ndarray:
    """Distinct (text, item, first word the item would have in the text) where a part of it stands."""
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    out = [np.empty((0, 3), np.int64)]
    for length, key in window_keys(found, max(index.seeds, default=0)):
        if length not in index.seeds:
            continue
        seeds = index.seeds[length]
        near = np.flatnonzero(marks[length][key & np.uint64((1 << 20) - 1)])
        near = near[near + length <= before[text[near] + 1]]
        lo = np.searchsorted(seeds.keys, key[near], "left")
        n = np.searchsorted(seeds.keys, key[near], "right") - lo
        near, lo, n = near[n > 0], lo[n > 0], n[n > 0]
        total = np.cumsum(n)
        a = 0
        while a < len(near):
            b = max(a + 1, int(np.searchsorted(total, total[a] - n[a] + PLACES, "right")))
            some = n[a:b]
            spot = np.repeat(near[a:b], some)
            row = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + np.repeat(lo[a:b], some)
            part, t = seeds.parts[row], text[spot]
            start = spot - seeds.offsets[row]  # of the item
            good = _stand(found, before[t], before[t + 1], start + index.first[part], part, index)
            out.append(np.unique(np.stack([t, index.owner[part], start - before[t]], 1)[good], axis=0))
            a = b
    return np.unique(np.concatenate(out), axis=0)


def _finder(index: Index, similarity: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _marks(index)
        for batch in batches:
            for some in slices(batch, "text"):
                found, before = plain_hashes(some.column("text"))
                hits = _hits(found, before, index, marks)
                rows = []
                if len(hits):
                    cuts = np.concatenate([[0], np.flatnonzero((hits[1:, :2] != hits[:-1, :2]).any(1)) + 1, [len(hits)]])
                    for a, b in zip(cuts[:-1], cuts[1:]):
                        t, k = int(hits[a, 0]), int(hits[a, 1])
                        item = index.items[k]
                        most, words = allowed(len(item), similarity), found[before[t]:before[t + 1]]
                        best = (most + 1, 0)
                        lo = hi = -1
                        for at in [*hits[a:b, 2].tolist(), None]:  # rising; overlapping neighbourhoods are one
                            if at is not None and lo >= 0 and at - most <= hi:
                                hi = at + len(item) + most
                                continue
                            if hi >= 0:
                                d, end = edit_distance(item.tolist(), words[lo:hi].tolist())
                                best = min(best, (d, lo + end))
                            if at is not None:
                                lo, hi = max(0, at - most), at + len(item) + most
                        if best[0] <= most:
                            rows.append((some.column("doc_id")[t].as_py(), some.column("mark")[t].as_py(), index.ids[k], best[0], best[1], len(item)))
                cols = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "mark", "item_id", "edits", "end_word", "item_words"])

    return find


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of up to BLOCK_WORDS words, each read to the driver alone. Null and wordless items are left out."""
    part: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.where("text IS NOT NULL").select("item_id", F.lower("text").alias("text")).toLocalIterator():
        n = len(_MARKS.sub(b"", r["text"].encode()).split())
        if n and part and size + n > BLOCK_WORDS:
            yield part
            part, size = [], 0
        if n:
            part.append((r["item_id"], r["text"]))
            size += n
    if part:
        yield part


_FOUND = "doc_id bigint, mark bigint, item_id bigint, edits bigint, end_word bigint, item_words bigint"


def contaminations(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document row and item it holds: doc_id, mark (the text_mark of its text), item_id, edits (words), end_word (in the document's words without
    punctuation) and item_words.

    All are found. An item is held if some stretch of the text is within (1 - similarity) x item_words edits; items of fewer than
    eight words must stand word for word. Null and empty texts hold nothing; a null doc_id is reported as null; equal rows are
    reported each; equal items are reported each. An empty benchmark gives no row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"), F.lower("text").alias("text"))
    out = spark.createDataFrame([], _FOUND)
    for part in blocks(benchmark):
        out = out.unionByName(rows.mapInArrow(_finder(index_block(part, similarity), similarity), _FOUND))
    return out


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of `docs`, judged by its own text: doc_id, contaminated, n_items, the closest item and its edits."""
    best = F.min(F.struct("edits", "item_id"))
    found = contaminations(docs, benchmark).groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.count_distinct("item_id").alias("n_items"), best.alias("b"))
    return docs.join(found, same_row(docs), "left").select(
        "doc_id", F.col("b").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.col("b.item_id").alias("item_id"), F.col("b.edits").alias("edits"))
