"""Vector compression: each vector is cut into parts, each part is coded by the nearest entry of its codebook.

A part is looked up through a memo of grid cells. Its coarse cell is the integer division of its components by CELL; for the box of a cell each
entry has a least and a greatest distance, and an entry whose least distance is above another's greatest can be nearest to no point
of the box. Of the others those go to which the entry nearest to the box's centre is closer all over the box: the difference of the two
distances is linear, so its greatest value stands in a corner. What is left of the codebook is cached under the cell, and only these
entries are compared exactly. Cells that many vectors share, a crowd of equal vectors above all, are worked out once per task and round.

Codebooks are learned in rounds: tasks sum the parts of each entry (integers, so the order makes no difference), Spark adds the sums up, the driver
gets one row per entry."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from macrospark.llm.common import kept

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Width of a grid cell, in units of 1 / SCALE.
CELL = 64
#: Components are cut off at this size, so that squared distances fit into a long.
MOST = 1 << 25
#: Distances worked out at once.
PAIRS = 1 << 18

Books = list[np.ndarray]


def finite(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there, with components that are all finite numbers."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & good)


def whole_numbers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64)


def bounds(width: int) -> list[tuple[int, int]]:
    """First and last place of each part; equal where the width allows."""
    return [(p * width // PARTS, (p + 1) * width // PARTS) for p in range(PARTS)]


class Memo:
    """Nearest entries of one codebook, by cached cells."""

    def __init__(self, book: np.ndarray):
        self.book, self.cells = book, {}
        self.apart = np.abs(book[:, None] - book[None]).sum(2)  # Manhattan, between entries

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell the entries not dominated across its box, ascending."""
        keys = [c.tobytes() for c in cells]
        new = [i for i, k in enumerate(keys) if k not in self.cells]
        step = max(1, PAIRS // max(1, self.book.size))
        for at in range(0, len(new), step):
            some = new[at:at + step]
            low = (cells[some] * CELL)[:, None, :]
            below, above = low - self.book[None], self.book[None] - (low + CELL - 1)
            least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(2)
            most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(2)
            centre = ((2 * low + CELL - 1 - 2 * self.book[None]) ** 2).sum(2)  # four times the squared distance
            near = centre.argmin(1)
            beaten = centre[np.arange(len(some)), near][:, None] + 4 * (CELL - 1) * self.apart[near] < centre
            for i, stay in zip(some, (least <= most.min(1)[:, None]) & ~beaten):
                self.cells[keys[i]] = np.flatnonzero(stay)
        return [self.cells[k] for k in keys]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of each row; ties go to the lower index."""
        index, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        if not len(parts):
            return index, error
        cells, own = np.unique(parts // CELL, axis=0, return_inverse=True)
        lists = self.candidates(np.ascontiguousarray(cells))
        counts = np.array([len(x) for x in lists])[own.reshape(-1)]
        ends, at = np.cumsum(counts), 0
        while at < len(parts):  # so many rows at once that their candidates stay within PAIRS
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            entry = np.concatenate([lists[c] for c in own.reshape(-1)[at:to]])
            n = counts[at:to]
            starts = np.cumsum(n) - n
            far = ((np.repeat(parts[at:to], n, axis=0) - self.book[entry]) ** 2).sum(1)
            error[at:to] = np.minimum.reduceat(far, starts)
            index[at:to] = np.minimum.reduceat(np.where(far == np.repeat(error[at:to], n), entry, len(self.book)), starts)
            at = to
        return index, error


def _parts(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    rows = whole_numbers(batch.column("embedding").flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)
    return [rows[:, a:b] for a, b in bounds(width)]


def entry_sums(rows: DataFrame, books: Books, width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Of each part and used entry: how many parts are nearest to it and their sums."""
    longest = max(b - a for a, b in bounds(width))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(b) for b in books]
        counts, sums = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, longest), np.int64)
        for batch in batches:
            for p, part in enumerate(_parts(batch, width)):
                at, _ = memos[p].nearest(part)
                np.add.at(counts[p], at, 1)
                np.add.at(sums[p][:, :part.shape[1]], at, part)
        p, e = np.nonzero(counts)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * longest, pa.int32()), pa.array(sums[p, e].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), flat], ["part", "entry", "n", "sums"])

    each = rows.select("embedding").mapInArrow(summed, "part int, entry int, n bigint, sums array<bigint>")
    total = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(longest)]).alias("sums"))
    return {(r["part"], r["entry"]): (r["n"], r["sums"]) for r in total.collect()}  # PARTS x ENTRIES rows at most


def train(rows: DataFrame, rounds: int = ROUNDS) -> tuple[Books, int]:
    """Codebooks and the width of the vectors: those of the smallest vec_id (then vector). A vector of another length has no code."""
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    head = rows.orderBy(*order).select("embedding").head(1)
    if not head:
        return [], 0
    width = len(head[0]["embedding"])
    rows = rows.where(F.size("embedding") == width)
    first = whole_numbers(np.array([r["embedding"] for r in rows.orderBy(*order).select("embedding").head(ENTRIES)], np.float64))
    books = [np.ascontiguousarray(first[:, a:b]) for a, b in bounds(width)]
    for _ in range(rounds):
        for (p, e), (n, sums) in entry_sums(rows, books, width).items():
            books[p][e] = np.array(sums[:books[p].shape[1]], np.int64) // n
    return books, width


def books_sha256(books: Books) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry.tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """vec_id, label, code and error of every row with a finite vector, and the codebooks.

    Rows whose vector is null, empty or holds null or non-finite components are left out, as are those of another length
    than the smallest vec_id's. Repeated rows and rows without vec_id are rows of their own (without vec_id they come last among the first
    entries); ties in distance go to the lower entry. With fewer than 256 rows the codebooks are as short. Components beyond
    MOST / SCALE count as that. Further columns are left out. No vector: no row, no codebook."""
    rows = finite(vectors.select("vec_id", "embedding", "label"))
    books, width = train(rows, rounds)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(b) for b in books]
        for batch in batches:
            found = [memos[p].nearest(part) for p, part in enumerate(_parts(batch, width))]
            bytes_ = np.stack([at for at, _ in found], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([b.tobytes().hex() for b in bytes_], pa.string()),
                                              pa.array(sum(e for _, e in found))], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.where(F.size("embedding") == width).mapInArrow(coded, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"), books


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (equal labels' errors, nulls together) and the checksum of the codebooks."""
    coded, books = compress(vectors)
    coded = kept(coded, "codes")
    sums = kept(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "code-labels")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def digest_oracle() -> str:
    """The same rounds in DuckDB, each part compared with every entry, for vectors whose length PARTS divides."""
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT vec_id, part, e[part * len(e) // {PARTS} + 1 : (part + 1) * len(e) // {PARTS}] x FROM v, range({PARTS}) t(part)),
        b0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 entry, x FROM p
            WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES}))"""]
    far = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, part, x, m.d, m.entry FROM (SELECT p.vec_id, p.part, any_value(p.x) x,
            min({{'d': CAST({far} AS BIGINT), 'entry': b.entry}}) m FROM p JOIN b{k} b ON p.part = b.part GROUP BY p.vec_id, p.part))""")
        if k < ROUNDS:
            steps.append(f"""s{k} AS (SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) x FROM (SELECT part, entry, i, sum(c)::DOUBLE s, count(*) n FROM
                (SELECT part, entry, unnest(x) c, unnest(range(len(x))) i FROM a{k}) GROUP BY part, entry, i) GROUP BY part, entry),
            b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(s.x, b.x) x FROM b{k} b LEFT JOIN s{k} s ON b.part = s.part AND b.entry = s.entry)""")
    return f"""
    WITH {', '.join(steps)},
    c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) code, CAST(sum(d) AS BIGINT) error FROM a{ROUNDS} GROUP BY vec_id),
    h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) h FROM b{ROUNDS})
    SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
    FROM c JOIN v ON c.vec_id = v.vec_id, h"""
