"""Substring dedup: windows of 13 words that occur in an earlier document are cut out.

Every window of every document is hashed (Rabin-Karp) and sent, as part of a packed array, to the bucket of a second
hash. There, equal windows meet and the smallest doc_id that holds one is found; the hash goes back, packed again, to the
other documents, which look it up among their own windows, merge what it covers into intervals, and drop those words.

What is compared is the 64-bit hash within the bucket of an independent one, 64 + log2(buckets) bits in all; with 10^8 windows
the chance that any two different ones are taken for the same is about 10^-5.

Packing keeps the exchange near 9 bytes a window. Before it is sent, a chunk of some million windows keeps only the
smallest document of each window: all others in the chunk are later copies whatever comes from elsewhere, and get
their reply at once. So a passage in a third of all documents reaches its bucket once per chunk."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from macrospark.llm.common import tasks
from macrospark.llm.rolling import WINDOW_BASES, slices, text_buffers, window_hashes, word_hashes

WIDTH = 13
#: Windows sorted together before they are sent.
CHUNK = 1 << 20

#: Windows travel packed: of each document in `docs`, `counts` of the `hashes`, in order.
_PACKED = "bucket int, docs binary, counts binary, hashes binary"


def _of_texts(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of every window, and the number of the text it lies in."""
    found, before = word_hashes(*text_buffers(column))
    owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
    if len(found) < width:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    whole = owner[:len(owner) - width + 1] == owner[width - 1:]  # within one text
    h, g = (window_hashes(found, width, b)[whole] for b in WINDOW_BASES)
    return h, g, owner[:len(whole)][whole]


def _runs(keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


def _packed(bucket: np.ndarray, docs: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per bucket from rows of (bucket, document, hash)."""
    order = np.lexsort((docs, bucket))
    bucket, docs, hashes = bucket[order], docs[order], hashes[order]
    cuts, rows = _runs(bucket), []
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = _runs(docs[a:b])
        rows.append((int(bucket[a]), docs[a:b][own[:-1]].tobytes(), np.diff(own).astype(np.int32).tobytes(), hashes[a:b].tobytes()))
    for at in range(0, len(rows), 4096):
        cols = list(zip(*rows[at:at + 4096]))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]],
                                         ["bucket", "docs", "counts", "hashes"])


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Documents and hashes, a row for each hash."""
    docs, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for d, c, x in zip(*[table.column(k).to_pylist() for k in ("docs", "counts", "hashes")]):
        docs.append(np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.int32)))
        hashes.append(np.frombuffer(x, np.uint64))
    return np.concatenate(docs), np.concatenate(hashes)


def _later(h: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over rows (window, document): the smallest document's first row of each window, and the first row of each later document."""
    order = np.lexsort((docs, h))
    hs, ds = h[order], docs[order]
    new = np.ones(len(hs), bool)
    new[1:] = hs[1:] != hs[:-1]
    other = new.copy()
    other[1:] |= ds[1:] != ds[:-1]
    smallest = np.zeros(len(h), bool)
    later = np.zeros(len(h), bool)
    smallest[order[new]] = True
    later[order[other & ~new]] = True
    later[order] &= ds > np.repeat(ds[new], np.diff(np.append(np.flatnonzero(new), len(hs))))
    return smallest, later


def _sender(width: int, buckets: int, homes: int):
    def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, g, docs = (np.concatenate(x) for x in zip(*parts))
        smallest, later = _later(h, docs)
        # replies share the exchange, under negative bucket numbers
        yield from _packed((-1 - docs[later] % homes).astype(np.int32), docs[later], h[later])
        yield from _packed((g[smallest] % np.uint64(buckets)).astype(np.int32), docs[smallest], h[smallest])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for some in slices(batch, "text"):
                ids = some.column("doc_id").to_numpy(zero_copy_only=False)
                h, g, owner = _of_texts(some.column("text"), width)
                if len(h):
                    parts.append((h, g, ids[owner]))
                    held += len(h)
                if held >= CHUNK:
                    yield from flush(parts)
                    parts, held = [], 0
        if held:
            yield from flush(parts)

    return send


def _meet(homes: int):
    """Of one bucket: what each document must hear about, packed by the home bucket of the documents."""
    def meet(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        if bucket < 0:
            return group.set_column(0, "bucket", pa.array(np.full(len(group), -1 - bucket, np.int32)))
        docs, h = _unpacked(group)
        _, later = _later(h, docs)
        out = list(_packed((docs[later] % homes).astype(np.int32), docs[later], h[later]))
        return pa.Table.from_batches(out) if out else group.slice(0, 0)

    return meet


def repeated_windows(rows: DataFrame, width: int, homes: int) -> DataFrame:
    """Packed hashes of the windows that a smaller doc_id also holds; bucket is doc_id modulo `homes`."""
    sent = rows.where("doc_id IS NOT NULL").mapInArrow(_sender(width, 2 * tasks(rows.sparkSession), homes), _PACKED)
    return sent.groupBy("bucket").applyInArrow(_meet(homes), _PACKED)


_CUT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<from: int, to: int>>, kept string"


def _cutter(width: int):
    def cut(texts: pa.Table, replies: pa.Table) -> pa.Table:
        docs, told = _unpacked(replies)
        order = np.argsort(docs, kind="stable")
        docs, told = docs[order], told[order]
        total, removed, shas, spans, left = [], [], [], [], []
        for doc, text in zip(texts.column("doc_id"), texts.column("text").cast(pa.large_binary())):
            raw = text.as_py()
            found = (raw or b"").split()
            gone: list[tuple[int, int]] = []
            mine = told[np.searchsorted(docs, doc.as_py(), "left"):np.searchsorted(docs, doc.as_py(), "right")] if doc.is_valid else told[:0]
            if len(mine):
                hashed, _ = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                gone = intervals(np.flatnonzero(np.isin(window_hashes(hashed, width, WINDOW_BASES[0]), mine)), width)
            stay, at = [], 0
            for a, b in gone:
                stay += found[at:a]
                at = b
            stay += found[at:]
            whole = b" ".join(stay)
            total.append(len(found))
            removed.append(len(found) - len(stay))
            shas.append(hashlib.sha256(whole).hexdigest())
            spans.append([{"from": a, "to": b} for a, b in gone])
            left.append(whole if gone else raw)
        return pa.table([texts.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()),
                         pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), pa.array(left, pa.binary()).cast(pa.string())],
                        ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"])

    return cut


def intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal stretches [from, to) that windows from `starts` (rising) on cover; touching ones are one."""
    if not len(starts):
        return []
    gaps = np.flatnonzero(np.diff(starts) > width)
    return list(zip(starts[np.r_[0, gaps + 1]].tolist(), (starts[np.r_[gaps, len(starts) - 1]] + width).tolist()))


def dedup_substrings(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space), spans
    (removed word intervals) and kept (the text; as it was where nothing goes, else its kept words joined by one space).

    A null text has no words and stays null. A document of fewer than 13 words has no window. Rows without
    doc_id stay whole and are nobody's earlier copy. Rows that share a doc_id are one document: none removes from the other, and what one
    loses the other loses where it has it. No document: no row."""
    homes = 2 * tasks(docs.sparkSession) + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = repeated_windows(rows, width, homes)
    home = F.pmod(F.coalesce("doc_id", F.xxhash64("text")), F.lit(homes)).cast("int")
    return rows.withColumn("home", home).groupBy("home").cogroup(told.groupBy("bucket")).applyInArrow(_cutter(width), _CUT)


def digest(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def digest_oracle() -> str:
    """The digest in DuckDB, which compares the words themselves."""
    return r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
    p AS (SELECT doc_id, unnest(range(0, len(w) - 12)) i, w FROM d),
    g AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 13], ' ') win FROM p),
    f AS (SELECT win, min(doc_id) first FROM g GROUP BY win HAVING count(DISTINCT doc_id) > 1),
    c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) i FROM g JOIN f USING (win) WHERE doc_id > first),
    a AS (SELECT doc_id, list(i) gone FROM c GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
        sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i - 1)), ' ')) AS kept_sha256
    FROM d LEFT JOIN a USING (doc_id)"""
