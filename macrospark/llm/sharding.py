"""Sharding by rendezvous hashing: a record goes to the shard that bids best for its key.

Every shard's bid depends on the key and that shard alone, so a further shard takes from the others just the
records it outbids them for, and nothing moves between old shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from macrospark.llm.common import DIGEST_BITS, before_in_group, digest_number, digest_sql, key_text

SEED = "shard"


def bids(key: Column, weights: Sequence[float], seed: str = SEED) -> Column:
    """Array of (cost, shard), one per shard of positive weight. Costs are exponential with rate = weight, so
    that a shard is cheapest with a chance in proportion to its weight."""
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight"))
                       for i, w in enumerate(weights) if w > 0])
    unit = lambda s: (digest_number(seed, key, s["shard"].cast("string")) + F.lit(0.5)) / F.lit(float(1 << DIGEST_BITS))
    return F.transform(shards, lambda s: F.struct((-F.log(unit(s)) / s["weight"]).alias("cost"), s["shard"].alias("shard")))


def winner(key: Column, weights: Sequence[float], seed: str = SEED) -> Column:
    """The shard of a key; equal costs go to the lower shard."""
    return F.array_min(bids(key, weights, seed))["shard"]


def assign(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", grown: Sequence[float] = (),
           seed: str = SEED) -> DataFrame:
    """Adds shard and grown_shard (with the further weights `grown` behind the others; null without any).

    A null key is a key like any other; rows with equal keys share a shard. Columns named shard or
    grown_shard are replaced."""
    k = key_text(F.col(key))
    best = F.array_min(bids(k, weights, seed))
    out = docs.withColumn("shard", best["shard"])
    if not grown:
        return out.withColumn("grown_shard", F.lit(None).cast("int"))
    more = [0.0] * len(weights) + [float(w) for w in grown]
    return out.withColumn("grown_shard", F.array_min(F.array(best, F.array_min(bids(k, more, seed))))["shard"])


def slots(assigned: DataFrame, key: str = "doc_id", ties: Sequence[str] = (), seed: str = SEED) -> DataFrame:
    """Adds slot: gapless numbers from 0 in each shard, in an order drawn from the key. No task sees a whole shard.
    Rows alike in key and `ties` may swap their numbers."""
    ranked = assigned.withColumn("_rank", digest_number(seed, "slot", key_text(F.col(key))))
    return before_in_group(ranked, ["shard"], "_rank", [key, *ties], {"slot": F.lit(1)}).drop("_rank")


def digest(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: size, checksum, shard, slot, and the shard if there were one more.

    An empty or null text has size 16 and checksum 0. No document: no row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"),
                       F.crc32(body).alias("text_crc32"))
    placed = slots(assign(rows, [1.0] * shards, grown=[1.0]), ties=["text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def digest_oracle(shards: int = 40) -> str:
    """The digest in DuckDB."""
    bid = lambda n: f"-ln(({digest_sql(f"'{SEED}/' || k || '/' || {n}")} + 0.5) / {1 << DIGEST_BITS}.0)"
    return f"""
    WITH poly(t) AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), range(0, 8)),
            lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))),
    d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '<null>') k, hex(encode(coalesce(text, ''))) hx,
            strlen(coalesce(text, '')) + 16 size FROM documents),
    c AS (SELECT doc_id, k, size, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
            list_transform(range(0, CAST(strlen(hx) / 2 AS BIGINT)), lambda i: CAST('0x' || hx[2*i+1:2*i+2] AS BIGINT))),
            lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1]))) text_crc32 FROM d, poly),
    s AS (SELECT *, list_min(list_transform(range(0, {shards}), lambda i: {{'cost': {bid('i')}, 'shard': i}})) best,
            {{'cost': {bid(str(shards))}, 'shard': CAST({shards} AS BIGINT)}} more FROM c)
    SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(best.shard AS INTEGER) AS shard,
        row_number() OVER (PARTITION BY best.shard ORDER BY {digest_sql(f"'{SEED}/slot/' || k")}, doc_id, text_crc32, size) - 1 AS slot,
        CAST(CASE WHEN more < best THEN more.shard ELSE best.shard END AS INTEGER) AS grown_shard FROM s"""
