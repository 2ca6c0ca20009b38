"""Language of web pages by Bayesian fusion of evidence.

Four sources are multiplied: the likelihood of the text under byte-trigram models (counted over all documents with a language), the
chance of the declared markup language and of the address suffix given the language, and a prior of the host. The last three are
counted over the pages themselves, with the text's posterior in the place of a known language, in grouped aggregations. A host with
few pages leans on its domain and a domain on the whole; a page's own share is taken out of its priors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from macrospark.llm.common import kept
from macrospark.llm.rolling import slices, text_buffers

BUCKETS = 1 << 14
#: The model is sent to every executor: languages x BUCKETS doubles.
MOST_LANGUAGES = 256
#: Every byte is in three trigrams, so their log-likelihoods are worth a third.
TEXT_WEIGHT = 1 / 3
#: Pages that a domain's, a host's, and a marker's prior count for.
DOMAIN_WEIGHT, HOST_WEIGHT, MARKER_WEIGHT = 5.0, 5.0, 1.0


def _trigrams(data: np.ndarray) -> np.ndarray:
    x = data.astype(np.uint32)
    return ((x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(18)).astype(np.int32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for some in slices(batch, "text", 1 << 21):
            data, offsets = text_buffers(some.column("text"))
            if len(data) < 3:
                continue
            grams, langs = _trigrams(data), some.column("lang").to_pylist()
            names = sorted(set(langs))
            code = np.repeat(np.array([names.index(x) for x in langs]), np.diff(offsets))[:len(grams)]
            whole = np.ones(len(data), bool)
            for back in (1, 2):  # trigrams that run over the end of their text
                whole[np.maximum(offsets[1:] - back, 0)] = False
            whole = whole[:len(grams)]
            for k, name in enumerate(names):
                counts.setdefault(name, np.zeros(BUCKETS, np.int64))
                counts[name] += np.bincount(grams[whole & (code == k)], minlength=BUCKETS)
    for name, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])


def trigram_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the log-likelihood of each bucket, from all documents with a language. What the driver reads is bounded by
    MOST_LANGUAGES x BUCKETS counts."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.lower("text").alias("text"), "lang")
    counts = kept(rows.mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    langs = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.full((max(1, len(langs)), BUCKETS), 0.5)
    for r in counts.toLocalIterator():
        table[langs.index(r["lang"]), r["bucket"]] += r["n"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def _scorer(model: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", 1 << 20):
                data, offsets = text_buffers(some.column("text"))
                out = np.zeros((some.num_rows, len(model)))
                if len(data) >= 3:
                    grams = _trigrams(data)
                    lo, hi = np.minimum(offsets[:-1], len(grams)), np.clip(offsets[1:] - 2, 0, len(grams))
                    for k, line in enumerate(model):
                        sums = np.concatenate([[0.0], np.cumsum(line[grams])])
                        out[:, k] = np.where(hi > lo, sums[np.maximum(hi, lo)] - sums[lo], 0.0) * TEXT_WEIGHT
                post = np.exp(out - out.max(axis=1, keepdims=True))
                post /= post.sum(axis=1, keepdims=True)
                as_lists = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.ravel()))
                cols = [some.column(c) for c in ("page_id", "host", "domain", "declared", "suffix")]
                yield pa.RecordBatch.from_arrays([*cols, as_lists(out), as_lists(post)],
                                                 ["page_id", "host", "domain", "declared", "suffix", "likelihood", "posterior"])

    return score


def plain_text(html: Column) -> Column:
    """Text of a page: without scripts, styles, comments, tags and entities."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)|<[^>]*>?", " ")
    return F.lower(F.regexp_replace(bare, r"&#?\w{1,10};", " "))


def evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, declared (markup language), suffix (top-level domain and a two-letter first path segment), host and domain.
    What is missing is an empty string."""
    url, html = F.lower(F.coalesce("url", F.lit(""))), F.coalesce("html", F.lit(""))
    host = F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), plain_text(html).alias("text"),
        F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})\b""", 1)).alias("declared"),
        F.concat_ws("/", F.regexp_extract(host, r"\.([a-z]{2,24})$", 1), F.regexp_extract(url, r"//[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1)).alias("suffix"),
        host.alias("host"), F.regexp_extract(host, r"([^.]+\.)?[^.]+$", 0).alias("domain"))


def _sums(df: DataFrame, key: str, k: int, name: str) -> DataFrame:
    """Posterior mass of each language and number of pages per value of `key`."""
    return df.groupBy(key).agg(F.array(*[F.sum(F.col("posterior")[i]) for i in range(k)]).alias(f"{name}_mass"), F.count(F.lit(1)).alias(f"{name}_n"))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per page: page_id, language, probability, text_language (from the text alone), declared, suffix and host.

    A null or empty page has even text likelihoods: the other evidence decides, ties going to the first language by name.
    Missing evidence counts for nothing; pages without host share no host prior. Repeated pages count as often as they
    stand. If no document has a language, language and probability are null."""
    langs, model = trigram_model(docs)
    k = max(1, len(langs))
    scored = "page_id bigint, host string, domain string, declared string, suffix string, likelihood array<double>, posterior array<double>"
    rows = kept(evidence(pages).mapInArrow(_scorer(model), scored), "language-scored")
    whole = rows.agg(*[F.sum(F.col("posterior")[i]) for i in range(k)], F.count(F.lit(1))).first()
    n = whole[k]
    base = [((whole[i] or 0.0) + MARKER_WEIGHT) / (n + MARKER_WEIGHT * k) for i in range(k)]
    joined = rows
    for key, name in (("declared", "declared"), ("suffix", "suffix"), ("host", "host"), ("domain", "domain")):
        joined = joined.join(_sums(rows.where(F.col(key) != ""), key, k, name), key, "left")

    def chance(name: str, i: int) -> Column:  # of the marker in language i, against its chance in all pages
        mass, total = F.col(f"{name}_mass")[i] + MARKER_WEIGHT * base[i], F.col(f"{name}_n") + MARKER_WEIGHT
        return F.coalesce(F.log(mass / (total * F.lit(base[i]))), F.lit(0.0))

    def host_prior(i: int) -> Column:
        own = F.col("posterior")[i]
        domain = F.when(F.col("domain_n").isNull(), F.lit(base[i])).otherwise(
            (F.greatest(F.col("domain_mass")[i] - own, F.lit(0.0)) + DOMAIN_WEIGHT * base[i]) / (F.col("domain_n") - 1 + DOMAIN_WEIGHT))
        return F.log(F.when(F.col("host_n").isNull(), domain).otherwise(
            (F.greatest(F.col("host_mass")[i] - own, F.lit(0.0)) + HOST_WEIGHT * domain) / (F.col("host_n") - 1 + HOST_WEIGHT)))

    logs = F.array(*[F.col("likelihood")[i] + chance("declared", i) + chance("suffix", i) + host_prior(i) for i in range(k)])
    fused = joined.withColumn("_log", logs).withColumn("_top", F.array_max("_log"))
    total = reduce(lambda a, b: a + b, [F.exp(F.col("_log")[i] - F.col("_top")) for i in range(k)])
    names = F.array(*[F.lit(x) for x in langs]) if langs else F.array(F.lit(None).cast("string"))
    first = lambda values: names[F.array_position(values, F.array_max(values)).cast("int") - 1]
    return fused.select("page_id", first(F.col("_log")).alias("language"), (F.lit(1.0) / total if langs else F.lit(None).cast("double")).alias("probability"),
                        first(F.col("likelihood")).alias("text_language"), "declared", "suffix", "host")


def digest(pages: DataFrame, docs: DataFrame) -> DataFrame:
    return identify(pages, docs).withColumn("probability", F.round("probability", 6))
