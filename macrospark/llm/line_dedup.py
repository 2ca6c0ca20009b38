"""Line dedup over overlapping windows of three lines.

A window is three consecutive lines that have a word; blank lines do not count and are kept. Windows are looked up over all
documents. The first occurrence of a window (smallest document, then smallest position) stays; the lines of every
later one go. Windows are judged on the input, so chains of copies all point at the first. Of equal lines that go,
an earlier copy always stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from macrospark.llm.common import let, text_mark

LINES = 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def windows(docs: DataFrame, span: int = LINES) -> DataFrame:
    """doc_id, mark (text_mark of the row's text), at (number of its first line among the lines with a word) and two 64-bit hashes of a window, which
    together stand for its text."""
    full = F.filter(lines_of(F.col("text")), has_word)
    def hashed(lines: Column) -> Column:
        def one(i: Column) -> Column:
            own = [lines[i + k] for k in range(span)]
            return F.struct(i.alias("at"), F.xxhash64(*own).alias("h"), F.xxhash64(F.lit(span), *own[::-1]).alias("g"))
        return F.when(F.size(lines) >= span, F.transform(F.sequence(F.lit(0), F.size(lines) - span), one))
    return docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", text_mark(F.col("text")).alias("mark"), F.explode(let(full, hashed)).alias("w")).select("doc_id", "mark", "w.*")


def later_starts(wins: DataFrame) -> DataFrame:
    """Per document row (doc_id, mark): starts, the positions of windows that occurred before. A window that a third of all documents
    hold is found in a combining aggregation; the join back to its occurrences can be split by Spark."""
    place = F.struct("doc_id", "mark", "at")
    first = wins.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    again = wins.join(first.where("n > 1").drop("n"), ["h", "g"]).where(place > F.col("first"))
    return again.groupBy("doc_id", "mark").agg(F.collect_set("at").alias("starts"))


def cleaned(text: Column, starts: Column, span: int = LINES) -> Column:
    """Struct of kept (text) and n_removed (lines): merged windows from `starts` on are cut out."""
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + span - 1))))
    gone = lambda ls: let(F.filter(F.transform(ls, lambda x, i: F.when(has_word(x), i)), lambda i: i.isNotNull()),
                          lambda full: F.transform(covered, lambda c: full[c]))
    def cut(ls: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone(ls))
        return F.struct(F.array_join(F.transform(stay, lambda i: ls[i]), "\n").alias("kept"), F.size(covered).cast("long").alias("n_removed"))
    return let(lines_of(text), cut)


def dedup_lines(docs: DataFrame, span: int = LINES) -> DataFrame:
    """The documents with `text` cleaned and n_removed added.

    A null text stays null; a text of fewer than three lines, an empty one too, stays as it is; a text of any length is taken whole. Rows without doc_id are
    left alone and are nobody's earlier copy. Rows that share a doc_id are judged each by its own text, in the order of their text_mark; rows alike in both
    have the same first occurrences. No documents: no rows. Columns named n_removed are replaced, others may have any names."""
    starts = later_starts(windows(docs, span)).select(F.col("doc_id").alias("__doc_id"), F.col("mark").alias("__mark"), F.col("starts").alias("__starts"))
    base = docs.drop("n_removed")
    same = (F.col("__docs.doc_id") == F.col("__later.__doc_id")) & (text_mark(F.col("__docs.text")) == F.col("__later.__mark"))
    joined = base.alias("__docs").join(starts.alias("__later"), same, "left").select("__docs.*", "__later.__starts")
    done = joined.withColumn("__cut", F.when(F.col("__starts").isNotNull(), cleaned(F.col("text"), F.col("__starts"), span)))
    keep = [F.when(F.col("__cut").isNotNull(), F.col("__cut.kept")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`")
            for c in base.columns]
    return done.select(*keep, F.coalesce(F.col("__cut.n_removed"), F.lit(0)).cast("long").alias("n_removed"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines and n_removed of lines with a word, kept_sha256 of the cleaned text."""
    n = F.size(F.filter(lines_of(F.col("text")), has_word)).cast("long")
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", n.alias("n_kept"), "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def digest_oracle() -> str:
    return r"""
    WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line,
            unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) i FROM documents),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 n FROM d WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    w AS (SELECT doc_id, n, line || chr(10) || lead(line) OVER p || chr(10) || lead(line, 2) OVER p win
            FROM f WINDOW p AS (PARTITION BY doc_id ORDER BY n)),
    r AS (SELECT doc_id, n FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY win ORDER BY doc_id, n) k FROM w WHERE win IS NOT NULL) WHERE k > 1),
    c AS (SELECT DISTINCT doc_id, n + unnest([0, 1, 2]) n FROM r),
    k AS (SELECT d.doc_id, d.i, d.line, c.n IS NOT NULL gone, f.n IS NOT NULL worded FROM d LEFT JOIN f ON d.doc_id = f.doc_id AND d.i = f.i
            LEFT JOIN c ON d.doc_id = c.doc_id AND f.n = c.n)
    SELECT doc_id, CAST(sum(CASE WHEN worded AND NOT gone THEN 1 ELSE 0 END) AS BIGINT) AS n_kept, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM k GROUP BY doc_id"""
