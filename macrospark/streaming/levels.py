"""Compaction of landed vintage batches by levels (STR3).

`append_vintages` leaves a folder per batch, and a reader's work grows with their number. Here runs of finished batches are folded by
Spark jobs into fewer, larger ones: `fanout` runs of a level make one of the next, so a row is written again once per level and not at
each compaction. Which runs count is said by a numbered list that is written whole and then renamed, so a reader sees either
all of a compaction or nothing of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from macrospark.columns import KEY, ORDER, VALUE, Names, names
from macrospark.sources.readers import resolve_vintages

LISTS, RUNS = "_lists", "_runs"


@dataclass(frozen=True)
class Run:
    """Batches `first` to `last`, folded `level` times."""
    level: int
    first: int
    last: int
    path: str


class _Folder:
    """The few file operations that Spark's readers and writers do not offer, through the file system Spark itself uses."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root, self.path_of = root.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.path_of(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, below: str = "") -> list[str]:
        at = self.path_of(f"{self.root}/{below}")
        return [s.getPath().getName() for s in self.system.listStatus(at)] if self.system.exists(at) else []

    def finished(self, below: str) -> bool:
        return self.system.exists(self.path_of(f"{self.root}/{below}/_SUCCESS"))

    def publish(self, draft: str, name: str) -> bool:
        """Renames a folder; False where the name is taken."""
        to = self.path_of(f"{self.root}/{name}")
        return not self.system.exists(to) and self.system.rename(self.path_of(f"{self.root}/{draft}"), to)


def _listed(spark: SparkSession, folder: _Folder) -> tuple[int, list[Run]]:
    versions = [int(n) for n in folder.names(LISTS) if n.isdigit()]
    if not versions:
        return 0, []
    rows = spark.read.schema("level int, first long, last long, path string").json(f"{folder.root}/{LISTS}/{max(versions)}").collect()
    return max(versions), sorted((Run(r["level"], r["first"], r["last"], r["path"]) for r in rows), key=lambda r: r.first)


def runs(spark: SparkSession, target: str) -> list[Run]:
    """What a reader reads now, in the order of batches: listed runs, and finished batches after them, as level 0."""
    folder = _Folder(spark, target)
    listed = _listed(spark, folder)[1]
    done = listed[-1].last if listed else -1
    landed = sorted(int(n.removeprefix("batch=")) for n in folder.names() if n.startswith("batch="))
    return listed + [Run(0, b, b, f"batch={b}") for b in landed if b > done and folder.finished(f"batch={b}")]


def _rows(spark: SparkSession, target: str, chosen: list[Run], schema: T.StructType | str) -> DataFrame:
    """Rows of some runs; of equal vintages the later run is the newer one."""
    parts = [spark.read.schema(schema).parquet(f"{target}/{r.path}").withColumn("_run", F.lit(r.last)) for r in chosen]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _folded(
    spark: SparkSession, target: str, chosen: list[Run], key: Names, value: str, vintage: str
) -> DataFrame:
    schema = spark.read.parquet(f"{target}/{chosen[-1].path}").schema
    kept = T.StructType([schema[c] for c in [*names(key), value, vintage]])
    return resolve_vintages(_rows(spark, target, chosen, kept), key, value, [vintage, "_run"])


def compact(
    spark: SparkSession, target: str, fanout: int = 8, key: Names = (KEY, ORDER), value: str = VALUE,
    vintage: str = "realtime_start",
) -> int:
    """STR3: fold runs until no level holds `fanout` neighbouring ones; the number of folds.

    For one compacting job at a time, beside a running stream and readers. Batches are taken in order and only once finished; a batch that is
    landed again after it was folded holds the same rows and is not read again. If the job is lost, what it had not listed is
    not seen, and the next one starts from the last list. Folders that are no longer listed stay until nobody reads them (`unused`)."""
    if fanout < 2:
        raise ValueError("needs a fanout of at least two")
    folder, folds = _Folder(spark, target), 0
    while True:
        now = runs(spark, target)
        # The oldest group of `fanout` neighbours of one level, lowest level first.
        groups = [now[i:i + fanout] for i in range(len(now) - fanout + 1)]
        ready = [g for g in groups if len({r.level for r in g}) == 1]
        if not ready:
            return folds
        group = min(ready, key=lambda g: (g[0].level, g[0].first))
        version = _listed(spark, folder)[0] + 1
        made = Run(group[0].level + 1, group[0].first, group[-1].last, f"{RUNS}/{version}-{group[0].first}-{group[-1].last}")
        _folded(spark, target, group, key, value, vintage).write.mode("overwrite").parquet(f"{target}/{made.path}")
        # The list reaches to the last batch it covers, so batches that stand between listed runs are listed too.
        kept = [r for r in now if r not in group and r.last <= max(made.last, max((x.last for x in now if x.level), default=-1))]
        draft = f"{LISTS}/_draft-{version}"
        listing = [(r.level, r.first, r.last, r.path) for r in [*kept, made]]
        spark.createDataFrame(listing, "level int, first long, last long, path string").coalesce(1).write.mode("overwrite").json(f"{target}/{draft}")
        if not folder.publish(draft, f"{LISTS}/{version}"):
            raise RuntimeError(f"list {version} of {target} was written by another job")
        folds += 1


def read_compacted(
    spark: SparkSession, target: str, key: Names = (KEY, ORDER), value: str = VALUE, vintage: str = "realtime_start"
) -> DataFrame:
    """STR3: the table as of now, over listed runs and the batches after them: the rows of `read_current`."""
    now = runs(spark, target)
    if not now:
        raise ValueError(f"no finished batch in {target}")
    return _folded(spark, target, now, key, value, vintage)


def unused(spark: SparkSession, target: str) -> list[str]:
    """Folders below `target` that a reader who starts now does not read, for whoever clears them."""
    folder = _Folder(spark, target)
    now = runs(spark, target)
    read, done = {r.path for r in now}, max((r.last for r in now if r.level), default=-1)
    landed = [n for n in folder.names() if n.startswith("batch=") and int(n.removeprefix("batch=")) <= done]
    return sorted(p for p in [*landed, *[f"{RUNS}/{n}" for n in folder.names(RUNS)]] if p not in read)
