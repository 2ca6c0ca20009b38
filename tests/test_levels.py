"""Compaction of vintage batches by levels."""

import numpy as np
import pandas as pd
import pytest

from macrospark.streaming import jobs as J, levels as V

KEY = ["series_id", "date"]


def batch(spark, seed, rows=40):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"series_id": rng.choice(["a", "b"], rows), "date": rng.integers(0, 30, rows), "value": rng.normal(size=rows).round(6),
                        "realtime_start": rng.integers(0, 20, rows)}).drop_duplicates(["series_id", "date", "realtime_start"])
    return spark.createDataFrame(pdf, "series_id string, date int, value double, realtime_start int")


def seen(df):
    return sorted(map(tuple, df.select(*KEY, "value", "realtime_start").collect()))


def test_compaction_keeps_the_table(spark, tmp_path):
    """Ten batches, compactions in between: rows as without them, few runs, no row lost when a batch comes again."""
    target = str(tmp_path / "t")
    land = J.append_vintages(target)
    for i in range(10):
        land(batch(spark, i), i)
        if i % 2:
            V.compact(spark, target, 3)
    now = V.runs(spark, target)
    assert [(r.first, r.last) for r in now][0] == (0, 8) and now[0].level == 2 and len(now) == 2
    want = seen(J.read_current(spark, target))  # all batch folders are still there
    assert seen(V.read_compacted(spark, target)) == want
    land(batch(spark, 4), 4)
    assert seen(V.read_compacted(spark, target)) == want
    assert "batch=0" in V.unused(spark, target) and "batch=9" not in V.unused(spark, target)
    assert V.compact(spark, target, 3) == 0


def test_unfinished_work_is_not_seen(spark, tmp_path):
    target = str(tmp_path / "t")
    land = J.append_vintages(target)
    for i in range(3):
        land(batch(spark, i), i)
    before = seen(V.read_compacted(spark, target))
    batch(spark, 99).write.parquet(f"{target}/_runs/1-0-2")          # a fold that was lost before it was listed
    batch(spark, 98).write.parquet(f"{target}/_lists/_draft-1")      # and its draft
    batch(spark, 97).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{target}/batch=3")
    assert seen(V.read_compacted(spark, target)) == before
    assert V.compact(spark, target, 3) == 1 and seen(V.read_compacted(spark, target)) == before
    with pytest.raises(ValueError):
        V.read_compacted(spark, str(tmp_path / "nothing"))
