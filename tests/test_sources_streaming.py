"""Landed files, exports, stored parameters, and streams that arrive in parts."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from macrospark.operators import decompose as D
from macrospark.session import cut_lineage, shared_dir
from macrospark.sources import readers as R, sinks as K
from macrospark.streaming import jobs as J


def test_payload_files(spark, tmp_path):
    good = {"observations": [{"date": "2020-01-01", "value": "1.5"}, {"date": "2020-02-01", "value": "."}]}
    bad = {"observations": [{"date": "invalid-date", "value": "3"}, {"value": "4"}, {"date": "2020-03-01", "value": "inf"}]}
    for name, payload in (("UNRATE", good), ("CPIAUCSL", bad)):
        (tmp_path / f"{name}.json").write_text(json.dumps(payload, indent=1))
    rows = R.read_payloads(spark, str(tmp_path), multiline=True)
    clean = rows.select("series_id", "date", R.numeric(F.col("value")).alias("value")).collect()
    assert len(clean) == 5
    assert {(r["series_id"], r["date"], r["value"]) for r in clean if r["value"] is not None} == {
        ("UNRATE", dt.date(2020, 1, 1), 1.5), ("CPIAUCSL", None, 3.0), ("CPIAUCSL", None, 4.0)}
    named = R.with_indicator(rows).select("indicator").distinct().collect()
    assert {r[0] for r in named} == {"unemployment_rate", "CPI"}


def test_vintage_csv(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("realtime_start,realtime_end,date,value\n2025-01-01,2025-02-01,1967-01-01,24602.0\n"
                    "2025-02-01,2025-03-01,1967-01-01,24610.0\n2025-01-01,2025-03-01,1967-04-01,.\n")
    df = R.read_csv(spark, str(path)).withColumn("series_id", F.lit("gdp")).withColumn("value", R.numeric(F.col("value")))
    out = R.resolve_vintages(df).orderBy("date").collect()
    assert [(r["date"], r["value"]) for r in out] == [(dt.date(1967, 1, 1), 24610.0), (dt.date(1967, 4, 1), None)]


def test_since_is_pushed_down(spark, tmp_path):
    spark.range(10).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date")).write.parquet(str(tmp_path / "p"))
    plan = R.since(spark.read.parquet(str(tmp_path / "p")), "2020-01-05")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2020-01-05)" in plan


def test_columnar_export_order_and_zeros(series):
    row = K.columnar_export(series({"a": [3.0, None, 1.0]}), ["value"], "series_id").first()
    assert row["dates"] == ["2000-01-01", "2000-02-01", "2000-03-01"] and row["value"] == [3.0, 0.0, 1.0]


def test_snapshot(series):
    latest = R.latest_values(series({"a": [1.0, 2.0], "b": [5.0, None]}), text=False)
    row = K.snapshot_map(latest).first()
    assert row["values"] == {"a": 2.0, "b": None} and row["updated_at"]


def test_parameters_survive_storage(spark, series, tmp_path):
    params = D.decomposition_params(D.decompose(series({"a": [float(i % 12) for i in range(36)]})))
    K.save_params(params, str(tmp_path / "params"))
    assert K.load_params(spark, str(tmp_path / "params")).collect() == params.collect()


def test_partitioned_panel(spark, series, tmp_path):
    K.write_panel(series({"a": [1.0, 2.0], "b": [3.0]}), str(tmp_path / "panel"), partition="series_id")
    assert sorted(p.name for p in (tmp_path / "panel").glob("series_id=*")) == ["series_id=a", "series_id=b"]
    assert spark.read.parquet(str(tmp_path / "panel")).count() == 3


def test_cut_lineage_is_a_reliable_checkpoint(spark):
    df = cut_lineage(spark.range(5))
    assert df.count() == 5 and spark.sparkContext.getCheckpointDir().startswith("file:" + shared_dir(spark))


# --- streams ---------------------------------------------------------------------------

SCHEMA = "series_id string, ts timestamp, value double, realtime_start date"


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stamp(month, day):
    return dt.datetime(2024, month, day)


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "in")
    land(spark, path, [("a", stamp(1, 1), 1.0, dt.date(2024, 2, 1)), ("a", stamp(1, 2), 3.0, dt.date(2024, 2, 1)),
                       ("b", stamp(1, 5), 10.0, dt.date(2024, 2, 1))])
    return path


LATER = [("a", stamp(1, 30), 5.0, dt.date(2024, 3, 1)), ("a", stamp(2, 1), 7.0, dt.date(2024, 3, 1)),
         ("b", stamp(1, 5), 20.0, dt.date(2024, 3, 1))]


def run(stream, batch, progress, mode="append"):
    (stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", progress)
     .trigger(availableNow=True).start().awaitTermination())


def test_monthly_means_take_late_rows(spark, folder, tmp_path):
    target, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    for extra in (None, LATER):
        if extra:
            land(spark, folder, extra)
        run(J.landed_files(spark, folder, SCHEMA), J.land_monthly_sums(target, "ts"), progress)
    out = {(r["series_id"], r["month_start"].month): (r["value"], r["n"]) for r in J.read_monthly_means(spark, target).collect()}
    assert out == {("a", 1): (3.0, 3), ("a", 2): (7.0, 1), ("b", 1): (15.0, 2)}


def test_no_month_is_too_late(spark, tmp_path):
    """One file per batch, months far out of order."""
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    for month in (6, 5, 1, 2, 6):
        rows = [("a", dt.datetime(2024, month, 3), float(month))]
        spark.createDataFrame(rows, "series_id string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(folder)
        run(J.landed_files(spark, folder, "series_id string, ts timestamp, value double", files_per_batch=1),
            J.land_monthly_sums(target, "ts"), str(tmp_path / "progress"))
    got = {r["month_start"].month: (r["value"], r["n"]) for r in J.read_monthly_means(spark, target).collect()}
    assert got == {1: (1.0, 1), 2: (2.0, 1), 5: (5.0, 1), 6: (6.0, 2)}


def test_equal_times_are_decided(spark):
    rows = [("a", dt.datetime(2024, 1, 1), 1.0, 5), ("a", dt.datetime(2024, 1, 1), 9.0, 4), ("a", dt.datetime(2023, 1, 1), 99.0, 9)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, value double, rank int")
    assert J.latest_stream(df, "ts").first()["value"] == 9.0 and J.latest_stream(df, "ts", ties="rank").first()["value"] == 1.0


def test_new_vintages_replace_old(spark, folder, tmp_path):
    target, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    key = ["series_id", "ts"]
    for extra in (None, LATER):
        if extra:
            land(spark, folder, extra)
        run(J.landed_files(spark, folder, SCHEMA), J.append_vintages(target, key), progress)
    current = J.read_current(spark, target, key)
    assert current.count() == 5
    assert current.filter("series_id = 'b'").first()["value"] == 20.0
    J.compact_vintages(spark, target, str(tmp_path / "small"), key=key)
    assert J.read_current(spark, str(tmp_path / "small"), key).orderBy(*key).collect() == current.orderBy(*key).collect()


def test_replayed_batch_changes_nothing(spark, folder, tmp_path):
    target = str(tmp_path / "out")
    write = J.append_vintages(target, ["series_id", "ts"])
    rows = spark.read.schema(SCHEMA).parquet(folder)
    write(rows, 0)
    write(rows, 0)
    assert spark.read.parquet(target).count() == 3


def test_refresh_rebuilds_only_touched_months(spark, folder, tmp_path):
    target, progress = str(tmp_path / "gold"), str(tmp_path / "progress")
    seen = []

    def build(rows):
        seen.append(sorted(r["month"].month for r in rows.select("month").distinct().collect()))
        return rows.groupBy("month", "series_id").agg(F.sum("value").alias("value"))

    rebuild = J.rebuild_months(lambda: spark.read.schema(SCHEMA).parquet(folder), build, target, "ts")
    J.refresh(J.landed_files(spark, folder, SCHEMA), rebuild, progress).awaitTermination()
    land(spark, folder, [("a", stamp(2, 1), 7.0, dt.date(2024, 3, 1))])
    J.refresh(J.landed_files(spark, folder, SCHEMA), rebuild, progress).awaitTermination()
    assert seen == [[1], [2]]
    assert spark.read.parquet(target).agg(F.sum("value")).first()[0] == 21.0


def test_streaming_flags_and_latest(spark, folder, tmp_path):
    bounds = spark.createDataFrame([("a", 0.0, 2.0)], "series_id string, lower_bound double, upper_bound double")
    run(J.score_stream(J.landed_files(spark, folder, SCHEMA), bounds), J.land_updates(str(tmp_path / "flags")), str(tmp_path / "p1"))
    flags = {(r["series_id"], r["value"]): r["anomaly"] for r in spark.read.parquet(str(tmp_path / "flags")).collect()}
    assert flags == {("a", 1.0): 0, ("a", 3.0): 1, ("b", 10.0): 1}
    run(J.latest_stream(J.landed_files(spark, folder, SCHEMA), "ts"), J.land_updates(str(tmp_path / "last")), str(tmp_path / "p2"), "update")
    assert {r["series_id"]: r["value"] for r in J.read_updates(spark, str(tmp_path / "last"), "series_id").collect()} == {"a": 3.0, "b": 10.0}
