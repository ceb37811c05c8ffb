import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapweave.operators import grid, shape
from gapweave.plans.storage import new_path
from gapweave.sources import results, sheets
from helpers import table

OBS = "site string, variable string, ts timestamp_ntz, value double"


def obs(spark, rows):
    return spark.createDataFrame([("s", "v", pd.Timestamp(t).to_pydatetime(), v) for t, v in rows], OBS)


def test_absent_hour_becomes_a_null_row(spark):
    d = table(grid.regularize(obs(spark, [("2024-01-01 00:00", 2.0), ("2024-01-01 02:00", 7.0)])), "pos")
    assert d.value.isna().tolist() == [False, True, False] and d.pos.tolist() == [0, 1, 2]
    assert str(d.ts[1]) == "2024-01-01 01:00:00"


@pytest.mark.parametrize("bad", ["2024-01-01 00:00", "2024-01-01 00:30"])
def test_duplicate_and_off_grid_stamps_are_rejected(spark, bad):
    d = obs(spark, [("2024-01-01 00:00", 1.0), (bad, 2.0), ("2024-01-01 03:00", 1.0)])
    with pytest.raises(Exception, match="duplicate|off-grid"):
        grid.regularize(d).collect()


def test_a_day_back_stays_a_day_back_despite_missing_rows(spark):
    hours = [h for h in range(50) if h not in (5, 6, 20, 33)]
    d = obs(spark, [(pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h), float(h)) for h in hours])
    p = table(grid.regularize(d, size=8), "pos")
    assert len(p) == 50 and (p.value[24:].dropna() == [float(h) for h in hours if h >= 24]).all()
    assert grid.assert_grid(grid.regularize(d, size=8)).first()["violations"] == 0


def test_frequency_labels(spark):
    for minutes, want in ((1, "1min"), (5, "5min"), (10, "10min"), (15, "1H"), (60, "1H")):
        rows = [(pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minutes * i), 1.0) for i in range(20)]
        assert grid.detect_freq(obs(spark, rows)).first()["freq"] == want


def test_sheets_with_different_headers(spark, tmp_path):
    (tmp_path / "b.csv").write_text("﻿수집일,Tin,RH\n2024-01-01 010000,1.5,x\n2024-01-01 020000,2.5,40\n", encoding="utf-8")
    (tmp_path / "a.csv").write_text("RH,Date\n55,2024-01-01 00:00:00\n", encoding="utf-8")
    d = table(sheets.read_site_sheets(spark, str(tmp_path)), "site", "variable", "ts")
    assert d.site.tolist() == ["a", "b", "b", "b", "b"]
    assert d[d.variable == "Tin"].value.tolist() == [1.5, 2.5] and pd.isna(d.value[1])
    assert [r.site for r in sheets.list_sites(spark, str(tmp_path)).collect()] == ["a", "b"]


def test_strict_and_drop_timestamps(spark):
    d = spark.createDataFrame([("2024-01-01 013000",), ("junk",)], "s string")
    assert sheets.parse_timestamps(d, "s", "drop").count() == 1
    with pytest.raises(Exception, match="unparseable"):
        sheets.parse_timestamps(d, "s", "strict").collect()


def test_results_resume_patch_and_merge(spark):
    cols = "site string, model string, scenario string, vars_key string, gap_len long, repeat long, case_id long, score double"
    rows = spark.createDataFrame([("s", "m", "A", "v", 2, i, i, float(i)) for i in range(6)], cols)
    path = new_path(spark, "r")
    results.append_results(rows.where("case_id < 4"), path)
    assert results.append_results(rows.withColumn("score", F.lit(9.0)), path).agg(F.sum("score")).first()[0] == 0 + 1 + 2 + 3 + 9 + 9
    fix = rows.where("case_id = 2").withColumn("score", F.lit(-1.0))
    assert results.patch_results(rows, fix).agg(F.sum("score")).first()[0] == 15 - 3
    parts = [results.shard(rows, 2, 0), results.shard(rows, 2, 1)]
    assert results.merge_shards(parts, ["case_id"], rows).count() == 6
    with pytest.raises(Exception, match="missing key"):
        results.merge_shards(parts[:1], ["case_id"], rows).collect()
    with pytest.raises(Exception, match="duplicate key"):
        results.merge_shards([*parts, parts[0]], ["case_id"], rows).collect()


def test_split_json_both_layouts(spark, tmp_path):
    roles = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "train")], "site string, role string")
    path = new_path(spark, "split")
    results.write_split(roles, path, {"seed": 1})
    want = {("a", "train"), ("b", "test"), ("c", "train")}
    assert {tuple(r) for r in results.read_split(spark, path).collect()} == want
    (tmp_path / "split.json").write_text(json.dumps({"train": ["a", "c"], "test": ["b"], "meta": {"seed": 1}}, indent=1))
    assert {tuple(r) for r in results.read_split(spark, str(tmp_path)).collect()} == want


def test_metadata_rejects_two_groups_for_a_name(spark):
    d = spark.createDataFrame([("A ", "Red_x", 1), ("a", "red x", 2), ("b", "blue", 3)], "name string, plant string, o int")
    assert results.read_site_metadata(d, order=["o"]).count() == 2
    bad = spark.createDataFrame([("a", "red", 1), ("a", "blue", 2)], "name string, plant string, o int")
    with pytest.raises(Exception, match="several groups"):
        results.read_site_metadata(bad, order=["o"]).collect()


def test_range_bounds_are_inclusive_and_unlisted_variables_untouched(spark):
    d = spark.createDataFrame([("s", "RH", 0.0), ("s", "RH", 100.0), ("s", "RH", 100.1), ("s", "x", -9e9)], "site string, variable string, value double")
    assert table(shape.range_screen(d), "variable", "value").value.isna().sum() == 1


def test_quoted_cells_and_groups_of_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('date,"Tin, inside",note\n2024-01-01 000000,1.5,"two\nlines, ""quoted"""\n2024-01-01 010000,,x\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text('﻿date,"Tin, inside",note\n2024-01-02 000000,7,8\n', encoding="utf-8")
    (tmp_path / "c.csv").write_text("RH,time\n50, 2024-01-03 000000\n\nnan,2024-01-03 010000\n", encoding="utf-8")
    (tmp_path / "d.csv").write_text("date\n2024-01-03 000000\n", encoding="utf-8")  # no sensor: no rows
    d = sheets.read_site_sheets(spark, str(tmp_path))
    got = sorted((r.site, r.variable, str(r.ts), r.value) for r in d.where("value is not null").collect())
    assert got == [
        ("a", "Tin, inside", "2024-01-01 00:00:00", 1.5), ("b", "Tin, inside", "2024-01-02 00:00:00", 7.0), ("b", "note", "2024-01-02 00:00:00", 8.0), ("c", "RH", "2024-01-03 00:00:00", 50.0),
    ]
    assert d.where("value is null").count() == 4


def test_reset_touches_the_named_partitions_alone(spark, tmp_path):
    path, backup = str(tmp_path / "r"), str(tmp_path / "b")
    rows = spark.createDataFrame([(m, i, float(i)) for m in ("x y", "z") for i in range(5)], "model string, case_id long, MAE double")
    rows.write.partitionBy("model").parquet(path)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "r" / "model=z").glob("*.parquet")}
    left = results.reset_models(spark, path, backup, ["x y", "never"])
    assert {r.model for r in left.collect()} == {"z"} and left.count() == 5
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "r" / "model=z").glob("*.parquet")} == before
    assert spark.read.parquet(backup).count() == 5
    again = results.append_results(rows.where("model = 'x y'"), path, ("model", "case_id"))
    assert again.count() == 10
    assert results.append_results(rows, str(tmp_path / "new"), ("model", "case_id")).count() == 10


def test_a_site_has_one_sheet(spark, tmp_path):
    """Rows of a site that lie in many tasks still make one file."""
    rows = [(f"s{i % 5}", f"2024-01-01 {i // 5:02}:00:00", float(i)) for i in range(100)]
    wide = spark.createDataFrame(rows, "site string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(8)
    sheets.write_site_sheets(wide, str(tmp_path / "sheets"))
    assert {r.site: r.files for r in sheets.list_sites(spark, str(tmp_path / "sheets")).collect()} == {f"s{i}": 1 for i in range(5)}
    assert sheets.read_site_sheets(spark, str(tmp_path / "sheets")).count() == 100
