"""Steps done run by run, and tables that go when their step has ended."""

import os

import pytest
from pyspark.sql import functions as F

from aeromosaic.functions import ordering
from aeromosaic.plans import orthomosaic as om
from rasters import frames_table, ground


def _tables(spark):
    """Names of the tables in the shared folder."""
    folder = ordering.shared_dir(spark).removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def _flight(spark, n=5):
    scene = ground(180 + 40 * n, 170)
    frames = frames_table(spark, [scene[40 * k : 40 * k + 180] for k in range(n)])
    return frames.withColumn("frame_idx", F.col("frame_idx") + 5).cache()


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_runs_give_the_tables_of_one_run(spark, monkeypatch):
    frames = _flight(spark)
    whole = om.mosaic(frames, tile=64)
    steps = [row[1:2] + row[3:] for row in whole["log"].rows]
    monkeypatch.setattr(om, "RUN", 2)  # partners are up to two runs away
    parts = om.mosaic(frames, tile=64)
    for name in ("frames", "keypoints", "matches", "pair_best", "chain", "canvas", "crop_box", "status", "failures"):
        assert _rows(parts[name]) == _rows(whole[name]), name
    assert [row[1:2] + row[3:] for row in parts["log"].rows] == steps
    assert whole["matches"].count() > 100 and whole["cropped"].count()


def test_only_tables_of_the_result_stay(spark, monkeypatch):
    monkeypatch.setattr(om, "RUN", 4, raising=False)
    frames, before = _flight(spark), _tables(spark)
    tables = om.mosaic(frames, tile=64)
    new = _tables(spark) - before
    read = {f for name, table in tables.items() if name != "log" for f in table.inputFiles()}
    used = {name for name in new if any(f"/{name}/" in f for f in read)}
    assert tables["cropped"].count() and new == used


def test_tables_of_a_step_that_fails_go(spark):
    before = _tables(spark)
    with pytest.raises(ZeroDivisionError), ordering.passing(spark):
        ordering.settle(spark.range(3))
        kept = ordering.settle(spark.range(5).repartition(3), lasting=True)
        raise ZeroDivisionError
    (left,) = _tables(spark) - before
    assert left in kept.inputFiles()[0] and kept.count() == 5
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    outside = ordering.settle(spark.range(2))
    assert outside.count() == 2


def test_frames_without_a_number_are_a_run(spark, monkeypatch):
    monkeypatch.setattr(om, "RUN", 4)
    frames = _flight(spark, 3)
    odd = frames.withColumn("frame_idx", F.when(F.col("frame_idx") != 6, F.col("frame_idx")))
    tables = om.mosaic(odd, tile=64)
    counts = {r.frame_idx: r["count"] for r in tables["keypoints"].groupBy("frame_idx").count().collect()}
    assert set(counts) == {None, 5, 7} and tables["matches"].where("i is null").isEmpty()
