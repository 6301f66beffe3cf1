import math

import pytest
from pyspark.sql import functions as F

from scriptloom.errors import ConfigurationError
from scriptloom.functions import numbers as N
from scriptloom.plans import windows


def starts(spark, duration, chunk, overlap):
    plan = windows.plan_chunks(spark.createDataFrame([(duration,)], "duration_seconds double"), chunk=chunk, overlap=overlap)
    return [(r["start_seconds"], round(r["chunk_seconds"], 6)) for r in plan.orderBy("index").collect()]


def test_plan(spark):
    assert starts(spark, 60.0, 30, 2) == [(0, 30), (28, 30), (56, 4)]
    assert len(starts(spark, 60.0, 30, 0)) == 2 and len(starts(spark, 60.01, 30, 0)) == 3 and starts(spark, 0.25, 30, 0) == [(0, 0.25)]


@pytest.mark.parametrize("duration", [None, 0.0, -1.0, float("nan"), float("inf")])
def test_no_windows_without_duration(spark, duration):
    df = spark.createDataFrame([(duration,)], "d double")
    assert df.select(windows.chunk_count(F.col("d"), 30.0)).first()[0] is None


@pytest.mark.parametrize("chunk,overlap", [(0, 0), (-1, 0), (30.01, 0), (30, -1), (30, 30), (30, 31)])
def test_bounds(chunk, overlap):
    with pytest.raises(ConfigurationError):
        windows.check(chunk, overlap)


def test_windows_of_a_point(spark):
    points = spark.createDataFrame([(float(s),) for s in (0, 27.9, 28, 29.9, 30, 57, 100)], "s double")
    got = {(r["s"], r["index"]) for r in windows.windows_of(points, "s").collect()}
    assert got == {(s, i) for s in (0, 27.9, 28, 29.9, 30, 57, 100) for i in range(10) if i * 28 <= s < i * 28 + 30}


def test_intervals(spark):
    rows = [(0, 0.0, 5.0, 30.0), (1, 25.0, 45.0, 30.0), (2, 10.0, 12.0, 30.0)]
    df = spark.createDataFrame(rows, "i int, a double, b double, d double").withColumn("g", F.lit(1))
    out = N.normalize_intervals(df, ["g"], "i", "a", "b", "d").orderBy("i").collect()
    assert [r["norm_start"] for r in out] == sorted(r["norm_start"] for r in out)
    assert out[1]["norm_end"] == 30 and math.isclose(out[2]["norm_start"], 25 * 30 / 45)
