from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seqwatch.operators import scaling
from seqwatch.sinks import tables

ROWS = "set_t int, v_t int, series string"


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(1, 7, "a"), (3, 7, "a"), (2, 7, "b"), (2, 9, "b")], ROWS)


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_fit(df):
    assert values(scaling.fit(df), "*") == [(1.0, 3.0, 7.0, 9.0)]


def test_constant_channel_and_no_clamping(spark):
    fitted = scaling.MinMaxParams(("set_t", "v_t"), (1.0, 7.0), (3.0, 7.0))
    other = spark.createDataFrame([(5, 7), (-1, 8), (2, None)], "set_t int, v_t int")
    assert values(scaling.scale(other, fitted), "set_t", "v_t") == [
        (2.0, 0.5), (-1.0, 0.5), (0.5, None)
    ]


def test_literals_and_subquery_agree(df):
    fitted = scaling.fit(df)
    literal = scaling.scale(df, scaling.MinMaxParams.of_row(fitted, ["set_t", "v_t"]))
    assert values(literal, "*") == values(scaling.scale(df, fitted), "*")


def test_per_series(df):
    scaled = scaling.scale(df, scaling.fit(df, series_keys=["series"]), series_keys=["series"])
    assert scaled.columns == df.columns
    assert sorted(values(scaled, "series", "set_t", "v_t")) == [
        ("a", 0.0, 0.5), ("a", 1.0, 0.5), ("b", 0.5, 0.0), ("b", 0.5, 1.0)
    ]


def test_unknown_series_stay(spark, df):
    more = df.union(spark.createDataFrame([(4, 8, "new"), (5, 9, None)], ROWS))
    scaled = scaling.scale(more, scaling.fit(df, series_keys=["series"]), series_keys=["series"])
    assert scaled.count() == 6
    unknown = values(scaled.filter("series IS NULL OR series = 'new'"), "set_t", "v_t")
    assert unknown == [(None, None)] * 2


def test_model_agrees_after_save_and_load(df, tmp_path):
    model = scaling.fit_model(df)
    tables.save_scaler(model, str(tmp_path / "scaler"))
    loaded = tables.load_scaler(str(tmp_path / "scaler"))
    params = scaling.MinMaxParams.of_model(loaded, ["set_t", "v_t"])
    by_model = scaling.time_tagged_vectors(
        df.withColumn("timestamp", F.timestamp_seconds(F.lit(17))), loaded
    )
    arrays = [r.features_with_timestamp for r in by_model.collect()]
    plain = values(scaling.scale(df, params), "set_t", "v_t")
    assert arrays == [[17.0, *p] for p in plain]


def test_scaling_keeps_order(spark):
    df = spark.range(1000).select(F.rand(3).alias("set_t"), F.rand(4).alias("v_t"))
    df = df.withColumn("raw", F.col("set_t"))
    got = values(scaling.scale(df, scaling.fit(df)).orderBy("raw"), "set_t")
    assert got == sorted(got)
