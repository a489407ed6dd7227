"""Range windows with a halo against pandas and against windows by instrument."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.ranges import RANGE, positioned_by_days, with_ranged_ewm, with_ranges
from barloom.functions.rules import PRESETS, rule
from barloom.operators.indicators import indicator_frame, ranged_frame
from barloom.sources.bars import normalise, positioned


def long_walk(n, ticker="L", seed=3):
    rng = np.random.default_rng(seed)
    close = np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.003, n))), 2)
    open_ = np.round(close * np.exp(rng.normal(0, 0.002, n)), 2)
    frame = pd.DataFrame({"ticker": ticker, "bar_ts": pd.date_range("2024-01-01", periods=n, freq="1min"), "open": open_, "high": np.maximum(open_, close) + 0.05, "low": np.minimum(open_, close) - 0.05, "close": close, "volume": np.round(1000 * np.exp(rng.normal(0, 0.5, n)))})
    frame.loc[rng.random(n) < 0.01, "close"] = np.nan
    frame.loc[2000:2200, "close"] = np.nan
    return frame


def test_means_are_carried_between_ranges(spark):
    x = np.random.default_rng(5).normal(100, 5, 40 * RANGE + 17)
    df = spark.createDataFrame(pd.DataFrame({"ticker": "L", "i": range(len(x)), "x": x})).withColumn("x", F.when((F.col("i") >= 3) & ~F.col("i").between(5000, 6800), F.col("x")))  # a gap of over three ranges
    x[5000:6801] = np.nan
    x = pd.Series(x).ffill().to_numpy()
    got = with_ranged_ewm(with_ranges(df), {"y": ("x", 26), "z": ("x", 5), "long": ("x", 3000)}).orderBy("i").toPandas()
    for name, span in (("y", 26), ("z", 5), ("long", 3000)):
        assert got[name][:3].isna().all()
        np.testing.assert_allclose(got[name][3:], pd.Series(x[3:]).ewm(span=span, adjust=False).mean(), rtol=1e-12)
    with pytest.raises(ValueError):
        with_ranged_ewm(with_ranges(df), {"y": ("x", 1)})


def test_one_long_instrument_equals_windows_by_instrument(spark):
    raw = pd.concat([long_walk(9000), long_walk(RANGE, "S", 4), long_walk(5, "T", 5)], ignore_index=True)
    bars = normalise(spark.createDataFrame(raw))
    rules = [rule(p, 1.2).alias(p) for p in PRESETS]
    want = indicator_frame(positioned(bars)).select("*", *rules).orderBy("ticker", "i").toPandas()
    got = ranged_frame(positioned_by_days(bars)).select("*", *rules).orderBy("ticker", "i").toPandas()
    assert len(got) == len(want) and set(got.columns) == {*want.columns, "range"}
    for c in want.columns:
        if want[c].dtype == float or c.startswith(("macd", "signal", "ma", "rsi", "atr", "vol", "high")) and c not in PRESETS:
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)
        else:
            assert got[c].tolist() == want[c].tolist(), c


def test_one_instrument_spreads_over_tasks(spark):
    bars = spark.range(100_000).select(F.lit("L").alias("ticker"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id)").alias("bar_ts"), *((F.lit(100.0) + F.sin(F.col("id") / 700) * 5 + F.lit(k)).alias(c) for k, c in enumerate(("open", "high", "low", "close"))), F.lit(5.0).alias("volume"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranged_frame(positioned_by_days(bars, "hour")).groupBy(F.spark_partition_id()).count().collect()
        assert len(got) == 8 and sum(r["count"] for r in got) == 100_000 and max(r["count"] for r in got) < 40_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty(spark):
    assert ranged_frame(positioned_by_days(normalise(spark.createDataFrame(long_walk(5))).limit(0))).count() == 0
