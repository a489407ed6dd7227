"""Rules kept by stateful streams, against the same rules over whole tables."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.rules import PRESETS
from barloom.operators.indicators import indicator_frame
from barloom.plans.queries import VOL_MULT
from barloom.sources.bars import bars_from_events, normalise, positioned
from barloom.streaming.last_bar import current, latest_indicators, latest_rules, run_latest

SF = "/root/testdata/sf0.001"
SHOWN = ("macd", "signal", "ma5", "ma20", "ma60", "ma60_2", "vol20_prev", "high40_prev2", "high60_prev", "atr14", "rsi14", "gc", "gc_prev5")


@pytest.fixture(scope="module")
def bars(spark):
    return bars_from_events(spark.read.parquet(f"{SF}/events.parquet")).toPandas().sort_values(["bar_ts", "ticker"], ignore_index=True)


def _expected(spark, bars):
    frame = indicator_frame(positioned(normalise(spark.createDataFrame(bars))))
    last = frame.where("i = n - 1").select("ticker", "i", "bar_ts", "close", *SHOWN)
    return last.orderBy("ticker").toPandas()


@pytest.fixture(autouse=True)
def _few_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


class _Stream:
    def __init__(self, spark, folder, late="2 hours"):
        self.spark, self.folder, self.late = spark, folder, late
        self.schema = "ticker string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double"

    def push(self, part):
        rows = self.spark.createDataFrame(part).withColumn("bar_ts", F.col("bar_ts").cast("timestamp_ntz"))
        rows.coalesce(2).write.mode("append").parquet(f"{self.folder}/in")
        latest = latest_indicators(self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in"), self.late)
        run_latest(latest, f"{self.folder}/out", f"{self.folder}/ck").awaitTermination()

    def now(self):
        return current(self.spark, f"{self.folder}/out").select("ticker", "i", "bar_ts", "close", *SHOWN).orderBy("ticker").toPandas()


def _same(got, want):
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-9)


def test_every_batch_equals_the_whole_table_and_a_restart_goes_on(spark, bars, tmp_path):
    stream = _Stream(spark, str(tmp_path))
    cuts = [0, 37, len(bars) // 2, len(bars)]
    for a, b in zip(cuts, cuts[1:], strict=False):  # each push is a query of its own on one checkpoint
        stream.push(bars[a:b])
        _same(stream.now(), _expected(spark, bars[:b]))
    rules = latest_rules(current(spark, f"{tmp_path}/out"), VOL_MULT, 20)
    assert set(PRESETS) < set(rules.columns) and rules.count() == bars.ticker.nunique()


def test_late_revised_and_missing_bars(spark, bars, tmp_path):
    own = bars[bars.ticker == bars.ticker[0]].reset_index(drop=True)[:90]
    own.loc[[40, 88], "close"] = float("nan")
    own.loc[70, "volume"] = float("nan")
    stream = _Stream(spark, str(tmp_path), late="10 days")
    kept_back = own.iloc[[80, 85]]
    revised = own.iloc[[84]].assign(close=1.0)
    stream.push(own.drop(index=[80, 85, 84, 88, 89]))
    stream.push(pd.concat([revised, own.iloc[[88]]]))
    stream.push(pd.concat([kept_back, own.iloc[[84, 89]]]))
    _same(stream.now(), _expected(spark, own))
    # A new bar far ahead settles the others; one before them is dropped from then on.
    ahead = own.iloc[[89]].assign(bar_ts=own.bar_ts[89] + pd.Timedelta(days=30))
    again = own.iloc[[89]].assign(bar_ts=own.bar_ts[89] + pd.Timedelta(days=31))
    stream.push(ahead)
    stream.push(pd.concat([again, own.iloc[[3]].assign(bar_ts=own.bar_ts[3] + pd.Timedelta(minutes=1))]))
    _same(stream.now(), _expected(spark, pd.concat([own, ahead, again])))
