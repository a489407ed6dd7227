"""The indicator frame: every column the rules, labels and scanners read.

All windows share one partitioning by instrument, so bars are shuffled once.  For
instruments too long for a task, ``ranged_frame`` computes the same by ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ranges import backfilled, with_halo, with_ranged_ewm, with_ranges, without_halo
from barloom.functions.windows import by_bar, lag, lead, roll, with_ewm


def with_macd(bars: DataFrame, fast: int = 12, slow: int = 26, smooth: int = 9) -> DataFrame:
    """ema_fast, ema_slow, macd, signal, and the strict golden cross gc."""
    df = with_ewm(bars, {"ema12": ("close", fast), "ema26": ("close", slow)}).withColumn("macd", F.col("ema12") - F.col("ema26"))
    return _crossed(with_ewm(df, {"signal": ("macd", smooth)}))


def _crossed(df: DataFrame) -> DataFrame:
    df = df.withColumns({"macd_1": lag("macd"), "signal_1": lag("signal")})
    return df.withColumn("gc", F.coalesce((F.col("macd_1") < F.col("signal_1")) & (F.col("macd") > F.col("signal")), F.lit(False)))


def true_range() -> Column:
    """The largest of the bar's range and its distances from the close before; nulls skip."""
    before = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def with_rsi(bars: DataFrame, n: int = 14, backfill: bool = True) -> DataFrame:
    """rsi14 of simple means; a bar without losses has none of its own.

    ``backfill`` fills missing values with the next valid one, which looks ahead; without
    it the column is causal.
    """
    df = bars.withColumn("step", F.col("close") - lag("close"))
    gain = F.when(F.col("step").isNotNull(), F.greatest("step", F.lit(0.0)))
    loss = F.when(F.col("step").isNotNull(), -F.least("step", F.lit(0.0)))
    df = df.withColumns({"gain": roll(F.avg, gain, 1 - n, 0), "loss": roll(F.avg, loss, 1 - n, 0)})
    df = df.withColumn("rsi14", 100 - 100 / (1 + F.col("gain") / F.expr("nullif(loss, 0)")))
    if backfill:
        back = Window.partitionBy("ticker").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn("rsi14", F.last("rsi14", ignorenulls=True).over(back))
    return df.drop("step", "gain", "loss")


def with_legacy_rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """rsi_legacy: the first step counts as 0, no losses give 100, no steps at all null."""
    step = F.coalesce(F.col("close") - lag("close"), F.lit(0.0))
    df = bars.withColumn("step", step)
    df = df.withColumns({"gain": roll(F.avg, F.greatest("step", F.lit(0.0)), 1 - n, 0), "loss": roll(F.avg, -F.least("step", F.lit(0.0)), 1 - n, 0)})
    value = F.when((F.col("gain") == 0) & (F.col("loss") == 0), None).when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("gain") / F.col("loss")))
    return df.withColumn("rsi_legacy", F.when(F.col("gain").isNotNull(), value)).drop("step", "gain", "loss")


def indicator_frame(bars: DataFrame) -> DataFrame:
    """Bars with all indicators."""
    return _rolled(with_rsi(with_macd(bars)))


def ranged_frame(bars: DataFrame, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The same frame for instruments of any length: windows run by ranges of bars, so one
    instrument spreads over many tasks.  Adds ``range``.

    ``then`` may add columns by further windows by instrument that look back at most one
    bar beyond the longest mean and five more; ``rsi14`` is not filled yet there.
    """
    df = with_ranged_ewm(with_ranges(bars), {"ema12": ("close", 12), "ema26": ("close", 26)})
    df = with_ranged_ewm(df.withColumn("macd", F.col("ema12") - F.col("ema26")), {"signal": ("macd", 9)})
    df = _rolled(with_rsi(_crossed(with_halo(df)), backfill=False))
    return backfilled(without_halo(then(df) if then else df), "rsi14")


def _rolled(df: DataFrame) -> DataFrame:
    df = df.withColumns({
        "ma5": roll(F.avg, "close", -4, 0), "ma10": roll(F.avg, "close", -9, 0), "ma20": roll(F.avg, "close", -19, 0), "ma60": roll(F.avg, "close", -59, 0),
        "vol20": roll(F.avg, "volume", -19, 0), "vol20_prev": roll(F.avg, "volume", -20, -1),
        "high40_prev": roll(F.max, "high", -40, -1), "high40_prev2": roll(F.max, "high", -41, -2), "high60_prev": roll(F.max, "high", -60, -1),
        "tr": true_range(), "close_1": lag("close"), "next_open": lead("open"), "next_close": lead("close"),
        "gc_prev5": F.coalesce(F.max(F.col("gc").cast("int")).over(by_bar().rowsBetween(-5, -1)), F.lit(0)),
    })
    return df.withColumns({"atr14": roll(F.avg, "tr", -13, 0), "ma20_1": lag("ma20"), "ma20_2": lag("ma20", 2), "ma60_1": lag("ma60"), "ma60_2": lag("ma60", 2)})


def recent_cross(window: int = 5, least: int = 35) -> Column:
    """A cross (from at or below to above) in the last bars, given enough history."""
    cross = (F.col("macd_1") <= F.col("signal_1")) & (F.col("macd") > F.col("signal"))
    return (F.col("i") >= least - 1) & F.coalesce(F.max(cross).over(by_bar().rowsBetween(1 - window, 0)), F.lit(False))


def any_recent(flag: Column, window: int = 5) -> Column:
    return F.coalesce(F.max(F.coalesce(flag, F.lit(False))).over(by_bar().rowsBetween(1 - window, 0)), F.lit(False))


def ma_cross(short: str, long: str) -> Column:
    return F.coalesce((lag(short) < lag(long)) & (F.col(short) > F.col(long)), F.lit(False))
