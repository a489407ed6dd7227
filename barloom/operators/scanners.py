"""Daily scanners: stage flags at every bar, their counts, and the last bar's hits.

Flags hold for every bar as if it were the last, so a scan of one day filters on it and a
look back reads them all.  Stages of the trend, power and funnel scans are cumulative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from barloom.functions.windows import by_bar
from barloom.operators.indicators import any_recent, ma_cross, recent_cross, with_legacy_rsi

#: Thresholds of the scanners.
BREAKOUT_WIN, TREND_VOL, TREND_ATR, POWER_VOL, POWER_CANDLE, POWER_WIN = 40, 1.3, (0.01, 0.08), 2.0, 0.02, 60


def has_bars(n: int) -> Column:
    return F.col("i") >= n - 1


def volume_spike(multiple: float) -> Column:
    return has_bars(21) & (F.col("vol20_prev") > 0) & (F.col("volume") >= multiple * F.col("vol20_prev"))


def _flags(**stages: Column) -> dict[str, Column]:
    return {name: F.coalesce(c, F.lit(False)) for name, c in stages.items()}


def _cumulative(prefix: str, **stages: Column) -> dict[str, Column]:
    out, so_far = {}, F.lit(True)
    for name, c in stages.items():
        so_far = so_far & F.coalesce(c, F.lit(False))
        out[f"{prefix}_{name}"] = so_far
    return out | {f"{prefix}_final": so_far}


def breakout_flags() -> dict[str, Column]:
    """The two conditions are tested independently of each other."""
    first_day = (F.col("close") > F.col("high40_prev")) & (F.col("close_1") <= F.col("high40_prev2"))
    ok = has_bars(BREAKOUT_WIN + 3)
    f = _flags(breakout_len_ok=ok, breakout_breakout_ok=ok & first_day, breakout_macd_ok=ok & recent_cross())
    return f | {"breakout_final": f["breakout_breakout_ok"] & f["breakout_macd_ok"]}


def trend_flags() -> dict[str, Column]:
    ratio = F.col("atr14") / F.col("close")
    return _cumulative("trend", len_ok=has_bars(60), vol_ok=volume_spike(TREND_VOL), ma_ok=F.col("ma20") > F.col("ma60"), atr_ok=(F.col("close") > 0) & ratio.between(*TREND_ATR))


def power_flags() -> dict[str, Column]:
    candle = (F.col("open") > 0) & (F.col("close") > F.col("open")) & (F.col("close") / F.col("open") - 1 >= POWER_CANDLE)
    return _cumulative("power", len_ok=has_bars(POWER_WIN + 2), vol_ok=volume_spike(POWER_VOL), candle_ok=candle, breakout_ok=F.col("close") > F.col("high60_prev"))


def diagnose(frame: DataFrame) -> DataFrame:
    """All stage flags of the three daily scanners, for every bar."""
    return frame.withColumns(breakout_flags() | trend_flags() | power_flags())


FLAGS = ("breakout_len_ok", "breakout_breakout_ok", "breakout_macd_ok", "breakout_final", "trend_len_ok", "trend_vol_ok", "trend_ma_ok", "trend_atr_ok", "trend_final", "power_len_ok", "power_vol_ok", "power_candle_ok", "power_breakout_ok", "power_final")


def diagnostic_counts(diagnosed: DataFrame, *by: str) -> DataFrame:
    """How many bars reach each stage."""
    return diagnosed.groupBy(*by).agg(*(F.count_if(f).alias(f) for f in FLAGS))


def hits(diagnosed: DataFrame, scanner: str, last_only: bool = True) -> DataFrame:
    """ticker, i, bar_ts, close of a scanner's hits: on the last bar, or on any."""
    rows = diagnosed.where(F.col(f"{scanner}_final"))
    rows = rows.where(F.col("i") == F.col("n") - 1) if last_only else rows
    return rows.select("ticker", "i", "bar_ts", "close")


def observed_hits(diagnosed: DataFrame, last_only: bool = True) -> tuple[DataFrame, Observation]:
    """scanner, ticker, i, bar_ts, close of all scanners' hits, and the counts of bars and
    of each stage, which the job that writes the hits takes on its way.

    Counts are there (``Observation.get``) once an action on the hits is over.  They are
    taken behind the last shuffle, where each task's result is counted once.
    """
    rows = diagnosed.where(F.col("i") == F.col("n") - 1) if last_only else diagnosed
    seen = Observation("stages")
    rows = rows.observe(seen, F.count("*").alias("bars"), *(F.count_if(f).alias(f) for f in FLAGS))
    fired = F.explode(F.array_compact(F.array(*(F.when(F.col(f"{s}_final"), F.lit(s)) for s in ("breakout", "trend", "power")))))
    return rows.select(fired.alias("scanner"), "ticker", "i", "bar_ts", "close"), seen


def funnel(frame: DataFrame) -> DataFrame:
    """Cumulative stages of the legacy funnel, its volume ratio and rsi, for every bar."""
    df = with_legacy_rsi(frame)
    green = F.sum((F.col("close") > F.col("open")).cast("int")).over(by_bar().rowsBetween(-39, 0))
    df = df.withColumns({"green": green, "box_high": F.max("high").over(by_bar().rowsBetween(-60, -1)), "vol_ratio": F.when(F.col("vol20") > 0, F.col("volume") / F.col("vol20")).otherwise(0.0)})
    return df.withColumns(_cumulative(
        "funnel", enough_data=has_bars(120), trend_pass=(F.col("ma10") > F.col("ma20")) & (F.col("ma20") > F.col("ma60")) & (F.col("rsi_legacy") >= 50), green_pass=F.col("green") >= 18,
        breakout_pass=(F.col("close") > F.col("box_high")) & (F.col("close") < 1.15 * F.col("box_high")), volume_pass=F.col("vol_ratio") >= 1.3,
    ))


FUNNEL = ("funnel_enough_data", "funnel_trend_pass", "funnel_green_pass", "funnel_breakout_pass", "funnel_volume_pass")


def top_picks(candidates: DataFrame, by: str, k: int = 5) -> DataFrame:
    """The k candidates of each ``by`` with the largest volume ratio, ties in order of names.

    A limit by window: Spark keeps k rows a task before it shuffles.
    """
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("vol_ratio").desc(), "ticker", "i"))
    return candidates.withColumn("place", place).where(F.col("place") <= k)


def script_flags(frame: DataFrame) -> DataFrame:
    """Golden cross above zero and a crossing of averages in the last 5 bars, on volume
    above 1.5 times the mean of the 20 bars before."""
    crossed = frame.withColumns({"x5_20": ma_cross("ma5", "ma20"), "x20_60": ma_cross("ma20", "ma60"), "gc_positive": F.col("gc") & (F.col("macd") > 0)})
    both = has_bars(60) & any_recent(F.col("gc_positive")) & (any_recent(F.col("x5_20")) | any_recent(F.col("x20_60")))
    return crossed.withColumn("script_final", F.coalesce(both & (F.col("volume") > 1.5 * F.col("vol20_prev")), F.lit(False)))
