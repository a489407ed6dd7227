"""Which features of a bar go with a large rise in the bars after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import roll
from barloom.operators import trades
from barloom.operators.reports import named
from barloom.sources.strategy import StrategyConfig, config_table

#: Features and their conditions.
FEATURES = {
    "near_high95": "close >= 0.95 * high40_prev",
    "breakout40": "close > high40_prev",
    "ma20_gt_60": "ma20 > ma60",
    "ma5_gt_20_gt_60": "ma5 > ma20 AND ma20 > ma60",
    "macd_bull": "macd > signal AND signal > 0",
    "vol_1_2": "volume >= 1.2 * vol20_prev",
    "vol_1_5": "volume >= 1.5 * vol20_prev",
    "body_pos_2": "close / open - 1 >= 0.02",
    "close_upper70": "(close - low) / nullif(high - low, 0) >= 0.7",
    "atr_ok": "atr14 / close >= 0.01 AND atr14 / close <= 0.08",
    "rsi_55_75": "rsi14 >= 55 AND rsi14 <= 75",
}
#: Targets, by bars ahead and rise.
TARGETS = {"ret5_ge_8": ("future_ret_5", 0.08), "ret10_ge_12": ("future_ret_10", 0.12), "ret10_ge_15": ("future_ret_10", 0.15)}
VALID = "high40_prev IS NOT NULL AND ma60 IS NOT NULL AND vol20_prev IS NOT NULL AND atr14 IS NOT NULL"


def feature_frame(frame: DataFrame) -> DataFrame:
    """ticker, i, both forward returns, the features, the targets and ``valid``.

    Bars whose future is too short have no forward return and count as negatives.
    """
    df = frame.withColumns({f"future_ret_{h}": roll(F.max, "close", 1, h) / F.col("close") - 1 for h in (5, 10)})
    flags = [F.expr(f"coalesce({sql}, false)").alias(name) for name, sql in FEATURES.items()]
    targets = [F.coalesce(F.col(c) >= least, F.lit(False)).alias(name) for name, (c, least) in TARGETS.items()]
    return df.select("ticker", "i", "future_ret_5", "future_ret_10", *flags, *targets, F.expr(VALID).alias("valid"))


def feature_lift(features: DataFrame) -> DataFrame:
    """target, feature, pos_rate_pct, neg_rate_pct, lift: one aggregate over valid bars.

    A side without bars has rate 0.
    """
    rate = lambda f, t, side: F.coalesce(F.avg(F.when(F.col(t) == side, F.col(f).cast("double"))), F.lit(0.0)) * 100
    pairs = [(t, f) for t in TARGETS for f in FEATURES]
    one = features.where("valid").agg(F.array(*(F.struct(F.lit(t).alias("target"), F.lit(f).alias("feature"), rate(f, t, True).alias("pos"), rate(f, t, False).alias("neg")) for t, f in pairs)).alias("all"))
    rows = one.select(F.explode("all").alias("r")).select("r.*")
    return rows.select("target", "feature", F.round("pos", 2).alias("pos_rate_pct"), F.round("neg", 2).alias("neg_rate_pct"), F.round((F.col("pos") + 1e-9) / (F.col("neg") + 1e-9), 3).alias("lift"))


def sample_rates(features: DataFrame) -> DataFrame:
    """sample_count and the share of positive bars for each target."""
    rates = [F.round(F.coalesce(F.avg(F.col(t).cast("double")), F.lit(0.0)) * 100, 2).alias(f"{t}_pct") for t in TARGETS]
    return features.where("valid").agg(F.count("*").alias("sample_count"), *rates)


#: Names of the targets in an analysis file.
TARGET_NAMES = {"ret5_ge_8": "surge_5_8", "ret10_ge_12": "surge_10_12", "ret10_ge_15": "surge_10_15"}


def analysis_document(features: DataFrame, validation: DataFrame | None = None) -> DataFrame:
    """The whole analysis as one JSON document (column ``json``): sample_count, per target
    its positive rate and the features' lifts in the order of FEATURES, and the strategy's
    check (``validation``, one row)."""
    lift = F.struct(F.array_position(F.array(*map(F.lit, FEATURES)), F.col("feature")).alias("order"), "feature", "pos_rate_pct", "neg_rate_pct", "lift")
    per = feature_lift(features).groupBy("target").agg(F.sort_array(F.collect_list(lift)).alias("lifts"))  # 11 rows each
    per = per.select("target", F.transform("lifts", lambda x: F.struct(x["feature"].alias("feature"), x["pos_rate_pct"].alias("pos_rate_pct"), x["neg_rate_pct"].alias("neg_rate_pct"), x["lift"].alias("lift"))).alias("lifts"))
    lifts = per.agg(F.map_from_entries(F.collect_list(F.struct("target", "lifts"))).alias("lifts"))
    one = sample_rates(features).crossJoin(lifts)  # one row each
    targets = F.struct(*(F.struct(F.col(f"{t}_pct").alias("positive_rate_pct"), F.element_at("lifts", t).alias("feature_lift")).alias(name) for t, name in TARGET_NAMES.items()))
    parts = [F.col("sample_count"), targets.alias("targets")]
    if validation is not None:
        one = one.crossJoin(validation.select(F.struct("*").alias("check")))
        parts.append(F.col("check").alias("quant_surge_validation"))
    return one.select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("json"))


def strategy_validation(frame: DataFrame, cfg: StrategyConfig, names: DataFrame | None = None) -> DataFrame:
    """One row: the strategy, its summary (null without trades) and the names of the
    instruments where it fires on the last bar."""
    spark = frame.sparkSession
    configs = config_table(spark, [cfg])
    summary = trades.summarise(trades.evaluate_portfolio(trades.simulate(frame, [cfg])), configs).agg(F.first(F.struct(*trades.SUMMARY)).alias("backtest"))
    # One day's signals.
    live = named(trades.live_signals(frame, cfg), names).agg(F.sort_array(F.collect_list("name")).alias("live_candidates"))
    strategy = configs.select(F.struct("entry_set", "stop_pct", "max_hold", "vol_mult", "entry", "macd_zero_filter", "market", "days", "fee_bp", "slip_bp", F.lit(cfg.score).cast("double").alias("score")).alias("strategy"))
    return strategy.crossJoin(summary).crossJoin(live)  # one row each
