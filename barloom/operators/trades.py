"""Signals, exits, trades and their metrics.

An exit depends on the entry bar, the stop and the longest hold only; a signal on the rule,
the volume multiple and the zero-line filter only.  So a grid of configurations takes one
flag per rule variant and one search per stop up to the longest hold, from which the
shorter holds are read; configurations are expanded after the bars that nothing wants are
gone.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rules import rule
from barloom.operators.exits import search_exits
from barloom.sources.strategy import StrategyConfig


def least_history(max_hold: int) -> int:
    return max(35, max_hold + 2)


def signal_flag(entry_set: str, vol_mult: float, macd_zero_filter: bool) -> Column:
    """Where a rule fires, by its gates and predicate."""
    flag = rule(entry_set, vol_mult)
    return flag & ~F.coalesce(F.col("macd") <= 0, F.lit(False)) if macd_zero_filter else flag


def exit_of(path: Column, stop_pct: float) -> Column:
    """exit_i, exit_price and reason of an entry at the first bar of ``path``, an array of
    bars that is at hand; ``operators.exits`` finds the exits of a whole table.

    The peak takes in a bar's high before its low is tested; the stop comes before the dead
    cross, which does not count on the entry bar; a path's end is a maximum hold.
    """
    first = path[0]
    start = F.struct(F.lit(float("-inf")).alias("peak"), F.lit(False).alias("done"), first["i"].alias("exit_i"), first["close"].alias("exit_price"), F.lit("max_hold").alias("reason"))

    def step(state: Column, bar: Column) -> Column:
        peak = F.greatest(state["peak"], bar["high"])
        stop = peak * (1 - stop_pct)
        hit = bar["low"] <= stop
        cross = bar["dead"] & (bar["i"] > first["i"])
        price = F.when(hit, F.least(bar["open"], stop)).otherwise(bar["close"])
        reason = F.when(hit, "trailing_stop").when(cross, "dead_cross").otherwise("max_hold")
        moved = F.struct(peak.alias("peak"), (hit | cross).alias("done"), bar["i"].alias("exit_i"), price.alias("exit_price"), reason.alias("reason"))
        return F.when(state["done"], state).otherwise(moved)

    return F.aggregate(path, start, step)


def simulate(frame: DataFrame, configs: Iterable[StrategyConfig]) -> DataFrame:
    """One row per trade: config, ticker, i, entry_i, buy, exit_i, exit_price, reason, ret.
    Trades may overlap."""
    configs = list(configs)
    variants = sorted({(c.entry_set, float(c.vol_mult), c.macd_zero_filter) for c in configs})
    stops, holds = sorted({float(c.stop_pct) for c in configs}), sorted({c.max_hold for c in configs})
    # As many rows as the caller named configurations.
    rows = [(c.name, variants.index((c.entry_set, float(c.vol_mult), c.macd_zero_filter)), stops.index(float(c.stop_pct)), holds.index(c.max_hold), least_history(c.max_hold), c.entry, float(c.fee_bp + c.slip_bp)) for c in configs]
    table = F.broadcast(frame.sparkSession.createDataFrame(rows, "config string, variant int, stop int, hold int, least long, entry string, cost double"))
    fired = F.array(*(F.when(signal_flag(*v), F.lit(k)) for k, v in enumerate(variants)))
    bars = search_exits(frame.withColumn("fired", F.filter(fired, lambda x: x.isNotNull())), stops, holds)
    wanted = bars.select("*", F.explode("fired").alias("variant")).join(table, "variant").where(F.col("n") >= F.col("least"))
    x, ends = F.get("exits", F.col("stop")), F.get("ends", F.col("hold"))  # where a shorter hold ends
    early = x["exit_i"] <= ends["i"]
    ended = F.struct(ends["i"].alias("exit_i"), ends["close"].alias("exit_price"), F.lit("max_hold").alias("reason"))
    found = F.when(early, F.struct(x["exit_i"].alias("exit_i"), x["exit_price"].alias("exit_price"), x["reason"].alias("reason"))).otherwise(ended)
    buy = F.when(F.col("entry") == "next_open", F.col("next_open")).otherwise(F.col("next_close"))
    each = wanted.select("config", "ticker", "i", (F.col("i") + 1).alias("entry_i"), buy.alias("buy"), found.alias("x"), "cost")
    ret = (F.col("x.exit_price") - F.col("buy")) / F.col("buy") - F.col("cost") / 10000
    return each.select("config", "ticker", "i", "entry_i", "buy", "x.exit_i", "x.exit_price", "x.reason", ret.alias("ret"))


def equity_curve(trades: DataFrame) -> DataFrame:
    """Trades with curve, peak and drawdown of their configuration.

    The order is that of instruments by name and then of signals.  Products run within an
    instrument; what comes before it is carried from one row per instrument, so no window
    holds all trades of a configuration.
    """
    own = Window.partitionBy("config", "ticker").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.withColumn("local", F.product(1 + F.col("ret")).over(own)).withColumn("local_peak", F.max("local").over(own))
    per = rows.groupBy("config", "ticker").agg(F.product(1 + F.col("ret")).alias("whole"), F.max("local").alias("top"))
    before = Window.partitionBy("config").orderBy("ticker").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("level", F.coalesce(F.product("whole").over(before), F.lit(1.0))).withColumn("top", F.col("level") * F.col("top"))
    per = per.select("config", "ticker", "level", F.max("top").over(before).alias("peak_before"))
    rows = rows.join(per, ["config", "ticker"]).withColumn("curve", F.col("level") * F.col("local"))
    rows = rows.withColumn("peak", F.greatest("peak_before", F.col("level") * F.col("local_peak"))).withColumn("drawdown", F.col("curve") / F.col("peak") - 1)
    return rows.drop("local", "local_peak", "level", "peak_before")


#: Bars of an instrument in a segment, and segments that are merged at once.
SEGMENT, MERGED = 256, 256
_SUMS = ("trade_count", "wins", "total", "gross_profit", "gross_loss", "trailing_stop_count", "dead_cross_count", "max_hold_count")


def _fold(trades_of: Column) -> Column:
    """The curve of a segment's trades in order: its end, its highest and lowest point, and
    the worst ratio to the peak before."""
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(1.0).alias("curve"), none.alias("peak"), none.alias("low"), none.alias("fall"))

    def step(s: Column, x: Column) -> Column:
        curve = s["curve"] * (1 + x["ret"])
        peak = F.greatest(s["peak"], curve)
        return F.struct(curve.alias("curve"), peak.alias("peak"), F.least(s["low"], curve).alias("low"), F.least(s["fall"], curve / peak).alias("fall"))

    return F.aggregate(F.array_sort(trades_of), start, step)


def _merge(states: Column) -> Column:
    """The curve of segments one after another, each given by its own curve from 1 on: the
    merge is associative, so any grouping of neighbours gives the same."""
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(1.0).alias("curve"), none.alias("peak"), none.alias("low"), none.alias("fall"))

    def step(s: Column, x: Column) -> Column:
        x, level = x["state"], s["curve"]
        peak, low = F.greatest(s["peak"], level * x["peak"]), F.least(s["low"], level * x["low"])
        return F.struct((level * x["curve"]).alias("curve"), peak.alias("peak"), low.alias("low"), F.least(s["fall"], x["fall"], level * x["low"] / s["peak"]).alias("fall"))

    return F.aggregate(F.array_sort(states), start, step)


def _merged(states: DataFrame, keys: list[str], order: str, *more: Column) -> DataFrame:
    """States of neighbours merged by ``keys``, in the ``order`` of a column."""
    got = states.groupBy(*keys).agg(F.collect_list(F.struct(F.col(order).alias("at"), "state")).alias("states"), *(F.sum(c).alias(c) for c in _SUMS), *more)
    return got.withColumn("state", _merge(F.col("states"))).drop("states")


def _ticker_states(trades: DataFrame) -> DataFrame:
    """Sums and the curve's state per configuration and instrument, merged over a tree of
    segments, so that trades of one instrument are folded in many tasks.  Returns are above
    -1, so curves stay positive."""
    r = F.col("ret")
    part = F.floor(F.col("i") / SEGMENT)
    sums = [F.count("*").alias("trade_count"), F.count_if(r > 0).alias("wins"), F.sum(r).alias("total"), F.sum(F.when(r > 0, r).otherwise(0.0)).alias("gross_profit"), (-F.sum(F.when(r < 0, r).otherwise(0.0))).alias("gross_loss")]
    sums += [F.count_if(F.col("reason") == x).alias(f"{x}_count") for x in ("trailing_stop", "dead_cross", "max_hold")]
    # At most SEGMENT trades of a configuration and instrument.
    leaves = trades.groupBy("config", "ticker", part.alias("segment")).agg(F.collect_list(F.struct("i", "ret")).alias("trades"), *sums)
    leaves = leaves.withColumn("state", _fold(F.col("trades"))).drop("trades")
    joined = _merged(leaves.withColumn("branch", F.floor(F.col("segment") / MERGED)), ["config", "ticker", "branch"], "segment")
    return _merged(joined, ["config", "ticker"], "branch")


def _metrics(states: DataFrame, *keys: str) -> DataFrame:
    shown = [(100 * F.col("wins") / F.col("trade_count")).alias("win_rate_pct"), (100 * F.col("total") / F.col("trade_count")).alias("avg_trade_return_pct"), ((F.col("state.curve") - 1) * 100).alias("cumulative_return_pct")]
    shown += [((F.col("state.fall") - 1) * 100).alias("max_drawdown_pct"), F.expr("gross_profit / nullif(gross_loss, 0)").alias("profit_factor")]
    return states.select(*keys, "trade_count", "trailing_stop_count", "dead_cross_count", "max_hold_count", *shown)


def evaluate_tickers(trades: DataFrame) -> DataFrame:
    """Metrics per configuration and instrument; drawdown by the instrument's own curve."""
    return _metrics(_ticker_states(trades), "config", "ticker")


def score() -> Column:
    """The composite score, of unrounded inputs."""
    return F.col("cumulative_return_pct") + 2 * F.col("avg_trade_return_pct") + 0.15 * F.col("win_rate_pct") + 0.1 * F.least("trade_count", F.lit(50)) - 0.5 * F.abs("max_drawdown_pct")


def evaluate_portfolio(trades: DataFrame) -> DataFrame:
    """Metrics and score per configuration; configurations without trades have no row.  The
    curve runs over instruments by name; one state an instrument is merged in a row."""
    whole = _merged(_ticker_states(trades), ["config"], "ticker", F.count("*").alias("active_tickers"))
    return _metrics(whole, "config", "active_tickers").withColumn("score", score())


#: The fields of a summary, and the decimals of those that are rounded.
SUMMARY = ("market", "days", "entry_set", "entry", "macd_zero_filter", "vol_mult", "stop_pct", "max_hold", "fee_bp", "slip_bp", "active_tickers", "trade_count", "win_rate_pct", "avg_trade_return_pct", "cumulative_return_pct", "max_drawdown_pct", "profit_factor", "trailing_stop_count", "dead_cross_count", "max_hold_count", "score")
DECIMALS = {"win_rate_pct": 2, "avg_trade_return_pct": 2, "cumulative_return_pct": 2, "max_drawdown_pct": 2, "profit_factor": 3, "score": 2}


def summarise(evaluated: DataFrame, configs: DataFrame) -> DataFrame:
    """config, grid_ord and the summary's fields of every configuration with trades."""
    rows = configs.join(evaluated, "config")
    shown = [(F.round(c, DECIMALS[c]) + F.lit(0.0)).alias(c) if c in DECIMALS else F.col(c) for c in SUMMARY]
    return rows.select("config", "grid_ord", *shown)


def rank(evaluated: DataFrame, configs: DataFrame | None = None, min_trades: int = 8) -> DataFrame:
    """Configurations with enough trades, best first: score, cumulative return and profit
    factor, missing values last, ties in the order of the grid."""
    rows = evaluated.where(F.col("trade_count") >= min_trades)
    rows = rows if "grid_ord" in rows.columns else configs.join(rows, "config")
    return rows.orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("cumulative_return_pct"), F.desc_nulls_last("profit_factor"), "grid_ord")


def live_signals(frame: DataFrame, cfg: StrategyConfig, last_only: bool = True) -> DataFrame:
    """ticker, date, close where a rule fires on the last bar (or, for a look back, on any);
    the check of the next open is skipped for a bar that has none."""
    flag = (F.col("n") >= least_history(cfg.max_hold)) & rule(cfg.entry_set, cfg.vol_mult)
    if cfg.macd_zero_filter:
        flag = flag & ~F.coalesce(F.col("macd") <= 0, F.lit(False))
    rows = frame.where(F.col("i") == F.col("n") - 1) if last_only else frame
    return rows.where(flag).select("ticker", "i", F.date_format("bar_ts", "yyyy-MM-dd").alias("date"), "close")
