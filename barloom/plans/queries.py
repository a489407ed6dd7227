"""All queries over bars: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.ranges import positioned_by_days
from barloom.functions.rules import PRESETS, rule
from barloom.functions.tables import register, register_messages
from barloom.operators import reports, scanners, surge, trades
from barloom.operators.indicators import any_recent, indicator_frame, ma_cross, ranged_frame, recent_cross, with_legacy_rsi, with_macd, with_rsi
from barloom.operators.scanners import FLAGS, FUNNEL
from barloom.plans import sql
from barloom.sources import tickers
from barloom.sources.bars import bars_from_events, event_bars, normalise, positioned, read_bars
from barloom.sources.daily import read_daily
from barloom.sources.store import shared_folder, write_store
from barloom.sources.strategy import QUANT, StrategyConfig, config_table, grid, parse_strategies
from barloom.streaming.last_bar import current, latest_indicators, latest_rules, run_latest

Query = Callable[[SparkSession, str], DataFrame]
VOL_MULT = 1.5
MIN_TRADES = 8
_BASE = {"vol_mult": VOL_MULT, "macd_zero_filter": False, "stop_pct": 0.10, "max_hold": 20}
CONFIGS = {
    "next_open": [StrategyConfig(entry_set=p, entry="next_open", **_BASE) for p in PRESETS],
    "next_close": [StrategyConfig(entry_set=p, entry="next_close", **_BASE) for p in PRESETS],
    "grid": list(grid()),  # the whole default grid
}
LIVE = StrategyConfig(entry_set="breakout40_slope", **_BASE)
ORACLE_SQL = sql.oracle(CONFIGS, VOL_MULT, LIVE, MIN_TRADES)


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def _rounded(*names: str) -> list[Column]:
    return [_r(n).alias(n) for n in names]


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicator_frame(event_bars(spark, sf_dir))


def _on(make: Callable[[DataFrame], DataFrame], *columns: str, digits: bool = False) -> Query:
    """A query over the bars alone: only what it needs is computed."""
    return lambda spark, sf_dir: make(event_bars(spark, sf_dir)).select("ticker", "i", *(_rounded(*columns) if digits else columns))


def _bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(spark, sf_dir).select("ticker", "bar_ts", "i", "open", "high", "low", "close", "volume")


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_events(spark.read.parquet(f"{sf_dir}/events.parquet")).agg(F.max("bar_ts").alias("latest"))


def _preset(name: str) -> Query:
    return lambda spark, sf_dir: _frame(spark, sf_dir).where((F.col("i") < F.col("n") - 2) & rule(name, VOL_MULT)).select("ticker", "i", "close")


def _trades(which: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = trades.simulate(_frame(spark, sf_dir), CONFIGS[which])
        return rows.select("config", "ticker", "i", "entry_i", F.round("buy", 6).alias("buy"), "exit_i", F.round("exit_price", 6).alias("exit_price"), "reason", _r("ret").alias("ret"))

    return run


def _simulated(spark: SparkSession, sf_dir: str, which: str = "next_open") -> DataFrame:
    return trades.simulate(_frame(spark, sf_dir), CONFIGS[which])


def _exit_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simulated(spark, sf_dir).groupBy("config", "reason").agg(F.count("*").alias("n"))


_METRICS = ("win_rate_pct", "avg_trade_return_pct", "cumulative_return_pct", "max_drawdown_pct", "profit_factor")
_COUNTS = ("trade_count", "trailing_stop_count", "dead_cross_count", "max_hold_count")


def _eval_per_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.evaluate_tickers(_simulated(spark, sf_dir)).select("config", "ticker", *_COUNTS, *_rounded(*_METRICS))


def _eval_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.evaluate_portfolio(_simulated(spark, sf_dir)).select("config", "active_tickers", *_COUNTS, *_rounded(*_METRICS), _r("score", 4).alias("score"))


def _equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.equity_curve(_simulated(spark, sf_dir)).select("config", "ticker", "i", F.round("curve", 6).alias("curve"), F.round("peak", 6).alias("peak"), _r("drawdown").alias("drawdown"))


def _grid_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default grid, and how many instruments have bars enough for each of its holds."""
    sizes = bars_from_events(spark.read.parquet(f"{sf_dir}/events.parquet")).groupBy("ticker").agg(F.count("*").alias("n"))
    holds = sorted({c.max_hold for c in CONFIGS["grid"]})
    fit = sizes.agg(*(F.count_if(F.col("n") >= trades.least_history(h)).alias(str(h)) for h in holds))
    fit = fit.select(F.explode(F.create_map(*(x for h in holds for x in (F.lit(h), F.col(f"`{h}`"))))).alias("max_hold", "instruments"))
    return config_table(spark, CONFIGS["grid"]).join(fit, "max_hold")


def _members_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members on every day with orders, of lists that are dated twice a month."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    dated = orders.where(F.dayofmonth("day").isin(3, 9)).groupBy(F.col("day").alias("date"), F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("ticker")).agg(F.min("o_orderkey").alias("ord"))
    return tickers.members_by_day(dated, orders.select("day"), _strict(spark, sf_dir))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by rounded keys, so that equal results keep the grid's order on any engine."""
    done = trades.evaluate_portfolio(_simulated(spark, sf_dir, "grid"))
    done = done.withColumns({c: _r(c, 4) for c in ("score", "cumulative_return_pct", "profit_factor")})
    return trades.rank(done, config_table(spark, CONFIGS["grid"]).select("config", "grid_ord"), MIN_TRADES)


def _grid_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.posexplode(F.col("rows")).alias("pos", "row")
    # One row per configuration: as many as the grid was given.
    rows = _ranked(spark, sf_dir).withColumn("key", F.struct(-F.col("score"), -F.col("cumulative_return_pct"), F.col("profit_factor").isNull(), -F.col("profit_factor"), "grid_ord"))
    return rows.agg(F.sort_array(F.collect_list(F.struct("key", "config", "trade_count", "score"))).alias("rows")).select(place).select("row.config", (F.col("pos") + 1).cast("long").alias("place"), "row.trade_count", "row.score")


def _grid_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).limit(1).select("config", F.lit(1).cast("long").alias("place"), "trade_count", "score")


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.live_signals(_frame(spark, sf_dir), LIVE, last_only=False)


def _selection_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.selection_log(scanners.hits(scanners.diagnose(_frame(spark, sf_dir)), "breakout", last_only=False), "breakout")


def _surge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surge.feature_frame(_frame(spark, sf_dir))


def _scan(name: str) -> Query:
    return lambda spark, sf_dir: scanners.hits(scanners.diagnose(_frame(spark, sf_dir)), name, last_only=False)


def _diag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanners.diagnostic_counts(scanners.diagnose(_frame(spark, sf_dir)), "ticker").select("ticker", *FLAGS)


def _funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanners.funnel(_frame(spark, sf_dir))


def _funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _funnel(spark, sf_dir).agg(F.count("*").alias("scanned"), *(F.count_if(f).alias(f) for f in FUNNEL))


def _top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = _funnel(spark, sf_dir).where("funnel_volume_pass")
    return scanners.top_picks(hit, "ticker").select("ticker", "i", _r("vol_ratio").alias("vol_ratio"), F.col("place").cast("long").alias("place"))


def _script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanners.script_flags(_frame(spark, sf_dir)).where("script_final").select("ticker", "i", "close")


def _raw_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" "), "p_size", F.lit(".0"))).when(F.col("p_partkey") % 4 == 1, (F.col("p_size") * 7).cast("string")).when(F.col("p_partkey") % 4 == 2, F.col("p_brand"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(code.alias("code"), "p_partkey")


def _strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickers.strict_tickers(_raw_codes(spark, sf_dir), "p_partkey")


def _lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickers.lenient_tickers(_raw_codes(spark, sf_dir), "p_partkey").select("ticker", "name", "ord")


def _strategy_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.named(trades.live_signals(_frame(spark, sf_dir), QUANT, last_only=False), None)
    days = event_bars(spark, sf_dir).select(F.date_format("bar_ts", "yyyy-MM-dd").alias("date"))
    return reports.daily_sections("Quant", QUANT, found, days)


def _message_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.message_chunks(_strategy_section(spark, sf_dir).select(F.concat(F.lit("quant "), "date").alias("ident"), "text"))


def _picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = reports.named(_funnel(spark, sf_dir).where("funnel_volume_pass"), None).withColumn("market", F.lit("KOSPI"))
    return reports.pick_messages(scanners.top_picks(hit, "market"))


def _pick_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.message_batches(_picks(spark, sf_dir).select(F.col("market").alias("ident"), "place", "message"))


def _analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _frame(spark, sf_dir)
    return surge.analysis_document(surge.feature_frame(frame), surge.strategy_validation(frame, QUANT))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = trades.evaluate_portfolio(_simulated(spark, sf_dir))
    done = done.withColumns({c: _r(c, 9) for c in trades.DECIMALS})  # ties of the last digit alike on any engine
    return trades.summarise(done, config_table(spark, CONFIGS["next_open"])).drop("grid_ord")


def _last_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = scanners.diagnose(_frame(spark, sf_dir))
    last = flagged.where(F.col("i") == F.col("n") - 1)
    return last.select("ticker", "i", "bar_ts", "close", *FLAGS)


def _last_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule on every instrument's last bar, where the next open is not known."""
    frame = _frame(spark, sf_dir)
    fires = [F.when(F.col("n") >= trades.least_history(LIVE.max_hold), rule(p, VOL_MULT)).otherwise(False).alias(p) for p in PRESETS]
    return frame.where(F.col("i") == F.col("n") - 1).select("ticker", "i", F.date_format("bar_ts", "yyyy-MM-dd").alias("date"), "close", *fires)


def _nonfinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over bars with planted NaN and infinite values."""
    bars = event_bars(spark, sf_dir).withColumns({
        "volume": F.when(F.col("i") % 23 == 7, float("nan")).otherwise(F.col("volume")),
        "open": F.when(F.col("i") % 29 == 3, float("inf")).when(F.col("i") % 29 == 11, float("nan")).otherwise(F.col("open")),
        "high": F.when(F.col("i") % 211 == 5, float("-inf")).otherwise(F.col("high")),
    })
    frame = indicator_frame(positioned(normalise(bars)))
    fired = F.explode(F.array_compact(F.array(*(F.when(rule(p, VOL_MULT), F.lit(p)) for p in PRESETS))))
    return frame.where(F.col("i") < F.col("n") - 2).select("ticker", "i", fired.alias("rule"))


def _scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan_report(scanners.diagnose(_frame(spark, sf_dir)), source="events", run_at="2024-01-01 00:00:00 UTC")


def _ranged_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positioned_by_days(bars_from_events(spark.read.parquet(f"{sf_dir}/events.parquet")))


def _ranged(*columns: str) -> Query:
    return lambda spark, sf_dir: ranged_frame(_ranged_bars(spark, sf_dir)).select("ticker", "i", *_rounded(*columns))


def _ranged_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over ranges: one row per rule that fires."""
    fired = F.explode(F.array_compact(F.array(*(F.when(rule(p, VOL_MULT), F.lit(p)) for p in PRESETS))))
    return ranged_frame(_ranged_bars(spark, sf_dir)).where(F.col("i") < F.col("n") - 2).select("ticker", "i", fired.alias("rule"))


def _ranged_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanners.diagnostic_counts(ranged_frame(_ranged_bars(spark, sf_dir), scanners.diagnose), "ticker").select("ticker", *FLAGS)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/bars-{uuid.uuid4().hex}"


def _stream_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars arrive in two steps, the later ones after the stream was stopped."""
    folder = _own_folder(spark)
    bars_from_events(spark.read.parquet(f"{sf_dir}/events.parquet")).write.parquet(f"{folder}/all")
    bars = spark.read.parquet(f"{folder}/all")
    first, last = bars.agg(F.min("bar_ts"), F.max("bar_ts")).first()
    if first is not None:
        cut = F.lit(first + (last - first) * 0.8).cast("timestamp_ntz")
        for part in (F.col("bar_ts") <= cut, F.col("bar_ts") > cut):
            bars.where(part).write.mode("append").parquet(f"{folder}/in")
            latest = latest_indicators(spark.readStream.schema(bars.schema).parquet(f"{folder}/in"))
            run_latest(latest, f"{folder}/out", f"{folder}/state").awaitTermination()
        found = current(spark, f"{folder}/out")
    else:
        found = indicator_frame(positioned(bars))
    return latest_rules(found, VOL_MULT, LIVE.max_hold).select("ticker", "i", F.date_format("bar_ts", "yyyy-MM-dd").alias("date"), "close", *PRESETS)


def _stored_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MACD over a bucketed table: no shuffle after the table is written."""
    folder = _own_folder(spark)
    bars = bars_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return with_macd(positioned(write_store(bars, f"bars_{uuid.uuid4().hex}", folder, buckets=16))).select("ticker", "i", *_rounded("macd", "signal"))


def _bar_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten days of two instruments up to a date, or the last one with bars, from a table of
    bars under their foreign names."""
    folder = _own_folder(spark)
    bars = bars_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    named = bars.withColumnsRenamed({"bar_ts": "날짜", "open": "시가", "high": "고가", "low": "저가", "close": "종가", "volume": "거래량"})
    named.repartitionByRange("ticker").sortWithinPartitions("ticker", "날짜").write.parquet(folder)
    wanted = spark.createDataFrame([("click",), ("view",)], "ticker string")
    return read_bars(spark, folder, wanted, end="2024-01-25", days=10)


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by scanner and all stage counts, of one job over all bars."""
    folder = _own_folder(spark)
    found, seen = scanners.observed_hits(scanners.diagnose(_frame(spark, sf_dir)), last_only=False)
    found.write.parquet(folder)
    counts = spark.createDataFrame([(k, v) for k, v in seen.get.items()], "name string, n long")  # 15 numbers
    return counts.unionByName(spark.read.parquet(folder).groupBy(F.concat("scanner", F.lit("_hits")).alias("name")).agg(F.count("*").alias("n")))


def _strategy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategies, partial and broken ones among them, one for each part."""
    texts = [
        F.format_string('{"entry_set": "strict_union", "max_hold": %d, "stop_pct": 0.05}', "p_size"),
        F.format_string('{"max_hold": "%d", "macd_zero_filter": false}', "p_size"),
        F.format_string('{"entry_set": "%s"}', "p_brand"),
        F.format_string('{"macd_zero_filter": "%s"}', "p_type"),
        F.format_string('{"days": %d', "p_size"),
        F.concat(F.lit('{"vol_mult": '), "p_retailprice", F.lit(', "note": [1]}')),
    ]
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.coalesce(*(F.when(F.col("p_partkey") % len(texts) == k, t) for k, t in enumerate(texts)))
    return parse_strategies(parts.select(F.col("p_partkey").cast("string").alias("path"), text.alias("json")))


def _daily_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per instrument and day, some of them empty or broken: all bars, and a reason
    for each bad file."""
    folder = _own_folder(spark)
    bars = bars_from_events(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("day", F.to_date("bar_ts"))
    line = F.concat_ws(",", *(F.col(c).cast("string") for c in ("bar_ts", "open", "high", "low", "close", "volume")))
    lines = bars.groupBy("ticker", "day").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bar_ts", line.alias("line")))), lambda x: x["line"]), "\n").alias("rows"))  # a day's bars
    head = "날짜,시가,고가,저가,종가,거래량"
    date = F.dayofmonth("day")
    text = F.when(date == 7, "no bars").when(date == 14, head).when(date == 21, "").when(date == 25, f"{head}\n2024-01-01 00:00:00,1,1,1,x,1").otherwise(F.concat(F.lit(head + "\n"), "rows"))
    lines.select("ticker", "day", text.alias("value")).write.partitionBy("ticker", "day").text(folder)
    return read_daily(spark, folder).drop("path")


def _sql_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _frame(spark, sf_dir)
    register(spark, frame.schema)
    return spark.sql("SELECT ticker, i, close FROM {f} WHERE i < n - 2 AND fires('strict_union', :v, struct(*))", {"v": VOL_MULT}, f=frame)


def _sql_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _frame(spark, sf_dir)
    register(spark, frame.schema)
    return spark.sql("SELECT ticker, i, explode(rules) AS rule FROM (SELECT ticker, i, fired_rules(:v, struct(*)) AS rules FROM {f} WHERE i < n - 2)", {"v": VOL_MULT}, f=frame)


def _sql_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_messages(spark)
    sections = _strategy_section(spark, sf_dir).select(F.concat(F.lit("quant "), "date").alias("ident"), "text")
    return spark.sql("SELECT * FROM split_message(TABLE({m}), 3500)", m=sections)


def _sql_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's sections, in batches by month."""
    register_messages(spark)
    items = _strategy_section(spark, sf_dir).select(F.substring("date", 1, 7).alias("ident"), F.col("date").alias("place"), F.col("text").alias("message"))
    return spark.sql("SELECT * FROM batch_messages(TABLE({m}), 3000)", m=items)


def _candle(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"body_pct": F.col("close") / F.col("open") - 1, "close_pos": (F.col("close") - F.col("low")) / F.expr("nullif(high - low, 0)")})


_all = ("ticker", "i")

QUERIES: dict[str, Query] = {
    "bars_hourly": _bars_hourly,
    "ind_ema12_26": _on(with_macd, "ema12", "ema26", digits=True),
    "ind_macd_signal": _on(with_macd, "macd", "signal", digits=True),
    "ind_gc_strict": _on(lambda b: with_macd(b).withColumnRenamed("gc", "flag"), "flag"),
    "ind_gc_recent5": _on(lambda b: with_macd(b).withColumn("flag", recent_cross()), "flag"),
    "ind_gc_positive": _on(lambda b: with_macd(b).withColumn("flag", any_recent(F.col("gc") & (F.col("macd") > 0))), "flag"),
    "ind_ma": _on(indicator_frame, "ma5", "ma10", "ma20", "ma60", digits=True),
    "ind_ma_cross": _on(lambda b: indicator_frame(b).withColumns({"c1": ma_cross("ma5", "ma20"), "c2": ma_cross("ma20", "ma60")}).withColumns({"x5_20": any_recent(F.col("c1")), "x20_60": any_recent(F.col("c2"))}), "x5_20", "x20_60"),
    "ind_volume": _on(indicator_frame, "vol20", "vol20_prev", digits=True),
    "ind_high40": _on(indicator_frame, "high40_prev", "high40_prev2", "high60_prev", digits=True),
    "ind_rsi_engine": _on(with_rsi, "rsi14", digits=True),
    "ind_rsi_causal": _on(lambda b: with_rsi(b, backfill=False), "rsi14", digits=True),
    "ind_rsi_legacy": _on(with_legacy_rsi, "rsi_legacy", digits=True),
    "ind_tr_atr": _on(indicator_frame, "tr", "atr14", digits=True),
    "ind_forward_returns": lambda spark, sf_dir: _surge(spark, sf_dir).select(*_all, *_rounded("future_ret_5", "future_ret_10")),
    "ind_gc_prev5": _on(indicator_frame, "gc_prev5"),
    "feat_candle": _on(_candle, "body_pct", "close_pos", digits=True),
    "latest_data_date": _latest,
    **{f"preset_{p}": _preset(p) for p in PRESETS},
    "live_signals": _live,
    "trades_next_open": _trades("next_open"),
    "trades_next_close": _trades("next_close"),
    "exit_reasons": _exit_reasons,
    "eval_per_ticker": _eval_per_ticker,
    "eval_portfolio": _eval_portfolio,
    "equity_drawdown": _equity,
    "grid_configs": _grid_configs,
    "grid_ranking": _grid_ranking,
    "grid_best": _grid_best,
    "surge_labels": lambda spark, sf_dir: _surge(spark, sf_dir).select(*_all, *surge.TARGETS, "valid"),
    "surge_feature_frame": lambda spark, sf_dir: _surge(spark, sf_dir).select(*_all, *surge.FEATURES, "valid"),
    "surge_feature_lift": lambda spark, sf_dir: surge.feature_lift(_surge(spark, sf_dir)),
    "surge_sample_rates": lambda spark, sf_dir: surge.sample_rates(_surge(spark, sf_dir)),
    "surge_analysis_json": _analysis,
    "scan_breakout": _scan("breakout"),
    "scan_trend": _scan("trend"),
    "scan_power": _scan("power"),
    "scan_diag_counts": _diag_counts,
    "scan_legacy_funnel": lambda spark, sf_dir: _funnel(spark, sf_dir).select(*_all, *FUNNEL, "green"),
    "scan_legacy_counts": _funnel_counts,
    "scan_legacy_top5": _top5,
    "scan_script": _script,
    "tickers_strict": _strict,
    "tickers_lenient": _lenient,
    "members_by_day": _members_by_day,
    "selection_log": _selection_log,
    "strategy_section": _strategy_section,
    "message_chunks": _message_chunks,
    "pick_messages": _picks,
    "pick_batches": _pick_batches,
    "strategy_summary": _summary,
    "scan_last_bar": _last_hits,
    "rules_last_bar": _last_signals,
    "preset_nonfinite": _nonfinite,
    "scan_report": _scan_report,
    "stream_rules_last_bar": _stream_rules,
    "stored_macd_signal": _stored_macd,
    "bar_scan": _bar_scan,
    "strategy_files": _strategy_files,
    "scan_observed": _observed,
    "daily_file_scan": _daily_files,
    "sql_preset_strict_union": _sql_preset,
    "sql_fired_rules": _sql_rules,
    "sql_message_chunks": _sql_chunks,
    "sql_section_batches": _sql_batches,
    "ranged_macd_signal": _ranged("macd", "signal"),
    "ranged_ma": _ranged("ma5", "ma10", "ma20", "ma60"),
    "ranged_rsi_engine": _ranged("rsi14"),
    "ranged_rules": _ranged_rules,
    "ranged_diag_counts": _ranged_diag,
}
