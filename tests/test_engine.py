"""Indicators, rules, exits and metrics against a row-by-row version in pandas."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.rules import NEEDS_CROSS, PRESETS, require, rule
from barloom.functions.windows import with_ewm
from barloom.operators import surge, trades
from barloom.operators.exits import first_events, search_exits
from barloom.operators.indicators import indicator_frame, with_legacy_rsi
from barloom.sources.bars import normalise, positioned
from barloom.sources.strategy import QUANT, StrategyConfig, grid, load_strategy, load_strategy_or_none, parse_list, to_json


def walk(seed, n, ticker, drift=0.0, vol=0.03):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(drift, vol, n)))
    open_ = close * np.exp(rng.normal(0, vol / 2, n))
    high, low = np.maximum(open_, close) * (1 + rng.random(n) * vol), np.minimum(open_, close) * (1 - rng.random(n) * vol)
    volume = np.round(1000 * np.exp(rng.normal(0, 0.5, n)))
    df = pd.DataFrame({"ticker": ticker, "bar_ts": pd.date_range("2024-01-01", periods=n), "open": open_, "high": high, "low": low, "close": close, "volume": volume})
    return df.round({"open": 2, "high": 2, "low": 2, "close": 2})


@pytest.fixture(scope="module")
def data():
    flat = walk(9, 80, "FLAT")
    flat[["open", "high", "low", "close"]] = 50.0
    return {"A": walk(1, 150, "A", 0.004), "B": walk(2, 230, "B", -0.001, 0.05), "C": walk(3, 1300, "C", 0.001), "D": walk(4, 20, "D"), "FLAT": flat}


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = spark.createDataFrame(pd.concat(data.values(), ignore_index=True))
    return indicator_frame(positioned(normalise(rows))).cache()


def prepared(df):
    df = df.reset_index(drop=True).copy()
    c, h, l, v = df["close"], df["high"], df["low"], df["volume"]
    df["macd"] = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    df["signal"] = df["macd"].ewm(span=9, adjust=False).mean()
    df["gc"] = (df["macd"].shift(1) < df["signal"].shift(1)) & (df["macd"] > df["signal"])
    for n in (5, 20, 60):
        df[f"ma{n}"] = c.rolling(n).mean()
    df["vol20"] = v.rolling(20).mean()
    df["vol20_prev"] = df["vol20"].shift(1)
    df["high40"] = h.rolling(40).max()
    step = c.diff()
    gain, loss = step.clip(lower=0).rolling(14).mean(), -step.clip(upper=0).rolling(14).mean()
    df["rsi14"] = (100 - 100 / (1 + gain / loss.where(loss.abs() > 1e-12))).bfill()
    df["atr14"] = pd.concat([h - l, (h - c.shift()).abs(), (l - c.shift()).abs()], axis=1).max(axis=1).rolling(14).mean()
    return df


def fires(name, d, i, v):
    """A rule at bar i, by the definitions in words."""
    g = lambda c, k=0: d[c].iloc[i - k] if i - k >= 0 else math.nan
    hp = g("high40", 1)
    vol = g("volume") >= v * g("vol20_prev")
    stack = g("ma5") > g("ma20") > g("ma60")
    bull = g("macd") > g("signal") > 0
    dup = any(d["gc"].iloc[max(0, i - 5) : i])
    rng = max(g("high") - g("low"), 1e-9)
    o, c = g("open"), g("close")
    near = i >= 41 and not dup and c >= 0.95 * hp
    if name == "macd_gc":
        return True
    if name == "macd_ma_vol":
        return stack and g("volume") >= v * g("vol20")
    if name == "breakout40_slope":
        return i >= 41 and c > hp and g("macd") > g("macd", 1) and g("macd") > g("signal")
    if name == "macd_rsi65_gap3":
        return g("rsi14") <= 65 and (i + 1 >= len(d) or (c > 0 and d["open"].iloc[i + 1] / c <= 1.03))
    if name == "macd_nodup5_high95":
        return near
    if name == "ma2060_atr":
        return i >= 1 and g("ma20", 1) <= g("ma60", 1) and g("ma20") > g("ma60") and 0.015 <= g("atr14") / c <= 0.06
    if name == "strict_union":
        return g("macd") > 0 and vol and (near or g("rsi14") <= 65 or stack)
    if name == "trend_long_bull":
        body = c - o
        return body > 0 and body / rng >= 0.6 and ((g("close", 1) > 0 and body / g("close", 1) >= 0.03) or body >= g("atr14")) and g("ma20") > g("ma60") and bull and vol
    if name == "trend_ma_union":
        return i >= 1 and vol and stack and g("ma20") > g("ma20", 1) and g("ma60") > g("ma60", 1) and bull
    if name == "trend_breakout40_macd":
        return i >= 1 and vol and c > hp and g("macd") > g("macd", 1) and g("macd") > g("signal")
    if name == "trend_ma2060_vol":
        return i >= 2 and vol and all(g("ma20", k) > g("ma60", k) for k in range(3))
    if name == "trend_high95_macd":
        return vol and c >= 0.95 * hp and g("macd") > 0 and g("signal") > 0
    if name == "gc_today_vol":
        return vol
    if name == "breakout40_gc_today_vol":
        return i >= 41 and vol and c > hp and g("close", 1) <= g("high40", 2)
    return c >= 0.97 * hp and g("ma20") > g("ma60") and bull and vol and c > o and (c / o - 1 >= 0.02 or (c - g("low")) / rng >= 0.7)


def exit_at(d, e, stop, hold):
    peak = -math.inf
    for j in range(e, min(len(d) - 1, e + hold) + 1):
        r = d.iloc[j]
        peak = max(peak, r["high"])
        if r["low"] <= peak * (1 - stop):
            return j, min(r["open"], peak * (1 - stop)), "trailing_stop"
        if j > e and r["macd"] < r["signal"]:
            return j, r["close"], "dead_cross"
    return j, r["close"], "max_hold"


def test_indicators(frame, data):
    got = frame.toPandas()
    for t, raw in data.items():
        own, want = got[got["ticker"] == t].sort_values("i"), prepared(raw)
        for c in ("macd", "signal", "ma5", "ma20", "ma60", "vol20", "vol20_prev", "rsi14", "atr14"):
            np.testing.assert_allclose(own[c].astype(float), want[c], rtol=1e-9, atol=1e-9, err_msg=f"{t} {c}")
        np.testing.assert_allclose(own["high40_prev"].astype(float), want["high40"].shift(1))
        assert own["gc"].tolist() == want["gc"].tolist()


def test_smoothed_mean_of_a_long_series(spark):
    x = np.random.default_rng(5).normal(100, 5, 5000)
    df = spark.createDataFrame(pd.DataFrame({"ticker": "L", "i": range(5000), "x": x}))
    got = with_ewm(df, {"y": ("x", 26), "z": ("x", 3)}).orderBy("i").toPandas()
    np.testing.assert_allclose(got["y"], pd.Series(x).ewm(span=26, adjust=False).mean(), rtol=1e-12)
    np.testing.assert_allclose(got["z"], pd.Series(x).ewm(span=3, adjust=False).mean(), rtol=1e-12)


def test_rules_fire_where_the_definitions_say(frame, data):
    got = frame.select("ticker", "i", *[rule(p, 1.2).alias(p) for p in PRESETS]).toPandas()
    for t, raw in data.items():
        d, own = prepared(raw), got[got["ticker"] == t].sort_values("i")
        for p in PRESETS:
            want = [i for i in range(len(d)) if (p not in NEEDS_CROSS or d["gc"].iloc[i]) and bool(fires(p, d, i, 1.2))]
            assert np.flatnonzero(own[p].to_numpy()).tolist() == want, (t, p)


@pytest.mark.parametrize(("stop", "hold", "entry"), [(0.1, 20, "next_open"), (0.03, 7, "next_close")])
def test_trades_and_metrics(frame, data, stop, hold, entry):
    configs = [StrategyConfig(entry_set=p, stop_pct=stop, max_hold=hold, vol_mult=1.2, entry=entry, macd_zero_filter=z) for p in ("macd_gc", "trend_breakout40_macd") for z in (True, False)]
    found = trades.simulate(frame, configs).cache()
    got = {(r["config"], r["ticker"], r["i"]): r for r in found.collect()}
    want = {}
    for c in configs:
        for t, raw in data.items():
            d = prepared(raw)
            for i in range(len(d) - 2 if len(d) >= max(35, hold + 2) else 0):
                if (c.entry_set in NEEDS_CROSS and not d["gc"].iloc[i]) or (c.macd_zero_filter and d["macd"].iloc[i] <= 0) or not fires(c.entry_set, d, i, 1.2):
                    continue
                buy = d["open" if entry == "next_open" else "close"].iloc[i + 1]
                j, px, why = exit_at(d, i + 1, stop, hold)
                want[c.name, t, i] = (j, why, (px - buy) / buy - 0.001)
    assert got.keys() == want.keys() and len(want) > 50
    for k, (j, why, ret) in want.items():
        assert (got[k]["exit_i"], got[k]["reason"]) == (j, why)
        assert got[k]["ret"] == pytest.approx(ret)
    summary = {r["config"]: r for r in trades.evaluate_portfolio(found).collect()}
    for c in configs:
        r = [v[2] for k, v in sorted(want.items()) if k[0] == c.name]
        curve = np.cumprod(1 + np.array(r))
        s = summary[c.name]
        assert s["trade_count"] == len(r) == s["trailing_stop_count"] + s["dead_cross_count"] + s["max_hold_count"]
        assert s["max_drawdown_pct"] == pytest.approx(100 * (curve / np.maximum.accumulate(curve) - 1).min())
        assert s["cumulative_return_pct"] == pytest.approx(100 * (curve[-1] - 1))


def test_summary_of_two_instruments(spark):
    rows = [("c", "A", 1, 0, "trailing_stop", 0.05), ("c", "A", 1, 5, "dead_cross", -0.02), ("c", "B", 2, 3, "max_hold", 0.03)]
    found = spark.createDataFrame(rows, "config string, ticker string, ticker_ord long, i long, reason string, ret double")
    s = trades.evaluate_portfolio(found).first()
    assert (s["trade_count"], s["active_tickers"], s["trailing_stop_count"], s["dead_cross_count"], s["max_hold_count"]) == (3, 2, 1, 1, 1)
    assert s["profit_factor"] == pytest.approx(4.0)
    loss_first = spark.createDataFrame([("c", "A", 1, 0, "max_hold", -0.1), ("c", "A", 1, 1, "max_hold", 0.05)], found.schema)
    assert trades.evaluate_portfolio(loss_first).first()["max_drawdown_pct"] == 0


def test_exit_priority_gap_and_data_end(spark):
    bars = [(0, 100.0, 101.0, 99.0, 100.0, False), (1, 80.0, 82.0, 79.0, 81.0, True), (2, 100.0, 130.0, 99.0, 120.0, False)]
    df = spark.createDataFrame([(bars,)], "path array<struct<i:int,open:double,high:double,low:double,close:double,dead:boolean>>")
    x = df.select(trades.exit_of(F.col("path"), 0.1).alias("x")).first()["x"]
    assert (x["exit_i"], x["exit_price"], x["reason"]) == (1, 80.0, "trailing_stop")
    late = df.select(trades.exit_of(F.slice("path", 2, 2), 0.5).alias("x")).first()["x"]
    assert (late["exit_i"], late["reason"]) == (2, "max_hold")  # a dead cross on the entry bar does not count
    same_bar = df.select(trades.exit_of(F.slice("path", 3, 1), 0.2).alias("x")).first()["x"]
    assert (same_bar["exit_price"], same_bar["reason"]) == (100.0, "trailing_stop")  # below 0.8 * 130


def test_legacy_rsi(spark, data):
    rows = positioned(normalise(spark.createDataFrame(pd.concat([data["A"], data["FLAT"]], ignore_index=True))))
    got = with_legacy_rsi(rows).orderBy("ticker", "i").toPandas()
    c = data["A"]["close"].diff().fillna(0)
    gain, loss = c.clip(lower=0).rolling(14).mean(), -c.clip(upper=0).rolling(14).mean()
    np.testing.assert_allclose(got[got["ticker"] == "A"]["rsi_legacy"].astype(float), 100 - 100 / (1 + gain / loss), rtol=1e-9)
    assert got[got["ticker"] == "FLAT"]["rsi_legacy"].isna().all()


def test_configurations(tmp_path):
    assert require("macd_gc") == "true" and "trend_long_bull" not in NEEDS_CROSS and "strict_union" in NEEDS_CROSS and len(NEEDS_CROSS) == 7 and len(PRESETS) == 15
    with pytest.raises(ValueError):
        require("nothing")
    assert (QUANT.entry_set, QUANT.vol_mult, QUANT.stop_pct, QUANT.max_hold) == ("quant_surge_common", 1.2, 0.10, 15)
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"entry_set": "strict_union", "stop_pct": "0.12", "max_hold": 10, "vol_mult": 2, "entry": "next_open", "macd_zero_filter": False, "market": "KOSPI", "days": 180, "fee_bp": 1, "slip_bp": 2, "other": 3}))
    cfg = load_strategy(str(path))
    assert cfg.stop_pct == 0.12 and cfg.fee_bp == 1.0 and not cfg.macd_zero_filter and json.loads(to_json(cfg))["days"] == 180
    path.write_text("{nope")
    assert load_strategy_or_none(str(path)) is None and load_strategy_or_none(str(tmp_path / "none")) is None
    assert len(list(grid())) == 756 and next(iter(grid())).name == "macd_gc|stop=0.08|hold=10|vol=1.5|next_open|zero=1"
    assert parse_list("true, 0,YES", bool) == [True, False, True] and parse_list(" 1, 2 ", int) == [1, 2]
    with pytest.raises(ValueError):
        parse_list("maybe", bool)


def test_surge_features(frame):
    features = surge.feature_frame(frame).cache()
    pdf = features.where("valid").toPandas()
    lift = {(r["target"], r["feature"]): r for r in surge.feature_lift(features).collect()}
    assert len(lift) == 33
    for t in surge.TARGETS:
        pos, neg = pdf[pdf[t]], pdf[~pdf[t]]
        p = 100 * pos["macd_bull"].mean() if len(pos) else 0.0
        assert lift[t, "macd_bull"]["pos_rate_pct"] == pytest.approx(p, abs=0.0051)
        assert lift[t, "macd_bull"]["neg_rate_pct"] == pytest.approx(100 * neg["macd_bull"].mean(), abs=0.0051)
    doc = json.loads(surge.analysis_document(features).first()["json"])
    assert doc["sample_count"] == len(pdf) and len(doc["targets"]) == 3
    tail = features.where("ticker = 'A'").orderBy(F.desc("i")).first()
    assert tail["future_ret_5"] is None and not tail["ret5_ge_8"]


def test_empty_bars(spark, frame):
    assert trades.simulate(frame.limit(0), [QUANT]).count() == 0
    with pytest.raises(ValueError):
        normalise(spark.range(1))


def test_exits_of_long_holds_by_search():
    """Ranges of runs against a walk bar by bar, with missing values and gaps."""
    rng = np.random.default_rng(11)
    n = 3000
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.004, n)))
    high, low = close * (1 + rng.random(n) * 0.01), close * (1 - rng.random(n) * 0.01)
    high[rng.random(n) < 0.02], low[rng.random(n) < 0.02] = np.nan, np.nan
    for share in (0.0, 0.002, 0.2):
        dead = rng.random(n) < share
        for hold, stop in ((1, 0.01), (7, 0.02), (1000, 0.08), (1000, 0.2), (5000, 0.5)):
            entry = np.sort(rng.choice(n, 60, replace=False))
            entry[-1] = n - 1
            at, price, why = first_events(high, low, dead, entry, hold, stop)
            for k, e in enumerate(entry):
                peak, want = -math.inf, None
                for j in range(e, min(n - 1, e + hold) + 1):
                    peak = max(peak, -math.inf if np.isnan(high[j]) else high[j])
                    if low[j] <= peak * (1 - stop):
                        want = (j, peak * (1 - stop), 2)
                        break
                    if dead[j] and j > e:
                        want = (j, math.nan, 1)
                        break
                want = want or (min(n - 1, e + hold), math.nan, 0)
                assert (at[k], why[k]) == (want[0], want[2])
                assert np.isclose(price[k], want[1], equal_nan=True)


def test_exits_across_ranges(frame, data):
    wanted = frame.withColumn("fired", F.array(F.lit(0)))
    got = [{(r["ticker"], r["i"]): (r["exits"], r["ends"]) for r in search_exits(wanted, [0.05, 0.2], [3, 40], span).collect()} for span in (16, 4096)]
    assert got[0] == got[1] and len(got[0]) == sum(max(0, len(d) - 2) for d in data.values())


def test_curves_merge_in_any_grouping(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [("c", t, int(i), "max_hold", float(r)) for t in ("A", "B", "C") for i, r in enumerate(rng.normal(0, 0.05, 700)) if rng.random() < 0.7]
    found = spark.createDataFrame(rows, "config string, ticker string, i long, reason string, ret double").repartition(7)
    for segment, merged in ((256, 256), (3, 2), (1, 5)):
        monkeypatch.setattr(trades, "SEGMENT", segment)
        monkeypatch.setattr(trades, "MERGED", merged)
        s = trades.evaluate_portfolio(found).first()
        curve = np.cumprod(1 + np.array([r[4] for r in rows]))
        assert s["max_drawdown_pct"] == pytest.approx(100 * (curve / np.maximum.accumulate(curve) - 1).min())
        assert s["cumulative_return_pct"] == pytest.approx(100 * (curve[-1] - 1)) and s["active_tickers"] == 3
    assert "Window" not in trades.evaluate_portfolio(found)._jdf.queryExecution().executedPlan().toString()
