"""The queries as DuckDB SQL over the same tables."""

from __future__ import annotations

import json

from barloom.functions.rules import NEEDS_CROSS, PRESETS, rule_sql
from barloom.operators.reports import SCANNERS
from barloom.operators.scanners import FLAGS, FUNNEL
from barloom.operators.surge import FEATURES, TARGET_NAMES, TARGETS, VALID
from barloom.operators.trades import DECIMALS, SUMMARY
from barloom.sources.strategy import QUANT, StrategyConfig

BARS = """
st AS (SELECT event_type, event_id, ts, value, avg(ln(1+value)) OVER (PARTITION BY event_type) AS mu, stddev_pop(ln(1+value)) OVER (PARTITION BY event_type) AS sd FROM events),
px AS (SELECT event_type, event_id, ts, value, round(100*exp(sum(0.01*((ln(1+value)-mu)/sd)) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 2) AS price FROM st),
b0 AS (SELECT event_type AS ticker, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bar_ts, min_by(price, {'t': ts, 'e': event_id}) AS open, max(price) AS high, min(price) AS low,
              max_by(price, {'t': ts, 'e': event_id}) AS close, round(sum(value), 2) AS volume FROM px GROUP BY 1, 2),
bars AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY bar_ts) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n, dense_rank() OVER (ORDER BY ticker) AS ticker_ord FROM b0)"""


def _ewm(c: str, span: int) -> str:
    a = 2.0 / (span + 1)
    return f"pow({1 - a!r}::DOUBLE, i) * sum({c} * pow({1 - a!r}::DOUBLE, -i) * CASE WHEN i = 0 THEN 1.0 ELSE {a!r}::DOUBLE END) OVER (PARTITION BY ticker ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _roll(agg: str, c: str, first: int, last: int) -> str:
    side = lambda k: f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}" if k else "CURRENT ROW"
    frame = f"OVER (PARTITION BY ticker ORDER BY i ROWS BETWEEN {side(first)} AND {side(last)})"
    return f"CASE WHEN count({c}) {frame} = {last - first + 1} THEN {agg}({c}) {frame} END"


_W = "OVER (PARTITION BY ticker ORDER BY i)"

FRAME = (
    BARS
    + f""",
e1 AS (SELECT *, {_ewm('close', 12)} AS ema12, {_ewm('close', 26)} AS ema26, lag(close) {_W} AS close_1, lead(open) {_W} AS next_open, lead(close) {_W} AS next_close FROM bars),
e2 AS (SELECT *, ema12 - ema26 AS macd FROM e1),
e3 AS (SELECT *, {_ewm('macd', 9)} AS signal FROM e2),
e4 AS (SELECT *, lag(macd) {_W} AS macd_1, lag(signal) {_W} AS signal_1, CASE WHEN close - close_1 > 0 THEN close - close_1 WHEN close_1 IS NOT NULL THEN 0.0 END AS gain,
       CASE WHEN close - close_1 < 0 THEN close_1 - close WHEN close_1 IS NOT NULL THEN 0.0 END AS loss, greatest(high - low, abs(high - close_1), abs(low - close_1)) AS tr FROM e3),
e5 AS (SELECT *, coalesce(macd_1 < signal_1 AND macd > signal, false) AS gc, {_roll('avg', 'gain', -13, 0)} AS ag, {_roll('avg', 'loss', -13, 0)} AS al,
       {_roll('avg', 'coalesce(gain, 0.0)', -13, 0)} AS lg, {_roll('avg', 'coalesce(loss, 0.0)', -13, 0)} AS ll, {_roll('avg', 'tr', -13, 0)} AS atr14,
       {_roll('avg', 'close', -4, 0)} AS ma5, {_roll('avg', 'close', -9, 0)} AS ma10, {_roll('avg', 'close', -19, 0)} AS ma20, {_roll('avg', 'close', -59, 0)} AS ma60,
       {_roll('avg', 'volume', -19, 0)} AS vol20, {_roll('avg', 'volume', -20, -1)} AS vol20_prev,
       {_roll('max', 'high', -40, -1)} AS high40_prev, {_roll('max', 'high', -41, -2)} AS high40_prev2, {_roll('max', 'high', -60, -1)} AS high60_prev FROM e4),
e6 AS (SELECT *, 100 - 100 / (1 + ag / nullif(al, 0)) AS rsi_own, CASE WHEN lg = 0 AND ll = 0 THEN NULL WHEN ll = 0 THEN 100.0 ELSE 100 - 100 / (1 + lg / ll) END AS rsi_legacy,
       lag(ma5) {_W} AS ma5_1, lag(ma20) {_W} AS ma20_1, lag(ma20, 2) {_W} AS ma20_2, lag(ma60) {_W} AS ma60_1, lag(ma60, 2) {_W} AS ma60_2,
       coalesce(max(gc::INT) OVER (PARTITION BY ticker ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS gc_prev5 FROM e5),
ind AS (SELECT *, first_value(rsi_own IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rsi14 FROM e6)"""
)

_LAST5 = "OVER (PARTITION BY ticker ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
_RECENT = f"(i >= 34 AND coalesce(max((macd_1 <= signal_1 AND macd > signal)::INT) {_LAST5}, 0) = 1)"
_X520, _X2060 = "coalesce(ma5_1 < ma20_1 AND ma5 > ma20, false)", "coalesce(ma20_1 < ma60_1 AND ma20 > ma60, false)"
_SPIKE = "(i >= 20 AND vol20_prev > 0 AND volume >= {m} * vol20_prev)"


def select(columns: dict[str, str] | list[str], where: str = "true", source: str = "ind", more: str = "") -> str:
    named = columns if isinstance(columns, dict) else {c: c for c in columns}
    return f"WITH {FRAME}{more} SELECT {', '.join(f'{sql} AS {name}' for name, sql in named.items())} FROM {source} WHERE {where}"


def rounded(*names: str) -> dict[str, str]:
    return {n: f"round({n}, 6) + 0.0" for n in names}


_AT = {"ticker": "ticker", "i": "i"}


def trades(configs: list[StrategyConfig]) -> str:
    """CTE ``trades`` of the configurations, by a range join and a running peak: signals per
    rule variant, exits per stop and hold, and the configurations that combine them."""
    variants = sorted({(c.entry_set, float(c.vol_mult), c.macd_zero_filter) for c in configs})
    fired = " UNION ALL ".join(f"SELECT {k} AS variant, ticker, ticker_ord, i, n, next_open, next_close FROM ind WHERE i < n - 2 AND {rule_sql(name, v)}" + (" AND NOT coalesce(macd <= 0, false)" if zero else "") for k, (name, v, zero) in enumerate(variants))
    listed = ", ".join(f"('{c.name}', {variants.index((c.entry_set, float(c.vol_mult), c.macd_zero_filter))}, {float(c.stop_pct)}::DOUBLE, {c.max_hold}, {max(35, c.max_hold + 2)}, '{c.entry}', {float(c.fee_bp + c.slip_bp)}::DOUBLE)" for c in configs)
    return f""",
fired AS MATERIALIZED ({fired}),
cfg(config, variant, stop, hold, least_n, entry, cost) AS (VALUES {listed}),
sg AS (SELECT config, ticker, ticker_ord, i, CASE WHEN entry = 'next_open' THEN next_open ELSE next_close END AS buy, stop, hold, cost FROM fired JOIN cfg USING (variant) WHERE n >= least_n),
wanted AS (SELECT DISTINCT ticker, i, stop, hold FROM sg),
path AS (SELECT s.ticker, s.i, s.stop, s.hold, b.i AS j, b.open, b.low, b.close, b.macd, b.signal,
         max(b.high) OVER (PARTITION BY s.ticker, s.i, s.stop, s.hold ORDER BY b.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * (1 - s.stop) AS lvl, max(b.i) OVER (PARTITION BY s.ticker, s.i, s.stop, s.hold) AS last_j
         FROM wanted s JOIN ind b ON b.ticker = s.ticker AND b.i BETWEEN s.i + 1 AND s.i + 1 + s.hold),
ev AS (SELECT *, CASE WHEN low <= lvl THEN 'trailing_stop' WHEN j > i + 1 AND macd < signal THEN 'dead_cross' WHEN j = last_j THEN 'max_hold' END AS reason, CASE WHEN low <= lvl THEN least(open, lvl) ELSE close END AS px FROM path),
ex AS (SELECT ticker, i, stop, hold, min(j) AS exit_i, min_by(px, j) AS exit_price, min_by(reason, j) AS reason FROM ev WHERE reason IS NOT NULL GROUP BY ALL),
trades AS (SELECT config, ticker, ticker_ord, i, i + 1 AS entry_i, buy, exit_i, exit_price, reason, (exit_price - buy) / buy - cost / 10000 AS ret FROM sg JOIN ex USING (ticker, i, stop, hold))"""


_METRICS = """count(*) AS trade_count, avg((ret > 0)::INT::DOUBLE) * 100 AS win_rate_pct, avg(ret) * 100 AS avg_trade_return_pct, (product(1 + ret) - 1) * 100 AS cumulative_return_pct,
 count(*) FILTER (WHERE reason = 'trailing_stop') AS trailing_stop_count, count(*) FILTER (WHERE reason = 'dead_cross') AS dead_cross_count, count(*) FILTER (WHERE reason = 'max_hold') AS max_hold_count,
 min(drawdown) * 100 AS max_drawdown_pct, sum(CASE WHEN ret > 0 THEN ret ELSE 0.0 END) / nullif(-sum(CASE WHEN ret < 0 THEN ret ELSE 0.0 END), 0) AS profit_factor"""
_SHOWN = "trade_count, trailing_stop_count, dead_cross_count, max_hold_count, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("win_rate_pct", "avg_trade_return_pct", "cumulative_return_pct", "max_drawdown_pct", "profit_factor"))


def _curve(by: str, order: str) -> str:
    frame = f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f", c1 AS (SELECT *, product(1 + ret) {frame} AS curve FROM trades), c2 AS (SELECT *, max(curve) {frame} AS peak, curve / max(curve) {frame} - 1 AS drawdown FROM c1)"


def evaluation(configs: list[StrategyConfig], by_ticker: bool) -> str:
    if by_ticker:
        return f"WITH {FRAME}{trades(configs)}{_curve('config, ticker', 'i')} SELECT config, ticker, {_SHOWN} FROM (SELECT config, ticker, {_METRICS} FROM c2 GROUP BY config, ticker)"
    return f"WITH {FRAME}{trades(configs)}{_curve('config', 'ticker_ord, i')}, m AS (SELECT config, count(DISTINCT ticker) AS active_tickers, {_METRICS} FROM c2 GROUP BY config) SELECT config, active_tickers, {_SHOWN}, round({_SCORE}, 4) + 0.0 AS score FROM m"


_SCORE = "cumulative_return_pct + 2 * avg_trade_return_pct + 0.15 * win_rate_pct + 0.1 * least(trade_count, 50) - 0.5 * abs(max_drawdown_pct)"


def ranking(configs: list[StrategyConfig], min_trades: int, best: bool) -> str:
    names = ", ".join(f"('{c.name}', {k})" for k, c in enumerate(configs))
    rows = f"WITH {FRAME}{trades(configs)}{_curve('config', 'ticker_ord, i')}, m AS (SELECT config, count(DISTINCT ticker) AS active_tickers, {_METRICS} FROM c2 GROUP BY config), g(config, grid_ord) AS (VALUES {names}), s AS (SELECT m.*, {_SCORE} AS raw, grid_ord FROM m JOIN g USING (config) WHERE trade_count >= {min_trades})"
    place = "row_number() OVER (ORDER BY round(raw, 4) DESC, round(cumulative_return_pct, 4) DESC, round(profit_factor, 4) DESC NULLS LAST, grid_ord)"
    return rows + f" SELECT config, {place} AS place, trade_count, round(raw, 4) + 0.0 AS score FROM s" + (f" QUALIFY {place} = 1" if best else "")


def _diag() -> str:
    first_day = "coalesce(close > high40_prev AND close_1 <= high40_prev2, false)"
    t = ["i >= 59", _SPIKE.format(m=1.3), "ma20 > ma60", "close > 0 AND atr14 / close >= 0.01 AND atr14 / close <= 0.08"]
    p = ["i >= 61", _SPIKE.format(m=2.0), "open > 0 AND close > open AND close / open - 1 >= 0.02", "close > high60_prev"]
    all_of = lambda xs: " AND ".join(f"coalesce({x}, false)" for x in xs)
    values = ["i >= 42", f"i >= 42 AND {first_day}", f"i >= 42 AND {_RECENT}", f"i >= 42 AND {first_day} AND {_RECENT}", *(all_of(t[:k]) for k in (1, 2, 3, 4, 4)), *(all_of(p[:k]) for k in (1, 2, 3, 4, 4))]
    return ", diag AS (SELECT *, " + ", ".join(f"({v}) AS {f}" for f, v in zip(FLAGS, values, strict=True)) + " FROM ind)"


DIAG = _diag()


def _funnel() -> str:
    stages = ["i >= 119", "ma10 > ma20 AND ma20 > ma60 AND rsi_legacy >= 50", "green >= 18", "close > box_high AND close < 1.15 * box_high", "vol_ratio >= 1.3"]
    flags = ", ".join("(" + " AND ".join(f"coalesce({x}, false)" for x in stages[: k + 1]) + f") AS {f}" for k, f in enumerate(FUNNEL))
    return f""", f0 AS (SELECT *, sum((close > open)::INT) OVER (PARTITION BY ticker ORDER BY i ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS green, max(high) OVER (PARTITION BY ticker ORDER BY i ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS box_high,
 CASE WHEN vol20 > 0 THEN volume / vol20 ELSE 0.0 END AS vol_ratio FROM ind), fun AS (SELECT *, {flags} FROM f0)"""


FUN = _funnel()
_SURGE = (
    f", s0 AS (SELECT *, ({_roll('max', 'close', 1, 5)}) / close - 1 AS future_ret_5, ({_roll('max', 'close', 1, 10)}) / close - 1 AS future_ret_10 FROM ind), sf AS (SELECT ticker, i, future_ret_5, future_ret_10, "
    + ", ".join([f"coalesce({sql}, false) AS {f}" for f, sql in FEATURES.items()] + [f"coalesce({c} >= {v}, false) AS {t}" for t, (c, v) in TARGETS.items()])
    + f", {VALID} AS valid FROM s0)"
)


_LIFT = "SELECT target, feature, round(p, 2) AS pos_rate_pct, round(q, 2) AS neg_rate_pct, round((p + 1e-9) / (q + 1e-9), 3) AS lift FROM r"


def _lift_rows() -> str:
    rows = []
    for t in TARGETS:
        for f in FEATURES:
            rows.append(f"SELECT '{t}' AS target, '{f}' AS feature, coalesce(avg({f}::INT::DOUBLE) FILTER (WHERE {t}), 0.0) * 100 AS p, coalesce(avg({f}::INT::DOUBLE) FILTER (WHERE NOT {t}), 0.0) * 100 AS q FROM sf WHERE valid")
    return " UNION ALL ".join(rows)


def _lift() -> str:
    return f"WITH {FRAME}{_SURGE}, r AS ({_lift_rows()}) {_LIFT}"


def preset(name: str, vol_mult: float) -> str:
    return select({**_AT, "close": "close"}, f"i < n - 2 AND {rule_sql(name, vol_mult)}")


def indicator_queries() -> dict[str, str]:
    flag = lambda sql: {**_AT, "flag": sql}
    return {
        "bars_hourly": f"WITH {BARS} SELECT ticker, bar_ts, i, open, high, low, close, volume FROM bars",
        "ind_ema12_26": select(_AT | rounded("ema12", "ema26")),
        "ind_macd_signal": select(_AT | rounded("macd", "signal")),
        "ind_gc_strict": select(flag("gc")),
        "ind_gc_recent5": select(flag(_RECENT)),
        "ind_gc_positive": select(flag(f"coalesce(max((gc AND macd > 0)::INT) {_LAST5}, 0) = 1")),
        "ind_ma": select(_AT | rounded("ma5", "ma10", "ma20", "ma60")),
        "ind_ma_cross": select(_AT | {"x5_20": f"max({_X520}::INT) {_LAST5} = 1", "x20_60": f"max({_X2060}::INT) {_LAST5} = 1"}),
        "ind_volume": select(_AT | rounded("vol20", "vol20_prev")),
        "ind_high40": select(_AT | rounded("high40_prev", "high40_prev2", "high60_prev")),
        "ind_rsi_engine": select(_AT | rounded("rsi14")),
        "ind_rsi_causal": select(_AT | {"rsi14": "round(rsi_own, 6) + 0.0"}),
        "ind_rsi_legacy": select(_AT | rounded("rsi_legacy")),
        "ind_tr_atr": select(_AT | rounded("tr", "atr14")),
        "ind_forward_returns": select(_AT | rounded("future_ret_5", "future_ret_10"), source="sf", more=_SURGE),
        "ind_gc_prev5": select(_AT | {"gc_prev5": "gc_prev5"}),
        "feat_candle": select(_AT | {"body_pct": "round(close / open - 1, 6) + 0.0", "close_pos": "round((close - low) / nullif(high - low, 0), 6) + 0.0"}),
        "latest_data_date": f"WITH {BARS} SELECT max(bar_ts) AS latest FROM bars",
    }


def reports_sql(quant: StrategyConfig, cfgs: list[StrategyConfig]) -> dict[str, str]:
    """Texts and tables of the reports."""
    head = f"[Quant] {quant.entry_set}\nentry={quant.entry} stop={quant.stop_pct} hold={quant.max_hold} vol={quant.vol_mult}\n\n"
    fires = f"n >= {max(35, quant.max_hold + 2)} AND {rule_sql(quant.entry_set, quant.vol_mult)}"
    sections = f"""WITH {FRAME}, q AS (SELECT strftime(bar_ts, '%Y-%m-%d') AS date, CASE WHEN {fires} THEN format('{{}} ({{}}) close={{:.0f}}', ticker, ticker, round(close)) END AS line FROM ind),
s AS (SELECT date, '{head}' || coalesce(string_agg(line, '\n' ORDER BY line), 'No signal today.') AS text FROM q GROUP BY date)"""
    money = lambda x: f"format('{{:,}}', CAST({x} AS BIGINT))"
    picks = f"""WITH {FRAME}{FUN}, p AS (SELECT *, row_number() OVER (ORDER BY vol_ratio DESC, ticker_ord, i) AS place FROM fun WHERE funnel_volume_pass QUALIFY place <= 5),
m AS (SELECT 'KOSPI' AS market, CAST(place AS INTEGER) AS place, concat_ws('\n', ticker || ' (' || ticker || ')', {money('round(close)')} || '원', format('x{{:.1f}} / RSI {{:.0f}}', round(vol_ratio, 1), round(rsi_legacy)), {money('floor(ma60)')} || ' / ' || {money('floor(ma20)')}, 'https://m.stock.naver.com/domestic/stock/' || ticker || '/total') AS message FROM p)"""
    axes = {"entry_set": [c.entry_set for c in cfgs], "stop_pct": [c.stop_pct for c in cfgs], "max_hold": [c.max_hold for c in cfgs], "vol_mult": [c.vol_mult for c in cfgs], "entry": [c.entry for c in cfgs], "zero": [c.macd_zero_filter for c in cfgs]}
    lists = {k: list(dict.fromkeys(v)) for k, v in axes.items()}
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)
    tables = " CROSS JOIN ".join(f"(VALUES {', '.join(f'({text(v)}, {k})' for k, v in enumerate(vs))}) AS t_{name}({name}, {name}_ord)" for name, vs in lists.items())
    place = "0"
    for name, vs in lists.items():
        place = f"({place} * {len(vs)} + {name}_ord)"
    grid = f"""WITH {BARS}, sizes AS (SELECT count(*) AS n FROM bars GROUP BY ticker)
SELECT (SELECT count(*) FROM sizes WHERE n >= greatest(35, max_hold + 2)) AS instruments, format('{{}}|stop={{:g}}|hold={{}}|vol={{:g}}|{{}}|zero={{}}', entry_set, stop_pct::DOUBLE, max_hold, vol_mult::DOUBLE, entry, zero::INT) AS config, CAST({place} AS BIGINT) AS grid_ord, entry_set, stop_pct::DOUBLE AS stop_pct, max_hold, vol_mult::DOUBLE AS vol_mult, entry, zero AS macd_zero_filter,
 '{cfgs[0].market}' AS market, {cfgs[0].days} AS days, {cfgs[0].fee_bp}::DOUBLE AS fee_bp, {cfgs[0].slip_bp}::DOUBLE AS slip_bp FROM {tables}"""
    return {
        "strategy_section": sections + " SELECT date, text FROM s",
        # No section of these tables is longer than a message.
        "message_chunks": sections + " SELECT 'quant ' || date AS ident, 0 AS chunk, text FROM s WHERE length(text) <= 3500",
        "sql_section_batches": sections.replace("WITH", "WITH RECURSIVE", 1) + """,
it AS (SELECT date[:7] AS ident, text AS m, row_number() OVER (PARTITION BY date[:7] ORDER BY date) AS k FROM s),
r AS (SELECT ident, k, m, 0 AS chunk, length(m) + 2 AS size FROM it WHERE k = 1
  UNION ALL SELECT it.ident, it.k, it.m, CASE WHEN size + length(it.m) > 3000 THEN chunk + 1 ELSE chunk END, CASE WHEN size + length(it.m) > 3000 THEN 0 ELSE size END + length(it.m) + 2 FROM r JOIN it ON it.ident = r.ident AND it.k = r.k + 1)
SELECT ident, chunk, string_agg(m || '\n\n', '' ORDER BY k) AS text FROM r GROUP BY ident, chunk""",
        "pick_messages": picks + " SELECT market, place, message FROM m",
        "pick_batches": picks + " SELECT market AS ident, 0 AS chunk, string_agg(message || '\n\n', '' ORDER BY place) AS text FROM m GROUP BY market HAVING sum(length(message) + 2) <= 3000",
        "grid_configs": grid,
    }


def scan_report() -> str:
    """The report of the last bars as one text."""
    stages = {s: [f.removeprefix(f"{s}_") for f in FLAGS if f.startswith(f"{s}_")] for s in SCANNERS}
    line = "'- ' || ticker || ' (' || ticker || ') | ' || format('{:,}', CAST(round_even(close, 0) AS BIGINT))"
    lines = ", ".join(f"string_agg({line}, '\n' ORDER BY {line}) FILTER (WHERE {s}_final) AS {s}_lines" for s in SCANNERS)
    counts = ", ".join(f"count(*) FILTER (WHERE {f}) AS {f}" for f in FLAGS)
    sections = " || ".join(f"coalesce('[{title}]\n' || {s}_lines || '\n\n', '')" for s, title in SCANNERS.items())
    nothing = f"CASE WHEN coalesce({', '.join(f'{s}_lines' for s in SCANNERS)}) IS NULL THEN 'Nothing passed today.\n\n' ELSE '' END"
    summary = " || ".join(["'[SUMMARY]\ninstruments=' || instruments", *(f"'\n{s}=' || {s}_final" for s in SCANNERS)])
    diag = [f"'[DIAG - {s.title()}]' || " + " || ".join(f"'\n{x}=' || {s}_{x}" for x in xs) for s, xs in stages.items()]
    text = f"'Daily scan\n- run: 2024-01-01 00:00:00 UTC\n- instruments: events\n- data of: ' || coalesce(latest, 'N/A') || '\n\n' || {sections} || {nothing} || concat_ws('\n\n', {', '.join([summary, *diag])})"
    return f"WITH {FRAME}{DIAG}, one AS (SELECT {lines}, {counts}, count(*) AS instruments, strftime(max(bar_ts), '%Y%m%d') AS latest FROM diag WHERE i = n - 1) SELECT {text} AS text FROM one"


def _number(x: str) -> str:
    """A double as JSON writes it: from 10 million on with an exponent."""
    digits = f"rtrim(replace(({x})::VARCHAR, '.', ''), '0')"
    return f"CASE WHEN abs({x}) >= 1e7 THEN left({digits}, 1) || '.' || coalesce(nullif(substr({digits}, 2), ''), '0') || 'E' || (strpos(({x})::VARCHAR, '.') - 2) ELSE coalesce(({x})::VARCHAR, 'null') END"


def surge_analysis(cfg: StrategyConfig) -> str:
    """The analysis of rises and the strategy's check as one JSON text."""
    order = ", ".join(f"('{f}', {k})" for k, f in enumerate(FEATURES))
    lifts = f"SELECT target, string_agg('{{\"feature\":\"' || feature || '\",\"pos_rate_pct\":' || {_number('pos_rate_pct')} || ',\"neg_rate_pct\":' || {_number('neg_rate_pct')} || ',\"lift\":' || {_number('lift')} || '}}', ',' ORDER BY k) AS rows FROM lift JOIN (VALUES {order}) AS o(feature, k) USING (feature) GROUP BY target"
    rates = ", ".join(f"round(coalesce(avg({t}::INT::DOUBLE), 0.0) * 100, 2) AS {t}" for t in TARGETS)
    target = lambda t: f"'\"{TARGET_NAMES[t]}\":{{\"positive_rate_pct\":' || {_number(t)} || ',\"feature_lift\":[' || (SELECT rows FROM lifts WHERE target = '{t}') || ']}}'"
    known = {"market", "days", "entry_set", "entry", "macd_zero_filter", "vol_mult", "stop_pct", "max_hold", "fee_bp", "slip_bp"}
    shown = lambda f: f"'\"{f}\":' || " + (f"'{json.dumps(getattr(cfg, f))}'" if f in known else _number(f"round({_SCORE if f == 'score' else f}, {DECIMALS[f]}) + 0.0") if f in DECIMALS else f)
    strategy = json.dumps({f: getattr(cfg, f) for f in ("entry_set", "stop_pct", "max_hold", "vol_mult", "entry", "macd_zero_filter", "market", "days", "fee_bp", "slip_bp", "score")}, separators=(",", ":"))
    backtest = " || ',' || ".join(shown(f) for f in SUMMARY)
    fires = f"i = n - 1 AND n >= {max(35, cfg.max_hold + 2)} AND {rule_sql(cfg.entry_set, cfg.vol_mult)}"
    return f"""WITH {FRAME}{_SURGE}{trades([cfg])}{_curve('config', 'ticker_ord, i')}, m AS (SELECT count(DISTINCT ticker) AS active_tickers, {_METRICS} FROM c2 GROUP BY config),
r AS ({_lift_rows()}), lift AS ({_LIFT}), lifts AS ({lifts}), rates AS (SELECT count(*) AS sample_count, {rates} FROM sf WHERE valid), live AS (SELECT string_agg('"' || ticker || '"', ',' ORDER BY ticker) AS names FROM ind WHERE {fires})
SELECT '{{"sample_count":' || sample_count || ',"targets":{{' || concat_ws(',', {', '.join(target(t) for t in TARGETS)}) || '}},"quant_surge_validation":{{"strategy":{strategy},"backtest":' || coalesce((SELECT '{{' || {backtest} || '}}' FROM m), 'null') || ',"live_candidates":[' || coalesce(names, '') || ']}}}}' AS json FROM rates, live"""


def oracle(configs: dict[str, list[StrategyConfig]], vol_mult: float, live: StrategyConfig, min_trades: int) -> dict[str, str]:
    out = indicator_queries() | {f"preset_{p}": preset(p, vol_mult) for p in PRESETS}
    assert NEEDS_CROSS <= set(PRESETS)
    for key in ("next_open", "next_close"):
        out[f"trades_{key}"] = f"WITH {FRAME}{trades(configs[key])} SELECT config, ticker, i, entry_i, round(buy, 6) AS buy, exit_i, round(exit_price, 6) AS exit_price, reason, round(ret, 6) + 0.0 AS ret FROM trades"
    full = configs["next_open"]
    out["exit_reasons"] = f"WITH {FRAME}{trades(full)} SELECT config, reason, count(*) AS n FROM trades GROUP BY 1, 2"
    out["eval_per_ticker"], out["eval_portfolio"] = evaluation(full, True), evaluation(full, False)
    out["equity_drawdown"] = f"WITH {FRAME}{trades(full)}{_curve('config', 'ticker_ord, i')} SELECT config, ticker, i, round(curve, 6) AS curve, round(peak, 6) AS peak, round(drawdown, 6) + 0.0 AS drawdown FROM c2"
    out["grid_ranking"], out["grid_best"] = ranking(configs["grid"], min_trades, False), ranking(configs["grid"], min_trades, True)
    fires = f"n >= {max(35, live.max_hold + 2)} AND {rule_sql(live.entry_set, live.vol_mult)}"
    out["live_signals"] = select({**_AT, "date": "strftime(bar_ts, '%Y-%m-%d')", "close": "close"}, fires)
    out["selection_log"] = select({"date": "strftime(bar_ts, '%Y-%m-%d')", "ticker": "ticker", "method": "'breakout'", "close": "format('{:.2f}', close)"}, "breakout_final", "diag", DIAG)
    names = ", ".join(f"('{c.name}', '{c.market}', {c.days}, '{c.entry_set}', '{c.entry}', {str(c.macd_zero_filter).lower()}, {float(c.vol_mult)}::DOUBLE, {float(c.stop_pct)}::DOUBLE, {c.max_hold}, {float(c.fee_bp)}::DOUBLE, {float(c.slip_bp)}::DOUBLE)" for c in full)
    shown = ", ".join(f"round(round({c}, 9), {k}) + 0.0 AS {c}" for c, k in (("win_rate_pct", 2), ("avg_trade_return_pct", 2), ("cumulative_return_pct", 2), ("max_drawdown_pct", 2), ("profit_factor", 3)))
    out["strategy_summary"] = f"""WITH {FRAME}{trades(full)}{_curve('config', 'ticker_ord, i')}, m AS (SELECT config, count(DISTINCT ticker) AS active_tickers, {_METRICS} FROM c2 GROUP BY config),
p(config, market, days, entry_set, entry, macd_zero_filter, vol_mult, stop_pct, max_hold, fee_bp, slip_bp) AS (VALUES {names})
SELECT p.*, active_tickers, trade_count, trailing_stop_count, dead_cross_count, max_hold_count, {shown}, round(round({_SCORE}, 9), 2) + 0.0 AS score FROM m JOIN p USING (config)"""
    out["scan_last_bar"] = select(["ticker", "i", "bar_ts", "close", *FLAGS], "i = n - 1", "diag", DIAG)
    out["rules_last_bar"] = select({**_AT, "date": "strftime(bar_ts, '%Y-%m-%d')", "close": "close"} | {p: f"n >= {max(35, live.max_hold + 2)} AND {rule_sql(p, vol_mult)}" for p in PRESETS}, "i = n - 1")
    out["stream_rules_last_bar"] = out["rules_last_bar"]
    out["scan_report"], out["surge_analysis_json"] = scan_report(), surge_analysis(QUANT)
    named = " UNION ALL ".join([f"SELECT '{f}' AS name, count(*) FILTER (WHERE {f}) AS n FROM diag" for f in FLAGS] + [f"SELECT '{s}_hits', count(*) FROM diag WHERE {s}_final HAVING count(*) > 0" for s in SCANNERS])
    out["scan_observed"] = f"WITH {FRAME}{DIAG} SELECT 'bars' AS name, count(*) AS n FROM diag UNION ALL {named}"
    out["stored_macd_signal"] = out["ind_macd_signal"]
    out["bar_scan"] = f"WITH {BARS}, upto AS (SELECT * FROM bars WHERE bar_ts <= '2024-01-25') SELECT ticker, bar_ts, open, high, low, close, volume FROM upto WHERE ticker IN ('click', 'view') AND bar_ts >= (SELECT max(bar_ts) - INTERVAL 10 DAYS FROM upto)"
    prices = ", ".join(f"CASE WHEN reason IS NULL THEN {c} END AS {c}" for c in ("bar_ts", "open", "high", "low", "close", "volume"))
    out["daily_file_scan"] = f"""
WITH {BARS}, d AS (SELECT *, CAST(bar_ts AS DATE) AS day, CASE day(bar_ts) WHEN 7 THEN 'lacks bar_ts, open, high, low, close, volume' WHEN 14 THEN 'empty' WHEN 21 THEN 'empty' WHEN 25 THEN 'a value has the wrong type' END AS reason FROM bars)
SELECT DISTINCT ticker, day, {prices}, reason FROM d"""
    d = StrategyConfig()
    out["strategy_files"] = f"""
WITH p AS (SELECT *, p_partkey % 6 AS k FROM part), r AS (SELECT *, CASE k WHEN 2 THEN 'unknown rule' WHEN 3 THEN 'bad field macd_zero_filter' WHEN 4 THEN 'no JSON object' END AS reason FROM p)
SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN reason IS NULL THEN CASE k WHEN 0 THEN 'strict_union' ELSE '{d.entry_set}' END END AS entry_set, CASE WHEN reason IS NULL THEN CASE k WHEN 0 THEN 0.05::DOUBLE ELSE {d.stop_pct}::DOUBLE END END AS stop_pct,
 CASE WHEN reason IS NULL THEN CASE WHEN k < 2 THEN p_size ELSE {d.max_hold} END END AS max_hold, CASE WHEN reason IS NULL THEN CASE k WHEN 5 THEN p_retailprice ELSE {d.vol_mult}::DOUBLE END END AS vol_mult, CASE WHEN reason IS NULL THEN '{d.entry}' END AS entry,
 CASE WHEN reason IS NULL THEN k <> 1 END AS macd_zero_filter, CASE WHEN reason IS NULL THEN '{d.market}' END AS market, CASE WHEN reason IS NULL THEN {d.days} END AS days, CASE WHEN reason IS NULL THEN {d.fee_bp}::DOUBLE END AS fee_bp, CASE WHEN reason IS NULL THEN {d.slip_bp}::DOUBLE END AS slip_bp, NULL::DOUBLE AS score, reason FROM r"""
    planted = BARS.replace("bars AS (", "whole AS (") + """,
bars AS (SELECT * REPLACE (CASE WHEN i % 23 = 7 THEN NULL ELSE volume END AS volume, CASE WHEN i % 29 IN (3, 11) THEN NULL ELSE open END AS open, CASE WHEN i % 211 = 5 THEN NULL ELSE high END AS high) FROM whole)"""
    fired = " UNION ALL ".join(f"SELECT ticker, i, '{p}' AS rule FROM ind WHERE i < n - 2 AND {rule_sql(p, vol_mult)}" for p in PRESETS)
    for name in ("macd_signal", "ma", "rsi_engine"):
        out[f"ranged_{name}"] = out[f"ind_{name}"]
    out["ranged_rules"] = f"WITH {FRAME} {fired}"
    out["sql_fired_rules"] = out["ranged_rules"]
    out["sql_preset_strict_union"] = out["preset_strict_union"]
    out["preset_nonfinite"] = f"WITH {FRAME.replace(BARS, planted)} {fired}"
    out |= reports_sql(QUANT, configs["grid"])
    out["sql_message_chunks"] = out["message_chunks"]
    out["surge_labels"] = select(["ticker", "i", *TARGETS, "valid"], source="sf", more=_SURGE)
    out["surge_feature_frame"] = select(["ticker", "i", *FEATURES, "valid"], source="sf", more=_SURGE)
    out["surge_feature_lift"] = _lift()
    rates = ", ".join(f"round(coalesce(avg({t}::INT::DOUBLE), 0.0) * 100, 2) AS {t}_pct" for t in TARGETS)
    out["surge_sample_rates"] = f"WITH {FRAME}{_SURGE} SELECT count(*) AS sample_count, {rates} FROM sf WHERE valid"
    for s in ("breakout", "trend", "power"):
        out[f"scan_{s}"] = select(["ticker", "i", "bar_ts", "close"], f"{s}_final", "diag", DIAG)
    out["scan_diag_counts"] = f"WITH {FRAME}{DIAG} SELECT ticker, " + ", ".join(f"count(*) FILTER (WHERE {f}) AS {f}" for f in FLAGS) + " FROM diag GROUP BY ticker"
    out["ranged_diag_counts"] = out["scan_diag_counts"]
    out["scan_legacy_funnel"] = select(["ticker", "i", *FUNNEL, "green"], source="fun", more=FUN) .replace("green AS green", "CAST(green AS BIGINT) AS green")
    out["scan_legacy_counts"] = f"WITH {FRAME}{FUN} SELECT count(*) AS scanned, " + ", ".join(f"count(*) FILTER (WHERE {f}) AS {f}" for f in FUNNEL) + " FROM fun"
    out["scan_legacy_top5"] = f"WITH {FRAME}{FUN} SELECT ticker, i, round(vol_ratio, 6) AS vol_ratio, row_number() OVER (PARTITION BY ticker ORDER BY vol_ratio DESC, ticker_ord, i) AS place FROM fun WHERE funnel_volume_pass QUALIFY place <= 5"
    script = f"(i >= 59 AND max((gc AND macd > 0)::INT) {_LAST5} = 1 AND (max({_X520}::INT) {_LAST5} = 1 OR max({_X2060}::INT) {_LAST5} = 1) AND volume > 1.5 * vol20_prev)"
    out["scan_script"] = f"WITH {FRAME}, sc AS (SELECT *, coalesce({script}, false) AS hit FROM ind) SELECT ticker, i, close FROM sc WHERE hit"
    out["tickers_strict"] = r"""
WITH raw AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' ' || p_size || '.0' WHEN 1 THEN CAST(p_size * 7 AS VARCHAR) WHEN 2 THEN p_brand ELSE NULL END AS code FROM part),
c AS (SELECT p_partkey, regexp_replace(trim(coalesce(code, '')), '\.0$', '') AS code FROM raw),
z AS (SELECT p_partkey, CASE WHEN regexp_full_match(code, '[0-9]+') AND length(code) < 6 THEN lpad(code, 6, '0') ELSE code END AS ticker FROM c)
SELECT ticker, min(p_partkey) AS ord FROM z WHERE regexp_full_match(ticker, '[0-9]{6}') GROUP BY ticker"""
    out["tickers_lenient"] = out["tickers_strict"].replace("SELECT ticker, min(p_partkey) AS ord FROM z WHERE regexp_full_match(ticker, '[0-9]{6}') GROUP BY ticker", "SELECT ticker, ticker AS name, min(p_partkey) AS ord FROM z WHERE ticker <> '' GROUP BY ticker")
    out["members_by_day"] = f"""
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
m AS (SELECT CAST(o_orderdate AS DATE) AS date, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS ticker, min(o_orderkey) AS ord FROM orders WHERE day(o_orderdate) IN (3, 9) GROUP BY 1, 2),
dates AS (SELECT DISTINCT date FROM m),
r AS (SELECT day, CASE WHEN day - date <= 14 THEN date END AS date FROM d ASOF LEFT JOIN dates ON d.day >= dates.date),
f AS ({out['tickers_strict']})
SELECT day, m.date, ticker, ord FROM r JOIN m ON r.date = m.date UNION ALL SELECT day, CAST(day - 14 AS DATE) AS date, ticker, ord FROM r, f WHERE r.date IS NULL"""
    return out
