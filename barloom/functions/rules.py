"""Entry rules: names and predicates over an indicator frame.

A predicate is one SQL expression; ``{v}`` is the volume multiple.  A missing operand makes
it null, which counts as false, unless an inner ``coalesce`` says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_VOLUME = "volume >= {v} * vol20_prev"
_BULL = "macd > signal AND signal > 0"

#: The fifteen rules.
PRESETS = {
    "macd_gc": "true",
    "macd_ma_vol": "ma5 > ma20 AND ma20 > ma60 AND volume >= {v} * vol20",
    "breakout40_slope": "i >= 41 AND close > high40_prev AND macd - macd_1 > 0 AND macd > signal",
    "macd_rsi65_gap3": "rsi14 <= 65 AND (next_open IS NULL OR (close > 0 AND next_open / close <= 1.03))",
    "macd_nodup5_high95": "i >= 41 AND gc_prev5 = 0 AND close >= 0.95 * high40_prev",
    "ma2060_atr": "i >= 1 AND ma20_1 <= ma60_1 AND ma20 > ma60 AND atr14 / close >= 0.015 AND atr14 / close <= 0.06",
    "strict_union": f"macd > 0 AND {_VOLUME} AND (coalesce(i >= 41 AND gc_prev5 = 0 AND close >= 0.95 * high40_prev, false) OR coalesce(rsi14 <= 65, false) OR coalesce(ma5 > ma20 AND ma20 > ma60, false))",
    "trend_long_bull": f"close - open > 0 AND (close - open) / greatest(high - low, 1e-9) >= 0.60 AND (coalesce(close_1 > 0 AND (close - open) / close_1 >= 0.03, false) OR coalesce(close - open >= atr14, false)) AND ma20 > ma60 AND {_BULL} AND {_VOLUME}",
    "trend_ma_union": f"i >= 1 AND {_VOLUME} AND ma5 > ma20 AND ma20 > ma60 AND ma20 > ma20_1 AND ma60 > ma60_1 AND {_BULL}",
    "trend_breakout40_macd": f"i >= 1 AND {_VOLUME} AND close > high40_prev AND macd - macd_1 > 0 AND macd > signal",
    "trend_ma2060_vol": f"i >= 2 AND {_VOLUME} AND ma20 > ma60 AND ma20_1 > ma60_1 AND ma20_2 > ma60_2",
    "trend_high95_macd": f"{_VOLUME} AND close >= 0.95 * high40_prev AND macd > 0 AND signal > 0",
    "gc_today_vol": _VOLUME,
    "breakout40_gc_today_vol": f"i >= 41 AND {_VOLUME} AND close > high40_prev AND close_1 <= high40_prev2",
    "quant_surge_common": f"close >= 0.97 * high40_prev AND ma20 > ma60 AND {_BULL} AND {_VOLUME} AND close > open AND (close / open - 1 >= 0.02 OR (close - low) / greatest(high - low, 1e-9) >= 0.70)",
}
#: Rules that also need a golden cross on the signal bar.
NEEDS_CROSS = frozenset({"macd_gc", "macd_ma_vol", "macd_rsi65_gap3", "macd_nodup5_high95", "strict_union", "gc_today_vol", "breakout40_gc_today_vol"})


def require(name: str) -> str:
    """The predicate of a rule; an unknown name is an error."""
    if name not in PRESETS:
        raise ValueError(f"unknown entry rule {name!r}; known: {', '.join(PRESETS)}")
    return PRESETS[name]


def rule_sql(name: str, vol_mult: float, cross: bool = True) -> str:
    gate = "gc AND " if cross and name in NEEDS_CROSS else ""
    return f"coalesce({gate}({require(name).format(v=float(vol_mult))}), false)"


def rule(name: str, vol_mult: float, cross: bool = True) -> Column:
    return F.expr(rule_sql(name, vol_mult, cross))
