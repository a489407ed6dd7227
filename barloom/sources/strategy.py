"""Strategy configurations: defaults, JSON files, grids."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.rules import PRESETS, require


@dataclass(frozen=True)
class StrategyConfig:
    """The default parameters of a strategy."""

    entry_set: str = "macd_gc"
    stop_pct: float = 0.10
    max_hold: int = 20
    vol_mult: float = 1.5
    entry: str = "next_open"
    macd_zero_filter: bool = True
    market: str = "KOSPI"
    days: int = 365
    fee_bp: float = 5.0
    slip_bp: float = 5.0
    score: float | None = None

    @property
    def name(self) -> str:
        return f"{self.entry_set}|stop={self.stop_pct:g}|hold={self.max_hold}|vol={self.vol_mult:g}|{self.entry}|zero={int(self.macd_zero_filter)}"

    @classmethod
    def from_dict(cls, values: dict) -> StrategyConfig:
        """Known keys, coerced; others are ignored.  Flags have to be real booleans."""
        kinds = {"entry_set": str, "stop_pct": float, "max_hold": int, "vol_mult": float, "entry": str, "macd_zero_filter": bool, "market": str, "days": int, "fee_bp": float, "slip_bp": float, "score": float}
        known = {f.name for f in fields(cls)}
        return cls(**{k: None if v is None else kinds[k](v) for k, v in values.items() if k in known})


#: The strategy that checks surge features.
QUANT = StrategyConfig(entry_set="quant_surge_common", stop_pct=0.10, max_hold=15, vol_mult=1.2, macd_zero_filter=False)


def load_strategy(path: str) -> StrategyConfig:
    return StrategyConfig.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))


def load_strategy_or_none(path: str) -> StrategyConfig | None:
    """None for a missing or malformed file: the caller falls back to the scanners."""
    try:
        return load_strategy(path)
    except (OSError, ValueError, TypeError):
        return None


def parse_strategies(files: DataFrame) -> DataFrame:
    """``files(path, json)`` as strategies: path, a column per field, ``reason``.

    Fields that a file lacks take their defaults; numbers may be texts of numbers, flags
    have to be booleans; unknown keys are ignored.  A bad file has a ``reason`` (no JSON
    object, then the first field that is wrong, then an unknown rule) and null fields.  A
    null or empty file is no JSON object; of a key that is there twice, the file is none.
    """
    kinds = {"str": "string", "float": "double", "int": "int", "bool": "boolean", "float | None": "double"}
    types = {f.name: (kinds[f.type], f.default) for f in fields(StrategyConfig)}
    read = files.withColumn("v", F.try_parse_json("json"))
    read = read.withColumn("v", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")))
    given = {name: F.try_variant_get("v", f"$.{name}", "variant") for name in types}
    values, wrong = {}, []
    for name, (kind, default) in types.items():
        there = given[name].isNotNull() & ~F.is_variant_null(given[name])
        value = F.try_variant_get("v", f"$.{name}", kind)
        if kind == "boolean":
            value = F.when(F.schema_of_variant(given[name]) == "BOOLEAN", value)
        null = F.lit(False) if default is None else given[name].isNotNull() & F.is_variant_null(given[name])
        wrong.append(F.when((there & value.isNull()) | null, F.lit(f"bad field {name}")))
        values[name] = F.when(there, value).otherwise(F.lit(default).cast(kind))
    rule_unknown = F.when(~values["entry_set"].isin(*PRESETS), F.lit("unknown rule"))
    reason: Column = F.coalesce(F.when(F.col("v").isNull(), F.lit("no JSON object")), *wrong, rule_unknown)
    read = read.select("path", "v", reason.alias("reason"))
    return read.select("path", *(F.when(F.col("reason").isNull(), c).alias(name) for name, c in values.items()), "reason")


def read_strategies(spark: SparkSession, path: str) -> DataFrame:
    """All JSON files of a folder by ``parse_strategies``, one row per file."""
    return parse_strategies(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json")))


def parse_list(text: str, kind=str) -> list:
    """Values of a comma-separated list; flags are true/false, 1/0, yes/no."""
    parts = [p.strip() for p in text.split(",") if p.strip()]
    if kind is not bool:
        return [kind(p) for p in parts]
    words = {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}
    if bad := [p for p in parts if p.lower() not in words]:
        raise ValueError(f"not a flag: {bad[0]}")
    return [words[p.lower()] for p in parts]


#: The default grid.
GRID = {
    "entry_set": ["macd_gc", "macd_ma_vol", "strict_union", "trend_long_bull", "trend_ma_union", "breakout40_gc_today_vol", "quant_surge_common"],
    "stop_pct": [0.08, 0.1, 0.12],
    "max_hold": [10, 15, 20],
    "vol_mult": [1.5, 1.8, 2.0],
    "entry": ["next_open", "next_close"],
    "macd_zero_filter": [True, False],
}


def grid(**values: list) -> Iterator[StrategyConfig]:
    """All combinations, in the order of their product; unknown rules are an error."""
    axes = GRID | values
    for name in axes["entry_set"]:
        require(name)
    for point in itertools.product(*axes.values()):
        yield StrategyConfig(**dict(zip(axes, point, strict=True)))


def config_table(spark: SparkSession, configs: list[StrategyConfig]) -> DataFrame:
    """config, grid_ord and the parameters of each configuration."""
    rows = [(c.name, k, c.entry_set, float(c.stop_pct), c.max_hold, float(c.vol_mult), c.entry, c.macd_zero_filter, c.market, c.days, float(c.fee_bp), float(c.slip_bp)) for k, c in enumerate(configs)]
    return spark.createDataFrame(rows, "config string, grid_ord long, entry_set string, stop_pct double, max_hold int, vol_mult double, entry string, macd_zero_filter boolean, market string, days int, fee_bp double, slip_bp double")


def to_json(cfg: StrategyConfig) -> str:
    return json.dumps(asdict(cfg), ensure_ascii=False, indent=2)
