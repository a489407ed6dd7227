"""One huge instrument in many tasks: ranges of bars, halos, and carried means.

A window by instrument is one task per instrument.  Here bars are cut into ranges of
``RANGE`` by their position, and windows run by instrument and range:

* Rolling windows see a halo: the last ``HALO`` bars before a range and the first ``AHEAD``
  bars after it are copied into it and dropped again when the windows are done.
* A smoothed mean takes y to q**m * y + b over m bars.  Such maps compose, so each range
  gives its own b, and what comes into a range is the composition of the ranges before it,
  as far back as a double can tell.  That is a window over one row per range.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE, HALO, AHEAD = 512, 64, 16
_KEY = ("ticker", "range")


def positioned_by_days(bars: DataFrame, every: str = "day") -> DataFrame:
    """Adds ``i`` and ``n`` like ``positioned``, from counts by day: no window holds more
    than an instrument's bars of one day, or one row per day.  Bars without a time go."""
    rows = bars.withColumn("__day", F.date_trunc(every, "bar_ts"))
    per, days = rows.groupBy("ticker", "__day").agg(F.count("*").alias("__many")), Window.partitionBy("ticker").orderBy("__day")
    before = F.coalesce(F.sum("__many").over(days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("ticker", "__day", before.alias("__before"), F.sum("__many").over(Window.partitionBy("ticker")).alias("n"))
    place = F.row_number().over(Window.partitionBy("ticker", "__day").orderBy("bar_ts")) - 1
    rows = rows.join(per, ["ticker", "__day"]).withColumn("i", (place + F.col("__before")).cast("long"))
    return rows.drop("__day", "__before")


def with_ranges(bars: DataFrame) -> DataFrame:
    """Adds ``range``; ``i`` has to number the bars of an instrument without gaps."""
    return bars.withColumn("range", F.floor(F.col("i") / RANGE))


def with_ranged_ewm(df: DataFrame, spans: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds smoothed means, name -> (column, span), as ``with_ewm`` does, in windows by
    instrument and range.  A missing value counts as the one before; before the first value
    there is no mean."""
    columns = sorted({c for c, _ in spans.values()})
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("i"))
    ends = df.groupBy(*_KEY).agg(*(f(c, at(c)).alias(f"__{name}_{c}") for c in columns for name, f in (("first", F.min_by), ("last", F.max_by))))
    ranges, inside = Window.partitionBy("ticker").orderBy("range"), Window.partitionBy(*_KEY).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    base = {c: F.first(f"__first_{c}", ignorenulls=True).over(ranges.rowsBetween(Window.unboundedPreceding, 0)).alias(f"__base_{c}") for c in columns}
    come = {c: F.last(f"__last_{c}", ignorenulls=True).over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias(f"__in_{c}") for c in columns}
    rows = df.join(ends.select(*_KEY, *base.values(), *come.values()), list(_KEY))
    rows = rows.withColumns({f"__known_{c}": F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"__in_{c}")) for c in columns})
    k = F.col("i") - F.col("range") * RANGE
    terms, values, carried = {}, {}, {}
    for name, (c, span) in spans.items():
        a = 2.0 / (span + 1)
        q = 1.0 - a
        if q**RANGE < 1e-250:
            raise ValueError(f"span {span} is too short for ranges of {RANGE} bars")
        terms[name] = a * (F.col(f"__known_{c}") - F.col(f"__base_{c}")) * F.pow(F.lit(q), -k)
        # Ranges further back than this weigh less than 1e-18.
        depth = max(1, math.ceil(41.5 / (-RANGE * math.log(q))))
        parts = F.collect_list(f"__map_{name}").over(ranges.rowsBetween(-depth, -1))
        carried[name] = F.aggregate(parts, F.lit(0.0), _map(q)).alias(f"__carry_{name}")
        value = F.col(f"__base_{c}") + F.pow(F.lit(q), k) * F.sum(terms[name]).over(inside) + F.pow(F.lit(q), k + 1) * F.col(f"__carry_{name}")
        values[name] = F.when(F.col(f"__known_{c}").isNotNull(), value)
    weight = {name: F.lit((1.0 - 2.0 / (span + 1)) ** (RANGE - 1)) for name, (_, span) in spans.items()}
    maps = rows.groupBy(*_KEY).agg(*((F.coalesce(F.sum(t), F.lit(0.0)) * weight[name]).alias(f"__map_{name}") for name, t in terms.items()))
    rows = rows.join(maps.select(*_KEY, *carried.values()), list(_KEY)).withColumns(values)
    return rows.drop(*(x for x in rows.columns if x.startswith("__")))


def _map(q: float) -> Callable[[Column, Column], Column]:
    return lambda y, b: y * F.lit(q**RANGE) + b


def with_halo(df: DataFrame) -> DataFrame:
    """Every range with the bars around it: ``ticker`` becomes (ticker, range), so windows
    by instrument run within ranges, and ``own`` marks a range's own bars."""
    k = F.col("i") - F.col("range") * RANGE
    near = F.array_compact(F.array(F.col("range"), F.when(k >= RANGE - HALO, F.col("range") + 1), F.when((k < AHEAD) & (F.col("range") > 0), F.col("range") - 1)))
    rows = df.withColumn("into", F.explode(near)).withColumn("own", F.col("into") == F.col("range"))
    return rows.withColumn("ticker", F.struct("ticker", F.col("into").alias("range"))).drop("into")


def without_halo(df: DataFrame) -> DataFrame:
    return df.where("own").withColumn("ticker", F.col("ticker.ticker")).drop("own")


def backfilled(df: DataFrame, column: str) -> DataFrame:
    """Missing values filled with the next valid one, across ranges."""
    firsts = df.groupBy(*_KEY).agg(F.min_by(column, F.when(F.col(column).isNotNull(), F.col("i"))).alias("__first"))
    later = Window.partitionBy("ticker").orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.select(*_KEY, F.first("__first", ignorenulls=True).over(later).alias("__next"))
    inside = Window.partitionBy(*_KEY).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    filled = df.withColumn(column, F.last(column, ignorenulls=True).over(inside)).join(firsts, list(_KEY))
    return filled.withColumn(column, F.coalesce(column, "__next")).drop("__next")
