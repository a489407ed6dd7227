"""Windows by instrument: guarded rolling aggregates and exponentially weighted means."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Bars in a chunk of a smoothed mean: the weight of a bar two chunks back is below 1e-17
#: of a double's precision for spans up to 40.
CHUNK = 512


def by_bar() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("i")


def roll(agg: Callable[[Column], Column], c: Column | str, first: int, last: int) -> Column:
    """``agg`` over the bars ``first`` to ``last`` from here, null unless all have a value."""
    c = F.col(c) if isinstance(c, str) else c
    frame = by_bar().rowsBetween(first, last)
    return F.when(F.count(c).over(frame) == last - first + 1, agg(c).over(frame))


def lag(c: Column | str, k: int = 1) -> Column:
    return F.lag(c, k).over(by_bar())


def lead(c: Column | str, k: int = 1) -> Column:
    return F.lead(c, k).over(by_bar())


def finite(c: Column | str) -> Column:
    """The value, null where it is NaN or infinite: Spark orders NaN above every number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def all_finite(*columns: Column | str) -> Column:
    """Whether every value is a finite number; nulls are not."""
    out = F.lit(True)
    for c in columns:
        out = out & finite(c).isNotNull()
    return out


def with_ewm(df: DataFrame, spans: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds smoothed means: name -> (column, span).  A missing value counts as the one before."""
    first = by_bar().rowsBetween(Window.unboundedPreceding, 0)
    bases = {f"{c}_base": F.first(c, ignorenulls=True).over(first) for c, _ in spans.values()}
    known = {f"{c}_known": F.last(c, ignorenulls=True).over(first) for c, _ in spans.values()}
    bases |= known
    return df.withColumns(bases).withColumns({name: _ewm(c, span) for name, (c, span) in spans.items()}).drop(*bases)


def _ewm(c: str, span: int) -> Column:
    """y0 = x0, y = a*x + (1-a)*y_before with a = 2/(span+1), for series of any length.

    Within a chunk the recursion is a weighted sum; what comes before a chunk is the sum of
    the two chunks before it, which a frame over chunk numbers gives.  Everything is a
    window of one partitioning, so no row-by-row code runs and powers cannot overflow.
    """
    a = 2.0 / (span + 1)
    q = 1.0 - a
    if q ** (2 * CHUNK) > 1e-17:
        raise ValueError(f"span {span} is too long for chunks of {CHUNK} bars")
    chunk = F.floor(F.col("i") / CHUNK)
    k = F.col("i") - chunk * CHUNK
    base = F.col(f"{c}_base")
    term = a * (F.col(f"{c}_known") - base) * F.pow(F.lit(q), -k)
    own = F.sum(term).over(Window.partitionBy("ticker", chunk).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    chunks = Window.partitionBy("ticker").orderBy(chunk)
    before = lambda back: F.coalesce(F.sum(term).over(chunks.rangeBetween(-back, -back)), F.lit(0.0))
    carried = before(1) + F.lit(q**CHUNK) * before(2)
    return base + F.pow(F.lit(q), k) * own + F.pow(F.lit(q), k + CHUNK) * carried
