"""Instrument lists: files, membership as of a date, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of the column that holds the code.
STRICT_COLUMNS = ("ticker", "Ticker", "종목코드", "code", "Code")
LENIENT_COLUMNS = ("ticker", "code")


def clean_code(raw: Column) -> Column:
    """Trimmed, without a trailing ``.0``; digits are filled up to six with zeros."""
    code = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"\.0$", "")
    return F.when(code.rlike("^[0-9]+$") & (F.length(code) < 6), F.lpad(code, 6, "0")).otherwise(code)


def distinct_in_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key, in a grouping that keeps one row per key and task."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("first")).select(key, "first.*")


def strict_tickers(rows: DataFrame, order: str, column: str | None = None) -> DataFrame:
    """ticker and ``ord`` of six-digit codes; the first known column, else the first."""
    name = column or next((c for c in STRICT_COLUMNS if c in rows.columns), rows.columns[0])
    codes = rows.select(clean_code(F.col(f"`{name}`")).alias("ticker"), F.col(order).cast("long").alias("ord")).where(F.col("ticker").rlike("^[0-9]{6}$"))
    return distinct_in_order(codes, "ticker", "ord")


def lenient_tickers(rows: DataFrame, order: str) -> DataFrame:
    """ticker, name and ``ord``; any code that is not blank, from ``ticker`` or ``code``
    whatever the header's case; an error without such a column."""
    named = {c.strip().lower(): c for c in rows.columns}
    name = next((named[c] for c in LENIENT_COLUMNS if c in named), None)
    if name is None:
        raise ValueError("no ticker or code column")
    label = F.trim(F.coalesce(F.col(f"`{named['name']}`"), F.lit(""))) if "name" in named else F.lit("")
    codes = rows.select(clean_code(F.col(f"`{name}`")).alias("ticker"), label.alias("name"), F.col(order).cast("long").alias("ord")).where(F.col("ticker") != "")
    codes = distinct_in_order(codes, "ticker", "ord")
    return codes.withColumn("name", F.coalesce(F.expr("nullif(name, '')"), "ticker"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with ``line`` as an order."""
    return spark.read.csv(path, header=True, inferSchema=False).withColumn("line", F.monotonically_increasing_id())


def members_as_of(membership: DataFrame, asof: str, back_days: int = 14) -> DataFrame:
    """Members on the latest date on or before ``asof`` that has any, within ``back_days``."""
    near = membership.where((F.col("date") <= F.lit(asof).cast("date")) & (F.col("date") >= F.date_sub(F.lit(asof).cast("date"), back_days)))
    return near.join(F.broadcast(near.agg(F.max("date").alias("date"))), "date")  # one row


def resolve(membership: DataFrame, asof: str, fallback: DataFrame | None = None, limit: int | None = None, back_days: int = 14) -> DataFrame:
    """date, ticker, ord: members as of a date; where no date has any, those of a ticker
    file (``strict_tickers``), dated by the earliest day that was looked at."""
    found = members_as_of(membership, asof, back_days).select("date", "ticker", F.col("ord").cast("long").alias("ord"))
    if fallback is not None and not found.take(1):
        found = fallback.select(F.date_sub(F.lit(asof).cast("date"), back_days).alias("date"), "ticker", "ord")
    return found if limit is None else found.orderBy("ord", "ticker").limit(limit)


def members_by_day(membership: DataFrame, days: DataFrame, fallback: DataFrame | None = None, back_days: int = 14) -> DataFrame:
    """day, date, ticker, ord: the members as of every ``day`` of ``days``.

    A day's members are those of the latest date on or before it that has any, at most
    ``back_days`` before; a day without such a date has the ``fallback``'s instruments,
    dated by the earliest date looked at.  The look back is a join by equality with the few
    dates that a day may take, so any number of days and members spreads over all tasks.
    """
    members = membership.select(F.col("date").cast("date").alias("date"), "ticker", F.col("ord").cast("long").alias("ord")).where("date is not null")
    asked = days.select(F.col("day").cast("date").alias("day")).where("day is not null").distinct()
    looks = asked.select("day", F.explode(F.sequence(F.date_sub("day", back_days), F.col("day"))).alias("date"))
    taken = looks.join(members.select("date").distinct(), "date").groupBy("day").agg(F.max("date").alias("date"))
    found = taken.join(members, "date").select("day", "date", "ticker", "ord")
    if fallback is None:
        return found
    # A ticker file is of the size of a file.
    listed = F.broadcast(fallback.agg(F.collect_list(F.struct("ticker", "ord")).alias("listed")))
    rest = asked.join(taken, "day", "left_anti").crossJoin(listed).select("day", F.date_sub("day", back_days).alias("date"), F.inline("listed"))  # one row
    return found.unionByName(rest.select("day", "date", "ticker", F.col("ord").cast("long").alias("ord")))


def listing(listings: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The first rows of each market by ``ord``; markets without a limit stay whole."""
    place = F.row_number().over(Window.partitionBy("market").orderBy("ord"))
    most = F.create_map(*(x for m, n in limits.items() for x in (F.lit(m), F.lit(n)))) if limits else None
    if most is None:
        return listings
    return listings.withColumn("place", place).where(F.col("place") <= F.coalesce(F.element_at(most, F.col("market")), F.lit(2**31 - 1))).drop("place")
