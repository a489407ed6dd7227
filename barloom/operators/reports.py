"""Text for people: selections, report sections, messages of bounded length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.sources.strategy import StrategyConfig


def named(rows: DataFrame, names: DataFrame | None) -> DataFrame:
    """Adds ``name``: the row's own unless it is the ticker, else the dimension's, else the
    ticker."""
    own = F.expr("nullif(name, ticker)") if "name" in rows.columns else F.lit(None).cast("string")
    if names is None:
        return rows.withColumn("name", F.coalesce(own, "ticker"))
    known = names.groupBy("ticker").agg(F.min("name").alias("known_name"))
    return rows.join(known, "ticker", "left").withColumn("name", F.coalesce(own, "known_name", "ticker")).drop("known_name")


def two_decimals(c: Column | str) -> Column:
    """The number's own digits, as C writes them: Java's format fills up with zeros behind 17
    digits, rounds the shortest text instead of the number, and writes a null as a word."""
    return F.udf(lambda x: None if x is None else f"{x:.2f}", "string", useArrow=True)(c)


def selection_log(selections: DataFrame, method: str) -> DataFrame:
    """date, ticker, method and the price as text with two decimals."""
    return selections.select(F.date_format("bar_ts", "yyyy-MM-dd").alias("date"), "ticker", F.lit(method).alias("method"), two_decimals("close").alias("close"))


def _line() -> Column:
    return F.format_string("%s (%s) close=%.0f", "name", "ticker", "close").alias("line")


def _section_text(title: str, cfg: StrategyConfig) -> Column:
    head = f"[{title}] {cfg.entry_set}\nentry={cfg.entry} stop={cfg.stop_pct} hold={cfg.max_hold} vol={cfg.vol_mult}\n\n"
    return F.concat(F.lit(head), F.when(F.size("lines") > 0, F.array_join("lines", "\n")).otherwise("No signal today.")).alias("text")


def section(title: str, cfg: StrategyConfig, selections: DataFrame) -> DataFrame:
    """One row ``text``: header, parameters, and the selections' lines in order."""
    return selections.select(_line()).agg(F.array_sort(F.collect_list("line")).alias("lines")).select(_section_text(title, cfg))


def daily_sections(title: str, cfg: StrategyConfig, selections: DataFrame, days: DataFrame) -> DataFrame:
    """date, text: a section for every date of ``days``, from that day's selections."""
    lines = selections.select("date", _line()).groupBy("date").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return days.select("date").distinct().join(lines, "date", "left").select("date", _section_text(title, cfg))


#: Title of each daily scanner's section.
SCANNERS = {"breakout": "Breakout: first close above 40 highs, recent MACD cross", "trend": "Trend: rising averages, moderate range, volume", "power": "Power: bullish bar on volume above 60 highs"}
_STAGES = {"breakout": ("len_ok", "breakout_ok", "macd_ok", "final"), "trend": ("len_ok", "vol_ok", "ma_ok", "atr_ok", "final"), "power": ("len_ok", "vol_ok", "candle_ok", "breakout_ok", "final")}


def scan_report(diagnosed: DataFrame, names: DataFrame | None = None, source: str = "bars", run_at: str | None = None) -> DataFrame:
    """One row ``text``: the three scanners' hits on each instrument's last bar, a summary
    and how many instruments reach each stage.  ``run_at`` is the time of the run, by
    default now in the session's time zone."""
    last = named(diagnosed.where(F.col("i") == F.col("n") - 1), names)
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "ticker", F.lit(") | "), F.format_number("close", 0))
    hits = [F.array_sort(F.collect_list(F.when(F.col(f"{s}_final"), line))).alias(f"{s}_lines") for s in SCANNERS]
    counts = [F.count_if(f"{s}_{x}").alias(f"{s}_{x}") for s, stages in _STAGES.items() for x in stages]
    one = last.agg(*hits, *counts, F.count("*").alias("instruments"), F.date_format(F.max("bar_ts"), "yyyyMMdd").alias("latest"))
    now = F.lit(run_at) if run_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss z")
    section = lambda s: F.when(F.size(f"{s}_lines") > 0, F.concat(F.lit(f"[{SCANNERS[s]}]\n"), F.array_join(f"{s}_lines", "\n"), F.lit("\n\n"))).otherwise("")
    nothing = F.when(F.greatest(*(F.size(f"{s}_lines") for s in SCANNERS)) == 0, "Nothing passed today.\n\n").otherwise("")
    counted = lambda label, c: F.concat(F.lit(f"{label}="), F.col(c).cast("string"))
    summary = F.concat_ws("\n", F.lit("[SUMMARY]"), counted("instruments", "instruments"), *(counted(s, f"{s}_final") for s in SCANNERS))
    stages = [F.concat_ws("\n", F.lit(f"[DIAG - {s.title()}]"), *(counted(x, f"{s}_{x}") for x in xs)) for s, xs in _STAGES.items()]
    head = F.concat(F.lit("Daily scan\n- run: "), now, F.lit(f"\n- instruments: {source}\n- data of: "), F.coalesce("latest", F.lit("N/A")), F.lit("\n\n"))
    return one.select(F.concat(head, *(section(s) for s in SCANNERS), nothing, F.concat_ws("\n\n", summary, *stages)).alias("text"))


def pick_messages(picks: DataFrame) -> DataFrame:
    """market, place, message: price, volume ratio, averages and a link of each pick."""
    dollars = F.col("market").isin("S&P500", "NASDAQ")
    whole = lambda c: F.format_number(c, 0)
    link = F.concat(F.lit("https://m.stock.naver.com/"), F.when(dollars, "worldstock").otherwise("domestic"), F.lit("/stock/"), "ticker", F.lit("/total"))
    text = F.concat_ws("\n", F.concat("name", F.lit(" ("), "ticker", F.lit(")")), F.concat(whole("close"), F.when(dollars, "$").otherwise("원")), F.format_string("x%.1f / RSI %.0f", "vol_ratio", "rsi_legacy"), F.concat(whole(F.floor("ma60")), F.lit(" / "), whole(F.floor("ma20"))), link)
    return picks.select("market", "place", text.alias("message"))


def split_message(text: str, most: int) -> list[str]:
    """Lines packed greedily into chunks of at most ``most`` characters; a longer line is
    cut, wherever it stands."""
    out, current = [], ""
    for line in text.split("\n"):
        while len(line) > most:
            if current:
                out.append(current)
                current = ""
            out.append(line[:most])
            line = line[most:]
        joined = f"{current}\n{line}" if current else line
        if len(joined) > most:
            out.append(current)
            current = line
        else:
            current = joined
    return [*out, current] if current else out


def batch_items(items: list[str], most: int = 3000) -> list[str]:
    """Items joined in order, each followed by a blank line; a batch ends before the item
    that would take it above ``most`` characters."""
    out, current = [], ""
    for item in items:
        if current and len(current) + len(item) > most:
            out.append(current)
            current = ""
        current += item + "\n\n"
    return [*out, current] if current else out


def message_batches(items: DataFrame, most: int = 3000) -> DataFrame:
    """ident, chunk, text for ``items(ident, place, message)``: a few picks per ident."""
    lists = items.groupBy(F.col("ident").cast("string").alias("ident")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "message"))), lambda x: x["message"]).alias("items"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, part) for i, own in zip(b["ident"], b["items"], strict=True) for k, part in enumerate(batch_items(list(own), most))]
            yield pd.DataFrame(rows, columns=["ident", "chunk", "text"])

    return lists.mapInPandas(run, "ident string, chunk int, text string")


def message_chunks(messages: DataFrame, most: int = 3500) -> DataFrame:
    """ident, chunk, text for ``messages(ident, text)``; null and empty texts give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, part) for i, t in zip(b["ident"], b["text"], strict=True) for k, part in enumerate(split_message(t or "", most))]
            yield pd.DataFrame(rows, columns=["ident", "chunk", "text"])

    return messages.select(F.col("ident").cast("string").alias("ident"), "text").mapInPandas(run, "ident string, chunk int, text string")
