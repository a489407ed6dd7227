"""Rules and messages in SQL, and bars in one file per instrument and day."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan, StringContains

from barloom.functions.rules import PRESETS, rule
from barloom.functions.tables import register, register_messages
from barloom.operators import reports
from barloom.operators.indicators import indicator_frame
from barloom.sources.bars import bars_from_events, event_bars
from barloom.sources.daily import DailyBarReader, read_daily

SF = "/root/testdata/sf0.01"


def test_rules_by_name(spark):
    frame = indicator_frame(event_bars(spark, SF)).persist()
    register(spark, frame.schema)
    flags = ", ".join(f"fires('{p}', 1.5, struct(*)) AS {p}" for p in PRESETS)
    got = spark.sql(f"SELECT ticker, i, {flags}, fired_rules(1.5, struct(*)) AS fired FROM {{f}}", f=frame)
    want = frame.select("ticker", "i", *(rule(p, 1.5).alias(p) for p in PRESETS))
    rows = got.collect()
    assert sorted(r[:-1] for r in rows) == sorted(map(tuple, want.collect())) and any(r["strict_union"] for r in rows)
    assert all(r["fired"] == [p for p in PRESETS if r[p]] for r in rows)
    # A literal name leaves its own columns only.
    plan = spark.sql("SELECT ticker FROM {f} WHERE fires('gc_today_vol', 2, struct(*))", f=indicator_frame(event_bars(spark, SF)))
    assert "atr14" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert spark.sql("SELECT fires(CAST(NULL AS STRING), 1.5, struct(*)) AS x FROM {f} LIMIT 1", f=frame).first()["x"] is None
    with pytest.raises(Exception, match="unknown entry rule nope"):
        spark.sql("SELECT fires('nope', 1.5, struct(*)) AS x FROM {f}", f=frame).collect()
    frame.unpersist()


def test_messages_in_sql(spark):
    register_messages(spark)
    texts = [("a", "x" * 25 + "\n\nlast", 1), ("b", None, 2), ("c", "", 3), (None, "one\ntwo", 4), ("a", "again", 5)]
    messages = spark.createDataFrame(texts, "ident string, text string, extra long")
    got = spark.sql("SELECT * FROM split_message(TABLE({m}), 10)", m=messages).collect()
    want = [(i, k, part) for i, t, _ in texts for k, part in enumerate(reports.split_message(t or "", 10))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    items = [(f"m{k % 3}" if k % 3 else None, k, f"text {k} " + "y" * (k % 7)) for k in range(200)] + [("m1", 500, None), ("only null", 1, None)]
    rows = spark.createDataFrame(items, "ident string, place int, message string").repartition(5)
    got = spark.sql("SELECT * FROM batch_messages(TABLE({m}), 60)", m=rows).collect()
    want = [(i, k, part) for i in (None, "m1", "m2") for k, part in enumerate(reports.batch_items([t for own, _, t in items if own == i and t is not None], 60))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert spark.sql("SELECT * FROM batch_messages(TABLE({m}))", m=rows.where("false")).count() == 0
    whole = spark.sql("SELECT * FROM split_message(TABLE({m}))", m=messages)
    assert whole.count() == 3 and "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="text not found"):
        spark.sql("SELECT * FROM split_message(TABLE({m}))", m=rows).collect()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("daily"))
    bars = bars_from_events(spark.read.parquet(f"{SF}/events.parquet")).withColumn("day", F.to_date("bar_ts"))
    bars.repartition("ticker").write.partitionBy("ticker", "day").parquet(f"{folder}/a b")
    return f"{folder}/a b", bars.persist()


def test_good_files_give_their_bars(spark, stored):
    folder, bars = stored
    got = read_daily(spark, folder)
    assert sorted(got.select(*bars.columns).collect()) == sorted(bars.collect())
    assert got.where("reason is not null").count() == 0


def test_filters_reach_the_folders(spark, stored):
    folder, bars = stored
    days = sorted(r["day"] for r in bars.select("day").distinct().collect())
    reader = DailyBarReader(f"file://{folder.replace(' ', '%20')}")
    whole = sum(len(p.files) for p in reader.partitions())
    assert whole >= len(days) * 4
    kept = [EqualTo(("ticker",), "click"), GreaterThanOrEqual(("day",), days[2]), LessThan(("day",), days[5])]
    other = [GreaterThanOrEqual(("close",), 1.0), StringContains(("ticker",), "c")]
    assert list(reader.pushFilters(kept + other)) == other
    files = [f for p in reader.partitions() for f in p.files]
    assert {f[1:] for f in files} == {("click", d) for d in days[2:5]} and len(files) < whole
    test = (F.col("ticker") == "click") & (F.col("day") >= days[2]) & (F.col("day") < days[5]) & (F.col("close") > 90)
    got, want = read_daily(spark, folder).where(test), bars.where(test)
    assert sorted(got.select(*bars.columns).collect()) == sorted(want.collect()) and want.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "day#" not in plan.split("Filter (", 1)[1].split("\n", 1)[0].replace("isnotnull(day#", "")  # decided by the source
    assert read_daily(spark, folder).where("ticker in ('click', 'nobody') and day = date'1999-01-01'").count() == 0


def test_bad_files_have_a_reason(spark, tmp_path):
    head = "Date,Open,High,Low,Close,Volume"
    files = {
        "ok": f"{head}\n2024-01-02 09:00:00,1,2,0.5,1.5,10\n2024-01-02 10:00:00,nan,inf,0.5,,10\n",
        "zero": "",
        "blank": "\n \n",
        "header": head,
        "short": f"{head}\n2024-01-02 09:00:00,1,2\n",
        "lacks": "Date,Open,High,Low,Close\n2024-01-02,1,1,1,1\n",
        "type": f"{head}\n2024-01-02 09:00:00,1,2,0.5,x,10\n",
        "stamp": f"{head}\nsoon,1,2,0.5,1,10\n",
        "extra": f"ticker,reason,{head}\nz,why,2024-01-02,1,1,1,1,1\n",
    }
    for name, text in files.items():
        at = tmp_path / f"ticker={name}" / "day=2024-01-02"
        at.mkdir(parents=True)
        (at / "part.csv").write_text(text)
        (at / ".part.csv.crc").write_text("no file of bars")
    pages = tmp_path / "ticker=__HIVE_DEFAULT_PARTITION__" / "day=2024-01-03"
    pages.mkdir(parents=True)
    (pages / "x.parquet").write_bytes(b"PAR1 but not really")
    got = read_daily(spark, str(tmp_path)).collect()
    reasons = {r["ticker"]: r["reason"] for r in got}
    wrong = "a value has the wrong type"
    assert reasons == {"ok": None, "extra": None, "zero": "empty", "blank": "empty", "header": "empty", "short": "broken", "lacks": "lacks volume", "type": wrong, "stamp": wrong, None: "broken"}
    assert len(got) == len(files) + 2
    ok = sorted((r for r in got if r["ticker"] == "ok"), key=lambda r: r["bar_ts"])
    assert [r["close"] for r in ok] == [1.5, None] and ok[1]["open"] is None and ok[1]["high"] is None and ok[1]["volume"] == 10
    bad = next(r for r in got if r["ticker"] == "zero")
    assert bad["day"] == dt.date(2024, 1, 2) and bad["bar_ts"] is None and bad["volume"] is None and isinstance(bad, Row)


def test_a_folder_without_files_and_one_that_is_not_there(spark, tmp_path):
    assert read_daily(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="nothing-here"):
        read_daily(spark, f"{tmp_path}/nothing-here").count()
