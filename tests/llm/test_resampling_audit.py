"""Importance resampling and the filter audit against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barloom.llm import filter_audit, resampling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows], DOCS)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def runs(text, n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    return len(w), [" ".join(w[k : k + m]) for m in range(1, n + 1) for k in range(len(w) - m + 1)]


def plain_resample(rows, target, buckets, n, least, pct):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = Counter(bucket(x) for _, text, _ in rows for x in runs(text, n)[1]), Counter(bucket(x) for text in target for x in runs(text, n)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (big_s + buckets)) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, text, _ in rows:
        words, own = runs(text, n)
        weight = sum(gain(bucket(x)) for x in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * pct // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize(("n", "pct"), [(1, 10), (1, 100), (2, 37)])
def test_resample_equals_a_plain_draw(spark, n, pct):
    rng = random.Random(3)
    word = lambda: rng.choice(["alpha", "Beta", "gamma7", "été", "日本語", "x-y", "don't", "a_b", "Z"])
    rows = [(k * 7 - 300 + (k % 5) * 2**40, " ".join(word() for _ in range(rng.randrange(0, 60))), "en") for k in range(150)]
    rows += [(None, "alpha " * 30, None), (None, "alpha " * 30, None), (5, "beta " * 25, "en"), (5, "beta " * 25, "en"), (-1, None, "en"), (-2, "", "en"), (-3, "-- !!", "en"), (-4, "q " * 20000, "en")]
    target = ["alpha beta gamma7 " * 5, "", None]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    df = docs_of(spark, rows).selectExpr("*", "1 as rank", "2 as row", "3 as bucket", "4 as weight").repartition(4)
    got = resampling.resample(df, goal, buckets=97, ngram=n, share_pct=pct)
    assert in_order(tuple(r) for r in got.collect()) == in_order(plain_resample(rows, target, 97, n, 20, pct))


def test_resample_draws_some_of_equal_rows_and_stands_empty_tables(spark):
    rows = [(1, "same words " * 20, "en")] * 40
    goal = spark.createDataFrame([], "text string")
    got = resampling.resample(docs_of(spark, rows), goal, share_pct=25).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11)) and len(got) == 40
    assert resampling.resample(docs_of(spark, rows).limit(0), goal).count() == 0
    assert [r["rank"] for r in resampling.resample(docs_of(spark, rows[:1]), goal).collect()] == [None]


def plain_audit(rows, labels):
    fails = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        marks = "".join(f for f, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search(r"[#$%&*|]", t), copy)) if bad)
        of = [x for x in labels if x[0] == i and i is not None]
        fails.append((lang or "", marks, any(q == 1 for _, q, _ in of), any(x == 1 for _, _, x in of)))
    out = []
    for part in sorted({p for p, *_ in fails}):
        own, sums, lines = [r for r in fails if r[0] == part], Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                here = [r for r in own if f in r[1] and not set(r[1]) & set(order[: step - 1])]
                kept = sum(not set(r[1]) & set(order[:step]) for r in own)
                redundant = sum(f in r[1] and bool(set(r[1]) & set(order[: step - 1])) for r in own)
                sums[f] += len(here)
                lines.append((part, order, step, kept, len(here), redundant, sum(r[1] == f for r in own), sum(r[2] for r in here), sum(r[3] for r in here), f))
        out += [(*x[:-1], sums[x[-1]]) for x in lines]
    return sorted(out)


def audit_rows():
    rng = random.Random(8)
    rows = []
    for k in range(120):
        words = [rng.choice(["one", "Two", "THREE", "vier", "fünf", "s€x"]) + (str(rng.randrange(400)) if rng.random() < 0.9 else "") for _ in range(rng.choice([3, 99, 100, 130, 400]))]
        text = " ".join(words) + rng.choice(["", "", " #", " |x"])
        if rows and rng.random() < 0.4:
            text = rng.choice(rows)[1]
        rows.append((rng.randrange(90), text, rng.choice(["en", "de", None, ""])))
    long = "abc " * 30000
    return rows + [(500, long + "x", "en"), (501, long + "y", "en"), (400, long + "x", "de"), (None, "", "en"), (None, None, "en"), (None, long + "y", "fr"), (7, "", "en"), (8, None, "en"), (9, "UPPER", "en")]


LABELS = [(k % 60, k % 2, int(k % 5 == 0)) for k in range(0, 80, 3)] + [(None, 1, 1), (3, None, None), (4, 1, None)]


def test_audit_equals_all_orders(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    df = docs_of(spark, audit_rows()).selectExpr("*", "1 as mask", "2 as points", "3 as blocks", "4 as part", "5 as good").repartition(4)
    got = filter_audit.audit(df, labels)
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(audit_rows(), LABELS)
    assert filter_audit.audit(df.limit(0), labels).count() == 0
    assert filter_audit.audit(df, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_copies_when_all_block_hashes_agree(spark, monkeypatch):
    """Only the texts themselves tell rows apart then."""
    marked = filter_audit._marked
    monkeypatch.setattr(filter_audit, "_marked", lambda docs: marked(docs).withColumns({"blocks": F.lit(b"12345678"), "points": F.lit(1).cast("long"), "mark": F.lit(1).cast("long")}))
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    rows = [(1, "a", "en"), (2, "b", "en"), (3, "a", "en"), (4, "c", "de"), (5, "b", "de")]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs_of(spark, rows), labels)
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, [])
