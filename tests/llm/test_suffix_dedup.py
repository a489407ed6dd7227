"""Removal of repeated strings against a dictionary of all strings."""

import random

import pytest

from barloom.llm.suffix_dedup import remove_repeats

SCHEMA = "doc_id long, text string"


def brute(rows, length):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        spans, p = [], 0
        while p < len(data):
            e = p
            while e < len(data) and gone[e] == gone[p]:
                e += 1
            if gone[p]:
                spans.append((p, e))
            p = e
        out.append((i, len(data), tuple(spans), bytes(b for b, g in zip(data, gone) if not g)))
    return out


def run(df, **how):
    got = remove_repeats(df, **how).collect()
    return sorted((r["doc_id"], r["n_bytes"], tuple(tuple(s) for s in r["spans"]), bytes(r["kept"])) for r in got)


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randrange(8, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(0, 6))]
        text = "\n".join(parts)
        if rows and rng.random() < 0.2:
            text = rng.choice(rows)[1]
        if text and rng.random() < 0.3:
            k = rng.randrange(len(text))
            text = text[:k] + rng.choice("xyz") + text[k + 1 :]
        rows.append((i, text))
    return rows


@pytest.mark.parametrize(("length", "gram"), [(100, 32), (40, 8)])
def test_equals_a_dictionary_of_all_strings(spark, length, gram):
    rows = texts(3, 160) + [(500, "ab" * 700), (501, "a" * 99), (502, "a" * 350), (503, ""), (504, None), (505, " a" * 40000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert run(df, length=length, gram=gram) == sorted(brute(rows, length))


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(None, "q" * 30 + "w" * 90), (4, "q" * 30 + "w" * 90), (4, "q" * 30 + "w" * 90)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "2 as part", "3 as covered", "4 as asked").coalesce(1)
    got = sorted((r["doc_id"] or -1, len(r["kept"])) for r in remove_repeats(df).collect())
    assert got == [(-1, 0), (4, 0), (4, 120)]
    assert remove_repeats(df.limit(0)).count() == 0


def test_rows_keep_their_numbers_when_splits_change(spark, tmp_path):
    rng = random.Random(6)
    own = ["".join(rng.choices("abcdefgh ", k=300)) for _ in range(60)]
    rows = [(k, own[k] + (own[k - 1][:150] if k % 3 else "")) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12, "doc_id").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    want = {r["doc_id"]: bytes(r["kept"]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        later = remove_repeats(docs)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        got = {r["doc_id"]: bytes(r["kept"]) for r in later.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want and any(len(got[k]) < len(rows[k][1]) for k in got)


def test_a_common_line_in_all_kinds_of_surroundings(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(12))
    line = " ".join(word() for _ in range(9))
    rows = [(i, f"{word()}{word()}\n{line[: rng.randrange(60, len(line))]}\n{word()}") for i in range(120)] + [(7, "other " + line)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = run(df, length=40, gram=8)
    by_hash = {i: [t for _, t in sorted((h, t) for h, j, t in ((r["h"], r["doc_id"], r["text"]) for r in df.selectExpr("*", "xxhash64(text) as h").collect()) if j == i)] for i in (7,)}
    ordered = [r for r in rows if r[0] < 7] + [(7, t) for t in by_hash[7]] + [r for r in rows if r[0] > 7]
    assert got == sorted(brute(ordered, 40))


def test_windows_made_to_collide_stay(spark):
    """The two words in the middle had one hash while bases and primes were fixed."""
    rng, rows = random.Random(4), []
    noise = lambda: "".join(rng.choices("abcdefghij ", k=60))
    for k in range(40):
        before, after = noise(), noise()
        rows += [(2 * k + j, before + w + after) for j, w in enumerate(("mlonlmmnmlonlnlmmmolnonm", "nnlmonmmnnlmnlonmnlnlklm"))]
    assert run(spark.createDataFrame(rows, SCHEMA)) == sorted(brute(rows, 100))
    assert all(not spans for _, _, spans, _ in brute(rows, 100))
