"""The language model: counts by brute force, probabilities that sum to one, seatings."""

import itertools
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from barloom.llm import pitman_yor as lm
from barloom.llm.common import checkpoint_folder

DOCS = "doc_id long, text string"


def corpus(seed, n):
    rng = random.Random(seed)
    chains = {w: rng.choices(["ein", "haus", "Stadt", "été", "x", "日本", "walking", "q" * 40], k=2) for w in ("", "ein", "haus", "stadt", "été", "x", "日本", "walking", "q" * 40)}
    rows = []
    for i in range(n):
        words = [""]
        for _ in range(rng.randrange(0, 40)):
            words.append(rng.choice(chains.get(words[-1].lower(), ["ein", "x"])) if rng.random() < 0.8 else f"n{rng.randrange(300)}")
        rows.append((i, " ".join(words[1:])))
    return rows


def odd(rows):
    return [*rows, (None, "ein haus"), (None, None), (9001, ""), (9002, " \t\n"), (9003, "ein " * 30000), (9004, "a\x00b"), (3, rows[3][1]), (3, rows[3][1]), (3, "other text")]


def plain_base(rows):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    own = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]) for i, t in rows]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, ws in own if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in own]


def rows_of(df):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2:]))


def test_counts_and_base_scores(spark):
    rows = odd(corpus(1, 200))
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as row", "2 as w", "3 as part", "4 as far").repartition(3)
    got = rows_of(lm.score_texts(df))
    want = sorted(plain_base(rows), key=lambda r: (r[0] is None, r[0] or 0, r[2:]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    # The texts repeat what training has seen, so the model has to tell more than single words do.
    held = [g for g in got if g[1] and 5 < g[2] < 1000]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)
    # Where a token is scored changes nothing, nor does the number of parts or another run.
    for how in ({"top_pairs": 0}, {"top_pairs": 40}, {}):
        assert np.allclose([g[6] for g in rows_of(lm.score_texts(df, **how))], [g[6] for g in got], rtol=1e-9)


def test_empty_tables_and_no_training_texts(spark):
    df = spark.createDataFrame(corpus(2, 5), DOCS)
    assert lm.score_texts(df.limit(0)).count() == 0
    got = rows_of(lm.score_texts(spark.createDataFrame([(None, "a b"), (None, None)], DOCS)))
    assert [(g[2], g[3], g[4]) for g in got] == [(1, 0, 0), (3, 0, 0)] and all(g[6] == 0.0 for g in got)


def test_probabilities_sum_to_one_in_every_context(spark):
    rows = corpus(3, 150)
    model = lm.train(spark.createDataFrame(rows, DOCS), part_pairs=200)
    assert model.n_parts > 1
    parts = [lm._read(r.asDict()) for r in model.state.collect()]
    look = lm.Lookup(lm._joined(parts, len(model.totals)), model.totals, model.n_words, model.n_tokens)
    assert len(look.w) == model.n_words
    every = np.r_[look.w, np.uint64(12345)]  # and a word that training has not seen
    for ctx in (0, ord("n"), ord("i") << 8 | ord("n"), ord("z") << 8 | ord("n"), ord("z") << 8 | ord("z"), 40000):
        _, _, score = look.score(every, np.full(len(every), ctx, np.uint16))
        assert abs((10**score).sum() - 1) < 1e-9, ctx


def partitions(n):
    """All partitions of n customers into tables, as lists of table sizes."""
    if n == 0:
        yield []
        return
    for rest in partitions(n - 1):
        yield [*rest, 1]
        for k in range(len(rest)):
            yield [*rest[:k], rest[k] + 1, *rest[k + 1 :]]


def test_draws_follow_the_weights_of_all_seatings():
    d, strength, others, parent, c = 0.6, 1.0, 3.0, 0.2, 6
    weight = Counter()
    for tables in partitions(c):
        w = math.prod(math.prod(k - d for k in range(1, n)) for n in tables)
        weight[len(tables)] += w * math.prod((strength + d * (others + j)) * parent for j in range(len(tables)))
    many = 200_000
    got = Counter(lm.draw_tables(np.full(many, c), np.full(many, others), np.full(many, parent), d, strength, np.random.default_rng(1)).tolist())
    for t, w in weight.items():
        assert abs(got[t] / many - w / sum(weight.values())) < 0.005, t


@pytest.mark.parametrize("c", [1, 2, 63, 64, 65, 5000, 3_000_000])
def test_draws_stay_in_range(c):
    t = lm.draw_tables(np.full(50, c), np.full(50, 10.0), np.full(50, 0.3), 0.5, 1.0, np.random.default_rng(2))
    assert (t >= 1).all() and (t <= c).all()


def test_steps_are_close_to_seating_one_by_one():
    d, others, parent, c = 0.5, 4.0, 0.1, 1500
    rng, t = np.random.default_rng(3), np.ones(4000)
    t[:] = lm.draw_tables(np.full(4000, 64), np.full(4000, others), np.full(4000, parent), d, 1.0, rng)
    for n in range(64, c):
        new = (1 + d * (others + t)) * parent
        t += rng.random(4000) < new / (n - d * t + new)
    got = lm.draw_tables(np.full(4000, c), np.full(4000, others), np.full(4000, parent), d, 1.0, rng)
    assert abs(got.mean() - t.mean()) < 0.05 * t.mean() and abs(got.std() - t.std()) < 0.15 * t.std()


def test_log_stirling_counts_seatings():
    s = lm.log_stirling(0.3)
    for c in range(1, 8):
        for t, own in itertools.groupby(sorted(partitions(c), key=len), key=len):
            assert math.isclose(math.exp(s[c, t]), sum(math.prod(math.prod(k - 0.3 for k in range(1, n)) for n in x) for x in own))


def test_contexts_are_whole_words(spark):
    # Both words before end alike, in many letters; only as wholes do they tell what follows.
    rows = [(i, "walking home" if i % 2 else "talking loud") for i in range(200)]
    held = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    asked = [(held[0], "walking home"), (held[1], "walking loud")]
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(spark.createDataFrame(rows + asked, DOCS)).collect()}
    assert got[held[0]] > got[held[1]] + 1


def test_rare_contexts_are_scored_by_their_own_totals(spark):
    rows = corpus(4, 200)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    model = lm.train(df, part_pairs=200, top_contexts=5)
    assert model.rare and 0 < len(model.totals[0].keys) <= 5 and model.n_parts > 1
    parts = [lm._read(r.asDict()) for r in model.state.collect()]
    whole = lm._joined(parts, len(model.totals))
    look = lm.Lookup(whole, model.totals, model.n_words, model.n_tokens)
    every = np.r_[whole.w, np.uint64(12345)]
    rare = np.unique(whole.code[whole.code >= 0])
    assert len(rare) > 100
    of = {}
    for ctx in rare:
        at = whole.code == ctx
        of[int(ctx)] = [float(x) for x in (whole.n[at].sum(), *(t[0][at].sum() for t in whole.samples()))]
    for ctx in rare[:20]:
        totals = [np.full(len(every), x) for x in of[int(ctx)]]
        _, _, score = look.score(every, np.full(len(every), ctx, np.uint64), totals)
        assert abs((10**score).sum() - 1) < 1e-9
    keys, texts = model.totals[0].keys, [t for _, t in rows]
    want = []
    for w, ctx, owner in lm.tokens(lm.pa.array(texts)):
        totals = [np.array([of.get(int(c), [0.0] * 3)[k] for c in ctx]) for k in range(3)]
        want += np.bincount(owner, look.score(w, ctx, totals)[2]).tolist()
    assert len(keys) and len(want) == len(rows)
    for top in (0, 40, 1 << 20):
        got = {r["doc_id"]: r["score"] for r in lm.score_texts(df, top_pairs=top, part_pairs=200, top_contexts=5).collect()}
        assert np.allclose([got[i] for i, _ in rows], want, rtol=1e-9)


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_rare_contexts_are_drawn_beside_the_tables_of_the_last_sweep(spark, broadcast):
    rows = corpus(5, 600)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    parts_of = lambda model: sorted(((r["part"], lm._read(r.asDict())) for r in model.state.collect()), key=lambda x: x[0])
    how = {"samples": 1, "part_pairs": 800, "top_contexts": 0}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        one, two = (lm.train(df, burn_in=k, **how) for k in (0, 1))
        last, got = parts_of(one), parts_of(two)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(last) > 1 and one.rare > 1
    tables, more = Counter(), 0
    for _, p in last:
        assert (p.code >= 0).all()
        for ctx, t in zip(p.code.tolist(), p.t3.tolist(), strict=True):
            tables[ctx] += t
    for (part, p), (same, drawn) in zip(last, got, strict=True):
        # By brute force: all tables of the context but the dish's own.
        others = np.array([tables[ctx] for ctx in p.code.tolist()]) - p.t3
        many = p.n > 1
        more += (others[many] > p.d[many] - 1).sum()
        p.d = np.where(many, others + 1, 0)
        want = lm.sweep(p, one.totals[-1], np.random.default_rng([1, part]), False)
        assert part == same and (want.code == drawn.code).all()
        for level in ("t3", "t2", "t1", "t0"):
            assert (getattr(want, level) == getattr(drawn, level)).all(), level
    assert more > 100


def test_the_result_reads_only_sums(spark):
    # Tokens and the model are gone from the disk when their sums are there.
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(400))) for i in range(300)]
    size = lambda: sum(p.stat().st_size for p in Path(checkpoint_folder(spark).removeprefix("file:")).rglob("*") if p.is_file())
    before = size()
    found = lm.score_texts(spark.createDataFrame(rows, DOCS).repartition(2), top_pairs=0, top_contexts=1000)
    assert size() - before < sum(len(t) for _, t in rows) / 4
    assert found.count() == len(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_index_finds_what_is_listed(n):
    rng = np.random.default_rng(4)
    listed = np.unique(np.r_[rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1), np.array([0, 2**64 - 1], np.uint64)[:n]])
    rng.shuffle(listed)
    asked = np.r_[listed, listed + np.uint64(1), rng.integers(0, 1 << 63, 50, np.uint64), np.array([0, 1, 2**64 - 1], np.uint64)]
    at, there = lm.Index(listed).find(asked)
    assert there.tolist() == np.isin(asked, listed).tolist()
    assert (listed[at[there]] == asked[there]).all()


def test_keys_do_not_depend_on_the_place():
    words = [b"a", b"ab", b"abcdefg", b"abcdefgh", b"abcdefghi", b"abcdefghijklmnop", b"abcdefghijklmnopq"]
    want = None
    for shift in range(9):
        buf = np.frombuffer(b"x" * shift + b"".join(words), np.uint8)
        end = shift + np.cumsum([len(w) for w in words])
        got = lm.word_keys(buf, end - [len(w) for w in words], end).tolist()
        want = want or got
        assert got == want and len(set(got)) == len(words)
