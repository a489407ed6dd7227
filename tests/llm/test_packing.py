"""Token pieces against the tokenizer itself; sequences against their contract."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from barloom.llm import packing
from barloom.llm.packing import CAPACITY, best_fit, crossover, encoder, evolve, pack

SCHEMA = "doc_id long, text string"


def reference():
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return t


def test_ids_are_those_of_the_tokenizer_file():
    t, ids_of = reference(), encoder()
    texts = ["", " ", "Hello  world\n\n x", "naïve Übung’s 中文 \U0001f600   x", "a" * 5000, " " * 300000 + "x", "\n" * 999, "don't I'LL we've 1234567 3.14", "<|endoftext|> y", "\x00\x07\x1c\x85 z", "".join(map(chr, range(0x300, 0x1000)))]
    for x in texts:
        assert ids_of(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x[:30]


def test_packs_every_piece_without_gaps(spark):
    rng, t = random.Random(2), reference()
    rows = [(i, " ".join(rng.choice(["alpha", "be", "Gamma,", "δέλτα", "x9"]) for _ in range(rng.choice([0, 3, 80, 700, 4000])))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "no id"), (502, "same"), (502, "same")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "2 as length", "3 as block")
    got = pack(df, block_pieces=64).collect()
    want = []
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % CAPACITY or CAPACITY
        cuts = [0, *range(first, len(ids), CAPACITY), len(ids)]
        want += [(i if i is not None else -1, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= CAPACITY
    assert pack(df.limit(0)).count() == 0


def test_genetic_search_beats_best_fit():
    rng = random.Random(4)
    sizes = [rng.randrange(300, 1100) for _ in range(300)]
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    start = best_fit(sizes, order, CAPACITY)
    best = evolve(sizes, CAPACITY, 1, generations=30)
    assert len(best) <= len(start)
    assert sorted(i for b in best for i in b) == list(range(len(sizes)))
    child = crossover(sizes, start, best, CAPACITY, rng)
    assert sorted(i for b in child for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= CAPACITY for b in child)


def triplets(n, seed):
    """Sizes of which three each fill a sequence: best fit pairs the wrong ones."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        a = rng.randrange(CAPACITY * 38 // 100, CAPACITY * 49 // 100)
        b = rng.randrange((CAPACITY - a) // 2 - CAPACITY // 10, (CAPACITY - a) // 2 + 1)
        out += [a, b, CAPACITY - a - b]
    rng.shuffle(out)
    return out


def test_search_saves_sequences_over_best_fit(monkeypatch):
    saved = []
    for seed in range(6):
        sizes = triplets(60, seed)
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
        start = best_fit(sizes, order, CAPACITY)
        first, second = (evolve(sizes, CAPACITY, k) for k in (1, 2))
        best = evolve(sizes, CAPACITY, 3, [first, second])  # elites migrate
        assert sorted(i for b in best for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= CAPACITY for b in best)
        saved.append(len(start) - len(best))
    assert min(saved) >= 0 and sum(saved) >= 3, saved
    calls = []
    monkeypatch.setattr(packing, "crossover", lambda *a: calls.append(1) or crossover(*a))
    evolve([CAPACITY] * 5, CAPACITY, 1)
    assert len(calls) == 2  # also where the first bins are as few as can be


def test_blocks_share_their_last_sequences(spark):
    rng = random.Random(5)
    rows = [(k, k, 0, 0, n, 0) for k, n in enumerate(rng.randrange(200, 1500) for _ in range(1500))]
    pieces = spark.createDataFrame(rows, packing._PIECES)
    got = packing.pack_pieces(pieces, block_pieces=40).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == sorted((r[1], r[4]) for r in rows)
    fill = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    least = -(-sum(fill.values()) // CAPACITY)
    alone = packing.pack_pieces(pieces, block_pieces=10**6).selectExpr("count(distinct sequence_id) as n").first()["n"]
    assert max(fill.values()) <= CAPACITY and len(fill) <= alone + 2, (len(fill), alone, least)


def test_few_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pack(docs).selectExpr("count(distinct sequence_id) as n", "sum(length) as total").first()
    assert got["n"] <= 1.002 * -(-got["total"] // CAPACITY) + 1


def test_special_tokens_in_texts_are_their_ids(spark):
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    texts = ["a <|endoftext|>", "<|endoftext|>" * 3, "<|endoftext| > x", "x <|endoftext|>y  <|endoftext|>\n", "plain"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[0][-1] == 50256
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in pack(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert got == {k: (len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())) for k, ids in enumerate(want)}
