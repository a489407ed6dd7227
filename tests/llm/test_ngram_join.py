"""The Jaccard join against all pairs."""

import random
import re

import pyarrow as pa
import pytest

from barloom.llm.components import components
from barloom.llm.ngram_join import drop_near_duplicates, jaccard_classes, shingle_sets
from barloom.llm.textarrays import draw_key

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root, links = list(range(len(sets))), [0] * len(sets)
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                links[a] += 1
                links[b] += 1
                ra, rb = root[a], root[b]
                root = [rb if r == ra else r for r in root]
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root[k]] = min(least.get(root[k], i), i)
    return sorted((i, len(s), least[root[k]], links[k]) for k, (i, s) in enumerate(sets))


def near_copies(seed, n_docs):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))] for _ in range(n_docs // 6)]
    rows = []
    for i in range(n_docs):
        words = list(rng.choice(bases[:3] if rng.random() < 0.4 else bases))
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words += passage
        text = " ".join(words)
        rows.append((i, text.upper() if rng.random() < 0.2 else text))
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_equals_all_pairs(spark, block):
    rows = near_copies(5, 400) + [(1000, ""), (1001, None), (1002, " \t"), (1003, "one two"), (1004, "ONE\ntwo"), (1005, "x " * 30000)]
    df = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], SCHEMA)
    got = jaccard_classes(df, block=block, heavy=8)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "n_links").collect()) == brute(rows)


def test_one_of_each_component_stays(spark):
    rows = near_copies(6, 150)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).selectExpr("*", "1 as n", "2 as cid", "3 as root")
    got = drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({c for _, _, c, _ in brute(rows)})


def test_nulls_repeats_and_empty(spark):
    text = "a b c d e f g h"
    rows = [(None, text), (None, text), (7, text), (7, text), (7, "other words are in this one here"), (None, None)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["n_links"]) for r in jaccard_classes(df).collect())
    assert got == [(-1, 0, -1, 0), (-1, 4, 7, 3), (-1, 4, 7, 3), (7, 3, 7, 0), (7, 4, 7, 3), (7, 4, 7, 3)]
    assert drop_near_duplicates(df).count() == 3
    assert jaccard_classes(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(500)] + [(900, 901), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(501), 0), 900: 900, 901: 900}


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") & 1] for k in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_a_power_of_two_cannot_tell_apart(spark, n):
    swap = str.maketrans("ab", "ba")
    rows = [(1, thue_morse(n)), (2, thue_morse(n).translate(swap)), (3, " ".join([thue_morse(n)] * 9)), (4, " ".join([thue_morse(n).translate(swap)] * 9))]
    got = jaccard_classes(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA))
    assert sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in got.collect()) == [(k, k, 0) for k in (1, 2, 3, 4)]


#: Two words that had one hash while bases and primes were fixed.
TWINS = ("mlonlmmnmlonlnlmmmolnonm", "nnlmonmmnnlmnlonmnlnlklm")


def test_words_made_to_collide(spark):
    long = [" ".join(chr(97 + k) + w for k in range(20)) for w in TWINS]
    rows = [(1, TWINS[0]), (2, TWINS[1]), (3, long[0]), (4, long[1])]
    got = jaccard_classes(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA))
    assert sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in got.collect()) == [(k, k, 0) for k in (1, 2, 3, 4)]


def test_hashes_depend_on_a_key_that_is_drawn():
    texts = pa.array(["a", " ".join(TWINS), "one two three four five six"])
    keys = [draw_key() for _ in range(2)]
    seen = [[s.tolist() for s in shingle_sets(texts, key)] for key in keys]
    assert seen[0] == [s.tolist() for s in shingle_sets(texts, keys[0])]
    assert all(not set(a) & set(b) for a, b in zip(*seen))
