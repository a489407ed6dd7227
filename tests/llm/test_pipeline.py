"""Every stage against a plain version, on its own input."""

import hashlib
import importlib.util
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline here", allow_module_level=True)

import corpus_pipeline

from tests.llm.test_ngram_join import brute
from tests.llm.test_operators import groups_by_text

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "best-fit packing"
    good, exact, near, mix, pack = (f for _, f in corpus_pipeline.STAGES)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = good(spark, docs, SF).cache()
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.schema == docs.schema
    assert sum(i in ids for i, q in labels.items() if q == 1) >= 0.97 * sum(q == 1 for q in labels.values())
    assert sum(i not in ids for i, q in labels.items() if q == 0) >= 0.8 * sum(q == 0 for q in labels.values())
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    once = exact(spark, kept, SF).cache()
    assert once.columns == docs.columns and {r["doc_id"] for r in once.collect()} == {k for _, k, _, _ in groups_by_text(rows)}
    rows = [(r["doc_id"], r["text"]) for r in once.collect()]
    few = near(spark, once, SF).cache()
    assert few.columns == docs.columns and sorted(r["doc_id"] for r in few.collect()) == sorted({c for _, _, c, _ in brute(rows)})
    mixed = mix(spark, few, SF).cache()
    assert mixed.columns == docs.columns
    # Each document as often as its source's budget takes it, and one cut a source.
    given, want = Counter(), plain_mix([r.asDict() for r in few.collect()])
    for r in mixed.collect():
        given[r["doc_id"]] += words(r["text"])
    assert {i: n for i, n in given.items() if n} == {i: n for i, n in want.items() if n}
    assert sum(words(r["text"]) == 0 for r in mixed.collect()) == sum(words(r["text"]) == 0 for r in few.collect())
    tokenizer, pieces = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), Counter()
    for r in mixed.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        pieces.update((r["doc_id"], k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:])))
    packed = pack(spark, mixed, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == pieces
    fill = {}
    for r in sorted(packed, key=lambda r: r["offset"]):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= 1.002 * -(-sum(fill.values()) // 2048) + 1


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_mix(rows):
    """doc_id -> words taken, by loops."""
    by, taken = defaultdict(list), Counter()
    for r in rows:
        by[r["source"]].append((hashlib.md5(f"7:{r['doc_id']}".encode()).hexdigest(), r["doc_id"], words(r["text"])))
    names = sorted(s for s in by if s is not None) + [None] * (None in by)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    size = {s: sum(n for _, _, n in by[s]) for s in by}
    target, left, open_ = {}, float(sum(size.values())), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in full} if full else {s: weight[s] * level for s in open_}
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    for s in by:
        epochs, rest = divmod(int(target[s] + 0.5), size[s]) if size[s] else (0, 0)
        for _, i, n in sorted(by[s]):
            taken[i] += epochs * n + min(n, rest)
            rest -= min(n, rest)
    return taken


def test_run_on_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, mark int, block int, `own mark` int, key string, h1 int"
    good = [" ".join(f"Quiet {k} evenings {w} by the river bring calm thoughts" for w in range(6)) for k in range(40)]
    rows = [(k, t, "en", "ab"[k % 2], len(t), 1, 2, 3, 4, "k", 5) for k, t in enumerate(good)]
    rows += [rows[3], rows[3], (None, good[5], None, None, None, 1, 2, 3, 4, None, 5), (None, None, None, None, None, 1, 2, 3, 4, None, 5), (90, "", "en", "a", 0, 1, 2, 3, 4, "k", 5), (91, "long words " * 40000, "en", "b", 440000, 1, 2, 3, 4, "k", 5)]
    labels = [(k, 1, 0) for k in range(40)]
    for name, own in (("odd", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(own, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder).cache()
            assert docs.schema.simpleString() == spark.read.parquet(f"{folder}/documents.parquet").schema.simpleString(), stage_name
        got = corpus_pipeline.run(spark, folder).collect()
        if not own:
            assert got == [] and docs.count() == 0
            continue
        whole = [r for r in docs.collect()]
        assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(r["doc_id"] for r in whole)
        assert {91, 90, 0} <= {r["doc_id"] for r in got}
