"""Filter lists of thousands of rules; the classifier against a plain computation; secrets side by side."""

import hashlib
import math
import re
import threading

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import quality, secret_scan, url_rules
from barloom.llm.common import scratch, written
from barloom.llm.textarrays import mix

PAGES = "/root/testdata/sf0.1/pages.parquet"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def subject(url):
    host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups()
    return host.translate(LOWER), path


def test_thousands_of_rules_from_pages(spark, monkeypatch):
    """A filter list made of the pages' own hosts and paths: all pages' verdicts equal those
    of every rule tried on every URL, while the index lets few rules run."""
    pages = spark.read.parquet(PAGES)
    urls = {r["page_id"]: r["url"] for r in pages.select("page_id", "url").collect()}
    lines = []
    for k, url in enumerate(sorted(urls.values())):
        host, path = subject(url)
        last = path.strip("/").split("/")[-1]
        if k % 3:
            lines.append((f"||{host}^", f"@@||{host}{path}|", f"||{host}^*/{last}", f"|{host}{path[:4]}", f"/{last}^")[k % 5])
        if k % 2:
            lines.append(f"||{host}{path}^" if k % 4 == 1 else f"|{host}{path}|")
        if k % 300 == 0:
            lines.append(f"*{host.split('.')[0]}.example")  # no token: runs on every URL
    lines += ["! comment", "", "/casino[0-9]*[.-]/"]
    rules = tuple(dict.fromkeys(r for line in lines if (r := url_rules.parse_filter(line))))
    assert len(rules) > 2000
    compiled = [(r, re.compile(r.whole_pattern)) for r in rules]
    want, blocked = {}, 0
    for page, url in urls.items():
        host, path = subject(url)
        fits = [r for r, p in compiled if p.search(host + path)]
        best = max(fits, key=lambda r: (r.verdict == "allow", len(r.name), r.name), default=None)
        want[page] = best.verdict if best else "allow"
        blocked += want[page] == "block"
    assert 0 < blocked < len(urls)
    for most in (url_rules.BROADCAST_RULES, 100):  # sent to all tasks, and shuffled by token
        monkeypatch.setattr(url_rules, "BROADCAST_RULES", most)
        got = url_rules.judge_urls(pages.select("page_id", "url"), rules).collect()
        assert {r["page_id"]: r["verdict"] for r in got} == want and len(got) == len(urls)
    # The rules that a URL's tokens fetch, against all rules on all URLs.
    by_token = {}
    for token, *_ in url_rules.index_rules(rules):
        by_token[token] = by_token.get(token, 0) + 1
    run = sum(by_token.get(t, 0) for u in urls.values() for t in {"", *re.findall(r"[a-z0-9]+", "\n".join(subject(u)).translate(LOWER))})
    print("expressions run", run, "of", len(rules) * len(urls))
    assert run < 0.02 * len(rules) * len(urls)


def plain_features(text, bits=quality.BITS):
    data = text.encode()
    hashed = lambda v: int(mix(np.array([v], np.uint64))[0]) >> (64 - bits)
    out = {hashed((data[k] << 16 | data[k + 1] << 8 | data[k + 2]) + 1) for k in range(len(data) - 2)}
    kind = lambda c: 0 if c in b"abcdefghijklmnopqrstuvwxyz" or c >= 128 else 1 if c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 2 if c in b"0123456789" else 3
    codes, before = [], None
    for word in re.findall(rb"[^\x20\x09-\x0D]+", data):
        kinds = [kind(c) for c in word]
        runs = [k for n, k in enumerate(kinds) if n == 0 or kinds[n - 1] != k][:6]
        codes.append(2 * sum((k + 1) * 5**n for n, k in enumerate(runs)) + (word == before))
        before = word
    return out | {hashed((a << 40) + (b << 20) + c + (1 << 62)) for a, b, c in zip(codes, codes[1:], codes[2:])}


def test_scores_by_a_plain_computation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score_texts(docs, model).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        if len(text) > 20000:
            continue
        x = sorted(plain_features(text))
        norm = math.sqrt(sum(float(model.squares[k]) for k in x))
        margin = sum(float(model.weights[k]) for k in x) / norm if norm else 0.0
        assert abs(got[doc_id] - 1 / (1 + math.exp(-(model.slope * margin + model.offset)))) < 1e-4
    whole = max(texts.values(), key=len) + " Zq9! end" * 30000  # every byte of a long text counts
    assert set(next(quality.features(__import__("pyarrow").array([whole]))).tolist()) == plain_features(whole)


def test_fit_is_bounded_by_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    ids = labels.where("quality in (0, 1)").where(~quality.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("a"), F.max("quality").alias("b")).where("a = b")
    rows = ids.join(docs, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    most, used, first = 400_000, 0, []
    for r in rows:
        used += 4 * len(plain_features(r["text"] or ""))
        if used > most:
            break
        first.append(r["doc_id"])
    assert 10 < len(first) < len(rows)
    bounded = quality.train(docs, labels, train_bytes=most)
    wanted = quality.train(docs, labels.where(F.col("doc_id").isin(first)))
    whole = quality.train(docs, labels)
    same = lambda a, b: np.array_equal(a.weights, b.weights) and np.array_equal(a.squares, b.squares) and (a.slope, a.offset) == (b.slope, b.offset)
    assert same(bounded, wanted) and not same(bounded, whole)
    nothing = quality.train(docs, labels, train_bytes=0)  # no row fits: the model of no rows
    assert not nothing.weights.any() and quality.score_texts(docs.limit(3), nothing).where("score < 1").count() == 0


def test_runs_beside_base_spans(spark):
    """A run is tested where it overlaps no base span, however many spans a text has."""
    hexes = [hashlib.md5(str(k).encode()).hexdigest() for k in range(4000)]
    text = " ".join(f"token={h} {h[:5]}Zq{h[5:25]}" for h in hexes)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = next(secret_scan._scan(iter(docs.toArrow().to_batches()))).to_pylist()[0]
    spans = secret_scan.base_spans(text)
    runs = [m.span() for m in secret_scan.RUN.finditer(text)]
    free = {(s, e) for s, e in runs[:600] if not any(s < y and x < e for x, _, y in spans)}
    found = {(c["start"], c["stop"]) for c in row["candidates"] if c["start"] <= runs[599][0]}
    assert row["n_assign"] == 4000 and found and found == {(s, e) for s, e in free if secret_scan.battery(text[s:e])}


def test_threads_keep_their_own_tables(spark):
    """A block that ends in one thread leaves the tables of another."""
    ready, done, seen = threading.Event(), threading.Event(), []

    def other():
        with scratch(spark):
            table = written(spark.range(5))
            ready.set()
            done.wait(60)
            seen.append(table.count())

    worker = threading.Thread(target=other)
    worker.start()
    with scratch(spark):
        ready.wait(60)
    done.set()
    worker.join()
    assert seen == [5]
