"""Exact dedup, media, quotes, mixing, URL rules, classifier and secrets on small cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from barloom.llm import exact_dedup, mixing, mpeg_audio, quality, quote_links, secret_scan, url_rules
from barloom.llm import queries as llm_queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCS)


# exact dedup


def groups_by_text(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    size, least = Counter(norm(t) for _, t in rows), {}
    for i, t in rows:
        least[norm(t)] = min(least.get(norm(t), i), i)
    return sorted((i, least[norm(t)], size[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)


def test_exact_groups_with_long_texts_and_collisions(spark):
    rng = random.Random(1)
    texts = ["a  b\tc", "a b c", "", " ", "\n", "é" * 50, "x" * 5000, "x" * 4999 + "y", "p q " * 900, "p\nq " * 900, "plain"]
    rows = [(i, rng.choice(texts)) for i in range(90)] + [(900, None)]
    df = docs_of(spark, [(i, t, "s") for i, t in rows]).selectExpr("*", "1 as norm", "2 as h1", "3 as chunk")
    for how in ({}, {"chunk_chars": 64, "members_per_copy": 4}, {"primes": (3, 5), "bases": (2, 3)}):
        got = exact_dedup.exact_duplicates(df, **how).collect()
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == groups_by_text(rows), how
        assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})


def test_exact_nulls_repeats_and_empty(spark):
    df = docs_of(spark, [(None, "t", None), (3, "t", "a"), (3, "t", "a"), (None, None, None)])
    got = sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(df).collect())
    assert got == [(-1, -1, 1, True), (-1, 3, 3, False), (3, 3, 3, False), (3, 3, 3, True)]
    assert exact_dedup.drop_duplicates(df).count() == 2 and exact_dedup.drop_duplicates(df).columns == df.columns
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0


def test_fingerprints_compose():
    data = np.frombuffer(random.Random(2).randbytes(5000), np.uint8)
    whole = [exact_dedup.fingerprint(data, b, p) for b, p in zip(exact_dedup.BASES, exact_dedup.PRIMES)]
    parts = [(len(x), *(exact_dedup.fingerprint(x, b, p) for b, p in zip(exact_dedup.BASES, exact_dedup.PRIMES))) for x in (data[:7], data[7:4000], data[4000:])]
    assert exact_dedup.combine(parts) == (5000, *whole)


# media


def test_media_round_trip_and_damage(spark):
    rows = [(1, "hello é" * 500), (2, ""), (3, None), (4, "\xff\xfb" * 900), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as media")
    got = {r["doc_id"]: r for r in mpeg_audio.store_texts(df, keep_media=True).collect()}
    for i, t in rows:
        payload = mpeg_audio.payload_of((t or "").encode())
        assert len(payload) % 64 == 0 and len(payload) >= 64
        assert got[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got[i]["payload_bytes"] == len(payload)
        scanned = mpeg_audio.scan(bytes(got[i]["media"]))
        assert scanned.payload == payload and scanned.bad_crc == 0 and scanned.resyncs == 0 and scanned.vbr["frames"] == len(scanned.offsets)
    media = bytes(got[1]["media"])
    s = mpeg_audio.scan(media)
    assert s.samples == 1152 * len(s.offsets) and s.tags["payload_bytes"] == str(got[1]["payload_bytes"])
    cut = media[: s.offsets[1]] + b"\0junk\xff\xfb" + media[s.offsets[1] :]
    hurt = mpeg_audio.scan(cut)
    assert hurt.resyncs == 1 and len(hurt.offsets) == len(s.offsets)
    bad = bytearray(media)
    bad[s.offsets[0] + 8] ^= 1
    assert mpeg_audio.scan(bytes(bad)).bad_crc == 1
    assert mpeg_audio.read_media(spark.createDataFrame([(1, bytearray(media)), (2, None)], "doc_id long, media binary")).count() == 2
    assert mpeg_audio.store_texts(df.limit(0)).count() == 0


def test_media_with_the_letters_of_a_tag_in_the_payload(spark):
    rows = [(n, ("x" * at + "TAG").ljust(n, "y")) for n in (64, 640, 960, 1984, 12672) for at in range(n - 3) if at % 64 < 2] + [(64 * k, "TAG" * (64 * k // 3)) for k in range(1, 200)]
    got = mpeg_audio.store_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = sorted((n, hashlib.sha256(mpeg_audio.payload_of(t.encode())).hexdigest()) for n, t in rows)
    assert sorted((r["doc_id"], r["payload_sha256"]) for r in got) == want


def test_media_tag_at_the_end():
    payload = bytes(range(256)) * 20
    media, v1 = mpeg_audio.encode(payload), b"TAG" + b"a title".ljust(30, b"\0") + b"\xff" * 95
    # "TAG" exactly 128 bytes before the end of the stream, in the last frame.
    data = bytearray(64 * 30)
    at = len(mpeg_audio.encode(bytes(data)))
    inside = next(k for k in range(len(data)) if mpeg_audio.encode(bytes(k) + b"TAG" + bytes(len(data) - k - 3))[at - 128 : at - 125] == b"TAG")
    data[inside : inside + 3] = b"TAG"
    got = mpeg_audio.scan(mpeg_audio.encode(bytes(data)))
    assert got.payload == data and got.missing == 0 and "TIT2" not in got.tags
    first = got.offsets[0]
    hurt = mpeg_audio.encode(bytes(data))
    assert mpeg_audio.scan(hurt[:first] + b"junk" + hurt[first:]).payload == data
    tagged = mpeg_audio.scan(media + v1)
    assert tagged.payload == payload and tagged.tags["TIT2"] == "a title" and tagged.resyncs == 0
    assert mpeg_audio.scan(media[: mpeg_audio.scan(media).offsets[-1]] + v1).missing > 0


# quotation linking


def test_quotes_link_and_order(spark):
    rows = [
        (1, 0, "user", "How are you?\nFine weather."), (1, 1, "assistant", "> How  are YOU?\nGood."), (1, 2, "user", "> Fine weather.\nIndeed."),
        (1, 3, "user", ">> How are you?\n> Good.\nAnd you?"), (1, 4, "user", "> nobody said this\nhm"), (2, 0, "user", "> How are you?"), (None, 1, "user", "x"), (3, 0, None, None), (1, 1, "assistant", "> How  are YOU?\nGood."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as bucket", "2 as hash", "3 as message")
    got = {(r["conv_id"], r["turn"]): r for r in quote_links.link_quotes(df).collect()}
    assert len(got) == 7
    assert [got[1, t]["body"] for t in range(5)] == ["How are you?\nFine weather.", "Good.", "Indeed.", "And you?", "hm"]
    assert [got[1, t]["parent_turn"] for t in range(5)] == [None, 0, 0, 1, 3]
    assert got[1, 3]["max_level"] == 2 and got[1, 3]["n_linked"] == 2 and got[1, 4]["n_linked"] == 0 and got[2, 0]["parent_turn"] is None
    assert [(got[1, t]["thread"], got[1, t]["depth"]) for t in range(5)] == [(0, 0), (0, 1), (0, 1), (0, 2), (4, 0)]
    assert sorted(range(5), key=lambda t: got[1, t]["reply_order"]) == [0, 1, 3, 2, 4]
    assert quote_links.link_quotes(df.limit(0)).count() == 0


def test_whole_passage_comes_before_its_lines(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "u", "Thanks\nSee A"), (1, 1, "u", "Thanks"), (1, 2, "u", "> Thanks\n> See A\nok"), (1, 3, "u", "> Thanks\n> See B"), (1, 4, "u", ">> Thanks\n>>  see a")]
    got = {r["turn"]: r for r in quote_links.link_quotes(spark.createDataFrame(rows, schema)).collect()}
    assert [got[t]["parent_turn"] for t in range(5)] == [None, 0, 0, 1, 3]
    assert [got[t]["n_linked"] for t in range(5)] == [0, 0, 1, 1, 1] and (got[2]["thread"], got[2]["depth"]) == (0, 1)


def test_messages_without_a_key_are_rows(spark, tmp_path):
    text = "a\r\n> b\n>> c\nd\n> e\n> f"
    rows = [(1, 0, "u", text), (None, 1, "u", text), (None, 1, "u", text), (2, None, "u", None), (None, None, "u", "> x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r for r in llm_queries.op5_quote_links(spark, str(tmp_path)).collect()}
    assert len(got) == 4
    facts = lambda r: (r["message"], r["body"], r["n_quotes"], r["max_level"], r["n_linked"])
    assert facts(got[None, 1]) == facts(got[1, 0]) and got[None, 1]["n_quotes"] == 3
    assert [got[2, None][c] for c in ("body", "n_quotes", "parent_turn", "thread", "depth", "reply_order")] == ["", 0, None, None, None, None] and got[None, None]["max_level"] == 1


def test_long_conversation_equals_a_loop(spark):
    rng = random.Random(3)
    said, rows = [], []
    for t in range(300):
        line = f"line {rng.randrange(40)}"
        quote = f"> {rng.choice(said)}\n" if said and rng.random() < 0.5 else ""
        rows.append((7, t, "user", quote + line))
        said.append(line)
    got = {r["turn"]: r for r in quote_links.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for t, (_, _, _, text) in enumerate(rows):
        if text.startswith(">"):
            q = text.split("\n")[0][2:]
            assert got[t]["parent_turn"] == max(k for k in range(t) if said[k] == q)
        else:
            assert got[t]["parent_turn"] == (t - 1 if t else None)
    assert sorted(r["reply_order"] for r in got.values()) == list(range(1, 301))


def plain_links(rows):
    """All columns by loops: rows are (conv_id, turn, role, text), one message a turn."""
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t).strip(" ").lower()
    out, said = {}, defaultdict(list)
    for conv, turn, _, text in sorted(rows, key=lambda r: r[:2]):
        blocks = []
        for line in re.split("\r?\n", text or ""):
            mark = re.match(r"(?:\x20*>)+\x20?", line)
            level = mark[0].count(">") if mark else 0
            if not blocks or blocks[-1][0] != level:
                blocks.append((level, []))
            blocks[-1][1].append(line[mark.end() :] if mark else line)
        find = lambda t: max((k for k, pieces in said[conv] if norm(t) and norm(t) in pieces), default=None)
        quotes = []
        for level, lines in blocks:
            if level:
                whole = find("\n".join(lines))
                each = [k for k in map(find, lines) if k is not None]
                quotes.append((level, whole if whole is not None else max(each, default=None)))
        quoted = max((k for level, k in quotes if level == 1 and k is not None), default=None)
        own = [lines for level, lines in blocks if level == 0]
        out[conv, turn] = {"body": "\n".join("\n".join(x) for x in own), "n_quotes": len(quotes), "max_level": max((v for v, _ in quotes), default=0), "n_linked": sum(k is not None for _, k in quotes), "quoted": quoted}
        out[conv, turn]["parent_turn"] = quoted if quoted is not None else (said[conv][-1][0] if said[conv] else None)
        said[conv].append((turn, {norm("\n".join(x)) for x in own} | {norm(y) for x in own for y in x}))
    kids = defaultdict(list)
    for conv, turn in sorted(out):
        kids[conv, out[conv, turn]["quoted"]].append(turn)
    for conv in {c for c, _ in out}:
        order, stack = [], [(t, t, 0) for t in reversed(kids[conv, None])]
        while stack:
            t, root, depth = stack.pop()
            order.append(t)
            out[conv, t] |= {"thread": root, "depth": depth, "reply_order": len(order)}
            stack += [(c, root, depth + 1) for c in reversed(kids[conv, t])]
    return out


def test_planted_quotes_equal_loops_in_every_column(spark):
    rng, rows = random.Random(21), []
    for conv in range(12):
        said = []
        for turn in range(rng.randrange(1, 45)):
            own = ["", " Mixed  Case LINE"] if rng.random() < 0.05 else [f"line {rng.randrange(30)}" for _ in range(rng.randrange(1, 4))]
            lines = []
            for _ in range(rng.randrange(0, 3) if said else 0):
                source = rng.choice(said[:1] if conv == 3 else said)  # in one conversation all quote the first
                at = rng.randrange(len(source))
                passage = source if rng.random() < 0.6 else source[at : at + 1] if rng.random() < 0.8 else ["nobody said this"]
                lines += [rng.choice(["> ", ">", ">> ", "> > "]) + x for x in passage] + (["so"] if rng.random() < 0.5 else [])
            rows.append((conv, turn * 3, rng.choice(["user", None]), rng.choice(["\n", "\r\n"]).join(lines + own)))
            said.append(own)
    rows += [(50, k, "user", f"> m{k - 1}\nm{k}" if k else "m0") for k in range(200)]  # one long chain
    rows += [(51, 0, "user", ""), (51, 1, "user", None), (51, 2, "user", "> "), (52, 5, "user", "x " * 200000 + "\n> y")]
    got = {(r["conv_id"], r["turn"]): r.asDict() for r in quote_links.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = plain_links(rows)
    assert got.keys() == want.keys() and sum(w["n_linked"] for w in want.values()) > 250 and want[50, 199]["depth"] == 199
    for key, w in want.items():
        assert {c: got[key][c] for c in w if c != "quoted"} == {c: v for c, v in w.items() if c != "quoted"}, key


# mixing


def test_mix_takes_each_target(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "b", "c", None])) for i in range(400)] + [(1000, "z " * 5000, "d"), (None, None, "e")]
    df = docs_of(spark, rows).selectExpr("*", "1 as size", "2 as key")
    got = mixing.mix_sources(df, bucket_rows=16).collect()
    by = defaultdict(lambda: [0, 0])
    target = {}
    for r in got:
        by[r["source"]][0] += r["size"]
        by[r["source"]][1] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(by[s][1] - target[s]) <= 1 for s in by) and all(by[s][0] == next(r["source_size"] for r in got if r["source"] == s) for s in by)
    # Shares dealt in rounds, the excess over three times the size to the others.
    names = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, left, open_ = {}, float(sum(v[0] for v in by.values())), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * by[s][0]}
        if not full:
            want |= {s: weight[s] * level for s in open_}
            break
        want |= {s: 3.0 * by[s][0] for s in full}
        left -= sum(want[s] for s in full)
        open_ -= full
    assert all(abs(want[s] - target[s]) < 1e-6 * (1 + want[s]) for s in names)
    mixed = mixing.apply_mix(df)
    words = sum(len((r["text"] or "").split()) for r in mixed.collect())
    assert words == sum(r["taken"] for r in got) and mixed.columns == df.columns
    assert mixing.mix_sources(df.limit(0)).count() == 0


# URL rules


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/x?q#f", "https://www.example.com/en/", "https://example.com/fr/", "http://x.net/es/a", "http://net/fr/", "http://com", "no scheme", None, "http://notexample.com/en/", "x://b.adserver.org/", "https://casino.org/p", "http://q.org/wp-login.php?x", "http://EXAMPLE.com?/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 as host", "2 as token", "3 as name")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge_urls(df).collect()}
    assert [got[k] for k in range(13)] == [("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("com/", "allow"), ("net/es/", "block"), ("net/fr/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/", "allow"), (None, "block"), (None, "block"), (None, "block"), (None, "allow")]
    many = tuple(url_rules.domain_rule("block", f"h{k}.org") for k in range(500))
    assert len({row[0] for row in url_rules.index_rules(many)}) == 500  # each under its own token
    assert url_rules.judge_urls(df.limit(0)).count() == 0 and url_rules.judge_urls(df, rules=()).count() == 13


def test_url_patterns_without_a_common_token(spark, monkeypatch):
    block = ["http://ads.example.org/", "http://ad.x.org/", "http://x.ad2.y.org/a", "http://adserver2.x.org", "http://adserver.x.org/", "http://my-casino.org/p", "http://online-casino-x.org"]
    allow = ["http://bad.x.org/", "http://x.org/ad.y/", "http://adx.x.org/", "http://x.org/the-casino-story", "http://x.org/a.casino.b", "http://x.org/a\n.ad.\n"]
    df = spark.createDataFrame(list(enumerate(block + allow)), "page_id long, url string")
    for most in (url_rules.BROADCAST_RULES, 0):
        monkeypatch.setattr(url_rules, "BROADCAST_RULES", most)
        got = {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(df).collect()}
        assert [got[k] for k in range(len(got))] == ["block"] * len(block) + ["allow"] * len(allow)


# classifier


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out")
    right = got.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("share")).collect()
    assert all(r["share"] > 0.97 for r in right) and len(right) == 2


def test_classifier_edges(spark):
    rows = [(i, ("good words here number %d" % i) if i % 2 else "### %%% $$$ &&&" * (i % 5 + 1), None) for i in range(200)] + [(None, "x", None), (500, "", None), (501, None, None), (502, "z " * 60000, None)]
    df = docs_of(spark, rows).selectExpr("*", "1 as y", "2 as score")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(3, 0, 0), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels).collect()
    assert len(got) == 204 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] < 200]) > 0.95
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in got)
    assert quality.classify(df, labels.limit(0)).where("predicted = 1").count() == 204  # nothing learned: nothing rejected
    assert quality.classify(df.limit(0), labels).count() == 0


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.array(sorted({int(rng.integers(0, 50)), 60 + (k % 2)}), np.int32) for k in range(200)]
    y = np.arange(200) % 2
    w = quality.dual_descent(rows, [np.ones(len(r)) / np.sqrt(len(r)) for r in rows], y, 64, 1.0, 50)
    assert all((w[r].sum() > 0) == bool(c) for r, c in zip(rows, y))


# secrets


def test_secrets_base_and_random(spark):
    rng = random.Random(8)
    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    tokens = ["".join(rng.choice(b62) for _ in range(40)) for _ in range(30)]
    words = [f"some_long_identifier_name_{k}" for k in range(300)]
    rows = [(0, "ＡPASSWORD = 'hunter2hunter2' token:short"), (1, "AKIA" + "Z9" * 8 + " AKIAX"), (2, "é " + "0af3" * 8 + " " + "a" * 31), (3, None), (4, "")]
    rows += [(10 + k, f"x {t} y") for k, t in enumerate(tokens)] + [(100 + k, f"use {w}({k}) aaaaaaaaaaaaaaaaaaaaaaaa1") for k, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as base", "2 as candidates")
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(df).collect()}
    assert got[0]["spans"] == "assign:1:27" and got[1]["spans"] == "access:0:20" and got[2]["spans"] == "hex:2:34" and got[3]["spans"] == got[4]["spans"] == ""
    assert (got[0]["n_assign"], got[1]["n_access"], got[2]["n_hex"]) == (1, 1, 1)
    assert got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert sum("random:2:42" in got[10 + k]["spans"] for k in range(30)) >= 27
    assert sum("random" in got[100 + k]["spans"] for k in range(300)) == 0
    assert secret_scan.scan_secrets(df.limit(0)).count() == 0


def test_secrets_after_an_equals_sign_and_without_digits(spark):
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    forms = ["AWS_ACCESS_KEY_LONG_NAME={}", "sig={}", "http://x.org/?sig={}&a=1", "export K={}==", "x {} y", "{}=1"]
    rows, at = [], {}
    for k in range(120):
        form = forms[k % len(forms)]
        token = "".join(rng.choice(letters if k % 2 else letters + "0123456789") for _ in range(24))
        rows.append((k, form.format(token)))
        s = form.index("{}")
        at[k] = f"random:{s}:{s + 24 + 2 * form.endswith('=='):d}"
    names = ["getElementsByClassName", "AWS_SECRET_ACCESS_KEY=x", "updateUserAccountPreferences", "SPRING_DATASOURCE_DRIVER_NAME=", "spark_sql_shuffle_partitions", "TransactionAwarePersistenceManager"]
    rows += [(1000 + k, f"use {names[k % len(names)]}") for k in range(600)]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in range(6):
        own = [k for k in range(120) if k % 6 == kind]
        assert sum(at[k] in got[k].split(",") for k in own) >= len(own) - 3, forms[kind]
    assert sum(got[1000 + k] != "" for k in range(600)) == 0


def test_arrays_of_pyarrow_slices():
    from barloom.llm.textarrays import buffer_of

    buf, off = buffer_of(pa.array(["ab", None, "é", ""]).slice(1))
    assert bytes(buf) == "é".encode() and off.tolist() == [0, 0, 2, 2]


def test_word_shapes_compare_whole_words():
    code = lambda text: quality._shapes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0].tolist()
    same, other = code("x" * 65 + " " + "x" * 65), code("x" * 65 + " " + "x" * 64 + "y")
    assert same[1] & 1 and not other[1] & 1
    long = code("x" * 300000 + " " + "x" * 300000 + " " + "x" * 299999 + "y")
    assert [c & 1 for c in long] == [0, 1, 0]


def test_hosts_and_paths_with_line_feeds(spark):
    urls = ["http://a\nb.com/x", "http://q\n.net/es/", "http://com\n/x", "http://x.net/\n/es/", "http://x.net/es/\n", "s://a\nb.example.com/en/\nq"]
    df = spark.createDataFrame(list(enumerate(urls)) + [(None, urls[0]), (0, urls[0])], "page_id long, url string")
    got = [(r["page_id"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(df).collect()]
    want = [(0, "com/", "allow"), (1, "net/es/", "block"), (2, None, "allow"), (3, None, "allow"), (4, "net/es/", "block"), (5, "example.com/en/", "block"), (None, "com/", "allow"), (0, "com/", "allow")]
    assert sorted(got, key=str) == sorted(want, key=str)


FILTERS = ["! a comment", "[Header 2.0]", "", "example.org##.banner", "||ads.example.org^", "/banner/*/img^", "|track.", "pixel.gif|", "@@||good.ads.example.org^", "/adv[0-9]+/", "||x.io/a.b*c|", "swf|", "foo*bar"]


def plain_filter(line, host, path):
    """The syntax in words, by a walk over the pattern."""
    body = line[2:] if line.startswith("@@") else line
    s = (host + path).lower()
    if body[0] == body[-1] == "/" and len(body) > 2:
        return re.search(body[1:-1], s) is not None
    core = body.strip("|").lower()

    def at(i, k):
        if k == len(core):
            return i == len(s) or not body.endswith("|")
        if core[k] == "*":
            return any(at(j, k + 1) for j in range(i, len(s) + 1))
        if core[k] == "^":
            return (i == len(s) and at(i, k + 1)) or (i < len(s) and not re.match(r"[a-z0-9_.%-]", s[i]) and at(i + 1, k + 1))
        return i < len(s) and s[i] == core[k] and at(i + 1, k + 1)

    starts = range(len(s) + 1)
    if body.startswith("||"):
        starts = [0] + [i + 1 for i, c in enumerate(host) if c == "."]
    elif body.startswith("|"):
        starts = [0]
    return any(at(i, 0) for i in starts)


def test_filter_lines_fit_where_their_syntax_says(spark):
    rng = random.Random(11)
    bits = ["ads", "example", "org", "good", "track", "banner", "img", "pixel", "gif", "x", "io", "a", "b", "c", "adv12", "swf", "foo", "bar", "FOO"]
    urls = ["http://" + ".".join(rng.choices(bits, k=rng.randrange(1, 5))) + "".join(rng.choice("/./_-") + rng.choice(bits) for _ in range(rng.randrange(0, 6))).replace(".", "/", 1) for _ in range(400)]
    urls += ["http://ads.example.org", "http://a.good.ads.example.org/x", "http://track.x/", "http://x.io/a.b/c", "http://b/banner/q/img", "http://q/foo/xbar", "http://q/pixel.gif", "http://q/adv7"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = tuple(r for r in map(url_rules.parse_filter, FILTERS) if r)
    assert len(rules) == 9 and {t for r in rules for t in r.tokens} >= {"ads", "example", "banner"} and "bar" not in {t for r in rules for t in r.tokens}
    got = {r["page_id"]: (r["host"], r["path"], r["verdict"]) for r in url_rules.judge_urls(df, rules).collect()}
    for k in range(len(urls)):
        host, path, verdict = got[k]
        fits = [line for line in FILTERS[4:] if plain_filter(line, host, path)]
        assert verdict == ("block" if fits and not any(f.startswith("@@") for f in fits) else "allow"), (urls[k], fits)
    assert {v for _, _, v in got.values()} == {"block", "allow"}
    try:
        url_rules.parse_filter("||x.org^$third-party")
    except ValueError:
        return
    raise AssertionError("options were taken")


def test_mix_of_repeated_rows(spark):
    rows = [(1, "a b c d e f g", "s1")] * 6 + [(None, "x y", "s1")] * 5 + [(2, None, "s1"), (2, "", None)] + [(k, "w " * 50, "s2") for k in range(9)]
    df = docs_of(spark, rows).selectExpr("*", "1 as row", "2 as taken", "3 as size", "4 as doc")
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    want = Counter()
    for r in got:
        want[r["source"]] += r["taken"]
    mixed = mixing.apply_mix(df)
    assert mixed.columns == df.columns
    have = Counter()
    for r in mixed.collect():
        have[r["source"]] += len((r["text"] or "").split())
    assert have == want and all(v for v in want.values() if v) and mixing.apply_mix(df.limit(0)).count() == 0
    assert sum(r["text"] is None or r["text"] == "" for r in mixed.collect()) == 2


def frames_of(version, layer, index, rate, n, crc=False, mono=False):
    """Silent frames of any kind, built by the formulas of the format."""
    base = {3: 1, 2: 2, 0: 2.5}[version]
    table = {(True, 1): mpeg_audio.BITRATES_1_I, (True, 2): mpeg_audio.BITRATES_1_II, (True, 3): mpeg_audio.BITRATES_1, (False, 1): mpeg_audio.BITRATES_2_I}.get((base == 1, layer), mpeg_audio.BITRATES_2)
    hertz = mpeg_audio.RATES[rate] // {1: 1, 2: 2, 2.5: 4}[base]
    samples = 384 if layer == 1 else 1152 if layer == 2 or base == 1 else 576
    slot = 4 if layer == 1 else 1
    size = samples * table[index] * 1000 // (8 * hertz * slot) * slot
    head = bytes((0xFF, 0xE0 | version << 3 | (4 - layer) << 1 | (not crc), index << 4 | rate << 2, 0xC0 if mono else 0))
    body = head
    if crc:
        side = {(True, True): 17, (True, False): 32, (False, True): 9, (False, False): 17}[base == 1, mono]
        c = 0xFFFF
        for byte in head[2:] + bytes(side):
            for k in range(7, -1, -1):
                c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15 ^ byte >> k) & 1 else 0)
        body += c.to_bytes(2, "big")
    return body.ljust(size, b"\0") * n, size, samples, hertz


def test_media_of_other_layers_versions_and_tables(spark):
    for version in (3, 2, 0):
        for layer in (1, 2, 3):
            for index in (1, 5, 14):
                for rate in range(3):
                    data, size, samples, hertz = frames_of(version, layer, index, rate, 4)
                    got = mpeg_audio.scan(b"\0junk" + data)
                    assert (got.offsets, got.samples, got.rate) == ([5 + k * size for k in range(4)], 4 * samples, hertz), (version, layer, index, rate)
    for version in (3, 2, 0):
        for mono in (True, False):
            data, size, samples, _ = frames_of(version, 3, 8, 0, 3, crc=True, mono=mono)
            hurt = bytearray(data)
            hurt[size + 7] ^= 4
            assert (mpeg_audio.scan(data).checked, mpeg_audio.scan(data).bad_crc, mpeg_audio.scan(bytes(hurt)).bad_crc) == (3, 0, 1)
    data, size, samples, _ = frames_of(3, 3, 9, 0, 3)
    table = b"VBRI" + b"\0\1\0\0\0d" + (3 * size).to_bytes(4, "big") + (2).to_bytes(4, "big") + bytes((0, 2, 0, 1, 0, 2, 0, 1)) + (700).to_bytes(2, "big") + (701).to_bytes(2, "big")
    vbri = data[:36] + table + data[36 + len(table) :]
    got = mpeg_audio.scan(vbri)
    assert got.vbr == {"kind": "VBRI", "frames": 2, "bytes": 3 * size, "toc": [700, 701], "frames_per_entry": 1} and len(got.offsets) == 2
    text = "TPE1" + "Björk"
    v24 = b"ID3\x04\0\0\0\0\0" + bytes([10 + 7]) + b"TPE1\0\0\0\x07\0\0\x03" + text[4:].encode()
    assert mpeg_audio.scan(v24 + vbri).tags["TPE1"] == "Björk"
    rows = [(1, bytearray(mpeg_audio.encode(b"q" * 640))), (1, bytearray(mpeg_audio.encode(b"q" * 640))), (2, bytearray(vbri)), (None, None), (3, bytearray(b"\xff"))]
    read = [r.asDict() for r in mpeg_audio.read_media(spark.createDataFrame(rows, "doc_id long, media binary").selectExpr("*", "1 as tags")).collect()]
    assert sorted((r["doc_id"] or 0, len(r["frame_offsets"]), r["vbr_kind"], r["intact"]) for r in read) == sorted([(1, 1, "Xing", True), (1, 1, "Xing", True), (2, 2, "VBRI", None), (0, 0, None, None), (3, 0, None, None)], key=str)


def test_media_every_place_of_a_tag_and_changed_payloads():
    for n in list(range(1, 400, 3)) + [2000]:
        for at in range(0, n, 7 if n < 400 else 31):
            payload = mpeg_audio.payload_of((b"x" * at + b"TAG").ljust(n, b"y")[:n])
            assert mpeg_audio.scan(mpeg_audio.encode(payload)).payload == payload
    media = bytearray(mpeg_audio.encode(b"p" * 6400))
    assert mpeg_audio.scan(bytes(media)).intact
    media[mpeg_audio.scan(bytes(media)).offsets[1] + 500] ^= 1
    got = mpeg_audio.scan(bytes(media))
    assert got.bad_crc == 0 and got.intact is False


def test_battery_keeps_its_level_on_random_tokens():
    rng = random.Random(13)
    for name, alphabet, _ in secret_scan.ALPHABETS:
        for n in (24, 40, 100):
            got = [secret_scan.battery("".join(rng.choice(alphabet) for _ in range(n))) for _ in range(1500)]
            p = np.array([x[1] for x in got if x[0] == name])
            for level in (0.05, 0.01):
                assert (p <= level).mean() <= level + 4 * (level / len(p)) ** 0.5, (name, n, level)


def test_exact_null_distributions():
    # All strings of 6 symbols over 3, and all orders of 3 and 4 symbols.
    import itertools

    squares = [sum(x.count(c) ** 2 for c in "abc") for x in itertools.product("abc", repeat=6)]
    tail = secret_scan.square_tail(6, 3)
    assert all(abs(tail[s] - np.mean([q >= s for q in squares])) < 1e-12 for s in range(12, 37))
    runs = [1 + sum(a != b for a, b in zip(x, x[1:])) for x in set(itertools.permutations("aaabbbb"))]
    for r in range(2, 8):
        assert abs(secret_scan.runs_test(3, 4, r) - min(1, 2 * min(np.mean([q <= r for q in runs]), np.mean([q >= r for q in runs])))) < 1e-12


def test_changes_of_groups_exactly():
    import itertools

    alphabet = "ABab1"
    shares = tuple(sum(secret_scan._group(c) == g for c in alphabet) / 5 for g in range(3))
    changes = [sum(secret_scan._group(x) != secret_scan._group(y) for x, y in zip(t, t[1:])) for t in itertools.product(alphabet, repeat=6)]
    got = secret_scan.few_changes(6, shares)
    assert all(abs(got[c] - np.mean([x <= c for x in changes])) < 1e-12 for c in range(6))
    rng = random.Random(3)
    b62 = secret_scan.ALPHABETS[5][1]
    long = np.array([secret_scan.change_test("".join(rng.choice(b62) for _ in range(400)), b62) for _ in range(2000)])
    assert all(abs((long <= level).mean() - level) < 4 * (level / 2000) ** 0.5 for level in (0.05, 0.2, 0.5))


def test_cuts_against_their_definition():
    rng = random.Random(4)
    for trial in range(300):
        bins = [rng.randrange(rng.choice((12, 60, 400))) for _ in range(rng.choice((0, 1, 3, 40, 400)))]
        bins += [int(-np.log10(rng.random() + 1e-12) / 0.05) % 400 for _ in range(rng.choice((0, 1, 30, 200)))]
        want = 0
        for cut in range(1, secret_scan.LAST_CUT + 1):
            reported = sum(b < cut for b in bins)
            bounds = [(1 + sum(cut <= b < cut + k * cut for b in bins)) / k for k in (1, 2, 4, 8, 16, 20) if cut * (1 + k) <= 400]
            want = cut if min(bounds) <= 0.05 * reported else want
        tokens = {("base62", 5, b): bins.count(b) for b in bins} | {("hex", 6, 399): 5}
        assert secret_scan.cuts(tokens, 0.05).get(("base62", 5), 0) == want and ("hex", 6) not in secret_scan.cuts(tokens, 0.05)


def test_few_names_among_reported_tokens(spark):
    """Names of three forms with random tokens of four lengths among them: of what is
    reported at most a twentieth are names, over all mixtures and in nearly all of each."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice(c) for c in ("bcdfglmnprst", "aeiou", "lmnrst", "aeiou", "cdknt")[: rng.choice((3, 4, 5))]) + rng.choice(("", "er", "ing", "or")) for _ in range(600)})
    b62 = secret_scan.ALPHABETS[5][1]
    some = lambda: rng.sample(words, rng.randint(4, 7))
    forms = {
        "camel": lambda: "".join(w.title() for w in some()) + str(rng.randrange(1, 999)),
        "snake": lambda: "_".join(some()),
        "path": lambda: "/".join(some()),
    }
    found, wrong, recall = 0, 0, {}
    for name, form in forms.items():
        for size in (24, 32, 40, 64):
            names = [x for x in (form() for _ in range(1500)) if len(x) >= 20]
            secrets = ["".join(rng.choice(b62) for _ in range(size)) for _ in range(30)]
            rows = list(enumerate(names + secrets))
            got = {r["doc_id"] for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).where("spans like '%random%'").collect()}
            bad = sum(k < len(names) for k in got)
            found, wrong = found + len(got), wrong + bad
            recall[name, size] = (len(got) - bad) / 30
            assert bad <= 0.1 * max(10, len(got)), (name, size, bad, len(got))
    assert found and wrong <= 0.05 * found
    assert all(recall[name, size] >= 0.8 for name in ("snake", "path") for size in (24, 32, 40, 64)) and recall["camel", 64] >= 0.8, recall


def plain_base(text):
    found = []
    for kind, pattern, flags in (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), ("access", r"AKIA[A-Z0-9]+", 0), ("hex", r"[0-9a-f]+", 0)):
        for m in re.finditer(pattern, text, flags):
            if kind == "assign" and (len(m[2]) < 8 or not m[1].isascii()):
                continue
            if m.end() - m.start() >= {"assign": 0, "access": 16, "hex": 32}[kind]:
                found.append((m.start(), ("assign", "access", "hex").index(kind), kind, m.end()))
    return [(s, k, e) for s, _, k, e in sorted(found)]


def test_secrets_base_against_the_patterns(spark):
    rng = random.Random(14)
    bits = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "abc123", "hunter2hunter2", "AKIA", "ABCDEFGH12345678", "deadbeef" * 4, "0af", ".", "\n", "é", "ſecret", "-_"]
    rows = [(k, "".join(rng.choices(bits, k=rng.randrange(0, 14)))) for k in range(3000)] + [(None, "token=abcdefgh1"), (9000, "x" * 500000 + " secret: abcdefgh")] + [(9001, "AKIA" + "Q" * 12)] * 3
    got = secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(i, ",".join(f"{k}:{s}:{e}" for s, k, e in plain_base(t))) for i, t in rows]
    have = [(r["doc_id"], ",".join(x for x in r["spans"].split(",") if x and not x.startswith("random"))) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert all(r["base_sha256"] == hashlib.sha256(b.encode()).hexdigest() for r, (_, b) in zip(got, have))


def test_exact_dedup_of_texts_above_a_chunk(spark):
    big = "ab cd\t" * 120000  # 720,000 characters, three chunks of the default size
    rows = [(1, big), (2, big.replace("\t", "  ")), (3, big[:-2] + "x "), (4, big), (4, big), (None, big), (5, "s")]
    df = docs_of(spark, [(i, t, "s") for i, t in rows])
    got = [(r["doc_id"] or -1, r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(df).collect()]
    assert sorted(got) == [(-1, 1, 5), (1, 1, 5), (2, 1, 5), (3, 3, 1), (4, 1, 5), (4, 1, 5), (5, 5, 1)]
    assert sorted(r["doc_id"] for r in exact_dedup.drop_duplicates(df).collect()) == [1, 3, 5]


def test_dual_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 8)).astype(np.int32) for _ in range(120)]
    y = np.array([int(r.min() < 3) ^ int(rng.random() < 0.1) for r in rows])
    ratio = quality.log_ratios(rows, y, 40)
    counts = [[1.0 + sum(j in r for r, c in zip(rows, y) if c == k) for j in range(40)] for k in (0, 1)]  # plain naive Bayes
    assert np.allclose(ratio, [np.log(a / sum(counts[1])) - np.log(b / sum(counts[0])) for a, b in zip(counts[1], counts[0])])
    values = [ratio[r] / np.linalg.norm(ratio[r]) for r in rows]
    w = quality.dual_descent(rows, values, y, 40, 1.0, 4000)
    loss = lambda w: 0.5 * w @ w + sum(max(0.0, 1 - (2 * c - 1) * (w[r] @ v)) for r, v, c in zip(rows, values, y))
    best = loss(w)
    assert all(loss(w + rng.normal(0, s, 40)) >= best - 1e-3 for s in (1e-3, 1e-2, 0.1) for _ in range(200))
