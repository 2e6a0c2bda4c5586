import base64
import hashlib
import io
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from flowlattice.llm import bpe, impact_search, order_minhash, warc

# ---- BPE

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ENC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", None, "a" * 1000, "=" * 3000, "ab" * 700, " " * 900 + "x", "\n" * 600, "日本語" * 300, "<|endoftext|>", "é" * 513, "\t \n  x  ", "🙂" * 400, "the" * 300, "I'll don't 123 ½ ﬁ x"]


def test_coder_agrees_with_the_library():
    c = bpe.Coder(RANKS, bpe.merge_table(RANKS), public_tokenizers.PATTERN)
    r = random.Random(2)
    texts = ODD + ["".join(chr(r.randrange(1, 0x2FFF)) for _ in range(400)) for _ in range(20)] + [" ".join(r.choice(["Hello", "wörld", "tokenizer", "x1y2", "--"]) for _ in range(200))]
    got = c.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ENC.encode_ordinary(t or "") for t in texts]
    assert [x.decode() for x in c.decode(got)] == [t or "" for t in texts]


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 5)
    monkeypatch.setattr(bpe, "CHARS", 40)
    c = bpe.Coder(RANKS, bpe.merge_table(RANKS), public_tokenizers.PATTERN)
    for _ in range(2):
        texts = [f"some words {i} and others {i * 7}, again and again and again" for i in range(30)]
        got = c.encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ENC.encode_ordinary(t) for t in texts]
        assert [x.decode() for x in c.decode(got)] == texts


@pytest.mark.parametrize("near", [8, 1])
def test_long_words_agree_with_the_library(monkeypatch, near):
    monkeypatch.setattr(bpe, "NEAR", near)  # so few tokens around a seam that it has to be widened
    c = bpe.Coder(RANKS, bpe.merge_table(RANKS), public_tokenizers.PATTERN)
    r = random.Random(6)
    letters = lambda k, n: "".join(r.choice(k) for _ in range(n))
    texts = [" ".join(letters("abcdefghijklmnopqrstuvwxyz", 250) for _ in range(400)), letters("ab", 9000), "x" + "a" * 9001, "xab" + "abc" * 3000, "-" * 7001, " " * 5001 + "x", "the" * 2000 + "re" * 500]
    texts += ["".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(20_000)), letters("01", 5000), letters("aeiou", 120_000)]
    got = c.encode(texts)
    for t, x in zip(texts, got, strict=True):
        assert np.frombuffer(x, "<u4").tolist() == ENC.encode_ordinary(t)
    assert [x.decode() for x in c.decode(got)] == texts


def test_bpe_frames(docs):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    df = docs(*enumerate(ODD))
    got = {r.doc_id: r for r in bpe.digests(df, path, pattern).collect()}
    for i, t in enumerate(ODD):
        ids = ENC.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    coded = bpe.encoded(df, path, pattern)
    assert coded.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids"]
    assert {r.doc_id: r.text for r in bpe.decoded(coded, path, pattern).collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.digests(df.where("false"), path, pattern).count() == 0 and bpe.encoded(df.where("false"), path, pattern).count() == 0
    clash = bpe.encoded(df.withColumn("ids", F.lit("mine")).withColumn("w", F.lit(1)), path, pattern)
    assert clash.columns == ["doc_id", "lang", "source", "n_chars", "w", "n_tokens", "ids"] and clash.count() == len(ODD)


# ---- search


def plain_topk(rows, queries, k=5):
    ok = {i: np.floor(256 * np.array(v, np.float64)).astype(int) for i, v in rows if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v)}
    return [(q, n + 1, i, s) for q in queries if q in ok for n, (s, i) in enumerate(sorted(((-int(ok[q] @ v), i) for i, v in ok.items() if i != q))[:k])]


@pytest.mark.parametrize("scale", [0.2, 0.004])
def test_search_is_exact(spark, monkeypatch, scale):
    monkeypatch.setattr(impact_search, "BLOCK_ROWS", 300)
    monkeypatch.setattr(impact_search, "QUERY_ROWS", 7)
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(0, scale, 16)]) for i in range(1000)] + [(2000, None), (2050, [float("nan")] * 16), (2100, [None] * 16), (2150, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = impact_search.search(df, df.where("vec_id % 50 = 0")).collect()
    want = plain_topk(rows, range(0, 2200, 50))
    assert sorted((x.query_id, x["rank"], -x.score, x.vec_id) for x in got) == sorted((q, n, s, i) for q, n, i, s in want)


def test_search_of_little(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0]), (2, []), (None, [9.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in impact_search.search(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 65536), (0, 2, 2, 0)]
    assert impact_search.search(df, df.where("false")).count() == 0 and impact_search.search(df.where("false"), df).count() == 0


def test_search_of_large_components_repeats_and_clashes(spark):
    big = [[float(x) for x in np.random.default_rng(i).integers(-(2**20), 2**20, 4)] for i in range(60)]
    rows = [(i, v) for i, v in enumerate(big)] + [(50, big[50]), (7, big[9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("g", F.lit(2))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in impact_search.search(df, df.where("vec_id = 50")).collect())
    whole = [(i, [int(256 * x) for x in v]) for i, v in rows]
    want = sorted((-sum(a * b for a, b in zip(whole[50][1], v, strict=True)), i) for i, v in whole if i != 50)[:5]
    assert got == [(50, n + 1, i, -s) for n, (s, i) in enumerate(want)]


@pytest.mark.parametrize("rows_a_block", [3, 4096])
def test_search_of_huge_components(spark, monkeypatch, rows_a_block):
    """Large rows and queries are scored in whole numbers; only a score that would be returned can be too large."""
    monkeypatch.setattr(impact_search, "BLOCK_ROWS", rows_a_block)
    r = random.Random(5)
    vectors = [(i, [r.uniform(-2, 2), r.uniform(-2, 2), 0.0]) for i in range(20)]
    # 20 is large but fits; 21 and 22 are far below all others; 23 meets nothing but zeros
    vectors += [(20, [2.0**45, 2.0**45, 0.0]), (21, [-1e30, -1e30, 0.0]), (22, [-(2.0**45), 0.0, 0.0]), (23, [0.0, 0.0, 1e307])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    exact = {i: [impact_search.whole(x) for x in v] for i, v in vectors}
    plus = [i for i, v in vectors[:20] if v[0] > 0.1 and v[1] > 0.1]
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in impact_search.search(df, df.where(F.col("vec_id").isin(plus))).collect())
    want = []
    for q in plus:
        best = sorted((-sum(a * b for a, b in zip(exact[q], v, strict=True)), i) for i, v in exact.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want) and any(i == 20 for *_, i, _ in got)
    large = [(x["rank"], x.vec_id, x.score) for x in impact_search.search(df.where("vec_id < 20"), df.where("vec_id = 20")).orderBy("rank").collect()]
    best = sorted((-sum(a * b for a, b in zip(exact[20], exact[i], strict=True)), i) for i in range(20))[:5]
    assert large == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    with pytest.raises(Exception, match="leaves 64 bits"):
        impact_search.search(df, df.where("vec_id = 21")).collect()  # 22 gives it a score of more than 2^63
    huge = spark.createDataFrame([(0, [1e30]), (1, [1.0]), (2, [-1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="leaves 64 bits"):
        impact_search.search(huge, huge).collect()


def test_bounds_from_the_first_block_spare_others():
    r = np.random.default_rng(7)
    base = r.integers(-40, 40, (500, 8))
    index, query = impact_search.Index(np.arange(500), base), np.full(8, 50.0)
    best = index.top(-1, query, 5)
    assert index.top(-1, query, 5, best[-1][1]) == best and index.top(-1, query, 5, 8 * 40 * 50.0) == []


def test_search_stops_on_proof():
    r = np.random.default_rng(3)
    base = r.integers(-40, 40, (2000, 16))
    base[7] = 127
    index = impact_search.Index(np.arange(2000), base)
    assert index.top(-1, np.full(16, 100.0), 1) == [(7, 127 * 1600)]


# ---- WARC


def test_warc(spark):
    pages = [(1, "http://a/x?y#z", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://c\r\nWARC-Type: evil", "x\r\n\r\nWARC/1.1\r\n\r\né"), (None, "http://d", "same"), (5, "u", ""), (6, "http://e", "big " * 50_000), (2, "http://b", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.captures(df).collect()
    top = {"same": 2, None: 5, "": 5}
    want = Counter()
    for i, _, t in pages:
        keep = top.get(t, i)
        d = base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
        want[i, len((t or "").encode()), d, "response" if i == keep else "revisit", None if i == keep else keep] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    least = warc.captures(df, least=5).collect()
    assert {r.record_type for r in least} == {"response"} and len(least) == len(pages)
    assert warc.captures(df.where("false")).count() == 0


def test_warc_keeps_any_id_and_large_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "CLASSES", (10, 100))
    monkeypatch.setattr(warc, "FILE_BYTES", 200)
    df = spark.createDataFrame([(f"p {i}\r\n/é", "http://h/\ta\x7f", "x" * (i * 7)) for i in range(40)] + [(None, None, None)], "page_id string, url string, html string")
    got = {r.page_id: r for r in warc.captures(df).collect()}
    assert set(got) == {f"p {i}\r\n/é" for i in range(40)} | {None}
    assert all(got[f"p {i}\r\n/é"].payload_bytes == 7 * i for i in range(40)) and got["p 3\r\n/é"].response.target_uri == "http://h/%09a%7F"


def test_warc_payloads_and_nesting(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"page {i % 3}\r\n\r\n" * 5) for i in range(9)], "page_id long, url string, html string")
    path = warc.shared_dir(spark, "test")
    warc.write(df, path)
    own = warc.assemble(warc.read(spark, path)).collect()
    assert len(own) == 9 and sum(r.record_type == "response" for r in own) == 3
    for r in own:
        assert r.metadata.id and r.request.fields.startswith(f"GET http://h/{r.page_id}"[:4])
        assert (r.response.payload is None) == (r.record_type == "revisit")
        if r.record_type == "response":
            assert bytes(r.response.payload).decode() == f"page {r.page_id % 3}\r\n\r\n" * 5 and r.response.digest_field == "sha1:" + r.response.payload_digest


def test_captures_are_nested_and_say_what_was_asked(spark):
    pages = [(1, " http://h.org/a b?q=1#part ", "x"), (2, "https://h.org", "x"), (3, None, "y"), (4, "no host/é", "z")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("class", F.lit("clash")).withColumn("n", F.lit(1))
    got = {r.page_id: r for r in warc.captures(df).collect()}
    asked = {i: (r.request.method, r.request.target, r.request.host, r.response.target_uri, r.metadata.via) for i, r in got.items()}
    assert asked == {1: ("GET", "%20http://h.org/a%20b?q=1", "", "%20http://h.org/a%20b?q=1#part%20", "pages"), 2: ("GET", "/", "h.org", "https://h.org", "pages"), 3: ("GET", "/", "", "", "pages"), 4: ("GET", "no%20host/é", "", "no%20host/é", "pages")}
    names = {(r.request.id, r.response.id, r.metadata.id) for r in got.values()}
    assert len({x for own in names for x in own}) == 12 and got[1].record_type == "revisit"
    # requests and metadata are joined in: without their records, there is nothing to say of them
    path = warc.shared_dir(spark, "test")
    warc.write(df, path)
    records = warc.read(spark, path)
    assert all(r.request is None and r.metadata is None and r.page_id is None for r in warc.assemble(records.where("type in ('response', 'revisit')")).collect())
    plan = warc.assemble(records).select("request.method", "metadata.via", "response.target_uri")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2 and "= request)" in plan and "= metadata)" in plan


def test_records_are_parted_by_length():
    one = b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 4\r\n\r\n\r\n\r\n\r\n\r\n"
    assert [(h["warc-type"], b) for h, b in warc.records_of(io.BytesIO(one * 2))] == [("x", b"\r\n\r\n")] * 2
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(one[:-6])))


# ---- near-dedup


def plain_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_banded_alignment_agrees_with_the_whole_table():
    r = random.Random(3)
    pairs = [([r.randrange(4) for _ in range(r.randrange(0, 40))], [r.randrange(4) for _ in range(r.randrange(0, 40))], r.randrange(0, 20)) for _ in range(400)]
    got = order_minhash.distances([np.array(a, np.uint32) for a, _, _ in pairs], [np.array(b, np.uint32) for _, b, _ in pairs], np.array([c for *_, c in pairs]))
    for (a, b, c), d in zip(pairs, got.tolist(), strict=True):
        want = plain_distance(a, b)
        assert d == (want if want <= c else -1)


def near_docs(seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    out, shared = [], [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(r.randrange(40, 160))]
        for _ in range(r.randrange(1, 5)):
            w = list(base)
            for _ in range(r.randrange(0, len(w) // 20 + 1)):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
    out += [" ".join(shared + [word() for _ in range(140)]) for _ in range(40)]  # a common passage is no copy
    base = [word() for _ in range(100)]
    for _ in range(60):  # one large group
        w = list(base)
        w[r.randrange(100)] = word()
        out.append(" ".join(w))
    out += ["a b", "a b", "a c", "A  b", "x", "one two three four five six", "y " * 3000]
    return list(enumerate(out)) + [(900, None), (901, ""), (902, " \n "), (903, None)]


@pytest.mark.parametrize("small", [24, 6])
def test_classes_agree_with_all_pairs(docs, monkeypatch, small):
    monkeypatch.setattr(order_minhash, "SMALL", small)
    rows = near_docs()
    words = {i: order_minhash.word_hashes(t or "") for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, t in rows:
        for j, u in rows[:i] if i < 900 else []:
            limit = int(order_minhash.allowed(max(len(words[i]), len(words[j]))))
            if t == u or order_minhash.within(words[i], words[j], limit) is not None:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in order_minhash.classes(docs(*rows)).collect()}
    assert got == {i: find(i) for i, _ in rows}
    left = {r.doc_id for r in order_minhash.kept(docs(*rows)).collect()}
    assert left == {i for i, _ in rows if find(i) == i}


@pytest.mark.parametrize("n", [*range(3, 21), 24, 28, 32, 33, 36, 40, 41, 50, 64, 100, 300, 2000])
@pytest.mark.parametrize("alike", [0.8, 0.82, 0.84, 0.86, 0.88, 0.9, 0.92, 0.94, 0.96, 0.98, 1.0])
def test_similar_texts_share_a_sketch(n, alike):
    r = np.random.default_rng(n)
    met = 0
    rounds = 200 if n < 2000 else 50
    for _ in range(rounds):
        x = r.integers(0, 1 << 32, n, dtype=np.uint32)
        y, k = x.copy(), int((1 - alike) * n + 1e-9)
        y[r.choice(n, k, replace=False)] = r.integers(0, 1 << 32, k, dtype=np.uint32)
        met += bool((order_minhash.sketches(x) == order_minhash.sketches(y)).any())
    assert met >= 0.95 * rounds


@pytest.mark.parametrize("n", [*range(5, 60, 3), 200])
def test_texts_of_unlike_lengths_share_a_sketch(n):
    """Words put in and left out, across the lengths at which the kind of k-mers changes."""
    r, met, rounds = np.random.default_rng(n), 0, 200
    for _ in range(rounds):
        x = r.integers(0, 1 << 32, n, dtype=np.uint32)
        d = int(order_minhash.allowed(n))
        y = np.delete(x, r.choice(n, d, replace=False)) if r.random() < 0.5 else np.insert(x, r.integers(0, n, d), r.integers(0, 1 << 32, d, dtype=np.uint32))
        met += bool(set(order_minhash.sketches(x).tolist()) & set(order_minhash.sketches(y).tolist()))
    assert met >= 0.95 * rounds


def test_short_pairs_are_found(docs):
    """Hundreds of pairs of short texts, one word in five changed at most, through the whole operator."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for k in range(600):
        w = [word() for _ in range(5 + k % 26)]
        y = list(w)
        for at in r.sample(range(len(w)), len(w) // 5):
            y[at] = word()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(y))]
    got = {x.doc_id: x.class_id for x in order_minhash.classes(docs(*rows)).collect()}
    assert all(got[2 * k] == 2 * k and got[2 * k + 1] in (2 * k, 2 * k + 1) for k in range(600))
    assert sum(got[2 * k + 1] == 2 * k for k in range(600)) >= 590


def test_rare_runs_of_similar_texts_meet():
    r = np.random.default_rng(9)
    for _ in range(400):
        n = int(r.integers(1, 60))
        x = r.integers(0, 9 if n % 2 else 1 << 30, n).astype(np.uint32)
        y = x.copy()
        for _ in range(int(r.integers(0, 14))):
            kind, at = r.integers(3), int(r.integers(max(len(y), 1)))
            y = np.insert(y, at, r.integers(9)) if kind == 0 else np.delete(y, at) if kind == 1 and len(y) > 1 else np.concatenate((y[:at], [r.integers(9)], y[at + 1 :])).astype(np.uint32)
        if order_minhash.within(x, y, int(order_minhash.allowed(max(len(x), len(y))))) is None:
            continue
        known = np.unique(order_minhash.kmers(x, 2)[::2])
        counts = r.integers(1, 5, len(known))
        assert set(order_minhash.rare_kmers(x, known, counts).tolist()) & set(order_minhash.rare_kmers(y, known, counts).tolist())


@pytest.mark.parametrize("block", [1024, 5])
def test_hot_passages_lose_no_link(docs, monkeypatch, block):
    """Versions of texts behind one passage, some so short that the passage is most of them."""
    monkeypatch.setattr(order_minhash, "SMALL", 4)
    monkeypatch.setattr(order_minhash, "BLOCK", block)
    r = random.Random(block)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(40)]
    rows = []
    for k in range(30):
        own = [word() for _ in range(r.choice([12, 30, 60]))]
        rows += [passage + own, passage + own[:-2] + [word()], [word(), *passage[1:], *own]]
    texts = [" ".join(w) for w in rows]
    got = {x.doc_id: x.class_id for x in order_minhash.classes(docs(*enumerate(texts))).collect()}
    hashes = [order_minhash.word_hashes(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if order_minhash.within(hashes[j], hashes[i], int(order_minhash.allowed(max(len(hashes[i]), len(hashes[j]))))) is not None:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert [got[i] for i in range(len(texts))] == root and len(set(root)) > 8


@pytest.mark.parametrize("block", [1024, 7])
def test_a_large_bucket_loses_no_link(docs, monkeypatch, block):
    monkeypatch.setattr(order_minhash, "SMALL", 6)
    monkeypatch.setattr(order_minhash, "BLOCK", block)
    drift = [" ".join(f"w{i}" for i in range(9 * k, 9 * k + 100)) for k in range(30)]  # each is like the next one only
    other = [" ".join([f"p{i}" for i in range(15)] + [f"x{k // 2}-{i}" for i in range(80 + k % 2)]) for k in range(30)]  # pairs behind a passage of all
    df = docs(*enumerate(drift + other))
    nodes = order_minhash.nodes_of(df).withColumn("sk", F.array(F.lit(1).cast("long")))  # one bucket
    root = {bytes(r.node): bytes(r.root) for r in order_minhash.components(order_minhash.links(df, nodes)).collect()}
    name = [hashlib.md5(t.encode()).digest() for t in drift + other]
    assert len({root.get(x, x) for x in name[:30]}) == 1
    assert [root.get(x, x) for x in name[30::2]] == [root.get(x, x) for x in name[31::2]] and len({root.get(x, x) for x in name}) == 16


def test_texts_of_many_nodes_are_not_shuffled(spark, docs, monkeypatch):
    """Where more nodes are needed than may be broadcast, their words are read without the texts going through an exchange."""
    plans, write = [], order_minhash.written
    monkeypatch.setattr(order_minhash, "NEEDED", 10)
    monkeypatch.setattr(order_minhash, "written", lambda df, tag: (plans.append(df._jdf.queryExecution().executedPlan().toString()) if tag == "words" else None, write(df, tag))[1])
    df = docs(*((k, None if k == 7 else f"w{k} x{k} y") for k in range(3000)))
    need = df.where("doc_id % 10 = 3").select(order_minhash.node_of(F.col("text")).alias("node"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {bytes(r.node): r.w for r in order_minhash._words(need, df).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert all(got[hashlib.md5(t.encode()).digest()] == order_minhash.word_hashes(t).tobytes() for t in (f"w{k} x{k} y" for k in range(3, 3000, 10)))
    assert len(got) < 300 + 0.1 * 2700  # about one in MARKS of the others
    assert len(plans) == 1 and "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]


def test_blocks_of_a_connected_group_grow_with_it(spark, monkeypatch):
    """A few nodes against many that are connected: dealt a block each, not all blocks against all, and no link is lost."""
    monkeypatch.setattr(order_minhash, "SMALL", 4)
    monkeypatch.setattr(order_minhash, "BLOCK", 10)
    copies = [[f"w{i}" for i in range(50)] + [f"c{k}-{i}" for i in range(50)] for k in range(200)]  # said to be connected, and too far apart for links
    others = [[*copies[k][:-5], *(f"o{k}-{i}" for i in range(5))] for k in (0, 77, 199)]  # each is like one copy alone
    others += [[*copies[5][:-25], *(f"p{i}" for i in range(24 + j))] for j in range(2)]  # like each other alone
    texts = [" ".join(w) for w in copies + others]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    nodes = order_minhash.nodes_of(df).withColumn("sk", F.array(F.lit(1).cast("long")))
    name = [hashlib.md5(t.encode()).digest() for t in texts]
    rows = [(1, bytearray(x), bytearray(name[0] if k < 200 else x), len(texts)) for k, x in enumerate(name)]
    spots = spark.createDataFrame(rows, "key long, node binary, root binary, c long")
    words = order_minhash._words(spots.select("node"), df)
    got = {(bytes(r.a), bytes(r.b)) for r in order_minhash._blocks(spots, nodes, words).collect()}
    pair = lambda x, y: (min(name[x], name[y]), max(name[x], name[y]))
    assert got == {pair(200, 0), pair(201, 77), pair(202, 199), pair(203, 204)}
    monkeypatch.setattr(order_minhash, "compare", lambda t: pa.table({"a": t["node"], "b": t["node"]}))
    assert order_minhash._blocks(spots, nodes, words).count() == 200 + 5 * (1 + 20)


def test_bounds_reject_no_link():
    r = random.Random(8)
    for _ in range(200):
        x = [r.randrange(30) for _ in range(r.randrange(1, 60))]
        y = list(x)
        for _ in range(r.randrange(0, 12)):
            at = r.randrange(len(y) + 1)
            y[at : at + r.randrange(2)] = [r.randrange(30)] * r.randrange(2)
        d = plain_distance(x, y)
        a, b = (np.array(z, np.uint32) * np.uint32(0x9E3779B1) for z in (x, y))
        one, two = order_minhash.apart(order_minhash.fine_bags(a), order_minhash.fine_bags(b))
        coarse = order_minhash.apart(*(np.frombuffer(order_minhash.bag(z), np.uint8)[None] for z in (a, b)))[0]
        assert coarse <= d and one <= d and two <= 2 * d


def test_one_row_stays_of_each_class(docs):
    rows = [(1, "t u v"), (1, "t u v"), (1, "t u v"), (None, "w x y"), (None, "w x y"), (2, "t u v"), (3, None), (3, None), (4, "T  u v"), (4, "t u v")]
    left = order_minhash.kept(docs(*rows)).collect()
    assert sorted((r.doc_id or 0, (r.text or "-").lower().split()) for r in left) == [(0, ["w", "x", "y"]), (1, ["t", "u", "v"]), (3, ["-"]), (3, ["-"])]


def test_no_documents_and_no_ids(docs):
    assert order_minhash.classes(docs((1, "x")).where("false")).count() == 0
    got = order_minhash.classes(docs((None, "a b c"), (None, "a b c"), (3, "a b c"), (None, "z"), (4, ""), (5, ""), (6, " "), (7, None), (8, None))).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == {(None, 3): 2, (3, 3): 1, (None, None): 1, (4, 4): 1, (5, 4): 1, (6, 6): 1, (7, 7): 1, (8, 8): 1}


# ---- the pipeline


def test_pipeline(spark, docs, tmp_path):
    r = random.Random(1)
    line = lambda: " ".join(r.choice("the and of to with this have from their which would there about".split()) for _ in range(9))
    rows = [(i, "\n".join(line() for _ in range(8)), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0"), (101, "12 34", "en", "s1"), (102, None, None, None), (103, rows[5][1] + "\n" + line(), None, "s2")]
    docs(*rows).write.parquet(str(tmp_path / "documents.parquet"))
    have = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, have, str(tmp_path))
        assert out.columns == have.columns, name
        have = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = have.collect()
    assert {r_.doc_id for r_ in seen["language_id"]} == {i for i, t, *_ in rows if t and i != 101}
    assert all(r_.lang for r_ in seen["language_id"]) and all(r_.n_chars == len(r_.text) for r_ in seen["line_windows"])
    assert 100 not in {r_.doc_id for r_ in seen["near_dedup"] if r_.text}
    assert {r_.doc_id for r_ in seen["source_mix"]} <= {r_.doc_id for r_ in seen["near_dedup"]}
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r_.doc_id for r_ in last) == Counter(r_.doc_id for r_ in seen["source_mix"])
    text = {r_.doc_id: r_.text for r_ in seen["source_mix"]}
    assert all(r_.ids == ENC.encode_ordinary(text[r_.doc_id]) for r_ in last)
