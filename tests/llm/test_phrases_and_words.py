"""Operators 11 to 13 against brute-force versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlattice.llm import periodic_runs, phrase_automata, spelling_variants

BLANK = " \t\n\x0b\x0c\r"


def words(t):
    return [w for w in re.split(f"[{BLANK}]+", t or "") if w]


def sha(t):
    return hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()


# ---- repeated phrases


def plain_phrases(rows, n=13):
    """(doc_id, n_words, n_removed, kept) of each row."""
    low = {}
    rank = lambda i: (i is not None, i or 0)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            low[key] = min(low.get(key, rank(i)), rank(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {j for k in range(len(w) - n + 1) if low[tuple(w[k : k + n])] < rank(i) for j in range(k, k + n)}
        out.append((i, len(w), len(gone), None if t is None else " ".join(x for j, x in enumerate(w) if j not in gone)))
    return Counter(out)


def phrase_rows(seed=1, docs=120):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "the"]) if r.random() < 0.2 else "".join(r.choice("abcdefgh") for _ in range(4))
    shared = [[word() for _ in range(r.choice([12, 13, 14, 40, 90]))] for _ in range(12)]
    rows = []
    for i in range(docs):
        w = [word() for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(3)):
            passage = list(r.choice(shared))
            if r.random() < 0.5:  # a version that later ones may copy, but not the first
                passage[r.randrange(len(passage))] = r.choice(["x1", "x2"])
            at = r.randrange(len(w) + 1)
            w[at:at] = passage
        rows.append((i, r.choice(BLANK).join(w)))
    rows += [(500 + i, t) for i, (_, t) in enumerate(rows[:5])]
    rows += [(600, None), (601, ""), (602, "\n \t"), (None, rows[7][1]), (603, rows[3][1] + " " + rows[3][1]), (604, "z " * 300), (605, "z " * 40), (606, "é " * 20), (607, "é " * 20)]
    return rows + [rows[9], (10, rows[11][1])]  # rows that repeat, and one id with another text


@pytest.mark.parametrize("small", [False, True])
def test_phrases_agree_with_all_windows(docs, monkeypatch, small):
    if small:  # many shards, parts, stretches and automata
        for name, size in (("SHARD", 40), ("PART", 30), ("STRETCH", 7), ("AUTOMATON", 20), ("BROADCAST_ROWS", 1)):
            monkeypatch.setattr(phrase_automata, name, size)
    rows = phrase_rows()
    got = phrase_automata.dedup(docs(*rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == plain_phrases(rows)
    assert sum(r.n_removed for r in got) > 1000


def test_a_version_that_the_first_document_lacks(docs):
    """Windows that share an anchor with the home, but stand only in two later documents, are found in the second round."""
    base = [f"w{i}" for i in range(60)]
    other = base[:30] + ["edit"] + base[31:]
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(other))]
    got = {r.doc_id: (r.n_removed, r.text) for r in phrase_automata.dedup(docs(*rows)).collect()}
    assert got[1][0] == 0 and got[2] == (59, "edit") and got[3] == (60, "")


def test_phrases_keep_columns_and_take_nothing(docs):
    rows = docs((2, "a " * 20), (1, "a " * 20)).withColumn("spans", F.lit("mine")).withColumn("n_words", F.lit("old")).withColumn("o", F.lit(1))
    out = phrase_automata.dedup(rows)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "spans", "o", "n_words", "n_removed"]
    assert {(r.doc_id, r.spans, r.n_words, r.n_removed) for r in out.collect()} == {(1, "mine", 20, 0), (2, "mine", 20, 20)}
    assert phrase_automata.digests(rows.where("false")).count() == 0
    assert phrase_automata.dedup(rows.select("text", "doc_id")).columns == ["text", "doc_id", "n_words", "n_removed"]


def test_a_hot_passage_is_dealt_to_parts(docs, monkeypatch):
    monkeypatch.setattr(phrase_automata, "PART", 500)
    passage = " ".join(f"p{i}" for i in range(50))
    got = {r.doc_id: r.n_removed for r in phrase_automata.dedup(docs(*((i, f"own{i} {passage} tail{i}") for i in range(300)))).collect()}
    assert got == {i: 50 if i else 0 for i in range(300)}


def test_words_and_anchors():
    r = random.Random(4)
    a, b = ([f"{r.randrange(999)}é" for _ in range(40)] for _ in range(2))
    texts = ["", " ".join(a), "x", " \n".join(b[:9] + a[5:30] + b[9:]) + "\t", " ".join(a[:12]), "x", "y"]
    own = phrase_automata.Words(pa.array(["skipped", *texts]).slice(1))
    assert [own.text(i, i + 1) for i in range(len(own.starts))] == [w for t in texts for w in t.split()]
    assert own.first.tolist() == [0, 0, 40, 41, 106, 118, 119, 120]
    h = dict(zip(own.hashes().tolist(), [w for t in texts for w in t.split()], strict=True))
    assert len(h) == len(set(h.values())) == len(set(a) | set(b) | {"x", "y"})
    for width in phrase_automata.ANCHORS:
        m, windows = own.anchors(width)
        assert windows.tolist() == [0, 28, 0, 53, 0, 0, 0] and (m[5:18] == m[28 + 9 : 28 + 22]).all()


# ---- periodic runs


def plain_runs(w):
    n, seen = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(12, 2 * q):
                seen.setdefault((s, i - s + q), q)
    return sorted(((s, length, q) for (s, length), q in seen.items()), key=lambda x: (x[0], x[2]))


def test_runs_agree_with_all_lags():
    r = random.Random(1)
    some = 0
    for _ in range(1500):
        n, kinds = r.randrange(0, 110), r.choice([1, 2, 3, 40, 300])
        w = [b"w%d" % r.randrange(kinds) for _ in range(n)]
        if n and r.random() < 0.6:
            a, p = r.randrange(n), r.randrange(1, n + 1)
            w = w[:a] + [w[a + i % p] if a + i % p < n else w[a + i] for i in range(n - a)]
        got = periodic_runs.runs_of(w)
        assert got == plain_runs(w), w
        some += bool(got)
    assert some > 300


def plain_digest(i, t):
    w = words(t)
    n, h = len(w), crc32(str(i).encode())
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *own, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_run_digests(docs):
    r = random.Random(2)
    rows = [(i, r.choice([" ", "\n", " \t "]).join(r.choice(["é", "b", "ccc", f"w{r.randrange(50)}"]) for _ in range(r.randrange(0, 150)))) for i in range(300)]
    rows += [(1000, "x " * 500), (1001, None), (1002, ""), (None, "a b c " * 9), (5, rows[5][1]), (1003, "a b " * 30)]
    got = periodic_runs.digests(docs(*rows)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_digest(*x) for x in rows)
    assert sum(x.n_runs > 0 for x in got) > 20
    assert periodic_runs.digests(docs(*rows[:1]).where("false")).count() == 0


def test_collapsing_keeps_columns(docs):
    rows = docs((1, "s " + "a b " * 10 + "e"), (2, None)).withColumn("runs", F.lit("mine")).withColumn("rest", F.lit(3))
    out = periodic_runs.collapse(rows)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "rest", "runs"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "s a b e" and [tuple(x) for x in got[1].runs] == [(1, 20, 2)] and got[2].text is None and got[2].runs == [] and got[2].rest == 3


def test_long_texts_are_quick():
    r = random.Random(3)
    w = [b"w%d" % int(r.random() ** 3 * 5000) for _ in range(200_000)]
    assert periodic_runs.runs_of(w[:150_000] + w[:150_000]) == [(0, 300_000, 150_000)]


# ---- spelling


def plain_variants(rows, spoiled=199):
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = crc32(f"{'' if i is None else i}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % spoiled == 0 else w] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}
    cut = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            cut[w[:k] + "?" + w[k + 1 :]].add(w)
            cut[w[:k] + w[k + 1 :]].add(w)
        cut[w].add(w)
    near = defaultdict(set)
    for key, own in cut.items():
        for a in own:
            for b in own:
                if a != b and (abs(len(a) - len(b)) == 1 or len(a) == len(b) and "?" in key):
                    near[a].add(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def spelling_rows(seed=3):
    r = random.Random(seed)
    part = ["an", "er", "th", "é", "ou", "s", "Àb", "o"]
    base = ["".join(r.choice(part) for _ in range(r.randrange(3, 6))) for _ in range(120)]
    def typo(w):
        k = r.randrange(len(w))
        return r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("xyé") + w[k:], w[:k] + r.choice("xyé") + w[k + 1 :]])
    base += [typo(r.choice(base)) for _ in range(120)]
    rows = [(i, " ".join(r.choice(base) if r.random() < 0.7 else r.choice(base[:9]) for _ in range(60)) + ". X1") for i in range(120)]
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb"]
    return rows + [(900, " ".join(w for k, w in enumerate(chain) for _ in range(5 * 6**k)))] + [(901, None), (902, ""), (None, "aaaaaa " * 7 + "bananana " * 9 + "bananan " * 8), (5, rows[5][1])]


@pytest.mark.parametrize("small", [False, True])
def test_variants_agree_with_deletions(docs, monkeypatch, small):
    if small:  # many shards, keys of several q-grams
        monkeypatch.setattr(spelling_variants, "SHARD", 30)
        monkeypatch.setattr(spelling_variants, "HOT", 4)
    rows = spelling_rows()
    got = spelling_variants.spelled(docs(*rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = plain_variants(rows)
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert sum(r.form is not None for r in got) > 5 and any(r.form not in (None, r.root) for r in got)


def test_variants_of_nothing(docs):
    assert spelling_variants.spelled(docs((1, "word")).where("false")).count() == 0
    assert spelling_variants.spelled(docs((1, None), (2, "seldom"))).count() == 0
    one = spelling_variants.spelled(docs((2, "single " * 6))).collect()
    assert [(r.word, r.form, r.root, r.n_near, r.form_n) for r in one] == [("single", None, "single", 0, None)]


def test_one_edit():
    r = random.Random(5)
    for _ in range(4000):
        a = "".join(r.choice("ab") for _ in range(r.randrange(0, 6)))
        b = "".join(r.choice("ab") for _ in range(len(a) + r.randrange(2)))
        want = any(b == x for k in range(len(a) + 1) for x in ([a[:k] + c + a[k:] for c in "ab"] + ([a[:k] + c + a[k + 1 :] for c in "ab"] if k < len(a) else []))) and a != b
        assert spelling_variants.one_edit(a, b) == want, (a, b)
