import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlattice.llm import hyperlang, licences, line_dedup, mixing, toxicity
from flowlattice.llm.common import fold, held_out


def test_folds_and_missing_ids(spark):
    import zlib

    rows = spark.createDataFrame([(i,) for i in (0, 1, 17, -5)] + [(None,)], "doc_id long")
    got = [(r.doc_id, r.f) for r in rows.select("doc_id", fold(F.col("doc_id")).alias("f")).collect()]
    assert got == [(i, zlib.crc32(str(i).encode()) % 5) for i in (0, 1, 17, -5)] + [(None, 0)]


# ---- licences


def test_markup_parses_and_is_checked():
    assert licences.parse("A <<beginOptional>>b<<endOptional>> c") == [b"a", ("optional", [b"b"]), b"c"]
    assert licences.parse('<<var;name="x";original="y z";match=".{0,9}">> end') == [("any", ".{0,9}"), b"end"]
    for bad in ("<<beginOptional>>a", "a<<endOptional>>"):
        with pytest.raises(ValueError):
            licences.parse(bad)
    with pytest.raises(ValueError):
        licences.Automaton(licences.parse("<<beginOptional>>a<<endOptional>>"))


def test_automata_agree_with_regular_expressions():
    import random

    r = random.Random(3)
    for _ in range(300):
        parts = "".join(r.choice(["a ", "b ", "<<beginOptional>>c d<<endOptional>> ", '<<var;name="v";match=".{1,4}">> ', '<<var;name="v";match=".*">> ', '<<var;name="v";match="a( b)*">> ', "<<beginOptional>>a <<beginOptional>>b<<endOptional>><<endOptional>> "]) for _ in range(4)) + "e"
        tree = licences.parse(parts)
        words = [r.choice([b"a", b"b", b"c", b"d", b"e"]) for _ in range(12)]
        line = "".join(x.decode() + " " for x in words)
        machine, rule = licences.Automaton(tree), re.compile(licences.pattern(parts))
        at = 0
        for i in range(len(words)):
            assert machine.accepts(words, i) == bool(rule.match(line, at)), (parts, words, i)
            at += len(words[i]) + 1


def filled(template):
    """A template's wording with all that is optional, and names put in."""
    text = re.sub(r'<<var;[^>]*?original="([^"]*)"[^>]*>>', lambda m: m[1].replace("copyright holder", "Jane Ümlaut & Co."), template)
    return re.sub(r"<<(begin|end)Optional>>", " ", text)


def test_every_template_takes_its_wording_and_no_other():
    scanner = licences.Scanner()
    plain = {"Apache-2.0-notice", "GPL-2.0-or-later", "GPL-3.0-or-later", "MPL-2.0", "Unlicense", "Zlib", "BSD-4-Clause", "BSD-3-Clause", "BSD-2-Clause", "ISC", "MIT-grant"}
    for label in plain:
        words = licences.words_of("preamble " + filled(licences.TEMPLATES[label]).replace("https://", "") + " and more")
        got = scanner.labels(words)
        assert label in got, label
        assert not {x for x in got if x.startswith("BSD-")} - {label}  # the clauses tell them apart
        short = [w for w in words if w in scanner.needs[label]]
        for at in (1, len(short) // 2, len(short) - 1):  # one mandatory word of another spelling
            broken = licences.Words(words)
            place = [i for i, w in enumerate(words) if w == short[at]]
            for i in place:
                broken[i] = short[at] + b"x"
            assert label not in scanner.labels(broken)


def test_a_region_without_a_bound_is_linear():
    words = licences.words_of("begin " + "some words " * 100_000)
    assert not licences.Automaton(licences.parse('begin <<var;name="x";original="y">> end')).accepts(words, 0)
    assert words.characters(0, 3) == len("begin some words") and words.characters(2, 2) == 0


def scan(docs, *texts):
    return {r.doc_id: r for r in licences.scan(docs(*enumerate(texts))).collect()}


def test_licence_scan(docs):
    got = scan(docs, "Licensed under the Apache License, Version 2.0.", "Released under the MIT\nLicense! and the mit license", "Licensed under an Apache License, Version 2.0", "", None, "general public license", "This work is licensed under the GNU General Public License, version 3.", "É" * 50_000)
    assert (got[0].labels, got[0].base_labels, got[0].n_base, got[0].first_word, got[0].score) == ("Apache-2.0,apache", "apache", 1, 3, 1.0)
    assert (got[1].labels, got[1].n_base, got[1].first_word, got[1].last_word, got[1].n_words) == ("MIT,mit", 2, 3, 7, 9)
    assert (got[2].labels, got[2].score) == ("apache", 0.5)  # a mandatory word differs
    assert all((got[i].n_words, got[i].n_base, got[i].first_word, got[i].labels, got[i].score) == (0, 0, None, "", 0.0) for i in (3, 4))
    assert got[5].base_labels == "gpl" and got[6].labels == "GPL-3.0,gpl" and got[7].n_words == 1
    assert licences.scan(docs((1, "x")).where("false")).count() == 0


def test_licences_in_full_are_told_apart(docs):
    drop = lambda t: re.sub(r"<<[^>]*>>", lambda m: (re.findall('original="([^"]*)"', m[0]) or [""])[0], t)
    bsd2, bsd3, mit = (drop(licences.TEMPLATES.get(k, "")) for k in ("BSD-2-Clause", "BSD-3-Clause", "MIT-grant"))
    got = scan(docs, bsd2, bsd3, mit, mit.replace("subject to", "not subject to"), bsd2.split(":")[0], bsd3.replace("Neither", "Either"))
    assert [got[i].labels for i in range(6)] == ["BSD-2-Clause", "BSD-3-Clause", "MIT-grant", "", "", ""]
    assert [got[i].score for i in range(6)] == [1.0, 1.0, 1.0, 0.0, 0.0, 0.0]


def test_replaceable_regions_follow_their_match(docs):
    said = "this software and associated documentation files"
    mit = re.sub(r"<<[^>]*>>", lambda m: (re.findall('original="([^"]*)"', m[0]) or [""])[0], licences.TEMPLATES["MIT-grant"])
    got = scan(docs, mit.replace(said, "ab " * 41), mit.replace(said, ("a" * 20 + " ") * 40), mit.replace(said, "a" * 200), mit.replace(said, "a" * 201), mit.replace(said, "é" * 200))
    assert [got[i].labels for i in range(5)] == ["MIT-grant", "", "MIT-grant", "", "MIT-grant"]
    own = {"x": 'one <<var;name="n";match="(red|green)( red)*">> end'}
    rows = licences.scan(docs((1, "One green red, red END"), (2, "one blue end"), (3, "one end"), (3, "one red end")).withColumn("labels", F.lit("clash")), own).collect()
    assert sorted((r.doc_id, r.labels) for r in rows) == [(1, "x"), (2, ""), (3, ""), (3, "x")]


# ---- line dedup


def dedup(docs, *rows):
    return {r.doc_id: r for r in line_dedup.dedup(docs(*rows)).collect()}


def test_repeated_windows_go_from_later_documents(docs):
    got = dedup(docs, (2, "x\na\nb\nc\ny"), (1, "a\nb\nc\nd"), (3, "a\nb\nz"), (4, None), (5, ""), (6, "b\nc\nd\na\nb\nc"))
    assert got[1].text == "a\nb\nc\nd" and got[1].n_removed == 0
    assert (got[2].text, got[2].n_lines, got[2].n_removed) == ("x\ny", 5, 3)
    assert got[3].text == "a\nb\nz" and got[4].text is None and got[4].n_lines == 0 and got[5].text == ""
    assert (got[6].text, got[6].n_removed) == ("", 6)  # two overlapping windows merge with a third


def test_windows_within_one_document_and_blank_ones(docs):
    got = dedup(docs, (1, "a\nb\nc\na\nb\nc"), (2, "\n\n\n\n\n"), (3, "\n\n\n\n"), (4, "p\np\np\np\np"))
    assert got[1].text == "a\nb\nc" and got[2].text == "\n\n\n\n\n" and got[3].n_removed == 0
    assert (got[4].text, got[4].n_removed) == ("p", 4)  # the second window takes two lines of the first
    twice = line_dedup.dedup(docs((None, "a\nb\nc"), (None, "a\nb\nc"), (1, "a\nb\nc")).withColumn("n_lines", F.lit("clash"))).collect()
    assert Counter(r.text for r in twice) == {"a\nb\nc": 2, "": 1}
    clash = docs((1, "a\nb\nc"), (2, "a\nb\nc")).select("*", *(F.lit(1).alias(c) for c in ("gone", "tk", "lines", "rest", "id", "g_doc", "n_lines")))
    kept = line_dedup.dedup(clash, counts=False)
    assert kept.columns == clash.columns and sorted((r.doc_id, r.text, r.n_lines, r.gone) for r in kept.collect()) == [(1, "a\nb\nc", 1, 1), (2, "", 1, 1)]
    assert line_dedup.dedup(clash.where("false")).count() == 0


def test_dedup_agrees_with_loops(docs):
    import random

    r = random.Random(7)
    rows = [(i, "\n".join(r.choice("abcd ") for _ in range(r.randrange(0, 14)))) for i in range(60)]
    seen, want = set(), {}
    for i, t in rows:
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - 2):
            win = tuple(lines[p : p + 3])
            if not "".join(win).strip(" "):
                continue
            if win in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(win)
        want[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    assert {i: r_.text for i, r_ in dedup(docs, *rows).items()} == want


# ---- mixing


def fill(sizes, weights=mixing.WEIGHTS):
    """Targets by resharing the excess over and over."""
    total, open_, out = sum(sizes), dict(enumerate(sizes)), {}
    while open_:
        left, w = total - sum(out.values()), {i: weights[i % 3] for i in open_}
        share = {i: left * w[i] / sum(w.values()) for i in open_}
        over = [i for i in open_ if share[i] > 3 * sizes[i] + 1e-9]
        if not over:
            return out | share
        for i in over:
            out[i] = 3 * sizes[i]
            del open_[i]
    return out


def test_mix_meets_its_targets(docs):
    import random

    r = random.Random(1)
    names = ["b", "B", "a", None, "é", "z"]
    rows = [(i, " ".join("w" * r.randrange(1, 4) for _ in range(r.randrange(0, 400))), "en", r.choice(names[:2] if r.random() < 0.6 else names)) for i in range(500)]
    rows += [(900, None, "en", "a"), (901, " \t\n", "en", "z"), (None, "x y", "en", "a"), (None, "x y", "en", "a")]
    df = docs(*rows)
    got = mixing.taken(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.taken(df.repartition(3)).collect()), key=str)
    size, target, taken = Counter(), {}, Counter()
    for x in got:
        size[x.source] += x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
        assert 0 <= x.taken <= 3 * x.size and x.source_size > 0
    order = sorted((s for s in size if s is not None)) + [None]
    want = fill([size[s] for s in order])
    for i, s in enumerate(order):
        assert target[s] == pytest.approx(want[i]) and taken[s] == round(target[s])
    out = mixing.mixed(df).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()
    assert all(abs(x.n - target[x.source]) < 600 for x in out)


def test_mix_follows_its_schedule(docs):
    rows = [(i, "w " * (50 + i % 90), "en", "abc"[i % 3]) for i in range(300)] + [(500, "one two three", "en", "a")] * 40
    df = docs(*rows).select("*", *(F.lit(7).alias(c) for c in ("copies", "k", "c", "j", "row", "slots", "m_k")))
    d, mix = mixing.plan(df)
    slots = mix.select("slot", "s", "block").distinct().orderBy("slot").collect()
    u = [r.slot * mixing.STEP % mixing.UNIT for r in slots]
    edges = {s: (min(x for x, r in zip(u, slots, strict=True) if r.s == s), max(x for x, r in zip(u, slots, strict=True) if r.s == s)) for s in (0, 1, 2)}
    assert edges[0][1] < edges[1][0] and edges[1][1] < edges[2][0]  # the points of a source lie in one interval
    for s in (0, 1, 2):  # and its blocks come in order
        assert [r.block for r in slots if r.s == s] == list(range(sum(r.s == s for r in slots)))
    first = {}
    for r in mix.collect():
        first[r.doc_id] = min(first.get(r.doc_id, r.slot), r.slot)
    got = {}
    for r in mixing.taken(df).collect():
        got[r.doc_id] = min(got.get(r.doc_id, 1 << 60), 1 << 60 if r.first_slot is None else r.first_slot)
    assert {i: x for i, x in got.items() if x < 1 << 60} == first
    out = mixing.mixed(df)
    assert out.columns == df.columns
    order = [r.doc_id for r in out.coalesce(1).collect()]
    seen = list(dict.fromkeys(i for i in order if i != 500))
    assert [first[i] for i in seen] == sorted(first[i] for i in seen)
    equal = [r for r in mixing.taken(df).collect() if r.doc_id == 500]
    assert len(equal) == 40 and abs(order.count(500) - sum(r.taken for r in equal) / 3) <= 1


def test_ten_million_slots_are_enough(spark):
    by = spark.createDataFrame([(0, 7_000_000, 0), (1, 0, 7_000_000), (2, 1, 7_000_000), (3, 2_999_999, 7_000_001)], "s long, need long, before long")
    got = mixing.schedule(spark, by).groupBy("s").agg(F.count("*").alias("n"), F.max("block").alias("top")).collect()
    assert {r.s: (r.n, r.top + 1) for r in got} == {0: (7_000_000, 7_000_000), 2: (1, 1), 3: (2_999_999, 2_999_999)}


def test_running_sums_over_ranges(spark):
    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "a long, b long")
    rows = mixing.running(df, [F.col("a")], {"before": "b"}, 5).orderBy("a").collect()
    total = 0
    for n, r in enumerate(rows):
        assert (r.place, r.before) == (n, total)
        total += r.b


def test_mix_of_nothing(docs):
    assert mixing.taken(docs((1, "x")).where("false")).count() == 0
    (r,) = mixing.taken(docs((1, None, "en", None))).collect()
    assert (r.size, r.taken, r.target) == (0, 0, 0.0) and mixing.mixed(docs((1, None))).count() == 0


def test_the_schedule_spreads_sources_evenly(spark, docs):
    rows = mixing.sized(docs(*[(i, "w " * 300, "en", "ab"[i % 2]) for i in range(200)]))
    slots = mixing.schedule(spark, mixing.targets(rows)).orderBy("slot").collect()
    share = sum(x.s == 0 for x in slots) / len(slots)
    for lo in range(0, len(slots) - 50, 50):
        assert abs(sum(x.s == 0 for x in slots[lo : lo + 50]) / 50 - share) < 0.06
    for s in (0, 1):
        assert [x.block for x in slots if x.s == s] == list(range(sum(x.s == s for x in slots)))


# ---- toxicity and language


def prose(seed, words, n=60):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(words, n))


EN, DE = "the and of to with this have from their which would there about".split(), "der die und nicht mit sich auch eine nach über durch werden können".split()


def test_language_id(docs):
    rows = [(i, prose(i, EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(120)]
    odd = [(500, None, "en"), (501, "", "de"), (502, "123 $$$ ...", "en"), (503, "THE AND OF THIS HAVE", None), (504, "x" * 200_000 + " the and", "en"), (None, "und nicht mit der", "de")]
    got = {r.doc_id: r for r in hyperlang.identify(docs(*rows, *odd)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (500, 501, 502))
    assert got[503].lang_pred == "en" and got[None].lang_pred == "de" and got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = hyperlang.identify(docs((1, "the and", None)))
    assert [r.lang_pred for r in nothing.collect()] == ["und"] and hyperlang.identify(docs(*rows).where("false")).count() == 0


def test_hypervectors_agree_with_plain_sums():
    enc = hyperlang.Encoder(64)
    texts = ["Ab c", "", None, "日本 x", "aaaa"]
    got = enc.vectors(texts)
    for t, v in zip(texts, got, strict=True):
        want, s = np.zeros(64), f" {(t or '').lower()} "
        if t:
            for a, b, c in zip(s, s[1:], s[2:], strict=False):
                want += np.roll(enc.letter(ord(a)), 2).astype(int) * np.roll(enc.letter(ord(b)), 1) * enc.letter(ord(c))
        assert (v == want).all()


def test_toxicity(spark, docs):
    rows = [(i, prose(i, EN) + (" you pathetic moron" if i % 4 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)] + [(7, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    odd = [(800, None), (801, ""), (802, prose(802, EN, 30_000)), (None, prose(3, EN))]
    got = {r.doc_id: r for r in toxicity.score(docs(*rows, *odd), labels).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i, _ in rows)
    assert got[800].score == got[801].score < 0.5 and got[802].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score(docs((1, "x")), labels.where("false")).first().predicted == 0
    assert toxicity.score(docs(*rows).where("false"), labels).count() == 0


def test_scores_agree_with_presence():
    texts = ["pathetic moron moron", "", None, "nothing here", "a" * 5000]
    held = np.unique(np.concatenate([toxicity.features(t) for t in texts]))
    weights = np.random.default_rng(0).normal(size=len(held)).astype(np.float32)
    table = dict(zip(held.tolist(), weights.tolist(), strict=True))
    want = [1 / (1 + np.exp(-(0.25 + sum(table[f] for f in toxicity.features(t).tolist())))) for t in texts]
    assert toxicity.scores(texts, held, weights, 0.25) == pytest.approx(want, rel=1e-4)


def test_toxicity_agrees_with_a_plain_fit(docs, spark):
    rows = [(i, prose(i, EN, 30) + (" vile vermin" if i % 5 == 0 else "")) for i in range(200)] + [(10, "another text")] * 3
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    df = docs(*rows)
    held, weights, bias = toxicity.fit(df.withColumn("ids", F.lit(1)).withColumn("tk", F.lit(2)), labels)
    import hashlib

    one = {}
    for i, t in rows:
        key = hashlib.md5(t.encode()).hexdigest()
        one[i] = min(one.get(i, (key, t)), (key, t))
    learn = sorted(i for i in range(200) if __import__("zlib").crc32(str(i).encode()) % 5)
    sets = [set(toxicity.features(one[i][1]).tolist()) for i in learn]
    toxic = np.array([i % 5 == 0 for i in learn])
    ids, ratio = [], []
    for j in sorted(set().union(*sets)):
        n1, n0 = sum(j in x for x, y in zip(sets, toxic, strict=True) if y), sum(j in x for x, y in zip(sets, toxic, strict=True) if not y)
        r = np.log((n1 + 1) / (toxic.sum() + 2)) - np.log((n0 + 1) / ((~toxic).sum() + 2))
        if n1 + n0 >= toxicity.MIN_ROWS and abs(r) >= toxicity.MIN_RATIO:
            ids.append(j)
            ratio.append(r)
    assert held.tolist() == ids
    x = np.array([[(j in s) * r for j, r in zip(ids, ratio, strict=True)] for s in sets])
    w = weights.astype(float) / np.array(ratio)
    z = x @ w + bias
    assert ((z >= 0) == toxic).all()
    # at the optimum of the penalised loss the gradient vanishes: but for the intercept, which is set afterwards
    side = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    loss = lambda v, b: (side * np.logaddexp(0, -np.where(toxic, 1, -1) * (x @ v + b))).sum() + toxicity.L2 / 2 * (v**2).sum()
    best = min(loss(w, bias + d) for d in np.linspace(-6, 6, 241))
    assert all(min(loss(w + 0.05 * np.random.default_rng(k).normal(size=len(w)), bias + d) for d in np.linspace(-6, 6, 49)) > best - 1e-3 for k in range(20))


def test_the_cut_has_least_error():
    r = np.random.default_rng(2)
    for _ in range(50):
        toxic = r.random(30) < 0.4
        if toxic.all() or not toxic.any():
            continue
        z, share = r.normal(size=30) + toxic, r.random()
        error = lambda at: share * (z[toxic] < at).mean() + (1 - share) * (z[~toxic] >= at).mean()
        assert error(toxicity.cut(z, toxic, share)) <= min(error(at) for at in np.linspace(-5, 5, 2001)) + 1e-9


def test_languages_agree_with_plain_prototypes(docs, monkeypatch):
    import zlib

    rows = [(i, prose(i, EN if i % 3 else DE, 12), "en" if i % 3 else "de") for i in range(90)] + [(3, prose(3, DE, 12), "de")] * 2
    enc = hyperlang.Encoder()
    sums = {"de": 0.0, "en": 0.0}
    for i, t, lang in dict.fromkeys(rows):
        if zlib.crc32(str(i).encode()) % 5:
            v = enc.vectors([t])[0].astype(float)
            sums[lang] = sums[lang] + v / np.linalg.norm(v)
    for r in hyperlang.identify(docs(*rows).select("*", F.lit("x").alias("lang_pred"), F.lit(1).alias("score"))).collect():
        v = enc.vectors([next(t for i, t, _ in rows if i == r.doc_id)])[0].astype(float)
        cos = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in sums.items()}
        best = max(cos, key=cos.get)
        assert r.lang_pred == best and r.score == pytest.approx(cos[best], abs=1e-4)


def test_a_rare_language_is_learned(docs):
    rows = [(i, prose(i, EN, 10), "en") for i in range(400)] + [(1000 + i, prose(i, DE, 10), "de") for i in range(6)]
    langs, _ = hyperlang.fit(docs(*rows), sample=20)
    assert langs == ["de", "en"]


def test_held_out_rows_teach_nothing(docs, spark):
    rows = [(i, "zzzq zzzq zzzq" if i % 2 else "the and of") for i in range(200)]
    labels = docs(*rows).where(held_out(F.col("doc_id"))).select("doc_id", F.lit(1).alias("toxic"))
    assert max(r.score for r in toxicity.score(docs(*rows), labels).collect()) < 1e-6
