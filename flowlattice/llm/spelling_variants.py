"""Grouping of spelling variants: words one edit apart, by a positional q-gram index.

Words are maximal runs of Latin letters, A-Z lower-cased.  Those of ``LETTERS`` code points or more
that occur ``LEAST`` times or more are compared.  Two are near if they differ by exactly one code point
put in, left out or replaced.  A word's form is its near word that occurs most often, if that is
``TIMES`` times as often or more; its root is where forms lead.

A word of n letters, padded with Q - 1 marks at either end, has n + Q - 1 q-grams.  One edit changes
Q of them at most, so near words share max(n) - 1 or more (the bound), each at the same place, or one
place further on in the longer word.  Shards hold an inverted index: for every q-gram, length and
place, the words that have it.  A word's shortest postings, so many that a near word must be in one,
are merged through a heap; words that come up are counted against the bound and then verified.

Shards are made so that near words meet in one: of a word's q-grams, ordered by how rare they are,
near words share one of the first Q + 1, so every word goes to the shards of these.  A q-gram that
brings up over ``HOT`` words is taken together with the next ones instead (near words share r of the
first Q + r), until groups are small; bounds on q-grams hold up to ``DEEPEST``, and words that share the
rarest five and are still more than that stay one group.  Only counts of q-grams, at most one a triple
of the 92 symbols, reach the driver.

Edge cases: a null text has no words; a null id counts as an empty one where ids spoil words.  Empty
tables and tables without frequent words give no rows.  Rows that repeat count each time.  Of forms
of equal count, the first in code-point order is taken; forms always grow, so there are no circles.
Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlattice.llm.common import slices, written

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS, LEAST, TIMES = 6, 5, 5
#: One word in so many, by a checksum of id and word, loses a letter where words are spoiled.
SPOILED = 199
Q = 3
#: Marks before and after a word, and symbols in all: two marks, a-z, U+00C0 to U+00FF.
BEFORE, AFTER, SYMBOLS = "\x01", "\x02", 92
#: Words of a shard, about, words that one key brings up at most, and q-grams in a key at most.
SHARD, HOT, DEEPEST = 20_000, 10_000, 5
_SYMBOL = {c: i for i, c in enumerate([BEFORE, AFTER, *LOWER, *map(chr, range(0xC0, 0x100))])}


def words_of(docs: DataFrame, spoiled: int | None = None) -> DataFrame:
    """w: every word of every text; with ``spoiled``, some without a letter.

    With h = crc32 of "<doc_id>:<word>": where ``spoiled`` divides h, the code point at h % length goes.
    """
    rows = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("w"))
    if spoiled is None:
        return rows.select("w")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "w").cast("binary"))
    n = F.length("w")
    at = (F.col("h") % n).cast("int")
    less = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, n))
    return rows.withColumn("h", h).select(F.when(F.col("h") % spoiled == 0, less).otherwise(F.col("w")).alias("w"))


def vocabulary(words: DataFrame, letters: int = LETTERS, least: int = LEAST) -> DataFrame:
    """w, n: the words of enough letters that occur often enough, and how often."""
    return words.where(F.length("w") >= letters).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def grams(w: str) -> list[str]:
    p = BEFORE * (Q - 1) + w + AFTER * (Q - 1)
    return [p[i : i + Q] for i in range(len(w) + Q - 1)]


def _code(gram: str) -> int:
    code = 0
    for c in gram:
        code = code * SYMBOLS + _SYMBOL[c]
    return code


def _ranks(words: DataFrame) -> np.ndarray:
    """How often each q-gram occurs in ``words``, by its code: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**Q, np.int64)
        for b in batches:
            codes = [_code(g) for w in b.column("w").to_pylist() for g in grams(w)]
            total += np.bincount(np.array(codes, np.int64), minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["code", "c"])

    out = np.zeros(SYMBOLS**Q, np.int64)
    for r in words.select("w").mapInArrow(count, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")).toLocalIterator():
        out[r.code] = r.c
    return out


def _ordered(w: str, ranks: np.ndarray) -> list[int]:
    """A word's q-grams, each with how often it has occurred before in it, rarest first, as whole numbers."""
    seen: dict[int, int] = defaultdict(int)
    out = []
    for code in map(_code, grams(w)):
        out.append((int(ranks[code]), code, seen[code]))
        seen[code] += 1
    return [code << 32 | k for _, code, k in sorted(out)]


def routed(words: DataFrame) -> DataFrame:
    """key, w, n: near words share a key, and hardly any key has over HOT words."""
    ranks = _ranks(words)

    def deeper(depth: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                rows = []
                for key, at, w, n in zip(*(b.column(c).to_pylist() for c in ("key", "at", "w", "n")), strict=True):
                    own = _ordered(w, ranks)
                    # 64 bits that stand for the key's q-grams; keys that collide only bring up more words
                    rows += [((key * 0x9E3779B97F4A7C15 + own[j] + 1) & (1 << 63) - 1, j, w, n) for j in range(at + 1, min(Q + depth, len(own)))]
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["key", "at", "w", "n"])

        return run

    rows, out = words.select(F.lit(0).cast("long").alias("key"), F.lit(-1).alias("at"), "w", "n"), None
    for depth in range(1, DEEPEST + 1):
        rows = written(rows.mapInArrow(deeper(depth), "key long, at int, w string, n long"), "keys")
        hot = written(rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("key"), "hot")
        if depth == DEEPEST or hot.isEmpty():
            return rows.drop("at") if out is None else out.unionByName(rows.drop("at"))
        cool = rows.join(hot, "key", "left_anti").drop("at")
        out, rows = cool if out is None else out.unionByName(cool), rows.join(hot, "key", "left_semi")
    raise AssertionError


def one_edit(a: str, b: str) -> bool:
    """Whether a and b (not shorter than a, by one at most) differ by exactly one edit."""
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a != b and a[i + (len(a) == len(b)) :] == b[i + 1 :]


def near_in(words: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of places in ``words`` (distinct) of near words, the shorter one first."""
    own = [grams(w) for w in words]
    index: dict[tuple[str, int, int], list[int]] = defaultdict(list)
    for i, gs in enumerate(own):
        for p, g in enumerate(gs):
            index[g, len(gs), p].append(i)
    none: list[int] = []
    for i, gs in enumerate(own):
        m = len(gs)
        # of the same length, behind this word: bound m - Q of m, so one of the Q + 1 shortest postings has it
        lists = [(len(x), p, x) for p, g in enumerate(gs) for x in (index[g, m, p],)]
        lists.sort()
        last = -1
        for j in heapq.merge(*(x[bisect_right(x, i) :] for _, _, x in lists[: Q + 1])):
            if j != last:
                last = j
                if sum(map(str.__eq__, gs, own[j])) >= m - Q and one_edit(words[i], words[j]):
                    yield i, j
        # longer by one: an edit leaves m + 1 - Q of this word's m, so one of the Q shortest has it
        both = [(index.get((g, m + 1, p), none), index.get((g, m + 1, p + 1), none)) for p, g in enumerate(gs)]
        both.sort(key=lambda x: len(x[0]) + len(x[1]))
        last = -1
        for j in heapq.merge(*(x for pair in both[:Q] for x in pair)):
            if j != last:
                last = j
                other = own[j]
                if sum(g == other[p] or g == other[p + 1] for p, g in enumerate(gs)) >= m + 1 - Q and one_edit(words[i], words[j]):
                    yield i, j


def near(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: near words of ``words`` (w, n), each pair once."""

    def run(t: pa.Table) -> pa.Table:
        own = dict(zip(t["w"].to_pylist(), t["n"].to_pylist(), strict=True))  # a word may come by several keys
        names = sorted(own)
        pairs = [(names[i], names[j]) for i, j in near_in(names)]
        a, b = ([p[k] for p in pairs] for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.string()), "n_a": pa.array([own[x] for x in a], pa.int64()), "b": pa.array(b, pa.string()), "n_b": pa.array([own[x] for x in b], pa.int64())})

    rows = routed(words)
    shards = -(-rows.count() // SHARD) + 1
    # as many tasks as shards: they are small in bytes and take their time
    own = rows.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "w", "n").repartition(shards, "shard")
    return own.groupBy("shard").applyInArrow(run, "a string, n_a long, b string, n_b long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root of ``forms`` (word, form): where following forms ends.  Chains halve with each round."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        out = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = out.drop("moved")
        if out.where("moved").isEmpty():
            return now


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of ``words`` (w, n; distinct)."""
    words = written(words, "words")
    pairs = written(near(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("m"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("b"))
    fit = -F.col("b.m") >= TIMES * F.col("n")
    best = written(best.select("word", "n_near", F.when(fit, F.col("b.near")).alias("form"), F.when(fit, -F.col("b.m")).alias("form_n")), "forms")
    out = words.select(F.col("w").alias("word"), "n").join(best, "word", "left").join(roots(best.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def spelled(docs: DataFrame) -> DataFrame:
    """``variants`` of the frequent words of doc_id, text, one word in SPOILED of which has lost a letter."""
    return variants(vocabulary(words_of(docs, SPOILED)))
