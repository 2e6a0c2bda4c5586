"""Substring dedup by repeated-phrase automata.

Words are what ASCII white space parts.  Every ``WINDOW`` consecutive words of a text are a window.
A word goes if a window that covers it also starts in a document with a smaller doc_id; windows are
judged on the input, not on what is left.

A window's anchor is the least hash among its runs of a few words, so equal windows have equal
anchors, and neighbouring windows mostly share one.  Anchors in more than one document are the first
sign of a recurring passage; the document of the smallest id is the anchor's home.  Stretches of
windows whose anchors have the same home are cut out of the documents and sent to the home's shard.
There the windows of the homes' own stretches are compiled into Aho-Corasick automata over words,
of a bounded number of phrases each, and the stretches of the other documents stream through them,
in parts of a bounded size, so a passage that a third of all documents share is dealt to many tasks.
What an automaton finds has been confirmed word by word.

A window may share its anchor with the home but not itself stand there, and still stand in another
smaller document.  So what the first round didn't find, a fraction of the near copies, goes through
a second one, whose anchors are whole windows: a home is then the first document that has the window.
The first round spares most of a corpus a shuffle of every window; the second makes it exact (a
window could only be missed if 64 bits of hash of two different windows collide).

Edge cases: a null text has no words and stays null.  A null doc_id is smaller than any other.  Rows
of equal doc_id are not smaller than each other, whether their texts are equal or not, so neither
loses words to the other; rows that repeat id and text are treated alike.  A text of fewer than
``WINDOW`` words loses none, but its words are parted by single blanks, like all.  No rows: no rows.
doc_id is a whole number.  Other columns pass through untouched, whatever they are called.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlattice.functions.materialise import discard
from flowlattice.llm.common import BROADCAST_ROWS, slices, written
from flowlattice.llm.line_dedup import text_number

WINDOW = 13
#: Words of the runs that anchors are chosen from, in the first round and the last.
ANCHORS = (6, WINDOW)
#: Windows of a shard's homes, of the stretches in one part of a shard, of one stretch, and of one automaton, about.
SHARD, PART, STRETCH, AUTOMATON = 20_000, 400_000, 20_000, 20_000
#: Bytes of text that are looked through at once, about.
CHUNK = 1_000_000
#: Odd, so that it has an inverse among 64-bit numbers.
BASE = 0x9E3779B97F4A7C15
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Stands for a null doc_id.
NO_ID = -(1 << 63)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Words:
    """The words of some texts by their places in the texts' bytes: starts, ends, and first, the number of each text's first word."""

    def __init__(self, texts: pa.StringArray) -> None:
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at -= at[0]
        self.data, inside = data, ~_BLANK[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[at[:-1][at[:-1] < len(data)]] = False  # a text ends words, too
        after[at[1:][at[1:] > 0] - 1] = False
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, at)

    def hashes(self) -> np.ndarray:
        """64 bits of every word: its bytes as digits, by sums up to its end and its start."""
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(self.data)), out=sums[1:])
        return _mix((sums[self.ends] - sums[self.starts]) * _powers(pow(BASE, -1, 1 << 64), len(self.data))[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def anchors(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The anchor of every window, text by text, and each text's number of windows."""
        h, n = self.hashes(), len(self.starts) - WINDOW + 1
        windows = np.maximum(np.diff(self.first) - (WINDOW - 1), 0)
        if n < 1:
            return np.zeros(0, np.int64), windows
        runs = np.zeros(len(h) - width + 1, np.uint64)
        for i in range(width):
            runs = _mix(runs * np.uint64(BASE) + h[i : i + len(runs)])
        least = runs[:n].copy()
        for i in range(1, WINDOW - width + 1):
            np.minimum(least, runs[i : i + n], out=least)
        own = np.arange(windows.sum()) + np.repeat(self.first[:-1] - (np.cumsum(windows) - windows), windows)  # those inside one text
        return least[own].view(np.int64), windows

    def text(self, lo: int, hi: int) -> str:
        """Words lo to hi as they stand."""
        return self.data[self.starts[lo] : self.ends[hi - 1]].tobytes().decode("utf-8", "surrogatepass")


def _chunks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The same rows, with texts of about CHUNK bytes at once."""
    size = np.cumsum(pa.compute.binary_length(b.column("text")).to_numpy())
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CHUNK, "right")))
        yield b.slice(lo, hi - lo)
        lo = hi


def _ones(mask: np.ndarray) -> list[tuple[int, int]]:
    """From and to of every run of true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _batch(kind: str, rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in kind.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == "string" else pa.int64()) for c, k in zip(cols, kinds, strict=True)], names=list(names))


def anchored(rows: DataFrame, width: int) -> DataFrame:
    """m, o: every anchor of every row, once for neighbouring windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in _chunks(b):
                m, windows = Words(c.column("text")).anchors(width)
                o = np.repeat(c.column("o").to_numpy(), windows)
                new = np.concatenate(([True], (m[1:] != m[:-1]) | (o[1:] != o[:-1]))) if len(m) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(m[new]), pa.array(o[new], pa.int64())], names=["m", "o"])

    return rows.select("o", "text").mapInArrow(run, "m long, o long")


PIECE = "home long, o long, tk long, start long, n long, text string"


def stretches(rows: DataFrame, width: int) -> DataFrame:
    """home, o, tk, start, n, text: n windows from word ``start`` on whose anchors have the same home, of rows o, tk, start, text."""
    again = written(anchored(rows, width).groupBy("m").agg(F.min("o").alias("home"), F.max("o").alias("last")).where("home < last").drop("last"), "anchors")
    side = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    own = anchored(rows, width).join(side, "m").groupBy("o").agg(F.collect_set(F.struct("m", "home")).alias("known"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in _chunks(b):
                words, out = Words(c.column("text")), []
                anchors, windows = words.anchors(width)
                lists = c.column("known")
                flat, at = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
                ms, homes = flat.field("m").to_numpy(), flat.field("home").to_numpy()
                done = 0
                for i, (o, tk, start) in enumerate(zip(*(c.column(x).to_pylist() for x in ("o", "tk", "start")), strict=True)):
                    m = anchors[done : done + windows[i]]
                    done += len(m)
                    if not len(m):
                        continue
                    mine = ms[at[i] : at[i + 1]]
                    order = np.argsort(mine, kind="stable")
                    mine = mine[order]
                    place = np.minimum(np.searchsorted(mine, m), len(mine) - 1)
                    known, home = mine[place] == m, homes[at[i] : at[i + 1]][order][place]
                    first = np.flatnonzero(np.concatenate(([True], (home[1:] != home[:-1]) | (known[1:] != known[:-1]))))
                    for f, e in zip(first.tolist(), [*first[1:].tolist(), len(m)], strict=True):
                        for s in range(f, e if known[f] else f, STRETCH):
                            n = min(e - s, STRETCH)
                            out.append((int(home[f]), o, tk, start + s, n, words.text(int(words.first[i]) + s, int(words.first[i]) + s + n + WINDOW - 1)))
                yield _batch(PIECE, out)

    cut_out = written(rows.join(own, "o").select("o", "tk", "start", "text", "known").mapInArrow(cut, PIECE), "stretches")
    discard(again, shuffles=True)
    return cut_out


FOUND = "o long, tk long, start long, stop long, text string"


def _automata(homes: dict[int, list[str]]) -> Iterator[tuple[set[int], dict[bytes, str], ahocorasick.Automaton]]:
    """Automata of the windows of the homes' stretches; each with its homes and its letters for words."""
    waiting = [(home, t) for home in sorted(homes) for t in homes[home]]
    while waiting:
        letters: dict[bytes, str] = {}
        own, size, machine = set(), 0, ahocorasick.Automaton(ahocorasick.STORE_INTS)
        while waiting and (not size or size < AUTOMATON):
            home, t = waiting.pop()
            words = words_of(t)
            # the code points that are not letters of words: 0, and surrogates
            line = "".join([letters.setdefault(w, chr(k + 1 if (k := len(letters)) < 0xD7FF else k + 0x801)) for w in words])
            for i in range(len(words) - WINDOW + 1):
                machine.add_word(line[i : i + WINDOW], 1)
            own.add(home)
            size += len(words)
        machine.make_automaton()
        yield own, letters, machine


def locate(streams: pa.Table, homes: pa.Table) -> pa.Table:
    """Of the windows of ``streams``: spans (words start to stop) that homes have, without text, and stretches that they don't have, with text."""
    phrases: dict[int, list[str]] = defaultdict(list)
    for home, t in zip(homes["h_home"].to_pylist(), homes["h_text"].to_pylist(), strict=True):
        phrases[home].append(t)
    texts, n = streams["text"].to_pylist(), streams["n"].to_pylist()
    by_home: dict[int, list[int]] = defaultdict(list)
    for i, home in enumerate(streams["home"].to_pylist()):
        by_home[home].append(i)
    there = {i: np.zeros(n[i], bool) for own in by_home.values() for i in own}
    for own, letters, machine in _automata({h: t for h, t in phrases.items() if h in by_home}):
        letter = letters.get
        for home in own:
            for i in by_home[home]:
                line = "".join([letter(w, "\0") for w in words_of(texts[i])])
                at = [end - WINDOW + 1 for end, _ in machine.iter(line)]
                if at:
                    there[i][at] = True
    rows = []
    for i, (o, tk, start) in enumerate(zip(*(streams[c].to_pylist() for c in ("o", "tk", "start")), strict=True)):
        rows += [(o, tk, start + a, start + e + WINDOW - 1, None) for a, e in _ones(there[i])]
        if not there[i].all():
            words = words_of(texts[i])
            rows += [(o, tk, start + a, start + e + WINDOW - 1, b" ".join(words[a : e + WINDOW - 1]).decode("utf-8", "surrogatepass")) for a, e in _ones(~there[i])]
    return pa.Table.from_batches([_batch(FOUND, rows)])


def searched(pieces: DataFrame) -> DataFrame:
    """o, tk, start, stop, text: what ``locate`` says of the stretches of every shard."""
    home = F.col("home") == F.col("o")
    total = pieces.agg(F.sum(F.when(home, F.col("n")))).first()[0] or 0
    shards = -(-total // SHARD) + 1
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("home"), F.lit(shards)))
    parts = written(pieces.where(~home).groupBy("shard").agg(F.ceil(F.sum("n") / PART).alias("parts")), "parts")
    side = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
    both = pieces.join(side, "shard")
    streams = both.where(~home).withColumn("part", F.pmod(F.xxhash64("o", "tk", "start"), F.col("parts")))
    homes = both.where(home).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    streams, homes = streams.select("shard", "part", "home", "o", "tk", "start", "n", "text"), homes.select(*(F.col(c).alias(f"h_{c}") for c in ("shard", "part", "home", "text")))
    out = written(streams.groupBy("shard", "part").cogroup(homes.groupBy("h_shard", "h_part")).applyInArrow(locate, FOUND), "found")
    discard(parts)
    return out


def covered(docs: DataFrame) -> DataFrame:
    """o, tk, spans: the words (start to stop) of doc_id, text that go, for documents that lose some."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("o")
    rows = docs.where("text is not null").select(key, text_number(F.col("text")).alias("tk"), F.lit(0).cast("long").alias("start"), "text")
    found, before = None, None
    for width in ANCHORS:
        pieces = stretches(rows, width)
        discard(before)  # this round's stretches came from it
        now = searched(pieces)
        discard(pieces, shuffles=True)
        hits = written(now.where("text is null").select("o", "tk", "start", "stop"), "hits")
        found = hits if found is None else found.unionByName(hits)
        rows, before = now.where("text is not null").select("o", "tk", "start", "text"), now
    discard(before)
    return found.groupBy("o", "tk").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the words that stay, parted by single blanks, as text, then n_words and n_removed in place of columns of these names."""
    gone = covered(docs.select("doc_id", "text")).select(F.col("o").alias("g_o"), F.col("tk").alias("g_tk"), "spans")
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    # a caller's columns stay inside one, so that none clashes with these
    rest = F.struct(*(F.col(c) for c in names if c != "text")) if len(names) > 1 else F.struct(F.lit(0).alias("none"))
    d = docs.select(rest.alias("rest"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("o"), text_number(F.col("text")).alias("tk"))
    d = d.join(gone, (d["o"] == gone["g_o"]) & (d["tk"] == gone["g_tk"]), "left").select("rest", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, counts, less = [], [], []
            for t, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = words_of(t)
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, [s["start"] for s in spans or ()], 1)
                np.add.at(step, [s["stop"] for s in spans or ()], -1)
                stay = np.flatnonzero(np.cumsum(step)[:-1] == 0)
                counts.append(len(words))
                less.append(len(words) - len(stay))
                texts.append(None if t is None else b" ".join([words[i] for i in stay.tolist()] if spans else words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column("rest"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(less, pa.int64())], names=["rest", "text", "n_words", "n_removed"])

    out = d.mapInArrow(run, f"rest {d.schema['rest'].dataType.simpleString()}, text string, n_words long, n_removed long")
    return out.select(*(F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in names), "n_words", "n_removed")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def oracle() -> str:
    """DuckDB SQL for digests(), of documents whose ids don't repeat."""
    window = ", ".join(f"lead(w, {i}) OVER o" for i in range(1, WINDOW))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
r AS (SELECT doc_id, i, concat_ws(' ', w, {window}) AS p, lead(w, {WINDOW - 1}) OVER o AS z FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT p, min(doc_id) AS home FROM r WHERE z IS NOT NULL GROUP BY p HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, i + unnest(range({WINDOW})) AS i FROM r JOIN f USING (p) WHERE z IS NOT NULL AND doc_id > home),
t AS (SELECT doc_id, count(g.i) AS n_removed, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (g.i IS NULL), '') AS kept FROM l LEFT JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""
