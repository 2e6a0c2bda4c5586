"""Byte-level BPE by DuckDB recursive queries, one database per partition.

Encoding.  A pattern cuts texts into words.  Words not met before by this Python worker go to
DuckDB: a row holds a word's tokens; the recursive step lays out token positions, joins
neighbouring tokens with the merge table, and contracts each word's leftmost pair of least
rank, until no pair of any word is in the table.  A text's ids are its words' ids in order.

A word of over ``LONG`` bytes is contracted in pieces of ``PIECE`` bytes by the same query.  A
row of tokens is the whole word's encoding exactly if each two neighbours, put together, encode
to themselves: the first merge across a place where two tokens meet would also be the first in
those two alone.  So the seams between pieces are checked, and around one that fails the tokens
on both sides are contracted anew, until no seam fails.

Decoding uses ids alone.  A text's ids are cut before every token that starts with a blank (and
after ``RUN`` tokens); of the distinct runs, token positions are joined with the vocabulary and
put together by an ordered aggregation.

Edge cases: a null text encodes as the empty text, to no ids.  Special tokens' strings are
ordinary text.  Repeated rows give repeated results; extra columns are not read.  Very long
texts are cut into words piece by piece; none is cut short.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a word beyond which it is contracted in pieces, bytes of a piece, and tokens contracted anew on either side of a seam.
LONG, PIECE, NEAR = 128, 64, 8
#: Words (or pieces), and tokens of runs of ids, for one DuckDB query; tokens of a run at most.
BATCH, TOKENS, RUN = 40_000, 1_000_000, 64
#: Bytes of words and runs that a Python worker remembers; later ones are worked out each time.
REMEMBER = 60_000_000
#: What an entry takes besides its bytes, about.
ENTRY = 160
#: Characters whose words are held at once.
CHARS = 1_000_000

# USING KEY keeps a word's last state alone, so memory doesn't grow with the steps
_CONTRACT = """
WITH RECURSIVE s(w, ts) USING KEY (w) AS (
  SELECT w, ts FROM seed
  UNION ALL
  SELECT w, list_concat(ts[:p - 1], [(best >> 24)::INT], ts[p + 2:])
  FROM (SELECT s.*, best, (best & 16777215)::INT AS p
        FROM (SELECT n.w, min(m.t::BIGINT << 24 | n.p) AS best
              FROM (SELECT w, unnest(ts[:-2]) AS a, unnest(ts[2:]) AS b, generate_subscripts(ts[2:], 1) AS p FROM s WHERE len(ts) > 1) n
              JOIN merges m ON (n.a::BIGINT << 32 | n.b) = m.pair GROUP BY n.w) JOIN s USING (w)))
SELECT ts AS ids FROM s ORDER BY w"""

_JOIN = """
SELECT string_agg(v.bytes, '' ORDER BY r.p) AS t
FROM (SELECT w, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM runs) r JOIN vocab v USING (id) GROUP BY r.w ORDER BY r.w"""


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> np.ndarray:
    """Rows (left id, right id, merged id): every way to put a token together from two tokens."""
    rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return np.array(rows, np.int32).reshape(-1, 3)


class Coder:
    """Encodes and decodes in one process."""

    def __init__(self, ranks: dict[bytes, int], merges: np.ndarray, pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.words: dict[str, bytes] = {}
        self.runs: dict[bytes, bytes] = {}
        self.seams: dict[bytes, bytes] = {}
        self.room = {"words": REMEMBER, "runs": REMEMBER}
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        blank, size = np.zeros(max(ranks.values()) + 1, bool), np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            blank[rank], size[rank] = token[:1] == b" ", len(token)
        self.blank, self.size = blank, size
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "500MB"})
        self.db.execute("SET temp_directory = ''")
        table = pa.table({"pair": merges[:, 0].astype(np.int64) << 32 | merges[:, 1], "t": merges[:, 2]})
        vocab = pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": [t.decode("latin-1") for t in ranks]})
        for name, rows in (("merges", table), ("vocab", vocab)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def _ask(self, sql: str, name: str, rows: pa.Table) -> pa.ChunkedArray:
        self.db.register(name, rows)
        try:
            return self.db.sql(sql).to_arrow_table().column(0)
        finally:
            self.db.unregister(name)

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian 32-bit integers."""
        out: list[bytes] = []
        for lo in range(0, len(words), BATCH):
            part = words[lo : lo + BATCH]
            ends = np.cumsum([len(w) for w in part])
            ts = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(self.single[np.frombuffer(b"".join(part), np.uint8)]))
            got = self._ask(_CONTRACT, "seed", pa.table({"w": pa.array(np.arange(len(part)), pa.int32()), "ts": ts})).combine_chunks()
            flat, at = got.flatten().to_numpy().astype("<u4").tobytes(), (got.offsets.to_numpy() - got.offsets[0].as_py()) * 4
            out += [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return out

    def join(self, runs: list[bytes]) -> list[bytes]:
        """The bytes that runs of ids stand for."""
        out: list[bytes] = []
        for part in by_size(runs, [len(r) // 4 for r in runs], TOKENS):
            ends = np.cumsum([len(r) // 4 for r in part])
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(np.frombuffer(b"".join(part), "<i4")))
            got = self._ask(_JOIN, "runs", pa.table({"w": pa.array(np.arange(len(part)), pa.int32()), "ids": ids}))
            out += [t.encode("latin-1") for t in got.to_pylist()]
        return out

    def _near(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of what stands around seams; such words often repeat."""
        if len(self.seams) > BATCH:
            self.seams.clear()
        new = list(set(words).difference(self.seams))
        self.seams |= zip(new, self.contract(new), strict=True)
        return [np.frombuffer(self.seams[w], "<u4") for w in words]

    def pieced(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of any length, from those of their pieces; all words together, end to end."""
        if not words:
            return []
        text, stops = b"".join(words), np.cumsum([0, *map(len, words)])
        cuts = [a for lo, hi in zip(stops.tolist(), stops[1:].tolist(), strict=False) for a in range(lo, hi, PIECE)]
        parts = self.contract([text[a:z] for a, z in zip(cuts, [*cuts[1:], len(text)], strict=True)])
        ends = np.cumsum(self.size[np.frombuffer(b"".join(parts), "<u4")])  # where each token ends
        seams, furthest, turns = np.setdiff1d(cuts, stops), -1, 0
        while len(seams):
            at = np.searchsorted(ends, seams)
            left, right = np.where(at > 0, ends[at - 1], 0), ends[at + 1]
            found = self._near([text[a:z] for a, z in zip(left.tolist(), right.tolist(), strict=True)])
            wrong = [i for i, (x, s, a) in enumerate(zip(found, seams.tolist(), left.tolist(), strict=True)) if len(x) != 2 or self.size[x[0]] != s - a]
            if not wrong:
                break
            # all before the first wrong seam is sound; if that doesn't move on, more tokens around it are contracted
            turns = 0 if seams[wrong[0]] > furthest else turns + 1
            furthest = max(furthest, int(seams[wrong[0]]))
            own = np.searchsorted(stops, seams[wrong], "right")
            first, final = np.searchsorted(ends, stops[own - 1], "right"), np.searchsorted(ends, stops[own])
            spans, later, last = [], [], -1
            for k, i in enumerate(wrong):
                width = NEAR << turns if k == 0 else NEAR
                lo, hi = max(int(at[i]) - width + 1, int(first[k])), min(int(at[i]) + width, int(final[k]))
                if lo > last:
                    spans.append((lo, hi))
                    last = hi
                else:
                    later.append(int(seams[i]))
            edges = [(int(ends[lo - 1]) if lo else 0, int(ends[hi])) for lo, hi in spans]
            kept, done = [], 0
            for (lo, hi), (a, _), ids in zip(spans, edges, self._near([text[a:z] for a, z in edges]), strict=True):
                kept += [ends[done:lo], a + np.cumsum(self.size[ids])]
                done = hi + 1
            ends = np.concatenate([*kept, ends[done:]])
            again = np.setdiff1d([*later, *chain.from_iterable(edges)], stops).astype(np.int64)
            seams = again[ends[np.searchsorted(ends, again)] == again]
        at = [0, *ends.tolist()]
        ids = np.array([self.ranks[text[a:z]] for a, z in zip(at, at[1:], strict=False)], "<u4").tobytes()
        own = np.append(0, np.searchsorted(ends, stops[1:]) + 1) * 4
        return [ids[a:z] for a, z in zip(own.tolist(), own[1:].tolist(), strict=False)]

    def learn(self, new: Iterable[str]) -> dict[str, bytes]:
        """Ids of words; remembers as many as there is room for."""
        plain = {w: w.encode("utf-8", "surrogatepass") for w in new}
        short = [w for w, b in plain.items() if len(b) <= LONG]
        got = dict(zip(short, self.contract([plain[w] for w in short]), strict=True))
        self._remember("words", got)
        long = [w for w in plain if len(plain[w]) > LONG]
        return got | dict(zip(long, self.pieced([plain[w] for w in long]), strict=True))

    def _remember(self, what: str, new: dict) -> None:
        if self.room[what] > 0:
            self.room[what] -= sum(len(k) + len(v) + ENTRY for k, v in new.items())
            getattr(self, what).update(new)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers; texts of one call are held at once."""
        cut = [self._words(t or "") for t in texts]
        own = self._resolved(set(chain.from_iterable(w for w in cut if isinstance(w, list))))
        out = []
        for words in cut:
            if isinstance(words, list):
                out.append(b"".join(map(own, words)))
            else:  # a very long text, piece by piece
                parts = []
                while piece := [m.group() for m in islice(words, CHARS // 4)]:
                    parts.append(b"".join(map(self._resolved(set(piece)), piece)))
                out.append(b"".join(parts))
        return out

    def _words(self, text: str):
        return self.pattern.findall(text) if len(text) <= CHARS else self.pattern.finditer(text)

    def _resolved(self, words: set[str]):
        """A lookup that knows these words."""
        fresh = {w: ids for w, ids in self.learn(words.difference(self.words)).items() if w not in self.words}
        return (lambda w: self.words.get(w) or fresh[w]) if fresh else self.words.__getitem__

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """The bytes of texts from their ids."""
        cut = []
        for ids in coded:
            n = len(ids) // 4
            at = np.union1d(np.flatnonzero(self.blank[np.frombuffer(ids, "<u4")]), [0, n])
            wide = np.flatnonzero(np.diff(at) > RUN)
            if len(wide):
                at = np.union1d(at, np.concatenate([np.arange(at[i], at[i + 1], RUN) for i in wide]))
            at = (at * 4).astype(np.int64).tolist()
            cut.append([ids[a:b] for a, b in zip(at, at[1:], strict=False)])
        new = list(set(chain.from_iterable(cut)).difference(self.runs))
        fresh = dict(zip(new, self.join(new), strict=True))
        self._remember("runs", fresh)
        return [b"".join([self.runs.get(r) or fresh[r] for r in runs]) for runs in cut]


def by_size(rows: list, sizes: list[int], most: int) -> Iterator[list]:
    """Consecutive rows of about ``most`` in all."""
    lo = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most:
            yield rows[lo : i + 1]
            lo, held = i + 1, 0
    if lo < len(rows):
        yield rows[lo:]


def batches_of(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of about CHARS characters."""
    lo = 0
    for part in by_size(texts, [len(t or "") for t in texts], CHARS):
        yield lo, lo + len(part)
        lo += len(part)


def _coder(given) -> Coder:
    """The coder of a broadcast vocabulary; it lives in the broadcast value, so a Python worker keeps it from task to task."""
    held = given.value
    if "coder" not in held:
        held["coder"] = Coder(held["ranks"], held["merges"], held["pattern"])
    return held["coder"]


def _given(docs: DataFrame, path: str, pattern: str):
    ranks = load_ranks(path)
    return docs.sparkSession.sparkContext.broadcast({"ranks": ranks, "merges": merge_table(ranks), "pattern": pattern})


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every text and decodes the ids again."""
    given = _given(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(given)
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in batches_of(texts):
                coded = coder.encode(texts[lo:hi])
                plain = coder.decode(coded)
                cols = [b.column("doc_id")[lo:hi], pa.array([len(c) // 4 for c in coded], pa.int64())]
                cols += [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (coded, plain)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of ``docs`` but text, then n_tokens and ids."""
    given = _given(docs, path, pattern)
    kept = [c for c in docs.columns if c not in ("text", "n_tokens", "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(given)
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in batches_of(texts):
                coded = coder.encode(texts[lo:hi])
                ends = np.cumsum([0, *(len(c) // 4 for c in coded)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                yield pa.RecordBatch.from_arrays([*(b.column(c)[lo:hi] for c in kept), pa.array(np.diff(ends), pa.int64()), ids], names=[*kept, "n_tokens", "ids"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(kept).schema)
    return docs.select(*kept, "text").mapInArrow(run, f"{fields}n_tokens long, ids array<int>")


def decoded(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``coded`` with its ids (null: none) replaced by text; bytes that are not UTF-8 become U+FFFD."""
    given = _given(coded, path, pattern)
    kept = [c for c in coded.columns if c not in ("text", "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(given)
        for b in batches:
            ids = [np.asarray(x or [], "<u4").tobytes() for x in b.column("ids").to_pylist()]
            plain = [t.decode("utf-8", "replace") for t in coder.decode(ids)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(plain, pa.string())], names=[*kept, "text"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in coded.select(kept).schema)
    return coded.select(*kept, F.col("ids").cast("array<long>").alias("ids")).mapInArrow(run, f"{fields}text string")
