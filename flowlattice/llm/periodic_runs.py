"""Periodic runs of words by bit-parallel lags.

Words are what ASCII white space parts.  A run of period q is a stretch of words in which words q
apart are equal, that no neighbouring word extends, whose smallest period is q, and which has
max(``LEAST``, 2 q) words or more.

A text's word ids are laid out as bit planes, one big integer for each bit of the ids.  At lag q, each
plane is XORed with itself shifted by q and the mismatches are ORed; what stays zero are places whose
word is repeated q words on.  ANDing that with itself, shifted by doubling steps, leaves the places at
which long enough stretches begin.  Lags ascend, and the same stretch at a multiple of its period is
passed over, so a stretch gets its smallest period.

A lag is taken up only if some place at a multiple of the length that its stretch needs agrees, for
such a stretch holds such a place.  These are n/q places for lag q, n log n in all, and most lags of
a long text end there.  A run over the whole text ends the search, as there is no other beyond it.

Edge cases: null and empty texts, and texts of under ``LEAST`` words, have no run.  Null and repeated
ids play no part: each row stands alone.  No rows: no rows.  Other columns pass through untouched,
whatever they are called.  A text of n words in one repetition after the other takes time with n^2/64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlattice.llm.common import slices

LEAST = 12
#: Planes after which a lag is given up if no stretch is left.
EARLY = 3
#: What parts words; the same bytes as bytes.split() takes.
BLANKS = r"[\x20\x09-\x0D]+"
RUNS = "array<struct<start:long,length:long,period:long>>"


def _places(bits: int, n: int) -> np.ndarray:
    """Where the n lowest bits are set."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))


def _stretches(equal: int, least: int) -> int:
    """The places at which ``least`` set bits in a row begin."""
    have = 1
    while have < least and equal:
        step = min(have, least - have)
        equal &= equal >> step
        have += step
    return equal


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, n)
    planes: list[int] = []
    found: dict[tuple[int, int], int] = {}
    for q in range(1, n // 2 + 1 if n >= LEAST else 0):
        least, m = max(LEAST, 2 * q) - q, n - q
        if not (ids[:m:least] == ids[q::least]).any():
            continue
        planes = planes or [int.from_bytes(np.packbits(ids >> b & 1, bitorder="little").tobytes(), "little") for b in range(max(1, (len(number) - 1).bit_length()))]
        every, differ, begins = (1 << m) - 1, 0, 0
        for part in (planes[:EARLY], planes[EARLY:]):
            for p in part:
                differ |= p ^ p >> q
            begins = _stretches(every & ~differ, least)
            if not begins:
                break
        if not begins:
            continue
        first, last = _places(begins & ~(begins << 1), m), _places(begins & ~(begins >> 1), m)
        for s, length in zip(first.tolist(), (last - first + least + q).tolist(), strict=True):
            found.setdefault((s, length), q)
        if (0, n) in found:
            break
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, parted by single blanks, without those that stand in a run after its first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, [s + q for s, _, q in runs], 1)
    np.add.at(gone, [s + length for s, length, _ in runs], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()])


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with every run cut down to its first period in text, then runs (by start, then period) in place of a column of that name."""
    names = [c for c in docs.columns if c != "runs"]
    rest = F.struct(*(F.col(c) for c in names if c != "text")) if len(names) > 1 else F.struct(F.lit(0).alias("none"))
    rows = docs.select(rest.alias("rest"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts: list[str | None] = []
            starts, lengths, periods, ends = [], [], [], [0]
            for t in b.column("text").to_pylist():
                words = (t or "").encode("utf-8", "surrogatepass").split()
                own = runs_of(words)
                texts.append(None if t is None else collapsed(words, own).decode("utf-8", "surrogatepass"))
                for s, length, q in own:
                    starts.append(s), lengths.append(length), periods.append(q)
                ends.append(len(starts))
            each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts, lengths, periods)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([b.column("rest"), pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], names=["rest", "text", "runs"])

    out = rows.mapInArrow(run, f"rest {rows.schema['rest'].dataType.simpleString()}, text string, runs {RUNS}")
    return out.select(*(F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in names), "runs")


def repeated(docs: DataFrame) -> DataFrame:
    """``docs`` with a periodic tail in the texts that a checksum of the id picks, one in ten.

    With h = crc32 of the id in decimal and g = floor(h / 10): where 10 divides h and there are n > 0 words, each word i >= a
    becomes word a + (i - a) % p, for a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).  A null id picks none.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", BLANKS), lambda w: w != "")
    d = docs.withColumn("text", F.when(h % 10 == 0, F.struct(words.alias("w"), F.floor(h / 10).alias("g"), F.col("text").alias("t"))).otherwise(F.struct(F.lit(None).cast("array<string>").alias("w"), F.lit(None).cast("long").alias("g"), F.col("text").alias("t"))))
    w, g = F.col("text.w"), F.col("text.g")
    n = F.size(w).cast("long")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    return d.withColumn("text", F.when(w.isNotNull() & (n > 0), F.array_join(tail, " ")).otherwise(F.col("text.t")))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every text, after ``repeated``."""
    own = collapse(repeated(docs.select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines: Column = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    own = own.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("b.length"), -F.col("b.period")
    return own.select("doc_id", "n_runs", (-F.col("b.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
