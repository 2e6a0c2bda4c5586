"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features: whether a hashed byte n-gram (orders ``ORDERS``) of the normalised text occurs.
Normalising lower-cases and turns ASCII digits, punctuation and controls into blanks.  From
a bounded sample of labelled rows, each feature j gets

    r_j = ln((n1_j + 1) / (N1 + 2)) - ln((n0_j + 1) / (N0 + 2))

(counted by Spark; only features that matter, and rows cut down to them, reach the driver)
with n1_j of N1 toxic and n0_j of N0 clean rows that have it; logistic regression is then
fitted to presence * r.  A last shift of the intercept puts 0.5 where the sample's error,
weighted by the classes' true shares, is least.

Edge cases: a null or empty text has no feature and gets the intercept's score.  Labels that
are null, or whose doc_id is null or unknown, teach nothing; a doc_id with several labels
counts as toxic if one says so, and one with several texts teaches that of the smallest hash.  No label, or one class alone: the score is that class's share
(0 without labels).  Repeated rows score alike.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlattice.llm.common import hash_share, held_out, slices, written

ORDERS = (4, 5, 6)
BITS = 20
#: Labelled rows of each class to fit on, about; chosen by a hash of doc_id.
SAMPLE = 1500
MIN_ROWS, MIN_RATIO = 4, 0.7
STEPS, RATE, L2 = 400, 0.05, 2e-3
#: Bytes that are hashed at once.
BLOCK = 2_000_000

_BLANK = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalise(text: str | None) -> bytes:
    return b" " + (text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANK) + b" "


def hashed(data: bytes) -> Iterator[np.ndarray]:
    """For each order, the features at every place of ``data`` where an n-gram of that order starts."""
    padded = np.frombuffer(data + b"\0" * 8, np.uint8)
    words = np.ndarray(len(data), "<u8", padded.data, strides=(1,))
    for n in ORDERS:
        keys = words[: max(len(data) - n + 1, 0)] & np.uint64((1 << 8 * n) - 1)
        keys = keys * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
        yield ((keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int32)


def features(text: str | None) -> np.ndarray:
    """The distinct features of a text, in order; its bytes are hashed block by block."""
    data, seen = normalise(text), np.zeros(1 << BITS, bool)
    if not (text or ""):
        return np.zeros(0, np.int32)
    lap = max(ORDERS) - 1
    for lo in range(0, len(data), BLOCK):
        for ids in hashed(data[lo : lo + BLOCK + lap]):
            seen[ids] = True
    return np.flatnonzero(seen).astype(np.int32)


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, float]:
    """doc_id, toxic of about ``sample`` learning rows a class, and toxic's share of all of them."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / max(sum(n.values()), 1)
    keep = F.lit(False)
    for label, rows in n.items():
        keep = keep | ((F.col("toxic") == label) & hash_share(F.col("doc_id"), sample / rows))
    return known.where(keep), share


def learned(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """toxic, ids (the features): one row a picked doc_id."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [features(t) for t in b.column("text").to_pylist()]
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("tk"), ids], names=["doc_id", "toxic", "tk", "ids"])

    # the sample is bounded, so its ids may be broadcast; texts stay where they are
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tk"), "text")
    rows = joined.mapInArrow(gather, f"doc_id {kind}, toxic int, tk string, ids array<int>")
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "ids"), "tk").alias("x")).select("x.toxic", "x.ids")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, their weights (w * r), and the intercept."""
    picked, share = sample_rows(docs, labels, sample)
    rows = written(learned(docs, picked), "learned")
    total = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    none = np.zeros(0, np.int32), np.zeros(0, np.float32), logit(share)
    if len(total) < 2:
        return none
    n, hits = F.count("*"), F.sum("toxic")
    counts = rows.select("toxic", F.explode("ids").alias("id")).groupBy("id").agg(hits.cast("long").alias("n1"), (n - hits).cast("long").alias("n0"))
    counts = counts.where(F.col("n1") + F.col("n0") >= min(MIN_ROWS, sum(total.values()) / 10)).toPandas().sort_values("id")  # 2^BITS at most
    ratio = ratios(counts["n1"].to_numpy(), counts["n0"].to_numpy(), total[1], total[0])
    told = np.abs(ratio) >= MIN_RATIO
    ids, ratio = counts["id"].to_numpy()[told].astype(np.int32), ratio[told]
    if not len(ids):
        return none

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.intersect1d(x.values.to_numpy(), ids, assume_unique=True).astype("<i4").tobytes() for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(own, pa.binary())], names=["toxic", "own"])

    got = sorted((r.toxic, bytes(r.own)) for r in rows.mapInArrow(known, "toxic int, own binary").collect())
    return train(np.array([y for y, _ in got], bool), [np.frombuffer(x, "<i4") for _, x in got], ids, ratio, share)


def ratios(n1: np.ndarray, n0: np.ndarray, total1: int, total0: int) -> np.ndarray:
    """Naive Bayes log-count ratios."""
    return np.log((n1 + 1) / (total1 + 2)) - np.log((n0 + 1) / (total0 + 2))


def train(toxic: np.ndarray, rows: list[np.ndarray], ids: np.ndarray, ratio: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression of presence * ratio; rows hold ids alone."""
    total1, total0 = int(toxic.sum()), int((~toxic).sum())
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    col, r = np.searchsorted(ids, np.concatenate(rows)), ratio
    weight = np.where(toxic, 0.5 / total1, 0.5 / total0)
    w, b = np.zeros(len(ids)), 0.0
    m, v = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    for step in range(1, STEPS + 1):  # Adam on the whole sample
        z = np.bincount(row, (w * r)[col], len(rows)) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic)
        grad = np.append(np.bincount(col, g[row], len(ids)) * r + L2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    z = np.bincount(row, (w * r)[col], len(rows))
    return ids.astype(np.int32), (w * r).astype(np.float32), -cut(z, toxic, share)


def cut(z: np.ndarray, toxic: np.ndarray, share: float) -> float:
    """The threshold of z with least weighted error; the middle of the widest such gap."""
    order = np.argsort(z)
    s, y = z[order], toxic[order]
    cost = np.where(y, share / max(y.sum(), 1), (1 - share) / max((~y).sum(), 1))
    miss = np.concatenate(([0], np.cumsum(cost * y)))  # toxic rows below the cut
    false = (cost * ~y).sum() - np.concatenate(([0], np.cumsum(cost * ~y)))
    edge = np.concatenate(([s[0] - 1], s, [s[-1] + 1]))
    error = miss + false
    best = np.flatnonzero(error <= error.min() + 1e-12)
    gap = edge[best + 1] - edge[best]
    k = best[gap.argmax()]
    return float((edge[k] + edge[k + 1]) / 2)


def logit(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return float(np.log(p / (1 - p)))


def scores(texts: list[str | None], held: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The scores of texts, batch-wise: features without a weight are skipped at once."""
    table = np.zeros(1 << BITS, np.float32)
    table[held] = weights
    live = np.zeros(1 << BITS, bool)
    live[held] = True
    z = np.full(len(texts), bias)
    lap = max(ORDERS) - 1
    i = 0
    while i < len(texts):
        parts, size, lo = [], 0, i
        while i < len(texts) and (not parts or size < BLOCK):
            parts.append(normalise(texts[i]) + b"\0" * lap if texts[i] else b"")
            size += len(parts[-1])
            i += 1
        ends, data, pairs = np.cumsum([len(p) for p in parts]), b"".join(parts), []
        for at in range(0, len(data), BLOCK):
            raw = np.frombuffer(data[at : at + BLOCK + lap], np.uint8)
            gaps = np.flatnonzero(raw == 0)
            for n, ids in zip(ORDERS, hashed(data[at : at + BLOCK + lap]), strict=True):
                hit = live[ids[:BLOCK]]
                for k in range(n):  # n-grams that reach into the gap behind a text are none of its own
                    back = gaps - k
                    hit[back[(back >= 0) & (back < len(hit))]] = False
                spot = np.flatnonzero(hit)
                pairs.append(np.searchsorted(ends, spot + at, "right").astype(np.int64) << BITS | ids[spot])
        own = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        z[lo:i] += np.bincount(own >> BITS, table[own & ((1 << BITS) - 1)], i - lo)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; see the module's text."""
    held, weights, bias = fit(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = scores(b.column("text").to_pylist(), held, weights, bias)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
