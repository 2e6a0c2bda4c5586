"""Exact top-k by an impact-ordered, score-at-a-time index.

Components become impacts floor(256 * x).  Candidates are dealt to blocks of a bounded size.  A
block's index has, for each dimension and each level of impact (``LEVEL`` impacts wide), one
posting segment: the rows in it and the segment's least and largest impact.

A query meets a block's segments by descending magnitude of quantised impact times its own
component.  A segment adds to its rows' sums the most it can contribute.  After every round,
a row's sum plus the largest positive contribution still open in every dimension bounds its
score from above; the k-th largest exact score of some rows bounds the k-th best from below.
Rows whose upper bound falls short are proven out.  When few are left (or no segment is), all
that are left get exact scores.  The best k of each block are then merged.

Before that, every query meets a first block, of the candidates of the largest norms.  Its k-th best
score there goes with the query to all other blocks as a bound from below, so that there whole blocks
and segments drop out at once.

Scores are exact.  Rows and queries whose components are so large that doubles might not hold their
scores are scored in whole numbers of any size, outside the segments.  A score that would be returned
and does not fit into 64 bits is an error, as the result could not be stated; others may be as large
as they like.

Edge cases: a vector that is null or holds a null or non-finite component takes no part.  A
shorter vector counts as 0 beyond its end.  Rows that repeat a query's vec_id are none of its
candidates; a query row that repeats another asks once.  Rows with a null vec_id ask nothing
and, having no id to return, are no candidates.  No queries or no candidates: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlattice.llm.common import written

SCALE = 256
#: Candidates of a block and queries of a block, about.
BLOCK_ROWS, QUERY_ROWS = 4096, 4096
#: Impacts that share a segment (a power of two), segments of a round, and rows that are few enough to rescore.
LEVEL, ROUND, FEW = 16, 256, 2048
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def plain(impacts: np.ndarray) -> np.ndarray:
    """Which rows are so small that doubles hold every score between two of them, and all sums on the way."""
    limit = (2.0**52 / max(impacts.shape[1], 1)) ** 0.5
    return abs(impacts).max(axis=1, initial=0) < limit


def whole(x: float) -> int:
    """floor(SCALE * x), whatever the size of x."""
    return int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(SCALE * x)


class Index:
    """The segments of one block, and its vectors for exact scores; ``large``: rows outside the segments, in whole numbers."""

    def __init__(self, ids: np.ndarray, impacts: np.ndarray, large: list[tuple[int, list[int]]] | None = None) -> None:
        self.ids, self.exact, self.large = ids, impacts.astype(np.float64), large or []
        own = self.exact.astype(np.int64)
        n, dims = own.shape
        level = own // LEVEL
        low = int(level.min()) if level.size else 0
        width = int(level.max()) - low + 1 if level.size else 1
        key = (np.arange(dims) * width + (level - low)).T.ravel()  # dimension by dimension
        order = np.argsort(key, kind="stable")
        self.rows = np.tile(np.arange(n, dtype=np.int32), dims)[order]
        segments, self.starts = np.unique(key[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(key))
        self.dim = segments // width
        values = own.T.ravel()[order]
        self.least = np.minimum.reduceat(values, self.starts).astype(np.float64) if len(values) else np.zeros(0)
        self.most = np.maximum.reduceat(values, self.starts).astype(np.float64) if len(values) else np.zeros(0)
        self.quantised = np.maximum(abs(self.least), abs(self.most))

    def top(self, own: int, query: np.ndarray, k: int, floor: float = -np.inf, exactly: list[int] | None = None) -> list[tuple[int, int]]:
        """(vec_id, score) of the block's best k for one query; those below ``floor`` may be left out.  exactly: a query that is too large for the segments."""
        found = self._segments(own, query, k, floor) if exactly is None else []
        rest = self.large if exactly is None else [*self.large, *((int(i), [int(x) for x in v]) for i, v in zip(self.ids, self.exact.tolist(), strict=True))]
        if rest:
            asked = exactly or [int(x) for x in query.tolist()]
            found += [(i, sum(a * b for a, b in zip(asked, v, strict=True))) for i, v in rest if i != own]
            found.sort(key=lambda x: (-x[1], x[0]))
        return found[:k]

    def _segments(self, own: int, query: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        free = self.ids != own
        k = min(k, int(free.sum()))
        if k == 0:
            return []
        q = query[self.dim]
        bound = np.maximum(q * self.least, q * self.most)
        rest = np.zeros(len(query))  # the largest contribution that each dimension still has open
        np.maximum.at(rest, self.dim, bound)
        if rest.sum() < floor:
            return []
        order = np.argsort(-self.quantised * abs(q), kind="stable")
        sums = np.where(free, 0.0, -np.inf)
        open_ = np.ones(len(order), bool)
        left = np.flatnonzero(free)
        for lo in range(0, len(order), ROUND):
            part = order[lo : lo + ROUND]
            open_[part] = False
            rows = np.concatenate([self.rows[a:b] for a, b in zip(self.starts[part].tolist(), self.ends[part].tolist(), strict=True)])
            sums += np.bincount(rows, np.repeat(bound[part], self.ends[part] - self.starts[part]), len(sums))
            rest = np.zeros(len(query))
            np.maximum.at(rest, self.dim[open_], bound[open_])
            best = np.argpartition(-sums, k - 1)[:k]
            floor = max(floor, (self.exact[best] @ query).min())
            left = np.flatnonzero(sums + rest.sum() >= floor)
            if len(left) <= max(FEW, k):
                break
        score = (self.exact[left] @ query).astype(np.int64)
        return [(int(self.ids[left[i]]), int(score[i])) for i in np.lexsort((self.ids[left], -score))[:k]]


def _table(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists as rows of one width."""
    rows = column.combine_chunks()
    flat, at = rows.flatten().to_numpy(), np.diff(rows.offsets.to_numpy())
    if len(at) and (at == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(at), dims))
    out[np.repeat(np.arange(len(at)), at), np.arange(len(flat)) - np.repeat(np.cumsum(at) - at, at)] = flat
    return out


ASKED = "query_id long, ask long, vec_id long, score long, over int"


def _answers(candidates: pa.Table, questions: pa.Table, k: int) -> pa.Table:
    """The best k of one block for each question: clamped scores, and over (-1, 0, 1) where they leave 64 bits."""
    out: list[tuple] = []
    if candidates.num_rows and questions.num_rows:
        dims = max(int(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max()) for t in (candidates, questions))
        ids, rows, asked = candidates["vec_id"].to_numpy(), _table(candidates["v"], dims), _table(questions["v"], dims)
        with np.errstate(over="ignore"):
            impacts, query = np.floor(SCALE * rows), np.floor(SCALE * asked)
        small, fits = plain(impacts), plain(query)
        index = Index(ids[small], impacts[small], [(int(i), [whole(x) for x in v]) for i, v in zip(ids[~small], rows[~small].tolist(), strict=True)])
        floors = questions["floor"].to_pylist() if "floor" in questions.column_names else [None] * questions.num_rows
        for n, (own, ask, floor) in enumerate(zip(questions["vec_id"].to_pylist(), questions["ask"].to_pylist(), floors, strict=True)):
            best = index.top(own, query[n], k, -np.inf if floor is None else floor, None if fits[n] else [whole(x) for x in asked[n].tolist()])
            out += [(own, ask, i, max(LEAST, min(MOST, s)), (s > MOST) - (s < LEAST)) for i, s in best]
    cols = list(zip(*out, strict=True)) or [()] * 5
    return pa.Table.from_arrays([pa.array(c, pa.int32() if i == 4 else pa.int64()) for i, c in enumerate(cols)], names=["query_id", "ask", "vec_id", "score", "over"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs have vec_id and embedding."""

    def finite(df: DataFrame) -> DataFrame:
        sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        df = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))

    base = finite(vectors)
    asked = written(finite(queries).dropDuplicates(["vec_id", "v"]).withColumn("ask", F.xxhash64("v")), "asked")
    n, m = base.count(), asked.count()
    b, q = max(1, -(-n // BLOCK_ROWS)), max(1, -(-m // QUERY_ROWS))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(q)))
    if b > 1:
        norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        first = written(base.orderBy(norm.desc(), "vec_id").limit(BLOCK_ROWS), "first")
        left = first.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q - 1))))
        best = left.groupBy("qb").cogroup(asked.groupBy("qb")).applyInArrow(lambda x, y: _answers(x, y, k), ASKED)
        # the k-th best of some candidates, where it is a whole double; scores beyond 2^52 bound nothing
        floor = F.when((F.count("*") == k) & (F.max(F.abs("over")) == 0) & (F.min("score") > -(1 << 52)), F.least(F.min("score"), F.lit(1 << 52)).cast("double"))
        floors = best.groupBy(F.col("query_id").alias("f_id"), F.col("ask").alias("f_ask")).agg(floor.alias("floor"))
        asked = written(asked.join(floors, (F.col("vec_id") == F.col("f_id")) & (F.col("ask") == F.col("f_ask")), "left").select("vec_id", "v", "ask", "qb", "floor"), "bounds")
    # row order deals the candidates, so that ids or vectors that repeat spread too
    left = base.withColumn("bb", F.pmod(F.monotonically_increasing_id(), F.lit(b))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q - 1)))).select((F.col("bb") * q + F.col("qb")).alias("g"), "vec_id", "v")
    right = asked.withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))).select((F.col("bb") * q + F.col("qb")).alias("g"), *(c for c in asked.columns if c != "qb"))
    best = left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(lambda x, y: _answers(x, y, k), ASKED)
    rank = F.row_number().over(Window.partitionBy("query_id", "ask").orderBy(F.col("over").desc(), F.col("score").desc(), "vec_id"))
    score = F.when(F.col("over") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score of the result leaves 64 bits")).cast("long"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))


def oracle(k: int = 5, step: int = 50) -> str:
    """DuckDB SQL for search() with the rows whose vec_id is divisible by ``step`` as queries."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {step} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
