"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled (ordered by a hash of id and text) into one stream of
words, which repeats up to ``EPOCHS`` times.  The stream is cut into blocks of ``BLOCK`` words.
Slot i of the mix has the golden-ratio point i * phi mod 1, held as a whole number of 2^-31; the
cumulative target weights say which source that point falls to.  The k-th slot of a source takes
its k-th block.  A source has no more slots than its target needs, and its last block ends where
the target is reached; each source's share of the weights has some slots to spare, as points fall
unevenly by about the logarithm of their number, and whether all have enough is checked.

Targets: sources in order of code points, null last, weigh ``WEIGHTS`` over and over and share
the sum of all sizes; a target stops at ``EPOCHS`` times its source's size and the excess goes
to the others by weight.

Running sums are taken in two levels, of about the root of the number of rows each, so a source that
holds most rows is spread over many tasks; rows that are equal are counted before they are placed.

Edge cases: a null or blank text has size 0 and is never taken.  Rows that repeat id, text and
source follow each other in the stream.  A null source is a source.  No rows or no words: targets 0.
Columns beyond doc_id, text and source pass through ``mixed`` whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlattice.llm.common import BROADCAST_ROWS, written

#: The weights that sources take in turn, and the most passes over a source.
WEIGHTS = (5, 2, 1)
EPOCHS = 3
BLOCK = 512
#: Sources that one task ranks.
PART = 50_000
#: Points are whole numbers below 2^31; the step is the odd one nearest to the golden ratio's part of it.
UNIT, STEP = 1 << 31, 1_327_217_885
#: Cells of the unit interval by which points find their source.
CELLS = 4096

_WORD = r"[^\x20\x09-\x0D]+"


def order_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, k, row: narrow rows with a number each, written once so that texts are read once."""
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    return written(docs.select("doc_id", "source", size.alias("size"), order_key().alias("k"), F.monotonically_increasing_id().alias("row")), "sized")


def running(rows: DataFrame, order: list[Column], sums: dict[str, str], parts: int) -> DataFrame:
    """rows with place (from 0) and, by name, the sums of columns over the rows before in the order.

    Rows are ranked within ranges of the order, and then the ranges, of which there are ``parts``.
    """
    cut = written(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    whole = cut.groupBy("part").agg(F.count("*").alias("n_place"), *(F.sum(c).alias(f"n_{name}") for name, c in sums.items()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("part", *(F.coalesce(F.sum(f"n_{x}").over(before), F.lit(0)).alias(f"b_{x}") for x in ("place", *sums)))
    inside = Window.partitionBy("part").orderBy(*order)
    out = cut.withColumn("place", (F.row_number().over(inside) - 1).cast("long"))
    for name, c in sums.items():
        out = out.withColumn(name, F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.join(F.broadcast(whole), "part")  # a row a range
    return out.select(*rows.columns, *((F.col(x) + F.col(f"b_{x}")).alias(x) for x in ("place", *sums)))


def targets(rows: DataFrame) -> DataFrame:
    """s, source, source_size, target, goal (target in whole words), need (blocks), before (blocks of the sources before); one row a source."""
    by = written(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    parts = 1 + by.count() // PART
    by = running(by, [F.col("source").asc_nulls_last()], {}, parts).withColumnRenamed("place", "s")
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("s") % len(WEIGHTS) + 1).cast("int")).cast("long")
    by = by.withColumn("w", w).withColumn("cap", EPOCHS * F.col("source_size"))
    by = written(running(by, [F.col("cap") / F.col("w"), F.col("s")], {"capped": "cap", "heard": "w"}, parts).drop("place"), "rising")
    total, weights = by.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    # were all sources before this one capped, the rest would get so much a unit of weight; the true level is the largest
    level = by.agg(F.max((F.lit(total) - F.col("capped")).cast("double") / (F.lit(weights) - F.col("heard")).cast("double"))).first()[0]
    by = by.withColumn("target", F.least(F.col("cap").cast("double"), F.col("w") * F.lit(level or 0.0)))
    by = by.select("s", "source", "source_size", "target", F.round("target").cast("long").alias("goal"), F.ceil(F.round("target") / BLOCK).cast("long").alias("need"))
    return written(running(by, [F.col("s")], {"before": "need"}, parts).drop("place"), "targets")


def placed(rows: DataFrame, by: DataFrame, n_rows: int, n_sources: int) -> DataFrame:
    """Each row with its source's figures and ``start``, its first word's place in the source's stream."""
    buckets = max(1, round(n_rows**0.5))
    by = F.broadcast(by) if n_sources <= BROADCAST_ROWS else by
    d = rows.groupBy("source", "k", "size").agg(F.count("*").alias("c"))
    d = d.join(by, d["source"].eqNullSafe(by["source"])).drop(by["source"])
    d = d.withColumn("bucket", F.floor(F.conv(F.substring("k", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2.0**32)).cast("long"))
    d = written(d.withColumn("words", F.col("c") * F.col("size")), "keys")
    sums = d.groupBy("s", "bucket").agg(F.sum("words").alias("own"))
    upto = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "bucket", F.coalesce(F.sum("own").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("s", "bucket").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("run", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(sums, ["s", "bucket"])
    d = d.select(F.col("source").alias("k_source"), F.col("k").alias("k_k"), "s", "source_size", "target", "goal", "c", (F.col("base") + F.col("run")).alias("start"))
    d = rows.join(d, (rows["k"] == d["k_k"]) & rows["source"].eqNullSafe(d["k_source"]))
    d = written(d.drop("k_k", "k_source"), "placed")
    one = d.where("c = 1").withColumn("j", F.lit(0).cast("long"))
    more = numbered(d.where("c > 1"))
    return one.unionByName(more).withColumn("start", F.col("start") + F.col("j") * F.col("size"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with j, their place (from 0) among those of equal k and source: within the task that gave them ``row``, then over tasks."""
    task = F.shiftright("row", 33).alias("task")
    sums = rows.groupBy("k", "source", task).agg(F.count("*").alias("own"))
    upto = Window.partitionBy("k", "source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("k").alias("s_k"), F.col("source").alias("s_source"), F.col("task").alias("s_task"), F.coalesce(F.sum("own").over(upto), F.lit(0)).alias("base"))
    own = rows.select("*", task)
    own = own.withColumn("r", F.row_number().over(Window.partitionBy("k", "source", "task").orderBy("row")) - 1)
    out = own.join(sums, (own["k"] == sums["s_k"]) & own["source"].eqNullSafe(sums["s_source"]) & (own["task"] == sums["s_task"]))
    return out.select(*rows.columns, (F.col("r") + F.col("base")).alias("j"))


def point(slot: Column) -> Column:
    return (slot % UNIT) * STEP % UNIT


def spare(blocks: int) -> int:
    """Slots that a source's share holds beyond its need."""
    return 8 + 2 * max(blocks, 1).bit_length()


def _edge(blocks: Column, place: Column, extra: int, total: int) -> Column:
    """The point at which a share begins, or ends: the sources' widths before it, of all widths."""
    return F.floor((blocks + place * extra).cast("double") / F.lit(float(total)) * float(UNIT)).cast("long")


def schedule(spark: SparkSession, by: DataFrame) -> DataFrame:
    """slot, s, block: which source's block each slot takes, for exactly the blocks that sources need."""
    blocks, n = by.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count("*")).first()
    extra = spare(blocks)
    while True:
        total = blocks + n * extra
        slots = written(_slots(spark, by, n, extra, total), "slots")
        chunk = F.floor(F.col("slot") / max(1, round(total**0.5))).alias("chunk")
        sums = written(slots.groupBy("s", chunk).agg(F.count("*").alias("own")), "chunks")
        had = sums.groupBy("s").agg(F.sum("own").alias("had"))
        if by.join(had, "s", "left").where(F.coalesce("had", F.lit(0)) < F.col("need")).isEmpty():
            break
        extra *= 2
    upto = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "chunk", F.coalesce(F.sum("own").over(upto), F.lit(0)).alias("base"))
    slots = slots.withColumn("chunk", chunk)
    rank = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1
    out = slots.withColumn("rank", rank).join(sums, ["s", "chunk"]).withColumn("block", F.col("base") + F.col("rank"))
    return out.where("block < need").select("slot", "s", "block")


def _slots(spark: SparkSession, by: DataFrame, n: int, extra: int, total: int) -> DataFrame:
    """slot, s, need: the source that each slot's point falls to."""
    c = F.col
    fits = by.select("s", "need", _edge(c("before"), c("s"), extra, total).alias("lo"), _edge(c("before") + c("need"), c("s") + 1, extra, total).alias("hi"))
    width = UNIT // CELLS
    cells = fits.where("lo < hi").select("s", "need", "lo", "hi", F.explode(F.sequence(F.floor(c("lo") / width), F.floor((c("hi") - 1) / width))).alias("cell"))
    slots = spark.range(total).select(c("id").alias("slot"), point(c("id")).alias("u")).withColumn("cell", F.floor(c("u") / width))
    small = n <= BROADCAST_ROWS  # then cells are at most CELLS + n rows
    return slots.join(F.broadcast(cells) if small else cells, "cell").where("u >= lo and u < hi").select("slot", "s", "need")


def pieces(d: DataFrame) -> DataFrame:
    """Rows cut at passes and blocks: s, row, e (the pass), block, at (first word within the document), n (words)."""
    d = d.where("size > 0 and start < goal").withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))))
    d = d.withColumn("a", F.col("start") + F.col("e") * F.col("source_size")).where("a < goal").withColumn("z", F.least(F.col("a") + F.col("size"), F.col("goal")))
    d = d.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / BLOCK), F.floor((F.col("z") - 1) / BLOCK))))
    first = F.greatest("a", F.col("block") * BLOCK)
    return d.select("s", "source", "row", "doc_id", "e", "block", (first - F.col("a")).alias("at"), (F.least(F.col("z"), (F.col("block") + 1) * BLOCK) - first).alias("n"))


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The placed rows, and the mix: slot, source, block, doc_id, at, n (and s, row, e) for every piece taken; read in order of slot and at."""
    rows = sized(docs)
    by = targets(rows)
    d = placed(rows, by, rows.count(), by.count())
    return d, pieces(d).join(schedule(docs.sparkSession, by), ["s", "block"])


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot (the slot that takes the document first; else null) for every row of ``docs``."""
    d, mix = plan(docs)
    own = mix.groupBy("row").agg(F.sum("n").alias("taken"), F.min("slot").alias("first_slot"))
    out = d.join(own, "row", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix with all their columns, in the schedule's order.

    Each comes as often as its words are taken, to the nearest whole; a copy stands where its pass's first block does.
    """
    d, mix = plan(docs)
    own = mix.groupBy("row", "e").agg(F.sum("n").alias("n"), F.min("slot").alias("slot"))
    own = own.groupBy("row").agg(F.sum("n").alias("taken"), F.array_sort(F.collect_list("slot")).alias("slots"))  # EPOCHS slots at most
    own = d.select("row", "k", "source", "size", "c", "j").join(own, "row").withColumn("copies", F.round(F.col("taken") / F.col("size")).cast("int"))
    own = own.where("copies > 0").select(F.col("k").alias("m_k"), F.col("source").alias("m_source"), "c", F.col("j").alias("m_j"), F.slice("slots", 1, F.col("copies")).alias("slots"))
    own = written(own, "copies")
    keyed = docs.select(F.struct("*").alias("doc"), order_key().alias("k"), "source")
    same = lambda x: (x["k"] == own["m_k"]) & x["source"].eqNullSafe(own["m_source"])
    once = keyed.join(own.where("c = 1"), same(keyed))
    # equal rows are numbered anew, as only then each meets one plan
    twice = own.where("c > 1").select(F.col("m_k").alias("t_k"), F.col("m_source").alias("t_source")).distinct()
    again = keyed.join(twice, (keyed["k"] == twice["t_k"]) & keyed["source"].eqNullSafe(twice["t_source"]), "left_semi")
    again = numbered(written(again.withColumn("row", F.monotonically_increasing_id()), "equal"))
    again = again.join(own.where("c > 1"), same(again) & (again["j"] == own["m_j"]))
    out = once.select("doc", "slots").unionByName(again.select("doc", "slots")).select("doc", F.explode("slots").alias("slot"))
    return out.repartitionByRange("slot").sortWithinPartitions("slot").select("doc.*")


def oracle() -> str:
    """DuckDB SQL for taken() without source: the schedule from the points up, blocks by rank of slot, and each stream's words laid on them."""
    bits = "CASE WHEN t.blocks > 1 THEN (floor(log2(t.blocks)) + 1)::BIGINT ELSE 1 END"
    return f"""
WITH r AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM r GROUP BY source),
b AS (SELECT *, ([{", ".join(map(str, WEIGHTS))}])[s % {len(WEIGHTS)} + 1]::BIGINT AS w, {EPOCHS} * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total FROM a),
c AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(w) OVER (ORDER BY cap / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM b),
g AS (SELECT s, source, source_size, least(cap::DOUBLE, w * max(level) OVER ()) AS target FROM c),
n AS (SELECT *, round(target)::BIGINT AS goal, ceil(round(target) / {BLOCK})::BIGINT AS need FROM g),
t AS (SELECT sum(need)::BIGINT AS blocks, count(*) AS sources FROM n),
x AS (SELECT 8 + 2 * ({bits}) AS extra, blocks + sources * (8 + 2 * ({bits})) AS slots FROM t),
f AS (SELECT s, need, floor((coalesce(sum(need) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s * extra)::DOUBLE / slots::DOUBLE * {UNIT}.0)::BIGINT AS lo,
  floor((sum(need) OVER (ORDER BY s) + (s + 1) * extra)::DOUBLE / slots::DOUBLE * {UNIT}.0)::BIGINT AS hi FROM n, x),
i AS (SELECT i AS slot, (i % {UNIT}) * {STEP} % {UNIT} AS u FROM x, unnest(range(slots)) AS o(i)),
q AS (SELECT slot, s, need, row_number() OVER (PARTITION BY s ORDER BY slot) - 1 AS block FROM i JOIN f ON u >= lo AND u < hi),
p AS (SELECT r.*, n.s, n.source_size, n.target, n.goal, coalesce(sum(size) OVER (PARTITION BY n.s ORDER BY k, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r JOIN n ON r.source IS NOT DISTINCT FROM n.source),
e AS (SELECT row, s, start + e * source_size AS a, least(start + e * source_size + size, goal) AS z FROM p, unnest(range({EPOCHS})) AS o(e) WHERE size > 0 AND start + e * source_size < goal),
l AS (SELECT row, s, a, z, unnest(range(a // {BLOCK}, (z - 1) // {BLOCK} + 1)) AS block FROM e),
m AS (SELECT row, sum(least(z, (l.block + 1) * {BLOCK}) - greatest(a, l.block * {BLOCK}))::BIGINT AS taken, min(slot) AS first_slot FROM l JOIN q ON q.s = l.s AND q.block = l.block AND q.block < q.need GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot::BIGINT AS first_slot FROM p LEFT JOIN m USING (row)"""
