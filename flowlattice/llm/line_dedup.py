"""Line dedup over overlapping windows of three consecutive lines.

Lines are parted by line feeds and compared as they are.  Every three consecutive lines of
which one at least is not blank are a window.  Of the places of equal windows in all documents
the first (smallest doc_id, then smallest line number) stays; at every other place the three
lines are covered.  Covered lines, however many windows cover them, are removed.

Windows are compared by 128 bits of hash.  The windows that occur again are written before
they are joined back, so that a very common one can be dealt to many tasks.

Edge cases: a null text stays null with 0 lines; a text of fewer than three lines has no window
and stays.  Null ids come first; of equal ids, the text of the smaller hash.  Rows that repeat id
and text are one document and are treated alike.  A text whose lines all go becomes empty.  Other
columns pass through untouched, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlattice.llm.common import written

WINDOW = 3


def text_number(text: Column) -> Column:
    """60 bits of a text's hash."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_number(F.col("text")).alias("tk"), F.split("text", "\n", -1).alias("lines"))


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, tk (the text's hash), pos, h1, h2: one row a window."""
    n = F.size("lines") - (WINDOW - 1)
    rows = _keyed(docs).where(F.size("lines") >= WINDOW)
    own = F.arrays_zip(*(F.slice("lines", i + 1, n).alias(f"l{i}") for i in range(WINDOW)))
    rows = rows.select("doc_id", "tk", F.posexplode(own).alias("pos", "w"))
    lines = [F.col(f"w.l{i}") for i in range(WINDOW)]
    rows = rows.where(F.length(F.trim(F.concat(*lines))) > 0)
    return rows.select("doc_id", "tk", F.col("pos").cast("long").alias("pos"), F.xxhash64(*lines).alias("h1"), F.xxhash64(F.lit(1), *lines).alias("h2"))


def repeated(rows: DataFrame) -> DataFrame:
    """h1, h2 and the first place of every window that occurs more than once."""
    first = F.min(F.struct("doc_id", "tk", "pos")).alias("f")
    return rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), first).where("n > 1").select("h1", "h2", F.col("f.doc_id").alias("f_doc"), F.col("f.tk").alias("f_tk"), F.col("f.pos").alias("f_pos"))


def covered(docs: DataFrame) -> DataFrame:
    """doc_id, tk, gone: the numbers of the lines to remove."""
    rows = windows(docs)
    again = written(repeated(rows), "windows")
    later = rows.join(again, ["h1", "h2"]).where(~(F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("tk") == F.col("f_tk")) & (F.col("pos") == F.col("f_pos"))))
    spots = F.array_distinct(F.flatten(F.transform(F.collect_set("pos"), lambda p: F.sequence(p, p + (WINDOW - 1)))))
    return later.groupBy("doc_id", "tk").agg(spots.alias("gone"))


def dedup(docs: DataFrame, counts: bool = True) -> DataFrame:
    """``docs`` with text cut; with ``counts``, then n_lines and n_removed in place of columns of these names."""
    gone = covered(docs.select("doc_id", "text")).select(F.col("doc_id").alias("g_doc"), F.col("tk").alias("g_tk"), "gone")
    names = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    # a caller's columns stay inside one, so that none clashes with these
    rest = F.struct(*(F.col(c) for c in names if c != "text")) if len(names) > 1 else F.struct(F.lit(0).alias("none"))
    d = docs.select(rest.alias("rest"), F.col("doc_id").alias("id"), text_number(F.col("text")).alias("tk"), F.split("text", "\n", -1).alias("lines"))
    d = d.join(gone, d["id"].eqNullSafe(gone["g_doc"]) & (d["tk"] == gone["g_tk"]), "left")
    n = F.coalesce(F.size("lines"), F.lit(0)).cast("long")
    n = F.when(F.col("lines").isNull(), 0).otherwise(n).cast("long")
    left = F.array_except(F.sequence(F.lit(0).cast("long"), n - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull() | F.col("lines").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i.cast("int"))), "\n"))
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    d = d.select("rest", text.alias("text"), n.alias("n_lines"), removed.alias("n_removed"))
    return d.select(*(F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in names), *(["n_lines", "n_removed"] if counts else []))


def oracle() -> str:
    """DuckDB SQL for doc_id, n_lines, n_removed, text."""
    return """
WITH d AS (SELECT doc_id, text, ('0x' || substr(md5(text), 1, 15))::BIGINT AS tk, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT row_number() OVER () AS r, * FROM (SELECT DISTINCT doc_id, tk, ls FROM d)),
l AS (SELECT r, doc_id, tk, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM u),
w AS (SELECT r, doc_id, tk, i, x AS a, lead(x) OVER o AS b, lead(x, 2) OVER o AS c FROM l WINDOW o AS (PARTITION BY r ORDER BY i)),
n AS (SELECT r, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id NULLS FIRST, tk, i) AS k FROM w WHERE b IS NOT NULL AND c IS NOT NULL AND trim(a || b || c, ' ') <> ''),
g AS (SELECT DISTINCT r, i + unnest([0, 1, 2]) AS i FROM n WHERE k > 1),
t AS (SELECT l.r, coalesce(string_agg(l.x, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text, count(g.i) AS n_removed FROM l LEFT JOIN g USING (r, i) GROUP BY l.r)
SELECT d.doc_id, coalesce(len(d.ls), 0)::BIGINT AS n_lines, coalesce(t.n_removed, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NOT NULL THEN t.text END AS text
FROM d LEFT JOIN u ON d.doc_id IS NOT DISTINCT FROM u.doc_id AND d.tk = u.tk LEFT JOIN t ON t.r = u.r"""
