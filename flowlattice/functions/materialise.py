"""Tables between steps: written to the folder that the cluster shares, and read again."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh path in this application's part of spark.checkpoint.dir.

    Where that is unset, a session on one machine (tests) takes a temporary folder; on a cluster, executors
    would each write to a disk of their own, so it is an error.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(spark, "_flowlattice_tables", None)
        if base is None:
            base = spark._flowlattice_tables = tempfile.mkdtemp(prefix="flowlattice-")
    return f"{base.rstrip('/')}/flowlattice-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Cuts a plan that has grown long; what is written outlives executors.  by: a column whose values get a folder each."""
    path = shared_dir(df.sparkSession, tag)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame | None, shuffles: bool = False) -> None:
    """Deletes written tables that nothing reads any more (what ``written`` returned; None is passed over).

    With ``shuffles``, files of the finished steps' shuffles go too: Spark's cleaner deletes them as soon as it learns from
    the collectors that nobody holds them.
    """
    there = [t for t in tables if t is not None]
    for t in there:
        _delete(t.sparkSession, t._written_at)
    if there and shuffles:
        gc.collect()
        there[0].sparkSession.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Deletes this application's written tables; results that still read them can't be used afterwards."""
    _delete(spark, shared_dir(spark, "x").rpartition("/")[0])
