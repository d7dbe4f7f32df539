"""Shared-folder helpers: where intermediate tables are written so that they survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach; on a cluster it is the one in ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, one machine) a temporary folder is chosen and
    recorded in the session, so that ``checkpoint()`` and written tables agree on it.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other call uses."""
    return f"{shared_root(spark)}/chronoloom/{name}-{uuid.uuid4().hex}"


#: The tables written inside each ``scratch`` block that is open.
_scratch: list[list[str]] = []


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back with the same schema.

    This cuts the lineage: a lost executor costs no recomputation, and later joins see a
    plain scan whose size is known. The table goes at the end of the innermost ``scratch`` block, or
    with ``keep`` at the end of the one around that; outside of any it stays.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if len(_scratch) > keep:
        _scratch[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that are written inside the block, at its end.

    What leaves the block must read no other table than those written with ``keep``.
    """
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield
    finally:
        _scratch.pop()
        for path in paths:
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


#: Rows of an Arrow batch where whole texts travel: a batch is held on both sides of the pipe.
ARROW_ROWS = 1000


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs run inside the block."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


#: Tables whose counted rows take up to this are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, bytes_per_row: int) -> DataFrame:
    """``df`` with a broadcast hint if its rows, which are counted here, fit the bound."""
    return F.broadcast(df) if df.count() * bytes_per_row <= BROADCAST_BYTES else df


def broadcast_if_light(df: DataFrame, size: Column) -> DataFrame:
    """As ``broadcast_if_small``, by the sum of ``size``, the bytes of a row."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``n``: the number of rows before it in the given order, from 0.

    Rows are dealt into ranges of the order and numbered there; only the ranges' sizes meet in one
    task. Rows that are equal in the order are numbered in any way.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id())
    dealt = written(dealt, "numbered")
    part = F.shiftright("n", 33)
    sizes = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = sizes.select("part", F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each partition
    return dealt.join(F.broadcast(before), part == F.col("part")).withColumn("n", F.col("before") + F.col("n").bitwiseAND((1 << 33) - 1)).drop("part", "before")


def running_total(df: DataFrame, keys: list[str], order: str, value: str, name: str, group: int = 1024) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same keys that are lower in ``order``.

    ``order`` has different whole numbers from 0 for each key. ``group`` neighbouring numbers are
    summed first, so that no task sees all rows of a key.
    """
    cell = F.expr(f"`{order}` div {group}")
    rows = df.withColumn("__cell", cell)
    cells = rows.groupBy(*keys, "__cell").agg(F.sum(value).alias("__sum"))
    earlier = W.partitionBy(*keys).orderBy("__cell") if keys else W.orderBy("__cell")
    cells = cells.select(*keys, "__cell", F.coalesce(F.sum("__sum").over(earlier.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = W.partitionBy(*keys, "__cell").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(cells, [*keys, "__cell"]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__cell", "__before", "__inside")
