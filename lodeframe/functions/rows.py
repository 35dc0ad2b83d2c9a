"""Row-set operators: which duplicate wins, first groups, replacement by path."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError


def _one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows are dealt by their key before they are ranked: a rank limit before the shuffle would sort all that a task reads, in memory and on disk, where most keys stand once."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.repartition(*keys).withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def last_wins(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """One row per key, the last in the order."""
    return _one(df, keys, [F.desc(c) for c in order])


def first_wins(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    return _one(df, keys, [F.asc(c) for c in order])


def first_groups(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """Rows of the first n groups by their first appearance; a top-n of groups, then a join."""
    chosen = df.groupBy(group).agg(F.min(order).alias("_seen")).orderBy("_seen", group).limit(n)
    return df.join(F.broadcast(chosen.select(group)), group, "left_semi")


def replace_by_path(old: DataFrame, new: DataFrame, path: str = "path") -> DataFrame:
    """Old rows of paths that the new rows don't touch, and the new rows."""
    return old.join(new.select(path).distinct(), path, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Update all, insert all."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def diff(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, status in unchanged, changed, new, stale, from (path, fingerprint) on both sides."""
    a, b = current.select("path", F.col("fingerprint").alias("now")), manifest.select("path", F.col("fingerprint").alias("was"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "stale").when(F.col("now") == F.col("was"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full").select("path", status.alias("status"))


def cut(df: DataFrame) -> DataFrame:
    """The rows, kept in the shared checkpoint folder, without the plan that made them."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise EngineError("INVALID_CONFIG", "spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or f"{tempfile.gettempdir()}/checkpoints/lodeframe")
    return df.checkpoint()


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """df with batch: the number of the group of ``size`` rows in the order. Rows are counted within range partitions first, so no task sees them all."""
    sorted_ = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    placed = cut(sorted_.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(order))))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row for each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn("batch", F.floor((F.col("_before") + F.col("_i") - 1) / size)).drop("_p", "_i", "_before")
