"""Joins that keep working when one key holds a large part of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

#: A key is hot when it holds more than this part of the left rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.002


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of the rows with a non-null key: at most ``1 / share`` of them.

    Rows are counted by key with map-side aggregation, so a hot key costs one row per input partition.
    """
    counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    return counts.join(F.broadcast(total), F.col("_n") > F.col("_total") * share).select(*keys)


def skew_safe_left_join(left: DataFrame, right: DataFrame, keys: list[str], share: float = HOT_SHARE, hot: DataFrame | None = None) -> DataFrame:
    """``left LEFT JOIN right USING (keys)`` for a ``right`` that is unique by ``keys``.

    Left rows with a hot key stay where they are: the right rows of hot keys, at most ``1 / share`` of them because
    right is unique, are broadcast. All other rows take the ordinary shuffled join. Null keys match nothing and are
    not shuffled either. ``hot`` gives the hot keys where they are known already. An empty side, repeated left rows and ties need nothing special: every left row comes out
    once.
    """
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    hot = hot_keys(left, keys, share) if hot is None else hot
    hot_right = right.join(F.broadcast(hot), keys, "left_semi")
    flagged = left.join(F.broadcast(hot.withColumn("__skew_hot", F.lit(True))), keys, "left")
    stay = flagged.filter(any_null | F.col("__skew_hot")).drop("__skew_hot")
    move = flagged.filter(~any_null & F.col("__skew_hot").isNull()).drop("__skew_hot")
    return stay.join(F.broadcast(hot_right), keys, "left").unionByName(move.join(right, keys, "left"))


def sums_before(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one in ``order``, which is unique.

    Rows are put in ranges of ``order`` and written; a window sums up within a range, and only the sum of each range,
    as many as there are partitions, goes to the driver. No task holds all rows.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = {r[0]: r[1] or 0 for r in ranged.groupBy("__range").agg(F.sum(value)).collect()}
    offsets, total = [], 0
    for k in sorted(totals):
        offsets += [F.lit(k), F.lit(total)]
        total += totals[k]
    within = F.sum(value).over(W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    start = F.element_at(F.create_map(*offsets), F.col("__range")) if offsets else F.lit(0)
    return ranged.withColumn(out, (F.coalesce(within, F.lit(0)) + start).cast("bigint")).drop("__range")
