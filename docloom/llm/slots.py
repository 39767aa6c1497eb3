"""Gapless numbering of rows within groups, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K

BUCKETS = 256


def numbered(
    df: DataFrame, group: list[str], order: list[str], name: str, *, buckets: int = BUCKETS, bucket: Column | None = None
) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 … within each ``group``.

    Rows of a group are dealt to ``buckets`` by the hash of ``order``, or to the number
    ``bucket``, and numbered there; a bucket starts where the rows before it end.  Only (group, bucket) counts
    meet in one place.  ``order`` must tell apart all rows that differ in other
    columns that matter; equal rows take any order.  A group of equal rows stays in one
    bucket, which is sorted with spilling and never held.
    """
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets)) if bucket is None else bucket
    dealt = df.withColumn(K.unused(df.columns, "_bucket"), bucket.cast("int")).toDF(*names.values(), "_bucket")
    group, order = [names[c] for c in group], [names[c] for c in order]
    counts = dealt.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    inner = Window.partitionBy(*group, "_bucket").orderBy(*order)
    placed = dealt.withColumn("_place", F.row_number().over(inner) - 1)
    on = [placed["_bucket"] == starts["_b"]] + [placed[c].eqNullSafe(starts[f"_g{i}"]) for i, c in enumerate(group)]
    own = [F.col(n).alias(c) for c, n in names.items() if c != name]
    return placed.join(starts, on).select(*own, (F.col("_start") + F.col("_place")).alias(name))
