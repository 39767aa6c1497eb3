"""Rendezvous hashing over weighted shards.

Every (key, shard) pair has a score ``-ln(u) / weight`` with u uniform in (0, 1) from
a hash of both; a key goes to the shard with the least score.  Scores of other shards
do not change when one is added, so a row moves only into the new shard, and the
expected number of movers is the new shard's share of the weight.  Native functions
only, no shuffle for the shard itself.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slots import numbered
from .storage import read

SHARDS = 16
#: Hexadecimal digits of the hash that make u: 52 bits, exact in a double
_DIGITS = 13


def score(key: Column, shard: int, weight: float) -> Column:
    digest = F.md5(F.concat_ws("/", key, F.lit(str(shard))).cast("binary"))
    whole = F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double")
    return -F.log((whole + 0.5) / F.lit(float(1 << 4 * _DIGITS))) / F.lit(float(weight))


def assign(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of ``key``; equal scores go to the smaller number.  A null key counts as ``null``."""
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("shards need positive weights")
    text = F.coalesce(key.cast("string"), F.lit("null"))
    best = [F.struct(score(text, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in sorted(weights.items())]
    return (best[0] if len(best) == 1 else F.least(*best))["shard"]


def shard(
    docs: DataFrame, weights: Mapping[int, float], *, key: str = "doc_id", name: str = "shard"
) -> DataFrame:
    """``docs`` with the column ``name``; an existing one of that name is replaced.

    Rows with equal keys share a shard, null keys too.  Text and other columns play
    no part, so null, empty and very long texts are rows like any other.
    """
    return docs.withColumn(name, assign(F.col(key), weights))


def op5(spark, sf_dir: str) -> DataFrame:
    """Digest of the contract: law ``key``, 16 equal shards, 17 when grown."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    rows = rows.withColumn("law", F.lit("key"))
    placed = shard(rows, {s: 1.0 for s in range(SHARDS)})
    placed = shard(placed, {s: 1.0 for s in range(SHARDS + 1)}, name="grown_shard")
    # dealt by digits that any engine computes alike, so that the slots can be checked elsewhere
    digits = F.substring(F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32").cast("binary")), 1, 2)
    slots = numbered(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot", bucket=F.conv(digits, 16, 10))
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
