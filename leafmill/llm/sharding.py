"""Reproducible shuffle and sharding by a Feistel permutation with cycle walking.

Rows are numbered globally in order of id, size and checksum. A balanced Feistel network permutes
0 .. 4**w - 1, the least such domain of at least n; positions outside 0 .. n - 1 are walked on until
they fall inside. Position p is slot p // shards of shard p % shards, so shards differ by one row
at most, and both directions (``permute``, ``restore``) are computable without the data.

Defined cases: a null text is empty; null ids are numbered last; rows alike in id, size and
checksum take their numbers in any order among themselves; an empty table gives no rows; extra
columns stay, but for those named row_number, shard and slot, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Scratch, free_names, global_row_number

ROUNDS = 6
SEED = 20240229
SHARDS = 8


def _keys(seed: int) -> list[int]:
    x, out = seed & (2**64 - 1), []
    for _ in range(ROUNDS):  # splitmix64
        x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
        z = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & (2**64 - 1)
        out.append(z ^ z >> 31)
    return out


def _round(half: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    z = (half ^ np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(32))) & mask


def _width(n: int) -> int:
    w = 1
    while 4**w < n:
        w += 1
    return w


def _feistel(x: np.ndarray, w: int, seed: int, back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << w) - 1), np.uint64(w)
    left, right = x >> shift, x & mask
    if back:
        for key in reversed(_keys(seed)):
            left, right = right ^ _round(left, key, mask), left
    else:
        for key in _keys(seed):
            left, right = right, left ^ _round(right, key, mask)
    return left << shift | right


def permute(x: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """The position of each row number below n; with ``back``, the row number of each position."""
    out = np.asarray(x).astype(np.uint64)
    w, todo = _width(n), np.ones(len(out), bool)
    with np.errstate(over="ignore"):
        while todo.any():  # the domain is less than 4 n, so a quarter at least falls inside each time
            out[todo] = _feistel(out[todo], w, seed, back)
            todo = out >= np.uint64(n)
    return out.astype(np.int64)


def locate(row: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def shard(df: DataFrame, order: list, scratch: Scratch, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add row_number, shard and slot to the rows of ``df``, numbered in ``order``; columns of these names are replaced."""
    numbered = scratch.save(global_row_number(df.drop("shard", "slot"), order, scratch), "numbered")
    n = numbered.count()

    @F.pandas_udf("bigint")
    def position(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    place = free_names([*numbered.columns, "shard", "slot"], "_position")[0]
    placed = numbered.withColumn(place, position("row_number"))
    placed = placed.withColumn("shard", (F.col(place) % shards).cast("int")).withColumn("slot", F.floor(F.col(place) / shards).cast("bigint"))
    return placed.drop(place)


def write_shards(sharded: DataFrame, path: str, shards: int = SHARDS, parts: int = 1) -> None:
    """Write one folder per shard, its rows in slot order; ``parts`` files a shard, each a range of slots."""
    sharded.repartitionByRange(shards * parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard(docs, [F.col("doc_id").asc_nulls_last(), F.col("size").asc(), F.col("text_crc32").asc()], Scratch(spark))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_sharding": op5_sharding}
ORACLES = {}
