"""Sharding: a uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt to source partitions by a hash. How many rows each partition sends to each shard is drawn exactly: row
by row of the matrix from the multivariate hypergeometric law over the shards' remaining room, so that the row and
column sums are exact (shard sizes differ by one at most, law `rows`). Each partition permutes its rows and sends its
k-th rows by the drawn counts; each shard permutes what it got. Both permutations are keyed by seeded hashes of the
rows, so a recomputed partition comes out the same, and reruns agree. A shard is permuted in many buckets of its key
space: no task holds a shard.

Null texts have size 16 and the checksum of no bytes. Repeated rows are dealt one by one; equal rows are exchangeable.
Rows tie only where they are equal in all columns that are dealt. An empty table gives an empty result. Only counts
per partition and the matrix (partitions x shards, at most a million rows a partition) are on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import buckets, fresh, running_sum, table, written

SHARDS, SEED = 40, 20240607
PARTITION_ROWS, LEAST_PARTITIONS = 1_000_000, 256


def matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each partition sends to each shard; shard sizes differ by one at most."""
    n = sum(rows)
    rng = np.random.Generator(np.random.PCG64(seed))
    room = np.full(shards, n // shards, np.int64)
    room[rng.permutation(shards)[: n % shards]] += 1
    out = np.zeros((len(rows), shards), np.int64)
    for i, k in enumerate(rows):
        out[i] = rng.multivariate_hypergeometric(room, k, method="marginals") if room.sum() < 10**9 else _by_places(rng, room, k)
        room -= out[i]
    return out


def _by_places(rng: np.random.Generator, room: np.ndarray, k: int) -> np.ndarray:
    """The same law for rooms beyond the generator's limit: k places of all, each counted for the shard it lies in."""
    picks = np.sort(rng.choice(int(room.sum()), size=k, replace=False, shuffle=False))
    return np.diff(np.searchsorted(picks, np.concatenate([[0], np.cumsum(room)])))


def shuffle(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rows with `shard` and `slot` (gapless from 0 in each shard); names get underscores where taken."""
    part, rank, key = fresh(rows, "_part"), fresh(rows, "_rank"), fresh(rows, "_key")
    shard, slot, ends_ = fresh(rows, "shard"), fresh(rows, "slot"), fresh(rows, "_ends")
    spark, cols = rows.sparkSession, [F.col(f"`{c}`") for c in rows.columns]
    n = rows.count()
    parts = buckets(n, PARTITION_ROWS, LEAST_PARTITIONS)
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(parts)).cast("int"))
    counts = {r[0]: r[1] for r in dealt.groupBy(part).count().collect()}
    drawn = matrix([counts.get(p, 0) for p in range(parts)], shards, seed)
    ends = spark.createDataFrame([(p, c.tolist()) for p, c in enumerate(np.cumsum(drawn, axis=1))], f"{part} int, {ends_} array<long>")
    local = Window.partitionBy(part).orderBy(F.xxhash64(F.lit(seed + 1), *cols), *cols)
    sent = (
        dealt.withColumn(rank, F.row_number().over(local).cast("long") - 1)
        .join(ends, part)
        .withColumn(shard, F.size(F.filter(ends_, lambda e: e <= F.col(rank))))
        .withColumn(key, F.xxhash64(F.lit(seed + 2), part, rank))
        .drop(ends_)
    )
    per_shard = buckets(n // shards, 50_000, 8)
    out = running_sum(sent, shard, [key, part, rank], F.pmod(F.shiftrightunsigned(key, 33), F.lit(per_shard)), F.lit(1), slot)
    return out.select(*cols, shard, slot)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    thin = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    return shuffle(written(thin, "thin")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
