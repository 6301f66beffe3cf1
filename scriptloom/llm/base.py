"""What the operators of this folder share: shared-storage tables, Arrow batches, prefix sums."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: Words between ASCII white space; other Unicode spaces belong to words.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in one Arrow batch: bounds a Python worker's memory when texts are long.
ARROW_ROWS = 250
ARROW_BYTES = 4 << 20

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or with underscores added until no column of df has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Prepares for Python workers: sends them the package, and bounds the Arrow batches by rows and bytes."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def together(batches, size: int):
    """Batches joined, up to `size` bytes or one batch."""
    held, n = [], 0
    for b in batches:
        if held and n + b.nbytes > size:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([x.column(i) for x in held]) for i in range(len(held[0].columns))], schema=held[0].schema)
            held, n = [], 0
        if len(b):
            held.append(b)
            n += b.nbytes
    if held:
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([x.column(i) for x in held]) for i in range(len(held[0].columns))], schema=held[0].schema)


def walked(pool: np.ndarray, size: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The runs of pool that the numbers `kind` name, one after the other; size: of each run, which stand in order."""
    kind = kind[size[kind] > 0]
    # a step of 1 inside a run, a jump to the next one's first
    many, begin = size[kind], (np.cumsum(size) - size).astype(np.int32)[kind]
    step = np.ones(int(many.sum()), np.int32)
    step[(np.cumsum(many) - many)[1:]] = begin[1:] - begin[:-1] - many[:-1] + 1
    step[:1] = begin[:1]
    return pool.take(np.cumsum(step, dtype=np.int64), mode="clip") if len(step) else pool[:0]


def hand_back() -> None:
    """Hands freed memory back to the system: idle workers would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def released(run):
    """A worker's function over batches that hands freed memory back when it ends."""

    def go(batches):
        yield from run(batches)
        hand_back()

    return go


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one in local mode if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("on a cluster spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="scriptloom-"))
    return "file://" + _own_dir[0]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended already
        pass


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    The files go when the driver's process ends. codec: of the files, if not Spark's own choice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scriptloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def buckets(n_rows: int, rows: int = 50_000, least: int = 64) -> int:
    """How many buckets hold about `rows` rows each."""
    return max(least, -(-n_rows // rows))


def running_sum(df: DataFrame, group: str, order: list, bucket, value, out: str, total: str | None = None) -> DataFrame:
    """Adds `out`: the sum of `value` over the earlier rows of the same `group`, in the order (bucket, *order).

    No task holds a whole group: each (group, bucket) is summed on its own, the sums before each bucket come from
    the small table of bucket sums. `total`, if named, gets the whole group's sum. group must not be null.
    """
    b, v, before = fresh(df, f"{out}_bucket"), fresh(df, f"{out}_value"), fresh(df, f"{out}_so_far")
    df = df.withColumn(b, bucket).withColumn(v, value.cast("long"))
    sums = df.groupBy(group, b).agg(F.sum(v).alias(v))
    w = Window.partitionBy(group).orderBy(b)
    sums = sums.select(group, b, (F.sum(v).over(w) - F.col(v)).alias(before), *([F.sum(v).over(Window.partitionBy(group)).alias(total)] if total else []))
    inner = Window.partitionBy(group, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(sums, [group, b])
        .withColumn(out, F.col(before) + F.coalesce(F.sum(v).over(inner), F.lit(0)))
        .drop(b, v, before)
    )


#: hub_join broadcasts the values that more than one of HUBS rows has; fewer than HUBS values can.
HUBS = 1000


def hub_join(rows: DataFrame, table: DataFrame, on: str, count: str, spread, how: str = "inner", total: int | None = None, small: bool = False) -> DataFrame:
    """rows joined (inner or left) with table, which has a row per value of the column `on`.

    `count`, a column of table that the result lacks, says how many of rows (all of them: `total`) have the value. The
    most frequent values come by a broadcast of fewer than HUBS rows; the rest, and rows whose value is null, are dealt
    by value or by the hash `spread`, so no task gets the rows of a hub. Values that table lacks must not be hubs, unless
    they are null. small: table's size is known to be bounded, and all of it is broadcast.
    """
    value, hot, key, salt = (fresh(rows, x) for x in ("_of_table", "_hot", "_cold", "_salt"))
    more = [c for c in table.columns if c not in (on, count)]
    if small:
        bounded = table.select(F.col(on).alias(key), F.struct(*more).alias(value))
        return rows.join(F.broadcast(bounded), F.col(on) == F.col(key), how).select(*rows.columns, *(F.col(f"{value}.{c}").alias(c) for c in more))
    total = table.agg(F.sum(count)).first()[0] or 0 if total is None else total
    packed = table.select(F.col(on).alias(key), F.struct(*more).alias(value), (F.col(count) * HUBS > total).alias(hot))
    hubs = packed.where(hot).drop(hot)
    # one structure as key: a null value in it is hashed with the salt beside it
    dealt = lambda v, n: F.struct(v.alias("v"), n.cast("long").alias("n"))
    rest = packed.where(~F.col(hot)).select(dealt(F.col(key), F.lit(0)).alias(f"{key}_"), F.col(value).alias(f"{value}_"))
    at = rows.join(F.broadcast(hubs), F.col(on) == F.col(key), "left")  # fewer than HUBS rows
    passed = F.col(value).isNotNull() | F.col(on).isNull()
    at = at.withColumn(salt, dealt(F.when(~passed, F.col(on)), F.when(passed, spread.bitwiseOR(F.lit(1))).otherwise(F.lit(0))))
    at = at.join(rest, F.col(salt) == F.col(f"{key}_"), "left")
    whole = F.coalesce(value, f"{value}_")
    at = at.where(whole.isNotNull()) if how == "inner" else at
    return at.select(*rows.columns, whole.alias(value)).select(*rows.columns, *(F.col(f"{value}.{c}").alias(c) for c in more))
