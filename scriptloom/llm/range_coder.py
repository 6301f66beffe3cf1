"""Adaptive context-mixing range coder for token ids, in independently reset and checksummed blocks.

The coder runs in Spark's JVM (jvm/RangeCoder.java, compiled at run time by the compiler that Spark brings along and sent
to the executors as a jar): an adaptive coder goes id by id, which numpy can't do fast, and a block costs no lanes there.

A block's model starts from a fixed state and follows the ids. Order 1 and order 2 keep, for the last id and for the
last two, a short list of ids that followed with their counts; order 0 keeps a count of every id, low ids starting
higher. For each id the lists' distributions are mixed: the weights of order 2, order 1 and order 0 are looked up by how
much each list has seen, and move towards the orders that gave the id its probability (gradient of the log
probability). An id in a list is coded with the sum of its masses; another is an escape, coded by order 0's counts. All
arithmetic is in integers.

Chunk: magic (8 bytes), number of ids (8), number of blocks (4); then per block its number of ids, of bytes, and the
CRC-32 of its ids as little-endian 32-bit integers (4 each); then the blocks. Ids lie in 0..65535; others are an error,
as is a chunk that doesn't decode to its checksums. No ids give a chunk without blocks; null gives null.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Ids of a block: what a damaged byte costs, and what an order has to learn from.
BLOCK = 1 << 18
_source = Path(__file__).parent / "jvm" / "RangeCoder.java"
_classes: dict[str, object] = {}


def _loaded(spark: SparkSession):
    """The coder's class in Spark's JVM; its functions are registered in the session."""
    app = spark.sparkContext.applicationId
    session, jvm = spark._jsparkSession, spark.sparkContext._jvm
    if app not in _classes:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(_source.read_text())
        handle, name = tempfile.mkstemp(prefix="scriptloom-", suffix=".jar")
        os.close(handle)
        code = compiler.getBytecodes()
        with zipfile.ZipFile(name, "w") as z:
            for k in code:
                z.writestr(k.replace(".", "/") + ".class", bytes(code[k]))
        _classes[app] = name
    if not spark.catalog.functionExists("loom_encode"):
        spark.sql(f"ADD JAR '{Path(_classes[app]).as_uri()}'")
        load = session.artifactManager().classloader().loadClass
        none = spark.sparkContext._gateway.new_array
        for name in ("Encode", "Decode"):
            f = load(f"scriptloom.RangeCoder${name}").getDeclaredConstructor(none(jvm.java.lang.Class, 0)).newInstance(none(jvm.java.lang.Object, 0))
            session.udf().register(f"loom_{name.lower()}", f, jvm.org.apache.spark.sql.types.DataType.fromDDL("binary"))


def encoded(spark: SparkSession, ids: Column | str, block: int = BLOCK) -> Column:
    """The chunk of binary `ids` (little-endian 32-bit integers)."""
    _loaded(spark)
    return F.call_function("loom_encode", ids, F.lit(block).cast("int"))


def decoded(spark: SparkSession, chunk: Column | str) -> Column:
    """The ids of a chunk, as binary."""
    _loaded(spark)
    return F.call_function("loom_decode", chunk)


def encode(spark: SparkSession, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One chunk, for tests and tools."""
    df = spark.createDataFrame([(bytearray(np.asarray(ids, "<u4").tobytes()),)], "x binary")
    return bytes(df.select(encoded(spark, "x", block)).first()[0])


def decode(spark: SparkSession, chunk: bytes) -> np.ndarray:
    df = spark.createDataFrame([(bytearray(chunk),)], "x binary")
    return np.frombuffer(bytes(df.select(decoded(spark, "x")).first()[0]), "<u4")
