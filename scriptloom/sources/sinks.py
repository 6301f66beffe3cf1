"""Sinks. Tables go through Spark's commit protocol; a single document file is written whole or not at all."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..shipping import ship
from .publish import published


def staged(df: DataFrame) -> DataFrame:
    """df written once, in the folder that spark.checkpoint.dir names, and opened again: it cuts the lineage, survives
    lost executors, and costly steps before it run once. In local mode a temporary folder will do."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ConfigurationError("on a cluster spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="scriptloom-")
        atexit.register(shutil.rmtree, folder, True)
        folder = f"file://{folder}"
    path = f"{folder.rstrip('/')}/scriptloom-staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def check_shared(spark: SparkSession, folder: str | Path) -> None:
    """Raises unless every executor that can be reached sees what the driver writes into a folder. Local mode shares all."""
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return
    ship(spark)
    mark = Path(folder, f".seen-{uuid.uuid4().hex}").absolute()
    write_text(mark, "")

    def sees(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([mark.exists()] * len(b))], names=["seen"])

    n = 4 * spark.sparkContext.defaultParallelism
    try:
        if not spark.range(0, n, 1, n).mapInArrow(sees, "seen boolean").agg(F.min("seen")).first()[0]:
            raise ConfigurationError(f"{folder} isn't a folder that driver and executors share")
    finally:
        mark.unlink(missing_ok=True)


def write_text(path: str | Path, text: str) -> None:
    published(Path(path), lambda part: part.write_text(text, encoding="utf-8"))


def write_json(path: str | Path, value: object) -> None:
    write_text(path, json.dumps(value, indent=2, ensure_ascii=False))


def write_reports(reports: DataFrame, folder: str) -> None:
    """A file of each kind per source, named after it: reports has source, markdown and json. Sources of one stem get a piece
    of their path's digest as well, so that none replaces another's. folder is shared by all executors."""
    stem = F.regexp_replace(F.element_at(F.split("source", "/"), -1), r"(?<=.)\.[^.]*$", "")
    named = reports.select("source", "markdown", "json", stem.alias("stem"))
    many = F.count("*").over(Window.partitionBy("stem")) > 1
    named = named.withColumn("name", F.when(many, F.concat("stem", F.lit("-"), F.substring(F.sha2("source", 256), 1, 8))).otherwise(F.col("stem")))

    def each(rows) -> None:
        for r in rows:
            write_text(Path(folder, f"{r['name']}.analysis.md"), r["markdown"])
            write_json(Path(folder, f"{r['name']}.analysis.json"), json.loads(r["json"]))

    ship(reports.sparkSession)
    named.select("name", "markdown", "json").foreachPartition(each)


def read_json(path: str | Path) -> object:
    return json.loads(Path(path).read_text(encoding="utf-8"))
