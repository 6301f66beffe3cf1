"""The corpus pipeline: quality rules, n-gram Jaccard join, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of documents. Null and empty texts go at the first stage, which also settles empty inputs: an empty table
passes through all stages. Repeated rows are copies for the second stage. Extra columns of docs stay with their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm import base, decontaminate, jaccard_join, mixing, quality_rules, token_files

POLICY = "full-1"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the policy rejects go."""
    led, names = quality_rules.ledger(docs)
    return led.where(quality_rules.kept(POLICY, names["failed_rules"])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each class of linked texts stays."""
    return jaccard_join.one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: contaminated documents go."""
    out, names = decontaminate.decontaminate(docs, base.table(spark, sf_dir, "benchmark"))
    return out.where(~F.col(names["contaminated"])).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the mix's rows, a document for each whole pass and each range of words taken beyond."""
    return mixing.mixed_rows(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token files, written and read back. Executors still hold what earlier stages left: less is kept here."""
    return token_files.read(token_files.write(docs, kept=100_000, at_once=4 << 20))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", clean_of_benchmark),
    ("mixing", mix),
    ("token_output", token_output),
]
#: No SQL expresses near duplicates found by MinHash, the seeded mix and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = base.written(docs, name)
    return docs
