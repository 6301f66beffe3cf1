"""LM scoring of all documents, learning from all but a fold.

Held-out documents are those whose crc32(doc_id as text) mod 5 is 1; the others are training documents. One pass over
the training documents gathers, from each whole text, word counts, subword bigram counts, and every window of subwords
so that all of it grows with the corpus. The attention weights are fitted on these
windows in ROUNDS: each partition trains on its own share of the round's windows from common weights, and the results
are averaged by number of windows through a tree of tasks. So scores depend on how the table is split, a little (they
differ by what training on other shares does); on one split, reruns agree. A second pass scores every document whole.

The unigram base needs the corpus-wide count of every word. The HEAD most frequent words are broadcast, a bounded
table; the rarer words of each document are joined to their counts by a shuffle, so none is left out.

Null texts count as empty (the end token alone); a null doc_id's text is empty, so it is a training document. Repeated
rows count and are scored one by one; ties don't occur. Very long texts are scored whole. With no training document
all counts are 0, N is 0 and V is 0. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm as lm
from .base import released, small_batches, table, together, written

FOLDS, HELD_OUT = 5, 1
ROUNDS, RATE = 2, 0.02
#: Texts are read together up to this many bytes.
TOGETHER = 4 << 20
HEAD = 300_000
#: Words and windows that a worker hands on at once.
COUNTED, PACKED = 20_000, 30_000


def held_out(key: str):
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")), F.lit(FOLDS)) == HELD_OUT


GATHERED = "kind int, word binary, n long, data binary"


def gather(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """From training documents: kind 0 a word's count, kind 1 bigram counts, kind 2 windows of subwords."""

    def row(kind: int, words: list, n: list, data: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.int32()), pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=["kind", "word", "n", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, seen = lm.Bigrams(), 0
        for batch in together(batches, TOGETHER):
            words = lm.Words(batch.column(0))
            times = np.bincount(words.kind, minlength=len(words.kinds))
            for i in range(0, len(times), COUNTED):  # Spark adds the batches' counts up
                part = times[i : i + COUNTED]
                yield row(0, words.kinds[i : i + COUNTED], part, [None] * len(part))
            ids = lm.speller(path).spell(words)
            pairs.add(ids)
            inputs, wanted, _, n = lm.windows(ids)
            seen += n
            both = np.concatenate([inputs.astype("<u2"), wanted.astype("<u2")], axis=1)
            del inputs, wanted
            # not compressed: Spark's files are, in less time
            for i in range(0, len(both), PACKED):
                yield row(2, [None], [len(both[i : i + PACKED])], [lm.pack(both[i : i + PACKED], 0)])
        if seen:
            yield row(1, [None], [seen], [_sparse(pairs.settle())])

    return written(docs.select(F.col(text).cast("string")).mapInArrow(released(run), GATHERED), "gathered")


def _sparse(counts: np.ndarray) -> bytes:
    at = np.flatnonzero(counts)
    return lm.pack(np.concatenate([at, counts[at]]))


def _add(packed: Iterator[bytes]) -> np.ndarray:
    total = np.zeros(lm.VOCAB**2, np.int64)
    for x in packed:
        at, n = np.frombuffer(zlib.decompress(x), np.int64).reshape(2, -1)
        total[at] += n
    return total


def _bigram_counts(gathered: DataFrame) -> np.ndarray:
    """The sum of the partitions' counts: added up on executors until few are left, then one by one here."""
    parts = gathered.where("kind = 1").select("data").rdd.map(lambda r: bytes(r[0]))
    while (n := parts.getNumPartitions()) > 8:
        parts = parts.coalesce(max(8, n // 8), shuffle=True).mapPartitions(lambda rows: [_sparse(_add(rows))])
    return _add(parts.toLocalIterator())


def fit(gathered: DataFrame) -> tuple[dict, tuple]:
    """Weights and tables, from what gather() has written."""
    spark = gathered.sparkSession
    tables = lm.tables(_bigram_counts(gathered))
    weights, shared = lm.fresh_weights(), spark.sparkContext.broadcast(tables)
    batches = gathered.where("kind = 2").select("data").rdd

    for number in range(ROUNDS):

        def share(rows, weights=weights, number=number) -> Iterator[tuple]:
            both = (np.frombuffer(zlib.decompress(r[0]), "<u2").reshape(-1, lm.CONTEXT + lm.STRIDE)[number::ROUNDS] for r in rows)
            n, w = 0, weights
            for part in _grouped(both, 40_000):
                n += len(part)
                part = part[np.random.Generator(np.random.PCG64(number)).permutation(len(part))].astype(np.int32)
                w = lm.train(w, shared.value, part[:, : lm.CONTEXT], part[:, lm.CONTEXT :], RATE / (1 + 2 * number))
            if n:
                yield n, {k: n * v.astype(np.float64) for k, v in w.items()}

        add = lambda x, y: (x[0] + y[0], {k: x[1][k] + y[1][k] for k in x[1]})
        none = (0, {k: np.zeros(s) for k, s in lm.SHAPES.items()})
        n, total = batches.mapPartitions(share).treeAggregate(none, add, add, 2)
        if n:
            weights = {k: (v / n).astype(np.float32) for k, v in total.items()}
    return weights, tables


def _grouped(arrays: Iterable[np.ndarray], rows: int) -> Iterator[np.ndarray]:
    held, size = [], 0
    for a in arrays:
        held.append(a)
        size += len(a)
        if size >= rows:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of each row. path: of the vocabulary."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or lm.vocabulary_path()
    gathered = gather(docs.where(~held_out(key)), path, text)
    counts = written(gathered.where("kind = 0").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    n_train, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total = n_train + 0.5 * (vocabulary + 1)
    most = counts.orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    shared = spark.sparkContext.broadcast((most["word"].to_pylist(), most["c"].to_pylist(), *fit(gathered)))
    thin = docs.select(F.col(key), held_out(key).alias("held_out"), F.col(text).cast("string"))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"_row long, {key} {kind}, held_out boolean, n_tokens long, known long, base double, score double, words array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (head, times, weights, tables), speller = shared.value, lm.speller(path)
        log_of, nothing = {w: math.log10((c + 0.5) / total) for w, c in zip(head, times)}.get, repeat(0.0)  # no logarithm is 0
        at = TaskContext.get().partitionId() << 36
        for batch in together(batches, TOGETHER):
            words, n = lm.Words(batch.column(2)), len(batch)
            each = np.fromiter(map(log_of, words.kinds, nothing), np.float64, len(words.kinds))[words.kind]
            first = np.concatenate([[0], words.ends[:-1]])
            rare = each == 0
            n_rare = np.add.reduceat(rare, first, dtype=np.int64)
            rare_words = pa.array(words.kinds, pa.binary()).take(pa.array(words.kind[rare]))
            rare_lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_rare)]), pa.int32()), rare_words)
            tokens = words.ends - first
            score = lm.score(weights, tables, speller.spell(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(at, at + n)), batch.column(0), batch.column(1), pa.array(tokens), pa.array(tokens - n_rare), pa.array(np.add.reduceat(each, first)), pa.array(score), rare_lists],
                names=["_row", key, "held_out", "n_tokens", "known", "base", "score", "words"],
            )
            at += n

    scored = written(thin.mapInArrow(released(run), schema), "scored")
    rare = scored.select("_row", F.explode("words").alias("word"), F.lit(1).alias("n"))
    c = F.coalesce("c", F.lit(0))
    rest = rare.join(counts, "word", "left").groupBy("_row").agg(
        F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(float(total)))).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known")
    )
    return scored.drop("words").join(rest, "_row", "left").select(
        key, "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
