"""Benchmark decontamination by winnowing.

Words are runs of letters, digits and non-ASCII characters, lower-cased in A-Z. A benchmark item's windows are its
runs of WINDOW consecutive words; a shorter item is one window. Of the GRAM-word grams inside a window the one with
the least hash is its fingerprint. A document keeps, of every WINDOW - GRAM + 1 consecutive grams, the one with the
least hash; so whatever window it shares with an item, it keeps that window's fingerprint (items of L < WINDOW words
get their own gram length, so that the guarantee holds for spans of L words). Document and benchmark fingerprints
meet in a hash join inside the scan of the documents: the benchmark is the stated query set, and it is broadcast in
blocks of at most BLOCK_WORDS words, however long it is. A hit is extended to the whole window, looked up by its hash
and compared word by word, so the result is exact and a passage shared by many items costs a document no more than
one lookup per position.

Null and empty texts have no words: nothing is hit and they aren't contaminated. Items without words, or null, have
no windows; items of the same id count once, a null id counts as the empty string. Repeated document rows are each
judged, very long texts are read whole, an empty documents or benchmark table gives an empty or hit-free result.
Columns of the documents are carried along; the operator's own get underscores added where a name is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .base import fresh, hub_join, released, small_batches, table, written

WINDOW, GRAM = 13, 8
#: Words of benchmark text that are broadcast at a time: about 60 MB in a Python worker.
BLOCK_WORDS = 1_000_000
OUT = (("n_words", LongType()), ("n_hit", LongType()), ("items", ArrayType(StringType())), ("n_items", LongType()),
       ("items_sha256", StringType()), ("contaminated", BooleanType()))

#: bytes.translate table: A-Z to lower case, letters, digits and bytes of non-ASCII characters kept, others to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(FOLD).split()


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive ids."""
    x = _mix(ids.astype(np.uint64) + np.uint64(1))
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * _MULTIPLIER + x[j : j + n]
    return _mix(out)


def least_in_window(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive hashes."""
    n, span = len(h) - w + 1, 1
    if n <= 0:
        return np.zeros(0, h.dtype)
    m = h
    while span * 2 <= w:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    return m[:n] if span == w else np.minimum(m[:n], m[w - span : w - span + n])


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least hash of some w consecutive ones (all of them where hashes tie)."""
    m = least_in_window(h, w)
    keep = np.zeros(len(h), bool)
    for o in range(w):
        keep[o : o + len(m)] |= h[o : o + len(m)] == m
    return np.flatnonzero(keep)


class Block:
    """Fingerprints of a block of items, ready to be met by documents."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW, gram: int = GRAM):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, ws in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                by_length.setdefault(n, {}).setdefault(tuple(ids[i : i + n]), set()).add(item)
        self.classes = []
        for n, windows in sorted(by_length.items()):
            k = min(gram, n)
            w = n - k + 1
            ids = np.array(list(windows), np.int32)
            items_of = [sorted(x) for x in windows.values()]
            grams = np.stack([gram_hashes_rows(ids[:, j : j + k]) for j in range(w)], axis=1)
            whole = gram_hashes_rows(ids)
            order = np.argsort(whole, kind="stable")
            ids, whole, grams, items_of = ids[order], whole[order], grams[order], [items_of[i] for i in order]
            alike = int(np.unique(whole, return_counts=True)[1].max())  # windows of one hash stand next to each other
            self.classes.append((n, k, w, np.unique(grams.min(axis=1)), whole, alike, ids, items_of))

    def hits(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, list]]:
        """(starts, window numbers, window length, items by window) of the occurrences in ids, 0 being no known word."""
        for n, k, w, prints, whole, alike, known, items_of in self.classes:
            h = gram_hashes(ids, k)
            at = winnow(h, w)
            at = at[_in_sorted(h[at], prints)]  # the join of fingerprints
            starts = np.unique((at[:, None] - np.arange(w)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts <= len(ids) - n)]
            if not len(starts):
                continue
            rows = ids[starts[:, None] + np.arange(n)[None, :]]
            hashes = gram_hashes_rows(rows)
            first = np.searchsorted(whole, hashes)
            for j in (np.minimum(first + o, len(whole) - 1) for o in range(alike)):
                ok = (known[j] == rows).all(axis=1)  # the hit extended to the whole window
                yield starts[ok], j[ok], n, items_of


def gram_hashes_rows(rows: np.ndarray) -> np.ndarray:
    """gram_hashes of each row as a whole."""
    x, out = _mix(rows.astype(np.uint64) + np.uint64(1)), np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows.shape[1]):
            out = out * _MULTIPLIER + x[:, j]
    return _mix(out)


def _in_sorted(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def blocks_of(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of about block_words words; a longer item goes in overlapping pieces."""
    block, size = [], 0
    for row in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        ws, name = words(row["t"]), row["i"] or ""
        step = max(1, block_words - WINDOW + 1)
        for piece in [ws[i : i + block_words] for i in range(0, max(1, len(ws) - WINDOW + 1), step)]:
            if size and size + len(piece) > block_words:
                yield block
                block, size = [], 0
            block.append((name, piece))
            size += len(piece)
    yield block


def _judge(blocks: list, batch_texts: list) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """For each text: number of words, which are hit, and the items found."""
    tokens = [words(t) for t in batch_texts]
    lengths = np.array([len(t) for t in tokens], np.int64)
    firsts = np.concatenate([[0], np.cumsum(lengths + WINDOW)])  # unknown words keep texts apart
    hit = np.zeros(firsts[-1] + 1, np.int32)
    found: list[set[str]] = [set() for _ in tokens]
    for block in blocks:
        ids = np.zeros(firsts[-1], np.int32)
        get = block.vocabulary.get
        for first, t in zip(firsts, tokens):
            ids[first : first + len(t)] = [get(w, 0) for w in t]
        for starts, which, n, items_of in block.hits(ids):
            np.add.at(hit, starts, 1)
            np.add.at(hit, starts + n, -1)
            owner = np.searchsorted(firsts, starts, side="right") - 1
            for pair in np.unique(np.stack([owner, which], axis=1), axis=0).tolist():
                found[pair[0]].update(items_of[pair[1]])
    covered = np.cumsum(hit) > 0
    for first, n, items in zip(firsts, lengths, found):
        yield int(n), covered[first : first + n], sorted(items)


def contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def _verdict(n: int, n_hit: int, items: list[str]) -> tuple:
    return n, n_hit, items, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), contaminated(n, n_hit)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, dict[str, str]]:
    """docs with the OUT columns, and those columns' names.

    With one block, the usual case, this is one scan without a shuffle. With more, each block is a scan of its own
    over the distinct texts, and hit words and items are joined by text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names, wide = {}, docs
    for name, _ in OUT:
        names[name] = fresh(wide, name)
        wide = wide.withColumn(names[name], F.lit(None))
    added = [StructField(names[n], t) for n, t in OUT]
    blocks = blocks_of(benchmark, item, item_text, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        at, schema, shared = docs.columns.index(text), StructType([*docs.schema.fields, *added]), spark.sparkContext.broadcast(Block(first))

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [_verdict(n, int(h.sum()), items) for n, h, items in _judge([shared.value], batch.column(at).to_pylist())]
                cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=schema.names)

        return docs.mapInArrow(released(judge), schema), names

    key = fresh(docs, "_text_key")
    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    partial: DataFrame | None = None
    for block in _chain(first, second, blocks):
        shared = spark.sparkContext.broadcast(Block(block))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for k, (n, h, items) in zip(batch.column(0).to_pylist(), _judge([shared.value], batch.column(1).to_pylist())):
                    if items:
                        edge = np.diff(np.concatenate([[0], h.astype(np.int8), [0]]))
                        out.append((k, np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), items))
                yield pa.RecordBatch.from_pydict({"k": pa.array([r[0] for r in out], pa.string()), "a": pa.array([r[1] for r in out], pa.list_(pa.int64())), "b": pa.array([r[2] for r in out], pa.list_(pa.int64())), "i": pa.array([r[3] for r in out], pa.list_(pa.string()))})

        part = written(keyed.select(key, text).mapInArrow(released(find), "k string, a array<long>, b array<long>, i array<string>").dropDuplicates(["k"]), "hits")
        shared.unpersist()
        partial = part if partial is None else partial.unionByName(part)
    # one row per text and block: intervals and items of a text join
    spans = partial.groupBy("k").agg(F.flatten(F.collect_list(F.arrays_zip("a", "b"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("i")))).alias("i"))
    n_hit = F.aggregate(
        F.array_sort("s"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, x: F.struct((acc.n + F.greatest(F.lit(0), x.b - F.greatest(x.a, acc.end))).alias("n"), F.greatest(acc.end, x.b).alias("end")),
    ).n
    n_words = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")).cast("long")
    met, rows = fresh(keyed, "_met"), fresh(keyed, "_rows")
    per_text = keyed.groupBy(key).agg(F.count("*").alias(rows)).join(spans.select(F.col("k").alias(key), F.struct(n_hit.alias("n"), "i").alias(met)), key, "left")
    out = hub_join(keyed, per_text, key, rows, F.xxhash64(key), "left")
    hit, found = F.coalesce(f"{met}.n", F.lit(0)).cast("long"), F.coalesce(f"{met}.i", F.array().cast("array<string>"))
    return out.select(
        *(F.col(f"`{c}`") for c in docs.columns), n_words.alias(names["n_words"]), hit.alias(names["n_hit"]), found.alias(names["items"]),
        F.size(found).cast("long").alias(names["n_items"]), F.sha2(F.array_join(found, ","), 256).alias(names["items_sha256"]),
        ((hit > 0) & (20 * hit >= n_words)).alias(names["contaminated"]),
    ), names


def _chain(first, second, rest):
    yield first
    yield second
    yield from rest


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, n = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", *(F.col(n[c]).alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(ws[i + 1:i + least(13, len(ws))], ' ') AS win
  FROM (SELECT item, ws, unnest(range(greatest(0, len(ws) - 13) + 1)) AS i FROM b WHERE len(ws) > 0)),
ls AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(ws[i + 1:i + n], ' ') AS win FROM (SELECT rid, ws, n, unnest(range(greatest(0, len(ws) - n + 1))) AS i FROM d, ls)),
h AS (SELECT rid, dw.n, i, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""
