"""Cross-tokenizer alignment: where two tokenizers' tokens of a text begin and end together, and which overlap.

A text, with a space before it, is encoded by a byte-level BPE (A) and by a piece model (B). Byte offsets where tokens of
both end cut them into groups; a link is a pair of an A and a B token whose byte ranges overlap. Both tokenizers treat a unit
(units.py) alike wherever it stands and cut at its ends, so groups and links lie within units, and the alignment runs
over the corpus's distinct units:

1. documents become numbers of the units of their block, a run of documents of about BLOCK bytes; the units are rows;
2. distinct units are encoded, and aligned relationally: posexplode of the tokens, cumulative lengths by a window, a full
   equi-join of both sides on (unit, end), where both end there is a cut, and the running number of cuts is the group. Links
   are a range join by the merged ends: each end's range belongs to the next A end and the next B end, so a unit has as
   many links as distinct ends, and no group's tokens are paired all with all;
3. the units' pairs meet their blocks; a pair counts once for a document (distinct numbers of documents and pairs), summed
   in the block before the shuffle; a pair is best if no other pair of its A id is in more documents;
4. units get the sums over their links, meet their blocks once more, and documents add up what their units have.

Hot units are rows once a block; a pair of very many units is a skewed join key that Spark splits. A block's task holds its documents'
numbers (4 bytes a unit) and its units' rows; one very long document is a block of its own. A unit without spaces, however
long, is one row, its tokens are rows of a window of their own.

Null and empty texts, and texts whose A or B tokens don't give the bytes of space and text, have no tokens: counts of 0, an empty
string of groups. Repeated rows are documents of their own; ties for best are all best. An empty table gives an
empty one. doc_ids may be null and of any type. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import units
from .base import _remove, hand_back, released, small_batches, table, together, walked, written

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of texts in a block, and of those split at once; (document, pair) numbers sorted at once; the tables' codec.
BLOCK, TOGETHER, AT_ONCE, CODEC = 32 << 20, 4 << 20, 1 << 20, "zstd"
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Tokenizers:
    def __init__(self, byte_path: str, piece_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        # the byte-level alphabet: printable bytes stand for themselves, the others for signs from 256 on, in order
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}
        if set(sign) != set(ByteLevel.alphabet()):
            raise ValueError("another alphabet of bytes")
        self.a_bytes = [bytes(map(sign.__getitem__, self.a.id_to_token(i))) if set(self.a.id_to_token(i)) <= set(sign) else b"" for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("\n" in p or "▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces go across units")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both tokenizers of units. The model puts a space mark first, which a line feed keeps apart from a unit."""
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        return [(x, y[2:]) for x, y in zip(a, self.b.encode(["\n" + t for t in texts], num_threads=1))]


@lru_cache(1)
def tokenizers(byte_path: str, piece_path: str) -> Tokenizers:
    """One pair for each worker."""
    return Tokenizers(byte_path, piece_path)


#: While tables are written, their shuffles' files go as soon as they are; and rows that are dealt by unit stay there when
#: they are joined by unit and end.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


@contextmanager
def _set(spark: SparkSession):
    before = {k: spark.conf.get(k) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _forget(table: DataFrame) -> None:
    """Removes a written() table that nothing reads any more."""
    for file in table.inputFiles()[:1]:
        _remove(table.sparkSession, file.rpartition("/")[0])


def in_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of documents (block, key, of: the numbers of its units) and rows of units (block, n, unit)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, size, number = TaskContext.get().partitionId() << 32, 0, 0, {}
        names = ["block", "key", "of", "n", "unit"]

        def units_of_block():
            n = len(number)
            every = pa.array(list(number), pa.string())
            for i in range(0, n, 50_000):
                m = min(50_000, n - i)
                empty = [pa.nulls(m, batch.schema.field(0).type), pa.nulls(m, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array([part + at] * m, pa.int64()), *empty, pa.array(np.arange(i, i + m, dtype=np.int32)), every.slice(i, m)], names=names)

        batch = None
        for batch in together(batches, TOGETHER):
            texts = pc.fill_null(batch.column(1), "")
            spaced = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" "), texts, ""))
            code, many, distinct = units.split(spaced)
            place = np.fromiter((number.setdefault(u, len(number)) for u in distinct), np.int32, len(distinct))
            ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
            rows = len(texts)
            of = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[code]))
            yield pa.RecordBatch.from_arrays([pa.array([part + at] * rows, pa.int64()), batch.column(0), of, pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.string())], names=names)
            size += texts.nbytes
            if size >= BLOCK:
                yield from units_of_block()
                at, size, number = at + 1, 0, {}
        if batch is not None:
            yield from units_of_block()

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(released(run), f"block long, key {kind}, of array<int>, n int, unit string")


def encoded(distinct: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """unit, a, b: tokens' ids and lengths in bytes of both sides, null where their bytes aren't the unit's."""
    kind = "array<struct<id:int,size:int>>"

    def side(ids: list, table: list[bytes], text: np.ndarray, length: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The tokens, and whether their bytes are those of the texts, which stand in a row."""
        flat = np.fromiter((i for x in ids for i in x), np.int32)
        sizes = np.fromiter(map(len, table), np.int32, len(table))
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        total = np.diff(np.concatenate([[0], np.cumsum(sizes[flat], dtype=np.int64)])[ends])
        same = total == length
        given = walked(np.frombuffer(b"".join(table), np.uint8), sizes, flat[np.repeat(same, np.diff(ends))])
        text = text[np.repeat(same, length)]
        owner = np.repeat(np.flatnonzero(same), length[same])
        same[owner[given != text]] = False
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat), pa.array(sizes[flat])], ["id", "size"])), same

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(byte_path, piece_path)
        for batch in together(batches, 1 << 20):
            texts = batch.column(0).to_pylist()
            whole = "".join(texts).encode()
            text, length = np.frombuffer(whole, np.uint8), pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)
            (a, same_a), (b, same_b) = (side(ids, tab, text, length) for ids, tab in zip(zip(*both.encode(texts)), (both.a_bytes, both.b_bytes)))
            same = pa.array(same_a & same_b)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pc.if_else(same, x, None) for x in (a, b))], names=["unit", "a", "b"])

    return distinct.mapInArrow(released(run), f"unit string, a {kind}, b {kind}")


def aligned(tokens: DataFrame) -> DataFrame:
    """From u and the tokens a and b of units: u, n_a, n_b, n_groups, groups, links (arrays of an A and a B id).

    Units are dealt once, with their tokens in arrays; all that follows is by unit and stays in its partition.
    """
    tokens = tokens.repartition("u")

    def ends(side: str) -> DataFrame:
        each = tokens.select("u", F.posexplode(side).alias("pos", "t"))
        w = Window.partitionBy("u").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        return each.select("u", F.sum("t.size").over(w).alias("end"), F.col("t.id").alias(side))

    both = ends("a").join(ends("b"), ["u", "end"], "full_outer")
    # from the last end to the first, so that what follows an end is known when it is reached
    back = Window.partitionBy("u").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    cut = F.col("a").isNotNull() & F.col("b").isNotNull()
    rows = both.select(
        "u", "end", "a", "b", cut.alias("cut"), F.sum(cut.cast("int")).over(back).alias("group"),
        F.struct(F.last("a", True).over(back).alias("a"), F.last("b", True).over(back).alias("b")).alias("link"),
    )
    each = rows.groupBy("u").agg(
        F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.max("group").cast("long").alias("n_groups"),
        F.array_sort(F.collect_list(F.struct("end", "a", "b", "cut", "link"))).alias("ends"),
    )
    # a cut ends a group on both sides
    ids = lambda side: F.split(F.array_join(F.transform(F.filter("ends", lambda e: e[side].isNotNull()), lambda e: F.concat(e[side].cast("string"), F.when(e.cut, ";").otherwise(","))), ""), ";")
    pairs = F.zip_with(ids("a"), ids("b"), lambda a, b: F.concat(a, F.lit("|"), b))
    return each.select("u", "n_a", "n_b", "n_groups", F.array_join(F.slice(pairs, F.lit(1), F.col("n_groups").cast("int")), ";").alias("groups"), F.col("ends.link").alias("links"))


def _lean(run):
    """A function of a block's documents and units in a worker that lets go of the tokenizers, and of its own memory when it ends."""

    def go(docs: pa.Table, rows: pa.Table) -> pa.Table:
        tokenizers.cache_clear()
        hand_back()
        out = run(docs, rows)
        hand_back()
        return out

    return go


def _pairs_of_documents(docs: pa.Table, rows: pa.Table) -> pa.Table:
    """In how many documents of a block each pair is linked."""
    at, n, good, size, pool = _block(docs, rows, "pairs")
    kinds, pool = np.unique(pool, return_inverse=True)
    total, width = np.zeros(len(kinds), np.int64), max(1, len(kinds))
    start, ends = 0, np.concatenate([[0], np.cumsum(n)])
    weight = np.concatenate([[0], np.cumsum(size[at], dtype=np.int64)])[ends]
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(weight, weight[start] + AT_ONCE, "right")) - 1)
        doc = np.repeat(np.arange(stop - start), n[start:stop])
        key = np.unique(doc * np.int64(len(size)) + at[ends[start] : ends[stop]])  # a document's distinct units
        doc, unit = np.divmod(key, len(size))
        ok = good[start:stop][doc]
        doc, unit = doc[ok], unit[ok]
        pairs = walked(pool, size, unit)
        total += np.bincount(np.unique(np.repeat(doc, size[unit]) * width + pairs) % width, minlength=len(kinds))
        start = stop
    found = np.flatnonzero(total)
    return pa.table({"pair": pa.array(kinds[found], pa.int64()), "docs": pa.array(total[found])})


def _block(docs: pa.Table, rows: pa.Table, column: str):
    """Numbers of the units in a row, how many each document has, whether all of them can be encoded; and for `column` of the
    units' rows by number: its values' sizes and pool."""
    of = docs["of"].combine_chunks()
    at = of.flatten().to_numpy(zero_copy_only=False)
    n = np.diff(of.offsets.to_numpy()).astype(np.int64)
    number = rows["n"].combine_chunks().to_numpy(zero_copy_only=False)
    count = int(max(number.max(initial=-1), at.max(initial=-1))) + 1
    place = np.full(count, -1, np.int64)
    place[number] = np.arange(len(number))
    bad = np.zeros(count, bool)
    bad[number] = ~rows["good"].combine_chunks().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(n)])
    wrong = np.concatenate([[0], np.cumsum(bad[at])])[ends]
    good = np.diff(wrong) == 0
    lists = rows[column].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int32)
    sizes[lists.is_null().to_numpy(zero_copy_only=False)] = 0
    size = np.where(place >= 0, sizes[np.maximum(place, 0)] if len(sizes) else 0, 0).astype(np.int32)
    pool = walked(lists.flatten().to_numpy(zero_copy_only=False), sizes, place[place >= 0])  # now in the order of numbers
    return at, n, good, size, pool


def _documents(kind: pa.DataType):
    def run(docs: pa.Table, rows: pa.Table) -> pa.Table:
        """A block's documents: sums over their units, and the groups of all of them."""
        of = docs["of"].combine_chunks()
        at = of.flatten().to_numpy(zero_copy_only=False)
        ends = of.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        number = rows["n"].combine_chunks().to_numpy(zero_copy_only=False)
        count = int(max(number.max(initial=-1), at.max(initial=-1))) + 1
        bad = np.zeros(count, bool)
        bad[number] = ~rows["good"].combine_chunks().to_numpy(zero_copy_only=False)
        add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)])[ends])
        good = add(bad) == 0
        out = {"doc_id": docs["key"].combine_chunks()}
        for name in SUMS:
            x = np.zeros(count, np.int64)
            x[number] = rows[name].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
            out[name] = pa.array(np.where(good, add(x), 0))
        # units' strings stay in Arrow, and are joined for a few documents at a time
        place, groups = np.full(count, -1, np.int32), rows["groups"].combine_chunks()
        place[number] = np.where(groups.is_null().to_numpy(zero_copy_only=False), -1, np.arange(len(number)))

        def joined(first: int, last: int) -> pa.Array:
            units = place[at[ends[first] : ends[last]]]
            told = (units >= 0) & np.repeat(good[first:last], np.diff(ends[first : last + 1]))
            upto = np.concatenate([[0], np.cumsum(told)])[ends[first : last + 1] - ends[first]]
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), groups.take(pa.array(units[told]))), ";")

        lines = [joined(k, min(k + 200, len(good))) for k in range(0, len(good), 200)]
        out["groups"] = pa.chunked_array(lines, pa.string())
        return pa.table(out)

    return run


class Alignment:
    """documents: doc_id, SUMS, groups. pairs: a, b, docs, best. Both are DataFrames."""

    def __init__(self, documents: DataFrame, pairs: DataFrame):
        self.documents, self.pairs = documents, pairs


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", byte_path: str | None = None, piece_path: str | None = None) -> Alignment:
    import public_tokenizers as own

    spark, paths = docs.sparkSession, (byte_path or own.path(BYTES), piece_path or own.path(PIECES))
    small_batches(spark)
    with _set(spark):
        blocks = written(in_blocks(docs, key, text), "unit-blocks", CODEC)
        of, rows = blocks.where("of IS NOT NULL").select("block", "key", "of"), blocks.where("unit <> ''").select(F.col("block").alias("in_block"), "n", "unit")
        tokens = encoded(rows.select("unit").distinct(), *paths)
        tokens = written(tokens.select(F.monotonically_increasing_id().alias("u"), "*"), "unit-tokens", CODEC)
        width = tokenizers(*paths).b.get_piece_size()
        pair = lambda x: x.a * F.lit(width).cast("long") + x.b
        small = "int" if tokenizers(*paths).a.get_vocab_size() * width < 1 << 31 else "long"  # what a pair's number fits in
        made = aligned(tokens.where("a IS NOT NULL").select("u", "a", "b")).withColumn("links", F.transform("links", lambda x: pair(x).cast(small)))
        known = written(tokens.select("u", "unit").join(made, "u", "left").withColumn("good", F.col("n_a").isNotNull()), "unit-groups", CODEC)
        _forget(tokens)
        dictionary = rows.join(known.select("unit", "good", F.array_distinct("links").alias("pairs")), "unit").drop("unit")
        found = of.select("block", "of").groupBy("block").cogroup(dictionary.groupBy("in_block")).applyInArrow(_lean(_pairs_of_documents), "pair long, docs long")
        counted = written(found.groupBy("pair").agg(F.sum("docs").alias("docs")), "pair-counts", CODEC)
        a = F.floor(F.col("pair") / width)
        pairs = counted.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy(a)))
        # units' links meet the counts of their pairs
        links = known.select("u", F.explode("links").alias("pair"))
        met = links.join(pairs, "pair")  # a pair of many units: Spark splits its partition
        sums = met.groupBy("u").agg(F.sum("docs").alias("count_sum"), F.sum(F.col("best").cast("long")).alias("n_best"), F.count("*").alias("n_links"))
        whole = written(known.select("u", "unit", "good", "n_a", "n_b", "n_groups", "groups").join(sums, "u", "left").drop("u"), "unit-sums", CODEC)
        _forget(known)
        kind = docs.schema[key].dataType.simpleString()
        # written before it is dealt by block, so that the shuffles by unit are gone by then
        dictionary = written(rows.join(whole, "unit").drop("unit"), "unit-places", CODEC)
        _forget(whole)
        sums_ = ", ".join(f"{x} long" for x in SUMS)
        documents = of.groupBy("block").cogroup(dictionary.groupBy("in_block")).applyInArrow(_lean(_documents(kind)), f"doc_id {kind}, {sums_}, groups string")
    return Alignment(documents, pairs.select(a.cast("int").alias("a"), F.pmod("pair", F.lit(width)).cast("int").alias("b"), "docs", "best"))


def op11_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = align(table(spark, sf_dir, "documents").select("doc_id", "text")).documents
    return d.select("doc_id", *SUMS, F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256"))
