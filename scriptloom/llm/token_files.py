"""Token-id files: documents encoded by a public tokenizer, coded by the context-mixing range coder, and read back.

A file set is a Parquet table of chunks. A chunk holds the ids of consecutive whole documents, in ascending doc_id
order (then by text), as one `payload` in the coder's format beside the documents' ids, places and lengths; chunks are
ordered by (part, chunk). Spark's commit protocol writes it, so a lost executor's chunks are written again and never twice.

Every document ends with END. Null texts count as empty and give END alone. Null doc_ids come first; repeated
rows and ties are kept, next to each other. doc_ids may be of any type that has an order. Very long documents go into a
chunk of their own size: 13 bytes an id while it is coded. Special tokens' strings in a text give their ids, as is the
tokenizer's rule. An empty table gives an empty file set. Other columns are not read.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import range_coder
from .base import released, small_batches, table, together, walked, written

TOKENIZER, END = "word_bpe_49k.json", 2
#: A chunk closes at this many ids.
CHUNK_IDS = 1 << 20
#: Texts are encoded together up to this many bytes. In a task, a worker keeps the ids of about 2 * KEPT words and KEPT
#: units; between tasks, those of about KEPT words.
TOGETHER, KEPT = 8 << 20, 700_000
#: Words of signs, digits and Latin letters in composed form; and their units, in lower case.
_plain = re.compile("[\\x21-\\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
_units = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^a-z0-9\u00DF-\u00F6\u00F8-\u00FF]+")
_id = attrgetter("id")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Units(dict):
    """Units to their ids as little-endian 32-bit integers, each encoded once by the tokenizer's model."""

    def __init__(self, tokenizer):
        self.tokenize = tokenizer.model.tokenize
        letters = [chr(i) for i in range(0xDF, 0x100) if i != 0xF7]
        self.spelled = {ord(c): tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}

    def __missing__(self, unit: str) -> bytes:
        found = self[unit] = array("I", map(_id, self.tokenize(unit if unit.isascii() else unit.translate(self.spelled)))).tobytes()
        return found


class Encoder:
    """Ids of texts.

    A tokenizer that drops white space and splits texts into units, runs of letters or of other signs, gives a text the
    ids of its words: these are found and numbered by Arrow, looked up once in a batch, and encoded once as long as they
    are kept. A new word of Latin letters, digits and signs is split into units, which the tokenizer's model encodes; any
    other word, and what may be a special token, goes through the whole tokenizer. With tokenizers of another kind texts
    are encoded whole.
    """

    def __init__(self, path: str, kept: int = KEPT):
        import os

        self.kept = kept

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            parts = json.load(f)
        kinds = lambda of, name: [x["type"] for x in (of or {}).get(name, [])]
        steps = parts["pre_tokenizer"] or {}
        first = (steps.get("pretokenizers") or [{}])[0]
        self.by_word = (
            kinds(parts["normalizer"], "normalizers") == ["NFC", "Replace", "Lowercase"] and kinds(steps, "pretokenizers") == ["Split", "ByteLevel"]
            and first.get("pattern") == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"} and first["invert"]
        )
        self.young, self.old, self.units = {"": b""}, {}, Units(self.tokenizer) if self.by_word else {}

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words. Words not asked for in a while are forgotten a generation at a time."""
        if len(self.young) > self.kept:
            self.young, self.old = {"": b""}, self.young
        if len(self.units) > self.kept:
            self.units.clear()
        young, old, unit, whole = self.young, self.old, self.units.__getitem__, []
        out = list(map(young.get, words))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            w = words[i]
            ids = old.get(w)
            if ids is None:
                ascii = w.isascii()
                if ascii and w.isalpha():
                    ids = unit(w.lower())
                elif (w.isprintable() if ascii else _plain.fullmatch(w)) and "<|" not in w:  # printable: no control characters
                    ids = b"".join(map(unit, _units.findall(w.lower())))
                else:
                    whole.append(i)
                    continue
            out[i] = young[w] = ids
        for at in range(0, len(whole), 10_000):
            part = whole[at : at + 10_000]
            for i, ids in zip(part, self._alone([words[i] for i in part])):
                out[i] = young[words[i]] = ids
        return out

    def rest(self) -> None:
        """Forgets what is too much to keep between tasks."""
        self.old = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text followed by END, and how many each has with it."""
        texts = pc.fill_null(texts, "")
        if self.by_word:
            words = pc.ascii_split_whitespace(texts)
            first = words.offsets.to_numpy().astype(np.int64)
            numbered = words.flatten().dictionary_encode()
            kinds = [*self._words(numbered.dictionary.to_numpy(zero_copy_only=False).tolist()), np.array([END], "<u4").tobytes()]
            first -= first[0]
            kind = np.insert(numbered.indices.to_numpy(zero_copy_only=False), first[1:], len(kinds) - 1)
            size = np.fromiter(map(len, kinds), np.int32, len(kinds)) // 4
            ends = np.cumsum(size[kind], dtype=np.int64)[first[1:] + np.arange(len(texts))]
            ids = walked(np.frombuffer(b"".join(kinds), "<u4"), size, kind)
        else:
            every = [x + np.array([END], "<u4").tobytes() for x in self._alone(texts.to_pylist())]
            ids, ends = np.frombuffer(b"".join(every), "<u4"), np.cumsum([len(x) // 4 for x in every], dtype=np.int64)
        return ids, np.diff(ends, prepend=0)


@lru_cache(1)
def encoder(path: str, kept: int) -> Encoder:
    """One for each worker, whose next task goes on with the words it knows."""
    return Encoder(path, kept)


def write(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, kept: int = KEPT, at_once: int = TOGETHER) -> DataFrame:
    """The chunks of docs, written to the shared folder and opened again. path: of the tokenizer's file. kept and at_once
    bound a worker's memory: about 200 bytes for each of 3 * kept words and units, and 20 for each byte of text at once."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or tokenizer_path()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    thin = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    dealt = thin.repartitionByRange(n, "k", "h").sortWithinPartitions("k", "h", "t")
    kind = docs.schema[key].dataType.simpleString()
    place = f"array<struct<doc_id:{kind},start:bigint,n:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, chunk = encoder(path, kept), TaskContext.get().partitionId(), 0
        for batch in together(batches, at_once):
            keys = batch.column(0)
            ids, sizes = code.encode(batch.column(1))
            ends = np.cumsum(sizes)
            first = 0
            while first < len(sizes):
                base = int(ends[first] - sizes[first])
                last = max(first + 1, int(np.searchsorted(ends, base + CHUNK_IDS, side="right")))
                size = sizes[first:last]
                docs_ = pa.StructArray.from_arrays([keys.slice(first, last - first), pa.array(ends[first:last] - size - base), pa.array(size)], names=["doc_id", "start", "n"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int64()), pa.array([chunk], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(size)], pa.int32()), docs_), pa.array([int(size.sum())], pa.int64()), pa.array([ids[base : int(ends[last - 1])].tobytes()], pa.binary())],
                    names=["part", "chunk", "docs", "n_ids", "ids"],
                )
                first, chunk = last, chunk + 1
        code.rest()

    raw = dealt.select("k", "t").mapInArrow(released(run), f"part bigint, chunk bigint, docs {place}, n_ids bigint, ids binary")
    return written(raw.select("part", "chunk", "docs", "n_ids", range_coder.encoded(spark, "ids").alias("payload")), "tokens")


def read(chunks: DataFrame) -> DataFrame:
    """From the chunks alone: doc_id, start (ids of all documents before), n_tokens, ids_crc32 of each document."""
    sizes = chunks.select("part", "chunk", "n_ids")
    per_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = per_part.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    inside = sizes.withColumn("_in", F.sum("n_ids").over(Window.partitionBy("part").orderBy("chunk")) - F.col("n_ids"))
    starts = inside.join(before, "part").select("part", "chunk", (F.col("_before") + F.col("_in")).alias("_start"))
    piece = lambda ids, d: F.substring(ids, (4 * d.start + 1).cast("int"), (4 * d.n).cast("int"))
    digest = lambda ids: F.transform("docs", lambda d: F.struct(d.doc_id.alias("doc_id"), d.start.alias("start"), d.n.alias("n_tokens"), F.crc32(piece(ids, d)).alias("ids_crc32")))
    # the outer transform names the decoded ids, so that they are decoded once
    each = chunks.select("part", "chunk", F.explode(F.element_at(F.transform(F.array(range_coder.decoded(chunks.sparkSession, "payload")), digest), 1)).alias("d"))
    return each.join(starts, ["part", "chunk"]).select("d.doc_id", (F.col("d.start") + F.col("_start")).alias("start"), "d.n_tokens", "d.ids_crc32")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents")))
