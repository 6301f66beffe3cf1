"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of SHINGLE-word shingles (words between white space, lower-cased in A-Z; a text of fewer words, but
not none, is one shingle). Two texts are linked if the Jaccard similarity of their sets is THRESHOLD or more; classes
are the connected components of the links.

1. Copies of one text become a node, named by the text's MD5. Each row's MinHash signature is reduced to BANDS keys of
   ROWS values; texts that share a key are candidates. A pair at the threshold shares none with a chance of about 6e-5,
   at 0.85 of 1e-7.
2. Texts that share keys, by chains, form a block of candidates; nothing but these stars of (key, text) is shuffled.
3. A block's texts are signed once more and their shingle sets kept. A large block is cut into pieces, and every two
   pieces meet in a task of their own, so no task grows with the block. First the signatures meet: candidate pairs have
   their MinHash values compared incrementally, STEP at a time; a pair leaves once the posterior probability of reaching
   the threshold (uniform prior) is below TOLERANCE. A text that is left with no pair in a task goes no further there.
4. Then the shingle sets of the texts that are left meet likewise, and the remaining pairs are verified exactly. A task
   returns numbers of links and a representative per text, never pairs. No text is copied for this, and a set only to
   where a near copy of it may be.

A row without words (null, empty, blank) has no shingles: it has no links and is a class of its own. Repeated rows are
copies. class_id is the least doc_id in the class; it is null only if all are. Empty tables give empty results; very
long texts are compared whole; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import fresh, hand_back, hub_join, released, small_batches, table, written
from .components import connected
from .decontaminate import _mix, gram_hashes_rows

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE = 32, 6, 16, 1e-6
HASHES = BANDS * ROWS
#: Texts and words of a piece of a large block; two pieces meet in a task.
PIECE_TEXTS, PIECE_WORDS = 256, 300_000
#: Rows of the table of candidate texts, at about 100 bytes, up to which it is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 200_000

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_seeds = np.random.Generator(np.random.PCG64(20240613))
XOR = _seeds.integers(0, 1 << 32, HASHES, np.uint32)
ODD = _seeds.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)


class WordHashes(dict):
    """64-bit hashes of words, computed once each."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(texts: list[str | None], known: WordHashes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of all texts as 64-bit hashes, where each text's begin (with the end), and the numbers of words."""
    if len(known) > 200_000:
        known.clear()
    words = [t.encode().translate(LOWER).split() if t else [] for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((known[x] for w in words for x in w), np.uint64, int(n.sum()))
    first = np.concatenate([[0], np.cumsum(n)])
    k = np.where(n == 0, 0, np.maximum(1, n - size + 1))
    begin = np.concatenate([[0], np.cumsum(k)])
    x = _mix(np.concatenate([flat, np.zeros(size, np.uint64)]))
    grams = np.zeros(len(flat), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + x[j : j + len(flat)]
    grams = _mix(grams)
    out = grams[np.repeat(first[:-1] - begin[:-1], k) + np.arange(begin[-1])]
    for i in np.flatnonzero((n > 0) & (n < size)):
        out[begin[i]] = gram_hashes_rows(flat[None, first[i] : first[i + 1]])[0] ^ np.uint64(n[i])
    return out, begin, n


def signatures(shingles: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of each non-empty set."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    out, v = np.empty((HASHES, len(begin)), np.uint32), np.empty_like(h)
    for i in range(HASHES):
        np.bitwise_xor(h, XOR[i], out=v)
        np.multiply(v, ODD[i], out=v)
        out[i] = np.minimum.reduceat(v, begin)
    return out.T


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = [gram_hashes_rows(sig[:, b * ROWS : (b + 1) * ROWS].astype(np.uint64) + np.uint64(b << 40)) for b in range(BANDS)]
    return np.stack(keys, axis=1).view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n compared values, the fewest matches m at which P(J >= threshold | m of n) >= tolerance.

    With a uniform prior J's posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance and m < n:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


LEAST = least_matches()


def survivors(sig: np.ndarray, keys: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs that pass the pruning; side: only pairs of different sides."""
    i_all, j_all = [], []
    for i in range(len(sig) - 1):
        same = (keys[i + 1 :] == keys[i]).any(axis=1)
        if side is not None:
            same &= side[i + 1 :] != side[i]
        j = np.flatnonzero(same) + i + 1
        matches = np.zeros(len(j), np.int64)
        for n, least in LEAST.items():
            if not len(j):
                break
            matches += (sig[j, n - STEP : n] == sig[i, n - STEP : n]).sum(axis=1)
            stay = matches >= least
            j, matches = j[stay], matches[stay]
        i_all.append(np.full(len(j), i))
        j_all.append(j)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *i_all]), np.concatenate([none, *j_all])


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs reach the threshold exactly."""
    if not len(i):
        return np.zeros(0, bool)
    size = np.array([len(s) for s in sets], np.int64)
    if len(i) <= 4 * len(sets):
        shared = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    else:  # all at once: products of 0/1 rows over the shingles that are in two sets or more
        every = np.concatenate(sets)
        _, column, count = np.unique(every, return_inverse=True, return_counts=True)
        row, often = np.repeat(np.arange(len(sets)), size), count[column] > 1
        number = np.cumsum(count > 1) - 1
        row, column = row[often], number[column[often]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        total = np.zeros((len(sets), len(sets)), np.float64)
        width = 4096
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [c, c + width])
            x = np.zeros((len(sets), width), np.float32)
            x[row[a:b], column[a:b] - c] = 1
            total += x @ x.T
        shared = total[i, j].astype(np.int64)
    return shared >= threshold * (size[i] + size[j] - shared) - 1e-9


def links(sets: list[np.ndarray], sig: np.ndarray, copies: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The linked documents of each text (without its own copies), and the least linked text by chains."""
    i, j = survivors(sig, band_keys(sig), side)
    ok = verified(sets, i, j)
    i, j = i[ok], j[ok]
    n, label = np.zeros(len(sets), np.int64), np.arange(len(sets))
    np.add.at(n, i, copies[j])
    np.add.at(n, j, copies[i])
    while len(i):
        least = np.minimum(label[i], label[j])
        if (label[i] == least).all() and (label[j] == least).all():
            break
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
    return n, label


def signed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (node, t): each text's signature and its sorted distinct shingle hashes."""
    known = WordHashes()
    for batch in batches:
        if len(batch):
            shingles, begin, _ = shingle_hashes(batch.column(1).to_pylist(), known)
            sig = [x.tobytes() for x in np.ascontiguousarray(signatures(shingles, begin[:-1]))]
            sets = [np.unique(shingles[a:b]).tobytes() for a, b in zip(begin, begin[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig, pa.binary()), pa.array(sets, pa.binary())], names=["node", "sig", "shingles"])


def _blocks(group: pa.Table) -> Iterator[tuple[list[int], np.ndarray, np.ndarray | None]]:
    """The rows of each block in a task, by node; their signatures; and their pieces, if two pieces meet."""
    node, comp, piece, g = (group[c].to_pylist() for c in ("node", "component", "piece", "g"))
    sig = group["sig"].to_pylist()
    by: dict[bytes, list[int]] = {}
    for at in sorted(range(len(node)), key=node.__getitem__):
        by.setdefault(comp[at], []).append(at)
    for rows in by.values():
        meet = g[rows[0]]
        side = np.array([piece[at] for at in rows]) if meet["c"] and meet["i"] != meet["j"] else None
        yield rows, np.frombuffer(b"".join(sig[at] for at in rows), np.uint32).reshape(-1, HASHES), side


def _prune(group: pa.Table) -> pa.Table:
    """The texts of a task that are left with a pair."""
    left: list[int] = []
    for rows, sig, side in _blocks(group):
        i, j = survivors(sig, band_keys(sig), side)
        left += [rows[x] for x in np.union1d(i, j)]
    hand_back()
    meet = pa.struct([("c", pa.string()), ("i", pa.int32()), ("j", pa.int32())])
    out = group.select(["node", "g"]).take(pa.array(left, pa.int64()))
    return pa.table({"node": out["node"], "g": out["g"].cast(meet)})


def _verify(group: pa.Table) -> pa.Table:
    node, copies, sets, g = (group[c].to_pylist() for c in ("node", "copies", "shingles", "g"))
    out: list[tuple] = []
    for rows, sig, side in _blocks(group):
        n, label = links([np.frombuffer(sets[at], np.uint64) for at in rows], sig, np.array([copies[at] for at in rows], np.int64), side)
        out += [(node[at], int(k), node[rows[head]], not g[at]["c"]) for at, k, head in zip(rows, n, label) if k]
    hand_back()
    return pa.table({"node": pa.array([r[0] for r in out], pa.binary()), "n": pa.array([r[1] for r in out], pa.int64()), "head": pa.array([r[2] for r in out], pa.binary()), "last": pa.array([r[3] for r in out], pa.bool_())})


def _node(text: str):
    """A text's node; null without words."""
    return F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(F.col(text).cast("binary"))))


def nodes_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, node, n_words, keys) of each row, written; node is null without words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            shingles, begin, n = shingle_hashes(batch.column(2).to_pylist(), known)
            has = n > 0
            keys: list = [None] * len(n)
            if has.any():
                for i, row in zip(np.flatnonzero(has), band_keys(signatures(shingles, begin[:-1][has]))):
                    keys[i] = row
            node = [x if y else None for x, y in zip(batch.column(1).to_pylist(), has)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "n_words", "keys"])

    thin = docs.select(F.col(key).alias("doc_id"), _node(text).alias("node"), F.col(text).alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    return written(thin.mapInArrow(released(run), f"doc_id {kind}, node binary, n_words long, keys array<long>"), "signed")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The signed rows, and per node: copies, first (its least doc_id), head (the class's node), links."""
    spark = docs.sparkSession
    signed = nodes_of(docs, key, text)
    spread = signed.where("node IS NOT NULL").select("node", F.explode("keys").alias("k"))
    stars = spread.groupBy("k").agg(F.min("node").alias("b"), F.max("node").alias("z")).where("b < z").select("k", "b")
    edges = spread.join(stars, "k").where("node > b").select(F.col("node").alias("a"), "b")
    blocks = written(connected(edges), "blocks")
    copies = written(signed.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.first("n_words").alias("n_words")), "nodes")
    in_block = blocks.join(copies, "node")
    size = in_block.groupBy("component").agg(F.count("*").alias("m"), F.sum("n_words").alias("w"))
    pieces = F.greatest(F.ceil(F.col("m") / PIECE_TEXTS), F.ceil(F.col("w") / PIECE_WORDS)).cast("int")
    members = written(in_block.join(size.select("component", pieces.alias("pieces"), "w"), "component"), "members")
    n, words = members.agg(F.count("*"), F.sum(F.when(F.col("pieces") == 1, F.col("n_words")))).first()
    bins = 1 + (words or 0) // PIECE_WORDS
    texts = docs.select(F.col(key).alias("d"), _node(text).alias("node"), F.col(text).alias("t"))
    first = hub_join(texts, members.select("node", "copies", F.col("first").alias("f")), "node", "copies", F.xxhash64("d"), small=n <= BROADCAST_ROWS).where("d <=> f")
    # of one text, rows may also share the doc_id
    sets = written(first.select("node", "t").mapInArrow(released(signed_sets), "node binary, sig binary, shingles binary"), "sets").groupBy("node").agg(F.first("sig").alias("sig"), F.first("shingles").alias("shingles"))
    piece = F.pmod(F.xxhash64("node"), "pieces").cast("int")
    held = written(sets.join(members.select("node", "component", "copies", "pieces", piece.alias("piece")), "node"), "held")
    meets = F.when(
        F.col("pieces") > 1,
        F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda o: F.struct(F.hex("component").alias("c"), F.least("piece", o).alias("i"), F.greatest("piece", o).alias("j"))),
    ).otherwise(F.array(F.struct(F.lit("").alias("c"), F.pmod(F.xxhash64("component"), F.lit(bins)).cast("int").alias("i"), F.lit(0).alias("j"))))
    tasks = held.select("node", "component", "piece", "sig", F.explode(meets).alias("g"))
    left = written(tasks.groupBy("g").applyInArrow(_prune, "node binary, g struct<c:string,i:int,j:int>"), "left")
    tasks = left.join(held.drop("pieces"), "node")
    found = written(tasks.groupBy("g").applyInArrow(_verify, "node binary, n long, head binary, last boolean"), "links")
    number = found.groupBy("node").agg(F.sum("n").alias("links"))
    heads = found.where("last").select("node", "head")
    across = found.where("NOT last AND node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    if not across.isEmpty():
        heads = heads.unionByName(connected(across).select("node", F.col("component").alias("head")))
    per_node = copies.join(number, "node", "left").join(heads, "node", "left").select(
        "node", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("head", "node").alias("head")
    )
    return signed, written(per_node, "classes")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, class_id, n_links (other rows of similarity THRESHOLD or more, copies included)."""
    signed, nodes = classes(docs, key, text)
    ids = nodes.groupBy("head").agg(F.min("first").alias("class_id"))
    info = written(nodes.join(ids, "head").select("node", "copies", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links")), "info")
    return hub_join(signed.select("doc_id", "node"), info, "node", "copies", F.xxhash64("doc_id"), "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class: the head text's row of least doc_id. Rows without words all stay.

    Only rows of texts with copies or links meet the (small) table of such texts; the others pass by.
    """
    _, nodes = classes(docs, key, text)
    node, mark = fresh(docs, "_node"), fresh(docs, "_mark")
    marked = nodes.where("copies > 1 OR links > 0").select(F.col("node").alias(node), "copies", F.struct("first", (F.col("head") == F.col("node")).alias("head"), F.col("copies").alias("n")).alias(mark))
    at = hub_join(docs.withColumn(node, _node(text)), marked, node, "copies", F.xxhash64(F.col(key)), "left", small=marked.count() <= BROADCAST_ROWS)
    alone = at.where(F.col(mark).isNull())
    chosen = at.where(F.col(f"{mark}.head") & F.col(key).eqNullSafe(F.col(f"{mark}.first")))
    once = chosen.where(F.col(f"{mark}.n") == 1).unionByName(chosen.where(F.col(f"{mark}.n") > 1).dropDuplicates([node]))
    return alone.unionByName(once).select(*(F.col(f"`{c}`") for c in docs.columns))
