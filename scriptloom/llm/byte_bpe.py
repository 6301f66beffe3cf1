"""Byte-level BPE by backtracking from longest matches, and its decoding.

A text's matches of the vocabulary's pattern are encoded one by one. Their bytes, as Latin-1 signs, run through an
Aho-Corasick automaton of all tokens: the longest token at a place is tried first, then the longest shorter one that
begins it. A token may follow another if the merges leave the two together as they are; this is found once for
each pair and kept. A sequence whose neighbours all may stand together is the one that the merges give, and each prefix
has one such sequence at most, so a place that was given up is never tried again: the time is linear in the bytes, for a
bounded token length. A match that is a token itself gives that token, as the rank files' library does it.

Only a worker's memory holds anything beside the texts of a batch: the automaton, and what is known of units, matches and pairs,
each bounded by KEPT. Null and empty texts have no ids. Very long texts and matches take time and memory in proportion.
Special tokens do not exist here: their strings are ordinary text. Repeated rows and ties are encoded row by row, an empty
table gives an empty one. All columns stay; the new ones get underscores where their names are taken. Ids beyond the
vocabulary can't be decoded and raise; null ids of a row decode to null.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import units
from .base import fresh, small_batches, table, walked

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Units, matches and pairs that a worker keeps, of each; then it starts again with none.
KEPT = 600_000
NEVER = 1 << 62


def vocabulary(path: str) -> dict[bytes, int]:
    """Ranks from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Pairs(dict):
    """Whether the merges leave token b after token a as they are, by a << 32 | b."""

    def __init__(self, rank: dict[str, int], token: dict[int, str]):
        self.rank, self.token, self.edges = rank, token, ({}, {})

    def merged(self, signs: str, seen=lambda parts: None) -> list[str]:
        """The merges as they are defined: the neighbours that give the lowest rank join first, the leftmost of equals."""
        parts, rank = list(signs), self.rank.get
        while len(parts) > 1:
            best, i = min((rank(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            seen(parts)
        return parts

    def edge(self, token: str, last: bool) -> list[tuple[str, int]] | None:
        """The parts that stand at a token's last (or first) place one after the other while it is merged, each with the
        rank of the next; None if the ranks don't rise, or the merges give another sequence."""
        known = self.edges[last]
        if token not in known:
            parts = [token[-1 if last else 0]]
            whole = self.merged(token, lambda x: parts.append(x[-1 if last else 0]))
            parts = list(dict.fromkeys(parts))
            ends = [*(self.rank[p] for p in parts[1:]), NEVER]
            known[token] = [*zip(parts, ends)] if whole == [token] and sorted(set(ends)) == ends else None
        return known[token]

    def __missing__(self, key: int) -> bool:
        if len(self) > KEPT:
            self.clear()
        a, b = self.token[key >> 32], self.token[key & 0xFFFFFFFF]
        left, right = self.edge(a, True), self.edge(b, False)
        if left is None or right is None:
            fits = self.merged(a + b) == [a, b]
        else:
            # they stay apart unless a merge across comes before both parts beside the border are merged further
            i = j = 0
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                across = self.rank.get(x + y, NEVER)
                if fits := not (across < x_ends and across <= y_ends):
                    if x_ends == y_ends == NEVER:
                        break
                    i, j = (i + 1, j) if x_ends <= y_ends else (i, j + 1)
                else:
                    break
        self[key] = fits
        return fits


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.rank = {t.decode("latin-1"): r for t, r in ranks.items()}
        if any(chr(i) not in self.rank for i in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.token = {r: t for t, r in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.automaton.add_word(t, r)
        self.automaton.make_automaton()
        self.longest = max(map(len, self.rank))
        self.pairs, self.shorter = Pairs(self.rank, self.token), {}
        self.matches, self.known, self.kept = regex.compile(pattern).findall, {"": b""}, {}
        top = max(self.token) + 1
        self.length = [len(self.token.get(i, "")) for i in range(top)]
        self.size = np.array(self.length, np.int32)
        self.pool = np.frombuffer("".join(self.token.get(i, "") for i in range(top)).encode("latin-1"), np.uint8)

    def less(self, r: int) -> int:
        """The longest token that begins a token and is shorter; -1 if none."""
        less = self.shorter.get(r)
        if less is None:
            t = self.token[r]
            less = self.shorter[r] = next((self.rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.rank), -1)
        return less

    def match(self, signs: str) -> list[int]:
        """Ids of one match of the pattern, its bytes as Latin-1."""
        whole = self.rank.get(signs)
        if whole is not None:
            return [whole]
        pairs, length, longest, find, n = self.pairs, self.length, self.longest, self.automaton.iter_long, len(signs)
        out, at, before, given_up, r = [], 0, -1, set(), -1
        while at < n:
            if r < 0:  # the longest token here
                r = next(find(signs[at : at + longest]))[1]
            end = at + length[r]
            if end not in given_up and (before < 0 or pairs[before << 32 | r]):
                out.append(r)
                at, before, r = end, r, -1
                continue
            r = self.less(r)
            while r < 0:  # nothing fits here: the token before is shortened
                if not out:
                    raise ValueError("no sequence of tokens fits")
                given_up.add(at)
                at -= length[before]
                r = self.less(out.pop())
                before = out[-1] if out else -1
        return out

    def unit(self, text: str) -> bytes:
        """Ids of a text, as 32-bit integers."""
        out = []
        for m in self.matches(text):
            ids = self.kept.get(m)
            if ids is None:
                if len(self.kept) > KEPT:
                    self.kept.clear()
                ids = self.kept[m] = array("i", self.match(m.encode().decode("latin-1"))).tobytes()
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: pa.Array) -> pa.Array:
        kind, size, distinct = units.split(texts)
        if len(self.known) > KEPT:
            self.known = {"": b""}
        known, ids = self.known, []
        for u in distinct:
            x = known.get(u)
            if x is None:
                x = known[u] = self.unit(u)
            ids.append(x)
        many = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        ends = np.concatenate([[0], np.cumsum(many[kind], dtype=np.int64)])[np.concatenate([[0], np.cumsum(size)])]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(walked(np.frombuffer(b"".join(ids), np.int32), many, kind)))

    def decode(self, ids: pa.Array) -> pa.Array:
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        if len(flat) and (flat.dtype.kind not in "iu" or flat.min() < 0 or flat.max() >= len(self.size) or not self.size[flat].all()):
            raise ValueError("an id is not in the vocabulary")
        null = ids.is_null().to_numpy(zero_copy_only=False)
        many = np.where(null, 0, np.diff(ids.offsets.to_numpy()))
        ends = np.concatenate([[0], np.cumsum(self.size[flat], dtype=np.int64)])[np.concatenate([[0], np.cumsum(many)])]
        out = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(walked(self.pool, self.size, flat))])
        return pc.if_else(pa.array(null), None, out)


@lru_cache(1)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker."""
    return Encoder(vocabulary(path), pattern)


def _settings(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers as own

    return path or own.path(VOCABULARY), pattern or own.PATTERN


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> tuple[DataFrame, str]:
    """docs with the ids of their texts, an array of integers, and the new column's name."""
    small_batches(docs.sparkSession)
    where, name = _settings(path, pattern), fresh(docs, "ids")

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return encoder(*where).encode(texts)

    return docs.withColumn(name, ids.asNondeterministic()(F.col(f"`{text}`").cast("string"))), name  # so that it runs once


def decode(docs: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None) -> tuple[DataFrame, str]:
    """docs with the bytes that the ids stand for, and the new column's name."""
    small_batches(docs.sparkSession)
    where, name = _settings(path, pattern), fresh(docs, "decoded")

    @F.arrow_udf("binary")
    def decoded(x: pa.Array) -> pa.Array:
        return encoder(*where).decode(x)

    return docs.withColumn(name, decoded.asNondeterministic()(F.col(f"`{ids}`").cast("array<int>"))), name


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back, decoded = decode(coded.drop("text"), ids)
    return back.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col(ids).cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    )
