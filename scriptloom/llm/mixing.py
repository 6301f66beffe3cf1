"""Mixing sources to target weights by Sainte-Lague apportionment of equal-word blocks.

Targets: sources share SHARE of all words by weight, none beyond CAP times its own words; what a capped source
leaves is shared again by weight among the others until none is above.

A source's documents stand in a seeded order, cut into blocks of BLOCK words as one stream (the last may be short). Its blocks
are picked in a seeded order, each once before any is picked again, until the target is reached, to the word: the last
pick is cut there. So a source takes its target's words however small it is, and no block's length depends on any source.
Picks go to shards by highest quotients target / (2k + 1), a source leaving when it has its picks: shard j holds the picks
of ranks between its bounds in this one order, which gives it integer quotas per source. The first shard's quota takes a
source's first picks, the next shard's the following ones. How many words of a document are taken, and for which shards, follows
from its place in the stream alone.

Null texts and texts without words have size 0 and are taken 0 times. A null source is a source of its own, last in
order. Repeated rows stand in the stream one by one. An empty table, or one without words, gives targets of 0. A source's
taken words are its target, rounded. A row of numbers per source is on the driver, where plans are made in numpy, and comes
back by a join that spreads large sources. Columns of docs are carried along; clashing names get underscores.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import WORD, buckets, fresh, hub_join, running_sum, table, written

WEIGHTS, SHARE, CAP, SEED, SHARDS = (5, 2, 1), 1.5, 2, 20240611, 40
#: Words in a block.
BLOCK = 4096


def targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Words to take of each source."""
    size, weight = np.asarray(sizes, np.float64), np.asarray(weights, np.float64)
    out, open_, left = np.zeros(len(size)), np.ones(len(size), bool), share * math.fsum(sizes)
    while open_.any():
        part = left * weight / weight[open_].sum()
        above = open_ & (part > cap * size)
        if not above.any():
            out[open_] = part[open_]
            break
        out[above] = cap * size[above]
        left -= math.fsum(out[above])
        open_ &= ~above
    return out.tolist()


def quotas(goal: list[float], seats: int, most: list[int]) -> np.ndarray:
    """Sainte-Lague: the seats that the `seats` highest quotients goal / (2k + 1) give, none more than `most` of its own; ties go to
    the first.

    The lowest quotient that wins is enclosed by halving; what lies above is counted, the few in between are ranked.
    """
    g, most = np.asarray(goal, np.float64), np.asarray(most, np.int64)
    if seats >= most.sum():
        return most
    if seats <= 0:
        return np.zeros(len(g), np.int64)

    def above(limit: float) -> np.ndarray:
        """How many quotients of each source are limit or more."""
        n = np.maximum(0, np.floor((g / limit + 1) / 2))
        n += g / (2 * n + 1) >= limit  # the quotients as they are rounded decide
        return np.minimum(most, (n - ((n > 0) & (g / np.maximum(1, 2 * n - 1) < limit))).astype(np.int64))

    some = most > 0
    low, high = float((g[some] / (2 * most[some])).min()) / 2, float(g.max()) * 2
    while (middle := (low + high) / 2) not in (low, high):
        low, high = (middle, high) if above(middle).sum() > seats else (low, middle)
    won = above(high)
    while (rest := seats - int(won.sum())) > 0:  # once: what is left lies between neighbouring numbers, a quotient of each source
        tied = np.flatnonzero(above(low) > won)
        first = np.lexsort((tied, -g[tied] / (2 * won[tied] + 1)))[:rest]
        won[tied[first]] += 1
    return won


def order_of(blocks: int, rank: int, seed: int) -> tuple[int, int]:
    """A seeded order of a source's blocks: block b is pick number (factor * b + shift) mod blocks."""
    drawn = int.from_bytes(hashlib.blake2b(f"{seed} {rank}".encode(), digest_size=16).digest(), "little")
    factor, shift = 1 + drawn % (1 << 20), (drawn >> 64) % max(1, blocks)
    while math.gcd(factor, max(1, blocks)) > 1:
        factor += 1
    return factor, shift


def picks(words: int, take: int, block: int, factor: int, shift: int) -> tuple[int, int]:
    """How many picks reach `take` words, and how many words the last of them gives."""
    if not take:
        return 0, 0
    blocks = -(-words // block)
    short = blocks * block - words  # words that the last block lacks
    passes, rest = divmod(take - 1, words)
    rest += 1
    at = (factor * (blocks - 1) + shift) % blocks
    n = -(-rest // block)
    if at < n:
        n = -(-(rest + short) // block)
    return passes * blocks + n, rest - ((n - 1) * block - (short if at < n - 1 else 0))


def plan(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> list[dict]:
    """A row per source, by code point with null last: its target, its picks and how many of them come before each shard's end."""
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    words = [n for _, n in order]
    goal = targets(words, [weights[i % len(weights)] for i in range(len(words))], share, cap)
    rows = []
    for i, (s, n) in enumerate(order):
        blocks = -(-n // block)
        factor, shift = order_of(blocks, i, seed)
        quota, cut = picks(n, min(cap * n, math.floor(goal[i] + 0.5)), block, factor, shift)
        rows.append({"rank": i, "source": s, "words": n, "target": goal[i], "blocks": blocks, "quota": quota, "cut": cut, "factor": factor, "shift": shift})
    most = [r["quota"] for r in rows]
    ends = [quotas(goal, sum(most) * (j + 1) // shards, most).tolist() for j in range(shards)]
    for r, own in zip(rows, zip(*ends)):
        r["ends"] = list(own)
    return rows


def n_words(text: str):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def mix(docs: DataFrame, source: str = "source", text: str = "text", seed: int = SEED, by: tuple[str, ...] = ("doc_id",), keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """keep (all columns of docs) with size, source_size, target, taken, and the pieces taken: pass (0 the first time a
    block is picked), first and last word, shard; and those columns' names. `by` and a hash of the text fix the seeded order."""
    spark, keep = docs.sparkSession, docs.columns if keep is None else keep
    names, wide = {}, docs
    for name in ("size", "source_size", "target", "taken", "pieces"):
        names[name] = fresh(wide, name)
        wide = wide.withColumn(names[name], F.lit(None))
    # under neutral names from here on; words are counted once, unless that would write the texts again
    thin = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(source).alias("of"), n_words(text).alias("size"), F.struct(*by, F.xxhash64(text)).alias("tie"))
    sized = thin.withColumn("key", F.xxhash64(F.lit(seed), "tie"))
    sized = sized if text in keep else written(sized, "sized")
    per_source = sized.groupBy("of").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    planned, n_rows = plan([(r[0], r[1]) for r in per_source], seed=seed), sum(r["rows"] for r in per_source)
    many = {r["of"]: r["rows"] for r in per_source}
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))  # noqa: E731  # null is a source, too
    columns = ("source", "rank", "words", "target", "blocks", "quota", "cut", "factor", "shift", "ends")
    small = spark.createDataFrame([(*(r[c] for c in columns), many[r["source"]]) for r in planned], "source string, rank int, words long, target double, blocks long, quota long, cut long, factor long, shift long, ends array<long>, rows long")
    small = small.withColumn("source", key(F.col("source")))
    at = hub_join(sized.withColumn("source", key(F.col("of"))), small, "source", "rows", F.xxhash64("key", "tie"), total=n_rows)
    at = running_sum(at, "rank", ["key", "tie"], F.shiftright("key", 64 - max(6, (buckets(n_rows) - 1).bit_length())), F.col("size"), "before")
    first, end, block, blocks = F.col("before"), F.col("before") + F.col("size"), F.lit(BLOCK).cast("long"), F.col("blocks")
    whole = lambda x, y: F.floor(x / y).cast("long")

    def taken(b):
        """The picks of block b, as pieces of this document."""
        pick = F.pmod(F.col("factor") * b + F.col("shift"), blocks)
        number = lambda p: pick + p * blocks
        passes = F.filter(F.sequence(F.lit(0), F.lit(CAP - 1)), lambda p: number(p) < F.col("quota"))
        shard = lambda p: F.size(F.filter("ends", lambda e: e <= number(p)))
        stop = lambda p: b * block + F.when(number(p) == F.col("quota") - 1, F.col("cut")).otherwise(block)
        return F.filter(F.transform(passes, lambda p: F.struct(
            p.alias("pass"), (F.greatest(b * block, first) - first).alias("first"), (F.least(stop(p), end) - first).alias("last"), shard(p).alias("shard")
        )), lambda x: x["first"] < x["last"])

    none = F.array().cast("array<struct<pass:int,first:bigint,last:bigint,shard:int>>")
    pieces = F.when(F.col("size") > 0, F.flatten(F.transform(F.sequence(whole(first, block), whole(end - 1, block)), taken))).otherwise(none)
    at = at.withColumn("pieces", pieces)
    total = F.aggregate("pieces", F.lit(0).cast("long"), lambda acc, x: acc + x.last - x.first)
    return at.select(
        *(F.col(f"row.`{c}`").alias(c) for c in keep), F.col("size").alias(names["size"]), F.col("words").alias(names["source_size"]),
        F.col("target").alias(names["target"]), total.alias(names["taken"]), F.col("pieces").alias(names["pieces"]),
    ), names


def mixed_rows(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself, with the columns of docs: a row for each run of words that a pass takes, whatever their shards; the text of a
    run runs from its first word's start to its last word's end, and n_chars follows it."""
    at, n = mix(docs, source, text)
    part = fresh(at, "_part")

    def runs(p):
        """Pieces of pass p that follow each other directly, joined."""
        of = F.filter(n["pieces"], lambda x: x["pass"] == p)
        return F.element_at(F.transform(F.array(of), lambda f: F.zip_with(
            F.filter(f, lambda x, i: (i == 0) | (F.get(f, i - 1)["last"] != x["first"])), F.filter(f, lambda x, i: (i == F.size(f) - 1) | (F.get(f, i + 1)["first"] != x["last"])),
            lambda x, y: F.struct(x["first"].alias("first"), y["last"].alias("last")),
        )), 1)

    pieces = at.withColumn(part, F.explode(F.concat(*(runs(p) for p in range(CAP)))))
    first, last = F.col(f"{part}.first"), F.col(f"{part}.last")
    gap = r"[\x20\x09-\x0D]+"
    cut = F.when((first == 0) & (last == F.col(n["size"])), F.col(text)).otherwise(
        F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(f"{WORD}(?:{gap})?"), F.lit(0)), (first + 1).cast("int"), (last - first).cast("int")), "")
    )
    out = pieces.withColumn(text, cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the columns agreed on: the shards of the mix that take words of the document, and how many words each takes."""
    out, n = mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    by_shard = F.transform(n["pieces"], lambda x: F.struct(x["shard"].alias("shard"), (x["last"] - x["first"]).alias("words")))
    return out.select("doc_id", *(F.col(n[c]).alias(c) for c in ("size", "source_size", "target", "taken")), by_shard.alias("shards"))
