"""Source divergence audit: how far the word use of sources lies apart, exactly, in integers.

Terms are runs of letters (ASCII letters, of which A-Z are lower-cased, and any sign beyond ASCII). A language keeps its
terms that are in LEAST of its documents or more, V of them. A group is a language's source; N is its sum of kept terms'
counts. Its share of a term with count c is p = 1 + floor(SCALE * (c + 1) / (N + V)), and p lies floor((p - q)^2 / q) from q.

* pairs: for two groups of a language, the sum of distances over all kept terms;
* terms: for a group, its terms of higher share than in the whole language, the TOP most distant ones.

Heavy-light split. Terms are dealt to chunks by their hash, and a chunk gives partial sums for all pairs of groups, which
are added. A heavy term, one that over half of the language's groups have, goes through dense tiles: all groups' shares of
a block of terms against each other. For light terms every pair starts from the distance of the two shares of a term
that neither has, times their number. Postings then correct it: what one group's count changes against a share of count
0 follows from how often each count occurs; and where two groups of a posting list meet, the two one-sided
corrections give way to the true distance. All sums are of integers, so the split changes nothing.

Tasks: words are counted per (language, source, term) before the shuffle and after it. A chunk has about CHUNK_ROWS
counts; groups are cut into tiles of TILE by hash, and each pair of tiles is a task of its own for each chunk. One
term's counts, one for each of the language's sources, lie in one chunk; the result has the square of that number of rows.

Null text, language or source count as "". Groups without kept terms take part; a language without kept terms gives pairs
of value 0. Repeated rows are documents of their own. Ties in rank go by item. An empty table gives an empty one. Very long
texts take memory in proportion to themselves. Other columns are not read. Sums stay below 2^63 while V is below 2e9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import released, small_batches, table, together, written

LEAST, SCALE, TOP = 3, 1_000_000_000, 200
#: Text counted at once; rows of counts in a chunk; groups in a tile; numbers in a numpy block.
TOGETHER, CHUNK_ROWS, TILE, CELLS = 16 << 20, 250_000, 512, 1 << 21
#: Bytes that end a term become spaces, A-Z lower case.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i > 127 else 32 for i in range(256))


def terms(texts: pa.Array) -> pa.ListArray:
    """The terms of each text, with empty strings among them."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    folded = pa.py_buffer((data.to_pybytes() if data else b"").translate(_FOLD))
    return pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), offsets, folded, offset=texts.offset))


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it)."""
    small_batches(docs.sparkSession)
    thin = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(x) for c, x in ((lang, "lang"), (source, "source"), (text, "text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches, TOGETHER):
            of, number = [], {}
            for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                of.append(number.setdefault(pair, len(number)))
            split = terms(batch.column(2))
            size = np.diff(split.offsets.to_numpy())
            words = split.flatten().dictionary_encode()
            code, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
            k = max(1, len(names))
            each, n = np.unique(np.repeat(np.arange(len(size)), size) * k + code, return_counts=True)
            key = np.array(of, np.int64)[each // k] * k + each % k
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            if not len(first):
                continue
            group, term = np.divmod(key[first], k)
            pairs = list(number)
            cols = [pa.array([p[i] for p in pairs], pa.string()).take(pa.array(group)) for i in (0, 1)]
            out = pa.RecordBatch.from_arrays(
                [*cols, names.take(pa.array(term)), pa.array(np.add.reduceat(n, first)), pa.array(np.diff(first, append=len(key)))], names=["lang", "source", "term", "n", "docs"]
            )
            yield out.filter(pc.not_equal(out.column(2), ""))

    partial = thin.mapInArrow(released(run), "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


PACKED = "chunk int, lang string, terms array<string>, sources array<string>, sums array<long>, term array<int>, source array<int>, n array<long>"


def _pack(rows: pa.Table) -> pa.Table:
    """A chunk's counts: for each language the kept terms in order, and their postings."""
    out = []
    rows = rows.combine_chunks()
    langs = rows["lang"].combine_chunks().dictionary_encode()
    names, at = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
    for i, lang in enumerate(names):
        own = rows.filter(pa.array(at == i))
        term, source = (own[c].combine_chunks().dictionary_encode() for c in ("term", "source"))
        t, s = (x.indices.to_numpy(zero_copy_only=False) for x in (term, source))
        kept = np.bincount(t, own["docs"].to_numpy(), len(term.dictionary)) >= LEAST
        words = term.dictionary.to_pylist()
        order = sorted(np.flatnonzero(kept).tolist(), key=words.__getitem__)  # code points stand as their UTF-8 does
        if not order:
            continue
        place = np.full(len(words), -1, np.int32)
        place[order] = np.arange(len(order))
        stay = np.flatnonzero(place[t] >= 0)
        stay = stay[np.argsort(place[t[stay]], kind="stable")]
        n = own["n"].to_numpy()[stay]
        sums = np.zeros(len(source.dictionary), np.int64)
        np.add.at(sums, s[stay], n)
        out.append((rows["chunk"][0].as_py(), lang, [words[j] for j in order], source.dictionary.to_pylist(), sums.tolist(), place[t[stay]], s[stay], n))
    kinds = [pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = [x.split()[0] for x in PACKED.split(", ")]
    return pa.table([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], names=names)


def share(c: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(SCALE * (c + 1) / (n + v)), without a product beyond 2^63."""
    over, rest = np.asarray(n + v, np.int64), np.asarray(c + 1, np.int64)
    if int(rest.max(initial=0)) < (1 << 63) // SCALE:
        return 1 + SCALE * rest // over
    out, rest = np.divmod(rest, over)
    for _ in range(3):  # three digits at a time
        more, rest = np.divmod(rest * 1000, over)
        out = out * 1000 + more
    return 1 + out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def pair_sums(term, a, ca, b, cb, heavy: np.ndarray, na, nb, v: int) -> np.ndarray:
    """Sums of distances of each group of tile A from each of tile B over a chunk's terms.

    term: for the postings of tile A and of tile B, two arrays in ascending order; a, b: their groups' places in the tiles;
    ca, cb: their counts; heavy: of each term; na, nb: the groups' N.
    """
    ta, tb = term
    out = np.zeros((len(na), len(nb)), np.int64)
    # heavy terms: dense tiles
    dense, many = np.flatnonzero(heavy), max(1, CELLS // max(1, len(na) * len(nb)))
    for i in range(0, len(dense), many):
        block = dense[i : i + many]
        sides = []
        for t, g, c, n in ((ta, a, ca, na), (tb, b, cb, nb)):
            low, high = np.searchsorted(t, [block[0], block[-1] + 1])
            at = np.searchsorted(block, t[low:high])
            own = block[np.minimum(at, len(block) - 1)] == t[low:high]
            cells = np.zeros((len(block), len(n)), np.int64)
            cells[at[own], g[low:high][own]] = c[low:high][own]
            sides.append(share(cells, n[None, :], v))
        out += distance(sides[0][:, :, None], sides[1][:, None, :]).sum(0)
    # light terms: all as if no group had them, then corrections
    zero_a, zero_b = share(np.zeros(len(na), np.int64), na, v), share(np.zeros(len(nb), np.int64), nb, v)
    base = distance(zero_a[:, None], zero_b[None, :])
    out += int((~heavy).sum()) * base
    la, lb = ~heavy[ta], ~heavy[tb]
    ta, a, ca, tb, b, cb = ta[la], a[la], ca[la], tb[lb], b[lb], cb[lb]
    for g, c, n, add in ((a, ca, na, True), (b, cb, nb, False)):
        kinds, times = np.unique(np.stack([g, c]), axis=1, return_counts=True) if len(g) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
        many = max(1, CELLS // max(1, len(nb if add else na)))
        for i in range(0, kinds.shape[1], many):
            g_, c_, t_ = kinds[0, i : i + many], kinds[1, i : i + many], times[i : i + many, None]
            p = share(c_, n[g_], v)[:, None]
            if add:
                np.add.at(out, g_, t_ * (distance(p, zero_b[None, :]) - base[g_]))
            else:
                np.add.at(out.T, g_, t_ * (distance(zero_a[None, :], p) - base.T[g_]))
    # where a term's postings in A and in B meet
    first, last = np.searchsorted(tb, ta, "left"), np.searchsorted(tb, ta, "right")
    meets = last - first
    pa_, pb_ = share(ca, na[a], v), share(cb, nb[b], v)
    ends = np.cumsum(meets)
    start = 0
    while start < len(ta):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CELLS, "right")))
        times = meets[start:stop]
        x = np.repeat(np.arange(start, stop), times)
        y = np.arange(len(x)) - np.repeat(np.cumsum(times) - times, times) + first[x]
        p, q, g, s = pa_[x], pb_[y], a[x], b[y]
        np.add.at(out, (g, s), distance(p, q) - distance(p, zero_b[s]) - distance(zero_a[g], q) + base[g, s])
        start = stop
    return out


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of a chunk for a pair of tiles; of the tile with itself also the chunk's TOP terms of each group."""
    for batch in batches:
        for r in batch.to_pylist():
            sides = []
            term, of, n = np.array(r["term"], np.int64), np.array(r["source"], np.int64), np.array(r["n"], np.int64)
            for side in (r["a"], r["b"]):
                place = {s["source"]: i for i, s in enumerate(side)}
                at = np.array([place.get(s, -1) for s in r["sources"]], np.int64)[of]
                own = at >= 0
                sides.append((term[own], at[own], n[own], np.array([s["n"] for s in side], np.int64)))
            (ta, a, ca, na), (tb, b, cb, nb) = sides
            heavy = 2 * np.bincount(term, minlength=len(r["terms"])) > r["groups"]
            sums = pair_sums((ta, tb), a, ca, b, cb, heavy, na, nb, r["v"])
            names_a, names_b = [s["source"] for s in r["a"]], [s["source"] for s in r["b"]]
            x, y = (i.ravel() for i in np.indices(sums.shape))
            own = ~np.equal.outer(np.array(names_a, object), np.array(names_b, object)).ravel()
            rows = [(np.array(names_a, object)[x[own]], np.array(names_b, object)[y[own]], sums.ravel()[own], "pair")]
            if r["i"] == r["j"]:
                all_n = np.zeros(len(r["terms"]), np.int64)
                np.add.at(all_n, term, n)
                p, q = share(ca, na[a], r["v"]), share(all_n, np.int64(r["all"]), r["v"])[ta]
                up = np.flatnonzero(p > q)
                far = distance(p[up], q[up])
                order = np.lexsort((ta[up], -far, a[up]))
                g = a[up][order]
                rank = np.arange(len(g)) - np.searchsorted(g, g)
                top = order[rank < TOP]
                rows.append((np.array(names_a, object)[a[up][top]], np.array(r["terms"], object)[ta[up][top]], far[top], "term"))
            for group, item, value, part in rows:
                m = len(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["lang"]] * m, pa.string()), pa.array(group, pa.string()), pa.array([part] * m, pa.string()), pa.array(item, pa.string()), pa.array(value)],
                    names=["lang", "source", "part", "item", "value"],
                )


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part ("pair" or "term"), item (the other source, or a term), value, rank."""
    spark = docs.sparkSession
    small_batches(spark)
    counted = written(counts(docs, text, lang, source), "term-counts")
    n_chunks = max(1, -(-counted.count() // CHUNK_ROWS))
    chunked = counted.withColumn("chunk", F.pmod(F.xxhash64("lang", "term"), F.lit(n_chunks)).cast("int"))
    packed = written(chunked.groupBy("chunk").applyInArrow(_pack, PACKED), "term-postings")
    sums = packed.select("lang", F.explode(F.arrays_zip(F.col("sources").alias("source"), F.col("sums").alias("n"))).alias("x"))
    sums = sums.groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    every = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(x) for c, x in ((lang, "lang"), (source, "source")))).distinct()
    groups = every.join(sums, ["lang", "source"], "left").na.fill(0, ["n"])
    sizes = groups.groupBy("lang").agg(F.count("*").alias("groups"), F.sum("n").alias("all"))
    sizes = sizes.join(packed.groupBy("lang").agg(F.sum(F.size("terms")).alias("v")), "lang", "left").na.fill(0, ["v"])
    tile = F.pmod(F.xxhash64("source"), F.ceil(F.col("groups") / TILE)).cast("int")
    tiles = groups.join(sizes, "lang").withColumn("tile", tile).groupBy("lang", "groups", "all", "v", "tile").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("x"))
    a = tiles.select("lang", "groups", "all", "v", F.col("tile").alias("i"), F.col("x").alias("a"))
    meeting = written(a.join(tiles.select("lang", F.col("tile").alias("j"), F.col("x").alias("b")), "lang"), "tiles")
    # a chunk's postings meet their language's tiles: both sides are dealt by chunk, so no task has a whole language
    dealt = meeting.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)).cast("array<int>")))
    schema = "lang string, source string, part string, item string, value long"
    found = written(dealt.join(packed, ["lang", "chunk"]).mapInArrow(released(_audit), schema), "distances")
    none = meeting.select("lang", F.explode("a").alias("a"), "b").select("lang", F.col("a.source").alias("source"), F.explode("b.source").alias("item"))
    none = none.where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = found.where("part = 'pair'").unionByName(none).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # each chunk gives its TOP terms of a group; they are ranked in about as many buckets as there are chunks in a bucket
    best = [F.desc("value"), "item"]
    buckets = F.pmod(F.xxhash64("item"), F.lit(max(1, int(n_chunks**0.5))))
    few = found.where("part = 'term'").withColumn("bucket", buckets)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "bucket").orderBy(*best))).where(F.col("rank") <= TOP)
    w = Window.partitionBy("lang", "source", "part").orderBy(*best)
    ranked = pairs.unionByName(few.drop("bucket", "rank")).withColumn("rank", F.row_number().over(w))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), w AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
gc AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(gc.c), 0) AS n FROM g LEFT JOIN gc USING (lang, source) GROUP BY ALL),
p AS (
    SELECT gn.lang, gn.source, k.term, coalesce(gc.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(gc.c, 0) + 1)) // (gn.n + v.v) AS p,
        1 + (1000000000::HUGEINT * (k.c + 1)) // (v.n + v.v) AS q
    FROM gn JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN gc ON gc.lang = gn.lang AND gc.source = gn.source AND gc.term = k.term
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= 200
"""
