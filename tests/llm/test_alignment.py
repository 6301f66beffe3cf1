"""Operators 11 to 13 against plain versions: nulls, empty and long texts, odd white space, ties, repeated rows, empty tables, clashing names."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from scriptloom.llm import byte_bpe, cross_tokens, divergence, units

rng = random.Random(11)
ODD = ["a  b\n c", " lead", "trail ", "\n", " ", "  ", "x\r\ny\r\n", "tab\tand\x0bothers\x0c\x1c \x85\xa0　z", "no\nspace\n\nhere\n", "▁ mark▁s", "<s> </s> <|endoftext|> <0x41>", "ﬁ É ß 中文字符 🙂", "'s 't don't I'LL we're", "\x00 nul"]
WORDS = ["".join(rng.choices("abcdefghijklmnoprstuvwz", k=rng.randint(1, 9))) for _ in range(200)]
PROSE = [" ".join(rng.choices(WORDS, k=n)) + ".\n" + " ".join(rng.choices(WORDS, k=9)).title() for n in (3, 40, 200)]
LONG = ["x" * 40_000, "中" * 3_000, "-" * 20_000 + " " * 5_000 + "=" * 300, "".join(rng.choices("0123456789abcdef", k=20_000)), " ".join(rng.choices(WORDS, k=20_000))]
TEXTS = [None, "", *ODD, *PROSE, PROSE[1], PROSE[1], *LONG]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (5, "again"), (5, "again")]
KIND = "doc_id long, text string"


def noise():
    kind = rng.randrange(4)
    if kind == 0:
        return "".join(rng.choices("ab \n\t\r'st09-=_", k=rng.randint(0, 60)))
    if kind == 1:
        return "".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(32, 127), 0xA0, 0x2003, 0x85, 0x1C, 0x1F600])) for _ in range(rng.randint(0, 40)))
    if kind == 2:
        return rng.choice("ax-= 0\n中é") * rng.randint(1, 400)
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 200)))


NOISE = [noise() for _ in range(3000)]


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.encoder(*byte_bpe._settings(None, None))


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = byte_bpe.vocabulary(public_tokenizers.path(byte_bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_units_give_the_text_back():
    texts = [t or "" for t in TEXTS] + NOISE
    code, size, distinct = units.split(pa.array(texts))
    ends = np.cumsum(size)
    assert ["".join(distinct[i] for i in code[e - n : e]) for e, n in zip(ends, size)] == texts
    assert all("".join(units.found(t)) == t for t in texts)


def test_byte_bpe_as_the_library(coder, library):
    texts = [t or "" for t in TEXTS] + NOISE
    for other in (None, "byte_bpe_multi_50k.tiktoken"):
        if other:
            import tiktoken

            ranks = byte_bpe.vocabulary(public_tokenizers.path(other))
            coder, library = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        ids = coder.encode(pa.array(texts))
        assert ids.to_pylist() == library.encode_ordinary_batch(texts)
        assert [b.decode() for b in coder.decode(ids).to_pylist()] == texts


def test_pairs_fit_as_the_merges_say(coder):
    pairs, ids = byte_bpe.Pairs(coder.rank, coder.token), list(coder.token)
    for _ in range(20_000):
        a, b = rng.choice(ids), rng.choice(ids)
        word = coder.token[rng.choice(ids)]
        k = rng.randint(0, len(word))
        if rng.random() < 0.5 and word[:k] in coder.rank and word[k:] in coder.rank:
            a, b = coder.rank[word[:k]], coder.rank[word[k:]]
        assert pairs[a << 32 | b] == (pairs.merged(coder.token[a] + coder.token[b]) == [coder.token[a], coder.token[b]])


def test_byte_bpe_rows(spark, library):
    docs = spark.createDataFrame(ROWS, KIND).repartition(3).withColumn("ids", F.lit("mine")).withColumn("decoded", F.lit(1))
    coded, ids = byte_bpe.encode(docs)
    back, bytes_ = byte_bpe.decode(coded, ids)
    assert ids == "ids_" and bytes_ == "decoded_" and back.columns == ["doc_id", "text", "ids", "decoded", "ids_", "decoded_"]
    got = sorted((r["doc_id"] or -1, r["text"] or "", r[ids], r[bytes_].decode(), r["ids"], r["decoded"]) for r in back.collect())
    assert got == sorted((i or -1, t or "", library.encode_ordinary(t or ""), t or "", "mine", 1) for i, t in ROWS)
    assert byte_bpe.encode(spark.createDataFrame([], KIND))[0].count() == 0
    lists = spark.createDataFrame([(None,), ([],), ([0, 1],)], "ids array<int>")
    assert sorted((r[0] is None, bytes(r[0] or b"")) for r in byte_bpe.decode(lists)[0].select("decoded").collect()) == [(False, b""), (False, b'!"'), (True, b"")]
    with pytest.raises(Exception, match="vocabulary"):
        byte_bpe.decode(spark.createDataFrame([([99_999],)], "ids array<int>"))[0].collect()


def plain_alignment(rows):
    """Documents' results from whole texts, and the number of documents of each pair."""
    both = cross_tokens.tokenizers(*(public_tokenizers.path(n) for n in (cross_tokens.BYTES, cross_tokens.PIECES)))
    count, parts = Counter(), []
    for key, text in rows:
        spaced = (" " + (text or "")).encode()
        a, b = both.a.encode(spaced.decode(), add_special_tokens=False).ids, both.b.encode(text or "")
        cuts = [[0, *itertools.accumulate(len(table[i]) for i in ids)] for table, ids in ((both.a_bytes, a), (both.b_bytes, b))]
        if not text or any(b"".join(table[i] for i in ids) != spaced for table, ids in ((both.a_bytes, a), (both.b_bytes, b))):
            parts.append((key, 0, 0, "", []))
            continue
        ends, groups, x, y = sorted(set(cuts[0]) & set(cuts[1]))[1:], [], 0, 0
        for e in ends:
            x_, y_ = cuts[0].index(e), cuts[1].index(e)
            groups.append(",".join(map(str, a[x:x_])) + "|" + ",".join(map(str, b[y:y_])))
            x, y = x_, y_
        links, y = [], 0
        for x in range(len(a)):
            while cuts[1][y + 1] <= cuts[0][x]:
                y += 1
            links += [(a[x], b[z]) for z in itertools.takewhile(lambda z: z < len(b) and cuts[1][z] < cuts[0][x + 1], itertools.count(y))]
        count.update(set(links))
        parts.append((key, len(a), len(b), ";".join(groups), links))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = [
        (key, na, nb, groups.count("|"), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), groups)
        for key, na, nb, groups, links in parts
    ]
    return out, count, most


def test_alignment(spark, monkeypatch):
    rows = ROWS + [(100 + i, t) for i, t in enumerate(NOISE[:400])]
    docs = spark.createDataFrame(rows, KIND).repartition(2).withColumn("block", F.lit("mine")).withColumn("unit", F.lit(2))
    want, count, most = plain_alignment(rows)
    monkeypatch.setattr(cross_tokens, "AT_ONCE", 50)
    found = cross_tokens.align(docs)
    got = [tuple(r) for r in found.documents.select("doc_id", *cross_tokens.SUMS, "groups").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {(r["a"], r["b"]): (r["docs"], r["best"]) for r in found.pairs.collect()} == {p: (n, n == most[p[0]]) for p, n in count.items()}
    assert sum(w[1] == 0 for w in want) >= 3  # null, empty, and a mark that comes back as a space
    assert cross_tokens.align(spark.createDataFrame([], KIND)).documents.count() == 0


def test_blocks(spark, monkeypatch):
    """Many blocks give what one block gives; the worker's function is called here."""
    docs = spark.createDataFrame([(i, PROSE[i % 3] if i % 7 else None) for i in range(40)], KIND)
    want, *_ = plain_alignment([tuple(r) for r in docs.collect()])
    blocks = cross_tokens.in_blocks(docs.repartition(7), "doc_id", "text")
    assert blocks.where("of IS NOT NULL").count() == 40 and blocks.select("block").distinct().count() > 3
    got = [tuple(r) for r in cross_tokens.align(docs.repartition(7)).documents.select("doc_id", *cross_tokens.SUMS, "groups").collect()]
    assert sorted(got) == sorted(want)


def plain_audit(rows):
    term = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs, in_docs, counts = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        docs[lang].add(source)
        in_docs[lang].update(set(term(text)))
        counts[lang, source].update(term(text))
    out = []
    for lang, sources in docs.items():
        kept = [t for t, n in in_docs[lang].items() if n >= 3]
        share = {}
        total = Counter()
        for s in sources:
            n = sum(counts[lang, s][t] for t in kept)
            total.update({t: counts[lang, s][t] for t in kept})
            share[s] = {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (n + len(kept)) for t in kept}
        q = {t: 1 + 10**9 * (total[t] + 1) // (sum(total.values()) + len(kept)) for t in kept}
        far = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(sum(far(share[s][t], share[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(far(share[s][t], q[t]), t) for t in kept if counts[lang, s][t] and share[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found) if part == "pair" or i < 200]
    return out


def audit_rows(n, seed):
    r = random.Random(seed)
    words = [*WORDS, "É", "é", "ß", "中文", "Über", "naïve"]
    rows = [
        (" ".join(r.choices(words[: r.choice([5, 60, 206])], k=r.randint(0, 60))), r.choice(["en", "en", "de", None]), r.choice([None, "", "a", "b", "c", *(f"s{i}" for i in range(12))]))
        for _ in range(n)
    ]
    return rows + [(None, "en", "only null"), ("", "xx", "a"), ("x", "xx", "b"), ("rare", "yy", "a"), ("A1b2-C3 d_e" * 500, "en", "a"), ("Ä\x85\xa0Z", "en", "a")] + [("same same", "en", "hot")] * 30


@pytest.mark.parametrize(("tile", "chunk", "cells"), [(512, 250_000, 1 << 21), (3, 50, 7)])
def test_divergence(spark, monkeypatch, tile, chunk, cells):
    for name, value in (("TILE", tile), ("CHUNK_ROWS", chunk), ("CELLS", cells)):
        monkeypatch.setattr(divergence, name, value)
    rows = audit_rows(400, 3)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3).withColumn("chunk", F.lit("mine")).withColumn("term", F.lit(None).cast("int"))
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == sorted(plain_audit(rows))
    assert divergence.audit(docs.limit(0)).count() == 0


def test_heavy_and_light_agree():
    """Whatever is held for heavy or light, the sums are the plain ones."""
    r = np.random.Generator(np.random.PCG64(4))
    for _ in range(30):
        terms, na, nb = int(r.integers(1, 40)), int(r.integers(1, 9)), int(r.integers(1, 9))
        cells = r.integers(0, 6, (terms, na + nb)) * (r.random((terms, na + nb)) < 0.4) * int(r.choice([1, 1_000_000]))
        n, v = cells.sum(0) + r.integers(0, 50, na + nb), terms + int(r.integers(0, 9))
        share = [[1 + 10**9 * (int(c) + 1) // (int(m) + v) for c, m in zip(row, n)] for row in cells]
        want = [[sum((p[i] - p[na + j]) ** 2 // p[na + j] for p in share) for j in range(nb)] for i in range(na)]
        ta, a = np.nonzero(cells[:, :na])
        tb, b = np.nonzero(cells[:, na:])
        got = divergence.pair_sums((ta, tb), a, cells[ta, a], b, cells[tb, na + b], r.random(terms) < 0.5, n[:na], n[na:], v)
        assert got.tolist() == want


def test_shares_beyond_64_bits():
    c, n, v = np.array([0, 3, 10**13]), np.array([10**13, 5, 10**13]), 10**9
    assert divergence.share(c, n, v).tolist() == [1 + 10**9 * (int(x) + 1) // (int(m) + v) for x, m in zip(c, n)]


def test_digests(spark):
    """The thin queries' digests come from the operators' outputs."""
    texts = {i: t for i, t in [(i, t) for i, t in enumerate(TEXTS) if t]}
    docs = spark.createDataFrame(list(texts.items()), KIND)
    d = cross_tokens.align(docs).documents
    got = {r[0]: r[1] for r in d.select("doc_id", F.sha2(F.col("groups").cast("binary"), 256)).collect()}
    want, *_ = plain_alignment(list(texts.items()))
    assert got == {w[0]: hashlib.sha256(w[-1].encode()).hexdigest() for w in want}


def test_blocks_are_met_without_tokenizers_and_strings_of_python():
    cross_tokens.tokenizers(public_tokenizers.path(cross_tokens.BYTES), public_tokenizers.path(cross_tokens.PIECES))
    docs = pa.table({"block": [0] * 4, "key": [1, 2, 3, 4], "of": pa.array([[0, 1, 0], [], [1, 2], [3]], pa.list_(pa.int32()))})
    units = pa.table({"n": pa.array([1, 0, 2], pa.int32()), "good": [True, True, False], "groups": ["3|4;5|6", "1|2", None], **{x: [1, 2, None] for x in cross_tokens.SUMS}})
    out = cross_tokens._lean(cross_tokens._documents(pa.int64()))(docs, units)
    assert out["groups"].to_pylist() == ["1|2;3|4;5|6;1|2", "", "", ""] and out["n_links"].to_pylist() == [5, 0, 0, 0]
    assert cross_tokens.tokenizers.cache_info().currsize == 0
