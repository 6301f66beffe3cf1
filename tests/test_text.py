"""Column expressions against their plain Python meaning."""

import pytest
from pyspark.sql import functions as F

from scriptloom.functions import numbers as N
from scriptloom.functions import text as T
from scriptloom.functions import tokens as P

TEXTS = [
    "", " ", "Hello, world!", "We  need\n to solve", "don't 'quote' _x_ --", "Straße İstanbul ﬁn ΑΣ", "a\x1cb c", "...", "one", "tail space ", "x" * 50, None,
    "Σ ΣΑΣ ǅ Ꭰ ꭰ K Å ﬀ ẞ 𐐀 Ω ΐ ŉ", "_'a'_ '' _ x_'", "日本 – … € Ж", 'He said "stop."', "no end", "wait?) ", "über-alles 12,5 €",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")


def got(df, col):
    return [r[0] for r in df.orderBy("i").select(col).collect()]


def test_words(texts):
    assert got(texts, T.words(F.col("t"))) == [P.words(t) for t in TEXTS]


@pytest.mark.parametrize("n", [0, 1, 2, 9])
def test_trims(texts, n):
    assert got(texts, T.trim_suffix(F.col("t"), F.lit(n))) == [None if t is None else P.drop_last(t, n) for t in TEXTS]
    assert got(texts, T.trim_prefix(F.col("t"), F.lit(n))) == [None if t is None else P.drop_first(t, n) for t in TEXTS]


@pytest.mark.parametrize("limit", [5, 12, 30])
def test_compact(texts, limit):
    assert got(texts, T.compact(F.col("t"), limit)) == [P.compact(t, limit) for t in TEXTS]


def test_casefold_strip_squeeze(texts):
    assert got(texts, T.casefold(F.col("t"))) == [t and t.casefold() if t is not None else None for t in TEXTS]
    assert got(texts, T.strip(F.col("t"))) == [None if t is None else t.strip() for t in TEXTS]
    assert got(texts, T.squeeze(F.col("t"))) == [None if t is None else " ".join(t.split()) for t in TEXTS]


def test_nested_texts_are_found_once(texts):
    """compact() of compact() writes its text out once a level; lines behind labels find their values once."""
    written = lambda c: str(texts.select(c)._jdf.queryExecution().optimizedPlan()).count("regexp_replace(")
    once, twice = T.compact(F.col("t"), 12), T.compact(T.compact(F.col("t"), 12), 5)
    assert written(twice) == 2 * written(once) and written(T.labelled({"a: ": once})) == written(once)
    assert got(texts, twice) == [P.compact(P.compact(t, 12), 5) for t in TEXTS]
    assert got(texts, T.labelled({"a: ": once, "b: ": F.col("t")})) == ["\n".join(f"{k}: {v}" for k, v in (("a", P.compact(t, 12)), ("b", t)) if v) for t in TEXTS]
    both = T.with_translation(F.col("t"), once, " / ")
    assert written(both) == written(once)
    assert got(texts, both) == [t and P.with_translation(t, P.compact(t, 12), " / ") for t in TEXTS]


def test_casefold_of_all_characters(spark):
    """Each alone and beside ß, which is folded apart."""
    every = [chr(i) for i in range(1, 0x1F000) if not 0xD800 <= i <= 0xDFFF and chr(i).casefold() != chr(i)]
    rows = [(i, t) for i, t in enumerate(every + [f"{c}ßA" for c in every])]
    df = spark.createDataFrame(rows, "i int, t string")
    assert got(df, T.casefold(F.col("t"))) == [t.casefold() for _, t in rows]


def test_few_eszetts_cost_no_table(spark):
    """A text with ß isn't spelled by characters."""
    df = spark.createDataFrame([("Straße",)], "t string")
    assert not df.where(F.col("t").rlike(T._folds()[3])).count() and df.select(T.casefold(F.col("t"))).first()[0] == "strasse"


def test_ends_sentence(texts):
    flags = dict(zip(TEXTS, got(texts, T.ends_sentence(F.col("t")))))
    assert flags['He said "stop."'] and flags["wait?) "] and flags["..."] and not flags["no end"] and not flags[""]


def test_timestamp(spark):
    rows = [(0, 3661.234), (1, -5.0), (2, 0.0005), (3, 0.0015), (4, 360000.0)]
    df = spark.createDataFrame(rows, "i int, s double")
    assert got(df, N.timestamp(F.col("s"))) == ["01:01:01.234", "00:00:00.000", "00:00:00.000", "00:00:00.002", "100:00:00.000"]


def test_clean_time(spark):
    df = spark.createDataFrame([(0, "1.5"), (1, "x"), (2, None), (3, "NaN"), (4, "-Infinity"), (5, "-2")], "i int, s string")
    assert got(df, N.clean_time(F.col("s"), F.lit(4.0))) == [1.5, 4.0, 4.0, 4.0, 4.0, 0.0]


def _holders(df, name):
    """The plan's lines that name an expression."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if name in x]


def test_words_and_suffixes_of_odd_texts_without_work_for_each_word(spark):
    odd = ["a  b", "a\u00a0b c", " a b", "a b ", "x_ 'y' z", "__ '' _", "a'_'b _'c", "\u2003a\u3000b", "a - b c", "- a b", "a b -", "d\u0345e f", "É\u00b5ß ü", None]
    df = spark.createDataFrame(list(enumerate(odd)), "i int, t string")
    assert got(df, T.words(F.col("t"))) == [P.words(t) for t in odd]
    for n in (1, 2, 3):
        k = F.size(T.words(F.col("t")))
        assert got(df, T.trim_suffix(F.col("t"), F.lit(n), k)) == [None if t is None else P.drop_last(t, n) for t in odd]
    # the many texts that need no letter-wise fold get by without a function called for each of their words
    assert not _holders(spark.createDataFrame([], "t string").select(T.words(F.col("t"))), "filter(")
