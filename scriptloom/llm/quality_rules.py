"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule; policies
are versioned sets of rules, applied later by one bitwise AND, and ablations are bitwise aggregations of the ledger,
so that a policy can be changed or compared without reading the texts again.

Null and empty texts have no words: all measurements are 0 and rule `few_words` fails. Repeated rows are measured
each on its own. Rows without any column but the text work; other columns are carried along, and the ledger's own
columns get underscores added where a name is taken. An empty table gives an empty ledger.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .base import WORD, fresh, released, small_batches, table

_word, _symbol = re.compile(WORD), re.compile(r"[#*$%&|<>]")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words")
#: Rule -> test over the measurements that says it failed. The order fixes the bits: append, never reorder.
RULES = {
    "few_words": lambda m: m["n_words"] < 50,
    "repeated_words": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "short_words": lambda m: m["word_chars"] < 2 * m["n_words"],
    "long_words": lambda m: m["word_chars"] > 20 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > 3 * m["n_words"],
    "repeated_lines": lambda m: 2 * m["n_dup_lines"] > m["n_lines"],
    "few_letters": lambda m: 10 * m["n_letter_words"] < 5 * m["n_words"],
}
BIT = {rule: 1 << i for i, rule in enumerate(RULES)}
BASE = ("few_words", "repeated_words")
#: Policy version -> rules that reject. Versions are never changed, only added.
POLICIES = {"base-1": BASE, "full-1": tuple(RULES)}


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one text."""
    words = _word.findall(text or "")
    if not words:
        return (0,) * len(MEASURES)
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if _word.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated, windows = 0, list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        count, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if count[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    letters = sum(map(str.isalpha, words))
    if letters < len(words):
        letters += sum(not w.isalpha() and any(map(str.isalpha, w)) for w in words)
    return len(words), sum(map(len, words)), len(_symbol.findall(text)), dup, repeated, lines, letters


def ledger(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with MEASURES and `failed_rules`; and the columns' names, which differ where docs has them already."""
    spark = docs.sparkSession
    small_batches(spark)
    names, wide = {}, docs
    for name in (*MEASURES, "failed_rules"):
        names[name] = fresh(wide, name)
        wide = wide.withColumn(names[name], F.lit(0).cast("long"))
    schema = StructType([*docs.schema.fields, *(StructField(names[n], LongType()) for n in (*MEASURES, "failed_rules"))])
    at = docs.columns.index(text)

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t) for t in batch.column(at).to_pylist()]
            bits = []
            for row in rows:
                m = dict(zip(MEASURES, row))
                bits.append(sum(bit for (rule, failed), bit in zip(RULES.items(), BIT.values()) if failed(m)))
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *cols, pa.array(bits, pa.int64())], names=[f.name for f in schema.fields]
            )

    return docs.mapInArrow(released(evaluate), schema), names


def kept(policy: str, failed_rules: str = "failed_rules"):
    """The policy's verdict over a ledger."""
    return F.col(failed_rules).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(led: DataFrame, policy: str, failed_rules: str = "failed_rules") -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that would stay if it were left out.

    The ledger shrinks to a count per failure mask first, with map-side sums; the masks are bounded by the rules.
    """
    m = mask(policy)
    masks = led.groupBy(F.col(failed_rules).bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    return (
        masks.select("bits", "n", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in POLICIES[policy]))).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("only_this"),
            F.bit_or(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits")).otherwise(F.lit(0))).alias("fails_with"),
        )
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led, n = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return led.select(
        "doc_id", *(F.col(n[c]).alias(c) for c in MEASURES[:5]), (~kept("base-1")).alias("base_failed"),
        kept("full-1").alias("kept"), F.col("failed_rules"),
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the full policy rejects, alone and with others, over all documents' ledger."""
    led, n = ledger(table(spark, sf_dir, "documents").select("text"))
    return ablations(led.select(n["failed_rules"]), "full-1", n["failed_rules"])


_LEDGER = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
e AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w WHERE len(ws) > 0),
g AS (SELECT rid, pos, word, lead(word) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM e WINDOW p AS (PARTITION BY rid ORDER BY pos)),
r AS (SELECT rid, pos FROM g WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, word, w2, w3) > 1),
rw AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([pos, pos + 1, pos + 2]) AS p FROM r) GROUP BY rid),
ln AS (SELECT rid, line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY rid),
lw AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (regexp_matches(word, '\pL')) AS n_letter_words FROM e GROUP BY rid),
m AS (SELECT w.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(w.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_letter_words, 0) AS n_letter_words
  FROM w LEFT JOIN lw USING (rid) LEFT JOIN dl USING (rid) LEFT JOIN rw USING (rid)),
f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (word_chars < 2 * n_words)::BIGINT
  + 8 * (word_chars > 20 * n_words)::BIGINT + 16 * (10 * n_symbols > 3 * n_words)::BIGINT
  + 32 * (2 * n_dup_lines > n_lines)::BIGINT + 64 * (10 * n_letter_words < 5 * n_words)::BIGINT AS failed_rules FROM m)
"""
ORACLE = _LEDGER + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_rules & 3) <> 0 AS base_failed, failed_rules = 0 AS kept, failed_rules FROM f
"""
ABLATIONS_ORACLE = _LEDGER + f"""
SELECT rule, count(*) FILTER (failed_rules & bit <> 0) AS failed, count(*) FILTER (failed_rules = bit) AS only_this, coalesce(bit_or(failed_rules) FILTER (failed_rules & bit <> 0), 0) AS fails_with
FROM (VALUES {", ".join(f"('{r}', {b}::BIGINT)" for r, b in BIT.items())}) AS r(rule, bit) LEFT JOIN f ON true GROUP BY rule
"""
