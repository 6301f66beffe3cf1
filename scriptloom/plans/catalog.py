"""The registered queries over the transcript operators, with DuckDB SQL for those that SQL can express.

There are no media among the tables, so these stand in: conversations for a media item's windows (a turn each),
documents for transcripts cut into overlapping word windows, events for timed records, pages for raw strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import replies
from ..functions import text as T
from ..operators import chronology as chrono
from ..operators import continuity, memo, reconcile, render, seams
from ..schema import CHUNK
from ..sources import media, prompts
from ..streaming import responses
from . import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SIZE, SHARED = 40, 6  # words of a transcript window, and how many it shares with the next


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Fragments of SQL.
def _fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def _words(x: str) -> str:
    norm = f"regexp_replace(regexp_replace({_fold('t')}, '[^\\p{{L}}\\p{{N}}_'']+', '', 'g'), '^[_'']+|[_'']+$', '', 'g')"
    return f"list_filter(list_transform(regexp_extract_all({x}, '\\S+'), lambda t: {norm}), lambda w: w <> '')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _compact(x: str, n: int) -> str:
    s, head = _squeeze(f"coalesce({x}, '')"), f"left({_squeeze(f'coalesce({x}, chr(32))')}, {n - 1})"
    short = f"regexp_replace(regexp_replace({head}, ' [^ ]*$', ''), '[ ,;:\\-]+$', '')"
    return f"CASE WHEN length({s}) <= {n} THEN {s} ELSE (CASE WHEN {short} = '' THEN {head} ELSE {short} END) || '…' END"


_SAID = "trim(text, ' ' || chr(10))"


def _stamp(x: str) -> str:
    ms = f"greatest(0, CAST(round_even({x} * 1000, 0) AS BIGINT))"
    return f"printf('%02d:%02d:%02d.%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


WINDOWS_SQL = f"""
w0 AS (SELECT doc_id, lang, {_words('text')} AS ws FROM documents),
w1 AS (SELECT doc_id, lang, ws, unnest(range(CASE WHEN len(ws) <= {SIZE} THEN 1 ELSE CAST(ceil((len(ws) - {SIZE}) / {SIZE - SHARED}.0) AS BIGINT) + 1 END)) AS idx FROM w0 WHERE len(ws) > 0),
win AS (SELECT doc_id, lang, idx, ws[idx * {SIZE - SHARED} + 1:idx * {SIZE - SHARED} + {SIZE}] AS ws FROM w1),
pairs AS (SELECT doc_id, lang, idx, ws AS cur, lag(ws) OVER (PARTITION BY doc_id ORDER BY idx) AS prev FROM win),
seam AS (SELECT doc_id, lang, idx, prev, cur, coalesce(list_max(list_filter(range(1, least(len(prev), len(cur), 80) + 1), lambda k: prev[len(prev) - k + 1:] = cur[1:k] AND (k > 1 OR length(cur[1]) >= 5))), 0) AS overlap FROM pairs WHERE prev IS NOT NULL)
"""


def _cut_docs(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    docs = table(spark, d, "documents").select("doc_id", "lang", T.words(F.col("text")).alias("ws"))
    n = F.when(F.size("ws") <= SIZE, 1).otherwise(F.ceil((F.size("ws") - SIZE) / F.lit(SIZE - SHARED)).cast("int") + 1)
    # a filter on the words would find them twice; without any there are no windows
    cut = F.when(F.size("ws") > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("ws", i * (SIZE - SHARED) + 1, F.lit(SIZE))))
    return docs, cut


def doc_windows(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, lang, index, words: each document in windows of SIZE words that share SHARED."""
    docs, cut = _cut_docs(spark, d)
    return docs.select("doc_id", "lang", F.posexplode(cut).alias("index", "words"))


def window_pairs(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, lang, index, previous, words: each window but the first beside the one before, paired inside the row."""
    docs, cut = _cut_docs(spark, d)
    pairs = F.transform(F.array(cut), lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c)), lambda a, b: F.struct(a.alias("previous"), b.alias("words"))))
    return docs.select("doc_id", "lang", F.posexplode(F.element_at(pairs, 1)).alias("at", "p")).select("doc_id", "lang", (F.col("at") + 1).alias("index"), "p.previous", "p.words")


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns(spark, d).select("conv_id", "turn", F.lag("text").over(w).alias("previous"), F.col("text").alias("current")).where("previous IS NOT NULL")


def spans(spark: SparkSession, d: str) -> DataFrame:
    """user_id, duration_seconds: each user's events as one recording, in whole minutes as seconds."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return e.select("user_id", (F.floor((F.unix_micros("b") - F.unix_micros("a")) / 60_000_000) / 10.0).alias("duration_seconds"))


SPANS_SQL = "sp AS (SELECT user_id, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000) / 10.0 AS duration_seconds FROM events GROUP BY user_id)"


def conversation_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's turns as windows of 30 s each 28 s, spoken by role, with objects and a setting from the words."""
    c, w = turns(spark, d), T.words(F.col("text"))
    start = F.col("turn") * F.lit(28.0)
    none = lambda kind: F.lit(None).cast(kind)
    segment = F.struct(start.alias("start"), (start + 20.0).alias("end"), F.col("role").alias("speaker"), F.col("text").alias("text"), none("string").alias("translation"), none("boolean").alias("inferred_timestamp"))
    kinds = spark.createDataFrame([], CHUNK).schema
    audio = F.struct(F.lit("xx").alias("language"), F.col("text").alias("transcript"), none("string").alias("translation"), F.array(segment).alias("segments"), F.array().cast("array<string>").alias("non_speech_audio"),
                     *(none(kinds["audio"].dataType[k].dataType).alias(k) for k in ("segment_coverage", "boundary_reconciliation", "timestamp_reconciliation")))
    shot = F.struct((start + 10.0).alias("start"), (start + 15.0).alias("end"), F.concat(F.lit("shows "), F.col("role")).alias("description"), F.slice("ws", 1, 2).alias("visible_text"))
    visual = F.struct(F.concat(F.lit("turn of "), F.col("role")).alias("summary"), F.array(shot).alias("shots"), F.array(F.col("role")).alias("people"), F.slice("ws", 1, 4).alias("objects"), F.element_at("ws", -1).alias("setting"))
    return c.withColumn("ws", w).where("size(ws) > 0").select(F.col("conv_id").cast("string").alias("media_id"), F.col("turn").cast("int").alias("index"), start.alias("start_seconds"), F.lit(30.0).alias("duration_seconds"), audio.alias("audio"), visual.alias("visual"))


# Text.
@query(f"SELECT doc_id, len(ws)::BIGINT AS n_tokens, sha256(array_to_string(ws, ' ')) AS digest FROM (SELECT doc_id, {_words('text')} AS ws FROM documents)")
def tokens_normalized(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.words(F.col("text")).alias("ws"))
    return docs.select("doc_id", F.size("ws").cast("long").alias("n_tokens"), F.sha2(F.array_join("ws", " "), 256).alias("digest"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({_words('text')}) AS word FROM documents) GROUP BY word")
def word_counts(spark, d):
    return table(spark, d, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"""
WITH p AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '\\s*\\S+')) AS part, unnest(range(len(regexp_extract_all(text, '\\s*\\S+')))) AS i FROM conversations),
o AS (SELECT *, sum(length(part)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS e FROM p),
n AS (SELECT conv_id, turn, i, e - length(ltrim(part, ' ' || chr(10))) AS s, e, ({_words('part')})[1] AS word FROM o)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS pos, s::BIGINT AS start_at, e::BIGINT AS end_at, word FROM n WHERE word IS NOT NULL""")
def token_offsets(spark, d):
    c = turns(spark, d).select("conv_id", "turn", F.posexplode(T.parts(F.col("text"))).alias("i", "part"))
    w = Window.partitionBy("conv_id", "turn").orderBy("i")
    word = T.rstrip(F.col("part"))
    at = c.withColumn("end_at", F.sum(F.length(word)).over(w) + F.coalesce(F.sum(F.length("part") - F.length(word)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = at.withColumn("start_at", F.col("end_at") - F.length(T.strip(F.col("part")))).withColumn("word", T.normal(F.col("part"))).where("word <> ''")
    return at.select("conv_id", "turn", F.row_number().over(w).cast("long").alias("pos"), F.col("start_at").cast("long"), F.col("end_at").cast("long"), "word")


@query(f"""SELECT conv_id, turn, a = b AS same, len(list_intersect(a, b))::BIGINT AS shared FROM (SELECT conv_id, turn, {_words('text')} AS a, lag({_words('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL""")
def text_equivalent_turns(spark, d):
    a, b = T.words(F.col("current")), T.words(F.col("previous"))
    return turn_pairs(spark, d).select("conv_id", "turn", (a == b).alias("same"), F.size(F.array_intersect(a, b)).cast("long").alias("shared"))


@query("""SELECT conv_id, turn, regexp_matches(text, '[.!?]["'')\\]}]*\\s*$') AS ends FROM conversations""")
def ends_sentence_flags(spark, d):
    return turns(spark, d).select("conv_id", "turn", T.ends_sentence(F.col("text")).alias("ends"))


@query(f"SELECT doc_id, {_compact('text', 240)} AS short FROM documents")
def compact_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.compact(F.col("text"), 240).alias("short"))


@query("SELECT page_id, rtrim(left(trim(html), 160)) AS bounded, regexp_replace(url, '[^\\p{L}\\p{N}_-]', '_', 'g') AS stem FROM pages")
def bounded_strings(spark, d):
    return table(spark, d, "pages").select("page_id", T.bounded(F.col("html"), 160).alias("bounded"), T.safe_stem(F.col("url")).alias("stem"))


@query(f"""WITH p AS (SELECT conv_id, turn, regexp_extract_all(text, '\\S+') AS p FROM conversations), w AS (SELECT *, list_filter(range(1, len(p) + 1), lambda i: len({_words('p[i]')}) > 0) AS ix FROM p)
SELECT conv_id, turn, CASE WHEN len(ix) > 3 THEN array_to_string(p[1:ix[len(ix) - 2] - 1], ' ') ELSE '' END AS head, CASE WHEN len(ix) > 3 THEN array_to_string(p[ix[4]:], ' ') ELSE '' END AS tail FROM w""")
def trimmed_turns(spark, d):
    """All turns, those with signs that stand alone too: they are no tokens, and go or stay with their neighbours."""
    return turns(spark, d).select("conv_id", "turn", T.squeeze(T.trim_suffix(F.col("text"), F.lit(3))).alias("head"), T.squeeze(T.trim_prefix(F.col("text"), F.lit(3))).alias("tail"))


# Numbers, time, JSON.
@query(f"SELECT event_id, {_stamp('value')} AS stamp FROM events")
def timestamps_formatted(spark, d):
    return table(spark, d, "events").select("event_id", N.timestamp(F.col("value")).alias("stamp"))


@query("SELECT event_id, greatest(0.0, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 7.5)) AS seconds, greatest(0.0, coalesce(TRY_CAST(event_type AS DOUBLE), value)) AS fallback FROM events")
def lenient_times(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", N.variant_time(F.try_parse_json("props"), "$.k", F.lit(7.5)).alias("seconds"), N.clean_time(F.col("event_type"), F.col("value")).alias("fallback"))


_IV = "iv AS (SELECT user_id, event_id, epoch_us(ts) % 1000000 / 1000000.0 * 40 AS a, epoch_us(ts) % 1000000 / 1000000.0 * 40 + abs(value) / 100 AS b FROM events), m AS (SELECT *, max(a) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM iv), e AS (SELECT *, s + (b - a) AS en FROM m), x AS (SELECT *, max(en) OVER (PARTITION BY user_id) AS last FROM e)"


@query(f"WITH {_IV} SELECT event_id, round(CASE WHEN last > 30 THEN least(30, s * (30 / last)) ELSE s END, 6) AS norm_start, round(CASE WHEN last > 30 THEN least(30, greatest(s * (30 / last), en * (30 / last))) ELSE en END, 6) AS norm_end FROM x")
def scaled_intervals(spark, d):
    a = F.unix_micros(F.col("ts").cast("timestamp")) % 1_000_000 / 1_000_000.0 * 40
    e = table(spark, d, "events").select("user_id", "event_id", a.alias("a"), (a + F.abs("value") / 100).alias("b"), F.lit(30.0).alias("d"))
    out = N.normalize_intervals(e, ["user_id"], "event_id", "a", "b", "d")
    return out.select("event_id", F.round("norm_start", 6).alias("norm_start"), F.round("norm_end", 6).alias("norm_end"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_extract(spark, d):
    said = F.concat(F.lit('Sure {"note": "a } brace", "props": '), F.col("props"), F.lit("} and {more"))
    found = replies.extracted(table(spark, d, "events").select("event_id", said.alias("reply")))
    return found.select("event_id", F.get_json_object("json", "$.props.k").cast("long").alias("k"))


# Windows of time.
@query(f"""WITH {SPANS_SQL}, n AS (SELECT *, CASE WHEN duration_seconds <= 30 THEN 1 ELSE CAST(ceil((duration_seconds - 30) / 28) AS BIGINT) + 1 END AS c FROM sp WHERE duration_seconds > 0),
i AS (SELECT user_id, duration_seconds, unnest(range(c)) AS idx FROM n)
SELECT user_id, idx::INTEGER AS index, (idx * 28)::DOUBLE AS start_seconds, round(least(30::DOUBLE, duration_seconds - idx * 28), 6) AS chunk_seconds FROM i""")
def chunk_plan(spark, d):
    plan = windows.plan_chunks(spans(spark, d).where("duration_seconds > 0"))
    return plan.select("user_id", "index", F.col("start_seconds").cast("double"), F.round("chunk_seconds", 6).alias("chunk_seconds"))


@query("""WITH p AS (SELECT event_id, user_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 600000000.0 AS s FROM events),
i AS (SELECT event_id, user_id, s, unnest(range(greatest(0, CAST(floor((s - 30) / 28) AS BIGINT) + 1), CAST(floor(s / 28) AS BIGINT) + 1)) AS idx FROM p)
SELECT user_id, idx::INTEGER AS index, count(*) AS n, round(min(s - idx * 28.0), 6) AS first_at FROM i GROUP BY ALL""")
def events_in_chunks(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("event_id", "user_id", ((us - F.min(us).over(Window.partitionBy("user_id"))) / 600_000_000.0).alias("s"))
    at = windows.windows_of(e, "s")
    return at.groupBy("user_id", "index").agg(F.count("*").alias("n"), F.round(F.min(F.col("s") - F.col("start_seconds")), 6).alias("first_at"))


# Streams of lines.
def _lines(spark, d, make: Callable) -> DataFrame:
    return turns(spark, d).select(F.col("conv_id").cast("string").alias("response_id"), F.col("turn").cast("int").alias("pos"), make(F.col("text")).alias("line"))


@query("SELECT conv_id::VARCHAR AS response_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (turn < 5), '') AS text FROM conversations GROUP BY conv_id")
def sse_accumulate(spark, d):
    event = lambda t: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("delta"))).alias("choices"))))
    lines = _lines(spark, d, event)
    done = lines.select("response_id").distinct().select("response_id", F.lit(5).alias("pos"), F.lit("data: [DONE]").alias("line"))
    noise = lines.select("response_id", F.lit(-1).alias("pos"), F.lit(": keep-alive").alias("line")).distinct()
    late = lines.withColumn("pos", F.when(F.col("pos") >= 5, F.col("pos") + 1).otherwise(F.col("pos")))
    return responses.sse(late.unionByName(done).unionByName(noise)).select("response_id", "text")


@query("SELECT conv_id::VARCHAR AS response_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def ndjson_accumulate(spark, d):
    lines = _lines(spark, d, lambda t: F.to_json(F.struct(F.struct(t.alias("content")).alias("message"))))
    return responses.ndjson(lines).select("response_id", "text")


# Validation.
@query(f"""WITH t AS (SELECT conv_id, turn, {_words('text')} AS w, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
o AS (SELECT conv_id, any_value(n) AS n, flatten(list(w ORDER BY turn)) AS told, coalesce(flatten(list(w ORDER BY turn) FILTER (NOT (conv_id % 4 = 1 AND turn = n - 1) AND NOT (conv_id % 4 = 2 AND turn = 0) AND NOT (conv_id % 4 = 3 AND turn = 1))), []) AS said FROM t GROUP BY conv_id)
SELECT conv_id, CASE WHEN len(said) = 0 THEN 'synthesized' WHEN said = told THEN 'complete' WHEN said = told[1:len(said)] THEN 'repaired-tail' WHEN said = told[len(told) - len(said) + 1:] THEN 'repaired-head' ELSE 'canonical-fallback' END AS status FROM o""")
def coverage_status(spark, d):
    t = turns(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    c = F.col("conv_id") % 4
    left_out = ((c == 1) & (F.col("turn") == F.col("n") - 1)) | ((c == 2) & (F.col("turn") == 0)) | ((c == 3) & (F.col("turn") == 1))
    ordered = lambda rows: F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["text"])
    g = t.groupBy("conv_id").agg(F.array_join(ordered(F.struct("turn", "text")), " ").alias("transcript"), ordered(F.when(~left_out, F.struct("turn", "text"))).alias("said"))
    reply = F.to_json(F.struct("transcript", F.transform("said", lambda s: F.struct(s.alias("text"))).alias("segments")))
    v = replies.validated_audio(g.select("conv_id", reply.alias("reply"), F.lit(0.0).alias("start_seconds"), F.lit(30.0).alias("duration_seconds"), F.lit(False).alias("timestamps_are_absolute")))
    return v.select("conv_id", F.col("audio.segment_coverage.status").alias("status"))


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '')[1:80] AS lines FROM documents),
v AS (SELECT doc_id, list_transform(lines, lambda x: rtrim(left(trim(x), 160))) AS v, len(lines) AS n FROM l),
r AS (
    SELECT doc_id, v, n, 0::BIGINT AS i, 0::BIGINT AS room, []::VARCHAR[] AS seen, []::VARCHAR[] AS texts FROM v
    UNION ALL
    SELECT doc_id, v, n, i + 1, held + new::BIGINT, CASE WHEN new THEN list_append(seen, key) ELSE seen END, CASE WHEN new THEN list_append(texts, x) ELSE texts END
    FROM (SELECT *, x <> '' AND held < 6 AND NOT list_contains(seen, key) AS new FROM (SELECT *, v[i + 1] AS x, {_fold('v[i + 1]')} AS key, CASE WHEN i % 8 = 0 THEN 0 ELSE room END AS held FROM r WHERE i < n))
)
SELECT doc_id, ((n + 7) // 8)::BIGINT AS shots, len(texts)::BIGINT AS n_texts, sha256(array_to_string(texts, '|')) AS digest FROM r WHERE i = n""")
def ocr_dedup(spark, d):
    """Lines of documents as on-screen texts of shots, eight lines a shot, of ten shots."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 8).cast("int")), lambda i: F.slice("lines", i * 8 + 1, F.lit(8)))
    shots = F.slice(F.when(F.size("lines") > 0, cut).otherwise(F.array().cast("array<array<string>>")), 1, replies.MAX_SHOTS)
    v = table(spark, d, "documents").select("doc_id", lines.alias("lines")).select("doc_id", replies.visible_once(shots).alias("v"))
    texts = F.flatten("v")
    return v.select("doc_id", F.size("v").cast("long").alias("shots"), F.size(texts).cast("long").alias("n_texts"), F.sha2(F.array_join(texts, "|"), 256).alias("digest"))


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: rtrim(left(trim(x), 160))), lambda x: x <> '') AS v FROM documents)
SELECT doc_id, len(v[1:12])::BIGINT AS people, len(v[1:24])::BIGINT AS objects, array_to_string(v[1:24], '|') AS line FROM l""")
def bounded_lists(spark, d):
    lines = F.split("text", "\n")
    docs = table(spark, d, "documents").select("doc_id", F.to_json(F.struct(lines.alias("people"), lines.alias("objects"))).alias("reply"), F.lit(0.0).alias("start_seconds"), F.lit(30.0).alias("duration_seconds"), F.lit(False).alias("timestamps_are_absolute"))
    v = replies.validated_visual(docs)
    return v.select("doc_id", F.size("visual.people").cast("long").alias("people"), F.size("visual.objects").cast("long").alias("objects"), F.array_join("visual.objects", "|").alias("line"))


# Seams.
@query(f"WITH {WINDOWS_SQL} SELECT lang, overlap::BIGINT AS overlap, count(*) AS pairs FROM seam GROUP BY ALL")
def exact_seam(spark, d):
    k = seams.exact_overlap(F.col("previous"), F.col("words"))
    return window_pairs(spark, d).groupBy("lang", k.cast("long").alias("overlap")).agg(F.count("*").alias("pairs"))


@query(f"""WITH {WINDOWS_SQL} SELECT doc_id, idx::INTEGER AS index, overlap::BIGINT AS overlap, CASE WHEN overlap > 0 THEN 'current' END AS keeper FROM seam""")
def seam_winner(spark, d):
    p = window_pairs(spark, d).withColumn("overlap", seams.exact_overlap(F.col("previous"), F.col("words")))
    keeper = seams.keeper_column(F.array_join("previous", " "), F.array_join("words", " "), F.col("overlap"), F.col("overlap"), F.col("previous"), F.col("words"))
    return p.select("doc_id", "index", F.col("overlap").cast("long"), keeper.alias("keeper"))


@query()
def fuzzy_seam(spark, d):
    """Adjacent turns: few match exactly, so most go through the pruned search."""
    return seams.with_overlaps(turn_pairs(spark, d)).select("conv_id", "turn", "p", "c", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {WINDOWS_SQL}, nxt AS (SELECT doc_id, idx - 1 AS idx, overlap FROM seam), kept AS (SELECT win.doc_id, win.idx, win.ws[1:len(win.ws) - coalesce(overlap, 0)] AS ws FROM win LEFT JOIN nxt ON nxt.doc_id = win.doc_id AND nxt.idx = win.idx)
SELECT doc_id, len(flatten(list(ws ORDER BY idx)))::BIGINT AS n_words, sha256(array_to_string(flatten(list(ws ORDER BY idx)), ' ')) AS digest FROM kept GROUP BY doc_id""")
def reconciled_transcript(spark, d):
    w = doc_windows(spark, d)
    kinds = spark.createDataFrame([], CHUNK).schema
    none = lambda k: F.lit(None).cast(kinds["audio"].dataType[k].dataType).alias(k)
    audio = F.struct(none("language"), F.array_join("words", " ").alias("transcript"), *(none(k) for k in ("translation", "segments", "non_speech_audio", "segment_coverage", "boundary_reconciliation", "timestamp_reconciliation")))
    chunks = w.select(F.col("doc_id").cast("string").alias("media_id"), "index", (F.col("index") * 28.0).alias("start_seconds"), F.lit(30.0).alias("duration_seconds"), audio.alias("audio"), F.lit(None).cast(kinds["visual"].dataType).alias("visual"))
    out = reconcile.concatenated(reconcile.reconciled(chunks, 2.0), "transcript")
    n = F.when(F.col("transcript") == "", 0).otherwise(F.size(F.split("transcript", " ")))
    return out.select(F.col("media_id").cast("long").alias("doc_id"), n.cast("long").alias("n_words"), F.sha2("transcript", 256).alias("digest"))


_SHOTS = "p AS (SELECT user_id, event_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 600000000.0 AS s FROM events), i AS (SELECT event_id, user_id, s, unnest(range(greatest(0, CAST(floor((s - 30) / 28) AS BIGINT) + 1), CAST(floor(s / 28) AS BIGINT) + 1)) AS idx FROM p)"


@query(f"""WITH {_SHOTS}, k AS (SELECT *, EXISTS (SELECT 1 FROM i j WHERE j.user_id = i.user_id AND j.idx = i.idx - 1) AS before, EXISTS (SELECT 1 FROM i j WHERE j.user_id = i.user_id AND j.idx = i.idx + 1) AS after FROM i)
SELECT user_id, idx::INTEGER AS index, count(*) FILTER ((NOT before OR s >= idx * 28 + 1) AND (NOT after OR s < (idx + 1) * 28 + 1)) AS kept FROM k GROUP BY ALL""")
def shot_partition(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("event_id", "user_id", ((us - F.min(us).over(Window.partitionBy("user_id"))) / 600_000_000.0).alias("s"))
    shot = F.struct(F.col("s").alias("start"), F.col("s").alias("end"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("array<string>").alias("visible_text"))
    at = windows.windows_of(e, "s").groupBy(F.col("user_id").alias("media_id"), "index", "start_seconds").agg(F.collect_list(shot).alias("shots"))
    chunks = at.select("media_id", "index", "start_seconds", F.lit(30.0).alias("duration_seconds"), F.struct("shots").alias("visual"))
    return reconcile.split_shots(chunks).select(F.col("media_id").alias("user_id"), "index", F.size("visual.shots").cast("long").alias("kept"))


_SPEECH = """n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1 AS i FROM events),
s AS (SELECT user_id, i, i * 14.0::DOUBLE AS at, i * 14.0::DOUBLE + 30 AS stop, list_transform([3, 7, 11], lambda k: i * 14.0::DOUBLE + (event_id * k) % 29) AS starts FROM n),
f AS (SELECT *, starts[1] AS first, starts[3] AS last, greatest(0.0, starts[2] - starts[1], starts[3] - starts[1]) AS reach FROM s)"""


@query(f"""WITH RECURSIVE {_SPEECH},
r AS (
    SELECT user_id, i, NULL::DOUBLE AS bound, last AS left_at FROM f WHERE i = 0
    UNION ALL
    SELECT user_id, i, CASE WHEN first < bound THEN bound END, CASE WHEN first < bound THEN least(stop, bound + reach * ((stop - bound) / (stop - first))) ELSE last END
    FROM (SELECT f.*, least(f.stop, r.left_at + 0.001) AS bound FROM r JOIN f ON f.user_id = r.user_id AND f.i = r.i + 1)
)
SELECT user_id, i::INTEGER AS index, round(bound + 3.1e-8, 6) AS minimum, round(coalesce(bound, starts[1]) + 3.1e-8, 6) AS first_start, round(left_at + 3.1e-8, 6) AS last_start FROM r JOIN f USING (user_id, i)""")
def chronology(spark, d):
    """A user's events as speech, three segments each, in windows that overlap by 16 s and run into each other."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp")), "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", (F.row_number().over(w) - 1).alias("index"))
    at, kinds = F.col("index") * F.lit(14.0), spark.createDataFrame([], CHUNK).schema
    none = lambda k: F.lit(None).cast(kinds["audio"].dataType[k].dataType).alias(k)
    none_of = lambda k: F.lit(None).cast(k)
    start = lambda k: at + F.pmod(F.col("event_id") * k, F.lit(29))
    segments = F.array(*(F.struct(start(k).alias("start"), (start(k) + 1).alias("end"), none_of("string").alias("speaker"), F.lit("said").alias("text"), none_of("string").alias("translation"), none_of("boolean").alias("inferred_timestamp")) for k in (3, 7, 11)))
    audio = F.struct(*(segments.alias(k) if k == "segments" else none(k) for k in kinds["audio"].dataType.names))
    chunks = e.select(F.col("user_id").cast("string").alias("media_id"), "index", at.alias("start_seconds"), F.lit(30.0).alias("duration_seconds"), audio.alias("audio"), F.lit(None).cast(kinds["visual"].dataType).alias("visual"))
    said, near = F.col("audio.segments.start"), lambda x: F.round(x + 3.1e-8, 6)  # no half of a last digit
    return chrono.in_order(chunks).select(
        F.col("media_id").cast(e.schema["user_id"].dataType).alias("user_id"), "index", near(F.col("audio.timestamp_reconciliation.minimum_start")).alias("minimum"),
        near(F.get(said, F.lit(0))).alias("first_start"), near(F.element_at(said, -1)).alias("last_start"),
    )


# Running context.
@query(f"""WITH t AS (SELECT conv_id, turn, role, text, {_words('text')} AS ws FROM conversations), c AS (SELECT *, {_compact('text', 1200)} AS said FROM t WHERE len(ws) > 0),
w AS (SELECT *, row_number() OVER o AS nth, first_value(said) OVER o AS opening, lag(said) OVER o AS s1, lag(said, 2) OVER o AS s2, lag(role) OVER o AS r, lag(ws[len(ws)]) OVER o AS setting,
  coalesce(lag(ws[1:4], 3) OVER o, []) || coalesce(lag(ws[1:4], 2) OVER o, []) || coalesce(lag(ws[1:4]) OVER o, []) AS obj FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT *, list_transform(obj, lambda x: {_compact('x', 60)}) AS oc FROM w),
q AS (SELECT *, list_filter(range(1, len(oc) + 1), lambda i: list_position(oc, oc[i]) = i)[1:5] AS places FROM k),
u AS (SELECT *, array_to_string(list_transform(places, lambda i: oc[i]), '; ') AS objects, concat_ws(' ', CASE WHEN s2 <> opening THEN s2 END, CASE WHEN s1 <> opening THEN s1 END) AS recent FROM q),
j AS (SELECT conv_id, turn, nth, concat_ws(' ', 'Opening spoken context (background only; it may no longer apply): ' || {_compact('opening', 240)}, CASE WHEN recent <> '' THEN 'Recent spoken context: ' || {_compact('recent', 360)} END,
  'Previous visual summary (provisional): turn of ' || r, 'Last observed action (provisional): shows ' || r, CASE WHEN objects <> '' THEN 'Recently observed objects (provisional): ' || objects END, CASE WHEN setting <> '' THEN 'Previous setting (provisional): ' || {_compact('setting', 100)} END) AS line FROM u)
SELECT conv_id::VARCHAR AS media_id, turn::INTEGER AS index, CASE WHEN nth = 1 THEN '' ELSE {_compact('line', 1600)} END AS continuity FROM j""")
def continuity_record(spark, d):
    return continuity.with_continuity(conversation_chunks(spark, d)).select("media_id", "index", "continuity")


@query()
def visual_prompt_context(spark, d):
    """Grounding of each window's prompt, with the key under which its description is kept."""
    c = continuity.with_continuity(conversation_chunks(spark, d)).withColumn("transcript", T.visual_audio_context(F.col("audio")))
    user = T.user_context(F.lit("  a   talk "))
    return c.select("media_id", "index", prompts.grounding(user, F.col("transcript"), F.col("continuity")).alias("grounding"), memo.visual_key(F.col("transcript"), F.col("continuity"), user).alias("key"))


# Memoized results.
@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_chunks(spark, d):
    return memo.pending(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT d.doc_id, coalesce(l.quality, -1)::INTEGER AS quality, l.doc_id IS NOT NULL AS cached FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def cache_union(spark, d):
    cache = table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("cached"))
    new = lambda df: df.select("doc_id", F.lit(-1).alias("quality"), F.lit(False).alias("cached"))
    return memo.resumed(table(spark, d, "documents").select("doc_id"), cache, ["doc_id"], new)[0]


@query("""SELECT doc_id, left(sha256('{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}'), 16) AS key FROM documents""")
def cache_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", N.stable_key(source=F.col("source"), lang=F.col("lang"), n_chars=F.col("n_chars")).alias("key"))


# Reports.
@query(f"""WITH t AS (SELECT conv_id::VARCHAR AS media_id, turn, role, text, {_words('text')} AS ws FROM conversations), c AS (SELECT * FROM t WHERE len(ws) > 0)
SELECT media_id, turn::INTEGER AS index, 1 AS pos, 0 AS kind, (turn * 28 + 10)::DOUBLE AS at, '**Visual:** shows ' || role || ' Visible text: ' || array_to_string(ws[1:2], ', ') AS body FROM c
UNION ALL SELECT media_id, turn::INTEGER, 0, 1, (turn * 28)::DOUBLE, '**' || role || ':** ' || trim(text, ' ' || chr(10)) FROM c""")
def timeline_merge(spark, d):
    e = render.events(conversation_chunks(spark, d)).select("media_id", "index", F.posexplode("events").alias("pos", "e"))
    return e.select("media_id", "index", "pos", F.col("e.kind").alias("kind"), F.col("e.start").cast("double").alias("at"), F.col("e.body").alias("body"))


@query(f"""WITH t AS (SELECT conv_id::VARCHAR AS media_id, turn, role, {_SAID} AS said, {_words('text')} AS ws FROM conversations), c AS (SELECT * FROM t WHERE len(ws) > 0)
SELECT media_id, turn::INTEGER AS index, '### ' || {_stamp('turn * 28.0')} || '–' || {_stamp('(turn * 28.0 + 30)')} || chr(10) || chr(10) || CASE turn % 3
    WHEN 0 THEN '`' || {_stamp('turn * 28.0')} || '` **' || role || ':** ' || said
    WHEN 1 THEN '`' || {_stamp('turn * 28.0')} || '` **' || role || ':** ' || said || ' and more' || '  ' || chr(10) || '*Translation:* other'
    ELSE '**Transcript:** ' || said || chr(10) || chr(10) || '**Translation:** other' END || chr(10) AS lines FROM c""")
def coverage_render(spark, d):
    """Windows whose segments tell the transcript, tell less than it, or are missing."""
    c = conversation_chunks(spark, d)
    said, kind = F.col("audio.transcript"), F.col("index") % 3
    audio = F.col("audio").withField("transcript", F.when(kind == 1, F.concat(T.strip(said), F.lit(" and more"))).otherwise(said))
    audio = audio.withField("translation", F.when(kind > 0, F.lit(" other "))).withField("segments", F.when(kind < 2, F.col("audio.segments")).otherwise(F.slice("audio.segments", 1, 0)))
    c = c.withColumn("audio", audio).withColumn("visual", F.lit(None).cast(c.schema["visual"].dataType))
    return render.chunk_lines(c).select("media_id", "index", F.array_join("lines", "\n").alias("lines"))


@query()
def document_markdown(spark, d):
    chunks = conversation_chunks(spark, d)
    docs = chunks.groupBy("media_id").agg(F.max(F.col("start_seconds") + F.col("duration_seconds")).alias("duration_seconds")).withColumns({"source": F.concat(F.lit("conversation "), "media_id"), "media_type": F.lit("video"), "backend": F.lit("none"), "model": F.lit("none")})
    return render.markdown(docs, chunks)


@query()
def document_json(spark, d):
    chunks = conversation_chunks(spark, d)
    return render.documents_json(chunks.select("media_id").distinct().withColumn("source", F.concat(F.lit("conversation "), "media_id")), chunks)


@query("SELECT conv_id::VARCHAR AS media_id, string_agg(trim(text, ' ' || chr(10)), ' ' ORDER BY turn) AS transcript FROM conversations WHERE trim(text, ' ' || chr(10)) <> '' GROUP BY conv_id")
def document_rollup(spark, d):
    c = turns(spark, d).select(F.col("conv_id").cast("string").alias("media_id"), F.col("turn").alias("index"), F.struct(F.col("text").alias("transcript")).alias("audio"))
    return reconcile.concatenated(c, "transcript")


# Sources.
@query("SELECT page_id, to_base64(encode(html)) AS data, 'file://' || 'a%20b/' || page_id || '%3F%2B~.html' AS url FROM pages")
def media_parts(spark, d):
    p = table(spark, d, "pages")
    path = F.concat(F.lit("/root/a b/"), F.col("page_id"), F.lit("?+~.html"))
    return p.select("page_id", media.base64_text(F.encode("html", "UTF-8")).alias("data"), media.file_url(path, "/root").alias("url"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL WHEN value > 0 THEN value END AS duration_seconds, (event_id % 3 = 0)::BOOLEAN AS has_video, event_id % 3 <> 2 AS has_audio,
CASE WHEN event_id % 3 = 2 THEN 'no audio or video stream' WHEN NOT value > 0 THEN 'no positive duration' END AS error FROM events""")
def media_probe(spark, d):
    stream = lambda kind, cover: f'{{"codec_type": "{kind}", "width": 640, "height": 360, "disposition": {{"attached_pic": {cover}}}}}'
    m = F.col("event_id") % 3
    streams = F.when(m == 0, f"{stream('video', 1)}, {stream('video', 0)}, {stream('audio', 0)}").when(m == 1, f"{stream('video', 1)}, {stream('audio', 0)}").otherwise(stream("data", 0))
    reply = F.concat(F.lit('{"streams": ['), streams, F.lit('], "format": {"duration": "'), F.col("value").cast("string"), F.lit('"}}'))
    return media.probed(table(spark, d, "events").select("event_id", reply.alias("probe"))).select("event_id", "duration_seconds", "has_video", "has_audio", "error")
