"""The chronological report: events in order, Markdown, and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import timestamp

BREAK = "  \n*Translation:* "


def _said(speaker: Column, text: Column, translation: Column) -> Column:
    more = T.text_or(translation)
    return F.concat(F.lit("**"), T.text_or(speaker, "Speaker"), F.lit(":** "), T.text_or(text), F.when(more != "", F.concat(F.lit(BREAK), more)).otherwise(""))


def events(chunks: DataFrame) -> DataFrame:
    """chunks with `events`: array of (start, kind, pos, body), kind 0 a shot and 1 speech, in order of time.

    Speech comes by segment where the segments tell the whole transcript; else as the transcript at the first one.
    """
    at = F.col("start_seconds")
    shots = F.transform(
        F.coalesce("visual.shots", F.array().cast(chunks.schema["visual"].dataType["shots"].dataType)),
        lambda s, i: F.struct(
            F.coalesce(s["start"], at).alias("start"), F.lit(0).alias("kind"), i.alias("pos"),
            F.concat(F.lit("**Visual:** "), T.text_or(s["description"], "Visual event"), F.when(T.joined(s["visible_text"]) != "", F.concat(F.lit(" Visible text: "), T.joined(s["visible_text"]))).otherwise("")).alias("body"),
        ),
    )
    df = chunks.withColumn("_segments", F.filter(F.coalesce("audio.segments", F.array().cast(chunks.schema["audio"].dataType["segments"].dataType)), lambda s: T.text_or(s["text"]) != ""))
    df = df.withColumn("_told", T.text_or(F.col("audio.transcript")))
    line = F.array_join(F.transform("_segments", lambda s: T.strip(s["text"])), " ")
    df = df.withColumn("_whole", (F.col("_told") == "") | T.equivalent(F.col("_told"), line))
    each = F.transform("_segments", lambda s, i: F.struct(F.coalesce(s["start"], at).alias("start"), F.lit(1).alias("kind"), i.alias("pos"), _said(s["speaker"], s["text"], s["translation"]).alias("body")))
    head = F.get("_segments", F.lit(0))
    one = F.array(F.struct(F.coalesce(head["start"], at).alias("start"), F.lit(1).alias("kind"), F.lit(0).alias("pos"), _said(head["speaker"], F.col("_told"), F.col("audio.translation")).alias("body")))
    speech = F.when(F.col("_whole"), each).when(F.size("_segments") > 0, one).otherwise(F.filter(each, lambda e: F.lit(False)))
    return df.withColumn("events", F.array_sort(F.concat(shots, speech))).drop("_told", "_whole")


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """chunks with `lines`, the report's part on each."""
    v = lambda name: F.col(f"visual.{name}")
    labelled = lambda label, text: F.when(text != "", F.array(F.concat(F.lit(f"**{label}:** "), text))).otherwise(F.array().cast("array<string>"))
    apart = lambda lines: F.when(F.size(lines) > 0, F.concat(lines, F.array(F.lit("")))).otherwise(lines)
    scene = F.concat(labelled("Scene", T.text_or(v("summary"))), labelled("Setting", T.text_or(v("setting"))), labelled("People", T.joined(v("people"))), labelled("Objects", T.joined(v("objects"))))
    df = events(chunks)
    timeline = F.flatten(F.transform("events", lambda e: F.array(F.concat(F.lit("`"), timestamp(e["start"]), F.lit("` "), e["body"]), F.lit(""))))
    plain = F.when(F.size("_segments") == 0, F.concat(apart(labelled("Transcript", T.text_or(F.col("audio.transcript")))), apart(labelled("Translation", T.text_or(F.col("audio.translation")))))).otherwise(F.array().cast("array<string>"))
    title = F.concat(F.lit("### "), timestamp(F.col("start_seconds")), F.lit("–"), timestamp(F.col("start_seconds") + F.col("duration_seconds")))
    sounds = apart(labelled("Non-speech audio", T.joined(F.col("audio.non_speech_audio"))))
    return df.withColumn("lines", F.concat(F.array(title, F.lit("")), apart(scene), timeline, plain, sounds)).drop("_segments")


def markdown(documents: DataFrame, chunks: DataFrame, title: str = "Analysis") -> DataFrame:
    """(media_id, markdown) of documents (media_id, source, media_type, duration_seconds, backend, model)."""
    lines = chunk_lines(chunks).groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("index", "lines"))).alias("_parts"))
    kind = F.initcap(T.text_or(F.col("media_type"), "media"))
    quoted = lambda name, c: F.concat(F.lit(f"- {name}: `"), F.coalesce(c, F.lit("None")), F.lit("`"))
    head = F.array(
        F.concat(F.lit("# "), kind, F.lit(f" {title}")), F.lit(""), quoted("Source", F.col("source")), F.concat(F.lit("- Media type: "), kind),
        F.concat(F.lit("- Duration: "), timestamp(F.col("duration_seconds"))), quoted("Backend", F.col("backend")), quoted("Model", F.col("model")),
        F.lit(""), F.lit("## Chronological script"), F.lit(""),
    )
    body = F.coalesce(F.flatten(F.transform("_parts", lambda p: p["lines"])), F.array().cast("array<string>"))
    return documents.join(lines, "media_id", "left").select("media_id", F.concat(T.rstrip(F.array_join(F.concat(head, body), "\n")), F.lit("\n")).alias("markdown"))


def documents_json(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(media_id, json) with the chunks in order; absent fields are left out."""
    held = chunks.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("index", F.to_json(F.struct("index", "start_seconds", "duration_seconds", "audio", "visual")).alias("j")))).alias("_c"))
    parts = F.concat(F.lit('"chunks":['), F.coalesce(F.array_join(F.transform("_c", lambda c: c["j"]), ","), F.lit("")), F.lit("]}"))
    fields = F.to_json(F.struct(*(c for c in documents.columns if c != "media_id")))
    return documents.join(held, "media_id", "left").select("media_id", F.concat(F.regexp_replace(fields, r"\}$", ","), parts).alias("json"))
