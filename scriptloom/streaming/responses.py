"""Replies that arrive in lines: server-sent events and newline-delimited JSON.

A reply is bounded, so these are batch operators over a table of lines (response_id, pos, line), and plain functions
for the HTTP client that reads one reply.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BackendError
from ..functions import text as T


def content(value: object) -> str:
    """Of a chat message: a string, or a list of strings and {text} objects."""
    if isinstance(value, str):
        return value
    pieces = (p.get("text") if isinstance(p, dict) else p for p in value) if isinstance(value, list) else ()
    return "".join(p for p in pieces if isinstance(p, str))


def _decoded(lines: Iterable[bytes | str]) -> Iterator[str]:
    for line in lines:
        if text := (line.decode() if isinstance(line, bytes) else line).strip():
            yield text


def _event(payload: str, who: str) -> dict:
    try:
        event = json.loads(payload)
    except json.JSONDecodeError as e:
        raise BackendError(f"{who} sent a line that isn't JSON: {payload[:120]}") from e
    if event.get("error"):
        raise BackendError(f"{who} reports: {event['error']}")
    return event


def read_sse(lines: Iterable[bytes | str]) -> str:
    out = []
    for line in _decoded(lines):
        if not line.startswith("data:"):
            continue
        payload = line.removeprefix("data:").strip()
        if payload == "[DONE]":
            break
        for choice in (_event(payload, "the chat server").get("choices") or [])[:1]:
            delta = (choice.get("delta") or {}).get("content")
            out.append(content((choice.get("message") or {}).get("content") if delta is None else delta))
    return "".join(out)


def read_ndjson(lines: Iterable[bytes | str]) -> str:
    return "".join(content((_event(line, "the model server").get("message") or {}).get("content")) for line in _decoded(lines))


def _content(v: Column, path: str) -> Column:
    several = F.try_variant_get(v, path, "array<variant>")
    of = lambda e: F.coalesce(F.try_variant_get(e, "$.text", "string"), F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string")), F.lit(""))
    return F.when(several.isNotNull(), F.array_join(F.transform(several, of), "")).otherwise(F.try_variant_get(v, path, "string"))


def _assembled(payloads: DataFrame, text: Column) -> DataFrame:
    """response_id, text and error (of the first line that has one); payloads: response_id, pos, payload."""
    v = F.col("_v")
    error = F.when(v.isNull(), F.concat(F.lit("not JSON: "), F.substring("payload", 1, 120))).otherwise(F.try_variant_get(v, "$.error", "string"))
    read = payloads.withColumn("_v", F.try_parse_json("payload")).select("response_id", "pos", F.coalesce(text, F.lit("")).alias("t"), F.nullif(error, F.lit("")).alias("e"))
    out = read.groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("p"), F.min_by("e", F.when(F.col("e").isNotNull(), F.col("pos"))).alias("error"))
    whole = F.array_join(F.transform("p", lambda x: x["t"]), "")
    return out.select("response_id", F.when(F.col("error").isNull(), whole).alias("text"), "error")


def sse(lines: DataFrame) -> DataFrame:
    """One row per response of an event stream: text, or the error that it ran into before [DONE]."""
    line = T.strip(F.col("line"))
    data = lines.where(line.startswith("data:")).select("response_id", "pos", T.strip(F.substring(line, 6, 1 << 30)).alias("payload"))
    ends = data.groupBy("response_id").agg(F.min(F.when(F.col("payload") == "[DONE]", F.col("pos"))).alias("end"))
    live = data.join(ends, "response_id").where("end IS NULL OR pos < end")
    delta, message = _content(F.col("_v"), "$.choices[0].delta.content"), _content(F.col("_v"), "$.choices[0].message.content")
    every = lines.select("response_id").distinct()
    return every.join(_assembled(live, F.coalesce(delta, message)), "response_id", "left").select("response_id", F.when(F.col("error").isNull(), F.coalesce("text", F.lit(""))).alias("text"), "error")


def ndjson(lines: DataFrame) -> DataFrame:
    line = T.strip(F.col("line"))
    data = lines.where(line != "").select("response_id", "pos", line.alias("payload"))
    every = lines.select("response_id").distinct()
    return every.join(_assembled(data, _content(F.col("_v"), "$.message.content")), "response_id", "left").select("response_id", F.when(F.col("error").isNull(), F.coalesce("text", F.lit(""))).alias("text"), "error")
