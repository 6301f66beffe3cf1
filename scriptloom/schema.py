"""Spark types of the records. Time is float seconds throughout."""

from __future__ import annotations

SEGMENT = "struct<start:double,end:double,speaker:string,text:string,translation:string,inferred_timestamp:boolean>"
COVERAGE = "struct<version:string,status:string,complete:boolean>"
BOUNDARY = (
    "struct<strategy:string,retained_boundary:string,removed_suffix_tokens:int,removed_prefix_tokens:int,"
    "matched_prefix_tokens:int,confidence:double,overlap_seconds:double>"
)
RETIMED = "struct<strategy:string,minimum_start:double>"
AUDIO = (
    f"struct<language:string,transcript:string,translation:string,segments:array<{SEGMENT}>,non_speech_audio:array<string>,"
    f"segment_coverage:{COVERAGE},boundary_reconciliation:{BOUNDARY},timestamp_reconciliation:{RETIMED}>"
)
SHOT = "struct<start:double,end:double,description:string,visible_text:array<string>>"
VISUAL = f"struct<summary:string,shots:array<{SHOT}>,people:array<string>,objects:array<string>,setting:string>"
CHUNK = f"media_id string, index int, start_seconds double, duration_seconds double, audio {AUDIO}, visual {VISUAL}"
#: Versions written into results and cache keys.
SEGMENT_VERSION, TIMESTAMP_VERSION, CONTEXT_VERSION = "canonical-transcript-v1", "duration-bounded-affine-v1", "grounded-continuity-v1"


def empty_audio(language: str | None = None) -> dict:
    """What stands for the audio of a chunk without a track."""
    return {"language": language or "none", "transcript": "", "translation": None, "segments": [], "non_speech_audio": []}


def empty_visual() -> dict:
    return {"summary": "", "shots": [], "people": [], "objects": [], "setting": ""}
