"""Earlier results by content key: what is still to do, what is there already, and the keys."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import stable_key
from ..schema import CONTEXT_VERSION
from ..sources.publish import published


def workspace_key(path: Column, size: Column, modified: Column, chunk: Column, overlap: Column, fps: Column, edge: Column) -> Column:
    """Of a source as it is now, and how it is prepared."""
    return stable_key(path=path, size=size, modified=modified, chunk_seconds=chunk, chunk_overlap_seconds=overlap, fps=fps, max_edge=edge)


def visual_key(transcript: Column, continuity: Column, user_context: Column) -> Column:
    """A changed context calls for new pictures' descriptions, but not for new transcripts."""
    return stable_key(version=F.lit(CONTEXT_VERSION), user_context=user_context, transcript=transcript, continuity=continuity)


def pending(work: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of work without a result."""
    return work.join(cache.select(*keys).distinct(), keys, "left_anti")


def resumed(work: DataFrame, cache: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame], again: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(results of all work, those newly computed). again: applied to what the cache holds, such as re-validation."""
    hits = work.join(cache, keys, "inner")
    fresh = compute(pending(work, cache, keys))
    return (again(hits) if again else hits).unionByName(fresh), fresh


class Results:
    """Results of calls as JSON files by key, in a folder that all executors share; without a folder nothing is kept.

    They are written from inside tasks, so a task that runs again after a lost executor asks for nothing twice. A file
    appears whole or not at all; one that isn't a JSON object counts as missing.
    """

    def __init__(self, folder: str | None, **common):
        self.folder, self.common = folder, common

    def _at(self, key: dict) -> Path:
        name = hashlib.sha256(json.dumps(self.common | key, sort_keys=True).encode()).hexdigest()
        return Path(self.folder, name[:2], f"{name}.json")

    def of(self, key: dict, ask: Callable[[], dict], settle: Callable[[dict], dict]) -> dict:
        """settle()d result of ask(). An earlier result is settled again, and rewritten if that changes it."""
        if not self.folder:
            return settle(ask())
        at = self._at(key)
        try:
            held = json.loads(at.read_text())
        except (OSError, ValueError):
            held = None
        found = isinstance(held, dict)
        out = settle(held if found else ask())
        if not found or out != held:
            published(at, lambda part: part.write_text(json.dumps(out)))
        return out
