"""What earlier windows hand on to the next one: a short record of speech and pictures, by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import compact, with_translation

LIMIT, OPENING, RECENT, SUMMARY, ACTION, SETTING = 1600, 240, 360, 180, 220, 100
ITEMS, ITEM, LOOK_BACK, SPOKEN_BACK = 5, 60, 3, 2
#: How the sections begin, in their order.
LABELS = {
    "opening": "Opening spoken context (background only; it may no longer apply): ", "recent": "Recent spoken context: ",
    "summary": "Previous visual summary (provisional): ", "action": "Last observed action (provisional): ",
    "objects": "Recently observed objects (provisional): ", "setting": "Previous setting (provisional): ",
}


def first_of_each(items: Column, most: int) -> Column:
    """The first spelling of each item (compared case-folded), in order, at most `most`."""
    made = F.filter(F.transform(items, lambda i: T.compact(i, ITEM)), lambda i: i != "")
    first = lambda them, keys: F.filter(them, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    return F.slice(T.let(made, lambda them: T.let(F.transform(them, lambda i: T.casefold(i)), lambda keys: first(them, keys))), 1, most)


def with_continuity(chunks: DataFrame, by: str = "media_id", order: str = "index") -> DataFrame:
    """chunks with `continuity`, the record that each hands to the model, '' for the first."""
    w = Window.partitionBy(by).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = chunks.withColumn("_said", F.nullif(T.audio_text(F.col("audio")), F.lit("")))
    last = lambda c: F.lag(c).over(w)
    df = df.withColumns({
        "_opening": F.first("_said", ignorenulls=True).over(before), "_recent": F.collect_list("_said").over(w.rowsBetween(-SPOKEN_BACK, -1)),
        "_summary": last("visual.summary"), "_shots": last("visual.shots"), "_setting": last("visual.setting"),
        "_objects": F.flatten(F.collect_list("visual.objects").over(w.rowsBetween(-LOOK_BACK, -1))), "_nth": F.row_number().over(w),
    })
    recent = F.array_join(F.filter("_recent", lambda t: t != F.col("_opening")), " ")
    action = F.element_at(F.col("_shots"), -1)["description"]
    values = {
        "opening": T.compact(F.col("_opening"), OPENING), "recent": T.compact(recent, RECENT), "summary": T.compact(F.col("_summary"), SUMMARY),
        "action": F.when(F.size("_shots") > 0, T.compact(action, ACTION)), "objects": F.array_join(first_of_each(F.col("_objects"), ITEMS), "; "),
        "setting": T.compact(F.col("_setting"), SETTING),
    }
    record = F.when(F.col("_nth") == 1, "").otherwise(T.compact(T.labelled({LABELS[k]: v for k, v in values.items()}), LIMIT))
    return df.withColumn("continuity", record).drop("_said", "_opening", "_recent", "_summary", "_shots", "_setting", "_objects", "_nth")


def continuity(previous: list[dict]) -> str:
    """The record in plain Python, for the visual fold, where each window waits for the ones before."""
    if not previous:
        return ""
    heard = [c.get("audio") or {} for c in previous]
    speech = [with_translation(compact(a.get("transcript"), 1200), compact(a.get("translation"), 1200), " ") for a in heard]
    opening = next(filter(None, speech), "")
    visual = previous[-1].get("visual") or {}
    shots = [s for s in visual.get("shots") or [] if isinstance(s, dict)]
    items: dict[str, str] = {}
    for c in previous[-LOOK_BACK:]:
        for value in (c.get("visual") or {}).get("objects") or []:
            if text := compact(value, ITEM):
                items.setdefault(text.casefold(), text)
    values = {
        "opening": compact(opening, OPENING), "recent": compact(" ".join(t for t in speech[-SPOKEN_BACK:] if t and t != opening), RECENT),
        "summary": compact(visual.get("summary"), SUMMARY), "action": compact(shots[-1].get("description"), ACTION) if shots else "",
        "objects": "; ".join(list(items.values())[:ITEMS]), "setting": compact(visual.get("setting"), SETTING),
    }
    return compact("\n".join(LABELS[k] + v for k, v in values.items() if v), LIMIT)
