"""Speech in order: windows whose first words would start before the last ones of the window before are pressed behind them.

What a window leaves to the next is the start of its last segment, and that is a function of what it got itself: up to
a threshold its own last start, beyond it a line that rises up to the window's end. Such functions are closed under
composition, so no item is folded as a whole: BUCKET windows make one function, BUCKET of those another, an item's few
functions are applied one after the other, and going down again every bucket knows where it begins. All of it runs in
expressions over thin records of numbers; segments are moved in the rows where they are.

A window's own step is computed in the order of the plain rules, only what comes from earlier buckets is composed.
Segments without a start count with the window's first; a window whose first segment has none is never moved. Items with
such segments, or with a last start behind its window's end, are outside the class of functions: their thin records make
a single bucket. Windows without segments are passed over. Null and empty tables give themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SEGMENT

TICK = 0.001
#: Windows in a bucket, and levels of buckets.
BUCKET, LEVELS = 64, 2
#: A window: its end, its first and last start, how far its latest start lies behind the first. A function of the last
#: start before: `low` up to `until`, beyond it the least of `high` and base + rate * x.
STEP = "struct<end:double,first:double,last:double,reach:double>"
LINE = "struct<until:double,low:double,base:double,rate:double,high:double>"
NEVER = float("-inf")


def _bound(step: Column, before: Column) -> Column:
    return F.least(step["end"], before + TICK)


def _moved(step: Column, before: Column) -> Column:
    return F.coalesce(step["first"] < _bound(step, before), F.lit(False))


def _scale(step: Column, bound: Column) -> Column:
    """Of the moved window's times behind its first start."""
    span = step["end"] - step["first"]
    return F.when(span > 0, F.greatest(F.lit(0.0), step["end"] - bound) / span).otherwise(0.0)


def _through_step(step: Column, before: Column) -> Column:
    """The last start that a window leaves."""
    b = _bound(step, before)
    return F.when(_moved(step, before), F.least(step["end"], b + step["reach"] * _scale(step, b))).otherwise(F.coalesce(step["last"], before))


def _through_line(line: Column, x: Column) -> Column:
    return F.when(x <= line["until"], line["low"]).otherwise(F.least(line["high"], line["base"] + line["rate"] * x))


def _line(step: Column) -> Column:
    span = step["end"] - step["first"]
    rate = F.greatest(F.lit(0.0), 1 - step["reach"] / span)
    fixed = F.struct(F.lit(float("inf")).alias("until"), step["last"].alias("low"), F.lit(0.0).alias("base"), F.lit(0.0).alias("rate"), step["end"].alias("high"))
    free = F.struct((step["first"] - TICK).alias("until"), step["last"].alias("low"), (step["end"] - (step["end"] - TICK) * rate).alias("base"), rate.alias("rate"), step["end"].alias("high"))
    return F.when(span > 0, free).otherwise(fixed)


def _composed(f: Column, g: Column) -> Column:
    """g after f, where neither falls."""
    # beyond its threshold f passes that of g where its line does, if it ever does
    passes = F.when(f["high"] <= g["until"], F.lit(float("inf"))).when(f["rate"] > 0, (g["until"] - f["base"]) / f["rate"]).when(f["base"] > g["until"], F.lit(NEVER)).otherwise(F.lit(-NEVER))
    return F.struct(
        F.greatest(f["until"], passes).alias("until"), _through_line(g, f["low"]).alias("low"), (g["base"] + g["rate"] * f["base"]).alias("base"),
        (g["rate"] * f["rate"]).alias("rate"), F.least(g["high"], g["base"] + g["rate"] * f["high"]).alias("high"),
    )


def _before(rows: DataFrame, through, line, level: int) -> DataFrame:
    """rows (media_id, at, whole, f) as media_id, at, before: what all earlier ones leave. whole: of items that stay in one bucket."""
    key = F.when(F.col("whole") | (level == 0), F.lit(0)).otherwise(F.floor(F.col("at") / BUCKET)).cast("int")
    held = rows.groupBy("media_id", key.alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("at", "f"))).alias("fs"), F.first("whole").alias("whole"))
    if level == 0:
        seeded = held.withColumn("seed", F.lit(NEVER))
    else:
        first = line(F.get("fs", F.lit(0))["f"])
        rest = F.aggregate(F.slice("fs", F.lit(2), F.greatest(F.lit(0), F.size("fs") - 1)), first, lambda acc, x: _composed(acc, line(x["f"])))
        # the one bucket of a `whole` item needs no function
        lines = held.select("media_id", F.col("bucket").alias("at"), "whole", F.when(~F.col("whole"), rest).cast(LINE).alias("f"))
        up = _before(lines, _through_line, lambda f: f, level - 1).withColumnRenamed("at", "bucket").withColumnRenamed("before", "seed")
        seeded = held.join(up, ["media_id", "bucket"])
    start = F.struct(F.col("seed").alias("x"), F.array().cast("array<struct<at:int,before:double>>").alias("out"))
    step = lambda acc, r: F.struct(through(r["f"], acc["x"]).alias("x"), F.concat(acc["out"], F.array(F.struct(r["at"].alias("at"), acc["x"].alias("before")))).alias("out"))
    return seeded.select("media_id", F.explode(F.aggregate("fs", start, step)["out"]).alias("r")).select("media_id", "r.at", "r.before")


def steps(chunks: DataFrame) -> DataFrame:
    """media_id, at, whole, f: the thin records of the windows with segments."""
    starts = F.col("audio.segments.start")
    first, last = F.get(starts, F.lit(0)), F.element_at(starts, -1)
    end = F.col("start_seconds") + F.col("duration_seconds")
    reach = F.array_max(F.transform(starts, lambda s: F.greatest(F.lit(0.0), F.coalesce(s, first) - first)))
    spoken = chunks.where(F.size("audio.segments") > 0).select("media_id", F.col("index").alias("at"), F.struct(end.alias("end"), first.alias("first"), last.alias("last"), reach.alias("reach")).cast(STEP).alias("f"))
    odd = F.col("f.first").isNull() | F.col("f.last").isNull() | (F.col("f.last") > F.col("f.end"))
    by_item = Window.partitionBy("media_id")
    # only items of which a window can move: until one does, every window leaves its own last start
    before = F.last("f.last", ignorenulls=True).over(by_item.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    marked = spoken.withColumn("moves", F.coalesce(_moved(F.col("f"), before), F.lit(False)))
    marked = marked.withColumns({"whole": F.max(odd).over(by_item), "any": F.max("moves").over(by_item)})
    return marked.where("any").select("media_id", "at", "whole", "f")


def moved(chunks: DataFrame) -> DataFrame:
    """media_id, index, minimum: the windows that have to move, and where they may begin."""
    thin = steps(chunks)
    found = thin.join(_before(thin, _through_step, _line, LEVELS), ["media_id", "at"])
    return found.where(_moved(F.col("f"), F.col("before"))).select("media_id", F.col("at").alias("index"), _bound(F.col("f"), F.col("before")).alias("minimum"))


def in_order(chunks: DataFrame) -> DataFrame:
    """chunks (schema.CHUNK) with the segments of such windows between the bound and the window's end, in the same proportions."""
    found = chunks.join(moved(chunks), ["media_id", "index"], "left")
    end, bound, segments = F.col("start_seconds") + F.col("duration_seconds"), F.col("minimum"), F.col("audio.segments")
    first = F.get(segments["start"], F.lit(0))
    scale = _scale(F.struct(end.alias("end"), first.alias("first")), bound)

    def one(acc: Column, s: Column) -> Column:
        a = F.coalesce(s["start"], first)
        b = F.greatest(a, F.coalesce(s["end"], a))
        at = lambda x, floor: F.least(end, F.greatest(floor, bound + F.greatest(F.lit(0.0), x - first) * scale))
        return F.struct(at(a, acc["floor"]).alias("floor"), F.concat(acc["out"], F.array(s.withField("start", at(a, acc["floor"])).withField("end", at(b, at(a, acc["floor"]))))).alias("out"))

    pressed = F.aggregate(segments, F.struct(bound.alias("floor"), F.array().cast(f"array<{SEGMENT}>").alias("out")), one)["out"]
    note = F.struct(F.lit("monotonic-overlap").alias("strategy"), bound.alias("minimum_start"))
    audio = F.when(bound.isNotNull(), F.col("audio").withField("segments", pressed).withField("timestamp_reconciliation", note)).otherwise(F.col("audio"))
    return found.withColumn("audio", audio).select(*chunks.columns)
