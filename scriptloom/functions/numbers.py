"""Time, interval and key functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_time(x: Column, fallback: Column) -> Column:
    """A double, not below 0; fallback for what isn't a finite number."""
    d = x.try_cast("double") if hasattr(x, "try_cast") else x.cast("double")
    good = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
    return F.greatest(F.lit(0.0), F.when(good, d).otherwise(fallback))


def variant_time(v: Column, path: str, fallback: Column) -> Column:
    """clean_time of a member of a VARIANT; true counts as 1."""
    return clean_time(F.try_variant_get(v, path, "double"), fallback)


def timestamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm, rounded half to even, hours unbounded."""
    ms = F.greatest(F.lit(0), F.bround(seconds * 1000).cast("long"))
    part = lambda n, of: F.floor(ms / n) % of
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), part(60_000, 60), part(1000, 60), ms % 1000)


def normalize_intervals(df: DataFrame, chunk: list[str], position: str, start: str, end: str, duration: str) -> DataFrame:
    """Adds norm_start and norm_end: starts never fall, lengths stay, and what exceeds the duration is scaled into it.

    A row per interval, in the order of position within chunk; a null duration doesn't bound.
    """
    so_far = Window.partitionBy(*chunk).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    s = F.greatest(F.lit(0.0), F.max(start).over(so_far))
    df = df.withColumn("_s", s).withColumn("_e", F.col("_s") + F.greatest(F.lit(0.0), F.col(end) - F.col(start)))
    d = F.greatest(F.lit(0.0), F.col(duration))
    last = F.max("_e").over(Window.partitionBy(*chunk))
    scale = F.when((last > d) & (last > 0), d / last).otherwise(F.lit(1.0))
    df = df.withColumn("_k", scale)
    ns, ne = F.col("_s") * F.col("_k"), F.col("_e") * F.col("_k")
    free = F.col(duration).isNull()
    return df.withColumns({
        "norm_start": F.when(free, F.col("_s")).otherwise(F.least(d, ns)),
        "norm_end": F.when(free, F.col("_e")).otherwise(F.least(d, F.greatest(ns, ne))),
    }).drop("_s", "_e", "_k")


def midpoint(shot: Column, seam: Column) -> Column:
    s = F.coalesce(shot["start"], seam)
    return (s + F.coalesce(shot["end"], s)) / 2


def stable_key(**fields: Column) -> Column:
    """16 hexadecimal digits over the fields, by name."""
    ordered = F.struct(*(v.alias(k) for k, v in sorted(fields.items())))
    return F.substring(F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256), 1, 16)
