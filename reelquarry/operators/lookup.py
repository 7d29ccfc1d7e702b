"""Keyed lookups as joins: references with misses, wanted keys, ranges, tables with a default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def resolve_references(refs: DataFrame, targets: DataFrame, keys: list[str], order: str) -> DataFrame:
    """References with the target that came last under their keys; `found` is false for a miss."""
    rest = [c for c in targets.columns if c not in keys]
    last = targets.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("target"))
    joined = refs.join(last, keys, "left")
    return joined.select(*refs.columns, F.col("target").isNotNull().alias("found"), *[F.col(f"target.{c}").alias(c) for c in rest])


def wanted(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is wanted; with no key at all, all rows."""
    return rows if keys.isEmpty() else rows.join(keys, on, "left_semi")


def not_found(keys: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """Wanted keys, each once, that no row has."""
    return keys.select(*on).distinct().join(rows.select(*on).distinct(), on, "left_anti")


def offset_to_segment(offsets: DataFrame, segments: DataFrame, keys: list[str], offset: str) -> DataFrame:
    """Each offset with the segment (keys, log_start, length, ...) that holds it.

    Segments of a key don't overlap, so only the last one that starts at or before an offset can hold it: offsets and
    segments of a key are sorted together once. Empty segments hold none, and offsets that none holds have no row.
    """
    extra = [c for c in segments.columns if c not in keys]
    rows = offsets.select(*keys, F.col(offset).cast("long").alias("__at"), F.struct(*offsets.columns).alias("__row"), F.lit(None).cast(segments.select(F.struct(*extra).alias("s")).schema["s"].dataType).alias("__segment"))
    marks = segments.filter("length > 0").select(*keys, F.col("log_start").cast("long").alias("__at"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), F.struct(*extra).alias("__segment"))
    order = Window.partitionBy(*keys).orderBy("__at", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.union(marks).withColumn("__last", F.last("__segment", ignorenulls=True).over(order)).filter("__row IS NOT NULL")
    held = found.filter(F.col("__at") < F.col("__last.log_start") + F.col("__last.length"))
    return held.select(*[F.col(f"__row.{c}").alias(c) for c in offsets.columns], *[F.col(f"__last.{c}").alias(c) for c in extra])


def coded(code: Column, values: dict[int, int], default: int) -> tuple[Column, Column]:
    """(value, known) of a code under a small table."""
    value = F.lit(None).cast("int")
    for k, v in values.items():
        value = F.when(code == k, F.lit(v)).otherwise(value)
    return F.coalesce(value, F.lit(default)), value.isNotNull()
