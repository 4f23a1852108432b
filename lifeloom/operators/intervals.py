"""Interval algebra on rows: half-open [start, end), a null end is open.

Sets of intervals are tables of (keys..., start, end). All operators sort once by key and need no user function. Empty
intervals (start >= end) and those without a start count for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAR = "9999-12-31 00:00:00"


def far(like: Column | None = None) -> Column:
    """The instant that stands for an open end inside the operators."""
    return F.lit(FAR).cast("timestamp_ntz")


def _closed(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    kept = df.select(*keys, F.col(start).cast("timestamp_ntz").alias("start"), F.coalesce(F.col(end).cast("timestamp_ntz"), far()).alias("end"))
    return kept.where(F.col("start") < F.col("end"))


def _open(end: Column) -> Column:
    return F.when(end < far(), end)


def contains(start: Column, end: Column, t: Column) -> Column:
    return (start <= t) & (end.isNull() | (t < end))


def overlap_start(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def overlap_end(a: Column, b: Column) -> Column:
    """least() skips nulls, so an open end gives way to the other."""
    return F.least(a, b)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The two share a time of some length."""
    return F.greatest(a_start, b_start) < F.coalesce(F.least(a_end, b_end), far())


def merge(df: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or touching intervals of a key made one."""
    w = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = _closed(df, keys).withColumn("reached", F.max("end").over(w))
    fresh = F.when(F.col("reached").isNull() | (F.col("start") > F.col("reached")), 1).otherwise(0)
    order = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    islands = reached.withColumn("island", F.sum(fresh).over(order))
    merged = islands.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.select(*keys, "start", _open(F.col("end")).alias("end"))


def _sweep(sides: list[DataFrame], keys: list[str]) -> DataFrame:
    """Elementary segments of a key with the number of intervals of each side that cover them: (keys, start, end, n0, n1...)."""
    events = None
    for i, side in enumerate(sides):
        own = _closed(side, keys)
        cols = [F.lit(1 if i == j else 0).alias(f"d{j}") for j in range(len(sides))]
        back = [F.lit(-1 if i == j else 0).alias(f"d{j}") for j in range(len(sides))]
        both = own.select(*keys, F.col("start").alias("t"), *cols).unionByName(own.select(*keys, F.col("end").alias("t"), *back))
        events = both if events is None else events.unionByName(both)
    sums = events.groupBy(*keys, "t").agg(*(F.sum(f"d{j}").alias(f"d{j}") for j in range(len(sides))))
    order = Window.partitionBy(*keys).orderBy("t")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return sums.select(
        *keys, F.col("t").alias("start"), F.lead("t").over(order).alias("end"), *(F.sum(f"d{j}").over(running).alias(f"n{j}") for j in range(len(sides)))
    ).where("end is not null")


def subtract(base: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """What of base no interval of taken covers, merged."""
    left = _sweep([base, taken], keys).where("n0 > 0 and n1 = 0")
    return merge(left.select(*keys, "start", "end"), keys)


def intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """What both sets cover, merged."""
    both = _sweep([a, b], keys).where("n0 > 0 and n1 > 0")
    return merge(both.select(*keys, "start", "end"), keys)


def covered(required: DataFrame, covering: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fully_covered) of each key of required: nothing is left after subtraction."""
    left = subtract(required, covering, keys).select(*keys).distinct().withColumn("left", F.lit(True))
    return _closed(required, keys).select(*keys).distinct().join(left, keys, "left").select(*keys, F.col("left").isNull().alias("fully_covered"))


def segments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Elementary intervals between the event points of a key that at least one interval covers, with how many do."""
    found = _sweep([df], keys).where("n0 > 0")
    return found.select(*keys, "start", _open(F.col("end")).alias("end"), F.col("n0").alias("active"))


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], touching_point: bool = True) -> DataFrame:
    """Rows of a and b of one key whose intervals overlap, with the common interval as (i_start, i_end).

    Columns: on, those of a, those of b (start and end of b as b_start, b_end). With touching_point a row of no length
    strictly inside the other interval counts as well.
    """
    other = b.withColumnsRenamed({"start": "b_start", "end": "b_end"})
    ae, be = F.coalesce("end", far()), F.coalesce("b_end", far())
    met = (F.col("start") < be) & (F.col("b_start") < ae)
    if not touching_point:
        met = met & overlaps(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end"))
    joined = a.join(other, on).where(met)
    return joined.withColumns({"i_start": F.greatest("start", "b_start"), "i_end": F.least("end", "b_end")})
