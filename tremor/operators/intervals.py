"""Joins of points and intervals by an index of blocks.

An interval of up to 2**k lines is put into blocks of 2**(k - FINE) lines, of which it meets five
at most; a point looks into one block of each size that its group has. Keys are equal on both
sides, so the join is an ordinary one, an interval has five rows, a point at most as many as
there are sizes, and what meets without matching is about a quarter of what matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINE = 2


def _shift(size: Column) -> Column:
    """log2 of the block of an interval of this size."""
    return F.greatest(F.ceil(F.log2(size.cast("double"))).cast("int") - FINE, F.lit(0))


def _block(place: Column, shift: Column) -> Column:
    return F.call_function("shiftright", place.cast("long"), shift)


def points_in_intervals(points: DataFrame, intervals: DataFrame, group: str, point: str, low: str, high: str) -> DataFrame:
    """Every point with every interval of its group that holds it: both sides' columns, the group once.

    Bounds belong to the interval; one whose high is below its low, or with a null bound, holds
    nothing, as do null groups and points. Repeated rows count as often as they stand.
    """
    good = intervals.where(F.col(low) <= F.col(high)).withColumn("_shift", _shift(F.col(high).cast("long") - F.col(low) + 1))
    sizes = good.select(group, "_shift").distinct()
    near = good.withColumn("_block", F.explode(F.sequence(_block(F.col(low), F.col("_shift")), _block(F.col(high), F.col("_shift")))))
    asked = points.where(F.col(point).isNotNull()).join(sizes, group).withColumn("_block", _block(F.col(point), F.col("_shift")))
    met = asked.join(near, [group, "_shift", "_block"])
    return met.where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("_shift", "_block")


def overlapping_pairs(left: DataFrame, right: DataFrame, group: str, left_bounds: tuple[str, str], right_bounds: tuple[str, str]) -> DataFrame:
    """Every pair of intervals of one group that share a place.

    Two intervals share one exactly if the left one's low lies in the right one, or the right
    one's low lies in the left one beyond its low: two joins of points, which give no pair twice.
    """
    (a, b), (c, d) = left_bounds, right_bounds
    whole = left.where(F.col(a) <= F.col(b)), right.where(F.col(c) <= F.col(d))
    columns = [group, *(x for x in left.columns if x != group), *(x for x in right.columns if x != group)]
    first = points_in_intervals(whole[0], whole[1], group, a, c, d)
    second = points_in_intervals(whole[1], whole[0], group, c, a, b).where(F.col(c) > F.col(a))
    return first.select(columns).unionByName(second.select(columns))
