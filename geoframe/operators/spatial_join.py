"""Spatial join: an equi-join on grid cells, the bbox test, and the exact predicate.

Every geometry is dealt to the cells that its bbox meets; a pair is kept only in the cell that
holds the lower left corner of the bboxes' overlap, so no distinct is needed. Neither side is
broadcast: the planner knows the size of a side before it is dealt to cells, not after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.functions.native import st_is_envelope


def _cells(b: Column, size: float, grow: float = 0.0) -> Column:
    at = lambda v: F.floor(v / size).cast("long")
    return F.flatten(F.transform(F.sequence(at(b["xmin"] - grow), at(b["xmax"] + grow)), lambda x: F.transform(F.sequence(at(b["ymin"] - grow), at(b["ymax"] + grow)), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def spatial_join(a: DataFrame, b: DataFrame, ga: str, gb: str, size: float, exact: Column | None = None, within: float = 0.0, how: str = "inner") -> DataFrame:
    """Pairs whose bboxes (a's grown by `within`) meet and for which `exact` holds. Column names must differ between the sides.

    how: inner, left_semi, left_anti or left; the last three need a row id `__id` of a only inside."""
    a = a.withColumn("__id", F.monotonically_increasing_id()) if how != "inner" else a
    left = a.withColumn("__c", F.explode(_cells(F.col(f"{ga}.bbox"), size, within)))
    right = b.withColumn("__d", F.explode(_cells(F.col(f"{gb}.bbox"), size)))
    x, y = F.col(f"{ga}.bbox"), F.col(f"{gb}.bbox")
    meet = (x["xmax"] + within >= y["xmin"]) & (x["xmin"] - within <= y["xmax"]) & (x["ymax"] + within >= y["ymin"]) & (x["ymin"] - within <= y["ymax"])
    first = (F.floor(F.greatest(x["xmin"] - within, y["xmin"]) / size) == F.col("__c.cx")) & (F.floor(F.greatest(x["ymin"] - within, y["ymin"]) / size) == F.col("__c.cy"))
    pairs = left.hint("merge").join(right, (F.col("__c.cx") == F.col("__d.cx")) & (F.col("__c.cy") == F.col("__d.cy")) & meet & first).drop("__c", "__d")
    if exact is not None:
        pairs = pairs.where(exact)
    if how == "inner":
        return pairs
    if how in ("left_semi", "left_anti"):
        return a.join(pairs.select("__id").distinct(), "__id", how).drop("__id")
    return a.join(pairs.select("__id", *b.columns), "__id", "left").drop("__id")


def all_pairs(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
    """The pairs of a nested loop, whose result grows with the square anyway; a is dealt over all cores, however few files it has."""
    return a.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))).join(b, on)


def by_envelope(a: DataFrame, b: DataFrame, ga: str, gb: str, told, exact) -> DataFrame:
    """told(a, b) of the rows on both sides whose geometries are their envelopes (boxes, points), and exact(a, b) of all other pairs.

    Of the former only the envelopes are joined, and no Python function stands above their pairs."""
    whole = lambda df, g: df.where(st_is_envelope(g))
    other = lambda df, g: df.where(~st_is_envelope(g))
    slim = lambda df, g: whole(df, g).withColumn(g, F.struct(F.col(f"{g}.bbox").alias("bbox")))
    return told(slim(a, ga), slim(b, gb)).unionByName(exact(other(a, ga), b)).unionByName(exact(whole(a, ga), other(b, gb)))
