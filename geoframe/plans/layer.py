"""Layer: a DataFrame with an `oid` column, attributes and, for feature classes, a geometry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoframe.plans.where import bbox_overlaps, compile_where
from geoframe.types import FormatError


@dataclass
class Layer:
    df: DataFrame
    oid: str = "oid"
    geometry: str | None = "geometry"

    def __post_init__(self):
        if self.geometry not in self.df.columns:
            self.geometry = None

    @property
    def is_table(self) -> bool:
        return self.geometry is None

    @property
    def attributes(self) -> list[str]:
        return [c for c in self.df.columns if c not in (self.oid, self.geometry)]

    def read_features(self, where=None, bbox=None, limit: int | None = None, offset: int = 0, fields=None, parity: bool = False) -> DataFrame:
        """Filter, cut in oid order, project. The bbox test is native and stands apart, so the planner pushes it to the scan.

        parity: a limit below one gives one row, as the first row is counted after it is given."""
        df = self.df
        if where is not None:
            df = df.where(compile_where(where, df.schema))
        if bbox is not None:
            df = df.where(bbox_overlaps(self.geometry, bbox) if self.geometry else F.lit(False))
        if fields is not None:
            wanted = {f.lower() for f in fields}
            df = df.select(*[c for c in df.columns if c in (self.oid, self.geometry) or c.lower() in wanted])
        if limit is not None or offset:
            df = df.orderBy(self.oid)
            df = df.offset(offset) if offset else df
            df = df if limit is None else df.limit(max(1 if parity else 0, limit))
        return df

    def read_feature(self, oid: int) -> DataFrame:
        return self.df.where(F.col(self.oid) == oid)

    def record_count(self) -> int:
        return self.df.count()

    def extent(self) -> DataFrame:
        b = F.col(f"{self.geometry}.bbox")
        return self.df.agg(F.min(b["xmin"]).alias("xmin"), F.min(b["ymin"]).alias("ymin"), F.max(b["xmax"]).alias("xmax"), F.max(b["ymax"]).alias("ymax"))

    def append(self, rows: DataFrame, first: int | None = None) -> "Layer":
        """rows get the next oids. Numbers are given by partition: counts first, then places within each, so no task holds all rows."""
        start = first if first is not None else (self.df.agg(F.max(self.oid)).first()[0] or 0) + 1
        keyed = rows.drop(self.oid).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
        counts = [(r["__p"], r["n"]) for r in keyed.groupBy("__p").agg(F.count("*").alias("n")).orderBy("__p").collect()]
        before, total = [], 0
        for p, n in counts:
            before.append((p, total))
            total += n
        base = F.create_map(*[F.lit(x) for pair in before for x in pair]) if before else F.create_map().cast("map<int,int>")
        place = F.col("__i") - F.shiftleft(F.col("__p").cast("long"), 33)
        new = keyed.withColumn(self.oid, (place + F.element_at(base, F.col("__p")) + start).cast("long")).drop("__p", "__i")
        return Layer(self.df.unionByName(new, allowMissingColumns=True), self.oid, self.geometry)

    def update(self, rows: DataFrame) -> "Layer":
        """Whole records are replaced by oid; an oid that isn't there is an error of the caller and is ignored."""
        known = rows.join(self.df.select(self.oid), self.oid, "left_semi")
        return Layer(self.df.join(rows.select(self.oid), self.oid, "left_anti").unionByName(known, allowMissingColumns=True), self.oid, self.geometry)

    def delete(self, oids: DataFrame) -> "Layer":
        return Layer(self.df.join(oids.select(self.oid), self.oid, "left_anti"), self.oid, self.geometry)

    def checked(self, kind: str) -> DataFrame:
        """Rows whose geometry a layer of that kind can't hold fail the job; points go into multipoint layers."""
        allowed = {"multipoint": ["point", "multipoint"], "line": ["polyline"], "polyline": ["polyline"]}.get(kind, [kind])
        if kind in ("multipatch", "none"):
            return self.df
        g = F.col(f"{self.geometry}.kind")
        bad = g.isNotNull() & ~g.isin("null", *allowed)
        return self.df.withColumn(self.geometry, F.when(bad, F.raise_error(F.concat(F.lit(f"a {kind} layer can't hold a "), g))).otherwise(F.col(self.geometry)))


__all__ = ["Layer", "FormatError"]
