"""A geodatabase as an object: list, read, create, change and copy layers."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoframe.functions import vectorised as V
from geoframe.functions.native import crs_out_of_range
from geoframe.kernel import crs, gdbcodec
from geoframe.plans.layer import Layer
from geoframe.sources import filegdb
from geoframe.types import FIELD_TYPES, GEOMETRY_TYPES, GeoError, SpatialRef, fields

#: Names of attribute and table geometry types in client code.
CONSTANTS = {f"FGFT_{name.upper()}": code for code, (name, _) in FIELD_TYPES.items()} | {f"FGTGT_{name.upper()}": code for name, code in GEOMETRY_TYPES.items()}


class Database:
    """Layers by name. Nothing is held open: what a write has committed is what the next read sees."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        filegdb.open_database(path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, overwrite: bool = False) -> "Database":
        filegdb.create_database(path, overwrite)
        return cls(spark, path)

    def __enter__(self) -> "Database":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Nothing to do; may be called again."""

    def list_layers(self, system: bool = False) -> list[str]:
        return filegdb.list_layers(self.path, system)

    def list_feature_classes(self) -> list[str]:
        return [r["name"] for r in self.items().where("kind = 'feature class'").collect()]

    def list_tables(self) -> list[str]:
        return [r["name"] for r in self.items().where("kind = 'table'").collect()]

    def items(self) -> DataFrame:
        return filegdb.items(self.spark, self.path)

    def spatial_refs(self) -> list[tuple[int, str]]:
        return filegdb.spatial_refs(self.path)

    def definition(self, name: str) -> dict | None:
        return filegdb.definition(self.path, name)

    def read_feature(self, name: str, oid: int) -> dict | None:
        return filegdb.read_feature(self.path, name, oid)

    def append(self, name: str, df: DataFrame) -> int:
        return filegdb.append_rows(df, self.path, name)

    def update(self, name: str, df: DataFrame, oid: str = "OBJECTID") -> None:
        filegdb.update_rows(df, self.path, name, oid)

    def delete(self, name: str, oids: DataFrame, oid: str = "OBJECTID") -> None:
        filegdb.delete_rows(oids, self.path, name, oid)

    def __len__(self) -> int:
        return len(self.list_layers())

    def __iter__(self) -> Iterator[str]:
        return iter(self.list_layers())

    def __contains__(self, name: str) -> bool:
        return name.lower() in map(str.lower, self.list_layers(True))

    def __getitem__(self, name: str) -> Layer:
        return self.get_layer(name)

    def get_layer(self, name: str, **options) -> Layer:
        header = filegdb._header(filegdb.locate(self.path, name))
        oid = next((f.name for f in header.fields if f.type == 6), "OBJECTID")
        geometry = next((f.name for f in header.fields if f.type == 7), None)
        return Layer(filegdb.read_layer(self.spark, self.path, name, **options), oid, geometry)

    def metadata(self, name: str) -> dict:
        h = filegdb._header(filegdb.locate(self.path, name))
        return {"fields": h.fields, "geometry_type": h.geometry_type, "has_z": h.has_z, "has_m": h.has_m, "strings_are_utf8": h.utf8, "record_count": h.rows,
                "spatial_ref": SpatialRef(wkt=h.grid.wkt) if h.grid else None, "extent": h.grid.extent if h.grid else None, "is_table": h.grid is None,
                "alias": (filegdb.definition(self.path, name) or {}).get("alias", ""), "indexes": filegdb.indexes(self.path, name), "has_spatial_index": "spatial" in filegdb.indexes(self.path, name).values()}

    def create_layer(self, name: str, spec=(), geometry_type: str = "none", spatial_ref: SpatialRef = filegdb.WGS84, has_z: bool = False, has_m: bool = False) -> Layer:
        """An empty layer of the given fields."""
        columns = [f"`{f.name}` {f.spark}" for f in fields(spec) if f.type not in (6, 7)]
        if geometry_type != "none":
            columns.append(f"geometry {FIELD_TYPES[7][1]}")
        empty = self.spark.createDataFrame([], ", ".join(columns) or "name string")
        filegdb.write_layer(empty, self.path, name, geometry_type, spatial_ref, has_z=has_z, has_m=has_m)
        return self.get_layer(name)

    def write_layer(self, df: DataFrame, name: str, geometry_type: str = "none", **options) -> int:
        return filegdb.write_layer(df, self.path, name, geometry_type, **options)

    def delete_layer(self, name: str) -> None:
        filegdb.delete_layer(self.path, name)


def transform_layer(layer: Layer, src, dst, where=None, bbox=None, limit=None, offset: int = 0, fields=None) -> DataFrame:
    """Filtered rows with their geometry in another coordinate system. The bbox is in the source's."""
    rows = layer.read_features(where, bbox, limit, offset, fields)
    return rows.withColumn(layer.geometry, V.st_transform(layer.geometry, src, dst)) if layer.geometry else rows


def out_of_range(layer: Layer, src) -> int:
    """How many rows lie outside what their coordinate system can hold: a sign that another was meant."""
    geographic = crs._params(crs.resolve(src))[0] == "geographic"
    return layer.df.where(crs_out_of_range(layer.geometry, geographic)).count()


def write_transformed(layer: Layer, src, dst, db: Database, name: str, geometry_type: str, **filters) -> int:
    """Copy a layer to another coordinate system; its grid follows the new extent. Old row numbers aren't kept."""
    rows = transform_layer(layer, src, dst, **filters).drop(layer.oid)
    e = Layer(rows, geometry=layer.geometry).extent().first()
    geographic = crs._params(crs.resolve(dst))[0] == "geographic"
    q = crs.quantization(*(v or 0.0 for v in e), geographic)
    grid = gdbcodec.Grid(wkt=f'ID["EPSG",{crs.resolve(dst)}]', origin=(q["xorigin"], q["yorigin"], -100000.0, -100000.0), scale=(q["xyscale"], q["xyscale"], 1e4, 1e4),
                         tolerance=(q["xytolerance"], 1e-3, 1e-3), extent=tuple(float("nan") if v is None else v for v in e))
    return db.write_layer(rows, name, geometry_type, geometry=layer.geometry, grid=grid)


def ewkt(geometry: str, srid: int) -> Column:
    """Text for a spatial database: write the frame with df.write.jdbc(...) and cast the column there."""
    return F.concat(F.lit(f"SRID={srid};"), V.st_as_text(geometry))


def main(args: list[str] | None = None) -> int:
    """Copy a layer to another coordinate system. 0: done, 1: failed, 2: bad arguments."""
    p = argparse.ArgumentParser("python -m geoframe.database", description=main.__doc__)
    for name in ("src", "layer", "dst"):
        p.add_argument(name)
    p.add_argument("epsg", type=int)
    p.add_argument("dst_layer", nargs="?")
    p.add_argument("--src-epsg", type=int, default=4326)
    p.add_argument("--geometry-type", default="polygon")
    p.add_argument("--where")
    p.add_argument("--limit", type=int)
    p.add_argument("--quiet", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("copy layer").getOrCreate()
    try:
        try:
            target = Database(spark, a.dst)
        except GeoError:
            target = Database.create(spark, a.dst)
        n = write_transformed(Database(spark, a.src)[a.layer], a.src_epsg, a.epsg, target, a.dst_layer or a.layer, a.geometry_type, where=a.where, limit=a.limit)
    except (GeoError, crs.CoordTransformError) as e:
        print(e, file=sys.stderr)
        return 1
    if not a.quiet:
        print(f"{n} rows")
    return 0


if __name__ == "__main__":
    sys.exit(main())
