"""File geodatabases: a Spark data source to read layers, a writer, and the catalog.

    spark.dataSource.register(FileGDB)
    spark.read.format("filegdb").option("layer", "roads").load("/data/x.gdb")

Options: layer (name, or file name like a00000009), geometry (full; bbox: kind and envelope, from
the blobs' heads; none: the blobs aren't read), rows_per_partition. Each partition reads the
offsets of its own range of row slots, then the records in file order, and gives rows in oid
order; slots whose records don't parse are left out. A layer is one sequential file, so writing
encodes rows on the executors and strings them together in one place. Rows can be appended,
replaced and deleted in place: records are added at the end, and slots point to the new ones.

A database holds its seven system tables, the marker files, and for each layer a catalog entry,
an item with its definition, a relationship to the root, and its coordinate system. If a layer
can't be registered, its files and entries go again.
"""

from __future__ import annotations

import os
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from geoframe.kernel import gdbcodec as codec
from geoframe.plans.layer import Layer
from geoframe.sources import definitions
from geoframe.types import GEOMETRY_TYPES, WGS84, Field, FormatError, NotFoundError, SpatialRef, WriteError

#: The system tables, in the order of their files.
SYSTEM = ["GDB_SystemCatalog", "GDB_DBTune", "GDB_SpatialRefs", "GDB_Items", "GDB_ItemTypes", "GDB_ItemRelationships", "GDB_ItemRelationshipTypes"]


def _header(path: str) -> codec.Header:
    try:
        f = open(path, "rb")
    except FileNotFoundError:
        raise NotFoundError(f"no table {path}") from None
    with f:
        rows, at, _ = codec.read_header(f.read(40))
        f.seek(at)
        size = int.from_bytes(f.read(4), "little")
        f.seek(at)
        return codec.read_fields(f.read(size + 4), rows)


def _file(db: str, number: int) -> str:
    return os.path.join(db, f"a{number:08x}.gdbtable")


def _index(table: str) -> str:
    return table.replace(".gdbtable", ".gdbtablx")


def _offsets(table: str, first: int = 0, last: int | None = None) -> list[int]:
    with open(_index(table), "rb") as f:
        return codec.read_offsets(f, first, last)


def rows(table: str, first: int = 0, last: int | None = None, geometry: str = "full"):
    """(oid, row) of the slots [first, last), in oid order."""
    h, offsets = _header(table), _offsets(table, first, last)
    want = sorted((at, first + k) for k, at in enumerate(offsets) if at)
    got = {}
    with open(table, "rb", buffering=1 << 16 if geometry == "full" else 512) as f:  # small where most bytes are skipped
        for at, k in want:
            f.seek(at)
            size = int.from_bytes(f.read(4), "little")
            try:
                got[k] = codec.decode_row(codec.Reader(f.read(size)) if geometry == "full" else codec.FileReader(f), h, k + 1, geometry)
            except (FormatError, ValueError, IndexError, OverflowError, codec.struct.error):
                continue
    for k in sorted(got):
        yield k + 1, got[k]


def read_feature(db: str, layer: str, oid: int) -> dict | None:
    """One row by its number: its slot is the only one that is read. None if there is none."""
    return next((row for _, row in rows(locate(db, layer), oid - 1, oid)), None) if oid > 0 else None


def open_database(db: str) -> dict[str, int]:
    """File numbers by layer name."""
    if not os.path.isdir(db):
        raise NotFoundError(f"no database {db}")
    return {row["Name"]: oid for oid, row in rows(_file(db, 1))}


def list_layers(db: str, system: bool = False) -> list[str]:
    return [n for n in open_database(db) if system or n not in SYSTEM]


def system_rows(db: str, name: str) -> list[dict]:
    """The rows of a system table, found by its name in the catalog; none if the database has no such table."""
    number = open_database(db).get(name)
    return [row for _, row in rows(_file(db, number))] if number and os.path.exists(_file(db, number)) else []


def registered(db: str) -> dict[str, dict]:
    """Items by lower-case name."""
    return {(row["Name"] or "").lower(): row for row in system_rows(db, "GDB_Items") if row.get("Name")}


def items(spark: SparkSession, db: str) -> DataFrame:
    """The catalog: name, file, kind (of the item, else of the header), uuid, geometry type, records, coordinate system."""
    out, known = [], registered(db)
    for name, number in open_database(db).items():
        if not os.path.exists(_file(db, number)):
            continue
        h, item = _header(_file(db, number)), known.get(name.lower(), {})
        kind = "system" if name in SYSTEM else definitions.classify(item) or ("feature class" if h.grid else "table")
        out.append((name, f"a{number:08x}", kind, item.get("UUID"), h.geometry_type, h.rows, h.grid.wkt if h.grid else None))
    return spark.createDataFrame(out, "name string, file string, kind string, uuid string, geometry_type int, records int, wkt string")


def spatial_refs(db: str) -> list[tuple[int, str]]:
    """(id, text) of the registered coordinate systems."""
    number = open_database(db).get("GDB_SpatialRefs")
    return [(oid, row["SRTEXT"]) for oid, row in rows(_file(db, number)) if row["SRTEXT"]] if number and os.path.exists(_file(db, number)) else []


def definition(db: str, layer: str) -> dict | None:
    """What a layer's definition says: see definitions.parse."""
    text = registered(db).get(layer.lower(), {}).get("Definition")
    return definitions.parse(text) if text else None


def indexes(db: str, layer: str) -> dict[str, str]:
    """Index files of a layer by kind and name: attribute (.atx) and spatial (.spx) ones, and the list of free slots."""
    base = os.path.basename(locate(db, layer)).removesuffix(".gdbtable")
    kinds = {".atx": "attribute", ".spx": "spatial", ".freelist": "free", ".gdbindexes": "list"}
    return {f: kinds[end] for f in sorted(os.listdir(db)) if f.startswith(base + ".") for end in kinds if f.endswith(end)}


def locate(db: str, layer: str) -> str:
    names = open_database(db)
    name = layer.lstrip("\\")
    number = names.get(name) or next((v for k, v in names.items() if k.lower() == name.lower()), None)
    if number is None and len(name) == 9 and name[0] == "a":
        number = int(name[1:], 16)
    if number is None or not os.path.exists(_file(db, number)):
        raise NotFoundError(f"no layer {layer!r} in {db}")
    return _file(db, number)


def schema_of(h: codec.Header) -> str:
    return ", ".join(f"`{f.name}` {f.spark}" for f in h.fields)


class Slots(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class FileGDB(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filegdb"

    def _table(self) -> str:
        if "layer" not in self.options:
            raise FormatError("the option layer is needed")
        return locate(self.options["path"], self.options["layer"])

    def schema(self) -> str:
        return schema_of(_header(self._table()))

    def reader(self, schema: StructType) -> "FileGDBReader":
        return FileGDBReader(self._table(), schema, dict(self.options))


class FileGDBReader(DataSourceReader):
    def __init__(self, table: str, schema: StructType, options: dict):
        self.table, self.names = table, schema.fieldNames()
        wanted = {f.name for f in _header(table).fields if f.type == 7} & set(self.names)
        # without the geometry column in a given schema its blobs are skipped
        self.geometry = options.get("geometry", "full") if wanted else "none"
        self.step = int(options.get("rows_per_partition", 10000))

    def partitions(self):
        with open(_index(self.table), "rb") as f:
            n = codec.slots(f)
        return [Slots(k, min(n, k + self.step)) for k in range(0, n, self.step)] or [Slots(0, 0)]

    def read(self, part: Slots):
        for _, row in rows(self.table, part.first, part.last, self.geometry):
            yield tuple(_row(row.get(n)) for n in self.names)


def _row(v):
    if isinstance(v, dict):
        return Row(**{k: _row(x) for k, x in v.items()})
    return [_row(x) for x in v] if isinstance(v, list) else v


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileGDB)


def read_layer(spark: SparkSession, db: str, layer: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("filegdb").options(layer=layer, **options).load(db)


# -- writing


def _write_table(path: str, h: codec.Header, blobs) -> int:
    """A table file and its index from (oid, blob) in oid order; the number of rows."""
    fields = codec.write_fields(h)
    offsets, largest, n = [], 0, 0
    with open(path, "wb") as f:
        f.write(b"\0" * 40 + fields)
        for oid, blob in blobs:
            if oid <= len(offsets):
                raise WriteError(f"row numbers start at 1 and are different: {oid}")
            offsets += [0] * (oid - 1 - len(offsets))
            offsets.append(f.tell())
            f.write(len(blob).to_bytes(4, "little") + blob)
            largest, n = max(largest, len(blob)), n + 1
        size = f.tell()
        f.seek(0)
        f.write(codec.write_header(n, largest, size))
    with open(path.replace(".gdbtable", ".gdbtablx"), "wb") as f:
        f.write(codec.write_offsets(offsets))
    return n


#: The columns of the system tables (name, type), a row number first where there is one.
SYSTEM_FIELDS = {
    "GDB_SystemCatalog": [("ID", 6), ("Name", 4), ("FileFormat", 1)],
    "GDB_DBTune": [("Keyword", 4), ("ParameterName", 4), ("ConfigString", 4)],
    "GDB_SpatialRefs": [("ID", 6), ("SRTEXT", 4), *[(n, 3) for n in ("FalseX", "FalseY", "XYUnits", "FalseZ", "ZUnits", "FalseM", "MUnits", "XYTolerance", "ZTolerance", "MTolerance")]],
    "GDB_Items": [("ObjectID", 6), ("UUID", 11), ("Type", 10), ("Name", 4), ("PhysicalName", 4), ("Path", 4), ("DatasetSubtype1", 1), ("DatasetSubtype2", 1), ("DatasetInfo1", 4), ("DatasetInfo2", 4),
                  ("URL", 4), ("Definition", 12), ("Documentation", 12), ("ItemInfo", 12), ("Properties", 1), ("Defaults", 8), ("Shape", 7)],
    "GDB_ItemTypes": [("ObjectID", 6), ("UUID", 10), ("ParentTypeID", 10), ("Name", 4)],
    "GDB_ItemRelationships": [("ObjectID", 6), ("UUID", 11), ("OriginID", 10), ("DestID", 10), ("Type", 10), ("Attributes", 12), ("Properties", 1)],
    "GDB_ItemRelationshipTypes": [("ObjectID", 6), ("UUID", 10), ("OrigItemTypeID", 10), ("DestItemTypeID", 10), ("Name", 4), ("ForwardLabel", 4), ("BackwardLabel", 4), ("IsContainment", 0)],
}
#: The bytes of the marker files.
MARKERS = {"gdb": b"\x05\x00\x00\x00\xde\xad\xbe\xef", "timestamps": b"\xff" * 400}


def _uuid() -> str:
    return "{" + str(uuid.uuid4()).upper() + "}"


def _system_header(name: str) -> codec.Header:
    fields = [Field(n, t, 160 if n == "Name" else 2048, nullable=t != 6 and n not in ("Name", "FileFormat"), required=t == 6) for n, t in SYSTEM_FIELDS[name]]
    spatial = any(f.type == 7 for f in fields)
    return codec.Header(fields=fields, geometry_type=4 if spatial else 0, grid=codec.Grid(wkt=WGS84.wkt) if spatial else None)


def change(table: str, new: list[bytes] = (), slots: dict[int, bytes | None] | None = None) -> int:
    """Append records, and give slots (by row number) new ones or none; the first new row number. Records are added at the file's end, then the index follows, then the header."""
    with open(_index(table), "rb") as f:
        offsets = codec.read_offsets(f)
    first, todo = len(offsets) + 1, [(None, b) for b in new]
    for oid, blob in (slots or {}).items():
        if not 0 < oid <= len(offsets) or not offsets[oid - 1]:
            continue  # nothing to replace or delete
        if blob is None:
            offsets[oid - 1] = 0
        else:
            todo.append((oid, blob))
    with open(table, "r+b") as f:
        head = bytearray(f.read(40))
        largest = struct.unpack_from("<i", head, 8)[0]
        at = f.seek(0, 2)
        for oid, blob in todo:
            f.write(len(blob).to_bytes(4, "little") + blob)
            if oid is None:
                offsets.append(at)
            else:
                offsets[oid - 1] = at
            at, largest = at + 4 + len(blob), max(largest, len(blob))
        struct.pack_into("<ii", head, 4, sum(map(bool, offsets)), largest)
        struct.pack_into("<q", head, 24, at)
        with open(_index(table) + ".new", "wb") as g:
            g.write(codec.write_offsets(offsets))
        os.replace(_index(table) + ".new", _index(table))
        f.seek(0)
        f.write(head)
    return first


def _system(db: str, name: str) -> str:
    return _file(db, SYSTEM.index(name) + 1)


def _add(db: str, name: str, row: dict) -> int:
    """A row more in a system table; its number."""
    return change(_system(db, name), [codec.encode_row(row, _header(_system(db, name)))])


def _drop(db: str, name: str, test) -> None:
    change(_system(db, name), slots={oid: None for oid, row in rows(_system(db, name)) if test(row)})


def _write_catalog(db: str, names: dict[int, str]) -> None:
    h = _system_header(SYSTEM[0])
    _write_table(_file(db, 1), h, ((k, codec.encode_row({"Name": names[k], "FileFormat": 0}, h)) for k in sorted(names)))


def create_database(db: str, overwrite: bool = False) -> None:
    """An empty database: marker files, the seven system tables, the types of items and relationships, and the root item."""
    if not db.endswith(".gdb"):
        raise WriteError("a database's folder ends in .gdb")
    if os.path.exists(db):
        if not overwrite:
            raise WriteError(f"{db} is there already")
        for name in os.listdir(db):
            if name.startswith("a0") or name in MARKERS:
                os.remove(os.path.join(db, name))
    os.makedirs(db, exist_ok=True)
    for name, raw in MARKERS.items():
        with open(os.path.join(db, name), "wb") as f:
            f.write(raw)
    _write_catalog(db, dict(enumerate(SYSTEM, 1)))
    for k, name in enumerate(SYSTEM[1:], 2):
        _write_table(_file(db, k), _system_header(name), ())
    for name, guid in definitions.ITEM_TYPES.items():
        _add(db, "GDB_ItemTypes", {"UUID": guid, "ParentTypeID": guid, "Name": name})
    for name, guid in definitions.RELATIONSHIPS.items():
        _add(db, "GDB_ItemRelationshipTypes", {"UUID": guid, "Name": name, "ForwardLabel": name, "BackwardLabel": name, "IsContainment": int("In" in name)})
    _add(db, "GDB_Items", {"UUID": _uuid(), "Type": definitions.ITEM_TYPES["Workspace"], "Name": "", "PhysicalName": "", "Path": "\\", "URL": "", "Properties": 1, "Definition": definitions.workspace()})


def _register(db: str, name: str, number: int, h: codec.Header) -> None:
    """The four entries of a layer: catalog, coordinate system, item and relationship."""
    _write_catalog(db, {**{v: k for k, v in open_database(db).items()}, number: name})
    if not os.path.exists(_system(db, "GDB_Items")):
        return  # a database that was made without items
    g = h.grid
    if g and g.wkt:
        row = {"SRTEXT": g.wkt, "FalseX": g.origin[0], "FalseY": g.origin[1], "XYUnits": g.scale[0], "FalseZ": g.origin[2], "ZUnits": g.scale[2], "FalseM": g.origin[3], "MUnits": g.scale[3],
               "XYTolerance": g.tolerance[0], "ZTolerance": g.tolerance[2], "MTolerance": g.tolerance[1]}
        if not any(all(old[k] == v for k, v in row.items()) for old in system_rows(db, "GDB_SpatialRefs")):
            _add(db, "GDB_SpatialRefs", row)
    shape = next((f.name for f in h.fields if f.type == 7), None)
    own = _uuid()
    item = {"UUID": own, "Type": definitions.ITEM_TYPES["Feature Class" if g else "Table"], "Name": name, "PhysicalName": name.upper(), "Path": "\\" + name, "URL": "", "Properties": 1,
            "Definition": definitions.make(name, h)} | ({"DatasetSubtype1": 1, "DatasetSubtype2": h.geometry_type, "DatasetInfo1": shape} if g else {})
    root = next((row["UUID"] for row in system_rows(db, "GDB_Items") if row["Path"] == "\\"), None)
    _add(db, "GDB_Items", item)
    if root:
        _add(db, "GDB_ItemRelationships", {"UUID": _uuid(), "OriginID": root, "DestID": own, "Type": definitions.RELATIONSHIPS["DatasetInFolder"], "Properties": 1})


def _unregister(db: str, name: str) -> None:
    item = registered(db).get(name.lower())
    if item:
        _drop(db, "GDB_ItemRelationships", lambda row: item["UUID"] in (row["OriginID"], row["DestID"]))
        _drop(db, "GDB_Items", lambda row: row["UUID"] == item["UUID"])


def _encoder(h: codec.Header, number: str):
    """Rows of a batch as (n, blob)."""
    def encode(batches):
        for b in batches:
            got = b.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r[number] for r in got], pa.int64()), pa.array([codec.encode_row(r, h) for r in got], pa.binary())], names=["n", "blob"])

    return encode


def write_layer(df: DataFrame, db: str, name: str, geometry_type: str = "none", spatial_ref: SpatialRef = WGS84, oid: str = "oid", geometry: str = "geometry", grid: codec.Grid | None = None, has_z: bool = False, has_m: bool = False) -> int:
    """A new layer from df. Rows get oids in the order of df's own oid column if it has one, else in any order."""
    if not name or len(name) > 160 or "\\" in name or "/" in name:
        raise WriteError(f"bad layer name {name!r}")
    known = open_database(db)
    if name.lower() in map(str.lower, known):
        raise WriteError(f"{name} is there already")
    h = codec.Header(geometry_type=GEOMETRY_TYPES[geometry_type], has_z=has_z, has_m=has_m)
    h.fields = [Field("OBJECTID", 6, nullable=False, required=True)]
    kinds = {"smallint": 0, "int": 1, "float": 2, "double": 3, "string": 4, "timestamp": 5, "binary": 8, "bigint": 13, "date": 14}
    for c, t in df.dtypes:
        if c == oid:
            continue
        if c == geometry:
            if not h.geometry_type:
                raise WriteError("a layer with a geometry needs a geometry type")
            h.grid = grid or codec.Grid(wkt=spatial_ref.wkt)
            h.fields.append(Field(c, 7))
        elif t in kinds:
            h.fields.append(Field(c, kinds[t], editable=True))
        else:
            raise WriteError(f"column {c}: {t} can't be stored")

    keyed = df.withColumn("__n", F.col(oid) if oid in df.columns else F.monotonically_increasing_id() + 1)
    if geometry in df.columns:
        keyed = Layer(keyed, "__n", geometry).checked(geometry_type)
    blobs = keyed.mapInArrow(_encoder(h, "__n"), "n long, blob binary").orderBy("n")
    with open(_index(_file(db, 1)), "rb") as f:
        number = max([codec.slots(f), *known.values(), len(SYSTEM) + 1]) + 1  # numbers of deleted layers aren't used again
    dense = oid not in df.columns
    try:
        # the file is one sequence: partitions come one after the other, never all at once
        count = _write_table(_file(db, number), h, ((k + 1 if dense else r["n"], bytes(r["blob"])) for k, r in enumerate(blobs.toLocalIterator())))
        _register(db, name, number, h)
    except BaseException:
        _unregister(db, name)
        _write_catalog(db, {v: k for k, v in known.items()})
        for path in (_file(db, number), _index(_file(db, number))):
            if os.path.exists(path):
                os.remove(path)
        raise
    return count


def append_rows(df: DataFrame, db: str, layer: str) -> int:
    """Rows of df at the end of a layer, in any order; how many. Columns go by name, without regard to case; others are left out."""
    table = locate(db, layer)
    h = _header(table)
    by = {c.lower(): c for c in df.columns}
    own = df.select(*[F.col(f"`{by[f.name.lower()]}`").alias(f.name) for f in h.fields if f.type != 6 and f.name.lower() in by], F.lit(0).cast("long").alias("__n"))
    first, n = 0, 0
    for batch in _batches(own.mapInArrow(_encoder(h, "__n"), "n long, blob binary").toLocalIterator()):
        change(table, [bytes(r["blob"]) for r in batch])
        n += len(batch)
    return n


def update_rows(df: DataFrame, db: str, layer: str, oid: str = "OBJECTID") -> None:
    """Whole records are replaced by row number; numbers that aren't there are ignored."""
    table = locate(db, layer)
    h = _header(table)
    by = {c.lower(): c for c in df.columns}
    own = df.select(*[F.col(f"`{by[f.name.lower()]}`").alias(f.name) for f in h.fields if f.type != 6 and f.name.lower() in by], F.col(oid).cast("long").alias("__n"))
    for batch in _batches(own.mapInArrow(_encoder(h, "__n"), "n long, blob binary").toLocalIterator()):
        change(table, slots={r["n"]: bytes(r["blob"]) for r in batch})


def delete_rows(oids: DataFrame, db: str, layer: str, oid: str = "OBJECTID") -> None:
    """Rows go by number; their slots stay empty."""
    for batch in _batches(oids.select(F.col(oid).cast("long").alias("n")).toLocalIterator()):
        change(locate(db, layer), slots={r["n"]: None for r in batch})


def _batches(found, most: int = 50_000):
    """Lists of up to `most` rows, so that a file's index is rewritten once for each."""
    out = []
    for r in found:
        out.append(r)
        if len(out) == most:
            yield out
            out = []
    if out:
        yield out


def delete_layer(db: str, name: str) -> None:
    """The layer's files, item and relationships go, and its catalog slot stays empty: numbers aren't used again."""
    path, names = locate(db, name), {v: k for k, v in open_database(db).items()}
    for end in (".gdbtable", ".gdbtablx"):
        os.remove(path.replace(".gdbtable", end))
    number = int(os.path.basename(path)[1:9], 16)
    _unregister(db, names.pop(number))
    change(_file(db, 1), slots={number: None})
