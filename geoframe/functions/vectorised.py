"""Geometry functions over Arrow batches: what built-in expressions can't say."""

from __future__ import annotations

import json
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from geoframe.functions import native
from geoframe.functions.native import matches_de9im  # noqa: F401
from geoframe.kernel import arrangement, crs, shapes
from geoframe.kernel import geometry as kernel
from geoframe.kernel.geometry import Geometry
from geoframe.types import GEOMETRY


def _udf(fn, returns: str, args: int):
    """A function of geometries (dicts in a batch) and other values; a null argument gives null."""
    arrow = to_arrow_type(_parse_datatype_string(returns))  # on the driver, which can parse it

    def run(columns):
        out = []
        for row in zip(*[c.to_pylist() for c in columns]):
            if any(v is None for v in row):
                out.append(None)
                continue
            v = fn(*[Geometry.of(v) if isinstance(v, dict) else v for v in row])
            out.append(v.struct() if isinstance(v, Geometry) else v)
        return pa.array(out, arrow)

    if args == 1:
        def wrapped(a: pa.Array) -> pa.Array:
            return run([a])
    else:
        def wrapped(a: pa.Array, b: pa.Array) -> pa.Array:
            return run([a, b])
    return F.arrow_udf(wrapped, returnType=returns)


def _one(fn, returns: str):
    return lambda g: _udf(fn, returns, 1)(_c(g))


def _two(fn, returns: str):
    return lambda a, b: _udf(fn, returns, 2)(_c(a), _c(b))


def _c(g) -> Column:
    return F.col(g) if isinstance(g, str) else g


st_as_text = _one(kernel.to_wkt, "string")
st_as_geojson = _one(lambda g: json.dumps(kernel.to_geojson(g)), "string")
st_geom_from_text = _one(kernel.from_wkt, GEOMETRY)
st_geom_from_geojson = _one(kernel.from_geojson, GEOMETRY)
st_convex_hull = _one(shapes.convex_hull, GEOMETRY)
st_is_valid = _one(shapes.is_valid, "boolean")
st_is_simple = _one(shapes.is_simple, "boolean")
_distance = _two(shapes.distance, "double")
st_organized = _one(lambda g: kernel.organized(replace(g, shells=[])) if g.kind == "polygon" else g, GEOMETRY)


_relate = _two(arrangement.relate, "string")


def st_relate(a, b) -> Column:
    """The DE-9IM matrix. Of two boxes it is told natively from their envelopes; only other pairs reach the arrangement."""
    if not (isinstance(a, str) and isinstance(b, str)):
        return _relate(a, b)
    both = native.st_is_box(a) & native.st_is_box(b)
    return F.when(both, native.st_box_relate(a, b)).otherwise(_relate(F.when(~both, F.col(a)), F.col(b)))


def st_distance(a, b) -> Column:
    """Of two geometries that are their envelopes (boxes, points) it is told natively; only other pairs reach the kernel."""
    if not (isinstance(a, str) and isinstance(b, str)):
        return _distance(_c(a), _c(b))
    both = native.st_is_envelope(a) & native.st_is_envelope(b)
    return F.when(both, native.st_envelope_distance(a, b)).otherwise(_distance(F.when(~both, F.col(a)), F.when(~both, F.col(b))))


def st_simplify(g, tolerance: float, preserve_topology: bool = False) -> Column:
    if preserve_topology:
        raise NotImplementedError("only simplification by part is supported")
    return _one(lambda x: shapes.simplify(x, tolerance), GEOMETRY)(g)


def st_buffer(g, distance: float, quad_segs: int = 8, cap="round", join="round", mitre_limit: float = 5.0, single_sided: bool = False) -> Column:
    if cap not in arrangement.CAPS or join not in arrangement.JOINS:
        raise ValueError("unknown cap or join style")
    exact = _one(lambda x: arrangement.buffer(x, distance, quad_segs, cap, join, mitre_limit, single_sided), GEOMETRY)
    if not distance > 0 or single_sided or not 1 <= quad_segs <= 64 or arrangement.CAPS[cap] == "flat":
        return exact(g)
    # a point's buffer is a regular polygon around it; only other geometries (and points so far out that vertices would meet) reach the arrangement
    g = _c(g)
    centre = native.st_is_disc_centre(g, 1e5 * distance)
    return F.when(centre, native.st_disc(g, distance, quad_segs, arrangement.CAPS[cap] == "square")).otherwise(exact(F.when(~centre, g)))


def buffered(df: DataFrame, g: str, distance: float, name: str, quad_segs: int = 8) -> DataFrame:
    """df with the round buffers of its geometries. Rows with points are parted from the rest, so that they pass no Python function, not even as nulls."""
    if not distance > 0 or not 1 <= quad_segs <= 64:
        return df.withColumn(name, st_buffer(g, distance, quad_segs))
    centre = native.st_is_disc_centre(F.col(g), 1e5 * distance)
    return df.where(centre).withColumn(name, native.st_disc(F.col(g), distance, quad_segs)).unionByName(df.where(~centre).withColumn(name, st_buffer(g, distance, quad_segs)))


def _moved(g: pa.StructArray, move) -> pa.StructArray:
    """Geometries without members, with x and y of all their vertices moved in one call, and new envelopes."""
    parts = g.field("parts")
    inner = parts.values
    x, y = inner.field("x"), inner.field("y")
    nx, ny = (np.asarray(v, np.float64) for v in move(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)))
    axis = lambda old, new: pa.ListArray.from_arrays(old.offsets, pa.array(new))
    new = pa.StructArray.from_arrays([axis(x, nx), axis(y, ny), *[inner.field(c) for c in ("z", "m", "shell")]], ["x", "y", "z", "m", "shell"])
    # the vertices of geometry k are those from edge[k] to edge[k + 1]
    edge = x.offsets.to_numpy()[parts.offsets.to_numpy()]
    full = np.flatnonzero(np.diff(edge) > 0)
    box = np.zeros((4, len(g)))
    for k, (v, f) in enumerate(((nx, np.minimum), (ny, np.minimum), (nx, np.maximum), (ny, np.maximum))):
        if len(full):
            box[k, full] = f.reduceat(v[: edge[-1]], edge[full])
    empty = np.ones(len(g), bool)
    empty[full] = False
    boxes = pa.StructArray.from_arrays([pa.array(c) for c in box], ["xmin", "ymin", "xmax", "ymax"], mask=pa.array(empty))
    names = [f.name for f in g.type]
    columns = [{"parts": pa.ListArray.from_arrays(parts.offsets, new, mask=parts.is_null()), "bbox": boxes}.get(n, g.field(n)) for n in names]
    return pa.StructArray.from_arrays(columns, names, mask=g.is_null())


def st_transform(g, src, dst) -> Column:
    """Another coordinate system; Z stays, M stays, empties stay empty.

    Between geographic systems and web Mercator x and y are moved by built-in expressions. Else a batch is one call of the transform; collections go one by one."""
    src, dst = crs.resolve(src), crs.resolve(dst)
    kinds = crs._params(src)[0], crs._params(dst)[0]
    if "tm" not in kinds:
        return native.st_map_xy(_c(g), *native.mercator(*kinds))
    arrow = to_arrow_type(_parse_datatype_string(GEOMETRY))

    def one(x: Geometry) -> Geometry:
        if x.kind == "geometrycollection":
            return replace(x, members=[one(m) for m in x.members])
        parts = []
        for p in x.parts:
            nx, ny = crs.transform([v[0] for v in p], [v[1] for v in p], src, dst)
            parts.append([(float(a), float(b), *v[2:]) for a, b, v in zip(nx, ny, p)])
        return replace(x, parts=parts)

    def run(a: pa.Array) -> pa.Array:
        a = a.take(pa.array(np.arange(len(a))))  # without offsets, and without values under nulls
        if a.field("members").null_count < len(a):
            return pa.array([None if v is None else one(Geometry.of(v)).struct() for v in a.to_pylist()], arrow)
        return _moved(a, lambda x, y: crs.transform(x, y, src, dst)).cast(arrow)

    return F.arrow_udf(run, returnType=GEOMETRY)(_c(g))


def _overlay(op: str):
    return _two(lambda a, b: arrangement.overlay(a, b, op), GEOMETRY)


st_intersection, st_union, st_difference, st_sym_difference = map(_overlay, ("intersection", "union", "difference", "symmetric_difference"))


def _predicate(name: str):
    test = _two(lambda a, b: arrangement.predicate(name, a, b), "boolean")

    def of(a, b) -> Column:
        """Two boxes are told apart natively, and so are pairs whose envelopes don't meet; only others reach the exact test.

        Geometries without an envelope (empty ones) go to the exact test."""
        x, y = _c(a)["bbox"], _c(b)["bbox"]
        apart = F.coalesce((x["xmax"] < y["xmin"]) | (x["xmin"] > y["xmax"]) | (x["ymax"] < y["ymin"]) | (x["ymin"] > y["ymax"]), F.lit(False))
        boxes = native.st_is_box(a) & native.st_is_box(b) if isinstance(a, str) and isinstance(b, str) else F.lit(False)
        told = F.when(apart, F.lit(name == "disjoint"))
        if isinstance(a, str) and isinstance(b, str):
            told = told.when(boxes, native.st_box_predicate(name, a, b))
        exact = told.otherwise(test(F.when(~apart & ~boxes, _c(a)), _c(b)))
        return exact if name == "disjoint" else ~apart & exact  # the first part is native, so the planner can put it below

    return of


PREDICATES = ("intersects", "disjoint", "contains", "within", "covers", "covered_by", "touches", "crosses", "overlaps", "equals")
st_intersects, st_disjoint, st_contains, st_within, st_covers, st_covered_by, st_touches, st_crosses, st_overlaps, st_equals = map(_predicate, PREDICATES)


def boxes_meet(a: str, b: str) -> Column:
    x, y = F.col(f"{a}.bbox"), F.col(f"{b}.bbox")
    return (x["xmax"] >= y["xmin"]) & (x["xmin"] <= y["xmax"]) & (x["ymax"] >= y["ymin"]) & (x["ymin"] <= y["ymax"])


def area(g: Geometry) -> float:
    return sum((1 if s else -1) * abs(kernel.area2(p)) / 2 for m in g.flat() if m.kind == "polygon" for p, s in zip(m.parts, m.shells or [True] * len(m.parts)) if len(p) > 2)


def length(g: Geometry) -> float:
    steps = [(p, [*p[1:], p[0]] if m.kind == "polygon" else p[1:]) for m in g.flat() if m.dimension for p in m.parts]
    return float(sum(np.hypot(b[0] - a[0], b[1] - a[1]) for p, q in steps for a, b in zip(p, q)))


def boxed(g: Geometry) -> dict | None:
    return dict(zip(("xmin", "ymin", "xmax", "ymax"), g.envelope)) if g.envelope else None


def project(g: Geometry, systems: str) -> Geometry:
    """systems: "from to", as codes."""
    src, dst = systems.split()
    if g.kind == "geometrycollection":
        return replace(g, members=[project(m, systems) for m in g.members])
    moved = [crs.transform([v[0] for v in p], [v[1] for v in p], src, dst) for p in g.parts]
    return replace(g, parts=[[(float(x), float(y), *v[2:]) for x, y, v in zip(*xy, p)] for xy, p in zip(moved, g.parts)])


def register(spark: SparkSession) -> list[str]:
    """The functions of one and two geometries under their names in SQL."""
    one = {"st_as_text": (kernel.to_wkt, "string"), "st_geom_from_text": (kernel.from_wkt, GEOMETRY), "st_convex_hull": (shapes.convex_hull, GEOMETRY), "st_is_valid": (shapes.is_valid, "boolean"),
           "st_is_simple": (shapes.is_simple, "boolean"), "st_geom_from_geojson": (kernel.from_geojson, GEOMETRY), "st_as_geojson": (lambda g: json.dumps(kernel.to_geojson(g)), "string")}
    one |= {"st_area": (area, "double"), "st_length": (length, "double"), "st_is_empty": (lambda g: g.empty, "boolean"), "st_dimension": (lambda g: g.dimension, "int"), "st_envelope": (boxed, "struct<xmin:double,ymin:double,xmax:double,ymax:double>")}
    two = {"st_distance": (shapes.distance, "double"), "st_buffer": (lambda g, d: arrangement.buffer(g, d), GEOMETRY), "st_simplify": (lambda g, t: shapes.simplify(g, t), GEOMETRY), "st_transform": (project, GEOMETRY), "st_relate": (arrangement.relate, "string")}
    two |= {f"st_{p}": ((lambda a, b, p=p: arrangement.predicate(p, a, b)), "boolean") for p in PREDICATES}
    two |= {f"st_{n}": ((lambda a, b, o=o: arrangement.overlay(a, b, o)), GEOMETRY) for n, o in (("intersection", "intersection"), ("union", "union"), ("difference", "difference"), ("sym_difference", "symmetric_difference"))}
    for name, (fn, kind) in one.items():
        spark.udf.register(name, _udf(fn, kind, 1))
    for name, (fn, kind) in two.items():
        spark.udf.register(name, _udf(fn, kind, 2))
    return [*one, *two]
