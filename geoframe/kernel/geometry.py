"""The geometry value that the vectorised functions work on, and its text forms."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field, replace

from geoframe.types import SHAPES, FormatError

NAN = float("nan")
DIMENSION = {"point": 0, "multipoint": 0, "polyline": 1, "polygon": 2, "multipatch": 2, "null": 0}


@dataclass
class Geometry:
    """parts: lists of (x, y, z, m). Rings are unclosed; shells[i] tells shells from holes."""

    kind: str = "null"
    parts: list = field(default_factory=list)
    shells: list = field(default_factory=list)
    has_z: bool = False
    has_m: bool = False
    members: list = field(default_factory=list)

    @property
    def empty(self) -> bool:
        return all(m.empty for m in self.members) if self.kind == "geometrycollection" else not any(self.parts)

    @property
    def dimension(self) -> int:
        return max((m.dimension for m in self.members), default=0) if self.kind == "geometrycollection" else DIMENSION[self.kind]

    @property
    def xy(self) -> list[list[tuple[float, float]]]:
        return [[(v[0], v[1]) for v in p] for p in self.parts]

    @property
    def envelope(self):
        at = [v for g in (self.members or [self]) for v in ([w for p in g.parts for w in p] if g.kind != "geometrycollection" else [])]
        if self.members:
            boxes = [m.envelope for m in self.members if m.envelope]
            return (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else None
        return (min(v[0] for v in at), min(v[1] for v in at), max(v[0] for v in at), max(v[1] for v in at)) if at else None

    def flat(self):
        return [x for m in self.members for x in m.flat()] if self.kind == "geometrycollection" else [self]

    # -- the struct column

    def struct(self) -> dict:
        box = self.envelope
        leaves: list = []

        def walk(g, path):
            for i, m in enumerate(g.members):
                leaves.append({"path": [*path, i], **m._own()})
                walk(m, [*path, i])

        walk(self, [])
        return {**self._own(), "members": leaves if self.kind == "geometrycollection" else None, "bbox": dict(zip(("xmin", "ymin", "xmax", "ymax"), box)) if box else None}

    def _own(self) -> dict:
        axis = lambda p, k: [v[k] for v in p]
        shells = self.shells or [None] * len(self.parts)
        parts = [{"x": axis(p, 0), "y": axis(p, 1), "z": axis(p, 2) if self.has_z else None, "m": axis(p, 3) if self.has_m else None, "shell": s} for p, s in zip(self.parts, shells)]
        return {"kind": self.kind, "shape_type": SHAPES.get((self.kind, self.has_z, self.has_m), -1 if self.kind == "geometrycollection" else 0), "has_z": self.has_z, "has_m": self.has_m, "parts": parts}

    @staticmethod
    def of(row: dict | None) -> "Geometry | None":
        if row is None:
            return None
        out = Geometry._leaf(row)
        at = {(): out}
        for m in row.get("members") or []:
            leaf = Geometry._leaf(m)
            at[tuple(m["path"][:-1])].members.append(leaf)
            at[tuple(m["path"])] = leaf
        return out

    @staticmethod
    def _leaf(row: dict) -> "Geometry":
        parts = []
        for p in row["parts"] or []:
            n = len(p["x"])
            parts.append(list(zip(p["x"], p["y"], p["z"] or [NAN] * n, p["m"] or [NAN] * n)))
        g = Geometry(row["kind"], parts, [p["shell"] for p in row["parts"] or []], bool(row["has_z"]), bool(row["has_m"]))
        if g.kind == "polygon" and any(s is None for s in g.shells):
            g = organized(g)
        return g


def area2(ring) -> float:
    x0, y0 = ring[0][0], ring[0][1]
    total = 0.0
    for a, b in zip(ring[1:], ring[2:]):
        total += (a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0)
    return total


def inside_ring(x: float, y: float, ring) -> int:
    """1 inside, 0 on the ring, -1 outside."""
    odd = False
    for a, b in zip(ring, [*ring[1:], ring[0]]):
        cross = (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0])
        if cross == 0 and min(a[0], b[0]) <= x <= max(a[0], b[0]) and min(a[1], b[1]) <= y <= max(a[1], b[1]):
            return 0
        if (a[1] > y) != (b[1] > y) and (cross > 0) == (b[1] > a[1]):
            odd = not odd
    return 1 if odd else -1


def ring_within(inner, outer) -> bool:
    for v in inner:
        side = inside_ring(v[0], v[1], outer)
        if side:
            return side > 0
    mid = ((inner[0][0] + inner[1][0]) / 2, (inner[0][1] + inner[1][1]) / 2)
    return inside_ring(*mid, outer) >= 0


def organized(g: Geometry) -> Geometry:
    """Shells in order, each followed by its holes. A counter-clockwise ring is a hole of the smallest shell around it, or else a shell."""
    rings = [p for p in g.parts if len(p) >= 3]
    if len(rings) < 2:
        return replace(g, parts=rings, shells=[True] * len(rings))
    shell = [area2(r) < 0 for r in rings]
    if not any(shell):
        shell[0] = True
    owner = [None] * len(rings)
    for i, r in enumerate(rings):
        if not shell[i]:
            around = [k for k in range(len(rings)) if shell[k] and k != i and ring_within(r, rings[k])]
            owner[i] = min(around, key=lambda k: abs(area2(rings[k])), default=None)
            shell[i] = owner[i] is None
    parts, shells = [], []
    for i, r in enumerate(rings):
        if shell[i]:
            parts += [r, *(rings[k] for k in range(len(rings)) if owner[k] == i)]
            shells += [True, *(False for k in range(len(rings)) if owner[k] == i)]
    return replace(g, parts=parts, shells=shells)


def polygon(groups, has_z=False, has_m=False) -> Geometry:
    """From groups of a shell and its holes, as vertices; rings are turned to clockwise shells and unclosed."""
    parts, shells = [], []
    for group in groups:
        for k, ring in enumerate(group):
            ring = list(ring)
            if len(ring) > 1 and ring[0][:2] == ring[-1][:2]:
                ring.pop()
            if len(set(v[:2] for v in ring)) < 3:
                raise FormatError("a ring needs three different vertices")
            if (area2(ring) > 0) == (k == 0):
                ring.reverse()
            parts.append(ring)
            shells.append(k == 0)
    return Geometry("polygon", parts, shells, has_z, has_m)


# -- WKT

NAMES = {"point": "POINT", "multipoint": "MULTIPOINT", "polyline": "LINESTRING", "polygon": "POLYGON", "geometrycollection": "GEOMETRYCOLLECTION"}


def number(v: float) -> str:
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        raise OverflowError("an infinite ordinate has no text")
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


def _polygons(g: Geometry) -> list[list]:
    out: list[list] = []
    for p, s in zip(g.parts, g.shells or [True] * len(g.parts)):
        if s or not out:
            out.append([p])
        else:
            out[-1].append(p)
    return out


def to_wkt(g: Geometry) -> str:
    if g.kind == "null":
        return "GEOMETRYCOLLECTION EMPTY"
    if g.kind == "geometrycollection":
        return f"GEOMETRYCOLLECTION ({', '.join(map(to_wkt, g.members))})" if g.members else "GEOMETRYCOLLECTION EMPTY"
    if g.kind not in NAMES:
        raise NotImplementedError(f"{g.kind} has no WKT")
    tag = " ZM" if g.has_z and g.has_m else " Z" if g.has_z else " M" if g.has_m else ""
    vertex = lambda v: " ".join(map(number, [v[0], v[1], *([v[2]] if g.has_z else []), *([v[3]] if g.has_m else [])]))
    row = lambda p: "(" + ", ".join(map(vertex, p)) + ")"
    name = NAMES[g.kind]
    if not any(g.parts):
        return f"{name}{tag} EMPTY"
    if g.kind == "point":
        return f"POINT{tag} ({vertex(g.parts[0][0])})"
    if g.kind == "multipoint":
        return f"MULTIPOINT{tag} (" + ", ".join(f"({vertex(v)})" for v in g.parts[0]) + ")"
    if g.kind == "polyline":
        rows = [row(p) for p in g.parts]
    else:
        rows = ["(" + ", ".join(row([*r, r[0]]) for r in group) + ")" for group in _polygons(g)]
    return f"{name}{tag} {rows[0]}" if len(rows) == 1 else f"MULTI{name}{tag} ({', '.join(rows)})"


_WKT = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")


def from_wkt(text: str, has_z: bool | None = None, has_m: bool | None = None) -> Geometry:
    text = re.sub(r"^\s*SRID=\d+;", "", text)
    words, at = [], 0
    while text[at:].strip():
        found = _WKT.match(text, at)
        if not found:
            raise FormatError(f"bad WKT near {text[at:at + 20]!r}")
        words.append(found.group(1))
        at = found.end()
    words.reverse()
    out = _wkt(words, has_z, has_m, text)
    if words:
        raise FormatError(f"bad WKT: {words[-1]!r} after the end")
    return out


def _wkt(words: list[str], has_z, has_m, text) -> Geometry:
    def need(w: str) -> None:
        if not words or words.pop() != w:
            raise FormatError(f"bad WKT: {w!r} expected in {text[:40]!r}")

    def listed(read):
        need("(")
        out = [read()]
        while words and words[-1] == ",":
            words.pop()
            out.append(read())
        need(")")
        return out

    def vertex():
        out = []
        while words and (words[-1][-1].isdigit() or words[-1][-1] == "." or words[-1].upper() == "NAN"):
            out.append(float(words.pop()))
        if not 2 <= len(out) <= 4:
            raise FormatError(f"bad WKT: a vertex of {len(out)} numbers")
        return out

    name = words.pop().upper() if words else ""
    tag = ""
    if words and words[-1].upper() in ("Z", "M", "ZM"):
        tag = words.pop().upper()
    base = name.removeprefix("MULTI")
    if name == "GEOMETRYCOLLECTION":
        if tag:
            raise FormatError("a collection has no suffix")
        if words and words[-1].upper() == "EMPTY":
            words.pop()
            return Geometry("geometrycollection")
        members = listed(lambda: _wkt(words, None, None, text))
        return Geometry("geometrycollection", members=members, has_z=any(m.has_z for m in members), has_m=any(m.has_m for m in members))
    kinds = {"POINT": "point", "LINESTRING": "polyline", "POLYGON": "polygon"}
    if base not in kinds:
        raise FormatError(f"unknown geometry {name!r}")
    if words and words[-1].upper() == "EMPTY":
        words.pop()
        return Geometry("null")
    many = name != base
    if base == "POINT":
        def single():
            if words and words[-1] == "(":
                words.pop()
                v = vertex()
                need(")")
                return v
            return vertex()
        raw = [listed(single)] if many else [listed(vertex)]
        if not many and len(raw[0]) != 1:
            raise FormatError("a POINT has one vertex")
        kind = "multipoint" if many else "point"
    elif base == "LINESTRING":
        raw, kind = (listed(lambda: listed(vertex)) if many else [listed(vertex)]), "polyline"
    else:
        groups = listed(lambda: listed(lambda: listed(vertex))) if many else [listed(lambda: listed(vertex))]
        raw, kind = [r for g in groups for r in g], "polygon"
    most = max(len(v) for p in raw for v in p)
    z = "Z" in tag if tag else has_z if has_z is not None else most >= 3
    m = "M" in tag if tag else has_m if has_m is not None else most == 4

    def full(v):
        rest = iter(v[2:])
        return (v[0], v[1], next(rest, NAN) if z else NAN, next(rest, NAN) if m else NAN)

    if kind == "polygon":
        return polygon([[[full(v) for v in r] for r in g] for g in groups], z, m)
    return Geometry(kind, [[full(v) for v in p] for p in raw], [], z, m)


# -- GeoJSON


def to_geojson(g: Geometry) -> dict:
    at = lambda v: [v[0], v[1], v[2]] if g.has_z else [v[0], v[1]]
    if g.kind == "geometrycollection":
        return {"type": "GeometryCollection", "geometries": [to_geojson(m) for m in g.members]}
    if g.empty:
        return {"type": "GeometryCollection", "geometries": []}
    if g.kind == "point":
        return {"type": "Point", "coordinates": at(g.parts[0][0])}
    if g.kind == "multipoint":
        return {"type": "MultiPoint", "coordinates": [at(v) for v in g.parts[0]]}
    if g.kind == "polyline":
        rows = [[at(v) for v in p] for p in g.parts]
        return {"type": "LineString", "coordinates": rows[0]} if len(rows) == 1 else {"type": "MultiLineString", "coordinates": rows}
    if g.kind == "polygon":
        rows = [[[at(v) for v in [*r, r[0]]] for r in group] for group in _polygons(g)]
        return {"type": "Polygon", "coordinates": rows[0]} if len(rows) == 1 else {"type": "MultiPolygon", "coordinates": rows}
    raise NotImplementedError(f"{g.kind} has no GeoJSON")


def from_geojson(text, has_m: bool = False) -> Geometry:
    try:
        doc = json.loads(text) if isinstance(text, str) else text
        kind = doc["type"]
        if kind == "Feature":
            return from_geojson(doc["geometry"], has_m) if doc["geometry"] else Geometry()
        if kind == "FeatureCollection":
            if doc["features"]:
                raise FormatError("a FeatureCollection isn't one geometry")
            return Geometry()
        if kind == "GeometryCollection":
            members = [from_geojson(m, has_m) for m in doc["geometries"]]
            return Geometry("geometrycollection", members=members, has_z=any(m.has_z for m in members)) if members else Geometry()
        c = doc["coordinates"]
    except (KeyError, TypeError, ValueError) as e:
        raise FormatError(f"bad GeoJSON: {e}") from None
    depth = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}.get(kind)
    if depth is None:
        raise FormatError(f"unknown geometry {kind!r}")
    if not c:
        return Geometry()
    flat = [c]
    for _ in range(depth):
        flat = [v for part in flat for v in part]
    if any(not 2 <= len(v) <= (4 if has_m else 3) for v in flat):
        raise FormatError("a position has two or three numbers")
    z = any(len(v) > 2 for v in flat)
    full = lambda v: (float(v[0]), float(v[1]), float(v[2]) if len(v) > 2 else NAN, float(v[3]) if len(v) > 3 else NAN)
    if kind in ("Polygon", "MultiPolygon"):
        return polygon([[[full(v) for v in r] for r in g] for g in (c if depth == 3 else [c])], z, has_m)
    rows = [[c]] if depth == 0 else [c] if depth == 1 else c
    return Geometry({"Point": "point", "MultiPoint": "multipoint"}.get(kind, "polyline"), [[full(v) for v in p] for p in rows], [], z, has_m)
