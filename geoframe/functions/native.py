"""Geometry functions in built-in expressions: builders, descriptors, measures and simple tests."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoframe.types import GEOMETRY, MEMBER, PART


def _geometry(kind: str, code: int, parts: Column, bbox: Column) -> Column:
    # no cast of the whole: the planner sees through a struct to its fields, but not through a cast
    return F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("shape_type"), F.lit(False).alias("has_z"), F.lit(False).alias("has_m"),
                    parts.alias("parts"), F.lit(None).cast(f"array<{MEMBER}>").alias("members"), bbox.alias("bbox"))


def _part(x: Column, y: Column, shell: bool | None = None) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), F.lit(None).cast("array<double>").alias("z"), F.lit(None).cast("array<double>").alias("m"), F.lit(shell).cast("boolean").alias("shell"))


def _box(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("xmin"), y0.alias("ymin"), x1.alias("xmax"), y1.alias("ymax"))


def st_point(x: Column, y: Column) -> Column:
    return _geometry("point", 1, F.array(_part(F.array(x), F.array(y))), _box(x, y, x, y))


def st_box(x0: Column, y0: Column, w: Column, h: Column) -> Column:
    """A rectangle, its ring clockwise and unclosed."""
    return _geometry("polygon", 5, F.array(_part(F.array(x0, x0, x0 + w, x0 + w), F.array(y0, y0 + h, y0 + h, y0), True)), _box(x0, y0, x0 + w, y0 + h))


def st_polygon(x: Column, y: Column) -> Column:
    """A polygon of one ring, from arrays of its unclosed vertices."""
    return _geometry("polygon", 5, F.array(_part(x, y, True)), _box(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)))


def st_holed_box(x0, y0, w, h, hx, hy, hw, hh) -> Column:
    outer = _part(F.array(x0, x0, x0 + w, x0 + w), F.array(y0, y0 + h, y0 + h, y0), True)
    inner = _part(F.array(hx, hx + hw, hx + hw, hx), F.array(hy, hy, hy + hh, hy + hh), False)
    return _geometry("polygon", 5, F.array(outer, inner), _box(x0, y0, x0 + w, y0 + h))


def st_line(x: Column, y: Column) -> Column:
    return _geometry("polyline", 3, F.array(_part(x, y)), _box(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)))


def st_multipoint(x: Column, y: Column) -> Column:
    return _geometry("multipoint", 8, F.array(_part(x, y)), _box(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)))


def _all(g: str) -> str:
    """The parts of a geometry, and of its members."""
    return f"concat(coalesce({g}.parts, array()), flatten(transform(coalesce({g}.members, array()), m -> coalesce(m.parts, array()))))"


def _kinds(g: str, each: str) -> str:
    """Pairs of kind and parts, of the geometry or of its members, through `each` of (k, p), summed."""
    return f"aggregate(CASE WHEN {g}.kind = 'geometrycollection' THEN transform({g}.members, m -> named_struct('k', m.kind, 'p', m.parts)) ELSE array(named_struct('k', {g}.kind, 'p', {g}.parts)) END, 0D, (s, e) -> s + {each})"


def _area2(p: str) -> str:
    """Twice the signed area of a ring, from its first vertex, in order."""
    n = f"size({p}.x)"
    return (f"CASE WHEN {n} < 3 THEN 0D ELSE aggregate(sequence(1, {n} - 2), 0D, (t, i) -> t + ({p}.x[i] - {p}.x[0]) * ({p}.y[i + 1] - {p}.y[0]) - ({p}.x[i + 1] - {p}.x[0]) * ({p}.y[i] - {p}.y[0])) END")


def st_area2(g: str) -> Column:
    """Signed, of the first part."""
    return F.expr(f"transform({g}.parts, p -> {_area2('p')})[0]")


def st_area(g: str) -> Column:
    ring = f"(CASE WHEN p.shell IS NOT DISTINCT FROM false THEN -0.5D ELSE 0.5D END) * abs({_area2('p')})"
    return F.expr(_kinds(g, f"CASE WHEN e.k = 'polygon' THEN aggregate(e.p, 0D, (a, p) -> a + {ring}) ELSE 0D END"))


def _length(p: str, closed: str) -> str:
    n = f"size({p}.x)"
    step = f"sqrt(power({p}.x[i] - {p}.x[i - 1], 2) + power({p}.y[i] - {p}.y[i - 1], 2))"
    close = f"sqrt(power({p}.x[0] - element_at({p}.x, -1), 2) + power({p}.y[0] - element_at({p}.y, -1), 2))"
    return f"(CASE WHEN {n} < 2 THEN 0D ELSE aggregate(sequence(1, {n} - 1), 0D, (t, i) -> t + {step}) + CASE WHEN {closed} THEN {close} ELSE 0D END END)"


def st_length(g: str) -> Column:
    return F.expr(_kinds(g, f"CASE WHEN e.k IN ('polyline', 'polygon', 'multipatch') THEN aggregate(e.p, 0D, (a, p) -> a + {_length('p', chr(101) + '.k <> ' + chr(39) + 'polyline' + chr(39))}) ELSE 0D END"))


def st_centroid(g: str) -> Column:
    """A struct of x, y: area-weighted for polygons with area, else the mean of all vertices; null if there is none."""
    n = "size(p.x)"
    sign = "(CASE WHEN p.shell IS NOT DISTINCT FROM false THEN -1D ELSE 1D END) * (CASE WHEN (%s) < 0 THEN -1D ELSE 1D END)" % _area2("p")
    cross = "((p.x[i] - p.x[0]) * (p.y[i + 1] - p.y[0]) - (p.x[i + 1] - p.x[0]) * (p.y[i] - p.y[0]))"
    moment = lambda c: f"aggregate({g}.parts, 0D, (a, p) -> a + CASE WHEN {n} < 3 THEN 0D ELSE {sign} * aggregate(sequence(1, {n} - 2), 0D, (t, i) -> t + {cross} * ((p.{c}[i] - p.{c}[0]) + (p.{c}[i + 1] - p.{c}[0]) + 3 * p.{c}[0])) END)"
    weight = f"(2 * ({_area_expr(g)}))"
    mean = lambda c: f"aggregate(flatten(transform({g}.parts, p -> p.{c})), 0D, (a, v) -> a + v) / nullif(size(flatten(transform({g}.parts, p -> p.{c}))), 0)"
    pick = lambda c: f"CASE WHEN {g}.kind = 'polygon' AND {weight} > 0 THEN {moment(c)} / (3 * {weight}) ELSE {mean(c)} END"
    return F.when(F.expr(f"{g}.kind = 'geometrycollection'"), F.raise_error(F.lit("a collection has no centroid"))).otherwise(F.expr(f"named_struct('x', {pick('x')}, 'y', {pick('y')})"))


def _area_expr(g: str) -> str:
    return f"aggregate({g}.parts, 0D, (a, p) -> a + (CASE WHEN p.shell IS NOT DISTINCT FROM false THEN -0.5D ELSE 0.5D END) * abs({_area2('p')}))"


def st_envelope(g: str) -> Column:
    pick = lambda f, c: f"array_{f}(flatten(transform({_all(g)}, p -> p.{c})))"
    return F.expr(f"CASE WHEN size(flatten(transform({_all(g)}, p -> p.x))) > 0 THEN named_struct('xmin', {pick('min', 'x')}, 'ymin', {pick('min', 'y')}, 'xmax', {pick('max', 'x')}, 'ymax', {pick('max', 'y')}) END")


def st_point_count(g: str) -> Column:
    return F.expr(f"aggregate({_all(g)}, 0, (a, p) -> a + size(p.x))")


def st_part_count(g: str) -> Column:
    return F.expr(f"CASE WHEN {g}.kind = 'geometrycollection' THEN size({g}.members) ELSE size({g}.parts) END")


def st_is_empty(g: str) -> Column:
    return st_point_count(g) == 0


def st_dimension(g: str) -> Column:
    of = lambda k: f"CASE WHEN {k} IN ('polygon', 'multipatch') THEN 2 WHEN {k} = 'polyline' THEN 1 ELSE 0 END"
    return F.expr(f"CASE WHEN {g}.kind = 'geometrycollection' THEN coalesce(array_max(transform({g}.members, m -> {of('m.kind')})), 0) ELSE {of(g + '.kind')} END")


def st_is_ring(g: str) -> Column:
    p = f"{g}.parts[0]"
    return F.expr(f"CASE WHEN size({g}.parts) <> 1 THEN false WHEN {g}.kind = 'polygon' THEN size({p}.x) >= 3 WHEN {g}.kind = 'polyline' THEN size({p}.x) >= 4 AND {p}.x[0] = element_at({p}.x, -1) AND {p}.y[0] = element_at({p}.y, -1) ELSE false END")


def st_is_clockwise(g: str) -> Column:
    return F.expr(f"CASE WHEN size({g}.parts) = 1 AND size({g}.parts[0].x) >= CASE WHEN {g}.kind = 'polygon' THEN 3 ELSE 4 END THEN transform({g}.parts, p -> {_area2('p')})[0] < 0 ELSE false END")


def st_segmentize(g: str, longest: float) -> Column:
    """More vertices, so that no segment is longer; z and m are interpolated, closing edges of rings are included."""
    if longest <= 0:
        return F.col(g)
    closed = f"({g}.kind = 'polygon')"
    n, nxt = "size(p.x)", "((i + 1) % size(p.x))"
    pieces = f"greatest(1, cast(ceil(sqrt(power(p.x[{nxt}] - p.x[i], 2) + power(p.y[{nxt}] - p.y[i], 2)) / {longest}D - 1e-12D) AS int))"
    axis = lambda c: f"CASE WHEN p.{c} IS NULL THEN NULL WHEN {n} < 2 THEN p.{c} ELSE concat(flatten(transform(sequence(0, CASE WHEN {closed} THEN {n} - 1 ELSE {n} - 2 END), i -> transform(sequence(0, {pieces} - 1), k -> p.{c}[i] + (p.{c}[{nxt}] - p.{c}[i]) * k / {pieces}))), CASE WHEN {closed} THEN array() ELSE array(element_at(p.{c}, -1)) END) END"
    parts = f"transform({g}.parts, p -> named_struct('x', {axis('x')}, 'y', {axis('y')}, 'z', {axis('z')}, 'm', {axis('m')}, 'shell', p.shell))"
    return F.when(F.col(f"{g}.kind").isin("polyline", "polygon"), F.col(g).withField("parts", F.expr(parts))).otherwise(F.col(g))


def st_is_box(g: str) -> Column:
    """Whether a polygon is its own envelope: one ring of four vertices, with the envelope's area, and not flat."""
    b, p = f"{g}.bbox", f"get({g}.parts, 0)"
    step = lambda c, i: f"(get({p}.{c}, {i}) - get({p}.{c}, 0))"
    # written out for four vertices: without a lambda it stays in generated code, and in arguments of Python functions
    twice = " + ".join(f"({step('x', i)} * {step('y', i + 1)} - {step('x', i + 1)} * {step('y', i)})" for i in (1, 2))
    return F.expr(f"coalesce({g}.kind = 'polygon' AND size({g}.parts) = 1 AND size({p}.x) = 4 AND {b}.xmax > {b}.xmin AND {b}.ymax > {b}.ymin AND abs({twice}) = 2 * ({b}.xmax - {b}.xmin) * ({b}.ymax - {b}.ymin), false)")


def st_is_envelope(g: str) -> Column:
    """Whether a geometry is all of its envelope: a box, or a point of one finite vertex. Envelopes then tell its distances."""
    b, p = f"{g}.bbox", f"get({g}.parts, 0)"
    point = F.expr(f"coalesce({g}.kind = 'point' AND size({g}.parts) = 1 AND size({p}.x) = 1 AND abs({b}.xmin) < double('infinity') AND abs({b}.ymin) < double('infinity'), false)")
    return point | st_is_box(g)


def st_envelope_distance(a: str, b: str) -> Column:
    """Between two geometries that are their envelopes."""
    p, q = F.col(f"{a}.bbox"), F.col(f"{b}.bbox")
    gap = lambda d: F.greatest(F.lit(0.0), p[f"{d}min"] - q[f"{d}max"], q[f"{d}min"] - p[f"{d}max"])
    x, y = gap("x"), gap("y")
    return F.when(x == 0, y).when(y == 0, x).otherwise(F.sqrt(x * x + y * y))


def round_half_up(v: Column, digits: int) -> Column:
    """F.round(v, digits), without its decimal numbers where plain arithmetic gives the same.

    Up to 1e6, v times 10^6 is off by less than 1e-3; away from halves it has the same nearest whole number,
    and a whole number over a power of ten is the double nearest to that decimal."""
    if not 0 <= digits <= 6:
        return F.round(v, digits)
    unit = float(10**digits)
    up = v * unit
    plain = (F.abs(v) < 1e6) & (F.abs(up - F.floor(up) - 0.5) > 1e-2)
    return F.when(plain, F.floor(up + 0.5) / unit).otherwise(F.round(v, digits))


def st_is_disc_centre(g: Column, reach: float) -> Column:
    """Whether a geometry is a point of one vertex, less than `reach` from 0 along each axis."""
    p, b = F.get(g["parts"], F.lit(0)), g["bbox"]
    return F.coalesce((g["kind"] == "point") & (F.size(g["parts"]) == 1) & (F.size(p["x"]) == 1) & (F.abs(b["xmin"]) < reach) & (F.abs(b["ymin"]) < reach), F.lit(False))


def st_disc(g: Column, distance: float, quad_segs: int, square: bool = False) -> Column:
    """The round or square buffer of such a point: clockwise from its left, or lower left, end."""
    x, y, n = g["bbox"]["xmin"], g["bbox"]["ymin"], 4 * quad_segs
    steps = [(-1, -1), (-1, 1), (1, 1), (1, -1)] if square else [(math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)) for k in ((n // 2 - i) % n for i in range(n))]
    axis = lambda c, steps: F.transform(F.array(*[F.lit(distance * u) for u in steps]), lambda u: c + u)
    ring = _part(axis(x, [u for u, _ in steps]), axis(y, [v for _, v in steps]), True)
    return _geometry("polygon", 5, F.array(ring), _box(x - distance, y - distance, x + distance, y + distance))


def _box_tests(a: str, b: str) -> dict[str, str]:
    """How two boxes lie, as conditions on their envelopes."""
    p, q = f"{a}.bbox", f"{b}.bbox"
    ox, oy = (f"(least({p}.{d}max, {q}.{d}max) - greatest({p}.{d}min, {q}.{d}min))" for d in "xy")
    over = f"({p}.xmin <= {q}.xmin AND {p}.ymin <= {q}.ymin AND {p}.xmax >= {q}.xmax AND {p}.ymax >= {q}.ymax)"
    under = f"({q}.xmin <= {p}.xmin AND {q}.ymin <= {p}.ymin AND {q}.xmax >= {p}.xmax AND {q}.ymax >= {p}.ymax)"
    meet, inner = f"({ox} >= 0 AND {oy} >= 0)", f"({ox} > 0 AND {oy} > 0)"
    side = f"((({p}.xmin = {q}.xmin OR {p}.xmax = {q}.xmax) AND {oy} > 0) OR (({p}.ymin = {q}.ymin OR {p}.ymax = {q}.ymax) AND {ox} > 0))"
    return {"ox": ox, "oy": oy, "side": side, "meet": meet, "inner": inner, "intersects": meet, "disjoint": f"NOT {meet}", "contains": over, "covers": over, "within": under, "covered_by": under,
            "equals": f"({over} AND {under})", "touches": f"({meet} AND NOT {inner})", "overlaps": f"({inner} AND NOT {over} AND NOT {under})", "crosses": "false"}


def st_box_relate(a: str, b: str) -> Column:
    """The matrix of two boxes."""
    t = _box_tests(a, b)
    return F.expr(f"""CASE WHEN NOT {t['meet']} THEN 'FF2FF1212' WHEN {t['ox']} = 0 AND {t['oy']} = 0 THEN 'FF2F01212' WHEN NOT {t['inner']} THEN 'FF2F11212' WHEN {t['equals']} THEN '2FFF1FFF2'
        WHEN {t['contains']} THEN CASE WHEN {t['side']} THEN '212F11FF2' ELSE '212FF1FF2' END WHEN {t['within']} THEN CASE WHEN {t['side']} THEN '2FF11F212' ELSE '2FF1FF212' END
        WHEN {t['side']} THEN '212111212' ELSE '212101212' END""")


def st_box_predicate(name: str, a: str, b: str) -> Column:
    return F.expr(_box_tests(a, b)[name])


def st_geometry_at(g: str, i: int) -> Column:
    """Member i of a collection (negative: from the end), as a geometry; members of members aren't unfolded."""
    top = f"filter({g}.members, m -> size(m.path) = 1)"
    m = f"element_at({top}, {i + 1 if i >= 0 else i})"
    box = lambda f, c: f"array_{f}(flatten(transform({m}.parts, p -> p.{c})))"
    return F.when(F.expr(f"{g}.kind <> 'geometrycollection'"), F.raise_error(F.lit("only a collection has members"))).otherwise(F.expr(
        f"named_struct('kind', {m}.kind, 'shape_type', {m}.shape_type, 'has_z', {m}.has_z, 'has_m', {m}.has_m, 'parts', {m}.parts, 'members', CAST(NULL AS array<{MEMBER}>), "
        f"'bbox', CASE WHEN size(flatten(transform({m}.parts, p -> p.x))) > 0 THEN named_struct('xmin', {box('min', 'x')}, 'ymin', {box('min', 'y')}, 'xmax', {box('max', 'x')}, 'ymax', {box('max', 'y')}) END)").cast(GEOMETRY))


def st_dump_parts(g: str) -> Column:
    """Parts as rows for explode(): their number, whether they are shells, and their ordinates."""
    return F.expr(f"transform({_all(g)}, (p, i) -> named_struct('part', i, 'shell', p.shell, 'x', p.x, 'y', p.y, 'z', p.z, 'm', p.m))")


def st_dump_points(g: str) -> Column:
    """Vertices as rows for explode(): part, place in it, x and y."""
    return F.expr(f"flatten(transform({_all(g)}, (p, i) -> transform(p.x, (x, k) -> named_struct('part', i, 'place', k, 'x', x, 'y', p.y[k]))))")


def st_same(a: str, b: str) -> Column:
    """As exactly equal, and M as well; no ordinate equals no ordinate."""
    m = lambda g: F.transform(F.col(f"{g}.parts"), lambda p: p["m"])
    inner = lambda g: F.transform(F.col(f"{g}.members"), lambda x: F.transform(x["parts"], lambda p: p["m"]))
    return st_exactly_equals(a, b) & m(a).eqNullSafe(m(b)) & inner(a).eqNullSafe(inner(b))


def st_contains_point(g: str, x: Column, y: Column, box: str = "false") -> Column:
    """Where the point (_px, _py) lies: 0 inside, 1 on the boundary, 2 outside a polygon (rings by parity, boundary first).

    box: a column that holds st_is_box of the polygon, made once for each before a join; then the envelope decides."""
    n, j = "size(p.x)", "((i + 1) % size(p.x))"
    ax, ay, bx, by = "p.x[i]", "p.y[i]", f"p.x[{j}]", f"p.y[{j}]"
    on = f"exists(sequence(0, {n} - 1), i -> ({bx} - {ax}) * (_py - {ay}) - ({by} - {ay}) * (_px - {ax}) = 0 AND _px BETWEEN least({ax}, {bx}) AND greatest({ax}, {bx}) AND _py BETWEEN least({ay}, {by}) AND greatest({ay}, {by}))"
    odd = f"aggregate(sequence(0, {n} - 1), 0, (c, i) -> c + CASE WHEN ({ay} > _py) <> ({by} > _py) AND _px < {ax} + (_py - {ay}) / ({by} - {ay}) * ({bx} - {ax}) THEN 1 ELSE 0 END)"
    # the planner may move this test ahead of a join's own conditions, so it starts with the cheap answer itself
    sql = f"CASE WHEN _px < {g}.bbox.xmin OR _px > {g}.bbox.xmax OR _py < {g}.bbox.ymin OR _py > {g}.bbox.ymax THEN 2 WHEN {box} THEN CASE WHEN _px > {g}.bbox.xmin AND _px < {g}.bbox.xmax AND _py > {g}.bbox.ymin AND _py < {g}.bbox.ymax THEN 0 ELSE 1 END WHEN exists({g}.parts, p -> {on}) THEN 1 WHEN aggregate({g}.parts, 0, (c, p) -> c + {odd}) % 2 = 1 THEN 0 ELSE 2 END"
    return F.expr(sql.replace("_px", f"({x})").replace("_py", f"({y})")) if isinstance(x, str) else F.expr(sql)


def mercator(src: str, dst: str):
    """How x and y move between "geographic" (degrees) and "mercator" (metres on the sphere of the WGS 84 equator)."""
    a = 6378137.0
    if src == dst:
        return (lambda x: x), (lambda y: y)
    if dst == "mercator":  # beyond the poles there is no y
        return (lambda x: F.radians(x) * a), (lambda y: F.coalesce(F.ln(F.tan(F.lit(math.pi / 4) + F.radians(y) / 2)), F.lit(float("nan"))) * a)
    return (lambda x: F.degrees(x / a)), (lambda y: F.degrees(F.atan(F.exp(y / a)) * 2 - math.pi / 2))


def st_map_xy(g: Column, fx, fy) -> Column:
    """g with x and y of every vertex moved, each by an increasing function of itself."""
    moved = lambda parts: F.transform(parts, lambda p: F.struct(F.transform(p["x"], fx).alias("x"), F.transform(p["y"], fy).alias("y"), p["z"].alias("z"), p["m"].alias("m"), p["shell"].alias("shell")))
    inner = F.transform(g["members"], lambda m: F.struct(*[m[c].alias(c) for c in ("path", "kind", "shape_type", "has_z", "has_m")], moved(m["parts"]).alias("parts")))
    b = g["bbox"]
    box = F.when(b.isNotNull(), _box(fx(b["xmin"]), fy(b["ymin"]), fx(b["xmax"]), fy(b["ymax"])))
    return F.when(g.isNotNull(), F.struct(*[g[c].alias(c) for c in ("kind", "shape_type", "has_z", "has_m")], moved(g["parts"]).alias("parts"), inner.alias("members"), box.alias("bbox")).cast(GEOMETRY))


def st_collect(*geometries: str) -> Column:
    """A collection of single geometries; empties stay, Z and M if any member has them."""
    members = [F.struct(F.array(F.lit(i)).alias("path"), *[F.col(f"{g}.{c}").alias(c) for c in ("kind", "shape_type", "has_z", "has_m", "parts")]) for i, g in enumerate(geometries)]
    anyof = lambda c: F.array_max(F.array(*[F.col(f"{g}.{c}") for g in geometries]))
    low = lambda c: F.least(*[F.col(f"{g}.bbox.{c}") for g in geometries]) if len(geometries) > 1 else F.col(f"{geometries[0]}.bbox.{c}")
    high = lambda c: F.greatest(*[F.col(f"{g}.bbox.{c}") for g in geometries]) if len(geometries) > 1 else F.col(f"{geometries[0]}.bbox.{c}")
    return F.struct(F.lit("geometrycollection").alias("kind"), F.lit(-1).alias("shape_type"), anyof("has_z").alias("has_z"), anyof("has_m").alias("has_m"), F.array().cast(f"array<{PART}>").alias("parts"),
                    F.array(*members).cast(f"array<{MEMBER}>").alias("members"), _box(low("xmin"), low("ymin"), high("xmax"), high("ymax")).alias("bbox")).cast(GEOMETRY)


def st_exactly_equals(a: str, b: str) -> Column:
    """Same code, flags, parts, and X, Y and Z of every vertex in order; M isn't compared."""
    bare = lambda g: F.transform(F.col(f"{g}.parts"), lambda p: F.struct(p["x"], p["y"], p["z"]))
    inner = lambda g: F.transform(F.col(f"{g}.members"), lambda m: F.struct(m["path"], m["shape_type"], m["has_z"], m["has_m"], F.transform(m["parts"], lambda p: F.struct(p["x"], p["y"], p["z"]))))
    same = lambda c: F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return same("shape_type") & same("has_z") & same("has_m") & bare(a).eqNullSafe(bare(b)) & inner(a).eqNullSafe(inner(b))


def matches_de9im(matrix: Column, pattern: str) -> Column:
    return matrix.rlike("^" + "".join({"T": "[012]", "*": "."}.get(c, c) for c in pattern) + "$")


def transpose_de9im(matrix: Column) -> Column:
    return F.concat(*[F.substring(matrix, i, 1) for i in (1, 4, 7, 2, 5, 8, 3, 6, 9)])


def days_to_timestamp(days: Column) -> Column:
    """Days since 1899-12-30 as a timestamp; NaN is null."""
    return F.when(~F.isnan(days), F.timestamp_micros(F.round((days - 25569) * 86400 * 1000000).cast("long")))


def timestamp_to_days(ts: Column) -> Column:
    return F.unix_micros(ts) / 86400000000.0 + 25569


def crs_out_of_range(g: str, geographic: bool) -> Column:
    b = F.col(f"{g}.bbox")
    return (F.abs(b["xmin"]) > 180) | (F.abs(b["xmax"]) > 180) | (F.abs(b["ymin"]) > 90) | (F.abs(b["ymax"]) > 90) if geographic else F.greatest(F.abs(b["xmin"]), F.abs(b["xmax"]), F.abs(b["ymin"]), F.abs(b["ymax"])) < 1000
