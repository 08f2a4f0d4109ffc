"""The layer queries, each with its SQL for the same tables.

Geometries are made from the tables: a rectangle per part (`boxes`) and per supplier (`sbox`),
a point per event (`pts`), a path per order (`paths`). For axis-parallel rectangles every
operation has a closed form, which the SQL states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoframe.functions import native as N
from geoframe.functions import vectorised as V
from geoframe.operators.aggregates import union_aggregate
from geoframe.operators.spatial_join import all_pairs, by_envelope, spatial_join
from geoframe.plans.layer import Layer

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

BOXES = """boxes AS (SELECT p_partkey AS oid, p_name AS name, nullif(p_size % 5, 0) AS n, p_retailprice AS v,
  CAST(p_partkey % 97 AS DOUBLE) AS x0, CAST((p_partkey * 7) % 89 AS DOUBLE) AS y0,
  CAST(1 + p_size % 9 AS DOUBLE) AS w, CAST(1 + p_partkey % 5 AS DOUBLE) AS h FROM part)"""
SBOX = """sbox AS (SELECT s_suppkey AS oid, CAST(s_suppkey % 10 AS DOUBLE) AS x0, CAST((s_suppkey - s_suppkey % 10) / 10 AS DOUBLE) AS y0,
  CAST(1 + s_suppkey % 3 AS DOUBLE) AS w, CAST(1 + s_nationkey % 4 AS DOUBLE) AS h FROM supplier)"""
PAIRS = """pairs AS (SELECT a.oid AS a, b.oid AS b, a.x0 AS ax, a.y0 AS ay, a.x0 + a.w AS aX1, a.y0 + a.h AS aY1, b.x0 AS bx, b.y0 AS by_, b.x0 + b.w AS bX1, b.y0 + b.h AS bY1,
  a.w * a.h AS aa, b.w * b.h AS ba, least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0) AS ox, least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0) AS oy
  FROM sbox a JOIN sbox b ON a.oid < b.oid)"""
PTS = "pts AS (SELECT event_id AS oid, CAST((event_id * 37) % 100 AS DOUBLE) AS x, CAST((event_id * 91) % 97 AS DOUBLE) AS y, value FROM events)"
VERTS = """verts AS (SELECT l_orderkey AS oid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i,
  CAST(l_linenumber AS DOUBLE) AS x, CAST(l_quantity AS DOUBLE) AS y FROM lineitem)"""


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def boxes(spark, d) -> DataFrame:
    p = _t(spark, d, "part")
    x, y, w, h = (c.cast("double") for c in (F.col("p_partkey") % 97, (F.col("p_partkey") * 7) % 89, 1 + F.col("p_size") % 9, 1 + F.col("p_partkey") % 5))
    return p.select(F.col("p_partkey").alias("oid"), F.col("p_name").alias("name"), F.nullif(F.col("p_size") % 5, F.lit(0)).alias("n"), F.col("p_retailprice").alias("v"), N.st_box(x, y, w, h).alias("geometry"))


def sbox(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return _t(spark, d, "supplier").select(k.alias("oid"), N.st_box((k % 10).cast("double"), ((k - k % 10) / 10).cast("double"), (1 + k % 3).cast("double"), (1 + F.col("s_nationkey") % 4).cast("double")).alias("geometry"))


def pts(spark, d, dealt: bool = False) -> DataFrame:
    """dealt: over all cores, however few files there are, for what costs much a row."""
    k = F.col("event_id")
    e = _t(spark, d, "events").select("event_id", "value")
    return (e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if dealt else e).select(k.alias("oid"), "value", N.st_point(((k * 37) % 100).cast("double"), ((k * 91) % 97).cast("double")).alias("geometry"))


def paths(spark, d) -> DataFrame:
    rows = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("oid")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))).alias("v"))
    axis = lambda c: F.transform("v", lambda r: r[c].cast("double"))
    return rows.select("oid", N.st_line(axis("l_linenumber"), axis("l_quantity")).alias("geometry"))


def pairs(spark, d) -> DataFrame:
    """Pairs of supplier boxes whose bboxes meet: every operation below is decided by those, the rest by the bbox."""
    s = sbox(spark, d)
    a, b = s.select(F.col("oid").alias("a"), F.col("geometry").alias("ga")), s.select(F.col("oid").alias("b"), F.col("geometry").alias("gb"))
    return spatial_join(a, b, "ga", "gb", 4.0).where("a < b")


def flagship(spark, d) -> DataFrame:
    got = Layer(boxes(spark, d)).read_features(where="n IS NOT NULL AND n >= 2 AND NOT (name LIKE 'zzz%')", bbox=(10, 10, 60, 60), limit=200)
    return got.select("oid", "name", "n", N.st_area("geometry").alias("area"), N.st_length("geometry").alias("perimeter"), N.st_centroid("geometry").alias("c")).select("oid", "name", "n", "area", "perimeter", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def _where(name: str, text: str, sql: str) -> None:
    def run(spark, d):
        return Layer(boxes(spark, d)).read_features(where=text).select("oid", "name", "n")

    QUERIES[name], ORACLES[name] = run, f"WITH {BOXES} SELECT oid, name, n FROM boxes WHERE {sql}"


for _name, _text, _sql in (
    ("where_cmp", "n > 2", "n > 2"), ("where_and_or_not", "NOT (n > 2 OR name = 'small ring') AND oid <= 1000", "NOT (n > 2 OR name = 'small ring') AND oid <= 1000"),
    ("where_in", "n IN (1, 3)", "n IN (1, 3)"), ("where_not_in", "n NOT IN (1, 3)", "n NOT IN (1, 3)"), ("where_not_in_null", "n NOT IN (1, NULL)", "false"), ("where_in_null", "n IN (1, NULL)", "n = 1"),
    ("where_like", "name LIKE 'sm_ll%g%'", "name LIKE 'sm_ll%g%'"), ("where_not_like", "name NOT LIKE '%ing'", "name NOT LIKE '%ing'"), ("where_is_null", "n IS NULL", "n IS NULL"), ("where_is_not_null", "n IS NOT NULL", "n IS NOT NULL"),
    ("where_oid", "oid >= 10 AND oid < 20", "oid >= 10 AND oid < 20"), ("where_equals_null", "n = NULL", "false"), ("where_mismatch_equal", "n = 'a'", "false"), ("where_mismatch_unequal", "n <> 'a'", "n IS NOT NULL"),
    ("where_mismatch_order", "name > 1", "false"), ("where_mismatch_in", "n NOT IN ('a')", "n IS NOT NULL"), ("where_like_number", "n LIKE '1%'", "false"), ("where_true", "n = TRUE", "n = 1"), ("where_float", "v >= 1000.5 OR v < 905", "v >= 1000.5 OR v < 905"),
    ("where_three_valued", "NOT (n > 2)", "NOT (n > 2)"),
):
    _where(_name, _text, _sql)


@query(f"WITH {BOXES} SELECT oid, name, n FROM boxes WHERE n = 2")
def where_callable(spark, d):
    return Layer(boxes(spark, d)).read_features(where=lambda r: r["n"] == 2).select("oid", "name", "n")


@query(f"WITH {BOXES} SELECT oid, name FROM boxes WHERE n = 1 ORDER BY oid LIMIT 25 OFFSET 10")
def scan_limit_offset(spark, d):
    return Layer(boxes(spark, d)).read_features(where="n = 1", limit=25, offset=10).select("oid", "name")


@query(f"WITH {BOXES} SELECT oid, n FROM boxes")
def scan_projection(spark, d):
    return Layer(boxes(spark, d)).read_features(fields=["N", "nope"]).drop("geometry")


@query(f"WITH {BOXES} SELECT oid, name FROM boxes WHERE oid = 77")
def point_lookup(spark, d):
    return Layer(boxes(spark, d)).read_feature(77).select("oid", "name")


@query(f"WITH {BOXES} SELECT oid FROM boxes WHERE x0 + w >= 20 AND x0 <= 40 AND y0 + h >= 10 AND y0 <= 30")
def bbox_filter(spark, d):
    return Layer(boxes(spark, d)).read_features(bbox=(20, 10, 40, 30)).select("oid")


@query(f"WITH {BOXES} SELECT min(x0) AS xmin, min(y0) AS ymin, max(x0 + w) AS xmax, max(y0 + h) AS ymax FROM boxes")
def layer_extent(spark, d):
    return Layer(boxes(spark, d)).extent()


@query(f"WITH {BOXES} SELECT count(*) AS n FROM boxes")
def record_count(spark, d):
    return boxes(spark, d).agg(F.count("*").alias("n"))


@query(f"WITH {BOXES} SELECT oid, x0 AS xmin, y0 AS ymin, x0 + w AS xmax, y0 + h AS ymax FROM boxes")
def env(spark, d):
    return boxes(spark, d).select("oid", N.st_envelope("geometry").alias("e")).select("oid", "e.*")


@query(f"WITH {BOXES} SELECT oid, w * h AS area, 2 * (w + h) AS perimeter, x0 + w / 2 AS cx, y0 + h / 2 AS cy FROM boxes")
def measures(spark, d):
    b = boxes(spark, d).select("oid", N.st_area("geometry").alias("area"), N.st_length("geometry").alias("perimeter"), N.st_centroid("geometry").alias("c"))
    return b.select("oid", "area", "perimeter", F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"))


@query(f"WITH {BOXES} SELECT oid, 2 AS dimension, 4 AS points, 1 AS parts, true AS ring, true AS clockwise, false AS empty FROM boxes")
def descriptors(spark, d):
    g = "geometry"
    return boxes(spark, d).select("oid", N.st_dimension(g).alias("dimension"), N.st_point_count(g).alias("points"), N.st_part_count(g).alias("parts"), N.st_is_ring(g).alias("ring"), N.st_is_clockwise(g).alias("clockwise"), N.st_is_empty(g).alias("empty"))


@query(f"WITH {BOXES} SELECT oid, 9 * w * h - w * h AS area, 2 * 3 * (w + h) + 2 * (w + h) AS length FROM boxes")
def holed_area(spark, d):
    b = boxes(spark, d).select("oid", F.col("geometry.bbox").alias("b"))
    x, y, w, h = F.col("b.xmin"), F.col("b.ymin"), F.col("b.xmax") - F.col("b.xmin"), F.col("b.ymax") - F.col("b.ymin")
    g = b.select("oid", N.st_holed_box(x, y, 3 * w, 3 * h, x + w, y + h, w, h).alias("g"))
    return g.select("oid", N.st_area("g").alias("area"), N.st_length("g").alias("length"))


@query(f"""WITH {VERTS}, s AS (SELECT oid, x, y, lag(x) OVER (PARTITION BY oid ORDER BY i) AS px, lag(y) OVER (PARTITION BY oid ORDER BY i) AS py FROM verts)
SELECT oid, round(coalesce(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 0), 6) AS length, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, min(x) AS xmin, max(y) AS ymax, CAST(count(*) AS INTEGER) AS points FROM s GROUP BY oid""")
def path_measures(spark, d):
    g = "geometry"
    p = paths(spark, d).select("oid", F.round(N.st_length(g), 6).alias("length"), N.st_centroid(g).alias("c"), F.col("geometry.bbox.xmin").alias("xmin"), F.col("geometry.bbox.ymax").alias("ymax"), N.st_point_count(g).alias("points"))
    return p.select("oid", "length", F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"), "xmin", "ymax", "points")


@query(f"""WITH {VERTS}, s AS (SELECT oid, x, y, lag(x) OVER (PARTITION BY oid ORDER BY i) AS px, lag(y) OVER (PARTITION BY oid ORDER BY i) AS py FROM verts)
SELECT oid, CAST(1 + coalesce(sum(CASE WHEN px IS NOT NULL THEN greatest(1, ceil(sqrt((x - px) * (x - px) + (y - py) * (y - py)) / 2.5 - 1e-12)) END), 0) AS INTEGER) AS points FROM s GROUP BY oid""")
def segmentize_count(spark, d):
    return paths(spark, d).select("oid", N.st_segmentize("geometry", 2.5).alias("g")).select("oid", N.st_point_count("g").alias("points"))


@query(f"WITH {BOXES} SELECT oid, w * h AS area FROM boxes")
def hull_area(spark, d):
    b = boxes(spark, d).select("oid", F.col("geometry.bbox").alias("b"))
    x0, y0, x1, y1 = (F.col(f"b.{c}") for c in ("xmin", "ymin", "xmax", "ymax"))
    mid = lambda p, q: (p + q) / 2
    m = N.st_multipoint(F.array(x0, x1, mid(x0, x1), x0, x1), F.array(y0, y1, mid(y0, y1), y1, y0))
    return b.select("oid", V.st_convex_hull(m).alias("g")).select("oid", N.st_area("g").alias("area"))


@query(f"WITH {BOXES} SELECT oid, 2 AS points FROM boxes")
def simplify_zigzag(spark, d):
    b = boxes(spark, d).select("oid", F.col("geometry.bbox.xmin").alias("x"))
    line = N.st_line(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.col("x") + i), F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.when(i % 6 == 0, 0.0).otherwise((i % 2) * 0.1 - 0.05)))
    return b.select("oid", V.st_simplify(line, 0.1).alias("g")).select("oid", N.st_point_count("g").alias("points"))


@query(f"WITH {SBOX}, {PAIRS} SELECT a, b, round(sqrt(pow(greatest(0, -ox), 2) + pow(greatest(0, -oy), 2)), 6) AS distance FROM pairs")
def distance_box_box(spark, d):
    """All pairs, as its SQL has them; distance_join is the one for large tables."""
    s = sbox(spark, d)
    a, b = s.select(F.col("oid").alias("a"), F.col("geometry").alias("ga")), s.select(F.col("oid").alias("b"), F.col("geometry").alias("gb"))
    ordered = F.col("a") < F.col("b")
    far = lambda pairs, distance: pairs.select("a", "b", N.round_half_up(distance, 6).alias("distance"))
    return by_envelope(a, b, "ga", "gb", lambda a, b: far(all_pairs(a, F.broadcast(b), ordered), N.st_envelope_distance("ga", "gb")), lambda a, b: far(all_pairs(a, b, ordered), V.st_distance("ga", "gb")))


@query(f"WITH {SBOX}, {PTS} SELECT s.oid AS box, p.oid AS point, round(sqrt(pow(greatest(s.x0 - p.x, 0, p.x - s.x0 - s.w), 2) + pow(greatest(s.y0 - p.y, 0, p.y - s.y0 - s.h), 2)), 6) AS distance FROM sbox s JOIN pts p ON greatest(s.x0 - p.x, 0, p.x - s.x0 - s.w) <= 2 AND greatest(s.y0 - p.y, 0, p.y - s.y0 - s.h) <= 2 WHERE sqrt(pow(greatest(s.x0 - p.x, 0, p.x - s.x0 - s.w), 2) + pow(greatest(s.y0 - p.y, 0, p.y - s.y0 - s.h), 2)) <= 2")
def distance_join(spark, d):
    """Points at one place are as far from a box as each other: places are joined with boxes, then points with the places' pairs."""
    s = sbox(spark, d).select(F.col("oid").alias("box"), F.col("geometry").alias("ga"))
    p = pts(spark, d).select(F.col("oid").alias("point"), F.col("geometry.bbox.xmin").alias("_px"), F.col("geometry.bbox.ymin").alias("_py"))
    at = p.select("_px", "_py").distinct().select("_px", "_py", N.st_point(F.col("_px"), F.col("_py")).alias("gb"))
    near = lambda s, at, distance: spatial_join(s, at, "ga", "gb", 8.0, within=2.0).select("box", "_px", "_py", distance.alias("_d")).where("_d <= 2")
    j = by_envelope(s, at, "ga", "gb", lambda s, at: near(s, at, N.st_envelope_distance("ga", "gb")), lambda s, at: near(s, at, V.st_distance("ga", "gb")))
    return j.join(p, ["_px", "_py"]).select("box", "point", N.round_half_up(F.col("_d"), 6).alias("distance"))


_IN = "ox > 0 AND oy > 0"
_CONTAINS = "ax <= bx AND ay <= by_ AND aX1 >= bX1 AND aY1 >= bY1"
_WITHIN = "bx <= ax AND by_ <= ay AND bX1 >= aX1 AND bY1 >= aY1"
_TEST = {
    "intersects": "ox >= 0 AND oy >= 0", "contains": _CONTAINS, "within": _WITHIN, "covers": _CONTAINS, "covered_by": _WITHIN,
    "touches": "ox >= 0 AND oy >= 0 AND (ox = 0 OR oy = 0)", "overlaps": f"{_IN} AND NOT ({_CONTAINS}) AND NOT ({_WITHIN})", "equals": f"({_CONTAINS}) AND ({_WITHIN})", "crosses": "false",
}


def _predicate(name: str, sql: str) -> None:
    def run(spark, d):
        return pairs(spark, d).where(getattr(V, f"st_{name}")("ga", "gb")).select("a", "b")

    run.__name__ = f"rel_{name}"
    QUERIES[run.__name__], ORACLES[run.__name__] = run, f"WITH {SBOX}, {PAIRS} SELECT a, b FROM pairs WHERE {sql}"


for _name, _sql in _TEST.items():
    _predicate(_name, _sql)


@query(f"WITH {SBOX}, {PAIRS} SELECT a, b FROM pairs WHERE ox < 0 OR oy < 0")
def rel_disjoint(spark, d):
    s = sbox(spark, d)
    a, b = s.select(F.col("oid").alias("a"), F.col("geometry").alias("ga")), s.select(F.col("oid").alias("b"), F.col("geometry").alias("gb"))
    ordered = F.col("a") < F.col("b")
    # envelopes that are apart tell it for all geometries, envelopes that meet for boxes; only the rest is near enough for the exact test
    apart = lambda a, b: all_pairs(a, F.broadcast(b), ordered & ~V.boxes_meet("ga", "gb")).select("a", "b")
    return by_envelope(a, b, "ga", "gb", apart, lambda a, b: all_pairs(a, b, ordered).where(V.st_disjoint("ga", "gb")).select("a", "b"))


_EDGE = "(ox > 0 AND oy = 0) OR (ox = 0 AND oy > 0)"
# boundaries share a segment where equal sides overlap along the other axis
_SIDES = "((ax = bx OR aX1 = bX1) AND oy > 0) OR ((ay = by_ OR aY1 = bY1) AND ox > 0)"


@query(f"""WITH {SBOX}, {PAIRS} SELECT a, b, CASE WHEN ox = 0 AND oy = 0 THEN 'FF2F01212' WHEN {_EDGE} THEN 'FF2F11212'
  WHEN ({_CONTAINS}) AND ({_WITHIN}) THEN '2FFF1FFF2'
  WHEN {_CONTAINS} THEN CASE WHEN {_SIDES} THEN '212F11FF2' ELSE '212FF1FF2' END
  WHEN {_WITHIN} THEN CASE WHEN {_SIDES} THEN '2FF11F212' ELSE '2FF1FF212' END
  ELSE CASE WHEN {_SIDES} THEN '212111212' ELSE '212101212' END END AS matrix FROM pairs WHERE ox >= 0 AND oy >= 0""")
def relate_boxes(spark, d):
    return pairs(spark, d).select("a", "b", V.st_relate("ga", "gb").alias("matrix"))


@query(f"WITH {SBOX} SELECT oid, true AS crosses, '101FF0212' AS matrix FROM sbox")
def crosses_line_box(spark, d):
    s = sbox(spark, d).select("oid", "geometry", F.col("geometry.bbox").alias("b"))
    y = (F.col("b.ymin") + F.col("b.ymax")) / 2
    s = s.select("oid", "geometry", N.st_line(F.array(F.col("b.xmin") - 1, F.col("b.xmax") + 1), F.array(y, y)).alias("line"))
    return s.select("oid", V.st_crosses("line", "geometry").alias("crosses"), V.st_relate("line", "geometry").alias("matrix"))


@query(f"WITH {SBOX}, {PTS} SELECT s.oid AS box, p.oid AS point, CASE WHEN p.x > s.x0 AND p.x < s.x0 + s.w AND p.y > s.y0 AND p.y < s.y0 + s.h THEN 0 ELSE 1 END AS place FROM sbox s JOIN pts p ON p.x BETWEEN s.x0 AND s.x0 + s.w AND p.y BETWEEN s.y0 AND s.y0 + s.h")
def point_in_box(spark, d):
    s = sbox(spark, d).select(F.col("oid").alias("box"), F.col("geometry").alias("ga"), N.st_is_box("geometry").alias("is_box"))
    p = pts(spark, d).select(F.col("oid").alias("point"), F.col("geometry").alias("gb"))
    j = spatial_join(s, p, "ga", "gb", 4.0).withColumns({"_px": F.col("gb.bbox.xmin"), "_py": F.col("gb.bbox.ymin")})
    return j.select("box", "point", N.st_contains_point("ga", F.col("_px"), F.col("_py"), "is_box").alias("place")).where("place < 2")


@query(f"WITH {BOXES}, {PTS} SELECT b.oid, count(*) AS n, round(sum(p.value), 4) AS total FROM boxes b JOIN pts p ON p.x BETWEEN b.x0 AND b.x0 + b.w AND p.y BETWEEN b.y0 AND b.y0 + b.h GROUP BY b.oid")
def spatial_join_count(spark, d):
    """Points at one place are counted and summed before the join, so that its pairs grow with the places, not with the points."""
    b = boxes(spark, d).select("oid", F.col("geometry").alias("ga"))
    at = pts(spark, d).groupBy(F.col("geometry.bbox.xmin").alias("_px"), F.col("geometry.bbox.ymin").alias("_py")).agg(F.count("*").alias("_n"), F.sum("value").alias("_v"))
    p = at.select("_n", "_v", N.st_point(F.col("_px"), F.col("_py")).alias("gb"))
    pairs = lambda b, p: spatial_join(b, p, "ga", "gb", 2.0)  # noqa: E731  a box meets a point where their envelopes meet
    inside = lambda b, p: pairs(b, p).withColumns({"_px": F.col("gb.bbox.xmin"), "_py": F.col("gb.bbox.ymin")}).where(N.st_contains_point("ga", F.col("_px"), F.col("_py")) < 2)
    each = lambda rows: rows.select("oid", "_n", "_v")
    j = by_envelope(b, p, "ga", "gb", lambda b, p: each(pairs(b, p)), lambda b, p: each(inside(b, p)))
    return j.groupBy("oid").agg(F.sum("_n").alias("n"), F.round(F.sum("_v"), 4).alias("total"))


@query(f"WITH {BOXES}, {SBOX} SELECT s.oid FROM sbox s WHERE EXISTS (SELECT 1 FROM boxes b WHERE b.x0 <= s.x0 + s.w AND b.x0 + b.w >= s.x0 AND b.y0 <= s.y0 + s.h AND b.y0 + b.h >= s.y0)")
def spatial_join_semi(spark, d):
    s, b = sbox(spark, d).select("oid", F.col("geometry").alias("ga")), boxes(spark, d).select(F.col("geometry").alias("gb"))
    return spatial_join(s, b, "ga", "gb", 8.0, how="left_semi").select("oid")


@query(f"WITH {BOXES}, {SBOX} SELECT b.oid FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM sbox s WHERE b.x0 <= s.x0 + s.w AND b.x0 + b.w >= s.x0 AND b.y0 <= s.y0 + s.h AND b.y0 + b.h >= s.y0)")
def spatial_join_anti(spark, d):
    b, s = boxes(spark, d).select("oid", F.col("geometry").alias("ga")), sbox(spark, d).select(F.col("geometry").alias("gb"))
    return spatial_join(b, s, "ga", "gb", 8.0, how="left_anti").select("oid")


_MEET = "(CASE WHEN ox > 0 AND oy > 0 THEN ox * oy ELSE 0 END)"


def _overlay(name: str, sql: str) -> None:
    def run(spark, d):
        return pairs(spark, d).select("a", "b", getattr(V, f"st_{name}")("ga", "gb").alias("g")).select("a", "b", F.round(N.st_area("g"), 6).alias("area"))

    run.__name__ = f"ov_{name}_area"
    QUERIES[run.__name__], ORACLES[run.__name__] = run, f"WITH {SBOX}, {PAIRS} SELECT a, b, {sql} AS area FROM pairs WHERE ox >= 0 AND oy >= 0"


for _name, _sql in (("intersection", _MEET), ("union", f"aa + ba - {_MEET}"), ("difference", f"aa - {_MEET}"), ("sym_difference", f"aa + ba - 2 * {_MEET}")):
    _overlay(_name, _sql)


@query(f"WITH {SBOX}, {PAIRS} SELECT a, b, CASE WHEN ox > 0 AND oy > 0 THEN 'polygon' WHEN ox > 0 OR oy > 0 THEN 'polyline' ELSE 'point' END AS kind FROM pairs WHERE ox >= 0 AND oy >= 0")
def ov_result_kind(spark, d):
    return pairs(spark, d).select("a", "b", V.st_intersection("ga", "gb")["kind"].alias("kind"))


@query(f"WITH {BOXES} SELECT oid % 7 AS k, CAST(count(DISTINCT x0) AS BIGINT) AS area FROM boxes GROUP BY oid % 7")
def union_aggregate_area(spark, d):
    """Unit squares on a row, one per distinct x: the union's area is their number."""
    b = boxes(spark, d).select((F.col("oid") % 7).alias("k"), F.col("geometry.bbox.xmin").alias("x"))
    b = b.select("k", N.st_box(F.col("x"), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("g"))
    return union_aggregate(b, ["k"], "g").select("k", F.round(N.st_area("g")).cast("long").alias("area"))


def _buffer(name: str, sql: str, **style) -> None:
    def run(spark, d):
        return sbox(spark, d).select("oid", V.st_buffer("geometry", **style).alias("g")).select("oid", F.round(N.st_area("g"), 6).alias("area"))

    run.__name__ = f"buf_{name}_area"
    QUERIES[run.__name__], ORACLES[run.__name__] = run, f"WITH {SBOX} SELECT oid, round({sql}, 6) AS area FROM sbox"


_buffer("mitre", "(w + 0.5) * (h + 0.5)", distance=0.25, join="mitre")
_buffer("bevel", "(w + 0.5) * (h + 0.5) - 2 * 0.0625", distance=0.25, join="bevel")
_buffer("round", "w * h + 0.5 * (w + h) + 16 * sin(pi() / 16) * 0.0625", distance=0.25)
_buffer("erode", "(w - 0.5) * (h - 0.5)", distance=-0.25)


@query(f"WITH {PTS} SELECT oid, 32 AS points, round(16 * sin(pi() / 16), 6) AS area FROM pts")
def buf_point(spark, d):
    g = V.buffered(pts(spark, d, dealt=True).select("oid", "geometry"), "geometry", 1.0, "g")
    return g.select("oid", N.st_point_count("g").alias("points"), N.round_half_up(N.st_area("g"), 6).alias("area"))


@query(f"WITH {SBOX} SELECT oid, round(2 * w, 6) AS flat, round(2 * w + 4, 6) AS square, round(2 * w + 16 * sin(pi() / 16), 6) AS round_, round(w, 6) AS single FROM sbox")
def buf_line_caps(spark, d):
    s = sbox(spark, d).select("oid", F.col("geometry.bbox").alias("b"))
    s = s.select("oid", N.st_line(F.array("b.xmin", "b.xmax"), F.array("b.ymin", "b.ymin")).alias("g"))
    area = lambda g: F.round(N.st_area(g), 6)
    s = s.select("oid", V.st_buffer("g", 1.0, cap="flat").alias("f"), V.st_buffer("g", 1.0, cap="square").alias("q"), V.st_buffer("g", 1.0).alias("r"), V.st_buffer("g", 1.0, single_sided=True).alias("o"))
    return s.select("oid", area("f").alias("flat"), area("q").alias("square"), area("r").alias("round_"), area("o").alias("single"))


# -- shapes that are no boxes: the arrangement decides them

DIA = """dia AS (SELECT s_suppkey AS oid, CAST(s_suppkey % 10 AS DOUBLE) * 2 AS cx, CAST((s_suppkey - s_suppkey % 10) / 10 AS DOUBLE) AS cy, CAST(1 + s_suppkey % 3 AS DOUBLE) AS r FROM supplier),
dbox AS (SELECT oid, cx + cy - r AS x0, cx - cy - r AS y0, 2 * r AS w, 2 * r AS h FROM dia)"""
DPAIRS = PAIRS.replace("sbox", "dbox")


def diamonds(spark, d) -> DataFrame:
    """A square on its corner per supplier. Along x + y and x - y it is a box, of twice its area."""
    k = F.col("s_suppkey")
    s = _t(spark, d, "supplier").select(k.alias("oid"), ((k % 10) * 2).cast("double").alias("x"), ((k - k % 10) / 10).cast("double").alias("y"), (1 + k % 3).cast("double").alias("r"))
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    return s.select("oid", "r", N.st_polygon(F.array(x - r, x, x + r, x), F.array(y, y + r, y, y - r)).alias("geometry"))


def diamond_pairs(spark, d) -> DataFrame:
    s = diamonds(spark, d)
    a, b = s.select(F.col("oid").alias("a"), F.col("geometry").alias("ga")), s.select(F.col("oid").alias("b"), F.col("geometry").alias("gb"))
    return spatial_join(a, b, "ga", "gb", 4.0).where("a < b")


def five(x, y, w, h):
    """A rectangle with one vertex more, on its upper side."""
    return N.st_polygon(F.array(x, x, x + w / 2, x + w, x + w), F.array(y, y + h, y + h, y + h, y))


@query(f"""WITH {DIA}, {DPAIRS} SELECT a, b, CASE WHEN ox = 0 AND oy = 0 THEN 'FF2F01212' WHEN {_EDGE} THEN 'FF2F11212'
  WHEN ({_CONTAINS}) AND ({_WITHIN}) THEN '2FFF1FFF2'
  WHEN {_CONTAINS} THEN CASE WHEN {_SIDES} THEN '212F11FF2' ELSE '212FF1FF2' END
  WHEN {_WITHIN} THEN CASE WHEN {_SIDES} THEN '2FF11F212' ELSE '2FF1FF212' END
  ELSE CASE WHEN {_SIDES} THEN '212111212' ELSE '212101212' END END AS matrix FROM pairs WHERE ox >= 0 AND oy >= 0""")
def dia_relate(spark, d):
    return diamond_pairs(spark, d).select("a", "b", V.st_relate("ga", "gb").alias("matrix")).where("NOT matrix LIKE 'FF_FF%'")


for _name, _sql in _TEST.items():
    if _name in ("within", "covers", "touches", "overlaps"):
        def _run(spark, d, name=_name):
            return diamond_pairs(spark, d).where(getattr(V, f"st_{name}")("ga", "gb")).select("a", "b")

        QUERIES[f"dia_{_name}"], ORACLES[f"dia_{_name}"] = _run, f"WITH {DIA}, {DPAIRS} SELECT a, b FROM pairs WHERE {_sql}"


@query(f"""WITH {DIA}, {DPAIRS}, m AS (SELECT a, b, aa / 2 AS aa, ba / 2 AS ba, CASE WHEN ox > 0 AND oy > 0 THEN ox * oy / 2 ELSE 0 END AS i FROM pairs WHERE ox >= 0 AND oy >= 0)
SELECT a, b, round(i, 6) AS inter, round(aa + ba - i, 6) AS uni, round(aa - i, 6) AS diff, round(aa + ba - 2 * i, 6) AS sym FROM m""")
def dia_overlay(spark, d):
    p = diamond_pairs(spark, d).where(V.st_intersects("ga", "gb"))
    area = lambda op, name: F.round(N.st_area(op), 6).alias(name)
    p = p.select("a", "b", V.st_intersection("ga", "gb").alias("i"), V.st_union("ga", "gb").alias("u"), V.st_difference("ga", "gb").alias("d"), V.st_sym_difference("ga", "gb").alias("s"))
    return p.select("a", "b", area("i", "inter"), area("u", "uni"), area("d", "diff"), area("s", "sym"))


@query(f"WITH {DIA} SELECT oid, round(2 * r * r + sqrt(2) * r + 16 * sin(pi() / 16) * 0.0625, 6) AS area FROM dia")
def buf_diamond_area(spark, d):
    return diamonds(spark, d).select("oid", V.st_buffer("geometry", 0.25).alias("g")).select("oid", F.round(N.st_area("g"), 6).alias("area"))


@query(f"""WITH {SBOX} SELECT oid, oid % 4 < 3 AS within, oid % 4 < 3 AS covered_by, oid % 4 = 3 AS touches, oid % 2 = 0 AS equals,
  CASE oid % 4 WHEN 1 THEN '2FF1FF212' WHEN 3 THEN 'FF2F11212' ELSE '2FF11F212' END AS matrix FROM sbox""")
def rel_nested(spark, d):
    """A box in a column of a larger polygon: at its left side, between, at its right side, or beside it; and the polygon against its envelope, which may be moved."""
    s = sbox(spark, d).select("oid", F.col("geometry.bbox").alias("e"))
    x, y, w, h, k = F.col("e.xmin"), F.col("e.ymin"), F.col("e.xmax") - F.col("e.xmin"), F.col("e.ymax") - F.col("e.ymin"), (F.col("oid") % 4).cast("double")
    s = s.select("oid", five(x, y, 3 * w, 3 * h).alias("outer"), N.st_box(x + k * w, y + h, w, h).alias("inner"), N.st_box(x + F.col("oid") % 2, y, 3 * w, 3 * h).alias("same"))
    return s.select("oid", V.st_within("inner", "outer").alias("within"), V.st_covered_by("inner", "outer").alias("covered_by"), V.st_touches("inner", "outer").alias("touches"),
                    V.st_equals("outer", "same").alias("equals"), V.st_relate("inner", "outer").alias("matrix"))


@query(f"""WITH {SBOX} SELECT oid, oid % 4 >= 2 AS crosses, oid % 4 = 1 AS touches, CASE oid % 4 WHEN 0 THEN 'FF1FF0212' WHEN 1 THEN 'FF1F00212' WHEN 2 THEN '1010F0212' ELSE '101FF0212' END AS matrix FROM sbox""")
def rel_line_polygon(spark, d):
    """A line that ends before a polygon, on its side, inside it, or beyond it."""
    s = sbox(spark, d).select("oid", F.col("geometry.bbox").alias("e"))
    x, y, w, h, k = F.col("e.xmin"), F.col("e.ymin"), F.col("e.xmax") - F.col("e.xmin"), F.col("e.ymax") - F.col("e.ymin"), F.col("oid") % 4
    far = F.when(k == 0, x - 0.5).when(k == 1, x).when(k == 2, x + w / 2).otherwise(x + w + 1)
    s = s.select("oid", five(x, y, w, h).alias("p"), N.st_line(F.array(x - 1, far), F.array(y + h / 2, y + h / 2)).alias("l"))
    return s.select("oid", V.st_crosses("l", "p").alias("crosses"), V.st_touches("l", "p").alias("touches"), V.st_relate("l", "p").alias("matrix"))


@query(f"""WITH {SBOX} SELECT oid, 4 * w * h AS inter, round(4 * w * h + (1.5 * w + 1) * (3 * h + 2), 6) AS uni, 4 * w * h AS diff, 9 * w * h AS plugged, 'polyline' AS seam FROM sbox""")
def ov_holed(spark, d):
    """A box with a hole against one that covers its left half, and against one that fills the hole."""
    s = sbox(spark, d).select("oid", F.col("geometry.bbox").alias("e"))
    x, y, w, h = F.col("e.xmin"), F.col("e.ymin"), F.col("e.xmax") - F.col("e.xmin"), F.col("e.ymax") - F.col("e.ymin")
    s = s.select("oid", N.st_holed_box(x, y, 3 * w, 3 * h, x + w, y + h, w, h).alias("g"), N.st_box(x - 1, y - 1, 1.5 * w + 1, 3 * h + 2).alias("half"), N.st_box(x + w, y + h, w, h).alias("plug"))
    s = s.select("oid", V.st_intersection("g", "half").alias("i"), V.st_union("g", "half").alias("u"), V.st_difference("g", "half").alias("d"), V.st_union("g", "plug").alias("p"), V.st_intersection("g", "plug")["kind"].alias("seam"))
    area = lambda g, name: F.round(N.st_area(g), 6).alias(name)
    return s.select("oid", area("i", "inter"), area("u", "uni"), area("d", "diff"), area("p", "plugged"), "seam")


@query(f"WITH {SBOX} SELECT oid, oid % 2 = 0 AS valid, oid % 2 = 0 AS simple FROM sbox")
def validity_crossed(spark, d):
    """Rings and lines, every other one crossing itself."""
    s = sbox(spark, d).select("oid", F.col("geometry.bbox").alias("e"))
    x0, y0, x1, y1, odd = F.col("e.xmin"), F.col("e.ymin"), F.col("e.xmax"), F.col("e.ymax"), F.col("oid") % 2 == 1
    x, y = F.array(x0, F.when(odd, x1).otherwise(x0), x1, F.when(odd, x0).otherwise(x1)), F.array(y0, y1, F.when(odd, y0).otherwise(y1), F.when(odd, y1).otherwise(y0))
    s = s.select("oid", N.st_polygon(x, y).alias("p"), N.st_line(x, y).alias("l"))
    return s.select("oid", V.st_is_valid("p").alias("valid"), V.st_is_simple("l").alias("simple"))


@query(f"WITH {SBOX} SELECT oid, CAST(0 AS INTEGER) AS part, k AS place, CASE k WHEN 0 THEN x0 WHEN 1 THEN x0 ELSE x0 + w END AS x, CASE k WHEN 0 THEN y0 WHEN 3 THEN y0 ELSE y0 + h END AS y FROM sbox, (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS k)")
def dump_points(spark, d):
    return sbox(spark, d).select("oid", F.explode(N.st_dump_points("geometry")).alias("v")).select("oid", "v.*")


_I = "CAST({} AS BIGINT)"


@query(f"WITH {PTS} SELECT oid, 'POINT (' || {_I.format('x')} || ' ' || {_I.format('y')} || ')' AS wkt FROM pts")
def wkt_point(spark, d):
    return pts(spark, d).select("oid", V.st_as_text("geometry").alias("wkt"))


@query(f"WITH {BOXES} SELECT oid, printf('POLYGON ((%d %d, %d %d, %d %d, %d %d, %d %d))', {_I.format('x0')}, {_I.format('y0')}, {_I.format('x0')}, {_I.format('y0 + h')}, {_I.format('x0 + w')}, {_I.format('y0 + h')}, {_I.format('x0 + w')}, {_I.format('y0')}, {_I.format('x0')}, {_I.format('y0')}) AS wkt FROM boxes")
def wkt_box(spark, d):
    return boxes(spark, d).select("oid", V.st_as_text("geometry").alias("wkt"))


@query(f"WITH {BOXES} SELECT oid, true AS same FROM boxes")
def wkt_roundtrip(spark, d):
    b = boxes(spark, d).select("oid", "geometry", V.st_geom_from_text(V.st_as_text("geometry")).alias("g"))
    return b.select("oid", N.st_exactly_equals("geometry", "g").alias("same"))


@query(f"WITH {PTS} SELECT oid, 'Point' AS type, x, y FROM pts")
def geojson_point(spark, d):
    j = pts(spark, d).select("oid", F.from_json(V.st_as_geojson("geometry"), "type string, coordinates array<double>").alias("j"))
    return j.select("oid", "j.type", F.col("j.coordinates")[0].alias("x"), F.col("j.coordinates")[1].alias("y"))


@query(f"WITH {BOXES} SELECT oid, true AS same FROM boxes")
def geojson_roundtrip(spark, d):
    b = boxes(spark, d).select("oid", "geometry", V.st_geom_from_geojson(V.st_as_geojson("geometry")).alias("g"))
    return b.select("oid", N.st_exactly_equals("geometry", "g").alias("same"))


@query(f"WITH {BOXES} SELECT oid, true AS valid, true AS simple FROM boxes")
def validity(spark, d):
    return boxes(spark, d).select("oid", V.st_is_valid("geometry").alias("valid"), V.st_is_simple("geometry").alias("simple"))


@query(f"WITH {BOXES} SELECT oid, x0 + w > 180 OR y0 + h > 90 AS outside FROM boxes")
def crs_range_check(spark, d):
    return boxes(spark, d).select("oid", N.crs_out_of_range("geometry", True).alias("outside"))


@query(f"WITH {PTS} SELECT oid, round(6378137 * radians(x), 3) AS x, round(6378137 * ln(tan(pi() / 4 + radians(y * 0.8) / 2)), 3) AS y FROM pts")
def crs_web_mercator(spark, d):
    p = pts(spark, d).select("oid", N.st_point(F.col("geometry.bbox.xmin"), F.col("geometry.bbox.ymin") * 0.8).alias("g"))
    return p.select("oid", V.st_transform("g", 4326, 3857).alias("t")).select("oid", F.round("t.bbox.xmin", 3).alias("x"), F.round("t.bbox.ymin", 3).alias("y"))


@query(f"WITH {PTS} SELECT oid, true AS back FROM pts")
def crs_roundtrip(spark, d):
    p = pts(spark, d).select("oid", N.st_point(F.col("geometry.bbox.xmin") / 50 + 116, F.col("geometry.bbox.ymin") / 4 + 20).alias("g"))
    p = p.select("oid", "g", V.st_transform(V.st_transform("g", 4490, 4527), 4527, 4490).alias("t"))
    return p.select("oid", ((F.abs(F.col("t.bbox.xmin") - F.col("g.bbox.xmin")) < 1e-9) & (F.abs(F.col("t.bbox.ymin") - F.col("g.bbox.ymin")) < 1e-9)).alias("back"))


@query(f"WITH {BOXES} SELECT oid, n FROM boxes WHERE NOT (oid % 3 = 0)")
def delete_rows(spark, d):
    b = boxes(spark, d)
    return Layer(b).delete(b.where("oid % 3 = 0").select("oid")).df.select("oid", "n")


@query(f"WITH {BOXES} SELECT oid, CASE WHEN oid % 3 = 0 THEN 99 ELSE n END AS n FROM boxes")
def update_rows(spark, d):
    b = boxes(spark, d)
    return Layer(b).update(b.where("oid % 3 = 0").withColumn("n", F.lit(99).cast("int"))).df.select("oid", "n")


@query(f"WITH {BOXES} SELECT oid FROM boxes UNION ALL SELECT (SELECT max(oid) FROM boxes) + row_number() OVER (ORDER BY oid) AS oid FROM boxes WHERE oid % 3 = 0")
def append_rows(spark, d):
    b = boxes(spark, d)
    return Layer(b).append(b.where("oid % 3 = 0")).df.select("oid")


@query("""SELECT event_id AS oid, epoch_us(ts) / 86400000000.0 + 25569 AS days, true AS same FROM events""")
def day_numbers(spark, d):
    e = _t(spark, d, "events").select(F.col("event_id").alias("oid"), F.col("ts").cast("timestamp").alias("ts"))
    days = N.timestamp_to_days(F.col("ts"))
    return e.select("oid", days.alias("days"), (F.abs(F.unix_micros(N.days_to_timestamp(days)) - F.unix_micros("ts")) <= 1000).alias("same"))


@query(f"WITH {SBOX}, {PAIRS} SELECT a, b, CASE WHEN ox > 0 AND oy > 0 THEN true ELSE false END AS inner_ FROM pairs WHERE ox >= 0 AND oy >= 0")
def de9im_pattern(spark, d):
    return pairs(spark, d).select("a", "b", V.st_relate("ga", "gb").alias("m")).select("a", "b", (N.matches_de9im(F.col("m"), "T********") & N.matches_de9im(N.transpose_de9im(F.col("m")), "T********")).alias("inner_"))


@query(f"WITH {SBOX} SELECT oid, w * h AS area, 2 * (w + h) AS length, 2 AS members, 2 AS dimension, 5 AS points FROM sbox")
def collection_measures(spark, d):
    s = sbox(spark, d).withColumn("p", N.st_point(F.col("geometry.bbox.xmin") - 5, F.col("geometry.bbox.ymin") - 5))
    s = s.select("oid", N.st_collect("geometry", "p").alias("g"))
    return s.select("oid", N.st_area("g").alias("area"), N.st_length("g").alias("length"), N.st_part_count("g").alias("members"), N.st_dimension("g").alias("dimension"), N.st_point_count("g").alias("points"))


@query(f"WITH {PTS} SELECT x, y, count(*) AS n, round(avg(value), 4) AS mean, rank() OVER (ORDER BY count(*) DESC, x, y) AS place FROM pts GROUP BY x, y QUALIFY place <= 20")
def top_cells(spark, d):
    p = pts(spark, d).groupBy(F.col("geometry.bbox.xmin").alias("x"), F.col("geometry.bbox.ymin").alias("y")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))
    top = p.orderBy(F.desc("n"), "x", "y").limit(20)  # the top 20 alone are ranked
    return top.select("*", F.rank().over(Window.orderBy(F.desc("n"), "x", "y")).cast("long").alias("place"))


@query(f"WITH {BOXES} SELECT oid + 1 AS oid, name, n, w * h AS area FROM boxes WHERE n >= 2")
def gdb_scan(spark, d):
    """The boxes, written to a geodatabase and read back through the data source."""
    import os
    import tempfile
    import uuid

    from geoframe.database import Database

    shared = (spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.gettempdir()).removeprefix("file://")
    db = Database.create(spark, os.path.join(shared, f"{uuid.uuid4().hex}.gdb"))
    db.write_layer(boxes(spark, d).withColumn("oid", F.col("oid") + 1), "boxes", "polygon")
    got = db["boxes"].read_features(where="n >= 2")
    return got.select(F.col("OBJECTID").alias("oid"), "name", "n", F.round(N.st_area("geometry"), 4).alias("area"))
