"""Near-duplicate embeddings by randomised-rotation binary codes.

Each unit vector is turned by a fixed random rotation and kept as one sign bit per
dimension, with the inner product of the vector and its code as correction factor. For a
pair, <query, code> / factor is an unbiased estimate of the cosine, with an error that
falls as 1 / sqrt(dimensions). Pairs whose estimate plus `width` such errors stays below
the threshold are done with; all others are recomputed in double precision, and the exact
cosine alone decides.

Only vectors with equal labels (and dimensions) are compared. Equal vectors are one class
with a number of copies; its node is the least vec_id together with two hashes of label and
vector, so different vectors may share a vec_id. A label's classes are dealt into blocks by
hash, as large as `tile_bytes` allow, and pairs of blocks are tiles: no task holds a label,
and no pair leaves a tile, only the links and the least reachable node of each member.
Vectors are shuffled in the type that they have.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components, and
those without a label, link with nothing. Rows that share a vec_id are separate vectors, and
count each other among their links if they link. A null vec_id ranks first. A cosine equal to
the threshold links. Only vec_id, embedding and label are read, so other columns may have any
names. Dimensions may differ; a tile holds as many vectors as its bytes allow at any length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoframe.llm import common

THRESHOLD, WIDTH, TILE_BYTES = 0.93, 6.0, 8 << 20


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every caller."""
    q, r = np.linalg.qr(np.random.RandomState(3).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of huge or tiny components leave the range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def encode(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated vectors, and the inner products of vectors and codes."""
    turned = units @ rotation(units.shape[1])
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / np.sqrt(units.shape[1])


def undecided(turned: np.ndarray, codes: np.ndarray, factor: np.ndarray, threshold: float, width: float) -> np.ndarray:
    """Which pairs of turned queries (rows) and codes (columns) may reach the threshold."""
    d = turned.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))
    estimate = turned.astype(np.float32) @ signs.T / factor.astype(np.float32)
    error = np.sqrt(np.maximum(1 - factor**2, 0) / (factor**2 * max(d - 1, 1)))
    return estimate + (width * error + 1e-5).astype(np.float32) >= threshold


def tile(ids, copies, side, vectors, codes, factor, threshold=THRESHOLD, width=WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Links (copies counted) and least reachable id of a tile's members. side: 0, 1: of two blocks; 2: all of one."""
    u = unit(vectors)
    turned = u @ rotation(u.shape[1])
    rows_all, cols_all = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if (side != 2).any() else (np.arange(len(ids)),) * 2
    links, root = np.zeros(len(ids), np.int64), ids.copy()
    found = []
    for lo in range(0, len(rows_all), 256):
        rows = rows_all[lo: lo + 256]
        a, b = np.nonzero(undecided(turned[rows], codes[cols_all], factor[cols_all], threshold, width))
        a, b = rows[a], cols_all[b]
        if rows_all is cols_all:
            a, b = a[a != b], b[a != b]
        for k in range(0, len(a), 1 << 16):
            x, y = a[k: k + (1 << 16)], b[k: k + (1 << 16)]
            near = np.einsum("ij,ij->i", u[x], u[y]) >= threshold
            found.append((x[near], y[near]))
    if rows_all is cols_all:  # an estimate may pass one way only
        found += [(y, x) for x, y in found]
        if found:
            pair = np.unique(np.concatenate([x * len(ids) + y for x, y in found]))
            found = [(pair // len(ids), pair % len(ids))]
    else:
        found = [p for x, y in found for p in ((x, y), (y, x))]
    for x, y in found:
        np.add.at(links, x, copies[y])
    while True:
        old = root.copy()
        for x, y in found:
            np.minimum.at(root, x, root[y])
        if (old == root).all():
            return links, root


def links(vectors: DataFrame, threshold: float = THRESHOLD, width: float = WIDTH, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """vec_id, n_links, component_id and kept, a row per vector (vec_id, embedding, label)."""
    v = vectors.select("vec_id", "embedding", "label")
    if v.schema["embedding"].dataType.elementType.typeName() != "float":
        v = v.withColumn("embedding", F.col("embedding").cast("array<double>"))
    kind = v.schema["embedding"].dataType.simpleString()
    rank = F.coalesce(F.col("vec_id").cast("long"), F.lit(-2**63))
    fits = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    key = ["label", "d", "h1", "h2"]
    fits = F.coalesce(fits, F.lit(False))
    v = v.select(rank.alias("id"), F.when(fits, F.col("label")).alias("label"), F.when(fits, F.size("embedding")).alias("d"),
                 F.when(fits, F.xxhash64("label", "embedding")).alias("h1"), F.when(fits, F.xxhash64(F.lit(1), "label", "embedding")).alias("h2"), "embedding")
    node = F.struct(F.min("id").alias("id"), F.first("h1").alias("h1"), F.first("h2").alias("h2"))
    classes = v.where(F.col("h1").isNotNull()).groupBy(*key).agg(node.alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))

    def code(batches):
        for b in batches:
            raw = [np.asarray(x, np.float64) for x in b.column("embedding").to_pylist()]
            codes, factor = [None] * len(raw), np.zeros(len(raw))
            for d in {len(x) for x in raw}:
                at = [k for k, x in enumerate(raw) if len(x) == d]
                bits, factor[at] = encode(unit(np.stack([raw[k] for k in at])))
                for k, c in zip(at, bits):
                    codes[k] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.binary()), pa.array(factor)], names=[*b.schema.names, "code", "factor"])

    types = dict(v.dtypes)
    coded = classes.mapInArrow(code, f"label {types['label']}, d int, h1 long, h2 long, rep struct<id:bigint,h1:bigint,h2:bigint>, copies long, embedding {kind}, code binary, factor double")
    coded = common.written(common.few_files(coded, common.size_in_bytes(vectors)), "codes")

    block = F.greatest(F.lit(1), F.least(F.lit(16384), F.floor(F.lit(tile_bytes) / (8 * F.col("d")))))
    groups = coded.groupBy("label", "d").agg(F.count("*").alias("n")).select("label", "d", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    # a label may hold a third of all rows; the planner broadcasts the labels of several blocks if they are few, or splits the skewed join
    several = groups.where("blocks > 1")
    placed = coded.join(several, ["label", "d"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("t", F.explode(F.expr("transform(sequence(0, blocks - 1), x -> struct(least(own, x) AS i, greatest(own, x) AS j))")))
    side = F.when(F.col("t.i") == F.col("t.j"), 2).when(F.col("own") == F.col("t.i"), 0).otherwise(1)
    work = placed.select("label", "d", F.col("t.i").alias("i"), F.col("t.j").alias("j"), side.alias("side"), "rep.id", F.col("rep.h1").alias("r1"), F.col("rep.h2").alias("r2"), "copies", "embedding", "code", "factor")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        nodes = g[["id", "r1", "r2"]].to_numpy()
        order = np.lexsort(nodes.T[::-1])
        place = np.argsort(order)  # members by their rank
        n, root = tile(place, g["copies"].to_numpy(), g["side"].to_numpy(), np.stack(g["embedding"]).astype(np.float64), np.stack([np.frombuffer(c, np.uint8) for c in g["code"]]), g["factor"].to_numpy(), threshold, width)
        hit = n > 0
        own, least = nodes[hit], nodes[order[root[hit]]]
        return pd.DataFrame({"id": own[:, 0], "r1": own[:, 1], "r2": own[:, 2], "links": n[hit], "l0": least[:, 0], "l1": least[:, 1], "l2": least[:, 2]})

    found = work.groupBy("label", "d", "i", "j").applyInPandas(run, "id long, r1 long, r2 long, links long, l0 long, l1 long, l2 long")
    whole = lambda *c: F.struct(*[F.col(x).alias(n) for x, n in zip(c, ("id", "h1", "h2"))])
    found = common.written(common.few_files(found.select(whole("id", "r1", "r2").alias("rep"), "links", whole("l0", "l1", "l2").alias("root")), common.size_in_bytes(vectors)), "links")
    comp = common.components(found.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v")))
    told = coded.select(*key, "rep", "copies").join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    told = told.select(*key, "copies", F.coalesce("comp", "rep")["id"].alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = common.with_lookup(v.select("id", *key), told, key, "copies", F.col("id"))
    real = lambda c: F.when(c != -2**63, c)
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return common.few_files(out.select(real(F.col("id")).alias("vec_id"), "n_links", real(F.col("component_id")).alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept")), common.size_in_bytes(vectors))


def op3_embedding_near_dedup(spark, sf_dir):
    return links(common.table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (
  SELECT vec_id, label, e, label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0 AS ok FROM v),
p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.ok AND b.ok
    AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (
  SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x)
SELECT u.vec_id, CAST((SELECT count(*) FROM p WHERE p.x = u.vec_id) AS BIGINT) AS n_links,
       least(u.vec_id, coalesce((SELECT min(y) FROM r WHERE r.x = u.vec_id), u.vec_id)) AS component_id,
       u.vec_id = least(u.vec_id, coalesce((SELECT min(y) FROM r WHERE r.x = u.vec_id), u.vec_id)) AS kept
FROM u
"""
