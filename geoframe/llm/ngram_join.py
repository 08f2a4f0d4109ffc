"""Similarity join on word n-grams: documents whose sets of five-word shingles have Jaccard >= 0.8.

1. Each document's shingles (lower-case, white-space separated words) are hashed to 64 bits.
   Documents with the same set form a class; only its representative (least doc_id, of
   equal ids the least text hash) goes on, with the number of its copies. Id and text hash
   together tell classes apart, so that different texts may share an id, or have none.
2. MinHash LSH forest: in each of `trees` trees a representative has a label of `depth` hash
   minima. The labels are sorted once, by tree and label, over ranges of equal size: a sorted
   prefix trie, in which every subtree is one run. A pass over each range links a label to
   the first of the deepest run that it shares with the one before it; the ends of
   neighbouring ranges are linked too, so a subtree of any size is many tasks' work.
3. Pairs that share a full label in some tree are candidates. They are verified exactly, by
   counting common shingles, where their subtrees' members lie: in tiles of at most `block`
   by `block` members, so that no pair leaves a tile, only a number of links and a root per
   member.
4. A link of similarity s shares a prefix of length d with chance 1 - (1 - s^d)^trees. Each
   link that was found counts for the inverse of its chance, so the links found tell how many
   there are at each similarity, and how many each shorter length would still miss. Prefixes
   are shortened to the greatest length that misses no more than the target recall allows, with
   a margin of one link; at most to the length at which even links at the threshold are found
   with the target's chance. Pairs that share such a prefix, but no full label, are candidates
   of a second pass like the first. Without it, if full labels reach the target.
5. Roots from different tiles are joined by connected components.

Result: a row per document: doc_id, class_id (least doc_id that links reach), n_links
(other documents, copies included, with Jaccard >= threshold).

The stage keeps the representative of each class: one row of those with its id and text.

Edge cases: a text with one to four words is one shingle of all its words. Null texts and
texts without words have no shingles, link with nothing and are their own class. Repeated
rows (same doc_id) count as separate documents that are copies. A null doc_id ranks first.
Texts of any length are shingled whole. Only doc_id and the text are read, so other columns
may have any names; the stage returns them as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoframe.llm import common

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 20, 7, 0.999


def chance(s, d: int, trees: int):
    """That two sets of similarity s share a prefix of d minima in some tree."""
    return 1 - (1 - s**d) ** trees


def shortest(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The greatest prefix length up to depth at which even pairs at the threshold are found with the target's chance."""
    while depth > 1 and chance(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(flat: np.ndarray, sizes: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of texts given as word hashes, end to end; and how many each has."""
    out, count = [], np.zeros(len(sizes), np.int64)
    flat = mix(flat.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    ends = np.cumsum(sizes)
    for k, (e, n) in enumerate(zip(ends, sizes)):
        if n == 0:
            continue
        w = min(words, n)
        x = flat[e - n: e]
        h = np.full(n - w + 1, np.uint64(w))
        for j in range(w):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x[j: n - w + 1 + j])
        h.sort()
        h = h[np.concatenate([[True], h[1:] != h[:-1]])]
        out.append(h)
        count[k] = len(h)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), count


def labels(flat: np.ndarray, count: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Of each set: `depth` minima in each tree, 16 bits of each (sets without shingles: none)."""
    begins = np.concatenate([[0], np.cumsum(count)[:-1]])
    rng = np.random.RandomState(20)
    odd = rng.randint(0, 2**63 - 1, trees * depth).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.randint(0, 2**63 - 1, trees * depth).astype(np.uint64)
    out = np.zeros((len(count), trees * depth), np.uint16)
    for k in range(trees * depth):
        x = flat * odd[k]
        x += add[k]
        x ^= x >> np.uint64(32)
        out[:, k] = mix(np.minimum.reduceat(x, begins) + np.uint64(k)) >> np.uint64(48)
    return out.reshape(len(count), trees, depth)


def word_hashes(text: str):
    """A column of the hashes of a text's words; null texts have none."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]: offsets[-1]], np.diff(offsets)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    raw = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer((np.arange(len(raw) + 1, dtype=np.int32) * raw.shape[1]).tobytes()), pa.py_buffer(raw.tobytes())])


def _bytes(column: pa.Array, wide: int) -> np.ndarray:
    """A binary column of rows of `wide` bytes each as a table."""
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, np.uint8)[first: first + wide * len(column)].reshape(len(column), wide)


def signatures(docs: DataFrame, text: str, words: int, trees: int, depth: int) -> DataFrame:
    """(id, t, d1, d2, n, label): a hash of each text, the digest and size of its set, and its labels in all trees."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                flat, count = shingles(*_lists(part.column("w")), words)
                full = count > 0
                begins = np.concatenate([[0], np.cumsum(count[full])[:-1]]).astype(np.int64)
                d1, d2 = np.zeros(len(count), np.uint64), np.zeros(len(count), np.uint64)
                label = np.zeros((len(count), trees, depth), np.uint16)
                if full.any():
                    d1[full] = np.add.reduceat(mix(flat), begins)
                    d2[full] = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begins)
                    label[full] = labels(flat, count[full], trees, depth)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("t"), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(count), _binary(label)],
                    names=["id", "t", "d1", "d2", "n", "label"])
        common.trim()

    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("t"), word_hashes(text).alias("w"))
    return rows.mapInArrow(run, "id long, t long, d1 long, d2 long, n long, label binary")


def forest(classes: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """(u, v, deep): each label's link to the first of the deepest run of its tree that it shares with the label before it, if that prefix has `least` minima."""
    spark, wide = classes.sparkSession, 2 * depth
    each = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring(F.col("label"), t * wide + 1, F.lit(wide)))
    nodes = classes.select("rep.id", "rep.t", F.posexplode(each).alias("tree", "label"))
    order = ["tree", "label", "id", "t"]
    nodes = nodes.repartitionByRange(common.shuffle_partitions(spark), *order).sortWithinPartitions(*order)

    def run(batches):
        part, last, first = TaskContext.get().partitionId(), None, None
        hub = np.zeros((depth + 1, 2), np.int64)  # of the run of each length that the last label was in: its first
        for b in batches:
            if not b.num_rows:
                continue
            tree, label = b.column("tree").to_numpy(), _bytes(b.column("label"), wide).view(np.uint16)
            ids = np.stack([b.column("id").to_numpy(), b.column("t").to_numpy()], 1)
            before = (np.concatenate([[last[0]], tree[:-1]]), np.concatenate([last[1][None], label[:-1]])) if last else (np.concatenate([[-1], tree[:-1]]), np.concatenate([label[:1], label[:-1]]))
            same = np.logical_and.accumulate(before[1] == label, axis=1).sum(1) * (before[0] == tree)
            place = np.arange(len(tree))
            out = np.zeros((len(tree), 2), np.int64)
            for d in range(least, depth + 1):
                begin = np.maximum.accumulate(np.where(same < d, place, -1))  # -1: the run began in the batch before
                mine = np.where(begin[:, None] < 0, hub[d], ids[begin])
                hub[d] = mine[-1]
                out[same == d] = mine[same == d]
            if first is None:
                first = tree[:1], label[:1], ids[:1]
            last = tree[-1], label[-1], ids[-1]
            hit = same >= least
            n = int(hit.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1, np.int32)), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.binary()), *map(pa.array, (*ids[hit].T, *out[hit].T)), pa.array(same[hit].astype(np.int32))], names=names)
        if last:  # the ends of this range
            yield pa.RecordBatch.from_arrays([pa.array([2 * part, 2 * part + 1], pa.int32()), pa.array(np.array([first[0][0], last[0]], np.int32)), _binary(np.stack([first[1][0], last[1]])),
                                              pa.array([int(first[2][0, 0]), int(last[2][0])]), pa.array([int(first[2][0, 1]), int(last[2][1])]), pa.array([0, 0], pa.int64()), pa.array([0, 0], pa.int64()), pa.array([0, 0], pa.int32())], names=names)

    names = ["end", "tree", "label", "id", "t", "hub_id", "hub_t", "deep"]
    found = common.written(nodes.mapInArrow(run, "end int, tree int, label binary, id long, t long, hub_id long, hub_t long, deep int"), "forest")
    pair = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("t"))
    inner = found.where("end < 0").select(pair("id", "t").alias("u"), pair("hub_id", "hub_t").alias("v"), "deep")
    # two rows a range, in the order of the ranges
    near = Window.orderBy("end")
    ends = found.where("end >= 0").select("*", *[F.lag(c).over(near).alias(f"_{c}") for c in ("tree", "label", "id", "t")]).where("end % 2 = 0 AND tree = _tree")
    deep = F.lit(0)
    for d in range(1, depth + 1):
        deep = F.when(F.substring("label", 1, 2 * d) == F.substring("_label", 1, 2 * d), F.lit(d)).otherwise(deep)
    return inner.unionByName(ends.select(pair("id", "t").alias("u"), pair("_id", "_t").alias("v"), deep.alias("deep")).where(F.col("deep") >= least))


class Sets:
    """Shingle sets of some representatives, as a table of member by shingle that several members hold."""

    def __init__(self, flat: np.ndarray, count: np.ndarray):
        self.count = count
        owner = np.repeat(np.arange(len(count)), count)
        _, column, held = np.unique(flat, return_inverse=True, return_counts=True)
        several = held[column] > 1
        renumber = np.cumsum(held > 1) - 1
        self.owner, self.column, self.width = owner[several], renumber[column[several]], int((held > 1).sum())

    def common(self, rows: slice, columns: slice) -> np.ndarray:
        """How many shingles each of rows has in common with each of columns."""
        a, b = rows.stop - rows.start, columns.stop - columns.start
        both = np.zeros((a, b), np.float32)
        in_a = (self.owner >= rows.start) & (self.owner < rows.stop)
        in_b = (self.owner >= columns.start) & (self.owner < columns.stop)
        step = 4096
        for lo in range(0, self.width, step):
            near = (self.column >= lo) & (self.column < lo + step)
            x, y = np.zeros((a, min(step, self.width - lo)), np.float32), np.zeros((b, min(step, self.width - lo)), np.float32)
            x[self.owner[near & in_a] - rows.start, self.column[near & in_a] - lo] = 1
            y[self.owner[near & in_b] - columns.start, self.column[near & in_b] - lo] = 1
            both += x @ y.T
        return both


def share(a: np.ndarray, b: np.ndarray, d: int) -> np.ndarray:
    """Which labels of a (rows) and b (columns) share a prefix of d minima in some tree."""
    out = np.zeros((len(a), len(b)), bool)
    for t in range(a.shape[1]):
        if len(a) * len(b) <= 4096:
            out |= (a[:, None, t, :d] == b[None, :, t, :d]).all(-1)
            continue
        prefix = np.ascontiguousarray(np.concatenate([a[:, t, :d], b[:, t, :d]])).view(f"V{2 * d}").ravel()
        code = np.unique(prefix, return_inverse=True)[1]
        out |= code[: len(a), None] == code[None, len(a):]
    return out


def verify(ids, copies, side, flat, count, label, threshold, d: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (copies counted) and root of each member of a tile, among pairs that share a prefix of d minima in some tree, but (if d is less) no full label.

    side: 0 and 1 for members of two different blocks, else all 2. Last: how many linked pairs the links found stand for,
    and how many of those prefixes of d, d - 1, ... least minima miss."""
    order = np.argsort(side, kind="stable")
    back = np.argsort(order)
    begins = np.concatenate([[0], np.cumsum(count)])
    ids, copies, side, label = ids[order], copies[order], side[order], label[order]
    n, trees, depth = label.shape
    cut = int((side == 0).sum())
    whole = cut == 0
    links, root, told = np.zeros(n, np.int64), ids.copy(), np.zeros(2 + d - least)
    step, sets, parts = 512, None, []
    columns = slice(0, n) if whole else slice(cut, n)
    for lo in range(0, n if whole else cut, step):
        rows = slice(lo, min(lo + step, n if whole else cut))
        near = share(label[rows], label[columns], d)
        if d < depth and near.any():
            near &= ~share(label[rows], label[columns], depth)
        if whole:
            near[np.arange(rows.stop - rows.start), np.arange(rows.start, rows.stop)] = False
        if not near.any():
            continue
        if sets is None:
            sets = Sets(np.concatenate([flat[begins[k]: begins[k + 1]] for k in order]), count[order])
        both = sets.common(rows, columns)
        union = sets.count[rows, None] + sets.count[None, columns] - both
        near &= both >= threshold * union - 1e-6
        links[rows] += near @ copies[columns]
        if not whole:
            links[columns] += near.T @ copies[rows]
        s = (both[near] / union[near]).astype(np.float64)
        stands = 1 / chance(s, d, trees)
        told += np.array([stands.sum(), *(np.sum(stands * (1 - chance(s, x, trees))) for x in range(d, least - 1, -1))]) / (2 if whole else 1)
        parts.append((rows, columns, near))
    while True:  # the least id that links reach within the tile
        old = root.copy()
        for rows, columns, near in parts:
            if near.any():
                top = np.iinfo(np.int64).max
                root[rows] = np.minimum(root[rows], np.where(near, root[columns][None, :], top).min(1))
                root[columns] = np.minimum(root[columns], np.where(near, root[rows][:, None], top).min(0))
        if (old == root).all():
            return links[back], root[back], told


def verified(docs: DataFrame, classes: DataFrame, near: DataFrame, words: int, trees: int, depth: int, threshold: float, d: int, least: int, block: int) -> DataFrame:
    """The candidates of one prefix length, verified in tiles of the subtrees `near` (node, comp): rep, links, root, and told (see verify; on one row of a tile)."""
    members = near.withColumnRenamed("node", "rep")
    sizes = members.groupBy("comp").agg(F.count("*").alias("members"))
    large = sizes.where(F.col("members") > block).select("comp", F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    groups = max(1, near.count() // 1500)
    # at most rep count / block components are large; their table is narrow, and split from the rest by a join
    placed = members.join(large, "comp", "left").select("rep", "comp", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    tiles = F.expr("transform(sequence(0, blocks - 1), x -> struct(least(own, x) AS i, greatest(own, x) AS j))")
    placed = placed.select("rep", "comp", "blocks", "own", F.explode(tiles).alias("t"))
    side = F.when(F.col("t.i") == F.col("t.j"), 2).when(F.col("own") == F.col("t.i"), 0).otherwise(1)
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(groups))).otherwise(F.xxhash64("comp", "t.i", "t.j"))
    placed = placed.select("rep", "comp", F.col("t.i").alias("i"), F.col("t.j").alias("j"), side.alias("side"), group.alias("grp"))
    # the sets of the representatives: texts again, for candidates only
    reps = classes.select("rep", "copies", "label").join(near.select(F.col("node").alias("rep")), "rep")
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    texts = rows.join(reps, (rows["doc_id"] == reps["rep.id"]) & (rows["t"] == reps["rep.t"])).select("rep", "copies", "label", "text").dropDuplicates(["rep"])
    work = placed.join(texts.select("rep", "copies", "label", word_hashes("text").alias("w")), "rep")
    work = work.select("grp", F.xxhash64("comp").alias("comp"), "i", "j", "side", "rep.id", "rep.t", "copies", "label", "w")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["comp", "i", "j"], sort=False):
            flat, count = shingles(np.concatenate([np.asarray(w, np.int64) for w in g["w"]]), np.array([len(w) for w in g["w"]]), words)
            ids, texts_of = g["id"].to_numpy(), g["t"].to_numpy()
            order = np.lexsort((texts_of, ids))
            place = np.argsort(order)  # members by their rank: id, then text
            label = np.frombuffer(b"".join(g["label"]), np.uint16).reshape(len(g), trees, depth)
            links, root, told = verify(place, g["copies"].to_numpy(), g["side"].to_numpy(), flat, count, label, threshold, d, least)
            hit = (links > 0) | (root != place)
            least_of = order[root[hit]]
            if hit.any():
                rows_told = [list(told)] + [None] * (int(hit.sum()) - 1)
                out.append(pd.DataFrame({"id": ids[hit], "t": texts_of[hit], "links": links[hit], "root_id": ids[least_of], "root_t": texts_of[least_of], "told": pd.Series(rows_told, dtype=object)}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "t": [], "links": [], "root_id": [], "root_t": [], "told": pd.Series([], dtype=object)})

    found = work.groupBy("grp").applyInPandas(tile, "id long, t long, links long, root_id long, root_t long, told array<double>")
    return found.select(F.struct("id", "t").alias("rep"), "links", F.struct(F.col("root_id").alias("id"), F.col("root_t").alias("t")).alias("root"), "told")


def classed(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES,
            depth: int = DEPTH, recall: float = RECALL, block: int = 1024) -> DataFrame:
    """A row per document: id (-2**63 for null), t (a hash of its text), top (id and t of its class's representative; null without shingles), n_links."""
    least = shortest(threshold, trees, depth, recall)
    # ranks: a null id before all others
    docs = docs.select(F.coalesce(F.col("doc_id"), F.lit(-2**63)).alias("doc_id"), F.col(text).alias("text"))
    size = common.size_in_bytes(docs)
    own = common.written(common.few_files(signatures(docs, "text", words, trees, depth), size), "signatures")
    key = ["d1", "d2", "n"]
    classes = own.where("n > 0").groupBy(*key).agg(F.min(F.struct("id", "t")).alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"))
    classes = common.written(common.few_files(classes, common.size_in_bytes(own)), "classes")
    paths = forest(classes, trees, depth, least)
    found = None
    d = depth
    while d:
        fresh = paths.where(F.col("deep") >= d if d == depth else (F.col("deep") >= d) & (F.col("deep") < depth))
        told = None
        if found is None or not fresh.isEmpty():
            near = tree = common.components(paths.where(F.col("deep") >= d))
            if d < depth:  # subtrees that the shorter prefixes join from several
                joined = fresh.select(F.col("u").alias("node")).distinct().join(near, "node").select("comp").distinct()
                near = near.join(joined, "comp", "left_semi")
            more = common.written(common.few_files(verified(docs, classes, near, words, trees, depth, threshold, d, least, block), size), "links")
            common.discard(tree)
            told = more.where("told IS NOT NULL").agg(*[F.coalesce(F.sum(F.col("told")[k]), F.lit(0.0)) for k in range(2 + d - least)]).first()
            found = more if found is None else found.unionByName(more)
        # the greatest length that misses no more than the target allows; nothing is left to do after the second pass
        enough = [x for x in range(depth, least, -1) if told[1 + depth - x] + 1 <= (1 - recall) * told[0]] if d == depth else [d]
        d, before = (enough or [least])[0], d
        d = 0 if d == before else d
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = common.components(found.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v")))
    told = classes.select(*key, "rep", "copies").join(links, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    told = told.select(*key, "copies", F.coalesce("comp", "rep").alias("top"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = own.select("id", "t", *[F.when(F.col("n") > 0, F.col(k)).alias(k) for k in key])
    out = common.with_lookup(rows, told, key, "copies", F.col("id"))
    return out.select("id", "t", "top", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def join(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """A row per document: doc_id, class_id, n_links."""
    real = lambda c: F.when(c != -2**63, c)
    return common.few_files(classed(docs, text, **options).select(
        real(F.col("id")).alias("doc_id"), real(F.coalesce("top.id", "id")).alias("class_id"), "n_links"), common.size_in_bytes(docs))


def op1_ngram_jaccard_join(spark, sf_dir):
    return join(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark, docs, sf_dir):
    """One document of each class stays: that with the least doc_id; of equal ids, that with the least text hash. Without words, one of each id and text."""
    found = classed(docs.select("doc_id", "text"))
    keep = found.where(F.col("top").isNull() | (F.col("top") == F.struct("id", "t"))).select(F.col("id").alias("__id"), F.col("t").alias("__t")).distinct()
    own = docs.withColumns({"__id": F.coalesce(F.col("doc_id"), F.lit(-2**63)), "__t": F.xxhash64("text")})
    return own.join(keep, ["__id", "__t"]).dropDuplicates(["__id", "__t"]).select(*docs.columns)
