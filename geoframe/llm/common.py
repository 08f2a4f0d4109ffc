"""What several operators share: inputs, the shared folder, written tables, components, skewed look-ups."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; set here only where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir()
    if found is not None and not isinstance(found, str):
        found = found.get() if found.isDefined() else None
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="geoframe-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and read again by whoever lost an executor."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    _WRITTEN.append(path)
    return out


#: Folders that written() and operators have made and that are still there.
_WRITTEN: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() has made and that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._written_to)
        _WRITTEN.remove(t._written_to)


def release(spark: SparkSession) -> int:
    """Delete all intermediate tables of this session that are left; call it when results have been stored. How many there were."""
    n = len(_WRITTEN)
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
    return n


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns that are called like a result put under `<name>_in`, and the old names by the new."""
    taken, new = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            free = f"{c}_in"
            while free.lower() in taken:
                free += "_"
            taken.add(free.lower())
            new[free] = c
    return df.withColumnsRenamed({c: free for free, c in new.items()}), new


def restored(df: DataFrame, new: dict[str, str], columns: list[str]) -> DataFrame:
    """The given columns of df, with those that aside() renamed under their own names again."""
    back = {c: free for free, c in new.items()}
    return df.select(*[F.col(f"`{back.get(c, c)}`").alias(c) for c in columns])


def size_in_bytes(df: DataFrame) -> int:
    """What the planner takes df to be, from the sizes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def few_files(df: DataFrame, size: int, each: int = 64 << 20) -> DataFrame:
    """df in no more partitions than `size` bytes fill (two a core at least): a small result isn't many files."""
    # where the planner knows no size it says a huge one: the partitions stay as they are
    return df.coalesce(min(max(2 * df.sparkSession.sparkContext.defaultParallelism, size // each), 1 << 20))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n (a null id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python process, whichever task runs in it."""
    return sys.modules.setdefault("geoframe_worker_cache", types.ModuleType("geoframe_worker_cache")).__dict__


def trim() -> None:
    """Give back to the system what a Python worker has freed: idle workers count on an executor's memory."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, comp) for every end of an edge; comp is the smallest node that links reach.

    Nodes hang on the least of their neighbours, and labels fall to their label's own label
    (pointer jumping) down to the roots, so that chains of length n need about log n rounds.
    Then the edges are those between roots, without repeats: a group of any size, however many
    edges it has, is joined to its labels once, and what is left of it is small. Each round is
    written to the shared folder, and the one before it goes; only counts come to the driver.
    """
    between = lambda rows, a, b: rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    rest = written(between(edges, u, v), "edges")
    size = 32 * rest.count()
    levels = []
    while not levels or not rest.isEmpty():
        ends = rest.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))).alias("e"))
        labels = ends.groupBy(F.col("e.node").alias("node")).agg(F.min("e.near").alias("least")).select("node", F.least("node", "least").alias("comp"))
        labels, changed = written(few_files(labels, size), "labels"), 1
        while changed:
            seen = Observation()
            jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
            new = labels.join(jump, F.col("comp") == F.col("mid")).select("node", F.col("comp").alias("old"), F.col("far").alias("comp"))
            new = written(few_files(new, size).observe(seen, F.coalesce(F.count_if(F.col("old") != F.col("comp")), F.lit(0)).alias("changed")), "labels")
            discard(labels)
            labels, changed = new, seen.get.get("changed")
        of = lambda c: labels.select(F.col("node").alias(f"{c}_node"), F.col("comp").alias(f"{c}_root"))
        left = rest.join(of("a"), F.col("a") == F.col("a_node")).join(of("b"), F.col("b") == F.col("b_node"))
        left = written(few_files(between(left, "a_root", "b_root"), size), "edges")
        discard(rest)
        levels, rest = [*levels, labels], left
    discard(rest)
    found = levels.pop()
    while levels:  # a root of one level is a node of the next, or done
        first = levels.pop()
        last = found.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        told = written(few_files(first.join(last, F.col("comp") == F.col("mid"), "left").select("node", F.coalesce("far", "comp").alias("comp")), size), "labels")
        discard(first, found)
        found = told
    out = found.select("node", "comp")
    out._written_to = found._written_to
    return out


def with_lookup(rows: DataFrame, found: DataFrame, keys: list[str], count: str, by: Column, hot_share: float = 0.001) -> DataFrame:
    """rows left-joined to found (one row a key, with the number of its rows in `count`).

    Keys with more than hot_share of all rows are joined by broadcast: there are at most
    1 / hot_share of them, whatever the input. The others are shuffled; rows that need
    nothing from the shuffle (answered, or with a null key) are dealt out by `by`.
    """
    total = found.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > max(1000.0, hot_share * total)
    wide = [c for c in found.columns if c not in keys]
    first = rows.join(F.broadcast(found.where(hot).select(*keys, F.struct(*wide).alias("_hot"))), keys, "left")
    idle = F.col("_hot").isNotNull() | F.col(keys[0]).isNull()
    probe = [F.when(~idle, F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]
    rest = found.where(~hot).select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], F.lit(0).cast("long").alias("_rs"), F.struct(*wide).alias("_cold"))
    salt = F.when(idle, 1 + F.pmod(F.xxhash64(by), F.lit(1 << 20))).otherwise(F.lit(0)).cast("long").alias("_ks")
    on = [F.col(f"_k{i}") == F.col(f"_r{i}") for i in range(len(keys))] + [F.col("_ks") == F.col("_rs")]
    joined = first.select("*", *probe, salt).join(rest, on, "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in wide])
