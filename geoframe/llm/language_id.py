"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of order 0 to 3. A context gives a seen byte
count / (n + d) (n: bytes seen in it, d: different ones) and keeps d / (n + d) to escape
to the next shorter context, where bytes that the longer one has seen are excluded; below
order 0 all bytes are equally likely. The statistics are frozen after training, so the
code length of a byte depends only on the three bytes before it: a table of context by
byte by language holds every code length, and a text's code length in a language is
the sum over its bytes. All bytes of a text are scored.

Executors count the bytes of the sample by their contexts. These counts are the model: they
alone come to the driver and are broadcast, as plain arrays, and each Python worker makes
the table of code lengths from them once.

Edge cases: a null text, or one without a letter, is `und` with score 0. Rows with null lang
aren't learned from. With no learnable row every text is `und`. Repeated rows give repeated
results, and count once in training; ties go to the language that sorts first. Very long
texts are scored in runs of bytes, whole. Input columns called lang_pred, score or
bits_per_byte are returned as `<name>_in`; the stage returns them under their own names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoframe.llm import common

ORDER = 3
LEAST = 16  # an order-3 context is kept if a language has seen it so often
RESULTS = ("lang_pred", "score", "bits_per_byte")


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the three before it, as a number (the oldest highest), and how often it stands so."""
    raw = np.frombuffer(b"".join(b"\n\n\n" + t.encode("utf-8", "replace") for t in texts), np.uint8).astype(np.uint32)
    if len(raw) <= ORDER:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.unique(raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:], return_counts=True)


def model_of(samples: dict[str, list[str]]) -> dict:
    """The counts of some texts by language."""
    langs = sorted(samples)
    return {"langs": langs, "grams": [grams_of(samples[x]) for x in langs]}


class PPM:
    """The frozen tables of a model: context of the last three bytes; bits by context, byte and language."""

    def __init__(self, model: dict, part: int = 512):
        self.langs = model["langs"]
        if not self.langs:
            return
        many = len(self.langs)
        counts, kept = [], []  # by order: of each language sorted (context and byte, count); the contexts that stay
        for order in range(ORDER + 1):
            rows, often = [], []
            for gram, n in model["grams"]:
                key, at = np.unique(gram.astype(np.int64) & (1 << 8 * (order + 1)) - 1, return_inverse=True)
                rows.append((key, np.bincount(at, weights=n, minlength=len(key))))
                context, at = np.unique(key >> 8, return_inverse=True)
                often.append(context[np.bincount(at, weights=rows[-1][1], minlength=len(context)) >= {0: 0, ORDER: LEAST}.get(order, 2)])
            counts.append(rows)
            kept.append(np.unique(np.concatenate(often)) if order else np.zeros(1, np.int64))
        self.table = np.empty((sum(map(len, kept)), 256, many), np.float32)
        kind = np.uint16 if len(self.table) < 1 << 16 else np.int32
        dense, base = np.zeros(1, kind), 0  # of each context of the order before: its row
        for order, context in enumerate(kept):
            shorter = dense[context & (1 << 8 * (order - 1)) - 1] if order else None
            own = []
            for key, n in counts[order]:
                at = np.minimum(np.searchsorted(context, key >> 8), max(len(context) - 1, 0))
                here = context[at] == key >> 8 if len(context) else np.zeros(len(key), bool)
                own.append((at[here], key[here] & 255, n[here]))
            for lo in range(0, len(context), part):
                hi = min(lo + part, len(context))
                parent = self.table[shorter[lo:hi]].astype(np.float64) if order else np.full((1, 256, many), 1 / 256)
                count = np.zeros((hi - lo, 256, many))
                for j, (at, byte, n) in enumerate(own):
                    a, b = np.searchsorted(at, (lo, hi))
                    count[at[a:b] - lo, byte[a:b], j] = n[a:b]
                self.table[base + lo: base + hi] = self._node(parent, count)
            if order:
                dense = np.tile(dense, 256)  # a context that wasn't seen falls to its shorter one
            dense[context] = base + np.arange(len(context))
            base += len(context)
        np.log2(self.table, out=self.table)
        np.negative(self.table, out=self.table)
        self.table = self.table.reshape(-1, many)
        self.context = dense

    @staticmethod
    def _node(shorter: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Probabilities of all bytes in contexts, from their counts and the next shorter contexts'."""
        seen = count > 0
        n, d = count.sum(1, keepdims=True), seen.sum(1, keepdims=True)
        left = np.where(seen, 0, shorter)
        rest = np.maximum(left.sum(1, keepdims=True), 1e-300)
        mixed = count / np.maximum(n + d, 1) + d / np.maximum(n + d, 1) * left / rest
        return np.where(d == 0, shorter, np.where(d == 256, count / np.maximum(n, 1), mixed))

    def bits(self, texts: list[bytes], most: int = 1 << 18) -> np.ndarray:
        """Code lengths, by text and language. Texts are scored in runs of about `most` bytes."""
        out = np.zeros((len(texts), len(self.langs)))
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (size < most or end == start):
                size += len(texts[end]) + ORDER
                end += 1
            raw = np.frombuffer(b"".join(b"\n\n\n" + t for t in texts[start:end]), np.uint8)
            ends = np.cumsum([len(t) + ORDER for t in texts[start:end]])
            begins = np.concatenate([[0], ends[:-1]])
            for lo in range(0, len(raw) - ORDER, most):  # also cuts one very long text
                hi = min(lo + most, len(raw) - ORDER)
                x = raw[lo: hi + ORDER].astype(np.int32)
                at = self.context[(x[:-3] << 16) | (x[1:-2] << 8) | x[2:-1]]
                cost = self.table[(at.astype(np.int32) << 8) | x[3:]]
                # position p of cost is byte p + 3; a text's own bytes are those from begin + 3 on
                p0 = np.maximum(begins, lo) - lo
                p1 = np.minimum(ends - ORDER, hi) - lo
                here = np.flatnonzero(p1 > p0)
                if len(here):
                    cuts = np.stack([p0[here], p1[here]], 1).ravel()
                    if cuts[-1] == len(cost):
                        cuts = cuts[:-1]
                    out[start + here] += np.add.reduceat(cost, cuts, axis=0, dtype=np.float64)[::2]
            start = end
        return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_lang: int = 300) -> dict:
    """Learn from a bounded sample: of each language the docs_per_lang documents with the least hash of their key and text.

    The counts by language come from all rows; the sample is cut by a hash threshold before
    anything is shuffled, and only counts of bytes in their contexts reach the driver.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {"langs": [], "grams": []}
    limit = F.lit(0).cast("long")
    for x, n in counts.items():
        share = min(1.0, (1.3 * docs_per_lang + 30) / n)
        limit = F.when(F.col("lang") == x, F.lit(int(-2**63 + share * (2**64 - 2**11)))).otherwise(limit)
    # repeated rows have one hash, so what is left is bounded by the number of languages
    few = rows.where(F.col("h") <= limit).groupBy("lang", "h").agg(F.first("text").alias("text"))
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= docs_per_lang)

    def count(batches):
        for b in batches:
            names = np.array(b.column("lang").to_pylist(), object)
            texts = np.array(b.column("text").to_pylist(), object)
            for x in sorted(set(names)):
                gram, n = grams_of(list(texts[names == x]))
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    told = few.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs, gram, n = sorted(counts), told.column("gram").to_numpy(), told.column("n").to_numpy()
    # a language whose texts have no bytes at all still has its (empty) tree
    at = np.searchsorted(langs, told.column("lang").to_pylist())
    out = {"langs": langs, "grams": [(gram[at == j].astype(np.uint32), n[at == j]) for j in range(len(langs))]}
    del told
    common.trim()
    return out


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (the likelier language's share under equal priors) and bits_per_byte."""
    docs, moved = common.aside(docs, *RESULTS)
    text = {c: free for free, c in moved.items()}.get(text, text)
    own = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double, bits_per_byte double"
    keep = docs.select(*[f"`{c}`" for c in own], F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def score(batches):
        cache = common.worker_cache()
        if cache.get("ppm", ("",))[0] != name:  # one model at a time is kept
            cache.pop("ppm", None)
            cache["ppm"] = name, PPM(shared.value)
        ppm = cache["ppm"][1]
        for batch in (whole.slice(lo, 512) for whole in batches for lo in range(0, whole.num_rows, 512)):
            letter = np.array(batch.column("__letter").to_pylist(), bool)
            raw = [(t.as_py() or "").encode("utf-8", "replace") if has else b"" for t, has in zip(batch.column(text), letter)]
            rest = batch.drop_columns(["__letter"])
            pred, conf, rate = np.full(len(letter), "und", object), np.zeros(len(letter)), np.zeros(len(letter))
            if ppm.langs:
                bits = ppm.bits(raw)
                best = bits.argmin(1)
                least = bits[np.arange(len(best)), best]
                share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                pred = np.where(letter, np.array(ppm.langs, object)[best], "und")
                conf = np.where(letter, share, 0.0)
                rate = least / np.maximum(1, [len(t) for t in raw])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(pred, pa.string()), pa.array(conf, pa.float64()), pa.array(rate, pa.float64())],
                names=[*rest.schema.names, *RESULTS])
        common.trim()

    return keep.mapInArrow(score, schema)


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(common.fold_of(F.col("doc_id"), 4) != 2)


def op9_language_id(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(learnable(docs)))
    return found.select("doc_id", (common.fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def stage(spark, docs, sf_dir):
    """Documents whose language the models settle stay. `und`, texts that no language explains better than all
    others together, and texts that the best model codes no shorter than plain bytes (other scripts, noise) go."""
    columns = docs.columns
    docs, moved = common.aside(docs, *RESULTS)
    found = identify(docs, fit(learnable(docs)))
    return common.restored(found.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5) & (F.col("bits_per_byte") < 8)), moved, columns)
