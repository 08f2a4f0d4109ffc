"""Best-two-fit packing of token sequences into bins of a fixed size.

Bins are planned on the histogram of piece lengths, which has at most `size` entries at
any scale: a bin opens with the longest piece left, is filled greedily with the longest
piece that fits, and then its smallest added piece is replaced by two unpacked pieces whose
sum fits the expanded gap more tightly, as long as such two exist. A plan (a list of
lengths) is repeated while the histogram allows, so there are few plans. Pieces are then
numbered within their length by counts of hash buckets, and number n of a length gets the
n-th place that the plans hold for that length. No piece is moved between machines but by
its hash bucket; a full piece is a bin of its own and needs no number.

Edge cases: null text counts as empty (its document is the single end token). Repeated
rows are separate pieces and get separate places; which of several pieces of one length gets
which place is decided by a hash of their columns. Texts of any length are encoded whole. An
empty table gives an empty result. Input columns with the name of a result column (piece,
start, length, ids_crc32, sequence_id, offset) are returned as `<name>_in`.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoframe.llm import common

SIZE = 1024
END_ID = 2
#: Fixed value: how byte-level BPE cuts texts before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids, as little-endian 32-bit bytes, by a tokenizers file.

    A byte-level BPE never merges across a single space between two other characters, so a
    text is encoded space by space, and encodings are remembered (up to `most` of them).
    Words that aren't known yet are encoded in one go: a token that starts with a space starts
    the next word. Their merges are made by tiktoken, from the file's own vocabulary, where the
    file's merges are in the order of their ids. Texts with other white space next to a space are
    encoded whole, by tokenizers.

    Strings of special tokens in a text are ordinary text, as the README of the vocabulary files
    reads them: a text can't end its own document. specials=True reads them as their tokens.
    """

    def __init__(self, path: str, most: int = 200_000, specials: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not specials
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()] if specials else []
        n = self.tok.get_vocab_size()
        self.starts = np.array([(self.tok.id_to_token(i) or "").startswith("\u0120") for i in range(n)])
        self.most, self.known = most, {}
        self.merge = self._merger(path) or (lambda text: self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    @staticmethod
    def _merger(path: str):
        """tiktoken's encoder over the file's vocabulary, or None if it wouldn't do the same."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        if any(vocab["".join(m.split(" ") if isinstance(m, str) else m)] != 256 + k for k, m in enumerate(merges)):
            return None
        # printable bytes stand for themselves in the file; the others follow from code point 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(shown))}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        fit = []
        for w in words:
            if not w or w[0].isspace() or w[-1].isspace():
                self.known[w] = None  # a text with such a word is encoded whole
            else:
                fit.append(w)
        for lo in range(0, len(fit), 1000):
            part = fit[lo: lo + 1000]
            ids = np.array(self.merge(" " + " ".join(part)), "<u4")
            at = np.append(np.flatnonzero(self.starts[ids]), len(ids)) * 4
            if len(at) != len(part) + 1:
                raise ValueError("the tokenizer joins words")
            raw = ids.tobytes()
            self.known.update(zip(part, [raw[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        parts = [t.split(" ") for t in texts]
        new = set().union(*[p[1:] for p in parts]).difference(known)
        if new:
            self.learn(list(new))
        heads = self.whole([p[0] for p in parts])
        out: list[bytes | None] = []
        for head, p in zip(heads, parts):
            try:
                first = p[0]
                out.append(None if first and first[-1].isspace() and len(p) > 1 else head + b"".join([known[w] for w in p[1:]]))
            except TypeError:
                out.append(None)
        if self.special:
            out = [None if any(x in t for x in self.special) else ids for t, ids in zip(texts, out)]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(rest, self.whole([texts[k] for k in rest])):
            out[k] = ids
        return out


def cut(ids: bytes, size: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of a document: the first takes what is left over of full ones."""
    n = len(ids) // 4
    edges = [0, *range(n % size or min(n, size), n + 1, size)]
    return [(a, b - a, zlib.crc32(ids[4 * a: 4 * b])) for a, b in zip(edges, edges[1:])]


def pieces(docs: DataFrame, path: str, size: int = SIZE, text: str = "text", extra: list[str] | None = None) -> DataFrame:
    """A row per piece: doc_id, the extra columns, piece, start, length, ids_crc32."""
    docs, moved = common.aside(docs, "piece", "start", "length", "ids_crc32", "__text")
    new = {c: free for free, c in moved.items()}
    own, text = ["doc_id", *[new.get(c, c) for c in extra or []]], new.get(text, text)
    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in own) + ", piece int, start long, length long, ids_crc32 long"

    def run(batches):
        cache = common.worker_cache()
        if ("encoder", path) not in cache:
            cache["encoder", path] = Encoder(path)
        enc, end = cache["encoder", path], np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or "" for t in part.column("__text").to_pylist()]
                rows = [(k, i, *p) for k, ids in enumerate(enc.encode(texts)) for i, p in enumerate(cut(ids + end, size))]
                at, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows))
                kept = part.select(own).take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                    names=[*own, "piece", "start", "length", "ids_crc32"])
        common.trim()

    return docs.select(*[f"`{c}`" for c in own], F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """[(lengths in a bin, how many such bins)], by best-two-fit."""
    left = {n: c for n, c in histogram.items() if c > 0}
    keys = sorted(left)

    def below(x: int, used: dict[int, int]) -> int:
        """The longest length <= x of which a piece is left, or 0."""
        k = bisect_left(keys, x + 1) - 1
        while k >= 0 and left[keys[k]] <= used.get(keys[k], 0):
            k -= 1
        return keys[k] if k >= 0 else 0

    bins = []
    while keys:
        used: dict[int, int] = {}

        def put(n: int, by: int = 1) -> None:
            used[n] = used.get(n, 0) + by

        bin_, gap = [keys[-1]], size - keys[-1]
        put(keys[-1])
        while gap and (n := below(gap, used)):
            bin_.append(n)
            put(n)
            gap -= n
        while gap and len(bin_) > 1:
            least = min(bin_[1:])
            put(least, -1)
            room, best = gap + least, (least, 0, 0)
            a = below(room, used)
            while a and 2 * a > best[0]:  # a >= b, so no smaller a can beat the best sum
                put(a)
                b = below(min(a, room - a), used)
                put(a, -1)
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                if best[0] == room:
                    break
                a = below(a - 1, used)
            if not best[1]:
                put(least)
                break
            bin_.remove(least)
            bin_ += [best[1], best[2]]
            put(best[1])
            put(best[2])
            gap = room - best[0]
        used = {n: c for n, c in used.items() if c}
        times = min(left[n] // c for n, c in used.items())
        bins.append((bin_, times))
        for n, c in used.items():
            left[n] -= c * times
            if not left[n]:
                keys.remove(n)
    return bins


def places(bins: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length: rows of (from which number on a plan's place holds, its first bin, the offset in it)."""
    found: dict[int, list[list[int]]] = {}
    given: dict[int, int] = {}
    base = 0
    for lengths, times in bins:
        offset = 0
        for n in lengths:
            first = given.get(n, 0)
            found.setdefault(n, []).append([first, base, offset])
            given[n] = first + times
            offset += n
        base += times
    return {n: np.array(v, np.int64) for n, v in found.items()}


def placed(by: dict[int, np.ndarray], length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of the pieces with these numbers within their lengths."""
    bin_, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    for n in np.unique(length):
        here = np.flatnonzero(length == n)
        t = by[int(n)]
        k = np.searchsorted(t[:, 0], number[here], "right") - 1
        bin_[here] = t[k, 1] + number[here] - t[k, 0]
        offset[here] = t[k, 2]
    return bin_, offset


def pack(rows: DataFrame, size: int = SIZE, length: str = "length") -> DataFrame:
    """rows with sequence_id and offset. rows are read three times: give a written table."""
    spark = rows.sparkSession
    rows, _ = common.aside(rows, "sequence_id", "offset", "__bucket", "__n", "__before")
    schema, names = rows.schema, rows.columns
    part = F.col(length) < size
    dealt = rows.select(*names, F.when(part, F.pmod(F.xxhash64(*[c for c in names if schema[c].dataType.typeName() not in ("map", "variant")]), F.lit(4 * common.shuffle_partitions(spark)))).alias("__bucket"))
    counts = written_counts(dealt.where(part).groupBy(length, "__bucket").agg(F.count("*").alias("n")))
    bins = plan({r[length]: r["n"] for r in counts.groupBy(length).agg(F.sum("n").alias("n")).collect()}, size)
    shared = spark.sparkContext.broadcast(places(bins))  # plain arrays: a worker needs no installed package to read them
    before = counts.select(length, "__bucket", (F.sum("n").over(Window.partitionBy(length).orderBy("__bucket")) - F.col("n")).alias("__before"))
    order = Window.partitionBy(length, "__bucket").orderBy(*[c for c in ("doc_id", "piece") if c in names] or [F.lit(0)])
    numbered = dealt.where(part).withColumn("__n", F.row_number().over(order).cast("long") - 1).join(before, [length, "__bucket"])
    numbered = numbered.select(*names, (F.col("__n") + F.col("__before")).alias("__n"))
    out = ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long"

    def place(batches):
        for b in batches:
            bin_, offset = placed(shared.value, b.column(length).to_numpy(zero_copy_only=False), b.column("__n").to_numpy(zero_copy_only=False))
            rest = b.drop_columns(["__n"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(bin_), pa.array(offset)], names=[*rest.schema.names, "sequence_id", "offset"])

    base = sum(t for _, t in bins)
    full = dealt.where(F.col(length) == size).select(*names, (F.monotonically_increasing_id() + base).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return numbered.mapInArrow(place, out).unionByName(full)


def written_counts(df: DataFrame) -> DataFrame:
    return common.written(df, "lengths")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_best_fit_packing(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    return pack(common.written(pieces(docs, tokenizer_path()), "pieces"))


def stage(spark, docs, sf_dir):
    """The last stage: a row per piece, with its document's columns but the text, its place, and its text's token checksum."""
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]
    return pack(common.written(pieces(docs, tokenizer_path(), extra=extra), "pieces"))
