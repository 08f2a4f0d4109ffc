"""Substring dedup by hashes of lines and of the passages within them.

A text is cut into units: at line ends, after sentence ends, and before words with a capital
initial, so that a passage that was pasted into a line starts and ends at a cut. Scripts
without spaces are cut at their own marks, and their characters count as parts of words.
Units are normalised (case, white space and edge punctuation) and hashed to 128 bits.
Shorter units than `unit_words` are hashed together with those that follow: of several in
a row (capitals, title case, lists), each starts a window of twice `unit_words` or more.
Of each digest the occurrence with the least (doc_id, offset) stays. Two things go:

* a run of units that all have an earlier occurrence, if it holds `run_words` words or more (so
  every repeated line or paragraph of that length does, as all its units repeat). Less than
  `unit_words` words between two longer units are in no digest: they go if both sides do;
* a line of at least `line_chars` characters with an earlier occurrence, of any number of words.
  Lines that runs may miss are hashed whole for that. With line_chars=1 and run_words out of
  reach this is the dedup of lines by itself.

Shorter repeats, such as licence lines, stay: they are parts of clean documents.
Removed spans are kept as [start, end) in code points of the original text.

Edge cases: null and empty texts have no units and stay as they are; texts of any length are
cut whole. Rows with equal doc_id and text count as one document: neither loses text to the
other. Of different texts with one doc_id the one with the lesser hash of both is the earlier.
A null doc_id ranks first. An input column called removed is returned as `removed_in` (by
the stage under its own name).
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoframe.llm import common

RUN_WORDS = 25
UNIT_WORDS = 4
LINE_CHARS = 100
#: Characters of scripts without spaces, and how many of them count as a word.
HAN, THAI = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff", "\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff"
NO_SPACES = ((re.compile(f"[{HAN}]"), 2), (re.compile(f"[{THAI}]"), 4))
#: A longer run without spaces counts as a word per LONG_PART characters.
LONG_WORD, LONG_PART = re.compile(r"\S{41}"), 8
#: Cuts: after a line end; after a sentence's end and space; before a capital after a space; in scripts without spaces, after their marks and spaces.
CUT = re.compile(rf"(?<=\n)|(?<=[.!?] )|(?<= )(?=[A-ZÀ-ÖØ-ÞА-Я{HAN}{THAI}])|(?<=[。！？｡、，])")
EDGE = " \t\r\n.,;:!?\"'()[]|*%&$#"


def units(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, words, normalised text) of the units of a text, in order; they cover it."""
    cuts = [0, *(m.start() for m in CUT.finditer(text) if 0 < m.start() < len(text)), len(text)]
    scripts = [(kind, each) for kind, each in NO_SPACES if kind.search(text)]
    long = LONG_WORD.search(text) is not None
    out = []
    for a, b in zip(cuts, cuts[1:]):
        words = text[a:b].lower().split()
        n = len(words)
        if long:
            n += sum(len(w) // LONG_PART - 1 for w in words if len(w) > 40 and not any(kind.search(w) for kind, _ in scripts))
        for kind, each in scripts:
            n = max(n, -(-len(kind.findall(text, a, b)) // each))
        if words:
            words[0], words[-1] = words[0].lstrip(EDGE), words[-1].rstrip(EDGE)
        out.append((a, b, n, " ".join(words)))
    return out


def windows(cut: list[tuple[int, int, int, str]], unit_words: int = UNIT_WORDS) -> list[tuple[int, int]]:
    """What is hashed, as [i, j) of units: each of unit_words or more alone; of a row of shorter ones, as many from each on as hold twice that, or all that are left if they hold unit_words."""
    out, i = [], 0
    while i < len(cut):
        if cut[i][2] >= unit_words:
            out.append((i, i + 1))
            i += 1
            continue
        end = i
        while end < len(cut) and cut[end][2] < unit_words:
            end += 1
        j = words = 0
        for k in range(i, end):
            j = max(j, k)
            while j < end and words < 2 * unit_words:
                words += cut[j][2]
                j += 1
            if words >= unit_words and cut[k][2]:
                out.append((k, j))
            words -= cut[k][2]
        i = end
    return out


def lines(text: str, cut: list[tuple[int, int, int, str]], run_words: int = RUN_WORDS, line_chars: int = LINE_CHARS) -> list[tuple[int, int]]:
    """What is hashed as a whole line, as [i, j) of units: lines of line_chars or more without white space around, but less than run_words words."""
    out, i = [], 0
    while i < len(cut):
        j = i + 1
        while j < len(cut) and text[cut[j][0] - 1] != "\n":
            j += 1
        if cut[j - 1][1] - cut[i][0] >= line_chars and sum(u[2] for u in cut[i:j]) < run_words and len(text[cut[i][0]: cut[j - 1][1]].strip()) >= line_chars:
            out.append((i, j))
        i = j
    return out


def spans(text: str, repeated: set[int], run_words: int = RUN_WORDS, unit_words: int = UNIT_WORDS, line_chars: int = LINE_CHARS) -> list[tuple[int, int]]:
    """The spans to remove, given the starts of windows that have an earlier occurrence (of whole lines: -1 - start).

    Units in no window neither break a run nor count in it, but a run starts and ends with others."""
    cut = units(text)
    told: list[bool | None] = [None] * len(cut)
    for i, j in windows(cut, unit_words):
        again = cut[i][0] in repeated
        for k in range(i, j):
            told[k] = told[k] or again
    whole = [(cut[i][0], cut[j - 1][1]) for i, j in lines(text, cut, run_words, line_chars) if -1 - cut[i][0] in repeated]
    out, run, words = [], None, 0
    for (start, end, n, _), again in [*zip(cut, told), ((len(text), len(text), 0, ""), False)]:
        if again is None or n == 0 and start < len(text):
            continue
        if again:
            run, words = (run[0] if run else start, end), words + n
            continue
        if run and words >= run_words:
            out.append(run)
        run, words = None, 0
    joined: list[tuple[int, int]] = []
    for a, b in sorted(out + whole):
        if joined and a <= joined[-1][1]:
            joined[-1] = joined[-1][0], max(b, joined[-1][1])
        else:
            joined.append((a, b))
    return joined


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """docs with their rank (a null id before all others) and a key that only repeated rows share."""
    return docs.withColumn("__rank", F.coalesce(F.col("doc_id"), F.lit(-2**63))).withColumn("__key", F.xxhash64("doc_id", text))


def removals(docs: DataFrame, text: str = "text", unit_words: int = UNIT_WORDS, run_words: int = RUN_WORDS, line_chars: int = LINE_CHARS) -> DataFrame:
    """(__rank, __key, starts): the windows of each document that occur earlier (of whole lines: -1 - start)."""

    def cut(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                rank, key, start, h1, h2 = [], [], [], [], []
                for r, k, t in zip(*(part.column(c).to_pylist() for c in ("__rank", "__key", "text"))):
                    cut_at = units(t or "")
                    until = {}
                    for i, j in windows(cut_at, unit_words):
                        a = cut_at[i][0]
                        h = xxhash.xxh3_128_intdigest(" ".join(u[3] for u in cut_at[i:j]).encode("utf-8", "replace"))
                        # a window that overlaps its own like isn't a repeat of it
                        if j > i + 1 and until.get(h, 0) > a:
                            continue
                        until[h] = cut_at[j - 1][1]
                        rank.append(r), key.append(k), start.append(a), h1.append((h >> 64) - 2**63), h2.append((h & 2**64 - 1) - 2**63)
                    for i, j in lines(t or "", cut_at, run_words, line_chars):
                        h = xxhash.xxh3_128_intdigest(("\n" + " ".join(u[3] for u in cut_at[i:j] if u[3])).encode("utf-8", "replace"))
                        rank.append(r), key.append(k), start.append(-1 - cut_at[i][0]), h1.append((h >> 64) - 2**63), h2.append((h & 2**64 - 1) - 2**63)
                yield pa.RecordBatch.from_arrays([pa.array(rank, pa.int64()), pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], names=["__rank", "__key", "start", "h1", "h2"])
        common.trim()

    rows = docs.select("__rank", "__key", F.col(text).alias("text")).mapInArrow(cut, "__rank long, __key long, start int, h1 long, h2 long")
    rows = common.written(common.few_files(rows, common.size_in_bytes(docs)), "units")
    place = F.struct("__rank", "__key", F.when(F.col("start") < 0, -1 - F.col("start")).otherwise(F.col("start")).alias("start"))
    first = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = rows.join(first.select("h1", "h2", "first"), ["h1", "h2"]).where(place > F.col("first"))
    return later.groupBy("__rank", "__key").agg(F.collect_set("start").alias("starts"))


def dedup(docs: DataFrame, text: str = "text", run_words: int = RUN_WORDS, unit_words: int = UNIT_WORDS, line_chars: int = LINE_CHARS) -> DataFrame:
    """docs with the repeated passages taken out of the text, and removed: array of {start, end}."""
    own, moved = common.aside(docs, "removed", "starts", "__rank", "__key")
    text = {c: free for free, c in moved.items()}.get(text, text)
    ranked = keyed(own, text)
    found = ranked.join(removals(ranked, text, unit_words, run_words, line_chars), ["__rank", "__key"], "left").select(*[f"`{c}`" for c in own.columns], "starts")
    found = common.few_files(found, common.size_in_bytes(own))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", removed array<struct<start:int,`end`:int>>"
    names = own.columns
    at = names.index(text)

    def drop(batches):
        for b in (whole.slice(lo, 512) for whole in batches for lo in range(0, whole.num_rows, 512)):
            texts, gone = b.column(text).to_pylist(), []
            for k, (t, starts) in enumerate(zip(texts, b.column("starts").to_pylist())):
                cuts = spans(t, set(starts), run_words, unit_words, line_chars) if t and starts else []
                gone.append([{"start": a, "end": e} for a, e in cuts])
                if cuts:
                    edges = [0, *(x for c in cuts for x in c), len(t)]
                    texts[k] = "".join(t[a:e] for a, e in zip(edges[::2], edges[1::2]))
            columns = list(b.drop_columns(["starts"]).columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=[*names, "removed"])
        common.trim()

    return found.mapInArrow(drop, schema)


def op8_substring_dedup(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "text", "removed", F.size("removed").alias("n_removed"))


def stage(spark, docs, sf_dir):
    """Documents without their repeated passages; one that has nothing else left goes. n_chars follows the text."""
    columns = docs.columns
    docs, moved = common.aside(docs, "removed", "starts", "__rank", "__key")
    found = dedup(docs)
    if "n_chars" in columns:
        found = found.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return common.restored(found.where((F.size("removed") == 0) | (F.trim("text") != "")), moved, columns)
