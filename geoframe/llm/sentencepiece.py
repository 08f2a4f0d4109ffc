"""SentencePiece encoding and decoding, on a relational lattice.

Encoding: texts are cut into units where a space follows another character, and between
neighbours that stand side by side in no piece: no piece crosses such a cut, so it changes no
result. Of the distinct units all substrings up to the longest piece's length are exploded and
equi-joined to the piece table, which gives the lattice's edges; they are grouped by unit,
and a fold with Spark's `aggregate` turns each lattice into ids. The distinct units are
shuffled once: explode, join and grouping keep their partitioning. Each input partition then
looks up the units it holds in a table written for it, and strings their ids together.

The fold follows the model's own type. A unigram model takes the best path (Viterbi: the
best score at each place, from the edges that end there). A BPE model isn't a best path: it
merges neighbours, best piece first, leftmost first among equals; the fold then
takes the edges in the order of their merges, or replays merge by merge where that order can't
tell. Characters without a piece become byte pieces (or the unknown id, if the model has no
byte pieces).

The fold's state is a number with a bit per cut, or an array that each step copies. The
lattices of units of more than SHORT characters come from the same explode and join; their
edges are folded by folded(), in the partitions that hold them, with a heap of merges (BPE) or
a list of best scores (unigram), so that a unit of any length costs about its length.

Edge cases: null and empty texts have no ids. Repeated rows are encoded alike. Decoding null
ids gives null. Of pieces with equal scores the leftmost merges first. A model that normalises
texts (beyond a dummy prefix and spaces as ▁) is refused. Input columns with the name of a
result are returned as `<name>_in`.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoframe.llm import common

SPACE = "▁"
SHORT = 61  # n + 1 cuts are bits of a number
BLOCK = 256  # characters that substrings are taken from at a time
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            out |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return out

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[at: at + n]
            at += n


class Pieces:
    """The piece table of a model file and what else encoding needs."""

    def __init__(self, path: str):
        import sentencepiece

        self.path = path
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        self.kind = dict(_fields(next(v for k, v in parts if k == 2))).get(3, UNIGRAM)
        norm = dict(_fields(next((v for k, v in parts if k == 3), b"")))
        if norm.get(2) or norm.get(4, 1) or not norm.get(3, 1) or not norm.get(5, 1):
            raise ValueError("only models without normalisation, with a dummy prefix and escaped spaces, are supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.rows = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.unknown = sp.unk_id()
        self.byte0 = sp.piece_to_id("<0x00>") if n and sp.is_byte(sp.piece_to_id("<0x00>")) else -1
        self.longest = max(len(p) for p, _, _ in self.rows)
        self.least = min(s for _, _, s in self.rows)
        bad = [p for p, _, _ in self.rows if re.search(f"[^{SPACE}]{SPACE}", p)]
        if bad:
            raise ValueError(f"pieces span words: {bad[:3]}")
        self.distinct = sorted({x for _, _, x in self.rows}, reverse=True)  # scores; the best one's rank is 0
        self.text = [b"" if sp.is_control(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if i == self.unknown else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]


def words(text: str | None) -> list[str]:
    """The words of a text, with the spaces before them; the first has the dummy prefix."""
    return re.findall(" +[^ ]*", " " + text) if text else []


def keys(text: str | None) -> list[str]:
    """The words of a text without their first space each."""
    if not text:
        return []
    parts = text.split(" ")
    return parts if "" not in parts else [w[1:] for w in words(text)]


class Grams:
    """Which neighbours occur side by side in pieces: units end between others, and only substrings of known fours may be pieces."""

    SLOTS = 22  # bits of the hash of four neighbours; two that share a slot only cost a look-up

    def __init__(self, rows: list[tuple]):
        self.names = [p for p, *_ in rows if len(p) > 1]

    def __getstate__(self):
        return {"names": self.names}

    def _tables(self):
        """A number for each character; by two numbers, and by the slot of four, whether a piece holds them. The first call makes them."""
        if not hasattr(self, "_made"):
            text, ends = self._flat(self.names)
            chars = np.unique(text)
            code = np.zeros(0x110000, np.int32)
            code[chars] = np.arange(1, len(chars) + 1)  # a character that is in no piece of several has 0
            code[ord(" ")] = code[ord(SPACE)]
            wide, number = len(chars) + 1, code[text]
            left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(text))  # characters from here to the piece's end
            known = np.unique((number[:-1].astype(np.int64) * wide + number[1:])[left[:-1] >= 2])
            if wide * wide <= 1 << 27:
                table = np.zeros(wide * wide, bool)
                table[known] = True
                known = table
            slots = np.zeros(1 << self.SLOTS, bool)
            slots[self._slot(number, 4)[left[: max(len(text) - 3, 0)] >= 4]] = True
            self._made = code, known, wide, slots
        return self._made

    @staticmethod
    def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The characters of words, end to end, and where each ends."""
        return np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))

    def _slot(self, number: np.ndarray, q: int) -> np.ndarray:
        n = max(len(number) - q + 1, 0)
        h = np.zeros(n, np.uint64)
        for k in range(q):
            h = (h + number[k: n + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def cut(self, words: list[str]) -> dict[int, list[str]]:
        """The units of those words that fall into several, by the words' places in the list."""
        if not words:
            return {}
        code, known, wide, *_ = self._tables()
        text, ends = self._flat(words)
        number = code[text]
        key = number[:-1].astype(np.int64) * wide + number[1:]
        if known.dtype == bool:
            apart = ~known[key]
        else:
            at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            apart = known[at] != key if len(known) else np.ones(len(key), bool)
        apart[ends[:-1] - 1] = False
        cuts = np.flatnonzero(apart) + 1
        word = np.searchsorted(ends, cuts, "right")
        at = cuts - np.where(word > 0, ends[word - 1], 0)
        out: dict[int, list[str]] = {}
        before, first, whole, mine = -1, 0, "", []
        for k, x in zip(word.tolist(), at.tolist()):
            if k != before:
                mine.append(whole[first:])
                mine = out[k] = []
                before, first, whole = k, 0, words[k]
            mine.append(whole[first:x])
            first = x
        mine.append(whole[first:])
        return out

    def fours(self, units: list[str]) -> np.ndarray:
        """For each unit a number: a bit per place, from the lowest on (of the first SHORT + 1), whether the four characters from there may stand in a piece."""
        if not units:
            return np.zeros(0, np.int64)
        code, _, _, slots = self._tables()
        text, ends = self._flat(units)
        held = np.zeros(len(text), bool)
        held[: max(len(text) - 3, 0)] = slots[self._slot(code[text], 4)]
        begins, sizes = np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
        place = np.arange(len(text)) - np.repeat(begins, sizes)
        held &= place <= np.repeat(sizes, sizes) - 4  # none reaches into the next unit: the number is the unit's alone
        return np.add.reduceat(np.where(held & (place <= SHORT), np.left_shift(np.int64(1), np.minimum(place, SHORT)), 0), begins)


class Bits:
    """An edge in one number, so that edges sort as merges do: whether it is one character, rank, start, length, id, from the highest bits down."""

    def __init__(self, pieces):
        self.id = max(i for _, i, _ in pieces.rows).bit_length()
        self.span = pieces.longest.bit_length()
        self.rank = len({x for _, _, x in pieces.rows}).bit_length()
        self.start = 62 - self.id - self.span - self.rank
        self.low = self.id + self.span
        # SQL of the parts of the number v
        self.sql_id = f"cast(v & {(1 << self.id) - 1}L AS int)"
        self.sql_span = f"cast(shiftright(v, {self.id}) & {(1 << self.span) - 1}L AS int)"
        self.sql_start = f"cast(shiftright(v, {self.low}) & {(1 << self.start) - 1}L AS int)"
        self.sql_rank = f"(shiftright(v, {self.low + self.start}) & {(1 << self.rank) - 1}L)"
        self.sql = f"shiftleft(cast(k = 1 AS bigint), 62) + shiftleft(cast(rank AS bigint), {self.low + self.start}) + shiftleft(cast(s AS bigint), {self.low}) + shiftleft(cast(k AS bigint), {self.id}) + _id"

    def parts(self, v: np.ndarray) -> tuple[np.ndarray, ...]:
        """rank, start, end and id of edges."""
        start = v >> self.low & (1 << self.start) - 1
        return v >> self.low + self.start & (1 << self.rank) - 1, start, start + (v >> self.id & (1 << self.span) - 1), v & (1 << self.id) - 1


def folded(edges: np.ndarray, unit: str, kind: int, bits: Bits, scores: list[float], byte0: int, unknown: int) -> list[int]:
    """The ids of a unit from its lattice's edges, for units of any length."""
    rank, start, end, ids = (x.tolist() for x in bits.parts(np.asarray(edges, np.int64)))
    n = len(unit)
    known = {(s, e): k for k, (s, e) in enumerate(zip(start, end))}
    if kind == UNIGRAM:
        best, back = [0.0] + [-1e300] * n, [0] * (n + 1)
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        for k in sorted(range(len(start)), key=lambda k: start[k]):
            by_end[end[k]].append(k)
        for e in range(1, n + 1):
            paths = [(start[k], best[start[k]] + scores[rank[k]]) for k in by_end[e]]
            if (e - 1, e) not in known:
                paths.append((e - 1, best[e - 1] + min(scores) - 10))
            for s, x in paths:
                if x > best[e]:
                    best[e], back[e] = x, s
        cuts = [n]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
    else:
        to, since = list(range(1, n + 1)), list(range(-1, n))  # ends of the parts by their starts, and starts by their ends
        heap: list[tuple[int, int, int, int]] = []

        def see(s: int, m: int, e: int) -> None:
            k = known.get((s, e))
            if k is not None:
                heapq.heappush(heap, (rank[k], s, m, e))

        for s in range(n - 1):
            see(s, s + 1, s + 2)
        while heap:
            _, s, m, e = heapq.heappop(heap)
            if to[s] != m or m >= n or to[m] != e:  # one of the two has merged meanwhile
                continue
            to[s], to[m], since[e] = e, 0, s
            if s:
                see(since[s], s, e)
            if e < n:
                see(s, e, to[e])
        cuts = [0]
        while cuts[-1] < n:
            cuts.append(to[cuts[-1]])
    out: list[int] = []
    for s, e in zip(cuts, cuts[1:]):
        k = known.get((s, e))
        if k is not None:
            out.append(ids[k])
        elif byte0 >= 0:
            out += [byte0 + b for b in unit[s:e].replace(" ", SPACE).encode("utf-8", "replace")]
        else:
            out.append(unknown)
    return out


def _fold(kind: int, least: float) -> str:
    """SQL that turns a word's lattice into an array of (start, end) cuts.

    _m maps start * 65536 + end to (id, score); n is the word's length."""
    edge = lambda a, b: f"_m[({a}) * 65536 + ({b})]"
    if kind == UNIGRAM:
        # the state: of each place reached so far, the best score and the place before it
        from_ = f"""transform(sequence(greatest(0, e - _k), e - 1), s -> named_struct('score',
            s0[s].score + coalesce({edge('s', 'e')}.score, CASE WHEN e - s = 1 THEN {least - 10}D ELSE -1e30D END), 'back', s))"""
        reach = f"aggregate(sequence(1, n), array(named_struct('score', 0D, 'back', 0)), (s0, e) -> concat(s0, array(aggregate({from_}, named_struct('score', -1e300D, 'back', -1), (x, y) -> CASE WHEN y.score > x.score THEN y ELSE x END))))"
        return f"transform(array({reach}), p -> reverse(filter(aggregate(sequence(1, n), array(n), (c, i) -> CASE WHEN element_at(c, -1) > 0 THEN concat(c, array(p[element_at(c, -1)].back)) ELSE c END), x -> true)))[0]"
    # a state that starts with -1 is done
    pairs = f"transform(sequence(0, size(b) - 3), i -> coalesce({edge('b[i]', 'b[i + 2]')}.score, -1e30D))"
    merge = "transform(array(array_max(c)), x -> CASE WHEN x > -1e30D THEN transform(array(array_position(c, x)), p -> concat(slice(b, 1, p), slice(b, p + 2, size(b))))[0] ELSE concat(array(-1), b) END)[0]"
    return f"filter(aggregate(sequence(1, greatest(n - 1, 1)), sequence(0, n), (b, _) -> CASE WHEN b[0] < 0 OR size(b) < 3 THEN b ELSE transform(array({pairs}), c -> {merge})[0] END), x -> x >= 0)"


def _one_pass(bits: Bits) -> str:
    """SQL that takes the edges of several characters (the first _m) in the order of their merges, once, and returns the cuts that stay; -1 if that can't tell.

    An edge whose ends are cuts with one cut between them is merged now. If an end is gone
    it never can be. If there are more cuts between, it may become possible later, out of
    order: such units (hardly any, as pieces are made of earlier ones) are replayed merge by merge."""
    far = f"shiftleft(1L, {bits.sql_span})"
    step = f"transform(array({_window('c', bits)}), w -> CASE WHEN w < {far} OR bit_count(w) < 3 THEN c WHEN bit_count(w) = 3 THEN c - shiftleft(w - 1 - {far}, {bits.sql_start}) ELSE -1L END)[0]"
    return f"CASE WHEN _m = 0 THEN shiftleft(2L, n) - 1 ELSE aggregate(slice(_e, 1, _m), shiftleft(2L, n) - 1, (c, v) -> CASE WHEN c < 0 OR shiftright(c, {bits.sql_start}) & 1 = 0 THEN c ELSE {step} END) END"


def _window(cuts: str, bits: Bits) -> str:
    """The cuts (bits of a number) from the start of edge v to its end."""
    return f"shiftright({cuts}, {bits.sql_start}) & (shiftleft(2L, {bits.sql_span}) - 1)"


def _spelt(pieces: "Pieces", word: str, cuts: str) -> str:
    """SQL that turns the cuts of a word into ids, by the map _m."""
    part = f"{cuts}[i]", f"{cuts}[i + 1]"
    if pieces.byte0 >= 0:
        other = f"transform(regexp_extract_all(hex(encode(replace(substring({word}, {part[0]} + 1, {part[1]} - {part[0]}), ' ', '{SPACE}'), 'UTF-8')), '(..)', 1), x -> cast(conv(x, 16, 10) AS int) + {pieces.byte0})"
    else:
        other = f"array({pieces.unknown})"
    edge = f"_m[{part[0]} * 65536 + {part[1]}]"
    return f"flatten(transform(sequence(0, size({cuts}) - 2), i -> CASE WHEN {edge} IS NOT NULL THEN array({edge}.id) ELSE {other} END))"


def lattice(distinct: DataFrame, pieces: Pieces, word: str = "word", fours: str | None = None) -> DataFrame:
    """distinct (already dealt out by `word`, a row per word) with ids: array<int>, or for words of more than SHORT characters edges: array<long>.

    fours: a column made by Grams.fours(), which spares substrings that are no pieces; it isn't returned."""
    spark = distinct.sparkSession
    others = [c for c in distinct.columns if c not in (word, fours)]
    bits = Bits(pieces)
    order = {x: r for r, x in enumerate(sorted({x for _, _, x in pieces.rows}, reverse=True))}
    rows = [(*row, order[row[2]]) for row in pieces.rows]
    table = F.broadcast(spark.createDataFrame(rows, "_piece string, _id int, score double, rank int").withColumn("_h", F.xxhash64("_piece")))  # as many rows as the model has
    n = F.length(word)
    # blocks of a word with what pieces may reach beyond, then starts, then lengths: a substring is cut from a block
    block = F.explode(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")))
    cut = distinct.select(word, *others, *([fours] if fours else []), block.alias("_b"))
    at = F.col("_b") * BLOCK
    cut = cut.select(word, *others, *([fours] if fours else []), at.alias("_o"), (n - at).alias("_n"), F.regexp_replace(F.col(word).substr(at + 1, F.lit(BLOCK + pieces.longest)), " ", SPACE).alias("_w"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(BLOCK), F.col("_n")) - 1)).alias("_i"))
    most = F.least(F.lit(pieces.longest), F.col("_n") - F.col("_i"))
    if fours:  # as many fours as stand in a row from here, and three characters
        row = F.expr(f"shiftright({fours}, least(_i, {SHORT}))")
        row = F.bit_count(F.bitwise_not(row).bitwiseAND(row + 1) - 1)
        most = F.when((F.col("_o") > 0) | (F.col("_i") + row > SHORT), most).otherwise(F.least(most, row + 3))
    cut = cut.select("*", F.explode(F.sequence(F.lit(1), most)).alias("k"))
    edges = cut.select(word, *others, (F.col("_o") + F.col("_i")).alias("s"), "k", F.col("_w").substr(F.col("_i") + 1, F.col("k")).alias("piece"))
    # the join's key is a number, which is found faster; the strings are compared where it is found
    edges = edges.join(table, F.xxhash64("piece") == F.col("_h"), "left").withColumn("_id", F.when(F.col("piece") == F.col("_piece"), F.col("_id")))
    first = (F.col("s") == 0) & (F.col("k") == 1)
    # a word whose substrings are no pieces keeps its first row, without an edge; that row alone carries the other columns
    edges = edges.where(F.col("_id").isNotNull() | first)
    held = [F.first(F.when(first, F.col(c)), True).alias(c) for c in others]
    number, short = F.expr(bits.sql), n <= SHORT
    if pieces.kind == UNIGRAM:
        edge = F.when(short & F.col("_id").isNotNull(), F.struct((F.col("s") * 65536 + F.col("s") + F.col("k")).alias("at"), F.struct(F.col("_id").alias("id"), "score").alias("v")))
        whole = edges.groupBy(word).agg(*held, F.collect_list(edge).alias("_l"), F.collect_list(F.when(~short, number)).alias("_e"))
        whole = whole.select(word, *others, n.alias("n"), "_e", F.map_from_entries("_l").alias("_m"), F.lit(pieces.longest).alias("_k"))
        told = whole.select(word, *others, "n", "_e", "_m", F.when(short, F.expr(_fold(pieces.kind, pieces.least))).alias("_b"))
        return told.select(word, *others, F.when(short, F.expr(_spelt(pieces, word, "_b"))).alias("ids"), F.when(~short, F.col("_e")).alias("edges"))
    several = F.sum(F.when((F.col("k") > 1) & F.col("_id").isNotNull(), 1).otherwise(0)).cast("int")
    whole = edges.groupBy(word).agg(*held, several.alias("_m"), F.sort_array(F.collect_list(number)).alias("_e")).select(word, *others, "_m", "_e", n.alias("n"))
    kept = whole.select(word, *others, "_m", "_e", "n", F.when(short, F.expr(_one_pass(bits))).alias("_p"))
    # the edges between neighbouring cuts; they spell the unit if there are as many as cuts leave room for
    one = f"filter(slice(_e, _m + 1, size(_e)), v -> shiftright(_p, {bits.sql_start}) & 3 = 3)"
    formed = f"CASE WHEN _m = 0 THEN {one} ELSE concat(filter(slice(_e, 1, _m), v -> {_window('_p', bits)} = shiftleft(1L, {bits.sql_span}) + 1), {one}) END"
    kept = kept.select(word, *others, "_e", "n", "_p", F.when(short, F.expr(f"sort_array(transform({formed}, v -> v & {(1 << bits.low + bits.start) - 1}L))")).alias("_f"))
    entries = f"transform(_e, v -> named_struct('at', {bits.sql_start} * 65536 + {bits.sql_start} + {bits.sql_span}, 'v', named_struct('id', {bits.sql_id}, 'score', -cast({bits.sql_rank} AS double))))"
    replayed = f"transform(array(map_from_entries({entries})), _m -> transform(array({_fold(BPE, 0.0)}), _b -> {_spelt(pieces, word, '_b')})[0])[0]"
    ids = f"CASE WHEN n > {SHORT} THEN NULL WHEN size(_f) = bit_count(_p) - 1 AND _p > 0 THEN transform(_f, v -> {bits.sql_id}) ELSE {replayed} END"
    return kept.select(word, *others, F.expr(ids).alias("ids"), F.when(~short, F.col("_e")).alias("edges"))


def encode(docs: DataFrame, path: str, text: str = "text", decoded: str | None = None) -> DataFrame:
    """docs with ids: array<int>, and what they spell in column `decoded`, if it's named.

    docs must come straight from files or be written first: its partitions are read twice, and must be the same both times; if they aren't, the job fails."""
    spark = docs.sparkSession
    pieces = Pieces(path)
    docs, moved = common.aside(docs, "ids", *([decoded] if decoded else []))
    text = {c: free for free, c in moved.items()}.get(text, text)
    if any("\n" in p for p, *_ in pieces.rows):
        raise ValueError("pieces that hold line ends aren't supported")
    grams, bits, kind, scores = Grams(pieces.rows), Bits(pieces), pieces.kind, pieces.distinct
    byte0, unknown = pieces.byte0, pieces.unknown
    spelt = pieces.text if decoded else None

    def found(batches):
        part, known, seen = TaskContext.get().partitionId(), set(), set()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                new = set().union(*map(keys, b.column(0).slice(lo, 512).to_pylist())) - known
                words = [" " + w for w in new]
                units = grams.cut(words)
                seen.update([w for k, w in enumerate(words) if k not in units])
                seen.update(*units.values())
                if len(known) > 500_000:
                    known.clear()
                known |= new
        del known
        seen = list(seen)
        for lo in range(0, len(seen), 1 << 16):
            w = seen[lo: lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(grams.fours(w)), pa.array(np.full(len(w), part, np.int32))], names=["word", "fours", "part"])
        common.trim()

    # a unit is in each partition once, so its list is no longer than the number of partitions
    # a lattice has some fifty times its unit's rows, so the units are dealt out more finely than their size asks for
    rows = docs.select(text).mapInArrow(found, "word string, fours long, part int").repartition(8 * common.shuffle_partitions(spark), "word")
    units = rows.groupBy("word", "fours").agg(F.collect_list("part").alias("parts"))
    known = lattice(units, pieces, fours="fours").select("word", "ids", "edges", F.explode("parts").alias("part"))
    folder = common.fresh_path(spark, "pieces")
    setting = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(setting)
    try:  # such small partitions are grouped in memory; by default a sort takes over at 128 units
        spark.conf.set(setting, "100000")
        known.repartition("part").write.partitionBy("part").parquet(folder)
    finally:
        spark.conf.set(setting, before)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", ids array<int>" + (f", `{decoded}` string" if decoded else "")

    def strung(batches):
        from pyarrow import fs
        import pyarrow.parquet as pq

        part, table, whole = TaskContext.get().partitionId(), None, {}  # whole: ids of words, so that they are cut once
        spelling = np.array([*spelt], object) if decoded else None

        def load() -> dict[str, bytes]:
            out: dict[str, bytes] = {}
            system, root = fs.FileSystem.from_uri(folder)
            if system.get_file_info(f"{root}/part={part}").type == fs.FileType.NotFound:
                return out
            for f in system.get_file_info(fs.FileSelector(f"{root}/part={part}")):
                if f.path.endswith(".parquet"):
                    with system.open_input_file(f.path) as source:
                        for rows in pq.ParquetFile(source).iter_batches(batch_size=1 << 16, columns=["word", "ids", "edges"]):
                            units, long = rows.column("word").to_pylist(), rows.column("edges")
                            flat, off = rows.column("ids").values.to_numpy().astype("<i4"), rows.column("ids").offsets.to_numpy()
                            raw, off = flat.tobytes(), (off * 4).tolist()
                            out.update(zip(units, [raw[x:y] for x, y in zip(off[:-1], off[1:])]))
                            for k in np.flatnonzero(long.is_valid().to_numpy(zero_copy_only=False)):
                                edges = long[int(k)].values.to_numpy()
                                out[units[k]] = np.array(folded(edges, units[k], kind, bits, scores, byte0, unknown), "<i4").tobytes()
            return out

        for b in batches:
            table = load() if table is None else table
            for lo in range(0, b.num_rows, 512):
                rows = b.slice(lo, 512)
                parts = [keys(t) for t in rows.column(text).to_pylist()]
                new = list(set().union(*parts).difference(whole))
                words = [" " + w for w in new]
                units = grams.cut(words)
                try:
                    for k, (w, spaced) in enumerate(zip(new, words)):
                        whole[w] = b"".join([table[u] for u in units[k]]) if k in units else table[spaced]
                except KeyError as e:
                    raise RuntimeError(f"unit {e} wasn't in partition {part} when the units were gathered: write the input first") from None
                out = [b"".join([whole[w] for w in mine]) for mine in parts]
                del parts, new, words, units
                if len(whole) > 300_000:
                    whole.clear()
                off = np.concatenate([[0], np.cumsum([len(x) // 4 for x in out])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(out), "<i4")))
                more = [_told(ids, spelling)] if decoded else []
                yield pa.RecordBatch.from_arrays([*rows.select(names).columns, ids, *more], names=[*names, "ids", *([decoded] if decoded else [])])
        del table, whole
        common.trim()

    return docs.mapInArrow(strung, schema)


def _told(ids: pa.ListArray, spelling: np.ndarray) -> pa.Array:
    """What ids spell; null where they are null."""
    off, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
    return pa.array([None if null else b"".join(spelling[flat[x:y]]).decode("utf-8", "replace").removeprefix(" ") for x, y, null in zip(off[:-1], off[1:], ids.is_null().to_pylist())], pa.string())


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text that ids spell, without the dummy prefix; invalid bytes become U+FFFD."""
    rows, _ = common.aside(rows, out)
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` string"
    spelt = Pieces(path).text
    shared = rows.sparkSession.sparkContext.broadcast(spelt)

    def run(batches):
        text = np.array([*shared.value], object)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([*part.columns, _told(part.column(ids), text)], names=[*names, out])

    return rows.mapInArrow(run, schema)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    told = encode(docs, model_path(), decoded="decoded")
    return told.select("doc_id", "ids", F.size("ids").alias("n_ids"), F.coalesce(F.col("decoded") == F.col("text"), F.lit(True)).alias("round_trip"))
