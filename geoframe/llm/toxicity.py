"""Toxicity by a bidirectional GRU with attention pooling, in numpy.

A word's input is the sum of its own hashed embedding, those of its first four and five
bytes, and the mean of its characters' trigram embeddings (with the word's edges). Windows
of WINDOW words, each starting STEP words after the one before, cover the whole text. In
each window two GRUs run over the words, one from either side; attention pools their states,
and a logistic unit scores the pool. Nothing reaches the score but through the states, and
all weights start at random. A text scores as its most toxic window does.

Labels are of whole texts, so training looks for the telling window: in the first round it
is the one whose features have the largest log-odds in the labelled texts, then the one
that the model scores highest. It learns that window with the text's label, and other
windows of clean texts as clean. Training takes at most `most` labelled texts of each class,
drawn by hash, of at most `longest` characters each; scoring has no such bounds.

Edge cases: null and empty texts are scored as a window without words. Without labels of
both classes every text scores 0. Several labels of one doc_id count as toxic if any is;
null labels aren't learned from. Repeated rows score alike. Input columns called score or
predicted are returned as `<name>_in`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoframe.llm import common

WINDOW, STEP = 24, 12
WORD_ROWS, EDGE_ROWS, GRAM_ROWS = 1 << 16, 1 << 15, 1 << 15
DIM, HIDDEN = 12, 12
MOST, LONGEST = 1500, 200_000

_BREAK = np.ones(256, bool)
_BREAK[128:] = False
for _c in "abcdefghijklmnopqrstuvwxyz0123456789'":
    _BREAK[ord(_c)] = False
_POWERS = np.cumprod(np.concatenate([[1], np.full(4095, 0x100000001B3)]).astype(np.uint64))


def _rows(h: np.ndarray, rows: int) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(40)).astype(np.int64) & (rows - 1)


class Words:
    """The words of some texts, end to end: feature rows of each, and where texts begin."""

    def __init__(self, texts: list[str]):
        raw = np.frombuffer(b"".join(b"   " + t.lower().encode("utf-8", "replace") + b"   " for t in texts), np.uint8)
        ends = np.cumsum([len(t.lower().encode("utf-8", "replace")) + 6 for t in texts])
        gap = _BREAK[raw]
        begin = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        size = end - begin
        self.first = np.searchsorted(begin, np.concatenate([[0], ends[:-1]]))
        self.count = np.diff(np.append(self.first, len(begin)))
        clean = np.where(gap, 32, raw).astype(np.uint64)
        self.n = len(begin)
        if not self.n:
            return
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        part = clean[~gap] * _POWERS[at & 4095] * np.uint64(0x2545F4914F6CDD1D)
        word = np.add.reduceat(part ^ (part >> np.uint64(29)), np.cumsum(size) - size)
        five = np.zeros(self.n, np.uint64)
        edges = []
        for k in range(5):
            five = five * np.uint64(257) + np.where(k < size, clean[np.minimum(begin + k, len(clean) - 1)], 0) + np.uint64(1)
            if k >= 3:
                edges.append(_rows(five + np.uint64(k), EDGE_ROWS))
        self.word, self.four, self.five = _rows(word, WORD_ROWS), *edges
        gram = (clean[:-2] << np.uint64(16)) | (clean[1:-1] << np.uint64(8)) | clean[2:]
        inside = np.flatnonzero(~gap)
        self.gram = _rows(gram[inside - 1], GRAM_ROWS)
        self.begin, self.size = np.cumsum(size) - size, size

    @staticmethod
    def joined(texts: list[str], most: int = 1 << 20) -> "Words":
        """The words of many texts, made from about `most` characters at a time and kept as small integers."""
        parts, lo = [], 0
        while lo < len(texts) or not parts:
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) < most):
                size += len(texts[hi])
                hi += 1
            w = Words(texts[lo:hi])
            if w.n:
                for name in ("word", "four", "five", "gram", "begin", "size"):
                    setattr(w, name, getattr(w, name).astype(np.int32))
            parts.append(w)
            lo = hi
        out = Words([])
        full = [w for w in parts if w.n]
        out.n, out.count = sum(w.n for w in parts), np.concatenate([w.count for w in parts])
        out.first = np.concatenate([[0], np.cumsum(out.count)[:-1]]).astype(np.int64)
        for name in ("word", "four", "five", "gram", "size") if full else ():
            setattr(out, name, np.concatenate([getattr(w, name) for w in full]))
        if full:
            out.begin = np.cumsum(out.size, dtype=np.int64) - out.size
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each window: the words (row n: none), and its text. Every text has one at least."""
        many = np.maximum(1, -(-(self.count - WINDOW) // STEP) + 1)
        text = np.repeat(np.arange(len(self.count)), many)
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = (k * STEP)[:, None] + np.arange(WINDOW)
        return np.where(at < self.count[text][:, None], self.first[text][:, None] + at, self.n), text


def gathered(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different indexes, and the sum of the rows of each."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    begin = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    return index[begin], np.add.reduceat(rows[order], begin, axis=0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


class Model:
    def __init__(self, seed: int = 6, weights: dict | None = None):
        r = np.random.RandomState(seed)
        make = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
        self.p = weights or {"word": make(WORD_ROWS, DIM) * 0.2, "four": make(EDGE_ROWS, DIM) * 0.2, "five": make(EDGE_ROWS, DIM) * 0.2, "gram": make(GRAM_ROWS, DIM) * 0.2,
                             "att": make(2 * HIDDEN), "out": make(2 * HIDDEN), "bias": np.full(1, -1.0, np.float32),
                             # of the GRU from the left, and of that from the right: inputs, states, constants
                             "x": make(2, DIM, 3 * HIDDEN), "h": make(2, HIDDEN, 3 * HIDDEN), "c": np.zeros((2, 1, 3 * HIDDEN), np.float32)}

    def inputs(self, w: Words, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """A row per word from lo to hi, and one for no word."""
        p, hi = self.p, w.n if hi is None else hi
        out = np.zeros((hi - lo + 1, DIM), np.float32)
        if hi > lo:
            begin, size = w.begin[lo:hi], w.size[lo:hi]
            grams = np.add.reduceat(p["gram"][w.gram[begin[0]: begin[-1] + size[-1]]], begin - begin[0], axis=0)
            out[:-1] = p["word"][w.word[lo:hi]] + p["four"][w.four[lo:hi]] + p["five"][w.five[lo:hi]] + grams / size[:, None].astype(np.float32)
        return out

    def logits(self, w: Words, at: np.ndarray, most: int = 4096) -> np.ndarray:
        """Logits of windows in text order: each run of them needs the inputs of one run of words only."""
        out = np.empty(len(at), np.float32)
        for k in range(0, len(at), most):
            part = at[k: k + most]
            real = part[part < w.n]
            lo, hi = (int(real.min()), int(real.max()) + 1) if len(real) else (0, 0)
            out[k: k + most] = self.forward(self.inputs(w, lo, hi), np.where(part < w.n, part - lo, hi - lo), hi - lo)
        return out

    def forward(self, x: np.ndarray, at: np.ndarray, none: int, keep: bool = False):
        """Logits of windows `at` over word inputs x; keep: also what backward() needs. The two GRUs step together, one from either end."""
        p, n = self.p, len(at)
        xs = x @ p["x"] + p["c"]
        both = np.stack([at, at[:, ::-1]])
        here = both != none
        h, states, tape = np.zeros((2, n, HIDDEN), xs.dtype), np.empty((2, WINDOW, n, HIDDEN), xs.dtype), []
        for t in range(WINDOW):
            g = np.stack([xs[0][both[0, :, t]], xs[1][both[1, :, t]]])
            u = h @ p["h"]
            gates = sigmoid(g[:, :, :2 * HIDDEN] + u[:, :, :2 * HIDDEN])
            z, r = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:]
            c = np.tanh(g[:, :, 2 * HIDDEN:] + r * u[:, :, 2 * HIDDEN:])
            if keep:
                tape.append((h, z, r, c, u[:, :, 2 * HIDDEN:]))
            h = np.where(here[:, :, t, None], c + z * (h - c), h)
            states[:, t] = h
        states = np.concatenate([states[0], states[1, ::-1]], 2)  # place, window, state
        a = np.where(here[0].T, states @ p["att"], np.float32(-30))
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pool = (a[:, :, None] * states).sum(0)
        logit = pool @ p["out"] + p["bias"]
        return (logit, (states, tape, both, here, a, pool)) if keep else logit

    def backward(self, x, at, kept, d_logit) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters but the embeddings, and of the word inputs."""
        p, (states, tape, both, here, a, pool) = self.p, kept
        g = {"out": pool.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pool = d_logit[:, None] * p["out"]
        d_a = (d_pool * states).sum(2)
        d_s = a * (d_a - (a * d_a).sum(0)) * here[0].T
        g["att"] = np.einsum("tn,tnh->h", d_s, states)
        d_states = a[:, :, None] * d_pool + d_s[:, :, None] * p["att"]
        d_states = np.stack([d_states[:, :, :HIDDEN], d_states[::-1, :, HIDDEN:]])
        g["h"], d_g = np.zeros_like(p["h"]), np.zeros((2, len(at), WINDOW, 3 * HIDDEN), states.dtype)
        d_h = np.zeros((2, len(at), HIDDEN), states.dtype)
        for t in reversed(range(WINDOW)):
            h, z, r, c, u = tape[t]
            d_h = d_h + d_states[:, t]
            on = here[:, :, t, None]
            d_new = d_h * on
            d_z = d_new * (h - c) * z * (1 - z)
            d_c = d_new * (1 - z) * (1 - c * c)
            d_r = d_c * u * r * (1 - r)
            d_u = np.concatenate([d_z, d_r, d_c * r], 2)
            d_g[:, :, t] = np.concatenate([d_z, d_r, d_c], 2)
            g["h"] += h.transpose(0, 2, 1) @ d_u
            d_h = d_h * ~on + d_new * z + d_u @ p["h"].transpose(0, 2, 1)
        g["c"] = d_g.sum((1, 2))[:, None]
        d_xs = np.zeros((2, len(x), 3 * HIDDEN), d_g.dtype)
        for d in (0, 1):
            used, total = gathered(both[d].ravel(), d_g[d].reshape(-1, 3 * HIDDEN))
            d_xs[d, used] = total
        g["x"] = x.T @ d_xs
        return g, (d_xs @ p["x"].transpose(0, 2, 1)).sum(0)

    def best(self, texts: list[str]) -> tuple[np.ndarray, Words, np.ndarray, np.ndarray]:
        """Of each text: its highest logit; the words, and the row and words of each window."""
        w = Words(texts)
        at, text = w.windows()
        logit = self.logits(w, at)
        top = np.full(len(texts), -np.inf, np.float32)
        np.maximum.at(top, text, logit)
        return top, w, at, (logit, text)

    def train(self, texts: list[str], toxic: np.ndarray, rounds: int = 8, batch: int = 256, drop: float = 0.25, speed: float = 0.2) -> None:
        r = np.random.RandomState(1)
        w = Words.joined(texts)
        at, text = w.windows()
        at = at.astype(np.int32)
        label = toxic[text].astype(np.float32)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), w.count)
        rows = {"word": (w.word, WORD_ROWS, owner), "four": (w.four, EDGE_ROWS, owner), "five": (w.five, EDGE_ROWS, owner), "gram": (w.gram, GRAM_ROWS, np.repeat(owner, w.size))}
        score, common_rows = np.zeros(w.n + 1), {}
        for name, (row, size, own) in rows.items():  # log-odds of each feature, by texts that hold it
            kind = np.int32 if size * len(texts) < 1 << 31 else np.int64
            held = row.astype(kind) * kind(len(texts))
            held += own.astype(kind)
            held.sort()
            held = held[np.concatenate([[True], held[1:] != held[:-1]])]
            yes = np.bincount(held // len(texts), weights=toxic[held % len(texts)], minlength=size)
            no = np.bincount(held // len(texts), minlength=size) - yes
            odds = np.log((yes + 2) / (toxic.sum() + 4)) - np.log((no + 2) / ((1 - toxic).sum() + 4))
            odds = np.clip(odds, -1, 4) * (yes + no >= 3)
            common_rows[name] = (yes + no >= 3).astype(np.float32)  # rarer features would only be learned by heart
            if name != "gram":
                score[:-1] += np.maximum(odds[row], 0)
        logit = np.concatenate([score[at[k: k + 4096]].max(1) for k in range(0, len(at), 4096)])
        moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items() if k not in rows}
        spent = {k: np.full(len(self.p[k]), 1e-6, np.float32) for k in rows}  # of each row of the embeddings: the squares of its gradients so far
        step, each = 0, max(30, 3 * len(texts) // batch)
        for turn in range(rounds):
            if turn:
                logit = self.logits(w, at)
            order = np.lexsort((-logit, text))
            top = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])]
            other = np.flatnonzero(label == 0)
            chosen = np.concatenate([top, r.choice(other, min(len(other), len(top)), replace=False)])
            for _ in range(each):
                pick = chosen[r.permutation(len(chosen))[:batch]]
                used, near = np.unique(at[pick], return_inverse=True)
                sub = used[used < w.n]
                none = len(sub)
                small = near.reshape(at[pick].shape)
                x = np.zeros((none + 1, DIM), np.float32)
                grams = np.concatenate([np.arange(w.begin[k], w.begin[k] + w.size[k]) for k in sub])
                gram_of = np.repeat(np.arange(none), w.size[sub])
                share = (1 / w.size[sub]).astype(np.float32)[:, None]
                # some parts of a word's input are left out at random, so that none is relied on alone
                kept_of = {name: (r.random_sample((none, 1)) > drop).astype(np.float32) / np.float32(1 - drop) for name in rows}
                parts = {name: self.p[name][rows[name][0][sub]] for name in ("word", "four", "five")}
                parts["gram"] = np.add.reduceat(self.p["gram"][w.gram[grams]], np.cumsum(w.size[sub]) - w.size[sub], axis=0) * share
                x[:-1] = sum(parts[name] * kept_of[name] for name in rows)
                logit_b, kept = self.forward(x, small, none, keep=True)
                y = label[pick]
                d = (1 / (1 + np.exp(-logit_b)) - y) / len(pick)
                g, d_x = self.backward(x, small, kept, d.astype(np.float32))
                step += 1
                left = 1 - (step - 1) / (rounds * each)
                rate = 0.01 * left
                for name in g:
                    m, v = moment[name]
                    m += 0.1 * (g[name] - m)
                    v += 0.001 * (g[name] ** 2 - v)
                    self.p[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
                for name in rows:
                    row, grad = (w.gram[grams], (d_x[:-1] * kept_of[name] * share)[gram_of]) if name == "gram" else (rows[name][0][sub], d_x[:-1] * kept_of[name])
                    row, total = gathered(row, grad)
                    total *= common_rows[name][row][:, None]
                    spent[name][row] += (total * total).sum(1)
                    self.p[name][row] -= speed * left * total / np.sqrt(spent[name][row])[:, None]

    def calibrate(self, texts: list[str], toxic: np.ndarray, weight: float = 4.0) -> None:
        """Move the bias so that 0.5 divides unseen texts best; a clean text that is marked counts `weight` times in its class."""
        logit = np.concatenate([self.best(texts[k: k + 100])[0] for k in range(0, len(texts), 100)])
        order = np.argsort(logit)
        at, bad = logit[order], toxic[order] == 1
        # by cut: the toxic texts below it, and the clean ones above
        missed = np.concatenate([[0], np.cumsum(bad)]) / max(1, bad.sum())
        marked = (np.concatenate([[0], np.cumsum((~bad)[::-1])])[::-1]) / max(1, (~bad).sum())
        cost = missed + weight * marked
        best = np.flatnonzero(cost <= cost.min() + 1e-12)
        edge = np.concatenate([[at[0] - 1], at, [at[-1] + 1]])
        gap = best[np.argmax(edge[best + 1] - edge[best])]
        self.p["bias"] = self.p["bias"] - np.float32((edge[gap] + edge[gap + 1]) / 2)

    def score(self, texts: list[str]) -> np.ndarray:
        top = self.best(texts)[0].astype(np.float64)
        return 1 / (1 + np.exp(-top))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, longest: int = LONGEST) -> Model | None:
    """Learn from at most `most` labelled texts of each class, those with the least hashes of their ids, and up to `longest` characters."""
    told = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    told = told.withColumn("h", F.xxhash64("doc_id"))
    count = {r["toxic"]: r["n"] for r in told.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not count.get(0) or not count.get(1):
        return None
    limit = F.lit(0).cast("long")
    for k in (0, 1):
        limit = F.when(F.col("toxic") == k, F.lit(int(-2**63 + min(1.0, most / count[k]) * (2**64 - 2**11)))).otherwise(limit)
    ids = told.where(F.col("h") <= limit).select("doc_id", "toxic", "h")  # about 2 * most rows
    # repeated rows have one hash of id and text, so what is left is bounded by the labels
    got = docs.where(F.length("text").between(1, longest)).join(F.broadcast(ids), "doc_id").groupBy("h", F.xxhash64("text").alias("t")).agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    got = got.toPandas().sort_values(["h", "t"])
    if got["toxic"].nunique() < 2:
        return None
    # every fifth text is kept back, to set the threshold on texts that weren't learned
    texts, toxic, back = list(got["text"]), got["toxic"].to_numpy(np.float64), np.arange(len(got)) % 5 == 4
    model = Model()
    if len(set(toxic[back])) < 2 or len(set(toxic[~back])) < 2:
        model.train(texts, toxic)
        return model
    model.train([t for t, b in zip(texts, back) if not b], toxic[~back])
    model.calibrate([t for t, b in zip(texts, back) if b], toxic[back])
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with score and predicted."""
    docs, moved = common.aside(docs, "score", "predicted")
    text = {c: free for free, c in moved.items()}.get(text, text)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double, predicted int"
    shared = docs.sparkSession.sparkContext.broadcast(model and model.p)  # plain arrays: a worker needs no installed package to read them

    def run(batches):
        m = Model(weights=shared.value) if shared.value else None
        for b in batches:
            out, lo = np.zeros(b.num_rows), 0
            texts = [t or "" for t in b.column(text).to_pylist()]
            while m is not None and lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) < 400_000):
                    size += len(texts[hi])
                    hi += 1
                out[lo:hi] = m.score(texts[lo:hi])
                lo = hi
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def op6_toxicity(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").where(common.fold_of(F.col("doc_id"), 5) != 0)
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", (common.fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
