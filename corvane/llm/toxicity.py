"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.scratch import release, slices

WORD = re.compile(r"[^\W_]+")
WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, CHARS = 12, 8, 8, 4096
#: Defaults of trained(): the classifier is fitted on so many labelled documents at most, none longer than so many code points; scoring has no such bounds.
FIT_DOCS, FIT_CHARS, VOCABULARY = 4000, 20_000, 20_000
#: Least score that counts as toxic; words whose inputs a worker remembers (about 500 bytes each), and trigrams; windows that are scored together.
THRESHOLD, CACHED, GRAMS, BLOCK = 0.3, 240_000, 100_000, 1024


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def windows(n: int) -> np.ndarray:
    """Starts of the overlapping windows over n words; the last one reaches the end."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@lru_cache(GRAMS)
def bucket(trigram: str) -> int:
    return zlib.crc32(trigram.encode()) % CHARS


class Network:
    """Windows of words to the probability of the label.

    A word's input is its own vector (zero if it isn't in the vocabulary) beside the mean
    vector of its character trigrams. Two GRUs read a window both ways, attention pools
    their states, and one unit gives the score. A document scores as its highest window,
    an empty one 0.
    """

    def __init__(self, vocabulary: list[str], seed: int = 7):
        r, d = np.random.default_rng(seed), WORD_DIM + CHAR_DIM
        self.number = {w: k + 1 for k, w in enumerate(vocabulary)}
        small = lambda *shape: (r.standard_normal(shape) * 0.3 / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": small(len(vocabulary) + 1, WORD_DIM), "C": small(CHARS, CHAR_DIM), "v": small(2 * HIDDEN), "w": small(2 * HIDDEN), "b": np.full(1, -2, np.float32)}
        self.p["E"][0] = 0
        for side in "fb":
            self.p |= {"W" + side: small(d, 3 * HIDDEN) * 3, "U" + side: small(HIDDEN, 3 * HIDDEN) * 3, "B" + side: np.zeros(3 * HIDDEN, np.float32)}

    @staticmethod
    def trigrams(word: str) -> list[int]:
        x = f"<{word}>"
        return [bucket(x[i : i + 3]) for i in range(len(x) - 2)]

    def inputs(self, words: list[str]) -> np.ndarray:
        """A row for each word."""
        grams = [self.trigrams(w) for w in words]
        sizes = np.array([len(g) for g in grams])
        flat = np.fromiter(chain.from_iterable(grams), np.int64, sizes.sum())
        chars = np.add.reduceat(self.p["C"][flat], np.concatenate(([0], np.cumsum(sizes)[:-1])), 0) / sizes[:, None]
        return np.hstack([self.p["E"][[self.number.get(w, 0) for w in words]], chars]).astype(np.float32)

    def states(self, side: str, a: list[np.ndarray], out: list[np.ndarray], keep: list | None = None) -> None:
        """States of one GRU over its projected inputs, in the order given, put into out."""
        u, n, h = self.p["U" + side], HIDDEN, np.zeros((len(a[0]), HIDDEN), a[0].dtype)
        for x, place in zip(a, out, strict=True):
            g = h @ u
            zr = x[:, : 2 * n] + g[:, : 2 * n]  # sigmoid, in place
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :n], zr[:, n:]
            c = r * g[:, 2 * n :]
            c += x[:, 2 * n :]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((h, z, r, c, g[:, 2 * n :]))
            h = h - c
            h *= z
            h += c
            place[:] = h

    def pooled(self, states: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = np.where(there, states @ self.p["v"], -1e9)
        e = np.exp(e - e.max(1, keepdims=True))
        alpha = e / e.sum(1, keepdims=True)
        return alpha, (alpha[:, :, None] * states).sum(1)

    def both(self, a: dict[str, list[np.ndarray]], keep: dict | None = None) -> np.ndarray:
        steps = len(a["f"])
        out = np.empty((len(a["f"][0]), steps, 2 * HIDDEN), a["f"][0].dtype)
        for side, order, part in (("f", range(steps), slice(HIDDEN)), ("b", range(steps - 1, -1, -1), slice(HIDDEN, None))):
            self.states(side, [a[side][k] for k in order], [out[:, k, part] for k in order], None if keep is None else keep[side])
        return out

    def gradients(self, x: np.ndarray, there: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean cross entropy, and the inputs'."""
        p, n, keep, t = self.p, HIDDEN, {"f": [], "b": []}, x.shape[1]
        a = {s: [x[:, k] @ p["W" + s] + p["B" + s] for k in range(t)] for s in "fb"}
        h = self.both(a, keep)
        alpha, c = self.pooled(h, there)
        d = (sigmoid(c @ p["w"] + p["b"]) - y) / len(y)
        g = {"w": c.T @ d, "b": d.sum(keepdims=True)}
        dc = d[:, None] * p["w"]
        dalpha = (h * dc[:, None]).sum(2)
        de = alpha * (dalpha - (alpha * dalpha).sum(1, keepdims=True))
        g["v"] = (de[:, :, None] * h).sum((0, 1))
        dh = alpha[:, :, None] * dc[:, None] + de[:, :, None] * p["v"]
        dx = np.zeros_like(x)
        for side, part in (("f", dh[:, :, :n]), ("b", dh[:, ::-1, n:])):
            w, u, back = p["W" + side], p["U" + side], np.zeros((len(x), n), np.float32)
            gw, gu, gb = np.zeros_like(w), np.zeros_like(u), np.zeros(3 * n, np.float32)
            for k in range(t - 1, -1, -1):
                at = k if side == "f" else t - 1 - k
                before, z, r, cand, gn = keep[side][k]
                back = back + part[:, k]
                dn = back * (1 - z) * (1 - cand * cand)
                da = np.hstack([back * (before - cand) * z * (1 - z), dn * gn * r * (1 - r), dn])
                dg = np.hstack([da[:, : 2 * n], dn * r])
                gw += x[:, at].T @ da
                gu += before.T @ dg
                gb += da.sum(0)
                dx[:, at] += da @ w.T
                back = back * z + dg @ u.T
            g |= {"W" + side: gw, "U" + side: gu, "B" + side: gb}
        return g, dx

    def forget(self) -> None:
        """Free what scores() remembers."""
        for name in ("rows", "tables"):
            self.__dict__.pop(name, None)

    def scores(self, documents: list[list[str]]) -> list[np.ndarray]:
        """The scores of all windows of each document; a document without words has none."""
        if not hasattr(self, "rows") or len(self.rows) > CACHED:
            self.forget()
            self.rows: dict[str, int] = {}
            self.tables = {s: np.zeros((1024, 3 * HIDDEN), np.float32) + self.p["B" + s] for s in "fb"}
        new = [w for w in set().union(*documents) if w not in self.rows]
        if new:
            x, at = self.inputs(new), len(self.rows) + 1
            while at + len(new) > len(self.tables["f"]):  # twice the room, so that rows are seldom copied
                self.tables = {s: np.concatenate([t, np.empty_like(t)]) for s, t in self.tables.items()}
            self.rows.update(zip(new, range(at, at + len(new)), strict=True))
            for side, t in self.tables.items():
                t[at : at + len(new)] = x @ self.p["W" + side] + self.p["B" + side]
        cuts, out = [], []
        for d in documents:
            ids = np.fromiter(map(self.rows.__getitem__, d), np.int64, len(d))
            cuts.append(np.concatenate([ids, np.zeros(WINDOW, np.int64)])[windows(len(d))[:, None] + np.arange(WINDOW)] if d else np.zeros((0, WINDOW), np.int64))
        flat = np.concatenate(cuts) if cuts else np.zeros((0, WINDOW), np.int64)
        found = [np.zeros(0, np.float32)]
        for at in range(0, len(flat), BLOCK):
            ids = flat[at : at + BLOCK]
            places = np.ascontiguousarray(ids.T)
            h = self.both({s: [self.tables[s].take(k, 0) for k in places] for s in "fb"})
            found.append(sigmoid(self.pooled(h, ids > 0)[1] @ self.p["w"] + self.p["b"]))
        every, at = np.concatenate(found), 0
        for c in cuts:
            out.append(every[at : at + len(c)])
            at += len(c)
        return out


def distinct(documents: list[list[str]]) -> list[int]:
    """Places of the documents that aren't near copies of an earlier one: none of three minima over five-word shingles is known."""
    seen: set[tuple[int, int]] = set()
    out = []
    for k, d in enumerate(documents):
        h = np.array([zlib.crc32(" ".join(d[i : i + 5]).encode()) for i in range(max(1, len(d) - 4))], np.uint64)
        least = {(j, int(((h * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min())) for j, m in enumerate((2654435761, 2246822519, 3266489917))}
        if not least & seen:
            out.append(k)
        seen |= least
    return out


def fit(texts: list[str], labels: list[int], epochs: int = 8, seed: int = 7) -> Network:
    """Train on documents whose label holds for one window at least: each epoch takes a document's highest window, and one more of those without the label."""
    documents = [words_of(t) for t in texts]
    keep = [k for k in distinct(documents) if documents[k]]
    documents, y = [documents[k] for k in keep], np.array([labels[k] for k in keep], np.float32)
    held = [Counter(), Counter()]
    for d, label in zip(documents, y, strict=True):
        held[int(label)].update(set(d))
    both = held[0] + held[1]
    vocabulary = [w for w, n in sorted(both.items(), key=lambda x: (-x[1], x[0])) if n >= 3][:VOCABULARY]
    net, r = Network(vocabulary, seed), np.random.default_rng(seed)
    if not documents or len(set(y.tolist())) < 2:
        net.p["b"][:] = 4 * (y.mean() if len(y) else 0) - 5
        net.p["w"][:] = 0
        return net
    ones = max(1, y.sum())
    odds = {w: np.log((held[1][w] + 0.5) / (ones + 1)) - np.log((held[0][w] + 2) / (len(y) - ones + 4)) for w in vocabulary}
    net.p["E"][1:, 0] = np.clip([odds[w] for w in vocabulary], -2, 6)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    chosen = [[int(np.argmax([sum(max(0.0, odds.get(w, 0)) for w in d[a : a + WINDOW]) for a in windows(len(d))]))] for d in documents]
    steps = 0
    for epoch in range(epochs):
        if epoch >= 2:
            chosen = [[int(s.argmax())] for at in range(0, len(documents), 200) for s in net.scores(documents[at : at + 200])]
        spans = [(d, w) for d in range(len(documents)) for w in (chosen[d] if y[d] else {*chosen[d], int(r.integers(len(windows(len(documents[d])))))})]
        for batch in np.array_split(r.permutation(len(spans)), max(1, len(spans) // 64)):
            cut = [documents[spans[k][0]][spans[k][1] * STRIDE :][:WINDOW] for k in batch]
            words = list(dict.fromkeys(w for c in cut for w in c))
            place = {w: k + 1 for k, w in enumerate(words)}
            ids = np.zeros((len(cut), WINDOW), np.int64)
            for k, c in enumerate(cut):
                ids[k, : len(c)] = [place[w] for w in c]
            rows = np.vstack([np.zeros((1, WORD_DIM + CHAR_DIM), np.float32), net.inputs(words)])
            g, dx = net.gradients(rows[ids], ids > 0, y[[spans[k][0] for k in batch]])
            each = np.zeros_like(rows)
            np.add.at(each, ids, dx)
            numbers = np.array([net.number.get(w, 0) for w in words])
            g["E"] = np.zeros_like(net.p["E"])
            g["E"][numbers] = each[1:, :WORD_DIM]
            g["E"][0] = 0
            grams = [net.trigrams(w) for w in words]
            g["C"] = np.zeros_like(net.p["C"])
            sizes = np.array([len(x) for x in grams])
            np.add.at(g["C"], np.concatenate(grams), np.repeat(each[1:, WORD_DIM:] / sizes[:, None], sizes, 0))
            steps += 1
            for name, value in g.items():  # Adam
                m, v = moment[name]
                m += 0.1 * (value - m)
                v += 0.001 * (value * value - v)
                net.p[name] -= (0.005 * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
    net.forget()
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, most: int, longest: int) -> DataFrame:
    """(doc_id, y), the most labelled documents with the least hash of doc_id; only ids are shuffled.

    A first cut of the hashes, by the count of all, leaves little more than that many to
    sort, however many there are.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("y")).filter(~held_out(F.col("doc_id")))
    there = docs.filter((F.length("text") <= longest) & ~held_out(F.col("doc_id"))).select("doc_id")
    own = known.join(there, "doc_id", "left_semi").withColumn("hash", F.xxhash64("doc_id"))
    share = min(1.0, (1.2 * most + 200) / max(1, own.count()))
    near = own.filter(F.pmod("hash", F.lit(1 << 30)) < int(share * (1 << 30)))
    return near.orderBy(F.pmod("hash", F.lit(1 << 30)), "doc_id").limit(most).select("doc_id", "y")


def trained(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS, longest: int = FIT_CHARS) -> Network:
    """Fit on a bounded sample: the most labelled documents with the least hash of doc_id, held-out ones and those over longest code points never among them.

    The ids are chosen first, and only their texts are gathered. Null labels and ids don't
    count; of several labels of a document the highest does, of several texts the least.
    """
    ids = sampled(docs, labels, most, longest)
    texts = docs.filter(F.length("text") <= longest).select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # most rows at most
    rows = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([r.text for r in rows], [int(r.y) for r in rows])


def scored(model: Network, texts: list[str | None]) -> list[float]:
    """The highest score of all windows of each text; 0 for a null text or one without words."""
    return [float(s.max()) if len(s) else 0.0 for s in model.scores([words_of(t) for t in texts])]


def toxicity(docs: DataFrame, model: Network, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (columns doc_id, text; others are ignored).

    The score is the highest of all overlapping windows; a null text or one without words
    scores 0. A null doc_id isn't held out.
    """
    net = docs.sparkSession.sparkContext.broadcast(model)  # bounded by VOCABULARY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for x in slices(batches, 64):
                yield pa.record_batch([x.column("doc_id"), pa.array(scored(net.value, x.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])
        finally:
            net.value.forget()
            release()

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Network, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text scores threshold or more, in one pass; all columns stay as they are."""
    net = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for x in slices(batches, 64):
                yield x.filter(pa.array([s < threshold for s in scored(net.value, x.column("text").to_pylist())]))
        finally:
            net.value.forget()
            release()

    return docs.mapInArrow(run, docs.schema)
