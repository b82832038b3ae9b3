"""Benchmark decontamination by latent semantic retrieval, confirmed by common subsequences and answers."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.scratch import slices, stored

WORD = re.compile(r"\w+")
#: Benchmark items that one model and one search take at once; more items make more blocks.
BLOCK = 1000
PASSAGE, RANK, EXTRA = 32, 64, 8
#: Words that a window takes or leaves together; words that are scanned at once; documents whose passages are made at once.
GROUP, PIECE, DOCS = 4, 1 << 14, 500
#: Items of so many words at most are looked for in every window that can hold them, whatever its cosine.
SHORT = 8
#: Least cosine of a candidate; least share of an item's words in common order; the same where the answer is there too.
COSINE, COPY, PARAPHRASE, ANSWER = 0.5, 0.8, 0.65, 0.9


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def answer_of(text: str) -> list[str]:
    """The words of an item's last sentence; of an item with one sentence, its last third."""
    parts = [w for s in re.split(r"[.!?]+", text) if (w := words_of(s))]
    if len(parts) > 1:
        return parts[-1]
    return parts[0][-max(1, len(parts[0]) // 3) :] if parts else []


def masks_of(item: np.ndarray) -> dict[int, int]:
    """The places of each word of an item, as bits."""
    masks: dict[int, int] = {}
    for k, x in enumerate(item.tolist()):
        masks[x] = masks.get(x, 0) | 1 << k
    return masks


def matched(masks: dict[int, int], size: int, text: list[int]) -> int:
    """Length of the longest common subsequence with an item of so many words, by bits: a set bit of v is an item's word not yet matched."""
    full = v = (1 << size) - 1
    for m in map(masks.get, text):
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def common(item: np.ndarray, text: np.ndarray) -> int:
    return matched(masks_of(item), len(item), text.tolist())


def passages(texts: list[np.ndarray], unknown: int) -> np.ndarray:
    """A row for each passage, PASSAGE words in a row of one text; unknown words and the rest of a last row are numbered unknown."""
    sizes = np.array([len(ids) for ids in texts], np.int64)
    rows = -(-sizes // PASSAGE)
    out = np.full((int(rows.sum()), PASSAGE), unknown, np.int32)
    if texts:
        shift = PASSAGE * (np.cumsum(rows) - rows) - (np.cumsum(sizes) - sizes)
        words = np.concatenate(texts)
        out.reshape(-1)[np.arange(len(words)) + np.repeat(shift, sizes)] = np.where(words >= 0, words, unknown)
    return out


def holding(rows: np.ndarray, size: int) -> np.ndarray:
    """How many of the passages hold each feature."""
    own = np.sort(rows, 1)
    new = np.ones(own.shape, bool)
    new[:, 1:] = own[:, 1:] != own[:, :-1]
    return np.bincount(own[new], minlength=size + 1)[:size]


def gram(rows: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A' A basis, where A has a row of TF-IDF for each passage."""
    size, width = basis.shape
    weighted = np.vstack([idf[:, None] * basis, np.zeros((1, width))]).astype(np.float32)
    out = np.zeros((size, width))
    for at in range(0, len(rows), 1024):
        part = rows[at : at + 1024]
        y = sum(weighted[part[:, k]] for k in range(PASSAGE))
        words = part.reshape(-1)
        order = np.argsort(words)
        order = order[: np.searchsorted(words, size, sorter=order)]
        if len(order):
            f, first = np.unique(words[order], return_index=True)
            out[f] += np.add.reduceat(y[order // PASSAGE], first, 0) * idf[f, None]
    return out


def packed(batch: pd.DataFrame) -> Iterator[list[np.ndarray]]:
    """The ids of the texts of a batch, DOCS texts at a time."""
    for at in range(0, len(batch), DOCS):
        yield [np.frombuffer(x, "<i4") for x in batch.ids.iloc[at : at + DOCS]]


def document_frequency(tokens: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Passages that hold each feature, and all passages; size + 1 numbers are gathered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, total = np.zeros(size, np.int64), 0
        for texts in (t for x in batches for t in packed(x)):
            rows = passages(texts, size)
            df += holding(rows, size)
            total += len(rows)
        yield pd.DataFrame({"f": [*np.flatnonzero(df), -1], "n": [*df[df > 0], total]})

    out, total = np.zeros(size), 0
    for f, n in tokens.select("ids").mapInPandas(run, "f int, n long").groupBy("f").agg(F.sum("n")).collect():
        if f < 0:
            total = n
        else:
            out[f] = n
    return out, total


def gram_times(tokens: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A' A basis over all documents: each partition gives its sum, summed by feature."""
    size, width = basis.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((size, width))
        for texts in (t for x in batches for t in packed(x)):
            out += gram(passages(texts, size), idf, basis)
        used = np.flatnonzero(out.any(1))
        yield pd.DataFrame({"f": used.astype(np.int32), "v": pd.Series(list(out[used].astype(np.float32)), dtype=object)}, columns=["f", "v"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        f, at = np.unique(pdf.f.to_numpy(), return_inverse=True)
        total = np.zeros((len(f), width))
        np.add.at(total, at, np.stack(pdf.v.to_numpy()))
        return pd.DataFrame({"f": f, "v": list(total)})

    parts = tokens.select("ids").mapInPandas(run, "f int, v array<float>")
    out = np.zeros((size, width))
    for f, v in parts.groupBy(F.expr("f div 256").alias("part")).applyInPandas(add, "f int, v array<double>").collect():
        out[f] = v
    return out


def latent(image: np.ndarray, test: np.ndarray, rank: int) -> np.ndarray:
    """The leading singular vectors of A from one pass over it: Nystroem's form of the randomised SVD, of image = A' A test."""
    shift = 1e-6 * np.linalg.norm(image)
    image = image + shift * test
    values, vectors = np.linalg.eigh((test.T @ image + image.T @ test) / 2)
    half = image @ (vectors / np.sqrt(np.maximum(values, 1e-9 * max(values.max(), 1e-30))))
    return np.linalg.svd(half, full_matrices=False)[0][:, :rank]


class Search:
    """Items in the latent space, and the scan of documents for them.

    Items of about one length make a class, and a class fixes its windows. A window runs
    over whole groups of GROUP words and starts at every quarter of its length, so that
    its vector is a difference of two running sums over the groups. Windows of classes of
    up to SHORT words start at every group and hold an item whole wherever it starts in
    one; a few words' vector says little beside their neighbours', so no cosine is asked.
    """

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], idf: np.ndarray, basis: np.ndarray):
        self.table = np.vstack([idf[:, None] * basis, np.zeros((1, basis.shape[1]))]).astype(np.float32)  # the last row is for unknown words
        self.items = items
        self.masks = [(masks_of(ids), masks_of(answer)) for _, ids, answer in items]
        self.longest = 2 * max(len(ids) for _, ids, _ in items) + 4 * GROUP
        classes: dict[int, list[int]] = {}
        for k, (_, ids, _) in enumerate(items):
            classes.setdefault(round(math.log(len(ids)) / math.log(1.4)), []).append(k)
        self.classes = []
        for of in classes.values():
            length = max(len(items[k][1]) for k in of)
            vectors = np.stack([self.table[items[k][1]].sum(0) for k in of])
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            member = np.zeros((len(self.table), len(of)), np.uint8)
            for column, k in enumerate(of):
                member[items[k][1], column] = 1
            least = np.array([math.ceil(PARAPHRASE * len(items[k][1])) for k in of], np.int32)
            self.classes.append((length, of, (vectors / np.where(norms > 0, norms, 1)).T.copy(), member, least))

    def scan(self, documents: list[np.ndarray]) -> list[tuple[int, int, float, float, int, int]]:
        """(document, item_id, share of its words in common order, the same of its answer, first word, end) for each item that is found."""
        best: dict[tuple[int, int], tuple[float, float, int, int]] = {}
        pieces: list[tuple[int, int, np.ndarray]] = []
        waiting = 0
        for k, ids in enumerate(documents):
            for at in range(0, max(1, len(ids)), PIECE):  # a long document in pieces; each runs on beyond the longest window
                pieces.append((k, at, ids[at : at + PIECE + self.longest]))
                waiting += len(pieces[-1][2])
                if waiting >= PIECE:
                    self.scan_pieces(pieces, best)
                    pieces, waiting = [], 0
        self.scan_pieces(pieces, best)
        return [(k, self.items[i][0], *found) for (k, i), found in sorted(best.items())]

    def scan_pieces(self, pieces: list[tuple[int, int, np.ndarray]], best: dict[tuple[int, int], tuple[float, float, int, int]]) -> None:
        """Put what the pieces (document, place in it, ids) hold into best, by document and number of the item."""
        pieces = [p for p in pieces if (p[2] >= 0).any()]
        if not pieces:
            return
        sizes = np.array([len(ids) for _, _, ids in pieces])
        groups = -(-sizes // GROUP)
        base = np.concatenate(([0], np.cumsum(groups)))
        unknown = len(self.table) - 1
        flat = np.full(GROUP * base[-1], unknown, np.int32)
        for at, (_, _, ids) in zip(base.tolist(), pieces, strict=False):
            flat[GROUP * at : GROUP * at + len(ids)] = np.where(ids >= 0, ids, unknown)
        sums = np.zeros((base[-1] + 1, self.table.shape[1]))
        np.cumsum(sum(self.table[flat[k::GROUP]] for k in range(GROUP)), 0, np.float64, sums[1:])
        for length, of, vectors, member, least in self.classes:
            short = length <= SHORT
            wide = -(-(length + (GROUP - 1) * short) // GROUP)
            step, reach = (1, 0) if short else (max(1, wide // 4), length // 8)
            counts = np.maximum(0, -(-(groups - wide) // step)) + 1
            piece = np.repeat(np.arange(len(pieces)), counts)
            starts = base[piece] + step * (np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts))
            ends = np.minimum(starts + wide, base[piece + 1])
            first = np.maximum(GROUP * base[piece], GROUP * starts - reach)
            end = np.minimum(GROUP * base[piece] + sizes[piece], GROUP * ends + reach)
            # no more words can be in common order than the span's groups have of the item's
            held = np.zeros((base[-1] + 1, len(of)), np.int32)
            np.cumsum(sum(member[flat[k::GROUP]] for k in range(GROUP)), 0, np.int32, held[1:])
            low, high = first // GROUP, -(-end // GROUP)
            for at in range(0, len(starts), 2048):
                enough = held[high[at : at + 2048]] - held[low[at : at + 2048]] >= least
                live = np.flatnonzero(enough.any(1))
                hit = enough[live]
                if not short:
                    w = (sums[ends[at + live]] - sums[starts[at + live]]).astype(np.float32)
                    norms = np.linalg.norm(w, axis=1, keepdims=True)
                    hit &= w @ vectors >= COSINE * np.maximum(norms, 1e-6)
                near, row = np.nonzero(hit)
                for x, y in zip((live[near] + at).tolist(), row.tolist(), strict=True):
                    self.confirm(pieces[piece[x]], of[y], int(first[x] - GROUP * base[piece[x]]), int(end[x] - GROUP * base[piece[x]]), best)

    def confirm(self, piece: tuple[int, int, np.ndarray], item: int, first: int, end: int, best: dict[tuple[int, int], tuple[float, float, int, int]]) -> None:
        """Keep the item's best span in the document, if enough of its words are there in order."""
        document, at, ids = piece
        _, words, answer = self.items[item]
        masks, answer_masks = self.masks[item]
        span = ids[first:end].tolist()
        share = matched(masks, len(words), span) / len(words)
        known = best.get((document, item))
        if share >= PARAPHRASE and (known is None or share > known[0]):
            told = matched(answer_masks, len(answer), span) / max(1, len(answer))
            if share >= COPY or told >= ANSWER:
                best[document, item] = (share, told, at + first, at + end)


def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, overlap, answer, first_word, end_word): a row for each document and each benchmark item found in it.

    docs has doc_id and text, benchmark item_id and text; other columns are ignored. An
    item is found where its words come in the same order, COPY of them, or PARAPHRASE of
    them with ANSWER of its answer's. Null or empty texts and items without words are
    never found; repeated rows of docs are reported each, repeated items each by their id.

    Items are taken in blocks of about BLOCK, so what is gathered and shipped is bounded:
    a block's texts, the document frequencies of its words over all passages of docs, and
    the latent basis. The basis is that of a randomised SVD of the TF-IDF passages of all
    docs and items, restricted to the words of the items (others meet none of them).
    """
    spark = docs.sparkSession
    queries = stored(benchmark.select("item_id", "text").filter("text is not null"), "items")
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    out = None
    for block in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about BLOCK rows
        rows = sorted(((r.item_id, r.text) for r in rows if words_of(r.text)), key=str)
        found = _search(docs, rows, rank) if rows else spark.createDataFrame([], SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


SCHEMA = "doc_id long, item_id long, overlap double, answer double, first_word int, end_word int"


def _search(docs: DataFrame, rows: list[tuple[int, str]], rank: int) -> DataFrame:
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, t in rows for w in words_of(t)))}
    size = len(vocabulary)
    number = lambda words: np.array([vocabulary[w] for w in words], np.int64)
    items = [(i, number(words_of(t)), number(answer_of(t))) for i, t in rows]

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.get
        for x in slices(batches):
            ids = [np.fromiter(map(known, words, repeat(-1)), "<i4", len(words)).tobytes() for words in map(words_of, x.column("text").to_pylist())]
            yield pa.record_batch([x.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    tokens = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tokens_of, "doc_id long, ids binary"), "passages")
    df, total = document_frequency(tokens, size)
    own = passages([ids for _, ids, _ in items], size)
    df += holding(own, size)
    idf = np.log((1 + total + len(own)) / (1 + df))  # words of nearly every passage weigh next to nothing
    test = np.linalg.qr(np.random.default_rng(11).standard_normal((size, min(size, rank + EXTRA))))[0]
    search = Search(items, idf, latent(gram_times(tokens, idf, test) + gram(own, idf, test), test, rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            texts = x.column("ids").to_pylist()
            found = [(at + k, *hit) for at in range(0, len(texts), DOCS) for k, *hit in search.scan([np.frombuffer(t, "<i4") for t in texts[at : at + DOCS]])]
            row, *hits = zip(*found, strict=True) if found else [()] * 6
            ids = x.column("doc_id").take(pa.array(row, pa.int64()))  # as they are: pandas makes doubles of them beside a null
            yield pa.record_batch([ids, *(pa.array(h, t) for h, t in zip(hits, (pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32()), strict=True))], [c.split()[0] for c in SCHEMA.split(", ")])

    return tokens.mapInArrow(run, SCHEMA)


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that have a benchmark item in their text; the text's hash stands for the row, whatever its doc_id."""
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    gone = stored(contaminated(keyed, benchmark).select(F.col("doc_id").alias("_gone")).distinct(), "leaks")
    return docs.join(gone, F.xxhash64(docs.text) == gone._gone, "left_anti")
