"""Runs of words: maximal stretches that repeat with a period, and texts without their repeats."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.scratch import slices

#: A run has so many words at least.
SHORTEST = 12


def numbered(words: list) -> np.ndarray:
    """Words as numbers, equal ones alike."""
    seen = dict(zip(dict.fromkeys(words), range(len(words)), strict=False))
    return np.array(list(map(seen.__getitem__, words)), np.int64)


def next_same(w: np.ndarray) -> np.ndarray:
    """The distance from each word to its next occurrence; beyond the text if there is none."""
    order = np.argsort(w, kind="stable")
    out = np.full(len(w), 2 * len(w) + 2)
    same = w[order[1:]] == w[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def seeds(w: np.ndarray, block: int, near: int, far: int, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of each aligned block of so many words that occurs again near to far words on.

    Only blocks whose words all come again within far words can; they are the keys of an
    automaton that is run over the whole document.
    """
    whole = len(w) // block * block
    starts = np.flatnonzero((ahead[:whole] <= far).reshape(-1, block).all(1)) * block
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none
    plain, keys = w.tolist(), {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for x in starts.tolist():
        key = tuple(plain[x : x + block])
        if key not in keys:
            keys[key] = len(keys)
            automaton.add_word(key, keys[key])
    key_of = np.array([keys[tuple(plain[x : x + block])] for x in starts.tolist()])
    automaton.make_automaton()
    hits = np.array([(k, end - block + 1) for end, k in automaton.iter(tuple(plain))], np.int64).reshape(-1, 2)
    wide = len(w) + far + 2
    places = np.sort(hits[:, 0] * wide + hits[:, 1])
    first = np.searchsorted(places, key_of * wide + starts + near)
    last = np.searchsorted(places, key_of * wide + starts + far, "right")
    n = last - first
    x = np.repeat(starts, n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return x, places[at] % wide - x


def agree_right(w: np.ndarray, i: int, d: int) -> int:
    """The first place from i on where a word differs from the one d words on."""
    step, n = 16, len(w) - d
    while i < n:
        j = min(n, i + step)
        differ = w[i:j] != w[i + d : j + d]
        if differ.any():
            return i + int(differ.argmax())
        i, step = j, step * 2
    return n


def agree_left(w: np.ndarray, i: int, d: int) -> int:
    """The first place from which on, up to i, each word equals the one d words on."""
    step = 16
    while i > 0:
        j = max(0, i - step)
        differ = w[j:i] != w[j + d : i + d]
        if differ.any():
            return i - int(differ[::-1].argmax())
        i, step = j, step * 2
    return 0


def find_runs(w: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period.

    A run's stretch of words equal to those a period on has at least a period's length. So
    for periods from 2B-1 to 4B-2 it holds an aligned block of B words, which occurs again
    at just this distance: the scale's seeds. Each seed is extended both ways; seeds
    within an extended stretch, and those at multiples of the period of a run that holds
    them, give nothing new and are stepped over. That holds for shortest of 12 or more
    words: a shorter period's stretch is longer still.
    """
    if shortest < SHORTEST:
        raise ValueError(f"shortest has to be {SHORTEST} at least")
    n, block, found = len(w), 2, {}
    if n < shortest:
        return []
    ahead = next_same(w)
    near = 1
    while near <= n // 2:
        far = min(4 * block - 2, n // 2)
        x, d = seeds(w, block, near, far, ahead)
        order = np.lexsort((x, d))
        x, d = x[order], d[order]
        for period in np.unique(d).tolist():
            own = x[np.searchsorted(d, period) : np.searchsorted(d, period, "right")]
            i = 0
            while i < len(own):
                at = int(own[i])
                held = next((e for q, spans in found.items() if period % q == 0 and (k := bisect_right(spans, (at, n + 1)) - 1) >= 0 and (e := spans[k][1]) >= at + period + block), None)
                if held is None:
                    right = agree_right(w, at + block, period)
                    left = agree_left(w, at, period)
                    if right - left >= period and right - left + period >= shortest:
                        spans = found.setdefault(period, [])
                        spans.insert(bisect_right(spans, (left, right + period)), (left, right + period))
                    i = max(i + 1, int(np.searchsorted(own, right - block, "right")))
                else:
                    i = max(i + 1, int(np.searchsorted(own, held - period - block, "right")))
        near, block = 4 * block - 1, block * 2
    least: dict[tuple[int, int], int] = {}
    for q, spans in found.items():
        for span in spans:
            least[span] = min(q, least.get(span, q))
    return sorted((s, e - s, q) for (s, e), q in least.items())


def repeats(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words lie in some run after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) > 0


def tailed(doc_id: int | None, n: int) -> np.ndarray | None:
    """The places from which a tenth of the documents, by a hash of their id, take their words, so that they end in repeats; None for all others."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def word_runs(docs: DataFrame, rewrite: bool = False, texts: bool = False) -> DataFrame:
    """The runs of each whole text, one row for each row of docs (columns doc_id, text; others are ignored).

    n_runs, the longest run (ties: smallest start, then period; null without a run), and
    digests of all runs and of the words that stay when repeats go; texts=True adds the
    arrays themselves: runs, and collapsed. Words are what stands between the characters
    \\x20 and \\x09-\\x0D. A null, empty or short text has no runs. rewrite: see tailed();
    a null doc_id is never rewritten. A document is the unit: its work grows with its
    length times the logarithm of it, whatever repeats.
    """

    def one(doc_id: int | None, text: str | None) -> dict:
        words = (text or "").encode().split()
        take = tailed(doc_id, len(words)) if rewrite else None
        if take is not None:
            words = list(map(words.__getitem__, take.tolist()))
        runs = find_runs(numbered(words)) if len(words) >= SHORTEST else []
        if runs:
            gone = repeats(len(words), runs)
            kept = b" ".join([x for x, drop in zip(words, gone.tolist(), strict=True) if not drop])
        else:
            kept = b" ".join(words)
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        out = {"doc_id": doc_id, "n_runs": len(runs), "start": start, "length": length, "period": period, "exponent_milli": 1000 * length // period if runs else None}
        out |= {"runs_sha256": hashlib.sha256(listed.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(kept).hexdigest()}
        if texts:
            out |= {"runs": [{"start": s, "length": k, "period": q} for s, k, q in runs], "collapsed": kept.decode()}
        return out

    kinds = [pa.field(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (c.split() for c in COLUMNS.split(", "))]
    if texts:
        kinds += [pa.field("runs", pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))), pa.field("collapsed", pa.string())]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            yield pa.RecordBatch.from_pylist([one(i, t) for i, t in zip(x.column("doc_id").to_pylist(), x.column("text").to_pylist(), strict=True)], schema=schema)

    more = ", runs array<struct<start: long, length: long, period: long>>, collapsed string" if texts else ""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, COLUMNS + more)
