"""Byte-level BPE by a monoid: token lists that join at re-encoded boundary windows."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.scratch import release, slices

#: Bytes of a match, and code points of a text, up to which nothing is halved.
PIECE_LEAF, TEXT_LEAF = 2, 1 << 12
#: Matches (twice, in two generations), pairs of tokens, and stretches of up to PART bytes that a worker remembers.
CACHED, PAIRS, PARTS, PART, NEVER = 150_000, 150_000, 150_000, 8, 1 << 62


class ByteBPE:
    """An encoder by ranks, equal to merging each match of the pattern on its own.

    Within a match, the tokens of two halves are joined by one lemma: a sequence of tokens
    is the encoding of its bytes if each token encodes to itself and each two neighbours
    encode to just these two, because the first merge that crosses a token's end would
    cross it in the encoding of the two alone. So a join looks at the two tokens at the
    seam; if they aren't stable it encodes a window around the seam, and the window grows
    until its outer neighbours are stable beside it.

    reach says how many code points from its start the pattern may read to choose among
    its alternatives, beyond a match's own last character and the one after it (3 for
    contractions such as 're and single look-ahead at the end). It decides which matches
    of the left half of a text stand. None: unknown, and texts are matched whole.
    """

    def __init__(self, path: str, pattern: str, reach: int | None = None, piece_leaf: int = PIECE_LEAF, text_leaf: int = TEXT_LEAF):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {b: a for a, b in self.ranks.items()}
        self.find = regex.compile(pattern)
        self.reach, self.piece_leaf, self.text_leaf = reach, max(1, piece_leaf), max(8, text_leaf)
        self.pair = lru_cache(PAIRS)(lambda a, b: self.merged(self.bytes_of[a] + self.bytes_of[b]))
        self.forget()

    def forget(self) -> None:
        """Free what is remembered."""
        self.pair.cache_clear()
        self.parts: dict[bytes, list[int]] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first, then leftmost; for the short leaves and the windows."""
        if len(data) > 64:
            return self.merged_long(data)
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        around = [ranks.get(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while around and (best := min(around)) < NEVER:
            at = around.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del around[at]
            if at < len(around):
                around[at] = ranks.get(parts[at] + parts[at + 1], NEVER)
            if at:
                around[at - 1] = ranks.get(parts[at - 1] + parts[at], NEVER)
        return [ranks[x] for x in parts]

    def merged_long(self, data: bytes) -> list[int]:
        """The same with a heap, for windows that have grown long."""
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i; of parts merged away, end is 0
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (k := before[i]) >= 0 and (r := ranks.get(data[k:stop])) is not None:
                heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def stable(self, a: int, b: int) -> bool:
        """Whether two tokens, side by side, encode to just these two."""
        return self.pair(a, b) == [a, b]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's operation on the tokens of two neighbouring stretches of one match."""
        if not left or not right:
            return left + right
        window, width = self.pair(left[-1], right[0]), 1
        if window[0] == left[-1] and len(window) == 2:
            return left + right
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            if width > 1:
                window = self.merged(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            if (i == 0 or self.stable(left[i - 1], window[0])) and (j == len(right) or self.stable(window[-1], right[j])):
                return left[:i] + window + right[j:]
            width *= 2

    def encode_bytes(self, data: bytes) -> list[int]:
        """The tokens of a stretch of one match: halves are encoded, then joined; leaves are merged plainly. Short stretches, which come again in other matches, are remembered."""
        found = self.parts.get(data)
        if found is None:
            if len(data) <= self.piece_leaf:
                found = self.merged(data)
            else:
                half = len(data) // 2
                found = self.joined(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))
            if len(data) <= PART:
                if len(self.parts) >= PARTS:
                    self.parts.clear()
                self.parts[data] = found
        return found

    def packed(self, text: str) -> bytes:
        """The ids of one match as little-endian unsigned 32-bit integers; remembered, if short, in two generations of a bounded cache."""
        found = self.pieces.get(text)
        if found is None:
            if (found := self.older.pop(text, None)) is None:
                data = text.encode()
                ids = [self.ranks[data]] if data in self.ranks else self.encode_bytes(data)  # a match that is a token is that token
                found = struct.pack(f"<{len(ids)}I", *ids)
            if len(text) <= 64:
                if len(self.pieces) >= CACHED:
                    self.older, self.pieces = self.pieces, {}
                self.pieces[text] = found
        return found

    def settled(self, spans: list[tuple[int, int]], length: int) -> int:
        """How many matches of a left part stand whatever follows: none of them looked at the end of the part."""
        n = len(spans)
        while n and (spans[n - 1][1] >= length or spans[n - 1][0] + self.reach > length):
            n -= 1
        return n

    def matches(self, text: str) -> list[tuple[int, int]]:
        """The pattern's matches in a text, as (start, end): halves are matched, then joined at their seam."""
        if len(text) <= self.text_leaf or self.reach is None:
            return [m.span() for m in self.find.finditer(text)]
        half = len(text) // 2
        left, right = self.matches(text[:half]), self.matches(text[half:])
        keep = self.settled(left, half)
        at = left[keep][0] if keep < len(left) else half
        out, starts = left[:keep], {a + half: k for k, (a, _) in enumerate(right)}
        for m in self.find.finditer(text, at):  # from here on matches are new, until one starts where one of the right part starts
            if m.start() in starts:
                return out + [(a + half, b + half) for a, b in right[starts[m.start()] :]]
            out.append(m.span())
        return out

    def encode_packed(self, text: str) -> bytes:
        parts = self.find.findall(text) if len(text) <= self.text_leaf else [text[a:b] for a, b in self.matches(text)]
        found = list(map(self.pieces.get, parts))
        if None in found:
            found = [x or self.packed(p) for x, p in zip(found, parts, strict=True)]
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, concatenated up a tree."""
        parts = list(map(self.bytes_of.__getitem__, ids))
        while len(parts) > 4096:
            parts = [b"".join(parts[i : i + 4096]) for i in range(0, len(parts), 4096)]
        return b"".join(parts)


@lru_cache(1)
def loaded(path: str, pattern: str, reach: int | None) -> ByteBPE:
    return ByteBPE(path, pattern, reach)


def encoded(docs: DataFrame, path: str, pattern: str, ids: bool = True, reach: int | None = None) -> DataFrame:
    """Encode each whole text and decode it again: (doc_id, n_tokens, ids_sha256, decoded_sha256, ids).

    One row for each row of docs (columns doc_id, text; others are ignored). A null or
    empty text has no tokens and the digests of no bytes. ids_sha256 is of the ids as
    little-endian unsigned 32-bit integers. ids=False leaves the column out. reach: see
    ByteBPE; without it long texts are matched in one go. What a worker remembers stays
    for its next task: the tables are bounded, and each task would fill them again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sha = loaded(path, pattern, reach), hashlib.sha256
        try:
            for x in slices(batches):
                sizes, first, second, every = [], [], [], []
                for text in x.column("text").to_pylist():
                    packed = coder.encode_packed(text or "")
                    tokens = np.frombuffer(packed, "<u4")
                    sizes.append(len(tokens))
                    first.append(sha(packed).hexdigest())
                    second.append(sha(coder.decode(tokens.tolist())).hexdigest())
                    every.append(packed)
                out = [x.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
                if ids:
                    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(every), "<i4"))))
                yield pa.record_batch(out, names)
        finally:
            release()

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
