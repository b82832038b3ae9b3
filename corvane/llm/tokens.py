"""Token counts of a SentencePiece BPE model, by a whole-token shortcut."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.scratch import slices

SPACE, CACHED = "▁", 300_000
RUNS = re.compile(r" +[^ \n]*|\n[^ \n]*")


class Counter:
    """Counts tokens as the library's encode() gives them, for a model that leaves texts as they are but for the space sign.

    At the start it proves three things of the vocabulary, or refuses the model. The
    normaliser changes no text besides putting the space sign for spaces and before the
    text. No token has the space sign after another character, and none holds a line feed
    next to other characters. So no merge ever crosses these places, and a text falls
    into pre-tokens (a run of space signs with what follows, up to the next one or to a
    line feed) that merge on their own. Last, of each vocabulary string it is proven, by
    encoding it alone, whether it comes out as one token: such pre-tokens count 1 without
    any merging; the rest are merged, and remembered.
    """

    def __init__(self, path: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i))]
        bad = [p for p in pieces if SPACE in p.lstrip(SPACE) or "\n" in p]
        # NFKC, case folding, trimming or collapsing would show in one of these.
        probe = "  ﬁ ① AÄ　x́  "
        if bad or m.decode(m.encode(probe)) != probe or len(m.encode("\n")) != 2:
            raise ValueError("the model rewrites texts, or merges across spaces or line feeds")
        headed = [p[1:].replace(SPACE, " ") for p in pieces if p[0] == SPACE]
        self.one = {p: 1 for p, n in zip(headed, self.merged(headed), strict=True) if n == 1}
        self.counts, self.older = dict(self.one), dict[str, int]()

    def ids(self, keys: list[str]) -> list[list[int]]:
        """Ids of each pre-token. It is encoded behind a line feed, which takes two tokens: the sign that encode() puts first, and its own."""
        behind = [k if k[:1] == "\n" else f"\n {k}" for k in keys]
        return [x[2 - (k[:1] == "\n") :] for k, x in zip(keys, self.model.encode(behind, num_threads=1), strict=True)]

    def merged(self, keys: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        return list(map(len, self.ids(keys)))

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of a text that isn't empty. One space sign in front is left out, and one that starts with a line feed has none."""
        plain = text.replace(SPACE, " ").replace("\n", " \n")
        if "  " in plain or plain[0] == " " or plain[-1] == " ":
            runs = RUNS.findall(" " + text.replace(SPACE, " "))
            return [x if x[0] == "\n" else x[1:] for x in runs]
        return plain.split(" ")

    def count(self, text: str) -> int:
        if not text:
            return 0
        keys = self.pretokens(text)
        found = list(map(self.counts.get, keys))
        if None in found:
            missing = [k for k, n in zip(keys, found, strict=True) if n is None]
            new = [k for k in dict.fromkeys(missing) if k not in self.older]
            known = dict(zip(new, self.merged(new), strict=True)) | {k: self.older[k] for k in missing if k in self.older}
            if len(self.counts) + len(known) > CACHED + len(self.one):
                self.older, self.counts = self.counts, dict(self.one)
            self.counts.update((k, n) for k, n in known.items() if len(k) <= 64)
            found = [known[k] if n is None else n for k, n in zip(keys, found, strict=True)]
        return sum(found)


@lru_cache(2)
def loaded(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each whole text, one row for each row of docs (columns doc_id, text; others are ignored).

    A null or empty text has 0 bytes and 0 tokens. over_limit: n_tokens > limit. doc_id
    comes back as it is, null, repeated or large.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        for x in slices(batches):
            texts = [t or "" for t in x.column("text").to_pylist()]
            n = pa.array([counter.count(t) for t in texts], pa.int64())
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.record_batch([x.column("doc_id"), size, n, pa.compute.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
