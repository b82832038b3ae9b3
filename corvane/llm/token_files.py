"""Token ids in Arrow files of equal-length sequences, and their way back."""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm.scratch import folder, slices, stored

#: Ids of a sequence, sequences of a record batch, and pieces (twice, in two generations) that a worker remembers.
LENGTH, ROWS, CACHED, LONGEST = 2048, 256, 600_000, 64
#: Characters that are white space, letters and signs for every version of Unicode; apostrophes, which begin contractions, are none of them.
SPACE, LETTER, SIGN = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
#: Words, a line feed before one, signs, anything else up to white space, and what trails.
PIECES = re.compile(rf" ?[{LETTER}]+(?=[{SPACE}{SIGN}]|\Z)|\n(?=[{LETTER}])| ?[{SIGN}]+(?=[{LETTER}{SPACE}]|\Z)|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+\Z")
WORD = re.compile(f" ?[{LETTER}]+")
#: Before spaces that don't follow white space.
SPACED = re.compile(r"(?<!\s)(?= )")


class PieceCoder:
    """Encodes whole texts with the tokenizers library, of which it remembers pieces.

    A byte-level pre-tokenizer ends a match where white space follows anything else,
    between a letter and a sign, and between one line feed and a letter. So a text that is
    cut there encodes piece by piece. Words go to the library many at a time, line by
    line: a line feed between two words is a token of its own.
    If the model has a normaliser or another pre-tokenizer, or a text holds one of its
    special strings and these aren't plain, the text goes to the library uncut.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        step = kind.get("pre_tokenizer") or {}
        self.cuts = not kind.get("normalizer") and step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space")
        self.special = [] if plain else [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.feed = self.library.encode("\n", add_special_tokens=False).ids[0] if self.cuts else None
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if not self.cuts or any(x in text for x in self.special):
            return [text]
        return PIECES.findall(text)

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of self.dtype."""
        cut = [self.pieces(t) for t in texts]
        need = set().union(*cut) - self.known.keys()
        if len(self.known) + len(need) > CACHED:
            self.older, self.known = self.known, {"": b""}
            need = set().union(*cut) - self.known.keys()
        for p in need & self.older.keys():
            self.known[p] = self.older[p]
        new = [p for p in need if p not in self.older]
        self.known.update(self.encoded(new))
        found = [b"".join(map(self.known.__getitem__, parts)) for parts in cut]
        for p in new:
            if len(p) > LONGEST:
                del self.known[p]
        return found

    def encoded(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each part with its ids, by the library."""
        words = [p for p in parts if self.cuts and WORD.fullmatch(p)]
        others = [p for p in parts if not (self.cuts and WORD.fullmatch(p))]
        for at in range(0, len(words), 512):
            some = words[at : at + 512]
            ids = np.array(self.library.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            ends = [*np.flatnonzero(ids == self.feed).tolist(), len(ids)]
            if len(ends) != len(some):
                raise ValueError("a line feed is no token of its own")
            data, size = ids.tobytes(), self.dtype.itemsize
            yield from zip(some, (data[size * (a + 1) : size * b] for a, b in zip([-1, *ends], ends, strict=False)), strict=True)
        for p, x in zip(others, self.library.encode_batch_fast(others, add_special_tokens=False), strict=True):
            yield p, np.array(x.ids, self.dtype).tobytes()


@lru_cache(2)
def coder(path: str, plain: bool = False) -> PieceCoder:
    return PieceCoder(path, plain)


def located(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path as Hadoop writes it, and the path within."""
    return arrow_fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))


class Sequences:
    """Writes ids one after another into an Arrow file whose batches are fixed-size lists of ids and of mask bits."""

    def __init__(self, fs: arrow_fs.FileSystem, path: str, dtype: np.dtype, length: int, rows: int):
        self.length, self.rows, self.dtype = length, rows, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("tokens", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))], {"length": str(length), "rows": str(rows)})
        self.sink = fs.open_output_stream(path)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.length * self.rows:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids, step = np.concatenate([*self.waiting, np.zeros(0, self.dtype)]), self.length * self.rows
        for at in range(0, len(ids) if last else len(ids) - step + 1, step):
            own = ids[at : at + step]
            full = np.zeros(-(-len(own) // self.length) * self.length, self.dtype)
            full[: len(own)] = own
            mask = np.arange(len(full)) < len(own)
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (full, mask)]
            self.out.write_batch(pa.record_batch(columns, schema=self.schema))
        rest = ids[:0] if last else ids[len(ids) // step * step :]
        self.waiting, self.held = [rest], len(rest)

    def close(self) -> None:
        self.flush(True)
        self.out.close()
        self.sink.close()


class TokenFile:
    """Random access to a file of Sequences: views into the mapped file, nothing is copied on a local path; elsewhere only the batch asked for is read."""

    def __init__(self, uri: str):
        fs, path = located(uri)
        self.source = pa.memory_map(path) if isinstance(fs, arrow_fs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length, self.rows = (int(self.reader.schema.metadata[k]) for k in (b"length", b"rows"))
        self.last: tuple[int, pa.RecordBatch | None] = (-1, None)

    def batch(self, k: int) -> pa.RecordBatch:
        if self.last[0] != k:
            self.last = (k, self.reader.get_batch(k))
        return self.last[1]

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return 0 if n == 0 else (n - 1) * self.rows + self.reader.get_batch(n - 1).num_rows

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The i-th sequence's ids, as a view, and its mask bits: true for an id, false for padding."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        k, row = divmod(i, self.rows)
        tokens, mask = self.batch(k).columns
        at = row * self.length
        return tokens.values.to_numpy(zero_copy_only=True)[at : at + self.length], mask.values.slice(at, self.length)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from a place in the file; a view if they lie in one batch."""
        parts, step = [], self.length * self.rows
        while n > 0:
            k, at = divmod(start, step)
            parts.append(self.batch(k).column(0).values.to_numpy(zero_copy_only=True)[at : at + min(n, step - at)])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.uint32)])


DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def write_token_files(docs: DataFrame, path: str, end_id: int, length: int = LENGTH, rows: int = ROWS, files: int | None = None, into: str | None = None) -> DataFrame:
    """Encode each whole text (null: empty), append end_id, and write the ids in ascending order of doc_id; the stored manifest (part, ids_file, docs_file, n_docs, n_ids).

    The files of ascending part, one after the other, hold the ids of ascending doc_id;
    null ids come first, rows of one doc_id follow each other by a hash of the text, then
    by their place in the input. So a doc_id that a third of the rows share is spread over
    parts as well. Beside each file of sequences stands one with each document's id, start
    in that file and number of ids. Only the last sequence of a file is padded. An empty
    table gives an empty manifest and no files. docs: doc_id, text; others are ignored.

    files: how many parts; by default shuffle partitions, joined by their size. into is a folder that pyarrow can write from every executor (file, hdfs, s3, gs); by
    default one in the shared folder. Each attempt of a task writes files of its own
    names, and only the files of attempts that ended are in the manifest.
    """
    spark = docs.sparkSession
    if into is None:
        whole = spark._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/corvane/token-ids-{uuid.uuid4().hex}")
        into = whole.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(whole).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out, index, n_docs = coder(path), None, None, 0
        part, name = TaskContext.get().partitionId(), f"{into}/{uuid.uuid4().hex}"
        end = np.array([end_id], own.dtype)
        for x in slices(batches):
            if x.num_rows == 0:
                continue
            if out is None:
                fs, local = located(name)
                fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
                out = Sequences(fs, f"{local}.ids.arrow", own.dtype, length, rows)
                sink = fs.open_output_stream(f"{local}.docs.arrow")
                index = pa.ipc.new_file(sink, DOCS)
            starts, sizes = [], []
            for packed in own.packed([t or "" for t in x.column("text").to_pylist()]):
                starts.append(out.total)
                out.add(np.frombuffer(packed, own.dtype))
                out.add(end)
                sizes.append(out.total - starts[-1])
            n_docs += x.num_rows
            index.write_batch(pa.record_batch([x.column("doc_id"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=DOCS))
        if out is not None:
            out.close()
            index.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "ids_file": f"{name}.ids.arrow", "docs_file": f"{name}.docs.arrow", "n_docs": n_docs, "n_ids": out.total}])

    rows_of = docs.select(F.col("doc_id").cast("long"), "text").withColumn("row", F.monotonically_increasing_id())
    order = ["doc_id", F.xxhash64("text"), "row"]
    ordered = rows_of.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return stored(ordered.mapInArrow(run, "part long, ids_file string, docs_file string, n_docs long, n_ids long"), "token-files")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the files of a manifest.

    start counts the ids of all documents before it in all files. The manifest has a row
    for each file, so the running sum over it is small; a task reads whole files.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for f in x.to_pylist():
                ids, (fs, local) = TokenFile(f["ids_file"]), located(f["docs_file"])
                with fs.open_input_file(local) as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        own = index.get_batch(k)
                        sums = [zlib.crc32(ids.ids(r["start"], r["n_tokens"]).astype("<u4")) for r in own.to_pylist()]
                        starts = pa.array(own.column("start").to_numpy() + f["base"])
                        yield pa.record_batch([own.column("doc_id"), starts, own.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, min(manifest.count(), 10_000))
    return based.repartition(files, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
