"""Alignment of two tokenizers' tokens by the bytes they cover, in Spark's higher-order functions."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm.scratch import slices, stored
from corvane.llm.token_files import LETTER, SIGN, SPACE, SPACED, WORD, PieceCoder
from corvane.llm.token_files import PIECES as FINE
from corvane.llm.tokens import Counter

#: Pieces, and code points of them, that a worker remembers (and a stretch's more), bytes of text that go together, and pairs of ids up to which their counts are broadcast (16 bytes each, about 100 MB as a table).
CACHED, KEPT, CHARS, PAIRS = 300_000, 6_000_000, 4_000_000, 2_000_000
#: A token in one number: its end, then 0 for A or 1 for B, then its id; all ones below the end mark a group's end.
WIDE = 32
MARK = (1 << WIDE + 1) - 1
#: What stands behind a token of a group, behind A's last one, and behind B's.
SIGNS = ",|;"


class Bytes:
    """Token bytes and their lengths, by id."""

    def __init__(self, of: list[bytes]):
        self.of, self.size = of, np.array(list(map(len, of)), np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.of.__getitem__, ids.tolist()))


def byte_level(library: Tokenizer) -> Bytes:
    """Bytes of a byte-level vocabulary, whose entries are printable: visible Latin-1 characters stand for their own byte, all other bytes, in order, for the characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    sign = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    added = {i: x.content.encode() for i, x in library.get_added_tokens_decoder().items()}
    names = (library.id_to_token(i) for i in range(library.get_vocab_size()))
    return Bytes([added[i] if i in added else bytes(map(sign.__getitem__, name)) for i, name in enumerate(names)])


class Lists:
    """Lists of numbers, one after another."""

    def __init__(self, sizes: np.ndarray | list[int] = (), data: np.ndarray | list[int] = ()):
        self.sizes, self.data = np.asarray(sizes, np.int64), np.asarray(data, np.int32)

    def add(self, more: Lists) -> None:
        self.sizes, self.data = np.concatenate([self.sizes, more.sizes]), np.concatenate([self.data, more.data])

    def take(self, at: np.ndarray) -> Lists:
        n = self.sizes[at]
        starts = (np.cumsum(self.sizes) - self.sizes)[at]
        return Lists(n, self.data[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())])

    def ends(self) -> Lists:
        """The running sums of each list."""
        sums = np.concatenate(([0], np.cumsum(self.data, dtype=np.int64)))
        return Lists(self.sizes, sums[1:] - np.repeat(sums[np.cumsum(self.sizes) - self.sizes], self.sizes))

    def arrow(self, kind: pa.DataType) -> pa.ListArray:
        return listed(self.sizes, pa.array(self.data).cast(kind))


def distinct(numbers: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, and the place of each in them."""
    there = np.zeros(below, bool)
    there[numbers] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[numbers]


class Pair:
    """Both tokenizers of one worker; texts in, pieces and their tokens out.

    A space and the text are cut where both tokenizers end a token, whatever stands
    around: PieceCoder says why A does. B does if no token of it has a letter beside a
    sign, and none the text's white space behind anything else, which is looked up at the
    start; otherwise the cut is only before spaces that follow something else (see Counter).
    """

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = PieceCoder(path_a, plain=True), Counter(path_b)
        self.a_bytes = byte_level(self.a.library)
        m = self.b.model
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.b_bytes = Bytes([bytes([int(x[3:5], 16)]) if m.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)])
        plain = [x for i, x in enumerate(names) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        self.fine = self.a.cuts and not any(re.search(f"[{LETTER}][{SIGN}]|[{SIGN}][{LETTER}]", x) for x in plain)
        self.apart = sorted({c for x in plain for c in re.findall(f"(?<=[^{SPACE}▁])[{SPACE}▁]", x)})
        self.b_feed = m.encode("\n")[1]
        # What is remembered: pieces by number, with their tokens and their shape, which is the lengths of both kinds' tokens; the numbers that the last texts have.
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__  # a new piece gets the next number
        self.shape_number: dict[tuple[bytes, bytes], int] = {}
        self.ids, self.lengths = (Lists(), Lists()), (Lists(), Lists())
        self.shape, self.last, self.held = np.zeros(0, np.int32), np.zeros(0, np.int64), 0

    def forget(self) -> None:
        """Free all pieces but those of the last texts, and these too if they are too many."""
        names, shapes = list(self.number), list(self.shape_number)
        kept = [names[i] for i in self.last]
        if len(kept) > CACHED or sum(map(len, kept)) > KEPT:
            kept, self.last = [], self.last[:0]
        kinds, self.shape = distinct(self.shape[self.last], len(shapes))
        self.number.clear()
        self.number.update(zip(kept, range(len(kept)), strict=True))
        self.shape_number = {shapes[i]: k for k, i in enumerate(kinds.tolist())}
        self.ids, self.lengths = tuple(x.take(self.last) for x in self.ids), tuple(x.take(kinds) for x in self.lengths)
        self.last, self.held = np.arange(len(kept)), sum(map(len, kept))

    def pieces(self, text: str) -> list[str]:
        """The text begins with a space."""
        return FINE.findall(text) if self.fine and not any(x in text for x in self.apart) else SPACED.split(text)[1:] if self.a.cuts else [text]

    def learn(self, pieces: list[str]) -> None:
        """Tokens of new pieces, in the order of their numbers. Words go to both tokenizers many at a time, line by line (see PieceCoder and Counter); B encodes others behind a line feed, two tokens that no other joins."""
        plain = np.array([bool(self.fine and WORD.fullmatch(p)) for p in pieces], bool)
        words, others = (list(compress(pieces, x)) for x in (plain, ~plain))
        a, b = Lists(), Lists()
        for at in range(0, len(words), 512):
            lines = "\n" + "\n".join(words[at : at + 512])
            for of, ids, feed in ((a, self.a.library.encode_batch_fast([lines], add_special_tokens=False)[0].ids, self.a.feed), (b, self.b.model.encode(lines)[1:], self.b_feed)):
                row = np.array(ids, np.int32)
                ends = np.flatnonzero(row == feed)
                if len(ends) != lines.count("\n") or ends[0]:
                    raise ValueError("a line feed is no token of its own")
                of.add(Lists(np.diff(ends, append=len(row)) - 1, row[row != feed]))
        packed = [x for _, x in self.a.encoded(others)] if self.fine else self.a.packed(others)
        a.add(Lists([len(x) // self.a.dtype.itemsize for x in packed], np.frombuffer(b"".join(packed), self.a.dtype)))
        each = [x[2:] for x in self.b.model.encode(["\n" + p for p in others], num_threads=1)]
        b.add(Lists(list(map(len, each)), list(chain.from_iterable(each))))
        order = np.argsort(np.argsort(~plain, kind="stable"))
        a, b = a.take(order), b.take(order)
        keys = list(zip(lengths_of(a, self.a_bytes), lengths_of(b, self.b_bytes), strict=True))
        new = [x for x in dict.fromkeys(keys) if x not in self.shape_number]
        for k in (0, 1):
            self.ids[k].add((a, b)[k])
            self.lengths[k].add(Lists([len(x[k]) // 4 for x in new], np.frombuffer(b"".join(x[k] for x in new), np.int32)))
        self.shape_number.update(zip(new, range(len(self.shape_number), len(self.shape_number) + len(new)), strict=True))
        self.shape = np.concatenate([self.shape, np.array(list(map(self.shape_number.__getitem__, keys)), np.int32)])
        self.held += sum(map(len, pieces))

    def cut(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of all pieces, each once, the places in them of the texts' pieces, and how many each text has; none where either tokenizer's bytes aren't the text's."""
        if len(self.number) > CACHED or self.held > KEPT:
            self.forget()
        each = [np.fromiter(map(self.number.__getitem__, self.pieces(" " + t) if t else []), np.int32) for t in texts]
        new = islice(self.number, len(self.shape), None)
        while some := list(islice(new, 16_384)):
            self.learn(some)
        at, sizes = np.concatenate([np.zeros(0, np.int32), *each]), np.array(list(map(len, each)), np.int64)
        starts, keep = np.cumsum(sizes) - sizes, np.ones(len(at), bool)
        for k, t in enumerate(texts):
            own = slice(starts[k], starts[k] + sizes[k])
            if t and self.doubtful(t) and not self.whole(t, at[own]):
                keep[own], sizes[k] = False, 0
        self.last, places = distinct(at[keep], len(self.number))
        return self.last, places, sizes

    def doubtful(self, text: str) -> bool:
        """Whether tokens may spell other bytes than the text's: without a normaliser A's never do, and B is proven (see Counter) to change but the space sign."""
        return not self.a.cuts or "▁" in text

    def whole(self, text: str, own: np.ndarray) -> bool:
        """Whether the bytes of a text's tokens, all joined, are the text's. own: the numbers of its pieces."""
        a, b = (of.joined(x.take(own).data) for of, x in zip((self.a_bytes, self.b_bytes), self.ids, strict=True))
        return a == b" " + text.encode() == b


@lru_cache(1)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def listed(sizes: np.ndarray, flat: np.ndarray | pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), flat if isinstance(flat, pa.Array) else pa.array(flat))


def lengths_of(ids: Lists, of: Bytes) -> list[bytes]:
    """The lengths of each list's tokens, as the bytes of 32-bit integers."""
    data, at = of.size[ids.data].astype(np.int32).tobytes(), [0, *(np.cumsum(ids.sizes) * 4).tolist()]
    return [data[x:y] for x, y in zip(at, at[1:], strict=False)]


SHAPES = "array<struct<a_ends: array<long>, b_ends: array<long>>>"
PIECES = "array<struct<a: array<int>, b: array<int>, shape: int>>"
DOCS = "array<struct<doc_id: long, n_a: long, n_b: long, at: array<int>>>"


def tokenised(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(shapes, pieces, docs): rows of about CHARS code points of texts.

    shapes has the bytes at which tokens end, once for all pieces that are cut alike;
    pieces the ids of each distinct piece and the place of its shape; docs the places of
    each text's pieces.
    """

    def row(own: Pair, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        used, flat, sizes = own.cut([t for x in parts for t in x.column("text").to_pylist()])
        a, b = (x.take(used) for x in own.ids)
        kinds, shape = distinct(own.shape[used], len(own.shape_number))
        shapes = pa.StructArray.from_arrays([x.take(kinds).ends().arrow(pa.int64()) for x in own.lengths], ["a_ends", "b_ends"])
        pieces = pa.StructArray.from_arrays([a.arrow(pa.int32()), b.arrow(pa.int32()), pa.array(shape.astype(np.int32))], ["a", "b", "shape"])
        lengths = [np.concatenate(([0], np.cumsum(x.sizes[flat])))[np.concatenate(([0], np.cumsum(sizes)))] for x in (a, b)]
        ids = pa.concat_arrays([x.column("doc_id") for x in parts])
        texts = pa.StructArray.from_arrays([ids, *(pa.array(np.diff(x)) for x in lengths), listed(sizes, flat.astype(np.int32))], ["doc_id", "n_a", "n_b", "at"])
        return pa.record_batch([listed(np.array([len(x)]), x) for x in (shapes, pieces, texts)], ["shapes", "pieces", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts, held = pair(path_a, path_b), [], 0
        for x in slices(batches, 64):
            parts.append(x)
            held += x.column("text").nbytes
            if held >= CHARS:
                yield row(own, parts)
                parts, held = [], 0
        if parts:
            yield row(own, parts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"shapes {SHAPES}, pieces {PIECES}, docs {DOCS}")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used. It is the start of an aggregate over nothing: transform() would copy what use() returns, down to the last element."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, use)


def joined(*arrays: Column) -> Column:
    """The arrays one after another. concat() makes a lazy list of them each time, which shows where they are many and small."""
    return F.flatten(F.array(*arrays))


def id_of(token: Column) -> Column:
    return token.bitwiseAND((1 << WIDE) - 1)


def is_b(token: Column) -> Column:
    return token.bitwiseAND(1 << WIDE) != 0


def linked(a: Column, b: Column) -> Column:
    return F.shiftleft(a, WIDE).bitwiseOR(b)


def groups_of(a: Column, a_ends: Column, b: Column, b_ends: Column) -> Column:
    """The groups, each an array of its tokens by their ends, A before B: the last two end together.

    The tokens of both, and a mark for each end that array_intersect finds in both, are
    sorted as numbers; the groups stand between the marks.
    """
    packed = lambda ends, ids, kind: F.zip_with(ends, ids, lambda e, i: F.shiftleft(e, WIDE + 1).bitwiseOR(F.lit(kind << WIDE)).bitwiseOR(i.cast("long")))
    marks = F.transform(F.array_intersect(a_ends, b_ends), lambda e: F.shiftleft(e, WIDE + 1).bitwiseOR(F.lit(MARK)))
    row = F.sort_array(joined(packed(a_ends, a, 0), packed(b_ends, b, 1), marks))

    def cut(x: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: x[i - 1].bitwiseAND(MARK) == MARK)
        return bound(places, lambda p: F.transform(p, lambda at, k: bound(F.when(k == 0, 1).otherwise(p[F.when(k == 0, 0).otherwise(k - 1)] + 1), lambda first: F.slice(x, first, at - first))))

    none = F.array().cast("array<array<bigint>>")
    return F.when(F.size(a) == 0, none).otherwise(bound(row, cut))


def links_of(group: Column) -> Column:
    """The links of a group: each stretch between neighbouring ends lies in one token of either kind, another pair than any other stretch; from the last end back."""
    state = F.struct(F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, token: Column) -> Column:
        a, b = F.when(is_b(token), s["a"]).otherwise(id_of(token)), F.when(is_b(token), id_of(token)).otherwise(s["b"])
        return F.struct(a.alias("a"), b.alias("b"), F.when(a.isNull() | b.isNull(), s["out"]).otherwise(F.array_append(s["out"], linked(a, b))).alias("out"))

    return F.when(F.size(group) == 2, F.array(linked(id_of(group[0]), id_of(group[1])))).otherwise(F.aggregate(F.reverse(group), state, step, lambda s: s["out"]))


def laid_out(group: Column, n_a: Column, n: Column) -> Column:
    """A group's text, a1,a2|b1; as places: tokens (B's behind all n_a of A's), and behind all n tokens the signs of SIGNS."""

    def part(keep: Callable[[Column], Column], base: Column, last: int) -> Column:
        own = lambda x: F.flatten(F.transform(x, lambda t, k: F.array(id_of(t).cast("int") + base, n + F.when(k == F.size(x) - 1, last).otherwise(0))))
        return bound(F.filter(group, keep), own)

    return joined(part(lambda x: ~is_b(x), F.lit(0), 1), part(is_b, n_a, 2))


def aligned(s: Column) -> Column:
    """(text, a, b) of one shape, its tokens numbered from 0: its groups' text as places, without the last sign, and the tokens that each link joins."""
    n_a, n_b = F.size(s["a_ends"]), F.size(s["b_ends"])
    numbers = lambda n: F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))

    def done(groups: Column) -> Column:
        text = F.flatten(F.transform(groups, lambda g: laid_out(g, n_a, n_a + n_b)))
        sides = lambda x: [F.transform(x, lambda y: F.shiftright(y, WIDE).cast("int")).alias("a"), F.transform(x, lambda y: id_of(y).cast("int")).alias("b")]
        shown = bound(text, lambda x: F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))))
        return bound(F.flatten(F.transform(groups, links_of)), lambda x: F.struct(shown.alias("text"), *sides(x)))

    return bound(groups_of(numbers(n_a), s["a_ends"], numbers(n_b), s["b_ends"]), done)


def filled(p: Column, s: Column) -> Column:
    """(groups, links) of a piece with the aligned shape s: its groups' text, and the links."""
    said = joined(p["a"].cast("array<string>"), p["b"].cast("array<string>"), F.array(*map(F.lit, SIGNS)))
    text = bound(said, lambda x: F.array_join(F.transform(s["text"], lambda k: x[k]), ""))
    links = bound(p["a"], lambda a: bound(p["b"], lambda b: F.zip_with(s["a"], s["b"], lambda i, j: linked(a[i].cast("long"), b[j].cast("long")))))
    return F.struct(text.alias("groups"), links.alias("links"))


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The alignment of each row of docs: row, doc_id, n_a, n_b, n_groups, n_links, groups (as text), links.

    docs: doc_id, text; others are ignored. Texts that are null, empty, or that either
    tokenizer's bytes don't give back have zeros, '' and no links. A link is A's id,
    shifted by 32 bits, and B's.
    """

    def of_docs(groups: Column, links: Column) -> Column:
        def of_doc(x: Column) -> Column:
            text = F.array_join(F.transform(x["at"], lambda i: groups[i]), ";")
            own = F.flatten(F.transform(x["at"], lambda i: links[i]))
            return F.struct(x["doc_id"].alias("doc_id"), x["n_a"].alias("n_a"), x["n_b"].alias("n_b"), text.alias("groups"), own.alias("links"))

        return F.transform("docs", of_doc)

    def of_pieces(shapes: Column) -> Column:
        return F.transform("pieces", lambda p: bound(shapes[p["shape"]], lambda s: filled(p, s)))

    whole = lambda pieces: bound(pieces["groups"], lambda groups: bound(pieces["links"], lambda links: of_docs(groups, links)))
    each = tokenised(docs, path_a, path_b).select(F.inline(bound(bound(F.transform("shapes", aligned), of_pieces), whole)))
    n_groups = F.col("n_a") + F.col("n_b") - F.size("links")  # a group has one link less than tokens
    return each.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", n_groups.alias("n_groups"), "groups", "links")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(link, count, best) over all documents: how many links hold the pair, and whether no pair of its B id has more. Stored."""
    counted = aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("link").bitwiseAND((1 << WIDE) - 1)))  # a B id has as many pairs as A's vocabulary at most
    return stored(counted.withColumn("best", F.col("count") == most), "align-pairs", "zstd")


def alignment_report(docs: DataFrame, path_a: str, path_b: str, most: int = PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of docs.

    See alignments() for what counts as no tokens; groups_sha256 is then ''. n_best counts
    the links whose pair has its B id's highest count, ties included; count_sum adds up
    the counts over links. The counts are broadcast if there are most pairs or fewer;
    else both sides are shuffled by pair, after the links of a row are summed up by pair.
    """
    full = alignments(docs, path_a, path_b)
    digest = F.when(F.col("n_groups") == 0, "").otherwise(F.sha2("groups", 256))
    own = stored(full.select("row", "doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), digest.alias("groups_sha256"), "links"), "align", "zstd")
    pairs = pair_counts(own)
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    links = own.select("row", F.explode("links").alias("link"))
    if pairs.count() <= most:
        per = links.join(F.broadcast(pairs), "link").withColumn("n", F.lit(1))
    else:
        per = links.groupBy("row", "link").agg(F.count("*").alias("n")).join(pairs, "link")
    sums = per.groupBy("row").agg(F.sum(F.col("best").cast("long") * F.col("n")).alias("n_best"), F.sum(F.col("count") * F.col("n")).alias("count_sum"))
    found = own.select(*kept).join(sums, "row", "left")
    return found.select(*kept[1:], *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")))
