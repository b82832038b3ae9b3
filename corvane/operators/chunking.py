"""Headings, places and structure of Markdown notes, natively; and chunking that keeps blocks whole, per document."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import FRONT, chunk_id

HEADING = r"^(#{1,6})[ \t]+(\S.*?)[ \t]*$"
FENCE = r"^[ \t]*(?:```|~~~)"


def lines(notes: DataFrame, text: str = "note") -> DataFrame:
    """(doc_id, pos, line, start, fenced): the lines with the offset of each and whether it lies in a fence or is one (WIN-10).

    The windows are within a document, so a group is no larger than a document.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    each = notes.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    mark = F.col("line").rlike(FENCE)
    fences = F.sum(mark.cast("int")).over(w)
    start = F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.select("doc_id", "pos", "line", start.alias("start"), (mark | (fences % 2 == 1)).alias("fenced"))


def headings(notes: DataFrame, text: str = "note") -> DataFrame:
    """CHK-3: (doc_id, pos, start, level, title) of the headings outside fences."""
    own = lines(notes, text).filter(~F.col("fenced")).withColumn("line", F.regexp_replace("line", "\r$", "")).filter(F.col("line").rlike(HEADING))
    return own.select("doc_id", "pos", "start", F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), F.regexp_extract("line", HEADING, 2).alias("title"))


def paths(found: DataFrame) -> DataFrame:
    """CHK-4: headings with path, the titles in effect: the last of each level that no shallower heading follows."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = {k: F.last(F.when(F.col("level") == k, F.struct("pos", "title")), ignorenulls=True).over(w) for k in range(1, 7)}
    own = found.withColumns({f"_l{k}": c for k, c in last.items()})
    parts, above = [], F.lit(-1)
    for k in range(1, 7):
        at = F.coalesce(F.col(f"_l{k}.pos"), F.lit(-1))
        parts.append(F.when(at > above, F.col(f"_l{k}.title")))
        above = F.greatest(above, at)
    path = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return own.withColumn("path", path).drop(*(f"_l{k}" for k in last))


def line_at(text: Column, offset: Column) -> Column:
    """CHK-6: the line, from 1, of an offset from 0."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def sections(notes: DataFrame, text: str = "note") -> DataFrame:
    """CHK-9: (doc_id, ord, level, title, start_line, end_line, has_table, has_code, chars, tokens): a note's sections, the part before the first heading as level 0.

    A section runs up to the line before the next heading. Sections without a line that
    isn't blank, of level 0, have no row. tokens is TXT-30's estimate of chars.
    """
    own = lines(notes, text).withColumn("bare", F.regexp_replace("line", "\r$", ""))
    head = ~F.col("fenced") & F.col("bare").rlike(HEADING)
    w = Window.partitionBy("doc_id").orderBy("pos")
    own = own.withColumns({"head": head, "section": F.sum(head.cast("int")).over(w)})
    filled = F.trim(F.col("bare")) != ""
    each = own.groupBy("doc_id", F.col("section").alias("ord")).agg(
        F.max(F.when(F.col("head"), F.length(F.regexp_extract("bare", HEADING, 1)))).alias("level"),
        F.max(F.when(F.col("head"), F.regexp_extract("bare", HEADING, 2))).alias("title"),
        (F.min("pos") + 1).alias("start_line"),
        F.max(F.when(filled, F.col("pos") + 1)).alias("end_line"),
        F.max((~F.col("fenced") & F.col("bare").rlike(r"^[ \t]*\|")).cast("int")).alias("t"),
        F.max(F.col("fenced").cast("int")).alias("c"),
        F.sum(F.length("line")).alias("chars"),
    )
    each = each.filter("end_line is not null")
    return each.select("doc_id", "ord", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("title", F.lit("")).alias("title"), "start_line", "end_line", (F.col("t") == 1).alias("has_table"), (F.col("c") == 1).alias("has_code"), "chars", F.greatest(F.lit(1), F.floor(F.col("chars") / 4)).alias("tokens"))


def titles(notes: DataFrame, text: str = "note", path: str = "path") -> DataFrame:
    """CHK-9: (doc_id, doc_title): a title in the front matter, else the first heading of level 1, else the file's name without its suffix; empty if there is none of them."""
    front = F.regexp_extract(F.regexp_extract(text, FRONT, 0), r"(?m)^title:[ \t]*['\x22]?(.*?)['\x22]?[ \t\r]*$", 1)
    stem = F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*?)(?:\.[^./]*)?$", 1)
    first = headings(notes, text).filter("level = 1").groupBy("doc_id").agg(F.min_by("title", "pos").alias("first"))
    own = notes.select("doc_id", front.alias("front"), stem.alias("stem")).join(first, "doc_id", "left")
    return own.select("doc_id", F.coalesce(F.nullif("front", F.lit("")), "first", "stem").alias("doc_title"))


def located(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """CHK-12: chunks (doc_id, chunk_id, content, hint) with start, where the content stands in its document (doc_id, text) from 0: after the hint, else anywhere; null if it doesn't."""
    after, anywhere = F.expr("locate(content, text, greatest(hint, 0) + 1)"), F.expr("locate(content, text)")
    start = F.when(after > 0, after - 1).when(anywhere > 0, anywhere - 1)
    return chunks.join(texts, "doc_id").withColumn("start", start).drop("text")


# Below: what depends on the step before it, one document at a time.


def _stretches(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, line, fenced) of each line; a fence's own lines count as fenced."""
    out, inside, at = [], False, 0
    for line in text.splitlines(keepends=True):
        mark = re.match(FENCE, line) is not None
        out.append((at, at + len(line), line, inside or mark))
        inside ^= mark
        at += len(line)
    return out


def note_sections(text: str, levels: tuple[int, ...] = (2, 3)) -> list[tuple[int, int, str]]:
    """(start, end, breadcrumb) of the sections that open at headings of those levels, without blanks at their ends."""
    cuts, chain = [(0, "")], {}
    for start, _, line, fenced in _stretches(text):
        found = None if fenced else re.match(HEADING, line.rstrip("\n"))
        if found:
            level = len(found[1])
            chain = {k: v for k, v in chain.items() if k < level} | {level: line.strip()}
            if level in levels:
                cuts.append((start, " > ".join(chain[k] for k in sorted(chain))))
    ends = [start for start, _ in cuts[1:]] + [len(text)]
    out = []
    for (start, crumb), end in zip(cuts, ends, strict=True):
        body = text[start:end]
        if body.strip():
            first = start + len(body) - len(body.lstrip())
            out.append((first, first + len(body.strip()), crumb))
    return out


def blocks(body: str) -> list[tuple[int, int, str]]:
    """CHK-7: (start, end, kind) of the blocks between blank lines: fences stay whole, a table starts a block of its own; kinds are fence, table, list, quote and para."""
    groups: list[list[tuple[int, int, str, bool]]] = [[]]
    before = False
    for stretch in _stretches(body):
        _, _, line, fenced = stretch
        table = not fenced and re.match(r"[ \t]*\|", line) is not None
        opens = fenced and not before or table and groups[-1] and not re.match(r"[ \t]*\|", groups[-1][0][2])
        if not fenced and not line.strip():
            groups.append([])
        else:
            if opens and groups[-1]:
                groups.append([])
            groups[-1].append(stretch)
        before = fenced
    out = []
    for g in groups:
        if not g:
            continue
        start, end = g[0][0], g[-1][1]
        part = body[start:end]
        first = part.lstrip()
        kind = "fence" if g[0][3] else "table" if first[0] == "|" else "list" if re.match(r"(?:[-*+]|\d+[.)])[ \t]", first) else "quote" if first[0] == ">" else "para"
        out.append((start, start + len(part.rstrip()), kind))
    return out


def windows(start: int, end: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Overlapping windows over a stretch; the last one ends where it ends."""
    stride = size - overlap if size > overlap else size
    out = [(start, min(end, start + size))]
    while out[-1][1] < end:
        at = out[-1][0] + stride
        out.append((at, min(end, at + size)))
    return out


def packed(pieces: list[tuple[int, int]], budget: int, gap: int) -> list[list[tuple[int, int]]]:
    """Pieces in their order, as many together as fit, gap characters between them."""
    out: list[list[tuple[int, int]]] = []
    room = -1
    for a, b in pieces:
        if out and room >= gap + b - a:
            out[-1].append((a, b))
            room -= gap + b - a
        else:
            out.append([(a, b)])
            room = budget - (b - a)
    return out


def markdown_chunks(text: str, size: int = 1200, overlap: int = 200) -> list[tuple[int, int, str]]:
    """CHK-5, CHK-1: (start, end, content). Each section's breadcrumb comes before its parts; blocks are packed up to size, and blocks that are too long are cut: tables and fences between lines, others in overlapping windows. A text without headings is cut in windows."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    shift = len(text) - len(text.lstrip())
    bare = text.strip()
    if not any(not f and re.match(HEADING, line.rstrip("\n")) for _, _, line, f in _stretches(bare)):
        return [(shift + a, shift + b, bare[a:b]) for a, b in windows(0, len(bare), size, overlap)] if bare else []
    out = []
    for start, end, crumb in note_sections(bare):
        head = crumb + "\n\n" if crumb else ""
        if len(head) + end - start <= size:
            out.append((start, end, head + bare[start:end]))
            continue
        budget, waiting = max(1, size - len(head)), []

        def flush(out=out, waiting=waiting, head=head, budget=budget) -> None:
            for group in packed(waiting, budget, 2):
                out.append((group[0][0], group[-1][1], head + "\n\n".join(bare[a:b] for a, b in group)))
            waiting.clear()

        for a, b, kind in blocks(bare[start:end]):
            a, b = start + a, start + b
            if b - a <= budget:
                waiting.append((a, b))
                continue
            flush()
            if kind not in ("table", "fence"):
                out += [(x, y, head + bare[x:y]) for x, y in windows(a, b, budget, overlap)]
                continue
            rows = [(a + m.start(), a + m.end()) for m in re.finditer(r"[^\n]*", bare[a:b]) if m.end() > m.start() or bare[a + m.start() : a + m.start() + 1] == "\n"]
            short: list[tuple[int, int]] = []
            for x, y in [*rows, (b, b + budget + 1)]:
                if y - x <= budget:
                    short.append((x, y))
                    continue
                out += [(g[0][0], g[-1][1], head + "\n".join(bare[p:q] for p, q in g)) for g in packed(short, budget, 1)]
                short = []
                if x < b:
                    out += [(p, q, head + bare[p:q]) for p, q in windows(x, y, budget, overlap)]
        flush()
    return [(shift + a, shift + b, c) for a, b, c in out]


def chunk_notes(notes: DataFrame, text: str = "note", size: int = 1200, overlap: int = 200) -> DataFrame:
    """CHK-1, CHK-5: (chunk_id, doc_id, chunk_index, start_char, end_char, content) of each note; packing goes from block to block, so a document goes to an Arrow function, a batch of documents at a time. Null and blank texts have no chunks."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                x = whole.slice(at, 64)
                rows = [(d, k, *c) for d, t in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True) if t for k, c in enumerate(markdown_chunks(t, size, overlap))]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["doc_id", "chunk_index", "start_char", "end_char", "content"])

    own = notes.select(F.col("doc_id").cast("long"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, chunk_index int, start_char int, end_char int, content string")
    return own.select(chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "*")
