"""Chunks that follow a note's structure and never exceed a budget, in characters or in tokens.

Sections, paths and groups are windows over lines. A section goes to an Arrow function
that types its blocks and cuts what is too long; which small chunks are merged depends on
the chunk before, so a document's weights and paths, without texts, go to another; the
contents are put together in an aggregation.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.chunking import FENCE, HEADING
from corvane.operators.lists import each_list
from corvane.store import stored

if TYPE_CHECKING:
    import pyarrow as pa

# What a list's item, a table's row, a quote and a document's header look like, and where a cell may be cut, best first.
ITEM, ROW, QUOTE = r"([ \t]*)(?:[-*+]|\d{1,9}[.)])[ \t]+\S", r"[ \t]*\|", r"[ \t]{0,3}>"
HEADER = r"^\s*\[Document: .*\]\s*$"
BREAKS = (re.compile(r"(?i)<br\s*/?>"), re.compile(r"(?<=[.!?])\s+"), re.compile(r"\s+"))
MARKS = re.compile(r"\\.|(?<!`)(?P<tick>`+)(?!`)(?P<code>.*?)(?<!`)(?P=tick)(?!`)|(?P<pipe>\|)", re.S)


@dataclass(frozen=True)
class Measure:
    """How long a text is (CHK-11): prefix gives the weight before each of its offsets, room the weight that a budget allows.

    So the weight of a stretch is a difference, and the longest stretch within a budget a
    binary search; nothing is counted again at each try. slack is what a stretch may weigh
    more than the difference says (a token cut in two).
    """

    prefix: Callable[[str], Sequence[int]]
    room: Callable[[int], int]
    slack: int = 0

    def weight(self, text: str) -> int:
        return self.prefix(text)[len(text)] + self.slack if text else 0


#: Characters, and TXT-30's tokens: a quarter of the characters.
CHARS = Measure(lambda text: range(len(text) + 1), lambda budget: budget)
ESTIMATE = Measure(lambda text: range(len(text) + 1), lambda budget: 4 * budget + 3)


def spans_of(pattern: str, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(pattern, text)]


def line_spans(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def typed_blocks(body: str, front: bool = False) -> list[tuple[int, int, str]]:
    """CHK-7: (start, end, kind) of a body's blocks: fence, yaml, table, list, quote and para.

    Fences are whole, tables are runs of rows. A list goes on over blank lines with items
    and indented lines, and takes a paragraph before it that ends with a colon; plain
    lines right after a quote belong to it. front: the body may start with front matter.
    """
    out: list[list] = []
    closing, gap = None, False
    spans = line_spans(body)
    for n, (start, end) in enumerate(spans):
        line = body[start:end].rstrip("\r")
        end = start + len(line)
        if closing:
            out[-1][1] = end
            if re.match(closing, line):
                closing = None
        elif not line.strip():
            gap = True
            continue
        elif re.match(FENCE, line):
            out.append([start, end, "fence"])
            closing = FENCE
        elif front and not out and line.strip() == "---" and any(body[a:b].strip() == "---" for a, b in spans[n + 1 :]):
            out.append([start, end, "yaml"])
            closing = r"\s*---\s*$"
        else:
            own = "table" if re.match(ROW, line) else "list" if re.match(ITEM, line) else "quote" if re.match(QUOTE, line) else "para"
            last = out[-1][2] if out else ""
            goes_on = last == "list" and (own == "list" or line[0] in " \t") or not gap and (own == last or own == "para" and last == "quote")
            if goes_on:
                out[-1][1] = end
            else:
                led = own == "list" and last == "para" and body[out[-1][0] : out[-1][1]].rstrip().endswith(":")
                out.append([out.pop()[0] if led else start, end, own])
        gap = False
    trimmed = [(a + len(body[a:b]) - len(body[a:b].lstrip()), a + len(body[a:b].rstrip()), kind) for a, b, kind in out]
    return [x for x in trimmed if x[0] < x[1]]


def hard_split(text: str, room: int, m: Measure) -> list[tuple[int, int]]:
    """CHK-8a: spans of at most that weight, without blanks lost or overlaps: the longest one by binary search in the prefix sums, cut after its last blank if that lies past its middle."""
    sums, at, out = m.prefix(text), 0, []
    while at < len(text):
        end = max(at + 1, bisect_right(sums, sums[at] + max(0, room - m.slack), at + 1, len(text) + 1) - 1)
        if end < len(text):
            blank = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = blank + 1 if blank > at + (end - at) // 2 else end
        out.append((at, end))
        at = end
    return out


def cells_of(row: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The cells of a table row, and the row's code spans: pipes within those, or behind a backslash, are text."""
    pipes, code = [], []
    for x in MARKS.finditer(row):
        if x["pipe"]:
            pipes.append(x.start())
        elif x["tick"]:
            code.append(x.span())
    edges = [-1, *pipes, len(row)]
    cells = [row[a + 1 : b].strip() for a, b in zip(edges, edges[1:], strict=False)]
    return cells[bool(pipes) and not cells[0] : len(cells) - (len(pipes) > 1 and not cells[-1])], code


def cell_parts(value: str, room: int, m: Measure) -> list[str]:
    """Parts of a cell within that weight, cut after a line break, else a sentence, else a blank; never in a code span, unless one alone is too long."""
    sums, at, out = m.prefix(value), 0, []
    code = cells_of(value)[1]
    inside = lambda k: next((s for s in code if s[0] < k < s[1]), None)
    breaks = [[e for _, e in (x.span() for x in pattern.finditer(value)) if not inside(e)] for pattern in BREAKS]
    while at < len(value):
        end = max(at + 1, bisect_right(sums, sums[at] + max(0, room - m.slack), at + 1, len(value) + 1) - 1)
        if end < len(value):
            best = next((found[k - 1] for found in breaks if (k := bisect_right(found, end)) and found[k - 1] > at), None)
            held = inside(end)
            end = best or (held[0] if held and held[0] > at else end)
        out.append(value[at:end])
        at = end
    return out


def row_parts(row: str, head: str, room: int, m: Measure) -> list[str]:
    """CHK-8b: a row too long for the room as several, each with the header and the row's first cell; the header goes if both take more than half of the room, then the first cell likewise."""
    cells, _ = cells_of(row)
    said = lambda values: "| " + " | ".join(values) + " |"
    key = cells[0] if len(cells) > 1 else ""
    frame = lambda: m.weight(said([key, *[""] * (len(cells) - 1)])) + (m.weight(head + "\n") if head else 0)
    if head and frame() > room // 2:
        head = ""
    if key and frame() > room // 2:
        key = ""
    if frame() > room // 2:  # so many cells that empty ones leave no room
        return [row[a:b] for a, b in hard_split(row, room, m)]
    free, out, current, used = room - frame(), [], {}, 0
    for k, value in enumerate(cells):
        if k == 0 and key or not value:
            continue
        parts = [value] if m.weight(value) <= free else cell_parts(value, free, m)
        for part in parts:
            if used + m.weight(part) > free or len(parts) > 1:
                out, current, used = [*out, current], {}, 0
            current, used = current | {k: part}, used + m.weight(part)
    filled = [x for x in [*out, current] if x]
    return [(head + "\n" if head else "") + said([key if k == 0 and key else x.get(k, "") for k in range(len(cells))]) for x in filled]


def units_of(text: str, kind: str) -> tuple[str, str, list[tuple[int, int]]]:
    """What each piece of a long block repeats at its head and its tail, and the spans that are dealt to the pieces: rows, lines, items or sentences."""
    rows = line_spans(text)
    if kind == "table" and len(rows) > 2 and re.fullmatch(r"[ \t|:\-]*-[ \t|:\-]*", text[slice(*rows[1])]):
        return text[: rows[1][1]], "", rows[2:]
    if kind == "fence" and len(rows) > 2:
        closed = re.match(FENCE, text[slice(*rows[-1])]) is not None
        return text[: rows[0][1]], text[slice(*rows[-1])] if closed else "", rows[1 : len(rows) - closed]
    if kind == "list" and (items := [(a, len(x[1])) for a, b in rows if (x := re.match(ITEM, text[a:b]))]):
        top = min(indent for _, indent in items)
        starts = [a for a, indent in items if indent == top]
        return text[: starts[0]].strip(), "", [(a, a + len(text[a:b].rstrip())) for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
    if kind == "para":
        ends = [0, *(x.end() for x in BREAKS[1].finditer(text)), len(text)]
        return "", "", [(a, a + len(text[a:b].rstrip())) for a, b in zip(ends, ends[1:], strict=False) if a < b]
    return "", "", rows


def block_parts(text: str, kind: str, room: int, m: Measure) -> list[tuple[int, int, str]]:
    """CHK-8c: (start, end, said) of the pieces of a block that is longer than the room, each within it: as many units together as fit; fences rather end at a blank line."""
    head, tail, units = units_of(text, kind)
    wrap = sum(m.weight(x + "\n") for x in (head, tail) if x)
    if wrap > room // 2:
        head, tail, wrap, units = "", "", 0, line_spans(text)
    inner, sums = room - wrap, m.prefix(text)
    groups: list[list[tuple[int, int]]] = []
    for a, b in units:
        if groups and sums[b] - sums[groups[-1][0][0]] + m.slack <= inner:
            groups[-1].append((a, b))
            continue
        carried: list[tuple[int, int]] = []
        if groups and kind == "fence":
            blank = max((k for k, (x, y) in enumerate(groups[-1]) if k and not text[x:y].strip()), default=0)
            if blank and (rest := groups[-1][blank + 1 :]) and sums[b] - sums[rest[0][0]] + m.slack <= inner:
                groups[-1], carried = groups[-1][:blank], rest
        groups.append([*carried, (a, b)])
    said, out, bare_head = lambda body: "\n".join(x for x in (head, body, tail) if x), [], []
    for group in groups:
        filled = [u for u in group if text[slice(*u)].strip()]
        if not filled:
            continue
        a, b = filled[0][0], filled[-1][1]
        if sums[b] - sums[a] + m.slack <= inner:
            out.append((a, b, said(text[a:b])))
        elif kind == "table":
            parts = row_parts(text[a:b], head, room, m)
            if head and not bare_head and not parts[0].startswith(head):  # a header too wide to be repeated is said once
                bare_head = [(x, y, head[x:y]) for x, y in hard_split(head, room, m) if head[x:y].strip()]
            out += [(a, b, part) for part in parts]
        else:
            out += [(a + x, a + y, said(text[a + x : a + y].strip("\n"))) for x, y in hard_split(text[a:b], inner, m) if text[a + x : a + y].strip()]
    return bare_head + out


def section_parts(body: str, prefix: str, head: str, room: int, m: Measure, front: bool) -> list[tuple[int, int, int, int, str]]:
    """CHK-8: (start, end, part, parts, text) of a section, each text within the room beside the prefix; blocks are whole where they fit, those that don't are cut and numbered.

    head is put in as a first block, at no place of the body. parts is 1 for what isn't cut.
    """
    inner = room - (m.weight(prefix + "\n\n") if prefix else 0)
    blocks = [(a, b, kind, body[a:b]) for a, b, kind in typed_blocks(body, front)]
    blocks = [(0, 0, "para", head)] * bool(head) + blocks
    whole = "\n\n".join(text for *_, text in blocks)
    if not blocks or m.weight(whole) <= inner:
        return [(blocks[0][0], blocks[-1][1], 1, 1, whole)] if blocks else [(0, 0, 1, 1, "")]
    out, waiting = [], []
    for a, b, kind, text in [*blocks, (0, 0, "", "")]:
        together = "\n\n".join([*(x[2] for x in waiting), text])
        if waiting and (not kind or m.weight(together) > inner):
            out.append((waiting[0][0], waiting[-1][1], 1, 1, "\n\n".join(x[2] for x in waiting)))
            waiting = []
        if kind and m.weight(text) > inner:
            cut = block_parts(text, kind, inner, m)
            out += [(a + x if b else 0, a + y if b else 0, k, len(cut), part) for k, (x, y, part) in enumerate(cut, 1)]
        elif kind:
            waiting.append((a, b, text))
    return out


def section_rows(notes: DataFrame, text: str = "note") -> DataFrame:
    """(doc_id, ord, level, head, path, titles, body, start, below): the sections of each note, by windows within a document.

    ord 0 is the part before the first heading, ord -1 the front matter and headers that
    lead the note. path has the heading lines in effect, titles their titles; start is the
    body's offset, below the level of the next section.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    whole = Window.partitionBy("doc_id")
    own = notes.select(F.col("doc_id").cast("long"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    bare = F.regexp_replace("line", "\r$", "")
    start = F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.withColumns({"bare": bare, "start": start, "rule": F.trim(bare) == "---", "plain": ~bare.rlike(HEADER) & (F.trim(bare) != "")})
    own = own.withColumn("rules", F.sum(F.col("rule").cast("int")).over(w))
    first, last = (F.min(F.when(F.col("rule") & (F.col("rules") == k), F.col("pos"))).over(whole) for k in (1, 2))
    other = F.min(F.when(F.col("plain") & ~F.col("rule"), F.col("pos"))).over(whole)
    own = own.withColumns({"first": first, "last": last, "other": other})
    yaml = F.coalesce(F.col("pos").between(F.col("first"), F.col("last")) & (F.col("other").isNull() | (F.col("first") < F.col("other"))), F.lit(False))
    content = F.min(F.when(F.col("plain") & ~yaml, F.col("pos"))).over(whole)
    own = own.withColumn("meta", F.coalesce(F.col("pos") < content, F.lit(True)))
    mark = ~F.col("meta") & F.col("bare").rlike(FENCE)
    own = own.withColumn("fenced", mark | (F.sum(mark.cast("int")).over(w) % 2 == 1))
    own = own.withColumn("is_head", ~F.col("meta") & ~F.col("fenced") & F.col("bare").rlike(HEADING))
    own = own.withColumn("ord", F.when(F.col("meta"), -1).otherwise(F.sum(F.col("is_head").cast("int")).over(w)).cast("int"))
    head = F.max(F.when(F.col("is_head"), F.trim("bare")))
    lines = F.sort_array(F.collect_list(F.when(~F.col("is_head"), F.struct("pos", "line"))))
    each = own.groupBy("doc_id", "ord").agg(head.alias("head"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("body"), F.coalesce(F.min(F.when(~F.col("is_head"), F.col("start"))), F.min("start")).alias("start"))
    each = each.withColumns({"head": F.coalesce("head", F.lit("")), "level": F.length(F.regexp_extract("head", HEADING, 1)), "title": F.regexp_extract("head", HEADING, 2)})
    by = Window.partitionBy("doc_id").orderBy("ord")
    up_to = by.rowsBetween(Window.unboundedPreceding, 0)
    seen = {k: F.last(F.when(F.col("level") == k, F.struct("ord", "head", "title")), ignorenulls=True).over(up_to) for k in range(1, 7)}
    each = each.withColumns({f"l{k}": c for k, c in seen.items()} | {"below": F.lead("level").over(by)})
    parts, above = [], F.lit(-1)
    for k in range(1, 7):
        at = F.coalesce(F.col(f"l{k}.ord"), F.lit(-1))
        parts.append(F.when((at > above) & (F.col("ord") > 0), F.col(f"l{k}")))
        above = F.greatest(above, at)
    kept = F.filter(F.array(*parts), lambda x: x.isNotNull())
    each = each.withColumn("chain", kept)
    return each.select("doc_id", "ord", "level", "head", F.transform("chain", lambda x: x["head"]).alias("path"), F.transform("chain", lambda x: x["title"]).alias("titles"), "body", "start", "below")


def stored_sections(notes: DataFrame, text: str = "note") -> DataFrame:
    """The rows of section_rows(), stored: pieces and groups are made of them, by more than one chunker if need be."""
    return stored(section_rows(notes, text), "sections")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """So many rows of a batch at a time, so that what a task makes of them doesn't grow with the batch."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


PIECES = "doc_id long, ord int, k int, part int, parts int, start long, end long, prefix string, body string, skip int, weight long, bare_weight long"


def _pieces(sections: DataFrame, room: int, m: Measure) -> DataFrame:
    """Sections with prefix and first (a block of its own at the start, or empty) as pieces within the room. A prefix heavier than half of it is left out, and the heading's line then becomes a block."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in sliced(batches):
            out = []
            for r in x.to_pylist():
                prefix, first = r["prefix"], r["first"]
                if prefix and m.weight(prefix + "\n\n") > room // 2:
                    prefix, first = "", first or r["head"]
                for k, (a, b, part, parts, text) in enumerate(section_parts(r["body"], prefix, first, room, m, r["ord"] < 0)):
                    if not text and not prefix:
                        continue
                    skip = len(r["first"]) + 2 if k == 0 and parts == 1 and r["first"] and text.startswith(r["first"] + "\n\n") else 0
                    bare = m.weight(text[skip:])
                    place = {"start": r["start"] + a, "end": r["start"] + b} if r["start"] is not None else {"start": None, "end": None}
                    weight = m.weight(f"{prefix}\n\n{text}" if prefix and text else prefix or text)
                    out.append({c: r[c] for c in ("doc_id", "ord")} | {"k": k, "part": part, "parts": parts, "prefix": prefix, "body": text, "skip": skip, "weight": weight, "bare_weight": bare} | place)
            yield pa.RecordBatch.from_pylist(out, schema)

    return sections.select("doc_id", "ord", "prefix", "first", "head", "body", "start").mapInArrow(run, PIECES)


def _put_together(pieces: DataFrame, runs: DataFrame) -> DataFrame:
    """Chunks of the pieces that runs (doc_id, ord, k, chunk, lead) put together: the first as it is, each other behind its lead."""
    # skip: the heading's line, for which the lead stands
    first = F.concat_ws("\n\n", F.filter(F.array("prefix", "body"), lambda x: x != ""))
    later = F.concat_ws("\n\n", F.filter(F.array("lead", F.substring("body", F.col("skip") + 1, F.length("body"))), lambda x: x != ""))
    each = pieces.join(runs, ["doc_id", "ord", "k"])
    rows = each.groupBy("doc_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("ord", "k", first.alias("first"), later.alias("later"), "prefix", "part", "parts", "start", "end"))).alias("x"))
    shown = F.filter("x", lambda x: x["ord"] >= 0)
    content = F.array_join(F.transform("x", lambda x, i: F.when(i == 0, x["first"]).otherwise(x["later"])), "\n\n")
    main = F.element_at(F.when(F.size(shown) > 0, shown).otherwise(F.col("x")), 1)
    members = F.transform(shown, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return rows.select(
        "doc_id", F.col("chunk").alias("chunk_index"), main["prefix"].alias("breadcrumb"), main["part"].alias("part"), main["parts"].alias("parts"),
        F.array_min(F.transform("x", lambda x: x["start"])).alias("start_char"), F.array_max(F.transform("x", lambda x: x["end"])).alias("end_char"), content.alias("content"), members.alias("members"),
    )


def structured_chunks(notes: DataFrame, budget: int, measure: Measure = CHARS, least: int = 0, text: str = "note", sections: DataFrame | None = None) -> DataFrame:
    """CHK-8, 8d: (doc_id, chunk_index, breadcrumb, part, parts, start_char, end_char, content, members) of each note; no content exceeds the budget.

    Each section's chunks begin with its heading lines, joined by " > ". Headings that only
    lead to a deeper one have no chunk of their own. Blocks are whole where they fit; a
    longer one is cut by its rows, lines, items or sentences, numbered part of parts. What
    leads a note (front matter, document headers) joins its first chunk if both fit, else
    it has chunks of its own. With least, neighbours of one top-level section of which one
    weighs less than that are merged while they fit; pieces of a cut block never are.
    members has the places of what is in a chunk. Null and blank notes have no chunks. One
    row of notes for each doc_id. sections: what stored_sections() gave for the notes.
    """
    room, m = measure.room(budget), measure
    small = measure.room(least) if least else 0
    if budget <= 0 or room < 8:
        raise ValueError("the budget has to allow 8 at least")
    rows = stored_sections(notes, text) if sections is None else sections
    leads = (F.col("ord") > 0) & (F.trim("body") == "") & (F.coalesce("below", F.lit(0)) > F.col("level"))
    rows = rows.withColumns({"prefix": F.array_join("path", " > "), "first": F.lit("")}).filter(~leads & ((F.col("ord") > 0) | (F.regexp_replace("body", r"\s", "") != "")))
    whole, after = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("ord").rowsBetween(0, Window.unboundedFollowing)
    roots = F.size(F.collect_set(F.get("path", F.lit(0))).over(whole))  # with one root, its children name the groups
    own = F.when(roots == 1, F.get("path", F.lit(1))).otherwise(F.get("path", F.lit(0)))
    groups = rows.select("doc_id", "ord", "path", F.first(own, ignorenulls=True).over(after).alias("group"))
    pieces = stored(_pieces(rows, room, m), "pieces")

    def decide(listed: list[dict]) -> list[dict]:
        out, cur, chunk = [], None, -1
        for r in listed:
            same = 0 if cur is None else next((k for k, (a, b) in enumerate(zip(cur["path"], r["path"], strict=False)) if a != b), min(len(cur["path"]), len(r["path"])))
            lead = " > ".join(r["path"][same:])
            follow = m.weight("\n\n") + r["bare_weight"] + (m.weight(lead) + m.weight("\n\n") if lead and r["bare_weight"] else m.weight(lead))
            meta = cur is not None and cur["ord"] < 0 and cur["parts"] == 1
            apart = cur is None or cur["parts"] > 1 or r["parts"] > 1 or r["group"] != cur["group"] or min(cur["weight"], r["weight"]) >= small
            if cur is not None and (meta or not apart and cur["ord"] >= 0) and cur["weight"] + follow <= room:
                cur = r | {"weight": cur["weight"] + follow}
            else:
                cur, chunk, lead = dict(r), chunk + 1, ""
            out.append({"ord": r["ord"], "k": r["k"], "chunk": chunk, "lead": lead})
        return out

    listed = pieces.select("doc_id", "ord", "k", "part", "parts", "weight", "bare_weight").join(groups, ["doc_id", "ord"])
    runs = each_list(listed, "doc_id", ["ord", "k", "parts", "weight", "bare_weight", "path", "group"], decide, "doc_id long, ord int, k int, chunk int, lead string")
    return _put_together(pieces, runs)


def section_chunks(notes: DataFrame, budget: int, measure: Measure = CHARS, least: int = 0, text: str = "note", sections: DataFrame | None = None) -> DataFrame:
    """CHK-10: the same columns; one chunk for each section that fits, behind its path [A > B] and its heading's line.

    A section whose body weighs less than least joins the chunk before, behind its title in
    brackets, if both fit and their paths agree: the same section, a deeper one, or the
    next sibling of the chunk's first. A longer section is cut at its blocks, every part
    behind the path; a block too long is cut like in structured_chunks() and numbered.
    """
    room, m = measure.room(budget), measure
    small = measure.room(least) if least else 0
    if budget <= 0 or room < 8:
        raise ValueError("the budget has to allow 8 at least")
    rows = stored_sections(notes, text) if sections is None else sections
    prefix = F.when(F.size("titles") > 0, F.concat(F.lit("["), F.array_join("titles", " > "), F.lit("]"))).otherwise("")
    rows = rows.withColumns({"prefix": prefix, "first": F.col("head")}).filter((F.col("ord") > 0) | (F.regexp_replace("body", r"\s", "") != ""))
    bare = F.regexp_replace("body", r"^\s+|\s+$", "")
    titles = rows.select("doc_id", "ord", "titles", F.length("head").alias("head_chars"), (bare == "").alias("empty"))
    pieces = stored(_pieces(rows, room, m), "pieces")

    def decide(listed: list[dict]) -> list[dict]:
        out, cur, chunk = [], None, -1
        for r in listed:
            title = f"[{r['titles'][-1]}]" if r["titles"] else ""
            follow = m.weight("\n\n") * 2 + m.weight(title) + r["bare_weight"]
            old = cur["titles"] if cur else []
            agree = not old or not r["titles"] or r["titles"][: len(old)] == old or r["titles"][:-1] == old[:-1]
            tiny = r["ord"] > 0 and r["pieces"] == 1 and r["parts"] == 1 and not r["empty"] and r["bare_weight"] < small
            if cur is not None and tiny and cur["parts"] == 1 and agree and cur["weight"] + follow <= room:
                cur["weight"] += follow
            else:
                cur, chunk, title = dict(r), chunk + 1, ""
            out.append({"ord": r["ord"], "k": r["k"], "chunk": chunk, "lead": title})
        return out

    count = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "ord"))
    listed = pieces.select("doc_id", "ord", "k", "parts", "weight", "bare_weight", count.alias("pieces")).join(titles, ["doc_id", "ord"])
    runs = each_list(listed, "doc_id", ["ord", "k", "parts", "weight", "bare_weight", "pieces", "titles", "empty"], decide, "doc_id long, ord int, k int, chunk int, lead string")
    return _put_together(pieces, runs)


def hard_spans(texts: DataFrame, budget: int, measure: Measure = CHARS, text: str = "text") -> DataFrame:
    """CHK-8a for whole texts: (doc_id, n, start, end), spans within the budget; null and empty texts have none."""
    import pyarrow as pa

    room = measure.room(budget)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in sliced(batches):
            rows = [(d, n, a, b) for d, t in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True) if t for n, (a, b) in enumerate(hard_split(t, room, measure))]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "n", "start", "end"])

    return texts.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, "doc_id long, n int, start long, end long")


def table_parts(rows: DataFrame, header: Column, budget: int, measure: Measure = CHARS) -> DataFrame:
    """CHK-8b for a table of rows (doc_id, row): (doc_id, n, said), each row and its header within the budget, split where it isn't."""
    import pyarrow as pa

    room = measure.room(budget)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in sliced(batches):
            out = []
            for d, row, head in zip(*(x.column(k).to_pylist() for k in range(3)), strict=True):
                if row is not None:
                    one = f"{head}\n{row}"
                    out += [(d, n, said) for n, said in enumerate([one] if measure.weight(one) <= room else row_parts(row, head, room, measure))]
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string()), strict=True)], ["doc_id", "n", "said"])

    return rows.select(F.col("doc_id").cast("long"), "row", header.alias("head")).mapInArrow(run, "doc_id long, n int, said string")
