"""Text functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of an identifier run, those stripped at its edges, the shapes of identifiers.
RUN = r"[A-Za-z0-9_\-:./]+"
EDGE = r"^[_\-:./]+|[_\-:./]+$"
PARTS = r"[_\-:./ ]+"
CAMEL = "[a-z0-9][A-Z]"
PREFIXED = "^[A-Za-z][A-Za-z0-9]*:[0-9A-Za-z]{4,}$"
BLANK = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"
CYRILLIC = r"[\x{0400}-\x{052F}]"
# Dates in headers and front matter, front matter itself, a header's line.
HEADER_DATE = r"\[Document:[^|]*\|\s*Section:[^|]*\|\s*Date:\s*([0-9]{4}-[0-9]{2}-[0-9]{2}|unknown)\s*\]"
FRONT_DATE = r"(?m)^(?:date|updated|last_updated):\s*['\x22]?([0-9]{4}-[0-9]{2}-[0-9]{2})"
FRONT = r"^[ \t\r]*---[ \t\r]*\n(?:[^\n]*\n){0,198}?[ \t\r]*---[ \t\r]*(?:\n|$)"
HEADER_LINE = r"(?m)^\[Document: [^\n]*\| Date: [^\n]*\]\n\n"
# What says of itself that it is out of date.
MARKER = r"(?i)^\s*[-–—]*\s*(?:DEPRECATED|OBSOLETE|RETRACTED|SUPERSEDED)\b"
SELF = r"(?i)\*\*THIS (?:MEMORY|DOCUMENT|NOTE) IS (?:DEPRECATED|OBSOLETE|SUPERSEDED)\b"
# The sections of root folders.
SECTIONS = {".session": "session", ".reports": "report", ".plans": "plan", "docs": "docs", "memory": "memory"}
# Words that are no terms, in text, in literal searches and as keywords.
STOP = [
    "the", "what", "which", "who", "how", "why", "when", "where", "and", "for", "with", "that", "this", "from",
    "into", "about", "than", "were", "was", "are", "does", "did", "has", "have", "had", "its", "their", "there",
    "then", "them", "these", "those", "been", "being", "over", "under", "still", "also", "used", "use", "using",
    "value", "should",
]
GREP_STOP = [
    "what", "how", "when", "where", "which", "does", "procedure", "team", "describe", "explain", "show", "list",
    "about", "standard", "used", "from", "with", "for",
]
KEYWORD_STOP = [
    "this", "that", "with", "from", "have", "will", "should", "would",
]


def identifier_runs(text: Column) -> Column:
    """Runs of identifier characters, stripped at their edges, in their order."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda r: F.when(r.rlike(r"^[_\-:./]|[_\-:./]$"), F.regexp_replace(r, EDGE, "")).otherwise(r))
    return F.filter(runs, lambda r: r != "")


def identifier_tokens(text: Column) -> Column:
    """TXT-1: each run of identifier characters in lower case, then its parts if they differ from it. Plain words, which have no parts, take the short way."""

    def expand(run: Column) -> Column:
        whole = F.lower(run)
        parts = F.transform(F.split(F.regexp_replace(run, "([a-z0-9])([A-Z])", "$1 $2"), PARTS), F.lower)
        return F.when(run.rlike(r"[_\-:./]|[a-z0-9][A-Z]"), F.concat(F.array(whole), F.filter(parts, lambda p: (p != "") & (p != whole)))).otherwise(F.array(whole))

    return F.flatten(F.transform(identifier_runs(text), expand))


def is_identifier(token: Column) -> Column:
    """TXT-2: whether a token has the shape of a code identifier."""
    mixed = token.rlike("^[A-Za-z0-9]{3,}$") & token.rlike("[A-Za-z]") & token.rlike("[0-9]")
    return token.rlike(PREFIXED) | (F.contains(token, F.lit("_")) & token.rlike("[^_]")) | token.rlike(CAMEL) | mixed


def collapsed(text: Column) -> Column:
    """TXT-5: runs of blanks become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANK, " "))


def language(text: Column) -> Column:
    """TXT-6: ru if a quarter of the Latin and Cyrillic letters are Cyrillic, or there are three Cyrillic words; else en."""
    cyrillic, latin = F.regexp_count(text, F.lit(CYRILLIC)), F.regexp_count(text, F.lit("[A-Za-z]"))
    share = F.when(cyrillic + latin > 0, cyrillic / (cyrillic + latin) >= 0.25).otherwise(False)
    return F.when(share | (F.regexp_count(text, F.lit(CYRILLIC + "+")) >= 3), "ru").otherwise("en")


def source_header(name: Column, section: Column, date: Column) -> Column:
    """TXT-7: the attribution header and the empty line after it."""
    return F.concat(F.lit("[Document: "), name, F.lit(" | Section: "), section, F.lit(" | Date: "), F.coalesce(date, F.lit("unknown")), F.lit("]\n\n"))


def front_matter(content: Column) -> Column:
    """The YAML block at the start, fences and line end included, if it closes within 200 lines; else empty."""
    return F.regexp_extract(content, FRONT, 0)


def with_header(content: Column, header: Column) -> Column:
    """TXT-8: the header after the front matter, or before everything."""
    front = front_matter(content)
    body = F.ltrim(F.substring(content, F.length(front) + 1, F.length(content)), F.lit("\n"))
    return F.when(front == "", F.concat(header, content)).otherwise(F.concat(front, F.when(front.endswith("\n"), "").otherwise("\n"), F.lit("\n"), header, body))


def section_of(root: Column, kind: Column) -> Column:
    """TXT-9: the section that a root folder's name stands for; otherwise code for Python files and docs for the rest."""
    found = F.coalesce(*(F.when(root == name, section) for name, section in SECTIONS.items()))
    return F.coalesce(found, F.when(kind == "python", "code").otherwise("docs"))


def header_line(content: Column) -> Column:
    return F.regexp_extract(F.left(content, F.lit(4000)), HEADER_LINE, 0)


def without_header(content: Column) -> Column:
    """TXT-11: (body, header_line, header_lines): the text without its header, the header's line from 1 (0: none), and how many lines it took."""
    head = header_line(content)
    at = F.position(head, content)
    body = F.when(head == "", content).otherwise(F.concat(F.left(content, at - 1), F.substring(content, at + F.length(head), F.length(content))))
    line = F.when(head == "", 0).otherwise(F.regexp_count(F.left(content, at - 1), F.lit("\n")) + 1)
    return F.struct(body.alias("body"), line.alias("header_line"), F.when(head == "", 0).otherwise(2).alias("header_lines"))


def source_line(line: Column, header: Column, lines: Column) -> Column:
    """TXT-11: a line of the text with its header, as a line of the file without."""
    return F.when((lines == 0) | (line <= header), line).when(line < header + lines, header).otherwise(line - lines)


def chunk_date(content: Column) -> Column:
    """TXT-12: the header's date (unknown: none), else the front matter's; in the first 2000 characters."""
    zone = F.left(content, F.lit(2000))
    head = F.regexp_extract(zone, HEADER_DATE, 1)
    return F.when(head != "", F.try_to_date(head, "yyyy-MM-dd")).otherwise(F.try_to_date(F.regexp_extract(zone, FRONT_DATE, 1), "yyyy-MM-dd"))


def ranking_date(content: Column, path: Column) -> Column:
    """TXT-13: the header's date in the first 600 characters, else the one in the file's name."""
    head = F.try_to_date(F.regexp_extract(F.left(content, F.lit(600)), r"Date:\s*([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd")
    return F.coalesce(head, F.try_to_date(F.regexp_extract(basename(path), "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd"))


def is_deprecated(content: Column) -> Column:
    """TXT-14: whether a text declares itself stale, by the start of its name field or in bold; in the first 1500 characters."""
    zone = F.left(content, F.lit(1500))
    return F.trim(F.regexp_extract(zone, r"(?m)^name:\s*(.+)$", 1)).rlike(MARKER) | zone.rlike(SELF)


def breadcrumb(content: Column) -> Column:
    """TXT-15: what comes before the first empty line, if it is a heading; else empty."""
    first = F.trim(F.when(F.contains(content, F.lit("\n\n")), F.substring_index(content, "\n\n", 1)).otherwise(""))
    return F.when(first.rlike(r"^#{1,6}\s"), first).otherwise("")


def on_word(text: Column, size: int) -> Column:
    """TXT-16: cut to so many characters, not inside a word, with an ellipsis."""
    cut = F.left(text, F.lit(size))
    kept = F.regexp_extract(cut, r"(?s)^(.+) [^ ]*$", 1)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.regexp_replace(F.when(kept != "", kept).otherwise(cut), r"[\s]+$", ""), F.lit("…")))


def on_line(text: Column, size: int, mark: str = "…[truncated]") -> Column:
    """TXT-16: cut to so many characters, the mark included, at the end of a line, else of a word."""
    cut = F.left(text, F.lit(max(0, size - len(mark))))
    line, word = F.regexp_extract(cut, r"(?s)^(.+)\n[^\n]*$", 1), F.regexp_extract(cut, r"(?s)^(.+) [^ ]*$", 1)
    kept = F.when(line != "", line).when(word != "", word).otherwise(cut)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.regexp_replace(kept, r"[\s]+$", ""), F.lit(mark)))


def snippet(text: Column, size: int = 240) -> Column:
    """TXT-17: stripped, cut, with an ellipsis."""
    plain = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.length(plain) <= size, plain).otherwise(F.concat(F.regexp_replace(F.left(plain, F.lit(size)), r"\s+$", ""), F.lit("…")))


def one_description(text: Column, size: int = 400) -> Column:
    """TXT-18: the distinct parts between separators, in their order, joined by a bar and cut on a word."""
    parts = F.array_distinct(F.filter(F.transform(F.split(text, "<SEP>"), lambda p: F.trim(p)), lambda p: p != ""))
    return on_word(F.when(F.contains(text, F.lit("<SEP>")), F.array_join(parts, " | ")).otherwise(text), size)


def content_terms(question: Column) -> Column:
    """TXT-19: distinct words of four characters or more, in lower case, that are neither stop words nor identifiers."""
    words = F.transform(F.regexp_extract_all(question, F.lit("[A-Za-z][A-Za-z0-9_]{3,}"), F.lit(0)), F.lower)
    named = F.transform(F.filter(identifier_runs(question), is_identifier), F.lower)
    return F.array_distinct(F.array_except(words, F.array_union(named, F.array(*map(F.lit, STOP)))))


def overlap(text: Column, terms: Column) -> Column:
    """TXT-20: the share of the terms that the lower-case text contains; 0 without terms."""
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.filter(terms, lambda t: F.contains(text, t))) / F.size(terms))


def heading_depth(content: Column, path: Column | None = None) -> Column:
    """TXT-21: the number of headings on the path (an array), else the depth of the heading in the first line, else 0."""
    own = F.length(F.regexp_extract(content, r"^(#{1,6})\s", 1))
    return own if path is None else F.when(F.size(F.coalesce(path, F.array())) > 0, F.size(path)).otherwise(own)


def is_code(content: Column) -> Column:
    """TXT-22: whether three tenths of a text lie in fences, or it has twenty backticks."""
    plain = F.length(F.regexp_replace(content, r"(?s)```.*?```", ""))
    fenced = F.length(content) - plain
    return F.when(F.length(content) == 0, False).otherwise((fenced / F.length(content) >= 0.3) | (F.regexp_count(content, F.lit("`")) >= 20))


def keywords(text: Column, most: int = 5) -> Column:
    """TXT-23: the first distinct words of four characters or more that aren't stop words, joined by spaces; of a word's spellings the first."""
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9_.:/-]{2,}"), F.lit(0)), lambda w: F.regexp_replace(w, r"[.,:;()\[\]{}]+$", ""))
    good = F.filter(words, lambda w: (F.length(w) >= 4) & ~F.lower(w).isin(KEYWORD_STOP))
    first = F.slice(F.array_distinct(F.transform(good, F.lower)), 1, most)
    # the spelling of a word's first occurrence
    return F.array_join(F.transform(first, lambda low: F.element_at(F.filter(good, lambda w: F.lower(w) == low), 1)), " ")


def jaccard(a: Column, b: Column) -> Column:
    """TXT-25: the shared part of two arrays of distinct words; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def entity_text(text: Column) -> Column:
    """TXT-26: underscores, hyphens and blanks become one space, in lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"[_\-\s]+", " ")))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def matches_gold(path: Column, gold: Column) -> Column:
    """TXT-27: a gold entry with a slash is a path's end, one without its last name."""
    return F.when(F.contains(gold, F.lit("/")), (path == gold) | path.endswith(F.concat(F.lit("/"), gold))).otherwise(basename(path) == gold)


def fingerprint(content: Column) -> Column:
    """TXT-28: the SHA-256 of a text."""
    return F.sha2(content, 256)


def chunk_id(doc: Column, index: Column) -> Column:
    """TXT-29: a stable id of a document's chunk."""
    return F.concat(F.lit("chunk-"), F.left(F.sha2(F.concat_ws(":", doc.cast("string"), index.cast("string")), 256), F.lit(16)))


def token_estimate(text: Column) -> Column:
    """TXT-30: a quarter of the characters, at least 1; 0 for a blank text."""
    return F.when(F.regexp_replace(text, r"\s", "") == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int")))


def without_thoughts(text: Column) -> Column:
    """TXT-32: without the blocks that think aloud."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"^\s+|\s+$", "")


def title(text: Column, size: int = 120) -> Column:
    """TXT-37: one line without quotes around it, cut on a word."""
    return on_word(F.regexp_replace(collapsed(text), "^[\"'`]+|[\"'`]+$", ""), size)


def is_specific(term: Column) -> Column:
    """TXT-36: whether a grep term has a telling shape."""
    return (term.rlike("[A-Z]") & term.rlike("[a-z]")) | term.rlike(r"[_0-9/.]") | (term.rlike("[A-Z]") & ~term.rlike("[a-z]") & (F.length(term) >= 2)) | (F.length(term) > 4)


def hit_document(content: Column, path: Column) -> Column:
    """TXT-39: (doc, section) from the header, else the file's name and the heading in the first line."""
    pattern = r"(?s)\[Document:\s*(.*?)\s*\|\s*Section:\s*(.*?)\s*\|"
    there = content.rlike(pattern)
    first = F.trim(F.substring_index(F.regexp_replace(content, r"^\s+|\s+$", ""), "\n", 1))
    name, section = F.regexp_extract(content, pattern, 1), F.regexp_extract(content, pattern, 2)
    return F.struct(
        F.when(there & (name != ""), name).otherwise(basename(path)).alias("doc"),
        F.when(there, section).when(first.rlike(r"^#{1,6}\s"), first).otherwise("").alias("section"),
    )


def kind_of(path: Column) -> Column:
    """SRC-8: the kind of a file by its suffix."""
    suffix = F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))
    return F.when(suffix == ".md", "markdown").when(suffix == ".py", "python").when(suffix == ".json", "json").otherwise("text")


def stable_id(path: Column, archive: str = "ingested", moved: dict[str, str] | None = None) -> Column:
    """SRC-9: an id of a normalised absolute path; folders with the archive's name don't count, and prefixes may be mapped."""
    plain = F.array_join(F.filter(F.split(path, "/"), lambda p: p != archive), "/")
    for actual, logical in reversed((moved or {}).items()):
        plain = F.when((plain == actual) | plain.startswith(actual + "/"), F.concat(F.lit(logical), F.substring(plain, F.lit(len(actual) + 1), F.length(plain)))).otherwise(plain)
    return F.concat(F.lit("file:"), F.left(F.sha2(plain, 256), F.lit(12)))


def json_string(text: Column) -> Column:
    """A string as JSON: short escapes where there are any, a blank for every other control character; null stays null."""
    own = text
    for plain, said in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        own = F.replace(own, F.lit(plain), F.lit(said))
    return F.concat(F.lit('"'), F.regexp_replace(own, r"[\x00-\x1f\x7f]", " "), F.lit('"'))


def safe_json(value: dict | list | Column, depth: int, longest: dict[str, int], items: int, name: str = "", level: int = 0) -> Column:
    """TXT-35: a tree of dictionaries as JSON; leaves are strings, or arrays of strings, which stand in a list of one.

    Strings are cut to longest[name] code points (200 by default), arrays to so many items;
    what lies deeper than depth is "...". Nulls are null.
    """
    if isinstance(value, dict):
        if level >= depth:
            return F.lit('"..."')
        parts = [F.concat(F.lit(("," if k else "") + f'"{key}":'), safe_json(v, depth, longest, items, key, level + 1)) for k, (key, v) in enumerate(value.items())]
        return F.concat(F.lit("{"), *parts, F.lit("}"))
    most = F.lit(longest.get(name, 200))
    if isinstance(value, list):
        said = F.array_join(F.transform(F.slice(value[0], 1, items), lambda x: json_string(F.left(x, most))), ",")
        return F.coalesce(F.concat(F.lit("["), said, F.lit("]")), F.lit("null"))
    return F.coalesce(json_string(F.left(value, most)), F.lit("null"))
