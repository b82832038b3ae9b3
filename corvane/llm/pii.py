"""Personal data in texts, by SQL functions alone: patterns propose, checksums confirm, context words weigh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Each base pattern is written so that a match starts only where a run of its characters
# starts or where the last match ended (\G). The leftmost matches are the same as without
# that guard, since a match that starts inside a run is never the leftmost one; but a
# very long run is scanned once, not once for each of its characters. Possessive
# quantifiers stand where the next character can't belong to the run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32,128}+(?![A-Za-z0-9_-])"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"

BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)"

#: Kinds in the order that sorts spans with the same start, with a confidence before context and the words that raise or lower it.
KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE_KINDS = KINDS[:4]
CONTEXT = {
    "email": (0.9, r"(?i)\b(?:e-?mail|contact|mailto|write)\b", r"(?i)\b(?:example|noreply)\b"),
    "ip": (0.6, r"(?i)\b(?:ip|address|host|server|client)\b", r"(?i)\b(?:version|release|section)\b"),
    "card": (0.7, r"(?i)\b(?:card|visa|mastercard|amex|payment|credit|debit)\b", r"(?i)\b(?:order|isbn|serial|invoice|token)\b"),
    "phone": (0.7, r"(?i)\b(?:phone|tel|call|mobile|fax|whatsapp)\b", r"(?i)\b(?:order|serial|version)\b"),
    "iban": (0.8, r"(?i)\b(?:iban|bank|account|transfer)\b", r"(?i)\b(?:serial|code|key)\b"),
    "secret": (0.55, r"(?i)\b(?:token|secret|password|passwd|auth|bearer|credential|api|key)\b", r"(?i)\b(?:sha|md5|commit|checksum|digest|hash|uuid)\b"),
}
#: Code points on either side that count as nearby; what a word of either sort changes; least scores of the kinds beyond the base, whose spans stand or fall by their context.
REACH, STEP = 40, 0.1
LEAST = {"iban": 0.75, "secret": 0.6}
#: Matches whose places are counted together.
BLOCK = 256


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    values = F.transform(F.reverse(F.split(number, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 when divided by 97, its first four characters moved to the end and letters read as 10 to 35."""
    moved = F.concat(F.substring(iban, 5, 1 << 20), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97) == 1


def confirmed(kind: str, match: Column) -> Column:
    """The validator of a kind."""
    number = digits(match)
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(number).between(14, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(number).between(10, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(match, " ", ""))
    if kind == "secret":
        return match.rlike("[A-Za-z]") & match.rlike("[0-9].*[0-9].*[0-9].*[0-9]")
    return F.lit(True)


def score(kind: str, text: Column, start: Column, end: Column) -> Column:
    """Confidence of a span: context words within REACH characters on either side raise or lower it by STEP."""
    first, good, bad = CONTEXT[kind]
    near = F.concat_ws(" ", text.substr(F.greatest(start - REACH, F.lit(0)) + 1, F.least(start, F.lit(REACH))), text.substr(end + 1, F.lit(REACH)))
    return F.lit(first) + F.when(near.rlike(good), STEP).otherwise(0.0) - F.when(near.rlike(bad), STEP).otherwise(0.0)


#: A cheap test that a text can hold a kind at all.
MAY_HOLD = {"email": "@", "ip": ".", "card": "", "phone": "+", "iban": "", "secret": ""}


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once, however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def spans_of(kind: str, text: Column, pattern: str) -> Column:
    """Confirmed spans of a kind, as an array of (start, rank, end, kind, score); places are code points, ends exclusive.

    Leftmost matches that don't overlap. What lies between the matches gives their places:
    split and extraction walk the text in the same way. An array grows by copying, and
    finding a place in a text walks it from its start; so places are counted in blocks of
    BLOCK matches, and a match looks for its context in its block's part of the text. The
    work is in proportion to the text and to the number of matches.
    """
    size = lambda p: F.length(p["gap"]) + F.length(p["m"])
    places = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def located(part: Column, at: Column) -> Column:
        def step(state: Column, p: Column) -> Column:
            begin = state["at"] + F.length(p["gap"])
            end = state["at"] + size(p)
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), p["m"].alias("match")))).alias("out"))

        return F.aggregate(part, F.struct(at.alias("at"), places.alias("out")), step, lambda s: s["out"])

    def scored(part: Column, at: Column) -> Column:
        low = F.greatest(at - REACH, F.lit(0))
        length = F.aggregate(part, F.lit(0), lambda a, p: a + size(p)) + (at - low) + REACH
        good = F.filter(located(part, at), lambda p: confirmed(kind, p["match"]))
        made = lambda local: F.transform(
            good,
            lambda p: F.struct(p["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), p["end"].alias("end"), F.lit(kind).alias("kind"), score(kind, local, p["start"] - low, p["end"] - low).alias("score")),
        )
        return F.when(F.size(good) > 0, bound(text.substr(low + 1, length), made))

    def blocks(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda b: F.slice(parts, b * BLOCK + 1, BLOCK))

    def every(cut: Column) -> Column:
        starts = F.aggregate(
            F.transform(cut, lambda part: F.aggregate(part, F.lit(0), lambda a, p: a + size(p))),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
            lambda s: s["out"],
        )
        return F.flatten(F.filter(F.zip_with(cut, starts, scored), lambda x: x.isNotNull()))

    def parts(found: Column) -> Column:
        zipped = F.arrays_zip(F.transform(found, lambda m: m).alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"))
        return F.when(F.size(found) > 0, bound(zipped, lambda p: bound(blocks(p), every)))

    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>")
    test = F.contains(text, F.lit(MAY_HOLD[kind])) if MAY_HOLD[kind] else text.rlike({"iban": "[0-9]{2}", "secret": "[A-Za-z0-9_-]{32}"}.get(kind, "[0-9]"))
    out = F.coalesce(F.when(test, bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), parts)), none)
    return F.filter(out, lambda p: p["score"] >= LEAST[kind] - 1e-9) if kind in LEAST else out


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, found) for each row of docs (columns doc_id, text; others are ignored).

    found is the array of confirmed spans (start, rank, end, kind, score), sorted by start,
    then by the order of KINDS; a null or empty text has none. Spans of different kinds
    may overlap. A span that fails its validator is dropped and nothing inside it is tried
    again. Besides the base kinds, an IBAN (mod 97) and a secret (a long run of letters and
    digits) make spans, if their context leaves them the score of LEAST.
    """
    text = F.coalesce("text", F.lit(""))
    patterns = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE, IBAN, SECRET), strict=True))
    each = docs.select("doc_id", text.alias("text"))
    found = each.select("doc_id", *(spans_of(kind, F.col("text"), pattern).alias(kind) for kind, pattern in patterns.items()))
    return found.select("doc_id", F.array_sort(F.concat(*KINDS)).alias("found"))


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts and digests of personal_data(): one row for each row of docs."""
    base = F.filter("found", lambda s: s["rank"] < len(BASE_KINDS))
    counts = [F.expr(f"size(filter(found, s -> s.kind = '{kind}'))").cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    scores = F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",")
    return personal_data(docs).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), scores.alias("scores"))
