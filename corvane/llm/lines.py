"""Line deduplication by a deletion-neighbourhood join, in SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.scratch import bounded_broadcast, stored

#: Lines shorter than this are compared exactly, unless a caller says otherwise: one edit would make another word of them.
SHORTEST = 10
#: Code points of a window at most, once a line has more than two windows.
WINDOW = 256

#: A line as it is compared: runs of blanks are one space, none at the ends. Most lines need no rewriting, which a search for bytes tells.
NORMAL = r"""trim(if(contains(line, '  ') or contains(line, '\t') or contains(line, '\r') or contains(line, '\u000b') or contains(line, '\f'),
    regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' '), line))""".replace(r"\u000b", "\x0b").replace(r"'\f'", "'\x0c'")
#: Code points at either end of a line that its filter keys hash, as a function of a class c: at most half of c, in steps of a fifth.
END = "cast(least(floor(pow(2, floor(log2({c}) * 4) / 4) / 2), {c} div 2) as int)"


def _place() -> Column:
    """doc_id and line number as one number that sorts like the two; a null doc_id sorts last."""
    last = (1 << 63) - 1
    return F.coalesce(F.col("doc_id"), F.lit(last)).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")


def _lines(docs: DataFrame, shortest: int) -> DataFrame:
    """One row for each line that isn't blank: doc_id, tkey (tells rows with one doc_id apart), pos from 0, place, norm, n code points, k1 and k2 (128 bits that stand for norm) and ends.

    ends are hashes of the first and of the last code points, END(c) of them, where c is
    the length of the shorter of two lines one edit apart: for a line of n code points n
    or n-1. As both ends together have c code points at most, an edit misses one of them,
    so two lines one edit apart have a hash in common.
    """
    each = docs.select("doc_id", F.xxhash64("text").alias("tkey"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    each = each.select("doc_id", "tkey", "pos", F.expr(NORMAL).alias("norm")).filter("norm <> ''")
    each = each.select("*", F.length("norm").alias("n")).selectExpr("*", f"{END.format(c='n')} as e", f"if(n > {shortest}, {END.format(c='(n - 1)')}, 0) as f")
    both = "xxhash64(0, {x}, substring(norm, 1, {x})), xxhash64(1, {x}, right(norm, {x}))"
    ends = f"case when n < {shortest} then array() when e = f or n = {shortest} then array({both.format(x='e')}) else array({both.format(x='e')}, {both.format(x='f')}) end"
    return each.selectExpr("doc_id", "tkey", "pos", "norm", "n", "xxhash64(norm) as k1", "xxhash64(norm, 1) as k2", f"{ends} as ends").withColumn("place", _place())


def _windows(lines: DataFrame, extra: list[str], shortest: int) -> DataFrame:
    """A row for each window of each line: extra columns, n, c, norm, head and tail (code points before and after the window) and hk.

    Class c is the length of the shorter of two lines one edit apart, so a line of n code
    points is in classes n and n-1. A class fixes the windows: each runs over an equal
    share of the c code points, and one more in the longer lines, so that two lines one
    edit apart are equal before and after the window that holds the edit. hk hashes what
    lies outside the window, with the class and the window's number.
    """
    own = lines.selectExpr(*extra, "n", "norm", "explode(array(n, n - 1)) as c").filter(F.col("c") >= shortest)
    own = own.withColumn("parts", F.greatest(F.lit(2), F.ceil(F.col("c") / WINDOW).cast("int"))).withColumn("width", F.greatest(F.lit(1), F.ceil(F.col("c") / F.col("parts")).cast("int")))
    own = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = own.selectExpr(*extra, "n", "c", "norm", "j", "least(j * width, c) as head", "c - least((j + 1) * width, c) as tail")
    return own.selectExpr(*extra, "n", "c", "norm", "head", "tail", "xxhash64(c, j, substring(norm, 1, head), if(tail = 0, '', right(norm, tail))) as hk")


def neighbours(lines: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(k1, k2, other_first): for each distinct line the earliest place of another line one edit away, if there is one.

    Takes the table of _lines(). Two filters come first. Ends: a line matters only where
    another line has one of its hashes of ends; the texts of those lines alone are read,
    and each distinct one once. Windows: of these, a line matters only where another is
    equal outside one of its windows (the keys hk that two different lines have). Only
    there the deletion neighbourhood is emitted: the hash of the window with each of its
    code points deleted, beside hk; lines of the shorter length also emit the window as it
    is. Two kinds of variants can be equal. Equal lengths, same place deleted: one
    substitution apart. The longer line with one code point deleted equals the shorter:
    one insertion apart. So the lines that share a variant are all one edit from the
    earliest of them (of the other length, for an insertion), which stands for the group:
    a minimum, combined before the shuffle and joined back. No pairs within a group are
    made, and every pair that is made is verified by its edit distance.
    """
    ends = lines.select("k1", F.explode("ends").alias("hk"))
    met = stored(ends.groupBy("hk").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).filter("a <> b").select("hk"), "ends")
    ids = stored(ends.join(bounded_broadcast(met, 8), "hk", "left_semi").select("k1").distinct(), "lines-ids")
    own = lines.select("k1", "k2", "place", "n", "norm").join(bounded_broadcast(ids, 8), "k1", "left_semi")
    own = stored(own.groupBy("k1", "k2").agg(F.min("place").alias("first"), F.first("norm").alias("norm"), F.first("n").alias("n")), "lines-met")
    shared = _windows(own, ["k1"], shortest).groupBy("hk").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).filter("a <> b").select("hk")
    found = _windows(own, ["k1", "k2", "first"], shortest).join(bounded_broadcast(stored(shared, "windows"), 8), "hk")
    found = stored(found.selectExpr("k1", "k2", "first", "n > c as longer", "hk", "substring(norm, head + 1, n - head - tail) as m"), "candidates")
    each = found.selectExpr("struct(first, k1, k2) as line", "longer", "hk", "m", "explode(sequence(if(longer, 1, 0), length(m))) as i")  # 0: the window as it is
    without = "concat(substring(m, 1, i - 1), substring(m, i + 1))"
    variants = each.selectExpr("line", "longer", "if(longer or i = 0, 1, 0) as kind", f"case when i = 0 then xxhash64(hk, 1, m) when longer then xxhash64(hk, 1, {without}) else xxhash64(hk, 0, i, {without}) end as v")
    ids = variants.groupBy("v", "kind").agg(F.min("line.k1").alias("a"), F.max("line.k1").alias("b")).filter("a <> b").select("v", "kind")
    variants = stored(variants.join(bounded_broadcast(stored(ids, "variants-shared"), 16), ["v", "kind"]), "variants")
    best = variants.groupBy("v", "kind").agg(F.min(F.when(~F.col("longer"), F.col("line"))).alias("short"), F.min(F.when(F.col("longer"), F.col("line"))).alias("long"))
    pairs = variants.join(stored(best, "variants-best"), ["v", "kind"]).selectExpr("line", "if(longer or kind = 0, short, long) as other")
    pairs = pairs.filter("other is not null and other <> line").selectExpr("line.k1", "line.k2", "other.k1 as o1", "other.k2 as o2", "other.first as other_first").distinct()
    pairs = pairs.join(own.select("k1", "k2", "norm"), ["k1", "k2"]).join(own.selectExpr("k1 as o1", "k2 as o2", "norm as other"), ["o1", "o2"])
    return pairs.filter("levenshtein(norm, other, 1) between 0 and 1").groupBy("k1", "k2").agg(F.min("other_first").alias("other_first"))


def repeated_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, tkey, dropped): for each document with repeated lines the sorted numbers of the lines to drop, from 0.

    A line is dropped if a line at an earlier place (doc_id, then line number) is the same
    or, where both have at least shortest code points, one edit away (a code point
    inserted, deleted or substituted). Blank lines are never dropped. tkey is the hash of
    the text, so that rows with one doc_id and different texts are told apart; such rows
    have the same places and drop no lines of each other. A null doc_id sorts last.
    """
    shortest = max(1, shortest)
    lines = stored(_lines(docs, shortest), "lines", compression="zstd")
    own = lines.groupBy("k1", "k2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    marks = own.join(neighbours(lines, shortest), ["k1", "k2"], "left").filter("rows > 1 or other_first < first").selectExpr("k1", "k2", "least(first, other_first) as earliest")
    # stored, so that both sides of the join are shuffled as they are, and a line that many documents have is split over tasks
    drops = lines.select("doc_id", "tkey", "pos", "place", "k1", "k2").join(stored(marks, "marks"), ["k1", "k2"]).filter("earliest < place")
    return stored(drops.groupBy("doc_id", "tkey").agg(F.sort_array(F.collect_set("pos")).alias("dropped")), "drops")


def without_repeated_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """docs with the repeated lines cut out of text; all rows and all columns stay.

    Adds n_lines and n_dropped. A null text stays null with 0 lines; a text of which all
    lines go becomes empty. Columns of docs with those names are replaced. shortest: see
    repeated_lines().
    """
    names = list(docs.columns)
    own = docs.select(F.struct(*names).alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))  # so no name of docs can clash
    drops = repeated_lines(docs, shortest).select(F.col("doc_id").alias("drop_id"), "tkey", "dropped")
    out = own.join(drops.hint("shuffle_hash"), own.id.eqNullSafe(F.col("drop_id")) & (F.col("key") == F.col("tkey")), "left")  # texts aren't sorted
    # the lines are bound once: split() inside the inner function would run for each line
    kept = F.expr(r"transform(array(split(doc.text, '\n', -1)), x -> array_join(transform(array_except(sequence(0, size(x) - 1), dropped), i -> x[i]), '\n'))[0]")
    given = F.col("doc.text")
    n_lines = F.coalesce(F.length(given) - F.length(F.replace(given, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    text = F.when(F.col("dropped").isNull(), given).otherwise(kept)
    made = {"text": text, "n_lines": n_lines.cast("long"), "n_dropped": F.coalesce(F.size("dropped"), F.lit(0)).cast("long")}
    return out.select(*(made[c].alias(c) if c in made else F.col("doc").getField(c).alias(c) for c in names), *(made[c].alias(c) for c in made if c not in names))
