"""Upkeep of a corpus: what changed, what to do about it, duplicates, audits, catalogs and jobs, as joins of narrow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.store import stored


def changes(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """ING-1, JN-12: (key, state) of old (key, was) and new (key, now): new, changed, unchanged or deleted. Only keys and digests are shuffled."""
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return old.join(new, key, "full").select(key, state.alias("state"))


def refresh_plan(walked: DataFrame, known: DataFrame, status: DataFrame, keep: DataFrame, least: float = 0.5) -> DataFrame:
    """ING-3: (doc_id, state), what a refresh does with each document.

    walked: doc_id, now; known (fingerprints): doc_id, was; status: doc_id, status; keep:
    doc_id. A walked document is new (no status), retry (not processed), adopt (processed,
    no fingerprint), changed or unchanged. One that isn't walked is kept or gone if it has a
    fingerprint, unknown if it is only processed. Nothing is gone, and such documents are
    refused, if fewer documents were walked than a share least of the fingerprints.
    """
    every = walked.join(known, "doc_id", "full").join(status, "doc_id", "full").join(keep.distinct().withColumn("keep", F.lit(True)), "doc_id", "left")
    size = walked.agg(F.count(F.lit(1)).alias("w")).crossJoin(F.broadcast(known.agg(F.count(F.lit(1)).alias("k"))))  # one row each
    every = every.crossJoin(F.broadcast(size.select((F.col("w") < F.col("k") * least).alias("narrow"))))
    done = F.coalesce(F.col("status") == "processed", F.lit(False))
    state = (
        F.when(F.col("now").isNotNull() & F.col("status").isNull(), "new")
        .when(F.col("now").isNotNull() & ~done, "retry")
        .when(F.col("now").isNotNull() & F.col("was").isNull(), "adopt")
        .when(F.col("now").isNotNull(), F.when(F.col("now") == F.col("was"), "unchanged").otherwise("changed"))
        .when(F.col("was").isNotNull(), F.when(F.col("keep"), "kept").when(F.col("narrow"), "refused").otherwise("gone"))
        .when(done, "unknown")
    )
    return every.select("doc_id", state.alias("state")).filter("state is not null")


def canonical(docs: DataFrame, body: str, order: list) -> DataFrame:
    """ING-5, ING-6, ING-8: docs with canonical, the doc_id that stands for its body: the least by order, a minimum combined before the shuffle."""
    place = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)), F.col("doc_id"))
    best = docs.groupBy(body).agg(F.min(place).alias("_best"))
    return docs.join(best, body).withColumn("canonical", F.col("_best.doc_id")).drop("_best")


def latest(versions: DataFrame, key: list[str], by: list) -> DataFrame:
    """CAT-1: the last version of each key, of an append-only table."""
    return versions.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).filter("_n = 1").drop("_n")


def merged(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """ING-12, ING-20: base and new of one schema; where both have a key the new row wins."""
    return new.unionByName(base.join(new, key, "left_anti"))


def difference(name: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """ING-10, SET-2: one row (check, only_left, only_right, ok) for two tables of one column id."""
    both = left.distinct().withColumn("l", F.lit(1)).join(right.distinct().withColumn("r", F.lit(1)), "id", "full")
    found = both.agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))
    return found.select(F.lit(name).alias("check"), "only_left", "only_right", (F.col("only_left") + F.col("only_right") == 0).alias("ok"))


def shared_rare(tokens: DataFrame, least: int = 2, most: int = 20, shared: int = 2) -> DataFrame:
    """MIN-1, JN-10, FLT-9: (a, b, n) for pairs of documents that share at least that many tokens which occur in least to most documents; tokens: doc_id, token.

    The band bounds what a token can add: most * (most - 1) / 2 pairs.
    """
    own = tokens.distinct()
    rare = own.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df").between(least, most)).select("token")
    kept = own.join(rare, "token")
    pairs = kept.select("token", F.col("doc_id").alias("a")).join(kept.select("token", F.col("doc_id").alias("b")), "token").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= shared)


def fingerprint_of(rows: DataFrame, line, digits: int = 16) -> DataFrame:
    """AGG-14, AGG-15: (n, digest) of a table whatever its order: the sum of 128 bits of each line's digest, in two halves.

    Sorting all lines into one string, as a small tool can, would put a corpus into one
    task; a sum of digests is as independent of order and is combined before the shuffle.
    """
    own = rows.select(F.sha2(line, 256).alias("d"))
    half = lambda a: F.sum(F.conv(F.substring("d", a, 12), 16, 10).cast("decimal(38,0)"))
    return own.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(":", half(1).cast("string"), half(13).cast("string")), 256).alias("digest")).select("n", F.left("digest", F.lit(digits)).alias("digest"))


def by_rarity(rows: DataFrame) -> DataFrame:
    """(item_id, ws) of items (item_id, words as a set), stored: the words in order of how rare they are. Null ids and empty sets are left out."""
    each = rows.filter("item_id is not null").select("item_id", F.explode("words").alias("word"))
    rank = each.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    ordered = each.join(rank, "word").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("ws"))
    return stored(ordered.select("item_id", F.transform("ws", lambda x: x["word"]).alias("ws")), "ordered")


def near_pairs(rows: DataFrame, least: float) -> DataFrame:
    """MIN-3: (item_id, other, share): pairs of items (item_id, words as a set), other the smaller id, that share least or more of their words. Null ids and empty sets have no pairs."""
    return pairs_of(by_rarity(rows), least)


def pairs_of(ordered: DataFrame, least: float, asked: DataFrame | None = None) -> DataFrame:
    """(item_id, other, share): the pairs of near_pairs() among items of by_rarity(), of those asked for (item_id) with smaller ids; of a bound of 0 those that share a word.

    Two sets of which that share is common have one of their first words in common: of n
    words, all but the last ceil(least * n) and one more. Only those are joined, so that
    frequent words pair nothing, and each pair found is checked on its whole sets.
    """
    n = F.size("ws")
    first = ordered.select("item_id", n.alias("n"), F.explode(F.slice("ws", F.lit(1), n - F.ceil(n * least).cast("int") + 1)).alias("word"))
    other = first.select(F.col("item_id").alias("other"), F.col("n").alias("m"), "word")
    mine = first if asked is None else first.join(asked, "item_id", "left_semi")
    met = mine.join(other, "word").filter((F.col("item_id") > F.col("other")) & (F.least("n", "m") >= least * F.greatest("n", "m"))).select("item_id", "other").distinct()
    both = met.join(ordered, "item_id").join(ordered.select(F.col("item_id").alias("other"), F.col("ws").alias("vs")), "other")
    share = F.size(F.array_intersect("ws", "vs")) / F.size(F.array_union("ws", "vs"))
    return both.select("item_id", "other", share.alias("share")).filter(F.col("share") >= least)


def nearest_share(ordered: DataFrame, least: float) -> DataFrame:
    """(item_id, nearest): the largest share that each item of by_rarity() has in common with one of a smaller id; items that share no word with any are left out.

    Found in rounds of a falling bound, least first: an item that has a pair at the bound
    has its nearest among such pairs, so only the others go on. The last round, without
    a bound, is for those that are near nothing, and joins them on all their words.
    """
    out, left = None, ordered.select("item_id")
    for bound in (least, least / 2, least / 4, 0.0):
        found = stored(pairs_of(ordered, bound, left).groupBy("item_id").agg(F.max("share").alias("nearest")), "nearest")
        out = found if out is None else out.unionByName(found)
        left = stored(left.join(found, "item_id", "left_anti"), "asked")
        if left.isEmpty():
            break
    return out


def taken(rows: DataFrame, near: DataFrame) -> DataFrame:
    """MIN-3: (item_id, taken): items in ascending order are taken unless an earlier taken one is near (item_id, other).

    In rounds: an item without an open or taken item before it is taken, one that is near a
    taken one is not, the others stay open; each round settles the least open ones at
    least, and chains are as long as near items follow each other.
    """
    links = stored(near.select("item_id", "other").distinct(), "near")
    settled = stored(rows.filter("item_id is not null").select("item_id").distinct().join(links.select("item_id").distinct(), "item_id", "left_anti").withColumn("taken", F.lit(True)), "settled")
    while not links.isEmpty():
        known = links.join(settled.select(F.col("item_id").alias("other"), "taken"), "other", "left")
        state = known.groupBy("item_id").agg(F.coalesce(F.bool_or("taken"), F.lit(False)).alias("hit"), F.count_if(F.col("taken").isNull()).alias("open"))
        fresh = stored(state.filter("hit or open = 0").select("item_id", (~F.col("hit")).alias("taken")), "fresh")
        settled = stored(settled.unionByName(fresh), "settled")
        links = stored(links.join(fresh.select("item_id"), "item_id", "left_anti"), "near")
    return settled
