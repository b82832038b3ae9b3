"""Exact deduplication with a split for heavy hitters."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.scratch import stored

SPACES = " \t\n\x0b\x0c\r"


def misra_gries(counts: Counter, k: int) -> Counter:
    """Merge step: at most k counters stay, each lowered by the (k+1)th largest count."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return Counter({x: n - cut for x, n in counts.items() if n > cut})


def frequent(df: DataFrame, column: str, k: int) -> DataFrame:
    """At most k values of a string column, with every value that more than rows/(k+1) of the rows hold among them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: Counter = Counter()
        for x in batches:
            kept.update(x[column].value_counts().to_dict())
            kept = misra_gries(kept, k)
        yield pd.DataFrame({column: pd.Series(list(kept), dtype=object), "n": pd.Series(list(kept.values()), dtype="int64")})

    # The sum of the partial counters, cut once more to the k largest: what is frequent overall
    # keeps a count above zero, since all partial cuts together take at most rows/(k+1) from it.
    parts = df.select(column).mapInPandas(run, f"{column} string, n long")
    return parts.groupBy(column).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), column).limit(k).select(column)


def exact_duplicates(docs: DataFrame, k: int = 1000) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs (columns doc_id, text; others are ignored).

    Texts are equal if identical without the characters of [\\x20\\x09-\\x0D]; null counts
    as empty. Of equal texts the row with the most code points in the original text, then
    the smallest doc_id (null last) stays; of rows that agree in all that, exactly one.

    Misra-Gries counters (k of them) find the digests that may be frequent; their exact
    counts and winners, at most k rows, are broadcast, so that their copies are settled
    where they are read. Any other digest has at most rows/(k+1) copies and is shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.sha2(F.translate(text, SPACES, ""), 256).alias("text_sha256"), F.length(text).alias("size"), F.monotonically_increasing_id().alias("row"))
    own = stored(own, "digests")
    order = F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("without"), F.col("doc_id"), F.col("row"))
    heavy = stored(frequent(own, "text_sha256", k), "frequent")  # at most k rows
    verified = own.join(F.broadcast(heavy), "text_sha256").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
    verified = stored(verified, "winners")
    out = ["doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.row") == F.col("row")).alias("kept"), "text_sha256"]
    settled = own.join(F.broadcast(verified), "text_sha256").select(*out)
    each = Window.partitionBy("text_sha256")
    rest = own.join(F.broadcast(heavy), "text_sha256", "left_anti")
    rest = rest.withColumns({"group_size": F.count(F.lit(1)).over(each), "best": F.first(order).over(each.orderBy(order))}).select(*out)
    return settled.unionByName(rest)
