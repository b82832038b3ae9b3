"""Candidate pools of several channels: normalising, fusing, rescoring, ordering and selecting, in joins and windows.

A channel is (query_id, item_id, score). A pool is (query_id, item_id, dense, sparse), null
where a channel misses. All windows are within a query, so they share one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from corvane.operators.lists import each_list

#: Scores closer than this are one bucket of the order.
EPSILON = 3.8e-7


def per_query() -> WindowSpec:
    """The window of a query's items; made when a plan is, as it needs a session."""
    return Window.partitionBy("query_id")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by hash of keys in spark.sql.shuffle.partitions tasks: left to itself, Spark joins them to about one a core, whose sorts and windows then grow with the input."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def outer(dense: DataFrame, sparse: DataFrame, name: str = "sparse", left: str = "dense") -> DataFrame:
    """JN-1: the full outer join of two channels (or of a pool and one more channel: JN-2)."""
    a = dense.withColumnRenamed("score", left)
    return a.join(sparse.withColumnRenamed("score", name), ["query_id", "item_id"], "full")


def min_max(name: str, missing: float | Column = 0.0) -> Column:
    """WIN-4, FU-1: within the query's pool; a constant channel is 0.5."""
    x = F.col(name)
    low, high = F.min(x).over(per_query()), F.max(x).over(per_query())
    return F.when(x.isNull(), missing).when(high - low < 1e-12, 0.5).otherwise((x - low) / (high - low))


def z_score(name: str) -> Column:
    """WIN-5: within the query's channel; 0 for a constant one, null for a miss."""
    x = F.col(name)
    sd = F.stddev_pop(x).over(per_query())
    return F.when(x.isNull(), None).when(sd < 1e-12, 0.0).otherwise((x - F.avg(x).over(per_query())) / sd)


def floor(name: str) -> Column:
    """FU-3: the norm of a miss, one evenly spaced rank below the least of the channel's n items; 0 for an empty channel."""
    n = F.count(name).over(per_query())
    return F.when(n > 0, -1.0 / (n + 1)).otherwise(0.0)


def tie(dense: str = "dense", sparse: str = "sparse") -> Column:
    """FU-3: the z-score of an item that one channel alone has, to 9 places, so that equal ones stay equal; 0 for the others."""
    return F.when(F.col(sparse).isNull(), F.round(F.coalesce(z_score(dense), F.lit(0.0)), 9)).when(F.col(dense).isNull(), F.round(F.coalesce(z_score(sparse), F.lit(0.0)), 9)).otherwise(0.0)


def order(score: str = "score", mode: str = "zscore") -> list[Column]:
    """TOP-4: buckets of the score, then (in that mode) the column tie, then the id, all descending."""
    return [F.desc(F.rint(F.col(score) / EPSILON)), *([F.desc("tie")] if mode == "zscore" else []), F.desc("item_id")]


def fused(pool: DataFrame, alpha: float = 0.5, mode: str = "zscore", bonus: float = 0.05) -> DataFrame:
    """FU-2, FU-3: the pool with score and rank: alpha * dense + (1 - alpha) * sparse of the norms.

    mode says what is made of items that one channel alone has: off (a miss is 0), zscore
    (the same, and its z-score breaks ties), agreement (items of both channels get bonus)
    or impute (a miss is floor()).
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie between 0 and 1")
    if mode not in ("off", "zscore", "agreement", "impute"):
        raise ValueError(f"unknown mode {mode}")
    miss = floor if mode == "impute" else lambda _: 0.0
    score = alpha * min_max("dense", miss("dense")) + (1 - alpha) * min_max("sparse", miss("sparse"))
    if mode == "agreement":
        score = score + F.when(F.col("dense").isNotNull() & F.col("sparse").isNotNull(), bonus).otherwise(0.0)
    return ranked(pool.withColumns({"score": score, "tie": tie()}), mode)


def ranked(scored: DataFrame, mode: str = "zscore") -> DataFrame:
    """FU-10: the rank anew, after a change of score."""
    return scored.withColumn("rank", F.row_number().over(per_query().orderBy(*order(mode=mode))))


def weighted(pool: DataFrame, weights: dict[str, float]) -> DataFrame:
    """FU-4, FU-5: the weighted sum of any number of channels' norms, ties by id ascending."""
    score = sum((w * min_max(name) for name, w in weights.items()), F.lit(0.0))
    scored = pool.withColumn("score", score)
    return scored.withColumn("rank", F.row_number().over(per_query().orderBy(F.desc("score"), "item_id")))


def reciprocal(pool: DataFrame, weights: dict[str, float], k: int = 60, deepest: int | None = None) -> DataFrame:
    """FU-6: reciprocal rank fusion; each channel's rank in one pass, misses sorted last and not counted, ranks beyond deepest neither."""
    total = F.lit(0.0)
    for name, w in weights.items():
        rank = F.row_number().over(per_query().orderBy(F.desc_nulls_last(name), "item_id"))
        there = F.col(name).isNotNull() & (F.lit(True) if deepest is None else rank <= deepest)
        total = total + F.when(there, w / (k + rank)).otherwise(0.0)
    return pool.withColumn("score", total)


def first_of(scored: DataFrame, limit: int) -> DataFrame:
    return scored.filter(F.col("rank") <= limit)


def with_tail(top: DataFrame, tail: DataFrame, limit: int, most: int, score: Column) -> DataFrame:
    """FU-8, FU-9, SET-5, SEL-5: the first limit of a ranked pool, and after them up to most of the items that only the other channel has, by its score; nothing is evicted.

    top: query_id, item_id, score, rank over the whole pool; tail: a channel. score is
    made of the tail's column score.
    """
    extra = tail.join(top.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
    extra = extra.withColumn("n", F.row_number().over(per_query().orderBy(F.desc("score"), "item_id"))).filter(F.col("n") <= most)
    head = first_of(top, limit).select("query_id", "item_id", "score", "rank")
    return head.unionByName(extra.select("query_id", "item_id", score.alias("score"), (F.lit(limit) + F.col("n")).alias("rank")))


def boost(raw: Column) -> Column:
    """FU-8: what a grep score adds: up to 0.15, reached at 8."""
    return F.when(raw <= 0, 0.0).otherwise(F.least(raw / 8.0, F.lit(1.0)) * 0.15)


def local_norm(text: Column, terms: Column) -> Column:
    """FU-7: c / (c + 3) of the terms' occurrences in a lower-case text, five of each at most."""
    each = F.transform(terms, lambda t: F.least(F.lit(5.0), F.when(t == "", 0.0).otherwise((F.length(text) - F.length(F.replace(text, F.lower(t), F.lit("")))) / F.length(t))))
    count = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return count / (count + 3.0)


def superseded(score: Column, stale: Column, day: Column, today: Column) -> Column:
    """FU-11: 0.3 of the score for a text that calls itself stale; up to 15 % less with age, in full after a year; no date, no loss."""
    age = F.datediff(today, day)
    recency = F.when(day.isNull() | (age <= 0), 1.0).otherwise(1.0 - 0.15 * F.least(F.lit(1.0), age / 365.0))
    return score * F.when(stale, 0.3).otherwise(1.0) * recency


def diverse(scored: DataFrame, limit: int, cap: int = 2, penalty: float = 0.05) -> DataFrame:
    """SEL-1, WIN-1: the score less penalty for each better item of the source; cap of a source first, the others fill up; ties keep the fused rank."""
    s = scored.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "rank")) - 1)
    s = s.withColumn("adjusted", F.col("score") - penalty * F.col("n"))
    chosen = F.row_number().over(per_query().orderBy(F.col("n") >= cap, F.desc("adjusted"), F.desc("score"), "rank"))
    return s.withColumn("chosen", chosen).filter(F.col("chosen") <= limit)


def capped(scored: DataFrame, by: str, cap: int, limit: int) -> DataFrame:
    """SEL-2, WIN-7: the first limit of the ranked items, cap of each value of a column at most."""
    s = scored.withColumn("n", F.row_number().over(Window.partitionBy("query_id", by).orderBy("rank"))).filter(F.col("n") <= cap)
    return s.withColumn("chosen", F.row_number().over(per_query().orderBy("rank"))).filter(F.col("chosen") <= limit)


def suffix_matches(paths: DataFrame, hits: DataFrame) -> DataFrame:
    """JN-6: for each path the grep hit whose name it ends with, after a slash or a hyphen or whole; the best score, then the smallest name.

    paths: path; hits: name, score. A path's possible names are its ends, so the join is on
    equal names, not on every pair.
    """
    marks = F.array_union(F.array(F.lit(1)), F.filter(F.transform(F.sequence(F.lit(1), F.length("path")), lambda i: F.when(F.substring("path", i, F.lit(1)).isin("/", "-"), i + 1)), lambda i: i.isNotNull()))
    ends = paths.select("path", F.explode(F.transform(marks, lambda i: F.substring("path", i, F.length("path")))).alias("name"))
    best = ends.join(hits, "name").groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("less"), "name")).alias("best"))
    return best.select("path", F.col("best.name").alias("name"), (-F.col("best.less")).alias("score"))


def relevant_and_different(items: DataFrame, weight: float = 0.7, pool: int = 15, limit: int = 5) -> DataFrame:
    """SEL-3: greedy choice by weight * relevance (min-max in the pool) - (1 - weight) * the greatest cosine with what is chosen, among the first pool items of each query.

    items: query_id, item_id, rank, score, v (array<float>, of length 1). Each choice needs
    the ones before, so a query's pool, bounded by pool rows, goes to one Arrow function.
    """
    import numpy as np

    def choose(own: list[dict]) -> list[dict]:
        own = own[:pool]
        v, gain = np.array([r["v"] for r in own], float), np.array([r["score"] for r in own], float)
        gain = (gain - gain.min()) / np.ptp(gain) if np.ptp(gain) > 0 else np.full(len(gain), 0.5)
        near, left, out = np.full(len(own), -np.inf), list(range(len(own))), []
        while left and len(out) < limit:
            worth = [weight * gain[k] - (1 - weight) * (near[k] if out else 0.0) for k in left]
            out.append(left.pop(int(np.argmax(worth))))
            near = np.maximum(near, v @ v[out[-1]])
        return [{"item_id": own[k]["item_id"], "chosen": n} for n, k in enumerate(out, 1)]

    return each_list(items.filter(F.col("rank") <= pool), "query_id", ["rank", "item_id", "score", "v"], choose, "query_id long, item_id long, chosen int")


def blended(items: DataFrame, margin: float = 0.15) -> DataFrame:
    """RR-2: the fused order, in which an item rises past the one before it only if the reranker prefers it and their fused scores differ by less than margin.

    items: query_id, item_id, rank, score, rerank (null: the reranker left it out). An
    insertion sort depends on its own steps, so each query's pool, a bounded list, goes to
    one Arrow function.
    """
    def sort(rows: list[dict]) -> list[dict]:
        out: list[dict] = []
        for row in rows:
            at = len(out)
            while at and row["rerank"] < out[at - 1]["rerank"] and abs(out[at - 1]["score"] - row["score"]) < margin:
                at -= 1
            out.insert(at, row)
        return [{"item_id": r["item_id"], "place": n} for n, r in enumerate(out, 1)]

    own = items.select("query_id", "item_id", "rank", "score", F.coalesce(F.col("rerank").cast("double"), F.lit(1e9)).alias("rerank"))
    return each_list(own, "query_id", ["rank", "item_id", "score", "rerank"], sort, "query_id long, item_id long, place int")
