"""Measures of ranked lists, percentiles and gates, in joins and aggregations.

A run is (query_id, item_id, rank), gold is (query_id, item_id).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ideal(golds: Column, k: int) -> Column:
    """The greatest discounted gain of so many gold items among the first k."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), golds)).cast("int")), F.lit(0.0), lambda a, x: a + 1 / F.log2(x + 1))


def per_query(run: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """EV-1, EV-2, EV-3, TOP-9: (query_id, golds, found, recall, ndcg, rr, first) for each query with gold items; what isn't found counts 0, first is then null."""
    near = F.col("rank") <= k
    each = gold.distinct().join(run, ["query_id", "item_id"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("golds"), F.count_if(near).alias("found"), F.min("rank").alias("first"), F.coalesce(F.sum(F.when(near, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg")
    )
    return each.select("query_id", "golds", "found", (F.col("found") / F.col("golds")).alias("recall"), (F.col("dcg") / ideal(F.col("golds"), k)).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), "first")


def violated(run: DataFrame, correct: DataFrame, old: DataFrame) -> DataFrame:
    """EV-4: (query_id, violated) for each query with correct and superseded items: a superseded one comes before every correct one, or alone."""
    marks = correct.select("query_id", "item_id", F.lit(True).alias("good")).union(old.select("query_id", "item_id", F.lit(False)))
    first = marks.join(run, ["query_id", "item_id"], "left").groupBy("query_id").agg(
        F.min(F.when(F.col("good"), F.col("rank"))).alias("c"), F.min(F.when(~F.col("good"), F.col("rank"))).alias("s"), F.max(F.col("good").cast("int")).alias("any_c"), F.min(F.col("good").cast("int")).alias("any_s")
    )
    return first.filter("any_c = 1 and any_s = 0").select("query_id", F.when(F.col("s").isNull(), False).otherwise(F.col("c").isNull() | (F.col("s") < F.col("c"))).alias("violated"))


def placed(rows: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    """rows with place (from 0, in order of by) and total within their group.

    Rows are dealt in ranges of (group, by, a number of the row), so that neither a large
    group nor a frequent value goes to one task; each range is counted, and a row's place is
    that in its range and the counts of the ranges before.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(n, *group, *by, "_salt").withColumn("_part", F.spark_partition_id())
    own = own.withColumn("_at", F.row_number().over(Window.partitionBy("_part", *group).orderBy(*by, "_salt")) - 1)
    sizes = own.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_size"))
    w = Window.partitionBy(*group)
    before = sizes.select(*group, "_part", (F.sum("_size").over(w.orderBy("_part")) - F.col("_size")).alias("_before"), F.sum("_size").over(w).alias("total"))
    return own.join(before, [*group, "_part"]).withColumn("place", F.col("_at") + F.col("_before")).drop("_salt", "_part", "_at", "_before")


def percentiles(rows: DataFrame, group: list[str], value: str, shares: dict[str, float], nearest: bool = True) -> DataFrame:
    """AGG-3: for each group and name in shares the value at place rint(share * (n - 1)), half to even; AGG-4 (nearest=False): at min(n - 1, floor(share * n))."""
    own = placed(rows.filter(F.col(value).isNotNull()), group, [value])
    at = lambda p: F.rint(p * (F.col("total") - 1)) if nearest else F.least(F.col("total") - 1, F.floor(p * F.col("total")))
    wanted = F.lit(False)
    for p in shares.values():
        wanted = wanted | (F.col("place") == at(p))
    return own.filter(wanted).groupBy(*group).agg(*(F.max(F.when(F.col("place") == at(p), F.col(value))).alias(name) for name, p in shares.items()))


def bootstrap(rows: DataFrame, value: str, resamples: int = 2000, seed: int = 1) -> DataFrame:
    """AGG-10: (mean, low, high): the mean and its 95 % interval over that many resamples.

    Every row takes a Poisson weight in every resample, drawn from the hash of the row and
    the resample's number, many rows at once, so that a partition gives one row a resample
    whatever its size, and the result doesn't depend on the partitioning.
    """
    import math

    import numpy as np
    import pyarrow as pa

    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])  # of the Poisson distribution with mean 1

    def drawn(keys: np.ndarray) -> np.ndarray:
        x = keys.view(np.uint64)[:, None] + (np.arange(resamples, dtype=np.uint64) + np.uint64(1 + resamples * seed)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return np.searchsorted(steps, ((x ^ x >> np.uint64(31)) >> np.uint64(11)) * 2.0**-53)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = np.zeros(resamples), np.zeros(resamples)
        for x in batches:
            v, keys = x.column("v").to_numpy(zero_copy_only=False), x.column("key").to_numpy(zero_copy_only=False)
            for at in range(0, len(v), 256):
                w = drawn(keys[at : at + 256])
                weight += w.sum(0)
                total += v[at : at + 256] @ w
        yield pa.record_batch([pa.array(np.arange(resamples, dtype=np.int32)), pa.array(weight), pa.array(total)], ["b", "w", "t"])

    given = rows.filter(F.col(value).isNotNull())
    own = given.select(F.col(value).cast("double").alias("v"), F.xxhash64(*given.columns).alias("key"))
    means = own.mapInArrow(run, "b int, w double, t double").groupBy("b").agg(F.sum("t").alias("t"), F.sum("w").alias("w")).filter("w > 0").select((F.col("t") / F.col("w")).alias("m"))
    low_high = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))  # of one number a resample
    return given.agg(F.avg(value).alias("mean")).crossJoin(F.broadcast(low_high))


def report(measured: DataFrame, calls: DataFrame, latency: str) -> DataFrame:
    """EV-7: one row of means over queries (measured: recall, ndcg, rr, found) and of the calls' latencies: mean, p50, p95 and how many; nulls don't count.

    If no gold item of any query was found at all, the gold set belongs to another corpus,
    and the report is an error, not a row of zeros. No queries give nulls.
    """
    means = measured.agg(F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"), F.avg("rr").alias("mrr"), F.sum("found").alias("matched"), F.count(F.lit(1)).alias("_n"))
    guard = F.raise_error(F.lit("no gold item was found: the gold set and the corpus don't belong together")).cast("long")
    means = means.withColumn("matched", F.when((F.col("_n") > 0) & (F.coalesce("matched", F.lit(0)) == 0), guard).otherwise(F.col("matched"))).drop("_n")
    own = calls.filter(F.col(latency).isNotNull()).select(F.lit(1).alias("_all"), F.col(latency).alias("_v"))
    places = percentiles(own, ["_all"], "_v", {"latency_p50": 0.5, "latency_p95": 0.95}).drop("_all")
    sizes = own.agg(F.avg("_v").alias("latency_mean"), F.count("_v").alias("calls"))
    return means.crossJoin(F.broadcast(sizes)).join(F.broadcast(places), F.lit(True), "left")  # one row each


def paired(rows: DataFrame, a: str, b: str) -> DataFrame:
    """AGG-11: (mean, low, high, n): the mean of paired differences a - b and its 95 % interval by the normal distribution; pairs with a null don't count."""
    d = F.col(a) - F.col(b)
    own = rows.select(d.cast("double").alias("d")).filter("d is not null").agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.count(F.lit(1)).alias("n"))
    half = 1.96 * F.coalesce("sd", F.lit(0.0)) / F.sqrt("n")
    return own.select("mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"), "n")


def gate(baseline: DataFrame, candidate: DataFrame, tolerance: float = 0.02, latency: float = 0.2) -> DataFrame:
    """REG-1: (metric, before, after, delta, comparable, passed) for the metrics (metric, value, queries, corpus) that either report has.

    No loss beyond tolerance; a latency may grow by that share. Reports compare only if
    they asked the same number of queries of the same corpus (nulls are the same as nulls);
    where they don't, or one report lacks the metric, passed is null.
    """
    before = baseline.select("metric", F.col("value").alias("before"), F.struct("queries", "corpus").alias("asked"))
    after = candidate.select("metric", F.col("value").alias("after"), F.struct("queries", "corpus").alias("asks"))
    both = before.join(after, "metric", "full")
    slow = F.col("metric").startswith("latency")
    comparable = F.coalesce(F.col("asked") == F.col("asks"), F.lit(False)) & F.col("before").isNotNull() & F.col("after").isNotNull()
    passed = F.when(slow, F.col("after") <= F.col("before") * (1 + latency)).otherwise(F.col("after") - F.col("before") >= -tolerance)
    return both.select("metric", "before", "after", (F.col("after") - F.col("before")).alias("delta"), comparable.alias("comparable"), F.when(comparable, passed).alias("passed"))
