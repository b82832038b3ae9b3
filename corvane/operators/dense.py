"""Vectors: unit length, exact cosine search in blocks, greedy spreading, upkeep of an index, a layout."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.lists import each_list

#: Asked vectors of a block: what one task holds besides its own batch.
BLOCK = 1024
#: Scores that a task has at a time.
CELLS = 1 << 20


def unit(rows: DataFrame, given: str, name: str) -> DataFrame:
    """DN-1: rows with the vector scaled to length 1 (doubles); a zero vector stays."""
    own = F.transform(given, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(own, F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("_norm", norm).withColumn(name, F.transform(given, lambda x: x.cast("double") / F.when(F.col("_norm") == 0, 1.0).otherwise(F.col("_norm")))).drop("_norm")


def nearest(rows: DataFrame, asked: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """DN-2, TOP-2: (query_id, vec_id, score, rank), the k vectors of greatest cosine for each asked one, ties by vec_id.

    rows: vec_id, embedding; asked: query_id, embedding. Asked vectors are gathered in
    blocks of about that many, a list each; every block meets all rows once, by matrix
    products of CELLS scores at most, and only what is among a query's k best of its task
    so far leaves. So no row is made for a pair, and a task holds one block, one batch of
    rows and a few arrays of CELLS numbers, however large the tables. Blocks beyond the
    first add a pass over the rows each. Null vectors are left out; a zero vector has cosine 0.
    Ids come back as they are, null ones too.
    """
    import numpy as np
    import pyarrow as pa

    n = max(1, math.ceil(asked.count() / block))
    given = asked.filter("embedding is not null").select(F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("block"), "query_id", F.transform("embedding", lambda x: x.cast("double")).alias("q"))
    lists = given.groupBy("block").agg(F.collect_list(F.struct("query_id", "q")).alias("asked"))
    out = None
    for at in range(n):
        spark = rows.sparkSession
        one = lists.filter(F.col("block") == at).select("asked").collect()  # one block
        pairs = sorted(((r.query_id, r.q) for r in one[0].asked), key=lambda x: str(x[0])) if one else []
        if not pairs:
            continue
        ids, q = pa.array([p[0] for p in pairs], pa.int64()), np.array([p[1] for p in pairs], float)
        lengths = np.sqrt((q * q).sum(1))
        held = spark.sparkContext.broadcast((ids, q, lengths))  # one block
        step = max(1, CELLS // len(ids))

        def run(batches: Iterator[pa.RecordBatch], held=held, step=step) -> Iterator[pa.RecordBatch]:
            ids, q, lengths = held.value
            best = np.empty((0, len(ids)))  # the k best scores of each query so far
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    x = whole.slice(at, step)
                    v = np.stack(x.column("embedding").to_numpy(zero_copy_only=False)).astype(float)
                    size = np.sqrt((v * v).sum(1))[:, None] * lengths
                    score = np.divide(v @ q.T, size, out=np.zeros((len(v), len(ids))), where=size > 0)
                    best = np.concatenate([best, score])
                    if len(best) > k:
                        best = np.partition(best, len(best) - k, 0)[-k:].copy()
                    # what may still be one of the k best, and all that tie with the last within rounding: the exact order comes later
                    r, c = np.nonzero(score >= (best.min(0) if len(best) == k else -np.inf) - 1e-9)
                    yield pa.record_batch([ids.take(pa.array(c)), x.column("vec_id").take(pa.array(r)), pa.array(score[r, c])], ["query_id", "vec_id", "score"])

        part = rows.filter("embedding is not null").select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "query_id long, vec_id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.limit(0).select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)


def spread(ranked: DataFrame, most: float, limit: int) -> DataFrame:
    """DN-7: of each query's ranked vectors (query_id, vec_id, rank, v of length 1) the first limit whose cosine with every kept one is below most.

    Each choice needs the ones before; a query's ranked list is bounded by its top k.
    """
    import numpy as np

    def choose(own: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for row in own:
            if len(kept) < limit and all(float(np.dot(row["v"], k["v"])) < most for k in kept):
                kept.append(row)
        return [{"vec_id": r["vec_id"], "chosen": n} for n, r in enumerate(kept, 1)]

    return each_list(ranked, "query_id", ["rank", "vec_id", "v"], choose, "query_id long, vec_id long, chosen int")


def update_plan(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """DN-4: (key, state) from old (key, was) and new (key, now): new, modified, deleted or reused."""
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified").otherwise("reused")
    return old.join(new, key, "full").select(key, state.alias("state"))


def ordinal(rows: DataFrame, key: str) -> DataFrame:
    """rows with i, their place from 0 in the key's order: ranges are sorted apart, and each is moved by the count of those before it."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = rows.repartitionByRange(n, key).withColumn("_part", F.spark_partition_id())
    own = own.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1)
    sizes = own.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))  # a row for each range
    return own.join(F.broadcast(before), "_part").withColumn("i", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def spiral(rows: DataFrame, key: str) -> DataFrame:
    """DN-8: (key, x, y, z), points of a golden spiral on the unit sphere, in the key's order."""
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    own = ordinal(rows, key).crossJoin(F.broadcast(total))  # one row
    z: Column = 1 - 2 * (F.col("i") + 0.5) / F.col("n")
    own = own.select(key, z.alias("z"), (F.col("i") * math.pi * (3 - math.sqrt(5))).alias("a"))
    flat = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("z") * F.col("z")))
    return own.select(key, (flat * F.cos("a")).alias("x"), (flat * F.sin("a")).alias("y"), "z")
