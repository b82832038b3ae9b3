"""Streaming upkeep: new files in a folder are compared with a durable fingerprint state, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import fingerprint
from corvane.sinks.files import _fs


#: Parts of the state by a hash of the id; a batch rewrites those alone that its ids fall into.
BUCKETS = 64
SHAPE = "doc_id long, fp string"


def _written(spark: SparkSession, root: str) -> dict[int, list[int]]:
    """For each bucket the finished batches that wrote it, in order."""
    fs, at = _fs(spark, f"{root}/state")
    out: dict[int, list[int]] = {}
    for batch in fs.listStatus(at) if fs.exists(at) else []:
        parts = {p.getPath().getName() for p in fs.listStatus(batch.getPath())}
        if "_SUCCESS" in parts:
            for name in parts:
                if name.startswith("bucket="):
                    out.setdefault(int(name[7:]), []).append(int(batch.getPath().getName()[6:]))
    return {b: sorted(batches) for b, batches in out.items()}


def _read(spark: SparkSession, root: str, places: dict[int, int]) -> DataFrame:
    """The state of buckets as of batches."""
    if not places:
        return spark.createDataFrame([], SHAPE)
    paths = [f"{root}/state/batch={n}/bucket={b}" for b, n in places.items()]  # BUCKETS at most
    return spark.read.schema(SHAPE).parquet(*paths).select("doc_id", "fp")


def state(spark: SparkSession, root: str) -> DataFrame:
    """The fingerprints (doc_id, fp) as of the last finished batch."""
    return _read(spark, root, {b: batches[-1] for b, batches in _written(spark, root).items()})


def ingest(spark: SparkSession, source: str, root: str, schema: str, kind: str = "parquet", files: int = 100) -> None:
    """Read what is new in source (doc_id, text among its columns) in micro-batches, and keep under root the state and the events.

    Each batch writes its events (doc_id, event: new, changed or unchanged; batch) and,
    under its own number, the new state of the buckets that its ids fall into, so a batch
    that is run again after a loss overwrites itself and nothing else. Of a bucket's former
    states the last two stay. Of several rows of a document in a batch the one
    with the greatest fingerprint counts. Null ids are left out. The run ends when all
    files there are have been read.
    """

    def step(batch: DataFrame, number: int) -> None:
        own = batch.filter("doc_id is not null").groupBy("doc_id").agg(F.max(fingerprint(F.coalesce("text", F.lit("")))).alias("now"))
        own = own.withColumn("bucket", F.pmod(F.hash("doc_id"), F.lit(BUCKETS)))
        touched = [r.bucket for r in own.select("bucket").distinct().collect()]
        written = {b: [n for n in batches if n < number] for b, batches in _written(spark, root).items()}
        before = _read(spark, root, {b: written[b][-1] for b in touched if written.get(b)})
        both = own.drop("bucket").join(before, "doc_id", "full")
        event = F.when(F.col("fp").isNull(), "new").when(F.col("fp") == F.col("now"), "unchanged").otherwise("changed")
        both.filter("now is not null").select("doc_id", event.alias("event")).write.mode("overwrite").parquet(f"{root}/events/batch={number}")
        after = both.select("doc_id", F.coalesce("now", "fp").alias("fp"), F.pmod(F.hash("doc_id"), F.lit(BUCKETS)).alias("bucket"))
        after.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/state/batch={number}")
        for b in touched:
            for n in written.get(b, [])[:-1]:
                fs, old = _fs(spark, f"{root}/state/batch={n}/bucket={b}")
                fs.delete(old, True)

    stream = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files).load(source)
    query = stream.select("doc_id", "text").writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def late_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension: events of each type in windows of time, on a stream or a table; on a stream rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
