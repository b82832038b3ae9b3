"""Vectors in stores: a second index in half precision, a resumable copy between stores, and matrix files read in slices."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.sparse import there
from corvane.operators.upkeep import fingerprint_of
from corvane.store import stored

#: Bytes of a file that a task looks through for ids at once, of vectors that it decodes at once, and the longest id's bytes.
BLOCK, SLICE, LONGEST_ID = 8 << 20, 4 << 20, 4096


def halves(rows: DataFrame) -> DataFrame:
    """(vec_id, half): vectors (vec_id, embedding) as little-endian numbers of 16 bits; ids and nulls stay as they are. A number beyond 65504 becomes infinite."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            with np.errstate(over="ignore"):
                said = [None if v is None else np.array(v, "<f2").tobytes() for v in x.column("embedding").to_pylist()]
            yield pa.record_batch([x.column("vec_id"), pa.array(said, pa.binary())], ["vec_id", "half"])

    return rows.select("vec_id", "embedding").mapInArrow(run, f"vec_id {dict(rows.dtypes)['vec_id']}, half binary")


def wholes(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding): vectors in half precision as floats again."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            said = [None if v is None else np.frombuffer(v, "<f2").astype(np.float32).tolist() for v in x.column("half").to_pylist()]
            yield pa.record_batch([x.column("vec_id"), pa.array(said, pa.list_(pa.float32()))], ["vec_id", "embedding"])

    return rows.select("vec_id", "half").mapInArrow(run, f"vec_id {dict(rows.dtypes)['vec_id']}, embedding array<float>")


def digest(rows: DataFrame) -> str:
    """A digest of vectors (vec_id, embedding), whatever their order."""
    said = F.concat_ws("|", F.coalesce(F.col("vec_id").cast("string"), F.lit("")), F.coalesce(F.array_join(F.col("embedding").cast("array<float>").cast("array<string>"), ","), F.lit("-")))
    return fingerprint_of(rows, said, 32).first().digest


def by_length(vec_id: str = "vec_id") -> list[Column]:
    """The order of a second index: shorter ids first, then by text."""
    said = F.col(vec_id).cast("string")
    return [F.length(said), said]


def write_second(rows: DataFrame, root: str) -> None:
    """DN-5: store vectors (vec_id, embedding) in half precision in order of their ids, beside the digest of what they were made of; the digest comes last."""
    half = halves(rows)
    half.repartitionByRange(*by_length()).sortWithinPartitions(*by_length()).write.mode("overwrite").parquet(f"{root}/vectors")
    spark = rows.sparkSession
    spark.createDataFrame([(digest(rows),)], "digest string").coalesce(1).write.mode("overwrite").parquet(f"{root}/source")


def open_second(spark: SparkSession, root: str, source: DataFrame) -> DataFrame | None:
    """DN-5, DN-6: the second index's vectors (vec_id, embedding), or None where it isn't whole or its source has changed since; the caller then falls back to the first."""
    if not there(spark, f"{root}/source/_SUCCESS") or not there(spark, f"{root}/vectors/_SUCCESS"):
        return None
    if spark.read.schema("digest string").parquet(f"{root}/source").first().digest != digest(source):
        return None
    return wholes(spark.read.parquet(f"{root}/vectors"))


def transplant(source: DataFrame, root: str, ranges: int = 8) -> None:
    """SNK-10: copy vectors (vec_id, embedding) into a store of Parquet files under root, range by range of the ids' hashes.

    A range is counted against its source before it is marked; a copy that was cut off
    does only the ranges without a mark when it is called again. Any store that reads as
    such rows can be the source, a copy too, so it goes either way.
    """
    spark = source.sparkSession
    place = F.pmod(F.xxhash64("vec_id"), F.lit(ranges))
    for k in range(ranges):
        to = f"{root}/range={k}"
        if there(spark, f"{to}/_DONE/_SUCCESS"):
            continue
        own = source.select("vec_id", "embedding").filter(place == k)
        own.write.mode("overwrite").parquet(to)
        n = spark.read.schema(own.schema).parquet(to).count()
        if n != own.count():
            raise ValueError(f"{to} doesn't hold its source's rows")
        spark.range(n, n + 1).coalesce(1).write.mode("overwrite").parquet(f"{to}/_DONE")


def transplanted(spark: SparkSession, root: str, like: DataFrame) -> DataFrame:
    """The rows of a copy."""
    return spark.read.schema(like.select("vec_id", "embedding").schema).parquet(f"{root}/range=*")


def compared(source: DataFrame, copy: DataFrame, one_in: int = 10, least: float = 0.9999) -> DataFrame:
    """SMP-4: (counts, sampled, missing, changed): whether both have as many rows; of the source's sampled ids, by hash, how many there are, how many the copy lacks, and how many have a vector of a cosine below least. Two null or zero vectors are the same. Ids are unique and not null."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    drawn = F.pmod(F.xxhash64("vec_id"), F.lit(one_in)) == 0
    both = source.filter(drawn).select("vec_id", "embedding").join(copy.filter(drawn).select("vec_id", F.col("embedding").alias("other"), F.lit(True).alias("there")), "vec_id", "left")
    a, b = F.col("embedding"), F.col("other")
    product = F.sqrt(dot(a, a) * dot(b, b))
    same = F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(F.size(a) != F.size(b), False).when(product == 0, a == b).otherwise(dot(a, b) >= least * product)
    found = both.agg(F.count(F.lit(1)).alias("sampled"), F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.col("there") & ~same).alias("changed"))
    sizes = source.agg(F.count(F.lit(1)).alias("n")).crossJoin(copy.agg(F.count(F.lit(1)).alias("m")))  # one row each
    return sizes.crossJoin(found).select((F.col("n") == F.col("m")).alias("counts"), "sampled", "missing", "changed")


def _open(uri: str) -> pa.NativeFile:
    fs, path = arrow_fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri) if ":" in uri else f"file://{uri}")
    return fs.open_input_file(path)


def _find(file: pa.NativeFile, mark: bytes, start: int = 0) -> int:
    """Where a mark ends, block by block; -1 if there is none."""
    at, size = start, file.size()
    while at < size:
        file.seek(at)
        block = file.read(BLOCK)
        if (k := block.find(mark)) >= 0:
            return at + k + len(mark)
        at += max(1, len(block) - len(mark) + 1) if len(block) == BLOCK else len(block)
    return -1


def vector_file(spark: SparkSession, uri: str) -> DataFrame:
    """SRC-12: (row, vec_id, embedding) of a JSON file of vectors: embedding_dim, then data, a list of objects with "__id__", then matrix, base64 of floats of 32 bits, a row for each object.

    Neither the list nor the matrix is ever whole in one place: the driver looks for where
    they begin, tasks look through blocks of the list for ids, and decode slices of the
    matrix that hold whole rows. The file has to be one that pyarrow can open from every
    executor. A matrix that doesn't fit the ids is an error.
    """
    import numpy as np

    with _open(uri) as file:
        size = file.size()
        head = file.read(min(size, 1 << 16)).decode("utf-8", "replace")
        dim = int(re.search(r'"embedding_dim"\s*:\s*(\d+)', head)[1])
        first, matrix = _find(file, b'"data"'), _find(file, b'"matrix"')
        if first < 0 or matrix < first:
            raise ValueError("the file has no data before its matrix")
        start = _find(file, b'"', matrix)
        end = _find(file, b'"', start) - 1
        pad = 0 if end == start else (lambda t: t.count(b"="))((file.seek(end - 2), file.read(2))[1])
    rows = ((end - start) // 4 * 3 - pad) // (4 * dim)
    id_mark = re.compile(rb'"__id__"\s*:\s*("(?:[^"\\]|\\.)*")')

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for r in x.to_pylist():
                with _open(uri) as file:
                    file.seek(r["start"])
                    block = file.read(min(r["end"], matrix) - r["start"] + LONGEST_ID)
                found = [json.loads(m[1]) for m in id_mark.finditer(block) if m.start() < r["end"] - r["start"] and r["start"] + m.start() < matrix]
                yield pa.record_batch([pa.array([r["id"]] * len(found), pa.int64()), pa.array(range(len(found)), pa.int64()), pa.array(found, pa.string())], ["block", "k", "vec_id"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for r in x.to_pylist():
                a, b = r["start"] * 4 * dim, r["end"] * 4 * dim  # bytes; three of them are four characters
                with _open(uri) as file:
                    file.seek(start + a // 3 * 4)
                    part = base64.b64decode(file.read(-(-b // 3) * 4 - a // 3 * 4))
                flat = np.frombuffer(part[a % 3 : a % 3 + b - a], "<f4")
                yield pa.record_batch([pa.array(range(r["start"], r["end"]), pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(flat), dim).cast(pa.list_(pa.float32()))], ["row", "embedding"])

    def stretches(low: int, high: int, step: int) -> DataFrame:
        n = max(1, -(-(high - low) // step))
        own = spark.range(0, n, 1, min(n, 10_000)).select("id", (low + F.col("id") * step).alias("start"))
        return own.withColumn("end", F.least(F.col("start") + step, F.lit(high))).filter("start < end")

    found = stored(stretches(first, matrix, BLOCK).mapInArrow(ids, "block long, k long, vec_id string"), "vector-ids")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = found.groupBy("block").agg(F.count(F.lit(1)).alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row a block
    if found.count() != rows:
        raise ValueError("the matrix has other rows than the list")
    numbered = found.join(counts, "block").select((F.col("base") + F.col("k")).alias("row"), "vec_id")
    return numbered.join(stretches(0, rows, max(1, SLICE // (4 * dim))).mapInArrow(vectors, "row long, embedding array<float>"), "row")
