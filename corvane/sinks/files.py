"""Sinks: stores that are swapped in whole, guarded folders, sidecars and rows for other tools."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.upkeep import fingerprint_of


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def guard(spark: SparkSession, path: str, force: bool = False) -> None:
    """SNK-2: refuse a folder that holds something which isn't a store of ours, or a live graph index; force allows the former."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return
    names = {s.getPath().getName() for s in fs.listStatus(at)}
    if any(n.endswith(".graphml") for n in names):
        raise FileExistsError(f"{path} holds a live graph index")
    if names and "manifest.json" not in names and not force:
        raise FileExistsError(f"{path} is not empty and not a chunk store")


def write_store(chunks: DataFrame, path: str, settings: dict | None = None, force: bool = False) -> dict:
    """SNK-1, SNK-4: write chunks (or vectors) as Parquet with a manifest beside a fingerprint, staged and swapped in whole; the old store comes back if the swap fails. Returns the manifest."""
    spark = chunks.sparkSession
    guard(spark, path, force)
    stage, old = f"{path}.stage-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    chunks.write.parquet(f"{stage}/rows")
    rows = spark.read.parquet(f"{stage}/rows")
    mark = fingerprint_of(rows, F.to_json(F.struct(*sorted(rows.columns))), 64).first()
    manifest = {"rows": mark.n, "fingerprint": mark.digest, "columns": sorted(rows.columns), "settings": settings or {}}
    fs, at = _fs(spark, f"{stage}/manifest.json")
    out = fs.create(at)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    where, hidden = _fs(spark, path)[1], _fs(spark, old)[1]
    there = fs.exists(where)
    if there and not fs.rename(where, hidden):
        raise OSError(f"cannot move {path} away")
    if not fs.rename(_fs(spark, stage)[1], where):
        if there:
            fs.rename(hidden, where)
        raise OSError(f"cannot move the new store to {path}")
    if there:
        fs.delete(hidden, True)
    return manifest


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A store's rows, checked against its manifest."""
    manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/manifest.json").collect()))
    rows = spark.read.parquet(f"{path}/rows")
    mark = fingerprint_of(rows, F.to_json(F.struct(*sorted(rows.columns))), 64).first()
    if (mark.n, mark.digest) != (manifest["rows"], manifest["fingerprint"]):
        raise ValueError(f"{path} does not hold what its manifest says")
    return rows


def write_ranking_rows(rows: DataFrame, path: str, names: list[str]) -> None:
    """SNK-5: learnt-ranking rows as JSON lines; the header row with the feature names is a file of its own in the folder."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").json(path)
    spark.createDataFrame([(names,)], "feature_names array<string>").coalesce(1).write.mode("append").json(path)


def write_sidecars(sections: DataFrame, path: str) -> None:
    """SNK-8: a note's sections as one JSON document, a row a note, partitioned by a hash of the id."""
    cells = [c for c in sections.columns if c != "doc_id"]
    notes = sections.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*cells))).alias("sections"))  # a note's own
    out = notes.select(F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("part"), "doc_id", F.to_json("sections").alias("manifest"))
    out.write.mode("overwrite").partitionBy("part").json(path)


def put_artifacts(artifacts: DataFrame, root: str) -> DataFrame:
    """SNK-7: store artifacts (key, content as binary) by the digest of their content; returns (key, digest, bytes).

    Equal contents are stored once in a call. Folders go by the digest's first two digits,
    so that a read opens those of its digests alone. Null contents are left out.
    """
    own = artifacts.filter("content is not null").select("key", F.sha2("content", 256).alias("digest"), "content")
    once = own.groupBy("digest").agg(F.first("content").alias("content")).withColumn("part", F.left("digest", F.lit(2)))
    once.repartition("part").write.mode("append").partitionBy("part").parquet(f"{root}/contents")
    known = own.select("key", "digest", F.length("content").cast("long").alias("bytes"))
    known.write.mode("append").parquet(f"{root}/keys")
    return known


def get_artifacts(spark: SparkSession, root: str, asked: DataFrame) -> DataFrame:
    """SNK-7: (digest, content) of the asked digests (column digest), each checked against its content as it is read: one that was damaged ends the read. What isn't there has no row."""
    parts = [r.part for r in asked.select(F.left("digest", F.lit(2)).alias("part")).distinct().collect()]  # 256 at most
    held = spark.read.schema("digest string, content binary, part string").parquet(f"{root}/contents").filter(F.col("part").isin(parts))
    found = held.join(asked.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.first("content").alias("content"))
    said = F.concat(F.lit("an artifact is damaged: "), F.col("digest"))
    return found.select("digest", F.when(F.sha2("content", 256) == F.col("digest"), F.col("content")).otherwise(F.raise_error(said).cast("binary")).alias("content"))


def export_store(spark: SparkSession, path: str, to: str) -> dict:
    """SNK-11: a store of write_store(), checked, copied to another folder; the copy is a store too. Returns its manifest."""
    rows = read_store(spark, path)
    manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/manifest.json").collect()))
    return write_store(rows, to, manifest["settings"])


def import_store(spark: SparkSession, exported: str, path: str, force: bool = False) -> dict:
    """SNK-11: an exported store put in place of the one at path, in whole or not at all; a copy that isn't what its manifest says is refused."""
    mark = json.loads("\n".join(r.value for r in spark.read.text(f"{exported}/manifest.json").collect()))
    made = write_store(read_store(spark, exported), path, mark["settings"], force)
    if made["fingerprint"] != mark["fingerprint"]:
        raise ValueError(f"{path} does not hold what was exported")
    return made
