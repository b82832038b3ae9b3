"""Queries over sources and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.catalog import query, table
from corvane.functions import text as T
from corvane.sources import files as S
from corvane.store import folder
from corvane.streaming import ingest as stream

# A listing made of the parts: folders, names and sizes come from their columns.
_LISTING = "files AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'node_modules/x/' WHEN 1 THEN 'a/b/' WHEN 2 THEN '.git/' WHEN 3 THEN '' ELSE 'notes/' END || CASE WHEN p_partkey % 11 = 0 THEN 'secrets_' WHEN p_partkey % 13 = 0 THEN '.env_' ELSE 'f' END || p_partkey || CASE p_partkey % 6 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.JSON' WHEN 3 THEN '.py' WHEN 4 THEN '.pkl' ELSE '.json' END AS path, (p_retailprice * 1500)::BIGINT AS size FROM part)"
_GLOB = "(regexp_matches(path, '(^|/)(node_modules|\\.git)/') OR regexp_matches(path, '(^|/)(\\.env|secrets)[^/]*$') OR regexp_matches(path, '\\.pkl$') OR NOT regexp_matches(path, '\\.(md|txt|json|py)$'))"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    place = F.when(k % 7 == 0, "node_modules/x/").when(k % 7 == 1, "a/b/").when(k % 7 == 2, ".git/").when(k % 7 == 3, "").otherwise("notes/")
    name = F.when(k % 11 == 0, "secrets_").when(k % 13 == 0, ".env_").otherwise("f")
    end = F.when(k % 6 == 0, ".md").when(k % 6 == 1, ".txt").when(k % 6 == 2, ".JSON").when(k % 6 == 3, ".py").when(k % 6 == 4, ".pkl").otherwise(".json")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(place, name, k.cast("string"), end).alias("path"), F.round(F.col("p_retailprice") * 1500).cast("long").alias("size"))


for _name in ("src_2", "src_4"):

    @query(_name, f"WITH {_LISTING} SELECT path, NOT {_GLOB} AS taken FROM files")
    def globs(spark: SparkSession, sf_dir: str) -> DataFrame:
        return listing(spark, sf_dir).select("path", (~S.matches(F.col("path"), S.EXCLUDE) & S.matches(F.col("path"), S.INCLUDE)).alias("taken"))


@query("src_3", f"WITH {_LISTING} SELECT path, regexp_matches(path, '^notes/') OR regexp_matches(path, '7\\.md$') AS ignored FROM files")
def src_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patterns of an ignore file."""
    return listing(spark, sf_dir).select("path", S.matches(F.col("path"), S.ignored("# comment\n\nnotes/\n*7.md\n")).alias("ignored"))


@query("src_6", f"WITH {_LISTING} SELECT path, CASE WHEN {_GLOB} THEN 'glob' WHEN size > 2097152 THEN 'size' ELSE 'ok' END AS verdict FROM files")
def src_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select("path", S.verdict(F.col("path"), F.col("size")).alias("verdict"))


@query("src_7", f"WITH {_LISTING}, v AS (SELECT CASE WHEN {_GLOB} THEN 'glob' WHEN size > 2097152 THEN 'size' ELSE 'ok' END AS v, lower(regexp_extract(path, '\\.[^.]*$')) AS e FROM files) SELECT count(*) AS seen, count(*) FILTER (v = 'ok') AS accepted, count(*) FILTER (v = 'glob') AS skipped_glob, count(*) FILTER (v = 'size') AS skipped_size, 0::BIGINT AS skipped_binary, count(*) FILTER (v = 'ok' AND e = '.md') AS markdown, count(*) FILTER (v = 'ok' AND e = '.py') AS python, count(*) FILTER (v = 'ok' AND e = '.json') AS json, count(*) FILTER (v = 'ok' AND e = '.txt') AS text FROM v")
def src_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stats(listing(spark, sf_dir).select(S.verdict(F.col("path"), F.col("size")).alias("verdict"), T.kind_of(F.col("path")).alias("kind")))


@query("src_19", f"WITH {_LISTING} SELECT lower(regexp_extract(path, '\\.[^.]*$')) AS ext, count(*) AS n, sum(size)::BIGINT AS bytes FROM files GROUP BY 1")
def src_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and bytes by suffix, for an estimate of cost."""
    return listing(spark, sf_dir).groupBy(F.lower(F.regexp_extract("path", r"\.[^.]*$", 0)).alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("src_16", "SELECT 'api:' || doc_id AS doc_id, sha256(text) AS fp, length(text) AS chars FROM documents WHERE trim(text) <> ''")
def src_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that come from no file: any table with an id and a text."""
    return table(spark, sf_dir, "documents").filter("trim(text) <> ''").select(F.concat(F.lit("api:"), F.col("doc_id").cast("string")).alias("doc_id"), T.fingerprint(F.col("text")).alias("fp"), F.length("text").cast("long").alias("chars"))


@query(
    "src_17",
    "WITH u AS (SELECT n_nationkey AS ord, CASE n_nationkey % 8 WHEN 0 THEN '/abs.md' WHEN 1 THEN 'a/../b.md' WHEN 2 THEN 'x.exe' WHEN 3 THEN 'same.md' ELSE n_name || '.txt' END AS name, CASE WHEN n_nationkey % 8 = 4 THEN '' WHEN n_nationkey % 8 = 5 THEN '  ' ELSE repeat('x', n_nationkey) END AS c FROM nation), "
    "w AS (SELECT *, row_number() OVER (ORDER BY ord) AS n, sum(length(c)) OVER (ORDER BY ord) AS total, row_number() OVER (PARTITION BY name ORDER BY ord) AS same FROM u) SELECT ord, CASE WHEN n > 20 THEN 'too_many_files' WHEN starts_with(name, '/') OR contains(name, '..') THEN 'unsafe_filename' WHEN ends_with(name, '.exe') THEN 'unsupported_file_type' WHEN same > 1 THEN 'duplicate_filename' WHEN length(c) > 18 THEN 'file_too_large' WHEN total > 150 THEN 'upload_too_large' WHEN trim(c) = '' THEN 'empty_file' END AS reason FROM w WHERE n <= 21",
)
def src_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    name = F.when(k % 8 == 0, "/abs.md").when(k % 8 == 1, "a/../b.md").when(k % 8 == 2, "x.exe").when(k % 8 == 3, "same.md").otherwise(F.concat("n_name", F.lit(".txt")))
    content = F.when(k % 8 == 4, "").when(k % 8 == 5, "  ").otherwise(F.expr("repeat('x', n_nationkey)"))
    uploads = table(spark, sf_dir, "nation").select(k.alias("ord"), name.alias("name"), content.cast("binary").alias("content"))
    return S.checked_uploads(uploads, 20, 18, 150).select("ord", "reason")


@query("str_1", "SELECT doc_id, max(sha256(coalesce(text, ''))) AS fp FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id")
def str_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint state after a stream has read the documents in micro-batches."""
    root = f"{folder(spark)}/corvane/stream-{uuid.uuid4().hex}"
    shape = table(spark, sf_dir, "documents").schema
    stream.ingest(spark, f"{sf_dir}/document[s].parquet", root, shape)  # a pattern may be a file as well as a folder
    return stream.state(spark, root)


@query("str_2", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def str_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.late_counts(table(spark, sf_dir, "events"))
