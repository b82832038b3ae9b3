"""Queries of what surrounds retrieval: settings, fallbacks, batches, notes, cleaning, learning."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.catalog import query, table
from corvane.functions import text as T
from corvane.operators import chunking as C
from corvane.operators import ranker as R
from corvane.operators import upkeep as K
from corvane.operators.structured import typed_blocks
from corvane.plans.evaluation import graded_features
from corvane.plans.fixtures import NOTES, notes
from corvane.plans.ranking import FUSED, fused
from corvane.plans.sparse import CHUNKS, chunks
from corvane.store import stored

_OUT = "concat('entity<|#|>', source, '<|#|>a<|#|>b', chr(10), repeat(concat('relation<|#|>x<|#|>y<|#|>k<|#|>d', chr(10)), CAST(doc_id % 13 + 9 AS INT)), CASE WHEN doc_id % 4 = 0 THEN concat('cut off', chr(10)) WHEN doc_id % 4 = 1 THEN concat('<|COMPLETE|>', chr(10)) ELSE '' END)"


@query(
    "txt_33",
    f"WITH l AS (SELECT doc_id, list_filter(string_split({_OUT}, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents), g AS (SELECT doc_id, ls, len(list_filter(ls, lambda x: regexp_matches(x, '^(entity|relation)<\\|#\\|>'))) / len(ls) AS good, list_filter(ls, lambda x: trim(x) <> '<|COMPLETE|>') AS body FROM l), "
    "b AS (SELECT doc_id, good, CASE WHEN regexp_matches(body[-1], '^(entity|relation)<\\|#\\|>') THEN body ELSE body[:-2] END AS body FROM g) SELECT doc_id, good >= 0.9 AS ok, CASE WHEN good >= 0.9 THEN array_to_string(body, chr(10)) || chr(10) || '<|COMPLETE|>' ELSE '' END AS cleaned FROM b",
)
def txt_33(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training samples: nine tenths of the lines well formed, a last line that is cut off dropped, one terminator."""
    record = r"^(entity|relation)<\|#\|>"
    own = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.expr(_OUT), "\n"), lambda x: F.trim(x) != "").alias("ls"))
    own = own.select("doc_id", (F.size(F.filter("ls", lambda x: x.rlike(record))) / F.size("ls")).alias("good"), F.filter("ls", lambda x: F.trim(x) != "<|COMPLETE|>").alias("body"))
    body = F.when(F.element_at("body", -1).rlike(record), F.col("body")).otherwise(F.slice("body", F.lit(1), F.size("body") - 1))
    ok = F.col("good") >= 0.9
    return own.select("doc_id", ok.alias("ok"), F.when(ok, F.concat(F.array_join(body, "\n"), F.lit("\n<|COMPLETE|>"))).otherwise("").alias("cleaned"))


# Text as JSON, written out so that every engine escapes alike: short escapes, and a blank for other control characters.
_SAID = r"""'"' || regexp_replace(replace(replace(replace(replace(replace({x}, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t'), '[\x00-\x1f\x7f]', ' ', 'g') || '"'"""


@query("txt_35", "SELECT doc_id, '{\"text\":' || " + _SAID.format(x="substring(text, 1, 500)") + " || ',\"words\":[' || array_to_string(list_transform(string_split(text, ' ')[1:20], lambda w: " + _SAID.format(x="substring(w, 1, 40)") + "), ',') || '],\"meta\":{\"source\":' || " + _SAID.format(x="source") + " || ',\"more\":\"...\"}}' AS safe FROM documents")
def txt_35(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values made fit for JSON: long strings and lists are cut, what lies deeper than two levels becomes dots."""
    value = {"text": F.col("text"), "words": [F.split("text", " ")], "meta": {"source": F.col("source"), "more": {"lang": F.col("lang"), "chars": F.col("n_chars").cast("string")}}}
    return table(spark, sf_dir, "documents").select("doc_id", T.safe_json(value, depth=2, longest={"text": 500, "words": 40}, items=20).alias("safe"))


@query("chk_7")
def chk_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of each note by kind: a fence's end depends on its start, so a note goes to an Arrow function."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = [(d, a, b, k) for d, t in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True) if t for a, b, k in typed_blocks(t, True)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["doc_id", "start", "end", "kind"])

    return notes(spark, sf_dir).select("doc_id", "note").mapInArrow(run, "doc_id long, start int, end int, kind string")


@query("top_5", "SELECT n_nationkey + 1 AS top_k, CASE WHEN n_nationkey % 3 = 0 THEN (CASE WHEN n_nationkey < 10 THEN NULL ELSE n_nationkey + 5 END) ELSE greatest(n_nationkey + 1, 2 * (n_nationkey + 1)) END AS fetch, greatest(3 * (CASE WHEN n_nationkey % 3 = 0 THEN (CASE WHEN n_nationkey < 10 THEN NULL ELSE n_nationkey + 5 END) ELSE 2 * (n_nationkey + 1) END), n_nationkey + 1) AS pool FROM nation")
def top_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much to fetch for a top k: what was asked (null if that is too little), else twice k; the pool is three times that."""
    k = F.col("n_nationkey") + 1
    asked = F.when(F.col("n_nationkey") % 3 == 0, F.when(F.col("n_nationkey") < 10, None).otherwise(F.col("n_nationkey") + 5)).otherwise(F.greatest(k, 2 * k))
    return table(spark, sf_dir, "nation").select(k.alias("top_k"), asked.alias("fetch"), F.greatest(3 * asked, k).alias("pool"))


@query("flt_11", "SELECT item_id, CASE WHEN len(regexp_extract_all(text, '[A-Za-z]{8,}')) = 0 THEN 'naive' WHEN item_id % 4 = 0 THEN 'local' ELSE 'hybrid' END AS mode, len(regexp_extract_all(text, '[A-Za-z]{8,}')) = 0 OR item_id % 4 = 1 AS skip_graph FROM benchmark")
def flt_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode of a question: without keywords the plain one, and then no graph plan is built."""
    none = F.regexp_count("text", F.lit("[A-Za-z]{8,}")) == 0
    return table(spark, sf_dir, "benchmark").select("item_id", F.when(none, "naive").when(F.col("item_id") % 4 == 0, "local").otherwise("hybrid").alias("mode"), (none | (F.col("item_id") % 4 == 1)).alias("skip_graph"))


@query("lx_6", "SELECT item_id, CASE WHEN item_id % 10 = 9 THEN 'no roots' WHEN len(regexp_extract_all(text, '[A-Za-z]{9,}')) = 0 THEN 'no terms' ELSE 'ok' END AS reason FROM benchmark")
def lx_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a literal search has no result, before it is made."""
    reason = F.when(F.col("item_id") % 10 == 9, "no roots").when(F.regexp_count("text", F.lit("[A-Za-z]{9,}")) == 0, "no terms").otherwise("ok")
    return table(spark, sf_dir, "benchmark").select("item_id", reason.alias("reason"))


@query("cfg_1", "SELECT n_name, regexp_matches(lower(n_name), '^[a-z][a-z0-9_-]*$') AS valid, sha256('{\"engine\":\"corpus\",\"name\":\"' || lower(n_name) || '\",\"overlap\":' || n_regionkey || '}') AS fingerprint FROM nation")
def cfg_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategies: the name's form, and the fingerprint of the canonical JSON of the settings."""
    name = F.lower("n_name")
    plain = F.to_json(F.struct(F.lit("corpus").alias("engine"), name.alias("name"), F.col("n_regionkey").alias("overlap")))
    return table(spark, sf_dir, "nation").select("n_name", name.rlike("^[a-z][a-z0-9_-]*$").alias("valid"), F.sha2(plain, 256).alias("fingerprint"))


@query("fu_14", "SELECT item_id, CASE WHEN t.twin IS NULL THEN text ELSE text || chr(10) || t.twin END AS question FROM benchmark LEFT JOIN (SELECT doc_id AS item_id, substring(text, 1, 60) AS twin FROM documents WHERE doc_id % 2 = 0) t USING (item_id)")
def fu_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question with its twin in another language, from a table made beforehand."""
    twins = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("item_id"), F.left("text", F.lit(60)).alias("twin"))
    own = table(spark, sf_dir, "benchmark").join(twins, "item_id", "left")
    return own.select("item_id", F.when(F.col("twin").isNull(), F.col("text")).otherwise(F.concat("text", F.lit("\n"), "twin")).alias("question"))


@query("ev_9", f"{FUSED}, b AS (SELECT unnest([20, 40, 80]) AS budget), r AS (SELECT budget, query_id, item_id, sum(length(p_name)) OVER (PARTITION BY budget, query_id ORDER BY rank) AS used FROM b, fused JOIN part ON p_partkey = item_id) SELECT budget, count(*) FILTER (used <= budget) AS kept, count(*) AS total FROM r GROUP BY budget")
def ev_9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pieces fit under several budgets."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.length("p_name").alias("n"))
    own = fused(spark, sf_dir).select("query_id", "item_id", "rank").join(part, "item_id").withColumn("used", F.sum("n").over(Window.partitionBy("query_id").orderBy("rank")))
    own = own.withColumn("budget", F.explode(F.array(F.lit(20), F.lit(40), F.lit(80))))
    return own.groupBy("budget").agg(F.count_if(F.col("used") <= F.col("budget")).alias("kept"), F.count(F.lit(1)).alias("total"))


@query("ing_9", f"WITH {CHUNKS} SELECT chunk_id, 1 + length(substring(text, 1, start_char)) - length(replace(substring(text, 1, start_char), chr(10), '')) AS start_line, 1 + length(substring(text, 1, end_char - 1)) - length(replace(substring(text, 1, end_char - 1), chr(10), '')) AS end_line FROM chunks JOIN documents USING (doc_id)")
def ing_9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines filled in for chunks that lack them: found again in their document, then counted."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = C.located(chunks(spark, sf_dir).select("doc_id", "chunk_id", "content", (F.col("start_char") - 5).alias("hint")), texts).join(texts, "doc_id")
    line = lambda at: C.line_at(F.col("text"), at).cast("long")
    return found.select("chunk_id", line(F.col("start")).alias("start_line"), line(F.col("start") + F.length("content") - 1).alias("end_line"))


@query("ing_13", "SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source")
def ing_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after a purge."""
    gone = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(gone, "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("ing_15")
def ing_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload parts under limits of count and bytes. Documents are dealt in ranges of ids, and each range fills its parts one after the other, so that the limits hold for all and only a range's last part may be small."""
    import pyarrow as pa

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = size = count = 0
        for x in batches:
            numbers = []
            for n in x.column("bytes").to_pylist():
                n = n or 0
                if count and (count >= 50 or size + n > 100_000):
                    part, size, count = part + 1, 0, 0
                size, count = size + n, count + 1
                numbers.append(part)
            yield pa.record_batch([x.column("doc_id"), x.column("range"), pa.array(numbers, pa.int32()), x.column("bytes")], ["doc_id", "range", "part", "bytes"])

    own = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return own.withColumn("range", F.spark_partition_id()).select("doc_id", "range", "bytes").mapInArrow(fill, "doc_id long, range int, part int, bytes long")


@query("ing_23", f"WITH {NOTES} SELECT doc_id, '[Document: ' || lower(source) || '-' || doc_id || ' | Section: memory | Date: 2024-05-01]' || chr(10) || chr(10) || 'importance: ' || CASE WHEN doc_id % 5 = 0 THEN 'high' ELSE 'normal' END || chr(10) || 'tags: ' || array_to_string([source, lang], ', ') || chr(10) || chr(10) || note AS staged FROM notes")
def ing_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note to remember, staged with its header, importance and tags."""
    head = T.source_header(F.concat_ws("-", F.lower("source"), F.col("doc_id").cast("string")), F.lit("memory"), F.lit("2024-05-01"))
    level = F.when(F.col("doc_id") % 5 == 0, "high").otherwise("normal")
    return notes(spark, sf_dir).select("doc_id", F.concat(head, F.lit("importance: "), level, F.lit("\ntags: "), F.concat_ws(", ", "source", "lang"), F.lit("\n\n"), "note").alias("staged"))


@query("src_15", "SELECT path, arg_max(flag, k) AS indexed, arg_max(k, k) AS entry FROM (SELECT 'p' || (doc_id % 30) AS path, doc_id % 2 = 0 AS flag, doc_id AS k FROM documents) GROUP BY path")
def src_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of sources: the last entry of a path wins."""
    own = table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), (F.col("doc_id") % 30).cast("string")).alias("path"), (F.col("doc_id") % 2 == 0).alias("flag"), F.col("doc_id").alias("k"))
    return own.groupBy("path").agg(F.max_by("flag", "k").alias("indexed"), F.max("k").alias("entry"))


@query("snk_6", "SELECT count(*) AS n, substring(sha256(sum(('0x' || substring(d, 1, 12))::BIGINT::HUGEINT)::VARCHAR || ':' || sum(('0x' || substring(d, 13, 12))::BIGINT::HUGEINT)::VARCHAR), 1, 16) AS digest FROM (SELECT sha256(url || chr(10) || sha256(html)) AS d FROM pages)")
def snk_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle's digest over its tree, whatever the order of its members."""
    return K.fingerprint_of(table(spark, sf_dir, "pages"), F.concat("url", F.lit("\n"), F.sha2("html", 256)))


@query("dn_3")
def dn_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks embedded in batches of 48: there is no model here, so words are hashed into 64 places; the function is what a caller replaces."""
    import numpy as np
    import pandas as pd

    def embed(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), 64))
        for k, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[k, h % 64] += 1 - 2 * (h >> 31)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for at in range(0, len(x), 48):
                part = x[at : at + 48]
                v = embed(part.content.tolist())
                if v.shape != (len(part), 64):
                    raise ValueError("the embedder returned another shape")
                yield pd.DataFrame({"chunk_id": part.chunk_id, "embedding": list(v)})

    return chunks(spark, sf_dir).select("chunk_id", "content").mapInPandas(run, "chunk_id string, embedding array<double>")


#: The learner's features, in order.
LEARNT = ["dense_norm", "sparse_norm", "grep_norm", "dense", "sparse", "grep", "fused", "gap", "base_rr", "dense_rr", "sparse_rr", "grep_rr", "channels", "log_chars", "code"]


@query("ltr_6")
def ltr_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LambdaRank on four fifths of the queries; each item of the others with its label, the model's score and the place that it gives. The tests compare nDCG with the base order."""
    own = stored(graded_features(spark, sf_dir).select("query_id", "item_id", "rank", "label", F.array(*LEARNT).alias("x")), "features")
    held = F.pmod(F.xxhash64("query_id"), F.lit(5)) == 0
    model = R.fit(own.filter(~held), len(LEARNT), trees=8)
    scored = own.filter(held).select("query_id", "item_id", "rank", "label", R.score(model, F.col("x")).alias("score"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.rint(F.col("score") / 1e-9)), "rank")))
