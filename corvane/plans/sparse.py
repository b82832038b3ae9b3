"""Queries over chunks and BM25."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.catalog import query, table
from corvane.functions.text import identifier_tokens
from corvane.operators.sparse import Index, bm25, holding, postings, stored_index, window_chunks

_TOKS = r"""flatten(list_transform(list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z0-9_\-:./]+'),
    lambda r: regexp_replace(r, '^[_\-:./]+|[_\-:./]+$', '', 'g')), lambda r: r <> ''),
    lambda r: list_concat([lower(r)], list_filter(list_transform(regexp_split_to_array(regexp_replace(r, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-:./ ]+'),
    lambda p: lower(p)), lambda p: p <> '' AND p <> lower(r)))))"""
CHUNKS = """chunks AS (SELECT 'chunk-' || left(sha256(doc_id::VARCHAR || ':' || i::VARCHAR), 16) AS chunk_id, doc_id, i::INT AS chunk_index,
    (i * 1000)::INT AS start_char, least(length(text), i * 1000 + 1200)::INT AS end_char, substring(text, i * 1000 + 1, 1200) AS content
    FROM (SELECT doc_id, text, unnest(range(0, 1 + greatest(0, ceil((length(text) - 1200) / 1000.0)::BIGINT))) AS i FROM documents WHERE length(text) > 0))"""
TOKENS = CHUNKS + ", ct AS (SELECT chunk_id, doc_id, " + _TOKS.format(x="content") + " AS toks FROM chunks)"
POSTINGS = TOKENS + ", p AS (SELECT chunk_id, tok, len(any_value(toks))::INT AS dl, count(*) AS tf FROM (SELECT chunk_id, toks, unnest(toks) AS tok FROM ct) GROUP BY chunk_id, tok)"
BM25 = (
    POSTINGS
    + ", q AS (SELECT query_id, tok, count(*) AS m FROM (SELECT item_id AS query_id, unnest("
    + _TOKS.format(x="text")
    + """) AS tok FROM benchmark) GROUP BY ALL),
    st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM ct), d AS (SELECT tok, count(*) AS df FROM p GROUP BY tok),
    s AS (SELECT query_id, chunk_id, sum(m * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
          FROM q JOIN p USING (tok) JOIN d USING (tok), st GROUP BY query_id, chunk_id),
    top AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round_even(score * 1e9::DOUBLE, 0) DESC, chunk_id)::INT AS rank FROM s WHERE score > 0)"""
)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_chunks(table(spark, sf_dir, "documents"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of the documents' chunks; built by the first query that needs it."""
    return stored_index(table(spark, sf_dir, "documents"), chunks(spark, sf_dir), "1200/200")


@query("chk_2", f"WITH {CHUNKS} SELECT * FROM chunks")
def chk_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir)


@query("txt_1", "SELECT doc_id, array_to_string(" + _TOKS.format(x="text") + ", ' ') AS toks FROM documents")
def txt_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(identifier_tokens(F.col("text")), " ").alias("toks"))


@query("sp_1", f"WITH {POSTINGS} SELECT chunk_id, tok, dl, tf FROM p")
def sp_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(chunks(spark, sf_dir))


@query("agg_7", f"WITH {TOKENS} SELECT tok, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(toks) AS tok FROM ct) GROUP BY tok")
def agg_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency: distinct within a chunk, then within a document, so that the shuffle carries few repeats."""
    each = chunks(spark, sf_dir).select("doc_id", F.explode_outer(F.array_distinct(identifier_tokens(F.col("content")))).alias("tok")).filter("tok is not null")
    return each.distinct().groupBy("tok").agg(F.count(F.lit(1)).alias("df"))


for _name in ("sp_2", "sp_3", "jn_7", "top_1", "flt_1"):

    @query(_name, f"WITH {BM25} SELECT * FROM top WHERE rank <= 10")
    def sp_2(spark: SparkSession, sf_dir: str) -> DataFrame:
        """BM25 search of the whole questions in the stored index."""
        return bm25(index(spark, sf_dir), questions(spark, sf_dir))


_SWEEP = re.split(r",\s*s AS \(SELECT", BM25)[0]


@query(
    "sp_4",
    f"WITH {_SWEEP}, g AS (SELECT unnest([1.2, 1.5, 2.0])::DOUBLE AS k1, unnest([0.5, 0.75, 1.0])::DOUBLE AS b), s AS (SELECT query_id, k1, b, chunk_id, sum(m * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + k1 * (1 - b + b * dl / avgdl))) AS score FROM q JOIN p USING (tok) JOIN d USING (tok), st, g GROUP BY ALL), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY query_id, k1, b ORDER BY round_even(score * 1e9::DOUBLE, 0) DESC, chunk_id)::INT AS rank FROM s WHERE score > 0) SELECT query_id, k1, b, chunk_id, score, rank FROM t WHERE rank <= 3",
)
def sp_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three settings of the two parameters in one job."""
    grid = F.array(*(F.struct(F.lit(k).alias("k1"), F.lit(b).alias("b")) for k, b in ((1.2, 0.5), (1.5, 0.75), (2.0, 1.0))))
    asked = questions(spark, sf_dir).select("query_id", "text", F.explode(grid).alias("g")).select("query_id", "text", "g.k1", "g.b")
    return bm25(index(spark, sf_dir), asked, 3, by=["k1", "b"]).select("query_id", "k1", "b", "chunk_id", "score", "rank")


@query("sp_5", f"WITH {BM25}, w AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(text, '[A-Za-zà-ÿ]{{9,}}')) AS terms FROM benchmark), h AS (SELECT t.query_id, t.chunk_id, t.rank FROM top t JOIN chunks c USING (chunk_id) JOIN w ON w.query_id = t.query_id WHERE t.rank <= 50 AND len(list_filter(terms, lambda x: contains(c.content, x))) > 0) SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM h) WHERE n <= 10")
def sp_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten hits whose own text holds one of the question's terms (long words stand for identifiers)."""
    from pyspark.sql import Window

    terms = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-zà-ÿ]{9,}"), F.lit(0)))
    hits = bm25(index(spark, sf_dir), questions(spark, sf_dir), 50).join(questions(spark, sf_dir).select("query_id", terms.alias("terms")), "query_id")
    kept = hits.join(chunks(spark, sf_dir).select("chunk_id", "content"), "chunk_id").filter(F.exists("terms", lambda t: F.contains("content", t)))
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter("n <= 10").select("query_id", "chunk_id", "rank")


@query(
    "ev_1",
    f"""WITH {BM25}, gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    ranked AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM (SELECT query_id, doc_id, min(rank) AS r FROM top JOIN chunks USING (chunk_id) WHERE rank <= 50 GROUP BY ALL)),
    h AS (SELECT query_id, g.doc_id, r.rank, count(*) OVER (PARTITION BY query_id) AS golds FROM gold g LEFT JOIN ranked r USING (query_id, doc_id))
    SELECT query_id, golds, count(*) FILTER (rank <= 10) / golds AS recall, coalesce(max(1.0::DOUBLE / rank), 0) AS rr,
           coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10), 0) / list_sum(list_transform(range(1, least(10, golds) + 1), lambda x: 1 / log2(x + 1))) AS ndcg
    FROM h GROUP BY query_id, golds""",
)
def ev_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall@10, nDCG@10 and reciprocal rank of BM25 (EV-1..3, WIN-6): gold documents hold the whole passage."""
    from pyspark.sql import Window

    gold = holding(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage")))
    places = chunks(spark, sf_dir).select("chunk_id", "doc_id")
    hits = bm25(index(spark, sf_dir), questions(spark, sf_dir), 50).join(places, "chunk_id").groupBy("query_id", "doc_id").agg(F.min("rank").alias("r"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("r"))).drop("r")
    near = F.col("rank") <= 10
    each = gold.join(ranked, ["query_id", "doc_id"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("golds"),
        F.count_if(near).alias("found"),
        F.coalesce(F.max(1 / F.col("rank")), F.lit(0.0)).alias("rr"),
        F.coalesce(F.sum(F.when(near, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("golds")).cast("int")), F.lit(0.0), lambda a, x: a + 1 / F.log2(x + 1))
    return each.select("query_id", "golds", (F.col("found") / F.col("golds")).alias("recall"), "rr", (F.col("dcg") / ideal).alias("ndcg"))


_LIVE = POSTINGS.replace("FROM documents WHERE length(text) > 0", "FROM documents WHERE length(text) > 0 AND (doc_id % 10 = 0 OR doc_id % 7 <> 0)")


@query("ing_4", f"WITH {_LIVE} SELECT p.chunk_id, doc_id, tok, dl, tf FROM p JOIN chunks USING (chunk_id)")
def ing_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of nine tenths of the documents, to which deletes and inserts are applied in batches: what a build of the documents that are left gives."""
    import uuid

    from corvane.operators import live_index as L
    from corvane.store import folder

    root = f"{folder(spark)}/corvane/live-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    L.apply_changes(spark, root, docs.limit(0).select("doc_id"), window_chunks(docs.filter("doc_id % 10 <> 0")), batch=64)
    live = L.apply_changes(spark, root, docs.filter("doc_id % 7 = 0").select("doc_id"), window_chunks(docs.filter("doc_id % 10 = 0")), batch=64)
    return live.postings.select("chunk_id", "doc_id", "tok", "dl", "tf")
