"""Inputs that several families of queries share, as expressions that both Spark and the SQL of the comparison read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.catalog import table

_ID = "CAST(doc_id AS STRING)"
#: A Markdown note made of a document: front matter, header, headings, a table, a list and fences come and go with the id.
NOTE = f"""concat(
    CASE WHEN doc_id % 3 = 0 THEN concat('---', chr(10), 'name: ', CASE WHEN doc_id % 6 = 0 THEN 'DEPRECATED - ' ELSE 'note on superseded ' END, source, chr(10),
        CASE WHEN doc_id % 9 = 0 THEN 'updated: "2023-0' ELSE 'date: 2023-0' END, CAST(doc_id % 9 + 1 AS STRING), '-1', CAST(doc_id % 10 AS STRING), chr(10), '---', chr(10)) ELSE '' END,
    CASE WHEN doc_id % 2 = 0 THEN concat('[Document: d', {_ID}, '.md | Section: ', source, ' | Date: ', CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE concat('2024-0', CAST(doc_id % 9 + 1 AS STRING), '-0', CAST(doc_id % 9 + 1 AS STRING)) END, ']', chr(10), chr(10)) ELSE '' END,
    CASE WHEN doc_id % 5 <> 4 THEN concat('# Title_', {_ID}, ' of camelCase', chr(10), chr(10)) ELSE '' END,
    substring(text, 1, 400), chr(10), chr(10), '## Part A', chr(10),
    CASE WHEN doc_id % 7 = 0 THEN '**This note is DEPRECATED.** ' ELSE '' END, substring(text, 401, 300), chr(10),
    CASE WHEN doc_id % 4 = 1 THEN concat('```', chr(10), '# not a heading', chr(10), substring(text, 701, 500), chr(10), '```', chr(10)) ELSE '' END,
    CASE WHEN doc_id % 4 = 2 THEN concat('| a | b |', chr(10), '|---|---|', chr(10), '| 1 | 2 |', chr(10)) ELSE '' END,
    '### Deep ', {_ID}, chr(10), substring(text, 1201, 200), chr(10), '## Part B', chr(10), '- hyp:', substring(sha2_, 1, 8), ' see ops/run_', {_ID}, '.md and "Q7X42"', chr(10), substring(text, 1401, 150))"""
NOTES = f"notes AS (SELECT doc_id, source, lang, concat('/kb/', CASE WHEN doc_id % 5 = 0 THEN 'ingested/' ELSE '' END, source, '/2024-0', CAST(doc_id % 9 + 1 AS STRING), '-11_d', {_ID}, CASE WHEN doc_id % 4 = 0 THEN '.MD' WHEN doc_id % 4 = 1 THEN '.py' WHEN doc_id % 4 = 2 THEN '.json' ELSE '.x' END) AS path, {NOTE} AS note FROM (SELECT *, sha256(text) AS sha2_ FROM documents))"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, path, note): a Markdown note for each document."""
    docs = table(spark, sf_dir, "documents").withColumn("sha2_", F.sha2("text", 256))
    path = NOTES[NOTES.index("concat('/kb/'") : NOTES.index(" AS path")]
    return docs.select("doc_id", "source", "lang", F.expr(path).alias("path"), F.expr(NOTE).alias("note"))
