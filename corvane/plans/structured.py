"""Queries that chunk notes by their structure; packing has no SQL, tests/test_structured.py compares plain loops and checks the limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.catalog import query, table
from corvane.operators import structured as S
from corvane.plans.fixtures import notes

_SHOWN = ["doc_id", "chunk_index", "breadcrumb", "part", "parts", "start_char", "end_char", "content"]


@query("chk_8")
def chk_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured chunks of 500 characters at most, without merging."""
    return S.structured_chunks(notes(spark, sf_dir), 500).select(*_SHOWN)


@query("chk_8a")
def chk_8a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in spans of 300 characters at most."""
    return S.hard_spans(table(spark, sf_dir, "documents"), 300)


@query("chk_8b")
def chk_8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table row of each document (source, language, whole text), split behind its header and first cell."""
    cell = F.replace(F.regexp_replace("text", r"\s*\n\s*", "<br>"), F.lit("|"), F.lit(r"\|"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" | ", F.concat(F.lit("| "), "source"), "lang", F.concat(cell, F.lit(" |"))).alias("row"))
    return S.table_parts(rows, F.lit("| source | lang | text |\n|---|---|---|"), 400)


@query("chk_8c")
def chk_8c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as fences, dealt to pieces of 300 characters by their lines."""
    fence = F.concat(F.lit("```\n"), F.replace(F.col("text"), F.lit("```"), F.lit("'''")), F.lit("\n```\n"))
    return S.structured_chunks(table(spark, sf_dir, "documents").select("doc_id", fence.alias("note")), 300).select(*_SHOWN)


@query("chk_8d")
def chk_8d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as chk_8 with chunks under 150 characters merged, and the places of what was merged."""
    return S.structured_chunks(notes(spark, sf_dir), 500, least=150).select(*_SHOWN, "members")


@query("chk_10")
def chk_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk a section, small ones merged up along their path, long ones in numbered parts."""
    return S.section_chunks(notes(spark, sf_dir), 400, least=120).select(*_SHOWN)


@query("chk_11")
def chk_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both chunkers under a budget of 100 estimated tokens: one code, another measure."""
    own = notes(spark, sf_dir)
    rows = S.stored_sections(own)
    made = {"structured": S.structured_chunks(own, 100, S.ESTIMATE, 25, sections=rows), "sections": S.section_chunks(own, 100, S.ESTIMATE, 25, sections=rows)}
    both = [df.select(F.lit(name).alias("chunker"), *_SHOWN, F.floor(F.length("content") / 4).cast("int").alias("tokens")) for name, df in made.items()]
    return both[0].unionByName(both[1])
