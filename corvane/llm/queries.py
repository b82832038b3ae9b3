"""The queries of this subpackage, over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.chat import repaired

    return repaired(table(spark, sf_dir, "conversations")).drop("text")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corvane.llm.bpe import encoded

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False, reach=3)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corvane.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.lines import without_repeated_lines

    return without_repeated_lines(table(spark, sf_dir, "documents"), shortest=10).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.license import license_spans

    return license_spans(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.toxicity import toxicity, trained

    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, trained(docs, table(spark, sf_dir, "labels")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.pii import report

    return report(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corvane.llm.token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.runs import word_runs

    return word_runs(table(spark, sf_dir, "documents"), rewrite=True)


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corvane.llm.align import alignment_report

    return alignment_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


SQL = {
    "op5_exact": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
        r AS (SELECT *, row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id,
                     count(*) OVER (PARTITION BY text_sha256) AS group_size
              FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r""",
    "op6_lines": r"""
        WITH l AS (SELECT doc_id, i - 1 AS pos, raw, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
                   FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
        k AS (SELECT norm, min((doc_id, pos)) AS first FROM l WHERE norm <> '' GROUP BY norm),
        v AS (SELECT DISTINCT norm, first, unnest(list_concat([norm], list_transform(range(1, length(norm) + 1), lambda j: substring(norm, 1, j - 1) || substring(norm, j + 1)))) AS v
              FROM k WHERE length(norm) >= 10),
        n AS (SELECT a.norm, min(b.first) AS other FROM v a JOIN v b ON a.v = b.v AND a.norm <> b.norm AND levenshtein(a.norm, b.norm) <= 1 GROUP BY a.norm),
        e AS (SELECT k.norm, coalesce(least(first, other), first) AS earliest FROM k LEFT JOIN n ON n.norm = k.norm),
        m AS (SELECT doc_id, pos, raw, coalesce((doc_id, pos) > earliest, false) AS gone FROM l LEFT JOIN e ON e.norm = l.norm)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256
        FROM m GROUP BY doc_id
        UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL""",
}


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
