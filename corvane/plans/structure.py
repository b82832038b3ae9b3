"""Queries over the structure of notes, their chunks, literal search, and the context that is made of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.catalog import query, table
from corvane.functions import text as T
from corvane.operators import chunking as C
from corvane.operators import fusion as U
from corvane.operators.lists import each_list
from corvane.operators.evaluation import percentiles
from corvane.plans.fixtures import NOTES, notes
from corvane.plans.ranking import FUSED, fused
from corvane.plans.sparse import CHUNKS, chunks

LINES = rf"""WITH {NOTES}, l0 AS (SELECT doc_id, string_split(note, chr(10)) AS ls FROM notes), l1 AS (SELECT doc_id, unnest(ls) AS line, (generate_subscripts(ls, 1) - 1)::INT AS pos FROM l0),
    l2 AS (SELECT *, regexp_matches(line, '^[ \t]*(?:```|~~~)') AS mark, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l1),
    lines AS (SELECT doc_id, pos, line, start, mark OR sum(mark::INT) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 AS fenced FROM l2),
    heads AS (SELECT doc_id, pos, start, length(regexp_extract(line, '^(#{{1,6}})[ \t]+(\S.*?)[ \t]*$', 1))::INT AS level, regexp_extract(line, '^(#{{1,6}})[ \t]+(\S.*?)[ \t]*$', 2) AS title FROM lines WHERE NOT fenced AND regexp_matches(line, '^(#{{1,6}})[ \t]+(\S.*?)[ \t]*$'))"""


@query("win_10", f"{LINES} SELECT doc_id, pos, start, fenced FROM lines")
def win_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.lines(notes(spark, sf_dir)).select("doc_id", "pos", "start", "fenced")


@query("chk_3", f"{LINES} SELECT * FROM heads")
def chk_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.headings(notes(spark, sf_dir))


@query(
    "chk_4",
    f"{LINES} SELECT h.doc_id, h.pos, (SELECT string_agg(g.title, ' > ' ORDER BY g.pos) FROM heads g WHERE g.doc_id = h.doc_id AND g.pos <= h.pos AND NOT EXISTS (FROM heads x WHERE x.doc_id = g.doc_id AND x.pos > g.pos AND x.pos <= h.pos AND x.level <= g.level)) AS path FROM heads h",
)
def chk_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.paths(C.headings(notes(spark, sf_dir))).select("doc_id", "pos", F.array_join("path", " > ").alias("path"))


@query("chk_6", f"{LINES} SELECT doc_id, start, pos + 1 AS line FROM lines")
def chk_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of an offset: counted in the text before it, here for every line's start."""
    own = notes(spark, sf_dir).select("doc_id", "note")
    return C.lines(own).join(own, "doc_id").select("doc_id", "start", C.line_at(F.col("note"), F.col("start").cast("int")).alias("line"))


@query(
    "chk_9",
    rf"""{LINES}, s AS (SELECT *, regexp_matches(line, '^(#{{1,6}})[ \t]+(\S.*?)[ \t]*$') AND NOT fenced AS head FROM lines), n AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS ord FROM s)
    SELECT doc_id, ord, coalesce(max(length(regexp_extract(line, '^(#{{1,6}})', 1))) FILTER (head), 0)::INT AS level, coalesce(max(regexp_extract(line, '^(#{{1,6}})[ \t]+(\S.*?)[ \t]*$', 2)) FILTER (head), '') AS title, min(pos) + 1 AS start_line, max(pos + 1) FILTER (trim(line) <> '') AS end_line,
        bool_or(NOT fenced AND regexp_matches(line, '^[ \t]*\|')) AS has_table, bool_or(fenced) AS has_code, sum(length(line))::BIGINT AS chars, greatest(1, sum(length(line))::BIGINT // 4)::BIGINT AS tokens, any_value(doc_title) AS doc_title
    FROM n JOIN (SELECT doc_id, coalesce(first, regexp_extract(path, '([^/]*?)(\.[^./]*)?$', 1)) AS doc_title FROM notes LEFT JOIN (SELECT doc_id, arg_min(title, pos) AS first FROM heads WHERE level = 1 GROUP BY 1) USING (doc_id)) USING (doc_id) GROUP BY doc_id, ord HAVING end_line IS NOT NULL""",
)
def chk_9(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = notes(spark, sf_dir)
    return C.sections(own).join(C.titles(own), "doc_id")


@query("chk_1")
def chk_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of Markdown notes: packing has no SQL; the tests check whole coverage and literal notes."""
    return C.chunk_notes(notes(spark, sf_dir), size=500, overlap=60)


@query("chk_5")
def chk_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_notes(notes(spark, sf_dir), size=300, overlap=40)


@query("chk_12", f"WITH {CHUNKS}, h AS (SELECT c.*, CASE WHEN chunk_index % 3 = 0 THEN start_char + 700 ELSE start_char - 50 END AS hint, text FROM chunks c JOIN documents USING (doc_id)) SELECT chunk_id, CASE WHEN strpos(substring(text, greatest(hint, 0) + 1), content) > 0 THEN greatest(hint, 0) + strpos(substring(text, greatest(hint, 0) + 1), content) - 1 WHEN strpos(text, content) > 0 THEN strpos(text, content) - 1 END AS start FROM h")
def chk_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks found again in their documents, from a hint that is wrong for some."""
    own = chunks(spark, sf_dir).select("doc_id", "chunk_id", "content", F.when(F.col("chunk_index") % 3 == 0, F.col("start_char") + 700).otherwise(F.col("start_char") - 50).alias("hint"))
    return C.located(own, table(spark, sf_dir, "documents").select("doc_id", "text")).select("chunk_id", F.col("start").cast("long").alias("start"))


@query("chk_13", f"WITH {CHUNKS} SELECT chunk_id, lag(chunk_id) OVER w AS before, lead(chunk_id) OVER w AS after FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)")
def chk_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each chunk: their ids follow from the document and the index, so that nothing is shuffled."""
    index = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length("text") - 1200) / F.lit(1000)).cast("int")))
    each = table(spark, sf_dir, "documents").filter(F.length("text") > 0).select("doc_id", F.size(index).alias("count"), F.explode(index).alias("i"))
    near = lambda step, there: F.when(there, T.chunk_id(F.col("doc_id"), F.col("i") + step))
    return each.select(T.chunk_id(F.col("doc_id"), F.col("i")).alias("chunk_id"), near(-1, F.col("i") > 0).alias("before"), near(1, F.col("i") + 1 < F.col("count")).alias("after"))


@query("chk_14", f"WITH {CHUNKS}, f AS (SELECT doc_id, chunk_index, content, substring(text, 1000 * (chunk_index + 1) - 40, 300) AS fact, lead(content) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS after FROM chunks JOIN documents USING (doc_id)) SELECT doc_id, chunk_index, NOT contains(content, fact) AND NOT contains(after, fact) AND contains(content || substring(after, 201), fact) AS split FROM f WHERE after IS NOT NULL AND length(fact) = 300")
def chk_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a fact lies across two chunks in a row, in neither of them whole."""
    own = chunks(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    own = own.select("doc_id", "chunk_index", "content", F.substring("text", 1000 * (F.col("chunk_index") + 1) - 40, F.lit(300)).alias("fact"), F.lead("content").over(Window.partitionBy("doc_id").orderBy("chunk_index")).alias("after"))
    split = ~F.contains("content", "fact") & ~F.contains("after", "fact") & F.contains(F.concat("content", F.substring("after", 201, 1 << 20)), F.col("fact"))
    return own.filter("after is not null and length(fact) = 300").select("doc_id", "chunk_index", split.alias("split"))


@query("chk_15", f"WITH {CHUNKS} SELECT doc_id, sha256(string_agg(CASE WHEN chunk_index = 0 THEN content ELSE substring(content, 201) END, '' ORDER BY chunk_index)) AS digest FROM chunks GROUP BY doc_id")
def chk_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts rebuilt from their chunks, without the overlaps; a group is one document."""
    part = F.when(F.col("chunk_index") == 0, F.col("content")).otherwise(F.substring("content", 201, 1 << 20))
    own = chunks(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", part.alias("p")))).alias("ps"))
    return own.select("doc_id", F.sha2(F.array_join(F.transform("ps", lambda x: x["p"]), ""), 256).alias("digest"))


@query("chk_16", f"WITH {CHUNKS}, n AS (SELECT source, length(content) AS chars FROM chunks JOIN documents USING (doc_id)) SELECT source, count(*) AS n, avg(chars) AS mean, list_sort(list(chars))[round_even(0.5::DOUBLE * (count(*) - 1), 0)::BIGINT + 1] AS p50, list_sort(list(chars))[round_even(0.95::DOUBLE * (count(*) - 1), 0)::BIGINT + 1] AS p95 FROM n GROUP BY source")
def chk_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the chunks by source."""
    own = chunks(spark, sf_dir).select("doc_id", F.length("content").cast("long").alias("chars")).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    sums = own.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("chars").alias("mean"))
    return sums.join(percentiles(own.select("source", "chars"), ["source"], "chars", {"p50": 0.5, "p95": 0.95}), "source")


@query("chk_17", f"WITH {CHUNKS}, g AS (SELECT 'chunk-' || md5(content) AS id, count(*) AS copies, min((doc_id, chunk_index)) AS f, count(DISTINCT content) > 1 AS collision FROM chunks GROUP BY 1) SELECT id, copies, f[1] AS doc_id, f[2] AS chunk_index, collision FROM g")
def chk_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by the hash of their content: copies are skipped, the first stays, and texts that collide would show."""
    own = chunks(spark, sf_dir).groupBy(F.concat(F.lit("chunk-"), F.md5("content")).alias("id")).agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "chunk_index")).alias("f"), F.min(F.xxhash64("content")).alias("a"), F.max(F.xxhash64("content")).alias("b")
    )
    return own.select("id", "copies", "f.doc_id", "f.chunk_index", (F.col("a") != F.col("b")).alias("collision"))


# Literal search: identifiers of each note's neighbour are looked for in it.
_TERMS = "t AS (SELECT unnest(['camelCase', 'Q7X42', 'Title_1', 'part a', 'hyp:1']) AS term, unnest(range(5)) AS k)"
TERMS = ["camelCase", "Q7X42", "Title_1", "part a", "hyp:1"]
_GREP = f"""{LINES}, {_TERMS}, h AS (SELECT doc_id, pos, line, k, term FROM lines, t WHERE contains(lower(line), lower(term))), capped AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM h) WHERE n <= 20)"""


def grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LX-2: (doc_id, pos, line, k, term): lines that hold a term, whatever the case, up to 20 lines a note. A query has eight terms at most, so they are an array, not a join."""
    terms = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("term")) for k, t in enumerate(TERMS)))
    own = C.lines(notes(spark, sf_dir)).select("doc_id", "pos", "line", F.explode(F.filter(terms, lambda t: F.contains(F.lower(F.col("line")), F.lower(t["term"])))).alias("t"))
    own = own.select("doc_id", "pos", "line", "t.k", "t.term").withColumn("n", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("pos")))
    return own.filter("n <= 20").drop("n")


@query("lx_1", f"WITH {NOTES}, r AS (SELECT doc_id, list_transform(regexp_extract_all(note, '[A-Za-z0-9_\\-:./]+'), lambda r: regexp_replace(r, '^[_\\-:./]+|[_\\-:./]+$', '', 'g')) AS rs FROM notes), u AS (SELECT doc_id, unnest(rs) AS term, generate_subscripts(rs, 1) AS k FROM r), f AS (SELECT doc_id, lower(term) AS low, min(k) AS k FROM u WHERE regexp_matches(term, '^[A-Za-z][A-Za-z0-9]*:[0-9A-Za-z]{{4,}}$') OR (contains(term, '_') AND regexp_matches(term, '[^_]')) OR regexp_matches(term, '[a-z0-9][A-Z]') OR (regexp_matches(term, '^[A-Za-z0-9]{{3,}}$') AND regexp_matches(term, '[A-Za-z]') AND regexp_matches(term, '[0-9]')) GROUP BY ALL) SELECT doc_id, low AS term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM f) WHERE n <= 8")
def lx_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight identifiers of a question."""
    each = notes(spark, sf_dir).select("doc_id", F.posexplode_outer(T.identifier_runs(F.col("note"))).alias("k", "term")).filter(T.is_identifier(F.col("term")) & ~F.lower("term").isin(T.GREP_STOP))
    first = each.groupBy("doc_id", F.lower("term").alias("term")).agg(F.min("k").alias("k"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("k"))).filter("n <= 8").select("doc_id", "term")


@query("lx_2", f"{_GREP} SELECT doc_id, pos, term FROM capped")
def lx_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep(spark, sf_dir).select("doc_id", "pos", "term")


_WEIGHT = "CASE WHEN regexp_matches(lower(line), '(^|[^a-z0-9_])' || lower(term) || '($|[^a-z0-9_])') THEN 2 ELSE 1 END"
_SCORES = f"{_GREP}, w AS (SELECT doc_id, k, pos, {_WEIGHT} AS weight, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS n FROM capped), s AS (SELECT doc_id, sum(weight) AS total, count(DISTINCT k) AS terms FROM w WHERE n <= 5 GROUP BY doc_id)"


def file_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LX-3: a term's lines weigh 2 where it stands alone and 1 inside a word, the first five of them."""
    alone = F.concat(F.lit("(^|[^a-z0-9_])"), F.lower("term"), F.lit("($|[^a-z0-9_])"))
    own = grep(spark, sf_dir).withColumn("weight", F.when(F.regexp_like(F.lower("line"), alone), 2).otherwise(1))
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "k").orderBy("pos"))).filter("n <= 5")
    return own.groupBy("doc_id").agg(F.sum("weight").alias("total"), F.count_distinct("k").alias("terms"))


@query("lx_3", f"{_SCORES} SELECT doc_id, total::BIGINT AS total, terms FROM s")
def lx_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_scores(spark, sf_dir)


@query("lx_4", f"{_SCORES} SELECT doc_id, total * (1 + 0.5::DOUBLE * (terms - 1)) * CASE WHEN source = 'src1' THEN 1.2::DOUBLE ELSE 1 END * (0.7::DOUBLE + 0.3::DOUBLE * greatest(0.0::DOUBLE, 1 - (doc_id % 400) / 180.0::DOUBLE)) AS score FROM s JOIN notes USING (doc_id)")
def lx_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's score: more for several terms together, by its path, less with age down to 0.7 after 180 days (the id gives the age)."""
    age = F.col("doc_id") % 400
    own = file_scores(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    score = F.col("total") * (1 + 0.5 * (F.col("terms") - 1)) * F.when(F.col("source") == "src1", 1.2).otherwise(1.0) * (0.7 + 0.3 * F.greatest(F.lit(0.0), 1 - age / 180.0))
    return own.select("doc_id", score.alias("score"))


@query("lx_5", f"{_GREP}, d AS (SELECT DISTINCT doc_id, pos, line FROM capped), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM d) SELECT doc_id, string_agg('L' || (pos + 1) || ': ' || substring(trim(line), 1, 200), ' … ' ORDER BY pos) AS content FROM n WHERE n <= 3 GROUP BY doc_id")
def lx_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hit's first three lines."""
    own = grep(spark, sf_dir).select("doc_id", "pos", "line").distinct().withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).filter("n <= 3")
    said = F.concat(F.lit("L"), (F.col("pos") + 1).cast("string"), F.lit(": "), F.left(F.trim("line"), F.lit(200)))
    three = own.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", said.alias("s")))).alias("s"))
    return three.select("doc_id", F.array_join(F.transform("s", lambda x: x["s"]), " … ").alias("content"))


# Context: an order's fused items are its hits, a part's name is a hit's text.
_HITS = f"{FUSED}, hits AS (SELECT query_id, item_id, score, rank, p_name AS content, p_brand AS path FROM fused JOIN part ON p_partkey = item_id)"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("content"), F.col("p_brand").alias("path"))
    return fused(spark, sf_dir).select("query_id", "item_id", "score", "rank").join(part, "item_id")


@query("ctx_1", f"{_HITS}, g AS (SELECT query_id, item_id, 0.5::DOUBLE / row_number() OVER (PARTITION BY query_id ORDER BY item_id) AS score FROM hits WHERE item_id % 2 = 0) SELECT query_id, item_id, coalesce(h.score, g.score) AS score, g.score IS NOT NULL AS graph FROM (FROM hits WHERE item_id % 3 > 0) h FULL JOIN g USING (query_id, item_id)")
def ctx_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of two lists, each item once; the fused score goes before that of the graph's place."""
    own = hits(spark, sf_dir)
    graph = own.filter("item_id % 2 = 0").select("query_id", "item_id", (0.5 / F.row_number().over(U.per_query().orderBy("item_id"))).alias("g"))
    both = own.filter("item_id % 3 > 0").select("query_id", "item_id", "score").join(graph, ["query_id", "item_id"], "full")
    return both.select("query_id", "item_id", F.coalesce("score", "g").alias("score"), F.col("g").isNotNull().alias("graph"))


@query("ctx_2", f"{_HITS}, s AS (SELECT *, item_id % 7 = 0 AS flagged, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, rank) - 1 AS n FROM hits) SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY flagged, round_even((score - 0.05::DOUBLE * n) / 1e-9::DOUBLE, 0) DESC, rank)::INT AS place FROM s")
def ctx_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of pieces: flagged ones last, each repeat of a document less."""
    own = hits(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("query_id", "path").orderBy(F.desc("score"), "rank")) - 1)
    order = [F.col("item_id") % 7 == 0, F.desc(F.rint((F.col("score") - 0.05 * F.col("n")) / 1e-9)), F.col("rank")]
    return own.select("query_id", "item_id", F.row_number().over(U.per_query().orderBy(*order)).alias("place"))


@query("ctx_3", f"{_HITS}, k AS (SELECT * FROM hits WHERE NOT (length(content) < 12 AND item_id % 2 = 1)), r AS (SELECT DISTINCT query_id, path FROM hits) SELECT query_id, path FROM r WHERE (query_id, path) IN (SELECT (query_id, path) FROM k)")
def ctx_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of the pieces that are kept."""
    own = hits(spark, sf_dir)
    kept = own.filter(~((F.length("content") < 12) & (F.col("item_id") % 2 == 1)))
    return own.select("query_id", "path").distinct().join(kept, ["query_id", "path"], "left_semi")


def rendered(pieces: DataFrame, per_doc: int, total: int, least: int) -> DataFrame:
    """CTX-4, WIN-11: (query_id, item_id, place, text) of what fits: a document's pieces up to per_doc characters, all up to total.

    A piece that is too long is cut at a line; if fewer than least characters would be
    left, or it doesn't fit, it is skipped, and takes no room. What fits depends on the
    pieces before, so a query's ranked pool, which is bounded, goes to one function.
    """
    def fill(rows: list[dict]) -> list[dict]:
        used, left, out = {}, total, []
        for row in rows:
            room = min(per_doc - used.get(row["path"], 0), left)
            text = row["content"]
            if len(text) > room:
                cut = text[: max(0, room)]
                text = cut[: cut.rfind("\n")] if "\n" in cut else ""
                if len(text) < least:
                    continue
            used[row["path"]] = used.get(row["path"], 0) + len(text)
            left -= len(text)
            out.append({"item_id": row["item_id"], "place": len(out) + 1, "text": text})
        return out

    return each_list(pieces, "query_id", ["rank", "item_id", "path", "content"], fill, "query_id long, item_id long, place int, text string")


@query("ctx_4")
def ctx_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget that skipped pieces don't use: no SQL; the tests compare a plain loop."""
    return rendered(hits(spark, sf_dir), 60, 120, 10)


@query("ctx_5", f"{_HITS} SELECT query_id, string_agg('[' || rank || '] ' || path || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM hits WHERE rank <= 4 GROUP BY query_id")
def ctx_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context string of the first four pieces."""
    said = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "path", F.lit("\n"), "content")
    four = hits(spark, sf_dir).filter("rank <= 4").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", said.alias("s")))).alias("s"))
    return four.select("query_id", F.array_join(F.transform("s", lambda x: x["s"]), "\n\n").alias("context"))


@query("ctx_6", f"{_HITS}, c AS (SELECT query_id, string_agg(content, chr(10)) AS context FROM hits WHERE rank <= 2 GROUP BY 1) SELECT query_id, item_id, CASE WHEN contains(context, content) THEN NULL ELSE content END AS body FROM hits JOIN c USING (query_id)")
def ctx_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that the context holds already are left out."""
    own = hits(spark, sf_dir)
    context = own.filter("rank <= 2").groupBy("query_id").agg(F.array_join(F.collect_list("content"), "\n").alias("context"))
    return own.join(context, "query_id").select("query_id", "item_id", F.when(~F.contains("context", "content"), F.col("content")).alias("body"))


@query("ctx_7", f"{_HITS} SELECT query_id, item_id, path, rank > 3 AS injected FROM hits WHERE rank <= 5")
def ctx_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lean view: few fields, the tail marked."""
    return hits(spark, sf_dir).filter("rank <= 5").select("query_id", "item_id", "path", (F.col("rank") > 3).alias("injected"))


@query("ctx_8", f"{_HITS}, r AS (SELECT p_brand AS path, min(p_mfgr_) AS ref FROM (SELECT p_brand, p_type AS p_mfgr_ FROM part WHERE p_size > 10) GROUP BY 1) SELECT query_id, rank, path, ref, CASE WHEN length(content) <= 20 THEN content ELSE rtrim(substring(content, 1, 20)) || '…' END AS snippet FROM hits LEFT JOIN r USING (path) WHERE rank <= 3")
def ctx_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations: the first three hits with their reference and a snippet."""
    refs = table(spark, sf_dir, "part").filter("p_size > 10").groupBy(F.col("p_brand").alias("path")).agg(F.min("p_type").alias("ref"))
    return hits(spark, sf_dir).filter("rank <= 3").join(refs, "path", "left").select("query_id", "rank", "path", "ref", T.snippet(F.col("content"), 20).alias("snippet"))
