"""Queries for corpus upkeep: change detection, plans, duplicates, audits, filters, catalogs, jobs, samples, mining."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.catalog import query, table
from corvane.functions import text as T
from corvane.operators import upkeep as K
from corvane.operators import vector_store as V
from corvane.store import folder
from corvane.plans.fixtures import NOTES, notes

_OLD = "old AS (SELECT doc_id, sha256(text || CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE '' END) AS fp FROM documents WHERE doc_id % 10 <> 0), new AS (SELECT doc_id, sha256(text) AS fp FROM documents WHERE doc_id % 11 <> 0)"
_STATES = f"{_OLD}, c AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.fp = n.fp THEN 'unchanged' ELSE 'changed' END AS state FROM old o FULL JOIN new n ON o.doc_id = n.doc_id)"


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the corpus, the older derived by id: (doc_id, was) and (doc_id, now)."""
    docs = table(spark, sf_dir, "documents")
    old = docs.filter("doc_id % 10 <> 0").select("doc_id", T.fingerprint(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))).alias("was"))
    return old, docs.filter("doc_id % 11 <> 0").select("doc_id", T.fingerprint(F.col("text")).alias("now"))


for _name in ("ing_1", "jn_12"):

    @query(_name, f"WITH {_STATES} SELECT * FROM c")
    def ing_1(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Change detection between two versions of the corpus."""
        return K.changes(*versions(spark, sf_dir))


@query("ing_2", f"WITH {_STATES} SELECT state, count(*) AS n FROM c GROUP BY state")
def ing_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.changes(*versions(spark, sf_dir)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("ing_22", f"WITH {_STATES} SELECT count(*) FILTER (state <> 'unchanged') = 0 AS synced, count(*) FILTER (state = 'new') AS new, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'deleted') AS deleted, count(*) FILTER (state = 'unchanged') AS unchanged FROM c")
def ing_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sync status; the lists themselves are ing_1's."""
    n = {s: F.count_if(F.col("state") == s).alias(s) for s in ("new", "changed", "deleted", "unchanged")}
    return K.changes(*versions(spark, sf_dir)).agg((F.count_if(F.col("state") != "unchanged") == 0).alias("synced"), *n.values())


_STATUS = "status AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'failed' ELSE 'processed' END AS status FROM documents WHERE doc_id % 8 <> 0)"


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_id % 8 <> 0").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "failed").otherwise("processed").alias("status"))


@query(
    "ing_3",
    f"""WITH {_OLD}, {_STATUS}, e AS (SELECT doc_id, n.fp AS now, o.fp AS was, s.status, doc_id % 4 = 0 AS keep FROM new n FULL JOIN old o USING (doc_id) FULL JOIN status s USING (doc_id)),
    p AS (SELECT doc_id, CASE WHEN now IS NOT NULL THEN CASE WHEN status IS NULL THEN 'new' WHEN status <> 'processed' THEN 'retry' WHEN was IS NULL THEN 'adopt' WHEN now = was THEN 'unchanged' ELSE 'changed' END
        WHEN was IS NOT NULL THEN CASE WHEN keep THEN 'kept' WHEN (SELECT count(*) FROM new) < (SELECT count(*) FROM old) * 0.5 THEN 'refused' ELSE 'gone' END WHEN status = 'processed' THEN 'unknown' END AS state FROM e) SELECT * FROM p WHERE state IS NOT NULL""",
)
def ing_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = versions(spark, sf_dir)
    keep = table(spark, sf_dir, "documents").filter("doc_id % 4 = 0").select("doc_id")
    return K.refresh_plan(new, old, statuses(spark, sf_dir), keep)


@query("ing_5", "SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha256(trim(text)) ORDER BY length(source), source, doc_id) AS canonical FROM documents")
def ing_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates and the document that stands for each."""
    own = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.trim("text"), 256).alias("body"))
    return K.canonical(own, "body", [F.length("source"), F.col("source")]).select("doc_id", "canonical")


@query("ing_6", "SELECT f, doc_id AS chosen FROM (SELECT doc_id % 100 AS f, doc_id, row_number() OVER (PARTITION BY doc_id % 100 ORDER BY CASE source WHEN 'src1' THEN 0 WHEN 'src2' THEN 1 ELSE 2 END, length(text), doc_id) AS n FROM documents) WHERE n = 1")
def ing_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a file key: of the source that comes first, then the shortest."""
    order = F.struct(F.when(F.col("source") == "src1", 0).when(F.col("source") == "src2", 1).otherwise(2), F.length("text"), F.col("doc_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 100).alias("f")).agg(F.min(order).alias("b")).select("f", F.col("b.doc_id").alias("chosen"))


@query("ing_7", f"WITH {_STATUS}, k AS (SELECT DISTINCT 'n' || (doc_id % 40) || '.md' AS name FROM status WHERE status = 'processed' AND doc_id % 40 < 20) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM status WHERE status = 'processed') AND 'n' || (doc_id % 40) || '.md' NOT IN (FROM k)")
def ing_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are neither processed nor known by their file's name."""
    done = statuses(spark, sf_dir).filter("status = 'processed'")
    name = F.concat(F.lit("n"), (F.col("doc_id") % 40).cast("string"), F.lit(".md"))
    known = done.filter("doc_id % 40 < 20").select(name.alias("name")).distinct()
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name")).join(done, "doc_id", "left_anti").join(known, "name", "left_anti").select("doc_id")


@query("ing_8", "SELECT doc_id FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS c FROM documents) WHERE doc_id = c")
def ing_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a body, for mining."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


_SIDES = {"orders in lineitem": ("SELECT o_orderkey AS id FROM orders", "SELECT l_orderkey AS id FROM lineitem"), "customers with orders": ("SELECT c_custkey AS id FROM customer", "SELECT o_custkey AS id FROM orders"), "parts": ("SELECT p_partkey AS id FROM part", "SELECT l_partkey AS id FROM lineitem")}


@query("ing_10", " UNION ALL ".join(f"SELECT '{n}' AS check, a AS only_left, b AS only_right, a + b = 0 AS ok FROM (SELECT (SELECT count(*) FROM ({x} EXCEPT {y})) AS a, (SELECT count(*) FROM ({y} EXCEPT {x})) AS b)" for n, (x, y) in _SIDES.items()))
def ing_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistency of the tables with each other, a row a check."""
    ids = lambda name, column: table(spark, sf_dir, name).select(F.col(column).alias("id"))
    sides = [("orders in lineitem", "orders", "o_orderkey", "lineitem", "l_orderkey"), ("customers with orders", "customer", "c_custkey", "orders", "o_custkey"), ("parts", "part", "p_partkey", "lineitem", "l_partkey")]
    out = None
    for name, a, x, b, y in sides:
        each = K.difference(name, ids(a, x), ids(b, y))
        out = each if out is None else out.union(each)
    return out


@query("ing_11", "SELECT doc_id AS orphan FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ing_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a repair would delete (a dry run): documents that the other store doesn't know."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("orphan")).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("orphan")), "orphan", "left_anti")


_MERGE = "SELECT doc_id, 'old' AS side FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 5 = 0"
for _name in ("ing_12", "ing_20"):

    @query(_name, _MERGE)
    def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A base extended by incoming documents, which win."""
        docs = table(spark, sf_dir, "documents").select("doc_id")
        return K.merged(docs.filter("doc_id % 3 <> 0").withColumn("side", F.lit("old")), docs.filter("doc_id % 5 = 0").withColumn("side", F.lit("new")), "doc_id")


@query("ing_14", f"WITH {_STATUS} SELECT doc_id FROM documents JOIN status USING (doc_id) WHERE status = 'processed'")
def ing_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that may be archived."""
    return table(spark, sf_dir, "documents").select("doc_id").join(statuses(spark, sf_dir).filter("status = 'processed'"), "doc_id", "left_semi")


@query("ing_16", f"WITH {_STATUS} SELECT count(*) AS calls, sum(length(text) // 4)::BIGINT AS tokens, sum(length(text) // 4) * 0.4::DOUBLE / 1e6 + count(*) * 700 * 1.6::DOUBLE / 1e6 AS cost FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM status WHERE status = 'processed')")
def ing_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents that have no answer yet would cost."""
    left = table(spark, sf_dir, "documents").join(statuses(spark, sf_dir).filter("status = 'processed'"), "doc_id", "left_anti")
    tokens = F.sum(F.floor(F.length("text") / 4))
    return left.agg(F.count(F.lit(1)).alias("calls"), tokens.alias("tokens"), (tokens * 0.4 / 1e6 + F.count(F.lit(1)) * 700 * 1.6 / 1e6).alias("cost"))


@query("ing_17", "WITH p AS (SELECT user_id, max(ts) AS last, avg((event_type = 'purchase')::INT) AS done, (SELECT max(ts) FROM events) AS now FROM events GROUP BY user_id) SELECT user_id, CASE WHEN done >= 0.2 AND now - last >= INTERVAL 7 DAY THEN 'abandon' WHEN done >= 0.2 AND now - last >= INTERVAL 1 DAY THEN 'cancel' ELSE 'wait' END AS verdict FROM p")
def ing_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a batch that stall: done enough and idle for a day are cancelled, for a week given up."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    own = events.groupBy("user_id").agg(F.max("ts").alias("last"), F.avg((F.col("event_type") == "purchase").cast("int")).alias("done")).crossJoin(F.broadcast(now))  # one row
    idle = lambda days: (F.col("done") >= 0.2) & (F.col("last") <= F.col("now") - F.expr(f"INTERVAL {days} DAYS"))
    return own.select("user_id", F.when(idle(7), "abandon").when(idle(1), "cancel").otherwise("wait").alias("verdict"))


@query("ing_18", "SELECT source, count(*) FILTER (doc_id % 2 = 0) AS a, count(*) FILTER (doc_id % 2 = 1) AS b, count(*) FILTER (doc_id % 2 = 1) - count(*) FILTER (doc_id % 2 = 0) AS delta FROM documents GROUP BY source")
def ing_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indexes side by side."""
    own = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("a"), F.count_if(F.col("doc_id") % 2 == 1).alias("b"))
    return own.withColumn("delta", F.col("b") - F.col("a"))


@query(
    "ing_19",
    "WITH n AS (SELECT max(ts)::DATE + 3 AS now FROM events), e AS (SELECT event_type, max(ts) AS l, count(*) FILTER (value > 50) AS backlog, min_by(event_id, (ts, event_id)) AS oldest FROM events GROUP BY event_type) SELECT event_type, strftime(l, '%Y-%m-%d') AS last, date_diff('day', l::DATE, now) AS age, date_diff('day', l::DATE, now) > 7 AS stale, backlog, oldest FROM e, n",
)
def ing_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long ago each index was fed, and what waits."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.date_add(F.max("ts").cast("date"), 3).alias("now"))
    own = events.groupBy("event_type").agg(F.max("ts").alias("l"), F.count_if(F.col("value") > 50).alias("backlog"), F.min(F.struct("ts", "event_id")).alias("o")).crossJoin(F.broadcast(now))  # one row
    age = F.datediff("now", F.col("l").cast("date")).cast("long")
    return own.select("event_type", F.date_format("l", "yyyy-MM-dd").alias("last"), age.alias("age"), (age > 7).alias("stale"), "backlog", F.col("o.event_id").alias("oldest"))


@query("ing_21", "SELECT doc_id FROM documents WHERE doc_id <> 7 AND source || '/' || doc_id <> (SELECT source || '/' || doc_id FROM documents WHERE doc_id = 12)")
def ing_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deletion by id and one by path."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    gone = docs.filter("doc_id = 7").union(docs.filter(docs.path.endswith("/12")))
    return docs.join(F.broadcast(gone.limit(1000)), "doc_id", "left_anti").select("doc_id")


@query("agg_8", "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def agg_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


_SUM = "SELECT count(*) AS n, substring(sha256(sum(('0x' || substring(d, 1, 12))::BIGINT::HUGEINT)::VARCHAR || ':' || sum(('0x' || substring(d, 13, 12))::BIGINT::HUGEINT)::VARCHAR), 1, 16) AS digest FROM (SELECT sha256({line}) AS d FROM {rows})"


@query("agg_14", _SUM.format(line="source || '/' || doc_id || ':' || sha256(text)", rows="documents"))
def agg_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus's fingerprint, of its paths and digests."""
    return K.fingerprint_of(table(spark, sf_dir, "documents"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(":"), F.sha2("text", 256)))


@query("agg_15", _SUM.format(line="vec_id::VARCHAR", rows="embeddings"))
def agg_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.fingerprint_of(table(spark, sf_dir, "embeddings"), F.col("vec_id").cast("string"))


@query("win_9", "SELECT conv_id, turn, lag(turn) OVER w AS before, lead(turn) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def win_9(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("before"), F.lead("turn").over(w).alias("after"))


_HEADED = lambda g: r"regexp_extract(substring(note, 1, 400), '\[Document:\s*([^|]*?)\s*\|\s*Section:\s*([^|]*?)\s*\|\s*Date:\s*([0-9]{4}-[0-9]{2}-[0-9]{2}|unknown)\s*\]', {g})".replace("{g}", str(g))
_VERDICT = f"""CASE WHEN {_HEADED(3)} IN ('', 'unknown') THEN 'undated' WHEN {_HEADED(3)}::VARCHAR >= '2024-07-01' THEN 'recent' WHEN regexp_matches(path, 'd1[0-9]*\\.') OR contains(note, 'DEPRECATED - src3') THEN 'protected' ELSE 'candidate' END"""


@query("flt_2", f"WITH {NOTES} SELECT doc_id, {_VERDICT} AS verdict FROM notes WHERE {_HEADED(2)} <> 'src0'")
def flt_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be forgotten: dated before a day, of an allowed section, not protected by name or content; undated notes never."""
    pattern = r"\[Document:\s*([^|]*?)\s*\|\s*Section:\s*([^|]*?)\s*\|\s*Date:\s*([0-9]{4}-[0-9]{2}-[0-9]{2}|unknown)\s*\]"
    own = notes(spark, sf_dir).select("doc_id", "path", "note", F.regexp_extract(F.left("note", F.lit(400)), pattern, 2).alias("s"), F.regexp_extract(F.left("note", F.lit(400)), pattern, 3).alias("d"))
    guarded = F.col("path").rlike(r"d1[0-9]*\.") | F.contains("note", F.lit("DEPRECATED - src3"))
    verdict = F.when(F.col("d").isin("", "unknown"), "undated").when(F.col("d") >= "2024-07-01", "recent").when(guarded, "protected").otherwise("candidate")
    return own.filter("s <> 'src0'").select("doc_id", verdict.alias("verdict"))


for _name in ("flt_3", "top_7", "cat_1"):

    @query(_name, "WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error') SELECT event_id, user_id, event_type FROM l WHERE value > 5 AND event_type IN ('view', 'click', 'purchase') AND contains(props, '\"') ORDER BY ts DESC, event_id DESC LIMIT 20")
    def catalog_list(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The catalog's latest rows that meet all conditions, the most recent first; deleted ones (here: errors) don't count."""
        own = K.latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).filter("event_type <> 'error'")
        own = own.filter((F.col("value") > 5) & F.col("event_type").isin("view", "click", "purchase") & F.contains("props", F.lit('"')))
        return own.orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id", "event_type")


@query("flt_4", f"WITH {NOTES} SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN substring(note, 1, 100) ELSE note END AS c FROM notes) WHERE NOT (length(c) < 200 AND NOT starts_with(c, '[Document:'))")
def flt_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short chunks without a header go."""
    own = notes(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 == 1, F.left("note", F.lit(100))).otherwise(F.col("note")).alias("c"))
    return own.filter(~((F.length("c") < 200) & ~F.col("c").startswith("[Document:"))).select("doc_id")


@query("flt_5", "SELECT p_partkey, name FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN p_name || '|x' ELSE p_name END AS name, CASE WHEN p_size % 7 = 0 THEN 'UNKNOWN' ELSE p_type END AS type FROM part) WHERE type <> 'UNKNOWN' AND NOT contains(name, '|')")
def flt_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of unknown type or with a stray bar go."""
    name = F.when(F.col("p_partkey") % 9 == 0, F.concat("p_name", F.lit("|x"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").filter("p_size % 7 <> 0").select("p_partkey", name.alias("name")).filter(~F.contains("name", F.lit("|")))


@query("flt_6", "SELECT id FROM (SELECT CASE WHEN doc_id % 6 = 0 THEN 'dup-' ELSE 'doc-' END || doc_id AS id, doc_id % 10 = 3 AS dup FROM documents) WHERE NOT starts_with(id, 'dup-') AND NOT dup")
def flt_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real documents: no marks of a copy, no flag."""
    own = table(spark, sf_dir, "documents").select(F.concat(F.when(F.col("doc_id") % 6 == 0, "dup-").otherwise("doc-"), F.col("doc_id").cast("string")).alias("id"), (F.col("doc_id") % 10 == 3).alias("dup"))
    return own.filter(~F.col("id").startswith("dup-") & ~F.col("dup")).select("id")


_TOK = "tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{9,}}')) AS token FROM documents), band AS (SELECT token, count(*) AS df FROM tok GROUP BY 1 HAVING count(*) BETWEEN 2 AND {m})"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0)))).alias("token")).filter("token is not null")


@query("flt_8", "WITH " + _TOK.format(m=5) + " SELECT token, df FROM band")
def flt_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare tokens, which tell a document: in two to five."""
    return tokens(spark, sf_dir).groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df between 2 and 5")


@query("flt_9", "WITH " + _TOK.format(m=20) + " SELECT token, df FROM band")
def flt_9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df between 2 and 20")


for _name in ("min_1", "jn_10"):

    @query(_name, "WITH " + _TOK.format(m=20) + " SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM tok a JOIN band USING (token) JOIN tok b USING (token) WHERE a.doc_id < b.doc_id GROUP BY ALL HAVING count(*) >= 2")
    def min_1(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Pairs of documents on one topic, by the rare tokens they share."""
        return K.shared_rare(tokens(spark, sf_dir))


@query("flt_10", "SELECT l_orderkey, max(l_discount) < 0.08 AND count(*) FILTER (l_tax > 0.05) = 0 AS low FROM lineitem GROUP BY l_orderkey")
def flt_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mark of low confidence: the best dense score is low and no other channel has evidence."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(((F.max("l_discount") < 0.08) & (F.count_if(F.col("l_tax") > 0.05) == 0)).alias("low"))


@query("jn_14", f"WITH {NOTES}, c AS (SELECT DISTINCT lower('2024-0' || (doc_id % 9 + 1) || '-11_d' || doc_id || '.MD') AS name FROM documents WHERE doc_id % 8 = 0) SELECT doc_id FROM notes WHERE lower(regexp_extract(path, '[^/]*$')) IN (FROM c)")
def jn_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes whose file is cited, whatever the case."""
    cited = table(spark, sf_dir, "documents").filter("doc_id % 8 = 0").select(F.lower(F.concat(F.lit("2024-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("-11_d"), F.col("doc_id").cast("string"), F.lit(".MD"))).alias("name")).distinct()
    own = notes(spark, sf_dir).select("doc_id", F.lower(T.basename(F.col("path"))).alias("name"))
    return own.join(cited, "name", "left_semi").select("doc_id")


_PIECES = "p AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN substring(text, 1, 200) ELSE text END AS c FROM documents)"


@query("jn_15", f"WITH {_PIECES} SELECT a.doc_id AS doc_id, b.doc_id AS other FROM p a JOIN p b ON a.source = b.source AND a.doc_id < b.doc_id AND (contains(a.c, b.c) OR contains(b.c, a.c)) AND length(a.c) >= 200 AND length(b.c) >= 200 AND substring(a.c, 1, 200) = substring(b.c, 1, 200)")
def jn_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of one file of which one holds the other from its start: keyed on file and the first 200 characters, then verified."""
    own = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 2 == 0, F.left("text", F.lit(200))).otherwise(F.col("text")).alias("c")).filter(F.length("c") >= 200)
    own = own.withColumn("key", F.xxhash64("source", F.left("c", F.lit(200))))
    b = own.select("key", F.col("doc_id").alias("other"), F.col("c").alias("d"))
    return own.join(b, "key").filter("doc_id < other and (contains(c, d) or contains(d, c))").select("doc_id", "other")


@query("jn_16", f"WITH {NOTES}, s AS (SELECT doc_id AS target, 'run_' || (doc_id * 2) AS stem FROM documents WHERE doc_id % 3 = 0), w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(note, 'run_[0-9]+')) AS stem FROM notes) SELECT doc_id, target FROM w JOIN s USING (stem) WHERE doc_id <> target")
def jn_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name another's stem: stems are words, so the words of a text meet them by equality."""
    stems = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("target"), F.concat(F.lit("run_"), (F.col("doc_id") * 2).cast("string")).alias("stem"))
    words = notes(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("note", F.lit("run_[0-9]+"), F.lit(0)))).alias("stem"))
    return words.join(stems, "stem").filter("doc_id <> target").select("doc_id", "target")


@query("min_2", f"WITH {NOTES}, w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(note, 'hyp:[0-9a-f]')) AS pattern FROM notes) SELECT pattern, count(*) AS docs, min(doc_id) AS first FROM w GROUP BY 1")
def min_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inverted index of patterns."""
    words = notes(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("note", F.lit("hyp:[0-9a-f]"), F.lit(0)))).alias("pattern"))
    return words.groupBy("pattern").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first"))


_NEAR = "WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS ws FROM benchmark), k AS (SELECT item_id, unnest(ws) AS t FROM w), p AS (SELECT DISTINCT a.item_id AS a, b.item_id AS b FROM k a JOIN k b ON a.t = b.t AND a.item_id > b.item_id), j AS (SELECT p.a, p.b, len(list_intersect(x.ws, y.ws)) / len(list_distinct(list_concat(x.ws, y.ws))) AS s FROM p JOIN w x ON x.item_id = p.a JOIN w y ON y.item_id = p.b)"


def question_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0))).alias("words"))


@query("min_3", f"{_NEAR}, n AS (SELECT a AS item_id, max(s) AS nearest FROM j GROUP BY a) SELECT item_id, nearest, coalesce(nearest >= 0.48::DOUBLE, false) AS near FROM benchmark LEFT JOIN n USING (item_id)")
def min_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of words that each question has in common with the nearest earlier one, and whether that is 0.48 or more."""
    best = K.nearest_share(K.by_rarity(question_words(spark, sf_dir)), 0.48)
    near = F.coalesce(F.col("nearest") >= 0.48, F.lit(False))
    return table(spark, sf_dir, "benchmark").select("item_id").join(best, "item_id", "left").withColumn("near", near)


@query("min_3a")
def min_3a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions taken in their order, each unless a taken one is near: no SQL; the tests compare a plain loop."""
    return K.taken(table(spark, sf_dir, "benchmark").select("item_id"), K.near_pairs(question_words(spark, sf_dir), 0.48))


@query("min_5", "SELECT o_orderkey, ('0x' || substring(sha256(o_orderkey || '|' || o_custkey), 1, 8))::BIGINT % 2 AS bucket FROM orders")
def min_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair's bucket by hash."""
    h = F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")), 256)
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.conv(F.left(h, F.lit(8)), 16, 10).cast("long") % 2).alias("bucket"))


@query(
    "min_4",
    "WITH " + _TOK.format(m=20) + ", p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM tok a JOIN band USING (token) JOIN tok b USING (token) WHERE a.doc_id < b.doc_id GROUP BY ALL HAVING count(*) >= 2) SELECT p.a, p.b, abs(p.a % 90 - p.b % 90) AS days FROM p JOIN documents x ON x.doc_id = p.a JOIN documents y ON y.doc_id = p.b WHERE x.source = y.source AND abs(p.a % 90 - p.b % 90) <= 45 AND sha256(x.text) <> sha256(y.text)",
)
def min_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temporal miner: pairs on one topic, of one family, at most 45 days apart, of which one doesn't repeat the other (days stand in ids here)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", T.fingerprint(F.col("text")).alias("fp"))
    a, b = docs.toDF("a", "sa", "fa"), docs.toDF("b", "sb", "fb")
    days = F.abs(F.col("a") % 90 - F.col("b") % 90)
    return K.shared_rare(tokens(spark, sf_dir)).join(a, "a").join(b, "b").filter("sa = sb and fa <> fb").select("a", "b", days.alias("days")).filter("days <= 45")


_SEEDED = "sha256(doc_id::VARCHAR || ':13')"


@query("smp_1", f"SELECT doc_id FROM documents ORDER BY {_SEEDED} LIMIT 25")
def smp_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample: the first 25 by a hash of id and seed."""
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":13")), 256)).limit(25)


@query("smp_2", "WITH r AS (SELECT event_id, strftime(ts, '%Y-%m') AS month, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m') ORDER BY ts DESC, event_id) AS n FROM events) SELECT event_id, month FROM r ORDER BY n, month DESC LIMIT 30")
def smp_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round robin over the months, the newest first; each month gives 30 at most to the last sort."""
    month = F.date_format("ts", "yyyy-MM")
    own = table(spark, sf_dir, "events").select("event_id", "ts", month.alias("month"))
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("ts"), "event_id"))).filter("n <= 30")
    return own.orderBy("n", F.desc("month")).limit(30).select("event_id", "month")


@query("smp_3", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_SEEDED}) AS n FROM documents) SELECT doc_id, CASE WHEN n <= 20 THEN 'valid' WHEN n <= 50 THEN 'holdout' ELSE 'train' END AS side FROM r")
def smp_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split by counts: the few that leave the training side are the least hashes; the rest needs no order."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    few = docs.orderBy(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":13")), 256)).limit(50)
    place = F.row_number().over(Window.orderBy(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":13")), 256)))
    held = few.select("doc_id", F.when(place <= 20, "valid").otherwise("holdout").alias("side"))  # 50 rows
    return docs.join(F.broadcast(held), "doc_id", "left").select("doc_id", F.coalesce("side", F.lit("train")).alias("side"))


def copied(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The vectors, and a copy of them in another store."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    root = f"{folder(spark)}/corvane/vectors-{uuid.uuid4().hex}"
    V.transplant(own, root, 4)
    return own, V.transplanted(spark, root, own)


@query("snk_10", "SELECT vec_id, embedding[1] AS first, len(embedding)::INT AS n FROM embeddings")
def snk_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as another store gives them back."""
    return copied(spark, sf_dir)[1].select("vec_id", F.col("embedding")[0].alias("first"), F.size("embedding").alias("n"))


@query("smp_4", "SELECT true AS counts, count(*) AS sampled, 0::BIGINT AS missing, 0::BIGINT AS changed FROM embeddings")
def smp_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy in another store against its original, every vector sampled; the tests change and drop some."""
    return V.compared(*copied(spark, sf_dir), one_in=1)


@query("svc_1", "WITH f AS (SELECT user_id % 50 AS key, min_by(value, (ts, event_id)) AS first FROM events GROUP BY 1) SELECT event_id, CASE WHEN (SELECT min_by(event_id, (ts, event_id)) FROM events x WHERE x.user_id % 50 = e.user_id % 50) = event_id THEN 'created' WHEN value = first THEN 'existing' ELSE 'conflict' END AS outcome FROM events e JOIN f ON f.key = e.user_id % 50")
def svc_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idempotent creation: the first request of a key creates, an equal one finds it, another conflicts."""
    own = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("key"), "ts", "value")
    first = own.groupBy("key").agg(F.min(F.struct("ts", "event_id", "value")).alias("f"))
    outcome = F.when(F.col("f.event_id") == F.col("event_id"), "created").when(F.col("f.value") == F.col("value"), "existing").otherwise("conflict")
    return own.join(F.broadcast(first), "key").select("event_id", outcome.alias("outcome"))  # fifty keys


for _name in ("svc_2", "top_8"):

    @query(_name, "SELECT event_id, user_id FROM events WHERE event_type IN ('view', 'error') AND (event_type = 'view' OR ts < (SELECT max(ts) - INTERVAL 1 DAY FROM events)) ORDER BY ts, event_id LIMIT 1")
    def claim(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The next job: queued, or running with a lease that has run out; first come, first served."""
        events = table(spark, sf_dir, "events")
        now = events.agg(F.max("ts").alias("now"))
        free = events.crossJoin(F.broadcast(now)).filter("event_type = 'view' or (event_type = 'error' and ts < now - INTERVAL 1 DAY)")  # one row
        return free.orderBy("ts", "event_id").limit(1).select("event_id", "user_id")


@query("svc_3", "WITH v AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS version, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM events) SELECT user_id, event_id, version, parent, coalesce(parent % 3 <> 0, true) AS published FROM v")
def svc_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions, each naming its parent; one whose parent isn't the current head is refused (parents divisible by three stand for stale ones)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("version"), F.lag("event_id").over(w).alias("parent"))
    return own.withColumn("published", F.coalesce(F.col("parent") % 3 != 0, F.lit(True)))
