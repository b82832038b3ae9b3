"""Graph queries: parts and suppliers are the nodes, an order is a chunk that names them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.catalog import query, table
from corvane.functions import text as T
from corvane.operators import graph as G
from corvane.operators.components import components

EDGES = "edges AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem WHERE l_quantity > 25), ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), degree AS (SELECT a AS node, count(*) AS degree FROM ways GROUP BY 1)"
POSTINGS = "postings AS (SELECT DISTINCT unnest(['p' || l_partkey, 's' || l_suppkey]) AS entity, 'o' || l_orderkey AS chunk_id FROM lineitem WHERE l_linenumber <= 2), fan AS (SELECT entity, count(*) AS fanout FROM postings GROUP BY 1)"
SEEDS = "seeds AS (SELECT p_partkey AS query_id, unnest(['p' || p_partkey, 'p' || (p_partkey + 1)]) AS entity, unnest([1.0, 0.9])::DOUBLE AS weight FROM part WHERE p_partkey % 20 = 0)"
LOSS = "0.6::DOUBLE * least(1.0::DOUBLE, 1.0::DOUBLE / (ln(2.0 + degree) * ln(2.0 + fanout)))"
REACHED = f"""WITH {EDGES}, {POSTINGS}, {SEEDS}, node AS (SELECT node, degree, coalesce(fanout, 0) AS fanout FROM degree LEFT JOIN fan ON entity = node WHERE coalesce(fanout, 0) <= 80),
    step AS (SELECT w.a, w.b, x.degree, {LOSS.replace('degree', 'x.degree').replace('fanout', 'y.fanout')} AS loss FROM ways w JOIN node x ON x.node = a JOIN node y ON y.node = b),
    one AS (SELECT query_id, b AS entity, max(weight * loss) AS weight FROM seeds JOIN step ON a = entity GROUP BY ALL), more AS (SELECT o.* FROM one o LEFT JOIN seeds s USING (query_id, entity) WHERE s.weight IS NULL OR o.weight > s.weight),
    two AS (SELECT query_id, b AS entity, max(weight * loss) AS weight FROM more JOIN step ON a = entity WHERE degree <= 12 GROUP BY ALL),
    reached AS (SELECT query_id, entity, weight, hop FROM (SELECT *, row_number() OVER (PARTITION BY query_id, entity ORDER BY weight DESC, hop) AS n FROM (SELECT *, 0 AS hop FROM seeds UNION ALL SELECT *, 1 FROM more UNION ALL SELECT *, 2 FROM two)) WHERE n = 1)"""
SCORED = f"""{REACHED}, part_ AS (SELECT query_id, chunk_id, min(hop)::INT AS hops, count(*) AS matched, sum(weight / ln(1.0 + fanout)) AS raw FROM reached JOIN postings USING (entity) JOIN fan USING (entity) GROUP BY ALL),
    rel AS (SELECT * EXCLUDE (raw), raw / max(raw) OVER (PARTITION BY query_id) AS raw FROM part_), cited AS (SELECT DISTINCT query_id, 'o' || (query_id % 97) AS chunk_id FROM seeds),
    scored AS (SELECT query_id, chunk_id, coalesce(raw, 0) + CASE WHEN c.query_id IS NULL THEN 0 ELSE 0.5::DOUBLE END AS score, coalesce(hops, 0) AS hops, coalesce(matched, 0) + (c.query_id IS NOT NULL)::INT AS matched FROM rel r FULL JOIN cited c USING (query_id, chunk_id) WHERE NOT (chunk_id = 'o' || (query_id % 89)))"""
FOUND = f"""{SCORED}, t AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round_even(score / 1e-9::DOUBLE, 0) DESC, chunk_id) AS place, max(score) OVER (PARTITION BY query_id) AS top FROM scored),
    c AS (SELECT *, row_number() OVER (PARTITION BY query_id, substring(chunk_id, 2)::BIGINT % 5 ORDER BY place) AS n FROM t WHERE place <= 40),
    found AS (SELECT * FROM (SELECT query_id, chunk_id, floor(0.2::DOUBLE * score / top * 1e6 + 0.5) / 1e6 AS score, row_number() OVER (PARTITION BY query_id ORDER BY place)::INT AS rank FROM c WHERE n <= 2) WHERE rank <= 4)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 25")
    return rows.select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).distinct()


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2")
    ends = F.array(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey"))
    return rows.select(F.explode(ends).alias("entity"), F.concat(F.lit("o"), "l_orderkey").alias("chunk_id")).distinct()


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"))
    both = F.array(F.struct(F.concat(F.lit("p"), "query_id").alias("entity"), F.lit(1.0).alias("weight")), F.struct(F.concat(F.lit("p"), (F.col("query_id") + 1).cast("string")).alias("entity"), F.lit(0.9).alias("weight")))
    return rows.select("query_id", F.explode(both).alias("s")).select("query_id", "s.entity", "s.weight")


def reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.traversed(edges(spark, sf_dir), postings(spark, sf_dir), seeds(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = lambda m: seeds(spark, sf_dir).select("query_id", F.concat(F.lit("o"), (F.col("query_id") % m).cast("string")).alias("chunk_id"))
    return G.chunk_scores(reached(spark, sf_dir), postings(spark, sf_dir), chunk(97), chunk(89))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = postings(spark, sf_dir).select("chunk_id").distinct().unionByName(seeds(spark, sf_dir).select(F.concat(F.lit("o"), (F.col("query_id") % 97).cast("string")).alias("chunk_id"))).distinct()
    files = files.withColumn("file", F.substring("chunk_id", 2, 20).cast("long") % 5)
    return G.candidates(scored(spark, sf_dir), files, 4)


@query("gr_1", f"WITH {EDGES} SELECT * FROM degree")
def gr_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(edges(spark, sf_dir))


_WORDS = "regexp_extract_all(lower({x}), '[a-zà-ÿ]+')"
_MATCH = f"""n AS (SELECT DISTINCT array_to_string(w[2:3], ' ') AS name, w[2:3] AS words FROM (SELECT {_WORDS.format(x='text')} AS w FROM benchmark) WHERE len(w) >= 3), t AS (SELECT doc_id, ' ' || array_to_string({_WORDS.format(x='text')}, ' ') || ' ' AS text FROM documents),
    m AS (SELECT DISTINCT doc_id, name FROM t, n WHERE contains(text, ' ' || name || ' '))"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-zà-ÿ]+"), F.lit(0))
    names = table(spark, sf_dir, "benchmark").select(F.slice(words("text"), 2, 2).alias("words"), F.size(words("text")).alias("n")).filter("n >= 3")
    names = names.select(F.array_join("words", " ").alias("name"), "words").distinct()
    return G.matched(table(spark, sf_dir, "documents").select("doc_id", words("text").alias("words")), names)


for _name in ("gr_2", "jn_13"):

    @query(_name, f"WITH {_MATCH} SELECT * FROM m")
    def gr_2(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Names in texts, by their rarest word."""
        return mentions(spark, sf_dir)


@query("gr_3", f"WITH {_MATCH}, f AS (SELECT name, count(*) AS fanout FROM m GROUP BY 1 HAVING count(*) BETWEEN 1 AND 15), r AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY name) AS n FROM m JOIN f USING (name)) SELECT doc_id, name FROM r WHERE n <= 25")
def gr_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds: a text's entities that occur in 1 to 15 documents, 25 at most."""
    own = mentions(spark, sf_dir)
    few = own.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n between 1 and 15").select("name")
    kept = own.join(few, "name").withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("name")))
    return kept.filter("place <= 25").select("doc_id", "name")


for _name in ("gr_4", "jn_11"):

    @query(_name, f"{REACHED} SELECT query_id, entity, weight, hop FROM reached")
    def gr_4(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reached(spark, sf_dir)


@query("gr_5", f"{SCORED} SELECT * FROM scored")
def gr_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir)


@query("gr_6", f"{FOUND} SELECT * FROM found")
def gr_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir)


_POOL = "p AS (SELECT p_partkey AS query_id, 'o' || (p_partkey % 31 + i) AS chunk_id, (10 - i) / 10.0::DOUBLE AS score FROM part, (SELECT unnest(range(1, 6)) AS i) WHERE p_partkey % 20 = 0)"


def small_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("i"))
    return rows.select("query_id", F.concat(F.lit("o"), (F.col("query_id") % 31 + F.col("i")).cast("string")).alias("chunk_id"), ((10 - F.col("i")) / 10).alias("score"))


@query("gr_7", f"{FOUND}, {_POOL} SELECT query_id, chunk_id, coalesce(p.score, 0.1::DOUBLE) + coalesce(f.score, 0) AS score, p.score IS NULL AS new FROM p FULL JOIN found f USING (query_id, chunk_id)")
def gr_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.augmented(small_pool(spark, sf_dir), found(spark, sf_dir), 0.1)


@query("gr_8", f"{REACHED}, x AS (SELECT query_id, chunk_id, weight / ln(1.0 + fanout) AS part FROM reached JOIN postings USING (entity) JOIN fan USING (entity)) SELECT query_id, chunk_id, sum(part) AS s, max(part) AS m, avg(part) AS mean, sum(part) / sqrt(count(*)) AS root, max(part) + 0.1::DOUBLE * ln(count(*)) AS bonus FROM x GROUP BY ALL")
def gr_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways to sum up a chunk's entities, in one aggregation."""
    own = postings(spark, sf_dir)
    part = reached(spark, sf_dir).join(own, "entity").join(G.fan_out(own), "entity").select("query_id", "chunk_id", (F.col("weight") / F.log(1.0 + F.col("fanout"))).alias("part"))
    n = F.count(F.lit(1))
    return part.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("s"), F.max("part").alias("m"), F.avg("part").alias("mean"), (F.sum("part") / F.sqrt(n)).alias("root"), (F.max("part") + 0.1 * F.log(n)).alias("bonus"))


_NORM = r"lower(trim(regexp_replace({x}, '[_\-\s]+', ' ', 'g')))"
_TIER = "CASE WHEN id = q THEN 0 WHEN contains(id, q) THEN 1 WHEN len(list_filter(string_split(q, ' '), lambda w: NOT contains(id, w))) = 0 THEN 2 WHEN len(list_filter(string_split(q, ' '), lambda w: NOT contains(d, w))) = 0 THEN 3 END"


@query("gr_9", f"WITH q AS (SELECT unnest(['promo', 'STANDARD_Part', 'a e', 'o']) AS given), n AS (SELECT p_partkey, {_NORM.format(x='p_name')} AS id, {_NORM.format(x='p_type')} AS d FROM part), t AS (SELECT given, p_partkey, {_TIER} AS tier FROM (SELECT *, {_NORM.format(x='given')} AS q FROM q), n), r AS (SELECT *, row_number() OVER (PARTITION BY given ORDER BY tier, p_partkey)::INT AS place FROM t WHERE tier IS NOT NULL) SELECT given, p_partkey, tier, place FROM r WHERE place <= 20")
def gr_9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by name: exact, contained, all words in the name, all words in the description. A stated set of four names meets all nodes."""
    asked = spark.createDataFrame([(x,) for x in ("promo", "STANDARD_Part", "a e", "o")], "given string").withColumn("q", T.entity_text(F.col("given")))
    nodes = table(spark, sf_dir, "part").select("p_partkey", T.entity_text(F.col("p_name")).alias("id"), T.entity_text(F.col("p_type")).alias("d"))
    whole = lambda c: F.forall(F.split("q", " "), lambda w: F.contains(F.col(c), w))
    tier = F.when(F.col("id") == F.col("q"), 0).when(F.contains("id", "q"), 1).when(whole("id"), 2).when(whole("d"), 3)
    hits = nodes.crossJoin(F.broadcast(asked)).withColumn("tier", tier).filter("tier is not null")
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("given").orderBy("tier", "p_partkey"))).filter("place <= 20").select("given", "p_partkey", "tier", "place")


@query("gr_10", f"WITH {EDGES}, n AS (SELECT DISTINCT b AS node FROM ways WHERE a = 's3'), k AS (SELECT * FROM (SELECT node, row_number() OVER (ORDER BY node <> 's3', node) AS n FROM (FROM n UNION SELECT 's3')) WHERE n <= 30) SELECT a, b FROM edges WHERE a IN (SELECT node FROM k) AND b IN (SELECT node FROM k)")
def gr_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hop around a node: the node first, then its neighbours by id up to a budget, and the edges between those kept."""
    own = edges(spark, sf_dir)
    near = G.both_ways(own).filter("a = 's3'").select(F.col("b").alias("node")).distinct().filter("node <> 's3'")
    kept = F.broadcast(near.orderBy("node").limit(29).union(spark.createDataFrame([("s3",)], "node string")))  # the budget
    return own.join(kept.withColumnRenamed("node", "a"), "a", "left_semi").join(kept.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")


@query("gr_11", f"WITH {EDGES} SELECT direction, other, row_number() OVER (ORDER BY direction, other)::INT AS place FROM (SELECT 'out' AS direction, b AS other FROM edges WHERE a = 'p5' UNION ALL SELECT 'in', a FROM edges WHERE b = 'p5')")
def gr_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node's relations, either way."""
    own = edges(spark, sf_dir).filter("a = 'p5' or b = 'p5'")
    each = own.select(F.when(F.col("a") == "p5", "out").otherwise("in").alias("direction"), F.when(F.col("a") == "p5", F.col("b")).otherwise(F.col("a")).alias("other"))
    return each.withColumn("place", F.row_number().over(Window.orderBy("direction", "other")))  # one node's


_CHAINS = f"WITH {EDGES}, d AS (SELECT b FROM (SELECT DISTINCT * FROM ways) GROUP BY b HAVING count(*) <= 12), k AS (SELECT DISTINCT w.* FROM ways w JOIN d USING (b)), c AS (SELECT x.a, x.b AS bridge, y.a AS c FROM k x JOIN k y ON x.b = y.b AND x.a < y.a)"
for _name in ("gr_12", "jn_9"):

    @query(_name, f"{_CHAINS} SELECT * FROM c")
    def gr_12(spark: SparkSession, sf_dir: str) -> DataFrame:
        return G.chains(edges(spark, sf_dir), 12)


@query("gr_13", f"{_CHAINS}, e AS (SELECT 'p' || l_partkey AS a, 'p' || (l_partkey + 1) AS c FROM lineitem GROUP BY ALL) SELECT c.* FROM c WHERE NOT EXISTS (FROM e WHERE e.a = c.a AND e.c = c.c) AND substring(c.a, 2)::BIGINT % 3 <> substring(c.c, 2)::BIGINT % 3")
def gr_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains whose ends have no edge of their own and no document in common."""
    own = G.chains(edges(spark, sf_dir), 12).filter("substring(a, 2, 20) % 3 <> substring(c, 2, 20) % 3")
    parts = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("p"), (F.col("l_partkey") + 1).cast("string")).alias("c")).distinct()
    return own.join(parts, ["a", "c"], "left_anti").select("a", "bridge", "c")


@query("gr_14", "WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, 1000000000 + l_suppkey AS b FROM lineitem WHERE l_quantity > 49 AND l_partkey % 3 = 0), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS root FROM w UNION SELECT w.b, r.root FROM r JOIN w ON w.a = r.node WHERE r.root < w.b) SELECT node, min(root) AS root FROM r GROUP BY node")
def gr_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of a sparser graph."""
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 49 and l_partkey % 3 = 0")
    return components(rows.select(F.col("l_partkey").alias("a"), (F.lit(1000000000) + F.col("l_suppkey")).alias("b")).distinct())


@query("gr_15", "SELECT l_partkey, l_suppkey, trim(unnest(string_split(k, ','))) AS keyword FROM (SELECT l_partkey, l_suppkey, max(l_returnflag || ', ' || l_linestatus || ',x') AS k FROM lineitem GROUP BY 1, 2)")
def gr_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge's keywords."""
    own = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max(F.concat("l_returnflag", F.lit(", "), "l_linestatus", F.lit(",x"))).alias("k"))
    return own.select("l_partkey", "l_suppkey", F.explode(F.transform(F.split("k", ","), lambda x: F.trim(x))).alias("keyword"))


@query("gr_16", f"WITH {EDGES} SELECT (SELECT count(*) FROM degree) AS nodes, (SELECT count(*) FROM edges) AS edges, max(degree) AS most, (SELECT count(*) FROM degree WHERE starts_with(node, 's')) AS suppliers FROM degree")
def gr_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(edges(spark, sf_dir)).agg(F.count(F.lit(1)).alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.max("degree").alias("most"), F.count_if(F.col("node").startswith("s")).alias("suppliers"))


@query("gr_17", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_tax > 0.04 THEN l_returnflag END, l_linestatus) AS label FROM lineitem")
def gr_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge's label: its type, else its keywords."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.when(F.col("l_tax") > 0.04, F.col("l_returnflag")), F.col("l_linestatus")).alias("label"))


@query("gr_18", "SELECT 'nodes' AS what, count(*) AS n FROM part UNION ALL SELECT 'edges', count(*) FROM lineitem UNION ALL SELECT 'vectors ' || label, count(*) FROM embeddings GROUP BY label")
def gr_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index's counts."""
    count = lambda name, what: table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    vectors = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("vectors "), F.col("label").cast("string")).alias("what"), "n")
    return count("part", "nodes").union(count("lineitem", "edges")).union(vectors)


for _name in ("top_6", "snk_9"):

    @query(_name, f"WITH {EDGES}, k AS (SELECT node, degree FROM degree ORDER BY degree DESC, node LIMIT 400) SELECT a, b, x.degree AS degree_a, y.degree AS degree_b FROM edges JOIN k x ON x.node = a JOIN k y ON y.node = b ORDER BY a, b LIMIT 100")
    def top_6(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The nodes of greatest degree and the edges between them: a bounded sample for display."""
        own = edges(spark, sf_dir)
        top = F.broadcast(G.degrees(own).orderBy(F.desc("degree"), "node").limit(400))
        a, b = (top.select(F.col("node").alias(x), F.col("degree").alias(f"degree_{x}")) for x in "ab")
        return own.join(a, "a").join(b, "b").select("a", "b", "degree_a", "degree_b").orderBy("a", "b").limit(100)


@query("flt_7", f"WITH {POSTINGS} SELECT entity, fanout, fanout > 80 AS hub FROM fan WHERE fanout BETWEEN 1 AND 15 OR fanout > 80")
def flt_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that may be seeds, and hubs."""
    return G.fan_out(postings(spark, sf_dir)).filter("fanout between 1 and 15 or fanout > 80").withColumn("hub", F.col("fanout") > 80)
