"""Graph operators: degrees, matching, traversal, scoring and chains, in joins.

Edges are (a, b), undirected; a self-loop counts twice. Postings are (entity, chunk_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end, in one pass over the edges."""
    ends = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.select(F.explode(ends).alias("e")).select("e.a", "e.b")


def degrees(edges: DataFrame) -> DataFrame:
    """GR-1: (node, degree)."""
    return both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def fan_out(postings: DataFrame) -> DataFrame:
    """(entity, fanout): in how many chunks an entity occurs."""
    return postings.groupBy("entity").agg(F.count(F.lit(1)).alias("fanout"))


def edge_damping(degree: Column, fanout: Column) -> Column:
    """GR-4: what a hop loses by the degree of its start and the fan-out of its end."""
    return F.least(F.lit(1.0), 1.0 / (F.log(2.0 + degree) * F.log(2.0 + fanout)))


def traversed(edges: DataFrame, postings: DataFrame, seeds: DataFrame, decay: float = 0.6, hub: int = 80, bridge: int = 12) -> DataFrame:
    """GR-4, JN-11: (query_id, entity, weight, hop) reached from seeds (query_id, entity, weight) in two hops, the greatest weight of any path, then the fewest hops.

    Entities in more than hub chunks neither spread nor are reached; in the second hop only
    entities of a degree up to bridge spread. Each hop is one join on the start, after the
    hubs have left, so that no node of the frontier brings more than its kept neighbours.
    """
    fan, degree = fan_out(postings), degrees(edges)
    node = degree.join(fan.withColumnRenamed("entity", "node"), "node", "left").select("node", "degree", F.coalesce("fanout", F.lit(0)).alias("fanout")).filter(F.col("fanout") <= hub)
    ways = both_ways(edges).distinct().join(node.select(F.col("node").alias("a"), "degree"), "a").join(node.select(F.col("node").alias("b"), "fanout"), "b")
    ways = ways.select("a", "b", "degree", (decay * edge_damping(F.col("degree"), F.col("fanout"))).alias("loss"))

    def hop(frontier: DataFrame, number: int) -> DataFrame:
        start = ways if number == 1 else ways.filter(F.col("degree") <= bridge)
        out = frontier.join(start, frontier.entity == start.a).select("query_id", F.col("b").alias("entity"), (F.col("weight") * F.col("loss")).alias("weight"))
        return out.groupBy("query_id", "entity").agg(F.max("weight").alias("weight")).withColumn("hop", F.lit(number))

    zero = seeds.groupBy("query_id", "entity").agg(F.max("weight").alias("weight")).withColumn("hop", F.lit(0))
    known = zero.select("query_id", "entity", F.col("weight").alias("had"))
    one = hop(zero, 1).join(known, ["query_id", "entity"], "left").filter("had is null or weight > had").drop("had")
    every = zero.unionByName(one).unionByName(hop(one, 2))
    best = every.groupBy("query_id", "entity").agg(F.min(F.struct((-F.col("weight")).alias("less"), "hop")).alias("b"))
    return best.select("query_id", "entity", (-F.col("b.less")).alias("weight"), F.col("b.hop").alias("hop"))


def chunk_scores(reached: DataFrame, postings: DataFrame, cited: DataFrame, excluded: DataFrame, bonus: float = 0.5) -> DataFrame:
    """GR-5: (query_id, chunk_id, score, hops, matched): the entities' damped weights summed, divided by the query's greatest sum, with a bonus for cited chunks; excluded ones are left out after that.

    cited and excluded: (query_id, chunk_id).
    """
    fan = fan_out(postings)
    part = reached.join(postings, "entity").join(fan, "entity").select("query_id", "chunk_id", "hop", (F.col("weight") / F.log(1.0 + F.col("fanout"))).alias("part"))
    raw = part.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("raw"), F.min("hop").alias("hops"), F.count(F.lit(1)).alias("matched"))
    raw = raw.withColumn("raw", F.col("raw") / F.max("raw").over(Window.partitionBy("query_id")))
    out = raw.join(cited.distinct().withColumn("extra", F.lit(bonus)), ["query_id", "chunk_id"], "full")
    out = out.select("query_id", "chunk_id", (F.coalesce("raw", F.lit(0.0)) + F.coalesce("extra", F.lit(0.0))).alias("score"), F.coalesce("hops", F.lit(0)).alias("hops"), (F.coalesce("matched", F.lit(0)) + F.col("extra").isNotNull().cast("int")).alias("matched"))
    return out.filter("score > 0").join(excluded, ["query_id", "chunk_id"], "left_anti")


def candidates(scored: DataFrame, files: DataFrame, limit: int, weight: float = 0.2, cap: int = 2) -> DataFrame:
    """GR-6, WIN-7: of the first ten times limit chunks cap of a file at most, up to limit; the score is a share of the best, to six places."""
    q = Window.partitionBy("query_id")
    order = [F.desc(F.rint(F.col("score") / 1e-9)), "chunk_id"]
    top = scored.withColumns({"place": F.row_number().over(q.orderBy(*order)), "top": F.max("score").over(q)}).filter(F.col("place") <= 10 * limit).join(files, "chunk_id")
    few = top.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "file").orderBy("place"))).filter(F.col("n") <= cap)
    out = few.withColumn("rank", F.row_number().over(q.orderBy("place"))).filter(F.col("rank") <= limit)
    return out.select("query_id", "chunk_id", (F.floor(weight * F.col("score") / F.col("top") * 1e6 + 0.5) / 1e6).alias("score"), "rank")


def augmented(pool: DataFrame, found: DataFrame, floor: float) -> DataFrame:
    """GR-7: a pool (query_id, chunk_id, score) with the graph's candidates added to what it has; new chunks come in at floor and their score."""
    return pool.join(found.select("query_id", "chunk_id", F.col("score").alias("extra")), ["query_id", "chunk_id"], "full").select(
        "query_id", "chunk_id", (F.coalesce("score", F.lit(floor)) + F.coalesce("extra", F.lit(0.0))).alias("score"), F.col("score").isNull().alias("new")
    )


def matched(texts: DataFrame, names: DataFrame) -> DataFrame:
    """GR-2, JN-13: (doc_id, name) where a text holds a name as whole words in a row.

    texts: doc_id, words (array); names: name, words (array). Each name is looked for by
    its rarest word, counted over the texts, and only where that word occurs; then the
    words in a row confirm it.
    """
    postings = texts.select("doc_id", F.explode(F.array_distinct("words")).alias("word"))
    wanted = names.select("name", F.explode(F.array_distinct("words")).alias("word"))
    frequency = postings.join(wanted.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rarest = wanted.join(frequency, "word", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("r"), F.count(F.lit(1)).alias("n"))
    keys = rarest.filter("r.df > 0").select("name", F.col("r.word").alias("word"))
    pairs = postings.join(keys, "word").select("doc_id", "name").join(names, "name")
    joined = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    return pairs.select("doc_id", "name", joined("words").alias("phrase")).join(texts.select("doc_id", joined("words").alias("text")), "doc_id").filter("contains(text, phrase)").select("doc_id", "name").distinct()


def chains(edges: DataFrame, most: int) -> DataFrame:
    """GR-12, JN-9: (a, bridge, c) with a < c over bridges of a degree up to most, so that no bridge gives more than most * most / 2 rows; larger hubs tie everything to everything and say nothing."""
    ways = both_ways(edges).distinct().filter("a <> b")
    small = ways.groupBy("b").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") <= most).select("b")
    kept = ways.join(small, "b")
    other = kept.select("b", F.col("a").alias("c"))
    return kept.join(other, "b").filter("a < c").select("a", F.col("b").alias("bridge"), "c")
