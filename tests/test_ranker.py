"""LambdaRank: derivatives against differences of a plain loop, held-out queries, edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import ranker as R

SHAPE = "query_id long, item_id long, label int, x array<double>"


def corpus(n, seed):
    """Labels follow an interaction of two features; the first feature alone is a poor order."""
    r, rows = random.Random(seed), []
    for q in range(n):
        for i in range(12):
            a, b, c = r.random(), r.random(), r.random()
            want = 2 * (b > 0.6 and c > 0.5) + (b > 0.6) + 0.3 * a
            rows.append((q, i, int(want > 2.2) + int(want > 1), [a, b if r.random() > 0.05 else None, c]))
    return rows


def test_held_out_queries_beat_the_base_order(spark):
    own = spark.createDataFrame(corpus(120, 1), SHAPE)
    model = R.fit(own.filter("query_id < 90"), 3, trees=8)
    held = own.filter("query_id >= 90")
    mean = lambda by: R.ndcg(held, by, 5).agg(F.avg("ndcg")).first()[0]
    learnt, base = mean(R.score(model, F.col("x"))), mean(F.col("x")[0])
    assert learnt > base + 0.15 and learnt > 0.85, (learnt, base)


def test_scores_of_values_and_of_bins_agree(spark):
    own = spark.createDataFrame(corpus(40, 2), SHAPE)
    model = R.fit(own, 3, trees=2, depth=2)
    got = own.select("x", R.score(model, F.col("x")).alias("s")).collect()

    def plain(x):
        total = 0.0
        for t in model:
            n = 0
            while n not in t.leaves:
                f, threshold = t.splits[n]
                n = 2 * n + (2 if x[f] is not None and x[f] > threshold else 1)
            total += t.leaves[n]
        return total

    assert [r.s for r in got] == pytest.approx([plain(r.x) for r in got])
    again = R.fit(own.repartition(7), 3, trees=2, depth=2)
    assert [t.splits for t in again] == [t.splits for t in model]


def test_derivatives_equal_a_plain_loop():
    r = random.Random(3)
    rows = [{"item_id": k, "label": r.randrange(3), "score": r.random(), "bins": []} for k in range(9)]
    order = sorted(rows, key=lambda x: -x["score"])
    place = {x["item_id"]: k for k, x in enumerate(order)}
    ideal = sum((2 ** y - 1) / math.log2(k + 2) for k, y in enumerate(sorted((x["label"] for x in rows), reverse=True)))
    g, h = np.zeros(9), np.zeros(9)
    for a in rows:
        for b in rows:
            if a["label"] > b["label"]:
                i, j = a["item_id"], b["item_id"]
                change = abs((2 ** a["label"] - 2 ** b["label"]) * (1 / math.log2(place[i] + 2) - 1 / math.log2(place[j] + 2))) / ideal
                wrong = 1 / (1 + math.exp(a["score"] - b["score"]))
                g[i] += wrong * change
                g[j] -= wrong * change
                h[i] += wrong * (1 - wrong) * change
                h[j] += wrong * (1 - wrong) * change
    got = R.lambdas(rows)
    assert [x["g"] for x in got] == pytest.approx(g.tolist()) and [x["h"] for x in got] == pytest.approx(h.tolist())


def test_nothing_to_learn_gives_no_trees(spark):
    flat = spark.createDataFrame([(1, 1, 1, [0.0]), (1, 2, 1, [1.0]), (2, 1, 0, [0.5]), (None, 3, 2, [0.1]), (3, 1, None, [0.2]), (3, 2, 1, None)], SHAPE)
    assert R.fit(flat, 1) == [] and R.fit(flat.limit(0), 1) == []
    assert flat.select(R.score([], F.col("x")).alias("s")).first().s == 0.0


def test_lists_of_many_lengths_get_the_derivatives_of_each_alone(monkeypatch):
    import random

    import pyarrow as pa

    monkeypatch.setattr(R, "CELLS", 20)
    r = random.Random(2)
    lists = [[{"item_id": k * 7 % 23, "label": float(r.randrange(3)), "score": r.choice([0.0, 0.5, -1.0]), "bins": [q, k]} for k in range(r.randrange(1, 9))] for q in range(40)]
    lists[3] = [x | {"label": 0.0} for x in lists[3]]
    item = pa.struct([("item_id", pa.int64()), ("label", pa.float64()), ("score", pa.float64()), ("bins", pa.list_(pa.int32()))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(lists, pa.list_(item))], ["query_id", "list"])
    got = {tuple(x["bins"]): (x["g"], x["h"]) for b in R.gradients(iter([batch.slice(0, 15), batch.slice(15)])) for x in b.to_pylist()}
    want = {tuple(x["bins"]): (x["g"], x["h"]) for own in lists for x in R.lambdas(own)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and want


def test_lists_are_stored_once_for_all_trees_and_give_each_node_its_sums(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(R, "stored", lambda df, tag, keep=R.stored: tables.append(keep(df, tag)) or tables[-1])
    monkeypatch.setattr(R, "BLOCK", 50)
    rows = corpus(30, 5)
    rows += [(99, k, 0, [0.1, 0.2, 0.3]) for k in range(70)] + [(100, k, k % 3, [k / 70, None, math.nan]) for k in range(70)]
    own = spark.createDataFrame(rows, SHAPE)
    monkeypatch.setattr(R, "drop", lambda df: None)
    edges = R.bin_edges(own, 3, 300)
    assert len(R.fit(own, 3, trees=3, depth=2, bins=300)) == 3 and len(tables) == 1
    assert 1 < tables[0].count()
    split = (0, 149)
    got = {(r.node, r.feature, r.bin): (r.g, r.h) for r in R.histogram(tables[0], [({0: split}, {1: 0.25, 2: -0.5})], {0: split}, [2], 3, 300).collect()}
    lists = {}
    place = lambda v, e: 0 if v is None else len(e) if math.isnan(v) else sum(x < v for x in e)
    for q, i, label, x in rows:
        bins = [place(v, e) for v, e in zip(x, edges, strict=True)]
        lists.setdefault(q, []).append({"item_id": i, "label": label, "score": -0.5 if bins[0] > 149 else 0.25, "bins": bins})
    want = {}
    for x in (x for each in lists.values() for x in R.lambdas(each) if x["bins"][0] > 149):
        for k, b in enumerate(x["bins"]):
            old = want.get((2, k, b), (0, 0))
            want[2, k, b] = (old[0] + x["g"], old[1] + x["h"])
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want) and want


def test_a_long_list_takes_no_square_of_memory():
    import tracemalloc

    n = 2000
    own = pa_lists([[{"item_id": k, "label": float(k % 3), "score": k % 7 / 7, "bins": [k]} for k in range(n)]])
    tracemalloc.start()
    assert sum(x.num_rows for x in R.gradients(iter([own]))) == n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * n * n / 4


def pa_lists(lists):
    import pyarrow as pa

    item = pa.struct([("item_id", pa.int64()), ("label", pa.float64()), ("score", pa.float64()), ("bins", pa.list_(pa.int32()))])
    return pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(item))], ["query_id", "list"])


def test_features_in_one_shuffle_equal_those_of_joined_channels(spark, tmp_path):
    from corvane.plans.evaluation import features, graded_features, ltr_4

    lines = [(1, 10, 1, 5.0, 7.0, 0.02, "R"), (1, 10, 2, 20.0, 9.0, 0.01, "N"), (1, 11, 3, 12.0, None, 0.05, "R"), (1, 12, 4, 3.0, None, 0.03, "A"), (1, 13, 5, 2.0, 1.0, 0.04, "R"), (1, 14, 6, None, 4.0, None, None)]
    lines += [(2, 10, 1, 30.0, 8.0, 0.0, "A"), (2, 99, 2, 30.0, 8.0, 0.0, "A"), (None, 10, 1, 30.0, 8.0, 0.0, "A"), (3, None, 1, 30.0, 8.0, 0.0, "A"), (4, 11, 3, 11.0, 8.0, 0.0, "R")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"{'`' * 20 if k == 12 else ''}part {k}") for k in range(10, 15)] + [(11, "another")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    at = str(tmp_path)
    want = features(spark, at).join(ltr_4(spark, at), ["query_id", "item_id"])
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(graded_features(spark, at)) == rows(want) and want.count() == 7
