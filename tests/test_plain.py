"""Operators without SQL against plain loops, and text functions against literal values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import catalog
from corvane.functions import text as T
from corvane.operators import chunking as C
from corvane.operators import dense as D
from corvane.operators import evaluation as E
from corvane.operators import fusion as U
from corvane.operators import graph as G
from corvane.operators import upkeep as K
from corvane.operators.components import components
from corvane.operators.sparse import holding
from corvane.plans.structure import rendered


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x"))
    return row.first().x


@pytest.mark.parametrize(
    "token, want",
    [("hyp:1a2b3c4d", True), ("snake_case", True), ("VmaNative", True), ("Q7X42", True), ("word", False), ("__", False), ("12345", False), ("a1", False), ("", False), ("x:abc", False)],
)
def test_identifier_shapes(spark, token, want):
    assert one(spark, T.is_identifier(F.col("t")), t=token) is want


def test_identifier_tokens(spark):
    assert one(spark, T.identifier_tokens(F.col("t")), t="See VmaNative (phase_x1/safe-mode). q7x42, a..b ./-") == ["see", "vmanative", "vma", "native", "phase_x1/safe-mode", "phase", "x1", "safe", "mode", "q7x42", "a..b", "a", "b"]


@pytest.mark.parametrize("text, want", [("hello", "en"), ("привет мир", "ru"), ("x" * 90 + " да да да", "ru"), ("x" * 90 + " да", "en"), ("", "en"), ("123", "en")])
def test_languages(spark, text, want):
    assert one(spark, T.language(F.col("t")), t=text) == want


def test_headers_and_dates(spark):
    front = "---\nname: x\ndate: '2024-02-03'\n---\n\n\nbody\n"
    assert one(spark, T.with_header(F.col("t"), F.lit("[H]\n\n")), t=front) == "---\nname: x\ndate: '2024-02-03'\n---\n\n[H]\n\nbody\n"
    assert one(spark, T.with_header(F.col("t"), F.lit("[H]\n\n")), t="---\nnever closed\n") == "[H]\n\n---\nnever closed\n"
    assert one(spark, T.chunk_date(F.col("t")).cast("string"), t=front) == "2024-02-03"
    assert one(spark, T.chunk_date(F.col("t")).cast("string"), t="[Document: a | Section: b | Date: unknown]\n" + front) is None
    assert one(spark, T.chunk_date(F.col("t")).cast("string"), t="date: 2024-13-77") is None


@pytest.mark.parametrize("text, want", [("name: DEPRECATED - x", True), ("name: — superseded by y", True), ("name: b1-falsified-deprecated", False), ("a **THIS NOTE IS OBSOLETE** b", True), ("this note is obsolete", False), ("x" * 1600 + "**THIS NOTE IS OBSOLETE**", False)])
def test_stale_notes(spark, text, want):
    assert one(spark, T.is_deprecated(F.col("t")), t=text) is want


def test_cuts(spark):
    assert one(spark, T.on_word(F.col("t"), 9), t="alpha beta gamma") == "alpha…"
    assert one(spark, T.on_line(F.col("t"), 30), t="first line\nsecond line is much longer than that") == "first line…[truncated]"
    assert one(spark, T.keywords(F.col("t")), t="This is Alpha: alpha beta-x, gamma.") == "Alpha beta-x gamma"


def test_stable_ids_do_not_change_when_a_file_is_archived(spark):
    a, b = (one(spark, T.stable_id(F.col("p")), p=p) for p in ("/staging/report.md", "/staging/ingested/report.md"))
    assert a == b and len(a) == 17


def test_relevant_and_different_equals_a_loop(spark):
    r, rows = np.random.default_rng(2), []
    for q in range(6):
        for k in range(12):
            v = r.standard_normal(4)
            rows.append((q, k, k + 1, float(r.random()), [float(x) for x in v / np.linalg.norm(v)]))
    got = U.relevant_and_different(spark.createDataFrame(rows, "query_id long, item_id long, rank int, score double, v array<double>"), 0.6, 9, 4).collect()
    for q in range(6):
        pool = sorted((x for x in rows if x[0] == q), key=lambda x: x[2])[:9]
        low, high = min(x[3] for x in pool), max(x[3] for x in pool)
        chosen = []
        while len(chosen) < 4:
            best = max((x for x in pool if x not in chosen), key=lambda x: 0.6 * (x[3] - low) / (high - low) - 0.4 * max((float(np.dot(x[4], c[4])) for c in chosen), default=0.0))
            chosen.append(best)
        assert [x.item_id for x in sorted((x for x in got if x.query_id == q), key=lambda x: x.chosen)] == [x[1] for x in chosen]


def test_the_blend_keeps_sure_pairs(spark):
    rows = [(1, 1, 1, 0.9, 3), (1, 2, 2, 0.8, 1), (1, 3, 3, 0.4, 2), (2, 1, 1, 0.5, None), (2, 2, 2, 0.5, 1)]
    got = U.blended(spark.createDataFrame(rows, "query_id long, item_id long, rank int, score double, rerank int")).collect()
    order = lambda q: [x.item_id for x in sorted((x for x in got if x.query_id == q), key=lambda x: x.place)]
    assert order(1) == [2, 1, 3] and order(2) == [2, 1]


def test_spread_and_nearest_in_small_blocks(spark):
    r = np.random.default_rng(4)
    rows = [(k, [float(x) for x in r.standard_normal(5)]) for k in range(60)] + [(60, [0.0] * 5), (61, None)]
    own = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = own.filter("vec_id < 20").withColumnRenamed("vec_id", "query_id")
    got = {(x.query_id, x.rank): x.vec_id for x in D.nearest(own, asked, 4, block=6).collect()}
    m = np.array([v for _, v in rows[:60]])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(20):
        assert [got[q, k] for k in range(1, 5)] == list(np.argsort(-(m @ m[q]), kind="stable")[:4])
    assert D.nearest(own, asked.limit(0), 4).count() == 0


def test_places_do_not_depend_on_partitions(spark):
    rows = [(k % 3, float((k * 37) % 11)) for k in range(500)] + [(9, None)]
    own = spark.createDataFrame(rows, "g int, v double").repartition(7)
    got = {x.g: (x.p50, x.p95) for x in E.percentiles(own, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for g in range(3):
        ordered = sorted(v for k, v in rows if k == g)
        assert got[g] == tuple(ordered[round(p * (len(ordered) - 1))] for p in (0.5, 0.95))


def test_bootstrap_covers_the_mean(spark):
    r = random.Random(1)
    rows = [(k, r.gauss(3, 1)) for k in range(400)]
    own = spark.createDataFrame(rows, "k int, v double")
    a, b = (E.bootstrap(own.repartition(n), "v", 500).first() for n in (1, 5))
    assert a.low < a.mean < a.high and a.high - a.low == pytest.approx(4 / math.sqrt(400), rel=0.3)
    assert (a.low, a.high) == pytest.approx((b.low, b.high))


def test_components_of_a_path_and_a_ring(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}


def test_holding_equals_contains(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(1, "a b"), (2, "zz"), (3, None), (4, "of it the and")] + [(10 + k, t[0][5:90]) for k, t in enumerate(docs.select("text").limit(5).collect())]
    got = {(x.query_id, x.doc_id) for x in holding(docs, spark.createDataFrame(rows, "query_id long, passage string")).collect()}
    assert got == {(q, d.doc_id) for q, p in rows if p is not None for d in docs.collect() if p in d.text}


def test_names_in_texts(spark):
    texts = spark.createDataFrame([(1, ["see", "red", "fox", "run"]), (2, ["red", "a", "fox"]), (3, ["fox"]), (4, [])], "doc_id long, words array<string>")
    names = spark.createDataFrame([("red fox", ["red", "fox"]), ("fox", ["fox"]), ("owl", ["owl"])], "name string, words array<string>")
    assert {(x.doc_id, x.name) for x in G.matched(texts, names).collect()} == {(1, "red fox"), (1, "fox"), (2, "fox"), (3, "fox")}


def test_a_narrow_walk_deletes_nothing(spark):
    t = lambda rows, c: spark.createDataFrame(rows, f"doc_id long, {c} string")
    plan = lambda walked: {x.doc_id: x.state for x in K.refresh_plan(t(walked, "now"), t([(k, "a") for k in range(1, 7)], "was"), t([(1, "processed"), (2, "failed"), (3, "processed"), (9, "processed")], "status"), spark.createDataFrame([(5,)], "doc_id long")).collect()}
    assert plan([(1, "a"), (2, "a"), (3, "b"), (8, "c")]) == {1: "unchanged", 2: "retry", 3: "changed", 8: "new", 4: "gone", 5: "kept", 6: "gone", 9: "unknown"}
    assert plan([(1, "a")])[4] == "refused"


NOTE = "intro\n\n# Top\n\ntext one\n\n## A\n\n```\n# no heading\n\ncode\n```\n| a |\n|---|\n| 1 |\n\n## B\nlong " + "word " * 200 + "\n\n### C\ntail\n"


def test_markdown_chunks():
    got = C.markdown_chunks(NOTE, 200, 40)
    assert [c for _, _, c in got][0].startswith("intro") and all(len(c) <= 200 for _, _, c in got)
    code = next(c for _, _, c in got if "# no heading" in c)
    assert code.startswith("# Top > ## A\n\n## A") and "```\n# no heading\n\ncode\n```" in code
    seen = set()
    for a, b, _ in got:
        seen |= set(range(a, b))
    assert all(k in seen for k, ch in enumerate(NOTE) if not ch.isspace())
    assert C.markdown_chunks("") == [] and C.markdown_chunks("plain " * 100, 100, 20)[1][0] == 80
    with pytest.raises(ValueError):
        C.markdown_chunks("x", 10, 10)
    assert [k for _, _, k in C.blocks("para\n\n- item\n- item\n\n> q\n\n| a |\n| b |\n\n~~~\n\nx\n~~~\n")] == ["para", "list", "quote", "table", "fence"]


def test_heading_paths(spark):
    notes = spark.createDataFrame([(1, NOTE), (2, ""), (3, "no heading")], "doc_id long, note string")
    got = {x.title: x.path for x in C.paths(C.headings(notes)).collect()}
    assert got == {"Top": ["Top"], "A": ["Top", "A"], "B": ["Top", "B"], "C": ["Top", "B", "C"]}


def test_a_skipped_piece_takes_no_room(spark):
    rows = [(1, 1, 1, "a", "x" * 50), (1, 2, 2, "b", "y" * 80), (1, 3, 3, "a", "line one\nline two\nline three " + "z" * 40), (1, 4, 4, "c", "w" * 30)]
    got = [(x.item_id, x.text) for x in rendered(spark.createDataFrame(rows, "query_id long, item_id long, rank int, path string, content string"), 70, 100, 5).collect()]
    assert got == [(1, "x" * 50), (3, "line one\nline two"), (4, "w" * 30)]


def test_every_query_without_sql_runs(spark, sf_dir):
    for name in sorted(set(catalog.queries()) - set(catalog.oracle_sql())):
        assert catalog.queries()[name](spark, sf_dir).count() > 0, name


def test_questions_are_taken_unless_a_taken_one_is_near(spark):
    import random

    from corvane.operators import upkeep as K

    r = random.Random(6)
    base = [f"w{k}" for k in range(40)]
    sets = []
    for k in range(150):
        own = set(r.sample(base, r.randrange(1, 9))) if k % 3 or not sets else set(sets[r.randrange(len(sets))]) ^ set(r.sample(base, r.randrange(0, 2)))
        sets.append(sorted(own))
    rows = spark.createDataFrame([(k, w) for k, w in enumerate(sets)] + [(900, []), (None, ["w1"])], "item_id long, words array<string>")
    pairs = K.near_pairs(rows, 0.5)
    want = {(i, j): len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) for i in range(150) for j in range(i) if sets[i] and sets[j]}
    want = {k: s for k, s in want.items() if s >= 0.5}
    assert {(x.item_id, x.other): x.share for x in pairs.collect()} == pytest.approx(want)
    kept = set()
    for i in range(150):
        if not any((i, j) in want for j in kept):
            kept.add(i)
    assert {x.item_id for x in K.taken(rows, pairs).filter("taken").collect()} == kept | {900} and len(kept) < 140


def test_reports_that_asked_other_things_are_not_compared(spark):
    from corvane.operators import evaluation as E

    shape = "metric string, value double, queries long, corpus string"
    a = spark.createDataFrame([("mrr", 0.5, 10, "c"), ("recall", 0.5, 10, "c"), ("latency_p95", 10.0, 10, "c"), ("old", 1.0, 10, "c"), ("none", 0.1, None, None)], shape)
    b = spark.createDataFrame([("mrr", 0.47, 10, "c"), ("recall", 0.9, 9, "c"), ("latency_p95", 11.0, 10, "c"), ("new", 1.0, 10, "c"), ("none", 0.1, None, None)], shape)
    assert {x.metric: (x.comparable, x.passed) for x in E.gate(a, b).collect()} == {"mrr": (True, False), "recall": (False, None), "latency_p95": (True, True), "old": (False, None), "new": (False, None), "none": (True, True)}
    d = E.paired(spark.createDataFrame([(1.0, 0.5), (2.0, 1.0), (None, 1.0)], "a double, b double"), "a", "b").first()
    assert (d.mean, d.n) == (0.75, 2) and d.low < 0.75 < d.high


def test_any_text_is_fit_for_json(spark):
    import json

    from corvane.functions import text as T

    rows = spark.createDataFrame([('a"b\\c\n\r\t\x01\x7f/é', ["x\\", '"'] * 3), (None, None)], "t string, w array<string>")
    got = [json.loads(x.j) for x in rows.select(T.safe_json({"t": F.col("t"), "w": [F.col("w")], "m": {"d": {"e": F.col("t")}}}, 2, {"t": 9}, 4).alias("j")).collect()]
    assert got == [{"t": 'a"b\\c\n\r\t ', "w": ["x\\", '"', "x\\", '"'], "m": {"d": "..."}}, {"t": None, "w": None, "m": {"d": "..."}}]


def test_a_report_over_another_corpus_is_an_error(spark):
    shape = "recall double, ndcg double, rr double, found long"
    calls = spark.createDataFrame([(1.0,), (3.0,), (None,), (9.0,)], "ms double")
    r = E.report(spark.createDataFrame([(1.0, 0.5, 1.0, 2), (0.0, 0.0, 0.0, 0)], shape), calls, "ms").first()
    assert (r.recall, r.mrr, r.matched, r.calls, r.latency_p50, r.latency_p95) == (0.5, 0.5, 2, 3, 3.0, 9.0) and r.latency_mean == pytest.approx(13 / 3)
    with pytest.raises(Exception, match="belong together"):
        E.report(spark.createDataFrame([(0.0, 0.0, 0.0, 0)], shape), calls, "ms").collect()
    none = E.report(spark.createDataFrame([], shape), calls.limit(0), "ms").first()
    assert none.recall is None and none.calls == 0 and none.latency_p95 is None


def test_titles_take_precedence(spark):
    rows = [(1, "---\ntitle: 'Front title'\n---\n# H1\n", "a/b.md"), (2, "---\nname: x\n---\n## H2\n# First\n# Second\n", "a/b.md"), (3, "plain", "a/note.v2.md"), (4, "```\n# no\n```\n", None), (5, None, "x/y")]
    got = {r.doc_id: r.doc_title for r in C.titles(spark.createDataFrame(rows, "doc_id long, note string, path string")).collect()}
    assert got == {1: "Front title", 2: "First", 3: "note.v2", 4: "", 5: "y"}


def test_each_question_has_its_nearest_however_far(spark):
    words = {1: "a b c d", 2: "a b c e", 3: "a x y z w v", 4: "q r", 5: "a", 6: "", 7: "q s t u o p n m l k"}
    sets = {k: set(t.split()) for k, t in words.items()}
    rows = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "item_id long, words array<string>")
    want = {}
    for k, s in sets.items():
        shares = [len(s & o) / len(s | o) for j, o in sets.items() if j < k and s & o]
        want |= {k: max(shares)} if shares else {}
    assert {r.item_id: r.nearest for r in K.nearest_share(K.by_rarity(rows), 0.48).collect()} == want


def test_nearest_in_slices_gives_the_same(spark, monkeypatch):
    import numpy as np
    from corvane.operators import dense as D

    v = np.random.default_rng(3).normal(size=(400, 8)).round(1)
    v[200:240] = v[:40]
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>").coalesce(1)
    ask = rows.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    run = lambda: sorted(tuple(r)[:2] + (r.rank,) for r in D.nearest(rows, ask, 5).collect())
    whole = run()
    monkeypatch.setattr(D, "CELLS", 120)
    assert run() == whole and len(whole) == 200


def test_pools_are_dealt_over_all_shuffle_partitions(spark, sf_dir):
    from corvane.plans import ranking

    assert ranking.pool(spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # not one a core
