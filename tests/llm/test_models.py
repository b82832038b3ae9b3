import random

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import decontaminate, toxicity

DOCS = "doc_id long, text string, score int, item_id int"


def prose(r, n):
    return " ".join("".join(r.choice(["ta", "ri", "mo", "el", "on", "us"]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_gradients_are_those_of_the_loss():
    net, r = toxicity.Network(["a"]), np.random.default_rng(0)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    x, y, there = r.standard_normal((3, 5, 16)), np.array([1.0, 0, 1]), np.arange(5) < np.array([[5], [3], [4]])

    def loss():
        a = {s: [x[:, k] @ net.p["W" + s] + net.p["B" + s] for k in range(5)] for s in "fb"}
        q = toxicity.sigmoid(net.pooled(net.both(a), there)[1] @ net.p["w"] + net.p["b"])
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()

    g, _ = net.gradients(x, there, y)
    for name in ("Wf", "Ub", "Bf", "v", "w", "b"):
        at = (0,) * net.p[name].ndim
        was, sides = net.p[name][at], []
        for e in (1e-4, -1e-4):
            net.p[name][at] = was + e
            sides.append(loss())
        net.p[name][at] = was
        assert abs((sides[0] - sides[1]) / 2e-4 - g[name][at]) < 1e-5


def test_toxic_documents_are_found_wherever_the_word_is(spark):
    r, texts, labels = random.Random(4), [], []
    for k in range(400):
        words = prose(r, r.randrange(5, 120)).split()
        if k % 4 == 0:
            words.insert(r.randrange(len(words)), r.choice(["vilebad", "grimfoe"]))
        texts.append(" ".join(words))
        labels.append(int(k % 4 == 0))
    net = toxicity.fit(texts, labels, epochs=4)
    rows = [(1, prose(r, 5000) + " vilebad " + prose(r, 3000), 0, 0), (2, prose(r, 500), 0, 0), (3, None, 0, 0), (4, "", 0, 0), (None, "grimfoe", 0, 0), (2, prose(r, 50), 0, 0)]
    got = toxicity.toxicity(spark.createDataFrame(rows, DOCS), net).collect()
    assert [x.predicted for x in got] == [1, 0, 0, 0, 1, 0]
    assert all(0 <= x.score <= 1 for x in got)
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), net).count() == 0


def test_words_of_many_documents_are_projected_once(monkeypatch):
    net, asked = toxicity.Network(["a"]), []
    real = net.inputs
    monkeypatch.setattr(net, "inputs", lambda words: asked.extend(words) or real(words))
    documents = [[f"w{k}" for k in range(at, at + 1000)] for at in range(0, 60_000, 1000)]
    first = [net.scores([d])[0] for d in documents]
    again = [net.scores([d])[0] for d in documents]
    assert len(asked) == len(set(asked)) == 60_000
    assert all((a == b).all() for a, b in zip(first, again, strict=True))


def test_no_labels_still_score():
    assert [len(s) for s in toxicity.fit([], []).scores([["a"], []])] == [1, 0]


def naive(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_common_equals_the_plain_table():
    r = np.random.default_rng(2)
    for _ in range(200):
        a, b = r.integers(0, 6, r.integers(1, 30)), r.integers(-1, 6, r.integers(0, 50))
        assert decontaminate.common(a, b) == naive(a.tolist(), b.tolist())


def test_items_and_paraphrases_are_found_and_nothing_else(spark):
    r = random.Random(6)
    items = [(k, f"{prose(r, r.randrange(12, 40))}. {prose(r, 8)}.") for k in range(30)]
    rows = [(k, prose(r, r.randrange(1, 600)), 0, 0) for k in range(60)]
    want = set()
    for k in range(10):
        rows.append((100 + k, f"{prose(r, 700)}\n{items[k][1]}\n{prose(r, 50)}", 0, 0))
        want.add((100 + k, k))
    for k in range(10, 20):  # a fifth of the words changed, the answer kept
        head, answer = items[k][1].split(".")[:2]
        words = head.split()
        for j in range(2, len(words), 5):
            words[j] = "changed"
        rows.append((100 + k, f"{prose(r, 100)} {' '.join(words)}. {answer}. {prose(r, 300)}", 0, 0))
        want.add((100 + k, k))
    rows += [(None, None, 0, 0), (200, "", 0, 0)]
    docs, benchmark = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*items, (None, None), (99, " ! ")], "item_id long, text string")
    got = decontaminate.contaminated(docs, benchmark)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want
    left = decontaminate.without_benchmark(docs, benchmark)
    assert left.count() == len(rows) - 20 and left.columns == docs.columns
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert docs.select(F.col("score")).count() == len(rows)


def test_short_items_are_found_at_every_alignment(spark):
    r = random.Random(8)
    known = [f"known{k}" for k in range(40)]  # words of another item, so that neighbours have vectors too
    items = {n: " ".join(f"w{n}x{k}" for k in range(n)) for n in range(1, 9)}
    rows, want = [], set()
    for n in items:
        for at in range(4):
            for fill in (known, ["far", "off"]):
                words = [r.choice(fill) for _ in range(20 + at)] + items[n].split() + [r.choice(fill) for _ in range(17)]
                want.add((len(rows), n))
                rows.append((len(rows), " ".join(words), 0, 0))
    rows.append((1000, " ".join(["w4x0", "off"] * 5 + items[8].split()[:5]), 0, 0))
    benchmark = spark.createDataFrame([*items.items(), (99, " ".join(known))], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(rows, DOCS), benchmark)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want


def test_planted_paraphrases_of_real_items_are_found(spark, sf_dir):
    """Items of the benchmark with words changed, dropped and put in: whatever meets the shares by a plain table over the whole text is found, and nothing else."""
    r = random.Random(12)
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    known = {i: (decontaminate.words_of(t), decontaminate.answer_of(t)) for i, t in items}
    rows = []
    for k in range(240):
        words, out = known[items[k % len(items)][0]][0], []
        for w in words:
            x = r.random()
            rate = (k % 7) * 0.05
            if x < rate / 2:
                out.append("zzchanged")
            elif x < rate * 3 / 4:
                continue
            else:
                out += ["zzput", w] if x < rate else [w]
        rows.append((k, f"{prose(r, r.randrange(0, 200))} {' '.join(out)} {prose(r, r.randrange(0, 60))}", 0, 0))
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for k, text, _, _ in rows:
        i = items[k % len(items)][0]
        words, answer = known[i]
        said = decontaminate.words_of(text)
        share, told = naive(words, said) / len(words), naive(answer, said) / max(1, len(answer))
        if share >= decontaminate.COPY or share >= decontaminate.PARAPHRASE and told >= decontaminate.ANSWER:
            want.add((k, i))
    assert len(want) > 200
    assert len(want - got) <= len(want) // 100  # recall of 0.99 at least; spans are judged in windows, the plain table is over the whole text
    for k, i in got - want:  # nothing besides, but for other items that the text holds as well
        words, said = known[i][0], decontaminate.words_of(rows[k][1])
        assert naive(words, said) / len(words) >= decontaminate.PARAPHRASE


def test_held_out_quality_on_real_labels(spark, sf_dir):
    at = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    got = toxicity.toxicity(docs, toxicity.trained(docs, labels)).filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    ones, zeros = [x.predicted for x in got if x.toxic], [x.predicted for x in got if not x.toxic]
    assert sum(zeros) <= 0.1 * len(zeros) and sum(ones) >= 0.4 * len(ones), (sum(ones), len(ones), sum(zeros), len(zeros))


def test_the_sample_is_bounded_and_takes_no_held_out_row(spark):
    docs = spark.createDataFrame([(k % 900, f"text {k} " + "x" * (k % 50), 0, 0) for k in range(1000)] + [(None, "x", 0, 0)], DOCS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    few = toxicity.sampled(docs, labels, 100, 40)
    ids = [x.doc_id for x in few.collect()]
    assert len(ids) == len(set(ids)) == 100 and few.filter(toxicity.held_out(F.col("doc_id"))).count() == 0
    assert toxicity.sampled(docs.limit(0), labels, 100, 40).count() == 0
