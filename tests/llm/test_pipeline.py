"""The pipeline's stages on planted rows, null and repeated ids among them."""

import random

import pytest

import corpus_pipeline
from corvane.llm import decontaminate, simhash, toxicity
from corvane.llm.scratch import stored

DOCS = "doc_id long, text string"
ITEM = "which river crosses the old town of brenna and feeds the mill. the slow river tarn feeds it."


def prose(r, n):
    return " ".join("".join(r.choice(["ta", "ri", "mo", "el", "on", "us"]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_a_near_copy_takes_no_other_row_of_its_id(spark):
    r = random.Random(1)
    a, b, c, d = (prose(r, 60) for _ in range(4))
    rows = [(3, a), (None, a), (None, b), (5, a), (5, c), (None, None), (None, d), (7, d), (7, d)]
    left = simhash.keep_one(spark.createDataFrame(rows, DOCS))
    assert rows_of(left) == sorted([(3, a), (None, b), (5, c), (None, None), (7, d), (7, d)], key=str)


def test_near_copies_of_any_kind_go_and_others_stay(spark, monkeypatch):
    """Texts that share 0.8 or more of their five-word shingles, in groups large enough to be checked in several tasks."""
    monkeypatch.setattr(simhash, "PAIRS", 7)
    r, rows = random.Random(12), []
    for base in range(12):
        words = prose(r, r.choice([8, 60, 300])).split()
        for copy in range(r.choice([1, 3, 25])):
            own = list(words)
            for _ in range(0 if copy == 0 else r.randrange(0, max(1, len(words) // 55))):
                own[r.randrange(len(own))] = prose(r, 1)
            rows.append((base * 100 + copy, " ".join(own)))
        far = [w if r.random() < 0.85 else prose(r, 1) for w in words]  # about 0.3 in common
        rows.append((5000 + base, " ".join(far)))
    left = rows_of(simhash.keep_one(spark.createDataFrame(rows, DOCS)))
    assert left == sorted(plain_near(rows), key=str) and len(left) < len(rows) / 2


def test_a_leak_takes_no_other_row_of_its_id(spark):
    r = random.Random(2)
    leak, a, b = f"{prose(r, 40)} {ITEM} {prose(r, 40)}", prose(r, 60), prose(r, 60)
    rows = [(None, leak), (None, a), (5, leak), (5, b), (None, None), (6, "")]
    left = decontaminate.without_benchmark(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert rows_of(left) == sorted([(None, a), (5, b), (None, None), (6, "")], key=str)


@pytest.fixture(scope="module")
def toxic_corpus(spark, tmp_path_factory):
    """400 labelled documents, each fourth with a toxic word, and the folder of their labels."""
    r, rows = random.Random(4), []
    for k in range(400):
        words = prose(r, r.randrange(5, 120)).split()
        if k % 4 == 0:
            words.insert(r.randrange(len(words)), r.choice(["vilebad", "grimfoe"]))
        rows.append((k, " ".join(words)))
    at = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return rows, at


def clean(spark, rows, at):
    """The rows whose own text the network, trained alike, scores under the threshold."""
    net = toxicity.trained(spark.createDataFrame(rows, DOCS), spark.read.parquet(f"{at}/labels.parquet"))
    scores = net.scores([toxicity.words_of(t) for _, t in rows])
    return [x for x, s in zip(rows, scores, strict=True) if not len(s) or s.max() < toxicity.THRESHOLD]


def test_a_toxic_row_takes_no_other_row_of_its_id(spark, toxic_corpus):
    given, at = toxic_corpus
    r = random.Random(5)
    rows = [*given, (None, prose(r, 30) + " vilebad"), (None, prose(r, 30)), (900, prose(r, 30) + " grimfoe"), (900, prose(r, 30)), (None, None)]
    left = rows_of(corpus_pipeline.reject_toxic(spark, spark.createDataFrame(rows, DOCS), at))
    assert left == sorted(clean(spark, rows, at), key=str)
    assert {rows[-4], rows[-2], rows[-1]} <= set(left) and not {rows[-5], rows[-3]} & set(left)


def one_edit(a, b):
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def plain_lines(rows):
    """Each line goes that an earlier line (doc_id, null last, then number) equals or, from 10 code points on, is one edit from."""
    each = [(i if i is not None else 1 << 63, p, " ".join(line.split())) for i, t in rows for p, line in enumerate((t or "").split("\n"))]
    earlier = lambda x: any(y[:2] < x[:2] and (y[2] == x[2] or min(len(x[2]), len(y[2])) >= 10 and one_edit(x[2], y[2])) for y in each)
    gone, out = {x for x in each if x[2] and earlier(x)}, []
    for i, t in rows:
        kept = [line for p, line in enumerate((t or "").split("\n")) if (i if i is not None else 1 << 63, p, " ".join(line.split())) not in gone]
        out.append((i, None if t is None else "\n".join(kept)))
    return out


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return bool(a and b) and len(a & b) >= 0.8 * len(a | b)


def plain_near(rows):
    prints, of = [simhash.fingerprint(t) for _, t in rows], list(range(len(rows)))
    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if of[i] != of[j] and ((prints[i] ^ prints[j]).bit_count() <= 2 or alike(sets[i], sets[j])):
                of = [of[j] if x == of[i] else x for x in of]
    least = {c: min((i for (i, _), x in zip(rows, of, strict=True) if x == c and i is not None), default=None) for c in set(of)}
    return [x for x, c in zip(rows, of, strict=True) if x[0] == least[c]]


def plain_leaks(rows):
    said = lambda t: f" {' '.join(decontaminate.words_of(t))} "
    return [x for x in rows if said(ITEM) not in said(x[1])]


def test_each_stage_keeps_what_a_plain_version_keeps(spark, toxic_corpus):
    import base64

    import public_tokenizers as P
    import tiktoken

    given, at = toxic_corpus
    r = random.Random(9)
    a, b, line = prose(r, 60), prose(r, 60), prose(r, 12)
    odd = [(None, a.upper()), (None, b), (700, a), (701, a.upper()), (701, prose(r, 50)), (None, None), (702, ""), (None, prose(r, 20) + " vilebad"), (703, prose(r, 20) + " grimfoe"), (703, prose(r, 20))]
    odd += [(704, f"{line}\n{prose(r, 30)}"), (705, f"{prose(r, 30)}\n\n{line}x\n {line} "), (None, f"{line}\n{prose(r, 30)}"), (706, f"{prose(r, 30)} {ITEM} {prose(r, 9)}"), (706, prose(r, 40)), (None, f"{prose(r, 30)} {ITEM}")]
    rows = [*given, *odd]
    stages = [plain_lines, plain_near, plain_leaks]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], DOCS + ", n_chars long")
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:4], [lambda x: clean(spark, x, at), *stages], strict=True):
        docs, want = stored(stage(spark, docs, at), name), plain(rows)
        assert rows_of(docs) == sorted(want, key=str), name
        assert len(want) < len(rows) or want != rows, name
        rows = want
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = [(x.doc_id, list(x.ids)) for x in corpus_pipeline.encode(spark, docs, at).collect()]
    assert sorted(got, key=str) == sorted(((i, library.encode_ordinary(t or "")) for i, t in rows), key=str)
