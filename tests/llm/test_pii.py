import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            number = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(number) <= 19 and luhn(number),
                "phone": 10 <= len(number) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def texts():
    r = random.Random(5)
    bits = ["a@b.c", "x.y%+z@d-e.f.g", "@", ".", "+1 (017) 555-7713", "+", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "256.1.1.1", "0255.0.0.0", "9", " ", "-", "é", "\n", "a", "b", "12", "(", "5500000000000004", "..", "𝒳"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(1, 25))) for _ in range(600)]


def test_base_spans_equal_the_plain_patterns(spark, sf_dir):
    given = texts() + ["", None, "1" * 30_000, "a" * 30_000, "a." * 5_000, "1." * 5_000, "+" * 3_000, "x@y.z " * 200] + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert len(got) == len(given)
    for k, text in enumerate(given):
        want = brute(text or "")
        digest = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        assert got[k].base_sha256 == hashlib.sha256(digest.encode()).hexdigest(), text and text[:200]
        assert [got[k][f"n_{x}"] for x in BASE] == [sum(w[3] == x for w in want) for x in BASE]


def test_iban_and_context(spark):
    rows = [(1, "bank GB82 WEST 1234 5698 7654 32 ok"), (2, "bank GB83 WEST 1234 5698 7654 32 ok"), (None, "call +1 (017) 555-7713"), (3, "xx +1 (017) 555-7713")]
    found = {r.doc_id: r.found for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [s.kind for s in found[1]] == ["iban"] and found[1][0].score == pytest.approx(0.9)
    assert found[2] == []
    assert found[None][0].score > found[3][0].score


def test_empty_table(spark):
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_secrets_stand_by_their_context(spark):
    run = "bed4d44cf2780ed3ef0cb916120773181bc8de67"
    rows = [(1, f'token = "{run}"'), (2, f'commit hash {run} of'), (3, f"x {run} y"), (4, "token " + "a" * 40), (5, "token " + run * 5)]
    found = {r.doc_id: [s.kind for s in r.found] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: ["secret"], 2: [], 3: [], 4: [], 5: []}


def test_a_hundred_thousand_matches_in_one_text(spark):
    import time

    text = "write a.b@c.de to " + "me@you.org 1.2.3.4 " * 50_000
    start = time.perf_counter()
    got = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert time.perf_counter() - start < 60
    want = brute(text)
    assert (got.n_email, got.n_ip) == (50_001, 50_000)
    assert got.base_sha256 == hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want).encode()).hexdigest()
