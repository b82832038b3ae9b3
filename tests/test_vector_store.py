"""Vectors in stores: half precision, stale digests, copies that resume, matrix files in slices."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import vector_store as V

SHAPE = "vec_id string, embedding array<float>"


def rows(n, dim=6):
    r = np.random.default_rng(3)
    return [(f"v{k}", r.normal(size=dim).astype(np.float32).tolist()) for k in range(n)]


def test_halves_come_back_within_their_precision(spark, tmp_path):
    given = [*rows(50), ("none", None), (None, [1.0] * 6), ("zero", [0.0] * 6)]
    own = spark.createDataFrame(given, SHAPE)
    at = str(tmp_path / "second")
    assert V.open_second(spark, at, own) is None
    V.write_second(own, at)
    got = {x.vec_id: x.embedding for x in V.open_second(spark, at, own.repartition(5)).collect()}
    assert set(got) == {i for i, _ in given} and got["none"] is None
    for i, v in given:
        if v:
            assert np.allclose(got[i], v, rtol=2**-10, atol=2**-24)
    half = spark.read.parquet(f"{at}/vectors")
    ids = [x.vec_id for x in half.coalesce(1).collect() if x.vec_id]
    assert ids == sorted(ids, key=lambda i: (len(i), i))
    big = spark.createDataFrame([(2**60 + 1, [1.5]), (None, [2.5])], "vec_id long, embedding array<float>").coalesce(1)
    assert {x.vec_id for x in V.wholes(V.halves(big)).collect()} == {2**60 + 1, None}


def test_a_changed_source_makes_the_second_index_stale(spark, tmp_path):
    own = spark.createDataFrame(rows(20), SHAPE)
    at = str(tmp_path / "second")
    V.write_second(own, at)
    changed = own.withColumn("embedding", F.when(F.col("vec_id") == "v3", F.array_repeat(F.lit(0.5).cast("float"), 6)).otherwise(F.col("embedding")))
    assert V.open_second(spark, at, changed) is None and V.open_second(spark, at, own.limit(19)) is None
    assert V.open_second(spark, at, own).count() == 20


def test_a_copy_resumes_and_a_changed_vector_is_caught(spark, tmp_path, monkeypatch):
    own = spark.createDataFrame(rows(200), SHAPE)
    at, seen = str(tmp_path / "copy"), []
    check = V.there

    def cut(spark, path):
        if len(seen) == 3:
            raise RuntimeError("lost")
        seen.append(path)
        return check(spark, path)

    monkeypatch.setattr(V, "there", cut)
    with pytest.raises(RuntimeError):
        V.transplant(own, at, 8)
    monkeypatch.setattr(V, "there", check)
    times = {p: p.stat().st_mtime_ns for p in (tmp_path / "copy").glob("range=*/part-*")}
    V.transplant(own, at, 8)
    assert len(seen) == 3 and all(p.stat().st_mtime_ns == t for p, t in times.items()) and times
    copy = V.transplanted(spark, at, own)
    assert tuple(V.compared(own, copy, 1).first()) == (True, 200, 0, 0)
    back = str(tmp_path / "back")
    V.transplant(copy, back, 3)
    assert sorted(map(str, V.transplanted(spark, back, own).collect())) == sorted(map(str, own.collect()))
    turned = copy.withColumn("embedding", F.when(F.col("vec_id") == "v7", F.reverse("embedding")).otherwise(F.col("embedding")))
    assert V.compared(own, turned, 1).first().changed == 1 and V.compared(own, copy.filter("vec_id <> 'v9'"), 1).first()[:3] == (False, 200, 1)


@pytest.mark.parametrize(("n", "dim"), [(0, 3), (1, 1), (57, 5), (400, 7)])
def test_a_matrix_file_is_read_in_slices(spark, tmp_path, monkeypatch, n, dim):
    monkeypatch.setattr(V, "BLOCK", 700)
    monkeypatch.setattr(V, "SLICE", 200)
    monkeypatch.setattr(V, "LONGEST_ID", 100)
    r = np.random.default_rng(n)
    matrix = r.normal(size=(n, dim)).astype("<f4")
    data = [{"__id__": f'id "{k}" é\\', "__created_at__": k, "content": "x" * (k % 90), "note": '"matrix" is a word'[:k % 3]} for k in range(n)]
    at = tmp_path / "v.json"
    at.write_text(json.dumps({"embedding_dim": dim, "data": data, "matrix": base64.b64encode(matrix.tobytes()).decode()}))
    got = V.vector_file(spark, str(at)).orderBy("row").collect()
    assert [x.vec_id for x in got] == [d["__id__"] for d in data]
    assert np.array_equal(np.array([x.embedding for x in got], np.float32).reshape(n, dim), matrix)
    if n > 1:
        at.write_text(at.read_text().replace('"__id__"', '"id"', 1))
        with pytest.raises(ValueError):
            V.vector_file(spark, str(at))
