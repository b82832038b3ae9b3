"""The paged source: pages in parallel, the tenant pushed down, nothing lost."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.sources import pages


@pytest.fixture
def store(spark, tmp_path):
    rows = [{"tenant": f"t{k % 3}", "id": f"i{k}", "content": None if k % 10 == 0 else f"text {k}"} for k in range(100)]
    (tmp_path / "rows.json").write_text(json.dumps(rows))
    pages.register(spark)
    read = lambda client="FileClient", **more: spark.read.format("paged_store").options(client=f"tests.paged_client:{client}", address=str(tmp_path), page=7, pages=2, **more).load()
    asked = lambda: [json.loads(p.read_text()) for p in tmp_path.glob("asked-*")]
    return read, asked, rows


def test_all_pages_are_read_in_parallel(spark, store):
    read, asked, rows = store
    got = read()
    assert got.rdd.getNumPartitions() == 8  # 100 rows, 14 a partition
    assert sorted(map(str, got.collect())) == sorted(str(spark.createDataFrame([r], "tenant string, id string, content string").first()) for r in rows)
    assert {x[0] for x in asked()} == {None} and sorted({x[1] for x in asked()}) == list(range(0, 100, 7))


def test_the_tenant_is_pushed_to_the_store(store):
    read, asked, rows = store
    got = read().filter((F.col("tenant") == "t1") & F.col("content").isNotNull())
    assert {r.id for r in got.collect()} == {r["id"] for r in rows if r["tenant"] == "t1" and r["content"]}
    assert {x[0] for x in asked()} == {"t1"} and sum(x[2] for x in asked()) == 33
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "= t1" not in plan  # Spark filters by the content alone, the tenant is the store's
    assert read().filter("tenant = 'none'").count() == 0


def test_a_short_page_is_an_error(store):
    read, _, _ = store
    with pytest.raises(Exception, match="of 7 rows"):
        read("ShortClient").collect()
