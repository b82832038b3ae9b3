"""Sources, sinks and the stream on files of their own."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.sinks import files as sinks
from corvane.sources import files as sources
from corvane.streaming import ingest


def test_walk(spark, tmp_path):
    for name, content in {"a.md": b"---\nname: x\n---\nbody", "sub/b.txt": b"caf\xe9", "sub/c.md": b"x\x00y", "node_modules/d.md": b"d", ".env_x.md": b"e", "big.md": b"x" * 3_000_000, "e.py": b"print(1)", "skip/f.md": b"f"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    docs, files = sources.walk(spark, str(tmp_path), ignore="# c\nskip/\n")
    assert {x.relative: x.verdict for x in files.collect()} == {"a.md": "ok", "sub/b.txt": "ok", "sub/c.md": "binary", "node_modules/d.md": "glob", "big.md": "size", "e.py": "ok", "skip/f.md": "glob"}
    got = {x.relative: x for x in docs.collect()}
    assert sorted(got) == ["a.md", "e.py", "sub/b.txt"]
    assert got["a.md"].content.startswith("---\nname: x\n---\n\n[Document: a.md | Section: docs | Date: 2") and got["a.md"].content.endswith("]\n\nbody")
    assert got["sub/b.txt"].content.endswith("caf�") and "Section: code" in got["e.py"].content
    seen = sources.stats(files).first()
    assert (seen.seen, seen.accepted, seen.skipped_glob, seen.skipped_binary, seen.python) == (7, 3, 2, 1, 1)


def test_walk_never_opens_what_it_leaves(spark, tmp_path):
    """A file over 2 GiB, excluded or not, and names with signs that globs use."""
    (tmp_path / "a [1] {x}.md").write_text("brackets")
    for name in ("big.ckpt", "big.md"):
        with open(tmp_path / name, "wb") as f:
            f.truncate(2_200_000_000)
    (tmp_path / "target").mkdir()
    (tmp_path / "target" / "locked.md").write_text("x")
    (tmp_path / "target" / "locked.md").chmod(0)
    docs, files = sources.walk(spark, str(tmp_path))
    assert {x.relative: x.verdict for x in files.collect()} == {"a [1] {x}.md": "ok", "big.ckpt": "glob", "big.md": "size", "target/locked.md": "glob"}
    assert [x.relative for x in docs.collect()] == ["a [1] {x}.md"]
    (tmp_path / "none").mkdir()
    docs, files = sources.walk(spark, str(tmp_path / "none"))
    assert docs.count() == 0 and files.count() == 0


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("**/*.md", ["a.md", "x/y/a.md"], ["a.md.txt", "a.md/b.py"]),
        ("*.md", ["a.md", "x/a.md"], ["a.mdx"]),
        ("docs/*.md", ["docs/a.md"], ["x/docs/a.md", "docs/x/a.md"]),
        ("docs/**/a?.py", ["docs/a1.py", "docs/x/y/ab.py"], ["docs/a.py", "docs/x/abc.py"]),
        ("**/node_modules/**", ["node_modules/x", "a/node_modules/b/c"], ["node_modules", "my_node_modules/x"]),
        ("notes/", ["notes/a", "x/notes/b/c"], ["notes", "notes2/a"]),
        ("build", ["build", "build/x", "a/build/y"], ["builds/x", "rebuild"]),
        ("/top.md", ["top.md"], ["x/top.md"]),
        ("f[0-9].t+t", ["f1.t+t"], ["fx.t+t", "f1.ttt"]),
        ("f[!0-9]", ["fx"], ["f1"]),
        ("", [], ["", "a"]),
        ("**", ["a", "a/b"], []),
    ],
)
def test_globs(spark, glob, yes, no):
    rows = spark.createDataFrame([(p,) for p in [*yes, *no]], "path string")
    assert [r.path for r in rows.filter(sources.matches(F.col("path"), [glob])).collect()] == yes


def test_folders_that_are_excluded_take_what_is_below(spark):
    rows = spark.createDataFrame([("secrets_x/a.md",), ("a/secretsy.md",), ("a/b.md",)], "path string")
    assert [r.v for r in rows.select(sources.verdict(F.col("path"), F.lit(1)).alias("v")).collect()] == ["glob", "glob", "ok"]


def test_chunk_store_and_graph(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"k1": {"content": "a", "file_path": "f", "chunk_index": 0, "source_doc_id": "d"}, "k2": {"content": "b", "file_path": "f", "chunk_index": 1, "source_doc_id": "d", "more": 1}}))
    assert {(x.chunk_id, x.content, x.chunk_index) for x in sources.chunk_store(spark, str(tmp_path / "c.json")).collect()} == {("k1", "a", 0), ("k2", "b", 1)}
    (tmp_path / "g.xml").write_text('<graphml><key id="d0" for="node" attr.name="entity_type"/><graph><node id="a"><data key="d0">thing</data></node><node id="b"/><edge source="a" target="b"><data key="d9">w</data></edge></graph></graphml>')
    nodes, edges = sources.graph_xml(spark, str(tmp_path / "g.xml"))
    assert {x.id: x.attributes for x in nodes.collect()} == {"a": {"entity_type": "thing"}, "b": {}}
    assert [(x.a, x.b, x.attributes) for x in edges.collect()] == [("a", "b", {"d9": "w"})]


def test_store_is_swapped_in_whole(spark, tmp_path):
    at = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_index int, content string")
    sinks.write_store(rows, at)
    sinks.write_store(rows.limit(1), at)
    assert sinks.read_store(spark, at).count() == 1 and [p.name for p in tmp_path.iterdir()] == ["store"]
    (tmp_path / "store" / "manifest.json").write_text((tmp_path / "store" / "manifest.json").read_text().replace('"rows": 1', '"rows": 2'))
    (tmp_path / "store" / ".manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        sinks.read_store(spark, at)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x").write_text("x")
    with pytest.raises(FileExistsError):
        sinks.write_store(rows, str(tmp_path / "other"))


def test_ranking_rows_round_trip(spark, tmp_path):
    at = str(tmp_path / "ltr")
    sinks.write_ranking_rows(spark.createDataFrame([("q", "i", 1, 2, [0.5, 1.0])], "query_id string, item_id string, rank int, label int, features array<double>"), at, ["x", "y"])
    assert sources.ranking_rows(spark, at, ["x", "y"]).first().features == [0.5, 1.0]
    with pytest.raises(ValueError):
        sources.ranking_rows(spark, at, ["y", "x"])


def test_sidecars(spark, tmp_path):
    at = str(tmp_path / "side")
    sinks.write_sidecars(spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc_id long, ord int, title string"), at)
    assert {x.doc_id: [s["title"] for s in json.loads(x.manifest)] for x in spark.read.json(at).collect()} == {1: ["a", "b"], 2: ["c"]}


def test_stream_keeps_its_state(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    shape = "doc_id long, text string, more int"
    put = lambda rows: spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)
    put([(1, "a", 0), (2, "b", 0), (None, "x", 0)])
    ingest.ingest(spark, source, root, shape)
    put([(1, "a", 1), (2, "c", 0), (3, None, 0)])
    ingest.ingest(spark, source, root, shape)
    events = spark.read.parquet(f"{root}/events").groupBy("batch").agg(F.sort_array(F.collect_list(F.concat_ws(":", "doc_id", "event"))).alias("e"))
    assert {x.batch: x.e for x in events.collect()} == {0: ["1:new", "2:new"], 1: ["1:unchanged", "2:changed", "3:new"]}
    assert ingest.state(spark, root).count() == 3
    ingest.ingest(spark, source, root, shape)
    assert spark.read.parquet(f"{root}/events").count() == 5


def test_the_stream_rewrites_touched_buckets_alone(spark, tmp_path):
    source, root, shape = str(tmp_path / "in"), str(tmp_path / "out"), "doc_id long, text string"
    want = {k: f"t{k}" for k in range(300)}
    spark.createDataFrame(list(want.items()), shape).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest(spark, source, root, shape)
    before = spark.read.parquet(f"{root}/state/batch=0").count()
    for k in range(4):
        want[7] = f"again {k}"
        spark.createDataFrame([(7, want[7])], shape).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(spark, source, root, shape)
    parts = sorted(p.parent.name for p in (tmp_path / "out" / "state").glob("batch=*/bucket=*"))
    assert before == 300 and parts.count("batch=0") == ingest.BUCKETS - 1 and [p for p in parts if p != "batch=0"] == ["batch=3", "batch=4"]
    from corvane.functions.text import fingerprint

    same = spark.createDataFrame(list(want.items()), shape).select("doc_id", fingerprint(F.col("text")).alias("fp"))
    assert sorted(map(tuple, ingest.state(spark, root).collect())) == sorted(map(tuple, same.collect()))


def test_artifacts_are_checked_as_they_are_read(spark, tmp_path):
    at = str(tmp_path / "artifacts")
    put = sinks.put_artifacts(spark.createDataFrame([("a", b"one"), ("b", b"two"), ("c", b"one"), ("d", b""), ("e", None)], "key string, content binary"), at)
    digests = {r.key: r.digest for r in put.collect()}
    assert set(digests) == {"a", "b", "c", "d"} and digests["a"] == digests["c"]
    asked = spark.createDataFrame([(digests["a"],), (digests["d"],), ("0" * 64,)], "digest string")
    assert {r.digest: bytes(r.content) for r in sinks.get_artifacts(spark, at, asked).collect()} == {digests["a"]: b"one", digests["d"]: b""}
    spark.createDataFrame([("ab" * 32, b"other")], "digest string, content binary").withColumn("part", F.lit("ab")).write.mode("append").partitionBy("part").parquet(f"{at}/contents")
    with pytest.raises(Exception, match="damaged"):
        sinks.get_artifacts(spark, at, spark.createDataFrame([("ab" * 32,)], "digest string")).collect()


def test_a_store_goes_out_and_comes_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, None)], "chunk_index int, content string")
    at, out, back = (str(tmp_path / x) for x in ("store", "out", "back"))
    sinks.write_store(rows, at, {"size": 1200})
    sinks.write_store(rows.limit(1), back)
    assert sinks.export_store(spark, at, out)["settings"] == {"size": 1200}
    assert sinks.import_store(spark, out, back)["rows"] == 3
    assert sorted(map(str, sinks.read_store(spark, back).collect())) == sorted(map(str, rows.collect()))
    (tmp_path / "out" / "manifest.json").write_text((tmp_path / "out" / "manifest.json").read_text().replace('"rows": 3', '"rows": 2'))
    (tmp_path / "out" / ".manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        sinks.import_store(spark, out, back)
    assert sinks.read_store(spark, back).count() == 3
