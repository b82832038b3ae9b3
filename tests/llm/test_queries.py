"""The registered queries against SQL, the tokenizers' own libraries and brute force."""

import base64
import hashlib
import re

import duckdb
import public_tokenizers as P
import pytest
import xxhash

import corpus_pipeline
from corvane.llm import bpe, dedup, lines, simhash, tokens
from corvane.llm.queries import oracle_sql, queries

ODD = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "a" * 20_000 + "\n" + "é 𝒳 ▁x  y" * 300), (9004, "twice"), (None, "no id\nno id"), (9005, "<|endoftext|> <s> it's 12345\r\n\r\n  x"), (9006, "0123456789\n0123456789\n012345678X\n0123456789A")]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """Whole documents, odd rows, and columns whose names clash with results."""
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    return own.unionByName(odd).selectExpr("*", "'x' as fp", "1 as n_tokens", "2 as group_size", "3 as key", "4 as pos").cache()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_rows_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(oracle_sql()[name])
    order = [c[0] for c in want.description]
    got = queries()[name](spark, sf_dir)
    assert sorted(order) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*order).collect()))) == sorted(map(str, want.fetchall()))


def test_bpe_equals_the_library(docs):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in docs.collect():
        want.append((str(r.doc_id), library.encode_ordinary(r.text or ""), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [(str(r.doc_id), list(r.ids), r.decoded_sha256) for r in bpe.encoded(docs, path, P.PATTERN, reach=3).collect()]
    assert sorted(got) == sorted(want)


def test_token_counts_equal_the_library(docs):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted((str(r.doc_id), len(library.encode(r.text or ""))) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in tokens.token_counts(docs, path).collect()) == want


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_equals_all_pairs(docs):
    rows = docs.collect()
    prints = [fingerprint(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    want = sorted((str(r.doc_id), p, min(rows[k].doc_id for k in range(len(rows)) if find(k) == find(i) and rows[k].doc_id is not None) if r.doc_id is not None else None) for i, (r, p) in enumerate(zip(rows, prints, strict=True)))
    got = sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert [x for x in got if x[0] != "None"] == [x for x in want if x[0] != "None"]


def test_exact_duplicates_do_not_depend_on_the_split(docs):
    a, b = (sorted(map(str, dedup.exact_duplicates(docs, k).select("doc_id", "keep_id", "group_size", "kept").collect())) for k in (1, 1000))
    assert a == b and len(a) == docs.count()


def test_lines_within_one_edit_go(docs):
    got = {r.doc_id: r for r in lines.without_repeated_lines(docs).filter("doc_id > 9000 or doc_id is null").collect()}
    assert got[9006].text == "0123456789" and got[9006].n_dropped == 3
    assert got[9001].text is None and got[9002].text == "" and got[None].text == "no id"


def test_empty_tables(docs):
    none = docs.limit(0)
    for found in (dedup.exact_duplicates(none), simhash.near_duplicates(none), lines.without_repeated_lines(none), tokens.token_counts(none, P.path("piece_bpe_32k.model"))):
        assert found.count() == 0


def test_pipeline_keeps_columns_and_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        left = stage(spark, docs, sf_dir)
        assert left.columns == docs.columns, name
    end = corpus_pipeline.run(spark, sf_dir)
    assert 0 < end.count() < docs.count()


def library():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_joins_small_leaves_and_long_texts():
    import random

    path, known = library()
    r, bits = random.Random(1), ["a", "b", "'re", "'ll", " ", "  ", "\n", "12", "é", "𝒳", "!", "?!", "word", " the", "\r\n", "\t", "'s", "'"]
    small = bpe.ByteBPE(path, P.PATTERN, 3, 1, 8)
    for _ in range(1500):
        text = "".join(r.choice(bits) for _ in range(r.randrange(1, 80)))
        assert small.encode(text) == known.encode_ordinary(text), text
    usual = bpe.ByteBPE(path, P.PATTERN, 3)
    for text in ("a" * 70_000, "ab" * 50_000, " " * 70_000, "word's " * 20_000, "\n \n" * 30_000):
        assert usual.encode(text) == known.encode_ordinary(text) == bpe.ByteBPE(path, P.PATTERN).encode(text)
        assert usual.decode(usual.encode(text)) == text.encode()


def test_bpe_tables_stay_for_the_next_task(spark, monkeypatch):
    """The second task of a worker merges nothing that the first one has merged."""
    import pyarrow as pa

    class Held:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    merged, real = [], bpe.ByteBPE.merged
    monkeypatch.setattr(bpe.ByteBPE, "merged", lambda self, data: merged.append(data) or real(self, data))
    bpe.loaded.cache_clear()
    run = bpe.encoded(Held(), library()[0], P.PATTERN, reach=3)
    batch = pa.record_batch([pa.array([1]), pa.array(["zorblatt quixmere vundalo"])], ["doc_id", "text"])
    first = [x.to_pylist() for x in run(iter([batch]))]
    n = len(merged)
    assert [x.to_pylist() for x in run(iter([batch]))] == first and len(merged) == n > 0


def test_bpe_digests_and_empty_table(spark, docs):
    import struct

    path, known = library()
    some = docs.filter("doc_id > 9000 or doc_id < 20")
    for r in bpe.encoded(some, path, P.PATTERN, reach=3).join(some.select("doc_id", "text"), "doc_id").collect():
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(r.ids)}I", *r.ids)).hexdigest() and r.n_tokens == len(r.ids)
    assert bpe.encoded(docs.limit(0), path, P.PATTERN).count() == 0


def test_token_counts_have_bytes_and_limits(docs):
    got = tokens.token_counts(docs, P.path("piece_bpe_32k.model"), limit=300).collect()
    size = {str(r.doc_id): len((r.text or "").encode()) for r in docs.filter("doc_id <> 9004 or doc_id is null").collect()}
    assert all(r.over_limit == (r.n_tokens > 300) for r in got) and any(r.over_limit for r in got)
    assert all(r.n_bytes == size[str(r.doc_id)] for r in got if str(r.doc_id) in size)


def test_short_lines_within_one_edit_where_asked(spark):
    rows = [(1, "ab\nac\nabc\nx"), (2, "y\nzz\nab"), (3, "q\n\n q "), (4, None)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.without_repeated_lines(own).collect()} == {1: "ab\nac\nabc\nx", 2: "y\nzz", 3: "q\n", 4: None}
    got = {r.doc_id: r.text for r in lines.without_repeated_lines(own, 1).collect()}
    places = [(d, k, line.strip()) for d, t in rows if t for k, line in enumerate(t.split("\n"))]

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        return a == b or any(a[:i] + a[i + 1 :] in (b, b[:i] + b[i + 1 :]) for i in range(len(a))) or any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    for d, t in rows:
        if t is not None:
            kept = [line for k, line in enumerate(t.split("\n")) if not line.strip() or not any((e, j) < (d, k) and x and near(x, line.strip()) for e, j, x in places)]
            assert got[d] == "\n".join(kept)


def test_rows_without_an_id_keep_their_component(spark):
    rows = [(3, "one two three four five"), (None, "One two three four five"), (None, "other words in a text here"), (None, None), (7, "")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted([("3", "3"), ("None", "3"), ("None", "None"), ("None", "7"), ("7", "7")])
