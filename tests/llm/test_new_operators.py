"""Token files, word runs and tokenizer alignment against the libraries and plain loops."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corvane.llm import align, queries, runs, token_files

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    (2**60 + 1, None),
    (2**60 + 3, ""),
    (9003, " \n\t "),
    (9004, "a" * 5_000 + "\n" + "é 𝒳 ▁x  y" * 300),
    (9004, "twice twice"),
    (9004, "twice twice"),
    (None, "no id\n\n \n  no id  "),
    (9005, "<|endoftext|> <s> it's 12345\r\n\r\n  x<|endoftext|>"),
    (9006, "one two three " * 40),
    (9007, "<0x41>\0 日本語のテキスト  で　す　 x \u0085 y é"),
    (9008, " lead and trail "),
    (9009, "word " * 3000),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """Whole documents, odd rows, and columns whose names clash with results."""
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    return own.unionByName(odd).selectExpr("*", "'x' as part", "1 as row", "2 as links", "3 as n_tokens", "4 as base", "5 as start").cache()


def key(r):
    return str(tuple(r))


def test_token_files_hold_every_document_in_order(spark, docs):
    library = Tokenizer.from_file(A)
    rows = docs.collect()
    want = {}
    for r in rows:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    for length, per in ((2048, 256), (7, 3)):
        manifest = token_files.write_token_files(docs, A, 2, length, per)
        got = token_files.read_token_files(manifest).collect()
        found = {}
        for r in got:
            found.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
        assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
        got.sort(key=lambda r: r.start)
        assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in rows)
        assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
        for f in manifest.collect():
            own = token_files.TokenFile(f.ids_file)
            assert len(own) == -(-f.n_ids // length)
            before = pa.total_allocated_bytes()
            tokens, mask = own.sequence(len(own) // 2)
            assert tokens.dtype == np.uint16 and not tokens.flags.owndata and pa.total_allocated_bytes() == before
            assert sum(int(own.sequence(i)[1].true_count) for i in range(len(own))) == f.n_ids
            assert own.sequence(0)[1].true_count == min(length, f.n_ids)
            with pytest.raises(IndexError):
                own.sequence(len(own))


def test_pieces_encode_as_the_whole():
    library, r = Tokenizer.from_file(A), random.Random(3)
    own, plain = token_files.PieceCoder(A), token_files.PieceCoder(A, plain=True)
    bits = ["a", "word", " ", "  ", "\n", "\t", "'s", "'", "!?", "12", "é", "日本", " ", "　", "\u0085", "\x1c", "\r\n", "\0", "<|endoftext|>", " the"]
    for _ in range(400):
        texts = ["".join(r.choice(bits) for _ in range(r.randrange(0, 40))) for _ in range(20)]
        library.encode_special_tokens = False
        assert [np.frombuffer(x, own.dtype).tolist() for x in own.packed(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
        library.encode_special_tokens = True
        assert [np.frombuffer(x, own.dtype).tolist() for x in plain.packed(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_token_files_of_one_id_and_of_nothing(spark):
    same = spark.range(400).selectExpr("cast(7 as bigint) as doc_id", "concat('text ', id) as text").repartition(4)
    manifest = token_files.write_token_files(same, A, 2, files=4)
    assert manifest.count() == 4 and max(r.n_docs for r in manifest.collect()) < 200 and token_files.read_token_files(manifest).count() == 400
    none = token_files.write_token_files(same.limit(0), A, 2)
    assert none.count() == 0 and token_files.read_token_files(none).count() == 0


def plain_runs(w):
    """Every period tried at every place."""
    n, least = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= 12:
                least.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in least.items())


def test_runs_equal_a_plain_search():
    r = random.Random(5)
    for trial in range(1500):
        letters = r.choice([1, 2, 2, 3, 5, 30])
        w = [r.randrange(letters) for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(0, 4)):
            unit = [r.randrange(letters + 3) for _ in range(r.randrange(1, 20))]
            at = r.randrange(0, len(w) + 1)
            w[at:at] = (unit * 5)[: r.randrange(len(unit), 5 * len(unit) + 1)]
        assert runs.find_runs(np.array(w, np.int64)) == plain_runs(w), (trial, w)
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(20, np.int64), 11)


def test_runs_of_long_texts_stay_cheap():
    for unit, times in ((1, 120_000), (3, 40_000), (5_000, 20)):
        w = np.tile(np.arange(unit), times)
        assert runs.find_runs(w) == [(0, len(w), unit)]
    assert runs.find_runs(np.arange(200_000)) == []


def test_runs_query_equals_the_contract(spark, docs):
    got = sorted(map(key, runs.word_runs(docs, rewrite=True).collect()))
    want, wrote = [], 0
    for r in docs.collect():
        words = (r.text or "").encode().split()
        n, h = len(words), zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and n:
            wrote += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        number = {}
        found = plain_runs([number.setdefault(x, len(number)) for x in words]) if n <= 1500 else runs.find_runs(runs.numbered(words))
        gone = {i for s, k, q in found for i in range(s + q, s + k)}
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        digests = ("".join(f"{s},{k},{q}\n" for s, k, q in found).encode(), b" ".join(x for i, x in enumerate(words) if i not in gone))
        want.append(key((r.doc_id, len(found), *shown, *(hashlib.sha256(x).hexdigest() for x in digests))))
    assert got == sorted(want) and wrote > 10
    full = runs.word_runs(docs.filter("doc_id = 9006"), texts=True).first()
    assert full.collapsed == "one two three" and [tuple(x) for x in full.runs] == [(0, 120, 3)]
    assert runs.word_runs(docs.limit(0)).count() == 0


def plain_tokens(text, library, model):
    """Both tokenizers' (ids, ends), or nothing, straight from the contract."""
    back = {v: k for k, v in byte_letters().items()}
    a = library.encode(" " + text, add_special_tokens=False).ids
    a_bytes = [bytes(back[c] for c in library.id_to_token(i)) for i in a]
    b = model.encode(text)
    pieces = [model.id_to_piece(i) for i in b]
    b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
    want = (" " + text).encode()
    if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
        return None
    return a, np.cumsum([len(x) for x in a_bytes]).tolist(), b, np.cumsum([len(x) for x in b_bytes]).tolist()


def byte_letters():
    own = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    return own | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in own)}


@pytest.mark.parametrize("most", [align.PAIRS, 0])
def test_alignment_equals_a_plain_loop(docs, most):
    library, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    out, counts = [], Counter()
    for r in docs.collect():
        found = plain_tokens(r.text or "", library, model)
        if found is None:
            out.append((r.doc_id, 0, 0, 0, [], ""))
            continue
        a, ae, b, be = found
        groups, links, i, j = [], [], 0, 0
        own = ([], [])
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            step = (ae[i] > be[j]) - (ae[i] < be[j])
            if step <= 0:
                own[0].append(a[i])
            if step >= 0:
                own[1].append(b[j])
            if step == 0:
                groups.append(own)
                own = ([], [])
            i, j = i + (step <= 0), j + (step >= 0)
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        counts.update(links)
        out.append((r.doc_id, len(a), len(b), len(groups), links, hashlib.sha256(said.encode()).hexdigest()))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(n, top.get(y, 0))
    want = sorted(key((d, na, nb, ng, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha)) for d, na, nb, ng, links, sha in out)
    got = align.alignment_report(docs, A, B, most).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(key, got)) == want
    assert sum(x[1] == 0 for x in out) >= 3


def test_alignment_of_wide_groups_and_of_nothing(spark, docs):
    """Ends that seldom meet: one group of many tokens."""
    import pyspark.sql.functions as F

    a, b = list(range(2, 3001, 2)) + [3001], list(range(1, 3001, 2)) + [3001]
    own = spark.createDataFrame([([1] * len(a), a, [2] * len(b), b)], "a array<int>, a_ends array<long>, b array<int>, b_ends array<long>")
    g = own.select(align.groups_of(*map(F.col, ("a", "a_ends", "b", "b_ends"))).alias("g")).select(F.flatten(F.transform("g", align.links_of)).alias("x"), F.size("g").alias("n")).first()
    assert g.n == 1 and len(g.x) == len(a) + len(b) - 1
    assert align.alignment_report(docs.limit(0), A, B).count() == 0


def test_pieces_cut_alike_share_a_shape(docs):
    """Ends of tokens stand once for all pieces that are cut alike; ids and ends give the pieces' bytes back."""
    own, rows = align.Pair(A, B), align.tokenised(docs, A, B).collect()
    assert sum(len(r.shapes) for r in rows) < 0.7 * sum(len(r.pieces) for r in rows)
    for r in rows:
        shapes = [(tuple(x.a_ends), tuple(x.b_ends)) for x in r.shapes]
        assert len(set(shapes)) == len(shapes) <= len(r.pieces)
        for x in r.pieces:
            ends = shapes[x.shape]
            data = own.a_bytes.joined(np.array(x.a))
            assert data == own.b_bytes.joined(np.array(x.b)) and len(data) == ends[0][-1] == ends[1][-1]
            assert np.cumsum(own.a_bytes.size[x.a]).tolist() == list(ends[0]) and np.cumsum(own.b_bytes.size[x.b]).tolist() == list(ends[1])


def test_pieces_of_the_last_texts_stay(docs, monkeypatch):
    """A full table forgets what the last texts don't have, and only that; tokens and shapes stay those of their pieces."""
    texts = [r.text for r in docs.collect()]
    own, fresh, learnt, learn = align.Pair(A, B), align.Pair(A, B), [], align.Pair.learn
    monkeypatch.setattr(align.Pair, "learn", lambda self, pieces: (learnt.append(len(pieces)), learn(self, pieces)))
    own.cut(texts[::2])
    own.cut(texts[1::2])
    before = sum(learnt)
    monkeypatch.setattr(align, "CACHED", len(own.number) - 1)
    used, places, sizes = own.cut(texts[1::2])
    assert before > 100 and sum(learnt) - before < 0.1 * before  # pieces of texts without tokens aren't kept
    wanted, at, n = fresh.cut(texts[1::2])
    assert sizes.tolist() == n.tolist() and max(used) < len(own.number) == len(own.shape)

    def rows(x, used, places):
        every = list(x.number)
        names = [every[i] for i in used]
        kinds = x.shape[used]
        lists = [np.split(y.take(k).data, np.cumsum(y.take(k).sizes)[:-1]) for y, k in ((x.ids[0], used), (x.ids[1], used), (x.lengths[0], kinds), (x.lengths[1], kinds))]
        return [(p, *(z.tolist() for z in parts)) for p, *parts in zip(names, *lists, strict=True)], [names[k] for k in places]

    (got, order), (want, expected) = rows(own, used, places), rows(fresh, wanted, at)
    assert sorted(got) == sorted(want) and order == expected
    monkeypatch.setattr(align, "CACHED", 0)
    own.cut(["one two"])
    assert len(own.number) == 2  # more than fit aren't kept


def test_their_queries_cover_whole_tables(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op11_token_files", "op12_runs", "op13_align"):
        assert queries.queries()[name](spark, sf_dir).count() == n


BIG = 2**60


def test_ids_stay_as_they_are_beside_null(spark):
    """Large ids, a null and a repeated row in one batch."""
    from corvane.llm import chat, decontaminate, tokens

    turns = [(1_700_000_000_000_000_001 + k // 4, k % 4, ("user", "assistant")[k % 2], f"t{k}") for k in range(40)]
    rows = spark.createDataFrame([*turns, turns[0], (None, 0, "user", "alone")], "conv_id long, turn long, role string, text string").coalesce(1)
    got = chat.repaired(rows).collect()
    assert sorted((str(r.conv_id), r.turn, r.text) for r in got) == sorted((str(r.conv_id), r.turn, r.text) for r in rows.collect())
    docs = spark.createDataFrame([(BIG + 1, "alpha beta"), (BIG + 3, "gamma"), (None, "delta"), (BIG + 3, "gamma")], "doc_id long, text string").coalesce(1)
    assert sorted(str(r.doc_id) for r in tokens.token_counts(docs, B).collect()) == sorted(str(r.doc_id) for r in docs.collect())
    item = "the quick brown fox jumps over the lazy dog while seven wizards boil jugs of strong black tea near the old harbour"
    leaks = spark.createDataFrame([(BIG + 1, f"intro words {item} and more"), (BIG + 3, item), (None, item), (5, "clean text of other words")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(BIG + 7, item), (None, "")], "item_id long, text string")
    assert sorted((str(r.doc_id), r.item_id) for r in decontaminate.contaminated(leaks, bench).collect()) == [(str(BIG + 1), BIG + 7), (str(BIG + 3), BIG + 7), ("None", BIG + 7)]


def test_lines_take_any_column_names(spark):
    from corvane.llm import lines

    rows = spark.createDataFrame([(1, "a line of words\nb", "x"), (2, "a line of words\nc", "y"), (None, "a line of words", "z")], "doc_id long, text string, _id string")
    own = rows.selectExpr("*", "1 as _tkey", "2 as _dropped", "3 as key", "4 as id", "5 as dropped", "6 as n_lines", "7 as doc")
    got = lines.without_repeated_lines(own)
    assert got.columns == [*own.columns, "n_dropped"]
    assert sorted((r._id, r.text, r.n_lines, r.n_dropped, r.doc) for r in got.collect()) == [("x", "a line of words\nb", 2, 0, 7), ("y", "c", 2, 1, 7), ("z", "", 1, 1, 7)]


@pytest.mark.parametrize("block_rows", [5, 40, 50_000])
def test_simhash_blocks_lose_no_link(spark, block_rows):
    from corvane.llm import simhash
    from corvane.operators.components import components

    r = random.Random(9)
    words = {r.getrandbits(64) for _ in range(60)} | {sum(1 << b for b in r.sample(range(64), 32)) for _ in range(60)}
    for x in list(words):
        for _ in range(3):
            x ^= sum(1 << b for b in r.sample(range(64), r.randrange(1, 4)))
            words.add(x)
    words = sorted(x - (1 << 64) if x >> 63 else x for x in words)
    root = {x: x for x in words}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(words):
        for y in words[:i]:
            if ((x ^ y) % (1 << 64)).bit_count() <= 2:
                root[max(find(x), find(y))] = min(find(x), find(y))
    got = {n.node: n.root for n in components(simhash.links(spark.createDataFrame([(x,) for x in words], "fp long"), block_rows=block_rows)).collect()}
    assert {x: got.get(x, x) for x in words} == {x: find(x) for x in words}
