import random

from corvane.llm.license import TEMPLATES, WORD, Scanner, hashes, license_spans


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = step(row, x, b)
    return row[-1]


def step(row, x, b):
    new = [0]
    for j, y in enumerate(b):
        new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
    return new


def test_edited_templates_are_found_and_their_coverage_is_that_of_all_alignments():
    r, s = random.Random(1), Scanner(TEMPLATES)
    for name, text in TEMPLATES.items():
        words = text.split()
        if len(words) > 30:
            for _ in range(3):
                words[r.randrange(len(words))] = "xyzzy"
        given = "lorem ipsum dolor " * 40 + " ".join(words) + " sit amet" * 30
        found = {x[0]: x for x in s.scan(given)}
        assert name in found, name
        _, coverage, a, b = found[name]
        template = WORD.findall(text.lower())
        assert round(coverage * len(template)) == lcs(template, WORD.findall(given[a:b].lower()))


def test_clean_texts_have_none():
    r = random.Random(2)
    words = WORD.findall(" ".join(TEMPLATES.values()).lower())
    assert all(not Scanner(TEMPLATES).scan(" ".join(r.choice(words) for _ in range(300))) for _ in range(20))


def test_edges(spark):
    line = "Released under the MIT License."
    rows = [(1, None, 1), (2, "", 1), (None, "İ " + line, 1), (3, f"{line}\n{line}", 1), (3, "x " * 50_000 + line, 1)]
    got = license_spans(spark.createDataFrame(rows, "doc_id long, text string, start int")).collect()
    assert sorted((x.doc_id or 0, x.start, x.end, x.license) for x in got) == [
        (0, 2, 32, "mit-name"), (3, 0, 30, "mit-name"), (3, 32, 62, "mit-name"), (3, 100_000, 100_030, "mit-name")]
    assert license_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_name_line_gives_its_own_license_alone():
    s = Scanner(TEMPLATES)
    for name, text in TEMPLATES.items():
        assert [x[:2] for x in s.scan(f"lorem ipsum {text} dolor")] == [(name, 1.0)], name
    for other in ("Licensed under CC BY-SA 2.5", "Licensed under CC 0", "Released under the XYZ License", "licensed under the GNU Lesser General Public License, version 4", "Licensed under the Apache License, Version 1.0"):
        assert s.scan(f"lorem ipsum {other} dolor") == [], other
    lines = "Licensed under CC BY-NC 4.0\nLicensed under CC BY 4.0\nReleased under the MIT License\n" + TEMPLATES["mit"]
    assert [x[0] for x in s.scan(lines)] == ["cc-by-nc-4.0-name", "cc-by-4.0-name", "mit-name", "mit"]


def test_stray_fragments_before_a_copy_do_not_hide_it():
    s = Scanner(TEMPLATES)
    for name in ("mit", "gpl-3.0-notice", "bsd-2-clause"):
        words = TEMPLATES[name].split()
        for size in (3, 4, 6):
            for gap in range(12):
                given = ("lorem " * gap + " ".join(words[5 : 5 + size]) + " ") * 80 + "ipsum " + TEMPLATES[name]
                assert (name, 1.0) in [x[:2] for x in s.scan(given)], (name, size, gap)


def test_copies_with_words_changed_and_put_in_are_found():
    r, s = random.Random(7), Scanner(TEMPLATES)
    for name, text in TEMPLATES.items():
        words = WORD.findall(text.lower())
        if len(words) < 40:
            continue
        for _ in range(6):  # each seventh word changed, three words put in after each eighth
            given = []
            for k, w in enumerate(words):
                given.append("xyzzy" if k % 7 == 3 and w not in ("neither", "name", "version", "general", "public", "lesser", "affero", "2", "3", "1") else w)
                given += [r.choice(["foo", "bar"]) for _ in range(3)] * (k % 8 == 7)
            assert name in [x[0] for x in s.scan("lorem ipsum " * r.randrange(30) + " ".join(given) + " dolor" * 9)], name


def test_every_copy_within_the_share_is_a_candidate():
    """No choice of changed words, up to the share, hides a template from the index."""
    r, s = random.Random(3), Scanner(TEMPLATES)
    for name, words in s.words.items():
        n = len(words)
        for trial in range(200):
            m = int(0.2 * n + 1e-9)
            gone = set(range(trial % 5, n, 5)) if trial < 5 else set(r.sample(range(n), m))
            given = ["xyzzy" if k in gone and len(gone) <= m else w for k, w in enumerate(words)]
            met = [x for size, index in s.index.items() for y in hashes(given, size) for x, _ in index.get(int(y), ())]
            assert name in met, (name, sorted(gone))


def test_spans_equal_a_plain_search_over_documents(spark, sf_dir):
    """Names in documents, by plain patterns over the words."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet".replace("sf0.001", "sf0.01"))
    rows = docs.select("doc_id", "text").collect()
    names = {n: WORD.findall(t.lower()) for n, t in TEMPLATES.items() if n.endswith("-name")}
    want = set()
    for r in rows:
        words = " " + " ".join(WORD.findall((r.text or "").lower())) + " "
        want |= {(r.doc_id, n) for n, w in names.items() if " " + " ".join(w) + " " in words}
    got = {(r.doc_id, r.license) for r in license_spans(docs).filter(F.col("coverage") == 1.0).collect()}
    assert want and want == {x for x in got if x[1].endswith("-name")}
