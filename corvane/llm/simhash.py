"""SimHash near-duplicates: fingerprints of word shingles, compared exactly in tiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.scratch import bounded_broadcast, release, slices, stored
from corvane.operators.components import components

BITS, SEED = 64, 42


def shingle_hashes(text: str | None, words: int = 3) -> tuple[np.ndarray, int]:
    """The hashes of a text's shingles, and its number of words; fewer words than a shingle has are one shingle, none none."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64), 0
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum([len(x) + 1 for x in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[:n].tolist(), (ends[words - 1 :] if len(parts) >= words else ends[-1:]).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n), len(parts)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 without hashes."""
    n = len(hashes)
    counts, lanes = np.zeros((8, 8), np.int64), np.uint64(0x0101010101010101)
    for at in range(0, n, 255):  # 255 ones fit a byte, so eight counters are added in one word
        block = hashes[at : at + 255]
        for k in range(8):
            counts[k] += ((block >> np.uint64(k)) & lanes).sum(dtype=np.uint64).reshape(1).view(np.uint8)
    return sum(1 << (8 * lane + k) for k in range(8) for lane in range(8) if 2 * counts[k, lane] > n)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned fingerprint of one text; a text without words (or null) has 0."""
    return majority(shingle_hashes(text, words)[0])


def fingerprints(docs: DataFrame, words: int = 3, keyed: bool = False) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long, one row for each row of docs. keyed adds text_key, the text's hash."""
    key = [F.xxhash64("text").alias("text_key")] * keyed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            prints = np.array([fingerprint(t, words) for t in x.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([x.column("doc_id"), pa.array(prints), *([x.column("text_key")] if keyed else [])], ["doc_id", "fp", *["text_key"] * keyed])

    return docs.select(F.col("doc_id").cast("long"), "text", *key).mapInArrow(run, "doc_id long, fp long" + ", text_key long" * keyed)


def _forest(words: np.ndarray, home: np.ndarray, visits: np.ndarray, radius: int, cells: int = 2_000_000) -> np.ndarray:
    """For each word of a task, the smallest index linked to it, directly or through others, by links of home words to visiting ones; at most about so many cells are held at once."""
    parent, order, total = np.arange(len(words)), np.flatnonzero(home), np.bitwise_count(words)
    rows = max(1, cells // max(1, len(words)))
    for at in range(0, len(order), rows):
        block = order[at : at + rows]
        others = np.flatnonzero(visits & (total >= int(total[block].min()) - radius) & (total <= int(total[block].max()) + radius))
        i, j = np.nonzero(np.bitwise_count(words[block, None] ^ words[None, others]) <= radius)
        i, j = block[i], others[j]
        while (apart := parent[i] != parent[j]).any():
            i, j = i[apart], j[apart]
            a, b = parent[i], parent[j]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := parent[parent], parent):
                parent = up
    return parent


def links(words: DataFrame, radius: int = 2, lanes: int = 4, block_rows: int = 50_000) -> DataFrame:
    """(a, b) between distinct fingerprints (column fp) such that whatever is linked at radius differing bits or fewer is connected.

    A tile holds the fingerprints with the same population counts of their lanes (equal
    parts of the word). The counts of two words at radius bits or fewer differ by radius
    at most, in sum over the lanes, so a tile meets only such tiles and skips the others.
    A tile's own words are cut into blocks of about block_rows by hash, and so are all
    that visit it, its own among them; each block meets each block of visitors in a task
    of its own. So no task holds more than two blocks, and no link is lost: what the tasks
    find is connected afterwards. Each task returns a spanning forest, not all pairs.
    """
    width = BITS // lanes
    counts = [F.expr(f"bit_count(shiftrightunsigned(fp, {width * k}) & {(1 << width) - 1}L)") for k in range(lanes)]
    steps = [s for s in product(range(-radius, radius + 1), repeat=lanes) if sum(map(abs, s)) <= radius]
    base = width + 1
    key = sum((c * base**k for k, c in enumerate(counts)), F.lit(0)).cast("long")
    tiled = words.select("fp", key.alias("own"), F.array(*counts).alias("pc"))
    near = ["own"]
    for s in steps:  # only towards smaller tiles, and only where every lane's count stays possible
        if (shift := sum(d * base**k for k, d in enumerate(s))) < 0:
            fits = " and ".join(f"pc[{k}] + {d} between 0 and {width}" for k, d in enumerate(s) if d) or "true"
            near.append(f"if({fits}, own + {shift}L, null)")
    visited = "explode(filter(array(" + ", ".join(near) + "), x -> x is not null)) as tile"
    sizes = stored(tiled.groupBy("own").agg(F.first("pc").alias("pc"), F.count(F.lit(1)).alias("n")), "tiles")  # (width + 1) ** lanes rows at most
    guests = sizes.selectExpr("n", visited).groupBy("tile").agg(F.sum("n").alias("guests"))
    cuts = sizes.join(guests, F.col("own") == F.col("tile")).selectExpr("tile", f"cast(ceil(n / {block_rows}) as int) as blocks", f"cast(ceil(guests / {block_rows}) as int) as bins")
    out = tiled.selectExpr("fp", "own", visited).join(bounded_broadcast(stored(cuts, "tile-cuts"), 4), "tile")
    out = out.selectExpr("fp", "tile", "own = tile as same", "blocks", "bins", "cast(pmod(xxhash64(fp), blocks) as int) as mine", "cast(pmod(xxhash64(fp, 1), bins) as int) as bin")
    as_guest = "transform(sequence(0, blocks - 1), i -> struct(i as block, bin as guest))"
    as_home = "transform(sequence(0, bins - 1), i -> struct(mine as block, i as guest))"
    out = out.selectExpr("fp", "tile", "same", "mine", "bin", f"explode(if(same, array_union({as_home}, {as_guest}), {as_guest})) as at")
    out = out.selectExpr("fp", "tile", "at.block as block", "at.guest as guest", "same and at.block = mine as home", "at.guest = bin as visits")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf.fp.to_numpy(np.int64)
        parent = _forest(w.view(np.uint64), pdf.home.to_numpy(bool), pdf.visits.to_numpy(bool), radius)
        moved = np.flatnonzero(parent != np.arange(len(w)))
        return pd.DataFrame({"a": w[moved], "b": w[parent[moved]]})

    return out.groupBy("tile", "block", "guest").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3, lanes: int = 4, keyed: bool = False) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (columns doc_id, text; others are ignored).

    Fingerprints link at radius differing bits or fewer, and component_id is the smallest
    doc_id that can be reached. A null text counts as empty: fingerprint 0, linked like
    any other. Rows with a null doc_id are kept; they never name a component unless all
    its ids are null, and then component_id is null. Repeated rows share their component.
    keyed adds text_key, which tells rows with one doc_id apart.
    """
    own = stored(fingerprints(docs, words, keyed), "fingerprints")
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), radius, lanes))
    of = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    names = of.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = of.select("fp", "root").join(names, "root").select("fp", "component_id")
    return own.join(classes, "fp").select("doc_id", "fp", "component_id", *["text_key"] * keyed)


#: Bands of the stage's candidates, minima of a band, least share of common five-word shingles, and pairs with one text that a task checks.
BANDS, MINIMA, SIMILAR, PAIRS = 16, 4, 0.8, 2000
_DRAW = np.random.default_rng(5).integers(1, 1 << 63, (3, BANDS * MINIMA), dtype=np.uint64)


def five_word_hashes(threes: np.ndarray, n_words: int) -> np.ndarray:
    """Hashes of the five-word shingles, each from those of its first and its last three words; fewer words are one shingle."""
    if n_words >= 5:
        first, last = threes[: n_words - 4], threes[2:]
    else:
        first, last = threes[:1], threes[-1:]
    x = first * np.uint64(0x9E3779B97F4A7C15) ^ (last << np.uint64(31) | last >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ x >> np.uint64(29)


def bands(fives: np.ndarray) -> np.ndarray:
    """A key for each band of minima over the shingles; texts with a share s of common shingles meet in one with probability 1 - (1 - s**MINIMA)**BANDS."""
    least = np.full(BANDS * MINIMA, (1 << 64) - 1, np.uint64)
    for at in range(0, len(fives), 4096):
        np.minimum(least, ((fives[at : at + 4096, None] ^ _DRAW[0]) * (_DRAW[1] | np.uint64(1))).min(0), out=least)
    mixed = ((least * (_DRAW[2] | np.uint64(1))) >> np.uint64(3)).reshape(BANDS, MINIMA)
    return (mixed.sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp, bands) of each row; a text without words has no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            prints, keys = [], []
            for t in x.column("text").to_pylist():
                threes, n = shingle_hashes(t)
                prints.append(majority(threes))
                keys.append(bands(five_word_hashes(threes, n)).tolist() if n else [])
            yield pa.record_batch([x.column("doc_id"), x.column("text_key"), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_key", "fp", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, text_key long, fp long, bands array<long>")


def similar_texts(docs: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b), text_keys of texts that share SIMILAR or more of their five-word shingles, found by bands and checked exactly.

    Of each band's texts one, drawn by a hash of its own for each band, meets all others; so
    a group of any size gives a row a text, not its pairs, and texts that are alike but not
    like the drawn one meet in another band. A text that very many meet is copied to
    several tasks. The README has the measured recall.
    """
    each = own.select("text_key", F.explode("bands").alias("band")).distinct()
    drawn = F.min(F.struct(F.xxhash64("text_key", "band"), "text_key"))["text_key"]
    least = each.groupBy("band").agg(drawn.alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "rep")
    pairs = stored(each.join(stored(least, "bands"), "band").filter("text_key <> rep").select("text_key", "rep").distinct(), "pairs")
    parts = pairs.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("parts"))
    met = stored(pairs.select("text_key").union(pairs.select("rep")).distinct(), "met")
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").join(met, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    texts = stored(texts, "met-texts", "zstd")
    reps = texts.withColumnRenamed("text_key", "rep").withColumnRenamed("text", "rep_text").join(parts, "rep").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = pairs.join(parts, "rep").select("text_key", "rep", F.pmod(F.xxhash64("text_key"), F.col("parts")).cast("int").alias("part"))
    both = cells.join(texts, "text_key").join(reps.select("rep", "part", "rep_text"), ["rep", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(64)(lambda t: np.unique(five_word_hashes(*shingle_hashes(t))))
        for x in slices(batches):
            keep = []
            for a, b in zip(x.column("text").to_pylist(), x.column("rep_text").to_pylist(), strict=True):
                p, q = np.unique(five_word_hashes(*shingle_hashes(a))), known(b)
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(common >= SIMILAR * (len(p) + len(q) - common))
            yield x.select(["text_key", "rep"]).filter(pa.array(keep, pa.bool_())).rename_columns(["a", "b"])
        known.cache_clear()
        release()

    return both.select("text_key", "rep", "text", "rep_text").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, text_key, component_id) for each row: texts are linked if their fingerprints differ in radius bits or fewer, or if they share SIMILAR of their five-word shingles.

    component_id is the smallest doc_id that can be reached, null if all are null. Null and
    empty texts, and those without words, have one fingerprint, and are copies.
    """
    own = stored(signed(docs), "signed")
    prints = own.groupBy("fp").agg(F.min("text_key").alias("rep"))
    same = own.select("text_key", "fp").distinct().join(prints, "fp").select(F.col("text_key").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    close = links(prints.select("fp"), radius).join(prints.toDF("a", "x"), "a").join(prints.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = components(same.unionByName(close).unionByName(similar_texts(docs, own)))
    rows = own.select("doc_id", "text_key").join(roots.withColumnRenamed("node", "text_key"), "text_key", "left").select("doc_id", "text_key", F.coalesce("root", "text_key").alias("root"))
    rows = stored(rows, "rooted")
    names = stored(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "names")
    return rows.join(names, "root").select("doc_id", "text_key", "component_id")


def keep_one(docs: DataFrame, radius: int = 2) -> DataFrame:
    """docs without the near copies, see near_copies(): of each component the row with the smallest doc_id stays.

    Rows of a component that share that doc_id all stay; of a component whose ids are all
    null, all rows stay. Rows go by doc_id and text, so that a near copy takes no other
    text of its doc_id (or of the null ones) with it.
    """
    found = near_copies(docs, radius)
    gone = found.filter("doc_id <> component_id or (doc_id is null and component_id is not null)")
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_key")).distinct()
    return docs.join(gone, docs.doc_id.eqNullSafe(gone._gone) & (F.xxhash64(docs.text) == gone._key), "left_anti")
