"""LTR-6: LambdaRank by boosted trees; the sums that choose the splits are Spark aggregations, the trees are column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from corvane.store import drop, stored

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

#: Items that gradients() has at a time, and items of a packed block; lists are never cut.
CELLS, BLOCK = 1 << 20, 1 << 16


@dataclass(frozen=True)
class Tree:
    """A binary tree: node n's children are 2n+1 (at or below the threshold, null too) and 2n+2."""

    splits: dict[int, tuple[int, float]]
    leaves: dict[int, float]

    def value(self, x: Column, node: int = 0) -> Column:
        if node in self.leaves:
            return F.lit(self.leaves[node])
        feature, threshold = self.splits[node]
        left, right = self.value(x, 2 * node + 1), self.value(x, 2 * node + 2)
        return F.when(x[feature] > threshold, right).otherwise(left)


def score(trees: list[Tree], x: Column) -> Column:
    """LTR-3: the model's score of an array of features, in generated code; 0 without trees."""
    return sum((t.value(x) for t in trees), F.lit(0.0))


def derivatives(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second derivatives for the items of many queries of one length, a column each of scores and labels, in the ids' order: what swapping each pair of unequal labels would change in nDCG, weighted by how wrong their scores are; and whether a query has a label above 0.

    A step has one item of each query against those after it, so that a long list takes no square of memory.
    """
    import numpy as np

    n = len(s)
    place = np.zeros(s.shape, int)
    for i in range(n - 1):
        after = s[i + 1 :] > s[i]
        place[i] += after.sum(0)
        place[i + 1 :] += ~after
    scale = 1 / np.log2(np.arange(n) + 2)
    gain, discount = 2.0**y - 1, scale[place]
    ideal = (np.sort(gain, 0)[::-1] * scale[:, None]).sum(0)
    whole = np.where(ideal == 0, 1, ideal)
    g, h = np.zeros(s.shape), np.zeros(s.shape)
    for i in range(n - 1):
        change = np.abs((gain[i] - gain[i + 1 :]) * (discount[i] - discount[i + 1 :])) / whole
        sign = np.where(y[i] > y[i + 1 :], 1.0, -1.0)
        wrong = 1 / (1 + np.exp(np.clip(sign * (s[i] - s[i + 1 :]), -30, 30)))
        change *= wrong  # 0 for equal labels
        second = change * (1 - wrong)
        change *= sign
        g[i] += change.sum(0)
        g[i + 1 :] -= change
        h[i] += second.sum(0)
        h[i + 1 :] += second
    return g, h, ideal > 0


def lambdas(rows: list[dict]) -> list[dict]:
    """derivatives() for each item of one query (item_id, label, score, bins), equal scores in the order of the ids as text; none without a label above 0."""
    import numpy as np

    rows = sorted(rows, key=lambda r: str(r["item_id"]))
    g, h, some = derivatives(*(np.array(x, float).reshape(-1, 1) for x in ([r["score"] for r in rows], [r["label"] for r in rows])))
    return [{k: r[k] for k in ("item_id", "label", "score", "bins")} | {"g": float(a), "h": float(b)} for r, a, b in zip(rows, g[:, 0], h[:, 0], strict=True)] if some[0] else []


def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bins, g, h) of the items of lists (query, list of item_id, label, score, bins): lists of one length go through derivatives() together, CELLS items at a time at most unless one list has more."""
    import numpy as np
    import pyarrow as pa

    for x in batches:
        lists = x.column(1)
        starts, lengths = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py(), lists.value_lengths().to_numpy()
        flat = lists.flatten()
        label, score = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("label", "score"))
        code = flat.field("item_id").cast(pa.string()).dictionary_encode()
        names = code.dictionary.to_numpy(zero_copy_only=False)
        rank = np.argsort(np.argsort(names.astype(str), kind="stable"), kind="stable")[code.indices.to_numpy()]
        for n in np.unique(lengths):
            mine, step = starts[lengths == n], max(1, CELLS // max(1, int(n)))
            for at in range(0, len(mine), step):
                i = mine[at : at + step] + np.arange(n)[:, None]
                i = np.take_along_axis(i, np.argsort(rank[i], 0, kind="stable"), 0)
                g, h, some = derivatives(score[i], label[i])
                yield pa.RecordBatch.from_arrays([flat.field("bins").take(pa.array(i[:, some].ravel())), pa.array(g[:, some].ravel()), pa.array(h[:, some].ravel())], ["bins", "g", "h"])


def binned(rows: DataFrame, edges: list[list[float]], bins: int) -> DataFrame:
    """rows (query_id, item_id, label, x) with the bins of x, as bytes, in place of x. Bin b holds what is above edges[b - 1] and at or below edges[b], so a bin above b means a value above edges[b]; a null is in bin 0."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _bin_type(bins)
        for x in batches:
            flat = x.column("x").flatten()
            value = flat.to_numpy(zero_copy_only=False).reshape(-1, len(edges))
            place = np.empty(value.shape, kind)
            for k, e in enumerate(edges):
                place[:, k] = np.searchsorted(e, value[:, k])
            place[flat.is_null().to_numpy(zero_copy_only=False).reshape(value.shape)] = 0
            at = np.arange(len(place) + 1, dtype=np.int32) * (len(edges) * kind.itemsize)
            made = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(at), pa.py_buffer(place.tobytes())])
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in ("query_id", "item_id", "label")), made], ["query_id", "item_id", "label", "bins"])

    shape = StructType([*(rows.schema[c] for c in ("query_id", "item_id")), StructField("label", DoubleType()), StructField("bins", BinaryType())])
    return rows.select("query_id", "item_id", F.col("label").cast("double").alias("label"), F.col("x").cast("array<double>").alias("x")).mapInArrow(run, shape)


def _bin_type(bins: int) -> np.dtype:
    """The narrowest type of a bin, high byte first, so that bytes sort as the numbers do."""
    import numpy as np

    return np.min_scalar_type(bins).newbyteorder(">")


def packed(rows: DataFrame, width: int, bins: int) -> DataFrame:
    """rows (query_id, item_id, label, bins) as blocks of about BLOCK items: lengths (array), labels (array), bins (bytes, feature by feature).

    Queries of one length lie together, all their first items, then all their second ones; a query's
    items are in the order of the ids as text. Queries without a label above 0 are left out.
    """
    import numpy as np
    import pyarrow as pa

    def block(held: pa.Table) -> pa.RecordBatch:
        starts = np.flatnonzero(held["place"].to_numpy() == 1)
        lengths = np.diff(np.append(starts, len(held)))
        label = held["label"].to_numpy()
        kind = _bin_type(bins)
        each = np.frombuffer(b"".join(held["bins"].to_pylist()), kind).reshape(-1, width)
        kept, order = [], []
        for n in np.unique(lengths):
            i = starts[lengths == n] + np.arange(n)[:, None]
            gain = np.sort(2.0 ** label[i] - 1, 0)[::-1] / np.log2(np.arange(n) + 2)[:, None]
            i = i[:, gain.sum(0) > 0]
            kept.append(np.full(i.shape[1], n))
            order.append(i.ravel())
        kept, order = np.concatenate(kept), np.concatenate(order)
        one = lambda values, item: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, item))
        return pa.RecordBatch.from_arrays([one(kept, pa.int32()), one(label[order], pa.float64()), pa.array([each[order].T.tobytes()], pa.binary())], ["lengths", "labels", "bins"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for x in batches:
            first = np.flatnonzero(x.column("place").to_numpy() == 1)
            if count + x.num_rows >= BLOCK and len(first) and count + first[-1]:
                yield block(pa.Table.from_batches([*held, x.slice(0, first[-1])]))
                held, count, x = [], 0, x.slice(first[-1])
            held.append(x)
            count += x.num_rows
        if count:
            yield block(pa.Table.from_batches(held))

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("item_id").cast("string"), "label", "bins"))
    return rows.repartition(tasks, "query_id").select("label", "bins", place.alias("place")).mapInArrow(run, "lengths array<int>, labels array<double>, bins binary")


def histogram(blocks: DataFrame, grown: list[tuple[dict, dict]], splits: dict[int, tuple[int, int]], nodes: list[int], width: int, bins: int) -> DataFrame:
    """(node, feature, bin, g, h): sums of the derivatives after the grown trees over the items of blocks that splits send to nodes, summed in arrays by each task first; bins without an item are left out."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(nodes) * bins
        slot = {n: k * bins for k, n in enumerate(nodes)}
        total = np.zeros((3, width, size))
        for x in batches:
            for lengths, labels, each in zip(x.column("lengths"), x.column("labels"), x.column("bins"), strict=True):
                lengths, label = lengths.values.to_numpy(), labels.values.to_numpy()
                place = np.frombuffer(each.as_buffer(), _bin_type(bins)).reshape(width, -1)
                score = np.zeros(len(label))
                for tree in grown:
                    score += _leaf(*tree, place)
                g, h = np.empty(len(label)), np.empty(len(label))
                at = 0
                for n, m in zip(*np.unique(lengths, return_counts=True), strict=True):
                    own = slice(at, at := at + n * m)
                    g_, h_, _ = derivatives(score[own].reshape(n, m), label[own].reshape(n, m))
                    g[own], h[own] = g_.ravel(), h_.ravel()
                base = np.broadcast_to(_leaf(splits, slot, place, -1), len(label))
                if (base < 0).any():
                    there = base >= 0
                    base, place, g, h = base[there], place[:, there], g[there], h[there]
                for f in range(width):
                    cell = base + place[f]
                    total[0, f] += np.bincount(cell, minlength=size)
                    total[1, f] += np.bincount(cell, g, size)
                    total[2, f] += np.bincount(cell, h, size)
        there = np.nonzero(total[0])
        feature, node = there[0], np.array(nodes)[there[1] // bins]
        ints = [pa.array(v, pa.int32()) for v in (node, feature, there[1] % bins)]
        yield pa.RecordBatch.from_arrays([*ints, pa.array(total[1][there]), pa.array(total[2][there])], ["node", "feature", "bin", "g", "h"])

    parts = blocks.mapInArrow(run, "node int, feature int, bin int, g double, h double")
    return parts.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def _leaf(splits: dict[int, tuple[int, int]], values: dict, place: np.ndarray, other: float = 0.0, node: int = 0) -> np.ndarray:
    """What values has for the leaf of each item in a tree over bins (a row for each feature)."""
    import numpy as np

    if node not in splits:
        return np.asarray(values.get(node, other))
    feature, edge = splits[node]
    return np.where(place[feature] > edge, _leaf(splits, values, place, other, 2 * node + 2), _leaf(splits, values, place, other, 2 * node + 1))


def bin_edges(rows: DataFrame, width: int, bins: int) -> list[list[float]]:
    """For each of so many features the thresholds between about equal shares of its values: bins - 1 at most. A NaN is above all numbers, and no threshold."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(F.get("x", F.lit(k)), shares, 10_000).alias(f"f{k}") for k in range(width))).first()
    return [sorted({e for e in found[f"f{k}"] or [] if not math.isnan(e)}) for k in range(width)]


def fit(rows: DataFrame, width: int, trees: int = 15, depth: int = 3, bins: int = 16, rate: float = 0.2, least: float = 1e-3, shrink: float = 1.0) -> list[Tree]:
    """Boosted trees for rows (query_id, item_id, label, x): label 0 or more, x an array of width numbers, nulls lowest.

    The items are shuffled once, with bins in place of values, and stored in blocks of whole
    queries. Each level of a tree is one pass over these and one aggregation: a task makes
    the scores and derivatives anew, and sums up these for each node, feature and bin;
    2**(depth - 1) * width * bins rows reach the driver, which picks the splits, whatever the
    size of the training set. A leaf's sums are a part of its parent's. least: the second
    derivatives that a child needs; shrink keeps small leaves small. Rows of a null query or
    without a label don't count. No pair to learn from gives no trees.
    """
    edges = bin_edges(rows.filter("x is not null"), width, bins)
    own = rows.filter("query_id is not null and label is not null and x is not null")
    blocks = stored(packed(binned(own, edges, bins), width, bins), "ranker")
    model: list[Tree] = []
    grown: list[tuple[dict, dict]] = []
    for _ in range(trees):
        splits: dict[int, tuple[int, int]] = {}
        leaves: dict[int, float] = {}
        totals: dict[int, tuple[float, float]] = {}
        open_nodes = [0]
        for level in range(depth + 1):
            sums = histogram(blocks, grown, splits, open_nodes, width, bins).collect() if open_nodes and level < depth else []
            following = []
            for n in open_nodes:
                mine = [r for r in sums if r.node == n]
                g, h = totals[n] if n in totals else (sum(r[c] for r in mine if r.feature == 0) for c in ("g", "h"))
                best = _best(mine, g, h, width, least, shrink) if level < depth else None
                if best is None:
                    leaves[n] = rate * g / (h + shrink)
                else:
                    splits[n] = best
                    left_g, left_h = (sum(r[c] for r in mine if r.feature == best[0] and r.bin <= best[1]) for c in ("g", "h"))
                    totals |= {2 * n + 1: (left_g, left_h), 2 * n + 2: (g - left_g, h - left_h)}
                    following += [2 * n + 1, 2 * n + 2]
            open_nodes = following
        if not splits:
            break
        grown.append((splits, leaves))
        model.append(Tree({n: (f, edges[f][b]) for n, (f, b) in splits.items()}, leaves))
    drop(blocks)
    return model


def _best(sums: list, g: float, h: float, width: int, least: float, shrink: float) -> tuple[int, int] | None:
    """(feature, last bin of the left child) of the split that gains most; None if none gains. Ties go to the first feature and bin."""
    best, found = 1e-9, None
    for f in range(width):
        left_g = left_h = 0.0
        own = sorted((r.bin, r.g, r.h) for r in sums if r.feature == f)
        for k, (b, x, y) in enumerate(own[:-1]):
            left_g, left_h = left_g + x, left_h + y
            if min(left_h, h - left_h) < least:
                continue
            gain = left_g**2 / (left_h + shrink) + (g - left_g) ** 2 / (h - left_h + shrink) - g**2 / (h + shrink)
            if gain > best and not math.isnan(gain):
                best, found = gain, (f, b)
    return found


def ndcg(rows: DataFrame, by: Column, k: int) -> DataFrame:
    """(query_id, ndcg) of rows (query_id, item_id, label) in descending order of by, ties by item_id; queries without a label above 0 are left out."""
    w = Window.partitionBy("query_id")
    own = rows.withColumns({"place": F.row_number().over(w.orderBy(F.desc(by), "item_id")), "ideal": F.row_number().over(w.orderBy(F.desc("label"), "item_id"))})
    gain = F.pow(F.lit(2.0), F.col("label")) - 1
    at = lambda c: F.sum(F.when(F.col(c) <= k, gain / F.log2(F.col(c) + 1)).otherwise(0.0))
    return own.groupBy("query_id").agg(at("place").alias("a"), at("ideal").alias("b")).filter("b > 0").select("query_id", (F.col("a") / F.col("b")).alias("ndcg"))
