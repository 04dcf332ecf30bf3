"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is then put in its leaf. A query goes
through the tree best bin first: a priority queue holds the branches not taken, nearest
centre first. How many leaves it visits is calibrated: exact neighbours of a bounded set
of queries, found by brute force over all vectors in blocks, tell how many visits reach
the recall asked for. Leaves with many vectors are cut into parts, each searched on its
own, and the best of all parts are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import written

#: Bounds: vectors the tree is fitted on, queries the visits are calibrated on.
MAX_FIT = 16384
MAX_CALIBRATION = 64
#: Recall the visits are widened to on the calibration queries.
RECALL = 0.97
BRANCHES = 8
LEAF_SHARE = 96
#: Rows of a leaf's part; a leaf with more is cut.
PART_ROWS = 4096


@dataclass
class Tree:
    """Centres of all nodes; children of inner nodes; leaf numbers of the others."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row: at every level the nearest child."""
        out = np.zeros(len(rows), np.int64)
        stack = [(0, np.arange(len(rows)))]
        while stack:
            node, own = stack.pop()
            if not len(own):
                continue
            below = self.children[node]
            if not below:
                out[own] = self.leaf[node]
                continue
            nearest = _gaps(rows[own], self.centres[below]).argmin(1)
            stack += [(child, own[nearest == k]) for k, child in enumerate(below)]
        return out

    def best_bins(self, row: np.ndarray) -> Iterator[int]:
        """Leaves in the order in which a best-bin-first search of ``row`` reaches them."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while self.children[node]:
                below = self.children[node]
                gaps = _gaps(row[None], self.centres[below])[0]
                best = int(gaps.argmin())
                for k, child in enumerate(below):
                    if k != best:
                        heapq.heappush(queue, (float(gaps[k]), child))
                node = below[best]
            yield self.leaf[node]


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def _distances(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from differences."""
    return np.sqrt(((rows - query) ** 2).sum(1))


def fit_tree(sample: np.ndarray, branches: int = BRANCHES, leaf_share: int = LEAF_SHARE, seed: int = 7) -> Tree:
    """Hierarchical k-means over ``sample``, split until a node has ``leaf_share`` distinct rows or fewer."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0) if len(sample) else np.zeros((1, 1))
    centres, children, leaf, leaves = [sample.mean(0)], [[]], [-1], 0
    stack = [(0, np.arange(len(sample)))]
    while stack:
        node, own = stack.pop()
        groups: list[np.ndarray] = []
        if len(own) > leaf_share:
            own_rows = sample[own]
            mid = own_rows[rng.choice(len(own), min(branches, len(own)), replace=False)]
            for _ in range(12):
                near = _gaps(own_rows, mid).argmin(1)
                mid = np.stack([own_rows[near == k].mean(0) if (near == k).any() else mid[k] for k in range(len(mid))])
            near = _gaps(own_rows, mid).argmin(1)
            groups = [own[near == k] for k in range(len(mid)) if (near == k).any()]
        if len(groups) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        for group in groups:
            children[node].append(len(centres))
            stack.append((len(centres), group))
            centres.append(sample[group].mean(0))
            children.append([])
            leaf.append(-1)
    return Tree(np.stack(centres), children, leaf)


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): rows with a key and a vector of finite numbers, not all zero, of the commonest length."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (common[0]["d"] if common else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _nearest(ids: np.ndarray, rows: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest rows, ties to the smaller id, without the query's own row."""
    gaps = _distances(query, rows)
    gaps[ids == query_id] = np.inf
    if len(ids) > 4 * k:
        limit = np.partition(gaps, k - 1)[k - 1]
        keep = np.flatnonzero(gaps <= limit)
    else:
        keep = np.arange(len(ids))
    keep = keep[np.isfinite(gaps[keep])]
    keep = keep[np.lexsort((ids[keep], gaps[keep]))[:k]]
    return ids[keep], gaps[keep]


def exact(rows: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """(query_id, vec_id, score): exact neighbours of a bounded list of queries over all rows, in blocks."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, block = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for query_id, query in shared.value:
                found, gaps = _nearest(ids, block, query_id, query, k)
                yield pa.record_batch({"query_id": np.full(len(found), query_id), "vec_id": found, "score": gaps})

    return _merged(rows.mapInArrow(search, "query_id long, vec_id long, score double"), k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def calibrated_visits(tree: Tree, placed: DataFrame, queries: list[tuple[int, np.ndarray]], k: int, recall: float) -> int:
    """Least number of leaf visits with which the calibration queries reach ``recall`` of their exact neighbours."""
    truth = exact(placed.select("id", "v"), queries, k).select("query_id", F.col("vec_id").alias("id"))
    homes = truth.join(placed.select("id", "leaf"), "id").select("query_id", "leaf").collect()
    order = {q: {leaf: n for n, leaf in enumerate(tree.best_bins(v), 1)} for q, v in queries}
    visits = np.sort([order[r["query_id"]][r["leaf"]] for r in homes])
    return int(visits[min(len(visits) - 1, int(np.ceil(recall * len(visits))) - 1)]) if len(visits) else 1


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest found among all rows but its own.

    ``score`` is the exact Euclidean distance of the original vectors, ranked nearest
    first, ties to the smaller key. Null, zero and non-finite vectors take no part, nor
    null keys. Fewer than k rows give all of them: a query visits further leaves until they
    hold k rows beside its own. Rows that repeat a key count as rows of their own, but a
    row with the query's key is never its neighbour. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(MAX_FIT).select("v").toArrow().column("v").combine_chunks()
    tree = fit_tree(_matrix(sample))
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"id": batch.column(0), "v": batch.column(1), "leaf": shared.value.assign(_matrix(batch.column(1)))})

    placed = written(rows.mapInArrow(place, "id long, v array<double>, leaf long"), "leaves")
    sizes = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():
        sizes[r["leaf"]] = r["count"]
    asked = usable(queries, key, vector)
    some = asked.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(MAX_CALIBRATION).collect()
    visits = calibrated_visits(tree, placed, [(r["id"], np.array(r["v"])) for r in some], k, recall)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for n, row in enumerate(_matrix(batch.column(1))):
                held = 0
                for count, leaf in enumerate(shared.value.best_bins(row), 1):
                    held += int(sizes[leaf])
                    out += [(n, leaf, part) for part in range(-(-int(sizes[leaf]) // PART_ROWS))]
                    if count >= visits and held > k + 1:
                        break
            at = np.array(out, np.int64).reshape(-1, 3)
            yield pa.record_batch({"leaf": at[:, 1], "part": at[:, 2], "id": batch.column(0).take(pa.array(at[:, 0])), "v": batch.column(1).take(pa.array(at[:, 0]))})

    table = spark.createDataFrame([(n, max(1, -(-int(size) // PART_ROWS))) for n, size in enumerate(sizes)], "leaf long, parts long")
    dealt = placed.join(F.broadcast(table), "leaf").select("leaf", F.pmod(F.xxhash64("id", "v"), "parts").alias("part"), "id", "v")
    routed = asked.mapInArrow(route, "leaf long, part long, id long, v array<double>")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, block = left.column("id").to_numpy(), _matrix(left.column("v").combine_chunks())
        asked_ids, asked_rows = right.column("id").to_numpy(), _matrix(right.column("v").combine_chunks())
        found = [(q, *_nearest(ids, block, q, row, k)) for q, row in zip(asked_ids, asked_rows, strict=True)] if len(ids) else []
        flat = lambda n, kind: np.concatenate([f[n] for f in found]) if found else np.zeros(0, kind)
        whose = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
        return pa.table({"query_id": whose, "vec_id": flat(1, np.int64), "score": flat(2, np.float64)})

    found = dealt.groupBy("leaf", "part").cogroup(routed.groupBy("leaf", "part")).applyInArrow(search, "query_id long, vec_id long, score double")
    return _merged(found, k)
