"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; every row is indexed in the leaf that it
descends to. A query walks the tree with a priority queue, always opening the
node with the largest inner product to its centre, and so lists leaves in the
order of promise. How many leaves it visits is widened until the recall of
calibration queries, measured against all rows, reaches the target.

Neighbouring leaves share a cell of bounded size (a hot leaf is split over
several cells); queries meet rows cell by cell, and only their best of each cell
travel on.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import one_array
from .checkpoints import written

#: Most rows that the tree is fitted on, and queries that calibrate the visits (both by hash of the id).
SAMPLE_ROWS = 20_000
CALIBRATION = 100
LEAF_SAMPLE = 24
BRANCHES = 8
CELL_ROWS = 4096
QUERY_ROWS = 4096


@dataclass
class Tree:
    """Nodes with their centres; a leaf has no children."""

    centres: np.ndarray
    children: list[list[int]]
    leaf_of: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        self.leaf_of = {n: k for k, n in enumerate(n for n, c in enumerate(self.children) if not c)}

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: at every node the child with the nearest centre."""
        at = np.zeros(len(x), np.int64)
        half = (self.centres ** 2).sum(1) / 2
        moving = np.arange(len(x)) if self.children[0] else np.zeros(0, np.int64)
        while len(moving):
            left = []
            for node in np.unique(at[moving]):
                rows = moving[at[moving] == node]
                kids = np.array(self.children[node])
                at[rows] = kids[np.argmax(x[rows] @ self.centres[kids].T - half[kids], 1)]
                left.append(rows)
            moving = np.concatenate(left)
            moving = moving[[bool(self.children[n]) for n in at[moving]]]
        return np.array([self.leaf_of[n] for n in at], np.int64)

    def best_bins(self, queries: np.ndarray, visits: int) -> list[list[int]]:
        """For each query its first ``visits`` leaves, best bin first."""
        near = queries @ self.centres.T
        out = []
        for row in near:
            queue, leaves = [(0.0, 0)], []
            while queue and len(leaves) < visits:
                _, node = heapq.heappop(queue)
                if self.children[node]:
                    for kid in self.children[node]:
                        heapq.heappush(queue, (-row[kid], kid))
                else:
                    leaves.append(self.leaf_of[node])
            out.append(leaves)
        return out


def fit_tree(x: np.ndarray, branches: int = BRANCHES, leaf_sample: int = LEAF_SAMPLE, rounds: int = 6,
             seed: int = 3) -> Tree:
    """Splits the sample by k-means, again and again, until a part has at most ``leaf_sample`` rows."""
    rng = np.random.default_rng(seed)
    centres, children, todo = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [[]], [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= leaf_sample:
            continue
        part = x[rows]
        c = part[rng.choice(len(rows), min(branches, len(rows)), replace=False)]
        for _ in range(rounds):
            own = np.argmax(part @ c.T - (c ** 2).sum(1) / 2, 1)
            used = np.unique(own)
            c = np.stack([part[own == k].mean(0) for k in used])
        own = np.argmax(part @ c.T - (c ** 2).sum(1) / 2, 1)
        used = np.unique(own)
        if len(used) < 2:  # equal vectors: nothing to split
            continue
        for k in used:
            children[node].append(len(centres))
            todo.append((len(centres), rows[own == k]))
            centres.append(c[k])
            children.append([])
    return Tree(np.array(centres), children)


def _matrix(column, dim: int) -> np.ndarray:
    arr = one_array(column)
    return np.asarray(arr.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(arr), dim)


def exact_product(a: np.ndarray, b: np.ndarray) -> float:
    """The inner product rounded once: products of single-precision numbers are exact in double."""
    return math.fsum((a * b).tolist())


def top_of(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int,
           leaf: np.ndarray | None = None, visited: np.ndarray | None = None):
    """(query index, row index, score) of each query's ``k`` best rows, ties to the smaller id, its own id left out.

    With ``leaf`` (of each row) and ``visited`` (queries x leaves) a query sees
    only rows of leaves that it visits. Equal vectors, which share a leaf, count
    as one during the search; of them only the smallest ids can matter, ``k`` and as many as rows share a query's id.
    """
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    most = k + max(1, int((np.searchsorted(ids, query_ids, "right") - np.searchsorted(ids, query_ids, "left")).max(initial=0)))
    unique, first, group = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    by = np.argsort(group, kind="stable")
    begin = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(unique)))])
    members = [by[begin[g]:min(begin[g + 1], begin[g] + most)] for g in range(len(unique))]
    home = leaf[order][first] if leaf is not None else None
    picked = []
    for lo in range(0, len(queries), 256):
        among = np.arange(len(unique))
        if home is not None:  # only rows that one of these queries visits
            among = among[visited[lo:lo + 256].any(0)[home]]
        if not len(among):
            continue
        s = queries[lo:lo + 256] @ unique[among].T
        if home is not None:
            s[~visited[lo:lo + 256][:, home[among]]] = -np.inf
        take = min(len(among), most)
        least = np.partition(s, len(among) - take, 1)[:, len(among) - take]
        floor = np.maximum(least - 1e-9 * (1 + np.abs(least)), -1e300)
        for j, g in zip(*np.nonzero(s >= floor[:, None])):
            score = exact_product(queries[lo + j], unique[among[g]])
            picked += [(lo + int(j), -score, int(ids[m]), int(order[m])) for m in members[among[g]]
                       if ids[m] != query_ids[lo + j]]
    picked.sort()
    out, last, n = [], -1, 0
    for j, score, _, m in picked:
        n = n + 1 if j == last else 1
        last = j
        if n <= k:
            out.append((j, m, -score))
    return out


@dataclass
class Index:
    """The indexed rows (id, leaf, vector), the tree, the rows of each leaf, and the calibrated visits."""

    rows: DataFrame
    tree: Tree
    dim: int
    sizes: np.ndarray
    visits: int = 0
    recall: float = 0.0


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, vector as doubles) of the rows that take part, and their dimension."""
    v = F.col("vector")
    odd = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
            .where(F.col("vec_id").isNotNull() & v.isNotNull() & ~odd & F.exists(v, lambda e: e != 0)))
    sizes = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (rows.where(F.size(v) == sizes["n"]), int(sizes["n"])) if sizes else (rows, 0)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                sample_rows: int = SAMPLE_ROWS) -> Index | None:
    """Fits the tree on at most ``sample_rows`` rows and indexes every row that takes part.

    Null ids and vectors that are null, empty, zero or hold null or non-finite
    parts take no part; nor do vectors whose length differs from the most
    frequent one. None if no row is left.
    """
    rows, dim = usable(vectors, id_col, vector_col)
    if not dim:
        return None
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector").toArrow()
    tree = fit_tree(_matrix(sample.column("vector"), dim))
    shared = rows.sparkSession.sparkContext.broadcast(tree)  # bounded by the sample

    def assign(stream):
        for batch in stream:
            leaf = shared.value.descend(_matrix(batch.column("vector"), dim))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(leaf), batch.column("vector")],
                                             names=["vec_id", "leaf", "vector"])

    indexed = written(rows.mapInArrow(assign, "vec_id long, leaf long, vector array<double>"))
    sizes = np.zeros(len(tree.leaf_of), np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # one row per leaf
        sizes[r["leaf"]] = r["count"]
    return Index(indexed, tree, dim, sizes)


def calibrate(index: Index, queries: DataFrame, k: int, target: float, most: int = CALIBRATION) -> Index:
    """Sets the smallest number of leaf visits that finds a share of ``target`` of the true neighbours.

    At most ``most`` queries are compared with every indexed row, partition by partition.
    """
    chosen = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toArrow()
    dim = index.dim
    q, ids = _matrix(chosen.column("vector"), dim), chosen.column("vec_id").to_numpy()

    def compare(stream):
        for batch in stream:
            x = _matrix(batch.column("vector"), dim)
            own, leaf = batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
            rows = [(a, own[b], s, leaf[b]) for a, b, s in top_of(q, ids, x, own, k)] if len(x) else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["q", "vec_id", "s", "leaf"])

    best = Window.partitionBy("q").orderBy(F.desc("s"), "vec_id")
    found = (index.rows.mapInArrow(compare, "q long, vec_id long, s double, leaf long")
             .withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("q", "leaf").collect())
    place = [{leaf: n for n, leaf in enumerate(order, 1)} for order in index.tree.best_bins(q, len(index.sizes))]
    needed = sorted(place[r["q"]][r["leaf"]] for r in found)
    index.visits = needed[max(0, math.ceil(target * len(needed)) - 1)] if needed else 1
    index.recall = sum(n <= index.visits for n in needed) / len(needed) if needed else 1.0
    return index


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """Each query's ``k`` nearest found: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``; ties to the smaller id.

    ``queries`` has ``vec_id`` and ``vector``; rows with a query's own id are no candidates for it. Every query row is a
    query of its own: an id that two rows have is answered twice, with ``k`` neighbours each.
    """
    spark = index.rows.sparkSession
    # cells of neighbouring leaves with a bounded number of rows; a larger leaf has several cells of its own
    cell_of, split = np.zeros(len(index.sizes), np.int64), np.ones(len(index.sizes), np.int64)
    cell = filled = 0
    for leaf, n in enumerate(index.sizes.tolist()):
        if n > CELL_ROWS:
            split[leaf] = math.ceil(n / CELL_ROWS)
            cell += bool(filled)
            cell_of[leaf], cell, filled = cell, cell + split[leaf], 0
            continue
        if filled and filled + n > CELL_ROWS:
            cell, filled = cell + 1, 0
        cell_of[leaf], filled = cell, filled + n
    shared = spark.sparkContext.broadcast((index.tree, cell_of, split))
    visits, dim = index.visits, index.dim

    def walk(stream):
        tree, cells, parts = shared.value
        for batch in stream:
            ids, vectors, own = batch.column("vec_id"), batch.column("vector"), batch.column("row")
            rows = []
            for n, leaves in enumerate(tree.best_bins(_matrix(vectors, dim), visits)):
                by: dict[int, list[int]] = {}
                for leaf in leaves:
                    for part in range(int(parts[leaf])):
                        by.setdefault(int(cells[leaf]) + part, []).append(leaf)
                rows += [(c, n, leaves_of) for c, leaves_of in by.items()]
            if rows:
                c, n, leaves = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()), own.take(pa.array(n)), ids.take(pa.array(n)), vectors.take(pa.array(n)),
                     pa.array(leaves, pa.list_(pa.int64()))], names=["cell", "row", "query_id", "vector", "leaves"])

    asked = written(queries.select("vec_id", "vector", F.monotonically_increasing_id().alias("row")).mapInArrow(
        walk, "cell long, row long, query_id long, vector array<double>, leaves array<long>"))
    # rows of a cell that many queries visit are repeated for each sheet of its queries
    sheets = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).alias("sheets"))
    asked = asked.join(sheets, "cell").withColumn("sheet", F.pmod(F.xxhash64("row"), F.col("sheets"))).drop("sheets")

    def place(stream):
        _, cells, parts = shared.value
        for batch in stream:
            leaf, ids = batch.column("leaf").to_numpy(), batch.column("vec_id").to_numpy()
            spread = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            cell = cells[leaf] + (spread % parts[leaf].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns], names=["cell", *batch.schema.names])

    rows = index.rows.mapInArrow(place, "cell long, vec_id long, leaf long, vector array<double>")
    # a cell that no query visits has no sheets, and its rows go no further
    rows = (rows.join(sheets, "cell").withColumn("sheet", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sheets") - 1)))
            .select("cell", "sheet", "vec_id", "leaf", "vector"))
    result = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def meet(left, right):
        rows = []
        if left.num_rows and right.num_rows:
            q, x = _matrix(left.column("vector"), dim), _matrix(right.column("vector"), dim)
            qid, xid = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
            row = left.column("row").to_numpy()
            names, leaf = np.unique(right.column("leaf").to_numpy(), return_inverse=True)
            wanted = one_array(left.column("leaves"))
            own = np.repeat(np.arange(len(q)), np.diff(wanted.offsets.to_numpy()))
            asked_leaf = wanted.flatten().to_numpy()
            here = np.isin(asked_leaf, names)
            visited = np.zeros((len(q), len(names)), bool)
            visited[own[here], np.searchsorted(names, asked_leaf[here])] = True
            near = np.argsort(visited.argmax(1), kind="stable")  # queries that begin alike share a matrix
            rows = [(int(row[near[a]]), int(qid[near[a]]), int(xid[b]), s)
                    for a, b, s in top_of(q[near], qid[near], x, xid, k, leaf, visited[near])]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), result)] if rows
                                    else [pa.array([], f.type) for f in result], schema=result)

    met = (asked.groupBy("cell", "sheet").cogroup(rows.groupBy("cell", "sheet"))
           .applyInArrow(meet, "row long, query_id long, vec_id long, score double"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def nearest(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            query_filter=None, target: float = 0.95, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Indexes all vectors, calibrates, and searches for the rows that ``query_filter`` selects (all by default)."""
    index = build_index(vectors, id_col, vector_col, sample_rows)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = index.rows.select("vec_id", "vector")
    if query_filter is not None:
        queries = queries.where(query_filter)
    return search(calibrate(index, queries, k, target), queries, k)
