"""Approximate nearest neighbours by a hierarchical k-means tree.

The upper tree is fitted on a bounded sample (``fit_rows``); every row is indexed, in its leaf. A leaf that holds more than
``leaf_most`` rows gets a tree of its own, fitted in a task on a bounded sample of its rows (``sub_rows``), so that bins have
about the same rows at every size of the table, and a query's work does not grow with it. A query descends
best-bin-first: a priority queue holds the branches not taken by their distance, and leaves come out
nearest first; in leaves with trees of their own the bins come out the same way, and the nearest bins of all opened leaves
are searched. How many leaves a query opens and how many bins it searches is widened until a calibration set of
queries, answered exactly against all rows, reaches ``recall``. Bins are searched in blocks of bounded rows; each block
gives a query its nearest ``k``, so what is merged is ``k`` rows a block.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; a distance needs
two vectors of one length, so that where lengths differ those of the commonest length (ties: the longer) are searched; ties go to the smaller id; equal rows are rows of their own (a
query leaves out only rows with its own id); rows without id take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Stages, map_arrow


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return np.unique(centres, axis=0)


class Tree:
    """Nodes as lists of (centres, children); a child is a node's number or, below 0, ~leaf."""

    def __init__(self, x: np.ndarray, branch: int, leaf_rows: int, seed: int):
        self.nodes: list[tuple[np.ndarray, list[int]]] = []
        self.leaves = 0
        self.rng = np.random.default_rng(seed)
        self.root = self.grow(x, branch, leaf_rows)

    def grow(self, x: np.ndarray, branch: int, leaf_rows: int) -> int:
        centres = kmeans(x, branch, self.rng) if len(x) > leaf_rows else x[:0]
        if len(centres) < 2:
            self.leaves += 1
            return ~(self.leaves - 1)
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        used = np.unique(near)
        if len(used) < 2:
            self.leaves += 1
            return ~(self.leaves - 1)
        at = len(self.nodes)
        self.nodes.append((centres[used], []))
        for j in used:
            self.nodes[at][1].append(self.grow(x[near == j], branch, leaf_rows))
        return at

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.root)
        while (todo := np.unique(out[out >= 0])).size:
            for node in todo:
                rows = np.flatnonzero(out == node)
                centres, children = self.nodes[node]
                near = ((centres**2).sum(1) - 2 * x[rows] @ centres.T).argmin(1)
                out[rows] = np.array(children)[near]
        return ~out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves of a best-bin-first descent."""
        return [leaf for _, leaf in self.ordered(q, most)]

    def ordered(self, q: np.ndarray, most: int) -> list[tuple[float, int]]:
        """The first ``most`` leaves of a best-bin-first descent, each with the distance (squared) of the branch that led to it."""
        queue, out = [(0.0, self.root)], []
        while queue and len(out) < most:
            far, node = heapq.heappop(queue)
            while node >= 0:
                centres, children = self.nodes[node]
                distance = ((centres - q) ** 2).sum(1)
                best = int(distance.argmin())
                for j, child in enumerate(children):
                    if j != best:
                        heapq.heappush(queue, (float(distance[j]), child))
                node = children[best]
                far = max(far, float(distance[best]))
            out.append((far, ~node))
        return out


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[list, list, list]:
    """The ``k`` nearest rows of a block for each query: query ids, row ids, distances."""
    out: tuple[list, list, list] = ([], [], [])
    x = np.ascontiguousarray(x)
    for i, own in enumerate(q_ids):
        distance = np.sqrt(((x - q[i]) ** 2).sum(axis=1))
        if len(ids) > 4 * k:
            edge = np.partition(distance, k)[k]  # one more than k, for the query's own row
            near = np.flatnonzero(distance <= edge)
        else:
            near = np.arange(len(ids))
        near = near[ids[near] != own]
        near = near[np.lexsort((ids[near], distance[near]))[:k]]
        out[0].extend([own] * len(near))
        out[1].extend(ids[near])
        out[2].extend(distance[near])
    return out


BLOCK = "query_id long, vec_id long, score double"


def search_blocks(jobs: DataFrame, rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """Each block of ``rows`` against the queries of ``jobs`` with the same ``by``; merged to the ``k`` nearest a query."""

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            got = ([], [], [])
        else:
            q, x = (np.array(t.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(t.num_rows, -1) for t in (left, right))
            got = nearest(left.column("id").to_numpy(), q, right.column("id").to_numpy(), x, k)
        return pa.table({"query_id": pa.array(got[0], pa.int64()), "vec_id": pa.array(got[1], pa.int64()), "score": pa.array(got[2], pa.float64())})

    found = jobs.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(search, BLOCK)
    best = F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k)
    return found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def search(df: DataFrame, queries, *, key: str = "vec_id", vector: str = "embedding", k: int = 10, recall: float = 0.97, fit_rows: int = 20_000, branch: int = 8, leaf_rows: int = 100, block_rows: int = 4_000, leaf_most: int = 4_000, sub_rows: int = 100_000, tried: int = 64, seed: int = 3) -> DataFrame:
    """The ``k`` nearest rows found for each row that the condition ``queries`` (on ``id``) picks.

    ``fit_rows`` bounds the sample that the upper tree is fitted on, ``sub_rows`` that of a large leaf's tree, ``tried`` the calibration
    queries; all are chosen by a hash of the id.
    """
    spark, stages = df.sparkSession, Stages(df.sparkSession, "ann")
    vectors = valid_vectors(df, key, vector)
    hashed = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30))
    common = vectors.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors, n = vectors.where(F.size("v") == common["w"]), common["count"]
    share = min(1.0, fit_rows / n)
    sample = [r["v"] for r in vectors.where(hashed < int((1 << 30) * share)).limit(2 * fit_rows).collect()]
    sample = sample or [r["v"] for r in vectors.orderBy(hashed, "id").limit(fit_rows).collect()]
    x = np.array(sample)
    x = x[np.lexsort(x.T)]
    tree = Tree(x, branch, leaf_rows, seed)
    shared = spark.sparkContext.broadcast(tree)

    def place():
        tree = shared.value

        def step(batch):
            v = np.array(batch.column("v").flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(tree.leaf_of(v), pa.int32())], ["id", "v", "leaf"])

        return step

    rows = map_arrow(vectors, place, "id long, v array<double>, leaf int")
    rows = stages.keep(rows, "rows")
    asked = rows.where(queries)
    # a row a leaf, and there are fewer leaves than rows of the sample
    held = {r["leaf"]: r["count"] for r in rows.groupBy("leaf").count().collect()}
    large = {leaf: c for leaf, c in held.items() if c > leaf_most}
    trees = stages.keep(grown(rows, large, hashed, sub_rows, leaf_most, branch, seed), "trees") if large else None
    stored = stages.keep(binned(rows, trees, large, block_rows), "stored") if large else rows.withColumn("bin", F.lit(0))
    # bins that need more than one block, such as one of many equal vectors: n / block_rows rows at most, mostly none
    full = stages.keep(stored.groupBy("leaf", "bin").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("salts")).where("salts > 1"), "full")
    full = F.broadcast(full) if full.count() <= 100_000 else full

    def visiting(q: DataFrame, most: int) -> DataFrame:
        def make():
            tree = shared.value

            def step(batch):
                v = np.array(batch.column("v").flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
                leaves = [tree.visits(p, most) for p in v]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(leaves, pa.list_(pa.int32()))], ["id", "v", "leaves"])

            return step

        visited = map_arrow(q.select("id", "v"), make, "id long, v array<double>, leaves array<int>")
        return visited.select("id", "v", F.posexplode("leaves").alias("turn", "leaf"))

    # Calibration: exact answers for a few queries, the leaf of each answer, and the turn at which a query comes to that leaf.
    n_asked = asked.count()
    some = asked.where(hashed < int((1 << 30) * min(1.0, tried / max(1, n_asked))))
    everywhere = max(1, -(-n // block_rows))
    spread = F.pmod(F.xxhash64("id"), F.lit(everywhere)).cast("int")
    truth = search_blocks(some.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(everywhere - 1))).alias("salt")), rows.withColumn("salt", spread), ["salt"], k)
    turns = visiting(some, tree.leaves).select(F.col("id").alias("query_id"), "turn", "leaf")
    reached = truth.join(rows.select(F.col("id").alias("vec_id"), "leaf").distinct(), "vec_id").join(turns, ["query_id", "leaf"]).groupBy("turn").count().collect()
    by_turn = np.zeros(tree.leaves)
    for r in reached:
        by_turn[r["turn"]] += r["count"]
    most = first_to(by_turn, (1 + recall) / 2 if large else recall)
    if large:
        opened = visiting(some, most)
        order = ranked(bin_order(opened, trees, large, None))
        found = truth.join(stored.select(F.col("id").alias("vec_id"), "leaf", "bin").distinct(), "vec_id").join(order.withColumnRenamed("id", "query_id"), ["query_id", "leaf", "bin"]).groupBy("turn").count().collect()
        by_bin = np.zeros(max((r["turn"] + 1 for r in found), default=1))
        for r in found:
            by_bin[r["turn"]] += r["count"]
        searched = first_to(by_bin, min(1.0, recall * by_turn.sum() / by_bin.sum())) if by_bin.sum() else 1 << 30
        chosen = ranked(bin_order(visiting(asked, most), trees, large, searched)).where(F.col("turn") < searched)
        jobs = chosen.join(asked.select("id", "v"), "id")
    else:
        jobs = visiting(asked, most).withColumn("bin", F.lit(0))
    salts = F.coalesce("salts", F.lit(1))
    jobs = jobs.join(full, ["leaf", "bin"], "left").select("id", "v", "leaf", "bin", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    blocks = stored.join(full, ["leaf", "bin"], "left").select("id", "v", "leaf", "bin", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
    return search_blocks(jobs, blocks, ["leaf", "bin", "salt"], k)


def first_to(by_turn: np.ndarray, share: float) -> int:
    """How many turns reach this share of what all turns reach."""
    return min(len(by_turn), int(np.searchsorted(np.cumsum(by_turn), share * by_turn.sum() - 1e-9)) + 1) if by_turn.sum() else len(by_turn)


def matrix(table: pa.Table) -> np.ndarray:
    return np.array(table.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(table.num_rows, -1)


def grown(rows: DataFrame, large: dict[int, int], hashed, sub_rows: int, leaf_most: int, branch: int, seed: int) -> DataFrame:
    """(leaf, tree): a tree for each large leaf, fitted on at most about ``sub_rows`` of its rows."""
    shares = rows.sparkSession.createDataFrame([(leaf, min(1.0, sub_rows / c), c) for leaf, c in large.items()], "leaf int, share double, c long")
    sample = rows.join(F.broadcast(shares), "leaf").where(hashed < F.col("share") * (1 << 30))

    def fit(table: pa.Table) -> pa.Table:
        x = matrix(table)
        x = x[np.lexsort(x.T)]
        per_bin = max(4, int(leaf_most * len(x) / table.column("c")[0].as_py()))
        return pa.table({"leaf": table.column("leaf").slice(0, 1), "tree": pa.array([pickle.dumps(Tree(x, branch, per_bin, seed))], pa.binary())})

    return sample.groupBy("leaf").applyInArrow(fit, "leaf int, tree binary")


def with_trees(rows: DataFrame, trees: DataFrame, large: dict[int, int], per_task: int, fn, schema: str) -> DataFrame:
    """``fn(tree, rows)`` for groups of about ``per_task`` rows of each large leaf, however many rows a leaf has."""
    parts = rows.sparkSession.createDataFrame([(leaf, -(-c // per_task)) for leaf, c in large.items()], "leaf int, parts int")
    left = rows.join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    right = trees.join(F.broadcast(parts), "leaf").select("leaf", "tree", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    empty = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema).empty_table()

    def run(key, mine: pa.Table, tree: pa.Table) -> pa.Table:
        return fn(pickle.loads(tree.column("tree")[0].as_py()), mine) if mine.num_rows and tree.num_rows else empty

    return left.groupBy("leaf", "part").cogroup(right.groupBy("leaf", "part")).applyInArrow(run, schema)


def binned(rows: DataFrame, trees: DataFrame, large: dict[int, int], block_rows: int) -> DataFrame:
    """``rows`` with the bin of their leaf (0 where a leaf has no tree)."""

    def place(tree: Tree, mine: pa.Table) -> pa.Table:
        return pa.table({"id": mine.column("id"), "v": mine.column("v"), "leaf": mine.column("leaf"), "bin": pa.array(tree.leaf_of(matrix(mine)), pa.int32())})

    small = rows.where(~F.col("leaf").isin(*large)).withColumn("bin", F.lit(0))
    return small.unionByName(with_trees(rows, trees, large, 10 * block_rows, place, "id long, v array<double>, leaf int, bin int"))


def bin_order(opened: DataFrame, trees: DataFrame, large: dict[int, int], most: int | None) -> DataFrame:
    """(id, leaf, bin, first, far): the bins of the opened leaves (id, v, turn, leaf), for each leaf in the order of its tree, ``most`` at most."""

    def visit(tree: Tree, mine: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [], [])
        for i, turn, leaf, v in zip(mine.column("id").to_pylist(), mine.column("turn").to_pylist(), mine.column("leaf").to_pylist(), matrix(mine), strict=True):
            for far, b in tree.ordered(v, tree.leaves if most is None else most):
                for column, value in zip(out, (i, leaf, b, turn, far), strict=True):
                    column.append(value)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("id", "leaf", "bin", "first", "far"), out, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)})

    alone = opened.where(~F.col("leaf").isin(*large)).select("id", "leaf", F.lit(0).alias("bin"), F.col("turn").alias("first"), F.lit(0.0).alias("far"))
    asked = dict.fromkeys(large, 1) if most is None else large
    return alone.unionByName(with_trees(opened, trees, asked, 20_000, visit, "id long, leaf int, bin int, first int, far double"))


def ranked(bins: DataFrame) -> DataFrame:
    """(id, leaf, bin, turn): each query's bins, nearest first; a query's bins are as many as its leaves allow."""
    near = F.array_sort(F.collect_list(F.struct("far", "first", "leaf", "bin")))
    return bins.groupBy("id").agg(near.alias("b")).select("id", F.posexplode("b").alias("turn", "x")).select("id", "turn", "x.leaf", "x.bin")


def op8_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 100 = 0")
