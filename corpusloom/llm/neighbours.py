"""Problem 3: the most similar vectors of every vector.

A forest of random-projection trees is fitted on bounded samples, first the
tops and then, in Spark, every leaf that holds too much, and sent to all tasks.
Every vector is filed under one leaf of each tree; a search walks all trees
with one shared priority queue, in which a leaf's priority is its worst
wrong-side margin on the way down.  Vectors and searches meet in the leaves,
where similarities are computed in blocks and reranked exactly.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut

#: Vectors at most on which the tops of the trees are fitted, and on which one overfull leaf is split; all vectors are indexed.
SAMPLE, LEAF_DRAWN = 20_000, 4096
#: Vectors that a leaf is meant to hold, and holds at most, and the fewest of a sample in one.
LEAF, MOST, LEAF_SAMPLE = 2048, 4096, 24
#: Bytes of the forest at most, which is sent to all tasks; beyond it leaves are taken in blocks.
FOREST_BYTES = 256_000_000
#: Trees, and leaves that one search visits over all trees together.
TREES, VISITS = 3, 5
#: Searches of one leaf that one task takes at most, and compares at a time; vectors that walk the forest at a time.
SEARCHES, BLOCK, AT_ONCE = 16_384, 2048, 2048
#: Digits to which similarities are told apart.
DIGITS = 9


def unit_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, look, vec): the usable vectors at length 1 as bytes of float32; ``look`` is equal for copies.

    Null vectors, those with null, NaN or infinite parts and zero vectors are
    left out, as are vectors whose number of parts isn't the commonest one.
    """
    known = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    known = known.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("id").to_numpy(zero_copy_only=False), batch.column("vector")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.append(0, np.cumsum(sizes))
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                v = flat[starts[rows][:, None] + np.arange(size)]
                norm = np.sqrt(np.einsum("ij,ij->i", v, v))
                good = np.isfinite(norm) & (norm > 0)
                v = (v[good] / norm[good, None]).astype(np.float32)
                looks = [hashlib.md5(x.tobytes()).digest() for x in np.round(v, 5) + np.float32(0)]
                yield pa.RecordBatch.from_pydict({"id": ids[rows[good]], "size": np.full(len(v), size, np.int32), "look": looks, "vec": [x.tobytes() for x in v]}, schema=made)

    made = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("look", pa.binary()), ("vec", pa.binary())])
    return known.mapInArrow(run, "id long, size int, look binary, vec binary")


def _matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float32).reshape(len(vectors), dim)


def _plane(points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """A hyperplane between two random points, drawn to the middle of what is nearer to each, through the median."""
    a, b = points[rng.choice(len(points), 2, replace=False)]
    for _ in range(3):
        near = points @ (a - b) > (a @ a - b @ b) / 2
        if near.all() or not near.any():
            break
        a, b = points[near].mean(0), points[~near].mean(0)
    normal = a - b
    if not np.any(normal):
        normal = rng.standard_normal(points.shape[1])
    normal = (normal / np.linalg.norm(normal)).astype(np.float32)
    return normal, float(np.median(points @ normal))


def grow(points: np.ndarray, each: float, rng: np.random.Generator, leaf: int, few: int) -> list[tuple]:
    """Nodes (normal, offset, left, right) of a tree over ``points``, each of which stands for ``each`` vectors; leaves have no normal.

    Nodes are split until they stand for ``leaf`` vectors or both halves would hold under ``few`` points.
    """
    nodes: list[tuple] = [()]
    open_ = [(0, np.arange(len(points)))]
    while open_:
        node, rows = open_.pop()
        nodes[node] = (None, 0.0, -1, -1)
        if len(rows) * each <= leaf or len(rows) < 2 * few:
            continue
        normal, offset = _plane(points[rows], rng)
        right = points[rows] @ normal > offset
        if right.any() and not right.all():
            nodes[node] = (normal, offset, len(nodes), len(nodes) + 1)
            nodes += [(), ()]
            open_ += [(len(nodes) - 2, rows[~right]), (len(nodes) - 1, rows[right])]
    return nodes


class Forest:
    """Trees of hyperplanes in flat arrays; a node without children is a leaf, known by its number."""

    def __init__(self, dim: int):
        self.normal, self.offset = np.zeros((0, dim), np.float32), np.zeros(0, np.float32)
        self.left, self.right, self.roots = np.zeros(0, np.int32), np.zeros(0, np.int32), []

    def plant(self, nodes: list[tuple], at: int | None = None) -> None:
        """Adds a tree, or puts it in place of the leaf ``at``."""
        start, dim = len(self.offset), self.normal.shape[1]
        if at is None:
            self.roots.append(start)
        else:
            root, nodes, start = nodes[0], nodes[1:], start - 1  # its root takes the leaf's place
            self.normal[at], self.offset[at], self.left[at], self.right[at] = root[0], root[1], root[2] + start, root[3] + start
        self.normal = np.concatenate([self.normal, np.array([n[0] if n[0] is not None else np.zeros(dim) for n in nodes], np.float32).reshape(-1, dim)])
        self.offset = np.append(self.offset, np.array([n[1] for n in nodes], np.float32))
        for name, i in (("left", 2), ("right", 3)):
            setattr(self, name, np.append(getattr(self, name), np.array([n[i] + start if n[i] >= 0 else -1 for n in nodes], np.int32)))

    def visits(self, vectors: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
        """(leaves, own): the leaves that each search visits over all trees (-1 for none), and which are its own.

        All trees share one queue.  A leaf's priority is the worst wrong-side
        margin on the way to it, which never falls on the way down and stays the
        same on one side of each split; so the best ``many`` nodes of a level
        lead to the best ``many`` leaves.  A search's own leaves come first.
        """
        wide = max(many, len(self.roots))
        node, cost = np.full((len(vectors), wide), -1, np.int32), np.full((len(vectors), wide), np.inf, np.float32)
        node[:, : len(self.roots)], cost[:, : len(self.roots)] = self.roots, -1
        while (inner := (node >= 0) & (self.left[node] >= 0)).any():
            q, s = np.nonzero(inner)
            at = node[q, s]
            margin = np.einsum("ij,ij->i", vectors[q], self.normal[at]) - self.offset[at]
            side = margin > 0
            other, worse = np.full_like(node, -1), np.full_like(cost, np.inf)
            node[q, s] = np.where(side, self.right[at], self.left[at])
            other[q, s] = np.where(side, self.left[at], self.right[at])
            worse[q, s] = np.maximum(cost[q, s], np.abs(margin))
            node, cost = np.concatenate([node, other], axis=1), np.concatenate([cost, worse], axis=1)
            best = np.argpartition(cost, wide - 1, axis=1)[:, :wide]
            node, cost = np.take_along_axis(node, best, 1), np.take_along_axis(cost, best, 1)
        return node, cost < 0


def _drawn(heads: DataFrame, share: Column) -> DataFrame:
    """Rows of ``heads``, ``share`` of them, drawn by their look."""
    return heads.where(F.pmod(F.xxhash64("look"), F.lit(1_000_000)) < share * 1_000_000)


def _visited(heads: DataFrame, forest: Forest, dim: int, visits: int) -> dict[int, tuple[int, int]]:
    """By leaf, how many vectors are filed in it and how many searches visit it, counted over all rows."""
    shared = heads.sparkSession.sparkContext.broadcast(forest)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed, asked = np.zeros((2, len(shared.value.offset)), np.int64)
        for batch in batches:
            vectors = _matrix(batch.column("vec").to_pylist(), dim)
            for start in range(0, len(vectors), AT_ONCE):
                leaf, own = shared.value.visits(vectors[start : start + AT_ONCE], visits)
                filed += np.bincount(leaf[own], minlength=len(filed))
                asked += np.bincount(leaf[leaf >= 0], minlength=len(asked))
        at = np.flatnonzero(asked)
        yield pa.RecordBatch.from_pydict({"leaf": pa.array(at, pa.int32()), "filed": filed[at], "asked": asked[at]})

    counts = heads.select("vec").mapInArrow(count, "leaf int, filed long, asked long").groupBy("leaf").agg(F.sum("filed").alias("filed"), F.sum("asked").alias("asked"))
    return {r["leaf"]: (r["filed"], r["asked"]) for r in counts.collect()}  # leaves, whose number FOREST_BYTES bounds


def fit_forest(heads: DataFrame, dim: int, total: int, trees: int = TREES, visits: int = VISITS, seed: int = 7) -> tuple[Forest, dict[int, tuple[int, int]]]:
    """A forest whose leaves hold MOST vectors at most, and what is in them.

    The tops of the trees are fitted on one bounded sample.  Leaves that turn
    out overfull are split in Spark, each on a bounded sample of its own, until
    none is left, or none that can be split or that FOREST_BYTES has room for.
    """
    some = _drawn(heads, F.lit(min(1.0, SAMPLE / total))).select("vec").limit(SAMPLE + SAMPLE // 10).collect()  # the documented sample
    sample = _matrix(sorted(r["vec"] for r in some), dim)
    forest = Forest(dim)
    for t in range(trees):
        forest.plant(grow(sample, total / max(1, len(sample)), np.random.default_rng([seed, t]), LEAF, LEAF_SAMPLE))
    counts, whole = _visited(heads, forest, dim, visits), set()
    room = FOREST_BYTES // (4 * (dim + 3))
    while True:
        over = {leaf: filed for leaf, (filed, _) in counts.items() if filed > MOST and leaf not in whole}
        if not over or len(forest.offset) + sum(4 * f // LEAF for f in over.values()) > room:
            return forest, counts
        sent = heads.sparkSession.sparkContext.broadcast((forest, over))

        def own(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            forest, over = sent.value
            share = np.zeros(len(forest.offset))
            share[list(over)] = [LEAF_DRAWN / f for f in over.values()]
            for batch in batches:
                vec = batch.column("vec")
                vectors = _matrix(vec.to_pylist(), dim)
                draw = np.frombuffer(b"".join(x[:8] for x in batch.column("look").to_pylist()), np.uint64) / 2.0**64
                for start in range(0, len(vectors), AT_ONCE):
                    leaf = forest.visits(vectors[start : start + AT_ONCE], len(forest.roots))[0]
                    q, s = np.nonzero(share[leaf] > draw[start : start + AT_ONCE, None])
                    yield pa.RecordBatch.from_arrays([pa.array(leaf[q, s], pa.int32()), vec.take(pa.array(q + start))], ["leaf", "vec"])

        def split(rows: pd.DataFrame) -> pd.DataFrame:
            leaf = int(rows["leaf"].iloc[0])
            points = _matrix(sorted(rows["vec"]), dim)
            return pd.DataFrame({"leaf": [leaf], "nodes": [pickle.dumps(grow(points, over[leaf] / len(points), np.random.default_rng([seed, leaf]), LEAF, LEAF_SAMPLE))]})

        grown = heads.select("look", "vec").mapInArrow(own, "leaf int, vec binary").groupBy("leaf").applyInPandas(split, "leaf int, nodes binary")
        trees_at = {r["leaf"]: pickle.loads(r["nodes"]) for r in grown.collect()}  # bounded by FOREST_BYTES
        whole |= {leaf for leaf in over if len(trees_at.get(leaf, ())) < 2}
        if not over.keys() - whole:
            return forest, counts
        for leaf in sorted(over.keys() - whole):
            forest.plant(trees_at[leaf], leaf)
        counts = _visited(heads, forest, dim, visits)


def _leaf_pairs(rows: pd.DataFrame, dim: int, k: int, least: float) -> pd.DataFrame:
    """The best ``k`` of a leaf's vectors for each search in it, by similarity rounded and then by id."""
    vectors = _matrix(rows["vec"].tolist(), dim)
    ids, filed = rows["id"].to_numpy(), rows["filed"].to_numpy()
    asked = np.flatnonzero(rows["asks"].to_numpy())
    filed, filed_ids = vectors[filed], ids[filed]
    found = [pd.DataFrame({"id": ids[:0], "other": ids[:0], "similarity": np.zeros(0)})]
    for start in range(0, len(asked), BLOCK):
        these = asked[start : start + BLOCK]
        near = vectors[these] @ filed.T
        q, f = np.nonzero(near >= least - 1e-4)
        apart = ids[these][q] != filed_ids[f]
        q, f = q[apart], f[apart]
        exact = np.round(np.einsum("ij,ij->i", vectors[these][q].astype(np.float64), filed[f].astype(np.float64)), DIGITS)
        order = np.lexsort((filed_ids[f], -exact, q))
        q, f, exact = q[order], f[order], exact[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = (place < k) & (exact >= least)
        found.append(pd.DataFrame({"id": ids[these][q[keep]], "other": filed_ids[f[keep]], "similarity": exact[keep]}))
    return pd.concat(found)


def nearest(df: DataFrame, key: str, vector: str, k: int = 5, least: float = -1.0, trees: int = TREES, visits: int = VISITS) -> DataFrame:
    """(id, other, similarity): for each row the ``k`` rows most similar to it by cosine, of at least ``least``.

    Equal similarities (to 9 digits) go by the smaller id.  Null and zero
    vectors, vectors with null, NaN or infinite parts, and vectors of another
    length than the commonest take no part.  Copies, also scaled ones, are
    searched once; their rows are told apart again at the end, for which the
    ``k`` + 1 smallest ids of each group suffice.  Ids must be unique.  An
    empty table gives no rows.
    """
    spark = df.sparkSession
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    sizes = df.where(usable).groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "id long, other long, similarity double")
    dim, total = sizes[0]["size"], sizes[0]["count"]
    points = unit_vectors(df, key, vector).where(F.col("size") == dim)
    by_id = Window.partitionBy("look").orderBy("id")
    some = points.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    heads = cut(some.groupBy("look").agg(F.min("id").alias("head"), F.sort_array(F.collect_list("id")).alias("ids"), F.min_by("vec", "id").alias("vec")))

    forest, counts = fit_forest(heads, dim, total, trees, visits)
    # a leaf's vectors and its searches are both taken in blocks of bounded size, each of one with each of the other
    files, asks = np.ones((2, len(forest.offset)), np.int32)
    for leaf, (filed, asked) in counts.items():
        files[leaf], asks[leaf] = -(-filed // MOST), -(-asked // SEARCHES)
    shared = spark.sparkContext.broadcast((forest, files, asks))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, files, asks = shared.value
        for batch in batches:
            vec, every = batch.column("vec"), batch.column("head").to_numpy(zero_copy_only=False)
            vectors = _matrix(vec.to_pylist(), dim)
            for start in range(0, len(every), AT_ONCE):
                leaf, own = forest.visits(vectors[start : start + AT_ONCE], visits)
                q, s = np.nonzero(leaf >= 0)
                leaf, own, ids = leaf[q, s], own[q, s], every[start + q]
                for block in range(int((files[leaf] * asks[leaf]).max(initial=1))):
                    filed = own & (block % files[leaf] == ids % files[leaf])
                    asking = block // files[leaf] == ids // 64 % asks[leaf]
                    at = np.flatnonzero((block < files[leaf] * asks[leaf]) & (filed | asking))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaf[at], pa.int32()), pa.array(np.full(len(at), block), pa.int32()), pa.array(filed[at]), pa.array(asking[at]), pa.array(ids[at]), vec.take(pa.array(start + q[at]))],
                        ["leaf", "block", "filed", "asks", "id", "vec"],
                    )

    met = heads.select("head", "vec").mapInArrow(meet, "leaf int, block int, filed boolean, asks boolean, id long, vec binary")
    near = met.groupBy("leaf", "block").applyInPandas(lambda rows: _leaf_pairs(rows, dim, k, least), "id long, other long, similarity double")
    best = near.groupBy("id").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("similarity")).alias("far"), "other"))), 1, k).alias("near"))

    # from heads back to rows
    edges = best.select(F.col("id").alias("head"), F.explode("near").alias("n")).select("head", F.col("n.other").alias("other_head"), (-F.col("n.far")).alias("similarity"))
    own = heads.where(F.size("ids") > 1).select("head", F.col("head").alias("other_head"), F.lit(1.0).alias("similarity"))
    members = heads.select(F.col("head").alias("other_head"), F.col("ids").alias("others"))
    targets = edges.unionByName(own).join(members, "other_head").select("head", "similarity", F.explode("others").alias("other"))
    rows = points.join(heads.select("look", "head"), "look").select("id", "head")
    ranked = rows.join(targets, "head").where("id <> other")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return ranked.withColumn("place", place).where(F.col("place") <= k).where(F.col("similarity") >= least).select("id", "other", "similarity")


def similar_pairs(df: DataFrame, key: str, vector: str, k: int = 5, least: float = 0.9) -> DataFrame:
    """(id_a, id_b), id_a < id_b: one of the two is among the ``k`` nearest of the other, at least ``least`` alike."""
    found = nearest(df, key, vector, k, least)
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
