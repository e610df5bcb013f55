"""Nearest neighbours by largest inner product with vantage-point trees.

Vectors of like length (within a factor of two) are dealt to shards by hash; each
shard is indexed by one tree. One more coordinate makes all vectors of a tree
equally long, so that the largest inner product is the smallest Euclidean
distance and the triangle inequality holds. A subtree is left out when the
query's distance to it, times `factor`, is above the distance of the k-th found.
Distances, which are rounded, only leave out what lies further than their error;
what is found is ranked by the exact inner products. So factor one is exact, and
a larger factor visits less."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, growing, partitions
from .blobs import pack, unpack

#: Neighbours, vectors of a shard and queries of a block (about), vectors of a leaf, the relaxation, and
#: products taken at once.
K, SHARD, BLOCK, LEAF, FACTOR, PRODUCTS = 20, 16_384, 2_048, 128, 1.0, 50_000
#: A relaxation that kept 0.999 of the neighbours of clustered unit vectors (tests hold it to 0.9) and
#: visited a tenth fewer vectors.
FASTER = 1.5


class Tree:
    """A vantage-point tree of one shard; nodes in arrays, vectors in leaf order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, nodes: np.ndarray | None = None, cuts: np.ndarray | None = None):
        self.ids, self.vectors = ids, vectors
        self.nodes, self.cuts = nodes, cuts
        x = vectors.astype(np.float64)
        norm2 = (x * x).sum(1)
        self.radius = float(np.sqrt(norm2.max()))
        self.lifted = np.concatenate([x, np.sqrt(np.maximum(0, self.radius**2 - norm2))[:, None]], 1)
        # Products of x and a unit vector are off by less than `error`, distances by less than `slack`.
        ulps = (x.shape[1] + 8) * np.finfo(np.float64).eps
        self.error, self.slack = 2 * ulps * self.radius, 3 * self.radius * np.sqrt(8 * ulps)
        if nodes is None:
            self._build()

    def _build(self) -> None:
        order, nodes, cuts = np.argsort(self.ids, kind="stable"), [], []
        rng = np.random.default_rng(5)
        todo = [(0, len(order))]
        index = {}
        while todo:  # each node: vantage place, children or -1, first, last; cuts: radii inside and outside
            a, b = todo.pop()
            index[a, b] = len(nodes)
            own = order[a:b]
            if b - a <= LEAF:
                nodes.append([-1, -1, -1, a, b])
                cuts.append([0.0, 0.0])
                continue
            v = own[rng.integers(len(own))]
            d = np.sqrt(((self.lifted[own] - self.lifted[v]) ** 2).sum(1))
            by = np.argsort(d, kind="stable")
            own, d = own[by], d[by]
            if d[-1] == 0:  # equal vectors: nothing to split
                nodes.append([-1, -1, -1, a, b])
                cuts.append([0.0, 0.0])
                continue
            m = a + len(own) // 2
            order[a:b] = own
            nodes.append([v, a, m, a, b])
            cuts.append([d[m - a - 1], d[m - a]])
            todo += [(a, m), (m, b)]
        for n in nodes:
            if n[0] >= 0:
                n[1], n[2] = index[n[3], n[2]], index[n[2], n[4]]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        nodes = np.array(nodes, np.int64).reshape(-1, 5)
        nodes[:, 0] = np.where(nodes[:, 0] >= 0, place[nodes[:, 0]], -1)
        self.ids, self.vectors, self.lifted = self.ids[order], self.vectors[order], self.lifted[order]
        self.nodes, self.cuts = nodes, np.array(cuts).reshape(-1, 2)

    def packed(self) -> bytes:
        return pack([self.ids, np.ascontiguousarray(self.vectors, "<f4").view("<u4").reshape(-1), np.array([self.vectors.shape[1]], "<i8"), self.nodes.reshape(-1), self.cuts.astype("<f8").view("<i8").reshape(-1)])

    @staticmethod
    def unpacked(blob: bytes) -> Tree:
        ids, vectors, dim, nodes, cuts = unpack(blob)
        return Tree(ids, vectors.view("<f4").reshape(-1, int(dim[0])), nodes.reshape(-1, 5), cuts.view("<f8").reshape(-1, 2))

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Places (-1: none) and inner products of each query's k nearest but
        itself, equal ones by id. Products are added up one component after the
        other in double precision."""
        q = queries.astype(np.float64)
        length = np.sqrt((q * q).sum(1))
        unit = q / np.maximum(length, 1e-300)[:, None]
        best = np.full((len(q), k), -np.inf)
        place = np.full((len(q), k), -1, np.int64)
        named = np.append(self.ids, np.iinfo(np.int64).max)
        self.seen = 0

        def leaf(a: int, b: int, rows: np.ndarray) -> None:
            x = self.vectors[a:b].astype(np.float64)
            about = unit[rows] @ x.T
            self.seen += about.size
            least = best[rows, -1] / length[rows]
            hit = (about >= (least - 2 * self.error)[:, None]) & (ids[rows][:, None] != self.ids[None, a:b])
            some = hit.any(1)
            rows, hit = rows[some], hit[some]
            if not len(rows):
                return
            exact = np.full(hit.shape, -np.inf)
            r, c = np.nonzero(hit)
            for i in range(0, len(r), PRODUCTS):
                own = slice(i, i + PRODUCTS)
                exact[r[own], c[own]] = _products(q[rows[r[own]]], x[c[own]])
            both = np.concatenate([best[rows], exact], 1)
            where = np.concatenate([place[rows], np.where(hit, np.arange(a, b), -1)], 1)
            top = np.lexsort((named[where], -both), axis=1)[:, :k]
            best[rows], place[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(where, top, 1)

        def visit(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            v, inside, outside, a, b = self.nodes[node]
            if v < 0:
                leaf(a, b, rows)
                return
            inner, outer = self.cuts[node]
            # Distances are those of queries as long as the radius, which have the same order.
            square = 2 * self.radius * (self.radius - unit[rows] @ self.lifted[v, :-1])
            d = np.sqrt(np.maximum(0, square))
            near = d <= (inner + outer) / 2
            visit(inside, rows[near])
            visit(outside, rows[~near])
            gap = np.maximum(0, np.where(near, outer - d, d - inner) - self.slack)
            far = np.sqrt(np.maximum(0, 2 * self.radius * (self.radius - best[rows, -1] / length[rows])))
            open_ = gap * factor <= far
            visit(outside, rows[near & open_])
            visit(inside, rows[~near & open_])

        visit(0, np.arange(len(q)))
        return place, best


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, one addition after the other."""
    return np.cumsum(x * y, axis=1)[:, -1]


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<float>")
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    out = out.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    # Lengths of float vectors lie in fewer than 300 octaves.
    length2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return out.withColumn("dim", F.size("v")).withColumn("octave", F.floor(F.log2(length2) / 2).cast("int"))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(-1, dim).astype(np.float32)


def _indexed(table: pa.Table) -> pa.Table:
    dim, octave, shard = (table.column(c)[0].as_py() for c in ("dim", "octave", "shard"))
    tree = Tree(table.column("vec_id").to_numpy(), _matrix(table.column("v"), dim))
    return pa.table({"dim": pa.array([dim], pa.int32()), "octave": pa.array([octave], pa.int32()), "shard": pa.array([shard], pa.int64()), "blob": pa.array([tree.packed()], pa.binary())})


def build_index(spark: SparkSession, vectors: DataFrame, scratch: Scratch, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(dim, octave, shard, blob): trees of all usable vectors; those of another
    dimension or length are apart. Shards have `shard` vectors, about, whatever
    the input's size. Nulls and unusable vectors are left out as in `nearest`;
    equal vectors and repeated ids are all indexed; an empty table gives no tree."""
    src = _usable(vectors, id_col, vec_col)
    # As many rows as octaves and dimensions.
    sizes = src.groupBy("dim", "octave").agg(F.ceil(F.count("*") / shard).cast("long").alias("shards"))
    dealt = src.join(F.broadcast(sizes), ["dim", "octave"]).withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("shards")))
    index = dealt.groupBy("dim", "octave", "shard").applyInArrow(_indexed, "dim int, octave int, shard long, blob binary")
    return scratch.write(index, "index")


def _blocks(table: pa.Table) -> pa.Table:
    dim = table.column("dim")[0].as_py()
    ids, x = table.column("vec_id").to_numpy(), _matrix(table.column("v"), dim)
    return pa.table({"dim": pa.array([dim], pa.int32()), "block": table.column("block").slice(0, 1).cast(pa.int64()), "blob": pa.array([pack([ids, x.view("<u4").reshape(-1)])], pa.binary())})


def _searched(k: int, factor: float):
    """Rows of a tree in turn: the tree (block -1), then blocks of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for row in range(len(batch)):
                blob = batch.column("blob")[row].as_py()
                if batch.column("block")[row].as_py() < 0:
                    tree = Tree.unpacked(blob)
                    continue
                ids, x = unpack(blob)
                place, score = tree.search(ids, x.view("<f4").reshape(len(ids), -1), k, factor)
                q, at = np.nonzero(place >= 0)
                yield pa.record_batch([pa.array(ids[q]), pa.array(tree.ids[place[q, at]]), pa.array(score[q, at])], names=["query_id", "vec_id", "score"])

    return run


def search(spark: SparkSession, index: DataFrame, queries: DataFrame, scratch: Scratch, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, factor: float = FACTOR, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of the index (rules
    of `nearest`). Every block of queries meets every tree of its dimension once.
    A tree goes to one task, where the blocks stream by; only where there are
    fewer trees than tasks it goes to several, which share the blocks."""
    src = _usable(queries, id_col, vec_col)
    many = src.agg(F.count("*")).first()[0]
    blocks = max(1, -(-many // block))
    queries = src.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("long"))
    queries = scratch.write(queries.groupBy("dim", "block").applyInArrow(_blocks, "dim int, block long, blob binary"), "queries")
    parts = max(1, min(blocks, -(-2 * partitions(spark) // max(1, index.count()))))
    place = F.struct("octave", "shard", "part").alias("place")
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    trees = index.select("*", part).select("dim", place, F.lit(-1).cast("long").alias("block"), "blob")
    met = index.select("dim", "octave", "shard").join(growing(queries), "dim").withColumn("part", (F.col("block") % parts).cast("int"))
    met = met.select("dim", place, "block", "blob").unionByName(trees)
    met = met.repartition(max(partitions(spark), 1), "dim", "place").sortWithinPartitions("dim", "place", "block").select("block", "blob")
    found = met.mapInArrow(_searched(k, factor), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, factor: float = FACTOR) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (inner product in double
    precision) of each query's k nearest vectors but its own, nearest first, ties
    to the smaller vec_id; all candidates if fewer than k.

    Vectors that are null, empty, zero or hold null or non-finite components, and
    rows without a vec_id, take no part; vectors of different dimensions don't
    meet. Equal vectors tie; repeated vec_ids of other vectors are candidates of
    their own, and rows that share the query's vec_id are its own. An empty table
    gives an empty result; other columns are not read. queries: those whose id is
    divisible by 20 unless given."""
    scratch = Scratch(spark, "ann")
    queries = vectors.where(F.col(id_col) % 20 == 0) if queries is None else queries
    return search(spark, build_index(spark, vectors, scratch, id_col, vec_col), queries, scratch, id_col, vec_col, k, factor)
