"""Exact top-k search by inner product in M-trees.

Inner products become distances: with B an upper bound of all squared norms,
the point (x, sqrt(B - |x|^2)) lies at squared distance |q|^2 + B - 2 q.x from
(q, 0), so that the largest products are the nearest points.  Candidates are
split into shards; each shard is bulk-loaded once into a paged M-tree: routing
entries on two levels, which hold a pivot, a covering radius and the distance
to the parent's pivot, and leaves, whose entries hold the distance to the
leaf's pivot.  A block of queries is searched best first: each query opens the
node of its least lower bound, until that passes its k-th distance.  A node
enters with the bound that its parent's distance gives; the distance to its own
pivot is computed only when it comes first, and may put it back.  Within a leaf
the same inequality discards entries.  ``computed`` and ``avoided`` count the
distances to leaf entries, ``opened`` and ``closed`` those to leaves' pivots.

Scores are integers and ties are exact: distances only prune, with a margin
for rounding.  Queries meet shards by an equi-join on (shard, block of
queries); a task holds one shard's tree and one block, both bounded.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do rows with a null id; vectors meet those of their own
length only; repeated rows are candidates of their own, but a query's own id
never is; an id repeated among the queries is asked once for each different
vector; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import saved

SHARD_ROWS = 16_384
QUERY_ROWS = 4_096
LEAF, FAN = 128, 8
#: Products up to here are exact in float64.
EXACT = 1 << 52


class Tree:
    """A bulk-loaded M-tree over integer vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, bound: float | None = None, leaf: int = LEAF, fan: int = FAN, seed: int = 5):
        # Equal ids and vectors in one order whatever the input's: results and pages don't depend on it.
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        norm = np.einsum("ij,ij->i", self.x.astype(float), self.x.astype(float))
        self.bound = float(norm.max(initial=0.0)) if bound is None else bound
        self.p = np.column_stack([self.x.astype(float), np.sqrt(np.maximum(self.bound - norm, 0))])
        rng = np.random.default_rng(seed)
        n = len(ids)
        which, self.pivot = self._group(self.p, max(1, n // leaf), rng)
        self.page = np.argsort(which, kind="stable")
        self.start = np.searchsorted(which[self.page], np.arange(len(self.pivot) + 1))
        self.to_pivot = np.linalg.norm(self.p - self.pivot[which], axis=1)  # of leaf entries
        self.radius = np.array([self.to_pivot[self.page[a:b]].max(initial=0.0) for a, b in zip(self.start[:-1], self.start[1:], strict=True)])
        self.up, self.root = self._group(self.pivot, max(1, len(self.pivot) // fan), rng)
        self.to_root = np.linalg.norm(self.pivot - self.root[self.up], axis=1)  # of routing entries to their parent
        self.root_radius = np.zeros(len(self.root))
        np.maximum.at(self.root_radius, self.up, self.to_root + self.radius)
        self.computed = self.avoided = self.opened = self.closed = 0

    def dump(self) -> bytes:
        """The tree's arrays in one file."""
        out = io.BytesIO()
        np.savez(out, **{k: v for k, v in vars(self).items() if isinstance(v, np.ndarray)}, bound=self.bound)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as f:
            vars(tree).update({k: f[k] for k in f.files})
        tree.bound = float(tree.bound)
        tree.computed = tree.avoided = tree.opened = tree.closed = 0
        return tree

    @staticmethod
    def _group(p: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Assign points to the nearest of k sampled pivots, refined once; only groups that have points."""
        pivot = p[rng.choice(len(p), k, replace=False)]
        for _ in range(2):
            which = np.empty(len(p), np.int64)
            sq = np.einsum("ij,ij->i", pivot, pivot)
            for a in range(0, len(p), 4096):
                which[a : a + 4096] = np.argmin(sq - 2 * p[a : a + 4096] @ pivot.T, axis=1)
            live, which = np.unique(which, return_inverse=True)
            sums = np.zeros((len(live), p.shape[1]))
            np.add.at(sums, which, p)
            pivot = sums / np.bincount(which)[:, None]
        # The pivots moved after the last assignment: radii are taken from where they are now.
        return which, pivot

    def search(self, qid: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query number, vec_id, score: each query's k best, ties to smaller ids (unsorted)."""
        nq = len(q)
        qf = np.column_stack([q.astype(float), np.zeros(nq)])
        slack = 1e-9 * (1 + np.sqrt(self.bound) + np.sqrt(np.einsum("ij,ij->i", qf, qf).max(initial=0.0)))
        dist = lambda a, b: np.sqrt(np.maximum(np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * a @ b.T, 0))
        blur = 1e-6 * (1 + np.sqrt(self.bound))  # of distances taken by the expanded square
        to_root = dist(qf, self.root)
        # A leaf's bound before its own pivot's distance is known: from its parent's distance, and from its parent's cover.
        low = np.maximum(np.abs(to_root[:, self.up] - self.to_root) - self.radius, to_root[:, self.up] - self.root_radius[self.up]) - blur
        near = np.full(low.shape, np.nan)
        best_s = np.full((nq, k), np.iinfo(np.int64).min)
        best_i = np.full((nq, k), np.iinfo(np.int64).max)
        kth = np.full(nq, np.inf)
        qq = np.einsum("ij,ij->i", qf, qf)
        active = np.arange(nq)
        while len(active):
            leaf = np.argmin(low[active], axis=1)
            live = low[active, leaf] <= kth[active] + slack
            live &= np.isfinite(low[active, leaf])
            active, leaf = active[live], leaf[live]
            # Nodes that come first without their own distance get it, and may have to wait.
            far = np.isnan(near[active, leaf])
            q1, l1 = active[far], leaf[far]
            d = np.concatenate([np.zeros(0)] + [np.linalg.norm(qf[q1[a : a + 4096]] - self.pivot[l1[a : a + 4096]], axis=1) for a in range(0, len(q1), 4096)])
            near[q1, l1] = d
            low[q1, l1] = np.maximum(low[q1, l1], d - self.radius[l1] - blur)
            self.opened += len(q1)
            ready = ~far
            ready[far] = low[q1, l1] <= np.min(low[q1], axis=1)
            pairs_q, pairs_l = active[ready], leaf[ready]
            ok = low[pairs_q, pairs_l] <= kth[pairs_q] + slack
            pairs_q, pairs_l = pairs_q[ok], pairs_l[ok]
            low[pairs_q, pairs_l] = np.inf
            by = np.argsort(pairs_l, kind="stable")
            pairs_q, pairs_l = pairs_q[by], pairs_l[by]
            cuts = np.flatnonzero(np.concatenate([[True], pairs_l[1:] != pairs_l[:-1]])) if len(pairs_l) else np.zeros(0, np.int64)
            got_q, got_i, got_s = [], [], []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pairs_l)] if len(cuts) else [], strict=True):
                leaf, qs = pairs_l[a], pairs_q[a:b]
                rows = self.page[self.start[leaf] : self.start[leaf + 1]]
                keep = np.abs(near[qs, leaf][:, None] - self.to_pivot[rows]) - blur <= (kth[qs] + slack)[:, None]
                need = keep.any(axis=0)
                self.avoided += int((~need).sum()) * len(qs)
                rows, keep = rows[need], keep[:, need]
                self.computed += len(rows) * len(qs)
                s = self._products(q[qs], self.x[rows])
                keep &= (self.ids[rows] != qid[qs][:, None]) & (s >= best_s[qs, -1][:, None])
                at, col = np.nonzero(keep)
                got_q.append(qs[at])
                got_i.append(self.ids[rows[col]])
                got_s.append(s[at, col])
            if got_q and len(np.concatenate(got_q)):
                cq, ci, cs = np.concatenate(got_q), np.concatenate(got_i), np.concatenate(got_s)
                some = np.unique(cq)
                cq = np.concatenate([cq, np.repeat(some, k)])
                ci, cs = np.concatenate([ci, best_i[some].ravel()]), np.concatenate([cs, best_s[some].ravel()])
                o = np.lexsort((ci, np.negative(np.maximum(cs, np.iinfo(np.int64).min + 1)), cq))
                cq, ci, cs = cq[o], ci[o], cs[o]
                begin = np.flatnonzero(np.concatenate([[True], cq[1:] != cq[:-1]]))
                pos = np.arange(len(cq)) - np.repeat(begin, np.diff(np.append(begin, len(cq))))
                top = pos < k
                best_s[cq[top], pos[top]], best_i[cq[top], pos[top]] = cs[top], ci[top]
                full = best_i[some, -1] != np.iinfo(np.int64).max
                some = some[full]
                kth[some] = np.sqrt(np.maximum(qq[some] + self.bound - 2.0 * best_s[some, -1], 0)) + blur
        self.closed += int(np.isnan(near).sum())
        at, col = np.nonzero(best_i != np.iinfo(np.int64).max)
        return at, best_i[at, col], best_s[at, col]

    @staticmethod
    def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
        if most < EXACT:
            return (a.astype(float) @ b.astype(float).T).astype(np.int64)
        return a @ b.T


def usable(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, dim, x (array<bigint>): rows whose components are all finite, scaled and floored."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    v = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    return v.select("vec_id", F.size("embedding").alias("dim"), F.transform("embedding", lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("x"))


def _packed(df: DataFrame, by: list[str]) -> DataFrame:
    """One row a group: ids and components in flat arrays."""
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("vec_id", "x"))).alias("_v")).select(*by, F.col("_v.vec_id").alias("ids"), F.flatten(F.col("_v.x")).alias("xs"))


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score for queries whose id is divisible by ``every``."""
    v = saved(usable(vectors, scale), "vectors")
    sizes = {r["dim"]: (r["n"], r["q"]) for r in v.groupBy("dim").agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q")).collect()}  # a row a vector length
    n, nq = max([1, *(x[0] for x in sizes.values())]), max([1, *(x[1] or 0 for x in sizes.values())])
    shards, blocks = -(-n // SHARD_ROWS), -(-nq // QUERY_ROWS)
    # Ids differ, so their hashes spread; every group is of bounded size.
    shard = _packed(v.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards))), ["dim", "shard"])
    asks = v.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "x"])
    asks = _packed(asks.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks))), ["dim", "block"]).select("dim", "block", F.col("ids").alias("qids"), F.col("xs").alias("qxs"))

    def flat(batch: pa.RecordBatch, column: str, i: int) -> np.ndarray:
        return batch.column(column)[i].values.to_numpy(zero_copy_only=False)

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                dim, ids = batch.column("dim")[i].as_py(), flat(batch, "ids", i)
                tree = Tree(ids, flat(batch, "xs", i).reshape(len(ids), dim)).dump()
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), batch.column("shard").slice(i, 1), pa.array([tree], pa.binary())], ["dim", "shard", "tree"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                tree, qids = Tree.load(batch.column("tree")[i].as_py()), flat(batch, "qids", i)
                at, vec, score = tree.search(qids, flat(batch, "qxs", i).reshape(len(qids), -1), k)
                yield pa.RecordBatch.from_arrays([pa.array(qids[at]), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])

    every_one = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    trees = saved(shard.mapInArrow(build, "dim int, shard long, tree binary"), "trees").withColumn("block", every_one(blocks))
    paired = trees.join(asks.withColumn("shard", every_one(shards)), ["dim", "shard", "block"]).select("tree", "qids", "qxs").repartition(shards * blocks)
    found = paired.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
