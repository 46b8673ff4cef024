"""Nearest neighbours by largest inner product with vantage-point trees, one per shard.

Vectors get one more coordinate, ``sqrt(M - |x|^2)`` with M the largest squared
norm of their tree, and queries (scaled to that norm) a zero there, so that the
largest inner product is the least Euclidean distance, a metric.  Every shard (a
hash class of rows of bounded size) holds a vantage-point tree for each class of
norms within a factor of two, so that a long vector costs the others no
precision; query blocks meet every shard once.  A branch is passed over when
``factor`` times its triangle-inequality bound, less what rounding may add,
exceeds the distance that belongs to the query's k-th score so far: factor 1 is
exact search, ties included, larger factors prune more and may miss neighbours.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and rows without an id, take no part; vectors of another length than the query's are no
candidates; rows with the query's own id are no candidates; equal scores go to
the smaller id; an empty table gives no rows; extra columns are ignored.
Identical vectors of a shard are stored once with their smallest k + 1 ids,
which are all that a top k can need.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows per shard, queries per block, points per leaf.
SHARD, BLOCK, LEAF = 16_384, 2_048, 256


class VPTree:
    """Points in a permuted array; node i covers ``lo[i]:hi[i]``, its first point is the vantage point."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        n = len(points)
        self.order = np.arange(n)
        self.lo, self.hi, self.kids, self.bounds = [], [], [], []
        todo = [(0, n, -1, 0)]
        rng = np.random.Generator(np.random.PCG64(n))
        while todo:
            lo, hi, parent, side = todo.pop()
            node = len(self.lo)
            self.lo.append(lo)
            self.hi.append(hi)
            self.kids.append([-1, -1])
            self.bounds.append((0.0, 0.0))
            if parent >= 0:
                self.kids[parent][side] = node
            if hi - lo <= leaf:
                continue
            v = lo + int(rng.integers(hi - lo))
            self.order[[lo, v]] = self.order[[v, lo]]
            rest = self.order[lo + 1 : hi]
            d = np.sqrt(((points[rest] - points[self.order[lo]]) ** 2).sum(1))
            half = len(rest) // 2
            by = np.argpartition(d, half)
            self.order[lo + 1 : hi] = rest[by]
            d = d[by]
            self.bounds[node] = (float(d[:half].max(initial=0.0)), float(d[half:].min()))
            todo += [(lo + 1, lo + 1 + half, node, 0), (lo + 1 + half, hi, node, 1)]
        self.points = points[self.order]

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Per query the k nearest rows (indices, -1 where there are fewer) and their distances."""
        q = len(queries)
        best = np.full((q, k), np.inf)
        row = np.full((q, k), -1)
        square = (self.points**2).sum(1)
        own = (queries**2).sum(1)

        def offer(who, lo, hi):
            d = np.sqrt(np.maximum(own[who, None] + square[None, lo:hi] - 2 * (queries[who] @ self.points[lo:hi].T), 0))
            near = (d < best[who, -1:]).any(1)
            w = who[near]
            if len(w):
                every = np.concatenate([best[w], d[near]], 1)
                rows = np.concatenate([row[w], np.broadcast_to(self.order[lo:hi], (len(w), hi - lo))], 1)
                pick = np.argpartition(every, k - 1, axis=1)[:, :k] if every.shape[1] > k else np.argsort(every, axis=1)
                every, rows = np.take_along_axis(every, pick, 1), np.take_along_axis(rows, pick, 1)
                s = np.argsort(every, axis=1, kind="stable")
                best[w], row[w] = np.take_along_axis(every, s, 1), np.take_along_axis(rows, s, 1)
            return d

        self.walk(q, offer, lambda who: best[who, -1], factor)
        return row, best

    def walk(self, q: int, offer, radius, factor: float) -> None:
        """Offer points ``lo:hi`` to queries (``offer`` returns distances), but no branch whose bound times ``factor`` exceeds the query's radius."""
        todo = [(0, np.arange(q), np.zeros(q))]
        while todo:
            node, who, bound = todo.pop()
            live = bound * factor <= radius(who)
            who, bound = who[live], bound[live]
            if not len(who):
                continue
            lo, hi = self.lo[node], self.hi[node]
            inner, outer = self.kids[node]
            if inner < 0:
                offer(who, lo, hi)
                continue
            d = offer(who, lo, lo + 1)[:, 0]
            in_max, out_min = self.bounds[node]
            b_in, b_out = np.maximum(bound, d - in_max), np.maximum(bound, out_min - d)
            first = b_in <= b_out
            # the nearer side first: pushed last
            todo += [(outer, who[first], b_out[first]), (inner, who[~first], b_in[~first]), (inner, who[first], b_in[first]), (outer, who[~first], b_out[~first])]

    def products(self, queries: np.ndarray, best: np.ndarray, first: np.ndarray, row: np.ndarray, ids: np.ndarray, start: int, factor: float = 1.0) -> None:
        """Improve every query's best points by (score, least id), exactly, in place: scores, least ids, and rows (from ``start``); ``ids`` are the points' least ids."""
        k, dim = best.shape[1], queries.shape[1]
        x = self.points[:, :dim]
        ids = ids[self.order]
        square = (self.points**2).sum(1)
        most = float(square.max())
        norm = np.sqrt((queries**2).sum(1))
        scale = np.divide(math.sqrt(most), norm, out=np.zeros(len(norm)), where=norm > 0)
        scaled = queries * scale[:, None]
        own = (scaled**2).sum(1)
        # what rounding may add to a squared distance, and to an inner product
        loose = 8 * (dim + 4) * np.finfo(float).eps * (own + most)
        slack = 4 * (dim + 4) * np.finfo(float).eps * norm * math.sqrt(most)

        def radius(who):
            limit = own[who] + most - 2 * np.where(np.isinf(best[who, -1]), -np.inf, scale[who] * np.where(np.isinf(best[who, -1]), 0, best[who, -1])) + loose[who]
            return np.where(limit < 0, -1, np.sqrt(np.maximum(limit, 0)) + 2 * np.sqrt(loose[who]) * factor)

        def offer(who, lo, hi):
            ip = queries[who] @ x[lo:hi].T
            least = best[who, -1] - slack[who]
            if hi - lo > k:
                least = np.maximum(least, np.partition(ip, hi - lo - k, axis=1)[:, hi - lo - k] - 2 * slack[who])
            i, j = np.nonzero(ip >= least[:, None])
            if len(i):
                score = _exact(queries[who[i]], x[lo + j])
                w, at = np.unique(i, return_inverse=True)
                g = who[w]
                n = len(w)
                at = np.concatenate([at, np.repeat(np.arange(n), k)])
                score = np.concatenate([score, best[g].ravel()])
                least_id = np.concatenate([ids[lo + j], first[g].ravel()])
                place = np.concatenate([start + self.order[lo + j], row[g].ravel()])
                o = np.lexsort((least_id, -score, at))
                o = o[(np.searchsorted(at[o], np.arange(n))[:, None] + np.arange(k)).ravel()]
                best[g], first[g], row[g] = score[o].reshape(n, k), least_id[o].reshape(n, k), place[o].reshape(n, k)
            return np.sqrt(np.maximum(own[who, None] + square[None, lo:hi] - 2 * scale[who, None] * ip, 0))

        self.walk(len(queries), offer, radius, factor)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, one term after the other in double precision."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def _build(k: int):
    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim = key[1].as_py()
        ids = table.column("vec_id").to_numpy()
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), "<f8").reshape(-1, dim)
        order = np.lexsort((ids, *x.T))
        ids, x = ids[order], x[order]
        new = np.r_[True, (x[1:] != x[:-1]).any(1)]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        keep = np.arange(len(ids)) - first[group] <= k
        members = np.split(ids[keep], np.cumsum(np.bincount(group[keep]))[:-1])
        x, least = x[first], ids[first]
        square = (x * x).sum(1)
        size = np.frexp(square)[1] // 2  # norms within a factor of two
        order = np.argsort(-size, kind="stable")
        x, least, square, size, members = x[order], least[order], square[order], size[order], [members[i] for i in order]
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(x)]
        trees = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):  # long vectors first
            more = np.sqrt(np.maximum(square[lo:hi].max() - square[lo:hi], 0))
            trees.append((VPTree(np.concatenate([x[lo:hi], more[:, None]], 1)), lo, hi))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([dim], pa.int32()), "tree": [pickle.dumps((trees, x, least, members))]})

    return build


def _search(k: int, factor: float):
    # a top k without the query's own row lies within the first k + 1 distinct vectors by score and least id
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, dim, qids, qvecs in zip(*(batch.column(c).to_pylist() for c in ("tree", "dim", "qids", "qvecs")), strict=True):
                trees, x, least, members = pickle.loads(tree)
                ids = np.frombuffer(qids, "<i8")
                q = np.frombuffer(qvecs, "<f8").reshape(-1, dim)
                best, first = np.full((len(q), k + 1), -np.inf), np.full((len(q), k + 1), np.iinfo(np.int64).max)
                row = np.full((len(q), k + 1), -1)
                for t, lo, hi in trees:
                    t.products(q, best, first, row, least[lo:hi], lo, factor)
                who, at = np.nonzero(row >= 0)
                hit = row[who, at]
                score = _exact(q[who], x[hit])
                sizes = np.array([len(members[h]) for h in hit], dtype=np.int64)
                vec = np.concatenate([members[h] for h in hit]) if len(hit) else np.zeros(0, np.int64)
                who, score = np.repeat(who, sizes), np.repeat(score, sizes)
                other = ids[who] != vec
                who, vec, score = who[other], vec[other], score[other]
                order = np.lexsort((vec, -score, who))
                who, vec, score = who[order], vec[order], score[order]
                first = np.searchsorted(who, np.arange(len(ids)))
                top = np.arange(len(who)) - first[who] < k
                yield pa.RecordBatch.from_arrays([pa.array(ids[who[top]]), pa.array(vec[top]), pa.array(score[top])], ["query_id", "vec_id", "score"])

    return run


def _packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    ids = table.column("vec_id").to_numpy().astype("<i8")
    return pa.table({"dim": pa.array([key[1].as_py()], pa.int32()), "qids": [ids.tobytes()], "qvecs": [b"".join(table.column("vec").to_pylist())]})


def _doubles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("vec")
        values = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8")
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("dim"), pa.array([values[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["vec_id", "dim", "vec"])


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, factor: float = 1.0) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the queries ``vec_id % every == 0`` against all rows."""
    e = F.col("embedding")
    ok = e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.filter(ok & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.size(e).alias("dim"), e.cast("array<double>").alias("vec"))
    n, queries = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    shards, blocks = max(1, math.ceil(n / SHARD)), max(1, math.ceil(queries / BLOCK))
    packed = rows.mapInArrow(_doubles, "vec_id long, dim int, vec binary")
    trees = packed.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).groupBy("shard", "dim").applyInArrow(_build(k), "shard int, dim int, tree binary")
    asked = packed.filter(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64(F.col("vec_id") + 1), F.lit(blocks)).cast("int")).groupBy("block", "dim").applyInArrow(_packed, "dim int, qids binary, qvecs binary")
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = trees.join(asked, ["shard", "dim"]).select("tree", "dim", "qids", "qvecs").mapInArrow(_search(k, factor), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
