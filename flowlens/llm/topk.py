"""Exact top-k search by inner product with a dual-tree walk over cover trees.

Candidates and queries are dealt into blocks of bounded size by the hash of their ids; every pair
of blocks is one task group. A group builds a cover tree of its candidates and one of its queries
and walks both together, best bound first. With centres q and c, radii r and s, no pair below two
nodes scores more than <q,c> + |q|s + |c|r + rs. A pair of nodes is dropped if that is below the
worst k-th score of the query group so far. The best k of all blocks are merged by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flowlens.llm.tables import settle

#: Vectors of a block of candidates and of a block of queries.
CANDIDATES = 2048
QUERIES = 1024
#: Points of a leaf.
LEAF = 128
#: No score yet; its negative is a whole number, too.
_LEAST = -np.iinfo(np.int64).max


class CoverTree:
    """Nested covers of some points: the points of a child lie within half the parent's radius of its centre.

    A node has at most two children per leaf's worth of points; where they can't cover it that
    closely, the radii are larger. Bounds use the radii as they are, so results stay exact.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.center: list[np.ndarray] = []
        self.norm: list[float] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.leaf: list[np.ndarray] = []
        if len(points):
            self._add(np.arange(len(points)), 0)

    def _add(self, members: np.ndarray, head: int) -> int:
        """A node around the point at `head` of `members`."""
        node = len(self.center)
        center = self.points[members[head]]
        far = np.sqrt(((self.points[members] - center) ** 2).sum(axis=1))
        self.center.append(center)
        self.norm.append(float(np.sqrt((center**2).sum())))
        self.radius.append(float(far.max()) * (1 + 1e-9))
        self.children.append([])
        self.leaf.append(members)
        # Points that coincide can't be told apart by any cover.
        if len(members) <= LEAF or self.radius[node] == 0:
            return node
        half = self.radius[node] / 2
        nearest, which, centers = far.copy(), np.zeros(len(members), np.int64), [head]
        while nearest.max() > half and len(centers) * LEAF < 2 * len(members):
            head = int(nearest.argmax())
            away = np.sqrt(((self.points[members] - self.points[members[head]]) ** 2).sum(axis=1))
            closer = away < nearest
            nearest[closer], which[closer] = away[closer], len(centers)
            centers.append(head)
        groups = [np.flatnonzero(which == k) for k in range(len(centers))]
        for k, group in enumerate(groups):
            self.children[node].append(self._add(members[group], int(np.flatnonzero(group == centers[k])[0])))
        return node


class Best:
    """The k best candidates of each query: score, then smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), _LEAST, np.int64)
        self.id = np.full((queries, k), np.iinfo(np.int64).max, np.int64)

    def worst(self, rows: np.ndarray) -> int:
        return int(self.score[rows, -1].min())

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Offer all `ids` to each of `rows`, but a query's own id."""
        scores = np.where(own[:, None] == ids[None, :], _LEAST, scores)
        better = (scores >= self.score[rows, -1][:, None]) & (scores > _LEAST)
        for r in np.flatnonzero(better.any(axis=1)):
            row, hit = rows[r], better[r]
            score, vec = np.append(self.score[row], scores[r, hit]), np.append(self.id[row], ids[hit])
            order = np.lexsort((vec, -score))[: self.k]
            self.score[row], self.id[row] = score[order], vec[order]


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int
) -> Best:
    """The k best of some candidates for each query, by a walk of two trees."""
    best = Best(len(query_ids), k)
    if not len(query_ids) or not len(ids):
        return best
    # Sums of products stay exact in floating point below 2**53; larger ones use whole numbers.
    largest = float(np.abs(queries).max()) * float(np.abs(points).max()) * queries.shape[1]
    exact = largest < 2**52
    left, right = CoverTree(queries.astype(float)), CoverTree(points.astype(float))

    def bound(a: int, b: int) -> float:
        r, s = left.radius[a], right.radius[b]
        top = float(left.center[a] @ right.center[b]) + left.norm[a] * s + right.norm[b] * r + r * s
        return top + abs(top) * 1e-9 + 1e-6

    stack = [(bound(0, 0), 0, 0)]
    while stack:
        top, a, b = stack.pop()
        if top < best.worst(left.leaf[a]):
            continue
        below_a, below_b = left.children[a], right.children[b]
        if not below_a and not below_b:
            rows, held = left.leaf[a], right.leaf[b]
            for at in range(0, len(held), 4 * LEAF):
                part = held[at : at + 4 * LEAF]
                if exact:
                    scores = (left.points[rows] @ right.points[part].T).round().astype(np.int64)
                else:
                    whole = queries[rows].astype(object) @ points[part].T.astype(object)
                    scores = np.clip(whole, _LEAST + 1, 2**63 - 1).astype(np.int64)
                best.add(rows, scores, ids[part], query_ids[rows])
            continue
        split_a = below_a and (not below_b or left.radius[a] > right.radius[b])
        pairs = [(x, b) for x in below_a] if split_a else [(a, y) for y in below_b]
        stack.extend(sorted((bound(x, y), x, y) for x, y in pairs))
    return best


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """(vec_id, v): whole-number vectors; vectors that are null or hold null or non-finite components are left out."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~bad).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"),
    )


def top_k(
    vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query, exactly.

    Queries are the rows whose id is divisible by `every`, candidates all rows but the query's own.
    Ties go to the smaller id; with fewer than k candidates all are returned. Null ids and vectors
    that are null or hold null or non-finite components take no part; an empty vector scores 0;
    shorter vectors count as padded with zeros; scores beyond 64 bits are held at
    the bound. Of rows with equal ids the smallest vector counts.
    An empty table gives no rows; other columns are not read.
    """
    held = quantized(vectors, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    held = settle(held, "vectors")
    n = held.count()
    rows, columns = max(1, -(-n // (every * QUERIES))), max(1, -(-n // CANDIDATES))
    number = lambda parts, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(parts)).cast("int")
    every_of = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    queries = held.where(F.pmod("vec_id", F.lit(every)) == 0).select(
        number(rows, 1).alias("i"), every_of(columns).alias("j"), "vec_id", "v"
    )
    candidates = held.select(every_of(rows).alias("i"), number(columns, 2).alias("j"), "vec_id", "v")
    arrow = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        wide = max([0, *(len(v) for v in left.column("v")), *(len(v) for v in right.column("v"))])
        (query_ids, queries), (ids, points) = _matrix(left, wide), _matrix(right, wide)
        best = search_block(query_ids, queries, ids, points, k)
        found = best.score > _LEAST
        return pa.table(
            [np.repeat(query_ids, found.sum(axis=1)), best.id[found], best.score[found]], schema=arrow
        )

    pairs = (
        queries.groupBy("i", "j")
        .cogroup(candidates.groupBy("i", "j"))
        .applyInArrow(run, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(table: pa.Table, wide: int) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    out = np.zeros((len(ids), wide), np.int64)
    for row, vector in zip(out, table.column("v").to_pylist()):
        row[: len(vector)] = vector
    return ids, out


def oracle_sql(k: int = 20, every: int = 20, scale: int = 64) -> str:
    return f"""
WITH held AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM held q JOIN held c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= {k}
"""
