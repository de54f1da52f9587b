"""Exact top-k inner-product search by Fagin's threshold algorithm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Written, materialize, pieces

#: Candidates of a block at most, blocks at least, and queries of a block.
BLOCK, BLOCKS, QUERIES = 4096, 48, 2048


class SortedLists:
    """The per-dimension lists of a block of vectors, each in falling order of its component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.down = np.argsort(-self.vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.vectors.T, self.down, 1)

    def top(self, query: np.ndarray, k: int, skip: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, leaving out the id `skip`.

        Reads all lists in step, from the end that suits the sign of the query's
        component, and scores each vector when a list first shows it. What no
        list has shown yet scores at most the sum of query component times the
        value the list stands at; once that is below the kth score, it ends.
        Depth grows by doubling.
        """
        n = len(self.ids)
        used = np.flatnonzero(query)
        seen = np.zeros(n, bool)
        if skip is not None:
            at = np.searchsorted(self.ids, skip, "left"), np.searchsorted(self.ids, skip, "right")
            seen[at[0] : at[1]] = True
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        up = query[used] < 0
        q = query[used]
        depth, width = 0, max(16, n // 16)
        while depth < n and len(used):
            end = min(n, depth + width)
            shown = np.concatenate([self.down[used[~up], depth:end].ravel(), self.down[used[up], n - end : n - depth].ravel()])
            fresh = np.zeros(n, bool)
            fresh[shown] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            if len(new):
                rows, scores = np.concatenate([rows, new]), np.concatenate([scores, self.vectors[new] @ query])
                if len(rows) > k:
                    best = np.lexsort((rows, -scores))[:k] if len(rows) <= 4 * k else self._best(rows, scores, k)
                    rows, scores = rows[best], scores[best]
            stand = np.where(up, self.values[used, n - end], self.values[used, end - 1])
            if len(rows) >= k and int(stand @ q) < scores.min():
                break
            depth, width = end, width * 2
        if len(rows) < k and not len(used):  # a zero query scores 0 with all
            rest = np.flatnonzero(~seen)[: k - len(rows)]
            rows, scores = np.concatenate([rows, rest]), np.concatenate([scores, np.zeros(len(rest), np.int64)])
        best = np.lexsort((rows, -scores))[:k]
        return [(int(scores[b]), int(self.ids[rows[b]])) for b in best]

    @staticmethod
    def _best(rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((rows[near], -scores[near]))[:k]]


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), -1)


def _search(k: int):
    def run(left, right) -> Iterator:
        import pyarrow as pa

        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            sizes = right.column("size").to_numpy()
            for size in np.unique(left.column("size").to_numpy()).tolist():
                mine = right.filter(pa.array(sizes == size))
                if not mine.num_rows:
                    continue
                lists = SortedLists(mine.column("id").to_numpy(), _matrix(mine.column("v")))
                asked = left.filter(pa.array(left.column("size").to_numpy() == size))
                for query, vector in zip(asked.column("id").to_pylist(), _matrix(asked.column("v")), strict=True):
                    out += [(query, vec, score) for score, vec in lists.top(vector, k, query)]
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.int64())})

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, kept: Written | None = None) -> DataFrame:
    """The k candidates with the highest integer inner product for each query: query_id, rank, vec_id, score.

    queries, candidates: id long, v array<long>. A vector that is null, holds a
    null or has another length than the query takes no part; neither does the
    query's own id. Ties go to the smaller id; fewer candidates give fewer rows.
    Ids should be unique: a repeated candidate row may take several ranks.

    Candidates are dealt to blocks by a hash of the id and queries to blocks of
    QUERIES; each pair of blocks is one task's work with the threshold
    algorithm on the block's own sorted lists. The best of the blocks' top k are
    the whole's.
    """
    good = "id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)"
    queries = materialize(queries.select("id", "v").filter(good), kept)
    candidates = materialize(candidates.select("id", "v").filter(good), kept)
    n, m = candidates.count(), queries.count()
    blocks = max(BLOCKS, pieces(n, BLOCK)) if n >= BLOCKS * 16 else 1
    asks = pieces(m, QUERIES)
    dealt = lambda df, own, count, other, others: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).withColumn("size", F.size("v"))
    q = dealt(queries, "qb", asks, "cb", blocks)
    c = dealt(candidates, "cb", blocks, "qb", asks)
    found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantized(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """id and v: floor(256 * x) of each component; vectors with a null or non-finite component are left out."""
    c = F.col(column).cast("array<double>")
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(c.isNotNull() & fine).select(F.col("vec_id").alias("id"), F.transform(c, lambda x: F.floor(x * 256)).alias("v"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best for every vector whose id is divisible by 50, among all others."""
    vectors = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors.filter("id % 50 = 0"), vectors)
