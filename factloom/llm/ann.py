"""Approximate nearest neighbours by collision counting over sorted single projections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Candidates of one block, and queries of one block.
BLOCK = 8192
#: Half the width of a window, in radii: a vector at a query's radius falls into a window with probability 0.70.
WIDTH = 1.04
#: Each round searches so many times the blocks of all rounds before.
GROWTH = 8


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array of double): without missing, zero, non-finite or odd-sized vectors."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is larger than infinity here
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    return rows


class ProjectionIndex:
    """Sorted arrays of single projections over one block of vectors."""

    def __init__(self, points: np.ndarray, projections: np.ndarray):
        values = points @ projections.T
        self.order = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T.astype(np.int32))
        self.sorted = np.ascontiguousarray(np.take_along_axis(values.T, self.order.astype(np.int64), axis=1))  # one sorted array for each projection
        self.ranks = np.empty(self.order.shape, np.uint16)  # a block has less than 65,536 vectors
        for j, own in enumerate(self.order):
            self.ranks[j, own] = np.arange(len(points), dtype=np.uint16)
        self.shifted, self.inside = np.empty_like(self.ranks), np.empty(self.ranks.shape, bool)

    def colliding(self, at: np.ndarray, half: float, least: int) -> np.ndarray:
        """The vectors that lie in at least `least` of the windows of this half width around a query's projections."""
        m, n = self.ranks.shape
        ends = np.array([own.searchsorted(x) for own, x in zip(self.sorted, np.stack([at - half, at + half], axis=1))])
        low, width = ends[:, 0], ends[:, 1] - ends[:, 0]
        if width.sum() < m * n / 16:  # narrow windows are walked
            inside = np.concatenate([own[a : a + w] for own, a, w in zip(self.order, low, width)])
            return np.flatnonzero(np.bincount(inside, minlength=n) >= least)
        np.subtract(self.ranks, low.astype(np.uint16)[:, None], out=self.shifted)
        np.less(self.shifted, np.minimum(width, 65_535).astype(np.uint16)[:, None], out=self.inside)
        return np.flatnonzero(np.add.reduce(self.inside.view(np.uint8), axis=0, dtype=np.uint8 if m < 256 else np.uint16) >= least)


def search_block(ids, points, query_ids, queries, radii, k, projections, threshold, top_norm):
    """The k best verified candidates of one block for each query: lists of query id, vec id and score.

    radii: within which each query's k nearest are known to lie from other blocks, or infinity; then virtual rehashing
    widens the windows until k verified vectors lie within the radius that the windows stand for.
    """
    n, m = len(ids), projections.shape[0]
    # largest inner product as nearest distance: one more coordinate gives all candidates the same norm
    extra = np.sqrt(np.maximum(top_norm**2 - (points**2).sum(axis=1), 0.0))
    index = ProjectionIndex(np.concatenate([points, extra[:, None]], axis=1), projections)
    norms = np.sqrt((queries**2).sum(axis=1))
    spots = np.concatenate([queries * (top_norm / norms)[:, None], np.zeros((len(queries), 1))], axis=1) @ projections.T
    least, start, out = int(np.ceil(threshold * m)), 0.05 * top_norm, ([], [], [])
    for qid, q, norm, at, known in zip(query_ids, queries, norms, spots, radii):
        radius = known if known < np.inf else start
        while True:
            chosen = index.colliding(at, WIDTH * radius, least) if radius < 2 * top_norm else np.arange(n)  # no two are further apart
            chosen = chosen[ids[chosen] != qid]
            scores = (points[chosen] * q).sum(axis=1)
            within = np.count_nonzero(scores >= norm * (top_norm - radius**2 / (2 * top_norm)))
            if radius == known or within >= k or radius >= 2 * top_norm:
                break
            radius *= 1.1
        if known == np.inf:
            start = 0.5 * start + 0.45 * radius  # where the next query begins
        if len(chosen) > k:  # with all that tie with the k-th
            keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            chosen, scores = chosen[keep], scores[keep]
        order = np.lexsort((ids[chosen], -scores))[:k]
        out[0].append(np.full(len(order), qid, np.int64))
        out[1].append(ids[chosen][order])
        out[2].append(scores[order])
    return out


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    projections: int = 128, threshold: float = 0.62, seed: int = 11, block: int = BLOCK,
) -> DataFrame:
    """Each query's k nearest vectors by inner product: query_id, rank (from 1), vec_id, score. A query never finds its own id.

    All vectors are indexed, in blocks of about `block`: each block sorts its vectors along `projections` random lines.
    For a query, windows around its place on each line stand for a radius: a vector within it falls into at least threshold * projections
    of the windows with a probability of 0.97 or more. Those that do are verified with exact inner products in double precision. In the
    first block a query's radius grows until k verified vectors lie within it; every later round takes GROWTH times as many blocks, and
    each query's radius is then the distance of its k-th best so far, so windows are as narrow as the data allow, and narrow
    ones are walked instead of counted for all vectors. The best of all blocks are merged. Ties go to the smaller id. Query blocks meet all vector blocks.

    Vectors that are missing, zero, hold missing or non-finite components, or have another size than most take no part,
    as candidates and as queries; no more do missing ids. Of rows that repeat an
    id each is a candidate, and one is the query. An empty table gives an empty
    result; with fewer than k candidates all are returned. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows, asked = _usable(vectors, id_col, vector_col), _usable(queries, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, top_norm = sizes["d"], float(np.sqrt(sizes["norm"]))
    lines = np.random.default_rng(seed).standard_normal((projections, d + 1))
    # of rows that repeat a query's id, the smallest vector asks
    asked = asked.filter(F.size("v") == d).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = common.store(asked, "queries")
    n_blocks, n_asked = -(-sizes["n"] // block), max(1, -(-asked.count() // block))
    dealt = lambda df, n, out: df.withColumn(out, F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int"))
    points = dealt(rows.filter(F.size("v") == d), n_blocks, "b").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))

    def meet(points: pa.Table, wanted: pa.Table) -> pa.Table:
        out = ([], [], [])
        if points.num_rows and wanted.num_rows:
            arrays = [(t.column("vec_id").to_numpy(), t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d)) for t in (points, wanted)]
            radii = wanted.column("radius").to_numpy()
            for a in range(0, points.num_rows, 60_000):  # ranks are 16 bits wide
                part = search_block(*(x[a : a + 60_000] for x in arrays[0]), *arrays[1], radii, k, lines, threshold, top_norm)
                out = tuple(x + y for x, y in zip(out, part))
        join = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
        return pa.table([join(out[0], pa.int64()), join(out[1], pa.int64()), join(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    done, found = 0, None
    while done < n_blocks:
        end = min(n_blocks, max(1, done * (1 + GROWTH)))
        radius = F.lit(float("inf"))
        right = dealt(asked, n_asked, "c")
        if found is not None:
            norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
            kth = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
            radius = F.coalesce(F.sqrt(F.greatest(2 * top_norm**2 - 2 * top_norm * F.col("kth") / norm, F.lit(0.0))) * (1 + 1e-9) + 1e-9 * top_norm, radius)
            right = right.join(kth, "vec_id", "left")
        right = right.select("vec_id", "v", "c", radius.alias("radius"), F.explode(F.sequence(F.lit(done), F.lit(end - 1))).alias("b"))
        new = points.filter(F.col("b").between(done, end - 1)).groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(meet, schema)
        new = new if found is None else new.unionByName(found.drop("rank"))
        found = common.store(new.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "nearest")
        done = end
    return found.select("query_id", "rank", "vec_id", "score")


def op7_query(spark, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)
