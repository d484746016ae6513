"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order. The index is dealt to blocks; each
block posts its distinct vectors, with the place of the pivot in their order, in one inverted file per
pivot. A query reads only the files of its own nearest pivots, adds up the footrule distance of the two
orders, and the best of each block are ranked anew by the exact distance. As every block gives the same
share of its vectors, recall does not depend on the size of the table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.llm.common import query, table

#: Pivots, nearest pivots kept, and the vectors (of the least hashed ids) that pivots are chosen from.
PIVOTS, NEAREST, SAMPLE = 256, 64, 1024
#: Pivots are at least this part of the sample's median distance apart, so a dense cluster has one.
APART = 0.5
#: Share of a block that is ranked by the exact distance.
SHARE = 0.15
#: Part of the greatest footrule distance up to which every vector is ranked by the exact distance,
#: however many there are: in a dense cluster the orders hardly differ and cannot choose.
CLOSE = 0.35
INDEX_BLOCK, QUERY_BLOCK = 4096, 4096


def _orders(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Indexes of the nearest pivots of each vector, nearest first."""
    out = np.empty((len(vectors), nearest), np.int64)
    norms = (pivots**2).sum(axis=1)
    for at in range(0, len(vectors), 2048):
        distance = norms - 2 * vectors[at : at + 2048] @ pivots.T
        out[at : at + 2048] = np.argsort(distance, axis=1, kind="stable")[:, :nearest]
    return out


class InvertedFiles:
    """For each pivot the vectors that keep it, and its place in their order."""

    def __init__(self, orders: np.ndarray, n_pivots: int):
        self.n, self.nearest = orders.shape
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.vector, self.place = np.divmod(by_pivot, self.nearest)
        self.start = np.searchsorted(flat[by_pivot], np.arange(n_pivots + 1))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance to each vector; a pivot that one of the two lacks is at place `nearest`."""
        spans = [(self.start[p], self.start[p + 1]) for p in order]
        vector = np.concatenate([self.vector[a:b] for a, b in spans])
        place = np.concatenate([self.place[a:b] for a, b in spans])
        own = np.repeat(np.arange(self.nearest), [b - a for a, b in spans])
        saved = (self.nearest - own) + (self.nearest - place) - np.abs(own - place)
        return self.nearest * (self.nearest + 1) - np.bincount(vector, saved, self.n)


def spread_pivots(sample: np.ndarray) -> np.ndarray:
    """Vectors of the sample that are far enough from those chosen before."""
    squares = (sample**2).sum(axis=1)
    distance = np.sqrt(np.maximum(0, squares[:, None] + squares[None, :] - 2 * sample @ sample.T))
    limit, chosen = APART * np.median(distance), []
    for i in range(len(sample)):
        if len(chosen) < PIVOTS and (distance[i, chosen] >= limit).all():
            chosen.append(i)
    return sample[chosen]


def _searched(pivots, k: int, share: float, id_type: pa.DataType):
    names = ["query_id", "vec_id", "score"]

    def run(_, index: pa.Table, queries: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], id_type), pa.array([], id_type), pa.array([], pa.float64())], names)
        if not index.num_rows or not queries.num_rows:
            return none
        p = np.asarray(pivots.value, np.float64)

        def matrix(rows):
            values = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return values.astype(np.float64).reshape(rows.num_rows, -1)

        index, queries = index.sort_by("id"), queries.sort_by("id")
        ids, own = (t.column("id").to_numpy() for t in (index, queries))
        x, q = matrix(index), matrix(queries)
        nearest = min(NEAREST, len(p))
        x, same = np.unique(x, axis=0, return_inverse=True)
        copies = np.argsort(same.ravel(), kind="stable")  # of each vector, least id first
        start = np.searchsorted(same.ravel()[copies], np.arange(len(x) + 1))
        held = np.minimum(np.diff(start), k + 1)  # the own one and k others can be among the nearest
        files = InvertedFiles(_orders(x, p, nearest), len(p))
        most = min(len(x), max(4 * k, math.ceil(share * len(x))))
        found = []
        for row, order in enumerate(_orders(q, p, nearest)):
            footrule = files.footrule(order)
            best = np.argsort(footrule, kind="stable")
            close = int((footrule <= CLOSE * nearest * (nearest + 1)).sum())
            best = best[: max(most, close)]
            exact = np.sqrt(((x[best] - q[row]) ** 2).sum(axis=1))
            exact = np.repeat(exact, held[best])
            near = ids[copies[np.concatenate([np.arange(start[b], start[b] + held[b]) for b in best])]]
            near, exact = near[near != own[row]], exact[near != own[row]]
            top = np.lexsort((near, exact))[:k]
            found.append((np.full(len(top), own[row]), near[top], exact[top]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], names) if found else none

    return run


def nearest_neighbours(
    index: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    share: float = SHARE,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, itself (its id) left out.

    Nearest is the least Euclidean distance in double precision; ties go to the smaller id. Vectors that
    are NULL, zero, or have NULL or non-finite components, a NULL id, or another length than the
    pivots take no part. Of equal vectors each is a candidate; a repeated id is the query's own, too. With fewer
    candidates than k all are returned; an empty table gives no rows. Other columns are ignored.
    """
    spark = index.sparkSession
    vector = F.col("vector")
    sound = (
        vector.isNotNull()
        & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(vector, lambda v: v != 0)
    )

    def vectors(rows):
        rows = rows.select(
            F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
        )
        return rows.filter(sound & F.col("id").isNotNull())

    rows = vectors(index)
    sample = [r["vector"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    dimension = len(sample[0]) if sample else 0
    sample = np.array([v for v in sample if len(v) == dimension]) if sample else np.zeros((1, 1))
    pivots = spark.sparkContext.broadcast(spread_pivots(sample))
    whole = F.size("vector") == dimension
    wanted = vectors(queries).filter(whole)
    n_index, n_queries = rows.filter(whole).count(), wanted.count()
    n_index, n_queries = (max(1, math.ceil(n / b)) for n, b in ((n_index, INDEX_BLOCK), (n_queries, QUERY_BLOCK)))

    def everywhere(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n):
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    posted = rows.filter(whole).withColumn("block", dealt(n_index)).withColumn("part", everywhere(n_queries))
    asked = wanted.withColumn("part", dealt(n_queries)).withColumn("block", everywhere(n_index))
    id_type = rows.schema["id"].dataType
    name = id_type.simpleString()
    found = (
        posted.groupBy("block", "part")
        .cogroup(asked.groupBy("block", "part"))
        .applyInArrow(
            _searched(pivots, k, share, to_arrow_type(id_type)),
            f"query_id {name}, vec_id {name}, score double",
        )
    )
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


@query("op5_permutation_index")
def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
