"""Approximate nearest neighbours by pivot permutations: pivot inverted files, footrule ranking, exact reranking.

A vector is represented by the order of its nearest pivots. It is posted in the inverted files of its ``POSTED``
nearest pivots; a query opens the files of its ``ASKED`` nearest ones, and meets a vector in the file of the
nearest pivot (in the query's order) that both share, once. Within a file vectors are ranked by the footrule
distance over bands of positions, the sum over pivots of how many bands two orders place it apart; as
|x| + |y| - 2 x.y of columns of 0 and 1 that is one matrix product for a block of queries. The nearest share of a
file is reranked by the exact inner product in double precision.

Work: a query meets about ``ASKED * POSTED / pivots`` of all vectors. The number of pivots grows with the square
root of the rows, so files grow with the square root too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pivots for up to ``BASE_ROWS`` vectors, and at most; beyond that they grow with the square root of the rows.
PIVOTS, BASE_ROWS, MOST_PIVOTS = 128, 65_536, 4096
#: Inverted files that a vector is posted in and that a query opens; bands of positions.
POSTED, ASKED, BANDS = 4, 32, 8
#: Rows of a block of a file's vectors and of its queries.
VECTORS, QUERIES = 8192, 4096
#: Share of a file's vectors that is reranked, and the least number.
SHARE, LEAST = 0.15, 64


def usable(vec: str) -> object:
    """True for vectors with finite components only, not all zero."""
    bad = F.exists(vec, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return F.coalesce((F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` distinct vectors of a sample of ``8 * n`` rows, those of least hash of the id."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(8 * n).select("v").collect()
    seen = list(dict.fromkeys(tuple(r[0]) for r in rows))
    sizes = [len(v) for v in seen]
    size = max(set(sizes), key=sizes.count) if seen else 0
    same = [v for v in seen if len(v) == size][:n]
    return np.array(same, np.float64).reshape(len(same), size)


def bands(x: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """``(n, pivots * (bands - 1))`` of 0 and 1: pivot p stands behind band b in the vector's order of pivots."""
    order = np.argsort(-(x @ pivot.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    band = place * BANDS // max(1, order.shape[1])
    return (band[:, :, None] > np.arange(BANDS - 1)).reshape(len(x), -1).astype(np.float32)


def nearest_pivots(x: np.ndarray, pivot: np.ndarray, n: int) -> np.ndarray:
    """The numbers of each vector's ``n`` nearest pivots, nearest first."""
    return np.argsort(-(x @ pivot.T), axis=1, kind="stable")[:, :n].astype(np.int32)


def search_file(file: int, qid, q, asked, vid, v, posted, pivot: np.ndarray, k: int):
    """``(query, vec, score)``: each query's best ``k`` of a pivot's file, among those that meet it there first.

    ``asked`` and ``posted`` hold the pivots of each query and vector. Of the vectors that equal a query in id and
    components one is its own row and left out.
    """
    order = np.argsort(vid, kind="stable")
    vid, v, posted = vid[order], v[order], posted[order]
    codes = bands(v, pivot)
    ones = codes.sum(axis=1)
    none = np.int32(len(pivot))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for a in range(0, len(qid), 256):
        ids, x, near = qid[a : a + 256], q[a : a + 256], asked[a : a + 256]
        rank = np.full((len(ids), len(pivot)), none)
        np.put_along_axis(rank, near, np.arange(near.shape[1], dtype=np.int32)[None, :], axis=1)
        first = rank[:, posted[:, 0]]
        for j in range(1, posted.shape[1]):
            first = np.minimum(first, rank[:, posted[:, j]])
        here = first == rank[:, [file]]
        much = min(len(vid), max(LEAST, int(SHARE * here.sum(axis=1).max()) + 1))
        code = bands(x, pivot)
        far = np.where(here, code.sum(axis=1)[:, None] + ones[None, :] - 2 * (code @ codes.T), np.inf)
        # ties go to the smaller id: the rows are in its order
        far = far.astype(np.float64) * len(vid) + np.arange(len(vid))
        near = np.sort(np.argpartition(far, much - 1, axis=1)[:, :much], axis=1)
        score = np.einsum("qd,qcd->qc", x, v[near])
        score[np.isinf(np.take_along_axis(far, near, axis=1))] = -np.inf
        for i, j in zip(*np.nonzero(vid[near] == ids[:, None])):
            if score[i, j] > -np.inf and (v[near[i, j]] == x[i]).all():
                if not (vid[near[i, :j]] == ids[i]).any() or not any((v[c] == x[i]).all() for c in near[i, :j][vid[near[i, :j]] == ids[i]]):
                    score[i, j] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        top = np.take_along_axis(score, best, axis=1)
        ok = top > -np.inf
        out.append((np.repeat(ids, ok.sum(axis=1)), vid[np.take_along_axis(near, best, axis=1)[ok]], top[ok]))
    return [np.concatenate(x) for x in zip(*out)]


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int, kind=np.float64) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pa.concat_arrays([c.flatten() for c in flat.chunks]) if isinstance(flat, pa.ChunkedArray) else flat.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(rows, -1)


def _filed(rows: DataFrame, pivot, n: int, with_vector: bool) -> DataFrame:
    """``(p, near[, id, v])``: each row once for each of its ``n`` nearest pivots."""
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = nearest_pivots(_matrix(batch.column(1), batch.num_rows), pivot.value, n)
            width = near.shape[1]
            if not with_vector:
                p, count = np.unique(near, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(count)], names=["p", "n"])
                continue
            for a in range(0, batch.num_rows, 1024):
                some = near[a : a + 1024]
                own = pa.array(np.repeat(np.arange(a, a + len(some)), width))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * width), pa.array(np.repeat(some, width, axis=0).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(some.ravel()), batch.column(0).take(own), batch.column(1).take(own), lists], names=["p", "id", "v", "near"])

    return rows.select("id", "v").mapInArrow(run, f"p int, id long, v {kind}, near array<int>" if with_vector else "p int, n long")


def search(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every`` its ``k`` nearest others.

    Nearest is by largest inner product, ties to the smaller id. Vectors that are null, zero or not finite, of
    another length than most pivots, or without an id take no part. A repeated id is one query, by its first
    vector in order of components, and as many candidates as it has rows. Of equal vectors only the ``k + 1``
    rows of smallest ids can be among the ``k`` nearest of any query, so no more are posted. Large files are cut
    into blocks. An empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(usable("v") & F.col("id").isNotNull())
    n = rows.count()
    wanted = min(MOST_PIVOTS, math.ceil(PIVOTS * max(1.0, math.sqrt(n / BASE_ROWS))))
    pivot = pivots(rows, wanted)
    held = spark.sparkContext.broadcast(pivot)
    rows = rows.where(F.size("v") == pivot.shape[1])
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    vectors = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("id", "v")
    asks = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    # at most one row of counts for each pivot comes to the driver
    blocks = lambda rows, n, most: {r["p"]: -(-r["n"] // most) for r in _filed(rows, held, n, False).groupBy("p").agg(F.sum("n").alias("n")).collect()}
    nv, nq = blocks(rows, POSTED, VECTORS), blocks(asks, ASKED, QUERIES)
    table = [(p, int(nv.get(p, 1)), int(nq.get(p, 1))) for p in range(max(1, len(pivot)))]
    sizes = F.broadcast(spark.createDataFrame(table, "p int, nv int, nq int"))

    def dealt(rows: DataFrame, n: int, own: str, other: str, count_own: str, count_other: str) -> DataFrame:
        out = _filed(rows, held, n, True).join(sizes, "p").withColumn(own, F.pmod(F.xxhash64("v"), F.col(count_own).cast("long")))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count_other).cast("long") - 1))).select("p", "vb", "qb", "id", "v", "near")

    filed = dealt(vectors, POSTED, "vb", "qb", "nv", "nq")
    asked = dealt(asks, ASKED, "qb", "vb", "nq", "nv")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        parts = [(t.column("id").to_numpy(), _matrix(t.column("v"), t.num_rows), _matrix(t.column("near"), t.num_rows, np.int32)) for t in (left, right)]
        return pa.table(search_file(left.column("p")[0].as_py(), *parts[0], *parts[1], held.value, k), names=names)

    found = asked.groupBy("p", "vb", "qb").cogroup(filed.groupBy("p", "vb", "qb")).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
