"""Operator 1: approximate nearest neighbours by a permutation index.

A bounded sample of the distinct vectors serves as pivots.  Each vector is represented by
the order of its ``length`` nearest pivots and posted in the inverted file of each
of them; a file holds its vectors by the rank that its pivot has for them.  A query
takes its own ``asked`` nearest pivots and reads from the file of each the stretch
of ranks within ``window`` of its own; nothing else of the index is read.  The
difference of the two ranks is what a pivot adds to the footrule distance, and
``window`` + 1 where a vector isn't met.  The nearest share by footrule, in each
block of the index, is reranked with the original vectors in double precision; a
query's lists from all blocks meet in one top-k.

Largest inner product becomes nearest direction by one more component,
sqrt(M^2 - |v|^2) with M the largest norm, which is 0 for each query: so vectors
of any norm are ordered rightly.  Equal vectors of a block count once while
candidates are chosen, hence a vector with very many copies crowds out nothing,
and ties go to the smaller id.

The index is dealt in blocks of ``block`` vectors, the queries in blocks as well;
each pair of blocks is one bounded group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

#: Pivots (the bounded sample), posted pivots of each vector, pivots that a query asks, ranks read on either side.
PIVOTS, LENGTH, ASKED, WINDOW = 512, 128, 64, 48
#: Candidates' share and least number.
SHARE, LEAST = 0.15, 400
BLOCK, QUERY_BLOCK, K = 8192, 2048, 20


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v): vectors of the usual length that are neither null nor zero and
    hold neither null nor non-finite components."""
    v = F.col(vector_column).cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ok)


def permutations(rows: np.ndarray, extra: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Numbers of each row's nearest pivots, nearest first."""
    near = np.column_stack([rows, extra]) @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :length].astype(np.int16)


def inverted_files(order: np.ndarray, n_pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posted, ranks, begin): the vectors of all files and their ranks, one file after
    another and by rank in each; those that pivot p has at rank r are
    posted[begin[p * length + r]:begin[p * length + r + 1]]."""
    length = order.shape[1]
    place = (order.astype(np.int64) * length + np.arange(length)).ravel()
    by_place = np.argsort(place, kind="stable")
    begin = np.searchsorted(place[by_place], np.arange(n_pivots * length + 1))
    return by_place // length, (by_place % length).astype(float), begin


def footrules(files: tuple[np.ndarray, np.ndarray, np.ndarray], own: np.ndarray, n: int, length: int, window: int) -> np.ndarray:
    """Footrule distance of a query, with the pivots ``own``, to each of ``n`` posted
    vectors: differences of ranks beyond ``window`` count as ``window`` + 1."""
    posted, ranks, begin = files
    at, file = np.arange(len(own)), own.astype(np.int64) * length
    low, high = begin[file + np.minimum(np.maximum(at - window, 0), length)], begin[file + np.minimum(at + window + 1, length)]
    stretches = [slice(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
    less = np.concatenate([ranks[s] for s in stretches])
    less -= np.repeat(at.astype(float), high - low)
    np.abs(less, out=less)
    np.subtract(window + 1.0, less, out=less)
    return len(own) * (window + 1) - np.bincount(np.concatenate([posted[s] for s in stretches]), less, n).astype(np.int64)


def search_block(ids: np.ndarray, rows: np.ndarray, order: np.ndarray, q_ids: np.ndarray, q_rows: np.ndarray, q_order: np.ndarray,
                 n_pivots: int, asked: int, window: int, share: float, least: int, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query, scores, ids) of each query's best ``k`` in one block of the index."""
    by_id = np.argsort(ids, kind="stable")
    ids, rows, order = ids[by_id], rows[by_id], order[by_id]
    _, first, same = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    same = same.ravel()
    # Classes of equal vectors in the order of their smallest id, and the members of each in id order.
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    same, first = rank[same], np.sort(first)
    members = np.argsort(same, kind="stable")
    begin = np.searchsorted(same[members], np.arange(len(first) + 1))
    files = inverted_files(order[first], n_pivots)
    n, length = len(first), order.shape[1]
    take = min(n, max(least, int(np.ceil(share * n))))
    out = []
    for q, row, own in zip(q_ids.tolist(), q_rows, q_order, strict=True):
        far = footrules(files, own[:asked], n, length, window) * n + np.arange(n)
        near = np.argpartition(far, take - 1)[:take] if take < n else np.arange(n)
        # Sums of products in the same order for every pair, so that equal vectors score alike.
        score = np.einsum("ij,j->i", rows[first[near]], row)
        best = near[np.lexsort((near, -score))[:k + 1]]
        found = np.concatenate([members[begin[c]:min(begin[c + 1], begin[c] + k + 1)] for c in best])
        found = found[ids[found] != q]
        score = np.einsum("ij,j->i", rows[found], row)
        top = np.lexsort((ids[found], -score))[:k]
        out.append((q, score[top], ids[found][top]))
    return out


def search(vectors: DataFrame, query_ids, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding", pivots: int = PIVOTS, length: int = LENGTH,
           asked: int = ASKED, window: int = WINDOW, share: float = SHARE, least: int = LEAST, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest of all other rows.

    ``query_ids``: condition on vec_id.  Vectors that are null, zero, of an
    unusual length or hold null or non-finite components take no part, nor do
    rows without an id.  Rows with one id and equal vectors count once; further
    columns are left out; no rows give no rows.
    """
    spark = vectors.sparkSession
    good = usable(vectors, id_column, vector_column)
    size = F.size("v").alias("size")
    usual = good.groupBy(size).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).orderBy(F.desc("n"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return spark.createDataFrame([], schema)
    dim, top, n = usual["size"], usual["top"], usual["n"]
    good = good.where(F.size("v") == dim)
    distinct = good.groupBy("v").agg(F.min("vec_id").alias("vec_id"))  # copies of a vector are one pivot
    sample = distinct.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).collect()  # bounded: the pivots
    good = good.dropDuplicates(["vec_id", "v"])
    p = np.array([r["v"] for r in sample])
    extra = lambda x: np.sqrt(np.maximum(0.0, top - np.einsum("ij,ij->i", x, x)))
    pivot_rows = np.column_stack([p, extra(p)])
    n_pivots, length = len(p), min(length, len(p))

    def represent(batches):
        for pdf in batches:
            if len(pdf):
                rows = np.array(pdf["v"].tolist(), float)
                order = permutations(rows, np.where(pdf["query"], 0.0, extra(rows)), pivot_rows, length)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "query": pdf["query"], "v": [x.tobytes() for x in rows], "perm": [x.tobytes() for x in order]})

    # A query stands in the index as a vector and beside it as a query.
    both = good.withColumn("query", F.lit(False)).union(good.where(query_ids).withColumn("query", F.lit(True)))
    index = stored(both.mapInPandas(represent, "vec_id long, query boolean, v binary, perm binary"), "permutations")
    n_blocks = -(-n // block)
    q_blocks = -(-index.where("query").count() // query_block) or 1
    deal = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    grid = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    stay = index.where(~F.col("query")).select("vec_id", "v", "perm", deal(n_blocks).alias("b"), grid(q_blocks).alias("q"))
    ask = index.where("query").select("vec_id", "v", "perm", deal(q_blocks).alias("q"), grid(n_blocks).alias("b"))

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "score": [], "vec_id": []})
        read = lambda pdf: (pdf["vec_id"].to_numpy(), np.frombuffer(b"".join(pdf["v"]), float).reshape(len(pdf), dim), np.frombuffer(b"".join(pdf["perm"]), np.int16).reshape(len(pdf), length))
        got = search_block(*read(left), *read(right), n_pivots, asked, window, share, least, k)
        return pd.DataFrame({"query_id": [g[0] for g in got], "score": [g[1] for g in got], "vec_id": [g[2] for g in got]})

    lists = stay.groupBy("b", "q").cogroup(ask.groupBy("b", "q")).applyInPandas(pair, "query_id long, score array<double>, vec_id array<long>")
    rows = lists.select("query_id", F.explode(F.arrays_zip("score", "vec_id")).alias("x")).select("query_id", "x.vec_id", "x.score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
