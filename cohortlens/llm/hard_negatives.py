"""Operator 11: hard negatives by angular triangle filtering.

Each vector is stored with its norm and its angles to ``references`` orthogonal
directions (the leading ones of a bounded sample).  The triangle inequality of
angles, for all these directions at once, bounds the cosine of two vectors: with
c the cosines of the stored angles and s the sine of the angle to the space that
the directions span, cos(a, x) lies in c_a c_x - s_a s_x .. c_a c_x + s_a s_x.
Times both norms, widened by more than any rounding and then to whole numbers,
that is a window for the score.

Positives: of an anchor's rows of the same label only those are scored whose
upper bound reaches the k-th largest lower bound.  Negatives: each positive's
score gives a range of allowed scores; only rows of other labels whose window
overlaps a range, and whose upper bound reaches the k-th largest lower bound of
the rows surely in that range, are scored.  Scores are exact integers.

Anchors and rows are dealt in blocks; each pair of blocks is one bounded group,
and its best few rows per anchor and positive meet in a top-k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: 50 * positive <= 100 * negative <= 95 * positive.
LOW, HIGH = 50, 95
#: Vectors that the directions come from, and most directions.
SAMPLE, REFERENCES = 1024, 48
BLOCK, ANCHOR_BLOCK, STEP = 4096, 2048, 64
#: From this norm on, a product may leave the range of a long.
TOO_LONG = 2.0**31


def usable(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(vec_id, label, v, norm): rows with an id, a label and a vector without null or
    non-finite components, scaled to whole numbers; repeated rows once."""
    v = F.col(vector_column).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), v.alias("v"), ok.alias("ok"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.col("ok"))
    rows = rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")).alias("v"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    return rows.where(F.col("norm") < TOO_LONG).dropDuplicates(["vec_id", "label", "v"])


def directions(sample: np.ndarray, most: int = REFERENCES) -> np.ndarray:
    """Orthogonal unit rows, the leading directions of the sample's unit vectors."""
    norm = np.sqrt((sample**2).sum(1))
    _, size, basis = np.linalg.svd(sample[norm > 0] / norm[norm > 0, None], full_matrices=False)
    return basis[:most][size[:most] > 1e-6]


def angles(v: np.ndarray, norm: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Of each row to each direction; a zero vector stands at a right angle to all."""
    return np.arccos(np.clip(v @ basis.T / np.where(norm > 0, norm, 1.0)[:, None], -1.0, 1.0))


class Rows:
    """A block's rows in order of id, with the cosines of their stored angles."""

    def __init__(self, pdf: pd.DataFrame, dim: int, n_directions: int):
        pdf = pdf.sort_values(["vec_id", "label"], kind="stable")
        self.ids, self.labels = pdf["vec_id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64)
        self.v = np.frombuffer(b"".join(pdf["v"]), np.float64).reshape(len(pdf), dim)
        self.norm = pdf["norm"].to_numpy(float)
        self.cos = np.cos(np.frombuffer(b"".join(pdf["angles"]), np.float64).reshape(len(pdf), n_directions))
        self.sin = np.sqrt(np.maximum(1.0 - (self.cos**2).sum(1), 0.0) + 1e-12)

    def window(self, of: Rows, which: np.ndarray, at: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest whole scores of the anchors ``at`` of ``of`` with the rows ``which``."""
        mid, half = of.cos[at] @ self.cos[which].T, np.outer(of.sin[at], self.sin[which])
        size = np.outer(of.norm[at], self.norm[which])
        slack = 1e-9 * size + 1e-6
        return np.ceil((np.maximum(mid - half, -1.0)) * size - slack), np.floor(np.minimum(mid + half, 1.0) * size + slack)

    def scores(self, which: np.ndarray, anchor: np.ndarray, norm: float) -> np.ndarray:
        """Exact inner products; a double holds every sum below 2^53."""
        if norm * self.norm[which].max(initial=0.0) < 2.0**52:
            return (self.v[which] @ anchor).astype(np.int64)
        return (self.v[which].astype(np.int64) * anchor.astype(np.int64)).sum(1)


def kth_largest(x: np.ndarray, k: int) -> float:
    return np.partition(x, len(x) - k)[len(x) - k] if len(x) >= k else -np.inf


def first_rows(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; ties by smaller id."""
    return np.lexsort((ids, -score))[:k]


def best_positives(rows: Rows, anchors: Rows, k: int) -> list[tuple[int, int, int, int, int]]:
    """(anchor row's id, its label, id, score, scored) of the best ``k`` of the same label."""
    out = []
    for label in np.unique(anchors.labels):
        which, of = np.flatnonzero(rows.labels == label), np.flatnonzero(anchors.labels == label)
        for i in range(0, len(of) if len(which) else 0, STEP):
            lo, hi = rows.window(anchors, which, of[i:i + STEP])
            for a, low, high in zip(of[i:i + STEP].tolist(), lo, hi, strict=True):
                other = rows.ids[which] != anchors.ids[a]
                near = which[other & (high >= kth_largest(low[other], k))]
                score = rows.scores(near, anchors.v[a], anchors.norm[a])
                out += [(a, int(rows.ids[near[j]]), int(score[j]), len(near)) for j in first_rows(rows.ids[near], score, k)]
    return out


def best_negatives(rows: Rows, anchors: Rows, positives: list, k: int) -> list[tuple[int, int, int, int, int]]:
    """(anchor, place of the positive, id, score, scored) of each positive's best ``k`` in its range.

    ``positives``: scores of each anchor's positives.
    """
    out = []
    for i in range(0, len(anchors.ids), STEP):
        every = np.arange(len(rows.ids))
        at = np.arange(i, min(i + STEP, len(anchors.ids)))
        lo, hi = rows.window(anchors, every, at)
        for a, low, high in zip(at.tolist(), lo, hi, strict=True):
            other = (rows.labels != anchors.labels[a]) & (rows.ids != anchors.ids[a])
            ranges = [(-(-LOW * int(p) // 100), HIGH * int(p) // 100) for p in positives[a]]
            need = np.zeros(len(every), bool)
            for bottom, top in set(ranges):
                if bottom <= top:
                    fit = other & (high >= bottom) & (low <= top)
                    sure = low[fit & (low >= bottom) & (high <= top)]
                    need |= fit & (high >= kth_largest(sure, k))
            near = np.flatnonzero(need)
            score = rows.scores(near, anchors.v[a], anchors.norm[a])
            order = first_rows(rows.ids[near], score, len(near))
            near, score = near[order], score[order]
            for place, (bottom, top) in enumerate(ranges):
                # Scores fall along ``near``: those of a range stand together.
                begin, end = np.searchsorted(-score, [-top, -bottom + 1])
                out += [(a, place, int(rows.ids[near[j]]), int(score[j]), len(near)) for j in range(begin, min(begin + k, end))]
    return out


def hard_negatives(vectors: DataFrame, anchor_ids: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
                   references: int = REFERENCES, block: int = BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, n_scored).

    ``anchor_ids``: condition on vec_id; ``label``: the label as an expression of
    vec_id and label.  ``n_scored``: rows of the negative's block that got an
    integer score for the anchor.  Rows with a null id, label, vector or component,
    or a non-finite one, take no part, nor do vectors of a scaled norm of 2^31 and
    more, whose scores may not fit a long.  A vector that is shorter than another
    stands for one with zeros behind.  Repeated rows count once; rows of an
    anchor's own id are neither its positives nor its negatives.  Ties go to the
    smaller id.  A positive without negatives has no rows, nor has an empty table.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, n_scored long"
    good = usable(vectors, id_column, vector_column, label_column)
    good = good.withColumn("label", (F.col("label") if label is None else label).cast("long"))
    good = stored(good.where(F.col("label").isNotNull()).withColumn("anchor", F.coalesce(anchor_ids, F.lit(False))), "scaled_vectors")
    size = good.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.count_if("anchor").alias("anchors")).first()
    n, dim, n_anchors = size["n"], size["dim"] or 0, size["anchors"]
    if not n_anchors:
        return spark.createDataFrame([], schema)
    padded = lambda vs: np.array([np.pad(np.asarray(v, float), (0, dim - len(v))) for v in vs]).reshape(len(vs), dim)
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").limit(SAMPLE).select("v").collect()  # bounded
    basis = directions(padded([r["v"] for r in sample]), references)

    def measure(batches):
        for pdf in batches:
            if len(pdf):
                v, norm = padded(pdf["v"].tolist()), pdf["norm"].to_numpy(float)
                yield pdf[["vec_id", "label", "anchor", "norm"]].assign(v=[x.tobytes() for x in v], angles=[x.tobytes() for x in angles(v, norm, basis)])

    index = stored(good.mapInPandas(measure, "vec_id long, label long, anchor boolean, norm double, v binary, angles binary"), "angles")
    n_blocks, a_blocks = -(-n // block), -(-n_anchors // anchor_block)
    deal = lambda count: F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(count)).cast("int")
    grid = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    cols = ["vec_id", "label", "norm", "v", "angles"]
    rows = index.select(*cols, deal(n_blocks).alias("b"), grid(a_blocks).alias("q")).groupBy("b", "q")
    asks = index.where("anchor").withColumn("anchor_row", F.struct("vec_id", "label", F.md5("v").alias("v")))
    read = lambda pdf: Rows(pdf, dim, len(basis))

    def asked(extra: DataFrame):
        return extra.select(*cols, "anchor_row", *[c for c in extra.columns if c == "positives"], deal(a_blocks).alias("q"), grid(n_blocks).alias("b")).groupBy("b", "q")

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["vec_id", "label"], kind="stable")
        got = best_positives(read(left), read(right), positives) if len(left) and len(right) else []
        key = right["anchor_row"].tolist()
        return pd.DataFrame({"anchor_row": [key[g[0]] for g in got], "positive_id": [g[1] for g in got], "positive_score": [g[2] for g in got]})

    row = "anchor_row struct<vec_id: long, label: long, v: string>"
    lists = rows.cogroup(asked(asks)).applyInPandas(near, f"{row}, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), "positive_id")
    best = lists.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    found = best.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))  # at most ``positives`` each
    found = stored(asks.join(found, "anchor_row"), "anchors")

    def hard(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["vec_id", "label"], kind="stable")
        pos = [list(x) for x in right["positives"]]
        got = best_negatives(read(left), read(right), [[p["positive_score"] for p in x] for x in pos], negatives) if len(left) and len(right) else []
        key, ids = right["anchor_row"].tolist(), right["vec_id"].tolist()
        return pd.DataFrame({"anchor_row": [key[g[0]] for g in got], "place": [g[1] for g in got], "anchor_id": [ids[g[0]] for g in got],
                             "positive_id": [pos[g[0]][g[1]]["positive_id"] for g in got], "positive_score": [pos[g[0]][g[1]]["positive_score"] for g in got],
                             "negative_id": [g[2] for g in got], "negative_score": [g[3] for g in got], "n_scored": [g[4] for g in got]})

    lists = rows.cogroup(asked(found)).applyInPandas(hard, f"{row}, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long, n_scored long")
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "n_scored")


ORACLE_SQL = f"""
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id, x.label = a.label AS same, list_inner_product(a.v, x.v)::BIGINT AS score
      FROM v AS a, v AS x WHERE a.vec_id % 50 = 0 AND x.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
