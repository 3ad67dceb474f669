"""Operator 5: repeated runs of lines, by prefix doubling over line ids.

Each distinct text is a sequence of line ids; all of them together are the string
whose suffixes are ranked.  Texts that are equal as a whole are one sequence:
every line of a later copy has its earlier copy in the first.

1. Level 0 ranks the lines that occur twice or more.  Others end every repeat, so
   only runs of such lines with ``min_words`` words or more are looked at.  A round of doubling pairs a place's rank with the rank h lines further and
   ranks the distinct pairs by their order, so places share a rank at level k if
   their next 2**k lines are equal.  Ranks are row numbers of a stored table that
   is partitioned by range: order-preserving without one task seeing all rows.
   Pairs that occur once leave, so the rounds shrink.
2. A repeat counts from ``min_words`` words.  The shortest window from a place
   that holds so many words, and the shortest one that ends there, depend on the
   lines alone; with n lines, two overlapping windows of 2**k lines (2**k <= n)
   name it exactly: places with equal (n, rank, rank) are one interval of the
   suffix array with a common prefix of n lines.  Each line of a maximal repeated
   run of ``min_words`` or more lies in one of these windows, and each of these
   windows in such a run, so the union of the windows that have an earlier
   place is the union of the runs' later copies.
3. These lines are deleted.  An earlier copy may overlap the later one: of a short
   period that a text repeats, one period stays (of 30 equal lines, the first).

A window has at most ``min_words`` lines, as lines without words are not in the
sequence; so the rounds don't grow with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import stored, text_key, text_steps

MIN_WORDS = 50


def _order_key(doc_id, key):
    """A text that sorts by doc_id, nulls last, then by content key."""
    shifted = F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(shifted, F.lit("null")), F.lit(":"), key)


def _ranked(df: DataFrame, columns: list[str], name: str, rank: str) -> DataFrame:
    """``df`` with a number that sorts as ``columns`` do (stored, hence fixed)."""
    return stored(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn(rank, F.monotonically_increasing_id()), name)


def distinct_sequences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(d, key, first, lids, words, lines): one row per distinct text with a word,
    in the order of its smallest doc_id; 128-bit ids and word counts of its lines
    that hold words, and those lines' numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_steps(batches):
            ids, words, lines, ends = [], [], [], [0]
            for t in texts:
                for i, x in enumerate(t.split("\n")):
                    n = len(x.split())
                    if n:
                        ids.append(xxhash.xxh3_128_digest(x.encode()))
                        words.append(n)
                        lines.append(i)
                ends.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((ids, pa.binary()), (words, pa.int32()), (lines, pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["doc_id", "key", "ids", "words", "lines"])

    own = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_key(own).alias("key"), own.alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, key string, ids array<binary>, words array<int>, lines array<int>")
    one = rows.where(F.size("ids") > 0).groupBy("key").agg(F.min("doc_id").alias("first"), F.first(F.struct("ids", "words", "lines")).alias("x"))
    named = one.select("key", "first", F.col("x.ids").alias("lids"), "x.words", "x.lines", _order_key(F.col("first"), F.col("key")).alias("o"))
    return _ranked(named, ["o"], "sequences", "d").drop("o")


def windows(words: np.ndarray, least: int) -> np.ndarray:
    """(start, lines) of the shortest windows with ``least`` words from each place and up to each place."""
    n = len(words)
    before = np.r_[0, np.cumsum(words)]
    end = np.searchsorted(before, before[:-1] + least, "left")  # exclusive end, n + 1: none
    a = np.flatnonzero(end <= n)
    start = np.searchsorted(before, before[1:] - least, "right") - 1
    b = np.flatnonzero(start >= 0)
    rows = np.r_[np.column_stack([a, end[a] - a]), np.column_stack([start[b], b + 1 - start[b]])]
    return np.unique(rows.astype(np.int64).reshape(-1, 2), axis=0)


def repeated_runs(sequences: DataFrame, least: int) -> DataFrame:
    """(d, p, r, n), stored: the places in runs of lines that all occur twice or more
    and hold ``least`` words or more, with their line's rank r; and, with n lines, the
    windows of such runs.  No other place can be in a repeated window."""
    lines = sequences.select("d", F.posexplode(F.arrays_zip("lids", "words")).alias("p", "x")).select("d", F.col("p").cast("long").alias("p"), "x.lids", "x.words")
    again = _ranked(lines.groupBy("lids").count().where("count > 1").select("lids"), ["lids"], "level-ids", "r")
    # At most the text's own lines in each group.
    own = lines.join(again, "lids").groupBy("d").agg(F.sum("words").alias("n"), F.array_sort(F.collect_list(F.struct("p", "r", "words"))).alias("x")).where(F.col("n") >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, places in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                p, r, words = (places.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                cuts = np.flatnonzero(np.diff(p) != 1) + 1
                out = []
                for a, b in zip([0, *cuts], [*cuts, len(p)], strict=True):
                    if words[a:b].sum() >= least:
                        w = windows(words[a:b], least)
                        out.append(pa.table({"p": np.r_[p[a:b], w[:, 0] + p[a]], "r": pa.array([*r[a:b].tolist(), *[None] * len(w)], pa.int64()),
                                             "n": pa.array([*[None] * (b - a), *w[:, 1].tolist()], pa.int64())}))
                if out:
                    all_ = pa.concat_tables(out).combine_chunks()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(all_), d)), *(all_[c].chunk(0) for c in ("p", "r", "n"))], ["d", "p", "r", "n"])

    return stored(own.select("d", "x").mapInArrow(run, "d long, p long, r long, n long"), "repeated-runs")


def doubled(places: DataFrame, levels: int) -> list[DataFrame]:
    """Tables (d, p, r) by level: the rank of each place's next 2**level lines,
    for the places that share it with another.  ``places``: those of single lines."""
    now, out = places, [places]
    for k in range(levels):
        further = now.select("d", (F.col("p") - (1 << k)).alias("p"), F.col("r").alias("r2"))
        pairs = now.join(further, ["d", "p"])
        again = _ranked(pairs.groupBy("r", "r2").count().where("count > 1").select("r", "r2"), ["r", "r2"], "level-pairs", "new")
        now = stored(pairs.join(again, ["r", "r2"]).select("d", "p", F.col("new").alias("r")), f"level-{k + 1}")
        out.append(now)
    return out


def later_copies(sequences: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, p, n): windows of n lines from line p of sequence d that have an earlier copy."""
    top = max(0, int(math.log2(max(1, min_words))))
    runs = repeated_runs(sequences, min_words)
    levels = doubled(runs.where(F.col("r").isNotNull()).select("d", "p", "r"), top)
    at = runs.where(F.col("n").isNotNull()).select("d", "p", "n", F.floor(F.log2("n") + 1e-9).cast("int").alias("k"))
    named = None
    for k, level in enumerate(levels):
        first = at.where(F.col("k") == k).join(level.withColumnRenamed("r", "a"), ["d", "p"])
        last = level.select("d", F.col("p").alias("q"), F.col("r").alias("b"))
        both = first.withColumn("q", F.col("p") + F.col("n") - (1 << k)).join(last, ["d", "q"]).select("d", "p", "n", "k", "a", "b")
        named = both if named is None else named.union(both)
    named = stored(named, "named-windows")
    place = F.struct("d", "p")
    firsts = stored(named.groupBy("k", "n", "a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "first-windows")
    return named.join(firsts, ["k", "n", "a", "b"]).where(F.col("first") < place).select("d", "p", "n")


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(key, first, n_words, lines): per distinct text that has any, or that
    occurs under several doc_ids, the numbers of the lines to delete in its first copy."""
    seq = distinct_sequences(docs, id_column, text_column)
    hit = later_copies(seq, min_words)
    # At most the text's own lines in each group.
    gone = hit.select("d", F.explode(F.sequence("p", F.col("p") + F.col("n") - 1)).alias("p")).distinct().groupBy("d").agg(F.collect_list("p").alias("gone"))
    all_words = F.aggregate("words", F.lit(0), lambda a, x: a + x)
    rows = seq.select("d", "key", "first", all_words.alias("n_words"), "lines").join(gone, "d", "left")
    numbers = F.transform(F.coalesce("gone", F.array().cast("array<bigint>")), lambda p: F.get("lines", p.cast("int")))
    return stored(rows.select("key", "first", "n_words", numbers.alias("gone")), "deleted-lines")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text", drop_empty: bool = False) -> DataFrame:
    """``docs`` with the later copies of repeated runs of lines deleted from its texts.

    The order of copies is that of doc_id (null last), for one doc_id that of the
    content keys, then of lines.  Rows with one doc_id and equal texts are one
    document and stay alike.  Lines without words are no part of runs and stay,
    but not in a text of which a whole copy stands earlier (``min_words`` or
    more): it becomes empty.  Null texts stay null.  ``drop_empty`` leaves out
    documents that had words and have none now.
    """
    gone = deleted_lines(docs, min_words, id_column, text_column)
    names = docs.columns
    k, f, w, g, t = "\0key", "\0first", "\0words", "\0gone", "\0text"
    own = F.col(f"`{text_column}`").cast("string")
    changes = gone.where((F.size("gone") > 0) | (F.col("n_words") >= min_words)).select(F.col("key").alias(k), F.col("first").alias(f), F.col("n_words").alias(w), F.col("gone").alias(g))
    met = docs.withColumn(k, text_key(F.coalesce(own, F.lit("")))).join(changes, k, "left")
    later = F.col(w).isNotNull() & (F.col(w) >= min_words) & ~F.col(f"`{id_column}`").cast("long").eqNullSafe(F.col(f))
    kept = F.array_join(F.filter(F.split(own, "\n", -1), lambda x, i: ~F.array_contains(F.col(g), i)), "\n")
    new = F.when(own.isNull() | F.col(k).isNull(), own).when(later, F.lit("")).when(F.size(F.coalesce(F.col(g), F.array().cast("array<int>"))) > 0, kept).otherwise(own)
    out = met.withColumn(t, new)
    if drop_empty:
        changed = F.col(w).isNotNull() & ~F.col(t).rlike(r"\S")
        out = out.where(~F.coalesce(changed, F.lit(False)))
    return out.select(*[F.col(t).alias(c) if c == text_column else F.col(f"`{c}`") for c in names])
