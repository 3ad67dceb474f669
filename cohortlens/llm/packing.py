"""Operator 9: concatenate and cut.

All documents, each followed by an end id, form one stream; the stream is cut
into windows of fixed length.  Pass 1 encodes each input partition, writes the
ids with each document's start *inside its partition*, and so yields the
partitions' token totals.  The prefix sums of those totals (one number per
partition) are the partitions' global offsets.  Pass 2 adds them and cuts each
document where a window ends; no row moves.  A window that lies in several
partitions (or read splits) consists of boundary records, which
:func:`sequences` joins by window number; all other windows are put together
where their rows are read.  The order of the stream is that of the input's
partitions and of the rows in them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import LibraryEncoder, _inputs
from .common import per_executor, stored, text_steps

WINDOW = 2048
END_ID = 1
_TOKENS = "part int, local_start long, doc_id long, doc_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def token_table(docs: DataFrame, path: str, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pass 1, written to the shared folder: ids (unsigned 16-bit where the
    vocabulary allows, else 32-bit) with their start inside the partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = per_executor(LibraryEncoder, path)
        kind = "<u2" if max(len(enc.vocab.bytes), end_id + 1) <= 1 << 16 else "<u4"
        part, at = TaskContext.get().partitionId(), 0
        end = np.array([end_id], kind)
        for rows, texts in text_steps(batches):
            ids = [np.concatenate([np.frombuffer(i, "<u4").astype(kind), end]) for i in enc.encode(texts)]
            n = np.array([len(i) for i in ids], np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(n), part, np.int32)), pa.array(starts), rows.column(0), pa.array(n),
                pa.array([i.tobytes() for i in ids], pa.binary()),
            ], ["part", "local_start", "doc_id", "doc_tokens", "ids"])

    return stored(_inputs(docs, id_column, text_column).mapInArrow(run, _TOKENS), "tokens")


def offsets(tokens: DataFrame) -> DataFrame:
    """(part, part_start): exclusive prefix sums of the partitions' totals.

    One row per input partition of pass 1, however many rows these hold.
    """
    totals = tokens.groupBy("part").agg(F.max(F.col("local_start") + F.col("doc_tokens")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces: doc_id, start and length in the document, doc_tokens (with the end
    id), sequence_id, offset in the sequence, ids (little-endian uint32).

    Each id of each document lies in exactly one piece; sequences are full but
    for the last, and gapless from offset 0.  A null or empty text is the end id
    alone; a null doc_id stays null; repeated rows are packed each for
    themselves; no rows give no pieces; further columns are left out.
    """
    tokens = token_table(docs, path, end_id, id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            at = cols["at"].to_numpy()
            n = cols["doc_tokens"].to_numpy()
            first, last = at // window, (at + n - 1) // window
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            lo = np.maximum(seq * window, at[row])
            hi = np.minimum((seq + 1) * window, at[row] + n[row])
            raw = cols["ids"]
            ids, known, now = [], -1, None
            for r, a, b in zip(row.tolist(), (lo - at[row]).tolist(), (hi - at[row]).tolist(), strict=True):
                if r != known:
                    buf = raw[r].as_py()
                    now, known = np.frombuffer(buf, "<u2" if len(buf) == 2 * n[r] else "<u4"), r
                ids.append(now[a:b].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([
                cols["doc_id"].take(pa.array(row)), pa.array(lo - at[row]), pa.array(hi - lo), pa.array(n[row]),
                pa.array(seq), pa.array(lo - seq * window), pa.array(ids, pa.binary()),
            ], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    # The broadcast side has one row of two numbers per partition of pass 1.
    placed = tokens.join(F.broadcast(offsets(tokens)), "part")
    return placed.select("doc_id", "doc_tokens", (F.col("part_start") + F.col("local_start")).alias("at"), "ids").mapInArrow(run, _PIECES)


def pieces_digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def padded_length(n: int, window: int = WINDOW) -> int:
    """Length of a sequence of ``n`` ids when written: a power of two as it is, else the window."""
    return n if n & (n - 1) == 0 else window


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids): the windows, the last one padded.

    Windows whose pieces are all read by one task are put together there; the
    others leave as boundary records and meet by sequence_id (at most ``window``
    ids in each group).
    """
    schema = "sequence_id long, offset long, ids binary, n_tokens long"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's rows are in stream order, so a window is over when the next one begins.
        seq, held = None, []

        def out():
            got = b"".join(x for _, x in held)
            if held[0][0] == 0 and len(got) == 4 * window:
                return [(seq, 0, got, window)]
            return [(seq, o, x, len(x) // 4) for o, x in held]

        for batch in batches:
            rows = []
            for s, o, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if s != seq:
                    if held:
                        rows += out()
                    seq, held = s, []
                held.append((o, x))
            yield _rows(rows)
        if held:
            yield _rows(out())

    def _rows(rows):
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64())], ["sequence_id", "offset", "ids", "n_tokens"])

    parts = pieces.select("sequence_id", "offset", "ids").mapInArrow(local, schema)
    met = parts.groupBy("sequence_id").agg(F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    joined = F.aggregate("x", F.lit("").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    pow2 = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    fill = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), F.when(pow2, 0).otherwise(F.lit(window) - F.col("n_tokens")).cast("int")))
    return met.select("sequence_id", "n_tokens", F.concat(joined, fill).alias("ids"))
