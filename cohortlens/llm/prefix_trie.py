"""Operator 13: the trie of conversation prefixes from sorted common prefixes.

Each conversation is a sequence of turn keys (128-bit digests of role and text).
The sequences are sorted; ``lcp[i]`` is the number of leading turns that row i
shares with row i - 1.  The rows that start with row i's first d turns are an
interval [L, R] around i: a candidate prefix (i, d) finds either end on its own,
by a binary search over a sparse table of range minima of ``lcp``, without a
stack.  (i, d) with d > lcp[i] is the first place of its prefix, so each node is
made once; with d = lcp[i] it is the parent of the row's first new node.

What a node holds are sums over its interval: members and their smallest id (a
second sparse table), childless nodes (rows that the next row doesn't extend),
children (rows with lcp = d that go on), and saved tokens, the sum of the code
points that rows share with the row before, less those above the node.

The sorted rows are dealt by range into blocks of some ``BLOCK_TURNS`` turns, a
large group of equal conversations into many.  A block's summary is one row of
numbers: its minimum, totals, and the steps of the running minima of ``lcp``
from either end, of which there are fewer than sqrt(2 * turns of the block).  A
sparse table over the summaries carries a search that leaves its block on, over
whole blocks, into the steps of the block where it ends.  The ids of equal
conversations that cross blocks are hashed in a stream.

A conversation's keys and turn lengths (36 bytes a turn, no texts) are held as
one row; the texts stay where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import stored

#: Turns of a block, about; ids in one piece of a run that crosses blocks.
BLOCK_TURNS, PIECE = 1 << 17, 4096
#: Hex digits of a turn's key.
KEY = 32
#: Conversations of one group share a head; most turns of a head, plus one.
GROUP, HEAD = 100, 6
FAR = np.int64(2**62)
NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string")


def turns_of(conversations: DataFrame, id_column: str = "conv_id", turn_column: str = "turn",
             role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(conv_id, t): each conversation's turns in order, as (known, turn, key, chars).

    Null turns come first; equal ones are ordered by the key, each counts.  A null
    role or text is empty.  Rows without an id take no part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_column, text_column))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, KEY)
    turn = F.col(turn_column)
    rows = conversations.select(F.col(id_column).cast("long").alias("conv_id"), F.struct(
        turn.isNotNull().alias("known"), turn.alias("turn"), key.alias("key"), F.length(text).alias("chars")).alias("x"))
    return rows.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("t"))


def head_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string")) % HEAD).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """The turns with each conversation's first h, of its own, replaced by the first
    h of conversation c - c % 100 (SQL's remainder; all if fewer, none if absent);
    h is :func:`head_turns`."""
    heads = turns.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("head_id"), F.slice("t", 1, HEAD - 1).alias("head"))
    both = turns.withColumn("head_id", F.col("conv_id") - F.col("conv_id") % GROUP).join(heads, "head_id", "left")
    h = head_turns(F.col("conv_id"))
    none = F.slice("t", 1, 0)
    head = F.coalesce(F.slice("head", F.lit(1), h), none)
    return both.select("conv_id", F.concat(head, F.slice("t", h + 1, F.size("t"))).alias("t"))


def range_min(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: level k holds the minima of 2^k values from each place on."""
    table = [np.asarray(values)]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def least(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of the values in [lo, hi]; FAR where the range is empty."""
    lo, hi = np.asarray(lo), np.asarray(hi)
    out = np.full(len(lo), FAR)
    width = hi - lo + 1
    level = np.zeros(len(lo), np.int64)
    level[width > 0] = np.log2(width[width > 0]).astype(np.int64)
    for k in np.unique(level[width > 0]):
        at = (level == k) & (width > 0)
        out[at] = np.minimum(table[k][lo[at]], table[k][hi[at] - (1 << k) + 1])
    return out


def right_end(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Largest r with no value below ``depth`` in (at, r]."""
    r, n = np.array(at, np.int64), len(table[0])
    for k in range(len(table) - 1, -1, -1):
        fits = r + (1 << k) < n
        step = np.zeros(len(r), bool)
        step[fits] = table[k][r[fits] + 1] >= depth[fits]
        r[step] += 1 << k
    return r


def left_end(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Smallest s >= 0 with no value below ``depth`` in (s, at]."""
    s = np.array(at, np.int64)
    for k in range(len(table) - 1, -1, -1):
        fits = s - (1 << k) >= 0
        step = np.zeros(len(s), bool)
        step[fits] = table[k][s[fits] - (1 << k) + 1] >= depth[fits]
        s[step] -= 1 << k
    return s


def shared_turns(a: str, b: str) -> int:
    if a == b:
        return len(a) // KEY
    d, most = 0, min(len(a), len(b))
    while d < most and a[d:d + KEY] == b[d:d + KEY]:
        d += KEY
    return d // KEY


class Block:
    """A block's sorted rows.  ``border``: turns that its first row shares with the row before."""

    def __init__(self, pdf: pd.DataFrame, border: int = -1):
        pdf = pdf.sort_values(["key", "conv_id"], kind="stable")
        self.keys = pdf["key"].tolist()
        self.ids = pdf["conv_id"].to_numpy(np.int64)
        self.n = len(self.ids)
        chars = [np.asarray(c, np.int64) for c in pdf["chars"]]
        self.lens = np.array([len(c) for c in chars], np.int64)
        self.flat = np.concatenate([[0], *chars]).cumsum()
        self.off = np.concatenate([[0], self.lens.cumsum()])[:-1]
        self.lcp = np.array([border, *(shared_turns(a, b) for a, b in zip(self.keys, self.keys[1:]))], np.int64)
        self.shared = self.above(np.arange(self.n), np.maximum(self.lcp, 0))
        self.same = np.concatenate([[False], (self.lcp[1:] == self.lens[1:]) & (self.lens[1:] == self.lens[:-1])])
        self.leaf = np.concatenate([self.lcp[1:] < self.lens[:-1], [False]])  # of the last row: not known here
        self.goes_on = self.lens > self.lcp

    def above(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Code points in the row's first ``depth`` turns."""
        return self.flat[self.off[row] + depth] - self.flat[self.off[row]]

    def summary(self) -> dict:
        inside = self.lcp[1:]
        low = np.minimum.accumulate(inside)
        at = np.flatnonzero(np.concatenate([[True], low[1:] < low[:-1]])[:len(inside)]) + 1  # records from the left
        back = np.minimum.accumulate(inside[::-1])
        back_at = self.n - 1 - np.flatnonzero(np.concatenate([[True], back[1:] < back[:-1]])[:len(inside)])
        least_id, least_end = np.minimum.accumulate(self.ids), np.minimum.accumulate(self.ids[::-1])[::-1]
        leaves, shared = np.concatenate([[0], self.leaf.cumsum()]), np.concatenate([[0], self.shared[1:].cumsum()])
        # Children at the depth that holds up to a step, of the rows before it.
        held = [FAR, *self.lcp[at].tolist()]
        kids = lambda d, end: int(((inside[:end - 1] == d) & self.goes_on[1:end]).sum())
        return {
            "n": self.n, "first": self.keys[0], "last": self.keys[-1], "first_chars": np.diff(self.flat[:self.lens[0] + 1]), "first_len": self.lens[0], "last_len": self.lens[-1],
            "inside": inside.min() if self.n > 1 else FAR, "kids": kids(inside.min(), self.n) if self.n > 1 else 0,
            "shared": self.shared[1:].sum(), "leaves": self.leaf.sum(), "least": self.ids.min(), "single": bool(self.same[1:].all()),
            "step_depth": self.lcp[at], "step_at": at, "step_least": least_id[at - 1], "step_shared": shared[at - 1], "step_leaves": leaves[at],
            "step_kids": [kids(d, int(e)) for d, e in zip(held, at, strict=False)],
            "back_depth": self.lcp[back_at], "back_least": least_end[back_at],
        }


SUMMARY = ("n long, first string, last string, first_chars array<long>, first_len long, last_len long, inside long, kids long, shared long, leaves long, "
           "least long, single boolean, step_depth array<long>, step_at array<long>, step_least array<long>, step_shared array<long>, "
           "step_leaves array<long>, step_kids array<long>, back_depth array<long>, back_least array<long>")


class Blocks:
    """The summaries of all blocks in order, and the searches over them."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values("block")
        long = lambda c: pdf[c].to_numpy(np.int64)
        self.number = long("block")
        self.count, self.border, self.inside = len(pdf), long("border"), long("inside")
        self.first_len, self.last_len = long("first_len"), long("last_len")
        self.steps = {c: pdf[c].tolist() for c in pdf.columns if c.startswith(("step_", "back_"))}
        lowest = np.minimum(self.border, self.inside)
        self.low, self.least = range_min(lowest), range_min(long("least"))
        nxt = np.append(self.border[1:], -1)
        self.end_leaf = nxt < self.last_len
        sums = {"n": long("n"), "shared": long("shared") + long("border_chars"), "leaves": long("leaves") + self.end_leaf}
        self.sums = {k: np.concatenate([[0], v.cumsum()]) for k, v in sums.items()}
        self.first_on = self.first_len > self.border
        kids = ((self.border == lowest) & self.first_on) + np.where(self.inside == lowest, long("kids"), 0)
        order = np.lexsort((np.arange(self.count), lowest))
        self.kid_at, self.kid_sum = lowest[order] * (self.count + 1) + order, np.concatenate([[0], kids[order].cumsum()])
        self.border_chars = long("border_chars")
        # A run of equal rows goes on over a border; the block in which a block's last run begins.
        self.chain = np.append(False, (self.border[1:] == self.first_len[1:]) & (self.first_len[1:] == self.last_len[:-1]))
        through = pdf["single"].to_numpy(bool) & self.chain
        self.run_start = np.maximum.accumulate(np.where(through, 0, np.arange(self.count)))

    def to_the_right(self, b: int, depth: int) -> tuple[int, int, int, int, int]:
        """(rows, shared, leaves, children, least id) behind block b of the prefix of its last row's first ``depth`` turns."""
        one = np.array([depth])
        t = int(right_end(self.low, np.array([b]), one)[0])
        rows, shared, leaves = (int(self.sums[k][t + 1] - self.sums[k][b + 1]) for k in ("n", "shared", "leaves"))
        lo, hi = np.searchsorted(self.kid_at, [depth * (self.count + 1) + b + 1, depth * (self.count + 1) + t + 1])
        kids = int(self.kid_sum[hi] - self.kid_sum[lo])
        lowest = int(least(self.least, np.array([b + 1]), np.array([t]))[0])
        u = t + 1
        if u < self.count and self.border[u] >= depth:
            at = self.steps["step_depth"][u]
            k = next(i for i, v in enumerate(at) if v < depth)  # it ends in this block
            rows += int(self.steps["step_at"][u][k])
            shared += int(self.steps["step_shared"][u][k]) + int(self.border_chars[u])
            leaves += int(self.steps["step_leaves"][u][k])
            kids += int(self.border[u] == depth and self.first_on[u])
            if k and at[k - 1] == depth:
                kids += int(self.steps["step_kids"][u][k])
            lowest = min(lowest, int(self.steps["step_least"][u][k]))
        return rows, shared, leaves, kids, lowest

    def to_the_left(self, b: int, depth: int) -> int:
        """Smallest id, before block b, of the prefix of its first row's first ``depth`` turns (at most its border)."""
        t = b if self.low[0][b - 1] < depth else int(left_end(self.low, np.array([b - 1]), np.array([depth]))[0])
        if t < b and self.low[0][t] < depth:
            t += 1
        lowest = int(least(self.least, np.array([t]), np.array([b - 1]))[0])
        u = t - 1
        if u >= 0:
            k = next((i for i, v in enumerate(self.steps["back_depth"][u]) if v < depth), None)
            lowest = min(lowest, int(self.least[0][u] if k is None else self.steps["back_least"][u][k]))
        return lowest


def joined(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def nodes_of(block: Block, b: int, blocks: Blocks) -> tuple[pd.DataFrame, list[tuple[int, int, bytes]]]:
    """The nodes whose first member is in block b, with ``run`` where the ids of the
    members that end there go on behind it; and (run, part, ids) of such runs."""
    n, lens, lcp = block.n, block.lens, block.lcp
    lows, ids = range_min(lcp), range_min(block.ids)
    leaf = np.concatenate([[0], block.leaf.cumsum()])
    leaf[n] += blocks.end_leaf[b]
    shared = np.concatenate([[0], block.shared.cumsum()])
    kid_at = np.sort((lcp * (n + 1) + np.arange(n))[block.goes_on])
    behind = np.array([blocks.to_the_right(b, d) for d in range(int(lens[-1]) + 1)], np.int64)
    before = np.array([blocks.to_the_left(b, d) for d in range(int(lcp[0]) + 1)], np.int64) if b else np.zeros(0, np.int64)

    def interval(row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Right end in the block, the sums behind it, and the smallest id from ``row`` on."""
        r = right_end(lows, row, depth)
        more = np.tile(np.array([0, 0, 0, 0, FAR]), (len(row), 1))
        more[r == n - 1] = behind[depth[r == n - 1]]
        return r, more, np.minimum(least(ids, row, r), more[:, 4])

    each = lens - lcp
    row = np.repeat(np.arange(n), each)
    depth = np.arange(len(row)) - np.repeat(each.cumsum() - each, each) + lcp[row] + 1
    r, more, conv = interval(row, depth)
    members = r - row + 1 + more[:, 0]
    top = np.maximum(depth - 1, 0)
    saved = shared[r + 1] - shared[row + 1] + more[:, 1] - (members - 1) * np.where(depth > 0, block.above(row, top), 0)
    lo, hi = np.searchsorted(kid_at, depth * (n + 1) + row + 1), np.searchsorted(kid_at, depth * (n + 1) + r + 1)
    children = (lens[row] > depth) + hi - lo + more[:, 3]

    # Parents: of a row's first new node by its own search to both sides, of the others the node before.
    parent = np.zeros(len(conv), np.int64)
    parent[1:] = conv[:-1]
    first = np.flatnonzero(depth == lcp[row] + 1)
    i, d = row[first], lcp[row[first]]
    has = d >= 0
    i, d = i[has], d[has]
    s = left_end(lows, i, d)
    left = least(ids, s, i)
    out = (s == 0) & (lcp[0] >= d)
    left[out] = np.minimum(left[out], before[d[out]])
    parent[first[has]] = np.minimum(left, interval(i, d)[2])

    starts = np.append(np.flatnonzero(~block.same), n)
    run_end = dict(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
    open_end = b + 1 < blocks.count and bool(blocks.chain[b + 1])
    none = hashlib.sha256().hexdigest()
    ends, run = [none] * len(row), np.full(len(row), -1, np.int64)
    for k in np.flatnonzero(depth == lens[row]).tolist():
        end = run_end[int(row[k])]
        if end == n and open_end:
            run[k], ends[k] = blocks.number[b], None
        else:
            ends[k] = hashlib.sha256(joined(block.ids[row[k]:end])).hexdigest()
    nodes = pd.DataFrame({"conv_id": conv, "depth": depth, "parent_conv_id": pd.array(parent, "Int64"), "n_convs": members, "n_children": children,
                          "n_leaves": leaf[r + 1] - leaf[row] + more[:, 2], "saved_tokens": saved, "ends_sha256": ends, "run": pd.array(run, "Int64")})
    nodes.loc[nodes["depth"] == 0, "parent_conv_id"] = pd.NA
    nodes.loc[nodes["run"] < 0, "run"] = pd.NA
    crossing = []
    if blocks.chain[b]:
        crossing.append((int(blocks.number[blocks.run_start[b - 1]]), 0, int(starts[1])))
    if open_end and not (blocks.chain[b] and len(starts) == 2):
        crossing.append((int(blocks.number[b]), int(starts[-2]), n))
    pieces = [(run, at, joined(block.ids[at:min(at + PIECE, hi)])) for run, lo, hi in crossing for at in range(lo, hi, PIECE)]
    return nodes, pieces


def run_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(run, ends_sha256) of pieces sorted by run, block and place; one piece in hand at a time."""
    now, digest = None, None
    for pdf in batches:
        done = []
        for run, ids in zip(pdf["run"], pdf["ids"], strict=True):
            if run != now:
                if digest is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = run, hashlib.sha256(bytes(ids))
            else:
                digest.update(b",")
                digest.update(bytes(ids))
        if done:
            yield pd.DataFrame(done, columns=["run", "ends_sha256"])
    if digest is not None:
        yield pd.DataFrame([(now, digest.hexdigest())], columns=["run", "ends_sha256"])


def prefix_trie(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per distinct prefix of the sequences of ``turns`` (conv_id, t), see
    :func:`turns_of`: conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation without turns is a member of the root only; no conversations
    give no rows, not even a root.  Equal conversations share all their nodes.
    """
    spark = turns.sparkSession
    rows = stored(turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["key"]), "").alias("key"), F.transform("t", lambda x: x["chars"]).alias("chars")), "sequences")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("chars")).alias("turns")).first()
    n_blocks = max(1, -(-((size["turns"] or 0) + size["n"]) // block_turns))
    dealt = rows.repartitionByRange(n_blocks, "key", "conv_id").withColumn("block", F.spark_partition_id().cast("long"))
    dealt = stored(dealt, "sorted_sequences")

    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"block": key[0], **Block(pdf).summary()}])

    def borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            border = [-1 if a is None else shared_turns(a, b) for a, b in zip(pdf.pop("earlier"), pdf["first"], strict=True)]
            chars = [int(sum(c[:max(d, 0)])) for c, d in zip(pdf.pop("first_chars"), border, strict=True)]
            yield pdf.drop(columns=["first", "last"]).assign(border=border, border_chars=chars)

    summaries = dealt.groupBy("block").applyInPandas(summarise, f"block long, {SUMMARY}")
    beside = stored(summaries, "trie_blocks").withColumn("earlier", F.lag("last").over(Window.orderBy("block")))  # one row a block
    kept = [f for f in SUMMARY.split(", ") if f.split()[0] not in ("first", "last", "first_chars")]
    found = beside.mapInPandas(borders, f"block long, {', '.join(kept)}, border long, border_chars long").toPandas()  # numbers of each block
    if not len(found):
        return spark.createDataFrame([], NODES)
    blocks = Blocks(found)
    at = {int(k): i for i, k in enumerate(blocks.number)}

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        b = at[int(key[0])]
        nodes, pieces = nodes_of(Block(pdf, int(blocks.border[b])), b, blocks)
        none = [None] * len(pieces)
        cols = {c: [*nodes[c].tolist(), *none] for c in nodes.columns}
        cols["run"][len(nodes):] = [run for run, *_ in pieces]
        blank = [None] * len(nodes)
        cols |= {"part": [*blank, *([b] * len(pieces))], "place": [*blank, *(at for _, at, _ in pieces)], "ids": [*blank, *(ids for *_, ids in pieces)]}
        return pd.DataFrame({c: pd.Series([None if x is pd.NA else x for x in v], dtype=object) for c, v in cols.items()})

    made = f"{NODES}, run long, part long, place long, ids binary"
    out = stored(dealt.groupBy("block").applyInPandas(build, made), "trie_nodes")
    names = [f.split()[0] for f in NODES.split(", ")]
    pieces = out.where(F.col("ids").isNotNull()).select("run", "part", "place", "ids")
    digests = pieces.repartition("run").sortWithinPartitions("run", "part", "place").select("run", "ids").mapInPandas(run_digests, "run long, ends_sha256 string")
    nodes = out.where(F.col("depth").isNotNull())
    crossing = nodes.where(F.col("run").isNotNull()).drop("ends_sha256").join(digests, "run").select(names)
    return nodes.where(F.col("run").isNull()).select(names).unionByName(crossing)


#: A decimal id's CRC-32 by shifts: each byte, then eight times -1 for its bits.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295::BIGINT)"""

ORACLE_SQL = f"""
WITH x AS (SELECT conv_id, turn, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS w FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(w ORDER BY turn NULLS FIRST, sha256(length(w.r)::VARCHAR || ':' || w.r || w.t)) AS t FROM x GROUP BY conv_id),
h AS (SELECT conv_id, t, ({_CRC} % {HEAD})::INT AS h FROM own),
re AS (SELECT h.conv_id, list_concat(coalesce(b.t, [])[1:h.h], h.t[h.h + 1:]) AS t FROM h LEFT JOIN own AS b ON b.conv_id = h.conv_id - h.conv_id % {GROUP}),
p AS (SELECT conv_id, len(t) AS n, d, t[1:d] AS pre FROM re, unnest(range(0, len(t) + 1)) AS u(d)),
node AS (SELECT d AS depth, pre, min(conv_id) AS conv_id, count(*) AS n_convs,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256,
                CASE WHEN d > 0 THEN (count(*) - 1) * length(pre[d].t) ELSE 0 END AS own_saved, max(n) = d AS childless
         FROM p GROUP BY d, pre),
sub AS (SELECT top.depth, top.pre, sum(low.own_saved) AS saved_tokens, count(*) FILTER (WHERE low.childless) AS n_leaves,
               count(*) FILTER (WHERE low.depth = top.depth + 1) AS n_children
        FROM node AS low, unnest(range(0, low.depth + 1)) AS u(d) JOIN node AS top ON top.depth = u.d AND top.pre = low.pre[1:u.d] GROUP BY ALL)
SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n_convs, sub.n_children, sub.n_leaves, sub.saved_tokens::BIGINT AS saved_tokens, node.ends_sha256
FROM node JOIN sub ON sub.depth = node.depth AND sub.pre = node.pre
LEFT JOIN node AS up ON up.depth = node.depth - 1 AND up.pre = node.pre[1:node.depth - 1]
"""
