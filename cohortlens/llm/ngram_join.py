"""Operator 6: self-join on Jaccard similarity of word n-grams, by chosen paths.

1. Each text's set of n-grams (five words) and a signature of minimum hashes.
   Equal sets are one representative from here on.
2. Chosen paths: in a run, a node samples places of the signature, each with
   chance 1 / (threshold * places), and each set goes on to the child named by
   the node, the place and its value there; so sets split on sampled shared
   tokens.  Children with one set leave.  Buckets of up to ``LEAF`` sets are
   compared by brute force on the signatures, larger ones split again; what is
   still large after ``DEPTH`` splits is compared whole, in pairs of blocks.
   ``RUNS`` runs are repeated: a pair at the threshold meets in one run with
   chance 0.63 (one split) to 0.38 (three), so in 16 runs with 0.9995 at least,
   above it with more.  A bucket yields a spanning forest of its near pairs,
   not the pairs.
3. Components of these edges are *loose* groups: signatures are compared with a
   margin, so that a pair above the threshold is not missed by their error.
   Inside each loose group all pairs are verified on the whole sets, in pairs of
   blocks of bounded size; a block yields for each set the number of links and
   one edge, never the pairs.
4. Components of the verified edges are the classes.

No group is held whole by a task, and no pairs are written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .bpe import Store
from .common import sifted, stored, text_key, text_steps

N, THRESHOLD = 5, 0.8
PLACES, RUNS, DEPTH, LEAF = 128, 16, 3, 512
#: Signatures are compared at the threshold less this many standard errors.
MARGIN = 4.0
#: Most sets, and most n-grams, of a block of the verifying join.
BLOCK_SETS, BLOCK_TOKENS = 512, 400_000
SEED = 20_240_601


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draws(n: int, salt: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED + salt))


class Shingles:
    """Sets of hashed n-grams of the texts' lower-cased words between blanks."""

    def __init__(self, n: int):
        self.n, self.store = n, Store()
        self.power = _draws(n, 7) | np.uint64(1)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        cut = [t.lower().split() for t in texts]
        new = self.store.missing({w for x in cut for w in x})
        now, n = self.store.now, self.n
        now.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        out = []
        for words in cut:
            h = np.fromiter(map(now.__getitem__, words), np.uint64, len(words))
            m = len(h)
            if m == 0:
                out.append(h)
            elif m < n:  # a shorter text is one n-gram
                out.append(_mix(np.array([np.sum(h * self.power[:m])], np.uint64) + np.uint64(m)))
            else:
                s = np.zeros(m - n + 1, np.uint64)
                for i in range(n):
                    s += h[i:m - n + 1 + i] * self.power[i]
                out.append(np.unique(_mix(s)))
        return out


def signature(tokens: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum hashes of 64 bits (rows in steps, to bound memory)."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(tokens), 4096):
        x = tokens[i:i + 4096, None] * a[None, :] + b[None, :]
        np.minimum(least, x.min(axis=0), out=least)
    return _mix(least)


def short(signature: np.ndarray) -> bytes:
    """What signatures are compared by: 16 bits of each value."""
    return (signature >> np.uint64(48)).astype(np.uint16).tobytes()


def first_nodes(signature: np.ndarray, runs: int, threshold: float) -> np.ndarray:
    """Where a set goes from the roots of the runs; by whole values, so that
    different values don't meet however many sets there are."""
    drawn = _mix(_draws(runs, 4)[:, None] ^ _draws(PLACES, 3)[None, :])
    run, place = np.nonzero(drawn < _limit(threshold))
    return _mix(drawn[run, place] + signature[place] * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _limit(threshold: float) -> np.uint64:
    return np.uint64(int(2**64 / (threshold * PLACES)))


def sets_table(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, runs: int = RUNS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, key, id, n, sig, nodes, tokens), stored: per row the content key of its
    text, the digest of its n-gram set (null for the empty set), the set's size,
    short signature, first nodes and tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, a, b = Shingles(n), _draws(PLACES, 1) | np.uint64(1), _draws(PLACES, 2)
        for part, texts in text_steps(batches):
            sets = make(texts)
            sigs = [signature(s, a, b) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([None if s is None else short(s) for s in sigs], pa.binary()),
                pa.array([None if s is None else first_nodes(s, runs, threshold) for s in sigs], pa.list_(pa.int64())),
                pa.array([s.tobytes() for s in sets], pa.binary()),
            ], ["doc_id", "key", "id", "n", "sig", "nodes", "tokens"])

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, key string, id binary, n long, sig binary, nodes array<long>, tokens binary"), "ngram-sets")


def _children(rows: DataFrame, depth: int, threshold: float) -> DataFrame:
    """(bucket, id): the next nodes of (bucket, id, sig)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, limit = _draws(PLACES, 3), _limit(threshold)
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(batch.num_rows, PLACES).astype(np.uint64)
            node = np.array(batch.column(0).to_pylist(), np.int64).view(np.uint64)
            drawn = _mix(node[:, None] ^ places[None, :])
            row, place = np.nonzero(drawn < limit)
            child = _mix(drawn[row, place] + sig[row, place] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(depth))
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(1).take(pa.array(row))], ["bucket", "id"])

    return rows.mapInArrow(run, "bucket long, id binary")


def forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest over the pairs (a, b), heaviest first."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = range(len(a)) if weight is None else np.argsort(-weight, kind="stable").tolist()
    out = []
    for i in order:
        x, y = root(int(a[i])), root(int(b[i]))
        if x != y:
            parent[y] = x
            out.append((int(a[i]), int(b[i])))
            if len(out) == n - 1:
                break
    return out


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of rows with equal first ``n_keys`` columns (rows come sorted by them)."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n_keys] != key:
                if held:
                    yield key, held
                key, held = row[:n_keys], []
            held.append(row[n_keys:])
    if held:
        yield key, held


def near_edges(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): spanning forests of near signatures in each (bucket, i, j); ``side``
    tells the block of a row (0 or 1; pairs within block 0 are left out if i < j)."""
    least = threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / PLACES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bytes]] = []
        for (_, i, j), held in _groups(batches, 3):
            if len(held) < 2:
                continue
            ids = [h[0] for h in held]
            sig = np.frombuffer(b"".join(h[2] for h in held), np.uint16).reshape(len(held), PLACES)
            side = np.array([h[1] for h in held])
            found = []
            for x in range(len(ids) - 1):
                share = (sig[x + 1:] == sig[x]).mean(axis=1)
                ok = share >= least
                if i != j:
                    ok &= side[x + 1:] != side[x]
                y = np.flatnonzero(ok)
                found.append(np.column_stack([np.full(len(y), x), x + 1 + y, share[y]]))
            f = np.concatenate(found)
            out += [(ids[a], ids[b]) for a, b in forest(len(ids), f[:, 0].astype(int), f[:, 1].astype(int), f[:, 2])]
            if len(out) > 50_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return rows.mapInArrow(run, "a binary, b binary")


def _edges(pairs):
    cols = list(zip(*pairs, strict=True)) or [[], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], ["a", "b"])


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, "id")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each one's component, by alternating large
    and small stars; each round is a stored table of at most as many edges."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        # Large star: each neighbour above u goes to the least of u and its neighbours.
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(stored(least, "least"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "large-star")
        # Small star: u and its neighbours below it go to the least of them.
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct(), "small-star")
    roots = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(now.select("v", "v")).distinct()


def loose_groups(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, root) of sets that have a near one, by chosen paths."""
    sigs = stored(sets.where("id IS NOT NULL").groupBy("id").agg(F.first(F.struct("sig", "nodes")).alias("x")).select("id", "x.sig", "x.nodes"), "signatures")
    rows, leaves = sigs.select(F.explode("nodes").alias("bucket"), "id"), None
    sigs = sigs.select("id", "sig")
    for depth in range(1, DEPTH + 1):
        sizes = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
        members = stored(rows.join(sizes, "bucket"), "members")
        last = depth == DEPTH
        whole = members if last else members.where(F.col("size") <= LEAF)
        leaves = whole if leaves is None else leaves.union(whole)
        big = members.where(F.col("size") > LEAF)
        if last or big.isEmpty():
            break
        rows = stored(_children(big.join(sigs, "id").select("bucket", "id", "sig"), depth, threshold), "nodes")
    blocks = F.ceil(F.col("size") / LEAF).cast("int")
    leaves = _in_blocks(leaves.withColumn("blocks", blocks), ["bucket"])
    dealt = _dealt(leaves.join(sigs, "id").select("bucket", "i", "j", "id", "side", "sig"), "bucket", "i", "j")
    return components(stored(near_edges(dealt, threshold), "near"))


def _in_blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each row once for every pair of blocks that its own is part of: (i, j, side)."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(*keys, "id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """counts[i, j]: tokens that sets i and j share."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    token, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    held = np.bincount(place, minlength=len(token))
    out = np.zeros((n, n), np.float32)
    number = np.cumsum(held > 1) - 1
    shared = int((held > 1).sum())
    keep = held[place] > 1
    row, place = row[keep], number[place[keep]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    for begin in range(0, shared, 4096):
        a, b = np.searchsorted(place, [begin, begin + 4096])
        part = np.zeros((n, min(4096, shared - begin)), np.float32)
        part[row[a:b], place[a:b] - begin] = 1
        out += part @ part.T
    out[np.arange(n), np.arange(n)] = sizes
    return out.astype(np.int64)


def verified(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, links, a): for each set of a (root, i, j) the documents behind the sets
    linked to it there, and a set that it is joined to (itself, if to none)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, int, bytes]] = []
        for (_, i, j), held in _groups(batches, 3):
            ids = [h[0] for h in held]
            if len(ids) < 2:
                continue
            side, copies = np.array([h[1] for h in held]), np.array([h[2] for h in held])
            sets = [np.frombuffer(h[3], np.uint64) for h in held]
            sizes = np.array([len(s) for s in sets])
            common = common_counts(sets)
            near = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
            np.fill_diagonal(near, False)
            if i != j:
                near &= side[:, None] != side[None, :]
            links = near @ copies
            a, b = np.nonzero(np.triu(near))
            out += [(ids[y], 0, ids[x]) for x, y in forest(len(ids), a, b)]
            out += [(ids[x], int(links[x]), ids[x]) for x in range(len(ids)) if links[x]]
            if len(out) > 50_000:
                yield _links(out)
                out = []
        yield _links(out)

    return rows.mapInArrow(run, "id binary, links long, a binary")


def _links(rows):
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["id", "links", "a"])


def set_classes(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id, n_links) per distinct set: the class's smallest doc_id and the
    documents at ``threshold`` or more, equal sets included."""
    reps = stored(sets.where("id IS NOT NULL").groupBy("id").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")), "representatives")
    loose = loose_groups(sets, threshold)
    member = stored(loose.join(reps.select("id", "copies", "n"), "id"), "loose")
    size = member.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    placed = _in_blocks(member.join(stored(size, "loose-sizes"), "root"), ["root", "copies"])
    tokens = sifted(sets.select("id", "tokens"), "id", member)[0].join(member.select("id"), "id", "left_semi").groupBy("id").agg(F.first("tokens").alias("tokens"))
    dealt = _dealt(placed.join(stored(tokens, "tokens"), "id").select("root", "i", "j", "id", "side", "copies", "tokens"), "root", "i", "j")
    links = stored(verified(dealt, threshold), "links")
    groups = components(links.select("a", F.col("id").alias("b")))
    count = links.groupBy("id").agg(F.sum("links").alias("links"))
    rows = reps.join(groups, "id", "left").join(count, "id", "left").select("id", "first", "copies", F.coalesce("root", "id").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    rows = stored(rows, "linked")
    firsts = stored(rows.groupBy("root").agg(F.min("first").alias("class_id")), "class-ids")
    return rows.join(firsts, "root").select("id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, runs: int = RUNS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, key, class_id, n_links) per row of ``docs``; key: its text's content key.

    A text of fewer than ``n`` words is one n-gram; a text without words (null,
    empty) is linked to nothing and its own class.  Repeated rows are documents
    of their own, linked to each other.  The class id is the smallest doc_id
    (null if all are).  Further columns are left out.
    """
    sets = sets_table(docs, n, threshold, runs, id_column, text_column)
    classes = stored(set_classes(sets, threshold), "classes")
    rows = sets.select("doc_id", "key", "id")
    found = rows.where("id IS NOT NULL").join(classes, "id").select("doc_id", "key", "class_id", "n_links")
    return found.union(rows.where("id IS NULL").select("doc_id", "key", F.col("doc_id"), F.lit(0).cast("long")))


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, runs: int = RUNS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that another row of their class stands for: the one
    with the smallest doc_id stays (of several, the one with the smallest content
    key; of repeated rows, one).  Rows without words all stay.
    """
    found = near_duplicates(docs, n, threshold, runs, id_column, text_column)
    linked = found.where("n_links > 0")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    stay = stored(linked.groupBy("class_id").agg(F.min(place).alias("x")).select("x.doc_id", "x.key"), "kept")
    linked = stored(linked.select("doc_id", "key").distinct(), "linked-rows")
    # Only rows that may be linked move; the texts of the others are passed on as they are.
    names, k = docs.columns, "\0key"
    own = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    may, alone = sifted(docs.withColumn(k, text_key(own)), k, linked.select(F.col("key").alias(k)))
    i, other, is_linked, is_kept = "\0id", "\0other", "\0linked", "\0kept"
    marks = linked.withColumn(is_linked, F.lit(True)).join(stay.withColumn(is_kept, F.lit(True)), (linked["key"] == stay["key"]) & linked["doc_id"].eqNullSafe(stay["doc_id"]), "left").select(linked["key"].alias(k), linked["doc_id"].alias(other), is_linked, is_kept)
    rows = may.withColumn(i, F.col(f"`{id_column}`").cast("long"))
    m = stored(marks.withColumnRenamed(k, "\0k"), "marks")
    met = rows.join(m, (F.col(k) == F.col("\0k")) & F.col(i).eqNullSafe(F.col(other)), "left")
    out = lambda df: df.select(*[F.col(f"`{c}`") for c in names])
    free = met.where(F.col(is_linked).isNull())
    chosen = met.where(F.col(is_kept)).dropDuplicates([k, i])
    return out(alone).union(out(free)).union(out(chosen))
