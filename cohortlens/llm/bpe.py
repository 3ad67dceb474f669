"""Operator 8: byte-level BPE encoding and decoding over a trie of distinct words.

The encoding of a word's prefix is fixed by its last token: if the encoding of
``w[:i]`` ends with token ``t``, the rest of it is the encoding of
``w[:i - len(t)]``, and a sequence is an encoding exactly if each pair of
neighbours is the encoding of its own bytes.  So one token id per trie node (the
*last-token state*) holds the encodings of all prefixes.  The distinct new words
of a step are put into a trie (kept as their sorted order, which is its
depth-first order); the walk goes down each edge once, finds the state of the
new node from the states on the path to it, and reads a word's ids off the path
from its end.  A shared prefix is thus encoded once.

Words come from the tokenizer file's own split rule.  A text is first cut at
blanks; the piece after a blank is split on its own, which gives the same words
unless a blank touches other white space, in which case the whole text is split
at once.  Encoded pieces are kept in a bounded store, so frequent pieces cost
one look-up.  All work is map-only: no shuffle, memory bounded by the step size
and the stores, nothing kept that a lost executor can't rebuild.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import per_executor, text_steps

#: Split rule of byte-level BPE files whose ``use_regex`` is set (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of each of the two generations of a store of encoded pieces or words.
STORE_MAX = 120_000
#: Token pairs whose validity is remembered.
PAIRS_MAX = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable
    Latin-1 stands for itself, the rest follow from U+0100 in byte order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens, merges and special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.ids = {raw(k): v for k, v in vocab.items()}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for k, v in self.ids.items():
            self.bytes[v] = k
        for k, v in self.special.items():
            self.bytes[v] = k.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.split = regex.compile(SPLIT).findall
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """The defining procedure: merge the pair of lowest rank until none is left."""
        ids = [self.ids[word[i:i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            found = [(m[0], i, m[1]) for i in range(len(ids) - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
            if not found:
                break
            _, i, new = min(found)
            ids[i:i + 2] = [new]
        return ids

    def apart(self, left: bytes, right: bytes) -> list[int] | None:
        """``merge(left + right)``, given up (None) as soon as a token crosses the border."""
        get = self.merges.get
        ids = [self.ids[left[i:i + 1]] for i in range(len(left))]
        border = len(ids)
        ids += [self.ids[right[i:i + 1]] for i in range(len(right))]
        while True:
            best, at = None, 0
            for i, pair in enumerate(zip(ids, ids[1:], strict=False)):
                m = get(pair)
                if m is not None and (best is None or m[0] < best[0]):
                    best, at = m, i
            if best is None:
                return ids
            if at < border:
                if at == border - 1:
                    return None
                border -= 1
            ids[at:at + 2] = [best[1]]


class WordTrie:
    """Encodes sets of distinct words by last-token states along a trie walk."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.length = [len(b) for b in vocab.bytes]
        # Tokens by their reversed bytes: (node * 256 + byte) -> node, and the token that ends there.
        self.back: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for word, i in vocab.ids.items():
            node = 0
            for b in reversed(word):
                key = node << 8 | b
                nxt = self.back.get(key)
                if nxt is None:
                    nxt = self.back[key] = len(self.ends)
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = i
        # A token and a byte after it: the token of both (token * 256 + byte -> token).
        self.longer = {vocab.ids[w[:-1]] << 8 | w[-1]: i for w, i in vocab.ids.items() if w[:-1] in vocab.ids}
        self.pairs: dict[int, bool] = {}

    def valid(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` (-1: nothing) and ``b`` encode to just these tokens."""
        key = (a + 1) << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS_MAX:
                self.pairs.clear()
            v = self.vocab
            if a < 0:
                known = v.merge(v.bytes[b]) == [b]
            else:  # two tokens that merge are no encoding
                known = (a, b) not in v.merges and v.apart(v.bytes[a], v.bytes[b]) == [a, b]
            self.pairs[key] = known
        return known

    def encode(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(word, ids as little-endian uint32) for each word, in depth-first order."""
        back, ends, length, pairs, valid, longer = self.back, self.ends, self.length, self.pairs, self.valid, self.longer
        state = [-1]  # of each node on the path from the root
        before = b""
        for word in sorted(words):
            n, keep, most = len(word), 0, min(len(word), len(before))
            while keep < most and word[keep] == before[keep]:
                keep += 1
            del state[keep + 1:]
            for i in range(keep + 1, n + 1):
                # There is one encoding, so the likeliest last token may be tried
                # first: the one before with this byte added.
                t = longer.get(state[i - 1] << 8 | word[i - 1]) if i > 1 else None
                if t is not None:
                    j = i - length[t]
                    a = state[j] if j else -1
                    ok = pairs.get((a + 1) << 32 | t)
                    if valid(a, t) if ok is None else ok:
                        state.append(t)
                        continue
                node, j = 0, i
                while j:
                    node = back.get(node << 8 | word[j - 1])
                    if node is None:
                        raise ValueError(f"no encoding of {word!r}")
                    j -= 1
                    t = ends[node]
                    if t >= 0:
                        a = state[j] if j else -1
                        ok = pairs.get((a + 1) << 32 | t)
                        if valid(a, t) if ok is None else ok:
                            state.append(t)
                            break
                else:
                    raise ValueError(f"no encoding of {word!r}")
            before = word
            ids, i = [], n
            while i:
                ids.append(state[i])
                i -= length[state[i]]
            ids.reverse()
            yield word, struct.pack(f"<{len(ids)}I", *ids)


class Store:
    """Bounded map: a full generation becomes the old one, and what is used again moves on."""

    def __init__(self):
        self.now: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> set:
        """The keys that aren't kept; the others are in ``now`` afterwards."""
        if len(self.now) > STORE_MAX:
            self.now, self.old = {}, self.now
        new = keys.difference(self.now)
        again = new.intersection(self.old)
        self.now.update((k, self.old[k]) for k in again)
        return new - again


class Encoder:
    """Texts to ids; subclasses encode the distinct pieces that aren't stored yet."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.first = Store()
        self.later = Store()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        raise NotImplementedError

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        special = self.vocab.special_split
        cut = [special.split(t) if special and any(s in t for s in self.vocab.special) else [t] for t in texts]
        plain = self._plain([s for parts in cut for s in parts[::2]])
        out, k = [], 0
        for parts in cut:
            got = []
            for i, s in enumerate(parts):
                if i % 2:
                    got.append(np.uint32(self.vocab.special[s]).astype("<u4").tobytes())
                else:
                    got.append(plain[k])
                    k += 1
            out.append(got[0] if len(got) == 1 else b"".join(got))
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        pieces = [t.split(" ") for t in texts]
        new_first = self.first.missing({p[0] for p in pieces})
        new_later = self.later.missing({x for p in pieces for x in p[1:]})
        # A piece that is empty or touches other white space can't be split on its own.
        loose = {p for p in new_later if not p or p[0].isspace() or p[-1].isspace() or p[0] == "\x1c"}
        loose_first = {p for p in new_first if p and p[-1].isspace()}
        whole = {}
        if loose or loose_first or "" in new_first:
            whole = {i: t for i, (p, t) in enumerate(zip(pieces, texts, strict=True))
                     if p[0] in loose_first or (not p[0] and len(p) > 1) or not loose.isdisjoint(p[1:])}
        new_later -= loose
        new_first -= loose_first
        todo = [*new_first, *(" " + p for p in new_later)]
        ids = self.encode_pieces([*todo, *whole.values()])
        first, later = self.first.now, self.later.now
        first.update(zip(new_first, ids, strict=False))
        later.update(zip(new_later, ids[len(new_first):], strict=False))
        done = dict(zip(whole, ids[len(todo):], strict=True))
        return [done[i] if i in done else first[p[0]] + b"".join(map(later.__getitem__, p[1:]))
                for i, p in enumerate(pieces)]


class TrieEncoder(Encoder):
    """Pieces by the split rule, their distinct words by the trie walk."""

    def __init__(self, path: str):
        super().__init__(path)
        self.trie = WordTrie(self.vocab)
        self.words = Store()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        cut = list(map(self.vocab.split, pieces))
        new = self.words.missing({w for c in cut for w in c})
        words = self.words.now
        words.update((w.decode(), ids) for w, ids in self.trie.encode(w.encode() for w in new))
        return [words[c[0]] if len(c) == 1 else b"".join(map(words.__getitem__, c)) for c in cut]


class LibraryEncoder(Encoder):
    """Pieces by a compiled BPE library from the same vocabulary file."""

    def __init__(self, path: str):
        import tiktoken

        super().__init__(path)
        self.lib = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=self.vocab.ids, special_tokens={})

        self.length = np.array([len(b) for b in self.vocab.bytes], np.int64)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        # Pieces that begin with a blank and end without one are encoded in one
        # string, as no word spans two of them; the ids part where the bytes do.
        out: list[bytes] = [b""] * len(pieces)
        row = [i for i, p in enumerate(pieces) if p and p[0] == " " and not p[-1].isspace()]
        ids = np.array(self.lib.encode_ordinary("".join([pieces[i] for i in row])), "<u4")
        ends = np.cumsum([len(pieces[i].encode()) for i in row], dtype=np.int64)
        at = (4 * (np.searchsorted(np.cumsum(self.length[ids]), ends) + 1)).tolist()
        raw, begin = ids.tobytes(), 0
        for i, end in zip(row, at, strict=True):
            out[i], begin = raw[begin:end], end
        for i in set(range(len(pieces))).difference(row):
            out[i] = np.array(self.lib.encode_ordinary(pieces[i]), "<u4").tobytes()
        return out


def decode(vocab: Vocabulary, ids: bytes) -> str:
    """Text of ids (little-endian uint32); bytes that aren't UTF-8 become U+FFFD."""
    return b"".join(map(vocab.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian uint32 bytes and the text decoded from them.

    One row per input row, in any order.  A null or empty text has no ids and
    decodes to the empty text; a null id stays null; repeated rows stay; further
    columns are left out.  ``path`` names the tokenizer file on each executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = per_executor(TrieEncoder, path)
        for part, texts in text_steps(batches):
            ids = enc.encode(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([decode(enc.vocab, i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return _inputs(docs, id_column, text_column).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digest_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of :func:`encode_documents`,
    digested where the ids are made, so that only digests leave Python."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = per_executor(TrieEncoder, path)
        for part, texts in text_steps(batches):
            ids = enc.encode(texts)
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(decode(enc.vocab, i).encode()).hexdigest() for i in ids], pa.string()),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _inputs(docs, id_column, text_column).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _inputs(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
