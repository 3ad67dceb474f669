"""Operator 4: toxicity by fuzzy lexicon look-up and context windows.

The lexicon's terms form a trie.  Levenshtein automata run on it: a state is a
set of (trie node, edits so far), and the product automaton is made
deterministic as words need it, so a word costs one look-up per letter and ends
at the first letter where no term is near enough.  Terms are whole words (seeds
and learned) with edits allowed by their length, or stems that match exactly.

A word that is near a term counts as its misspelling only if it is no ordinary
word itself: neither a fixed one (words near the seeds), nor one that more clean
than toxic labelled texts hold, nor one that more texts hold than the term.

Each hit is weighed by the words around it: quotation marks around it or a verb
of reporting make it a quotation, a second-person word makes it abuse.  The
sums per kind of hit, saturated, go into a logistic model; hits of stems count by
how improbable so many are in a clean text of that length.

What is learned comes from a bounded sample of the labelled rows.  A whole word is
learned if the share of toxic texts that hold it is ``ODDS`` times that of the
clean ones (smoothed), a stem if the share of texts in which ``BURST`` different
words begin with it is.  As misspellings are rare there, the model also sees each
toxic row with its hits misspelled.  A text that equals a sampled toxic one is
known.  Ordinary words come from one pass over the texts that aren't held out and
are kept as a Bloom filter of a fixed size, whatever their number; scoring is one
pass over the texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .bpe import Store
from .common import stored, text_steps

#: Seed lexicon of insults, one per word.
SEEDS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "clown", "pathetic", "worthless", "disgusting", "bastard", "imbecile", "dumbass",
         "idiota", "estúpido", "imbécil", "connard", "salaud", "crétin", "arschloch", "dummkopf", "vollidiot")
#: Ordinary words within the seeds' edits.
ORDINARY = frozenset("""idiom idioma boron coron koron moon moran mormon morn moro moroni morton moton morin brash crash rash thrash tras trask
    closer lose losed loses laser lober loger loner looser loper louer lover lower loyer moser oser poser doser blown chown clon crown flown bustard bonnard
    aphetic apathetic athetic athletic bathetic empathetic epithetic esthetic pathetisch pathic mirthless mouthless toothless wordless workless worthies
    worthiest worthiness youthless degusting digesting discussing disguising disputing disrupting distrusting salad escupido""".split())
REPORTING = frozenset("said says say wrote writes called calls quoted quote quotes word words term so-called dit dijo escribió sagte schrieb écrit mot palabra wort".split())
SECOND = frozenset("you your you're u ur tu te toi vous votre du dich dir dein sie ihr usted ustedes tú vos eres bist es".split())
QUOTES = "\"“”„«»‘’'"
OPENS, CLOSES = "\"“„«‘'", "\"”“»’'"
#: Letters for which signs stand in disguised spellings.
SIGNS = str.maketrans("013457@$!", "oieastasi")
WINDOW_WORDS = 6
QUOTED, DIRECT = 0.2, 1.3
#: Labelled rows that are learned from, at most; lengths of stems, and different words of a text that make a stem count there.
SAMPLE, STEM_LENGTHS, BURST = 20_000, (4, 5, 6, 8), 3
#: Least share of the toxic texts, of stems and of words, least number of them, and how much larger than the clean texts' share it must be.
TOXIC_SHARE, WORD_SHARE, TOXIC_ROWS, ODDS = 0.02, 0.1, 2, 20.0
THRESHOLD = 0.3
#: Score of a text that equals a sampled toxic one, and no clean one.
KNOWN = 0.75
#: Texts that hold a word that the corpus alone makes ordinary, and toxic labelled texts from which on the labels decide.
FREQUENT, LABELLED = 5, 3
#: Words added to each length, so that one hit in a line is no proof.
SHORT = 100
#: Marks whole words among the proposals; size of the model: most learned stems and words.
WHOLE, STEMS, WORDS = "=", 400, 400
#: Bits and hashes of the filter of ordinary words: 8 MB; of a million words one in 10^9 others passes, of ten million one in 50.
FILTER_BITS, FILTER_HASHES = 1 << 26, 8


def edits_of(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class FuzzyLexicon:
    """Deterministic product of a lexicon trie and Levenshtein automata."""

    def __init__(self, words: list[str], stems: list[str] = ()):
        self.child: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.stem: list[bool] = [False]
        self.most: list[int] = [0]  # edits that some term below allows
        self.words = list(words)
        for i, w in enumerate(words):
            n = self._add(w, edits_of(w))
            self.word[n] = i
        for s in stems:
            self.stem[self._add(s, 0)] = True
        self.letters = {c for d in self.child for c in d}
        self.sets: list[dict[int, int]] = []
        self.known: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.final: list[tuple[int, int] | None] = []
        self.stems_at: list[bool] = []
        self.start = self._state({0: 0})

    def _add(self, term: str, edits: int) -> int:
        n = 0
        self.most[0] = max(self.most[0], edits)
        for c in term:
            if c not in self.child[n]:
                self.child[n][c] = len(self.child)
                self.child.append({})
                self.word.append(-1)
                self.stem.append(False)
                self.most.append(0)
            n = self.child[n][c]
            self.most[n] = max(self.most[n], edits)
        return n

    def _state(self, at: dict[int, int]) -> int:
        """Number of the state with these least edits by node; -1 for none."""
        todo = list(at)
        while todo:  # a term's letter may be missing in the word
            n = todo.pop()
            for m in self.child[n].values():
                if at[n] + 1 <= self.most[m] and at[n] + 1 < at.get(m, 99):
                    at[m] = at[n] + 1
                    todo.append(m)
        if not at:
            return -1
        key = tuple(sorted(at.items()))
        if key not in self.known:
            self.known[key] = len(self.sets)
            self.sets.append(dict(at))
            self.moves.append({})
            ends = [(e, self.word[n]) for n, e in at.items() if self.word[n] >= 0 and e <= edits_of(self.words[self.word[n]])]
            self.final.append(min(ends) if ends else None)
            self.stems_at.append(any(e == 0 and self.stem[n] for n, e in at.items()))
        return self.known[key]

    def _move(self, state: int, c: str) -> int:
        nxt: dict[int, int] = {}
        for n, e in self.sets[state].items():
            if e + 1 <= self.most[n]:  # a letter too many
                nxt[n] = min(nxt.get(n, 99), e + 1)
            for x, m in self.child[n].items():
                cost = e + (x != c)
                if cost <= self.most[m]:
                    nxt[m] = min(nxt.get(m, 99), cost)
        return self._state(nxt)

    def find(self, word: str) -> tuple[str, int] | None:
        """("word" or "stem", edits) of the nearest term, if one is near enough."""
        hit = self.nearest(word)
        return None if hit is None else hit[:2]

    def nearest(self, word: str) -> tuple[str, int, str] | None:
        """The same with the term, which is empty for stems."""
        s, stem = self.start, False
        for c in word:
            c = c if c in self.letters else ""
            moves = self.moves[s]
            t = moves.get(c)
            if t is None:
                t = moves[c] = self._move(s, c)
            if t < 0:
                return ("stem", 0, "") if stem else None
            s = t
            stem = stem or self.stems_at[s]
        end = self.final[s]
        if end is not None and (end[0] == 0 or not stem):
            return "word", end[0], self.words[end[1]]
        return ("stem", 0, "") if stem else None


def bare(chunk: str) -> str:
    """The word in a chunk between blanks: lower case, without signs at its ends, signs for letters undone."""
    w = chunk.lower()
    a, b = 0, len(w)
    while a < b and not (w[a].isalnum() or w[a] in "@$"):
        a += 1
    while b > a and not w[b - 1].isalnum():
        b -= 1
    w = w[a:b]
    return w if w.isalpha() or w.isdigit() else w.translate(SIGNS)


def context(chunks: list[str], i: int) -> float:
    """Weight of a hit at ``i`` by the words around it."""
    lo, hi = max(0, i - WINDOW_WORDS), i + WINDOW_WORDS + 1
    before, after = chunks[lo:i + 1], chunks[i:hi]
    near = {w.lower().strip(".,:;!?" + QUOTES) for w in chunks[lo:hi]}
    opened = any(w[0] in OPENS for w in before)
    closed = any(w.rstrip(".,:;!?")[-1:] in CLOSES and len(w) > 1 for w in after if w.rstrip(".,:;!?"))
    quoted = (opened and closed) or not near.isdisjoint(REPORTING)
    if quoted:
        return QUOTED
    return DIRECT if not near.isdisjoint(SECOND) else 1.0


class WordFilter:
    """A Bloom filter of words: holds each of its words, and hardly any other."""

    def __init__(self, bits: np.ndarray | None = None):
        self.bits = bits

    def __contains__(self, word: str) -> bool:
        if self.bits is None:
            return False
        raw, mask = word.encode(), FILTER_BITS - 1
        a, b = xxhash.xxh64_intdigest(raw, 42) & mask, xxhash.xxh64_intdigest(b"2" + raw, 42) & mask | 1
        at = [(a + k * b) & mask for k in range(FILTER_HASHES)]
        return all(self.bits[x >> 3] >> (x & 7) & 1 for x in at)

    @classmethod
    def of(cls, words: DataFrame) -> WordFilter:
        """Of column ``word``; the driver gets as many rows of 4 KB as the filter has."""
        mask = F.lit(FILTER_BITS - 1)
        a, b = F.xxhash64("word").bitwiseAND(mask), F.xxhash64(F.concat(F.lit("2"), F.col("word"))).bitwiseAND(mask).bitwiseOR(F.lit(1))
        at = words.select(F.explode(F.array(*[(a + F.lit(k) * b).bitwiseAND(mask) for k in range(FILTER_HASHES)])).alias("at"))
        parts = at.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits")).collect()
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for r in parts:
            bits[(r["part"] - 1) * len(r["bits"]):r["part"] * len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
        return cls(bits if parts else None)


class Features:
    """Per text: the sums of exact words, of misspelled words (at most 3) and of different words with a stem, each weighed by context; and the number of words."""

    def __init__(self, lexicon: FuzzyLexicon, ordinary=frozenset()):
        self.lexicon, self.ordinary, self.store = lexicon, ordinary, Store()

    def __call__(self, texts: list[str]) -> np.ndarray:
        cut = [t.split() for t in texts]
        new = self.store.missing({c for x in cut for c in x})
        now, find = self.store.now, self.lexicon.find
        for c in new:
            w = bare(c)
            hit = find(w) if len(w) > 2 else None
            now[c] = None if hit is None or (hit[1] and (w in ORDINARY or w in self.ordinary)) else w if hit[0] == "stem" else min(hit[1], 1)
        out = np.zeros((len(texts), 4))
        for row, chunks in zip(out, cut, strict=True):
            hits = [(i, k) for i, k in enumerate(map(now.__getitem__, chunks)) if k is not None]
            begun = set()
            for i, k in hits:
                if k not in begun:  # a word with a stem counts once
                    row[2 if isinstance(k, str) else k] += context(chunks, i)
                    if isinstance(k, str):
                        begun.add(k)
            row[3] = len(chunks)
        out[:, :2] = np.minimum(out[:, :2], 3.0)
        return out

    def misspelled(self, text: str) -> str:
        """The text with the hits among its words misspelled."""
        words = ((c, bare(c)) for c in text.split())
        return " ".join(misspelled(w) if edits_of(w) and self.lexicon.find(w) else c for c, w in words)


def misspelled(word: str) -> str:
    """The word without one of its letters."""
    i = zlib.crc32(word.encode()) % len(word)
    return word[:i] + word[i + 1:]


def beyond_chance(x: np.ndarray, chance: float) -> np.ndarray:
    """The model's inputs: in place of the stems' sum, half the digits of the probability
    (Poisson) that a clean text of that length holds so many, at most 3."""
    mean, hits = chance * (x[:, 3] + SHORT), x[:, 2]
    digits = -(hits * np.log(mean) - mean - np.array([lgamma(h + 1) for h in hits])) / np.log(10)
    return np.column_stack([x[:, :2], np.where(hits > 0, np.clip(digits / 2, 0.0, 3.0), 0.0)])


@dataclass(frozen=True)
class Model:
    """Weights (the constant last), stem hits by word of clean texts, and digests of known toxic texts (at most the sample's)."""

    weights: np.ndarray
    chance: float = 1e-4
    known: frozenset = frozenset()

    def scores(self, x: np.ndarray, texts: list[str]) -> np.ndarray:
        g = beyond_chance(x, self.chance) @ self.weights[:-1] + self.weights[-1]
        p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        known = np.array([digest(t) in self.known for t in texts], bool) if self.known else np.zeros(len(texts), bool)
        return np.where(known, np.maximum(p, KNOWN), p)


def digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode())


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 50, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """Weights and, last, the constant; Newton's method with a small ridge on the weights."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w, pull = np.zeros(x1.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (weight * p * (1 - p))[:, None]).T @ x1 + pull, x1.T @ (weight * (p - y)) + pull @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_column: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string")), F.lit(4)) == 2, F.lit(False))


def is_ordinary(clean: Column, toxic: Column, n: Column, term: Column) -> Column:
    """By the labelled texts and all texts that hold a word, and the texts that hold the term which it is near."""
    return (clean > toxic) | ((n >= FREQUENT) & (n > term) & (toxic < LABELLED))


def near_words(texts: DataFrame, lexicon: tuple) -> DataFrame:
    """(word, clean, toxic, n, term): distinct labelled and all texts that hold a
    word near a term, if it may be ordinary, and those that hold the term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, known = FuzzyLexicon(*lexicon).nearest, Store()
        for part, texts_ in text_steps(batches):
            rows = []
            cut = [set(t.split()) for t in texts_]
            for c in known.missing(set().union(*cut)):
                w = bare(c)
                hit = near(w) if len(w) > 2 else None
                known.now[c] = None if hit is None or hit[0] == "stem" or w in ORDINARY else (w, hit[2])
            for x, label, key in zip(cut, part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                rows += [(*hit, label, key) for hit in {known.now[c] for c in x} if hit is not None]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["word", "near", "toxic", "key"])

    held = texts.select("toxic", F.xxhash64("text").alias("key"), "text").mapInArrow(run, "word string, near string, toxic int, key long")
    once = held.groupBy("word", "near", "key").agg(F.max(F.coalesce(F.col("toxic") == 0, F.lit(False)).cast("int")).alias("clean"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    total = once.groupBy("word", "near").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    total = stored(total.where((F.col("word") == F.col("near")) | (F.col("clean") > 0) | (F.col("n") >= FREQUENT)), "near-words")
    terms = total.where(F.col("word") == F.col("near")).select("near", F.col("n").alias("term"))
    others = total.where(F.col("word") != F.col("near")).join(terms, "near", "left")
    return others.select("word", "clean", "toxic", "n", F.coalesce("term", F.lit(0)).alias("term"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[tuple[list[str], list[str], WordFilter], Model]:
    """((words, stems, ordinary words), model) from at most ``sample`` labelled rows that aren't held out.

    First the toxic rows propose terms, then all sampled rows count them.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    chosen = usable.where(~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    # The broadcast side has at most ``sample`` rows of two numbers; copies teach once.
    rows = stored(own.join(F.broadcast(chosen), "doc_id").select("toxic", "text").dropDuplicates(), "labelled-texts")

    def count(only: frozenset | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for part, texts in text_steps(batches):
                for label, t in zip(part.column(0).to_pylist(), texts, strict=True):
                    words = {bare(c) for c in t.split()}
                    begun = Counter(w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n)
                    held = {s for s, k in begun.items() if k >= BURST} | {WHOLE + w for w in words if edits_of(w)}
                    total.update((s, label) for s in (held if only is None else held & only))
                    total[WHOLE, label] += 1  # each text
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int32()), pa.array(list(total.values()), pa.int64())], ["stem", "toxic", "n"])

        return run

    def summed(part: DataFrame, only: frozenset | None) -> DataFrame:
        return part.mapInArrow(count(only), "stem string, toxic int, n long").groupBy("stem", "toxic").agg(F.sum("n").alias("n"))

    # Bounded: at most STEMS * 20 proposals of stems and WORDS * 20 of words.
    every = summed(rows.where("toxic = 1"), None).where((F.col("n") >= TOXIC_ROWS) & ~F.col("stem").isin("", WHOLE))
    whole = F.startswith("stem", F.lit(WHOLE))
    first = lambda some, most: every.where(some).orderBy(F.desc("n"), "stem").limit(most)
    proposed = first(~whole, STEMS * 20).union(first(whole, WORDS * 20))
    only = frozenset(r["stem"] for r in proposed.collect())
    n = {(r["stem"], r["toxic"]): r["n"] for r in summed(rows, only).collect()}
    n_toxic, n_clean = n.get((WHOLE, 1), 0), n.get((WHOLE, 0), 0)

    def odds(s: str) -> float:
        return (n.get((s, 1), 0) + 0.5) / (n_toxic + 1) / ((n.get((s, 0), 0) + 0.5) / (n_clean + 1))

    def usual(s: str) -> bool:
        """Of the many words some are in a few toxic texts by chance: less a deviation, the share must be larger."""
        t = n.get((s, 1), 0)
        return t >= TOXIC_SHARE * n_toxic if s[0] != WHOLE else t - t**0.5 >= WORD_SHARE * n_toxic

    good = [s for s in only if usual(s) and odds(s) >= ODDS]
    stems: list[str] = []
    for s in sorted((s for s in good if s[0] != WHOLE), key=lambda s: (len(s), s)):
        if not any(s.startswith(t) for t in stems):
            stems.append(s)
    stems = sorted(stems, key=lambda s: (-n[s, 1], s))[:STEMS]
    begun = tuple(stems)
    words = sorted((s for s in good if s[0] == WHOLE and s[1:] not in SEEDS and not s[1:].startswith(begun)), key=lambda s: (-n[s, 1], s))[:WORDS]
    lexicon = ([*SEEDS, *(s[1:] for s in words)], stems)
    near = stored(near_words(own.where(~held_out(F.col("doc_id"))).join(F.broadcast(chosen), "doc_id", "left"), lexicon), "near-terms")
    clean, toxic, texts, term = (F.col(c) for c in ("clean", "toxic", "n", "term"))
    ordinary = WordFilter.of(near.where(is_ordinary(clean, toxic, texts, term)))
    # A row's features are those that it would have, had its own words not been counted.
    without = {y: WordFilter.of(near.where(is_ordinary(clean - (1 - y), toxic - y, texts - 1, term))) for y in (0, 1)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = {y: Features(FuzzyLexicon(*lexicon), without[y]) for y in without}
        for part, texts in text_steps(batches):
            own = np.array(part.column(0).to_pylist())
            for y in np.unique(own).tolist():
                kind = make[int(y == 1)]
                some = [t for t, of in zip(texts, own, strict=True) if of == y]
                seen = [(some, 0.5 if y == 1 else 1.0)] + [([kind.misspelled(t) for t in some], 0.5)] * (y == 1)
                for these, weight in seen:
                    yield pa.RecordBatch.from_arrays([pa.array([y] * len(these), pa.int32()), pa.array([weight] * len(these)), pa.array([digest(t) if t.strip() else b"" for t in these], pa.binary()), *(pa.array(c) for c in kind(these).T)],
                                                     ["toxic", "weight", "digest", "a", "b", "c", "d"])

    # The driver gets at most twice ``sample`` rows of seven numbers.
    got = rows.repartition(64, "text").mapInArrow(features, "toxic int, weight double, digest binary, a double, b double, c double, d double").toPandas()
    x, y = got[["a", "b", "c", "d"]].to_numpy(float), got["toxic"].to_numpy(float)
    if len(set(y)) < 2:
        return (*lexicon, ordinary), Model(np.array([2.0, 1.0, 1.5, -3.0]))  # nothing to learn from: plain weights
    chance = float((x[y != 1, 2].sum() + 0.5) / (x[y != 1, 3].sum() + 1.0))
    # Misspelled copies have digests of their own; nobody wrote those texts.
    plain = got["digest"].where(got["weight"].eq(1.0) | ~got.duplicated("digest"), b"")
    known = frozenset(bytes(d) for d in plain[y == 1]) - frozenset(bytes(d) for d in plain[y != 1]) - {b""}
    return (*lexicon, ordinary), Model(fit_logistic(beyond_chance(x, chance), y, weight=got["weight"].to_numpy()), chance, known)


def scorer(lexicon: tuple[list[str], list[str], WordFilter], model: Model):
    """Column function: score of a text, 0 to 1; a null text is empty."""
    words, stems, ordinary = lexicon

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make = Features(FuzzyLexicon(words, stems), ordinary)
        for s in batches:
            texts = s.fillna("").tolist()
            parts = [texts[i:i + 200] for i in range(0, len(texts), 200)]
            yield pd.Series(np.concatenate([model.scores(make(part), part) for part in parts]) if parts else np.zeros(0))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    Nulls and empty texts have the score of a text without hits; a null doc_id is
    not held out; repeated rows are scored alike; labels without a row, or that
    are null, teach nothing; further columns are left out.  Without labels of
    both kinds the model's weights are fixed ones.
    """
    score = scorer(*learn(docs, labels, sample))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
