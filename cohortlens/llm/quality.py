"""Operator 10: quality rules on repetition, from a suffix array of each text.

The words of a step's texts become one integer sequence in which equal words of
different texts differ, so that one suffix array (prefix doubling, only groups
that still hold ties are sorted again) serves all texts of the step.  The
longest common prefix of neighbours in it, found by walking the doubling levels
down, gives for each place the longest substring that begins there and occurs
again in the same text; these are the maximal repeats, as each LCP interval's
members begin with it.  Repeats of ``min_words`` or more are united as spans;
a text fails if they cover more than ``max_covered`` of its words or if one is
longer than ``max_repeat`` words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import _inputs
from .common import text_steps

#: Fixed values of the base rule.
MIN_WORDS, SYMBOLS, REPEAT_PERCENT, BLANKS = 50, "#*$%&|<>", 50, "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Limits of the method.
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 10, 0.3, 200

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "covered_words long, longest_repeat long, base_failed boolean, kept boolean")


def doubled_ranks(first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... places, until no ties are left.

    ``first``: rank of each place; ``end``: for each place, where its text ends.
    A rank is the number of suffixes before the first of its group.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int64)
    s = first[order]
    head = np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], np.arange(n), 0)) if n else s
    rank[order] = head
    levels, h = [rank.copy()], 1
    tied = order[_tied(head)]
    while len(tied):
        nxt = tied + h
        after = np.where(nxt < end[tied], rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + after
        o = np.argsort(key, kind="stable")
        tied, key = tied[o], key[o]
        old = rank[tied]
        k = np.arange(len(tied))
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], k, 0))
        start = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], k, 0))
        new = old + start - group
        rank[tied] = new
        levels.append(rank.copy())
        tied, h = tied[_tied(new)], 2 * h
    return levels


def _tied(head: np.ndarray) -> np.ndarray:
    same = head[1:] == head[:-1]
    return np.r_[same, False] | np.r_[False, same]


def longest_repeats(levels: list[np.ndarray]) -> np.ndarray:
    """For each place, the length of the longest substring there that occurs again."""
    n = len(levels[0])
    best = np.zeros(n + 1, np.int64)
    if n < 2:
        return best[:n]
    order = np.argsort(levels[-1])
    a, b = order[:-1], order[1:]
    near = levels[0][a] == levels[0][b]  # the others have nothing in common
    a, b = a[near], b[near]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + lcp, b + lcp
        ok = (i < n) & (j < n)
        i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
        lcp += np.where(ok & (levels[k][i] == levels[k][j]), 1 << k, 0)
    np.maximum.at(best, a, lcp)
    np.maximum.at(best, b, lcp)
    return best[:n]


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Places that lie in one of the spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, start + length, -1)
    return np.cumsum(d[:n]) > 0


def repetition(words: list[list[str]], min_repeat: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: words in 3-word windows that occur again, words covered by
    repeats of ``min_repeat`` or more, and the longest repeat."""
    size = np.array([len(w) for w in words], np.int64)
    n = int(size.sum())
    if not n:
        return (np.zeros(len(words), np.int64),) * 3
    text = np.repeat(np.arange(len(words)), size)
    end = np.cumsum(size)[text]
    flat = np.empty(n, object)
    flat[:] = [x for w in words for x in w]
    code = pd.factorize(flat)[0].astype(np.int64)
    levels = doubled_ranks(text * n + code, end)
    best = longest_repeats(levels)
    per = lambda mask: np.bincount(text[mask], minlength=len(words))
    at = np.flatnonzero(best >= 3)
    three = covered(at, np.full(len(at), 3), n)
    at = np.flatnonzero(best >= min_repeat)
    long = covered(at, best[at], n)
    most = np.zeros(len(words), np.int64)
    np.maximum.at(most, text, best)
    return per(three), per(long), most


def quality(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT,
            id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts, base verdict and final verdict per row of ``docs``.

    A null or empty text has no words and fails the base rule.  A null id stays
    null; repeated rows are judged each for themselves; further columns are left
    out.  A repeat that overlaps itself counts.  A text at a limit passes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_steps(batches, step_chars=1_500_000):
            words = [WORD.findall(t) for t in texts]
            n = np.array([len(w) for w in words], np.int64)
            again, cover, longest = repetition(words, min_repeat)
            chars = np.array([len(t) - sum(map(t.count, BLANKS)) for t in texts], np.int64)
            symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
            lines = [[x for x in t.split("\n") if x.strip(BLANKS)] for t in texts]
            dup = np.array([len(x) - len(set(x)) for x in lines], np.int64)
            failed = (n < MIN_WORDS) | (100 * again > REPEAT_PERCENT * n)
            kept = ~failed & (cover <= max_covered * n) & (longest <= max_repeat)
            cols = [part.column(0), *map(pa.array, (n, chars, symbols, dup, again, cover, longest, failed, kept))]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SCHEMA.split(", ")])

    return _inputs(docs, id_column, text_column).mapInArrow(run, SCHEMA)
