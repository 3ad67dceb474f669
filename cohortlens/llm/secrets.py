"""Operator 2: secret scan in native expressions only.

Base kinds are regular expressions; the starts of their matches are the running
sums of the lengths of the parts between the matches and of the matches.  The
method adds candidate strings whose characters look random: over each class of
characters a window of ``window`` characters slides along the candidate, a
table of counts loses the character that leaves and gains the one that enters,
and the sum of n*log2(n) over the counts follows by two look-ups, which gives
the window's Shannon entropy.  A candidate counts if its largest entropy reaches
the class's threshold and no allow-list pattern fits it.  All of it happens
inside the row: no shuffle, no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Base kinds (fixed values), in order: pattern, and the group whose length decides, and that length.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = [("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16)]

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"


@dataclass(frozen=True)
class CharClass:
    """Candidates that ``fits`` matches (the first class that fits holds) and their threshold in bits."""

    name: str
    fits: str
    threshold: float


CLASSES = (
    CharClass("digits", r"^[0-9]+$", math.inf),  # numbers are no secrets
    CharClass("hex", r"^([0-9a-f]*[0-9][0-9a-f]*|[0-9A-F]*[0-9][0-9A-F]*)$", 2.9),
    CharClass("mixed", r"^(?=.*[0-9])(?=.*[A-Za-z])", 3.55),
    CharClass("letters", r"^(?=.*[a-z])(?=.*[A-Z].*[A-Z].*[A-Z])", 3.9),
)
#: Candidates that are known not to be secrets.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"(?i)example|sample|placeholder|xxxx|changeme",
    r"(?i)abcdefghij|0123456789|qwertyuiop",  # alphabets and keyboards
    r"^(sha(1|256|384|512)|md5)-",  # digests of public files
)
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_ZERO = 64  # counts are kept as the characters from this code on


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, key>> of the leftmost non-overlapping matches:
    code points, end exclusive; key is the match's ``group``."""
    parts, found, keys = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    kind = "struct<at:int,out:array<struct<start:int,end:int,key:string>>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,key:string>>").alias("out")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["part"])
        end = start + F.length(x["found"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["key"].alias("key")))).alias("out")).cast(kind)

    rows = F.zip_with(F.slice(parts, 1, F.size(found)), F.arrays_zip(found.alias("found"), keys.alias("key")),
                      lambda p, m: F.struct(p.alias("part"), m["found"].alias("found"), m["key"].alias("key")))
    none = F.array().cast("array<struct<start:int,end:int,key:string>>")
    return F.when(text.rlike(pattern), F.aggregate(rows, empty, step, lambda acc: acc["out"])).otherwise(none)


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind>> of the base kinds, each in text order."""
    def of(rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
        # A run of one class is maximal, so its least length may stand in the pattern.
        pattern = {"hex": r"[0-9a-f]{16,}", "access": r"AKIA[A-Z0-9]{14,}"}.get(kind, pattern)
        found = F.filter(matches(text, pattern, group), lambda m: F.length(m["key"]) >= least)
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.concat(*[of(rank, *x) for rank, x in enumerate(BASE)])


def max_window_entropy(s: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits) of a window over ``s``; null if it is shorter."""
    weight = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)])
    # The events in order: where a window is full a character leaves, then one enters.
    events = F.flatten(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.when(
        i > window, F.array(F.struct(F.substring(s, i - window, F.lit(1)).alias("c"), F.lit(-1).alias("d"), F.lit(False).alias("full")),
                            F.struct(F.substring(s, i, F.lit(1)).alias("c"), F.lit(1).alias("d"), F.lit(True).alias("full"))))
        .otherwise(F.array(F.struct(F.substring(s, i, F.lit(1)).alias("c"), F.lit(1).alias("d"), (i == window).alias("full"))))))
    events = F.transform(events, lambda e: F.struct(F.position(e["c"], F.lit(_ALPHABET)).alias("at"), e["d"].alias("d"), e["full"].alias("full")))
    kind = "struct<counts:string,total:double,least:double>"
    zero = F.struct(F.lit(chr(_ZERO) * len(_ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(None).cast("double").alias("least")).cast(kind)

    def step(acc: Column, e: Column) -> Column:
        n = F.ascii(F.substring(acc["counts"], e["at"], F.lit(1))) - _ZERO
        total = acc["total"] + F.get(weight, n + e["d"]) - F.get(weight, n)
        return F.struct(F.overlay(acc["counts"], F.char(n + e["d"] + _ZERO), e["at"], F.lit(1)).alias("counts"), total.alias("total"),
                        F.when(e["full"], F.least(acc["least"], total)).otherwise(acc["least"]).alias("least")).cast(kind)

    return F.aggregate(events, zero, step, lambda acc: F.lit(math.log2(window)) - acc["least"] / window)


def entropy_spans(text: Column, window: int = WINDOW, classes=CLASSES, allow=ALLOW) -> Column:
    """array<struct<start, rank, end, kind>> of the candidates that the method adds."""
    def needed(s: Column) -> Column:
        c = F.lit(None).cast("double")
        for x in reversed(classes):
            if math.isfinite(x.threshold):
                c = F.when(s.rlike(x.fits), x.threshold).otherwise(c)
            else:
                c = F.when(s.rlike(x.fits), F.lit(None)).otherwise(c)
        return c

    allowed = lambda s: F.coalesce(*[F.when(s.rlike(p), True) for p in allow], F.lit(False))
    cand = F.filter(matches(text, CANDIDATE), lambda m: needed(m["key"]).isNotNull() & ~allowed(m["key"]))
    hot = F.filter(cand, lambda m: F.coalesce(max_window_entropy(m["key"], window) >= needed(m["key"]), F.lit(False)))
    return F.transform(hot, lambda m: F.struct(m["start"].alias("start"), F.lit(len(BASE)).alias("rank"), m["end"].alias("end"), F.lit("entropy").alias("kind")))


def secrets(docs: DataFrame, window: int = WINDOW, classes=CLASSES, allow=ALLOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, base, added): arrays of spans, by start and then kind, per row of ``docs``.

    A null or empty text has none; a null id stays null; repeated rows stay;
    further columns are left out.  Spans of different kinds may overlap.  The
    running sums take time in the square of the number of matches in one text.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.array_sort(base_spans(text)).alias("base"),
                       entropy_spans(text, window, classes, allow).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k, *_ in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.array_sort(F.concat("base", "added"))).alias("spans"))


def _sql_matches(name: str, pattern: str, group: int, least: int, rank: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT k, {rank} AS rank, '{name}' AS kind,
        (list_sum(list_transform(list_slice(parts, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(ms, 1, i - 1), lambda x: length(x))), 0))::BIGINT AS s, ms[i] AS m, keys[i] AS key
      FROM (SELECT k, string_split_regex(t, '{p}') AS parts, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {group}) AS keys FROM d), unnest(range(1, len(ms) + 1)) AS u(i)
      WHERE length(keys[i]) >= {least}"""


# The entropy of each window is computed afresh from its list of characters.
def oracle_sql() -> str:
    base = " UNION ALL ".join(_sql_matches(k, p, g, n, r) for r, (k, p, g, n) in enumerate(BASE))
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
b AS ({base}),
c AS ({_sql_matches("entropy", CANDIDATE, 0, WINDOW, len(BASE))}),
e AS (SELECT c.*, (SELECT max(list_entropy(string_split(substr(m, i, {WINDOW}), ''))) FROM unnest(range(1, length(m) - {WINDOW} + 2)) AS v(i)) AS h FROM c
      WHERE NOT regexp_matches(m, '^[0-9A-Fa-f]{{8}}(-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}}$') AND NOT regexp_matches(lower(m), 'example|sample|placeholder|xxxx|changeme|abcdefghij|0123456789|qwertyuiop|^(sha(1|256|384|512)|md5)-')),
a AS (SELECT k, rank, kind, s, m FROM b UNION ALL SELECT k, rank, kind, s, m FROM e WHERE h >= CASE
        WHEN regexp_full_match(m, '[0-9]+') THEN 99 WHEN regexp_full_match(m, '[0-9a-f]+') AND regexp_matches(m, '[0-9]') OR regexp_full_match(m, '[0-9A-F]+') AND regexp_matches(m, '[0-9]') THEN {CLASSES[1].threshold}
        WHEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') THEN {CLASSES[2].threshold}
        WHEN regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z].*[A-Z].*[A-Z]') THEN {CLASSES[3].threshold} ELSE 99 END),
g AS (SELECT k, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
        string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
        string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY s, rank) AS spans FROM a GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (k)
"""
