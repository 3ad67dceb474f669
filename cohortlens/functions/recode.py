"""Recoding expressions: ordered bands, 0/1 flags, sentinel and missing-value
rules, code groupings, and the labels used on model output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.functions._col import col_of
from cohortlens.functions.casts import safe_double


def band(c, edges: Sequence, labels: Sequence[str], closed: str = "left",
         first_exact: bool = False) -> Column:
    """Ordered banding by chained CASE.

    ``closed='left'``: value < edges[i] -> labels[i]; ``'right'``: value <=
    edges[i].  ``first_exact`` tests the first edge with ``=`` (the
    "same day" bucket).  Values past the last edge, and NULL, get the last
    label, as a CASE ... ELSE does."""
    if len(labels) != len(edges) + 1:
        raise ValueError("need one more label than edges")
    c = col_of(c)
    expr = None
    for i, (e, lab) in enumerate(zip(edges, labels)):
        if i == 0 and first_exact:
            cond = c == e
        elif closed == "left":
            cond = c < e
        elif closed == "right":
            cond = c <= e
        else:
            raise ValueError(closed)
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr.otherwise(labels[-1])


def flag(cond: Column) -> Column:
    """Predicate -> int 0/1; NULL -> 0 (CASE WHEN cond THEN 1 ELSE 0)."""
    return F.when(cond, 1).otherwise(0).cast("int")


def recode_sentinel(c, sentinel: str, replacement: str) -> Column:
    c = col_of(c)
    return F.when(c == sentinel, F.lit(replacement)).otherwise(c)


def label_missing(c, label: str = "Unknown") -> Column:
    """NULL -> label, rows kept."""
    return F.coalesce(col_of(c), F.lit(label))


def measured_flag(c, not_measured: str = "None") -> Column:
    """1 when a value was recorded: not NULL and not the 'not measured' text."""
    c = col_of(c)
    return flag((c != not_measured) & c.isNotNull())


def band_ordinal(c, width: int = 10) -> Column:
    """``'[70-80)'`` -> 70/width + 1 = 8.0 (double, first number in the text)."""
    lower = F.regexp_extract(col_of(c), r"\d+", 0).try_cast("int")
    return (lower / F.lit(width) + 1).cast("double")


# Primary-diagnosis groups of ICD-9 codes, in the order they
# are tested.  Each group: (label, [inclusive numeric ranges], [single codes]).
DIAG_GROUPS = [
    ("Circulatory", [(390, 459)], [785]),
    ("Respiratory", [(460, 519)], [786]),
    ("Digestive", [(520, 579)], [787]),
    ("Injury", [(800, 999)], []),
    ("Musculoskeletal", [(710, 739)], []),
    ("Genitourinary", [(580, 629)], [788]),
    ("Neoplasms", [(140, 239)], []),
]
DIAG_MISSING = "?"
DIAG_OTHER_PREFIXES = ("E", "V")
DIAG_DIABETES_PREFIX = "250"


def diag_prefix_rules(c, otherwise: Column) -> Column:
    """Text rules tested before the numeric ranges."""
    c = col_of(c)
    other_prefix = None
    for p in DIAG_OTHER_PREFIXES:
        cond = c.startswith(p)
        other_prefix = cond if other_prefix is None else (other_prefix | cond)
    return (F.when(c == DIAG_MISSING, "Missing")
            .when(other_prefix, "Other")
            .when(c.startswith(DIAG_DIABETES_PREFIX), "Diabetes")
            .otherwise(otherwise))


def diag_group(c) -> Column:
    """ICD-9 text -> one of ten groups or ``Missing``; first match wins, codes
    outside every range (and non-numeric text) -> ``Other``."""
    v = safe_double(c)
    expr = None
    for label, ranges, singles in DIAG_GROUPS:
        cond = None
        for lo, hi in ranges:
            part = v.between(lo, hi)
            cond = part if cond is None else cond | part
        for s in singles:
            cond = cond | (v == s)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return diag_prefix_rules(c, expr.otherwise("Other"))


def code_group(c, mapping: Mapping[str, str] | None = None, default: str = "Other",
               members: Sequence[str] | None = None, label: str | None = None) -> Column:
    """Code -> group.  Either a simple CASE over ``mapping`` or, with
    ``members``/``label``, membership in a list; everything else -> default."""
    c = col_of(c)
    if members is not None:
        return F.when(c.isin(list(members)), F.lit(label)).otherwise(default)
    expr = None
    for code, lab in mapping.items():
        expr = F.when(c == code, lab) if expr is None else expr.when(c == code, lab)
    return expr.otherwise(default)


# Two-sided normal critical values for p = .001, .01, .05.
Z_CRIT = ((3.2905267314919255, "***"), (2.5758293035489004, "**"),
          (1.959963984540054, "*"))
P_CUTS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))


def significance_stars(p) -> Column:
    """p < .001 '***', < .01 '**', < .05 '*', else ''."""
    p = col_of(p)
    expr = None
    for cut, stars in P_CUTS:
        expr = F.when(p < cut, stars) if expr is None else expr.when(p < cut, stars)
    return expr.otherwise("")


def stars_from_z(z) -> Column:
    """Same stars from a Wald z (|z| above the two-sided critical value)."""
    az = F.abs(col_of(z))
    expr = None
    for crit, stars in Z_CRIT:
        expr = F.when(az > crit, stars) if expr is None else expr.when(az > crit, stars)
    return expr.otherwise("")


def direction(odds_ratio) -> Column:
    return F.when(col_of(odds_ratio) > 1, "Increases risk").otherwise("Decreases risk")


def rate_pct(target, digits: int = 1) -> Column:
    """``ROUND(100.0 * AVG(target), digits)`` — half-up rounding."""
    return F.round(F.lit(100.0) * F.avg(col_of(target)), digits)
