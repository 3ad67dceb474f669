"""Column-expression builders.  Each returns a ``Column``; nothing here runs
a job, so every helper stays inside whole-stage codegen."""

from cohortlens.functions.casts import prefix_int, safe_double
from cohortlens.functions.dates import (
    iso_date, day_diff, weekday_number, weekday_name, parse_mixed_date,
    month_key,
)
from cohortlens.functions.recode import (
    band, flag, recode_sentinel, label_missing, measured_flag, band_ordinal,
    diag_group, code_group, significance_stars, direction, rate_pct,
)

__all__ = [
    "prefix_int", "safe_double", "iso_date", "day_diff", "weekday_number",
    "weekday_name", "parse_mixed_date", "month_key", "band", "flag",
    "recode_sentinel", "label_missing", "measured_flag", "band_ordinal",
    "diag_group", "code_group", "significance_stars", "direction", "rate_pct",
]
