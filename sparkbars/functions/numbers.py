"""Number columns: null conventions, safe ratios, locale parsing, bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """NULL for NaN and infinities, the value itself otherwise."""
    v = col(x).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(INFINITY)), v)


def num(x: Column | str) -> Column:
    """Missing, junk and non-finite values count as zero."""
    return F.coalesce(finite(x), F.lit(0.0))


def rnd(x: Column | str, digits: int) -> Column:
    """Presentation rounding: non-finite becomes NULL, negative zero becomes zero."""
    r = F.round(finite(x), digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b where b is positive, NULL elsewhere."""
    return F.when(col(b) > 0, col(a) / col(b))


def pct(a: Column | str, b: Column | str) -> Column:
    """100 a / b, zero where b is zero or missing."""
    return F.when(F.coalesce(col(b), F.lit(0)) != 0, col(a) / col(b) * 100).otherwise(F.lit(0.0))


def bounded(x: Column | str, lo: float, hi: float) -> Column:
    """NULL outside [lo, hi] or when not finite."""
    v = finite(x)
    return F.when(v.between(lo, hi), v)


# Accepted ranges of fundamental ratios.
RATIO_BOUNDS = {
    "per": (-1000.0, 1000.0),
    "pbv": (-100.0, 100.0),
    "roe": (-500.0, 500.0),
    "roa": (-500.0, 500.0),
}


def parse_number(x: Column | str, integer: bool = False) -> Column:
    """Text with '.' grouping and ',' decimals. Several dots, or groups of three digits after
    each dot, are grouping; blanks, dashes and 'nan' are NULL."""
    s = F.replace(F.trim(col(x).cast("string")), F.lit(" "), F.lit(""))
    no_dots = F.replace(s, F.lit("."), F.lit(""))
    dots = F.length(s) - F.length(no_dots)
    text = (
        F.when(s.contains(",") & (dots > 0), F.replace(no_dots, F.lit(","), F.lit(".")))
        .when(s.contains(","), F.replace(s, F.lit(","), F.lit(".")))
        .when((dots > 1) | s.rlike(r"^[+-]?\d{1,3}\.\d{3}$"), no_dots)
        .otherwise(s)
    )
    value = F.when(~s.isin("", "-", "nan", "None"), text.try_cast("double"))
    return value.cast("long") if integer else value


def parse_int_loose(x: Column | str) -> Column:
    """Whole number out of decorated text: currency and unit words are dropped, the separator
    nearest the end is the decimal one when both occur, a lone separator before exactly three
    final digits is grouping, anything unreadable is zero."""
    s = F.regexp_replace(F.coalesce(col(x).cast("string"), F.lit("")), r"(?i)rp|idr|lot|lembar|x", "")
    s = F.regexp_replace(s, r"[^0-9,.\-]", "")
    no_dots = F.replace(s, F.lit("."), F.lit(""))
    no_commas = F.replace(s, F.lit(","), F.lit(""))
    has_dot, has_comma = s.contains("."), s.contains(",")
    # Position counted from the end: the smaller one is the separator nearer the end.
    comma_is_last = F.instr(F.reverse(s), ",") < F.instr(F.reverse(s), ".")
    text = (
        F.when(has_dot & has_comma & comma_is_last, F.replace(no_dots, F.lit(","), F.lit(".")))
        .when(has_dot & has_comma, no_commas)
        .when(has_comma & s.rlike(r",[^,]{3}$"), no_commas)
        .when(has_comma, F.replace(s, F.lit(","), F.lit(".")))
        .when(has_dot & s.rlike(r"\.[^.]{3}$"), no_dots)
        .otherwise(s)
    )
    return F.coalesce(F.bround(finite(text)).cast("long"), F.lit(0).cast("long"))
