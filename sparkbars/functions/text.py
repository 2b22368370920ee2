"""Text columns: symbols, holder classes, reasons, explanations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import col

SYMBOL_PATTERN = r"^[A-Z0-9][A-Z0-9.-]{0,14}$"


def normalise_symbol(x: Column | str) -> Column:
    return F.upper(F.trim(col(x)))


def valid_symbol(x: Column | str) -> Column:
    return F.coalesce(normalise_symbol(x).rlike(SYMBOL_PATTERN), F.lit(False))


def normalise_code(x: Column | str) -> Column:
    """Upper case letters and digits only."""
    return F.regexp_replace(F.upper(F.trim(F.coalesce(col(x), F.lit("")))), "[^A-Z0-9]", "")


def norm_reason(x: Column | str) -> Column:
    """A reason without its trailing parenthesised figures, so that equal reasons group together."""
    return F.trim(F.regexp_replace(col(x), r"\s*\([^)]*\)\s*$", ""))


def search_rank(sym: Column | str, name: Column | str, query: str) -> Column:
    """0 exact symbol, 1 symbol prefix, 2 symbol part, 3 exact name, 4 name prefix, 5 a word of
    the name starts with it, 6 name part, NULL no match."""
    q = query.strip().upper()
    s, n = F.upper(col(sym)), F.upper(F.coalesce(col(name), F.lit("")))
    words = F.split(n, "[^A-Z0-9]+")
    return (
        F.when(s == q, 0)
        .when(s.startswith(q), 1)
        .when(s.contains(q), 2)
        .when(n == q, 3)
        .when(n.startswith(q), 4)
        .when(F.exists(words, lambda w: w.startswith(q)), 5)
        .when(n.contains(q), 6)
    )


def search_symbols(master: DataFrame, query: str, limit: int = 40) -> DataFrame:
    """The best matches for a typed query (a top-k: the limit is the feature)."""
    ranked = master.withColumn("match_rank", search_rank("sym", "name", query))
    return ranked.filter(F.col("match_rank").isNotNull()).orderBy("match_rank", "sym").limit(limit)


def explain(x: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """The sentence of the first rule whose pattern is found in the text; ``$1`` stands for the
    pattern's first group. Text that no rule knows is returned as it is."""
    s = col(x)
    out = None
    for pattern, sentence in rules:
        text = F.lit(sentence)
        if "$1" in sentence:
            text = F.replace(text, F.lit("$1"), F.regexp_extract(s, pattern, 1))
        out = F.when(s.rlike(pattern), text) if out is None else out.when(s.rlike(pattern), text)
    return s if out is None else out.otherwise(s)


def run_select(spark, sql: str, limit: int = 200) -> DataFrame:
    """An ad-hoc read-only statement over the registered views (row cap is the feature)."""
    text = sql.strip().rstrip(";").strip()
    head = text.split(None, 1)[0].upper() if text else ""
    if head not in ("SELECT", "WITH") or ";" in text:
        raise ValueError("only a single SELECT or WITH statement is allowed")
    return spark.sql(text).limit(limit)


# Holder classes by code or keyword, first match wins.
HOLDER_CLASSES = (
    (("ID",), ("INDIVIDUAL",), "Individual"),
    (("CP",), ("CORPORATE", "COMPANY"), "Corporate"),
    (("MF",), ("MUTUAL", "FUND"), "Fund / Asset Manager"),
    (("IB",), ("FINANCIAL", "BANK"), "Financial Institution"),
    (("SC",), ("SECURIT", "INVESTMENT MANAGER"), "Securities / Investment"),
    (("IS",), ("INSURANCE",), "Insurance"),
    (("PF",), ("PENSION",), "Pension Fund"),
    (("FD",), ("FOUNDATION",), "Foundation"),
)
UNCLASSIFIED = "Unclassified"


def holder_class(x: Column | str) -> Column:
    """One of the holder categories for a class code or description, else the text itself."""
    raw = F.upper(F.trim(F.coalesce(col(x), F.lit(""))))
    out = F.when(raw == "", F.lit(UNCLASSIFIED))
    # A pension fund is also a fund by keyword, so it is decided before the fund rule.
    out = out.when(raw.contains("PENSION") & (raw.contains("FUND") | raw.contains("MUTUAL"))
                   & ~raw.contains("INDIVIDUAL") & ~raw.contains("CORPORATE") & ~raw.contains("COMPANY"),
                   F.lit("Pension Fund"))
    for codes, words, label in HOLDER_CLASSES:
        hit = raw.isin(*codes)
        for word in words:
            hit = hit | raw.contains(word)
        out = out.when(hit, F.lit(label))
    return out.otherwise(F.trim(col(x)))
