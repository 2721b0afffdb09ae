"""Column expressions that turn text into values; bad input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that the feeds use.
TRUE_WORDS, FALSE_WORDS = ["true", "1", "yes", "y"], ["false", "0", "no", "n"]
EXCHANGES = {"TOKYO": "TSE", "T": "TSE", "XTKS": "TSE"}

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def finite(c: Column) -> Column:
    """A finite double. Suffixes, underscores, NaN and infinities don't count as numbers."""
    text = F.trim(c)
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def accounting(c: Column) -> Column:
    """Thousands separators go, and parentheses mean a negative number."""
    text = F.regexp_replace(F.trim(c), ",", "")
    return finite(F.regexp_replace(text, r"^\((.*)\)$", "-$1"))


def boolean(c: Column) -> Column:
    word = F.lower(F.trim(c))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def any_date(c: Column) -> Column:
    """ISO (the first ten characters), yyyyMMdd or yyyy/MM/dd."""
    text = F.trim(c)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    packed = F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))
    slashed = F.when(text.rlike(r"^\d{4}/\d{2}/\d{2}$"), F.try_to_date(text, "yyyy/MM/dd"))
    return F.coalesce(iso, packed, slashed)


def first_present(columns: list[str], present: list[str]) -> Column:
    """The first of the columns, among those that the schema has, that isn't blank; 0 is a value like any other."""
    usable = [blank_to_null(F.col(c).cast("string")) for c in columns if c in present]
    return F.coalesce(*usable) if usable else F.lit(None).cast("string")


def stock_code(c: Column, letters: bool = True) -> Column:
    """Four places, filled with zeros if digits only. letters=False strips everything but digits first."""
    kept = F.upper(F.regexp_replace(c, r"[^0-9A-Za-z]" if letters else r"[^0-9]", ""))
    cut = F.substring(kept, 1, 4)
    return F.when(kept == "", None).when(kept.rlike(r"^\d+$") & (F.length(kept) < 4), F.lpad(kept, 4, "0")).otherwise(cut if letters else kept)


def exchange(c: Column, default: str = "TSE") -> Column:
    name = F.upper(F.coalesce(blank_to_null(c), F.lit(default)))
    known = F.create_map(*[F.lit(x) for pair in EXCHANGES.items() for x in pair])
    return F.coalesce(F.element_at(known, name), name)


def security_id_jp(raw: Column, code: Column, venue: Column, letters: bool = True) -> Column:
    """JP:code:venue. A given id in three parts is normalised, one of digits only is a code."""
    parts = F.split(raw, ":")
    built = F.concat_ws(":", F.lit("JP"), code, venue)
    return (
        F.when(blank_to_null(raw).isNull(), F.when(code.isNotNull(), built))
        .when(F.size(parts) == 3, F.concat_ws(":", F.upper(parts[0]), stock_code(parts[1], letters), exchange(parts[2])))
        .when(raw.rlike(r"^\d+$"), F.concat_ws(":", F.lit("JP"), stock_code(raw, letters), venue))
        .otherwise(raw)
    )


def padded_cik(c: Column) -> Column:
    text = F.trim(c)
    return F.when(text.rlike(r"^\d{1,10}$"), F.lpad(text, 10, "0"))


def price_ticker(country: Column, ticker: Column, code: Column, universe: Column) -> Column:
    board = F.when(F.lower(universe).contains("kosdaq"), ".KQ").otherwise(".KS")
    return F.when(country == "US", F.translate(ticker, ".", "-")).when(country == "KR", F.concat(code, board)).when(country == "JP", F.concat(code, F.lit(".T")))
