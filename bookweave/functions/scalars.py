"""Column expressions that read user input: numbers, tickers, currencies, dates, weights, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MISSING = ("", "NA", "N/A", "NAN", "NONE", "NULL", "-", "--")
CRYPTO = {"BTC": "BTC-USD", "ETH": "ETH-USD"}
NO_TICKER = ("", "NAN", "NONE", "<NA>")
NO_CURRENCY = ("", "NAN", "NONE", "<NA>", "N/A", "NA")
CURRENCY = {
    "$": "USD", "US$": "USD", "USDOLLAR": "USD", "USDOLLARS": "USD", "£": "GBP", "STERLING": "GBP", "POUND": "GBP", "POUNDS": "GBP",
    "€": "EUR", "EURO": "EUR", "EUROS": "EUR", "GBPENCE": "GBX", "PENCE": "GBX",
}
ISSUER_STOP = (
    "plc", "inc", "corp", "corporation", "company", "group", "holding", "holdings", "nv", "se", "ag", "etf", "ucits",
    "ishares", "vanguard", "core", "trust", "fund", "the", "ltd", "limited",
)


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def missing(v: Column) -> Column:
    return v.isNull() | F.upper(F.trim(v)).isin(*MISSING)


def clean_number(v: Column) -> Column:
    """A number without currency signs, commas, percent signs or spaces; brackets mean negative; percent is not divided."""
    text = F.trim(v)
    bare = F.regexp_replace(text, r"[$£€,%\s()]", "")
    x = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,2})?$"), bare).try_cast("double")
    return F.when(text.rlike(r"^\(.*\)$"), -F.abs(x)).otherwise(x)


def ticker(v: Column) -> Column:
    """Trimmed and in capitals; empty where there is none."""
    up = F.upper(F.trim(v))
    return F.when(v.isNull() | up.isin(*NO_TICKER), "").otherwise(F.coalesce(F.element_at(_map(CRYPTO), up), up))


def currency(v: Column) -> Column:
    """A code in capitals without spaces, names and signs as codes; USD where there is none."""
    up = F.replace(F.upper(F.trim(v)), F.lit(" "), F.lit(""))
    return F.when(v.isNull() | up.isin(*NO_CURRENCY), "USD").otherwise(F.coalesce(F.element_at(_map(CURRENCY), up), up))


def label(v: Column) -> Column:
    """A header: lower case, trimmed, `_` and `-` as spaces."""
    return F.trim(F.translate(F.lower(v), "_-", "  "))


def token(v: Column) -> Column:
    return F.regexp_replace(F.lower(v), "[^a-z0-9]", "")


def iso_date(v: Column) -> Column:
    """YYYY-MM-DD, with a time or without; anything else is null."""
    return F.when(v.rlike(r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?\s*$"), F.try_to_timestamp(F.substring(F.trim(v), 1, 10), F.lit("yyyy-MM-dd")).cast("date"))


def weight(v: Column, unit: Column) -> Column:
    """An exact weight from percent or decimal text, DECIMAL(19,18); null where undeclared, not a number or outside 0 to 1."""
    x = F.regexp_replace(F.trim(v), r"[%\s]", "").try_cast("decimal(38,18)")
    w = F.when(unit == "percent", (x / 100).cast("decimal(38,18)")).when(unit == "decimal", x)
    return F.when((w >= 0) & (w <= 1), w).cast("decimal(19,18)")


def issuer_words(v: Column) -> Column:
    """Words of more than one letter that are not generic, in order."""
    return F.filter(F.regexp_extract_all(F.lower(v), F.lit(r"([a-z]+)"), 1), lambda w: (F.length(w) > 1) & ~w.isin(*ISSUER_STOP))


def spreadsheet_safe(v: Column) -> Column:
    """Text that a spreadsheet would run gets a leading apostrophe."""
    return F.when(v.rlike(r"^\s*[=+@-]"), F.concat(F.lit("'"), v)).otherwise(v)
