"""Price text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: price patterns ---
NUMBER_PATTERN = r"[0-9]+(?:[.,][0-9]+)?"
CURRENCY_PATTERN = r"(?i)(?:[$€£¥]|EUR|USD|CHF|GBP)"


def parse_price(text: Column, locale_aware: bool = False) -> Column:
    """First number of a displayed price, spaces ignored; null if there is none.

    One separator is read, as the price tables were filled: ``$1,234.56`` gives 1.234. With
    ``locale_aware`` the last separator is the decimal one and the others group: 1234.56.
    """
    compact = F.regexp_replace(text, "[  ]", "")
    if not locale_aware:
        return F.replace(F.regexp_extract(compact, NUMBER_PATTERN, 0), F.lit(","), F.lit(".")).try_cast("double")
    number = F.regexp_extract(compact, r"[0-9]+(?:[.,][0-9]+)*", 0)
    whole = F.regexp_replace(F.regexp_extract(number, r"^(.*?)(?:[.,][0-9]{1,2})?$", 1), "[.,]", "")
    cents = F.regexp_extract(number, r"[.,]([0-9]{1,2})$", 1)
    return F.concat(whole, F.lit("."), F.when(cents == "", "0").otherwise(cents)).try_cast("double")


def strip_price(text: Column, symbols: str = "$,€£") -> Column:
    """Symbols dropped, the rest must be a number; null otherwise."""
    bare = F.trim(F.translate(text, symbols, ""))
    return F.regexp_extract(bare, r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$", 0).try_cast("double")


def currency_of(text: Column) -> Column:
    """First currency symbol or code, '' if there is none."""
    return F.coalesce(F.regexp_extract(text, CURRENCY_PATTERN, 0), F.lit(""))
