"""Text functions on columns and on column names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.functions.numeric import round_even

# Symbols spelled out in column names.
SYMBOL_WORDS = {"$": "usd", "%": "pct", "#": "num"}

# Short words and domain synonyms expanded before names are compared.
ABBREVIATIONS = {
    "hd": "head", "wt": "weight", "amt": "amount", "qty": "quantity",
    "avg": "average", "num": "number", "dt": "date", "pct": "percent",
    "temp": "temperature", "carc": "carcass", "cwt": "hundredweight",
    "del": "delivered", "recv": "received", "grp": "group",
    "loc": "location", "desc": "description", "cat": "category",
    "sub": "subcategory", "prod": "production", "fac": "facilities",
    "trans": "transportation", "freq": "frequency", "yr": "year",
    "mo": "month", "wk": "week", "lbs": "pounds", "lb": "pounds",
    "gal": "gallons", "kwh": "kilowatt_hours",
    "expense": "cost", "acct": "accounting", "supplier": "vendor",
    "farm": "site", "stage": "phase", "type": "category",
    "pay": "payment", "settlement": "payment", "ship": "delivery",
    "barn": "barn", "bldg": "barn", "building": "barn",
    "pig": "pig", "hog": "pig", "swine": "pig",
}

# Code points that count as white space.
_WHITE_POINTS = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
_WHITE_POINTS += [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WHITE = "".join(map(chr, _WHITE_POINTS))

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def snake_name(name: str) -> str:
    """Column name in snake case: ``Avg Price-$`` becomes ``avg_price_usd``."""
    spelled = "".join(SYMBOL_WORDS.get(ch, ch) for ch in name.strip())
    joined = re.sub(r"\W", "", re.sub(r"[\s/\\-]+", "_", spelled))
    humps = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", joined)
    return "_".join(part for part in humps.split("_") if part).lower()


def snake_columns(df: DataFrame) -> DataFrame:
    """All columns renamed to snake case; two names that fall together are an error."""
    names = [snake_name(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"column names collide after renaming: {clashes}")
    return df.toDF(*names)


def strip(col: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(col, F.lit(WHITE))


def strip_columns(df: DataFrame) -> DataFrame:
    """Every string column stripped."""
    return df.select(
        *[
            strip(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def to_number(col: Column) -> Column:
    """Number in a text, or null; Java's suffixes (``5d``) are not numbers here."""
    text = col.cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def comma_number(col: Column) -> Column:
    """Number written with thousands commas, or null."""
    return to_number(F.regexp_replace(col.cast("string"), ",", ""))


def lookup(col: Column, table: dict) -> Column:
    """Value of a small literal table for the column, null when the key is not in it."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col)


def contains_any(col: Column, words: list[str]) -> Column:
    """True when the text holds any of the words as a substring."""
    return reduce(lambda a, b: a | b, [col.contains(w) for w in words])


def plain_name(name: str) -> str:
    """Column name for comparing: lower case words parted by single blanks."""
    words = re.sub(r"[_\-\s/\\]+", " ", name.lower().strip())
    return re.sub(r"[^\w\s]", "", words).strip()


def spelled_name(name: str) -> str:
    """Plain name with abbreviations and synonyms written out."""
    return " ".join(ABBREVIATIONS.get(w, w) for w in plain_name(name).split())


def signed_money(col: Column) -> Column:
    """``$+1.50`` display form; ``N/A`` for null."""
    return F.when(col.isNull(), "N/A").otherwise(F.format_string("$%+.2f", round_even(col, 2)))


def whole_percent(col: Column) -> Column:
    """A fraction as a whole percent: 0.86 becomes ``86%``."""
    return F.concat(F.rint(col * 100).cast("bigint").cast("string"), F.lit("%"))
