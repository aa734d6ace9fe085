"""Date parsing and futures contract months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paddock.functions.text import WHITE, lookup

# Month numbers and exchange letters.
MONTH_NUMBERS = {
    "Jan": 1, "Feb": 2, "Mar": 3, "Apr": 4, "May": 5, "Jun": 6,
    "Jul": 7, "Aug": 8, "Sep": 9, "Oct": 10, "Nov": 11, "Dec": 12,
}
MONTH_LETTERS = {
    "Jan": "F", "Feb": "G", "Mar": "H", "Apr": "J", "May": "K", "Jun": "M",
    "Jul": "N", "Aug": "Q", "Sep": "U", "Oct": "V", "Nov": "X", "Dec": "Z",
}
# Months without a lean hog contract and the month that stands in.
UNLISTED_TO_LISTED = {"F": "G", "H": "J", "U": "V", "X": "Z"}
LISTED_LETTERS = ["G", "J", "K", "M", "N", "Q", "V", "Z"]

_BLANK = f"[{WHITE}]*"
_CLOCK = r"(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?: ?[AaPp][Mm])?(?:Z|[+-]\d{2}:?\d{2})?)?"
_MONTH, _DAY = r"(0?[1-9]|1[0-2])", r"(0?[1-9]|[12]\d|3[01])"

# All written forms in one pattern, month before day where both fit. A group that took no
# part in a match is empty in the replacement, so the groups of the forms are put side by
# side. A text that is no date costs one match and no exception.
_NUMERIC = (
    f"^{_BLANK}(?:(\\d{{4}})[-/]{_MONTH}[-/]{_DAY}{_CLOCK}"
    r"|(\d{4})(\d{2})(\d{2})"
    f"|{_MONTH}[-/]{_DAY}[-/](\\d{{4}}){_CLOCK}"
    f"|{_DAY}[-/]{_MONTH}[-/](\\d{{4}}){_CLOCK}){_BLANK}$"
)
_NUMERIC_ISO = "$1$4$9$12-$2$5$7$11-$3$6$8$10"
_SHORT_YEAR = f"^{_BLANK}(?:{_MONTH}/{_DAY}/(\\d{{2}}){_CLOCK}|{_DAY}/{_MONTH}/(\\d{{2}}){_CLOCK}){_BLANK}$"
_SHORT_YEAR_ISO = "20$3$6-$1$5-$2$4"
_WORDED = f"^{_BLANK}(?:([A-Za-z]{{3}})[a-z]* (\\d{{1,2}}),? (\\d{{4}})|(\\d{{1,2}})[- ]([A-Za-z]{{3}})[a-z]*[- ](\\d{{4}})){_BLANK}$"
_WORDED_DAY = "$2$4 $1$5 $3$6"


# Every form has a year of four digits or two slashes; most files have the plain form.
_NO_DATE_WITHOUT = r"\d{4}|\d/\d{1,2}/\d"
_PLAIN = r"^\d{4}-\d{2}-\d{2}$"


def parse_date(col: Column) -> Column:
    """Date in a text of mixed formats, month before day, null when it does not parse."""
    text = col.cast("string")
    return (
        F.when(text.rlike(_PLAIN), text.try_cast("date"))
        .when(~text.rlike(_NO_DATE_WITHOUT), F.lit(None).cast("date"))
        .when(text.rlike(_NUMERIC), F.regexp_replace(text, _NUMERIC, _NUMERIC_ISO).try_cast("date"))
        .when(text.rlike(_SHORT_YEAR), F.regexp_replace(text, _SHORT_YEAR, _SHORT_YEAR_ISO).try_cast("date"))
        .when(text.rlike(_WORDED), F.try_to_date(F.regexp_replace(text, _WORDED, _WORDED_DAY), "d MMM yyyy"))
    )


def parse_yyyymmdd(col: Column) -> Column:
    """Date written as an eight digit number, null when it is none."""
    pattern = r"^(\d{4})(\d{2})(\d{2})$"
    text = col.cast("string")
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, "$1-$2-$3").try_cast("date"))


def _contract_parts(col: Column) -> tuple[Column, Column]:
    parts = F.split(col, "-")
    return F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))


def contract_symbol(col: Column, root: str = "HE") -> Column:
    """Contract month ``25-Jun`` as symbol ``HEM25``; unlisted months move to the next listed one."""
    year, month = _contract_parts(col)
    letter = F.coalesce(lookup(month, MONTH_LETTERS), F.lit("?"))
    return F.concat(F.lit(root), F.coalesce(lookup(letter, UNLISTED_TO_LISTED), letter), year)


def contract_expiry(symbol: Column) -> Column:
    """Symbol ``HEM25`` as 202506, the month its contract expires; null for other texts."""
    letter, year = (F.regexp_extract(symbol, r"([FGHJKMNQUVXZ])(\d{2})$", i) for i in (1, 2))
    numbers = {mark: MONTH_NUMBERS[month] for month, mark in MONTH_LETTERS.items()}
    return (F.lit(2000) + year.try_cast("int")) * 100 + lookup(letter, numbers)


def contract_is_unlisted(col: Column) -> Column:
    """True when the contract month has no lean hog contract of its own."""
    _, month = _contract_parts(col)
    return ~F.coalesce(lookup(month, MONTH_LETTERS), F.lit("?")).isin(LISTED_LETTERS)


def contract_year(col: Column) -> Column:
    year, _ = _contract_parts(col)
    return F.lit(2000) + year.try_cast("int")


def contract_month(col: Column) -> Column:
    _, month = _contract_parts(col)
    return lookup(month, MONTH_NUMBERS)


def contract_yyyymm(col: Column) -> Column:
    """Contract month ``25-Jun`` as 202506; an unknown month counts as January."""
    return contract_year(col) * 100 + F.coalesce(contract_month(col), F.lit(1))
