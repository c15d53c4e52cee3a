"""Column expressions which clean raw text. All are built-in expressions; none raises on bad input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space of all of Unicode, and the four separators of ASCII.
BLANK = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
#: The same characters one by one: removing them needs no pattern, which is most of the time of cleaning a cell.
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Layouts of dates which do not start with the year.
DATE_FORMATS = ("M/d/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy")
TIME_OF_DAY = r"[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?[AaPp][Mm])?( ?(Z|[+-]\d{2}:?\d{2}))?$"
YEAR_FIRST = r"^(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})日?"
PLAIN_DAY = r"^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}( ([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?)?$"
COMPACT_DATE = r"^(\d{4})(\d{2})(\d{2})$"
# Serial day numbers of spreadsheets and their first day.
SERIAL_MIN, SERIAL_MAX, SERIAL_ORIGIN = 1, 132320, "1899-12-30"
# Signs dropped from numbers.
NUMBER_NOISE = ",¥￥" + BLANKS
# Company-form suffixes dropped from names.
COMPANY_SUFFIX = r"(有限责任公司|有限公司|股份有限公司|责任公司)$"


def trimmed(c: Column) -> Column:
    """Text without white space at both ends."""
    return F.btrim(c.cast("string"), F.lit(BLANKS))


def dimension_col(c: Column) -> Column:
    """Trimmed text, NULL when empty."""
    return F.nullif(trimmed(c), F.lit(""))


def provided(c: Column) -> Column:
    """True when the source holds something other than blanks."""
    return dimension_col(c).isNotNull()


def date_of(text: Column) -> tuple[Column, Column]:
    """(date, invalid flag) of a trimmed text."""
    number = text.try_cast("double")
    serial = F.date_add(F.lit(SERIAL_ORIGIN).cast("date"), F.floor(number).cast("int"))
    iso = F.regexp_replace(F.regexp_replace(text, COMPACT_DATE, "$1-$2-$3"), YEAR_FIRST, "$1-$2-$3")
    year_first = F.when(iso.rlike(r"^\d{4}-\d"), iso).try_cast("timestamp")
    day = F.initcap(F.regexp_replace(F.regexp_replace(text, TIME_OF_DAY, ""), r"(\d)-([A-Za-z]+)-(\d)", "$1 $2 $3"))
    parsed = F.coalesce(year_first, *[F.try_to_timestamp(day, F.lit(f)) for f in DATE_FORMATS]).cast("date")
    is_serial = F.coalesce(number.between(SERIAL_MIN, SERIAL_MAX), F.lit(False))
    # most exports write the year first, with or without a time: one pattern and one cast, nothing else is tried for them
    plain = F.when(text.rlike(PLAIN_DAY), F.translate(F.substring(text, 1, 10), "/", "-")).try_cast("date")
    value = F.coalesce(plain, F.when(is_serial, serial).otherwise(parsed))
    return value, text.isNotNull() & value.isNull()


def date_col(c: Column) -> tuple[Column, Column]:
    """(date, invalid flag) of mixed text dates, timestamps and serial day numbers."""
    return date_of(dimension_col(c))


def finite_number(text: Column) -> Column:
    """Finite double of a trimmed number text; NULL when there is none."""
    number = F.translate(text, NUMBER_NOISE, "").try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def number_of(text: Column, number: Column, kind: str) -> tuple[Column, Column, Column]:
    """(value, invalid flag, not-whole flag) of a trimmed text and its finite double.

    ``kind`` is ``"count"`` (whole numbers, bigint) or ``"money"`` (decimal(18,2)). The value is
    taken from the text where possible, so that no digit is lost to the double.
    """
    plain = F.translate(text, NUMBER_NOISE, "")
    invalid = text.isNotNull() & number.isNull()
    if kind == "money":
        exact = plain.try_cast("decimal(38,10)").try_cast("decimal(18,2)")
        value = F.when(number.isNotNull(), F.coalesce(exact, number.try_cast("decimal(18,2)")))
        return value, invalid | (text.isNotNull() & value.isNull()), F.lit(False)
    split = F.coalesce(F.abs(number % 1) > 1e-9, F.lit(False))
    value = F.when(
        number.isNotNull() & ~split, F.coalesce(plain.try_cast("bigint"), F.round(number).try_cast("bigint"))
    )
    # a whole number beyond the type is lost, and so invalid
    return value, invalid | (text.isNotNull() & ~split & value.isNull()), split


def number_col(c: Column, kind: str) -> tuple[Column, Column, Column]:
    """(value, invalid flag, not-whole flag) of a number written as text."""
    text = dimension_col(c)
    return number_of(text, finite_number(text), kind)


def identifier_col(c: Column) -> Column:
    """Identifier text: whole numbers lose ``.0``, blanks are NULL, leading zeros stay."""
    return F.nullif(F.regexp_replace(trimmed(c), r"^(-?\d+)\.0+$", "$1"), F.lit(""))


def compact_col(c: Column) -> Column:
    """Text without any white space; NULL becomes the empty text."""
    return F.coalesce(F.translate(c.cast("string"), BLANKS, ""), F.lit(""))


def name_col(c: Column) -> Column:
    """Comparable company name: no white space, lower case, no company-form suffix."""
    return F.regexp_replace(F.lower(compact_col(c)), COMPANY_SUFFIX, "")


def month_col(c: Column, year: str = r"[12]\d{3}") -> Column:
    """First year and month found in a text, as ``yyyy-MM``; NULL when none is found.

    ``year``: pattern of the years accepted.
    """
    text = F.regexp_replace(compact_col(c), r"\.0$", "")
    pattern = rf"({year})[-/]?(\d{{2}})"
    found = F.concat(
        F.regexp_extract(text, pattern, 1), F.lit("-"), F.regexp_extract(text, pattern, 2)
    )
    return F.nullif(found, F.lit("-"))


def lenient_number_col(c: Column) -> Column:
    """Number without thousands separators; NULL when blank or unreadable."""
    return F.regexp_replace(compact_col(c), ",", "").try_cast("double")


def trim_all(df: DataFrame) -> DataFrame:
    """Trim every header and every text column."""
    return df.select(
        *[
            (trimmed(F.col(f"`{name}`")) if kind == "string" else F.col(f"`{name}`")).alias(name.strip())
            for name, kind in df.dtypes
        ]
    )
