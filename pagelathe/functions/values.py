"""Values as people write them, as typed cells: column expressions over text whose white space is already squeezed.

Each function gives the cell's text, or null if the text doesn't state exactly one value of the type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and marks for "not known" (lower case).
UNKNOWN = ["?", "??", "???", "-", "--", "–", "—", "−", "...", "…", "n/a", "n.a.", "na", "n. a.", "unknown", "not known", "none given", "not given", "not available", "not stated", "unspecified", "undetermined", "tbd", "tba", "tbc", "t.b.d.", "none", "nil", "null"]
# Scale words and their powers of ten.
SCALES = {"hundred": 2, "thousand": 3, "k": 3, "lakh": 5, "million": 6, "millions": 6, "mln": 6, "mio": 6, "crore": 7, "billion": 9, "billions": 9, "bn": 9, "trillion": 12}
# The first three letters of the months.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

NUMBER = r"^([+−-]?)\s?(\d{1,3}(?:[ ,'’]\d{3})+(?!\d)|\d+)(?:[.,](\d+))?"
ANOTHER = r"^\s*(?:\[[^\]]*\]\s*)?(?:[-–—−/~]|\.\.+|to|or|and|until|till|through|bis)\s*[+−-]?\d"


def known(t: Column) -> Column:
    """The text, unless it is blank or says that the value isn't known."""
    bare = F.trim(F.regexp_replace(t, r"\[[^\[\]]*\]", ""))
    return F.when((t != "") & ~F.lower(bare).isin(UNKNOWN), t)


def _number(t: Column) -> tuple[Column, Column, Column]:
    """Sign, whole digits and digits after the point (without idle zeros) of the number at the start of the text, the point
    moved by the scale word after it; nulls for a range. All is text, so that no digit is lost."""
    whole = F.regexp_replace(F.regexp_extract(t, NUMBER, 2), r"\D", "")
    fraction = F.regexp_extract(t, NUMBER, 3)
    rest = F.regexp_replace(t, NUMBER, "")
    word = F.lower(F.regexp_extract(rest, r"^\s*([A-Za-z]+)(?![A-Za-z²³\d])", 1))
    power = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for scale in SCALES.items() for x in scale]), word), F.lit(0))
    after = F.regexp_replace(rest, rf"(?i)^\s*(?:{'|'.join(SCALES)})\b", "")
    ok = t.rlike(NUMBER) & ~rest.rlike(ANOTHER) & ~after.rlike(ANOTHER) & ~rest.rlike(r"^[\d.,:/%°^]*\d") & ~rest.rlike(r"^\s\d")
    digits = F.regexp_replace(F.concat(whole, F.rpad(fraction, power, F.lit("0"))), r"^0+(?=\d)", "")
    left = F.regexp_replace(F.substring(fraction, power + 1, F.length(fraction)), "0+$", "")
    minus = F.regexp_extract(t, NUMBER, 1).isin("-", "−") & ((digits != "0") | (left != ""))
    return F.when(minus, F.lit("-")).otherwise(F.lit("")), F.when(ok, digits), left


def decimal_cell(t: Column) -> Column:
    """A number with a point, no trailing zeros and all its digits; thousands may be grouped, a comma before one, two or over three digits is a point."""
    sign, digits, left = _number(known(t))
    return F.concat(sign, digits, F.when(left != "", F.concat(F.lit("."), left)).otherwise(F.lit("")))


def int_cell(t: Column) -> Column:
    """A whole number of up to 64 bits as plain digits; a number with a fraction is none."""
    sign, digits, left = _number(known(t))
    return F.when(left == "", F.concat(sign, digits)).try_cast("bigint").cast("string")


def bool_cell(t: Column) -> Column:
    """``true`` or ``false``; a mark or remark in brackets may follow the word."""
    word = F.lower(F.regexp_extract(t, r"^([A-Za-z0-9]+)[.!]?\s*(?:[\[(;,].*)?$", 1))
    return F.when(word.isin("yes", "y", "true", "t", "1"), "true").when(word.isin("no", "n", "false", "f", "0"), "false")


DATE_FORMS = [  # pattern, groups of year, month, day
    (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?!\d)", 1, 3, 4),
    (r"^(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4})(?!\d)", 3, 2, 1),
    (r"^(\d{1,2})(?:st|nd|rd|th)?\.?\s(?:day\s)?(?:of\s)?([A-Za-z]{3,9})\.?,?\s(\d{3,4})(?!\d)", 3, 2, 1),
    (r"^([A-Za-z]{3,9})\.?\s(\d{1,2})(?:st|nd|rd|th)?,?\s(\d{3,4})(?!\d)", 3, 1, 2),
]


def date_cell(t: Column) -> Column:
    """``yyyy-MM-dd`` of a date with its day; null for a range, for a date without its day and for a day that doesn't exist."""
    t = known(t)
    out = F.lit(None).cast("string")
    for pattern, y, m, d in reversed(DATE_FORMS):
        month = F.regexp_extract(t, pattern, m)
        named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(month, 1, 3)))
        number = F.when(month.rlike(r"^\d"), month.try_cast("int")).otherwise(named.cast("int"))
        text = F.format_string("%s-%02d-%s", F.lpad(F.regexp_extract(t, pattern, y), 4, "0"), number, F.lpad(F.regexp_extract(t, pattern, d), 2, "0"))
        rest = F.regexp_replace(t, pattern, "")
        single = ~rest.rlike(r"(?i)^\s*(?:[-–—−/~]|to\b|or\b|until\b|and\b)\s*(?:\d|[a-z]{3,9}\.?\s\d)")
        out = F.when(t.rlike(pattern), F.when(single, text.try_cast("date").cast("string"))).otherwise(out)
    return out


def string_cell(t: Column) -> Column:
    return known(t)


CELLS = {"int": int_cell, "decimal": decimal_cell, "date": date_cell, "bool": bool_cell, "string": string_cell}
#: Spark types of the typed columns. A decimal has 22 digits before the point and 16 after it; cells as text have all.
SQL_TYPES = {"int": "bigint", "decimal": "decimal(38,16)", "date": "date", "bool": "boolean", "string": "string"}
