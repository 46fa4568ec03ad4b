"""Text rules shared by all operators, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the control characters that separate records; the inside of a character class.
SPACE = r"\s\p{Z}\x{85}\x1c-\x1f"
#: The same as characters.
SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none outside."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def strip(c: Column) -> Column:
    """Without outer white space of any kind (``trim`` knows only the space)."""
    return F.btrim(c, F.lit(SPACES))


def page_title(c: Column) -> Column:
    """A title by the title rule; null if nothing is left of it.

    Underscores are spaces, a run of spaces is one space, outer spaces don't count, the first letter is upper case.
    """
    t = F.trim(F.regexp_replace(c, f"[_{SPACE}]+", " "))
    return F.when(F.length(t) > 0, F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30)))


def param_name(c: Column) -> Column:
    """A parameter's name: lower case, no outer spaces, runs of spaces, underscores and hyphens as one underscore."""
    return F.regexp_replace(F.lower(strip(c)), f"[_{SPACE}-]+", "_")


def instant(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp string, null if it is none; a string without a zone is UTC."""
    t = strip(c)
    zoned = F.when(t.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.unix_micros(zoned.try_cast("timestamp"))


def utc_text(micros: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` of microseconds since 1970, whatever the session's zone."""
    seconds = F.floor(micros / F.lit(1_000_000))
    stamp = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.concat(F.replace(F.substring(stamp.cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.lit("Z"))


def slug(c: Column) -> Column:
    """A file name of a title: lower case words joined by underscores; empty if it has no word."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]"), lambda w: w != "")
    return F.array_join(words, "_")
