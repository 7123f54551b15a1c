"""Column expressions on text, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's str.strip and str.split see it.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(text: Column) -> Column:
    """``text`` without white space at either end (trim() takes spaces only)."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def lstrip(text: Column) -> Column:
    """``text`` without white space at its start."""
    return F.regexp_replace(text, f"^{BLANK}+", "")


def squeeze(text: Column) -> Column:
    """``text`` with every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased terms between white space, punctuation kept; null text has none."""
    spaced = F.translate(F.lower(F.coalesce(text, F.lit(""))), BLANKS, " " * len(BLANKS))  # one pass, where a pattern would be tried at each place
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def title_case(text: Column) -> Column:
    """Every letter that follows a non-letter in upper case, all others in lower.

    ``initcap`` differs: it capitalises after white space only.
    """
    letters = F.split(F.lower(text), "")
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("after"))
    step = lambda s, c: F.struct(
        F.concat(s["out"], F.when(s["after"], c).otherwise(F.upper(c))).alias("out"),
        c.rlike(r"^\p{L}$").alias("after"),
    )
    return F.aggregate(letters, start, step, lambda s: s["out"])
