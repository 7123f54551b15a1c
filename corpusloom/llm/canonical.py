"""Problem 8: one form for texts that look the same.

Most characters of most texts are already in their final form, as Unicode's
normalization quick check tells without normalizing.  So each text is searched
for unstable characters only; the word around each is taken as boundary
context, brought to its form, and spliced back into the unchanged rest.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import cut

# Letters of other scripts that are drawn like a Latin letter.
LOOK_ALIKE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ӏ": "I", "Ѵ": "V", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j",
    # Coptic
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲭ": "X",
    "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H",
    "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Armenian, and letters of phonetic alphabets
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Լ": "L",
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʋ": "v",
}
# Hyphens that are drawn like the one of ASCII; line ends of other kinds.
HYPHENS = chr(0x2010) + chr(0x2011)
LINE_ENDS = "\r\x0b\x0c\x85" + chr(0x2028) + chr(0x2029)
#: Tags of compatibility decompositions that change what is drawn.
DRAWN_OTHERWISE = {"<super>", "<sub>", "<circle>", "<fraction>", "<square>", "<font>", "<vertical>"}
JOINER = chr(0x200D)
PICTURE_MARKS = chr(0xFE0F) + "".join(map(chr, range(0x1F3FB, 0x1F400)))
LAST = 0x20000  # beyond lie ideographs and private use, of which only U+2F800-2FA1F are unstable
EXTRA = range(0x2F800, 0x2FA20)
#: What stands between words, combining marks being part of them.
WORDS = re.compile(rf"([^\w{chr(0x300)}-{chr(0x36F)}]+)")


def _form(char: str) -> str:
    """What one character stands for, before composition."""
    if char in LOOK_ALIKE:
        return char  # depends on the word it stands in
    if char in HYPHENS:
        return "-"
    if char in LINE_ENDS:
        return "\n"
    kind = unicodedata.category(char)
    if kind == "Zs" or char == "\t":
        return " "
    if kind == "Cf":
        return ""
    tag, *rest = unicodedata.decomposition(char).split() or [""]
    if tag in DRAWN_OTHERWISE or char == "ſ" or not tag:
        return char
    if not tag.startswith("<"):
        return unicodedata.normalize("NFC", char)
    parts = "".join(chr(int(x, 16)) for x in rest)
    if parts[0] == " ":  # a spacing accent
        return char
    return "".join(_form(c) for c in parts)


@lru_cache(1)
def _tables() -> tuple[re.Pattern, dict[int, str]]:
    """The pattern of an unstable character, and the forms of single ones.

    Unstable are: characters whose form differs, those that may compose with
    what stands before (quick check "maybe"), and look-alikes.
    """
    unstable, forms = [], {}
    for code in [*range(0x80, 0xD800), *range(0xE000, LAST), *EXTRA, 9, 11, 12, 13]:
        char = chr(code)
        form = _form(char)
        if form != char:
            forms[code] = form
        if form != char or char in LOOK_ALIKE or unicodedata.combining(char) or not unicodedata.is_normalized("NFC", chr(0xAC00) + char) or code in range(0x1161, 0x11C3):
            unstable.append(code)
    spans: list[list[int]] = []
    for code in sorted(unstable):
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    inside = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
    return re.compile(f"[{inside}]"), forms


def _look_alikes(word: str) -> str:
    """``word`` in Latin letters, unless it holds letters of the other script that Latin lacks."""
    if not any(c in LOOK_ALIKE for c in word):
        return word
    foreign = [c for c in word if c.isalpha() and not c.isascii() and not unicodedata.name(c, "").startswith("LATIN")]
    latin = any(c.isalpha() and unicodedata.name(c, "").startswith("LATIN") for c in word)
    if not latin and any(c not in LOOK_ALIKE for c in foreign):
        return word
    return "".join(LOOK_ALIKE.get(c, c) for c in word)


def _segment(piece: str, forms: dict[int, str]) -> str:
    """The canonical form of one unstable segment (whole words with what joins them)."""
    out = []
    for i, char in enumerate(piece):
        if char == JOINER and i and (unicodedata.category(piece[i - 1]) == "So" or piece[i - 1] in PICTURE_MARKS):
            out.append(char)  # joins pictures into one
        else:
            out.append(forms.get(ord(char), char))
    words = WORDS.split("".join(out))
    return unicodedata.normalize("NFC", "".join(_look_alikes(w) for w in words))


def canonical(text: str | None) -> str | None:
    """The one form of all texts that look like ``text``; null stays null, '' stays ''.

    The kind of blanks, the width of letters, marks without width and the
    composition of accents don't count; raised, lowered and circled characters,
    accents, letter case and the number of blanks do.
    """
    if text is None or text.isascii() and not ("\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text):
        return text
    unstable, forms = _tables()
    text = text.replace("\r\n", "\n")
    out, done = [], 0
    while found := unstable.search(text, done):
        start = found.start()
        while start > done and (text[start - 1].isalnum() or unicodedata.combining(text[start - 1])):
            start -= 1
        if start == found.start() and start > done:
            start -= 1  # what a combining mark may join
        end = found.end()
        while end < len(text) and (text[end].isalnum() or unstable.match(text[end])):
            end += 1
        out += [text[done:start], _segment(text[start:end], forms)]
        done = end
    return "".join([*out, text[done:]])


@F.pandas_udf(T.StringType())
def _canonical(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(canonical, na_action="ignore").astype(object).where(batch.notna(), None)


def _stable(text: Column) -> Column:
    """Whether a text is null, or ASCII without tabs and other line ends, and so its own form."""
    return text.isNull() | text.rlike(r"^[\x0a\x20-\x7e]*$")


def canonical_text(text: Column) -> Column:
    """The canonical form of a text column.

    Texts that are ASCII without tabs and other line ends are left to the JVM.
    Python is run for every row whatever the condition, so that it is given
    null in place of them.
    """
    return F.when(_stable(text), text).otherwise(_canonical(F.when(~_stable(text), text)))


def with_canonical(df: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """``df`` with the canonical form of one text column added as ``out``.

    Null gives null and the empty text gives the empty text; every row and all
    other columns stay.  A column that already has the name ``out`` is replaced.
    """
    return df.withColumn(out, canonical_text(F.col(text)))


def same_look_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All pairs of rows whose different texts look the same: (``key``_a, ``key``_b), a < b.

    Null takes no part.  Rows are compared by hashes of 128 bits.  A class of
    equal looks that holds one string only, however many rows, yields no pair
    and leaves before any join; what remains is joined class by class.
    """
    marked = df.select(F.col(key).alias("_id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    formed = marked.select("_id", F.unhex(F.md5("_text")).alias("_own"), _stable(F.col("_text")).alias("_stable"), _canonical(F.when(~_stable(F.col("_text")), F.col("_text"))).alias("_form"))
    marked = cut(formed.select("_id", "_own", F.when(F.col("_stable"), F.col("_own")).otherwise(F.unhex(F.md5("_form"))).alias("_look")))
    looks = marked.groupBy("_look").agg(F.min("_own").alias("_low"), F.max("_own").alias("_high")).where("_low < _high")
    rows = marked.join(looks.select("_look"), "_look")
    a = rows.select("_look", F.col("_id").alias(f"{key}_a"), F.col("_own").alias("_own_a"))
    b = rows.select("_look", F.col("_id").alias(f"{key}_b"), F.col("_own").alias("_own_b"))
    pairs = a.join(b, "_look").where((F.col(f"{key}_a") < F.col(f"{key}_b")) & (F.col("_own_a") != F.col("_own_b")))
    return pairs.select(f"{key}_a", f"{key}_b")
