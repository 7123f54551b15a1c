"""Reading of typed names: tokens, parts, and when two readings may mean the same.

Small helpers of the operator in ``variants``; they look at one or two names.
"""

from __future__ import annotations

import re
import unicodedata

# Ordinals, Roman numerals, titles, and words that don't tell names apart.
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10, "eleventh": 11, "twelfth": 12}
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12}
TITLES = {"dr", "prof", "mr", "mrs", "ms", "mx", "sir", "phd", "jr", "sr", "doctor", "professor"}
FILLERS = {"the", "of", "on", "for", "and"}

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|\d+(?:st|nd|rd|th)?|&")
_JOINED = re.compile(r"(?<=[a-zà-ÿ])(?=[A-Z][a-z])")


def tokens(name: str) -> list[str]:
    """Lower-case words and numbers of a name without accents, as they stand; joined words are parted at capitals."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", _JOINED.sub(" ", name)) if not unicodedata.combining(c))
    found = [t.replace("'", "") for t in _TOKEN.findall(bare.lower().replace("’", "'"))]
    out = []
    for t in found:
        number = re.match(r"\d+", t)
        out.append(str(int(number[0])) if number else "and" if t == "&" else t)
    return out


def details(words: list[str]) -> list[str]:
    """Words that describe a name besides its core: numbers in figures, fillers left out."""
    out = []
    for w, after in zip(words, [*words[1:], ""], strict=True):
        if w in ("no", "nr", "number") and after.isdigit():
            continue
        if w in ORDINALS:
            w = str(ORDINALS[w])
        elif w in ROMAN and len(words) > 1:
            w = str(ROMAN[w])
        if w not in FILLERS:
            out.append(w)
    return out


def distance(a: str, b: str) -> int:
    """Edit distance in which a swap of neighbours is one step: the unrestricted Damerau-Levenshtein metric."""
    last: dict[str, int] = {}
    most = len(a) + len(b)
    d = [[most] * (len(b) + 2), [most, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        d.append([most, i] + [0] * len(b))
        match = 0
        for j, y in enumerate(b, 1):
            k, l = last.get(y, 0), match
            if x == y:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][l] + (i - k - 1) + 1 + (j - l - 1))
        last[x] = i
    return d[-1][-1]


def near(a: str, b: str) -> bool:
    """Whether the metric is at most 1, without computing it."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def shortens(short: str, word: str) -> bool:
    """Whether ``short`` abbreviates ``word``: same first letter, its letters in order, and clearly shorter."""
    if not short or not word or short[0] != word[0] or len(short) >= len(word) or short.isdigit() or word.isdigit():
        return False
    rest = iter(word)
    return all(c in rest for c in (short[:-1] if len(short) > 3 and short[-1] == "s" else short))


def same_word(a: str, b: str) -> bool:
    """Equal, one slip apart (longer words), or one the abbreviation of the other."""
    if a == b:
        return True
    if a.isdigit() or b.isdigit():
        return False
    if min(len(a), len(b)) >= 5 and near(a, b):
        return True
    return shortens(a, b) or shortens(b, a)


def same_details(a: list[str], b: list[str]) -> bool:
    """Whether two lists of describing words agree one by one, in any order, or one is the other's initials."""
    if len(a) == len(b):
        left = list(b)
        for w in sorted(a, key=len, reverse=True):
            match = next((x for x in left if x == w), None) or next((x for x in left if same_word(w, x)), None)
            if match is None:
                return False
            left.remove(match)
        return True
    short, long = (a, b) if len(a) < len(b) else (b, a)
    initials = [w[0] for w in long if not w.isdigit()]
    return len(short) == 1 and len(long) > 1 and len(short[0]) == len(initials) and sorted(short[0]) == sorted(initials)
