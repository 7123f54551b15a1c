"""Problem 1: lines that belong to a site and not to its documents.

Lines are brought to a plain form, in which dates and counts are all alike, and
cut into pieces at content-defined places: wherever a rolling hash over the
last characters says so.  Pieces are counted by source over the documents that
hold them.  Pieces repeated excessively point to the lines they stand in;
leaders are chosen among those lines, every suspicious line is held against the
leaders of its source, and the lines whose leader recurs in enough documents
are the site's own.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

#: A line is furniture from this share and number of the documents of its source on.
SHARE, LEAST = 0.1, 5
#: Part of the share that is asked of what was matched, as some slips go unmatched.
TOLERANCE = 0.8
#: Part of the share and least number of documents that make a piece frequent, or a line a leader.
PIECE_PART, PIECE_LEAST = 0.4, 3
LEADER_PART, LEADER_LEAST = 0.15, 2
#: Documents of one source that one task looks at together, and characters of theirs.
BATCH, BATCH_CHARACTERS = 1500, 8_000_000
#: Share of a line that frequent pieces cover if it may be furniture; characters of a short line, of which one such piece is enough.
COVERED, SHORT = 0.3, 40
#: Characters of the rolling window; one place in MEAN, a power of 2, is a cut.
WINDOW, MEAN = 4, 8
#: Characters that a line may vary in whatever its length; more if its fixed words are as many.
VARYING = 40
#: Lines in the order of names that a line is held against for what both share.
BESIDE = 40
#: Documents that are cut into pieces at a time, so that the arrays stay near the processor.
AT_ONCE = 100
#: Characters that are looked at together, however long lines are; few, for the same reason.
CHARACTERS = 200_000

LINE, DOCUMENT = "\n", "\x1e"
ALL = np.iinfo(np.int64).min
# Months, days of the week, and counts written as words.
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
_DAYS = "mon tue wed thu fri sat sun"
_COUNTS = "no one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand"


def _words(words: str, behind: str) -> str:
    """Any of ``words``, then ``behind``, as branches by first letter."""
    by_letter = groupby(sorted(words.split()), key=lambda w: w[0])
    return "|".join(f"{c}(?:{'|'.join(sorted((w[1:] for w in own), key=lambda w: (-len(w), w)))}){behind}" for c, own in by_letter)


_NUMBERED = r"0(?:[-/.]0[-/.]0|(?:st|nd|rd|th)? (?:" + _MONTHS.replace(" ", "|") + r")[a-z]*\.?,? 0)\b"
_NAMED = r"[a-z]*\.? 0(?:st|nd|rd|th)?,? 0\b"
_FIGURES = re.compile(r"\d[\d.,:]*(?:k?\b|(?=(?:st|nd|rd|th)\b))")
# dates and counts in words follow what is no part of a word, so that only such places are looked at
_DATE = re.compile(rf"([^a-z0-9_])(?:{_NUMBERED}|{_words(_MONTHS, _NAMED)}|" + _words(_DAYS, rf"[a-z]*,? (?:{_NUMBERED}|(?:{_MONTHS.replace(' ', '|')}){_NAMED})") + ")")
_COUNT = re.compile(rf"([^a-z0-9_])(?:{_words(_COUNTS, '')})\b")
_TAG = re.compile(r"</?[a-z][^<>\n]{0,80}>")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z]\w{1,30});")
_BLANKS = re.compile(r"  +")
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in "\n "]
# Words that mark a line as naming its author, who is then no variable part, where
# they stand next to the name: before it (but for a shared first name), or in the role behind it.
_AUTHOR = r"(?:by|words|text|pictures?|photos?|author|writer|editor|correspondent|reporter|desk|staff)"
_BEFORE = re.compile(rf"\b{_AUTHOR}\b\W+(?:\w+\W+){{0,2}}$")
_BEHIND = re.compile(rf"^(?:\s*\w+)?\s*[^\w\s]\W*(?:\w+\W+){{0,2}}?{_AUTHOR}\b")

_BY_INSIDE = re.compile(rf"^\W*(?:\w+\W+)?{_AUTHOR}\b|\W\s*(?:\w+\W+){{0,2}}{_AUTHOR}\W*$")


def plain(texts: list[str | None]) -> list[list[str]]:
    """The lines of each text in plain form, as many and in the same order as between its line feeds."""
    lines = [(t or "").replace(DOCUMENT, " ").lower().split(LINE) for t in texts]
    flat = [line for own in lines for line in own]
    wide = [i for i, line in enumerate(flat) if not line.isascii()]
    if wide:
        for i, line in zip(wide, unicodedata.normalize("NFKC", LINE.join(flat[i] for i in wide)).lower().split(LINE), strict=True):
            flat[i] = line
    flat = _even(LINE.join(flat)).split(LINE)
    these = [i for i, line in enumerate(flat) if line.count("0") > 1]  # every date has two figures
    for i, line in zip(these, _evened(_DATE, [flat[i] for i in these]), strict=False):
        flat[i] = line
    done = iter(_evened(_COUNT, flat))
    return [[_trimmed(next(done)) for _ in own] for own in lines]


def _evened(pattern: re.Pattern, lines: list[str]) -> list[str]:
    """``lines`` with 0 for what a ``pattern`` finds; letters beyond ASCII come up as what goes before, but no word begins after one."""
    return pattern.sub(lambda m: m[0] if m[1].isalnum() else m[1] + "0", LINE + LINE.join(lines))[1:].split(LINE)


def _even(short: str) -> str:
    """Lines without markup, with single blanks, and with figures all alike."""
    if "<" in short:
        short = _TAG.sub("", short)
    if "&" in short:
        short = _ENTITY.sub(lambda m: html.unescape(m[0]).replace(LINE, " ").replace(DOCUMENT, " "), short)
    for space in _SPACES:
        short = short.replace(space, " ")
    return _FIGURES.sub("0", _BLANKS.sub(" ", short))


def _trimmed(line: str) -> str:
    """``line`` without anything but letters and figures at its ends."""
    start, end = 0, len(line)
    while start < end and not line[start].isalnum():
        start += 1
    while end > start and not line[end - 1].isalnum():
        end -= 1
    return line[start:end]


_U = np.uint64
_MIX, _BASE = 0x9E3779B97F4A7C15, 0x5851F42D4C957F2D
_UNBASE = pow(_BASE, -1, 2**64)
_WINDOW_KEYS = [_U(0xD6E8FEB86659FD93), _U(0xA5A3564B2D4C5B97), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)]


def _powers(base: int, many: int) -> np.ndarray:
    return np.multiply.accumulate(np.append(_U(1), np.full(many, base, _U)))


def pieces(joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, line counted over all documents, start, end, hash) of each content-defined piece of ``plain`` text.

    The cuts depend on the last characters only, so that equal wording is cut
    alike wherever it stands.  Results are by line, so a line's end is a cut too.
    """
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends_doc, ends_line = codes == ord(DOCUMENT), codes == ord(LINE)
    stop = ends_doc | ends_line
    place = np.arange(len(codes))
    last_stop = np.maximum.accumulate(np.where(stop, place, -1))
    column = place - np.append(-1, last_stop[:-1])[: len(place)] - 1
    mixed = codes.astype(_U) * _U(_MIX)
    mixed ^= mixed >> _U(29)
    rolling = mixed * _WINDOW_KEYS[0]
    for back in range(1, WINDOW):
        rolling[back:] += np.where(column[back:] >= back, mixed[:-back], _U(0)) * _WINDOW_KEYS[back]
    rolling ^= rolling >> _U(32)
    rolling *= _U(_MIX)
    is_end = ((rolling >> _U(40)) & _U(MEAN - 1)) == 0
    is_end[:-1] |= stop[1:]
    end = np.flatnonzero(is_end & ~stop)
    start = np.maximum(np.append(0, end[:-1] + 1)[: len(end)], last_stop[end] + 1)
    longest = int(column.max(initial=0)) + 1
    sums = np.append(_U(0), np.cumsum(mixed * _powers(_BASE, longest)[column]))
    hashes = (sums[end + 1] - sums[start]) * _powers(_UNBASE, longest)[column[start]]
    hashes ^= hashes >> _U(31)
    hashes *= _U(_MIX)
    hashes ^= hashes >> _U(29)
    document = np.append(0, np.cumsum(ends_doc))[end]
    line = np.append(0, np.cumsum(stop))[end]
    return document, line, start, end + 1, hashes


def _of_source(hashes: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Hashes of pieces as those of pieces in a source."""
    out = (hashes ^ (source.astype(np.int64).view(_U) * _U(_BASE))) * _U(_MIX)
    return (out ^ (out >> _U(32))).view(np.int64)


def _count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, piece, documents) as counted within one task; the piece ALL counts a source's characters."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        both = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
        code, piece = pd.factorize(both[0])
        of = np.zeros(len(piece), np.int64)
        of[code] = both[1]
        return pa.RecordBatch.from_pydict({"piece": piece.astype(np.int64), "source": of, "documents": np.bincount(code, minlength=len(piece)).astype(np.int64)})

    for batch in batches:
        source = batch.column("source").to_numpy(zero_copy_only=False)
        every = batch.column("text").to_pylist()
        for start in range(0, len(every), AT_ONCE):
            texts = plain(every[start : start + AT_ONCE])
            document, _, _, _, hashes = pieces("".join(LINE.join(own) + DOCUMENT for own in texts))
            first = np.flatnonzero(~pd.Series(_of_source(hashes, document)).duplicated().to_numpy())  # a piece counts once a document
            of = source[start + document[first]]
            held.append(np.stack([_of_source(hashes[first], of), of]))
            size += len(first)
        code, own = pd.factorize(source)
        characters = np.bincount(code, weights=[len(t) for t in every]).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"piece": np.full(len(own), ALL), "source": own.astype(np.int64), "documents": characters})
        if size > 2_000_000:
            yield flush()
            held, size = [], 0
    yield flush()


def _suspicious(rows: pd.DataFrame, frequent: np.ndarray) -> pd.DataFrame:
    """Lines that may be furniture: (id, line_no, words, form, gaps), where form tells the frequent pieces in a row, and gaps whether there are others."""
    block = rows["text"].str.len().cumsum().to_numpy() // CHARACTERS
    return pd.concat([_suspicious_of(own, frequent) for _, own in rows.groupby(block)], ignore_index=True)


def _suspicious_of(rows: pd.DataFrame, frequent: np.ndarray) -> pd.DataFrame:
    rows = rows if len(frequent) else rows.iloc[:0]  # without frequent pieces no line is covered
    texts = plain(rows["text"].tolist())
    filled = [[(i, line) for i, line in enumerate(own) if line] for own in texts]
    lines = [line for own in filled for _, line in own]
    of_doc = np.repeat(np.arange(len(texts)), [len(own) for own in filled])
    line_no = np.fromiter((i for own in filled for i, _ in own), np.int32, len(lines))
    joined = LINE.join([*lines, ""])
    _, line, start, end, hashes = pieces(joined)
    known = pd.Series(_of_source(hashes, rows["source"].to_numpy()[of_doc[line]])).isin(frequent).to_numpy()
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    covered = np.bincount(line, weights=(end - start) * known, minlength=len(lines))
    # a line is looked at if frequent pieces cover enough of it; a slip leaves little else of a short one
    want = (covered >= COVERED * lengths) | ((covered > 0) & (lengths <= SHORT))
    chosen = np.flatnonzero(want)
    form, gaps = _forms(line, known, hashes, len(lines))
    return pd.DataFrame(
        {
            "id": rows["id"].to_numpy()[of_doc[chosen]],
            "line_no": line_no[chosen],
            "words": pd.Series([lines[i] for i in chosen], dtype=object),
            "form": form[chosen],
            "gaps": gaps[chosen],
        }
    )


def _forms(line: np.ndarray, known: np.ndarray, hashes: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``many`` lines a hash of its frequent pieces in a row, in which others stand as one gap, and whether there is a gap."""
    form, gaps = np.zeros(many, _U), np.bincount(line[~known], minlength=many) > 0
    again = np.append(False, ~known[1:] & ~known[:-1] & (line[1:] == line[:-1]))  # a gap goes on
    line, parts = line[~again], np.where(known, hashes, _U(1))[~again]
    if len(line):
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        place = np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))
        parts = (parts ^ (parts >> _U(31))) * _U(_MIX) * _powers(_BASE, int(place.max()) + 1)[place]
        form[line[first]] = np.add.reduceat(parts, first)
    return form.view(np.int64), gaps


def _alike(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` characters were put in, left out, changed or swapped."""
    if abs(len(a) - len(b)) > most:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    a, b = a[low:], b[low:]
    tail, high = 0, min(len(a), len(b))
    while tail < high and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if max(len(a), len(b)) <= most:
        return True
    reach: dict[int, int] = {}  # by how far b is ahead, the furthest place in a
    for edits in range(most + 1):
        before, reach = reach, {}
        for ahead in range(-edits, edits + 1):
            i = max(before.get(ahead, -2) + 1, before.get(ahead - 1, -1), before.get(ahead + 1, -2) + 1) if edits else 0
            i = min(i, len(a), len(b) - ahead)
            if i < 0 or i + ahead < 0:
                continue
            while i < len(a) and i + ahead < len(b) and a[i] == b[i + ahead]:
                i += 1
            if i == len(a) and i + ahead == len(b):
                return True
            reach[ahead] = i
    return False


def _slips(length: int) -> int:
    return 1 if length < 8 else 2 if length < 40 else max(3, length // 50)


def _parted(text: str, many: int) -> list[str]:
    """``text`` in ``many`` parts; one empty part, which every line holds, if it is too short."""
    ends = [len(text) * i // many for i in range(many + 1)]
    return [text[a:b] for a, b in zip(ends, ends[1:], strict=False)] if len(text) >= 2 * many else [""]


class Leader:
    """A line that others are held against: fixed words, or fixed words around a part that varies."""

    def __init__(self, head: str, tail: str | None = None):
        self.head, self.tail = head, tail
        self.varying = max(VARYING, len(head) + len(tail or ""))
        # of so many parts of the fixed words the slips that are let pass leave one as it is, a swap touching two
        part, slips = (0.45, _slips(len(head))) if tail is None else (0.7, 2 if len(head) > 12 else 1)
        self.parts = _parted(head, 2 * slips + 1) + _parted(head[: max(6, int(part * len(head)))], 3)

    def matches(self, line: str) -> bool:
        head, tail = self.head, self.tail
        if not any(part in line for part in self.parts):
            return False
        if tail is None:
            if _alike(line, head, _slips(len(head))):
                return True
            return len(line) < len(head) and len(line) >= max(6, 0.45 * len(head)) and _alike(line, head[: len(line)], 1)
        if len(line) <= len(head):
            return len(line) >= max(6, 0.7 * len(head)) and _alike(line, head[: len(line)], 1)
        for off in (0, -1, 1):
            if not _alike(line[: len(head) + off], head, 2 if len(head) > 12 else 1):
                continue
            rest = line[len(head) + off :]
            if not tail:
                return len(rest) <= self.varying
            for back in (0, 1, -1):
                at = len(rest) - len(tail) + back
                if at > 0 and at <= self.varying and _alike(rest[at:], tail, 2):
                    return True
            if len(rest) <= self.varying:
                return True  # cut short within the varying part
            for known in range(3, len(tail)):  # or within the tail
                if len(rest) - known <= self.varying and rest.endswith(tail[:known]):
                    return True
        return False


class Leaders:
    """The leaders of one source, found by the words they hold."""

    def __init__(self, leaders: list[Leader]):
        self.leaders, self.exact, self.by_word, self.least = leaders, {}, defaultdict(list), []
        for i, leader in enumerate(leaders):
            if leader.tail is None:
                self.exact.setdefault(leader.head, i)
            for word in set(f"{leader.head} {leader.tail or ''}".split()):
                self.by_word[word].append(i)
            # a slip changes two words at most; the head of a varying leader may be off by one character more
            slips = _slips(len(leader.head)) if leader.tail is None else 3
            self.least.append(len(set(leader.head.split())) - 2 * slips)
        self.always = [i for i, least in enumerate(self.least) if least <= 0]
        self.seen: dict[str, int] = {}

    def find(self, line: str) -> int:
        """The number of the leader that ``line`` follows, or -1: of those that match the one that shares most words, the first of several.

        Only leaders that share fewer words than any match must are passed over.
        """
        if (at := self.exact.get(line)) is not None:
            return at
        if (at := self.seen.get(line)) is not None:
            return at
        words = set(line.split())
        votes = Counter(i for word in words for i in self.by_word.get(word, ()))
        short = len(words) - 3  # words that a line cut short has in common: all but the last and those of one slip
        if short <= 0:
            tried = list(range(len(self.leaders)))
        else:
            tried = {i for i, many in votes.items() if many >= min(self.least[i], short)}.union(self.always)
        at = next((i for i in sorted(tried, key=lambda i: (-votes[i], i)) if self.leaders[i].matches(line)), -1)
        self.seen[line] = at
        return at


def _frame(a: str, b: str) -> tuple[str, str]:
    """The whole words at the start and at the end that two lines share."""
    most = min(len(a), len(b))
    n = next((i for i in range(most) if a[i] != b[i]), most)
    m = next((i for i in range(most - n) if a[-1 - i] != b[-1 - i]), most - n)
    return re.sub(r"\w+$", "", a[:n]), re.sub(r"^\w+", "", a[len(a) - m :])


def _byline(head: str, tail: str, site: str) -> bool:
    """Whether the part between ``head`` and ``tail`` is an author's name; the name of the ``site`` may hold any word."""
    words = re.findall(r"[^\W_]+", site.lower().rpartition(".")[0] or site.lower())
    if words and not all(re.fullmatch(_AUTHOR, word) for word in words):
        own = re.compile(r"\b" + r"[\W_]+".join(words) + r"\b")
        head, tail = own.sub("", head), own.sub("", tail)
    return bool(_BEFORE.search(head) or _BEHIND.search(tail))


def _varying(lines: dict[str, int], site: str) -> list[Leader]:
    """Leaders with a part that varies, from ``lines`` of a ``site`` that begin alike and the documents that each stands for."""
    frames: Counter[tuple[str, str]] = Counter()
    these, by_name = sorted(lines, key=lambda x: (-lines[x], x)), sorted(lines)
    for i, a in enumerate(by_name):
        for b in by_name[i + 1 : i + 1 + BESIDE]:  # lines with one head lie together
            if not _alike(a, b, 3):
                frames[_frame(a, b)] += lines[a] + lines[b]
    found: list[Leader] = []
    for (head, tail), _ in sorted(frames.items(), key=lambda x: (-x[1], x[0])):
        own = [x for x in these if x.startswith(head) and x.endswith(tail) and len(x) > len(head) + len(tail)]
        if own and _sound(head, tail, sorted(map(len, own))[len(own) // 2], site) and not any(x.matches(own[0]) for x in found):
            found.append(Leader(head, tail))
    return found


def _sound(head: str, tail: str, typical: float, site: str) -> bool:
    """Whether lines of ``typical`` length are told by ``head`` and ``tail``, and no author's name stands between them."""
    return len(head) >= 8 and len(head) + len(tail) >= max(12, 0.5 * typical) and not _byline(head, tail, site)


def _framed(form: object) -> Leader | None:
    """The leader with the words that all lines of a form with gaps share, if any; it depends on no examples.

    What all lines share at the start is what the first and the last in order share, and from behind likewise.
    """
    head, tail = _frame(form.low, form.high)[0], _frame(form.back_low[::-1], form.back_high[::-1])[1]
    slips = 2 * _slips(int(form.typical))
    if _alike(form.low, form.high, slips) and _alike(form.back_low, form.back_high, slips):
        return None  # one line with slips
    if len(head) + len(tail) >= form.shortest or not _sound(head, tail, form.typical, form.site):
        return None
    parts = [x[len(head) : len(x) - len(tail)] for x in form.lines]  # a slip in a byline hides its word from the frame
    named = sum(_BY_INSIDE.search(x) is not None for x in parts)
    return Leader(head, tail) if 2 * named < len(parts) else None


def _lead(forms: pd.DataFrame) -> pd.DataFrame:
    """The leaders of one source, from its frequent forms with a few example lines each."""
    forms = forms.sort_values(["documents", "low", "form"], ascending=[False, True, True])
    openings: dict[str, dict[str, int]] = defaultdict(dict)
    for row in forms.itertuples():
        for line in row.lines:
            openings[" ".join(line.split()[:2])].setdefault(line, row.documents)
    leaders = [x for opening in sorted(openings) for x in _varying(openings[opening], forms["site"].iloc[0])]
    whole = (~forms["gaps"]).tolist()
    rows = list(forms.itertuples())
    for row in (x for x, w in zip(rows, whole, strict=True) if w):
        leaders += [Leader(x) for x in row.lines if len(x) > 3 and not any(y.matches(x) for y in leaders)]
    gaps = [x for x, w in zip(rows, whole, strict=True) if not w]
    for row in gaps:
        ends = [row.low, row.high, row.back_low[::-1], row.back_high[::-1], *row.lines]
        if all(any(x.matches(line) for x in leaders) for line in ends) or not (framed := _framed(row)):
            continue
        # single lines that the frame holds count with it
        leaders = [x for x in leaders if x.tail is not None or not framed.matches(x.head)] + [framed]
    for row in gaps:
        leaders += [Leader(x) for x in row.lines[:1] if len(x) > 3 and not any(y.matches(x) for y in leaders)]
    heads, tails = (pd.Series(own, dtype=object) for own in ([x.head for x in leaders], [x.tail for x in leaders]))
    return pd.DataFrame({"source": forms["source"].iloc[0], "leader": np.arange(len(leaders)), "head": heads, "tail": tails})


def repeated_lines(df: DataFrame, key: str, source: str, text: str, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(``key``, line_no): the lines that a source repeats, but for slips and small variable parts.

    ``line_no`` counts from 0 between line feeds.  A line counts if lines like
    it stand in at least ``share`` and at least ``least`` of the rows of its
    source; lines that name an author count for each author alone.  Rows with
    null or empty text count as rows of their source but have no line; blank
    lines are never furniture; rows of a null source are left out.  ``key`` must
    be unique.  Repeated texts count as often as they come.
    """
    docs = df.select(F.col(key).alias("id"), F.xxhash64(source).alias("source"), F.col(source).alias("site"), F.col(text).alias("text")).where(F.col(source).isNotNull())
    counts = docs.groupBy("source").agg(F.count("*").alias("rows"), F.min("site").alias("site")).where(F.col("rows") >= least)
    docs = docs.drop("site").where(F.length("text") > 0)
    counted = docs.select("source", "text").mapInArrow(_count_pieces, "piece long, source long, documents long")
    bound = lambda part, low: F.greatest(F.lit(low), F.ceil(F.col("rows") * share * part))
    many = counted.groupBy("piece", "source").agg(F.sum("documents").alias("documents")).where((F.col("documents") >= PIECE_LEAST) | (F.col("piece") == ALL))
    often = cut(many.join(counts, "source").where((F.col("piece") == ALL) | (F.col("documents") >= bound(PIECE_PART, PIECE_LEAST))))
    batches = F.ceil(F.greatest(F.col("rows") / BATCH, F.col("documents") / BATCH_CHARACTERS)).cast("int")
    sizes = cut(often.where(F.col("piece") == ALL).select("source", "rows", "site", batches.alias("batches")))
    often = often.where(F.col("piece") != ALL).select("source", "piece").join(sizes.select("source", "batches"), "source")

    def each_batch(frame: DataFrame) -> DataFrame:
        return frame.withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)))

    def own_batch(frame: DataFrame) -> DataFrame:
        return frame.withColumn("batch", F.pmod(F.xxhash64("id"), F.col("batches")).cast("int"))

    def look(keys: tuple, rows: pd.DataFrame, frequent: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"source": [], "id": [], "line_no": [], "words": pd.Series([], dtype=object), "form": [], "gaps": []})
        return _suspicious(rows, frequent["piece"].to_numpy()).assign(source=keys[0])

    rows = own_batch(docs.join(sizes, "source")).select("source", "batch", "id", "text")
    kind = df.schema[key].dataType.simpleString()
    frequent = each_batch(often).select("source", "batch", "piece")
    suspicious = cut(
        rows.groupBy("source", "batch").cogroup(frequent.groupBy("source", "batch")).applyInPandas(look, f"source long, id {kind}, line_no int, words string, form long, gaps boolean")
    )

    examples = F.array_distinct(F.array(*(F.min_by("words", F.xxhash64("words", F.lit(i))) for i in range(6))))
    back = F.reverse("words")
    frame = [F.min("words").alias("low"), F.max("words").alias("high"), F.min(back).alias("back_low"), F.max(back).alias("back_high"), F.min(F.length("words")).alias("shortest"), F.avg(F.length("words")).alias("typical")]
    # frequent forms first, as most forms stand in one line, and what is said of a form's lines is long
    common = suspicious.groupBy("source", "form").agg(F.count("*").alias("documents")).where(F.col("documents") >= LEADER_LEAST)
    common = common.join(sizes, "source").where(F.col("documents") >= bound(LEADER_PART, LEADER_LEAST)).select("source", "form", "site")
    forms = suspicious.join(common, ["source", "form"]).groupBy("source", "form", "gaps", "site").agg(F.count("*").alias("documents"), examples.alias("lines"), *frame)
    tasks = 3 * df.sparkSession.sparkContext.defaultParallelism  # few bytes, much work
    leaders = cut(forms.repartition(tasks, "source").groupBy("source").applyInPandas(_lead, "source long, leader int, head string, tail string"))

    def follow(keys: tuple, lines: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("leader")
        found = Leaders([Leader(h, None if t is None else t) for h, t in zip(own["head"], own["tail"], strict=True)])
        lines = lines.assign(leader=[found.find(x) for x in lines["words"]])
        return lines.loc[lines["leader"] >= 0, ["source", "id", "line_no", "leader"]]

    lines = own_batch(suspicious.join(sizes, "source")).select("source", "batch", "id", "line_no", "words")
    led = each_batch(leaders.join(sizes, "source")).select("source", "batch", "leader", "head", "tail")
    led = lines.groupBy("source", "batch").cogroup(led.groupBy("source", "batch")).applyInPandas(follow, f"source long, id {kind}, line_no int, leader int")
    led = cut(led)
    spread = led.groupBy("source", "leader", "id").count().groupBy("source", "leader").agg(F.count("*").alias("documents"))
    spread = spread.join(sizes, "source").where((F.col("documents") >= least) & (F.col("documents") >= F.col("rows") * share * TOLERANCE))
    return led.join(spread.select("source", "leader"), ["source", "leader"]).select(F.col("id").alias(key), "line_no")


def without_lines(df: DataFrame, lines: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with the given (``key``, line_no) cut from its text; every row and all other lines stay.

    A text all of whose lines are cut becomes empty; null stays null.
    """
    marked = lines.groupBy(key).agg(F.collect_set("line_no").alias("_cut"))
    joined = df.join(marked, key, "left")
    parts = F.transform(F.split(F.col(text), LINE), lambda line, i: F.struct(i.cast("int").alias("i"), line.alias("line")))
    left = F.filter(parts, lambda x: ~F.array_contains("_cut", x["i"]))
    kept = F.array_join(F.transform(left, lambda x: x["line"]), LINE)
    return joined.withColumn(text, F.when(F.col("_cut").isNull(), F.col(text)).otherwise(kept)).drop("_cut")
