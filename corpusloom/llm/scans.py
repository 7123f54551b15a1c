"""Problem 4: text of scanned pages as continuous paragraphs of proper words.

Over all pages, the lines at the edges tell which sources are scanned, what
their running titles are and how printed page numbers go with the pages; pairs
of words that stand near each other give skip-gram vectors, of the vocabulary
and of the rare words of scanned pages.  A rare word is linked to its frequent
neighbours that glyph edits of a scanner lead to, each with the likeness of
their vectors.  On a page, the linked word is taken that also goes best with
the words around it; then furniture is left out and lines run on.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import skipgram
from corpusloom.session import cut

#: Words on either side that are context; most words of a vocabulary, whose list and vectors are sent to all tasks.
WINDOW, VOCABULARY = 4, 1_000_000
#: Sources whose titles are sent to all tasks at most; tasks that one source is spread over beyond that.
SOURCES, SALT = 200_000, 32
#: What speaks for a word: its vector beside those around it, its frequency, its likeness to what was read; against it, glyph edits.
AROUND, OFTEN, LIKE, EDIT = 1.0, 0.3, 1.0, 2.5
#: Lines from either edge of a page where furniture stands.
EDGE = 2
#: Share and least number of a source's pages that bear a page number for it to count as scanned, or one title.
NUMBERED_SHARE, NUMBERED_LEAST = 0.4, 3
TITLE_SHARE, TITLE_LEAST = 0.08, 3
#: A word that occurs so often where nothing was scanned is a word of its own, not a misread one; so is one of this share.
OWN_LEAST, OWN_SHARE = 3, 1e-6
#: Glyph edits at most in one word, and as a share of its letters.
EDITS, EDIT_SHARE = 5, 0.6

# How scanners misread, as (printed, read).
GLYPHS = [
    ("m", "rn"), ("m", "nn"), ("m", "in"), ("m", "ni"), ("rn", "m"), ("n", "ri"), ("n", "rl"), ("n", "r1"), ("n", "ii"), ("ri", "n"), ("u", "ii"), ("u", "li"), ("u", "il"), ("u", "v"), ("ii", "u"),
    ("w", "vv"), ("vv", "w"), ("d", "cl"), ("cl", "d"), ("h", "li"), ("li", "h"), ("h", "b"), ("b", "h"), ("h", "lı"), ("b", "8"), ("b", "6"), ("e", "c"), ("c", "e"), ("o", "c"), ("c", "o"), ("e", "o"),
    ("a", "o"), ("o", "a"), ("a", "0"), ("o", "0"), ("l", "1"), ("l", "i"), ("l", "I"), ("l", "|"), ("i", "l"), ("i", "1"), ("i", "j"), ("j", "i"), ("i", "I"), ("i", "!"), ("t", "l"), ("t", "f"), ("f", "t"), ("f", "l"),
    ("s", "5"), ("g", "9"), ("g", "q"), ("q", "g"), ("q", "9"), ("z", "2"), ("v", "y"), ("y", "v"), ("ü", "ii"), ("ü", "u"), ("ä", "a"), ("ö", "o"), ("ü", "ti"), ("ß", "b"), ("ß", "8"), ("ss", "ß"), ("k", "lc"), ("r", "i"), ("n", "u"), ("u", "n"), ("x", "k"), ("p", "n"),
    ("m", "rri"), ("rri", "m"), ("d", "c1"), ("d", "ci"), ("di", "ch"), ("h", "8"), ("h", "6"),
]
HYPHENS = "-" + chr(0x2010) + chr(0x2011) + chr(0xAC) + chr(0xAD)
_WORD = re.compile(rf"[^\W_]+(?:[{HYPHENS}][^\W_]+)*|[^\W_]*[|!][^\W_]+")
_TOKEN, _FIGURE = re.compile(r"[^\W_]+"), re.compile(r"\d")
_LAST = re.compile(rf"([^\W\d_][^\W_]*(?:-[^\W_]+)*|\d[^\W_]*)([{HYPHENS}]?)\s*$")
_FIRST = re.compile(r"\s*([^\W_]+(?:-[^\W_]+)*)")
_DIGIT = str.maketrans("lIiOoSsB", "11100558")
_NUMBER = re.compile(r"[\dlIiOoSsB]{1,5}")
_PAGE = re.compile(r"^\W*((?:page|pag|seite|p|s)\b\W*)?([\dlIiOoSsB]{1,5}|[ivxl]{1,6})\W*((?:of|0f|von|de|/)\W*[\dlIiOoSsB]{1,5})?\W*$", re.IGNORECASE)
_ROMAN = re.compile(r"(x{0,3})(ix|iv|v?i{0,3})", re.IGNORECASE)
_OF = re.compile(r"\b(?:page|pag|of|0f|von|seite)\b\W*", re.IGNORECASE)


def _as_number(token: str, sure: bool = False) -> int | None:
    """What a run of digits and look-alikes reads as; unless ``sure``, at least one must be a digit."""
    figures = token.translate(_DIGIT)
    return int(figures) if figures.isdecimal() and (sure or any(c.isdigit() for c in token)) else None


def _as_roman(token: str) -> int | None:
    """The value of a small Roman numeral."""
    m = _ROMAN.fullmatch(token)
    if not token or not m:
        return None
    ones = {"": 0, "i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9}
    return 10 * len(m[1]) + ones[m[2].lower()]


_FOLDS = [("rn", "m"), ("vv", "w"), ("0", "o"), ("1", "l"), ("i", "l"), ("5", "s"), ("8", "b"), ("rl", "n"), ("cl", "d"), ("ll", "u"), ("c", "e"), ("a", "o"), ("f", "t"), ("h", "b"), ("y", "v"), ("j", "l"), ("q", "g"), ("9", "g")]


def _title_key(line: str) -> str:
    """A line without page numbers, in letters that scanners don't confuse."""
    kept = _TOKEN.findall(line)
    if _FIGURE.search(line):
        kept = [t for t in kept if not (any(c.isdigit() for c in t) and _as_number(t) is not None)]
    key = " ".join(kept).lower()
    for read, fold in _FOLDS:
        key = key.replace(read, fold)
    return key


def _edges(lines: list[str]) -> list[int]:
    """The places of the first and last lines that aren't blank."""
    filled = [i for i, line in enumerate(lines) if line.strip()]
    return sorted({*filled[:EDGE], *filled[-EDGE:]})


def _numbers(line: str) -> set[int]:
    """The page numbers that an edge line may state."""
    if m := _PAGE.match(line):
        read = {_as_number(m[2], sure=bool(m[1] or m[3]) or len(m[2]) < 3), _as_roman(m[2])}
        return {n for n in read if n is not None}
    tokens = re.findall(r"[^\W_]+", line)
    return {n for t in tokens[:1] + tokens[-1:] if len(tokens) > 1 and any(c.isdigit() for c in t) and (n := _as_number(t)) is not None}


class Words:
    """A vocabulary as a tree of letters, searched for what a misread word may have been.

    The tree lies over the sorted words; a node is built when it is first entered.
    """

    def __init__(self, words: dict[str, str]):
        self.language = words
        self.sorted = sorted(words)
        self.index = {w: i for i, w in enumerate(self.sorted)}
        self.tree = _Node(0, len(self.sorted), 0)
        self.edits: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for printed, read in GLYPHS:
            self.edits[read[0]].append((read, printed))
        self.known: dict[str, dict[str, int]] = {}

    def printed(self, read: str) -> dict[str, int]:
        """Words that ``read`` may be a misreading of, each with the fewest glyph edits."""
        if (found := self.known.get(read)) is None:
            found = self._search(read)
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[read] = found
        return found

    def _search(self, read: str) -> dict[str, int]:
        most = min(EDITS, max(1, int(len(read) * EDIT_SHARE)))
        level: dict[tuple[int, int], tuple[_Node, int]] = {(0, id(self.tree)): (self.tree, 0)}
        found: dict[str, int] = {}
        while level:
            onward: dict[tuple[int, int], tuple[_Node, int]] = {}
            for (at, _), (node, cost) in level.items():
                if at == len(read):
                    if (word := node.word(self.sorted)) is not None:
                        found[word] = min(cost, found.get(word, cost))
                    continue
                steps = [(at + 1, read[at], cost)]
                if cost < most:
                    steps += [(at + len(r), p, cost + 1) for r, p in self.edits.get(read[at], ()) if read.startswith(r, at)]
                for then, letters, costs in steps:
                    child = node
                    for c in letters:
                        child = child.below(self.sorted).get(c)
                        if child is None:
                            break
                    if child is not None:
                        key = (then, id(child))
                        if key not in onward or onward[key][1] > costs:
                            onward[key] = (child, costs)
            level = onward
        return found


class _Node:
    """The sorted words from ``low`` to ``high``, which begin with the same ``depth`` letters."""

    __slots__ = ("children", "depth", "high", "low")

    def __init__(self, low: int, high: int, depth: int):
        self.low, self.high, self.depth, self.children = low, high, depth, None

    def word(self, words: list[str]) -> str | None:
        return words[self.low] if self.low < self.high and len(words[self.low]) == self.depth else None

    def below(self, words: list[str]) -> dict[str, _Node]:
        if self.children is None:
            self.children, at = {}, self.low + (self.word(words) is not None)
            while at < self.high:
                start = words[at][: self.depth + 1]
                end = bisect.bisect_right(words, start + chr(0x10FFFF), at, self.high)
                self.children[start[-1]] = _Node(at, end, self.depth + 1)
                at = end
        return self.children


def _body_tokens(text: str) -> list[str]:
    return [t.lower() for t in _WORD.findall(text)]


class Page:
    """What one page holds: furniture, broken words, misread words, and its repaired text."""

    def __init__(self, text: str, page: int | None, offset: int, titles: frozenset[str], words: Words, vectors: tuple[np.ndarray, np.ndarray, np.ndarray], links: dict[str, dict[str, tuple[int, float]]]):
        self.lines, self.words, self.vectors, self.links = text.split("\n"), words, vectors, links
        self.furniture = self._furniture(page, offset, titles)
        self.found: list[tuple[int, str, str]] = [(i, "furniture", "") for i in sorted(self.furniture)]
        self._read()

    def _furniture(self, page: int | None, offset: int, titles: frozenset[str]) -> set[int]:
        edges, heads, numbers = set(_edges(self.lines)), set(), {}
        longest = 3 * max(map(len, titles), default=0)
        for i, line in enumerate(self.lines):
            if 0 < len(line) <= longest and i not in heads:
                key = _title_key(line)
                if key in titles or (len(key) > 8 and any(abs(len(t) - len(key)) <= 2 and _close(key, t) for t in titles)):
                    heads.add(i)
            if page is not None and (m := _PAGE.match(line)) is not None:
                stated = _numbers(line)
                if page + offset in stated or page + offset + 1 in stated:  # a page may run on to the next one
                    numbers[i] = page + offset in stated, bool(m[1] or m[3])
        out = set(heads)
        for i, (own, named) in numbers.items():
            beside = any(j in heads for j in self._beside(i))
            if (own and i in edges) or named or beside:
                out.add(i)
        return out

    def _beside(self, i: int) -> list[int]:
        """The nearest lines above and below that aren't blank."""
        above = next((j for j in range(i - 1, -1, -1) if self.lines[j].strip()), None)
        below = next((j for j in range(i + 1, len(self.lines)) if self.lines[j].strip()), None)
        return [j for j in (above, below) if j is not None]

    def _read(self) -> None:
        """Walks over the lines of the body, token by token."""
        body = [i for i in range(len(self.lines)) if i not in self.furniture]
        tokens: list[list[tuple[str, int, int]]] = []  # by line of the body: word, start, end
        for i in body:
            tokens.append([(m[0], m.start(), m.end()) for m in _WORD.finditer(self.lines[i])])
        self.fixes: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
        self.joined: dict[int, str] = {}  # line: what its last word and the next line's first make
        broken = self._broken(body)
        flat = [(n, k) for n, line in enumerate(tokens) for k in range(len(line))]
        lower = [tokens[n][k][0].lower() for n, k in flat]
        index = self.words.index
        ids = [index.get(w, -1) for w in lower]
        for at, (n, k) in enumerate(flat):
            word, start, end = tokens[n][k]
            if ids[at] >= 0:
                continue
            i = body[n]
            first, last = k == 0 and n and body[n - 1] in broken, k == len(tokens[n]) - 1 and i in broken
            if first or last:
                continue
            if (fixed := self._fixed(word, at, flat, tokens, ids, body)) is not None:
                self.found.append((i, "misread", fixed))
                self.fixes[i].append((start, end, fixed.capitalize() if word[0].isupper() else fixed))
        for i, (whole, wrong) in broken.items():
            self.found.append((i, "broken_word", whole))
            if wrong:
                self.found.append((i, "misread", whole))

    def _broken(self, body: list[int]) -> dict[int, tuple[str, bool]]:
        """By line the word of the vocabulary that runs on to the next line, and whether it is misread too."""
        out: dict[int, tuple[str, bool]] = {}
        known = self.words.index
        for i, after in zip(body, body[1:], strict=False):
            end, start = _LAST.search((self.lines[i].split() or [""])[-1]), _FIRST.match(self.lines[after])
            if not end or not start or after != i + 1 and any(self.lines[j].strip() == "" for j in range(i + 1, after)):
                continue
            a, b = end[1].lower(), start[1].lower()
            if start[1][0].isupper():
                continue
            whole = next((w for w in ((a + b, a + "-" + b) if end[2] else (a + b,)) if w in known), None)
            if end[2]:
                if whole:
                    out[i] = (whole, False)
                elif printed := self.words.printed(a + b):
                    out[i] = (self._best({w: (c, 0.0) for w, c in printed.items()}, []), True)
            elif whole and not (a in known and b in known):
                out[i] = (whole, False)
            elif not whole and a not in known and b not in known and len(a + b) >= 7 and not self.words.printed(a) and not self.words.printed(b) and (printed := self.words.printed(a + b)):
                out[i] = (self._best({w: (c, 0.0) for w, c in printed.items()}, []), True)
        return out

    def _fixed(self, word: str, at: int, flat: list, tokens: list, ids: list[int], body: list[int]) -> str | None:
        """The word of the vocabulary that was printed, unless ``word`` is a name, a number or can't be told."""
        if len(word) > 1 and word.isupper() or _NUMBER.fullmatch(word) and any(c.isdigit() for c in word) and _as_number(word) is not None:
            return None
        printed = self.links.get(word.lower())
        if not printed:
            return None
        n, k = flat[at]
        if word[0].isupper() and not self._starts(n, k, tokens, body):
            printed = {w: c for w, c in printed.items() if self.words.language[w] == "de" and len(w) > 3}
        if not printed:
            return None
        context = [i for i in ids[max(0, at - WINDOW) : at] + ids[at + 1 : at + 1 + WINDOW] if i >= 0]
        return self._best(printed, context)

    def _starts(self, n: int, k: int, tokens: list, body: list[int]) -> bool:
        """Whether a token begins a sentence."""
        _, start, _ = tokens[n][k]
        line = self.lines[body[n]]
        before = line[:start].rstrip()
        if not before:
            j = body[n] - 1
            before = self.lines[j].rstrip() if j >= 0 and j not in self.furniture else ""
        if before and before[-1] not in ".!?:*-•":
            return False
        return True

    def _best(self, printed: dict[str, tuple[int, float]], context: list[int]) -> str:
        """Of words with their glyph edits and likeness to what was read, the one that goes best with the words around it."""
        u, v, often = self.vectors
        index = self.words.index
        least = min(c for c, _ in printed.values())
        near = {w: x for w, x in printed.items() if x[0] <= least + 1}
        if len(near) == 1:
            return next(iter(near))
        around = v[context].mean(0) if context else np.zeros(u.shape[1])
        return max(sorted(near), key=lambda w: AROUND * float(u[index[w]] @ around) + OFTEN * often[index[w]] + LIKE * near[w][1] - EDIT * near[w][0])

    def text(self) -> str:
        """The page as paragraphs: furniture left out, words joined and corrected, lines run on."""
        out: list[str] = []
        glue = "\n"
        for i, line in enumerate(self.lines):
            if i in self.furniture:
                continue
            for start, end, word in sorted(self.fixes.get(i, ()), reverse=True):
                line = line[:start] + word + line[end:]
            bare = line.strip()
            if not bare:
                glue = "\n\n"
                continue
            apart = re.match(r"[-*•]\s|[\d\W]+$", bare) is not None
            out.append((glue if not apart or glue == "\n\n" else "\n") + bare if out else bare)
            glue = " " if not re.match(r"[\d\W]+$", bare) else "\n"
            whole = next((w for j, kind, w in self.found if j == i and kind == "broken_word"), None)
            if whole:
                end = _LAST.search(out[-1])
                if end:
                    half = end[1] if whole.startswith(end[1].lower()) else whole[: len(end[1])]
                    out[-1] = out[-1][: end.start()] + half + ("-" if whole[len(half) : len(half) + 1] == "-" else "")
                glue = ""
        return "".join(out)


def _close(a: str, b: str) -> bool:
    """At most two letters changed, put in or left out."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        if min(row) > 2:
            return False
    return row[-1] <= 2


def _vocabulary(words: DataFrame) -> dict[str, str]:
    rows = words.where("word IS NOT NULL AND word <> ''").select(F.lower("word").alias("word"), "lang").limit(VOCABULARY + 1).collect()
    if len(rows) > VOCABULARY:
        raise ValueError(f"the vocabulary has more than {VOCABULARY} words")
    return {r["word"]: r["lang"] for r in rows}


class _Pairs:
    """Pairs of neighbouring words as counted within one task: of the vocabulary, and of other words with it."""

    def __init__(self, tree: Words):
        self.tree, self.size = tree, max(1, len(tree.index))
        self.numbers: dict[str, int] = {}
        self.held: list[np.ndarray] = []
        self.many = 0

    def add(self, spoken: list[str]) -> None:
        """Counts the pairs of words up to WINDOW apart; words that can't be of the vocabulary part them."""
        index, numbers, size = self.tree.index, self.numbers, self.size
        ids = np.array([index[t] if t in index else size + numbers.setdefault(t, len(numbers)) if t and self.tree.printed(t) else -1 for t in spoken], np.int64)
        for gap in range(1, WINDOW + 1):
            a, b = ids[:-gap], ids[gap:]
            for word, context in ((a, b), (b, a)):
                keep = (word >= 0) & (context >= 0) & (context < size)
                self.held.append(word[keep] * size + context[keep])
                self.many += int(keep.sum())

    def taken(self) -> pd.DataFrame:
        keys, counts = np.unique(np.concatenate(self.held) if self.held else np.zeros(0, np.int64), return_counts=True)
        word, context = keys // self.size, keys % self.size
        names = np.array([*self.numbers, ""], object)
        other = word >= self.size
        line = names[np.where(other, word - self.size, len(names) - 1)]
        self.numbers, self.held, self.many = {}, [], 0
        what = np.where(other, "near", "pair")
        return pd.DataFrame({"id": None, "source": None, "what": what, "line": line, "number": np.where(other, -1, word), "context": context.astype(np.int64), "count": counts})


def _survey(given: DataFrame, tree, kind: str) -> DataFrame:
    """What all pages say, in one pass, counted within batches and tasks.

    Rows are (id, source, what, line, number, context, count): 'pages',
    'title' and 'offset' of a source, 'word' for the words of a page that may
    be misread ones, 'pair' and 'near' for pairs of words.
    """

    def survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = tree.value
        pairs = _Pairs(words)
        for batch in batches:
            edges: Counter[tuple] = Counter()
            of_page: list[tuple] = []
            spoken: list[str] = []
            for key, of, number, page_text in zip(batch["id"], batch["source"], batch["page"], batch["text"], strict=True):
                lines = page_text.split("\n")
                keys, offsets = set(), set()
                for i in _edges(lines):
                    keys.add(_title_key(lines[i]))
                    offsets |= {n - int(number) for n in _numbers(lines[i])} if number == number and number is not None else set()
                edges[of, "pages", "", 0] += 1
                edges.update((of, "title", k, 0) for k in keys if len(k) > 5)
                edges.update((of, "offset", "", o) for o in offsets)
                tokens = _body_tokens(page_text)
                rare = Counter(t for t in tokens if t not in words.index)
                of_page += ((key, of, t, n) for t, n in rare.items() if words.printed(t))
                spoken += tokens
                spoken += [""] * WINDOW
            pairs.add(spoken)
            if edges:
                source, what, line, number = zip(*edges, strict=True)
                yield pd.DataFrame({"id": None, "source": source, "what": what, "line": line, "number": number, "context": -1, "count": list(edges.values())})
            if of_page:
                key, of, line, count = zip(*of_page, strict=True)
                yield pd.DataFrame({"id": key, "source": of, "what": "word", "line": line, "number": 0, "context": -1, "count": count})
            if pairs.many > 2_000_000:
                yield pairs.taken()
        yield pairs.taken()

    return given.select("id", "source", "page", "text").mapInPandas(survey, f"id {kind}, source long, what string, line string, number long, context long, count long")


def _links(rare: DataFrame, near: DataFrame, tree, vectors) -> DataFrame:
    """(word, printed): for each rare word, as ``printed``, the words of the vocabulary that glyph edits lead to, with their likeness.

    A rare word's own vector is fitted to all its contexts in the corpus;
    likeness is the cosine of the angle with that of its frequent neighbour.
    """
    bags = skipgram.bags(near.select("word", F.col("context").cast("int").alias("context"), F.col("count").alias("pairs")), "word")
    tasks = 3 * rare.sparkSession.sparkContext.defaultParallelism

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, (u, v, often) = tree.value, vectors.value
        side = skipgram.Side(v, often)
        length = np.sqrt((u * u).sum(1)) + 1e-9
        for batch in batches:
            found = []
            for word, contexts, counts in zip(batch["word"], batch["contexts"], batch["counts"], strict=True):
                printed = words.printed(word)
                least = min(printed.values())
                close = [w for w, c in printed.items() if c <= least + 1]
                like = dict.fromkeys(close, 0.0)
                if len(close) > 1 and contexts is not None:
                    own = side.fit(np.asarray(contexts), np.asarray(counts, np.float64), np.zeros(u.shape[1]), zlib.crc32(word.encode()))
                    at = [words.index[w] for w in close]
                    like = dict(zip(close, (u[at] @ own / (length[at] * (np.sqrt(own @ own) + 1e-9))).tolist(), strict=True))
                found.append([{"to": w, "edits": printed[w], "likeness": like[w]} for w in sorted(close)])
            yield pd.DataFrame({"word": batch["word"], "printed": found})

    joined = rare.join(bags, "word", "left").repartition(tasks, "word")
    return joined.mapInPandas(link, "word string, printed array<struct<to:string,edits:int,likeness:double>>")


def _beside(rows: DataFrame, about: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with ``about`` by source: sent to all tasks up to SOURCES rows, beyond them spread over SALT tasks a source."""
    if about.limit(SOURCES + 1).count() <= SOURCES:
        return rows.join(F.broadcast(about), "source", how)
    salted = about.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(salted, ["source", "salt"], how).drop("salt")


def read_pages(pages: DataFrame, words: DataFrame, key: str = "chunk_idx", source: str = "source", page: str = "page", text: str = "text") -> DataFrame:
    """(``key``, scanned, found, repaired) of every page with text: what was found on it, and its repaired text.

    ``found`` is a list of (line_no, kind, repaired): 'furniture' for running
    titles and page numbers, 'broken_word' for a word of ``words`` (word, lang)
    that runs on to the next line, 'misread' for one with wrong characters.
    ``line_no`` counts from 0 between line feeds.  Pages of sources that don't
    look scanned have no findings and keep their text; so do all pages if
    ``words`` is empty, furniture aside.  Rows with null or empty text are left
    out, null sources aren't scanned, and null pages bear no page number.
    Repeated pages each count; ``key`` must be unique.
    """
    spark = pages.sparkSession
    tree = spark.sparkContext.broadcast(Words(_vocabulary(words)))
    size = max(1, len(tree.value.index))
    kind = pages.schema[key].dataType.simpleString()
    given = pages.select(F.col(key).alias("id"), F.xxhash64(source).alias("source"), F.col(page).cast("int").alias("page"), F.col(text).alias("text")).where(
        F.col(source).isNotNull() & (F.length(text) > 0)
    )
    said = cut(_survey(given, tree, kind))
    of_source = said.where("what IN ('pages', 'title', 'offset')").groupBy("source", "what", "line", "number").agg(F.sum("count").alias("count"))
    counts = cut(of_source)
    per_source = counts.where("what = 'pages'").select("source", F.col("count").alias("pages"))
    offsets = counts.where("what = 'offset'").groupBy("source").agg(F.max_by("number", F.struct("count", -F.abs("number"))).alias("offset"), F.max("count").alias("numbered"))
    scanned = per_source.join(offsets, "source").where((F.col("numbered") >= NUMBERED_LEAST) & (F.col("numbered") >= NUMBERED_SHARE * F.col("pages")))
    titles = counts.where("what = 'title'").join(per_source, "source").where((F.col("count") >= TITLE_LEAST) & (F.col("count") >= TITLE_SHARE * F.col("pages")))
    titles = titles.groupBy("source").agg(F.sort_array(F.collect_list("line")).alias("titles"))  # bounded by the share
    about = cut(scanned.join(titles, "source", "left").select("source", "offset", F.array_join(F.coalesce("titles", F.array()), "\n").alias("titles")))

    pairs = said.where("what = 'pair'").groupBy(F.col("number").cast("int").alias("word"), F.col("context").cast("int").alias("context")).agg(F.sum("count").alias("pairs"))
    u, v, often = skipgram.train(cut(skipgram.bags(pairs, "word")), size)
    vectors = spark.sparkContext.broadcast((u, v, often))
    shared = spark.sparkContext.broadcast((u.astype(np.float32), v.astype(np.float32), np.log1p(often).astype(np.float32)))

    # words that occur where nothing was scanned are words of their own; the others are linked
    of_page = said.where("what = 'word'").select("id", "source", F.col("line").alias("word"), "count")
    clean = _beside(of_page, about.select("source"), "left_anti").groupBy("word").agg(F.sum("count").alias("count"))
    own = clean.where(F.col("count") >= max(OWN_LEAST, OWN_SHARE * float(often.sum()) / (2 * WINDOW)))
    seen = _beside(of_page, about.select("source"), "left_semi").select("id", "word")
    rare = seen.select("word").distinct().join(own.select("word"), "word", "left_anti")
    near = said.where("what = 'near'").groupBy(F.col("line").alias("word"), "context").agg(F.sum("count").alias("count"))
    links = cut(_links(rare, near, tree, vectors))
    linked = seen.join(links, "word").groupBy("id").agg(F.collect_list(F.struct("word", "printed")).alias("links"))  # bounded by the page

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = tree.value
        for batch in batches:
            found, repaired = [], []
            for number, page_text, offset, titles, links in zip(batch["page"], batch["text"], batch["offset"], batch["titles"], batch["links"], strict=True):
                number = None if number is None or number != number else int(number)
                own = {x["word"]: {p["to"]: (p["edits"], p["likeness"]) for p in x["printed"]} for x in links} if links is not None else {}
                read = Page(page_text, number, int(offset), frozenset((titles or "").split("\n")) - {""}, words, shared.value, own)
                found.append([{"line_no": i, "kind": k, "repaired": w} for i, k, w in dict.fromkeys(read.found)])
                repaired.append(read.text())
            yield pd.DataFrame({"id": batch["id"], "scanned": True, "found": found, "repaired": repaired})

    schema = f"id {kind}, scanned boolean, found array<struct<line_no int, kind string, repaired string>>, repaired string"
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
    papers = _beside(given, about, "inner").repartition(tasks, "id").join(linked.repartition(tasks, "id"), "id", "left").select("id", "page", "text", "offset", "titles", "links")
    born = _beside(given, about.select("source"), "left_anti")
    none = F.array().cast("array<struct<line_no int, kind string, repaired string>>")
    kept = born.select("id", F.lit(False).alias("scanned"), none.alias("found"), F.col("text").alias("repaired"))
    return papers.mapInPandas(repair, schema).unionByName(kept).withColumnRenamed("id", key)


def noise(pages: DataFrame, words: DataFrame, key: str = "chunk_idx") -> DataFrame:
    """(``key``, line_no, kind, repaired): distinct findings of ``read_pages``."""
    rows = read_pages(pages, words, key).where("scanned").select(key, F.explode("found").alias("f"))
    return rows.select(key, "f.line_no", "f.kind", "f.repaired")
