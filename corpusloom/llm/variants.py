"""Problem 2: spellings of names that stand for one thing.

A name is read as a core (the word that is its own) and details (kind,
subject, number, given name).  Cores are partitioned in the metric space of
the edit distance: each goes to the cell of its nearest pivot, and also to
every cell so near that the triangle inequality allows a partner there.  Inside
a cell an exact join by radius links cores; names with linked cores are the
same thing where their details agree.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.names import FILLERS, TITLES, details, near, same_details, tokens
from corpusloom.session import cut

#: Steps of the edit metric between cores that may be one.
RADIUS = 1
#: Pivots at most by type and cell; one for so many cores; cores of one cell that are not parted further.
PIVOTS, CORES_A_PIVOT, CELL = 512, 24, 20_000
#: A word is general in a type if this share of its names hold it and it goes with so many rarer words.
GENERAL_SHARE, GENERAL_PARTNERS = 0.01, 8
#: Types whose names are people's.
PEOPLE = ("Person",)
#: Rows of the table of given names that are sent to every task at most.
GIVEN_NAMES = 100_000


def general_words(names: DataFrame) -> dict[str, set[str]]:
    """By type, the words that go with many rarer ones (kinds, subjects); their number is bounded by the share."""
    words = names.select("kind", "name", F.explode(F.array_distinct("tokens")).alias("word"))
    totals = names.groupBy("kind").agg(F.count("*").alias("names"))
    counts = words.groupBy("kind", "word").count().join(totals, "kind")
    often = counts.where(F.col("count") >= F.greatest(F.lit(2.0), F.col("names") * GENERAL_SHARE)).select("kind", "word", "count")
    partners = often.join(words.select("kind", "word", "name"), ["kind", "word"]).join(
        words.select("kind", F.col("word").alias("other"), "name").join(counts.select("kind", F.col("word").alias("other"), F.col("count").alias("less")), ["kind", "other"]), ["kind", "name"]
    )
    rarer = partners.where("less < count").groupBy("kind", "word").agg(F.count_distinct("other").alias("rarer"))
    found: dict[str, set[str]] = defaultdict(set)
    for row in rarer.where(F.col("rarer") >= GENERAL_PARTNERS).collect():
        found[row["kind"]].add(row["word"])
    return found


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """The unrestricted Damerau-Levenshtein metric of each of ``a`` from its partner in ``b``, many pairs at a time."""
    out = np.zeros(len(a), np.int16)
    lengths = np.array([[len(x) for x in a], [len(y) for y in b]], np.int64).reshape(2, -1)
    order = np.lexsort((lengths[1], lengths[0]))
    start = 0
    while start < len(order):
        wide = int(lengths[:, order[start : start + 4096]].max(initial=1)) + 2
        these = order[start : start + max(1, min(4096, 2_000_000 // wide**2))]
        out[these] = _block([a[i] for i in these], [b[i] for i in these])
        start += len(these)
    return out


def _codes(words: list[str], letters: dict[str, int], wide: int, filler: int) -> np.ndarray:
    return np.array([[letters[c] for c in w] + [filler] * (wide - len(w)) for w in words], np.int64).reshape(len(words), wide)


def _block(a: list[str], b: list[str]) -> np.ndarray:
    letters = {c: i for i, c in enumerate(sorted(set("".join(a)) | set("".join(b))))}
    sizes = np.array([[len(x) for x in a], [len(y) for y in b]])
    high, wide = sizes.max(1)
    x, y = _codes(a, letters, high, len(letters)), _codes(b, letters, wide, len(letters) + 1)
    row, most = np.arange(len(a)), high + wide
    d = np.full((high + 2, wide + 2, len(a)), most, np.int16)
    d[1, 1:] = np.arange(wide + 1)[:, None]
    seen = np.zeros((len(a), len(letters) + 2), np.int64)
    for i in range(1, high + 1):
        d[i + 1, 1] = i
        match = np.zeros(len(a), np.int64)
        for j in range(1, wide + 1):
            hit = x[:, i - 1] == y[:, j - 1]
            k = seen[row, y[:, j - 1]]
            swap = d[k, match, row] + (i - k - 1) + 1 + (j - match - 1)
            d[i + 1, j + 1] = np.minimum(np.minimum(d[i, j] + ~hit, np.minimum(d[i + 1, j], d[i, j + 1]) + 1), swap)
            match[hit] = j
        seen[row, x[:, i - 1]] = i
    return d[sizes[0] + 1, sizes[1] + 1, row]


def _letters(words: list[str]) -> np.ndarray:
    """How often each of 32 classes of letters stands in each word."""
    counts = np.zeros((len(words), 32), np.int16)
    if words:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        np.add.at(counts, (np.repeat(np.arange(len(words)), [len(w) for w in words]), codes % 32), 1)
    return counts


def _at_least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A bound from below of the metric between all words of ``a`` and ``b`` by their letters: one step changes no more than one letter for another."""
    apart = np.abs(a[:, None, :] - b[None, :, :]).sum(2)
    return (apart + np.abs(a.sum(1)[:, None] - b.sum(1)[None, :]) + 1) // 2


def placed(words: list[str], pivots: list[str], slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, pivot, distance, whether it is the nearest) for each pivot that is at most ``slack`` farther than the nearest one.

    The true metric is taken only where the bound by letters leaves it open.
    """
    found: list[tuple[np.ndarray, ...]] = []
    far, own = _letters(pivots), _letters(words)
    for start in range(0, len(words), 256):
        some = words[start : start + 256]
        bound = _at_least(own[start : start + 256], far)
        d = np.full(bound.shape, np.iinfo(np.int16).max, np.int16)
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argpartition(bound, min(4, len(pivots)) - 1, axis=1)[:, :4], True, 1)
        best = np.full((len(some), 1), np.iinfo(np.int16).max, np.int64)
        for chosen in (lambda: first, lambda: (bound <= best) & ~first, lambda: (bound <= best + slack) & (d == np.iinfo(np.int16).max)):
            w, p = np.nonzero(chosen())
            d[w, p] = distances([some[i] for i in w], [pivots[i] for i in p])
            best = d.min(1, keepdims=True).astype(np.int64)
        w, p = np.nonzero(d <= best + slack)
        found.append((w + start, p, d[w, p], p == d.argmin(1)[w]))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, int),) * 4


def _apart(candidates: list[str], want: int) -> list[str]:
    """Up to ``want`` of the candidates, no two of which are one step apart."""
    chosen: list[str] = []
    for core in candidates:
        if len(chosen) < want and not any(near(core, c) for c in chosen):
            chosen.append(core)
    return chosen


def _pivots(cores: DataFrame, by: list[str], most: int, some: int) -> DataFrame:
    """(``by``, pivots): of each group some of the cores at home in it, one for ``some`` cores and ``most`` at most, that lie apart."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("names"), F.xxhash64("core")))
    first = cores.withColumn("place", place).where(F.col("place") <= 2 * most)
    sizes = cores.groupBy(*by).agg(F.count("*").alias("many"))
    listed = first.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("place", "core"))).alias("first")).join(sizes, by)  # bounded by ``most``
    choose = F.udf(lambda first, many: _apart([x["core"] for x in first], min(most, max(1, many // some))), "array<string>")
    return listed.select(*by, choose("first", "many").alias("pivots"))


def _joined_cell(cell: pd.DataFrame) -> pd.DataFrame:
    """Pairs (rare, common) of cores within the radius; one of each pair is at home in this cell."""
    cores, names, d = cell["core"].tolist(), cell["names"].to_numpy(), cell["d"].to_numpy()
    letters, home = _letters(cores), np.flatnonzero(cell["home"])
    pairs = set()
    for start in range(0, len(home), max(1, 2_000_000 // max(1, len(cores)))):
        these = home[start : start + max(1, 2_000_000 // max(1, len(cores)))]
        open_ = np.abs(d[these][:, None] - d[None, :]) <= RADIUS  # triangle inequality about the pivot
        h, o = np.nonzero(open_)
        close = np.zeros(len(h), bool)
        for at in range(0, len(h), 500_000):
            part = slice(at, at + 500_000)
            apart = letters[these[h[part]]] - letters[o[part]]
            close[part] = (np.abs(apart).sum(1) + np.abs(apart.sum(1)) + 1) // 2 <= RADIUS
        for a, b in zip(these[h[close]].tolist(), o[close].tolist(), strict=True):
            if a != b and near(cores[a], cores[b]):
                pairs.add((cores[a], cores[b]) if (names[a], cores[b]) < (names[b], cores[a]) else (cores[b], cores[a]))
    return pd.DataFrame(sorted(pairs), columns=["core", "like"]).assign(kind=cell["kind"].iloc[0])


_CELL = "kind string, cell string, home boolean, core string, names long, d int"


def _into_cells(rows: DataFrame) -> DataFrame:
    """Rows (kind, cell, home, core, names, pivots) in the cells of their pivots below their cell; ``home`` stays only in the nearest one."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (kind, cell), rows in batch.groupby(["kind", "cell"]):
                w, p, d, nearest = placed(rows["core"].tolist(), list(rows["pivots"].iloc[0]), 2 * RADIUS)
                below = np.array([f"{cell}/{i}" for i in range(len(rows["pivots"].iloc[0]))], object)
                yield pd.DataFrame({"kind": kind, "cell": below[p], "home": rows["home"].to_numpy()[w] & nearest, "core": rows["core"].to_numpy()[w], "names": rows["names"].to_numpy()[w], "d": d})

    return rows.mapInPandas(place, _CELL)


def linked_cores(cores: DataFrame) -> DataFrame:
    """(kind, core, like): every pair of cores within RADIUS of the metric, the rarer first, from (kind, core, names).

    Cells with more than CELL cores are parted again by pivots of their own,
    until none is left, or none that gets smaller by it.
    """
    tasks = 3 * cores.sparkSession.sparkContext.defaultParallelism  # few bytes, much work
    rows = cores.select("kind", F.lit("").alias("cell"), F.lit(True).alias("home"), "core", "names")
    pivots = _pivots(rows.select("kind", "cell", "core", "names"), ["kind", "cell"], PIVOTS, CORES_A_PIVOT)
    cells = cut(_into_cells(rows.join(F.broadcast(pivots), ["kind", "cell"]).repartition(tasks, "kind", "core")))  # a row a type, PIVOTS words each
    done = []
    while True:
        sizes = cells.groupBy("kind", "cell").agg(F.count("*").alias("many"), F.count_if("home").alias("homes"))
        big = cut(sizes.where((F.col("many") > CELL) & (F.col("homes") > CORES_A_PIVOT)))
        if big.isEmpty():
            break
        done.append(cells.join(big.select("kind", "cell"), ["kind", "cell"], "left_anti"))
        large = cells.join(big.select("kind", "cell", "many"), ["kind", "cell"])
        pivots = _pivots(large.where("home").select("kind", "cell", "core", "names"), ["kind", "cell"], PIVOTS, CORES_A_PIVOT)
        parted = cut(_into_cells(large.join(pivots, ["kind", "cell"]).repartition(tasks, "kind", "cell", "core")))
        # a cell of which nearly all lies in a part of it has to be joined as it is
        parts = parted.withColumn("above", F.regexp_replace("cell", "/[0-9]+$", "")).groupBy("kind", "above", "cell").agg(F.count("*").alias("part"))
        whole = parts.groupBy("kind", "above").agg(F.max("part").alias("part")).join(big.withColumnRenamed("cell", "above"), ["kind", "above"]).where("part > 0.8 * many")
        whole = cut(whole.select("kind", F.col("above").alias("cell")))
        done.append(cells.join(whole, ["kind", "cell"]))
        cells = cut(parted.withColumn("above", F.regexp_replace("cell", "/[0-9]+$", "")).join(whole.select("kind", F.col("cell").alias("above")), ["kind", "above"], "left_anti").drop("above"))
    every = cells
    for part in done:
        every = every.unionByName(part)
    return every.repartition(tasks, "kind", "cell").groupBy("kind", "cell").applyInPandas(_joined_cell, "core string, like string, kind string").distinct()


def _person(words: list[str], full: dict[str, set[str]]) -> tuple[str, list[str]]:
    """(surname, [given name, its long forms, or its initial])."""
    words = [w for w in words if w not in TITLES and w not in FILLERS]
    long = [w for w in words if len(w) > 1]
    if not long:
        return "", words
    known = [w for w in long if w in full] or [w for w in long if len(w) >= 4 and any(near(w, g) for g in full)]
    rest = [w for w in long if w not in known[:1]] or long
    core = max(rest, key=len)
    given = known[0] if known and known[0] != core else next((w for w in words if w != core), "")
    if len(given) > 1 and given not in full:
        given = next((g for g in sorted(full) if len(given) >= 4 and near(given, g)), given)
    return core, [given] if given else []


def _read(names: pd.Series, kind: str, general: set[str], full: dict[str, set[str]]) -> tuple[list[str], list[list[str]]]:
    cores, rest = [], []
    for name in names:
        words = tokens(name)
        if kind in PEOPLE:
            core, more = _person(words, full)
        else:
            own = [w for w in words if w not in general and w not in FILLERS and not w.isdigit()] or words
            core = max(own, key=len, default="")
            at = words.index(core) if core else 0
            more = details(words[:at] + words[at + 1 :]) if len(words) > 1 else []
        cores.append(core)
        rest.append(more)
    return cores, rest


def _agree(kind: str, a: list[str], b: list[str], full: dict[str, set[str]]) -> bool:
    if kind not in PEOPLE:
        return same_details(a, b)
    if not a or not b:
        return not a and not b
    x, y = a[0], b[0]
    if x == y:
        return True
    if len(x) == 1 or len(y) == 1:
        return any(p[0] == q[0] for p in full.get(x, {x}) | {x} for q in full.get(y, {y}) | {y})
    return bool((full.get(x, {x}) | {x}) & (full.get(y, {y}) | {y}))


class _Fits:
    """The things of one family by what a reading must share with them, so that few are compared."""

    def __init__(self, kind: str, full: dict[str, set[str]]):
        self.people, self.kind, self.full = kind in PEOPLE, kind, full
        self.things: list[list[str]] = []
        self.by: dict[tuple, list[int]] = defaultdict(list)

    def _forms(self, given: str) -> set[str]:
        return self.full.get(given, {given}) | {given}

    def add(self, reading: list[str]) -> int:
        number = len(self.things)
        self.things.append(reading)
        for key in self._keys(reading):
            self.by[key].append(number)
        return number

    def _keys(self, reading: list[str]) -> set[tuple]:
        """Under what a thing is kept."""
        if not self.people:
            letters = sorted(w[0] for w in reading if not w.isdigit())
            kept = {("all", len(reading), tuple(sorted(w for w in reading if w.isdigit())))}
            return kept | ({("initials", *letters)} if len(reading) > 1 else {("single", *sorted(reading[0]))} if reading else set())
        if not reading:
            return {("none",)}
        forms = self._forms(reading[0])
        return {("form", f) for f in forms} | {("letter", f[0]) for f in forms} | ({("initial", reading[0])} if len(reading[0]) == 1 else set())

    def _asked(self, reading: list[str]) -> set[tuple]:
        """Where a reading may find things that agree with it."""
        if not self.people:
            letters = sorted(w[0] for w in reading if not w.isdigit())
            kept = {("all", len(reading), tuple(sorted(w for w in reading if w.isdigit())))}
            return kept | ({("single", *letters)} if len(reading) > 1 else {("initials", *sorted(reading[0]))} if reading else set())
        if not reading:
            return {("none",)}
        forms = self._forms(reading[0])
        if len(reading[0]) == 1:
            return {("letter", f[0]) for f in forms} | {("form", f) for f in forms}
        return {("form", f) for f in forms} | {("initial", f[0]) for f in forms}

    def find(self, reading: list[str]) -> int | None:
        """The one thing that ``reading`` agrees with; of several the one of equal wording, if only one is; else none."""
        fits: set[int] = set()
        for key in sorted(self._asked(reading)):
            for t in self.by.get(key, ()):
                if t not in fits and _agree(self.kind, reading, self.things[t], self.full):
                    fits.add(t)
        if len(fits) > 1:
            exact = {t for t in fits if sorted(self.things[t]) == sorted(reading)}
            fits = exact or fits
        return next(iter(fits)) if len(fits) == 1 else None


def _things(kind: str, rows: list[tuple[list[str], int]], full: dict[str, set[str]]) -> list[int]:
    """For the readings (details, rows) of one family of cores, the number of the thing that each stands for.

    Readings are taken from the fullest to the shortest.  One that agrees with
    one thing joins it; one that agrees with several (an initial, a short form
    of two names) can't be told and stays alone.
    """
    order = sorted(range(len(rows)), key=lambda i: (-sum(map(len, rows[i][0])) if kind not in PEOPLE else -_fullness(rows[i][0], full), -rows[i][1], rows[i][0]))
    fits, number = _Fits(kind, full), [0] * len(rows)
    for i in order:
        found = fits.find(rows[i][0])
        number[i] = fits.add(rows[i][0]) if found is None else found
    return number


def _fullness(given: list[str], full: dict[str, set[str]]) -> int:
    """Long given names before short forms, both before initials."""
    if not given:
        return 0
    return 1 if len(given[0]) == 1 else 3 if given[0] in full.get(given[0], ()) else 2


def given_forms(given_names: DataFrame) -> dict[str, set[str]]:
    """For each given name and short form the long names it may stand for."""
    rows = given_names.select(F.lower("given").alias("given"), F.lower("short_form").alias("short")).limit(GIVEN_NAMES + 1).collect()
    if len(rows) > GIVEN_NAMES:
        raise ValueError(f"given_names has more than {GIVEN_NAMES} rows")
    full: dict[str, set[str]] = defaultdict(set)
    for row in rows:
        if row["given"]:
            full[row["given"]].add(row["given"])
            if row["short"]:
                full[row["short"]].add(row["given"])
    return dict(full)


def _families(cores: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, core, family): the cores that links connect, over any number of them; details decide inside a family."""
    both = cut(links.select("kind", "core", "like").unionByName(links.select("kind", F.col("core").alias("like"), F.col("like").alias("core"))).distinct())
    families = cut(cores.select("kind", "core", F.col("core").alias("family")))
    while True:
        near = both.join(families.select("kind", F.col("core").alias("like"), F.col("family").alias("other")), ["kind", "like"])
        least = near.groupBy("kind", "core").agg(F.min("other").alias("other"))
        stepped = families.join(least, ["kind", "core"], "left").select("kind", "core", "family", F.least("family", "other").alias("stepped"))
        # and on to the family of that family, so that long chains take few rounds
        onward = families.select("kind", F.col("core").alias("stepped"), F.col("family").alias("onward"))
        stepped = cut(stepped.join(onward, ["kind", "stepped"], "left").select("kind", "core", "family", F.least("stepped", "onward").alias("next")))
        families = stepped.select("kind", "core", F.col("next").alias("family"))
        if stepped.where("next <> family").isEmpty():
            return families


def resolve(df: DataFrame, given_names: DataFrame, key: str = "entity_id", name: str = "name", kind: str = "entity_type") -> DataFrame:
    """(``key``, thing): rows with the same thing are spellings of one thing; ``thing`` is the smallest ``key`` among them.

    Rows of different ``kind`` are never one thing.  Null and blank names stand
    alone, as do names that fit more than one thing.  Equal names of one kind
    are one thing however many rows have them.
    """
    shared = df.select(F.col(key).alias("id"), F.coalesce(F.col(kind), F.lit("")).alias("kind"), F.trim(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"\s+", " ")).alias("name"))
    full = given_forms(given_names)
    split = F.pandas_udf(lambda names: names.map(tokens), "array<string>")
    distinct = cut(shared.where("name <> ''").select("kind", "name").distinct().withColumn("tokens", split("name")))
    general = general_words(distinct)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind_, rows in batch.groupby("kind"):
                cores, rest = _read(rows["name"], kind_, general.get(kind_, set()), full)
                yield pd.DataFrame({"kind": kind_, "name": rows["name"].to_numpy(), "core": cores, "details": rest})

    readings = cut(distinct.select("kind", "name").mapInPandas(read, "kind string, name string, core string, details array<string>"))
    cores = readings.groupBy("kind", "core").agg(F.count("*").alias("names"))
    links = linked_cores(cores)
    families = _families(cores, links)

    member = readings.join(families, ["kind", "core"])
    distinct_readings = member.groupBy("kind", "family", "details").agg(F.count("*").alias("rows"))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Families one behind the other, each held until it is complete."""
        held: list[tuple] = []

        def named() -> pd.DataFrame:
            kind, family = held[0][:2]
            found = _things(kind, [(list(d), n) for _, _, d, n in held], full)
            return pd.DataFrame({"kind": kind, "family": family, "details": [d for _, _, d, _ in held], "number": found})

        for batch in batches:
            done = []
            for row in zip(batch["kind"], batch["family"], batch["details"], batch["rows"], strict=True):
                if held and held[0][:2] != row[:2]:
                    done.append(named())
                    held = []
                held.append(row)
            if done:
                yield pd.concat(done)
        if held:
            yield named()

    tasks = 3 * df.sparkSession.sparkContext.defaultParallelism
    by_family = distinct_readings.repartition(tasks, "kind", "family").sortWithinPartitions("kind", "family")
    numbered = cut(by_family.mapInPandas(number, "kind string, family string, details array<string>, number int"))
    known = member.join(numbered, ["kind", "family", "details"]).select("kind", "name", "family", "number")
    named = shared.join(known, ["kind", "name"], "left")
    things = named.where("family IS NOT NULL").groupBy("kind", "family", "number").agg(F.min("id").alias("thing"))
    return named.join(things, ["kind", "family", "number"], "left").select(F.col("id").alias(key), F.coalesce("thing", "id").alias("thing"))


def same_pairs(resolved: DataFrame, key: str = "entity_id") -> DataFrame:
    """(``key``_a, ``key``_b), a < b: all pairs of rows of one thing."""
    a = resolved.select("thing", F.col(key).alias(f"{key}_a"))
    b = resolved.select("thing", F.col(key).alias(f"{key}_b"))
    return a.join(b, "thing").where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
