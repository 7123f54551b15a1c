"""Plain lines at less cost, and blocks that change nothing."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa

from corpusloom.llm import furniture

ENDS = ["plain words", "(in marks)", "...", "", " x ", "-a", "a.", "é!", "¿x?", "日本 。"]


def texts(many=60):
    some = random.Random(2)
    return ["\n".join(some.choice(ENDS) + some.choice(["", " and more", " 3 of 4"]) for _ in range(some.randrange(1, 9))) for _ in range(many)]


def test_lines_between_letters_are_not_looked_through_for_marks(monkeypatch):
    assert furniture.plain(["\n".join(ENDS)]) == [["plain words", "in marks", "", "", "x", "a", "a", "é", "x", "日本"]]
    monkeypatch.setattr(furniture, "_MARKS", 0, raising=False)  # whoever looks for these fails
    assert furniture.plain(["plain words\nA b\n\né"]) == [["plain words", "a b", "", "é"]]


def test_sizes_of_blocks_change_nothing(monkeypatch):
    said = texts()
    source = np.arange(len(said), dtype=np.int64) % 3
    batch = pa.RecordBatch.from_pydict({"source": source, "text": said})
    rows = pd.DataFrame({"id": np.arange(len(said)), "source": source, "text": said})

    def found():
        counted = sorted(tuple(r.values()) for b in furniture._count_pieces(iter([batch])) for r in b.to_pylist())
        return counted, furniture._suspicious(rows, np.array(sorted({c[0] for c in counted if c[2] > 2})))

    whole = found()
    monkeypatch.setattr(furniture, "AT_ONCE", 7)
    monkeypatch.setattr(furniture, "CHARACTERS", 50)
    parts = found()
    assert whole[0] == parts[0] and len(whole[1]) and whole[1].equals(parts[1])
