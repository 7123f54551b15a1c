"""Problem 6: ids of texts under a public byte-level BPE vocabulary.

Texts are cut into words by the vocabulary's pattern.  The distinct words of a
batch lie as symbols in one flat array; each round finds all neighbouring
pairs by binary search over the sorted keys of the merges and joins, in every
word at once, the pair of lowest rank.  All occurrences of a pair in a word are
joined in one round: a merge of lower rank can't arise from it, as the symbol
that it makes is younger.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabulary files; a parameter of each query.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: the pattern of words of this family of vocabularies.
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker remembers at most; then it starts anew.
REMEMBERED = 400_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself if it is drawn, else one from 256 on."""
    drawn = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b) if b in drawn else chr(spare))
        spare += b not in drawn
    return letters


class Vocabulary:
    """Merges of a byte-level BPE vocabulary as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        words, model = whole.get("pre_tokenizer") or {}, whole["model"]
        if whole.get("normalizer") or words.get("type") != "ByteLevel" or not words.get("use_regex", True) or words.get("add_prefix_space"):
            raise ValueError(f"{path} cuts texts into other words than a plain byte-level vocabulary")
        ids = model["vocab"]
        self.byte_id = np.array([ids[c] for c in _byte_letters()], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.base = max(ids.values()) + 1
        keys = np.array([ids[a] * self.base + ids[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        self.none = len(merges)
        self.words = regex.compile(PATTERN)
        self.known: dict[str, np.ndarray] = {}

    def _encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of many words, merged in rounds over one flat array."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        symbol = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            key = symbol[:-1] * self.base + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.rank[at], self.none)
            rank = np.append(rank, self.none)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(word)))
            best = np.repeat(lowest, length)
            open_ = best < self.none
            if not open_.all():  # words without a pair left are finished
                done.append((word[~open_], symbol[~open_]))
                symbol, word, rank, best = symbol[open_], word[open_], rank[open_], best[open_]
                if not len(symbol):
                    break
            joins = rank == best
            # of overlapping occurrences (a a a) the 1st, 3rd, ... of the run are joined
            place = np.arange(len(joins))
            run = place - np.maximum.accumulate(np.where(joins, -1, place))
            left = np.flatnonzero(joins & (run % 2 == 1))
            symbol[left] = self.made[rank[left]]
            keep = np.ones(len(symbol), bool)
            keep[left + 1] = False
            symbol, word = symbol[keep], word[keep]
        of, ids = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(of, kind="stable")
        return np.split(ids[order].astype(np.int32), np.searchsorted(of[order], np.arange(1, len(raw))))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; none for null and empty ones."""
        cut = [self.words.findall(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w for words in cut for w in words if w not in self.known})
        if new:
            self.known.update(zip(new, self._encode_words(new), strict=True))
        none = np.zeros(0, np.int32)
        return [np.concatenate([self.known[w] for w in words]) if words else none for words in cut]


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker and file."""
    return Vocabulary(path)


def encode(df: DataFrame, text: str = "text", out: str = "ids", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """``df`` with the list of token ids of one text column added as ``out``, without special tokens.

    Null and empty texts both have the empty list.  Every row and all other
    columns stay; a column that already has the name ``out`` is replaced.
    ``folder`` holds ``<name>.json`` on every executor; a vocabulary that changes
    texts first, or cuts them into words by a pattern of its own, is an error.
    """
    path = f"{folder}/{name}.json"
    base = df.drop(out)
    schema = T.StructType([*base.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            ids = v.encode_batch(batch.column(text).to_pylist())
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, out])

    return base.mapInArrow(run, schema)


def token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """``df`` with the number of tokens of one text column; the text itself is dropped."""
    return encode(df, text, "_ids", name, folder).withColumn(out, F.size("_ids")).drop("_ids", text)
