"""Models as plug-ins, with deterministic stand-ins that need no files.

A text encoder maps an array of texts to an array of unit vectors; a recogniser
maps a text to spans; a captioner maps paths to captions; an answerer maps
prompts to answers.  Each is a function from Column to Column, so that a real
model takes the place of a stand-in as an Arrow UDF that loads it once a worker.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Length of the stand-in's vectors.
DIMENSIONS = 64
VECTORS = T.ArrayType(T.ArrayType(T.DoubleType()))
SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("label", T.StringType())]))


@lru_cache(500_000)
def _place(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % DIMENSIONS


def hash_vectors(texts: list[str | None]) -> np.ndarray:
    """A row for each text: its bag of hashed lower-case words at length 1; zeros for a text without words."""
    words = [(t or "").lower().split() for t in texts]
    row = np.repeat(np.arange(len(words)), [len(own) for own in words])
    at = np.fromiter((_place(w) for own in words for w in own), np.int64, len(row))
    counts = np.bincount(row * DIMENSIONS + at, minlength=len(words) * DIMENSIONS).reshape(len(words), DIMENSIONS).astype(np.float64)
    size = np.sqrt((counts * counts).sum(1, keepdims=True))
    return counts / np.where(size > 0, size, 1)


@F.arrow_udf(VECTORS)
def hash_encoder(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The stand-in for a text encoder, over arrays of texts; null gives null."""
    for batch in texts:
        made = hash_vectors(batch.flatten().to_pylist())
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * DIMENSIONS, pa.int32()), pa.array(made.ravel()))
        ends = np.append(0, np.cumsum(batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, mask=batch.is_null())


def text_encoder(model: Callable[[list[str]], np.ndarray]):
    """A Column function from an encoder that maps a list of texts to a matrix of unit rows."""

    @F.pandas_udf(VECTORS)
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda said: None if said is None else [list(map(float, row)) for row in model(list(said))] if len(said) else [])

    return encode


def text_model(model: Callable[[list[str]], list[str]]):
    """A Column function from a model that maps strings to strings (captions of paths, answers to prompts).

    Where a batch fails its items are tried one by one, and only those that
    fail again give the empty string, as the pipeline goes on without them.
    """

    def single(item: str) -> str:
        try:
            return model([item])[0]
        except Exception:
            return ""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            items = batch.fillna("").tolist()
            try:
                said = list(model(items))
            except Exception:
                said = [single(x) for x in items]
            yield pd.Series(said if len(said) == len(items) else [single(x) for x in items], dtype=object)

    return run


def span_model(model: Callable[[list[str]], list[list[tuple[int, int, str]]]]):
    """A Column function from a recogniser that maps texts to lists of (first, last, label) spans.

    A text on which the recogniser fails has none.
    """

    def single(text: str) -> list[tuple[int, int, str]]:
        try:
            return model([text])[0]
        except Exception:
            return []

    @F.pandas_udf(SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.fillna("").tolist()
            try:
                found = model(texts)
            except Exception:
                found = [single(t) for t in texts]
            yield pd.Series([[{"first": int(a), "last": int(b), "label": label} for a, b, label in own] for own in found])

    return run


def pattern_spans(patterns: dict[str, str]) -> Callable[[list[str]], list[list[tuple[int, int, str]]]]:
    """The stand-in for a recogniser: spans of one pattern for each label, in its order."""
    compiled = [(label, re.compile(pattern, re.ASCII)) for label, pattern in patterns.items()]
    return lambda texts: [[(m.start(), m.end(), label) for label, pattern in compiled for m in pattern.finditer(t)] for t in texts]


def needed_setting(name: str) -> str:
    """The value of an environment variable that a model can't do without."""
    value = os.environ.get(name)
    if not value:
        raise RuntimeError(f"{name} is not set")
    return value


def echo(prompt: Column) -> Column:
    """The stand-in for an answering model: the first line after the question mark of the prompt's layout."""
    return F.regexp_extract(prompt, r"### Question\n([^\n]*)", 1)


def caption_text(reply: Column) -> Column:
    """A captioner's reply without what leads it and without image marks."""
    own = F.regexp_replace(reply, r"(?s)^.*?Caption:", "")
    return F.trim(F.regexp_replace(F.replace(own, F.lit("<!-- image -->"), F.lit("")), r"^\s+|\s+$", ""))
