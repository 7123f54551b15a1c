"""Skip-gram vectors with negative samples, trained in Spark.

The loss depends on the corpus through counts of word pairs only.  These stay a
table with one row for each word (the bag of its contexts); words and contexts
are fitted by turns, each word's vector in the task that holds its bag, against
the vectors of the other side, which are sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of a vector; negative samples to a pair; contexts that they are drawn from for one word, if there are more.
DIMENSIONS, NEGATIVES, DRAWN = 32, 5.0, 1024
#: Turns of both sides; steps for one vector in a turn; weight of the prior that holds rare words near zero.
ROUNDS, STEPS, PRIOR = 4, 3, 1.0


class Side:
    """The vectors of one side, and how often each is drawn as a negative sample."""

    def __init__(self, vectors: np.ndarray, often: np.ndarray):
        self.vectors = vectors
        noise = np.maximum(often, 0.0) ** 0.75
        self.noise = noise / noise.sum() if noise.any() else np.full(len(noise), 1 / max(1, len(noise)))
        self.summed = np.cumsum(self.noise)

    def fit(self, contexts: np.ndarray, counts: np.ndarray, start: np.ndarray, seed: int) -> np.ndarray:
        """The vector of a word that has these contexts of this side, by Newton's steps from ``start``."""
        total = counts.sum()
        if len(self.noise) <= DRAWN:
            against, weight = self.vectors, NEGATIVES * total * self.noise
        else:
            drawn = np.searchsorted(self.summed, np.random.default_rng(seed).random(DRAWN) * self.summed[-1])
            against, weight = self.vectors[np.minimum(drawn, len(self.noise) - 1)], np.full(DRAWN, NEGATIVES * total / DRAWN)
        near, x = self.vectors[contexts], start.astype(np.float64)
        for _ in range(STEPS):
            p, q = 1 / (1 + np.exp(-np.clip(near @ x, -30, 30))), 1 / (1 + np.exp(-np.clip(against @ x, -30, 30)))
            slope = near.T @ (counts * (p - 1)) + against.T @ (weight * q) + PRIOR * x
            bend = (near * (counts * p * (1 - p))[:, None]).T @ near + (against * (weight * q * (1 - q))[:, None]).T @ against + PRIOR * np.eye(len(x))
            step = np.linalg.solve(bend, slope)
            x -= step * min(1.0, 2.0 / max(1e-9, float(np.linalg.norm(step))))
        return x


def bags(pairs: DataFrame, by: str) -> DataFrame:
    """(``by``, contexts, counts) from (``by``, context, pairs): at most one entry for each word of the vocabulary."""
    both = F.sort_array(F.collect_list(F.struct("context", "pairs")))
    return pairs.groupBy(by).agg(both.alias("both")).select(by, F.col("both.context").alias("contexts"), F.col("both.pairs").alias("counts"))


def train(own: DataFrame, size: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors of words, vectors of contexts, pairs of each word) of a vocabulary of ``size``, from its ``bags`` by word.

    Pairs must stand in both directions.  The matrices have ``size`` rows; what
    lies between is the table of bags, which stays in Spark.
    """
    spark = own.sparkSession
    rng = np.random.default_rng(seed)
    often = np.zeros(size)
    for r in own.select("word", F.aggregate("counts", F.lit(0.0), lambda s, x: s + x).alias("n")).collect():  # a row a word
        often[r["word"]] = r["n"]
    sides = [rng.normal(0, 0.3, (size, DIMENSIONS)) for _ in range(2)]
    for turn in range(2 * ROUNDS):
        fixed = spark.sparkContext.broadcast((Side(sides[(turn + 1) % 2], often), sides[turn % 2]))

        def fitted(batches: Iterator[pd.DataFrame], fixed=fixed, turn=turn) -> Iterator[pd.DataFrame]:
            side, start = fixed.value
            for batch in batches:
                rows = zip(batch["word"], batch["contexts"], batch["counts"], strict=True)
                vectors = [side.fit(np.asarray(c), np.asarray(n, np.float64), start[w], seed * 1_000_003 + turn * 101 + w) for w, c, n in rows]
                yield pd.DataFrame({"word": batch["word"], "vector": [v.tobytes() for v in vectors]})

        for r in own.mapInPandas(fitted, "word int, vector binary").collect():  # a row a word
            sides[turn % 2][r["word"]] = np.frombuffer(r["vector"])
        fixed.destroy()
    return sides[0], sides[1], often
