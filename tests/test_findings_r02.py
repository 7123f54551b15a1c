"""Batches of searches and of ways that keep no more than their results, against plain counting."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph, retrieval
from corpusloom.plans import catalogue
from tests.compare import DATA


def corpus(spark, many=120):
    some = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    texts = [(i, " ".join(some.choice(words[: 1 + i % 30]) for _ in range(some.randrange(9)))) for i in range(many)]
    asked = [(i, " ".join(some.choice([*words, "none"]) for _ in range(1 + i % 4))) for i in range(25)]
    return spark.createDataFrame(texts, "chunk_idx long, text string"), spark.createDataFrame(asked, "query_id long, query string")


def kept(monkeypatch, module):
    """A list that gets the number of rows of all that ``module`` keeps."""
    rows, real = [], module.cut

    def counted(df):
        done = real(df)
        rows.append(done.count())
        return done

    monkeypatch.setattr(module, "cut", counted)
    return rows


@pytest.mark.parametrize("block", [1 << 18, 11])
def test_bm25_best_is_the_top_of_all_scores(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "WEIGHT_BLOCK", block)
    monkeypatch.setattr(retrieval, "PAIR_BLOCK", 200)
    texts, asked = corpus(spark)
    terms = retrieval.query_terms(asked)
    want = retrieval.top(retrieval.bm25(texts, terms).withColumn("bm25", F.round("bm25", 9)), "bm25")
    assert sorted(map(tuple, retrieval.bm25_best(texts, terms).collect())) == sorted(map(tuple, want.select("query_id", "chunk_idx", "bm25", "rank").collect()))
    assert retrieval.bm25_best(texts.limit(0), terms).count() == retrieval.bm25_best(texts, terms.limit(0)).count() == 0


def test_a_batch_keeps_no_postings(spark, monkeypatch):
    rows, postings = kept(monkeypatch, retrieval), retrieval.term_counts(catalogue._texts(spark, DATA)).count()
    catalogue.QUERIES["bm25_batch"](spark, DATA).collect()
    assert rows and max(rows) < postings / 4


def test_a_term_that_weighs_nothing_still_counts(spark):
    texts = spark.createDataFrame([(0, "a b"), (1, "a"), (2, "b c"), (3, "d")], "chunk_idx long, text string")
    terms = retrieval.query_terms(spark.createDataFrame([(7, "a")], "query_id int, query string"))
    assert [(r.query_id, r.chunk_idx, r.bm25, r["rank"]) for r in retrieval.bm25_best(texts, terms).collect()] == [(7, 0, 0.0, 1), (7, 1, 0.0, 2)]  # a stands in half of the texts


RELATION = "subj_canonical string, subj_type string, predicate string, obj_canonical string, obj_type string"
PAIR = "pair long, from_form string, from_type string, to_form string, to_type string"


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_ways_from_both_ends_are_the_first_of_the_shortest(spark, depth):
    some = random.Random(3)
    names = [f"v{some.randrange(1000):03}" for _ in range(40)]
    told = [(some.choice(names), some.choice(names)) for _ in range(45)] + [("v-hub", n) for n in names[:12]] + [(names[0], names[0])]
    beside = {}
    for a, b in told:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    asked = [(i, some.choice(names), some.choice([*names, "v-hub", "nowhere"])) for i in range(60)] + [(60, names[0], names[0])]

    def first(a, b):
        ways = [[a]]
        for hop in range(1, depth + 1):
            ways = [w + [n] for w in ways for n in beside.get(w[-1], ()) if n not in w]
            if found := [w for w in ways if w[-1] == b]:
                return hop, " > ".join(min(found))
        return None

    edges = graph.edge_list(spark.createDataFrame([(a, "E", "r", b, "E") for a, b in told], RELATION))
    pairs = spark.createDataFrame([(i, a, "E", b, "E") for i, a, b in asked], PAIR)
    got = {r.pair: (r.distance, r.path) for r in graph.shortest_paths(pairs, edges, depth).collect()}
    assert got == {i: way for i, a, b in asked if (way := first(a, b))}


def test_ways_beside_a_hub_do_not_reach_all_of_its_neighbours(spark, monkeypatch):
    rows, leaves = kept(monkeypatch, graph), 400
    told = [("hub", f"leaf{i}") for i in range(leaves)] + [("leaf0", "x"), ("leaf1", "y")]
    pairs = spark.createDataFrame([(i, f"leaf{i}", "E", "x" if i % 2 else "y", "E") for i in range(2, 42)], PAIR)
    found = graph.shortest_paths(pairs, graph.edge_list(spark.createDataFrame([(a, "E", "r", b, "E") for a, b in told], RELATION))).collect()
    assert {(r.pair, r.distance, r.path) for r in found} == {(i, 3, f"leaf{i} > hub > leaf{i % 2 ^ 1} > {'x' if i % 2 else 'y'}") for i in range(2, 42)}
    assert max(rows) <= 2 * len(told)  # not pairs by leaves


@pytest.mark.parametrize("block", [1 << 18, 11])
def test_a_batch_of_hybrid_searches_is_that_of_single_ones(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "WEIGHT_BLOCK", block)
    monkeypatch.setattr(retrieval, "PAIR_BLOCK", 200)
    texts, asked = corpus(spark)
    some = np.random.default_rng(5)
    odd = {3: None, 4: [0.0] * 4, 5: [float("nan"), 1.0, 0.0, 0.0], 6: [None, 1.0, 0.0, 0.0]}
    vectors = spark.createDataFrame([(i, odd.get(i, some.normal(size=4).round(1).tolist())) for i in range(110)], "chunk_idx long, embedding array<double>")  # the last ten have none
    queries = spark.createDataFrame([(i, odd.get(i, some.normal(size=4).round(1).tolist())) for i in range(25)] + [(99, [1.0, 0.0, 0.0, 0.0])], "query_id long, vector array<double>")
    terms = retrieval.query_terms(asked)
    got = sorted(map(tuple, retrieval.hybrid_batch(texts, vectors, queries, terms).select("query_id", "rank", "chunk_idx", "score", "sem", "bm25").collect()))
    sem = vectors.join(queries, how="cross").select("query_id", "chunk_idx", F.round(retrieval.cosine(F.col("embedding"), F.col("vector")), 9).alias("sem"))
    every = queries.select("query_id").join(texts.select("chunk_idx"), how="cross").join(sem, ["query_id", "chunk_idx"], "left").join(retrieval.bm25(texts, terms), ["query_id", "chunk_idx"], "left").na.fill(0.0)
    ends = every.groupBy("query_id").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("sem", "bm25") for f in (F.min, F.max)))
    mixed = every.join(ends, "query_id")
    parts = [retrieval.scaled(F.col(c), F.col(f"min_{c}"), F.col(f"max_{c}")) for c in ("sem", "bm25")]
    want = retrieval.top(mixed.withColumn("score", F.round(0.6 * parts[0] + 0.4 * parts[1], 9)), "score").select("query_id", "rank", "chunk_idx", "score", "sem", "bm25")
    want = sorted(map(tuple, want.collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want] and len(got) == 26 * 5
    assert np.allclose([r[3:] for r in got], [r[3:] for r in want], atol=1e-8)


def test_a_batch_of_hybrid_searches_keeps_no_pairs(spark, monkeypatch):
    rows, postings = kept(monkeypatch, retrieval), retrieval.term_counts(catalogue._texts(spark, DATA)).count()
    catalogue.QUERIES["hybrid_batch"](spark, DATA).collect()
    assert rows and max(rows) < postings / 4
