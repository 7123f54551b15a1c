"""Search helped by the knowledge graph, in four modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import graph, retrieval

# How the modes over-fetch, seed, expand and weigh.
ENTITY_WEIGHT, CENTRALITY_WEIGHT, LEAST_IMPORTANCE = 0.3, 0.2, 0.3
SEED_HITS, GUIDED, HYBRID, CHUNKS_EACH = 3, (10, 0.5), (8, 0.4), 2


def entity_texts(entities: DataFrame) -> DataFrame:
    """(chunk_idx, text) over entities: name, canonical form and description, keyed by entity_id."""
    text = F.concat_ws(" ", "name", "canonical_form", "description")
    return entities.select(F.col("entity_id").alias("chunk_idx"), text.alias("text"))


def find_entities(entities: DataFrame, terms: DataFrame, k: int = 10) -> DataFrame:
    """(entity_id, canonical_form, entity_type, score, rank): the entities whose text fits the query's terms best."""
    scores = retrieval.top(retrieval.bm25(entity_texts(entities), terms), "bm25", k)
    named = scores.select(F.col("chunk_idx").alias("entity_id"), F.col("bm25").alias("score"), "rank")
    return named.join(entities.select("entity_id", "canonical_form", "entity_type"), "entity_id")


def contains_entities(entities: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Entities whose name or canonical form holds the query as it stands; the first ``k`` by id."""
    held = F.col("name").contains(query) | F.col("canonical_form").contains(query)
    return entities.where(held).select("entity_id", "canonical_form", "entity_type", F.lit(1.0).alias("score")).orderBy("entity_id").limit(k)


def query_entities(entities: DataFrame, terms: DataFrame, query: DataFrame, by_text: int = 10, by_vector: int = 5) -> DataFrame:
    """(canonical_form, entity_type, score): found by text, and, if any were, also those nearest the query's vector."""
    named = find_entities(entities, terms, by_text).select("canonical_form", "entity_type", "score")
    vectors = entities.select(F.col("entity_id").alias("chunk_idx"), "embedding")
    near = retrieval.nearest(vectors, query, by_vector)
    near = near.join(entities.select(F.col("entity_id").alias("chunk_idx"), "canonical_form", "entity_type"), "chunk_idx").select("canonical_form", "entity_type", F.col("sem").alias("score"))
    near = near.join(named, ["canonical_form", "entity_type"], "left_anti").crossJoin(F.broadcast(named.agg(F.count("*").alias("_n")))).where("_n > 0").drop("_n")  # one row
    return named.unionByName(near)


def coverage(hits: DataFrame, links: DataFrame, asked: DataFrame) -> DataFrame:
    """(chunk_idx, coverage): which part of the query's entities a hit mentions, by lower form and type."""
    keys = asked.select(F.lower("canonical_form").alias("key"), "entity_type").distinct()
    total = keys.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    own = links.join(F.broadcast(hits.select("chunk_idx")), "chunk_idx").select("chunk_idx", F.lower("canonical_form").alias("key"), "entity_type").distinct()
    matched = own.join(F.broadcast(keys), ["key", "entity_type"]).groupBy("chunk_idx").agg(F.count("*").alias("n"))
    return matched.crossJoin(F.broadcast(total)).select("chunk_idx", (F.col("n") / F.col("total")).alias("coverage"))


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """The best ``k`` by score; equal scores keep their order, hits before what was added."""
    best = rows.orderBy(F.desc("score"), "place", "chunk_idx").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "place", "chunk_idx"))).select("chunk_idx", "sem", "bm25", "score", "rank")


def candidates(scores: DataFrame, k: int) -> DataFrame:
    """The first ``k`` chunks of ``hybrid_scores`` with their place from 1."""
    best = scores.orderBy(F.desc("score"), "chunk_idx").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_idx")))


def entity_aware(scores: DataFrame, links: DataFrame, asked: DataFrame, k: int = 5, weight: float = ENTITY_WEIGHT) -> DataFrame:
    """The best ``k`` of three times as many hits, raised by how many of the query's entities they mention."""
    hits = candidates(scores, 3 * k)
    raised = hits.join(coverage(hits, links, asked), "chunk_idx", "left")
    return _ranked(raised.withColumn("score", F.col("score") + F.coalesce("coverage", F.lit(0.0)) * weight), k)


def expansion(hits: DataFrame, links: DataFrame, edges: DataFrame, entities: DataFrame, hops: int, most: int) -> DataFrame:
    """(chunk_idx, relevance): chunks of the entities that are related to those of the first hits.

    The first ``most`` related entities of some importance give two chunks each;
    a chunk keeps the importance of the first of them.
    """
    seeds = links.join(F.broadcast(hits.where(F.col("place") <= SEED_HITS)), "chunk_idx").groupBy("canonical_form", "entity_type").agg(F.min(F.struct("place", "canonical_form", "entity_type")).alias("seed"))
    seeds = seeds.select("seed", "canonical_form", "entity_type")
    found = graph.related(seeds, edges, entities, hops, LEAST_IMPORTANCE)
    first = found.orderBy("seed", "rank").limit(most).withColumn("place", F.row_number().over(Window.orderBy("seed", "rank")))
    chunks = graph.entity_chunks(links.join(F.broadcast(first.select("canonical_form", "entity_type")), ["canonical_form", "entity_type"]), CHUNKS_EACH)
    return chunks.join(first, ["canonical_form", "entity_type"]).groupBy("chunk_idx").agg(F.min_by("importance_score", "place").alias("relevance"))


def graph_guided(scores: DataFrame, links: DataFrame, edges: DataFrame, entities: DataFrame, k: int = 5, hops: int = 2) -> DataFrame:
    """The best ``k`` of the hits and of the chunks of related entities, which score half their importance."""
    hits = candidates(scores, k)
    most, part = GUIDED
    added = expansion(hits, links, edges, entities, hops, most).join(hits.select("chunk_idx"), "chunk_idx", "left_anti")
    pseudo = (F.col("relevance") * part).alias("score")
    added = added.select("chunk_idx", (F.col("relevance") * part).alias("sem"), F.lit(0.0).alias("bm25"), pseudo, F.lit(1 << 30).alias("place"))
    return _ranked(hits.unionByName(added), k)


def hybrid(scores: DataFrame, links: DataFrame, edges: DataFrame, entities: DataFrame, asked: DataFrame, k: int = 5, hops: int = 2, weight: float = ENTITY_WEIGHT, central: float = CENTRALITY_WEIGHT) -> DataFrame:
    """The best ``k`` of four times as many hits, raised by coverage and by the number of entities they mention, and of the chunks of related entities."""
    hits = candidates(scores, 4 * k)
    counts = links.join(F.broadcast(hits.select("chunk_idx")), "chunk_idx").groupBy("chunk_idx").agg(F.least(F.lit(1.0), F.count("*") / 5.0).alias("centrality"))
    raised = hits.join(coverage(hits, links, asked), "chunk_idx", "left").join(counts, "chunk_idx", "left")
    score = F.col("score") + F.coalesce("coverage", F.lit(0.0)) * weight + F.coalesce("centrality", F.lit(0.0)) * central
    raised = raised.select("chunk_idx", "sem", "bm25", score.alias("score"), "place")
    most, part = HYBRID
    added = expansion(hits, links, edges, entities, hops, most).join(hits.select("chunk_idx"), "chunk_idx", "left_anti")
    added = added.select("chunk_idx", (F.col("relevance") * part).alias("sem"), F.lit(0.0).alias("bm25"), (F.col("relevance") * part).alias("score"), F.lit(1 << 30).alias("place"))
    return _ranked(raised.unionByName(added), k)


def search(mode: str, scores: DataFrame, links: DataFrame, edges: DataFrame, entities: DataFrame, asked: DataFrame, k: int = 5, hops: int = 2) -> DataFrame:
    """The mode by name; an unknown one is a plain search."""
    if mode == "entity_aware":
        return entity_aware(scores, links, asked, k)
    if mode == "graph_guided":
        return graph_guided(scores, links, edges, entities, k, hops)
    if mode == "hybrid":
        return hybrid(scores, links, edges, entities, asked, k, hops)
    return _ranked(candidates(scores, k), k)


def result_entities(hits: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """(canonical_form, entity_type, description, confidence, importance, place): the entities of hits, each once, in the order of hits."""
    own = links.join(F.broadcast(hits.select("chunk_idx", "rank")), "chunk_idx").groupBy("canonical_form", "entity_type").agg(F.min("rank").alias("place"))
    known = own.join(entities.select("canonical_form", "entity_type", "description", "confidence", "importance_score"), ["canonical_form", "entity_type"])
    return known.select("canonical_form", "entity_type", "description", "confidence", graph.importance_or(F.col("confidence"), F.col("importance_score")).alias("importance"), "place")
