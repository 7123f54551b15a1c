"""The knowledge graph as vertex and edge tables: stores, statistics, traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut

# Bounds of the traversal.
MOST_HOPS, MOST_NEIGHBOURS, DEPTH = 3, 50, 3


def upsert(store: DataFrame, incoming: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """``store`` with the rows of ``incoming`` put in by ``key``, which must be unique in both.

    A row that comes in replaces the stored one, except that a null in one of
    the columns ``keep`` leaves what was stored.
    """
    values = [c for c in store.columns if c not in key]
    new = incoming.select(*key, F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in values))
    both = store.join(new, key, "full_outer")
    chosen = [F.when(F.col("_new"), F.coalesce(f"_{c}", c) if c in keep else F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values]
    return both.select(*key, *chosen)


def incoming_entities(mentions: DataFrame) -> DataFrame:
    """One entity for each (canonical_form, entity_type) of the mentions: its most confident mention, counted."""
    order = F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("far"), "chunk_idx", F.coalesce("char_pos", F.lit(-1)).alias("pos"), "name")
    row = F.struct("name", "confidence")
    found = mentions.groupBy("canonical_form", "entity_type").agg(F.min_by(row, order).alias("m"), F.count("*").alias("occurrences"))
    return found.select("canonical_form", "entity_type", "m.name", "m.confidence", "occurrences")


def upsert_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges (subject, predicate, object) whose ends are both stored; of repeated ones the last by chunk wins."""
    ends = entities.select("canonical_form", "entity_type").distinct()
    last = F.max(F.struct("chunk_idx", F.coalesce("confidence", F.lit(-1.0)).alias("_sure"), F.coalesce("evidence", F.lit("")).alias("evidence"), "confidence"))
    edges = relations.groupBy("subj_canonical", "subj_type", "predicate", "obj_canonical", "obj_type").agg(last.alias("r"))
    for side in ("subj", "obj"):
        edges = edges.join(ends.select(F.col("canonical_form").alias(f"{side}_canonical"), F.col("entity_type").alias(f"{side}_type")), [f"{side}_canonical", f"{side}_type"], "left_semi")
    return edges.select("subj_canonical", "subj_type", "predicate", "obj_canonical", "obj_type", "r.confidence", "r.chunk_idx", "r.evidence")


def link_mentions(mentions: DataFrame, chunks: DataFrame, entities: DataFrame, by_page: bool = False) -> DataFrame:
    """MENTIONS edges (chunk_idx, canonical_form, entity_type) with the last position and context of each.

    With ``by_page`` the edges go from (source, page) instead: the original
    store links an entity to every chunk of the page, which is these edges and
    the membership of chunks in pages, not expanded into pairs.
    """
    known = mentions.join(entities.select("canonical_form", "entity_type").distinct(), ["canonical_form", "entity_type"], "left_semi")
    at = ["source", "page"] if by_page else ["chunk_idx"]
    known = known.join(chunks.select("chunk_idx", *at).distinct() if by_page else chunks.select("chunk_idx"), "chunk_idx")
    position, context = F.coalesce("char_pos", F.lit(0)).alias("char_pos"), F.coalesce("context", F.lit("")).alias("context")
    last = F.max(F.struct("extracted_at", position, context))
    return known.groupBy(*at, "canonical_form", "entity_type").agg(last.alias("m")).select(*at, "canonical_form", "entity_type", "m.char_pos", "m.context")


def chunk_vertices(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (name), pages (source, page) and chunk vertices of graph rows; one document for each source."""
    documents = rows.select(F.col("source").alias("name")).distinct()
    pages = rows.select("source", "page").distinct()
    return documents, pages, rows.select("source", "page", "idx", "text", "heading", "image_path", "tags")


def statistics(entities: DataFrame, relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of counts."""
    counts = [df.agg(F.count("*").alias(name)) for df, name in ((entities, "n_entities"), (relations, "n_relations"), (chunks, "n_chunks"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each


def type_histogram(entities: DataFrame, k: int | None = None) -> DataFrame:
    """Entities by type, most frequent first; the first ``k`` types where given."""
    counts = entities.groupBy("entity_type").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "entity_type").limit(k) if k else counts


def edge_list(relations: DataFrame) -> DataFrame:
    """Both directions of each stored relation: (edge, from_form, from_type, to_form, to_type).

    ``edge`` is the identity of the relation; a relation of a vertex with itself
    stands once.
    """
    edge = F.struct("subj_canonical", "subj_type", "predicate", "obj_canonical", "obj_type").alias("edge")
    out = relations.select(edge, F.col("subj_canonical").alias("from_form"), F.col("subj_type").alias("from_type"), F.col("obj_canonical").alias("to_form"), F.col("obj_type").alias("to_type"))
    back = out.where((F.col("from_form") != F.col("to_form")) | (F.col("from_type") != F.col("to_type")))
    return out.unionByName(back.select("edge", F.col("to_form").alias("from_form"), F.col("to_type").alias("from_type"), F.col("from_form").alias("to_form"), F.col("from_type").alias("to_type")))


def _onward(ways: DataFrame, edges: DataFrame, last: bool) -> DataFrame:
    """``ways`` (seed, canonical_form, entity_type, trail) one edge further, none used twice; the trail isn't needed after the ``last``."""
    step = edges.select(F.col("from_form").alias("canonical_form"), F.col("from_type").alias("entity_type"), "edge", "to_form", "to_type")
    on = ways.join(step, ["canonical_form", "entity_type"]).where(~F.array_contains("trail", F.col("edge")))
    trail = F.array().cast(ways.schema["trail"].dataType) if last else F.sort_array(F.array_append("trail", F.col("edge")))
    return on.select("seed", F.col("to_form").alias("canonical_form"), F.col("to_type").alias("entity_type"), trail.alias("trail")).distinct()


def khop(seeds: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """(seed, canonical_form, entity_type, distance): what is reached from seeds over 1 to ``hops`` edges.

    ``seeds`` has seed, canonical_form, entity_type.  No edge is used twice on
    one way, vertices may be; a vertex appears once for each distance.  Between
    hops only what the rule needs is kept: the edges of the way.
    """
    hops = min(max(hops, 1), MOST_HOPS)
    ways = seeds.select("seed", "canonical_form", "entity_type", F.array().cast(f"array<{edges.schema['edge'].dataType.simpleString()}>").alias("trail"))
    found = None
    for hop in range(1, hops + 1):
        ways = _onward(ways, edges, last=hop == hops)
        here = ways.select("seed", "canonical_form", "entity_type", F.lit(hop).alias("distance"))
        found = here if found is None else found.unionByName(here)
    return found.distinct()


def neighbours(seeds: DataFrame, edges: DataFrame, entities: DataFrame, hops: int = 1, most: int = MOST_NEIGHBOURS) -> DataFrame:
    """The first ``most`` of ``khop`` by distance and importance (null first), with the rank of each.

    As distance ranks first, a seed that has ``most`` neighbours goes no hop
    further, so that hubs are not expanded for nothing.
    """
    hops, kind = min(max(hops, 1), MOST_HOPS), edges.schema["edge"].dataType.simpleString()
    known = entities.select("canonical_form", "entity_type", "importance_score")
    ways = seeds.select("seed", "canonical_form", "entity_type", F.array().cast(f"array<{kind}>").alias("trail"))
    reached = None
    for hop in range(1, hops + 1):
        ways = _onward(ways, edges, last=hop == hops)
        ways = cut(ways) if hop < hops else ways
        here = ways.select("seed", "canonical_form", "entity_type", F.lit(hop).alias("distance")).distinct().join(known, ["canonical_form", "entity_type"])
        reached = here if reached is None else reached.unionByName(here)
        if hop < hops:
            full = reached.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= most).select("seed")
            ways = ways.join(full, "seed", "left_anti")
    order = Window.partitionBy("seed").orderBy("distance", F.desc_nulls_first("importance_score"), "canonical_form", "entity_type")
    return reached.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def related(seeds: DataFrame, edges: DataFrame, entities: DataFrame, hops: int = 2, least: float = 0.0) -> DataFrame:
    """(canonical_form, entity_type, importance_score, place): neighbours of all seeds, each once, in the order of first finding."""
    near = neighbours(seeds, edges, entities, hops).where(F.coalesce("importance_score", F.lit(0.0)) >= least)
    first = near.groupBy("canonical_form", "entity_type").agg(F.min(F.struct("seed", "rank")).alias("first"), F.first("importance_score").alias("importance_score"))
    return first.select("canonical_form", "entity_type", "importance_score", F.col("first.seed").alias("seed"), F.col("first.rank").alias("rank"))


def _grown(level: DataFrame, step: DataFrame, seen: DataFrame, forward: bool) -> DataFrame:
    """The vertices one step beyond ``level`` (pair, at, path) that weren't ``seen``, each with the first of its ways."""
    path = F.array_append("path", F.col("next")) if forward else F.array_prepend("path", F.col("next"))
    on = level.join(step, "at").select("pair", F.col("next").alias("at"), path.alias("path"))
    return cut(on.groupBy("pair", "at").agg(F.min("path").alias("path")).join(seen, ["pair", "at"], "left_anti"))


def _joined(heads: DataFrame, tails: DataFrame, steps: list[DataFrame], degrees: list[DataFrame]) -> DataFrame:
    """(pair, path): the first way of each pair over one edge between its ``heads`` and its ``tails`` (pair, at, path).

    Whatever costs a pair least is done: to look up each head with each tail, or
    to follow the edges of the heads or those of the tails.  So no pair costs more
    than all edges, and a hub is expanded only where all else costs more.
    """
    sizes = [level.join(degree, "at").groupBy("pair").agg(F.count("*").alias(f"n{i}"), F.sum("degree").alias(f"d{i}")) for i, (level, degree) in enumerate(zip((heads, tails), degrees, strict=True))]
    least = F.least(F.col("n0") * F.col("n1"), "d0", "d1")
    how = F.when(F.col("n0") * F.col("n1") == least, 0).when(F.col("d0") == least, 1).otherwise(2)
    how = cut(sizes[0].join(sizes[1], "pair").select("pair", how.alias("how")))
    head, tail = (lambda way: heads.join(how.where(F.col("how") == way), "pair").select("pair", F.col("at").alias("head"))), (lambda way: tails.join(how.where(F.col("how") == way), "pair").select("pair", F.col("at").alias("tail")))
    edge, back = steps[0].select(F.col("at").alias("head"), F.col("next").alias("tail")), steps[1].select(F.col("at").alias("tail"), F.col("next").alias("head"))
    met = head(0).join(tail(0), "pair").join(edge, ["head", "tail"], "left_semi")
    met = met.unionByName(head(1).join(edge, "head").join(tail(1), ["pair", "tail"], "left_semi"))
    met = met.unionByName(tail(2).join(back, "tail").join(head(2), ["pair", "head"], "left_semi"))
    ways = met.join(heads.select("pair", F.col("at").alias("head"), F.col("path").alias("there")), ["pair", "head"]).join(tails.select("pair", F.col("at").alias("tail"), "path"), ["pair", "tail"])
    return cut(ways.groupBy("pair").agg(F.min(F.concat("there", "path")).alias("path")))


def shortest_paths(pairs: DataFrame, edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(pair, distance, path): one shortest undirected way for each of (pair, from_*, to_*) within ``depth``.

    Of equally short ways the first in the order of names is taken.  The search
    goes from both ends of all pairs together, by turns, and an edge joins what
    they have reached: up to three edges need one step from either end only.  A
    vertex that was reached keeps its first way only, and pairs that met stop.
    """
    vertex = lambda form, kind: F.struct(F.col(form).alias("form"), F.col(kind).alias("kind"))
    step = cut(edges.select(vertex("from_form", "from_type").alias("at"), vertex("to_form", "to_type").alias("next")).where("at <> next").distinct())
    steps = [step, step.select(F.col("next").alias("at"), F.col("at").alias("next"))]
    degrees = [cut(s.groupBy("at").agg(F.count("*").alias("degree"))) for s in steps]
    ends = cut(pairs.select("pair", vertex("from_form", "from_type").alias("start"), vertex("to_form", "to_type").alias("goal")).where("start <> goal"))
    levels = [ends.select("pair", F.col(end).alias("at"), F.array(end).alias("path")) for end in ("start", "goal")]
    seen, arrived = [level.select("pair", "at") for level in levels], None
    for length in range(1, depth + 1):
        if arrived is not None:
            levels = [level.join(arrived.select("pair"), "pair", "left_anti") for level in levels]
            side = length % 2
            levels[side] = _grown(levels[side], steps[side], seen[side], forward=not side)
            seen[side] = seen[side].unionByName(levels[side].select("pair", "at"))
        hit = _joined(*levels, steps, degrees).select("pair", F.lit(length).alias("distance"), "path")
        arrived = hit if arrived is None else arrived.unionByName(hit)
    return arrived.select("pair", "distance", F.array_join(F.transform("path", lambda v: v["form"]), " > ").alias("path"))


def subgraph(selected: DataFrame, relations: DataFrame, neighbours_too: bool = True) -> DataFrame:
    """(source, source_type, target, target_type, type, confidence): edges around or among the selected vertices.

    With neighbours, every edge at a selected vertex is seen from it, so that
    one between two of them stands in both directions.  Else only edges with
    both ends selected, as directed.
    """
    chosen = selected.select("canonical_form", "entity_type").distinct()
    subject = chosen.select(F.col("canonical_form").alias("subj_canonical"), F.col("entity_type").alias("subj_type"))
    object_ = chosen.select(F.col("canonical_form").alias("obj_canonical"), F.col("entity_type").alias("obj_type"))
    columns = lambda a, b: [F.col(f"{a}_canonical").alias("source"), F.col(f"{a}_type").alias("source_type"), F.col(f"{b}_canonical").alias("target"), F.col(f"{b}_type").alias("target_type"), F.col("predicate").alias("type"), "confidence"]
    out = relations.join(subject, ["subj_canonical", "subj_type"], "left_semi")
    if not neighbours_too:
        return out.join(object_, ["obj_canonical", "obj_type"], "left_semi").select(*columns("subj", "obj"))
    back = relations.join(object_, ["obj_canonical", "obj_type"], "left_semi")
    return out.select(*columns("subj", "obj")).unionByName(back.select(*columns("obj", "subj"))).distinct()


def subgraph_nodes(edges: DataFrame) -> DataFrame:
    """The vertices at the ends of a subgraph's edges, each once."""
    ends = [edges.select(F.col(e).alias("canonical_form"), F.col(f"{e}_type").alias("entity_type")) for e in ("source", "target")]
    return ends[0].union(ends[1]).distinct()


def entity_chunks(links: DataFrame, limit: int = 10) -> DataFrame:
    """(canonical_form, entity_type, chunk_idx, rank): the first ``limit`` chunks of each entity."""
    order = Window.partitionBy("canonical_form", "entity_type").orderBy("chunk_idx")
    ranked = links.select("canonical_form", "entity_type", "chunk_idx").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= limit)


def is_triples(texts: DataFrame, key: str) -> DataFrame:
    """(``key``, subj, pred, obj) of texts that have " is " once: the words on either side of it."""
    parts = F.split("text", " is ")
    words = lambda side: F.filter(F.split(side, r"\s+"), lambda w: w != "")
    cut = texts.where(F.size(parts) == 2).select(key, words(parts[0]).alias("_left"), words(parts[1]).alias("_right"))
    cut = cut.where((F.size("_left") > 0) & (F.size("_right") > 0))
    return cut.select(key, F.element_at("_left", -1).alias("subj"), F.lit("is").alias("pred"), F.col("_right")[0].alias("obj"))


def append_triples(triples: DataFrame, subject: Column, predicate: Column, object_: Column, rows: DataFrame) -> DataFrame:
    """A multigraph (subj, pred, obj) with an edge more for each of ``rows``; equal edges stand side by side."""
    return triples.select("subj", "pred", "obj").unionByName(rows.select(subject.alias("subj"), predicate.alias("pred"), object_.alias("obj")))


def successors(triples: DataFrame) -> DataFrame:
    """(subj, obj): what follows each vertex of a multigraph, each once."""
    return triples.select("subj", "obj").distinct()


def importance_or(confidence: Column, importance: Column) -> Column:
    """The importance of an entity; half its confidence where none was computed."""
    return F.coalesce(importance, confidence * 0.5)
