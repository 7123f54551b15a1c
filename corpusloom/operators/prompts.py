"""Prompts as one string, put together from hits, entities and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The wording and the bounds of the prompts.
CITATION_HEAD = "You are a retrieval QA system. Use ONLY the provided contexts to answer.\nFor every factual statement, add an inline citation in the form [file:{source}, page:{page}, heading:{heading}]"
NO_IMAGE = ".\n"
WITH_IMAGE = " and include image link when available as [image:{image_path}].\n"
UNKNOWN = "If something is not in the contexts, say you don't know.\n\n"
KG_HEAD = (
    "You are a retrieval QA system with access to a knowledge graph. Use ONLY the provided contexts, entities, and relationships to answer.\n"
    "For every factual statement, add an inline citation in the form [file:{source}, page:{page}, heading:{heading}].\n"
    "When referencing entities, use the format [entity:{entity_name}].\n"
)
ENTITY_HEAD = "You are answering a question about specific entities using information from documents.\nProvide accurate information with citations.\n\n"
MOST_ENTITIES, MOST_EDGES, MOST_PAIRS, MOST_DRAWN, MOST_NAMES, MOST_CHUNKS, MOST_RELATIONS, EXCERPT = 10, 15, 5, 10, 5, 3, 10, 200


def heading(column: str = "heading") -> Column:
    """The heading of a chunk, N/A without one."""
    return F.when(F.coalesce(column, F.lit("")) == "", "N/A").otherwise(F.col(column))


def preview(text: Column, length: int = 180) -> Column:
    """The first characters on one line, dots where something follows."""
    first = F.replace(F.substring(text, 1, length), F.lit("\n"), F.lit(" "))
    return F.when(F.length(text) > length, F.concat(first, F.lit("..."))).otherwise(first)


def _joined(rows: DataFrame, text: Column, order: str, between: str = "\n") -> DataFrame:
    """One row with ``text`` of all rows in order; empty for no rows."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"])
    return rows.agg(F.array_join(parts, between).alias("text"))


def _block(content: Column, *lines: Column) -> Column:
    head = F.concat(F.lit("### Context "), F.col("rank"), F.lit("\nSource: file="), F.col("source"), F.lit(", page="), F.col("page"), F.lit(", heading="), heading(), F.lit("\n"))
    return F.concat(head, *lines, content, F.lit("\n"))


def _image_line() -> Column:
    return F.when(F.coalesce("image_path", F.lit("")) != "", F.concat(F.lit("Image: "), F.col("image_path"), F.lit("\n"))).otherwise("")


def _question(query: str, about: str = "Answer (with citations)") -> str:
    return f"### Question\n{query}\n\n### {about}:\n"


def citation_prompt(query: str, hits: DataFrame, image_links: bool = True) -> DataFrame:
    """One row (prompt) from hits with rank and the columns of a chunk.

    With ``image_links`` an image's path stands on its own line before its
    caption; without, an image's content is its path.
    """
    if image_links:
        block = _block(F.coalesce("text", F.lit("")), _image_line())
    else:
        image = F.concat(F.lit("[Image at "), F.col("image_path"), F.lit("]"))
        block = _block(F.when(F.col("modality") == "text", F.col("text")).otherwise(F.coalesce(image, F.lit(""))))
    head = CITATION_HEAD + (WITH_IMAGE if image_links else NO_IMAGE) + UNKNOWN
    return _joined(hits, block, "rank").select(F.concat(F.lit(head), "text", F.lit("\n" + _question(query))).alias("prompt"))


def entity_section(entities: DataFrame, most: int = MOST_ENTITIES) -> DataFrame:
    """One row (text): the most confident entities, ties in the order of ``place``; empty for none."""
    best = entities.orderBy(F.desc_nulls_last("confidence"), "place", "canonical_form", "entity_type").limit(most)
    best = best.withColumn("o", F.row_number().over(Window.orderBy(F.desc_nulls_last("confidence"), "place", "canonical_form", "entity_type")))
    told = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), F.col("description"))).otherwise("")
    line = F.concat(F.lit("- **"), F.col("canonical_form"), F.lit("** ("), F.col("entity_type"), F.lit(")"), told)
    return _joined(best, line, "o").select(F.when(F.col("text") == "", "").otherwise(F.concat(F.lit("### Key Entities\n\n"), "text", F.lit("\n"))).alias("text"))


def numbered_edges(edges: DataFrame, most: int) -> DataFrame:
    """The first edges in the order of names with their number from 1."""
    order = ["source", "source_type", "type", "target", "target_type"]
    return edges.orderBy(*order).limit(most).withColumn("o", F.row_number().over(Window.orderBy(*order)))


def relationship_section(edges: DataFrame) -> DataFrame:
    """One row (text): the first edges by type, five pairs of each; empty for none."""
    first = numbered_edges(edges, MOST_EDGES)
    own = Window.partitionBy("type").orderBy("o")
    some = first.withColumns({"n": F.row_number().over(own), "start": F.min("o").over(Window.partitionBy("type"))}).where(F.col("n") <= MOST_PAIRS)
    pair = F.concat(F.lit("  - "), F.col("source"), F.lit(" → "), F.col("target"))
    pairs = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", pair.alias("t")))), lambda x: x["t"]), "\n")
    groups = some.groupBy("type", "start").agg(pairs.alias("pairs"))
    text = F.concat(F.lit("\n**"), F.col("type"), F.lit("**:\n"), F.col("pairs"))
    return _joined(groups, text, "start").select(F.when(F.col("text") == "", "").otherwise(F.concat(F.lit("### Entity Relationships\n\n"), "text", F.lit("\n"))).alias("text"))


def drawn(edges: DataFrame, compact: bool = True) -> DataFrame:
    """One row (text): the graph line by line, with vertices and confidences unless ``compact``."""
    if compact:
        line = F.concat(F.col("source"), F.lit(" --["), F.col("type"), F.lit("]-> "), F.col("target"))
        return _joined(numbered_edges(edges, MOST_DRAWN), line, "o")
    ends = edges.select(F.col("source").alias("form"), F.col("source_type").alias("kind")).union(edges.select("target", "target_type")).distinct()
    nodes = ends.orderBy("form", "kind").limit(MOST_DRAWN).withColumn("o", F.row_number().over(Window.orderBy("form", "kind")))
    listed = _joined(nodes, F.concat(F.lit("  - "), F.col("form"), F.lit(" ("), F.col("kind"), F.lit(")")), "o").withColumnRenamed("text", "nodes")
    sure = F.format_string("%.2f", F.coalesce("confidence", F.lit(0.0)))
    line = F.concat(F.lit("  - "), F.col("source"), F.lit(" --["), F.col("type"), F.lit(", "), sure, F.lit("]-> "), F.col("target"))
    tied = _joined(numbered_edges(edges, MOST_EDGES), line, "o")
    return listed.crossJoin(tied).select(F.concat(F.lit("Nodes:\n"), "nodes", F.lit("\n\nConnections:\n"), "text").alias("text"))


def kg_prompt(query: str, hits: DataFrame, links: DataFrame, entities: DataFrame, edges: DataFrame, graph_too: bool = False) -> DataFrame:
    """One row (prompt): entities, relationships, the graph if asked for, then the contexts with their entities' names."""
    named = links.join(F.broadcast(hits.select("chunk_idx")), "chunk_idx").groupBy("chunk_idx").agg(F.slice(F.sort_array(F.collect_set("canonical_form")), 1, MOST_NAMES).alias("names"))
    own = hits.join(named, "chunk_idx", "left")
    names = F.when(F.size(F.coalesce("names", F.array().cast("array<string>"))) > 0, F.concat(F.lit("Entities: "), F.array_join("names", ", "), F.lit("\n"))).otherwise("")
    contexts = _joined(own, _block(F.coalesce("text", F.lit("")), names, _image_line()), "rank").withColumnRenamed("text", "contexts")
    sections = entity_section(entities).withColumnRenamed("text", "who").crossJoin(relationship_section(edges).withColumnRenamed("text", "ties"))
    if graph_too:
        sections = sections.crossJoin(drawn(edges).select(F.when(F.col("text") != "", F.concat(F.lit("### Knowledge Graph\n```\n"), "text", F.lit("\n```\n"))).alias("picture")))
    else:
        sections = sections.withColumn("picture", F.lit(None).cast("string"))
    parts = F.array(*(F.when(F.col(c) != "", F.col(c)) for c in ("who", "ties", "picture")), F.col("contexts"))
    body = F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n")
    return sections.crossJoin(contexts).select(F.concat(F.lit(KG_HEAD + UNKNOWN), body, F.lit("\n" + _question(query))).alias("prompt"))


def entity_prompt(query: str, entities: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (prompt) about (canonical_form, entity_type, description, place), with chunks (canonical_form, rank, source, page, text) of each."""
    told = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), F.col("description"))).otherwise("")
    who = _joined(entities, F.concat(F.lit("**"), F.col("canonical_form"), F.lit("** ("), F.col("entity_type"), F.lit(")"), told), "place").withColumnRenamed("text", "who")
    tied = _joined(numbered_edges(edges, MOST_RELATIONS), F.concat(F.lit("- "), F.col("source"), F.lit(" "), F.col("type"), F.lit(" "), F.col("target")), "o").withColumnRenamed("text", "ties")
    line = F.concat(F.col("rank"), F.lit(". ["), F.col("source"), F.lit(", p."), F.col("page"), F.lit("]: "), F.substring(F.coalesce("text", F.lit("")), 1, EXCERPT), F.lit("..."))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("t")))), lambda x: x["t"]), "\n")
    about = chunks.where(F.col("rank") <= MOST_CHUNKS).groupBy("canonical_form").agg(lines.alias("lines"))
    about = entities.select("canonical_form", "place").join(about, "canonical_form")
    told = _joined(about, F.concat(F.lit("\n**About "), F.col("canonical_form"), F.lit(":**\n\n"), F.col("lines")), "place").withColumnRenamed("text", "told")
    section = lambda title, c: F.when(F.col(c) != "", F.concat(F.lit(f"### {title}\n\n"), F.col(c), F.lit("\n")))
    parts = F.array(section("Entities in Question", "who"), section("Known Relationships", "ties"), F.concat(F.lit("### Relevant Information\n\n"), F.col("told"), F.lit("\n")))
    body = F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n")
    return who.crossJoin(tied).crossJoin(told).select(F.concat(F.lit(ENTITY_HEAD), body, F.lit(_question(query, "Answer"))).alias("prompt"))
