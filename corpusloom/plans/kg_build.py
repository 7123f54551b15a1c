"""Building the knowledge graph: extract, resolve, re-point, enrich, store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import config
from corpusloom.operators import extraction, graph
from corpusloom.session import cut
from corpusloom.sources import cache

# Mentions a chunk needs before a model reads it, how much of a text it reads, and how many hints the long and the short request give.
GATE, READ_CHARS, HINTS, BRIEF_HINTS = 3, 2000, 10, 5
REQUEST = (
    "Extract entities and relations from the text.\nEntity types: {types}\nKnown candidates: {hints}\n\nText:\n{text}\n\n"
    'Answer with JSON only: {{"entities": [{{"name", "canonical", "type", "confidence", "description"}}], "relations": [{{"subject", "predicate", "object", "confidence", "evidence"}}]}}'
)
BRIEF = (
    "Name the main entities and relations.\nTypes: {types}\n\nText:\n{text}\n\nKnown: {hints}\n\n"
    'JSON only: {{"entities": [{{"name", "canonical", "type", "confidence"}}], "relations": [{{"subject", "predicate", "object", "confidence"}}]}}'
)


def request_text(text: Column, hints: Column, kinds: tuple[str, ...] = config.ENTITY_TYPES, brief: bool = False) -> Column:
    """What a model is asked about a text: its first characters, and the first candidates of the recogniser.

    ``hints`` is an array of strings; the short request shows fewer of them, and
    leaves their line out where there are none.
    """
    body = (BRIEF if brief else REQUEST).replace("{types}", ", ".join(kinds)).replace("{{", "{").replace("}}", "}")
    read = F.when(F.length(text) > READ_CHARS, F.concat(F.substring(text, 1, READ_CHARS), F.lit("..."))).otherwise(text)
    if not brief:
        head, _, rest = body.partition("{hints}")
        middle, _, tail = rest.partition("{text}")
        return F.concat(F.lit(head), F.array_join(F.slice(hints, 1, HINTS), ", "), F.lit(middle), read, F.lit(tail))
    head, _, rest = body.partition("{text}")
    middle, _, tail = rest.partition("\n\nKnown: {hints}")
    known = F.array_join(F.slice(hints, 1, BRIEF_HINTS), ", ")
    return F.concat(F.lit(head), read, F.lit(middle), F.when(known != "", F.concat(F.lit("\n\nKnown: "), known)).otherwise(""), F.lit(tail))


def find_span(text: Column, name: Column, canonical: Column) -> Column:
    """Where a name, else its canonical form, stands in a text in any letter case, from 0; null where it doesn't."""
    at = lambda x: F.instr(F.lower(text), F.lower(x)) - 1
    return F.when(at(name) >= 0, at(name)).when(at(canonical) >= 0, at(canonical))


@dataclass
class Extracted:
    """Mentions and relations of a corpus."""

    mentions: DataFrame
    relations: DataFrame


def _llm_mentions(replies: DataFrame, chunks: DataFrame) -> DataFrame:
    found = extraction.reply_entities(replies, "chunk_idx", "reply").join(chunks.select("chunk_idx", "text"), "chunk_idx")
    at = find_span(F.col("text"), F.col("name"), F.col("canonical_form"))
    context = F.when(at.isNotNull(), extraction.context_around(F.col("text"), at, F.length("name"))).otherwise(F.substring("text", 1, extraction.LEAD_CHARS))
    return found.select("chunk_idx", "name", "canonical_form", "entity_type", "confidence", at.cast("int").alias("char_pos"), context.alias("context"), F.lit("llm").alias("extraction_method"))


def extract(chunks: DataFrame, settings: config.Extraction = config.Extraction(), answer=None, gate: int = 0, spans=None, brief: bool = False) -> Extracted:  # noqa: B008
    """Mentions and relations of text chunks by a recogniser, by a model (``answer``: request to reply), or by both.

    In the mode for both, a model reads a chunk only if the recogniser (the
    plug-in ``spans``) found at least ``gate`` mentions in it; where both know
    an entity the model's word counts.  Mentions under the confidence or of
    other types are left out, as are relations under it.  A model is asked once
    a chunk, and its replies are kept for all that follows.
    """
    texts = chunks.where((F.col("modality") == "text") & (F.length("text") > 0))
    mode = settings.mode if answer is not None else "ner_only"
    named = extraction.recognise(texts, spans).withColumn("extraction_method", F.lit("ner")).drop("spacy_label")
    if mode == "hybrid":
        named = cut(named)
    parts, relations = [], None
    if mode != "llm_only":
        parts.append(named)
    if mode != "ner_only":
        asked = _asked(texts, named if mode == "hybrid" else None, gate)
        named_type = lambda h: F.concat(h["name"], F.lit(" ("), h["entity_type"], F.lit(")"))
        hints = F.transform("hints", named_type if brief else lambda h: h["name"])
        request = request_text(F.col("text"), hints, settings.entity_types, brief)
        replies = cut(asked.select("chunk_idx", answer(request).alias("reply")))
        parts.append(_llm_mentions(replies, texts))
        relations = extraction.reply_relations(replies, "chunk_idx", "reply").where(F.col("confidence") >= settings.min_confidence).drop("seq")
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    merged = extraction.merge_mentions(both.withColumn("extracted_at", F.lit(None).cast("timestamp_ntz"))).drop("entity_key")
    if relations is None:
        relations = chunks.sparkSession.createDataFrame([], "chunk_idx long, subj_canonical string, subj_type string, predicate string, obj_canonical string, obj_type string, confidence double, evidence string")
    return Extracted(extraction.confident(merged, settings.min_confidence, list(settings.entity_types)), relations)


def _asked(texts: DataFrame, named: DataFrame | None, gate: int) -> DataFrame:
    """``texts`` that a model reads, with hints: those with at least ``gate`` of the mentions ``named``, or all of them without any."""
    none = F.array().cast("array<struct<char_pos:int,name:string,entity_type:string>>")
    if named is None:
        return texts.withColumn("hints", none)
    first = F.slice(F.sort_array(F.collect_set(F.struct("char_pos", "name", "entity_type"))), 1, HINTS)
    hints = named.groupBy("chunk_idx").agg(first.alias("hints"), F.count("*").alias("n"))
    return texts.join(hints, "chunk_idx", "left").where(F.coalesce("n", F.lit(0)) >= gate).withColumn("hints", F.coalesce("hints", none))


@dataclass
class Incremental:
    """Mentions and relations, one row of counters, and what should be kept for the next run."""

    found: Extracted
    counters: DataFrame
    keep: DataFrame


def extract_kept(chunks: DataFrame, kept: DataFrame, settings: config.Extraction = config.Extraction(), answer=None, gate: int = GATE, spans=None) -> Incremental:  # noqa: B008
    """``extract`` of the texts that ``kept`` (text_md5, entities, relations) doesn't know; each text is read once, however many chunks have it.

    Kept and new finds are given to all chunks with the text.  Counters are the
    chunks whose text was known (cache_hits) and not (cache_misses), and the
    texts that a model read (llm_calls) or that had too few mentions for it
    (llm_skipped).
    """
    texts = chunks.where((F.col("modality") == "text") & (F.length("text") > 0)).withColumn("text_md5", F.md5("text"))
    hits, misses = cache.cached_extractions(chunks, kept)
    new = cut(misses.groupBy("text_md5").agg(F.min("chunk_idx").alias("chunk_idx"), F.first("text").alias("text")).withColumn("modality", F.lit("text")))
    read = extract(new, settings, answer, gate, spans, brief=True)
    keep = cut(cache.encoded_extractions(new, read.mentions, read.relations))
    every = hits.select("chunk_idx", "entities", "relations").unionByName(misses.select("chunk_idx", "text_md5").join(keep, "text_md5").select("chunk_idx", "entities", "relations"))
    every = cut(every)
    calls = new.agg(F.count("*").alias("n")).select(F.lit(0).alias("llm_calls"), F.lit(0).alias("llm_skipped"))
    if answer is not None and settings.mode == "hybrid":
        named = extraction.recognise(new, spans).groupBy("chunk_idx").agg(F.count("*").alias("n"))
        enough = F.coalesce("n", F.lit(0)) >= gate
        calls = new.join(named, "chunk_idx", "left").agg(F.count_if(enough).alias("llm_calls"), F.count_if(~enough).alias("llm_skipped"))
    known = texts.select("text_md5").join(kept.select("text_md5"), "text_md5", "left_semi").agg(F.count("*").alias("cache_hits"))
    counters = known.crossJoin(texts.agg(F.count("*").alias("all"))).crossJoin(calls)  # one row each
    counters = counters.select("cache_hits", (F.col("all") - F.col("cache_hits")).alias("cache_misses"), "llm_calls", "llm_skipped")
    return Incremental(Extracted(cache.decoded_mentions(every), cache.decoded_relations(every)), counters, keep)


def build(found: Extracted, enrich: bool = True, encode=None) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of the graph: resolved over the corpus, relations re-pointed and each kept once.

    Relations whose ends no stored entity has are left out, as the store can't
    hold them.  Without ``enrich`` entities have no importance.  With an
    ``encode`` plug-in entities have the vector of their canonical form.
    """
    resolved = cut(extraction.resolve_mentions(found.mentions))
    entities = resolved.withColumn("importance_score", extraction.importance(F.col("occurrences")) if enrich else F.lit(None).cast("double"))
    if encode is not None:
        entities = embedded(entities, encode)
    relations = extraction.distinct_relations(extraction.repoint_relations(found.relations, resolved))
    return entities, graph.upsert_relations(relations, entities)


def embedded(entities: DataFrame, encode) -> DataFrame:
    """``entities`` with the vector of their canonical form as ``embedding``; null forms have none."""
    vector = encode(F.when(F.col("canonical_form").isNotNull(), F.array("canonical_form")))
    return entities.withColumn("embedding", F.get(vector, F.lit(0)).cast("array<float>"))


def unique_violations(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has: what a uniqueness constraint of the store would refuse."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def entity_card(seeds: DataFrame, links: DataFrame, edges: DataFrame, entities: DataFrame, size: int = 3) -> DataFrame:
    """(seed, description, chunks, neighbours): what is shown of an entity, ``size`` chunks and twice as many neighbours."""
    own = graph.entity_chunks(links.join(seeds.select("canonical_form", "entity_type"), ["canonical_form", "entity_type"], "left_semi"), size)
    own = own.groupBy("canonical_form", "entity_type").agg(F.sort_array(F.collect_list("chunk_idx")).alias("chunks"))
    near = graph.neighbours(seeds, edges, entities, 1, 2 * size).groupBy("seed").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "canonical_form"))), lambda x: x["canonical_form"]).alias("neighbours"))
    told = entities.select("canonical_form", "entity_type", "description")
    return seeds.join(told, ["canonical_form", "entity_type"]).join(own, ["canonical_form", "entity_type"], "left").join(near, "seed", "left").select("seed", "description", "chunks", "neighbours")


def expanded_context(hits: DataFrame, links: DataFrame, edges: DataFrame, entities: DataFrame, hops: int = 2) -> DataFrame:
    """Entities related to those that the hits mention; the hits themselves stay as they are."""
    seeds = links.join(F.broadcast(hits.select("chunk_idx", "rank")), "chunk_idx").groupBy("canonical_form", "entity_type").agg(F.min(F.struct("rank", "canonical_form", "entity_type")).alias("seed"))
    return graph.related(seeds, edges, entities, hops).select("canonical_form", "entity_type", "importance_score", F.lit(0.8).alias("confidence"))
