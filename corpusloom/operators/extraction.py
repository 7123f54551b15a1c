"""Entities and relations: recognised, read from replies, merged, resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import plugins
from corpusloom.functions.text import squeeze, title_case

# Labels of the recogniser, what they stand for, and the confidences of what is found without a score.
LABEL_TYPES = {
    "PERSON": "Person", "ORG": "Organization", "GPE": "Location", "LOC": "Location", "DATE": "Date", "TIME": "Date",
    "CARDINAL": "Number", "QUANTITY": "Number", "PRODUCT": "Product", "EVENT": "Event", "FAC": "Location", "NORP": "Organization",
}
TITLE_TYPES = ["Person", "Organization", "Location", "Product", "Event"]
NER_CONFIDENCE, LLM_CONFIDENCE, IMPLIED_CONFIDENCE, CONTEXT_CHARS, LEAD_CHARS = 0.8, 0.7, 0.6, 50, 100
#: Patterns of the stand-in recogniser, one for each label; alternatives without groups.
PATTERNS = {
    "ORG": r"\b[A-Z][a-z]+ (?:Institute|Department) of [A-Z][a-z]+\b",
    "PERCENT": r"\b\d+ percent\b",
    "DATE": r"\b(?:1[89]|20)\d\d\b",
    "PRODUCT": r"\b[A-Z][a-z]+ (?:Reader|Scanner|Recorder|Analyser) \d+\b",
}
REPLY = "struct<entities:array<struct<name:string,canonical:string,type:string,confidence:string,description:string>>,relations:array<struct<subject:string,predicate:string,object:string,confidence:string,evidence:string>>,_broken:string>"


def canonical_name(name: Column, kind: Column) -> Column:
    """White space squeezed; names in title case, technical terms as they are, all else in lower case."""
    plain = squeeze(name)
    return F.when(kind.isin(TITLE_TYPES), title_case(plain)).when(kind == "Technical_Term", plain).otherwise(F.lower(plain))


def label_type(label: Column) -> Column:
    """The entity type of a recogniser's label; Concept for labels without one."""
    kinds = F.create_map(*(F.lit(x) for pair in LABEL_TYPES.items() for x in pair))
    return F.coalesce(F.get(F.map_values(F.map_filter(kinds, lambda k, _: k == label)), F.lit(0)), F.lit("Concept"))


def context_around(text: Column, start: Column, length: Column) -> Column:
    """``text`` from 50 characters before a span to 50 after it, within its bounds; ``start`` counts from 0."""
    first = F.greatest(start - CONTEXT_CHARS, F.lit(0))
    return F.substring(text, first + 1, start + length + CONTEXT_CHARS - first)


def recognise(chunks: DataFrame, spans=None, kinds: list[str] | None = None) -> DataFrame:
    """Mentions found by a recogniser: (chunk_idx, name, canonical_form, entity_type, confidence, char_pos, context, spacy_label).

    ``spans`` is a plug-in (a Column function such as ``plugins.span_model``
    makes) that maps a text to an array of (first, last, label), code points
    from 0 with ``last`` excluded; the stand-in goes by PATTERNS.  Texts are
    read once.  Each occurrence is a row.
    """
    spans = spans or plugins.span_model(plugins.pattern_spans(PATTERNS))
    texts = chunks.where((F.col("modality") == "text") & (F.length("text") > 0)).select("chunk_idx", "text")
    found = texts.withColumn("_spans", spans(F.col("text"))).where(F.size("_spans") > 0).select("chunk_idx", "text", F.explode("_spans").alias("s"))
    length = F.col("s.last") - F.col("s.first")
    typed = found.select("chunk_idx", "text", F.col("s.first").alias("char_pos"), F.col("s.label").alias("spacy_label"), F.substring(F.col("text"), F.col("s.first") + 1, length).alias("name"))
    typed = typed.withColumn("entity_type", label_type(F.col("spacy_label")))
    if kinds is not None:
        typed = typed.where(F.col("entity_type").isin(kinds))
    return typed.select(
        "chunk_idx", "name", canonical_name(F.col("name"), F.col("entity_type")).alias("canonical_form"), "entity_type", F.lit(NER_CONFIDENCE).alias("confidence"),
        "char_pos", context_around(F.col("text"), F.col("char_pos"), F.length("name")).alias("context"), "spacy_label",
    )


def reply_json(reply: Column) -> Column:
    """The JSON part of a model's reply: the first fenced object, else from the first to the last brace, else all of it."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(fenced != "", fenced).when(braced != "", braced).otherwise(reply)


def _read(replies: DataFrame, reply: str) -> DataFrame:
    parsed = F.from_json(reply_json(F.col(reply)), REPLY, {"columnNameOfCorruptRecord": "_broken"})
    return replies.withColumn("_r", parsed).where(F.col("_r").isNotNull() & F.col("_r._broken").isNull())


def _sound(items: Column) -> Column:
    """The items before the first whose confidence is no number: reading ends there."""
    bad = lambda x: x["confidence"].isNotNull() & x["confidence"].try_cast("double").isNull()
    first = F.array_position(F.transform(items, bad), F.lit(True))
    return F.when(first > 0, F.slice(items, F.lit(1), (first - 1).cast("int"))).otherwise(items)


def reply_entities(replies: DataFrame, key: str = "doc_id", reply: str = "text") -> DataFrame:
    """(``key``, seq, name, canonical_form, entity_type, confidence, description) of the entities in replies.

    Broken JSON gives no rows.  Missing fields have the usual defaults; an item
    whose confidence is no number ends the reading of its reply.
    """
    items = _read(replies, reply).select(key, F.posexplode(_sound(F.col("_r.entities"))).alias("seq", "e"))
    name = F.coalesce("e.name", F.lit(""))
    return items.select(
        key, "seq", name.alias("name"), F.coalesce("e.canonical", name).alias("canonical_form"), F.coalesce("e.type", F.lit("Concept")).alias("entity_type"),
        F.coalesce(F.col("e.confidence").try_cast("double"), F.lit(LLM_CONFIDENCE)).alias("confidence"), F.coalesce("e.description", F.lit("")).alias("description"),
    )


def reply_relations(replies: DataFrame, key: str = "doc_id", reply: str = "text") -> DataFrame:
    """(``key``, seq, subj_canonical, subj_type, predicate, obj_canonical, obj_type, confidence, evidence) of replies' relations.

    An endpoint is the last entity of the reply with that name in any letter
    case, else a Concept of its own name.  Replies whose entities end at a bad
    confidence have no relations.
    """
    read = _read(replies, reply).where(F.size(F.coalesce("_r.entities", F.array())) == F.size(F.coalesce(_sound(F.col("_r.entities")), F.array())))
    entities = F.coalesce(F.col("_r.entities"), F.array().cast("array<struct<name:string,canonical:string,type:string,confidence:string,description:string>>"))
    named = read.withColumn("_entities", F.reverse(entities))
    items = named.select(key, "_entities", F.posexplode(_sound(F.col("_r.relations"))).alias("seq", "r"))

    def endpoint(name: Column) -> Column:
        same = lambda e: F.lower(F.coalesce(e["canonical"], e["name"], F.lit(""))) == F.lower(name)
        return F.get(F.filter("_entities", same), F.lit(0))

    subject, object_ = F.coalesce("r.subject", F.lit("")), F.coalesce("r.object", F.lit(""))
    items = items.withColumns({"_s": endpoint(subject), "_o": endpoint(object_)})

    def name(found: str, given: Column) -> Column:
        return F.when(F.col(found).isNull(), given).otherwise(F.coalesce(F.col(f"{found}.canonical"), F.col(f"{found}.name"), F.lit("")))

    return items.select(
        key, "seq", name("_s", subject).alias("subj_canonical"), F.coalesce("_s.type", F.lit("Concept")).alias("subj_type"), F.coalesce("r.predicate", F.lit("")).alias("predicate"),
        name("_o", object_).alias("obj_canonical"), F.coalesce("_o.type", F.lit("Concept")).alias("obj_type"),
        F.coalesce(F.col("r.confidence").try_cast("double"), F.lit(LLM_CONFIDENCE)).alias("confidence"), F.coalesce("r.evidence", F.lit("")).alias("evidence"),
    )


#: Order of mentions within a key, the last one winning.
MENTION_ORDER = ("extracted_at", "char_pos", "name", "confidence", "context")


def merge_mentions(mentions: DataFrame) -> DataFrame:
    """One mention for each (chunk_idx, lower canonical form, type): the model's before the recogniser's.

    Within a side the last wins.  A model's mention without position or with an
    empty context takes those of the recogniser.
    """
    key = ["chunk_idx", "entity_key", "entity_type"]
    given = mentions.withColumn("entity_key", F.lower("canonical_form"))
    order = F.struct(*(F.col(c) for c in MENTION_ORDER))
    row = F.struct("name", "canonical_form", "confidence", "char_pos", "context", "extraction_method")
    sides = given.groupBy(*key).agg(
        F.max_by(row, F.when(F.col("extraction_method") == "llm", order)).alias("llm"),
        F.max_by(row, F.when(F.col("extraction_method") != "llm", order)).alias("ner"),
    )
    best = lambda c: F.when(F.col("llm").isNotNull(), F.col(f"llm.{c}")).otherwise(F.col(f"ner.{c}"))
    context = F.when(F.col("llm").isNull() | (F.coalesce("llm.context", F.lit("")) == ""), F.col("ner.context")).otherwise(F.col("llm.context"))
    return sides.select(
        *key, best("name").alias("name"), best("canonical_form").alias("canonical_form"), best("confidence").alias("confidence"),
        F.coalesce("llm.char_pos", "ner.char_pos").alias("char_pos"), context.alias("context"), best("extraction_method").alias("extraction_method"),
    )


def confident(mentions: DataFrame, least: float = 0.7, kinds: list[str] | None = None) -> DataFrame:
    """Mentions of at least a confidence and of some types; null confidence doesn't count."""
    sure = F.col("confidence") >= least
    return mentions.where(sure & F.col("entity_type").isin(kinds) if kinds else sure)


def resolve_entities(entities: DataFrame, seq: str = "entity_id") -> DataFrame:
    """One entity for each canonical form in any letter case, whatever the types.

    It is the most confident row (the first at equal confidence, null last);
    ``occurrences`` sums those of the rows, null counting 1, so that a later
    merge goes on from it; the description is the first that isn't empty.
    """
    sure = F.coalesce("confidence", F.lit(-1.0))
    order = F.struct((-sure).alias("far"), F.col(seq).alias("seq"))
    row = F.struct("name", "canonical_form", "entity_type", "confidence")
    told = F.when(F.coalesce("description", F.lit("")) != "", order)
    found = entities.groupBy(F.lower("canonical_form").alias("entity_key")).agg(
        F.min_by(row, order).alias("e"), F.count("*").alias("n_rows"), F.sum(F.coalesce("occurrences", F.lit(1))).alias("occurrences"), F.min_by("description", told).alias("description")
    )
    return found.select("entity_key", "e.name", "e.canonical_form", "e.entity_type", "e.confidence", "description", "n_rows", "occurrences", importance(F.col("occurrences")).alias("importance_score"))


def importance(occurrences: Column) -> Column:
    """A tenth per occurrence, 1 at most; an entity without a count occurs once."""
    return F.least(F.lit(1.0), F.coalesce(occurrences, F.lit(1)) / F.lit(10.0))


def resolve_mentions(mentions: DataFrame) -> DataFrame:
    """(entity_key, canonical_form, entity_type, confidence, occurrences, n_chunks) over all mentions of a form."""
    order = F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("far"), F.col("chunk_idx"), F.coalesce("char_pos", F.lit(-1)).alias("pos"), F.col("canonical_form"), F.col("entity_type"))
    row = F.struct("canonical_form", "entity_type", "confidence")
    found = mentions.groupBy(F.lower("canonical_form").alias("entity_key")).agg(F.min_by(row, order).alias("e"), F.count("*").alias("occurrences"), F.count_distinct("chunk_idx").alias("n_chunks"))
    return found.select("entity_key", "e.canonical_form", "e.entity_type", "e.confidence", "occurrences", "n_chunks")


RELATION_KEY = ["subj_canonical", "subj_type", "predicate", "obj_canonical", "obj_type"]


def repoint_relations(relations: DataFrame, resolved: DataFrame) -> DataFrame:
    """Relations whose endpoints are the resolved entities of their form and type; others keep their own."""
    ends = resolved.select("entity_key", F.col("entity_type").alias("_type"), F.col("canonical_form").alias("_form"))
    out = relations
    for side in ("subj", "obj"):
        found = ends.select(F.col("entity_key").alias(f"_{side}_key"), F.col("_type").alias(f"_{side}_type"), F.col("_form").alias(f"_{side}_form"))
        match = (F.lower(f"{side}_canonical") == F.col(f"_{side}_key")) & (F.col(f"{side}_type") == F.col(f"_{side}_type"))
        out = out.join(found, match, "left").withColumn(f"{side}_canonical", F.coalesce(f"_{side}_form", f"{side}_canonical")).drop(f"_{side}_key", f"_{side}_type", f"_{side}_form")
    return out


def distinct_relations(relations: DataFrame) -> DataFrame:
    """The first relation of each (subject, predicate, object), by chunk, confidence and evidence."""
    first = F.min(F.struct("chunk_idx", F.coalesce("confidence", F.lit(-1.0)).alias("_sure"), F.coalesce("evidence", F.lit("")).alias("_evidence"), "confidence", "evidence"))
    return relations.groupBy(*RELATION_KEY).agg(first.alias("r")).select(*RELATION_KEY, "r.confidence", "r.chunk_idx", "r.evidence")
