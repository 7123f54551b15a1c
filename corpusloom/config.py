"""Settings of the knowledge-graph pipeline, with presets."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

# The entity types, and the presets' numbers.
ENTITY_TYPES = ("Person", "Organization", "Location", "Concept", "Date", "Number", "Technical_Term", "Product", "Event")


@dataclass(frozen=True)
class Extraction:
    """How mentions are found and which of them count."""

    mode: str = "hybrid"
    entity_types: tuple[str, ...] = ENTITY_TYPES
    min_confidence: float = 0.7
    enable_coreference: bool = False
    spacy_model: str = "en_core_web_sm"
    llm_model: str = "llama-3.3-70b-versatile"
    enable_llm_refinement: bool = True


@dataclass(frozen=True)
class Retrieval:
    """How the graph takes part in a search."""

    retrieval_mode: str = "hybrid"
    expansion_hops: int = 2
    entity_boost_weight: float = 0.3
    centrality_weight: float = 0.2
    include_entity_context: bool = True


@dataclass(frozen=True)
class Pipeline:
    """Settings of a whole run."""

    enabled: bool = False
    extraction: Extraction = field(default_factory=Extraction)
    retrieval: Retrieval = field(default_factory=Retrieval)
    enable_enrichment: bool = True
    store_graph: bool = True


PRESETS = {
    "fast": Pipeline(True, Extraction("ner_only", min_confidence=0.8, enable_llm_refinement=False), Retrieval("entity_aware", 1, 0.2, 0.1, False), False),
    "balanced": Pipeline(True),
    "comprehensive": Pipeline(True, Extraction(min_confidence=0.6, enable_coreference=True), Retrieval("hybrid", 3, 0.4, 0.3)),
}


def preset(name: str = "balanced") -> Pipeline:
    """A preset by name; an unknown name is balanced."""
    return PRESETS.get(name, PRESETS["balanced"])


def custom(enabled: bool = True, extraction_mode: str = "hybrid", retrieval_mode: str = "hybrid", **settings) -> Pipeline:
    """Settings given by field name, each routed to the part that has it; others are an error."""
    parts = {}
    for name, kind, start in (("extraction", Extraction, Extraction(extraction_mode)), ("retrieval", Retrieval, Retrieval(retrieval_mode))):
        own = {f.name for f in fields(kind)}
        parts[name] = replace(start, **{k: settings.pop(k) for k in list(settings) if k in own})
    return replace(Pipeline(enabled, **parts), **settings)
