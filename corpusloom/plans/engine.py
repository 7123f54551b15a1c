"""The pipeline as one object: index, search, prompt, ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import plugins
from corpusloom.operators import chunking, prompts, retrieval
from corpusloom.session import cut
from corpusloom.sources import cache, pages


def tag_list(text: str | None) -> list[str]:
    """Keywords between commas, without blanks around them; empty ones are left out."""
    return [t.strip() for t in (text or "").split(",") if t.strip()]


def chunker_name(section: bool, docling: bool) -> str:
    """Which chunker two switches stand for."""
    return "section" if section else "docling_semantic" if docling else "baseline"


def response(hits: DataFrame, folder: str = "") -> DataFrame:
    """Hits as a search answers them: ten columns, image paths under the data folder as URLs."""
    below = F.substring(F.col("image_path"), len(folder) + 2, 1 << 20)
    url = F.when(F.col("image_path").startswith(f"{folder}/") if folder else F.lit(False), F.concat(F.lit("/cache/"), F.regexp_replace(below, r"\\", "/")))
    return hits.select("score", "sem", "bm25", "text", "page", "source", "heading", "image_path", url.alias("image_url"), "tags")


class Engine:
    """Data sets under one folder.

    ``encode`` maps an array of texts to an array of vectors; ``answer`` maps a
    prompt to an answer; ``parse`` maps a file to JSON of its pages.
    """

    def __init__(self, spark: SparkSession, folder: str, parse=None, encode=plugins.hash_encoder, answer=plugins.echo, captioner=None):
        self.spark, self.folder, self.parse, self.encode, self.answer, self.captioner = spark, folder, parse, encode, answer, captioner

    def index(self, files: list[str], section: bool = True, docling: bool = True, keywords: list[str] | None = None, target: int = 900, overlap: int = 150, text_model: str = "hash-64") -> dict:
        """Indexes files, unless a data set of them made alike is kept; (dataset_key, cached, counts)."""
        key = cache.dataset_key(self.spark, files)
        name = chunker_name(section, docling)
        meta = {"text_model": text_model, "image_caption_model": "none" if self.captioner is None else "given", "target_chars": target, "overlap_chars": overlap, "chunker": name, "images_saved": "figures_only"}
        kept = cache.load(self.spark, self.folder, key)
        cached = kept is not None and cache.serves(kept["meta"], {k: str(v) for k, v in meta.items()})
        if not cached:
            raw = pages.numbered(pages.page_chunks(pages.read_files(self.spark, files, self.parse)))
            self.index_chunks(key, raw, name, keywords, target, overlap, meta)
            kept = cache.load(self.spark, self.folder, key)
        counts = retrieval.modality_counts(kept["chunks"]).first()
        return {"dataset_key": key, "cached": cached, **counts.asDict(), "meta": meta}

    def index_chunks(self, key: str, raw: DataFrame, chunker: str, keywords: list[str] | None, target: int, overlap: int, meta: dict) -> None:
        """Chunks, encodes and keeps page chunks."""
        fine = chunking.chunk(raw, chunker, self.encode, target, overlap, keywords)
        chunks = cut(pages.numbered(fine, "chunk_idx", "piece_no").drop("piece_no"))
        if self.captioner is not None:
            captions = chunks.where("modality = 'image'").select("chunk_idx", plugins.caption_text(self.captioner(F.col("image_path"))).alias("caption"))
            chunks = cut(retrieval.with_captions(chunks, captions))
        texts = retrieval.effective_text(chunks)
        vectors = cut(texts.select("chunk_idx", self.encode(F.array("text"))[0].cast("array<float>").alias("embedding")))
        cache.paired(chunks, vectors)
        cache.save(self.folder, key, chunks, vectors, meta, cache.graph_rows(chunks, vectors), retrieval.lexicon(texts))

    def _hits(self, key: str, query: str, k: int, alpha: float, synonyms: DataFrame | None, graph_vectors: bool = False) -> DataFrame:
        kept = cache.load(self.spark, self.folder, key)
        if kept is None:
            raise LookupError(f"no data set {key}")
        asked = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        terms = retrieval.query_terms(asked) if synonyms is None else retrieval.expanded_terms(asked, synonyms)
        vector = cut(asked.select("query_id", self.encode(F.array("query"))[0].alias("vector")))  # one row
        terms = cut(terms)
        known = cache.kept_lexicon(kept, [r["term"] for r in terms.collect()])  # the terms of one query
        hits = retrieval.graph_hits(kept["graph"], vector, 3 * k) if graph_vectors and "graph" in kept else None
        return retrieval.search(kept["chunks"], kept["embeddings"], vector, terms, k, alpha, known, hits)

    def search(self, key: str, query: str, k: int = 5, alpha: float = 0.6, synonyms: DataFrame | None = None, graph_vectors: bool = False) -> DataFrame:
        """The best hits as answered to a caller, best first; with ``graph_vectors`` the graph's vector hits count too."""
        return response(self._hits(key, query, k, alpha, synonyms, graph_vectors).orderBy("rank"), self.folder)

    def prompt(self, key: str, query: str, k: int = 5, alpha: float = 0.6) -> DataFrame:
        """One row with the prompt."""
        return prompts.citation_prompt(query, self._hits(key, query, k, alpha, None))

    def ask(self, key: str, query: str, k: int = 5, alpha: float = 0.6) -> DataFrame:
        """One row with the prompt and its answer."""
        return self.prompt(key, query, k, alpha).withColumn("answer", self.answer(F.col("prompt")))
