"""Queries of the llm operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import canonical, furniture, neighbours, packing, scans, splitting, tokenizer, variants
from corpusloom.session import cut
from corpusloom.sources.tables import table


def _site_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The text chunks of web sites."""
    return table(spark, folder, "chunks").where("modality = 'text' AND source LIKE '%.example'").select("chunk_idx", "source", "text")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each line of a site's chunks that belongs to the site."""
    return furniture.repeated_lines(_site_chunks(spark, folder), "chunk_idx", "source", "text")


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The text chunks of web sites without the lines of the site."""
    chunks = _site_chunks(spark, folder)
    lines = furniture.repeated_lines(chunks, "chunk_idx", "source", "text")
    return furniture.without_lines(chunks, lines, "chunk_idx", "text")


def p2_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """The thing that each row of entities stands for."""
    return variants.resolve(table(spark, folder, "entities"), table(spark, folder, "given_names"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of rows of entities for the same real thing."""
    return variants.same_pairs(p2_resolved(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of similar vectors of graph_rows, and apart from these of entities."""
    found = [
        neighbours.similar_pairs(table(spark, folder, kind), key, "embedding").select(F.lit(kind).alias("kind"), "id_a", "id_b")
        for kind, key in (("graph_rows", "idx"), ("entities", "entity_id"))
    ]
    return found[0].unionByName(found[1])


def _paper_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The text chunks of PDF files, scanned or not."""
    return table(spark, folder, "chunks").where("modality = 'text' AND source LIKE '%.pdf'").select("chunk_idx", "source", "page", "text")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Furniture, broken and misread words of scanned pages."""
    return scans.noise(_paper_pages(spark, folder), table(spark, folder, "wordlist"))


def p4_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Every page of a PDF file, those of scanned files as continuous paragraphs."""
    return scans.read_pages(_paper_pages(spark, folder), table(spark, folder, "wordlist")).select("chunk_idx", "scanned", "repaired")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Request and chunk of every oversized text, and whether it holds an overlong run."""
    chunks = table(spark, folder, "chunks").select("chunk_idx", "dataset_key", "modality", "text")
    asked = splitting.requested_chunks(chunks, table(spark, folder, "index_requests"))
    cut = splitting.split_oversized(asked.drop("dataset_key", "modality"), with_text=False)
    first = cut.where("piece_no = 0")
    return first.select("request_id", "chunk_idx", F.when(F.col("long_run"), "long_run").otherwise("plain").alias("kind")).distinct()


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every oversized text chunk for each request of its data set."""
    chunks = table(spark, folder, "chunks").select("chunk_idx", "dataset_key", "modality", "heading", "text")
    asked = splitting.requested_chunks(chunks, table(spark, folder, "index_requests"))
    return splitting.split_oversized(asked.drop("modality"))


def p5_covered(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the pieces of each oversized text: they cover it, fit, and share what was asked for."""
    pieces = p5_pieces(spark, folder)
    row, size = Window.partitionBy("request_id", "chunk_idx").orderBy("piece_no"), F.greatest(F.coalesce("target_chars", F.lit(splitting.TARGET_CHARS)), F.lit(1))
    asked = F.greatest(F.coalesce("overlap_chars", F.lit(splitting.OVERLAP_CHARS)), F.lit(0))
    shared = F.when(asked < size, asked).otherwise((size / 2).cast("int"))
    before = F.lag("piece_end").over(row)
    fits = (F.length("piece") <= size) & (F.length("piece") == F.col("piece_end") - F.col("piece_start"))
    follows = F.when(before.isNull(), F.col("piece_start") == 0).otherwise((F.col("piece_start") == F.greatest(before - shared, F.lit(0))) & (F.col("piece_end") > before))
    marked = pieces.withColumns({"fits": fits, "follows": follows})
    return marked.groupBy("request_id", "chunk_idx").agg(F.max("piece_end").alias("covered"), F.bool_and("fits").alias("fits"), F.bool_and("follows").alias("follows"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encode(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p7_pack(spark: SparkSession, folder: str) -> DataFrame:
    """The container of each document, or of each part of an oversized one, for every capacity."""
    counted = tokenizer.token_counts(table(spark, folder, "documents").select("doc_id", "text"))
    boxes = table(spark, folder, "context_sizes").select(F.col("size_name").alias("box"), F.col("capacity_tokens").alias("capacity"))
    packed = packing.pack(counted.select(F.col("doc_id").alias("item"), F.col("n_tokens").alias("size")), boxes)
    return packed.select(
        F.col("box").alias("size_name"), F.col("container").alias("container_id"), F.col("item").alias("doc_id"), "piece",
        F.col("start").alias("first_token"), F.col("size").alias("n_tokens"),
    )


def p7_filled(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the containers of each capacity: all documents are in them, whole, and none is overfull."""
    packed = cut(p7_pack(spark, folder))
    sizes = table(spark, folder, "context_sizes")
    fills = packed.groupBy("size_name", "container_id").agg(F.sum("n_tokens").alias("fill")).join(F.broadcast(sizes), "size_name")
    fills = fills.groupBy("size_name").agg(F.bool_and(F.col("fill") <= F.col("capacity_tokens")).alias("fits"))
    docs = packed.groupBy("size_name", "doc_id").agg(F.count("*").alias("n"), F.max("piece").alias("last"), F.sum("n_tokens").alias("all"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    whole = (F.col("n") == F.col("last") + 1) & (F.col("all") == F.col("end"))
    return docs.groupBy("size_name").agg(F.count("*").alias("n_docs"), F.bool_and(whole).alias("whole")).join(fills, "size_name")


def p8_stable(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the canonical form of each document's canonical text is that text."""
    once = table(spark, folder, "documents").select("doc_id", canonical.canonical_text(F.col("text")).alias("once"))
    return once.select("doc_id", F.col("once").eqNullSafe(canonical.canonical_text(F.col("once"))).alias("stable"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents with different texts that look the same."""
    return canonical.same_look_pairs(table(spark, folder, "documents"))


def p8_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """The canonical text of every document."""
    return canonical.with_canonical(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "canonical")


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_resolved, p3_found, p4_found, p4_repaired, p5_found, p5_pieces, p5_covered, p6_ids, p7_pack, p7_filled, p8_found, p8_canonical, p8_stable)}

_LONG = "greatest(coalesce(target_chars, 900), 1)"



def _similar_sql(name: str, key: str) -> str:
    """Brute force over all pairs of one table."""
    return f"""
        SELECT DISTINCT '{name}' AS kind, least(a, b) AS id_a, greatest(a, b) AS id_b FROM (
            SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS place FROM (
                SELECT x.{key} AS a, y.{key} AS b, round(list_cosine_similarity(x.v, y.v), 9) AS s
                FROM (SELECT {key}, embedding::DOUBLE[] AS v FROM {name} WHERE {_USABLE}) x
                JOIN (SELECT {key}, embedding::DOUBLE[] AS v FROM {name} WHERE {_USABLE}) y ON x.{key} <> y.{key}
            ) WHERE s >= 0.9
        ) WHERE place <= 5
    """


_USABLE = "embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"

ORACLES = {
    "p5_covered": f"""
        SELECT request_id, chunk_idx, length(text) AS covered, true AS fits, true AS follows
        FROM (SELECT DISTINCT request_id, dataset_key, target_chars, overlap_chars FROM index_requests) JOIN chunks USING (dataset_key)
        WHERE modality = 'text' AND length(text) > {_LONG}
    """,
    "p7_filled": "SELECT size_name, (SELECT count(*) FROM documents) AS n_docs, true AS whole, true AS fits FROM context_sizes",
    "p8_stable": "SELECT doc_id, true AS stable FROM documents",
    "p3_found": _similar_sql("graph_rows", "idx") + " UNION ALL " + _similar_sql("entities", "entity_id"),
    "p5_found": f"""
        SELECT DISTINCT request_id, chunk_idx,
               CASE WHEN list_max(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: length(w))) > {_LONG}
                    THEN 'long_run' ELSE 'plain' END AS kind
        FROM (SELECT DISTINCT request_id, dataset_key, target_chars FROM index_requests)
        JOIN chunks USING (dataset_key)
        WHERE modality = 'text' AND length(text) > {_LONG}
    """,
}
