"""Data sets kept as tables under a key, and the key itself."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.retrieval import Lexicon
from corpusloom.sources.tables import CHUNK_SCHEMA

TABLES = ("chunks", "embeddings", "meta")
#: Settings that must be equal for a kept data set to serve again.
COMPARED = ("text_model", "image_caption_model", "chunker")


def dataset_key(spark: SparkSession, files: list[str]) -> str:
    """A key over the name, size and bytes of each file in order; a missing file counts by its path.

    Files are read and digested in tasks, wherever they are stored; the driver
    sees a digest of each.
    """
    full = {path: _qualified(spark, path) for path in dict.fromkeys(files)}
    there = [path for path in full if _exists(spark, path)]
    digests = {}
    if there:
        read = spark.read.format("binaryFile").load(there)
        named = F.concat(F.encode(F.regexp_extract("path", r"[^/]+$", 0), "utf-8"), F.encode(F.col("length").cast("string"), "utf-8"), F.col("content"))
        digests = {r["path"]: r["digest"] for r in read.select("path", F.md5(named).alias("digest")).collect()}  # a row a file
    own = [digests.get(full[path]) or hashlib.md5(path.encode()).hexdigest() for path in files]
    return hashlib.md5("".join(own).encode()).hexdigest()


def _qualified(spark: SparkSession, path: str) -> str:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def table_fingerprint(rows: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """(``group``, n_rows, fingerprint): MD5 over the digests of a group's rows, whatever their order in the files.

    Rows are digested where they lie; digests are added up as numbers, so that
    no group is gathered or sorted, however large.
    """
    own = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.coalesce(F.length(text), F.lit(-1)).cast("string"), F.coalesce(text, F.lit(""))))
    part = lambda start: F.conv(F.substring(own, start, 8), 16, 10).cast("decimal(20,0)")
    sums = rows.groupBy(group).agg(F.count("*").alias("n_rows"), *(F.sum(part(s)).alias(f"_{s}") for s in (1, 9, 17, 25)))
    return sums.select(group, "n_rows", F.md5(F.concat_ws("-", *(F.col(f"_{s}").cast("string") for s in (1, 9, 17, 25)))).alias("fingerprint"))


def decoded(rows: DataFrame) -> DataFrame:
    """Chunks with all columns: missing ones and nulls have their defaults."""
    start = {"text": "", "page": 0, "source": "", "modality": "text"}
    columns = []
    for f in CHUNK_SCHEMA.fields:
        value = F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        columns.append((F.coalesce(value, F.lit(start[f.name])) if f.name in start else value).alias(f.name))
    return rows.select(*columns)


def graph_rows(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vector as the graph store takes them; a heading is never null.

    There must be as many vectors as chunks, or fewer where some chunks have none.
    """
    own = chunks.select("source", "page", F.coalesce("heading", F.lit("")).alias("heading"), F.col("chunk_idx").alias("idx"), "text", "image_path", "tags")
    return own.join(vectors.select(F.col("chunk_idx").alias("idx"), "embedding"), "idx")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def paired(chunks: DataFrame, vectors: DataFrame) -> None:
    """Raises ValueError unless chunks and vectors are as many, one for each."""
    both = chunks.select("chunk_idx", F.lit(1).alias("c"), F.lit(0).alias("v")).unionByName(vectors.select("chunk_idx", F.lit(0).alias("c"), F.lit(1).alias("v")))
    odd = both.groupBy("chunk_idx").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).where("c <> 1 OR v <> 1")
    if not odd.isEmpty():
        raise ValueError("chunks and vectors don't match one to one")


def save(folder: str, key: str, chunks: DataFrame, vectors: DataFrame, meta: dict[str, str], graph: DataFrame | None = None, known: Lexicon | None = None) -> None:
    """Writes a data set; what was kept under its key is replaced.

    Postings are sorted by term, so that a search reads only the row groups
    that may hold its terms; chunks are sorted by number likewise.
    """
    spark, base = chunks.sparkSession, f"{folder}/{key}"
    chunks.select(*(f.name for f in CHUNK_SCHEMA.fields)).repartitionByRange("chunk_idx").sortWithinPartitions("chunk_idx").write.mode("overwrite").parquet(f"{base}/chunks")
    vectors.write.mode("overwrite").parquet(f"{base}/embeddings")
    if graph is not None:
        graph.write.mode("overwrite").parquet(f"{base}/graph")
    if known is not None:
        for name, rows, order in (("postings", known.postings, ["term", "chunk_idx"]), ("terms", known.terms, ["term"])):
            rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{base}/{name}")
        known.stats.coalesce(1).write.mode("overwrite").parquet(f"{base}/stats")
    spark.createDataFrame([(k, str(v)) for k, v in meta.items()], "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{base}/meta")


def load(spark: SparkSession, folder: str, key: str) -> dict[str, DataFrame] | None:
    """The tables of a kept data set, or None if one of the three is missing; the graph and the lexicon are optional."""
    base = f"{folder}/{key}"
    if not all(_exists(spark, f"{base}/{name}") for name in TABLES):
        return None
    found = {name: spark.read.parquet(f"{base}/{name}") for name in TABLES}
    found["chunks"] = decoded(found["chunks"])
    for name in ("graph", "postings", "terms", "stats"):
        if _exists(spark, f"{base}/{name}"):
            found[name] = spark.read.parquet(f"{base}/{name}")
    return found


def kept_lexicon(kept: dict[str, DataFrame], terms: list[str] | None = None) -> Lexicon | None:
    """The lexicon of a loaded data set, or None; with ``terms`` only what is kept of these, by filters that the scan takes."""
    if not all(name in kept for name in ("postings", "terms", "stats")):
        return None
    some = [kept[name] if terms is None else kept[name].where(F.col("term").isin(terms)) for name in ("postings", "terms")]
    return Lexicon(*some, kept["stats"])


def serves(meta: DataFrame, wanted: dict[str, str]) -> bool:
    """Whether a kept data set was made with the wanted models and chunker, and has figures only."""
    own = {r["name"]: r["value"] for r in meta.collect()}
    return all(own.get(k) == wanted.get(k) for k in COMPARED) and own.get("images_saved") == "figures_only"


def cached_extractions(chunks: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extractions of chunks whose text was seen before, by MD5 of the text, and the chunks still to be read."""
    keyed = chunks.where((F.col("modality") == "text") & (F.length("text") > 0)).withColumn("text_md5", F.md5("text"))
    return keyed.select("chunk_idx", "text_md5").join(kept, "text_md5"), keyed.join(kept.select("text_md5"), "text_md5", "left_anti")


#: What is kept of a text's extraction.
KEPT_ENTITY = "struct<name:string,canonical_form:string,entity_type:string,confidence:double,char_pos:int,description:string>"
KEPT_RELATION = "struct<subject:string,subject_type:string,predicate:string,object:string,object_type:string,confidence:double,evidence:string>"
#: Fixed value: the confidence of an endpoint that no kept entity is.
MADE_UP = 0.5


def encoded_extractions(texts: DataFrame, mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """(text_md5, entities, relations) of (chunk_idx, text_md5), one row a text; a text without finds has empty lists."""
    kinds = {"subj_canonical": "subject", "subj_type": "subject_type", "predicate": "predicate", "obj_canonical": "object", "obj_type": "object_type", "confidence": "confidence", "evidence": "evidence"}
    position = F.col("char_pos").cast("int").alias("char_pos")
    told = F.col("description") if "description" in mentions.columns else F.lit(None).cast("string")
    named = mentions.groupBy("chunk_idx").agg(F.sort_array(F.collect_list(F.struct("name", "canonical_form", "entity_type", "confidence", position, told.alias("description")))).cast(f"array<{KEPT_ENTITY}>").alias("entities"))
    tied = relations.groupBy("chunk_idx").agg(F.sort_array(F.collect_list(F.struct(*(F.col(a).alias(b) for a, b in kinds.items())))).cast(f"array<{KEPT_RELATION}>").alias("relations"))
    both = texts.select("chunk_idx", "text_md5").join(named, "chunk_idx", "left").join(tied, "chunk_idx", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return both.select("text_md5", empty("entities", KEPT_ENTITY), empty("relations", KEPT_RELATION))


def decoded_mentions(rows: DataFrame) -> DataFrame:
    """(chunk_idx, name, canonical_form, entity_type, confidence, char_pos, description) of rows (chunk_idx, entities)."""
    return rows.select("chunk_idx", F.explode("entities").alias("e")).select("chunk_idx", "e.*")


def decoded_relations(rows: DataFrame) -> DataFrame:
    """Relations of rows (chunk_idx, entities, relations), with the confidence of both ends.

    An end that none of the text's entities is (by form and type) is made up
    from the relation itself, with confidence 0.5; a missing type is Concept.
    """
    each = rows.select("chunk_idx", "entities", F.explode("relations").alias("r"))

    def sure(form: str, kind: str):
        same = F.filter("entities", lambda e: (e["canonical_form"] == F.col(form)) & (e["entity_type"] == F.col(kind)))
        return F.coalesce(F.get(F.reverse(same), F.lit(0))["confidence"], F.lit(MADE_UP))

    named = each.select(
        "chunk_idx", "entities", F.col("r.subject").alias("subj_canonical"), F.coalesce("r.subject_type", F.lit("Concept")).alias("subj_type"), "r.predicate",
        F.col("r.object").alias("obj_canonical"), F.coalesce("r.object_type", F.lit("Concept")).alias("obj_type"), "r.confidence", "r.evidence",
    )
    return named.withColumns({"subj_confidence": sure("subj_canonical", "subj_type"), "obj_confidence": sure("obj_canonical", "obj_type")}).drop("entities")


def keep_extractions(extracted: DataFrame, path: str) -> None:
    """Adds extractions (text_md5, entities, relations) to those kept."""
    extracted.write.mode("append").parquet(path)


def kept_extractions(spark: SparkSession, path: str) -> DataFrame:
    """All extractions kept so far, one for each text; none where nothing was kept yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"text_md5 string, entities array<{KEPT_ENTITY}>, relations array<{KEPT_RELATION}>")
    return spark.read.parquet(path).dropDuplicates(["text_md5"])


def read_export(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The entities and relations that ``write_export`` wrote, under the names of the tables."""
    entities = spark.read.schema("name string, canonical_form string, type string, confidence double, description string").json(f"{folder}/entities")
    relations = spark.read.schema("subject string, predicate string, object string, confidence double").json(f"{folder}/relations")
    return entities.withColumnRenamed("type", "entity_type"), relations.select(F.col("subject").alias("subj_canonical"), "predicate", F.col("object").alias("obj_canonical"), "confidence")


def write_export(entities: DataFrame, relations: DataFrame, folder: str) -> None:
    """Entities and relations as JSON lines."""
    kind = F.col("entity_type").alias("type")
    entities.select("name", "canonical_form", kind, "confidence", "description").write.mode("overwrite").json(f"{folder}/entities")
    own = [F.col("subj_canonical").alias("subject"), "predicate", F.col("obj_canonical").alias("object"), "confidence"]
    relations.select(*own).write.mode("overwrite").json(f"{folder}/relations")
