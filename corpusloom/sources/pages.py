"""Pages of parsed documents as chunks.

A parser is a plug-in that turns a file's bytes into JSON of its pages and
pictures; what becomes of them is relational.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.operators.ordinals import with_ordinal

#: What a parser gives for a file, as JSON.
DOCUMENT = (
    "struct<pages:array<struct<number:int,blocks:array<struct<lines:array<struct<spans:array<string>>>,text:string>>,text_blocks:array<string>>>,"
    "pictures:array<struct<page_no:int,page:int,saved:boolean>>,markdown:string>"
)


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.regexp_extract(path, r"[^/\\]+$", 0)


def stem(path: Column) -> Column:
    """The base name without its last suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def read_files(spark: SparkSession, paths: list[str], parse: Callable[[str, bytes], str]) -> DataFrame:
    """(path, document, error) of files; a file whose parser fails has a null document and says why in ``error``."""
    wrong = [p for p in paths if not p.lower().endswith(".pdf")]
    if wrong or not paths:
        raise ValueError(f"only .pdf files can be indexed: {wrong}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done, errors = [], []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    done.append(parse(path, bytes(content)))
                    errors.append(None)
                except Exception as e:
                    done.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": batch["path"], "json": done, "error": errors}, dtype=object)

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(run, "path string, json string, error string").select("path", F.from_json("json", DOCUMENT).alias("document"), "error")


def page_text(page: Column) -> Column:
    """A page's text: blocks of lines of spans, a block's own text where it has no lines, else the loose text blocks."""
    line = lambda ln: F.array_join(F.filter(ln["spans"], lambda s: s != ""), "")

    def block(b: Column) -> Column:
        lines = F.filter(F.transform(F.coalesce(b["lines"], F.array().cast("array<struct<spans:array<string>>>")), line), lambda x: x != "")
        return strip(F.when(F.size(lines) > 0, F.array_join(lines, " ")).otherwise(F.coalesce(b["text"], F.lit(""))))

    some = lambda texts: F.filter(texts, lambda t: t != "")
    blocks = some(F.transform(F.coalesce(page["blocks"], F.array().cast("array<struct<lines:array<struct<spans:array<string>>>,text:string>>")), block))
    loose = some(F.transform(F.coalesce(page["text_blocks"], F.array().cast("array<string>")), strip))
    return F.array_join(F.when(F.size(blocks) > 0, blocks).otherwise(loose), "\n")


def page_chunks(files: DataFrame) -> DataFrame:
    """Text and image chunks of (path, document): one for each page with text, one for each saved picture.

    A file without page text gives its markdown as one chunk of page 1.  Pages
    go by their number, else by their place.
    """
    pages = files.select("path", F.posexplode("document.pages").alias("at", "p"))
    number = F.coalesce("p.number", F.col("at") + 1)
    texts = pages.select("path", number.alias("page"), page_text(F.col("p")).alias("text")).where("text <> ''")
    whole = files.where(F.coalesce("document.markdown", F.lit("")) != "").join(texts.select("path"), "path", "left_anti")
    texts = texts.unionByName(whole.select("path", F.lit(1).alias("page"), F.col("document.markdown").alias("text")))
    texts = texts.select("path", "page", "text", F.lit("text").alias("modality"), F.lit(None).cast("string").alias("image_path"))
    pictures = files.select("path", F.posexplode("document.pictures").alias("at", "p")).where("p.saved")
    name = F.concat(stem(F.col("path")), F.lit("_figure_"), F.col("at"), F.lit(".png"))
    images = pictures.select("path", F.coalesce("p.page_no", "p.page", F.lit(1)).alias("page"), F.lit("").alias("text"), F.lit("image").alias("modality"), name.alias("image_path"))
    none = F.lit(None).cast("string")
    return texts.unionByName(images).select("text", "page", base_name(F.col("path")).alias("source"), none.alias("heading"), "modality", "image_path", F.lit(None).cast("array<string>").alias("tags"))


def numbered(chunks: DataFrame, *order) -> DataFrame:
    """``chunks`` with chunk_idx from 0 within the whole set, by source and then by ``order``, or else by page and kind."""
    order = order or ("page", F.desc("modality"), F.coalesce("image_path", F.lit("")), F.xxhash64("text"))
    if "chunk_idx" not in chunks.columns:
        return with_ordinal(chunks, "chunk_idx", "source", *order)
    old = chunks.withColumnRenamed("chunk_idx", "_old")
    return with_ordinal(old, "chunk_idx", "source", *("_old" if o == "chunk_idx" else o for o in order)).drop("_old")
