"""Chunkers: sentences, size-bounded, by section, and by similarity of sentences.

All of them fold over the arrays of one row, so a corpus is chunked without a
shuffle, whatever its size and however its texts are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import BLANK, lstrip, strip
from corpusloom.functions.vectors import dot

#: Default sizes of the chunkers, and the similarity under which a chunk ends.
TARGET_CHARS, OVERLAP_CHARS, SECTION_CHARS, SIMILARITY = 900, 150, 1200, 0.35
_AFTER_STOP = r"(?<=[.!?\x{3002}\x{ff01}\x{ff1f}])" + BLANK + "+"
_LINE_ENDS = r"[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
#: What every chunk carries besides its text.
KEPT = ("chunk_idx", "page", "source", "heading", "modality", "image_path", "tags")


def split_sentences(text: Column) -> Column:
    """Array of sentences: cut at white space after a full stop, ``!`` or ``?`` (also the wide forms)."""
    return F.filter(F.split(strip(text), _AFTER_STOP), lambda s: s != "")  # parts have no blanks at their ends


def is_text() -> Column:
    """Text chunks that hold text; all other rows pass through the chunkers unchanged."""
    return F.coalesce((F.col("modality") == "text") & (F.col("text") != ""), F.lit(False))


def sentences(chunks: DataFrame) -> DataFrame:
    """(chunk_idx, sentence_no, sentence) of every text chunk."""
    return chunks.where(is_text()).select("chunk_idx", F.posexplode(split_sentences(F.col("text"))).alias("sentence_no", "sentence"))


def _emit(chunks: DataFrame, made: Column) -> DataFrame:
    """One row for each (text, heading, tags) in ``made``; rows that aren't text pass through."""
    whole = F.array(F.struct(F.col("text"), F.col("heading"), F.col("tags")))
    rows = chunks.select(*KEPT, F.posexplode(F.when(is_text(), made).otherwise(whole)).alias("piece_no", "_piece"))
    image = F.when(F.col("modality") == "image", F.col("image_path")).alias("image_path")
    return rows.select("chunk_idx", "piece_no", "_piece.text", "page", "source", "_piece.heading", "modality", image, "_piece.tags")


def _pieces(texts: Column) -> Column:
    none = F.lit(None).cast("array<string>").alias("tags")
    return F.transform(texts, lambda t: F.struct(t.alias("text"), F.col("heading"), none))


def _carried(buffer: Column, overlap: int) -> Column:
    """What the next chunk takes over from the end of ``buffer``; null for nothing."""
    if overlap <= 0:
        return F.lit(None).cast("string")
    return F.when(F.length(buffer) > overlap, lstrip(F.right(buffer, F.lit(overlap))))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _folded(said: Column, near: Column | None, target: int, overlap: int, keep_blank: bool) -> Column:
    """Array of chunk texts: sentences in a row up to ``target`` characters, as long as each is ``near`` the one before it.

    The fold keeps places and sizes; a chunk's text is joined when it ends, and
    only what it hands on to the next one is carried along.
    """
    kind = "struct<out:array<string>,head:string,first:int,at:int,size:int>"
    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast("array<string>").alias("out"), none.alias("head"), F.lit(-1).alias("first"), F.lit(0).alias("at"), F.lit(0).alias("size")).cast(kind)

    def text(said: Column, s: Column) -> Column:
        return F.concat_ws(" ", s["head"], F.array_join(F.slice(said, s["first"] + 1, s["at"] - s["first"]), " "))

    def begun(s: Column, n: Column) -> Column:
        return F.struct(s["out"].alias("out"), none.alias("head"), s["at"].alias("first"), (s["at"] + 1).alias("at"), n.alias("size")).cast(kind)

    def grown(s: Column, n: Column) -> Column:
        return F.struct(s["out"].alias("out"), s["head"].alias("head"), s["first"].alias("first"), (s["at"] + 1).alias("at"), (s["size"] + 1 + n).alias("size")).cast(kind)

    def ended(s: Column, done: Column, n: Column) -> Column:
        carried = _carried(done, overlap)
        head = carried if keep_blank else F.nullif(carried, F.lit(""))
        return _bound(head, lambda h: F.struct(F.concat(s["out"], F.array(done)).alias("out"), h.alias("head"), s["at"].alias("first"), (s["at"] + 1).alias("at"), (F.coalesce(F.length(h) + 1, F.lit(0)) + n).alias("size")).cast(kind))

    def chunks(w: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            fits = (s["size"] + 1 + x["n"] <= target) & x["near"]
            return F.when(s["first"] < 0, begun(s, x["n"])).when(fits, grown(s, x["n"])).otherwise(_bound(text(w["said"], s), lambda done: ended(s, done, x["n"])))

        return F.aggregate(w["steps"], start, step, lambda s: F.when(s["first"] < 0, s["out"]).otherwise(F.concat(s["out"], F.array(text(w["said"], s)))))

    close = near if near is not None else F.transform(said, lambda x: F.lit(True))
    steps = F.zip_with(said, close, lambda x, c: F.struct(F.length(x).alias("n"), c.alias("near")))
    return _bound(F.struct(said.alias("said"), steps.alias("steps")), chunks)


def size_chunks(chunks: DataFrame, target: int = TARGET_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Chunks of whole sentences up to ``target`` characters, each led by the last ``overlap`` of the one before.

    A sentence over the target stays whole, and the part carried over isn't
    counted against the target, as in the pipeline that this follows.
    """
    said = _bound(split_sentences(F.col("text")), lambda x: _folded(x, None, target, overlap, True))
    return _emit(chunks, _pieces(said))


def is_title(line: Column) -> Column:
    """Short lines that end in a colon, stand in capitals, or are numbered."""
    capitals = (line == F.upper(line)) & (line != F.lower(line)) & (F.size(F.split(line, BLANK + "+")) <= 12)
    return (F.length(line) <= 140) & (line.endswith(":") | capitals | line.rlike(r"^\d+[.)]" + BLANK + "+.+$"))


def section_chunks(chunks: DataFrame, target: int = SECTION_CHARS, keywords: list[str] | None = None, lossless: bool = False) -> DataFrame:
    """One chunk per titled section, cut to ``target`` characters; what lies beyond is lost, as in the original.

    With ``lossless`` a longer section gives several chunks under its title.
    ``tags`` lists the keywords (lower case) in the whole body; without
    keywords it is null.  A title without body gives no chunk.
    """
    lines = F.filter(F.transform(F.split("text", _LINE_ENDS), strip), lambda line: line != "")
    words = [k.lower() for k in keywords or []]
    part = "struct<text:string,heading:string,tags:array<string>>"

    def finished(heading: Column, body: Column) -> Column:
        held = F.filter(F.array(*map(F.lit, words)), lambda k: F.contains(F.lower(body), k)) if words else F.lit(None)
        one = lambda start: F.struct(F.substring(body, start, target).alias("text"), heading.alias("heading"), held.cast("array<string>").alias("tags")).cast(part)
        if not lossless:
            return F.array(one(1))
        return F.transform(F.sequence(F.lit(0), ((F.length(body) - 1) / target).cast("int")), lambda k: one(k * target + 1))

    def sections(lines: Column) -> Column:
        """The lines between one title and the next, and those before the first."""
        places = F.filter(F.transform(lines, lambda line, i: F.when(is_title(line), i)), lambda i: i.isNotNull())
        ends = F.concat(places, F.array(F.size(lines)))

        def section(w: Column) -> Column:
            def one(title: Column, k: Column) -> Column:
                heading = F.when(title >= 0, F.regexp_replace(F.get(lines, title), ":+$", ""))
                body = F.array_join(F.slice(lines, title + 2, F.get(w["ends"], k) - title - 1), " ")
                return _bound(body, lambda b: F.when(b != "", finished(heading, b)).otherwise(F.array().cast(f"array<{part}>")))

            return F.flatten(F.transform(w["starts"], one))

        return _bound(F.struct(F.concat(F.array(F.lit(-1)), places).alias("starts"), ends.alias("ends")), section)

    return _emit(chunks, _bound(lines, sections))


def semantic_chunks(chunks: DataFrame, encode, target: int = TARGET_CHARS, overlap: int = OVERLAP_CHARS, least: float = SIMILARITY) -> DataFrame:
    """Chunks of sentences each of which is at least ``least`` similar to the one before it.

    ``encode`` maps an array of texts to an array of vectors (a Column function,
    such as a pandas UDF).  Texts without sentences give no chunk.
    """
    coded = chunks.withColumn("_said", F.when(is_text(), split_sentences(F.col("text"))))
    coded = coded.withColumn("_vectors", encode(F.col("_said")))
    before = lambda i: F.get(F.col("_vectors"), i - 1)
    near = F.transform("_vectors", lambda v, i: F.coalesce(F.round(dot(before(i), v), 9) >= least, F.lit(True)))
    return _emit(coded, _pieces(_folded(F.col("_said"), near, target, overlap, False)))


def chunk(chunks: DataFrame, chunker: str, encode=None, target: int | None = None, overlap: int = OVERLAP_CHARS, keywords: list[str] | None = None) -> DataFrame:
    """The chunker by name: section before docling_semantic before baseline; the target isn't passed to sections."""
    if chunker == "section":
        return section_chunks(chunks, keywords=keywords)
    if chunker == "docling_semantic":
        return semantic_chunks(chunks, encode, target or TARGET_CHARS, overlap)
    return size_chunks(chunks, target or TARGET_CHARS, overlap)
