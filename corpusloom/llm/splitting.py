"""Problem 5: items over a size limit, cut at natural boundaries with overlap.

A text is read as a tree: sections by depth of heading, paragraphs, lines (list
items among them), sentences, clauses and words.  Only nodes over the limit are
entered; inside one, neighbouring children that fit together are merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The sizes that stand for null ones.
TARGET_CHARS, OVERLAP_CHARS = 900, 150

_HEADING = re.compile(r"^[ \t]*(?:(?P<marks>#{1,6})[ \t]+\S|(?P<number>\d+(?:\.\d+)*)[.)]?[ \t]+[^\W\d_][^\n]{0,100}$|[^\Wa-z_][^a-z\n]{2,80}$|[^\W\d_][^\n.!?]{0,80}:[ \t\r]*$|<h(?P<tag>[1-6])\b)", re.MULTILINE)
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*|</(?:p|ul|ol|table|div)>\s*")
_LINE = re.compile(r"\n+|(?=<li\b)")
_SENTENCE = re.compile(r"[.!?…]+[\"'»”’)\]]*\s+|[。！？]+\s*")
_CLAUSE = re.compile(r"[,;:)\]]\s+|\s+[-–—(\[]+|[、，；：]")
_WORD = re.compile(r"\s+")
#: Depth of headings that are told apart.
DEPTHS = 3
LEVELS = ["section"] * DEPTHS + ["paragraph", "line", "sentence", "clause", "word"]
_BREAKS = [_PARAGRAPH, _LINE, _SENTENCE, _CLAUSE, _WORD]


def _headings(text: str) -> list[tuple[int, int]]:
    """(place, depth from 1) of each line that reads as a heading."""
    found = []
    for m in _HEADING.finditer(text):
        if m["marks"]:
            depth = len(m["marks"])
        elif m["tag"]:
            depth = int(m["tag"])
        elif m["number"]:
            depth = 1 + m["number"].count(".")
        else:
            depth = 1
        found.append((m.start(), min(depth, DEPTHS)))
    return found


def _children(text: str, start: int, end: int, level: int, headings: list[tuple[int, int]]) -> list[int]:
    """Where the children of a node begin, its own start aside."""
    if level < DEPTHS:
        return [at for at, depth in headings if depth <= level + 1 and start < at < end]
    pattern = _BREAKS[level - DEPTHS]
    if pattern is _CLAUSE:  # a dash or bracket opens the next clause
        cuts = []
        for m in pattern.finditer(text, start, end):
            cuts.append(m.start() + 1 if text[m.start()].isspace() else m.end())
    else:
        cuts = [m.end() for m in pattern.finditer(text, start, end)]
    return [c for c in cuts if start < c < end]


def _pack(text: str, start: int, end: int, level: int, limits: tuple[int, int], headings: list[tuple[int, int]], out: list[tuple[int, str]], cut: str) -> None:
    """Appends (end, kind of boundary) of each piece of text[start:end]; ``cut`` is the boundary at the node's own end.

    ``limits`` are those of the first piece of a text and of the others.  What
    an oversized child leaves at its end goes on with the siblings behind it.
    """
    while end - start > limits[bool(out)]:
        if level == len(LEVELS):
            start += limits[bool(out)]
            out.append((start, "hard"))
            continue
        cuts = _children(text, start, end, level, headings)
        if not cuts:
            level += 1
            continue
        kind, open_ = LEVELS[level], start
        for child_start, child_end in zip([start, *cuts], [*cuts, end], strict=True):
            if child_end - open_ <= limits[bool(out)]:
                continue
            if child_start > open_:
                out.append((child_start, kind))
                open_ = child_start
            if child_end - child_start > limits[bool(out)]:
                _pack(text, child_start, child_end, level + 1, limits, headings, out, cut if child_end == end else kind)
                open_ = child_end
                if child_end < end:
                    out.pop()
                    open_ = out[-1][0] if out else 0
        if open_ < end:
            out.append((end, cut))
        return
    out.append((end, cut))


def pieces(text: str, target: int, overlap: int) -> tuple[list[tuple[int, int, str]], bool]:
    """([start, end) and boundary of each piece, whether a run without white space is longer than ``target``).

    No piece is longer than ``target``; each begins ``overlap`` characters
    before the end of the one before it.
    """
    ends: list[tuple[int, str]] = []
    _pack(text, 0, len(text), 0, (target, target - overlap), _headings(text), ends, "end")
    starts = [0, *(end - overlap for end, _ in ends[:-1])]
    long_run = re.search(rf"\S{{{target + 1}}}", text) is not None
    return [(max(0, s), e, kind) for s, (e, kind) in zip(starts, ends, strict=True)], long_run


def split_oversized(df: DataFrame, text: str = "text", target: str = "target_chars", overlap: str = "overlap_chars", with_text: bool = True) -> DataFrame:
    """Pieces of the rows whose text has more code points than the row's target.

    Each piece keeps all columns of its row but the text and has: piece_no from
    0, piece_start, piece_end (code points, end excluded), boundary (section,
    paragraph, line, sentence, clause, word, hard, end), long_run, piece.
    Columns of the input with these names are replaced.  Without ``with_text``
    the pieces come as places only, and texts don't travel back from Python.

    Rows with null text, and those that fit, give no row.  Null targets and
    overlaps mean 900 and 150.  Targets below 1 count as 1, overlaps below 0 as
    0; an overlap that reaches the target is cut to half of it, as no piece
    could move forward otherwise.  Equal rows each give their pieces.
    """
    made = ["piece_no", "piece_start", "piece_end", "boundary", "long_run", "piece"]
    base = df.drop(*[c for c in made if c in df.columns])
    size = F.greatest(F.coalesce(F.col(target), F.lit(TARGET_CHARS)), F.lit(1))
    shared = F.greatest(F.coalesce(F.col(overlap), F.lit(OVERLAP_CHARS)), F.lit(0))
    shared = F.when(shared < size, shared).otherwise((size / 2).cast("int"))
    big = base.withColumns({"_size": size.cast("int"), "_shared": shared.cast("int")}).where(F.length(text) > F.col("_size"))
    span = T.StructType([T.StructField("piece_start", T.IntegerType()), T.StructField("piece_end", T.IntegerType()), T.StructField("boundary", T.StringType())])
    back = [f for f in big.schema.fields if with_text or f.name != text]
    schema = T.StructType([*back, T.StructField("_pieces", T.ArrayType(span)), T.StructField("long_run", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("piece_start", pa.int32()), ("piece_end", pa.int32()), ("boundary", pa.string())]))
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in (text, "_size", "_shared"))
            cut = [pieces(*row) for row in zip(*columns, strict=True)]
            spans = [[dict(zip(("piece_start", "piece_end", "boundary"), p, strict=True)) for p in found] for found, _ in cut]
            arrays = [*(batch.column(f.name) for f in back), pa.array(spans, kind), pa.array([run for _, run in cut], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [*(f.name for f in back), "_pieces", "long_run"])

    done = big.mapInArrow(run, schema)
    kept = [c for c in base.columns if c != text]
    flat = done.select(*kept, *([text] if with_text else []), "long_run", F.posexplode("_pieces").alias("piece_no", "_piece"))
    places = [*kept, "piece_no", "_piece.piece_start", "_piece.piece_end", "_piece.boundary", "long_run"]
    if not with_text:
        return flat.select(*places)
    part = F.substring(F.col(text), F.col("_piece.piece_start") + 1, F.col("_piece.piece_end") - F.col("_piece.piece_start"))
    return flat.select(*places, part.alias("piece"))


def requested_chunks(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """The text chunks of each request's data set; a request that is repeated counts once."""
    wanted = requests.select("request_id", "dataset_key", "target_chars", "overlap_chars").distinct()
    return chunks.where("modality = 'text'").join(wanted, "dataset_key")
