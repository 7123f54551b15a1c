"""Chunkers against plain readings of their rules, on hand-written edge cases."""

from __future__ import annotations

import re

import pytest

from corpusloom.functions.plugins import hash_encoder
from corpusloom.operators import chunking

SCHEMA = "chunk_idx long, text string, page int, source string, heading string, modality string, image_path string, tags array<string>"


def chunks(spark, *texts, modality="text"):
    return spark.createDataFrame([(i, t, 1, "s.pdf", "H", modality, None, ["x"]) for i, t in enumerate(texts)], SCHEMA)


def sentences(text):
    return [p.strip() for p in re.split(r"(?<=[.!?。！？])\s+", text.strip()) if p.strip()]


def sized(text, target, overlap):
    out, buffer = [], ""
    for s in sentences(text):
        if not buffer:
            buffer = s
        elif len(buffer) + 1 + len(s) <= target:
            buffer += " " + s
        else:
            out.append(buffer)
            buffer = buffer[-overlap:].lstrip() + " " + s if 0 < overlap < len(buffer) else s
    return [*out, buffer] if buffer else out


TEXTS = ["", "   ", "no stop at all", "A. B! C? D。 E", "1.5 x", "a." + chr(160) + "b.", "x" * 50 + ". y. " + "z" * 30 + ".", "one two. three four. five six. seven eight. nine ten.", "ab. cd. ef."]


@pytest.mark.parametrize(("target", "overlap"), [(20, 5), (20, 0), (10, 40), (6, 2)])
def test_size(spark, target, overlap):
    got = chunking.size_chunks(chunks(spark, *TEXTS), target, overlap).collect()
    for i, text in enumerate(TEXTS):
        own = [r.text for r in sorted((r for r in got if r.chunk_idx == i), key=lambda r: r.piece_no)]
        assert own == (sized(text, target, overlap) if text else [text])


def test_pass_through(spark):
    got = chunking.size_chunks(chunks(spark, "A. B.", None, modality="image")).collect()
    assert [(r.text, r.tags) for r in sorted(got, key=lambda r: r.chunk_idx)] == [("A. B.", ["x"]), (None, ["x"])]


def test_sections(spark):
    text = "lead in\nIntro:\nbody one\n\nbody two\n1. Scope\n2) Terms\nterms body\nSHORT TITLE\nA::\nlast " + "x" * 1300 + " Figure\nEnd:"
    got = sorted(chunking.section_chunks(chunks(spark, text, "ONLY TITLE"), keywords=["Figure", "none"]).collect(), key=lambda r: r.piece_no)
    assert [(r.heading, r.text[:10], r.tags) for r in got] == [(None, "lead in", []), ("Intro", "body one b", []), ("2) Terms", "terms body", []), ("A", "last xxxxx", ["figure"])]
    assert len(got[-1].text) == 1200
    assert [r.tags for r in chunking.section_chunks(chunks(spark, "body")).collect()] == [None]


def test_title_rules(spark):
    lines = ["x" * 139 + ":", "x" * 140 + ":", "A " * 12 + "B", "A " * 11 + "B", "1. x", "1.x", "12) y", "ABC1", "123"]
    frame = spark.createDataFrame([(line.strip(),) for line in lines], "line string")
    got = [r[0] for r in frame.select(chunking.is_title(frame.line)).collect()]
    assert got == [True, False, False, True, True, False, True, True, False]


def test_semantic(spark):
    got = sorted(chunking.semantic_chunks(chunks(spark, "red cat. red cat. blue dog. blue dog. " + "w " * 20 + "."), hash_encoder, target=40, overlap=0).collect(), key=lambda r: r.piece_no)
    assert [r.text for r in got][:2] == ["red cat. red cat.", "blue dog. blue dog."]
    assert chunking.semantic_chunks(chunks(spark, "   "), hash_encoder).count() == 0
