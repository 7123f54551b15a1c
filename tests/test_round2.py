"""Kept indexes, plug-ins that fail, kept extractions, and numbering by many tasks."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpusloom import config, session
from corpusloom.functions import plugins
from corpusloom.operators import chunking, extraction, graph, retrieval
from corpusloom.operators.ordinals import with_ordinal
from corpusloom.plans import kg_build
from corpusloom.sources import cache, pages

CHUNK = "chunk_idx long, text string, page int, source string, heading string, modality string, image_path string, tags array<string>"


def chunk_rows(spark, texts):
    return spark.createDataFrame([(i, t, 1, "s", None, "text", None, None) for i, t in enumerate(texts)], CHUNK)


def test_labels_of_the_recogniser(spark):
    labels = spark.createDataFrame([(x,) for x in ("FAC", "NORP", "PERCENT", "MONEY", "GPE", "TIME", None)], "label string")
    got = {r.label: r.kind for r in labels.select("label", extraction.label_type(F.col("label")).alias("kind")).collect()}
    assert got == {"FAC": "Location", "NORP": "Organization", "PERCENT": "Concept", "MONEY": "Concept", "GPE": "Location", "TIME": "Date", None: "Concept"}


def test_recogniser_is_a_plug_in(spark):
    def model(texts):
        if any("broken" in t for t in texts):
            raise ValueError
        return [[(t.index("Oak"), t.index("Oak") + 3, "FAC")] if "Oak" in t else [] for t in texts]

    found = extraction.recognise(chunk_rows(spark, ["At Oak", "é Oak", "broken Oak", None, ""]).coalesce(1), plugins.span_model(model)).collect()
    assert sorted((r.chunk_idx, r.name, r.char_pos, r.entity_type) for r in found) == [(0, "Oak", 3, "Location"), (1, "Oak", 2, "Location")]


def test_a_failing_item_blanks_no_other(spark):
    def model(items):
        if "bad" in items:
            raise ValueError
        return [x.upper() for x in items]

    frame = spark.createDataFrame([("a",), ("bad",), (None,), ("c",)], "x string").coalesce(1)
    assert [r.y for r in frame.select(plugins.text_model(model)(F.col("x")).alias("y")).collect()] == ["A", "", "", "C"]
    with pytest.raises(RuntimeError):
        plugins.needed_setting("NO_SUCH_SETTING_HERE")


def test_dataset_key_goes_by_bytes_in_order(spark, tmp_path):
    for name, text in (("a.pdf", "one"), ("b.pdf", "two")):
        (tmp_path / name).write_text(text)
    a, b, none = (str(tmp_path / n) for n in ("a.pdf", "b.pdf", "none.pdf"))
    first = cache.dataset_key(spark, [a, b])
    assert first == cache.dataset_key(spark, [a, f"file:{b}"]) and first != cache.dataset_key(spark, [b, a])
    assert cache.dataset_key(spark, [none]) == cache.dataset_key(spark, [none]) != cache.dataset_key(spark, [none, none])
    (tmp_path / "b.pdf").write_text("owt")
    assert first != cache.dataset_key(spark, [a, b])


def test_parser_errors_are_told(spark, tmp_path):
    for name in ("a.pdf", "b.pdf"):
        (tmp_path / name).write_text(name)

    def parse(path, content):
        if "b" in path.rpartition("/")[2]:
            raise ValueError("torn")
        return json.dumps({"markdown": "whole"})

    rows = {r.path.rpartition("/")[2]: r.error for r in pages.read_files(spark, [str(tmp_path / n) for n in ("a.pdf", "b.pdf")], parse).collect()}
    assert rows == {"a.pdf": None, "b.pdf": "ValueError: torn"}


def test_ordinals(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit("x").alias("_task_"))
    got = with_ordinal(rows.repartition(7), "n", F.desc("k")).collect()
    assert {r.n: r.k for r in got} == {i: 999 - i for i in range(1000)}
    assert with_ordinal(rows.limit(0), "n", "k").count() == 0


def test_kept_lexicon_serves_without_text(spark, tmp_path):
    chunks = chunk_rows(spark, ["salt in the estuary", "rain and salt", None, "ice", ""])
    texts = retrieval.effective_text(chunks)
    vectors = texts.select("chunk_idx", plugins.hash_encoder(F.array("text"))[0].alias("embedding"))
    cache.save(str(tmp_path), "k", chunks, vectors, {}, known=retrieval.lexicon(texts))
    kept = cache.load(spark, str(tmp_path), "k")
    terms = retrieval.query_terms(spark.createDataFrame([(0, "salt rain")], "query_id int, query string"))
    lexicon = cache.kept_lexicon(kept, ["salt", "rain"])
    want = {r.chunk_idx: round(r.bm25, 9) for r in retrieval.bm25(texts, terms).collect()}
    scores = retrieval.bm25(lexicon, terms)
    assert {r.chunk_idx: round(r.bm25, 9) for r in scores.collect()} == want and len(want) == 2
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.replace("text#", "text").split("PushedFilters")[0] and "PushedFilters: [In(term" in plan
    with pytest.raises(ValueError):
        cache.paired(chunks, vectors.where("chunk_idx > 0"))
    cache.paired(chunks, vectors)


def test_graph_hits_count_only_where_they_agree(spark):
    chunks = chunk_rows(spark, ["a", "b", "c"])
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.6, 0.8])], "chunk_idx long, embedding array<double>")
    query = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, vector array<double>")
    terms = spark.createDataFrame([], "query_id int, term string, times long")
    hits = spark.createDataFrame([(1, "s", 1, 0.9), (2, "s", 7, 0.99), (0, "s", 1, 0.2)], "chunk_idx long, source string, page int, score double")
    got = {r.chunk_idx: round(r.sem, 6) for r in retrieval.hybrid_scores(chunks, vectors, query, terms, hits=hits).collect()}
    assert got == {0: 1.0, 1: 0.9, 2: 0.6}


def test_nearest_with_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 3)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(10)]
    vectors = spark.createDataFrame(rows, "chunk_idx long, embedding array<double>").coalesce(1)
    found = retrieval.nearest(vectors, vectors.select(F.col("chunk_idx").alias("query_id"), F.col("embedding").alias("vector")), 3).collect()
    assert {(r.query_id, r.rank): r.chunk_idx for r in found if r.query_id < 2} == {(0, 1): 0, (0, 2): 2, (0, 3): 4, (1, 1): 1, (1, 2): 3, (1, 3): 5}
    assert len(found) == 30


def test_sections_without_loss(spark):
    body = "x" * 30 + " " + "y" * 30
    chunks = chunk_rows(spark, [f"lead\nTitle:\n{body}\nEMPTY\n1. Next\nend"])
    short = [(r.heading, r.text) for r in chunking.section_chunks(chunks, 25).orderBy("piece_no").collect()]
    assert short == [(None, "lead"), ("Title", body[:25]), ("1. Next", "end")]
    long = [(r.piece_no, r.heading, r.text) for r in chunking.section_chunks(chunks, 25, lossless=True).orderBy("piece_no").collect()]
    assert long == [(0, None, "lead"), (1, "Title", body[:25]), (2, "Title", body[25:50]), (3, "Title", body[50:]), (4, "1. Next", "end")]


def test_extractions_are_kept_and_decoded(spark, tmp_path):
    calls = str(tmp_path / "calls")
    text = "In 1999 the Oak Institute of Optics kept 12 percent."
    reply = json.dumps({"entities": [{"name": "Oak", "canonical": "Oak Institute Of Optics", "type": "Organization", "confidence": 0.95}], "relations": [{"subject": "Oak Institute Of Optics", "predicate": "KEPT", "object": "elm", "confidence": 0.9}]})

    def model(prompts):
        with open(calls, "a") as file:
            file.write("".join("1" for p in prompts if "Optics" in p))
        return [reply if "1999" in p else "{}" for p in prompts]

    chunks = chunk_rows(spark, [text, text, "Nothing here", None])
    none = cache.kept_extractions(spark, str(tmp_path / "kept"))
    first = kg_build.extract_kept(chunks, none, answer=plugins.text_model(model))
    assert tuple(first.counters.first()) == (0, 3, 1, 1)
    assert {(r.chunk_idx, r.obj_canonical, r.subj_confidence, r.obj_confidence) for r in first.found.relations.collect()} == {(0, "elm", 0.95, 0.5), (1, "elm", 0.95, 0.5)}
    assert open(calls).read() == "1"  # asked once, however often the finds are used
    cache.keep_extractions(first.keep, str(tmp_path / "kept"))
    again = kg_build.extract_kept(chunks, cache.kept_extractions(spark, str(tmp_path / "kept")), answer=plugins.text_model(model))
    assert tuple(again.counters.first()) == (3, 0, 0, 0) and open(calls).read() == "1"
    assert {tuple(r) for r in again.found.mentions.collect()} == {tuple(r) for r in first.found.mentions.collect()}


def test_requests_long_and_short(spark):
    hints = F.array(*(F.lit(f"h{i} (Event)") for i in range(12)))
    long, short, bare = spark.range(1).select(kg_build.request_text(F.lit("body"), hints), kg_build.request_text(F.lit("body"), hints, brief=True), kg_build.request_text(F.lit("body"), F.slice(hints, 1, 0), brief=True)).first()
    assert "h9 (Event)" in long and "h10" not in long and "Known: h0 (Event), h1 (Event), h2 (Event), h3 (Event), h4 (Event)\n" in short and "h5" not in short and "Known" not in bare


def test_entities_have_vectors(spark):
    found = kg_build.extract(chunk_rows(spark, ["The Oak Institute of Optics", "none"]))
    entity = kg_build.build(found, encode=plugins.hash_encoder)[0].first()
    assert entity.canonical_form == "Oak Institute Of Optics" and len(entity.embedding) == plugins.DIMENSIONS and abs(sum(x * x for x in entity.embedding) - 1) < 1e-5


def test_export_is_read_back(spark, tmp_path):
    entities = spark.createDataFrame([("n", "N", "Event", 0.5, None)], "name string, canonical_form string, entity_type string, confidence double, description string")
    relations = spark.createDataFrame([("A", "P", "B", None)], "subj_canonical string, predicate string, obj_canonical string, confidence double")
    cache.write_export(entities, relations, str(tmp_path))
    again = cache.read_export(spark, str(tmp_path))
    assert [tuple(x.first()) for x in again] == [("n", "N", "Event", 0.5, None), ("A", "P", "B", None)]


def test_hubs_stop_when_they_have_enough(spark):
    relations = [("hub", "E", "r", f"n{i:02}", "E") for i in range(60)] + [(f"n{i:02}", "E", "r", f"m{i:02}", "E") for i in range(60)] + [("lone", "E", "r", "hub", "E")]
    edges = graph.edge_list(spark.createDataFrame(relations, "subj_canonical string, subj_type string, predicate string, obj_canonical string, obj_type string"))
    names = {r[0] for r in relations} | {r[3] for r in relations}
    entities = spark.createDataFrame([(n, "E", 0.5) for n in names], "canonical_form string, entity_type string, importance_score double")
    seeds = spark.createDataFrame([(1, "hub", "E"), (2, "lone", "E")], "seed long, canonical_form string, entity_type string")
    plain = graph.khop(seeds, edges, 2).join(entities, ["canonical_form", "entity_type"])
    want = {s: sorted((r.distance, r.canonical_form) for r in plain.where(f"seed = {s}").collect())[:50] for s in (1, 2)}
    got = graph.neighbours(seeds, edges, entities, 2).collect()
    assert {s: sorted((r.distance, r.canonical_form) for r in got if r.seed == s) for s in (1, 2)} == want


def test_settings(spark):
    assert config.preset("fast").extraction == config.Extraction("ner_only", min_confidence=0.8, enable_llm_refinement=False)
    assert config.preset("comprehensive").extraction.enable_coreference and config.Extraction().spacy_model == "en_core_web_sm"
    assert config.custom(llm_model="other").extraction.llm_model == "other"


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Frame:
        class sparkSession:
            sparkContext = Context()

            class conf:
                @staticmethod
                def get(name, start):
                    return start

    with pytest.raises(RuntimeError):
        session.cut(Frame())
