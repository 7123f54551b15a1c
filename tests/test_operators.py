"""Operators of search, extraction and the graph on hand-written cases."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from corpusloom import config
from corpusloom.functions.text import title_case
from corpusloom.operators import extraction, graph, kg_retrieval, prompts, retrieval
from corpusloom.sources import cache, pages
from corpusloom.streaming import incremental

MENTIONS = "chunk_idx long, name string, canonical_form string, entity_type string, confidence double, char_pos int, context string, extraction_method string, extracted_at timestamp_ntz"


def test_bm25_by_hand(spark):
    docs = {0: "a b b", 1: "a c", 2: "", 3: "a", 4: "d"}
    texts = spark.createDataFrame(list(docs.items()), "chunk_idx long, text string")
    terms = retrieval.query_terms(spark.createDataFrame([(0, "b A zzz b")], "query_id int, query string"))
    got = {r.chunk_idx: r.bm25 for r in retrieval.bm25(texts, terms).collect()}
    words = [d.split() for d in docs.values()]
    vocabulary = {w for d in words for w in d}
    raw = {w: math.log(5 - sum(w in d for d in words) + 0.5) - math.log(sum(w in d for d in words) + 0.5) for w in vocabulary}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in raw.items()}
    average = sum(map(len, words)) / 5
    for i, d in enumerate(words):
        want = sum(n * idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / average)) for w, n in (("b", 2), ("a", 1)) if w in d)
        assert got.get(i, 0.0) == pytest.approx(want)


def test_scores_without_spread_or_terms(spark):
    chunks = spark.createDataFrame([(0, ""), (1, "")], "chunk_idx long, text string")
    vectors = spark.createDataFrame([(0, [0.0, 0.0]), (1, None)], "chunk_idx long, embedding array<float>")
    query = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, vector array<float>")
    terms = retrieval.query_terms(spark.createDataFrame([(0, "x")], "query_id int, query string"))
    assert [tuple(r) for r in retrieval.hybrid_scores(chunks, vectors, query, terms).orderBy("chunk_idx").collect()] == [(0, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0)]


def test_expansion_counts_capitals_twice(spark):
    asked = spark.createDataFrame([(0, "Layer weight")], "query_id int, query string")
    synonyms = spark.createDataFrame([("weight", "burden"), ("weight", "heavy_load")], "term string, lemma string")
    got = {r.term: r.times for r in retrieval.expanded_terms(asked, synonyms).collect()}
    assert got == {"layer": 2, "weight": 1, "burden": 1, "heavy": 1, "load": 1}


def test_nearest_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 1)
    vectors = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, [float("nan"), 0.0]), (5, None)], "chunk_idx long, embedding array<double>")
    asked = spark.createDataFrame([(7, [5.0, 0.0]), (8, [0.0, 0.0]), (9, [0.0, 3.0])], "query_id long, vector array<double>")
    got = [(r.query_id, r.chunk_idx, r.rank) for r in retrieval.nearest(vectors, asked, 2).orderBy("query_id", "rank").collect()]
    assert got == [(7, 1, 1), (7, 3, 2), (9, 2, 1), (9, 1, 2)]


def test_title_case(spark):
    frame = spark.createDataFrame([("o'neil mc-donald 3m",), ("",)], "s string")
    assert [r[0] for r in frame.select(title_case(F.col("s"))).collect()] == ["O'Neil Mc-Donald 3M", ""]


def test_replies(spark):
    texts = [
        '```json\n{"entities":[{"name":"A","type":"Person","confidence":"0.9"},{"name":"b","canonical":"B"}],"relations":[{"subject":"a","predicate":"KNOWS","object":"zz"}]}\n```',
        'said {"entities":[{"name":"x"},{"name":"y","confidence":"high"},{"name":"z"}],"relations":[{"subject":"x","object":"z"}]} so',
        '{"entities":[{"name":"cut',
        "nothing",
        None,
        "",
    ]
    replies = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [tuple(r) for r in extraction.reply_entities(replies).orderBy("doc_id", "seq").collect()]
    assert got == [(0, 0, "A", "A", "Person", 0.9, ""), (0, 1, "b", "B", "Concept", 0.7, ""), (1, 0, "x", "x", "Concept", 0.7, "")]
    got = [tuple(r) for r in extraction.reply_relations(replies).collect()]
    assert got == [(0, 0, "A", "Person", "KNOWS", "zz", "Concept", 0.7, "")]


def test_recogniser_positions(spark):
    text = "In 1999 the Oak Institute of Optics kept 12 percent. \U0001f600 Again 2001."
    chunks = spark.createDataFrame([(0, text, "text"), (1, text, "image"), (2, None, "text")], "chunk_idx long, text string, modality string")
    got = extraction.recognise(chunks).collect()
    assert {r.name for r in got} == {"1999", "2001", "Oak Institute of Optics", "12 percent"}
    assert all(text[r.char_pos : r.char_pos + len(r.name)] == r.name for r in got)
    assert {r.entity_type for r in got} == {"Date", "Organization", "Concept"}


def test_merge_and_resolve(spark):
    rows = [(1, "n", "Oak", "Person", 0.8, 5, "ctx", "ner", None), (1, "l", "OAK", "Person", 0.6, None, "", "llm", None), (2, "n2", "Oak", "Person", 0.9, 1, "c", "ner", None)]
    mentions = spark.createDataFrame(rows, MENTIONS)
    got = {r.chunk_idx: (r.name, r.canonical_form, r.char_pos, r.context) for r in extraction.merge_mentions(mentions).collect()}
    assert got == {1: ("l", "OAK", 5, "ctx"), 2: ("n2", "Oak", 1, "c")}
    entities = spark.createDataFrame(
        [(2, "b", "Oak", "Person", 0.9, 3, None), (1, "a", "oak", "Location", 0.9, None, "told"), (3, "c", "Elm", "Person", None, None, "")],
        "entity_id long, name string, canonical_form string, entity_type string, confidence double, occurrences int, description string",
    )
    got = {r.entity_key: (r.name, r.entity_type, r.description, r.occurrences) for r in extraction.resolve_entities(entities).collect()}
    assert got == {"oak": ("a", "Location", "told", 4), "elm": ("c", "Person", None, 1)}


def graph_of(spark, *edges):
    rows = [(a, "T", p, b, "T", 0.5, i, None) for i, (a, p, b) in enumerate(edges)]
    relations = spark.createDataFrame(rows, "subj_canonical string, subj_type string, predicate string, obj_canonical string, obj_type string, confidence double, chunk_idx long, evidence string")
    names = sorted({x for a, _, b in edges for x in (a, b)} | {"alone"})
    entities = spark.createDataFrame([(i, n, "T", 0.1 * i) for i, n in enumerate(names)], "entity_id long, canonical_form string, entity_type string, importance_score double")
    return relations, entities


def test_hops(spark):
    relations, entities = graph_of(spark, ("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("a", "q", "b"), ("d", "p", "d"), ("it's", "p", "a"))
    stored = graph.upsert_relations(relations, entities)
    edges = graph.edge_list(stored)
    seeds = entities.select(F.col("entity_id").alias("seed"), "canonical_form", "entity_type")
    names = {r.entity_id: r.canonical_form for r in entities.collect()}
    found = {(names[r.seed], r.canonical_form, r.distance) for r in graph.khop(seeds, edges, 3).collect()}
    ways = {n: [] for n in names.values()}
    flat = [(i, r.subj_canonical, r.obj_canonical) for i, r in enumerate(stored.collect())]

    def walk(start, at, used):
        for i, a, b in flat:
            for x, y in {(a, b), (b, a)}:
                if x == at and i not in used and len(used) < 3:
                    ways[start].append((y, len(used) + 1))
                    walk(start, y, used | {i})

    for n in ways:
        walk(n, n, frozenset())
    assert found == {(n, y, k) for n, w in ways.items() for y, k in w}
    assert ("alone", "a", 1) not in found


def test_paths_and_subgraph(spark):
    relations, entities = graph_of(spark, ("a", "p", "b"), ("b", "p", "c"), ("d", "p", "c"), ("d", "p", "e"), ("e", "p", "f"), ("a", "p", "x"), ("x", "p", "c"))
    edges = graph.edge_list(graph.upsert_relations(relations, entities))
    pairs = spark.createDataFrame([(1, "a", "T", "d", "T"), (2, "a", "T", "f", "T"), (3, "c", "T", "a", "T"), (4, "alone", "T", "a", "T")], "pair int, from_form string, from_type string, to_form string, to_type string")
    assert {(r.pair, r.distance, r.path) for r in graph.shortest_paths(pairs, edges).collect()} == {(1, 3, "a > b > c > d"), (3, 2, "c > b > a")}
    chosen = entities.where("canonical_form in ('a', 'b')")
    around = {(r.source, r.target) for r in graph.subgraph(chosen, relations).collect()}
    assert around == {("a", "b"), ("b", "a"), ("b", "c"), ("a", "x")}
    assert {(r.source, r.target) for r in graph.subgraph(chosen, relations, neighbours_too=False).collect()} == {("a", "b")}


def test_upsert_twice_is_once(spark):
    store = spark.createDataFrame([("a", "T", "old", 3), ("b", "T", "kept", None)], "canonical_form string, entity_type string, name string, occurrences int")
    new = spark.createDataFrame([("a", "T", "new", None), ("c", "T", "added", 1)], store.schema)
    once = graph.upsert(store, new, ["canonical_form", "entity_type"], ["occurrences"])
    want = {("a", "T", "new", 3), ("b", "T", "kept", None), ("c", "T", "added", 1)}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in graph.upsert(once, new, ["canonical_form", "entity_type"], ["occurrences"]).collect()} == want


def test_is_triples(spark):
    texts = spark.createDataFrame([(0, "the sky is blue today"), (1, " is x"), (2, "a is b is c"), (3, None), (4, "x is ")], "chunk_idx int, text string")
    assert [tuple(r) for r in graph.is_triples(texts, "chunk_idx").collect()] == [(0, "sky", "is", "blue")]


def test_modes_without_graph(spark):
    scores = spark.createDataFrame([(i, 0.1, 0.0, 1.0 / (i + 1)) for i in range(3)], "chunk_idx long, sem double, bm25 double, score double")
    links = spark.createDataFrame([], "chunk_idx long, canonical_form string, entity_type string, char_pos int, context string")
    relations, entities = graph_of(spark, ("a", "p", "b"))
    asked = spark.createDataFrame([], "canonical_form string, entity_type string, score double")
    for mode in ("baseline", "entity_aware", "graph_guided", "hybrid", "unknown"):
        got = kg_retrieval.search(mode, scores, links, graph.edge_list(relations), entities, asked, k=10).collect()
        assert [r.chunk_idx for r in sorted(got, key=lambda r: r["rank"])] == [0, 1, 2], mode


def test_prompts_without_anything(spark):
    hits = spark.createDataFrame([(1, 5, "s", None, "image", "f.png", None)], "rank int, page int, source string, heading string, modality string, image_path string, text string")
    text = prompts.citation_prompt("q?", hits).first().prompt
    assert "heading=N/A\nImage: f.png\n\n" in text and text.endswith("### Question\nq?\n\n### Answer (with citations):\n")
    assert "[Image at f.png]" in prompts.citation_prompt("q?", hits, image_links=False).first().prompt
    none = spark.createDataFrame([], "canonical_form string, entity_type string, description string, confidence double, place int")
    assert prompts.entity_section(none).first().text == ""


def test_config():
    assert config.preset("nonsense") == config.preset("balanced")
    assert config.preset("fast").extraction.min_confidence == 0.8
    own = config.custom(expansion_hops=3, min_confidence=0.5, enable_enrichment=False)
    assert (own.retrieval.expansion_hops, own.extraction.min_confidence, own.enable_enrichment) == (3, 0.5, False)
    with pytest.raises(TypeError):
        config.custom(nonsense=1)


def test_pages(spark):
    blocks = '{"pages":[{"number":2,"blocks":[{"lines":[{"spans":["a","b"]},{"spans":["c"]}]},{"lines":[],"text":" d "}]},{"text_blocks":["e"]},{"blocks":[]}],"pictures":[{"page":3,"saved":true},{"saved":false}]}'
    files = spark.createDataFrame([("/x/one.pdf", blocks), ("/x/two.pdf", '{"pages":[],"markdown":"# m"}'), ("/x/bad.pdf", None)], "path string, json string")
    files = files.select("path", F.from_json("json", pages.DOCUMENT).alias("document"))
    got = sorted((r.source, r.page, r.text, r.image_path or "") for r in pages.page_chunks(files).collect())
    assert got == [("one.pdf", 2, "ab c\nd", ""), ("one.pdf", 2, "e", ""), ("one.pdf", 3, "", "one_figure_0.png"), ("two.pdf", 1, "# m", "")]
    assert sorted(r.chunk_idx for r in pages.numbered(pages.page_chunks(files)).collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        pages.read_files(spark, ["a.txt"], lambda p, b: "")


def test_engine_end_to_end(spark, tmp_path):
    import json

    from corpusloom.plans.engine import Engine

    paths = []
    for name, text in (("a.pdf", "The estuary is salty. Rain falls."), ("b.pdf", "Glaciers melt slowly. Ice is cold.")):
        (tmp_path / name).write_text(text)
        paths.append(str(tmp_path / name))

    def parse(path: str, content: bytes) -> str:
        return json.dumps({"pages": [{"number": 1, "text_blocks": [content.decode()]}]})

    engine = Engine(spark, str(tmp_path / "kept"), parse)
    first, again = engine.index(paths, section=False, docling=False), engine.index(paths, section=False, docling=False)
    assert (first["n_chunks"], first["cached"], again["cached"]) == (2, False, True)
    assert not engine.index(paths)["cached"]
    hits = engine.search(first["dataset_key"], "estuary rain.").collect()
    assert hits[0].source == "a.pdf" and len(hits) == 2
    assert engine.ask(first["dataset_key"], "ice?").first().answer == "ice?"
    with pytest.raises(LookupError):
        engine.search("none", "x")


def test_stream_of_batches(spark, tmp_path):
    rows = [[(1, "n", "Oak", "Person", 0.5, 1, None, "ner", None)], [(2, "m", "oak", "Person", 0.9, 1, None, "ner", None), (3, "e", "Elm", "Person", 0.3, 1, None, "ner", None)]]
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, MENTIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = incremental.stream_entities(spark.readStream.schema(MENTIONS).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
        stream.awaitTermination()
        last = incremental.kept_entities(spark, str(tmp_path / "out"))
    assert {(r.entity_key, r.name, r.occurrences) for r in last.collect()} == {("oak", "m", 2), ("elm", "e", 1)}


def test_fingerprint_without_order(spark):
    rows = spark.createDataFrame([(1, "g", "a"), (2, "g", None), (3, "h", "")], "chunk_idx long, dataset_key string, text string")
    a, b = ({tuple(r) for r in cache.table_fingerprint(x, "dataset_key", "chunk_idx", "text").collect()} for x in (rows, rows.orderBy(F.desc("chunk_idx")).repartition(3)))
    assert a == b and len({r[2] for r in a}) == 2


def test_extract_by_model_and_recogniser(spark):
    import json

    from corpusloom.functions import plugins
    from corpusloom.plans import kg_build

    text = "In 1999 the Oak Institute of Optics kept 12 percent."
    chunks = spark.createDataFrame([(0, text, "text"), (1, "Nothing here", "text"), (2, None, "text")], "chunk_idx long, text string, modality string")
    reply = json.dumps({
        "entities": [{"name": "Oak Institute of Optics", "canonical": "Oak Institute Of Optics", "type": "Organization", "confidence": 0.95}, {"name": "elm", "confidence": 0.2}],
        "relations": [{"subject": "Oak Institute Of Optics", "predicate": "KEPT", "object": "elm", "confidence": 0.9}, {"subject": "oak institute of optics", "predicate": "IS", "object": "Oak Institute Of Optics"}],
    })
    model = plugins.text_model(lambda prompts: [reply if "1999" in p else "{}" for p in prompts])
    found = kg_build.extract(chunks, answer=model, gate=3)
    names = {(r.canonical_form, r.confidence, r.char_pos) for r in found.mentions.collect()}
    assert names == {("Oak Institute Of Optics", 0.95, 12), ("1999", 0.8, 3), ("12 percent", 0.8, 41)}
    entities, relations = kg_build.build(found)
    assert {(r.subj_canonical, r.predicate) for r in relations.collect()} == {("Oak Institute Of Optics", "IS")}
    assert {r.importance_score for r in entities.collect()} == {0.1}
    assert kg_build.extract(chunks, config.Extraction("ner_only")).relations.count() == 0
    request = chunks.limit(1).select(kg_build.request_text(F.lit("x" * 2001), F.array(F.lit("h")))).first()[0]
    assert "x" * 2000 + "..." in request and "Known candidates: h\n" in request
