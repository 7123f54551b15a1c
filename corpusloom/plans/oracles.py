"""DuckDB SQL that gives the same rows as the queries of the catalogue."""

from __future__ import annotations

BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The query that single searches ask, and the keywords of the section chunker.
QUERY = "How does rainfall change the salinity of the estuary at Northlight Archive ?"
KEYWORDS = ["survey", "table", "Figure"]
SYNONYMS = [("rainfall", "precipitation"), ("estuary", "river_mouth"), ("change", "alter"), ("change", "modify")]


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '{BLANK}+'), lambda t: t <> '')"


SENTENCES = f"""list_filter(list_transform(string_split(regexp_replace({strip('text')}, '([.!?。！？]){BLANK}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"""
IS_TEXT = "modality = 'text' AND text IS NOT NULL AND text <> ''"
SAID = f"said AS (SELECT chunk_idx, page, source, heading, {SENTENCES} AS ss FROM chunks WHERE {IS_TEXT})"
PASSED = f"SELECT chunk_idx, 0 AS piece_no, text, page, source, heading, modality, CASE WHEN modality = 'image' THEN image_path END AS image_path, tags FROM chunks WHERE NOT coalesce({IS_TEXT}, false)"


def folded(overlap: int, near: str = "true", keep_blank: bool = True) -> str:
    """The size-bounded chunker as a recursion over sentences; ``near`` also must hold to go on."""
    tail = f"regexp_replace(right(open, {overlap}), '^{BLANK}+', '')" if overlap else "NULL"
    led = f"CASE WHEN length(open) > {overlap} {'' if keep_blank else f'AND {tail} <> {chr(39) * 2}'} THEN {tail} || ' ' || ss[i + 1] ELSE ss[i + 1] END" if overlap else "ss[i + 1]"
    fits = f"(length(open) + 1 + length(ss[i + 1]) <= 900 AND {near})"
    return f"""
        fold AS (
            SELECT chunk_idx, ss, 1 AS i, ss[1] AS open, NULL::VARCHAR AS done FROM said WHERE len(ss) > 0
            UNION ALL
            SELECT chunk_idx, ss, i + 1, CASE WHEN {fits} THEN open || ' ' || ss[i + 1] ELSE {led} END, CASE WHEN NOT {fits} THEN open END
            FROM fold WHERE i < len(ss)
        ),
        parts AS (
            SELECT chunk_idx, i, done AS text FROM fold WHERE done IS NOT NULL
            UNION ALL SELECT chunk_idx, i + 1, open FROM fold WHERE i = len(ss)
        )
        SELECT chunk_idx, (row_number() OVER (PARTITION BY chunk_idx ORDER BY i) - 1)::INT AS piece_no, parts.text, page, source, heading, 'text' AS modality, NULL::VARCHAR AS image_path, NULL::VARCHAR[] AS tags
        FROM parts JOIN said USING (chunk_idx)
        UNION ALL {PASSED}
    """


def hashed(text: str) -> str:
    """The stand-in encoder: hashed words at length 1."""
    ids = f"list_transform({tokens(text)}, lambda w: ('0x' || substr(md5(w), 1, 4))::INT % 64)"
    counts = f"list_transform(range(64), lambda b: len(list_filter({ids}, lambda x: x = b))::DOUBLE)"
    return counts


def sections(keywords: list[str] | None) -> str:
    words = "[" + ", ".join(f"'{k.lower()}'" for k in keywords or []) + "]"
    tags = f"list_filter({words}, lambda k: contains(lower(body), k))" if keywords else "NULL::VARCHAR[]"
    title = f"(length(ln) <= 140 AND (ends_with(ln, ':') OR (ln = upper(ln) AND ln <> lower(ln) AND len(regexp_split_to_array(ln, '{BLANK}+')) <= 12) OR regexp_matches(ln, '^\\d+[.)]{BLANK}+.+$')))"
    return f"""
        WITH lines AS (
            SELECT chunk_idx, i, {strip('ln')} AS ln FROM (
                SELECT chunk_idx, unnest(ls) AS ln, generate_subscripts(ls, 1) AS i FROM (
                    SELECT chunk_idx, regexp_split_to_array(text, '[\\n\\r\\x{{0b}}\\x{{0c}}\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM chunks WHERE {IS_TEXT}))
        ),
        marked AS (SELECT *, {title} AS title FROM lines WHERE ln <> ''),
        numbered AS (SELECT *, sum(title::INT) OVER (PARTITION BY chunk_idx ORDER BY i) AS part FROM marked),
        bodies AS (
            SELECT chunk_idx, part, regexp_replace(max(ln) FILTER (title), ':+$', '') AS heading, string_agg(ln, ' ' ORDER BY i) FILTER (NOT title) AS body
            FROM numbered GROUP BY ALL
        )
        SELECT chunk_idx, (row_number() OVER (PARTITION BY chunk_idx ORDER BY part) - 1)::INT AS piece_no, substr(body, 1, 1200) AS text, page, source, bodies.heading, 'text' AS modality,
               NULL::VARCHAR AS image_path, {tags} AS tags
        FROM bodies JOIN (SELECT chunk_idx, page, source FROM chunks) USING (chunk_idx) WHERE body IS NOT NULL
        UNION ALL {PASSED}
    """


TEXTS = "SELECT chunk_idx, coalesce(text, '') AS text FROM chunks"
TERMS = f"SELECT 0 AS query_id, term, count(*) AS times FROM (SELECT unnest({tokens(chr(39) + QUERY + chr(39))}) AS term) GROUP BY term"
BATCH = "SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_kind = 'query' AND doc_id % 20 = 0 AND text IS NOT NULL"
BATCH_TERMS = f"SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens('query')}) AS term FROM ({BATCH})) GROUP BY ALL"


def usable(v: str) -> str:
    return f"({v} IS NOT NULL AND list_bool_and(list_transform({v}, lambda x: isfinite(x))) AND list_bool_or(list_transform({v}, lambda x: x <> 0)))"


def cosine(a: str, b: str) -> str:
    return f"(CASE WHEN {usable(a)} AND {usable(b)} THEN list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]) ELSE 0 END)"


EXAMPLE = f"SELECT embedding AS v FROM graph_rows WHERE {usable('embedding')} ORDER BY idx LIMIT 1"


def bm25(texts: str, terms: str, p: str = "") -> str:
    """Common table expressions that end in {p}bm (query_id, chunk_idx, bm25)."""
    return f"""
        {p}texts AS ({texts}), {p}tok AS (SELECT chunk_idx, {tokens('text')} AS ts FROM {p}texts),
        {p}post AS (SELECT chunk_idx, term, count(*) AS tf FROM (SELECT chunk_idx, unnest(ts) AS term FROM {p}tok) GROUP BY ALL),
        {p}dl AS (SELECT chunk_idx, len(ts) AS dl FROM {p}tok),
        {p}stat AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {p}dl),
        {p}raw AS (SELECT term, df, ln(n - df + 0.5e0) - ln(df + 0.5e0) AS raw FROM (SELECT term, count(*) AS df FROM {p}post GROUP BY term), {p}stat),
        {p}idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25e0 * (SELECT avg(raw) FROM {p}raw) ELSE raw END AS idf FROM {p}raw),
        {p}terms AS ({terms}),
        {p}bm AS (
            SELECT query_id, chunk_idx, sum(times * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS bm25
            FROM {p}post JOIN {p}terms USING (term) JOIN {p}idf USING (term) JOIN {p}dl USING (chunk_idx), {p}stat GROUP BY ALL
        )"""


def scaled(c: str) -> str:
    return f"CASE WHEN max({c}) OVER () - min({c}) OVER () < 1e-8 THEN 0 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"


SCORES = f"""{bm25(TEXTS, TERMS)},
        semq AS ({EXAMPLE}),
        sims AS (SELECT idx AS chunk_idx, {cosine('embedding', 'v')} AS sem FROM graph_rows, semq),
        both_ AS (SELECT chunk_idx, coalesce(sem, 0) AS sem, coalesce(bm25, 0) AS bm25 FROM chunks LEFT JOIN sims USING (chunk_idx) LEFT JOIN bm USING (chunk_idx)),
        scores AS (SELECT chunk_idx, sem, bm25, 0.6e0 * {scaled('sem')} + 0.4e0 * {scaled('bm25')} AS score FROM both_)"""
HITS = f"{SCORES}, hits AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_idx) AS rank FROM scores QUALIFY rank <= 5), found AS (SELECT * FROM hits JOIN chunks USING (chunk_idx))"

MENTION_ORDER = "struct_pack(a := extracted_at, b := char_pos, c := name, d := confidence, e := context)"
EDGES = """
        ends AS (SELECT DISTINCT canonical_form, entity_type FROM entities),
        edges AS (
            SELECT r.* FROM (
                SELECT *, row_number() OVER (PARTITION BY subj_canonical, subj_type, predicate, obj_canonical, obj_type ORDER BY chunk_idx DESC, coalesce(confidence, -1) DESC, coalesce(evidence, '') DESC) AS k
                FROM relations) r
            JOIN ends s ON s.canonical_form = subj_canonical AND s.entity_type = subj_type
            JOIN ends o ON o.canonical_form = obj_canonical AND o.entity_type = obj_type
            WHERE k = 1
        ),
        steps AS (
            SELECT concat_ws('|', subj_canonical, subj_type, predicate, obj_canonical, obj_type) AS edge, subj_canonical AS ff, subj_type AS ft, obj_canonical AS tf, obj_type AS tt FROM edges
            UNION ALL
            SELECT concat_ws('|', subj_canonical, subj_type, predicate, obj_canonical, obj_type), obj_canonical, obj_type, subj_canonical, subj_type FROM edges
            WHERE subj_canonical <> obj_canonical OR subj_type <> obj_type
        )"""
LINKS = """
        links AS (
            SELECT m.chunk_idx, m.canonical_form, m.entity_type, coalesce(m.char_pos, 0) AS char_pos, coalesce(m.context, '') AS context
            FROM mentions m JOIN (SELECT DISTINCT canonical_form, entity_type FROM entities) USING (canonical_form, entity_type) JOIN (SELECT chunk_idx FROM chunks) USING (chunk_idx)
            QUALIFY row_number() OVER (PARTITION BY m.chunk_idx, m.canonical_form, m.entity_type ORDER BY m.extracted_at DESC, coalesce(m.char_pos, 0) DESC, coalesce(m.context, '') DESC) = 1
        )"""
SEEDS = "seeds AS (SELECT entity_id AS seed, canonical_form, entity_type FROM entities WHERE entity_id % 20 = 0)"


def reached(seed: str = "seeds", name: str = "reach") -> str:
    """(seed, canonical_form, entity_type, distance) over up to two edges, none of them twice."""
    return f"""
        {name}1 AS (SELECT DISTINCT seed, tf, tt, edge FROM {seed} JOIN steps ON ff = canonical_form AND ft = entity_type),
        {name}2 AS (SELECT DISTINCT seed, s.tf, s.tt FROM {name}1 r JOIN steps s ON s.ff = r.tf AND s.ft = r.tt AND s.edge <> r.edge),
        {name} AS (
            SELECT DISTINCT seed, tf AS canonical_form, tt AS entity_type, 1 AS distance FROM {name}1
            UNION ALL SELECT seed, tf, tt, 2 FROM {name}2
        )"""


def ranked_reach(reach: str = "reach", name: str = "near") -> str:
    return f"""
        {name} AS (
            SELECT seed, canonical_form, entity_type, distance, importance_score,
                   row_number() OVER (PARTITION BY seed ORDER BY distance, importance_score DESC NULLS FIRST, canonical_form, entity_type) AS rank
            FROM {reach} JOIN entities USING (canonical_form, entity_type) QUALIFY rank <= 50
        )"""


ENTITY_TEXTS = "SELECT entity_id AS chunk_idx, concat_ws(' ', name, canonical_form, description) AS text FROM entities"
ASKED = f"""{bm25(ENTITY_TEXTS, TERMS, 'e_')},
        named AS (SELECT canonical_form, entity_type, bm25 AS score, entity_id, row_number() OVER (ORDER BY bm25 DESC, chunk_idx) AS rank FROM e_bm JOIN entities ON entity_id = chunk_idx QUALIFY rank <= 10),
        close AS (
            SELECT canonical_form, entity_type, round({cosine('embedding', 'v')}, 9) AS score FROM entities, semq WHERE {usable('embedding')}
            ORDER BY score DESC, entity_id LIMIT 5
        ),
        asked AS (
            SELECT canonical_form, entity_type, score FROM named
            UNION ALL SELECT * FROM close WHERE (SELECT count(*) FROM named) > 0 AND (canonical_form, entity_type) NOT IN (SELECT (canonical_form, entity_type) FROM named)
        )"""


def covered(k: int) -> str:
    """hitsk: the first k hits with coverage, centrality and place."""
    return f"""
        hitsk AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_idx) AS place FROM scores QUALIFY place <= {k}),
        keys AS (SELECT DISTINCT lower(canonical_form) AS key, entity_type FROM asked),
        cover AS (
            SELECT chunk_idx, count(*) / greatest((SELECT count(*) FROM keys), 1)::DOUBLE AS coverage
            FROM (SELECT DISTINCT chunk_idx, lower(canonical_form) AS key, entity_type FROM links) JOIN keys USING (key, entity_type) GROUP BY chunk_idx
        ),
        central AS (SELECT chunk_idx, least(1, count(*) / 5.0e0) AS centrality FROM links GROUP BY chunk_idx)"""


def expanded(most: int) -> str:
    """added (chunk_idx, relevance): chunks of entities related to those of the first three hits."""
    return f"""
        seeds AS (SELECT min(struct_pack(place := place, f := canonical_form, t := entity_type)) AS seed, canonical_form, entity_type FROM links JOIN hitsk USING (chunk_idx) WHERE place <= 3 GROUP BY canonical_form, entity_type),
        {reached()}, {ranked_reach()},
        firsts AS (
            SELECT canonical_form, entity_type, any_value(importance_score) AS importance_score, min(struct_pack(s := seed, r := rank)) AS first
            FROM near WHERE coalesce(importance_score, 0) >= 0.3 GROUP BY canonical_form, entity_type
        ),
        chosen AS (SELECT *, row_number() OVER (ORDER BY first) AS place FROM firsts QUALIFY place <= {most}),
        added AS (
            SELECT chunk_idx, min_by(importance_score, place) AS relevance FROM (
                SELECT *, row_number() OVER (PARTITION BY canonical_form, entity_type ORDER BY chunk_idx) AS r FROM links QUALIFY r <= 2
            ) JOIN chosen USING (canonical_form, entity_type) GROUP BY chunk_idx
        )"""


RESULT = "SELECT chunk_idx, round(sem, 6) AS sem, round(bm25, 6) AS bm25, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, place, chunk_idx) AS rank FROM mixed QUALIFY rank <= 5"
GUIDED = f"""{covered(5)}, {expanded(10)},
        mixed AS (
            SELECT chunk_idx, sem, bm25, score, place FROM hitsk
            UNION ALL SELECT chunk_idx, relevance * 0.5e0, 0, relevance * 0.5e0, 1 << 30 FROM added WHERE chunk_idx NOT IN (SELECT chunk_idx FROM hitsk)
        )"""
HYBRID = f"""{covered(20)}, {expanded(8)},
        mixed AS (
            SELECT chunk_idx, sem, bm25, score + coalesce(coverage, 0) * 0.3e0 + coalesce(centrality, 0) * 0.2e0 AS score, place
            FROM hitsk LEFT JOIN cover USING (chunk_idx) LEFT JOIN central USING (chunk_idx)
            UNION ALL SELECT chunk_idx, relevance * 0.4e0, 0, relevance * 0.4e0, 1 << 30 FROM added WHERE chunk_idx NOT IN (SELECT chunk_idx FROM hitsk)
        )"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The wording of the prompts, written out again so that a change of the operators' wording shows.
_DONT_KNOW = "If something is not in the contexts, say you don't know.\n\n"
CITATION_WORDING = (
    "You are a retrieval QA system. Use ONLY the provided contexts to answer.\nFor every factual statement, add an inline citation in the form "
    "[file:{source}, page:{page}, heading:{heading}] and include image link when available as [image:{image_path}].\n" + _DONT_KNOW
)
KG_WORDING = (
    "You are a retrieval QA system with access to a knowledge graph. Use ONLY the provided contexts, entities, and relationships to answer.\n"
    "For every factual statement, add an inline citation in the form [file:{source}, page:{page}, heading:{heading}].\n"
    "When referencing entities, use the format [entity:{entity_name}].\n" + _DONT_KNOW
)
QUESTION_WORDING = f"\n### Question\n{QUERY}\n\n### Answer (with citations):\n"
BLOCK = "'### Context ' || rank || chr(10) || 'Source: file=' || source || ', page=' || page || ', heading=' || CASE WHEN coalesce(heading, '') = '' THEN 'N/A' ELSE heading END || chr(10)"
IMAGE = "CASE WHEN coalesce(image_path, '') <> '' THEN 'Image: ' || image_path || chr(10) ELSE '' END"
CONTEXT = f"""
        own AS (SELECT canonical_form, entity_type, min(rank) AS place FROM links JOIN hits USING (chunk_idx) GROUP BY ALL),
        about AS (
            SELECT canonical_form, entity_type, description, confidence, coalesce(importance_score, confidence * 0.5e0) AS importance, place
            FROM own JOIN entities USING (canonical_form, entity_type)
        )"""
AROUND = """
        picked AS (SELECT canonical_form, entity_type FROM about ORDER BY place, canonical_form, entity_type LIMIT 10),
        around AS (
            SELECT DISTINCT subj_canonical AS source, subj_type AS source_type, obj_canonical AS target, obj_type AS target_type, predicate AS type, confidence
            FROM edges WHERE (subj_canonical, subj_type) IN (SELECT (canonical_form, entity_type) FROM picked)
            UNION
            SELECT obj_canonical, obj_type, subj_canonical, subj_type, predicate, confidence FROM edges WHERE (obj_canonical, obj_type) IN (SELECT (canonical_form, entity_type) FROM picked)
        ),
        numbered AS (SELECT *, row_number() OVER (ORDER BY source, source_type, type, target, target_type) AS o FROM around)"""
WHO = """
        who AS (
            SELECT '### Key Entities' || chr(10) || chr(10) || string_agg('- **' || canonical_form || '** (' || entity_type || ')' || CASE WHEN coalesce(description, '') <> '' THEN ': ' || description ELSE '' END, chr(10) ORDER BY o) || chr(10) AS t
            FROM (SELECT *, row_number() OVER (ORDER BY confidence DESC NULLS LAST, place, canonical_form, entity_type) AS o FROM about QUALIFY o <= 10)
        ),
        tied AS (
            SELECT '### Entity Relationships' || chr(10) || chr(10) || string_agg(chr(10) || '**' || type || '**:' || chr(10) || ps, chr(10) ORDER BY s) || chr(10) AS t FROM (
                SELECT type, s, string_agg('  - ' || source || ' → ' || target, chr(10) ORDER BY o) AS ps FROM (
                    SELECT *, row_number() OVER (PARTITION BY type ORDER BY o) AS n, min(o) OVER (PARTITION BY type) AS s FROM numbered WHERE o <= 15
                ) WHERE n <= 5 GROUP BY type, s)
        )"""
DRAWN = "string_agg(source || ' --[' || type || ']-> ' || target, chr(10) ORDER BY o)"

SQUEEZED = f"trim(regexp_replace(name, '{BLANK}+', ' ', 'g'))"
TITLED = f"array_to_string(list_transform(range(1, length({SQUEEZED}) + 1), lambda i: CASE WHEN i > 1 AND regexp_matches(substr({SQUEEZED}, i - 1, 1), '\\p{{L}}') THEN lower(substr({SQUEEZED}, i, 1)) ELSE upper(substr({SQUEEZED}, i, 1)) END), '')"
REPLIES = r"""
        replies AS (
            SELECT doc_id, CASE WHEN f <> '' THEN f WHEN b <> '' THEN b ELSE text END AS j FROM (
                SELECT doc_id, text, regexp_extract(text, '(?s)```(?:json)?\s*(\{.*?\})\s*```', 1) AS f, regexp_extract(text, '(?s)\{.*\}', 0) AS b FROM documents WHERE doc_kind = 'llm_reply' AND text IS NOT NULL)
        ),
        sound AS (SELECT doc_id, j::JSON AS j FROM replies WHERE json_valid(j)),
        ents AS (
            SELECT doc_id, i - 1 AS seq, coalesce(e->>'name', '') AS name, coalesce(e->>'canonical', e->>'name', '') AS canonical_form, coalesce(e->>'type', 'Concept') AS entity_type,
                   e->>'confidence' AS said, coalesce(e->>'description', '') AS description
            FROM (SELECT doc_id, unnest(es) AS e, generate_subscripts(es, 1) AS i FROM (SELECT doc_id, json_extract(j, '$.entities[*]') AS es FROM sound))
        ),
        bad AS (SELECT doc_id, min(seq) AS stop FROM ents WHERE said IS NOT NULL AND try_cast(said AS DOUBLE) IS NULL GROUP BY doc_id)"""

#: The stand-in recogniser's patterns and what their labels stand for.
NER = [
    ("ORG", "Organization", r"\b[A-Z][a-z]+ (?:Institute|Department) of [A-Z][a-z]+\b"), ("PERCENT", "Concept", r"\b\d+ percent\b"),
    ("DATE", "Date", r"\b(?:1[89]|20)\d\d\b"), ("PRODUCT", "Product", r"\b[A-Z][a-z]+ (?:Reader|Scanner|Recorder|Analyser) \d+\b"),
]


def found_spans(texts: str) -> str:
    """Common table expressions that end in ner (chunk_idx, name, char_pos, spacy_label, entity_type, canonical_form, context)."""
    hits = " UNION ALL ".join(
        f"SELECT chunk_idx, text, '{label}' AS spacy_label, '{kind}' AS entity_type, regexp_extract_all(text, '{pattern}') AS hits, regexp_split_to_array(text, '{pattern}') AS gaps FROM spoken"
        for label, kind, pattern in NER
    )
    return f"""
        spoken AS ({texts}), hit AS ({hits}),
        each AS (SELECT chunk_idx, text, spacy_label, entity_type, hits[i] AS name, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda g: length(g))), 0))::INT AS char_pos
                 FROM (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM hit WHERE len(hits) > 0)),
        ner AS (SELECT chunk_idx, name, char_pos, spacy_label, entity_type, CASE WHEN entity_type IN ('Organization', 'Product') THEN {TITLED} ELSE lower({SQUEEZED}) END AS canonical_form,
                       substr(text, greatest(char_pos - 50, 0) + 1, char_pos + length(name) + 50 - greatest(char_pos - 50, 0)) AS context FROM each)"""


SPOKEN = "SELECT chunk_idx, text FROM chunks WHERE modality = 'text' AND length(text) > 0"
RESOLVED = f"""{found_spans(SPOKEN)},
        merged AS (SELECT * FROM ner QUALIFY row_number() OVER (PARTITION BY chunk_idx, lower(canonical_form), entity_type ORDER BY char_pos DESC, name DESC) = 1),
        resolved AS (SELECT lower(canonical_form) AS entity_key, canonical_form, entity_type, 0.8e0 AS confidence, count(*) OVER w AS occurrences, count(DISTINCT chunk_idx) OVER w AS n_chunks
                     FROM merged WINDOW w AS (PARTITION BY lower(canonical_form))
                     QUALIFY row_number() OVER (PARTITION BY lower(canonical_form) ORDER BY chunk_idx, char_pos, canonical_form, entity_type) = 1)"""
IS_TRIPLES = """SELECT chunk_idx, l[-1] AS subj, 'is' AS pred, r[1] AS obj FROM (
            SELECT chunk_idx, list_filter(regexp_split_to_array(p[1], '[\\s\\x{0b}]+'), lambda w: w <> '') AS l, list_filter(regexp_split_to_array(p[2], '[\\s\\x{0b}]+'), lambda w: w <> '') AS r
            FROM (SELECT chunk_idx, string_split(text, ' is ') AS p FROM chunks WHERE text IS NOT NULL) WHERE len(p) = 2) WHERE len(l) > 0 AND len(r) > 0"""
HYBRID_SEARCH = f"WITH {HITS} SELECT rank::INT AS rank, chunk_idx, round(score, 6) AS score, round(sem, 6) AS sem, round(bm25, 6) AS bm25 FROM hits"
DRAWN_FULL = """
        ends_ AS (SELECT source AS form, source_type AS kind FROM numbered UNION SELECT target, target_type FROM numbered),
        nodes AS (SELECT string_agg('  - ' || form || ' (' || kind || ')', chr(10) ORDER BY form, kind) AS t FROM (SELECT * FROM ends_ ORDER BY form, kind LIMIT 10)),
        ties AS (SELECT string_agg('  - ' || source || ' --[' || type || ', ' || printf('%.2f', coalesce(confidence, 0)) || ']-> ' || target, chr(10) ORDER BY o) AS t FROM numbered WHERE o <= 15)
        SELECT 'Nodes:' || chr(10) || nodes.t || chr(10) || chr(10) || 'Connections:' || chr(10) || ties.t AS text FROM nodes, ties"""

ORACLES = {
    "ner_mentions": f"WITH {found_spans(SPOKEN)} SELECT chunk_idx, name, canonical_form, entity_type, 0.8e0 AS confidence, char_pos, context, spacy_label FROM ner",
    "kg_extract": f"WITH {RESOLVED} SELECT *, least(1, occurrences / 10.0e0) AS importance_score FROM resolved WHERE entity_type <> ''",
    "kg_vectors": f"""WITH {RESOLVED} SELECT entity_key, list_transform(c, lambda x: round((CASE WHEN s = 0 THEN 0 ELSE x / sqrt(s) END)::FLOAT::DOUBLE, 5)) AS embedding
        FROM (SELECT entity_key, c, list_dot_product(c, c) AS s FROM (SELECT entity_key, {hashed('canonical_form')} AS c FROM resolved))""",
    "extraction_counters": f"""WITH own AS (SELECT chunk_idx, text, md5(text) AS m FROM chunks WHERE modality = 'text' AND length(text) > 0), kept AS (SELECT DISTINCT md5(text) AS m FROM graph_rows WHERE length(text) > 0),
        new AS (SELECT min(chunk_idx) AS chunk_idx, any_value(text) AS text FROM own WHERE m NOT IN (SELECT m FROM kept) GROUP BY m), {found_spans('SELECT * FROM new')},
        reads AS (SELECT new.chunk_idx, count(name) AS n FROM new LEFT JOIN ner USING (chunk_idx) GROUP BY 1)
        SELECT (SELECT count(*) FROM own WHERE m IN (SELECT m FROM kept)) AS cache_hits, (SELECT count(*) FROM own WHERE m NOT IN (SELECT m FROM kept)) AS cache_misses,
               (SELECT count(*) FROM reads WHERE n >= 3) AS llm_calls, (SELECT count(*) FROM reads WHERE n < 3) AS llm_skipped""",
    "extraction_kept": f"""WITH {found_spans(SPOKEN)},
        merged AS (SELECT * FROM ner QUALIFY row_number() OVER (PARTITION BY chunk_idx, lower(canonical_form), entity_type ORDER BY char_pos DESC, name DESC) = 1)
        SELECT entity_type, canonical_form, count(*) AS n, sum(char_pos)::BIGINT AS positions FROM merged GROUP BY ALL""",
    "decoded_relations": """WITH own AS (SELECT chunk_idx, canonical_form, entity_type, confidence FROM mentions
            QUALIFY row_number() OVER (PARTITION BY chunk_idx, canonical_form, entity_type ORDER BY name DESC NULLS LAST, confidence DESC NULLS LAST, char_pos DESC NULLS LAST) = 1)
        SELECT r.chunk_idx, subj_canonical, subj_type, predicate, obj_canonical, obj_type, r.confidence, evidence, coalesce(a.confidence, 0.5e0) AS subj_confidence, coalesce(b.confidence, 0.5e0) AS obj_confidence
        FROM relations r LEFT JOIN own a ON a.chunk_idx = r.chunk_idx AND a.canonical_form = subj_canonical AND a.entity_type = subj_type
        LEFT JOIN own b ON b.chunk_idx = r.chunk_idx AND b.canonical_form = obj_canonical AND b.entity_type = obj_type""",
    "export_roundtrip": """SELECT entity_type AS kind, count(*) AS n, count(confidence) AS n_sure, round(sum(confidence), 6) AS sure FROM entities GROUP BY 1
        UNION ALL SELECT predicate, count(*), count(confidence), round(sum(confidence), 6) FROM relations GROUP BY 1""",
    "triples_appended": f"""SELECT subj, pred, obj, count(*) AS n FROM (
            SELECT subj_canonical AS subj, predicate AS pred, obj_canonical AS obj FROM relations UNION ALL SELECT subj, pred, obj FROM ({IS_TRIPLES})) GROUP BY ALL""",
    "repeated_mentions": "SELECT chunk_idx, canonical_form, entity_type, count(*) AS n FROM mentions GROUP BY ALL HAVING count(*) > 1",
    "agreeing_rows": "SELECT idx AS chunk_idx, g.source, g.page, g.heading FROM graph_rows g JOIN chunks c ON c.chunk_idx = idx WHERE g.source IS NOT DISTINCT FROM c.source AND g.page IS NOT DISTINCT FROM c.page",
    "hybrid_graph_hits": f"""WITH {bm25(TEXTS, TERMS)}, semq AS ({EXAMPLE}),
        near AS (SELECT idx AS chunk_idx, {cosine('embedding', 'v')} AS sem, source, page, {usable('embedding')} AS sound FROM graph_rows, semq),
        best AS (SELECT chunk_idx, source, page, round((1 + sem) / 2, 9) AS score FROM near WHERE sound ORDER BY score DESC, chunk_idx LIMIT 15),
        raised AS (SELECT b.chunk_idx, b.score FROM best b JOIN chunks c ON c.chunk_idx = b.chunk_idx AND c.source IS NOT DISTINCT FROM b.source AND c.page IS NOT DISTINCT FROM b.page),
        both_ AS (SELECT chunk_idx, greatest(coalesce(sem, 0), coalesce(raised.score, -1)) AS sem, coalesce(bm25, 0) AS bm25 FROM chunks LEFT JOIN (SELECT chunk_idx, sem FROM near) USING (chunk_idx) LEFT JOIN bm USING (chunk_idx) LEFT JOIN raised USING (chunk_idx)),
        scores AS (SELECT chunk_idx, sem, bm25, 0.6e0 * {scaled('sem')} + 0.4e0 * {scaled('bm25')} AS score FROM both_)
        SELECT (row_number() OVER (ORDER BY score DESC, chunk_idx))::INT AS rank, chunk_idx, round(score, 6) AS score, round(sem, 6) AS sem, round(bm25, 6) AS bm25 FROM scores QUALIFY rank <= 5""",
    "kept_index": HYBRID_SEARCH,
    "hybrid_batch": f"""WITH {bm25(TEXTS, BATCH_TERMS)}, asked AS ({BATCH}),
        coded AS (SELECT chunk_idx, c, sqrt(list_dot_product(c, c)) AS s FROM (SELECT chunk_idx, {hashed('text')} AS c FROM texts)),
        qcoded AS (SELECT query_id, c, sqrt(list_dot_product(c, c)) AS s FROM (SELECT query_id, {hashed('query')} AS c FROM asked)),
        every AS (SELECT query_id, chunk_idx, CASE WHEN q.s * d.s = 0 THEN 0 ELSE round(list_dot_product(q.c, d.c) / (q.s * d.s), 9) END AS sem, coalesce(bm25, 0) AS bm25
                  FROM qcoded q CROSS JOIN coded d LEFT JOIN bm USING (query_id, chunk_idx)),
        ranges AS (SELECT query_id, min(sem) AS ls, max(sem) AS hs, min(bm25) AS lb, max(bm25) AS hb FROM every GROUP BY query_id),
        mixed AS (SELECT query_id, chunk_idx, sem, bm25, round(0.6e0 * CASE WHEN hs - ls < 1e-8 THEN 0 ELSE (sem - ls) / (hs - ls) END + 0.4e0 * CASE WHEN hb - lb < 1e-8 THEN 0 ELSE (bm25 - lb) / (hb - lb) END, 9) AS score
                  FROM every JOIN ranges USING (query_id))
        SELECT query_id, chunk_idx, round(sem, 6) AS sem, round(bm25, 6) AS bm25, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_idx))::INT AS rank FROM mixed QUALIFY rank <= 5""",
    "vector_pairs": f"""WITH {EDGES} SELECT DISTINCT subj_canonical, subj_type, obj_canonical, obj_type, round({cosine('s.embedding', 'o.embedding')}, 6) AS sem
        FROM edges JOIN entities s ON s.canonical_form = subj_canonical AND s.entity_type = subj_type JOIN entities o ON o.canonical_form = obj_canonical AND o.entity_type = obj_type""",
    "kept_tables": """SELECT c.source, n_chunks, n_chars, n_tagged, coalesce(n_rows, 0) AS n_rows, coalesce(n_vectors, 0) AS n_vectors FROM
        (SELECT source, count(*) AS n_chunks, sum(length(coalesce(text, '')))::BIGINT AS n_chars, count(tags) AS n_tagged FROM chunks GROUP BY source) c
        LEFT JOIN (SELECT ch.source, count(*) AS n_rows, count(embedding) AS n_vectors FROM chunks ch JOIN graph_rows g ON g.idx = ch.chunk_idx GROUP BY 1) g USING (source)""",
    "prompt_images": f"""WITH {HITS} SELECT 'You are a retrieval QA system. Use ONLY the provided contexts to answer.' || chr(10) || 'For every factual statement, add an inline citation in the form [file:{{source}}, page:{{page}}, heading:{{heading}}].' || chr(10)
            || 'If something is not in the contexts, say you don''t know.' || chr(10) || chr(10)
            || string_agg({BLOCK} || CASE WHEN modality = 'text' THEN text ELSE coalesce('[Image at ' || image_path || ']', '') END || chr(10), chr(10) ORDER BY rank)
            || chr(10) || '### Question' || chr(10) || {quoted(QUERY)} || chr(10) || chr(10) || '### Answer (with citations):' || chr(10) AS prompt FROM found""",
    "prompt_entity": f"""WITH {HITS}, {LINKS}, {EDGES}, {CONTEXT}, {AROUND},
        five AS (SELECT *, row_number() OVER (ORDER BY place, canonical_form, entity_type) AS n FROM about QUALIFY n <= 5),
        shown AS (SELECT canonical_form, entity_type, chunk_idx, row_number() OVER (PARTITION BY canonical_form, entity_type ORDER BY chunk_idx) AS k FROM links QUALIFY k <= 3),
        lines AS (SELECT f.n, f.canonical_form, string_agg(k || '. [' || source || ', p.' || page || ']: ' || substr(coalesce(text, ''), 1, 200) || '...', chr(10) ORDER BY k) AS t
                  FROM five f JOIN shown USING (canonical_form, entity_type) JOIN chunks USING (chunk_idx) GROUP BY ALL)
        SELECT 'You are answering a question about specific entities using information from documents.' || chr(10) || 'Provide accurate information with citations.' || chr(10) || chr(10)
            || concat_ws(chr(10),
                '### Entities in Question' || chr(10) || chr(10) || (SELECT string_agg('**' || canonical_form || '** (' || entity_type || ')' || CASE WHEN coalesce(description, '') <> '' THEN ': ' || description ELSE '' END, chr(10) ORDER BY n) FROM five) || chr(10),
                (SELECT '### Known Relationships' || chr(10) || chr(10) || string_agg('- ' || source || ' ' || type || ' ' || target, chr(10) ORDER BY o) || chr(10) FROM numbered WHERE o <= 10),
                '### Relevant Information' || chr(10) || chr(10) || (SELECT string_agg(chr(10) || '**About ' || canonical_form || ':**' || chr(10) || chr(10) || t, chr(10) ORDER BY n) FROM lines) || chr(10))
            || '### Question' || chr(10) || {quoted(QUERY)} || chr(10) || chr(10) || '### Answer:' || chr(10) AS prompt""",
    "kg_viz_full": f"WITH {HITS}, {LINKS}, {EDGES}, {CONTEXT}, {AROUND}, {DRAWN_FULL}",
    "canonicalize": f"""SELECT DISTINCT name, entity_type, CASE WHEN entity_type IN ('Person', 'Organization', 'Location', 'Product', 'Event') THEN {TITLED}
        WHEN entity_type = 'Technical_Term' THEN {SQUEEZED} ELSE lower({SQUEEZED}) END AS canonical FROM mentions""",
    "llm_parse_entities": f"""WITH {REPLIES} SELECT doc_id, seq::INT AS seq, name, canonical_form, entity_type, coalesce(try_cast(said AS DOUBLE), 0.7e0) AS confidence, description
        FROM ents LEFT JOIN bad USING (doc_id) WHERE stop IS NULL OR seq < stop""",
    "llm_parse_relations": f"""WITH {REPLIES},
        rels AS (
            SELECT doc_id, i - 1 AS seq, coalesce(r->>'subject', '') AS s, coalesce(r->>'object', '') AS o, coalesce(r->>'predicate', '') AS predicate, r->>'confidence' AS said, coalesce(r->>'evidence', '') AS evidence
            FROM (SELECT doc_id, unnest(rs) AS r, generate_subscripts(rs, 1) AS i FROM (SELECT doc_id, json_extract(j, '$.relations[*]') AS rs FROM sound)) WHERE doc_id NOT IN (SELECT doc_id FROM bad)
        ),
        stops AS (SELECT doc_id, min(seq) AS stop FROM rels WHERE said IS NOT NULL AND try_cast(said AS DOUBLE) IS NULL GROUP BY doc_id),
        byname AS (SELECT doc_id, lower(canonical_form) AS k, arg_max(canonical_form, seq) AS form, arg_max(entity_type, seq) AS kind FROM ents GROUP BY ALL)
        SELECT r.doc_id, seq::INT AS seq, coalesce(a.form, s) AS subj_canonical, coalesce(a.kind, 'Concept') AS subj_type, predicate, coalesce(b.form, o) AS obj_canonical, coalesce(b.kind, 'Concept') AS obj_type,
               coalesce(try_cast(said AS DOUBLE), 0.7e0) AS confidence, evidence
        FROM rels r LEFT JOIN stops USING (doc_id) LEFT JOIN byname a ON a.doc_id = r.doc_id AND a.k = lower(s) LEFT JOIN byname b ON b.doc_id = r.doc_id AND b.k = lower(o) WHERE stop IS NULL OR seq < stop""",
    "repoint_relations": """WITH res AS (SELECT lower(canonical_form) AS k, arg_min(canonical_form, struct_pack(a := -coalesce(confidence, -1), b := entity_id)) AS form, arg_min(entity_type, struct_pack(a := -coalesce(confidence, -1), b := entity_id)) AS kind FROM entities GROUP BY 1)
        SELECT coalesce(a.form, subj_canonical) AS subj_canonical, subj_type, predicate, coalesce(b.form, obj_canonical) AS obj_canonical, obj_type, confidence, chunk_idx, evidence
        FROM relations LEFT JOIN res a ON a.k = lower(subj_canonical) AND a.kind = subj_type LEFT JOIN res b ON b.k = lower(obj_canonical) AND b.kind = obj_type""",
    "link_mentions_page": """SELECT source, page, m.canonical_form, m.entity_type, coalesce(m.char_pos, 0) AS char_pos, coalesce(m.context, '') AS context
        FROM mentions m JOIN (SELECT DISTINCT canonical_form, entity_type FROM entities) USING (canonical_form, entity_type) JOIN (SELECT chunk_idx, source, page FROM chunks) USING (chunk_idx)
        QUALIFY row_number() OVER (PARTITION BY source, page, m.canonical_form, m.entity_type ORDER BY m.extracted_at DESC, coalesce(m.char_pos, 0) DESC, coalesce(m.context, '') DESC) = 1""",
    "dataset_fingerprint": """WITH d AS (SELECT dataset_key, md5(chunk_idx::VARCHAR || '|' || coalesce(length(text), -1)::VARCHAR || '|' || coalesce(text, '')) AS h FROM chunks)
        SELECT dataset_key, count(*) AS n_rows, md5(concat_ws('-', sum(('0x' || substr(h, 1, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 9, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 17, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 25, 8))::BIGINT)::VARCHAR)) AS fingerprint
        FROM d GROUP BY dataset_key""",
    "sentences": f"WITH {SAID} SELECT chunk_idx, (generate_subscripts(ss, 1) - 1)::INT AS sentence_no, unnest(ss) AS sentence FROM said",
    "chunk_size": f"WITH RECURSIVE {SAID}, {folded(150)}",
    "chunk_size_no_overlap": f"WITH RECURSIVE {SAID}, {folded(0)}",
    "chunk_section": sections(None),
    "chunk_section_tags": sections(KEYWORDS),
    "chunk_semantic": f"""WITH RECURSIVE said0 AS (SELECT chunk_idx, page, source, heading, {SENTENCES} AS ss FROM chunks WHERE {IS_TEXT}),
        coded AS (SELECT chunk_idx, i, {hashed('s')} AS v FROM (SELECT chunk_idx, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM said0)),
        sims AS (
            SELECT a.chunk_idx, list(CASE WHEN sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) = 0 THEN 0 ELSE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) END ORDER BY a.i) AS near
            FROM coded a JOIN coded b ON b.chunk_idx = a.chunk_idx AND b.i = a.i + 1 GROUP BY a.chunk_idx
        ),
        said AS (SELECT said0.*, near FROM said0 LEFT JOIN sims USING (chunk_idx)),
        {folded(150, 'round(near[i], 9) >= 0.35e0', False).replace('SELECT chunk_idx, ss, 1 AS i', 'SELECT chunk_idx, ss, near, 1 AS i', 1).replace('SELECT chunk_idx, ss, i + 1', 'SELECT chunk_idx, ss, near, i + 1', 1)}""",
    "modality_counts": "SELECT count(*) FILTER (modality = 'text' AND length(text) > 0) AS n_text, count(*) FILTER (modality = 'image') AS n_image, count(*) AS n_chunks FROM chunks",
    "effective_text": TEXTS,
    "term_stats": f"WITH {bm25(TEXTS, TERMS)} SELECT chunk_idx, term, tf::INT AS tf FROM post",
    "doc_lengths": f"WITH {bm25(TEXTS, TERMS)} SELECT chunk_idx, dl::INT AS dl FROM dl",
    "idf": f"WITH {bm25(TEXTS, TERMS)} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {bm25(TEXTS, TERMS)} SELECT query_id, chunk_idx, round(bm25, 6) AS bm25, row_number() OVER (ORDER BY bm25 DESC, chunk_idx)::INT AS rank FROM bm QUALIFY rank <= 5",
    "bm25_batch": f"WITH {bm25(TEXTS, BATCH_TERMS)} SELECT query_id, chunk_idx, round(bm25, 6) AS bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, chunk_idx)::INT AS rank FROM bm QUALIFY rank <= 5",
    "query_expansion": f"""WITH typed AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(query, '\\s+'), lambda t: t <> '')) AS word FROM ({BATCH})),
        syn(term, lemma) AS (VALUES {', '.join(map(str, SYNONYMS))}),
        bag AS (SELECT * FROM typed UNION SELECT query_id, lower(word) FROM typed UNION SELECT query_id, lower(replace(lemma, '_', ' ')) FROM typed JOIN syn ON lower(term) = lower(word))
        SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens('word')}) AS term FROM bag) GROUP BY ALL""",
    "vector_topk": f"WITH semq AS ({EXAMPLE}) SELECT idx AS chunk_idx, round({cosine('embedding', 'v')}, 6) AS sem, row_number() OVER (ORDER BY round({cosine('embedding', 'v')}, 9) DESC, idx)::INT AS rank FROM graph_rows, semq QUALIFY rank <= 10",
    "vector_batch": f"""WITH sound AS (SELECT idx, embedding::DOUBLE[] AS v FROM graph_rows WHERE {usable('embedding')})
        SELECT q.idx AS query_id, d.idx AS chunk_idx, round(round(list_cosine_similarity(q.v, d.v), 9), 6) AS sem,
               row_number() OVER (PARTITION BY q.idx ORDER BY round(list_cosine_similarity(q.v, d.v), 9) DESC, d.idx)::INT AS rank
        FROM sound q, sound d WHERE q.idx % 20 = 0 QUALIFY rank <= 5""",
    "hash_embedding": f"""SELECT chunk_idx, list_transform(c, lambda x: round(CASE WHEN s = 0 THEN 0 ELSE x / sqrt(s) END, 6)) AS embedding
        FROM (SELECT chunk_idx, c, list_dot_product(c, c) AS s FROM (SELECT chunk_idx, {hashed('text')} AS c FROM chunks WHERE text IS NOT NULL))""",
    "minmax_fusion": f"WITH {SCORES} SELECT chunk_idx, round(sem, 6) AS sem, round(bm25, 6) AS bm25, round(score, 6) AS score FROM scores",
    "hybrid_search": f"WITH {HITS} SELECT rank::INT AS rank, chunk_idx, round(score, 6) AS score, round(sem, 6) AS sem, round(bm25, 6) AS bm25 FROM hits",
    "search_response": f"""WITH {HITS} SELECT round(score, 6) AS score, round(sem, 6) AS sem, round(bm25, 6) AS bm25, text, page, source, heading, image_path,
        CASE WHEN starts_with(image_path, 'figures/') THEN '/cache/' || replace(substr(image_path, 9), '\\', '/') END AS image_url, tags FROM found""",
    "search_preview": f"WITH {HITS} SELECT chunk_idx, replace(substr(text, 1, 180), chr(10), ' ') || CASE WHEN length(text) > 180 THEN '...' ELSE '' END AS preview FROM found",
    "graph_row_projection": "SELECT source, page, coalesce(heading, '') AS heading, chunk_idx AS idx, c.text, c.image_path, c.tags, len(embedding) AS dim FROM chunks c JOIN (SELECT idx AS chunk_idx, embedding FROM graph_rows) USING (chunk_idx)",
    "confident_mentions": "SELECT chunk_idx, name, entity_type, confidence FROM mentions WHERE confidence >= 0.7 AND entity_type IN ('Person', 'Organization')",
    "merge_entities": f"""WITH last AS (
            SELECT chunk_idx, lower(canonical_form) AS entity_key, entity_type, extraction_method = 'llm' AS llm, max(struct_pack(o := {MENTION_ORDER}, name := name, canonical_form := canonical_form, confidence := confidence, char_pos := char_pos, context := context, m := extraction_method)) AS r
            FROM (SELECT *, row_number() OVER (PARTITION BY chunk_idx, lower(canonical_form), entity_type, extraction_method = 'llm' ORDER BY extracted_at DESC NULLS LAST, char_pos DESC NULLS LAST, name DESC NULLS LAST, confidence DESC NULLS LAST, context DESC NULLS LAST) AS k FROM mentions)
            WHERE k = 1 GROUP BY ALL
        ),
        sides AS (SELECT chunk_idx, entity_key, entity_type, any_value(r) FILTER (llm) AS l, any_value(r) FILTER (NOT llm) AS n FROM last GROUP BY ALL)
        SELECT chunk_idx, entity_key, entity_type, CASE WHEN l IS NOT NULL THEN l.name ELSE n.name END AS name, CASE WHEN l IS NOT NULL THEN l.canonical_form ELSE n.canonical_form END AS canonical_form,
               CASE WHEN l IS NOT NULL THEN l.confidence ELSE n.confidence END AS confidence, coalesce(l.char_pos, n.char_pos) AS char_pos,
               CASE WHEN l IS NULL OR coalesce(l.context, '') = '' THEN n.context ELSE l.context END AS context, CASE WHEN l IS NOT NULL THEN l.m ELSE n.m END AS extraction_method
        FROM sides""",
    "resolve_entities": """SELECT lower(canonical_form) AS entity_key, arg_min(name, struct_pack(a := -coalesce(confidence, -1), b := entity_id)) AS name, arg_min(canonical_form, struct_pack(a := -coalesce(confidence, -1), b := entity_id)) AS canonical_form,
        arg_min(entity_type, struct_pack(a := -coalesce(confidence, -1), b := entity_id)) AS entity_type, max(confidence) AS confidence,
        arg_min(description, struct_pack(a := -coalesce(confidence, -1), b := entity_id)) FILTER (coalesce(description, '') <> '') AS description, count(*) AS n_rows,
        sum(coalesce(occurrences, 1))::BIGINT AS occurrences, least(1, sum(coalesce(occurrences, 1)) / 10.0e0) AS importance_score FROM entities GROUP BY 1""",
    "resolve_mentions": """WITH r AS (SELECT *, lower(canonical_form) AS entity_key, row_number() OVER (PARTITION BY lower(canonical_form) ORDER BY coalesce(confidence, -1) DESC, chunk_idx, coalesce(char_pos, -1), canonical_form, entity_type) AS k FROM mentions)
        SELECT entity_key, any_value(canonical_form) FILTER (k = 1) AS canonical_form, any_value(entity_type) FILTER (k = 1) AS entity_type, max(confidence) AS confidence, count(*) AS occurrences, count(DISTINCT chunk_idx) AS n_chunks FROM r GROUP BY entity_key""",
    "importance": "SELECT entity_id, least(1, coalesce(occurrences, 1) / 10.0e0) AS importance FROM entities",
    "distinct_relations": """SELECT subj_canonical, subj_type, predicate, obj_canonical, obj_type, confidence, chunk_idx, evidence FROM relations
        QUALIFY row_number() OVER (PARTITION BY subj_canonical, subj_type, predicate, obj_canonical, obj_type ORDER BY chunk_idx, coalesce(confidence, -1), coalesce(evidence, '')) = 1""",
    "upsert_entities": """WITH new AS (
            SELECT canonical_form, entity_type, name, confidence, count(*) OVER (PARTITION BY canonical_form, entity_type) AS occurrences FROM mentions
            QUALIFY row_number() OVER (PARTITION BY canonical_form, entity_type ORDER BY coalesce(confidence, -1) DESC, chunk_idx, coalesce(char_pos, -1), name) = 1
        )
        SELECT canonical_form, entity_type, CASE WHEN n.canonical_form IS NOT NULL THEN n.name ELSE e.name END AS name, CASE WHEN n.canonical_form IS NOT NULL THEN n.confidence ELSE e.confidence END AS confidence,
               coalesce(n.occurrences, e.occurrences) AS occurrences FROM entities e FULL JOIN new n USING (canonical_form, entity_type)""",
    "upsert_relations": f"WITH {EDGES} SELECT subj_canonical, subj_type, predicate, obj_canonical, obj_type, confidence, chunk_idx, coalesce(evidence, '') AS evidence FROM edges",
    "link_mentions": f"WITH {LINKS} SELECT chunk_idx, canonical_form, entity_type, char_pos, context FROM links",
    "graph_stats": f"WITH {EDGES} SELECT (SELECT count(*) FROM entities) AS n_entities, (SELECT count(*) FROM edges) AS n_relations, (SELECT count(*) FROM chunks) AS n_chunks",
    "type_histogram": "SELECT entity_type, count(*) AS n FROM entities GROUP BY entity_type",
    "is_triples": """SELECT chunk_idx, l[-1] AS subj, 'is' AS pred, r[1] AS obj FROM (
            SELECT chunk_idx, list_filter(regexp_split_to_array(p[1], '[\\s\\x{0b}]+'), lambda w: w <> '') AS l, list_filter(regexp_split_to_array(p[2], '[\\s\\x{0b}]+'), lambda w: w <> '') AS r
            FROM (SELECT chunk_idx, string_split(text, ' is ') AS p FROM chunks WHERE text IS NOT NULL) WHERE len(p) = 2) WHERE len(l) > 0 AND len(r) > 0""",
    "successors": "SELECT DISTINCT subj_canonical AS subj, obj_canonical AS obj FROM relations",
    "khop_neighbors": f"WITH {EDGES}, {SEEDS}, {reached()}, {ranked_reach()} SELECT seed, canonical_form, entity_type, distance, rank::INT AS rank FROM near",
    "related_entities": f"""WITH {EDGES}, {SEEDS}, {reached()}, {ranked_reach()}
        SELECT canonical_form, entity_type, any_value(importance_score) AS importance_score, min(struct_pack(s := seed, r := rank)).s AS seed, min(struct_pack(s := seed, r := rank)).r::INT AS rank
        FROM near WHERE coalesce(importance_score, 0) >= 0.3 GROUP BY ALL""",
    "shortest_path": f"""WITH RECURSIVE {EDGES}, {SEEDS},
        pairs AS (SELECT seed AS pair, canonical_form AS ff, entity_type AS ft, lead(canonical_form) OVER (ORDER BY seed) AS gf, lead(entity_type) OVER (ORDER BY seed) AS gt FROM seeds),
        hop AS (SELECT DISTINCT ff, ft, tf, tt FROM steps),
        ways AS (
            SELECT pair, gf, gt, ff AS f, ft AS t, [struct_pack(form := ff, kind := ft)] AS path FROM pairs WHERE gf IS NOT NULL
            UNION ALL
            SELECT pair, gf, gt, h.tf, h.tt, list_append(path, struct_pack(form := h.tf, kind := h.tt)) FROM ways w JOIN hop h ON h.ff = w.f AND h.ft = w.t
            WHERE len(path) <= 3 AND NOT list_contains(path, struct_pack(form := h.tf, kind := h.tt))
        )
        SELECT pair, (len(path) - 1)::INT AS distance, array_to_string(list_transform(path, lambda v: v.form), ' > ') AS path
        FROM ways WHERE f = gf AND t = gt AND len(path) > 1 QUALIFY row_number() OVER (PARTITION BY pair ORDER BY len(path), path) = 1""",
    "subgraph": f"""WITH {EDGES}, {SEEDS}
        SELECT DISTINCT subj_canonical AS source, subj_type AS source_type, obj_canonical AS target, obj_type AS target_type, predicate AS type, confidence FROM edges WHERE (subj_canonical, subj_type) IN (SELECT (canonical_form, entity_type) FROM seeds)
        UNION SELECT obj_canonical, obj_type, subj_canonical, subj_type, predicate, confidence FROM edges WHERE (obj_canonical, obj_type) IN (SELECT (canonical_form, entity_type) FROM seeds)""",
    "subgraph_inner": f"""WITH {EDGES}, chosen AS (SELECT canonical_form, entity_type FROM entities WHERE entity_type IN ('Person', 'Organization'))
        SELECT subj_canonical AS source, subj_type AS source_type, obj_canonical AS target, obj_type AS target_type, predicate AS type, confidence FROM edges
        WHERE (subj_canonical, subj_type) IN (SELECT (canonical_form, entity_type) FROM chosen) AND (obj_canonical, obj_type) IN (SELECT (canonical_form, entity_type) FROM chosen)""",
    "entity_chunks": f"WITH {LINKS} SELECT canonical_form, entity_type, chunk_idx, row_number() OVER (PARTITION BY canonical_form, entity_type ORDER BY chunk_idx)::INT AS rank FROM links QUALIFY rank <= 10",
    "entity_card": f"""WITH {EDGES}, {LINKS}, {SEEDS}, {reached()}, {ranked_reach()},
        own AS (SELECT canonical_form, entity_type, list_sort(list(chunk_idx)) AS chunks FROM (SELECT *, row_number() OVER (PARTITION BY canonical_form, entity_type ORDER BY chunk_idx) AS r FROM links QUALIFY r <= 3) GROUP BY ALL),
        six AS (SELECT seed, list(canonical_form ORDER BY rank) AS neighbours FROM near WHERE distance = 1 AND rank <= 6 GROUP BY seed)
        SELECT seed, description, chunks, neighbours FROM seeds JOIN entities USING (canonical_form, entity_type) LEFT JOIN own USING (canonical_form, entity_type) LEFT JOIN six USING (seed)""",
    "unique_violations": "SELECT lower(canonical_form) AS entity_key, count(*) AS n FROM entities GROUP BY 1 HAVING count(*) > 1",
    "document_pages": "SELECT DISTINCT source, page FROM graph_rows",
    "contains_entities": "SELECT entity_id, canonical_form, entity_type, 1.0e0 AS score FROM entities WHERE contains(name, 'Northlight') OR contains(canonical_form, 'Northlight') ORDER BY entity_id LIMIT 10",
    "expanded_context": f"""WITH {HITS}, {LINKS}, {EDGES},
        seeds AS (SELECT min(struct_pack(place := rank, f := canonical_form, t := entity_type)) AS seed, canonical_form, entity_type FROM links JOIN hits USING (chunk_idx) GROUP BY canonical_form, entity_type),
        {reached()}, {ranked_reach()}
        SELECT canonical_form, entity_type, any_value(importance_score) AS importance_score, 0.8e0 AS confidence FROM near GROUP BY ALL""",
    "entity_search": f"WITH semq AS ({EXAMPLE}), {ASKED} SELECT entity_id, canonical_form, entity_type, round(score, 6) AS score, rank::INT AS rank FROM named",
    "query_entities": f"WITH semq AS ({EXAMPLE}), {ASKED} SELECT canonical_form, entity_type, round(score, 6) AS score FROM asked",
    "kg_entity_aware": f"""WITH {SCORES}, {LINKS}, {ASKED}, {covered(15)},
        mixed AS (SELECT chunk_idx, sem, bm25, score + coalesce(coverage, 0) * 0.3e0 AS score, place FROM hitsk LEFT JOIN cover USING (chunk_idx)) {RESULT}""",
    "kg_graph_guided": f"WITH {SCORES}, {LINKS}, {EDGES}, {ASKED}, {GUIDED} {RESULT}",
    "kg_hybrid": f"WITH {SCORES}, {LINKS}, {EDGES}, {ASKED}, {HYBRID} {RESULT}",
    "kg_context": f"WITH {HITS}, {LINKS}, {CONTEXT} SELECT canonical_form, entity_type, description, confidence, importance, place::INT AS place FROM about",
    "prompt_citation": f"WITH {HITS} SELECT {quoted(CITATION_WORDING)} || string_agg({BLOCK} || {IMAGE} || coalesce(text, '') || chr(10), chr(10) ORDER BY rank) || {quoted(QUESTION_WORDING)} AS prompt FROM found",
    "prompt_kg": f"""WITH {HITS}, {LINKS}, {EDGES}, {CONTEXT}, {AROUND}, {WHO},
        names AS (SELECT chunk_idx, array_to_string(list_sort(list(DISTINCT canonical_form))[:5], ', ') AS ns FROM links GROUP BY chunk_idx),
        ctx AS (SELECT string_agg({BLOCK} || CASE WHEN ns IS NOT NULL THEN 'Entities: ' || ns || chr(10) ELSE '' END || {IMAGE} || coalesce(text, '') || chr(10), chr(10) ORDER BY rank) AS t FROM found LEFT JOIN names USING (chunk_idx)),
        pic AS (SELECT '### Knowledge Graph' || chr(10) || '```' || chr(10) || {DRAWN} || chr(10) || '```' || chr(10) AS t FROM numbered WHERE o <= 10)
        SELECT {quoted(KG_WORDING)} || concat_ws(chr(10), (SELECT t FROM who), (SELECT t FROM tied), (SELECT t FROM pic), (SELECT t FROM ctx)) || {quoted(QUESTION_WORDING)} AS prompt""",
    "kg_viz": f"WITH {HITS}, {LINKS}, {EDGES}, {CONTEXT}, {AROUND} SELECT {DRAWN} AS text FROM numbered WHERE o <= 10",
    "extraction_cache": """WITH own AS (SELECT chunk_idx, md5(text) AS text_md5 FROM chunks WHERE modality = 'text' AND length(text) > 0)
        SELECT text_md5, count(*) AS n_chunks, min(chunk_idx) AS first_chunk FROM own GROUP BY text_md5 HAVING count(*) > 1""",
    "incremental_resolve": """WITH r AS (SELECT *, lower(canonical_form) AS entity_key, (extraction_method = 'llm')::INT AS turn FROM mentions),
        best AS (SELECT *, row_number() OVER (PARTITION BY entity_key, turn ORDER BY coalesce(confidence, -1) DESC, chunk_idx, coalesce(char_pos, -1), name, canonical_form, entity_type) AS k FROM r),
        firsts AS (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY coalesce(confidence, -1) DESC, turn) AS j FROM best WHERE k = 1),
        counts AS (SELECT entity_key, count(*) AS occurrences FROM r GROUP BY entity_key)
        SELECT entity_key, name, canonical_form, entity_type, confidence, occurrences, least(1, occurrences / 10.0e0) AS importance_score FROM firsts JOIN counts USING (entity_key) WHERE j = 1""",
}
