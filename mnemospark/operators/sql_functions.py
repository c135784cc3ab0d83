"""The retrieval surface and the chunkers for SQL users: temporary table functions.

``create_functions`` gives one call of F1 to F5 each: ``SELECT * FROM match_chunks(7, array(...), 10)``, over the views
of :func:`search.create_views`. A call is one user's search; its filters reach the scan. Used with LATERAL it answers
a row after another set of columns, by a nested loop of the different vectors and the rows: fit for a stated, small set
of questions. Many questions go through the DataFrame forms, which these equal.

``register_chunkers`` gives the chunkers by the names of their strategies, over a TABLE argument, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.arrow import bound_batches
from mnemospark.operators import corpus
from mnemospark.operators.covers import COVER_SUM
from mnemospark.operators.retrieval import PLACES, RRF_K, STOP_WORDS
from mnemospark.operators.search import EXCERPT_CHARS, LEG_DEPTH

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _cosine(a: str, b: str) -> str:
    """Cosine of two vectors to PLACES digits; null unless both are usable and of one width."""
    fine = lambda v: f"forall({v}, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity')) AND exists({v}, c -> c <> 0)"
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    like = f"CASE WHEN size(a) > 0 AND size(a) = size(b) AND {fine('a')} AND {fine('b')} THEN round({dot('a', 'b')} / (sqrt({dot('a', 'a')}) * sqrt({dot('b', 'b')})), {PLACES}) END"
    return _bind(f"CAST({a} AS ARRAY<DOUBLE>)", "a", _bind(b, "b", like))


def _words(text: str) -> str:
    return f"filter(split(trim(regexp_replace(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+', ' ')), ' '), w -> length(w) > 1 AND w NOT IN ({_STOP}))"


def _text_rank(text: str, question: str) -> str:
    """A text's rank for the words of a question, null if it has none of them."""
    places = f"filter(transform({_words(text)}, (w, i) -> named_struct('pos', i, 'token', w)), p -> array_contains(asked, p.token))"
    rank = f"CASE WHEN size(found) > 0 THEN {_bind(COVER_SUM, 'c', 'size(found) - 1 + c / (c + 1)')} END"
    return _bind(_words(question), "asked", _bind(places, "places", _bind("array_distinct(transform(places, p -> p.token))", "found", rank)))


def _ranked(rows: str, k: str, *order: str, name: str = "rank") -> str:
    return f"SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY {', '.join(order)}) AS INT) AS {name} FROM ({rows})) WHERE {name} <= {k}"


def create_functions(spark: SparkSession) -> None:
    """Temporary functions match_chunks, match_memories, search_documents, hybrid_search and search_documents_hybrid over
    the views visible_chunks, visible_documents, active_memories and, for hybrid_search, searchable (see search.create_views).

    Types of keys are those of the views. A null threshold is 0, a null list of kinds or topics allows all.
    """
    kind = lambda view, c: spark.table(view).schema[c].dataType.simpleString()
    user, chunk, document, memory = kind("visible_chunks", "user_id"), kind("visible_chunks", "chunk_id"), kind("visible_documents", "document_id"), kind("active_memories", "memory_id")
    topic = spark.table("searchable").schema["topic_ids"].dataType.simpleString()
    near = lambda view, f, more="true": f"SELECT *, {_cosine('embedding', f'{f}.query_embedding')} AS similarity FROM {view} WHERE user_id = {f}.asker AND {more}"
    least = lambda f: f"coalesce({f}.match_threshold, 0D)"
    shown = {"url": "string", "title": "string", "word_count": kind("visible_documents", "word_count"), "captured_at": kind("visible_documents", "captured_at"), "extraction_status": "string"}
    columns = f"document_id {document}, score DOUBLE, rank INT, " + ", ".join(f"{c} {t}" for c, t in shown.items()) + ", excerpt STRING"
    listed = lambda scored, f: f"""SELECT document_id, score, rank, {', '.join(shown)}, excerpt FROM ({_ranked(f"SELECT s.score, d.*, substring(d.extracted_text, 1, {EXCERPT_CHARS}) AS excerpt FROM ({scored}) s JOIN visible_documents d ON d.document_id = s.document_id", f"{f}.match_count", "score DESC", "captured_at DESC", "document_id")})"""
    text = lambda f: f"SELECT document_id, round(raw / (raw + 1), 6) AS score FROM (SELECT document_id, {_text_rank('extracted_text', f'{f}.query_text')} AS raw FROM visible_documents WHERE user_id = {f}.asker) WHERE raw IS NOT NULL"
    f = "search_documents_hybrid"
    by_vector = _ranked(f"SELECT document_id, max(similarity) AS similarity FROM ({near('visible_chunks', f)}) WHERE similarity IS NOT NULL GROUP BY document_id", f"{LEG_DEPTH} * {f}.match_count", "similarity DESC", "document_id")
    by_text = _ranked(text(f), f"{LEG_DEPTH} * {f}.match_count", "score DESC", "document_id")
    documents_hybrid = f"SELECT document_id, round(sum(1D / ({RRF_K} + rank)), 9) AS score FROM (SELECT document_id, rank FROM ({by_vector}) UNION ALL SELECT document_id, rank FROM ({by_text})) GROUP BY document_id HAVING score >= coalesce({f}.min_score, 0D)"
    f = "hybrid_search"
    surface = f"""SELECT * FROM searchable WHERE user_id = {f}.asker AND CASE source WHEN 'document' THEN {f}.include_documents ELSE {f}.include_memories END
        AND ({f}.topic_filter IS NULL OR coalesce(arrays_overlap(topic_ids, {f}.topic_filter), false)) AND (source = 'document' OR {f}.kind_filter IS NULL OR array_contains({f}.kind_filter, kind))"""
    v_top = _ranked(f"SELECT id, similarity FROM (SELECT id, {_cosine('embedding', f'{f}.query_embedding')} AS similarity FROM ({surface})) WHERE similarity >= -1", f"{f}.match_count", "similarity DESC", "id")
    t_top = _ranked(f"SELECT id, round(raw, 6) AS text_score FROM (SELECT id, {_text_rank('text', f'{f}.query_text')} AS raw FROM ({surface})) WHERE raw IS NOT NULL", f"{f}.match_count", "text_score DESC", "id")
    both = f"""SELECT id, max(vector_score) AS vector_score, max(text_score) AS text_score, max(v) AS v, max(t) AS t FROM (
        SELECT id, similarity AS vector_score, CAST(NULL AS DOUBLE) AS text_score, rank AS v, CAST(NULL AS INT) AS t FROM ({v_top})
        UNION ALL SELECT id, NULL, text_score, NULL, rank FROM ({t_top})) GROUP BY id"""
    fused = f"SELECT id, vector_score, text_score, round(coalesce({f}.vector_weight / ({RRF_K} + v), 0D) + coalesce({f}.text_weight / ({RRF_K} + t), 0D), 9) AS score FROM ({both})"
    tables = {
        f"match_chunks(asker {user}, query_embedding ARRAY<DOUBLE>, match_count INT, match_threshold DOUBLE DEFAULT 0) RETURNS TABLE (chunk_id {chunk}, document_id {document}, ordinal {kind('visible_chunks', 'ordinal')}, similarity DOUBLE, text STRING, rank INT)":
            f"SELECT chunk_id, document_id, ordinal, similarity, text, rank FROM ({_ranked('SELECT * FROM (' + near('visible_chunks', 'match_chunks') + ') WHERE similarity >= ' + least('match_chunks'), 'match_chunks.match_count', 'similarity DESC', 'chunk_id')})",
        f"match_memories(asker {user}, query_embedding ARRAY<DOUBLE>, match_count INT, match_threshold DOUBLE DEFAULT 0, kind_filter ARRAY<STRING> DEFAULT NULL) RETURNS TABLE (memory_id {memory}, statement STRING, kind STRING, confidence {kind('active_memories', 'confidence')}, similarity DOUBLE, rank INT)":
            f"SELECT memory_id, statement, kind, confidence, similarity, rank FROM ({_ranked('SELECT * FROM (' + near('active_memories', 'match_memories', '(match_memories.kind_filter IS NULL OR array_contains(match_memories.kind_filter, kind))') + ') WHERE similarity >= ' + least('match_memories'), 'match_memories.match_count', 'similarity DESC', 'memory_id')})",
        f"search_documents(asker {user}, query_text STRING, match_count INT, min_rank DOUBLE DEFAULT 0) RETURNS TABLE ({columns})":
            listed(f"SELECT * FROM ({text('search_documents')}) WHERE score >= coalesce(search_documents.min_rank, 0D)", "search_documents"),
        f"search_documents_hybrid(asker {user}, query_text STRING, query_embedding ARRAY<DOUBLE>, match_count INT, min_score DOUBLE DEFAULT 0) RETURNS TABLE ({columns})": listed(documents_hybrid, "search_documents_hybrid"),
        f"hybrid_search(asker {user}, query_text STRING, query_embedding ARRAY<DOUBLE>, match_count INT, vector_weight DOUBLE DEFAULT 0.6D, text_weight DOUBLE DEFAULT 0.4D, include_documents BOOLEAN DEFAULT true, include_memories BOOLEAN DEFAULT true, kind_filter ARRAY<STRING> DEFAULT NULL, topic_filter {topic} DEFAULT NULL) RETURNS TABLE (id STRING, source STRING, document_id {document}, text STRING, title STRING, url STRING, occurred_at {kind('searchable', 'occurred_at')}, vector_score DOUBLE, text_score DOUBLE, score DOUBLE, rank INT)":
            f"SELECT r.id, s.source, s.document_id, s.text, s.title, s.url, s.occurred_at, r.vector_score, r.text_score, r.score, r.rank FROM ({_ranked(fused, 'hybrid_search.match_count', 'score DESC', 'id')}) r JOIN ({surface}) s ON s.id = r.id",
    }
    for head, body in tables.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


# ---- chunkers


class _Chunks:
    """Batches (id, text) to chunks, a text after another."""

    @staticmethod
    def cut(text: str) -> list[tuple[str, list[str]]]:
        raise NotImplementedError

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        rows = [(k, i, c, -(-len(c) // corpus.CHARS_PER_TOKEN), path) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, (c, path) in enumerate(self.cut(t or ""))]
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.string()))
        yield pa.table([pa.array([r[n] for r in rows], t) for n, t in enumerate(kinds)], names=["id", "ordinal", "chunk", "token_count", "heading_path"])


class RecursiveChunks(_Chunks):
    """chunk_recursive(TABLE(SELECT id, text ...)): as :func:`corpus.recursive_chunks`."""

    cut = staticmethod(lambda text: corpus.chunk_text(text))


class FixedChunks(_Chunks):
    """chunk_fixed(TABLE(SELECT id, text ...)): as :func:`corpus.fixed_chunks`; such chunks have no headings."""

    cut = staticmethod(lambda text: [(c, []) for c in corpus.fixed_text(text)])


class SemanticChunks:
    """chunk_semantic(TABLE(SELECT id, pos, text, vector ...) PARTITION BY id ORDER BY pos): sentences joined up to each cut of
    :func:`corpus.semantic_chunks`. One id's sentences are held at a time."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        self.rows += zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)
        yield from ()

    def terminate(self) -> Iterator[pa.Table]:
        vectors = [np.array(v if v and None not in v else [np.nan], float) for *_, v in self.rows]
        groups = corpus.semantic_groups(vectors)
        out: list[tuple] = []
        for (key, _, text, _), g in zip(self.rows, groups, strict=True):
            if out and out[-1][0] == g:
                out[-1][2].append(text or "")
            else:
                out.append((g, key, [text or ""]))
        chunks = [" ".join(t) for *_, t in out]
        columns = [pa.array([k for _, k, _ in out], pa.int64()), pa.array(range(len(out)), pa.int32()), pa.array(chunks, pa.string()), pa.array([-(-len(c) // corpus.CHARS_PER_TOKEN) for c in chunks], pa.int64()), pa.array([[] for _ in out], pa.list_(pa.string()))]
        yield pa.table(columns, names=["id", "ordinal", "chunk", "token_count", "heading_path"])


CHUNK_SCHEMA = "id bigint, ordinal int, chunk string, token_count bigint, heading_path array<string>"
#: Handlers by the name of the strategy, as corpus.CHUNKERS has them.
HANDLERS = {"fixed": FixedChunks, "recursive": RecursiveChunks, "semantic": SemanticChunks}


def register_chunkers(spark: SparkSession) -> None:
    """chunk_fixed, chunk_recursive and chunk_semantic for SQL: (id, ordinal, chunk, token_count, heading_path)."""
    bound_batches(spark)
    for name, handler in HANDLERS.items():
        spark.udtf.register(f"chunk_{name}", F.arrow_udtf(handler, returnType=CHUNK_SCHEMA))
