"""Queries over the retrieval surface: each user's chunks, documents and memories, by vector, by text and by both.

The SQL of each follows the reference's search functions, one query row after another, in place of one call each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators import memory, retrieval, search, sql_functions, vector_index
from mnemospark.plans.recall import _tokens_sql, covers_sql
from mnemospark.sources import tables
from mnemospark.sources.scratch import materialize

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_SQUEEZED = "trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g'))"
#: The retrieval views as SQL.
DOCUMENTS = f"""
    SELECT doc_id AS document_id, doc_id % 10 AS user_id, 'https://' || source || '.example.com/d/' || CAST(doc_id AS VARCHAR) AS url,
           CASE WHEN length({_SQUEEZED}) <= 40 THEN {_SQUEEZED} ELSE substring({_SQUEEZED}, 1, 39) || '…' END AS title,
           len(regexp_extract_all(text, '[^ \\t-\\r]+')) AS word_count, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * (doc_id % 500) AS captured_at,
           CASE WHEN doc_id % 50 = 49 THEN TIMESTAMP '2024-01-01 00:00:00' END AS deleted_at, CASE WHEN doc_id % 37 = 0 THEN 'failed' ELSE 'succeeded' END AS extraction_status,
           text AS extracted_text, topic_ids
    FROM documents LEFT JOIN (SELECT vec_id // 5 AS t, list(DISTINCT label) AS topic_ids FROM embeddings WHERE label IS NOT NULL GROUP BY 1) ON t = doc_id"""
CHUNKS = """
    SELECT doc_id * 1000000 + o AS chunk_id, doc_id AS document_id, doc_id % 10 AS user_id, o AS ordinal, piece AS text, CAST(embedding AS DOUBLE[]) AS e
    FROM (SELECT doc_id, unnest(p) AS piece, unnest(range(0, len(p))) AS o FROM (SELECT doc_id, regexp_extract_all(text, '(?s).{1,800}') AS p FROM documents))
    LEFT JOIN embeddings ON vec_id = (doc_id * 5 + o) % (SELECT count(*) FROM embeddings)"""
MEMORIES = """
    SELECT memory_id, user_id, conv_id, kind, statement, valid_from, status, CAST(memory_id % 10 AS DOUBLE) / 10 AS confidence, CAST(embedding AS DOUBLE[]) AS e, CASE WHEN label IS NOT NULL THEN [label] END AS topic_ids
    FROM (SELECT *, CASE WHEN lead(memory_id) OVER (PARTITION BY conv_id ORDER BY valid_from, memory_id) IS NULL THEN 'active' ELSE 'superseded' END AS status FROM (
        SELECT conv_id * 1000 + turn AS memory_id, conv_id, conv_id % 10 AS user_id, CASE WHEN turn % 2 = 0 THEN 'fact' ELSE 'preference' END AS kind, text AS statement,
               TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * conv_id + INTERVAL 1 HOUR * turn AS valid_from FROM conversations WHERE role = 'user'))
    LEFT JOIN embeddings ON vec_id = (conv_id * 10 + memory_id % 1000) % (SELECT count(*) FROM embeddings)"""
ASKED = f"SELECT memory_id AS query_id, user_id, statement AS query_text, e FROM ({MEMORIES}) WHERE memory_id % 100 = 0"
_VISIBLE = f"SELECT c.*, d.title, d.url, d.captured_at, d.topic_ids FROM ({CHUNKS}) c JOIN ({DOCUMENTS}) d ON d.document_id = c.document_id AND d.user_id = c.user_id WHERE d.deleted_at IS NULL"
_LIKE = "round(list_dot_product(r.e, q.e) / (sqrt(list_dot_product(r.e, r.e)) * sqrt(list_dot_product(q.e, q.e))), 9)"


def _near_sql(rows: str, key: str, k: int, least: float) -> str:
    """The k nearest of each user's rows as SQL: query_id, the row's columns, similarity, rank."""
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, {key}) AS rank FROM (
        SELECT q.query_id, r.*, {_LIKE} AS similarity FROM ({rows}) r JOIN ({ASKED}) q ON q.user_id = r.user_id WHERE r.e IS NOT NULL AND q.e IS NOT NULL) WHERE similarity >= {least}) WHERE rank <= {k}"""


def _text_sql(rows: str, key: str, asked: str = ASKED) -> str:
    """Text ranks of each user's rows (key, user_id, body) as SQL: query_id, key, raw."""
    hits = f"""SELECT w.query_id, i.{key}, i.token, i.pos FROM (SELECT {key}, user_id, unnest(t) AS token, unnest(range(0, len(t))) AS pos FROM (SELECT {key}, user_id, {_tokens_sql("body")} AS t FROM ({rows}))) i
            JOIN (SELECT DISTINCT query_id, user_id, unnest({_tokens_sql("query_text")}) AS token FROM ({asked})) w ON i.token = w.token AND i.user_id = w.user_id"""
    return f"SELECT query_id, {key}, raw FROM ({covers_sql(hits, key)})"


def _six(column: str) -> Column:
    """Six digits as the SQL rounds them: the product's nearest integer, not the nearest decimal."""
    return F.round(F.col(column) * 1e6) / 1e6


def _views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return tables.recall_queries(spark, sf_dir), tables.recall_chunks(spark, sf_dir), tables.recall_documents(spark, sf_dir), tables.recall_memories(spark, sf_dir)


@query(f"SELECT query_id, chunk_id, document_id, ordinal, round(similarity, 6) AS similarity, text, rank FROM ({_near_sql(_VISIBLE, 'chunk_id', 10, 0)})")
def match_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c, d, _ = _views(spark, sf_dir)
    out = search.match_chunks(q, c, d, 10)
    return out.select("query_id", "chunk_id", "document_id", "ordinal", _six("similarity").alias("similarity"), "text", F.col("rank").cast("bigint").alias("rank"))


@query(f"SELECT query_id, chunk_id, document_id, round(similarity, 6) AS similarity, rank FROM ({_near_sql(_VISIBLE, 'chunk_id', 10, 0)})")
def index_match_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c, d, _ = _views(spark, sf_dir)
    index = vector_index.build(search.visible_chunks(c, d), "chunk_id", keep=["document_id"], by="user_id")
    return vector_index.search(q, index, 10).withColumn("similarity", _six("similarity")).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"SELECT count(DISTINCT query_id) AS queries, count(*) AS wanted, true AS enough FROM ({_near_sql(_VISIBLE, 'chunk_id', 10, 0)})")
def index_probe_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the probes that half of the queries need for 95 % of their neighbours find 90 % for all queries."""
    q, c, d, _ = _views(spark, sf_dir)
    index = vector_index.build(search.visible_chunks(c, d), "chunk_id", by="user_id")
    exact = materialize(vector_index.search(q, index, 10).select("query_id", "chunk_id"))
    probes = vector_index.probes_for(q.where("query_id div 1000 % 2 = 0"), index, 10, 0.95, exact=exact)
    out = vector_index.recall(vector_index.search(q, index, 10, probes=probes), exact, "chunk_id")
    return out.select("queries", "wanted", (F.col("recall") >= 0.9).alias("enough"))


_ACTIVE = f"SELECT * FROM ({MEMORIES}) WHERE status = 'active'"


@query(f"SELECT query_id, memory_id, statement, kind, confidence, round(similarity, 6) AS similarity, rank FROM ({_near_sql(_ACTIVE, 'memory_id', 5, 0)})")
def match_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, _, _, m = _views(spark, sf_dir)
    return search.match_memories(q, m, 5).withColumn("similarity", _six("similarity")).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"SELECT query_id, memory_id, round(similarity, 6) AS similarity, rank FROM ({_near_sql(_ACTIVE + chr(39).join([' AND kind = ', 'preference', '']), 'memory_id', 5, 0.1)})")
def match_memories_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, _, _, m = _views(spark, sf_dir)
    out = search.match_memories(q, m, 5, 0.1, ["preference"])
    return out.select("query_id", "memory_id", _six("similarity").alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


_TOPICS = "topic_ids IS NOT NULL AND list_has_any(topic_ids, [0, 1, 2, 3, 4, 5])"


def _hybrid_sql(where: str, kinds: str) -> str:
    surface = f"""SELECT 'd' || CAST(chunk_id AS VARCHAR) AS id, 'document' AS source, user_id, document_id, text AS body, title, url, captured_at AS occurred_at, e FROM ({_VISIBLE}) WHERE {where}
        UNION ALL SELECT 'm' || CAST(memory_id AS VARCHAR), 'memory', user_id, NULL, statement, statement, NULL, valid_from, e FROM ({_ACTIVE}) WHERE {where} AND {kinds}"""
    return f"""WITH s AS ({surface}),
        v AS (SELECT query_id, id, similarity AS vector_score, rank FROM ({_near_sql("SELECT * FROM s", "id", 20, -1)})),
        x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY text_score DESC, id) AS rank FROM (SELECT query_id, id, round(raw, 6) AS text_score FROM ({_text_sql("SELECT * FROM s", "id")}))),
        f AS (SELECT coalesce(v.query_id, x.query_id) AS query_id, coalesce(v.id, x.id) AS id, vector_score, text_score,
                round(coalesce(CAST(0.6 AS DOUBLE) / (60 + v.rank), 0) + coalesce(CAST(0.4 AS DOUBLE) / (60 + x.rank), 0), 9) AS score
              FROM v FULL OUTER JOIN (SELECT * FROM x WHERE rank <= 20) x ON v.query_id = x.query_id AND v.id = x.id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f)
        SELECT r.query_id, r.id, s.source, s.document_id, s.body AS text, s.title, s.url, s.occurred_at, round(vector_score, 6) AS vector_score, text_score, round(score, 8) AS score, r.rank
        FROM r JOIN s ON s.id = r.id WHERE r.rank <= 20"""


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("vector_score", _six("vector_score")).withColumn("score", (F.round(F.col("score") * 1e8) / 1e8)).withColumn("rank", F.col("rank").cast("bigint"))


@query(_hybrid_sql("true", "true"))
def hybrid_chunks_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.hybrid_search(*_views(spark, sf_dir), 20))


@query(_hybrid_sql(_TOPICS, "kind = 'fact'"))
def hybrid_by_kind_and_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.hybrid_search(*_views(spark, sf_dir), 20, kinds=["fact"], topics=[0, 1, 2, 3, 4, 5]))


_FIRST = "memory_id = (SELECT min(conv_id * 1000 + turn) FROM conversations WHERE role = 'user' AND conv_id % 10 = 0 AND (conv_id * 1000 + turn) % 100 = 0)"


@query(_hybrid_sql("true", "true").replace("memory_id % 100 = 0", _FIRST))
def sql_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call of the table function: what user 0 finds for the first of their questions."""
    q, c, d, m = _views(spark, sf_dir)
    search.create_views(spark, c, d, m)
    sql_functions.create_functions(spark)
    q.where("user_id = 0").orderBy("query_id").limit(1).createOrReplaceTempView("question")
    call = "hybrid_search(user_id, query_text, CAST(query_embedding AS ARRAY<DOUBLE>), 20)"
    return _rounded(spark.sql(f"SELECT query_id, f.* FROM question, LATERAL {call} f"))


_SEEN = f"SELECT *, extracted_text AS body FROM ({DOCUMENTS}) WHERE deleted_at IS NULL"


def _shown_sql(scored: str, k: int) -> str:
    return f"""SELECT query_id, document_id, score, rank, url, title, word_count, captured_at, extraction_status, excerpt FROM (
        SELECT x.query_id, x.score, d.*, substring(d.extracted_text, 1, 4000) AS excerpt, row_number() OVER (PARTITION BY x.query_id ORDER BY x.score DESC, d.captured_at DESC, d.document_id) AS rank
        FROM ({scored}) x JOIN ({_SEEN}) d ON d.document_id = x.document_id) WHERE rank <= {k}"""


_SCORED = f"SELECT query_id, document_id, round(raw / (raw + 1), 6) AS score FROM ({_text_sql(_SEEN, 'document_id')})"


def _listed(found: DataFrame) -> DataFrame:
    return found.withColumn("rank", F.col("rank").cast("bigint"))


@query(_shown_sql(f"SELECT * FROM ({_SCORED}) WHERE score >= 0.6", 10))
def search_user_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, _, d, _ = _views(spark, sf_dir)
    return _listed(search.search_documents(q, d, 10, 0.6))


@query(_shown_sql(f"SELECT * FROM ({_SCORED})", 10))
def index_user_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, _, d, _ = _views(spark, sf_dir)
    return _listed(search.search_documents(q, d, 10, index=materialize(search.index_documents(d))))


_BY_VECTOR = f"""SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY max(similarity) DESC, document_id) AS rank FROM (
    SELECT q.query_id, r.document_id, {_LIKE} AS similarity FROM ({_VISIBLE}) r JOIN ({ASKED}) q ON q.user_id = r.user_id WHERE r.e IS NOT NULL AND q.e IS NOT NULL) GROUP BY query_id, document_id"""
_BY_TEXT = f"SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM ({_SCORED})"


@query(_shown_sql(f"SELECT query_id, document_id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 9) AS score FROM (SELECT * FROM ({_BY_VECTOR}) WHERE rank <= 30 UNION ALL SELECT * FROM ({_BY_TEXT}) WHERE rank <= 30) GROUP BY query_id, document_id", 10))
def hybrid_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c, d, _ = _views(spark, sf_dir)
    return _listed(search.search_documents_hybrid(q, c, d, 10))


# ---- web search syntax: a phrase of a passage, one more of its words, and a word that must be absent

_WORDS = f"SELECT item_id AS query_id, item_id % 10 AS user_id, {_tokens_sql('text')} AS t FROM benchmark"
_ASKS = f"SELECT query_id, user_id, CASE query_id % 3 WHEN 0 THEN [t[1], t[2]] WHEN 1 THEN [t[3]] ELSE [t[1], t[4]] END AS terms, query_id % 3 = 0 AS any_term, CASE query_id % 3 WHEN 1 THEN [t[1], t[2]] END AS phrase, CASE query_id % 3 WHEN 2 THEN t[2] END AS absent FROM ({_WORDS}) WHERE len(t) > 4"


@query(f"""WITH a AS ({_ASKS}), d AS (SELECT document_id, user_id, captured_at, {_tokens_sql("extracted_text")} AS t FROM ({_SEEN})),
    h AS (SELECT a.*, d.document_id, d.captured_at, d.t FROM a JOIN d ON d.user_id = a.user_id WHERE
        (CASE WHEN any_term THEN list_has_any(d.t, terms) ELSE list_has_all(d.t, terms) END)
        AND (phrase IS NULL OR len(list_filter(range(1, len(d.t)), lambda i: d.t[i] = phrase[1] AND d.t[i + 1] = phrase[2])) > 0) AND (absent IS NULL OR NOT list_contains(d.t, absent)))
    SELECT query_id, document_id FROM h""")
def search_websearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 10).alias("user_id"), retrieval.tokens(F.col("text")).alias("t")).where(F.size("t") > 4)
    t = lambda i: F.element_at("t", i)
    said = F.when(F.col("query_id") % 3 == 0, F.concat(t(1), F.lit(" OR "), t(2))).when(F.col("query_id") % 3 == 1, F.concat(F.lit('"'), t(1), F.lit(" "), t(2), F.lit('" '), t(3))).otherwise(F.concat(t(1), F.lit(" "), t(4), F.lit(" -"), t(2)))
    asked = words.select("query_id", "user_id", said.alias("query_text"))
    return search.search_websearch(asked, tables.recall_documents(spark, sf_dir), 1_000_000).select("query_id", "document_id")


# ---- statements near to earlier ones of their user

def _near_statements_sql(neighbours: int) -> str:
    return f"""WITH m AS (SELECT *, sha256(trim(regexp_replace(regexp_replace(nfc_normalize(statement), '[​-‍﻿]', '', 'g'), '[ \\t-\\r]+', ' ', 'g'))) AS h FROM ({MEMORIES})),
    x AS (SELECT a.memory_id, min(b.memory_id) AS match_id FROM m a JOIN m b ON a.user_id = b.user_id AND a.h = b.h AND b.memory_id < a.memory_id GROUP BY a.memory_id),
    p AS (SELECT q.memory_id, r.memory_id AS match_id, {_LIKE} AS similarity FROM m q JOIN m r ON q.user_id = r.user_id AND r.memory_id < q.memory_id WHERE q.e IS NOT NULL AND r.e IS NOT NULL AND q.memory_id NOT IN (SELECT memory_id FROM x)),
    b AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY similarity DESC, match_id) AS rn FROM p)
    SELECT memory_id, match_id, 1.0 AS similarity, 'duplicate' AS relation FROM x
    UNION ALL SELECT memory_id, match_id, round(similarity, 6), CASE WHEN similarity >= 0.9 THEN 'duplicate' ELSE 'candidate' END FROM b WHERE rn <= {neighbours} AND similarity >= {{least}}"""


@query(_near_statements_sql(1).format(least=0.8))
def memory_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = tables.recall_memories(spark, sf_dir)
    return memory.near_duplicates(held, held)


@query(_near_statements_sql(5).format(least=0.05))
def memory_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = tables.recall_memories(spark, sf_dir)
    return memory.near_duplicates(held, held, review=0.05, neighbours=5)
