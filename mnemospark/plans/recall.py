"""Queries over passages, statements and questions: vector and text search, fusion, context, evaluation and memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators import lifecycle, memory, novelty, retrieval, rollups, text_index
from mnemospark.plans.events import V_EVENTS
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


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every passage whose id is divisible by 100, against all passages."""
    return tables.chunks(spark, sf_dir).where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_embedding"))


_V = "SELECT vec_id AS chunk_id, vec_id // 5 AS document_id, label AS topic, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"
_COS = "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"
_PAIRS = f"SELECT a.chunk_id AS query_id, b.chunk_id, b.document_id, round({_COS}, 9) AS similarity FROM ({_V}) a, ({_V}) b WHERE a.chunk_id % 100 = 0"
_TOP = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM ({}) WHERE similarity >= 0"
MATCHES = f"SELECT * FROM ({_TOP.format(_PAIRS)}) WHERE rank <= 10"


@query(f"""SELECT query_id, document_id, arg_min(chunk_id, (-similarity, chunk_id)) AS chunk_id, round(max(similarity), 6) AS similarity FROM ({MATCHES.replace("<= 10", "<= 50")}) GROUP BY query_id, document_id""")
def nearest_chunk_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.match_vectors(_queries(spark, sf_dir), tables.chunks(spark, sf_dir), "chunk_id", 50, keep=["document_id"])
    return retrieval.nearest_per_group(hits, "document_id", "chunk_id").withColumn("similarity", F.round("similarity", 6))


@query("""SELECT topic, pos, round(avg(x), 6) AS x FROM (SELECT label AS topic, unnest(range(0, len(embedding))) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY topic, pos""")
def topic_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rollups.topic_centroids(tables.chunks(spark, sf_dir)).select("topic", F.posexplode("centroid").alias("pos", "x"))
    return c.select("topic", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


@query(f"""WITH m AS (SELECT topic, pos, avg(x) AS x FROM (SELECT label AS topic, unnest(range(0, len(embedding))) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY topic, pos),
    c AS (SELECT topic, list(x ORDER BY pos) AS e FROM m GROUP BY topic),
    s AS (SELECT a.chunk_id, b.topic, round({_COS}, 9) AS similarity, row_number() OVER (PARTITION BY a.chunk_id ORDER BY round({_COS}, 9) DESC, b.topic) AS rn FROM ({_V}) a, c b)
    SELECT chunk_id, topic, round(similarity, 6) AS similarity FROM s WHERE rn = 1""")
def nearest_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = tables.chunks(spark, sf_dir)
    found = retrieval.nearest_centroid(chunks, rollups.topic_centroids(chunks), "chunk_id", "topic")
    return found.withColumn("similarity", F.round("similarity", 6))


# ---- text search: benchmark passages as questions against documents

_STOP = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)


def _tokens_sql(column: str) -> str:
    words = f"string_split(trim(regexp_replace(lower(coalesce({column}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    return f"list_filter({words}, lambda w: length(w) > 1 AND NOT list_contains([{_STOP}], w))"


_INDEX = f"SELECT doc_id, unnest(t) AS token, unnest(range(0, len(t))) AS pos FROM (SELECT doc_id, {_tokens_sql('text')} AS t FROM documents)"
_WANTED = f"SELECT DISTINCT item_id AS query_id, unnest(t) AS token FROM (SELECT item_id, {_tokens_sql('text')} AS t FROM benchmark)"


def covers_sql(hits: str, key: str) -> str:
    """(query_id, key, matched, raw) of hits (query_id, key, token, pos): for each place the last place before it of each
    word that the text holds; their smallest begins a cover, a minimal one where no earlier place has the same."""
    return f"""
    WITH h AS ({hits}), t AS (SELECT query_id, {key}, token, count(*) OVER (PARTITION BY query_id, {key}) AS matched FROM h GROUP BY query_id, {key}, token),
    l AS (SELECT h.query_id, h.{key}, h.pos, t.matched, max(CASE WHEN h.token = t.token THEN h.pos END) OVER (PARTITION BY h.query_id, h.{key}, t.token ORDER BY h.pos) AS last
          FROM h JOIN t ON t.query_id = h.query_id AND t.{key} = h.{key}),
    e AS (SELECT query_id, {key}, pos, any_value(matched) AS matched, min(last) AS start FROM l GROUP BY query_id, {key}, pos HAVING count(last) = any_value(matched)),
    c AS (SELECT query_id, {key}, any_value(matched) AS matched, start, min(pos) AS finish FROM e GROUP BY query_id, {key}, start)
    SELECT query_id, {key}, any_value(matched) AS matched, any_value(matched) - 1 + round(sum(CAST(matched AS DOUBLE) / (finish - start + 1)), 9) / (round(sum(CAST(matched AS DOUBLE) / (finish - start + 1)), 9) + 1) AS raw
    FROM c GROUP BY query_id, {key}"""


def _search_sql(index: str, wanted: str) -> str:
    """Ranked postings as SQL, of (doc_id, token, pos) and (query_id, token)."""
    hits = f"SELECT w.query_id, i.doc_id, i.token, i.pos FROM ({index}) i JOIN ({wanted}) w ON i.token = w.token"
    return f"""SELECT query_id, doc_id, matched, score, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, score DESC, doc_id) AS rank
    FROM (SELECT query_id, doc_id, matched, round(raw / (raw + 1), 6) AS score FROM ({covers_sql(hits, "doc_id")}))"""


_SEARCH = _search_sql(_INDEX, _WANTED)


def _text_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    asked = tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), retrieval.search_terms(F.col("text")).alias("terms"))
    return retrieval.search_documents(asked, tables.read(spark, sf_dir, "documents"), "doc_id", "text", k)


@query(f"SELECT * FROM ({_SEARCH}) WHERE rank <= 10")
def search_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), retrieval.search_terms(F.col("text")).alias("terms"))
    index = retrieval.token_table(tables.read(spark, sf_dir, "documents"), "doc_id", "text")
    return retrieval.search_text(asked, index, "doc_id", 10).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"SELECT * FROM ({_SEARCH}) WHERE rank <= 10")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_hits(spark, sf_dir, 10).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"SELECT * FROM ({_SEARCH}) WHERE rank <= 10")
def search_block_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_documents by a kept index in blocks: the rarest words first, the common ones for what can be among the best."""
    asked = tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), retrieval.search_terms(F.col("text")).alias("terms"))
    index = materialize(text_index.build(tables.read(spark, sf_dir, "documents"), "doc_id", "text"))
    return text_index.search(asked, index, "doc_id", 10).withColumn("rank", F.col("rank").cast("bigint"))


_EXPECTED = "SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage verbatim. Documents with all of its words are looked at; a passage without words is in none."""
    items, docs = tables.read(spark, sf_dir, "benchmark"), tables.read(spark, sf_dir, "documents")
    asked = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"), retrieval.search_terms(F.col("text")).alias("terms"))
    hits = retrieval.postings_in(docs, "doc_id", "text", retrieval.search_terms_of(asked)).groupBy("query_id", "doc_id").agg(F.count_distinct("token").alias("matched"))
    full = hits.join(asked, "query_id").where(F.col("matched") == F.size("terms"))
    return full.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage")).select("query_id", "doc_id")


@query(f"""WITH x AS ({_EXPECTED}), f AS (SELECT x.query_id, h.rank FROM x LEFT JOIN (SELECT * FROM ({_SEARCH}) WHERE rank <= 10) h ON h.query_id = x.query_id AND h.doc_id = x.doc_id),
    p AS (SELECT query_id, count(*) AS expected, count(rank) AS found, min(rank) AS first, sum(CASE WHEN rank <= 3 THEN 1.0 / log2(rank + 1.0) ELSE 0.0 END) AS dcg FROM f GROUP BY query_id)
    SELECT query_id, expected, coalesce(first <= 3, false) AS hit, round(found / expected, 6) AS recall, round(coalesce(1.0 / first, 0.0), 6) AS mrr,
           round(CAST(dcg AS DOUBLE) / list_sum(list_transform(range(1, least(expected, 3) + 1), lambda i: 1.0 / log2(i + 1.0))), 6) AS ndcg FROM p""")
def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.evaluate(_text_hits(spark, sf_dir, 10), _expected(spark, sf_dir), "doc_id")
    return out.withColumn("expected", F.col("expected").cast("bigint"))


# ---- fusion


_SHOWN = f"SELECT * FROM ({_SEARCH}) WHERE rank <= 20"


@query(f"""SELECT query_id, doc_id, rank, round(score / max(score) OVER (PARTITION BY query_id), 6) AS shown,
    CASE WHEN max(score) OVER (PARTITION BY query_id) > min(score) OVER (PARTITION BY query_id)
         THEN round((score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id)), 6) ELSE 0.0 END AS scaled FROM ({_SHOWN})""")
def display_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.min_max(retrieval.display_score(_text_hits(spark, sf_dir, 20), "score"), "score")
    return hits.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), "shown", "scaled")


_CONTEXT = f"""SELECT query_id, doc_id, rank, tokens, used, truncated, text FROM (
    SELECT *, max(CASE WHEN used > 6000 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) = 1 AS truncated FROM (
        SELECT h.query_id, h.doc_id, h.rank, d.text, CAST(ceil(length(d.text) / 4) AS BIGINT) AS tokens,
               CAST(sum(CAST(ceil(length(d.text) / 4) AS BIGINT)) OVER (PARTITION BY h.query_id ORDER BY h.rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used
        FROM ({_SHOWN}) h JOIN documents d ON d.doc_id = h.doc_id)) WHERE used <= 6000"""


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _text_hits(spark, sf_dir, 20).join(tables.read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return retrieval.context_prefix(hits, "text")


@query(f"SELECT query_id, doc_id, rank, tokens, used, truncated FROM ({_CONTEXT})")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir).select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), "tokens", "used", "truncated")


@query(f"SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS citation, substring(text, 1, 240) AS snippet FROM ({_CONTEXT})")
def citation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.citations(_context(spark, sf_dir), "text").select("query_id", "doc_id", F.col("citation").cast("bigint").alias("citation"), "snippet")


@query(f"""SELECT query_id, doc_id, relevance, rerank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC NULLS LAST, rank) AS rerank FROM (
        SELECT query_id, doc_id, rank, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id % 11 AS DOUBLE) / 10 END AS relevance FROM ({_SHOWN}))) WHERE rerank <= 8""")
def rerank_supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _text_hits(spark, sf_dir, 20)
    scores = hits.where("doc_id % 3 <> 0").select("query_id", "doc_id", ((F.col("doc_id") % 11).cast("double") / 10).alias("relevance"))
    return retrieval.rerank(hits, scores, "doc_id").select("query_id", "doc_id", "relevance", F.col("rerank").cast("bigint").alias("rerank"))


def _any_sql(cues) -> str:
    return "(" + " OR ".join(f"contains(p, '{c}')" for c in cues) + ")"


@query(f"""WITH q AS (SELECT conv_id * 1000 + turn AS query_id, text, lower(trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g'))) AS p, trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g')) AS o FROM conversations WHERE role = 'user'),
    f AS (SELECT query_id, {_any_sql(retrieval.TEMPORAL_CUES)} AS has_temporal, {_any_sql(retrieval.ACTIVITY_VERBS)} AS has_activity,
            list_has_any(string_split(p, ' '), [{", ".join(f"'{w}'" for w in retrieval.QUESTION_WORDS)}]) AS has_question,
            len(list_filter(string_split(p, ' '), lambda w: length(w) > 0)) BETWEEN 1 AND 3 AS is_short,
            regexp_matches(text, '["“][^"”]{{1,80}}["”]') OR len(list_filter(list_slice(string_split(o, ' '), 2, 100000), lambda w: regexp_matches(w, '^[A-Z][A-Za-z0-9]*$') OR regexp_matches(w, '[0-9_./-]') OR length(w) > 12)) > 0 AS has_entity FROM q)
    SELECT *, CASE WHEN has_activity AND has_temporal THEN 'activity' WHEN has_temporal THEN 'temporal' WHEN has_entity OR is_short THEN 'entity' WHEN has_question THEN 'semantic' ELSE 'mixed' END AS intent FROM f""")
def intent_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tables.memories(spark, sf_dir).select(F.col("memory_id").alias("query_id"), F.col("statement").alias("query_text"))
    return retrieval.query_features(asked).drop("query_text")


# ---- memories

_M = """SELECT conv_id * 1000 + turn AS memory_id, conv_id, conv_id % 150 AS user_id, CASE WHEN turn % 2 = 0 THEN 'fact' ELSE 'preference' END AS kind, text AS statement,
    TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * conv_id + INTERVAL 1 HOUR * turn AS valid_from, turn % 4 AS access_count FROM conversations WHERE role = 'user'"""
_CHAIN = f"""SELECT *, CASE WHEN superseded_by IS NULL THEN 'active' ELSE 'superseded' END AS status FROM (
    SELECT *, lead(valid_from) OVER w AS valid_to, lead(memory_id) OVER w AS superseded_by FROM ({_M}) WINDOW w AS (PARTITION BY conv_id ORDER BY valid_from, memory_id))"""


@query(f"""SELECT user_id, sha256(trim(regexp_replace(regexp_replace(nfc_normalize(statement), '[​-‍﻿]', '', 'g'), '[ \\t-\\r]+', ' ', 'g'))) AS statement_hash, min(memory_id) AS memory_id, count(*) AS copies FROM ({_M}) GROUP BY 1, 2""")
def memory_exact_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.exact_duplicates(tables.memories(spark, sf_dir))


@query(f"SELECT memory_id, valid_from, valid_to, superseded_by, status FROM ({_CHAIN})")
def memory_supersede_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.supersede_chain(tables.memories(spark, sf_dir), "conv_id").select("memory_id", "valid_from", "valid_to", "superseded_by", "status")


@query(f"""SELECT moment_id, memory_id, status FROM ({_CHAIN}) m JOIN (VALUES (1, TIMESTAMP '2024-01-10 02:30:00'), (2, TIMESTAMP '2024-03-01 00:00:00')) t(moment_id, since)
    ON m.valid_from <= t.since AND (m.valid_to IS NULL OR t.since < m.valid_to)""")
def memory_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = spark.range(1).select(F.expr("explode(array(struct(1 AS moment_id, TIMESTAMP_NTZ '2024-01-10 02:30:00' AS at), struct(2 AS moment_id, TIMESTAMP_NTZ '2024-03-01 00:00:00' AS at)))").alias("m")).select("m.*")
    return memory.valid_at(memory.supersede_chain(tables.memories(spark, sf_dir), "conv_id"), moments).select("moment_id", "memory_id", "status")


@query(f"""SELECT user_id, memory_id, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, memory_id) AS rank FROM (
    SELECT user_id, memory_id, round(greatest(0.1, (1 + 0.1 * access_count) * pow(0.5, ((epoch_us(TIMESTAMP '2024-12-31 00:00:00') // 1000000 - epoch_us(valid_from) // 1000000) / 86400.0) / 30.0)), 6) AS weight FROM ({_CHAIN}) WHERE status = 'active')) WHERE rank <= 3""")
def memory_decay_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    active = memory.supersede_chain(tables.memories(spark, sf_dir), "conv_id").where("status = 'active'")
    weighed = active.withColumn("weight", F.round(memory.decay_weight(F.col("valid_from"), F.expr("TIMESTAMP_NTZ '2024-12-31 00:00:00'"), F.col("access_count")), 6))
    ranked = weighed.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("weight"), "memory_id")))
    return ranked.where("rank <= 3").select("user_id", "memory_id", "weight", F.col("rank").cast("bigint").alias("rank"))


@query(f"""SELECT memory_id, CASE WHEN status = 'active' AND valid_from < TIMESTAMP '2024-02-15 00:00:00' THEN 'archived' ELSE status END AS status FROM ({_CHAIN})""")
def memory_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = memory.supersede_chain(tables.memories(spark, sf_dir), "conv_id").withColumn("last_accessed_at", F.lit(None).cast("timestamp_ntz"))
    return memory.archive_stale(held, F.expr("TIMESTAMP_NTZ '2024-02-15 00:00:00'")).select("memory_id", "status")


@query(f"""SELECT memory_id, access_count + coalesce(n, 0) AS access_count FROM ({_M}) m LEFT JOIN (SELECT conv_id * 1000 + turn AS id, CAST(turn % 3 AS BIGINT) AS n FROM conversations WHERE turn % 3 > 0) u ON u.id = m.memory_id""")
def memory_access_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = tables.memories(spark, sf_dir).withColumn("last_accessed_at", F.lit(None).cast("timestamp_ntz"))
    uses = tables.read(spark, sf_dir, "conversations").where("turn % 3 > 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("memory_id"), F.explode(F.sequence(F.lit(1), (F.col("turn") % 3).cast("int"))).alias("n"))
    uses = uses.withColumn("used_at", F.expr("TIMESTAMP_NTZ '2024-06-01 00:00:00'"))
    return rollups.access_bump(held, uses).select("memory_id", "access_count")


# ---- activity: text leg, time and topics

_EVENT_TEXT = "type || ' ' || split_part(domain, '.', 1) || ' item' || CAST(k % 50 AS VARCHAR)"
_EVENT_INDEX = f"SELECT event_id AS doc_id, unnest(t) AS token, unnest(range(0, len(t))) AS pos FROM (SELECT event_id, {_tokens_sql('x')} AS t FROM (SELECT event_id, {_EVENT_TEXT} AS x FROM ({V_EVENTS})))"
_EVENT_WANTED = f"SELECT DISTINCT event_id AS query_id, unnest(t) AS token FROM (SELECT event_id, {_tokens_sql('x')} AS t FROM (SELECT event_id, {_EVENT_TEXT} AS x FROM ({V_EVENTS}) WHERE event_id % 100 = 0))"


@query(f"SELECT query_id, doc_id AS event_id, matched, score, rank FROM ({_search_sql(_EVENT_INDEX, _EVENT_WANTED)}) WHERE rank <= 10")
def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = tables.activity_events(spark, sf_dir).select("event_id", F.concat("type", F.lit(" "), F.substring_index("domain", ".", 1), F.lit(" item"), (F.col("k") % 50).cast("string")).alias("text"))
    asked = texts.where("event_id % 100 = 0").select(F.col("event_id").alias("query_id"), retrieval.search_terms(F.col("text")).alias("terms"))
    return retrieval.search_copies(asked, texts, "event_id", "text", 10).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""SELECT t.topic, count(*) AS events, CAST(sum(e.duration_seconds) AS BIGINT) AS seconds, max(e.occurred_at) AS last_at FROM ({V_EVENTS}) e
    JOIN (SELECT doc_id, 'https://site' || CAST(doc_id % 12 AS VARCHAR) || '.example.com/p/' || CAST(doc_id AS VARCHAR) AS url FROM documents) d ON d.url = e.url
    JOIN (SELECT DISTINCT vec_id // 5 AS document_id, label AS topic FROM embeddings) t ON t.document_id = d.doc_id GROUP BY t.topic""")
def time_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://site"), (F.col("doc_id") % 12).cast("string"), F.lit(".example.com/p/"), F.col("doc_id").cast("string"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"), url.alias("url"))
    return rollups.time_by_topic(tables.activity_events(spark, sf_dir), docs, tables.chunks(spark, sf_dir))


_NEAREST = f"""WITH m AS (SELECT topic, pos, avg(x) AS x FROM (SELECT label AS topic, unnest(range(0, len(embedding))) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY topic, pos),
    c AS (SELECT topic, list(x ORDER BY pos) AS e FROM m GROUP BY topic)
    SELECT document_id, topic, similarity FROM (SELECT a.document_id, b.topic, round({_COS}, 9) AS similarity, row_number() OVER (PARTITION BY a.chunk_id ORDER BY round({_COS}, 9) DESC, b.topic) AS rn FROM ({_V}) a, c b) WHERE rn = 1"""


@query(f"""WITH c AS (SELECT document_id, topic_id, max(confidence) AS confidence FROM (
        SELECT vec_id // 5 AS document_id, label AS topic_id, round(count(*) / 5.0, 6) AS confidence FROM embeddings GROUP BY 1, 2
        UNION ALL SELECT document_id, topic, round(similarity, 6) FROM ({_NEAREST})) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY confidence DESC, topic_id) AS rn FROM c)
    SELECT document_id, topic_id, CAST(confidence AS DOUBLE) AS confidence, rn = 1 AS is_primary FROM r WHERE rn <= 3""")
def topic_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = tables.chunks(spark, sf_dir).groupBy("document_id", F.col("topic").alias("topic_id")).agg(F.round(F.count("*") / 5.0, 6).alias("confidence"))
    near = nearest_topic(spark, sf_dir).join(tables.chunks(spark, sf_dir).select("chunk_id", "document_id"), "chunk_id")
    return lifecycle.assign_topics(hits, near.select("document_id", F.col("topic").alias("topic_id"), F.col("similarity").alias("confidence")), 3)


_READ = f"""SELECT CAST(e.occurred_at AS DATE) AS day, t.topic, e.duration_seconds FROM ({V_EVENTS}) e
    JOIN (SELECT doc_id, 'https://site' || CAST(doc_id % 12 AS VARCHAR) || '.example.com/p/' || CAST(doc_id AS VARCHAR) AS url FROM documents) d ON d.url = e.url
    JOIN (SELECT DISTINCT vec_id // 5 AS document_id, label AS topic FROM embeddings) t ON t.document_id = d.doc_id"""


@query(f"""SELECT day, {", ".join(f'CAST(coalesce(sum(duration_seconds) FILTER (WHERE topic = {t}), 0) AS BIGINT) AS "{t}"' for t in range(4))}, CAST(coalesce(sum(duration_seconds) FILTER (WHERE topic IS NULL OR topic NOT IN (0, 1, 2, 3)), 0) AS BIGINT) AS other, CAST(sum(duration_seconds) AS BIGINT) AS total FROM ({_READ}) GROUP BY day""")
def time_by_day_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://site"), (F.col("doc_id") % 12).cast("string"), F.lit(".example.com/p/"), F.col("doc_id").cast("string"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"), url.alias("url"))
    return rollups.time_by_day_topic(tables.activity_events(spark, sf_dir), docs, tables.chunks(spark, sf_dir), [0, 1, 2, 3])


@query(f"""SELECT memory_id, statement FROM ({_CHAIN}) WHERE status = 'active' AND kind = 'fact' ORDER BY valid_from DESC, memory_id DESC LIMIT 20""")
def recent_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = memory.supersede_chain(tables.memories(spark, sf_dir), "conv_id")
    return rollups.recent_memories(held, 20, ["fact"]).select("memory_id", "statement")


_PASSAGES = "SELECT label AS topic, CAST(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * (vec_id // 5) AS DATE) AS captured, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL"
_DOCUMENT_URL = "'https://site' || CAST(document_id % 12 AS VARCHAR) || '.example.com/p/' || CAST(document_id AS VARCHAR)"


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages whose documents were captured an hour apart."""
    return tables.chunks(spark, sf_dir).withColumn("captured_at", F.expr(f"{tables.EPOCH} + make_dt_interval(0, cast(document_id as int), 0, 0)"))


@query(f"""WITH p AS ({_PASSAGES}), d AS (SELECT DISTINCT topic, captured + 1 AS from_day FROM p)
    SELECT d.topic, epoch_us(CAST(from_day AS TIMESTAMP)) // 86400000000 AS from_day, epoch_us(CAST(lead(from_day) OVER (PARTITION BY d.topic ORDER BY from_day) AS TIMESTAMP)) // 86400000000 AS to_day, members, first_entry
    FROM (SELECT d.topic, d.from_day, count(*) AS members, round(avg(e[1]), 6) AS first_entry FROM d JOIN p ON p.topic = d.topic AND p.captured < d.from_day GROUP BY d.topic, d.from_day) d""")
def topic_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = novelty.centroid_versions(_passages(spark, sf_dir))
    return found.select("topic", "from_day", "to_day", "members", F.round(F.element_at("centroid", 1), 6).alias("first_entry"))


@query(f"""WITH p AS ({_PASSAGES}),
    v AS (SELECT document_id, {_DOCUMENT_URL} AS url, list(x ORDER BY pos) AS e FROM (
        SELECT document_id, pos, avg(x) AS x FROM (SELECT vec_id // 5 AS document_id, unnest(range(0, len(embedding))) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY document_id, pos) GROUP BY document_id),
    r AS (SELECT event_id, CAST(occurred_at AS DATE) AS day, v.e FROM ({V_EVENTS}) JOIN v USING (url)),
    c AS (SELECT day, topic, list(x ORDER BY pos) AS e FROM (
        SELECT day, topic, pos, avg(x) AS x FROM (SELECT day, topic, unnest(range(0, len(p.e))) AS pos, unnest(p.e) AS x FROM (SELECT DISTINCT day FROM r) JOIN p ON p.captured < day) GROUP BY day, topic, pos) GROUP BY day, topic),
    s AS (SELECT b.event_id, a.topic, round({_COS}, 9) AS likeness, count(*) OVER (PARTITION BY b.event_id) AS known_topics, row_number() OVER (PARTITION BY b.event_id ORDER BY round({_COS}, 9) DESC, a.topic) AS rn FROM r b JOIN c a ON a.day = b.day)
    SELECT r.event_id, coalesce(known_topics, 0) AS known_topics, topic, round(CASE WHEN likeness IS NULL THEN 0.5 ELSE least(1.0, greatest(0.0, 1 - likeness)) END, 6) AS topic_novelty FROM r LEFT JOIN s ON s.event_id = r.event_id AND rn = 1""")
def event_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each event on a captured page: the topics known on its day, the nearest of them, and how new the page was."""
    chunks = tables.chunks(spark, sf_dir)
    means = rollups.topic_centroids(chunks.select(F.col("document_id").alias("topic"), "embedding")).select(F.col("topic").alias("document_id"), "centroid")
    url = F.concat(F.lit("https://site"), (F.col("document_id") % 12).cast("string"), F.lit(".example.com/p/"), F.col("document_id").cast("string"))
    read = tables.activity_events(spark, sf_dir).select("event_id", "occurred_at", "url").join(means.withColumn("url", url), "url")
    found = novelty.known_likeness(read, novelty.centroid_versions(_passages(spark, sf_dir)), "event_id", "occurred_at", "centroid")
    return found.select("event_id", "known_topics", "topic", F.round(novelty.novelty(F.col("likeness")), 6).alias("topic_novelty"))


@query(f"""SELECT t.topic, count(*) AS events, CAST(sum(e.duration_seconds) AS BIGINT) AS seconds, max(e.occurred_at) AS last_at FROM ({V_EVENTS}) e
    JOIN (SELECT doc_id, doc_id % 7 AS of_user, 'https://site' || CAST(doc_id % 12 AS VARCHAR) || '.example.com/p/' || CAST(doc_id AS VARCHAR) AS url FROM documents) d ON d.url = e.url AND d.of_user = e.user_id % 7
    JOIN (SELECT DISTINCT vec_id // 5 AS document_id, label AS topic FROM embeddings) t ON t.document_id = d.doc_id GROUP BY t.topic""")
def own_time_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time on topics where each user has documents of their own; events name their pages with a campaign's parameters."""
    url = F.concat(F.lit("https://site"), (F.col("doc_id") % 12).cast("string"), F.lit(".example.com/p/"), F.col("doc_id").cast("string"))
    docs = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), url.alias("url"), (F.col("doc_id") % 7).alias("user_id"))
    events = tables.activity_events(spark, sf_dir).withColumn("user_id", F.col("user_id") % 7).withColumn("url", F.concat("url", F.lit("?utm_source=feed#top")))
    return rollups.time_by_topic(events, docs, tables.chunks(spark, sf_dir))
