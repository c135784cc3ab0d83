"""Queries over captured documents and pages: identity, chunks, cleaning, routing and upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.columns import domain_of, estimate_tokens, reading_seconds, slugify, squeeze, truncate
from mnemospark.operators import corpus, ingest, lifecycle, rollups
from mnemospark.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_SQUEEZED = "trim(regexp_replace({}, '[ \\t-\\r]+', ' ', 'g'))"
#: The document view as SQL, for the DuckDB side.
V_DOCUMENTS = f"""
    SELECT doc_id AS document_id, doc_id % 150 AS user_id, source, lang, text AS extracted_text,
           sha256({_SQUEEZED.format("regexp_replace(nfc_normalize(text), '[​-‍﻿]', '', 'g')")}) AS content_hash,
           len(regexp_extract_all(text, '[^ \\t-\\r]+')) AS word_count,
           'https://' || source || '.example.com/d/' || CAST(doc_id % 997 AS VARCHAR) AS url,
           TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * doc_id AS captured_at
    FROM documents"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


D = tables.documents


@query(f"SELECT CAST(date_trunc('week', captured_at) AS DATE) AS week, count(*) AS documents, CAST(sum(word_count) AS BIGINT) AS words FROM ({V_DOCUMENTS}) GROUP BY 1")
def docs_per_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D(spark, sf_dir).groupBy(F.to_date(F.date_trunc("week", "captured_at")).alias("week")).agg(F.count("*").alias("documents"), F.sum("word_count").alias("words"))


@query(f"""SELECT user_id, content_hash, arg_min(document_id, (captured_at, document_id)) AS document_id, min(captured_at) AS captured_at,
    arg_max(url, (captured_at, document_id)) AS url, max(captured_at) AS last_seen_at, count(*) AS captures FROM ({V_DOCUMENTS}) GROUP BY user_id, content_hash""")
def document_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D(spark, sf_dir)
    return ingest.upsert_documents(d)


@query(f"""SELECT user_id, content_hash, min(document_id) AS first_id, count(*) AS copies FROM ({V_DOCUMENTS}) GROUP BY user_id, content_hash""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.exact_groups(D(spark, sf_dir))


@query(f"""SELECT document_id, captured_at FROM ({V_DOCUMENTS}) d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id // 5 = d.document_id)
    ORDER BY captured_at, document_id LIMIT 100""")
def embedding_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D(spark, sf_dir).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    return ingest.embedding_backlog(d, tables.chunks(spark, sf_dir), 100).select("document_id", "captured_at")


@query(f"""SELECT coalesce(reason, 'valid') AS verdict, source, count(*) AS documents FROM (
    SELECT source, CASE WHEN NOT length(extracted_text) BETWEEN 200 AND 500000 THEN 'text' WHEN source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7') THEN 'source' WHEN NOT word_count >= 1 THEN 'word_count' END AS reason
    FROM ({V_DOCUMENTS})) GROUP BY 1, 2""")
def document_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.document_verdict(D(spark, sf_dir), [f"src{i}" for i in range(8)]).groupBy(F.coalesce("reason", F.lit("valid")).alias("verdict"), "source").agg(F.count("*").alias("documents"))


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Pieces of 679 characters, each chunk with the last 120 of the piece before it.
_CHUNKS = f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS ordinal,
        CASE WHEN i = 1 THEN own ELSE tail || CASE WHEN tail = '' OR regexp_matches(tail, '[ \\t-\\r]$') THEN '' ELSE ' ' END || own END AS chunk
    FROM (SELECT doc_id, i, pieces[i] AS own, CASE WHEN length(pieces[i - 1]) > 120 THEN regexp_replace(right(pieces[i - 1], 120), '^[^ \\t-\\r]*[ \\t-\\r]', '') ELSE pieces[i - 1] END AS tail
        FROM (SELECT doc_id, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM (
            SELECT doc_id, list_filter(list_transform(range(0, CAST(floor((length(text) - 1) / 679) AS BIGINT) + 1), lambda n: trim(substring(text, n * 679 + 1, 679), {_BLANK})), lambda c: c <> '') AS pieces
            FROM documents WHERE length(trim(text, {_BLANK})) > 0)))"""


@query(f"SELECT doc_id, ordinal, chunk, CAST(ceil(length(chunk) / 4) AS BIGINT) AS token_count FROM ({_CHUNKS})")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.fixed_chunks(tables.read(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.recursive_chunks(tables.read(spark, sf_dir, "documents"), "doc_id", "text")


@query("""SELECT doc_id, line, count(*) AS times FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE length(trim(line)) >= 20 GROUP BY doc_id, line HAVING count(*) > 3""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.repeated_lines(tables.read(spark, sf_dir, "documents"), "doc_id", "text")


_LINES = f"""SELECT document_id, site, before, i, lines[i] AS line, len(lines) AS n FROM (SELECT document_id, site, before, lines, unnest(range(1, len(lines) + 1)) AS i FROM (
    SELECT doc_id AS document_id, coalesce(source, '') AS site, length(coalesce(text, '')) AS before,
        string_split(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]', '', 'g'), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{{9F}}\\x{{FFFD}}]', '', 'g'), chr(10)) AS lines FROM documents))"""
_LINK = corpus.LINK.replace("'", "''")
_SITE_LINES = f"""
    b AS (SELECT document_id, site, line AS body FROM (SELECT document_id, site, trim(line) AS line, row_number() OVER (PARTITION BY document_id ORDER BY length(trim(line)) DESC, trim(line) DESC) AS rn FROM l) WHERE rn = 1),
    w AS (SELECT site, greatest({corpus.SITE_TEXTS}, ceil(count(DISTINCT body) * CAST({corpus.SITE_SHARE} AS DOUBLE))) AS wanted FROM b GROUP BY site),
    s AS (SELECT l.site, trim(l.line) AS line FROM l JOIN b ON b.document_id = l.document_id JOIN w ON w.site = l.site WHERE trim(l.line) <> '' GROUP BY l.site, trim(l.line), wanted HAVING count(DISTINCT body) >= wanted)"""


@query(f"""WITH l AS (SELECT *, length(trim(line)) AS size FROM ({_LINES})), {_SITE_LINES},
    m AS (SELECT l.* FROM l LEFT JOIN s ON s.site = l.site AND s.line = trim(l.line) WHERE s.line IS NULL
        AND NOT (size > 0 AND size < 40 AND NOT regexp_matches(l.line, '[.!?:]\\s*$') AND (i <= 3 OR i > n - 3) AND n > 6)
        AND NOT (size > 0 AND size - length(trim(regexp_replace(l.line, '{_LINK}', '', 'g'))) > {corpus.LINK_SHARE} * size)),
    r AS (SELECT *, count(*) OVER (PARTITION BY document_id, line) AS times, row_number() OVER (PARTITION BY document_id, line ORDER BY i) AS nth FROM m),
    k AS (SELECT document_id, string_agg(line, chr(10) ORDER BY i) AS text FROM r WHERE NOT (size >= 20 AND times > 3 AND nth > 1) GROUP BY document_id),
    o AS (SELECT d.document_id, d.before, trim(regexp_replace(regexp_replace(coalesce(k.text, ''), '[ \\t]+', ' ', 'g'), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')) AS text
          FROM (SELECT DISTINCT document_id, before FROM l) d LEFT JOIN k ON k.document_id = d.document_id)
    SELECT document_id, length(text) AS chars, round(CASE WHEN before > 0 THEN 1 - length(text) / before ELSE 0.0 END, 6) AS removed_ratio FROM o""")
def cleaned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.clean_documents(D(spark, sf_dir), site="source").select("document_id", F.length("text").alias("chars"), "removed_ratio")


@query(f"""WITH l AS ({_LINES}), {_SITE_LINES} SELECT site, count(*) AS lines FROM s GROUP BY site""")
def site_wide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = corpus.normalise_unicode(D(spark, sf_dir).select(F.coalesce("source", F.lit("")).alias("site"), F.coalesce("extracted_text", F.lit("")).alias("t")), "t").select("site", F.split("t", "\n").alias("lines"))
    return corpus.site_lines(texts).select("site", F.size("site_lines").cast("bigint").alias("lines"))


_BLOCK = ", ".join(f"'{t}'" for t in corpus.BLOCK_TAGS)
_RAW = "(?is)<!--.*?-->|" + "|".join(f"<{t}\\b.*?</{t}\\s*>" for t in ("script", "style", "noscript", "template"))
_PIECE = f"""CASE WHEN i = 1 THEN p WHEN regexp_extract(p, '^/?([a-zA-Z][a-zA-Z0-9]*)[^>]*>', 1) <> '' OR regexp_matches(p, '^[!?][^>]*>')
    THEN CASE WHEN lower(regexp_extract(p, '^/?([a-zA-Z][a-zA-Z0-9]*)[^>]*>', 1)) IN ({_BLOCK}) THEN chr(10) || chr(10) WHEN lower(regexp_extract(p, '^/?([a-zA-Z][a-zA-Z0-9]*)[^>]*>', 1)) = 'br' THEN chr(10) ELSE '' END
         || regexp_extract(p, '(?s)^[^>]*>(.*)$', 1) ELSE '<' || p END"""
_NAME = "regexp_extract(p, '^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-z]+);', 1)"
_CHAR = f"CASE WHEN {_NAME} SIMILAR TO '#[0-9]+' THEN chr(CAST(substring({_NAME}, 2) AS INTEGER)) WHEN {_NAME} LIKE '#%' THEN chr(CAST('0x' || substring({_NAME}, 3) AS INTEGER)) " + " ".join(f"WHEN {_NAME} = '{n}' THEN chr({ord(c)})" for n, c in corpus.REFERENCES.items()) + " END"


@query(f"""WITH t AS (SELECT page_id, url, html, string_split(regexp_replace(coalesce(html, ''), '{_RAW}', '<s>', 'g'), '<') AS ps FROM pages),
    b AS (SELECT page_id, url, html, string_split(array_to_string(list_transform(ps, lambda p, i: {_PIECE}), ''), '&') AS ps FROM t),
    d AS (SELECT page_id, url, html, array_to_string(list_transform(ps, lambda p, i: CASE WHEN i = 1 THEN p WHEN {_CHAR} IS NOT NULL THEN {_CHAR} || substring(p, length({_NAME}) + 2) ELSE '&' || p END), '') AS x FROM b),
    l AS (SELECT page_id, url, html, regexp_replace(regexp_replace(x, '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]', '', 'g'), '[ \\t\\r\\f\\x0B\\x{{A0}}]+', ' ', 'g') AS x FROM d),
    o AS (SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(x, ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM l)
    SELECT page_id, url, nullif(trim(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, nullif(regexp_extract(coalesce(html, ''), '(?i)<html[^>]*\\blang=.([A-Za-z-]+).', 1), '') AS lang,
           text, CASE WHEN length(text) >= 400 THEN 'succeeded' ELSE 'failed' END AS status, CASE WHEN length(text) < 400 THEN 'too_short' END AS reason FROM o""")
def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.extract_pages(tables.read(spark, sf_dir, "pages"))


@query("""SELECT coalesce(lang, 'none') AS lang, documents, round(documents / sum(documents) OVER (), 6) AS share FROM (SELECT lang, count(*) AS documents FROM documents GROUP BY lang)""")
def language_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rollups.status_distribution(tables.read(spark, sf_dir, "documents"), "lang")
    return out.select(F.coalesce("lang", F.lit("none")).alias("lang"), F.col("rows").alias("documents"), "share")


_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '')"


@query(f"""WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, {_HOST} AS host,
        regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM pages),
    c AS (SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END ||
            CASE WHEN len(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT x LIKE 'utm!_%' ESCAPE '!')) > 0
                 THEN '?' || array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT x LIKE 'utm!_%' ESCAPE '!')), '&') ELSE '' END AS canonical_url FROM p)
    SELECT canonical_url, count(*) AS captures, min(page_id) AS first_id FROM c GROUP BY canonical_url""")
def canonical_url_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.canonical_rollup(tables.read(spark, sf_dir, "pages"))


@query(f"SELECT {_HOST} AS domain, count(*) AS pages FROM pages GROUP BY 1")
def pages_per_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "pages").groupBy(domain_of(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


@query("""SELECT label AS topic, members, round(CASE WHEN max(members) OVER () = min(members) OVER () THEN 0.5
        ELSE (members - min(members) OVER ()) / (max(members) OVER () - min(members) OVER ()) END, 6) AS weight,
        round(members / sum(members) OVER (), 6) AS share FROM (SELECT label, count(*) AS members FROM embeddings GROUP BY label)""")
def topic_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.topic_cloud(tables.chunks(spark, sf_dir), "topic")


@query(f"SELECT doc_id, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars, CAST(max(length(chunk)) AS BIGINT) AS longest FROM ({_CHUNKS}) GROUP BY doc_id")
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = corpus.chunk_statistics(corpus.fixed_chunks(tables.read(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")
    return out.select("doc_id", "chunks", "chars", F.col("longest").cast("bigint").alias("longest"))


@query(f"""SELECT document_id, CAST(ceil(length(extracted_text) / 4) AS BIGINT) AS tokens, CAST(floor(word_count / 238 * 60 + 0.5) AS BIGINT) AS reading_seconds,
    CASE WHEN length(s) <= 40 THEN s ELSE substring(s, 1, 39) || '…' END AS title, regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
    FROM (SELECT *, {_SQUEEZED.format("extracted_text")} AS s FROM ({V_DOCUMENTS}))""")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D(spark, sf_dir).select("document_id", estimate_tokens(F.col("extracted_text")).alias("tokens"), reading_seconds(F.col("word_count")).alias("reading_seconds"), truncate(squeeze(F.col("extracted_text")), 40).alias("title"), slugify(F.col("source")).alias("slug"))


@query(f"""SELECT document_id, source FROM ({V_DOCUMENTS}) WHERE extracted_text ILIKE '%license%' ORDER BY document_id LIMIT 20""")
def title_typeahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D(spark, sf_dir).where(F.col("extracted_text").ilike("%license%")).select("document_id", "source").orderBy("document_id").limit(20)


@query("""SELECT vec_id AS chunk_id, vec_id // 5 AS document_id FROM embeddings WHERE (vec_id // 5) % 7 <> 0""")
def purge_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    purged = D(spark, sf_dir).where("document_id % 7 = 0")
    c = tables.chunks(spark, sf_dir)
    missing = c.select("document_id").where("document_id % 7 = 0").distinct()
    return lifecycle.purge_documents(purged.select("document_id").unionByName(missing), {"chunks": c})["chunks"].select("chunk_id", "document_id")


@query(f"""SELECT document_id FROM ({V_DOCUMENTS}) WHERE NOT (document_id % 3 = 0 AND document_id % 2 = 0)""")
def reprocess_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D(spark, sf_dir)
    done = d.where("document_id % 3 = 0").select("document_id", F.expr("CASE WHEN document_id % 2 = 0 THEN 'v2' ELSE 'v1' END").alias("version"))
    return lifecycle.not_current(d, done, "document_id", "v2").select("document_id")


_RULES = [(i, c, p, kind, v) for i, (c, p, *lists) in enumerate(lifecycle.CATEGORY_RULES) for kind, values in enumerate(lists) for v in values]
#: Topics that the passages' labels stand for, so that rules match.
_LABEL_TOPICS = ["databases", "machine-learning", "travel", "courses", "strategy", "nutrition", "investing", "newsletters", "embeddings", "gardening"]
#: Hosts that the documents' sources stand for, so that rules match.
_SOURCE_HOSTS = {"src0": "export.arxiv.org", "src1": "github.com", "src2": "blog.example.com", "src3": "nytimes.com", "src4": "deeplearning.medium.com"}
_HOST_CASE = "CASE source " + " ".join(f"WHEN '{s}' THEN '{h}'" for s, h in _SOURCE_HOSTS.items()) + " ELSE 'example.org' END"


@query(f"""WITH d AS (SELECT doc_id AS document_id, {_HOST_CASE} AS host, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9-]+', ' ', 'g'), ' '), lambda w: length(w) > 0) AS w FROM documents),
    t AS (SELECT vec_id // 5 AS document_id, label FROM embeddings GROUP BY 1, 2),
    r(place, category, confidence, kind, value) AS (VALUES {", ".join(f"({i}, '{c}', {p}, {k}, '{v}')" for i, c, p, k, v in _RULES)}),
    x AS (SELECT document_id, 1 AS kind, list_extract({_LABEL_TOPICS}, CAST(label + 1 AS BIGINT)) AS value FROM t
          UNION SELECT document_id, 2, unnest(w) FROM d UNION SELECT document_id, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d),
    f AS (SELECT d.document_id, r.* FROM d JOIN r ON r.kind = 0 AND (d.host = r.value OR d.host LIKE '%.' || r.value)
          UNION ALL SELECT x.document_id, r.* FROM x JOIN d ON d.document_id = x.document_id JOIN r ON r.kind = x.kind AND r.value = x.value),
    m AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY confidence DESC, kind, place, value) AS rn FROM f)
    SELECT d.document_id, CASE WHEN m.confidence >= 0.55 THEN m.category ELSE 'unclassified' END AS category, coalesce(CAST(m.confidence AS DOUBLE), 0.0) AS confidence,
           CASE WHEN m.confidence >= 0.55 THEN CASE m.kind WHEN 0 THEN 'host:' WHEN 1 THEN 'topic:' ELSE 'keyword:' END || m.value ELSE 'fallback' END AS matched_by
    FROM d LEFT JOIN (SELECT * FROM m WHERE rn = 1) m ON m.document_id = d.document_id""")
def category_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, _LABEL_TOPICS))
    topics = tables.chunks(spark, sf_dir).groupBy("document_id").agg(F.collect_set(F.get(names, F.col("topic"))).alias("topics"))
    d = D(spark, sf_dir).select("document_id", F.expr(_HOST_CASE).alias("host"), F.col("extracted_text").alias("title")).join(topics, "document_id", "left")
    return lifecycle.route_categories(d, lifecycle.category_rules(spark))


_TOPIC_WORDS = [(1, ["the", "tion"]), (2, ["que", "des"]), (3, ["Thon"]), (4, ["no-such-word"])]
_KEYED = ", ".join(f"({i}, '{w.lower()}')" for i, ws in _TOPIC_WORDS for w in ws)


@query(f"""SELECT DISTINCT document_id, topic_id, CAST(0.7 AS DOUBLE) AS confidence FROM (
    SELECT doc_id AS document_id, doc_id % 150 AS user_id, unnest(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}-]+', ' ', 'g'), ' ')) AS word FROM documents)
    JOIN (VALUES {_KEYED}) k(topic_id, keyword) ON keyword = word WHERE (user_id + topic_id) % 2 = 0""")
def topics_by_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D(spark, sf_dir).select("document_id", "user_id", F.col("extracted_text").alias("text"))
    topics = spark.createDataFrame(_TOPIC_WORDS, "topic_id int, keywords array<string>").withColumn("user_id", F.explode(F.sequence(F.lit(0), F.lit(149)))).where("(user_id + topic_id) % 2 = 0")
    return lifecycle.topics_by_keyword(d, topics)


@query(f"""SELECT document_id, url, 'https://src3.example.com/d/' || CAST(document_id % 997 AS VARCHAR) AS canonical_url FROM ({V_DOCUMENTS}) WHERE source = 'src3' AND (document_id % 997) % 5 = 3""")
def document_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D(spark, sf_dir)
    asked = spark.range(3, 997, 5).select(F.concat(F.lit("HTTPS://www.SRC3.example.com:443/d/"), F.col("id").cast("string"), F.lit("/?utm_source=x#top")).alias("url"))
    return ingest.document_by_url(d, asked).select("document_id", "url", "canonical_url")


@query(f"""SELECT document_id, url FROM ({V_DOCUMENTS}) WHERE document_id % 9 <> 0 ORDER BY captured_at DESC, document_id DESC LIMIT 20""")
def recent_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D(spark, sf_dir).withColumn("deleted_at", F.when(F.col("document_id") % 9 == 0, F.col("captured_at")))
    return rollups.recent_documents(d).select("document_id", "url")


@query("""WITH d AS (SELECT doc_id % 150 AS user_id, count(*) AS n FROM documents GROUP BY 1)
    SELECT user_id, slug, parent_slug FROM d CROSS JOIN (VALUES ('technology', NULL), ('databases', 'technology'), ('travel', NULL)) s(slug, parent_slug)
    WHERE NOT (slug = 'travel' AND user_id % 2 = 0)""")
def topic_seeding(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = D(spark, sf_dir).select("user_id").distinct()
    seeds = spark.createDataFrame([("technology", None), ("databases", "technology"), ("travel", None)], "slug string, parent_slug string")
    stored = users.where("user_id % 2 = 0").withColumn("slug", F.lit("travel"))
    return lifecycle.seed_topics(users, seeds, stored).select("user_id", "slug", "parent_slug")
