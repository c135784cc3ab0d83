"""The registered queries of the corpus operators: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import bpe, chat_format, embed_dedup, exact_dedup, html_extract, language_id, lexical_search, license_scan, minhash_dedup, mixing, toxicity, url_filters, whitening
from mnemospark.llm.common import read_table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents")).drop("spans")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read_table(spark, sf_dir, "documents"))


def op3_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_embeddings(read_table(spark, sf_dir, "embeddings"))


#: Turns of conversation -1, whose texts are control strings.
CONTROL_TURNS = [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CONTROL_TURNS, "conv_id bigint, turn bigint, role string, text string")
    return chat_format.digest_formatted(chat_format.format_conversations(turns.unionByName(extra)))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(read_table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def held_out():
    """Documents whose language label is not learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = language_id.detect_language(docs, docs.where(~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read_table(spark, sf_dir, "documents"))


#: The filter's rules.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(read_table(spark, sf_dir, "pages"), url_filters.rules_table(spark, URL_RULES))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def _url_filters_sql() -> str:
    """The rounds of propagation as one query after another; scores are integers, so that they are the same."""
    u = url_filters
    lower = f"'{u.UPPER}', '{u.LOWER}'"
    start = u.UNIT * (1 - u.DAMPING)
    link = u.LINK.replace("'", "''")
    fits = " UNION ALL ".join(f"SELECT '{r.partition('/')[0]}' AS rh, '/{r.partition('/')[2]}' AS rp, '{v}' AS ruled" for v, r in URL_RULES)
    moved = lambda c: f"CAST(floor(CAST({c} AS DOUBLE) * share * CAST({u.DAMPING} AS DOUBLE)) AS BIGINT)"
    seed = lambda mark, c: f"SELECT '{mark}' || host AS node, CAST(floor({c} * CAST({start!r} AS DOUBLE) + 0.5) AS BIGINT) AS seeded, CAST(floor(CAST({start!r} AS DOUBLE) + 0.5) AS BIGINT) AS al FROM hosts"
    share = lambda mark, c: f"CAST(floor(({c} + (1 - trust - distrust) * coalesce(CAST({mark}.seeded AS DOUBLE) / nullif({mark}.al, 0), 0)) * {u.MILLION} + 0.5) AS BIGINT) AS {c}"
    rounds = "".join(
        f"""
        s{k} AS MATERIALIZED (SELECT node, CAST(sum(seeded) AS BIGINT) AS seeded, CAST(sum(al) AS BIGINT) AS al FROM (
            SELECT b AS node, {moved("seeded")} AS seeded, {moved("al")} AS al FROM edges JOIN s{k - 1} ON node = a
            {"UNION ALL SELECT * FROM s0" if k < u.ROUNDS else ""}) GROUP BY node),"""
        for k in range(1, u.ROUNDS + 1)
    )
    return rf"""
        WITH p AS (
            SELECT row_number() OVER () AS r, page_id, html, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), {lower}) AS host,
                   regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        judged AS (
            SELECT p.r, page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(ruled, length(rh || rp)) AS ruled
            FROM p LEFT JOIN ({fits}) ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY p.r, page_id, host, path),
        hosts AS MATERIALIZED (
            SELECT host, CAST(count(*) FILTER (ruled = 'allow') AS DOUBLE) / count(*) AS trust, CAST(count(*) FILTER (ruled = 'block') AS DOUBLE) / count(*) AS distrust
            FROM judged WHERE host <> '' GROUP BY host),
        parts AS (
            SELECT host, string_split(host, '.') AS l FROM hosts WHERE NOT regexp_matches(host, '(^|\.)[0-9][^.]*$')),
        up AS (
            SELECT DISTINCT array_to_string(l[-k:], '.') AS src, array_to_string(l[-(k - 1):], '.') AS dst
            FROM (SELECT l, unnest(range(3, len(l) + 1)) AS k FROM parts WHERE len(l) BETWEEN 3 AND {u.MOST_LABELS})),
        found AS (
            SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), {lower}) AS dst FROM p WHERE host <> ''),
        links AS MATERIALIZED (
            SELECT src, dst, count(*) AS links FROM (SELECT * FROM found WHERE src <> dst UNION ALL SELECT src, dst FROM up UNION ALL SELECT dst, src FROM up) GROUP BY src, dst),
        edges AS MATERIALIZED (
            SELECT 't' || src AS a, 't' || dst AS b, CAST(links AS DOUBLE) / sum(links) OVER (PARTITION BY src) * coalesce(1 - trust - distrust, 1) AS share FROM links LEFT JOIN hosts ON host = dst
            UNION ALL SELECT 'd' || dst, 'd' || src, CAST(links AS DOUBLE) / sum(links) OVER (PARTITION BY dst) * coalesce(1 - trust - distrust, 1) FROM links LEFT JOIN hosts ON host = src),
        s0 AS MATERIALIZED ({seed("t", "trust")} UNION ALL {seed("d", "distrust")}),{rounds}
        shares AS (
            SELECT host, {share("t", "trust")}, {share("d", "distrust")}
            FROM hosts LEFT JOIN s{u.ROUNDS} t ON t.node = 't' || host LEFT JOIN s{u.ROUNDS} d ON d.node = 'd' || host)
        SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN distrust > trust AND distrust >= {round(u.BLOCK_SHARE * u.MILLION)} THEN 'block' ELSE 'allow' END) AS verdict,
               coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
        FROM judged j LEFT JOIN shares s ON s.host = j.host"""


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_bpe, op3_embed_dedup, op4_chat_format, op5_html_extract, op6_exact_dedup, op7_toxicity, op8_minhash_dedup, op9_language_id, op10_mixing, op11_url_filters, op12_whitening, op13_lexical_search)}

ORACLE_SQL = {
    "op11_url_filters": _url_filters_sql(),
    "op13_lexical_search": rf"""
        WITH t AS (
            SELECT r, doc_id, unnest(regexp_extract_all(translate(text, '{lexical_search.UPPER}', '{lexical_search.LOWER}'), '{lexical_search.TERM}')) AS term
            FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
        d AS (SELECT r, doc_id, count(*) AS n FROM t GROUP BY r, doc_id),
        a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM d),
        i AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{lexical_search.UPPER}', '{lexical_search.LOWER}'), '{lexical_search.TERM}')) AS term FROM benchmark),
        f AS (SELECT r, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY r, term),
        w AS (
            SELECT term, CAST(floor(CAST(1000 AS DOUBLE) * ln((CAST(2 AS DOUBLE) * any_value(docs) + CAST(2 AS DOUBLE)) / (CAST(2 AS DOUBLE) * count(*) + CAST(1 AS DOUBLE)))) AS BIGINT) AS w
            FROM f, a GROUP BY term),
        s AS (
            SELECT item_id, d.r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // length)))) AS BIGINT) AS score
            FROM f JOIN d ON d.r = f.r JOIN w ON w.term = f.term JOIN i ON i.term = f.term, a GROUP BY item_id, d.r, doc_id)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0) WHERE rank <= {lexical_search.TOP}""",
    "op3_embed_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND label IS NOT NULL),
        n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
        link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
        reach AS (
            SELECT vec_id AS node, vec_id AS other FROM embeddings
            UNION
            SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.other)
        SELECT r.vec_id, coalesce(d.n_links, 0) AS n_links, r.component_id, r.vec_id = r.component_id AS kept
        FROM (SELECT node AS vec_id, min(other) AS component_id FROM reach GROUP BY node) r
        LEFT JOIN (SELECT a, count(*) AS n_links FROM link GROUP BY a) d ON d.a = r.vec_id""",
    "op8_minhash_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w
            FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
            FROM w),
        u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        link AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        reach AS (
            SELECT doc_id AS node, doc_id AS other FROM documents
            UNION
            SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.other)
        SELECT s.doc_id, len(s.s) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
        FROM s JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) r ON r.node = s.doc_id""",
    "op6_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
        FROM (SELECT doc_id, text_sha256,
                     first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS FIRST
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
                     count(*) OVER (PARTITION BY text_sha256) AS group_size
              FROM d)""",
}
