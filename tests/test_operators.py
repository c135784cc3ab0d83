"""Rules of single operators on small frames."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.functions import columns
from mnemospark.operators import corpus, importance, ingest, lifecycle, memory, retrieval, rollups, search, sessions

NO_SIGNALS = {"dwell_seconds": 0.0, "scroll_depth_pct": 0.0, "is_unique_domain": False, "revisit_count": 0, "word_count": 0, "has_selection": False, "has_copy": False, "is_bookmarked": False, "is_downloaded": False, "youtube_watched_pct": 0.0, "app_is_excluded": False, "is_working_hours": False, "topic_novelty": 0.0}


@pytest.mark.parametrize(
    ("signals", "score", "band"),
    [
        ({}, 0.0, "noise"),
        ({"dwell_seconds": 300.0, "scroll_depth_pct": 80.0, "is_unique_domain": True, "word_count": 1200, "is_working_hours": True}, 0.56, "normal"),
        ({"dwell_seconds": 10.0}, 0.3, "low"),
        ({"dwell_seconds": 4.0}, 0.12, "noise"),
        ({"dwell_seconds": 30.0, "scroll_depth_pct": 100.0}, 0.45, "normal"),
        ({k: (1e6 if isinstance(v, (int, float)) and not isinstance(v, bool) else True) for k, v in NO_SIGNALS.items() if k != "app_is_excluded"}, 1.0, "critical"),
        ({"dwell_seconds": 300.0, "app_is_excluded": True}, 0.0, "noise"),
    ],
)
def test_client_score(spark, signals, score, band):
    values = {k: float(v) if not isinstance(NO_SIGNALS[k], bool) else v for k, v in (NO_SIGNALS | signals).items()}
    row = importance.client_score(spark.createDataFrame([values])).first()
    assert (row.score, row.band) == (pytest.approx(score), band)
    assert len(row.contributions) == (1 if signals.get("app_is_excluded") else sum(bool(v) for v in signals.values()))


def test_server_weights_are_complete(spark):
    assert importance.weight_check(importance.rules_frame(spark)).first().complete


def chunks(text, **sizes):
    return corpus.chunk_text(text, **sizes)


def test_chunker():
    assert chunks("") == [] and chunks(" \n ") == []
    assert chunks("short") == [("short", [])]
    paragraph = ("word " * 94).strip() + "."
    assert len(chunks("\n\n".join([paragraph] * 4))) == 4
    text = "# Top\n" + "a " * 500 + "\n## Sub\n" + "b " * 800
    paths = [p for _, p in chunks(text)]
    assert paths[0] == ["Top"] and paths[-1] == ["Top", "Sub"]
    assert all(len(c) <= 800 for c, _ in chunks("x" * 2500, least=1))
    assert len(chunks("c" * 700 + "\n\n" + "d" * 200, overlap=0)) == 1  # a short tail joins its predecessor
    assert chunks(text) == chunks(text)
    first, second = chunks("one two three four five. " * 20, size=200, overlap=40, least=1)[:2]
    assert second[0].startswith(first[0][-40:].split(" ", 1)[1])


def test_recursive_chunks_of_a_frame(spark):
    rows = corpus.recursive_chunks(spark.createDataFrame([(1, None), (2, ""), (3, "hello")], "id bigint, t string"), "id", "t").collect()
    assert [(r.id, r.ordinal, r.chunk, r.token_count) for r in rows] == [(3, 0, "hello", 2)]


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("HTTPS://WWW.Example.com:443/a/?utm_source=x&b=2&a=1#top", "https://example.com/a?a=1&b=2"),
        ("example.com", "https://example.com/"),
        ("http://example.com:8080/x//", "http://example.com:8080/x"),
        ("ftp://example.com/x", None),
        ("", None),
        (None, None),
    ],
)
def test_canonical_url(spark, url, expected):
    assert spark.createDataFrame([(url,)], "u string").select(columns.canonical_url(F.col("u")).alias("c")).first().c == expected


def test_dedup_is_idempotent(spark):
    t = datetime.datetime(2024, 1, 1)
    batch = spark.createDataFrame([(1, 7, "k1", t), (2, 7, "k1", t), (3, 7, "k2", t)], "event_id bigint, device_id bigint, dedupe_key string, occurred_at timestamp")
    new = ingest.append_new(batch, batch.limit(0), ["device_id", "dedupe_key"], ["occurred_at", "event_id"])
    assert sorted(r.event_id for r in new.collect()) == [1, 3]
    assert ingest.append_new(batch, new, ["device_id", "dedupe_key"], ["occurred_at", "event_id"]).count() == 0


def test_exclusion_covers_subdomains_and_unknown_hosts(spark):
    e = spark.createDataFrame([("bank.com",), ("my.bank.com",), ("notbank.com",), (None,), ("",)], "domain string")
    left = ingest.exclude_domains(e, spark.createDataFrame([("Bank.com",)], "domain string"))
    assert [r.domain for r in left.collect()] == ["notbank.com"]


def test_envelopes(spark, tmp_path):
    (tmp_path / "b.json").write_text(
        '{"schemaVersion":1,"deviceId":"d","events":[{"id":"e","deviceId":"d"}]}\n{"schemaVersion":2,"deviceId":"d","events":[{"id":"e","deviceId":"d"}]}\n'
        '{"schemaVersion":1,"deviceId":"d","events":[]}\n{"schemaVersion":1,"deviceId":"d","events":[{"id":"e","deviceId":"x"}]}\n'
    )
    rows = ingest.envelope_verdict(ingest.read_envelopes(spark, str(tmp_path))).collect()
    assert sorted(str(r.reason) for r in rows) == ["None", "device_mismatch", "empty_batch", "schema_version"]


def test_payload_verdict(spark):
    rows = spark.createDataFrame([("copy", '{"text":"x"}'), ("copy", "{}"), ("search", '{"query":""}'), ("youtube_watch", '{"videoId":"video-id","watchedSeconds":3,"watchedPct":0.5,"transcriptAvailable":true}'), ("youtube_watch", '{"videoId":"v"}'), ("bookmark", '{"url":"https://a.org/"}'), ("bookmark", '{"url":"x"}'), ("other", None)], "type string, payload string")
    assert [r.payload_reason for r in ingest.payload_verdict(rows).collect()] == ["selectionLength", "text", "query", None, "videoId", None, "url", None]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0, 9.0],), ([0.0, 0.0, 1.0],), ([1.0],)], "v array<double>")
    assert [r.s for r in df.select(columns.shorten_vector(F.col("v"), 2).alias("s")).collect()] == [[0.6, 0.8], None, None]


def test_filters_follow_empty_and_absent_lists(spark):
    df = spark.range(3)
    assert df.where(retrieval.metadata_filter({"id": []})).count() == 0
    assert df.where(retrieval.metadata_filter({"id": None})).count() == 3


def test_blocked_search_equals_the_join(spark, sf):
    from mnemospark.sources import tables

    c = tables.chunks(spark, sf)
    q = c.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    one = retrieval.match_vectors(q, c, "chunk_id", 4).select("query_id", "chunk_id", "rank")
    scored = c.crossJoin(q).select("query_id", "chunk_id", F.round(columns.cosine(F.col("embedding"), F.col("query_embedding")), 9).alias("s")).where("s >= 0")
    two = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "chunk_id"))).where("rank <= 4").select("query_id", "chunk_id", "rank")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_blocked_search_answers_every_query(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], "chunk_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(100 + i, [float(i), 1.0]) for i in range(8)], "query_id bigint, query_embedding array<double>")
    got = {r.query_id: r.chunk_id for r in retrieval.match_vectors(asked, corpus, "chunk_id", 1).collect()}
    assert got == {100 + i: i for i in range(8)}


def test_vector_search_of_odd_rows(spark):
    rows = [(1, 7, [1.0, 0.0]), (2, 7, None), (3, 7, [0.0, 0.0]), (4, 7, [float("nan"), 1.0]), (5, 7, [1.0, 0.0, 0.0]), (6, None, [1.0, 0.0]), (7, 8, [1.0, 0.0]), (8, 7, [1.0, 0.1])]
    corpus_ = spark.createDataFrame(rows, "chunk_id bigint, user_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(1, 7, [2.0, 0.0]), (2, 9, [1.0, 0.0]), (3, 7, None), (4, 7, [0.0, 0.0])], "query_id bigint, user_id bigint, query_embedding array<double>")
    found = retrieval.match_vectors(asked, corpus_, "chunk_id", 5, by="user_id")
    assert sorted((r.query_id, r.chunk_id, r.rank) for r in found.collect()) == [(1, 1, 1), (1, 8, 2)]
    assert retrieval.match_vectors(asked.limit(0), corpus_, "chunk_id", 5).count() == retrieval.match_vectors(asked, corpus_.limit(0), "chunk_id", 5).count() == 0
    by_doc = retrieval.match_vectors(asked, corpus_.withColumn("document_id", F.col("chunk_id") % 7), "document_id", 1, by="user_id", grouped=True)
    assert [(r.query_id, r.document_id, r.similarity) for r in by_doc.collect()] == [(1, 1, 1.0)]


def searchable(spark):
    t = datetime.datetime(2024, 1, 1)
    docs = [(1, 7, "u1", "One", 3, t, None, "succeeded", "alpha beta gamma", [1]), (2, 7, "u2", "Two", 3, t, t, "succeeded", "alpha beta", [1]), (3, 7, "u3", "Three", 3, t, None, "succeeded", "beta alpha delta", [2]), (4, 8, "u4", "Four", 3, t, None, "succeeded", "alpha beta", [1])]
    documents = spark.createDataFrame(docs, "document_id bigint, user_id bigint, url string, title string, word_count int, captured_at timestamp, deleted_at timestamp, extraction_status string, extracted_text string, topic_ids array<int>")
    chunks_ = spark.createDataFrame([(10 * d[0], d[0], d[1], 0, d[8], [1.0, float(d[0])]) for d in docs], "chunk_id bigint, document_id bigint, user_id bigint, ordinal int, text string, embedding array<double>")
    memories = spark.createDataFrame([(1, 7, "fact", "likes alpha", 0.9, "active", t, [1.0, 1.0], [1]), (2, 7, "fact", "liked alpha", 0.9, "superseded", t, [1.0, 1.0], [1]), (3, 7, "preference", "alpha too", 0.5, "active", t, None, None)], "memory_id bigint, user_id bigint, kind string, statement string, confidence double, status string, valid_from timestamp, embedding array<double>, topic_ids array<int>")
    return chunks_, documents, memories


def ask(spark, text, vector):
    return spark.createDataFrame([(1, 7, text, vector)], "query_id bigint, user_id bigint, query_text string, query_embedding array<double>")


def test_search_sees_only_what_a_user_may_see(spark):
    c, d, m = searchable(spark)
    q = ask(spark, "alpha", [1.0, 1.0])
    assert {r.document_id for r in search.match_chunks(q, c, d, 10).collect()} == {1, 3}
    assert [r.memory_id for r in search.match_memories(q, m, 10).collect()] == [1]
    assert {r.document_id for r in search.search_documents(q, d, 10).collect()} == {1, 3}
    assert {r.id for r in search.hybrid_search(q, c, d, m, 10).collect()} == {"d10", "d30", "m1", "m3"}
    assert {r.id for r in search.hybrid_search(q, c, d, m, 10, kinds=["fact"], topics=[1]).collect()} == {"d10", "m1"}
    assert {r.id for r in search.hybrid_search(q, c, d, m, 10, include_documents=False).collect()} == {"m1", "m3"}
    only_text = search.hybrid_search(ask(spark, "alpha", None), c, d, m, 10).collect()
    assert {r.id for r in only_text} == {"d10", "d30", "m1", "m3"} and all(r.vector_score is None for r in only_text)
    assert {r.document_id for r in search.search_documents_hybrid(ask(spark, None, [1.0, 1.0]), c, d, 10).collect()} == {1, 3}
    left, degraded = search.of_model(c.withColumn("embedding_model", F.when(F.col("chunk_id") > 10, "m2").otherwise("m1")), "m1")
    assert left.count() == 1 and degraded.first().degraded
    search.create_views(spark, c, d, m)
    assert spark.sql("select count(*) as n from active_memories").first().n == 2


@pytest.mark.parametrize(("text", "found"), [("alpha beta", {1, 3}), ('"alpha beta"', {1}), ("alpha -delta", {1}), ("gamma or delta", {1, 3}), ("gamma delta", set()), ("-alpha", set()), ("", set()), (None, set())])
def test_websearch(spark, text, found):
    _, d, _ = searchable(spark)
    assert {r.document_id for r in search.search_websearch(ask(spark, text, None), d, 10).collect()} == found


def test_wire_verdicts(spark):
    good = {"id": "0b5c1f9e-1111-2222-3333-444455556666", "deviceId": "d", "batch_device": "d", "type": "copy", "occurredAt": "2024-01-01T00:00:00.5Z", "importance": 0.5, "dedupeKey": "k" * 8, "domain": None, "metadata": "{}", "payload": "{}"}
    cases = [({}, None), ({"id": "7"}, "id"), ({"type": "x"}, "type"), ({"deviceId": "e"}, "deviceId"), ({"occurredAt": "yesterday"}, "occurredAt"), ({"importance": 2.0}, "importance"), ({"dedupeKey": "k"}, "dedupeKey"), ({"metadata": "[]"}, "metadata")]
    cases += [({"type": "page_view"}, "domain"), ({"type": "page_view", "domain": "x"}, "duration"), ({"type": "page_view", "domain": "x", "payload": '{"durationMs":5}'}, None), ({"type": "app_session", "payload": '{"durationSeconds":-1}'}, "duration")]
    schema = "id string, deviceId string, batch_device string, type string, occurredAt string, importance double, dedupeKey string, domain string, metadata string, payload string"
    rows = ingest.wire_verdict(spark.createDataFrame([tuple((good | c)[f.split()[0]] for f in schema.split(", ")) for c, _ in cases], schema)).collect()
    assert [r.reason for r in rows] == [reason for _, reason in cases]


def test_capture_and_floor(spark):
    rows = spark.createDataFrame([("https://a.org/x", None), (None, "body"), (None, None), ("x", None), (None, "")], "url string, body_text string")
    assert [r.reason for r in ingest.capture_verdict(rows).collect()] == [None, None, "url_or_body", "url", "body"]
    said = spark.createDataFrame([("copy", "x" * 39), ("copy", "x" * 40), ("search", "x"), ("selection", None)], "type string, text string")
    assert [r.k for r in said.select(ingest.text_floor(F.col("type"), F.col("text")).alias("k")).collect()] == [False, True, True, False]


def test_near_statements_in_slices(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(memory, "SLICE", 7)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 8))
    rows = [(i, i % 2, f"h{i if i % 9 else 0}", (base[i % 6] + rng.standard_normal(8) * 0.3).tolist() if i % 11 else None) for i in range(60)]
    held = spark.createDataFrame(rows, "memory_id bigint, user_id bigint, statement_hash string, embedding array<double>")
    expected = {}
    for i, u, h, v in rows:
        same = [j for j, w, g, _ in rows if j < i and w == u and g == h]
        near = sorted((-round(float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)), 9), j) for j, w, _, x in rows if j < i and w == u and x and v)
        if same:
            expected[i] = (min(same), "duplicate")
        elif near and -near[0][0] >= 0.8:
            expected[i] = (near[0][1], "duplicate" if -near[0][0] >= 0.9 else "candidate")
    assert {r.memory_id: (r.match_id, r.relation) for r in memory.near_duplicates(held, held).collect()} == expected


def test_pages_cleaning_and_strategies(spark):
    html = "<html lang=\"en\"><head><title> T </title><style>x</style></head><body><!-- no --><h1>A &amp;amp; B</h1><p>one<br>two &#233;&#x20AC;&nbsp;x</p><script>var a='<p>';</script>5 < 6</body>"
    row = corpus.extract_pages(spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id bigint, url string, html string")).orderBy("page_id").collect()
    assert row[0].text == "T A &amp; B\n\none\ntwo é€ x\n\n5 < 6".replace("T A", "T \n\nA").replace(" \n", "\n")
    assert (row[0].title, row[0].lang, row[0].status, row[1].text) == ("T", "en", "failed", "")
    body = "\n".join(["Home", "About", "Contact", "A real sentence of the text.", "Subscribe to our newsletter", *["The same caption of a photo"] * 5, "Another real sentence.", "e\u0301nd\u200b of it.", "\x07Bell.", "Terms", "Privacy", "Imprint"])
    out = corpus.clean_documents(spark.createDataFrame([(1, body), (2, ""), (3, None)], "document_id bigint, extracted_text string")).orderBy("document_id").collect()
    assert out[0].text == "A real sentence of the text.\nSubscribe to our newsletter\nThe same caption of a photo\nAnother real sentence.\nénd of it.\nBell." and 0 < out[0].removed_ratio < 1
    assert [(r.text, r.removed_ratio) for r in out[1:]] == [("", 0.0), ("", 0.0)]
    drift = corpus.cleaning_drift(spark.createDataFrame([(0.0,), (0.5,)], "removed_ratio double")).first()
    assert (drift.documents, drift.mean_ratio) == (2, 0.25)
    docs = spark.createDataFrame([(1, "word " * 400)], "document_id bigint, t string")
    fixed = corpus.chunk_documents("fixed", docs, "document_id", "t").orderBy("ordinal").collect()
    assert len(fixed) == 3 and fixed[1].chunk.startswith("word word") and len(fixed[1].chunk) <= 800 and fixed[0].chunk == ("word " * 400)[:679].strip()
    with pytest.raises(ValueError, match="unknown"):
        corpus.chunk_documents("other", docs, "document_id", "t")
    with pytest.raises(ValueError, match="vector"):
        corpus.chunk_documents("semantic", docs)
    said = spark.createDataFrame([(1, i, "s" * 30, i) for i in range(4)], "document_id bigint, pos int, text string, chunk_no int")
    assert [len(r.chunk) for r in corpus.merge_chunks(said, size=65).orderBy("ordinal").collect()] == [61, 61]


def test_last_keys(spark):
    t = datetime.datetime(2024, 1, 1)
    seq = [(1, "a"), (1, "b"), (1, "a"), (1, "c"), (1, "b"), (1, "a"), (2, "a"), (2, "a"), (1, "a")]
    e = spark.createDataFrame([(i, d, k, t + datetime.timedelta(seconds=i)) for i, (d, k) in enumerate(seq)], "event_id bigint, device_id bigint, dedupe_key string, occurred_at timestamp")
    assert sorted(r.event_id for r in rollups.suppress_last_keys(e, 2).collect()) == [0, 1, 3, 4, 5, 6]
    assert sorted(r.event_id for r in rollups.suppress_last_keys(e).collect()) == [0, 1, 3, 6]
    assert rollups.suppress_last_keys(e, 0).count() == len(seq)


def test_overrides_leave_other_users_the_defaults(spark):
    e = spark.createDataFrame([(i, u, *[180.0 if s == "dwell_seconds" else 0.0 for s in importance.SIGNALS]) for i, u in enumerate([1, 2, None])], "event_id bigint, user_id bigint, " + ", ".join(f"{s} double" for s in importance.SIGNALS))
    o = spark.createDataFrame([(1, "rule.dwell", 0.5, None)], "user_id bigint, rule string, weight double, enabled boolean")
    got = importance.server_score_by_rules(e, importance.override_rules(importance.rules_frame(spark), o)).collect()
    assert {r.event_id: r.score for r in got} == {0: 0.5, 1: 0.16, 2: 0.16}


def test_remaining_small_operators(spark):
    c = spark.createDataFrame([(1, 5, 0, None, None), (2, 5, 1, [1.0], "m1"), (3, 6, 0, [1.0], "m2")], "chunk_id bigint, document_id bigint, ordinal int, embedding array<double>, embedding_model string")
    assert sorted(r.chunk_id for r in ingest.stale_vectors(c, "m1").collect()) == [1, 3]
    new = spark.createDataFrame([(1, [2.0], "m1")], "chunk_id bigint, embedding array<double>, embedding_model string")
    assert {r.chunk_id: r.embedding_model for r in ingest.attach_vectors(c, new).collect()} == {1: "m1", 2: "m1", 3: "m2"}
    fresh = c.where("document_id = 5 and ordinal = 0")
    assert sorted(r.chunk_id for r in ingest.replace_chunks(c, fresh).collect()) == [1, 3]
    e = spark.createDataFrame([('{"type":"copy","x":"1"}', "app.a"), ("{}", "app.b"), (None, None)], "json string, package string")
    assert [r.payload for r in ingest.split_payload(e, "json", ["type"]).collect()] == [{"x": "1"}, {}, None]
    assert [r.package for r in ingest.exclude_apps(e, spark.createDataFrame([("app.a",)], "package string")).collect()] == ["app.b", None]
    topics = spark.createDataFrame([(1, 7, "tech", None), (2, 7, "sql", "tech"), (3, 8, "sql", "tech")], "topic_id bigint, user_id bigint, slug string, parent_slug string")
    assert {r.topic_id: r.parent_id for r in lifecycle.topic_parents(topics).collect()} == {1: None, 2: 1, 3: None}
    memories = spark.createDataFrame([(1, "s1", [1, 2]), (2, "s2", None)], "memory_id bigint, statement string, topic_ids array<int>")
    sources = spark.createDataFrame([(1, 2, "frozen"), (1, 99, "gone")], "memory_id bigint, chunk_id bigint, excerpt string")
    docs = spark.createDataFrame([(5, "Title", "u")], "document_id bigint, title string, url string")
    got = memory.provenance(memories, sources, c, docs).collect()
    assert sorted((r.memory_id, str(r.excerpt), str(r.document_title)) for r in got) == [(1, "frozen", "Title"), (1, "gone", "None"), (2, "None", "None")]
    links, held, counted = rollups.merge_topics_everywhere(spark.createDataFrame([(1, 1), (1, 2)], "document_id bigint, topic_id int"), memories, spark.createDataFrame([(1,), (2,), (3,)], "topic_id int"), spark.createDataFrame([(1, 2)], "from_id int, to_id int"))
    assert sorted(map(tuple, links.collect())) == [(1, 2)] and {r.memory_id: r.topic_ids for r in held.collect()} == {1: [2], 2: None}
    assert {r.topic_id: (r.documents, r.memories) for r in counted.collect()} == {2: (1, 1), 3: (0, 0)}
    rewritten = memory.rewrite(memories, spark.createDataFrame([(1, "merged")], "memory_id bigint, merged_statement string"))
    assert {r.memory_id: r.statement for r in rewritten.collect()} == {1: "merged", 2: "s2"}
    ticks = spark.createDataFrame([(1, "v", 3.0, 0.1), (1, "v", 4.0, 0.3), (1, "w", 1.0, 0.9)], "user_id bigint, video_id string, seconds double, pct double")
    assert [tuple(r) for r in corpus.watch_progress(ticks).collect()] == [(1, "v", 7.0, 0.3)]

    @F.pandas_udf("double")
    def longest(q: pd.Series, t: pd.Series) -> pd.Series:
        return t.str.len().astype(float)

    hits = spark.createDataFrame([(1, 10, 1, "q", "short"), (1, 11, 2, "q", "much longer"), (2, 10, 1, "q", "short"), (2, 11, 2, "q", "much longer")], "query_id bigint, chunk_id bigint, rank int, q string, t string")
    assert [r.chunk_id for r in retrieval.rerank_with(hits.where("query_id = 1"), longest, "q", "t", "chunk_id").orderBy("rerank").collect()] == [11, 10]
    scores = hits.select("query_id", "chunk_id", F.col("rank").cast("double").alias("relevance"))
    kept = retrieval.rerank(hits, scores, "chunk_id", exact=spark.createDataFrame([(2,)], "query_id bigint")).orderBy("query_id", "rerank").collect()
    assert [r.chunk_id for r in kept] == [11, 10, 10, 11]

    @F.pandas_udf("string")
    def related(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["contradictory"] * len(a))

    pair = spark.createDataFrame([("a", "b", 4)], "l string, r string, match_id int")
    assert memory.adjudicate_with(pair, related, "l", "r").first().decision == "supersede"
    assert [r.s for r in spark.createDataFrame([(0.2,), (1.5,), (None,)], "d double").select(retrieval.similarity_from_distance(F.col("d")).alias("s")).collect()] == [0.8, 0.0, 0.0]
    cited = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "query_id bigint, citation int")
    context = spark.createDataFrame([(1, 1), (2, 1)], "query_id bigint, citation int")
    assert {r.query_id: r.sound for r in retrieval.citation_integrity(cited, context).collect()} == {1: False, 2: True}
    one = spark.createDataFrame([(1, None), (None, 1), (1, 1), (None, None)], "document_id int, memory_id int")
    assert retrieval.one_source(one).count() == 2


def test_merge_decisions(spark):
    rows = spark.createDataFrame([(None, None), (1, "duplicate"), (1, "complementary"), (1, "contradictory"), (1, "unrelated")], "match_id int, relation string")
    assert [r.d for r in rows.select(memory.merge_decision(F.col("relation"), F.col("match_id")).alias("d")).collect()] == ["insert", "reject", "merge", "supersede", "insert"]


def test_supersede_closes_the_old_statement(spark):
    t = datetime.datetime(2024, 1, 1)
    schema = "memory_id bigint, statement string, valid_from timestamp, valid_to timestamp, superseded_by bigint, status string"
    stored = spark.createDataFrame([(1, "a", t, None, None, "active"), (2, "b", t, None, None, "active")], schema)
    new = spark.createDataFrame([(3, "c", t + datetime.timedelta(1), None, None, "active", 1)], schema + ", replaces bigint")
    rows = {r.memory_id: r for r in memory.supersede(stored, new).collect()}
    assert rows[1].superseded_by == 3 and rows[1].status == "superseded" and rows[1].valid_to == rows[3].valid_from
    assert rows[2].status == rows[3].status == "active"


def test_admission(spark):
    c = spark.createDataFrame([(1, 5, "long enough", 0.9, 0.5, [0]), (2, 5, "long enough", 0.8, 0.5, [7]), (3, 5, "short", 0.9, 0.5, [0])], "candidate_id bigint, document_id bigint, statement string, confidence double, importance double, ordinals array<int>")
    assert [r.candidate_id for r in memory.admit(c, spark.createDataFrame([(5, 0)], "document_id bigint, ordinal int")).collect()] == [1]


def test_retention_override_only_shortens(spark):
    now = datetime.datetime(2024, 6, 1)
    e = spark.createDataFrame([(1, "low", now - datetime.timedelta(50)), (1, "high", now - datetime.timedelta(5000)), (2, "low", now - datetime.timedelta(50)), (2, "noise", now)], "user_id bigint, band string, occurred_at timestamp")
    own = spark.createDataFrame([(1, "low", 10), (2, "low", 1000)], "user_id bigint, band string, keep_days int")
    kept = lifecycle.retained(e, F.lit(now), own).select("user_id", "band").collect()
    assert sorted(map(tuple, kept)) == [(1, "high"), (2, "low")]


def test_category_rules(spark):
    d = spark.createDataFrame([(1, "export.arxiv.org", None, "x"), (2, "x.org", None, "A Kubernetes api"), (3, "nytimes.com", None, ""), (4, None, ["travel"], None), (5, None, None, "interest rate")], "document_id bigint, host string, topics array<string>, title string")
    rows = {r.document_id: (r.category, r.matched_by) for r in lifecycle.route_categories(d, lifecycle.category_rules(spark)).collect()}
    assert rows == {1: ("research", "host:arxiv.org"), 2: ("engineering", "keyword:api"), 3: ("unclassified", "fallback"), 4: ("unclassified", "fallback"), 5: ("finance", "keyword:interest rate")}


def test_app_sessions(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, 1, "a", 0), (1, 2, "a", 4), (1, 3, "b", 10), (1, 4, None, 12), (1, 5, "a", 20), (1, 6, "a", 30)]
    c = spark.createDataFrame([(d, e, p, t + datetime.timedelta(seconds=s)) for d, e, p, s in rows], "device_id bigint, event_id bigint, package string, occurred_at timestamp")
    assert sorted((r.package, r.seconds) for r in sessions.app_sessions(c).collect()) == [("a", 10), ("a", 10)]


def test_transcripts(spark):
    s = spark.createDataFrame([(1, 0.0, "hi"), (1, 1.0, "hi"), (1, 130.0, "you"), (2, 5.0, "x")], "video_id bigint, start double, text string")
    assert sorted(map(tuple, corpus.flatten_transcript(s).collect())) == [(1, "hi you"), (2, "x")]
    assert [len(r.text) for r in corpus.group_transcript(s.where("video_id = 1"), most=3).collect()] == [2, 2, 3]
    assert sorted(map(tuple, corpus.group_transcript(s).collect())) == [(1, 0.0, "hi hi"), (1, 130.0, "you"), (2, 5.0, "x")]


def test_nfc(spark):
    df = spark.createDataFrame([("é​",), ("plain",), (None,)], "t string")
    assert sorted(str(r.t) for r in corpus.normalise_unicode(df, "t").collect()) == ["None", "plain", "é"]


def test_semantic_chunks(spark):
    s = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.1]), (1, 2, [0.0, 1.0]), (1, 3, [0.1, 1.0])], "document_id bigint, pos int, vector array<double>")
    assert [r.chunk_no for r in corpus.semantic_chunks(s).orderBy("pos").collect()] == [0, 0, 1, 1]


def test_topic_merge_and_bump(spark):
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "document_id bigint, topic_id bigint")
    moved = rollups.merge_topics(links, spark.createDataFrame([(1, 2)], "from_id bigint, to_id bigint"))
    assert sorted(map(tuple, moved.collect())) == [(1, 2), (2, 2)]


def test_embedder_is_deterministic(spark):
    df = spark.createDataFrame([("a b",), ("a b",), (None,)], "t string")
    rows = [r.embedding for r in retrieval.embed_with(df, retrieval.hashing_embedder(8), "t", 8).collect()]
    assert rows[0] == rows[1] and len(rows[2]) == 8


@pytest.mark.parametrize("unit", ["<!-- x ", "<script> x ", "<p>a</p> ", "-- > </script <script ", "<!-- a --> <b>", "<title>"])
def test_pages_take_linear_time(spark, unit):
    import time

    page = spark.range(1).select(F.lit(1).alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit(unit), 2_000_000 // len(unit)).alias("html"))
    began = time.perf_counter()
    assert corpus.extract_pages(page).first().url == "u"
    assert time.perf_counter() - began < 30  # minutes where each opener looks for its end


def test_openers_without_an_end_hide_nothing(spark):
    pages = ["a<!-- b <p>c", "a<!-- b -->c<!-- d", "<script>x</script>y<script>z", "<style>a<!--</style>b-->c", "<!-- <script> -->a</script>b", "a<noscript>b</noscript ><template>c"]
    got = [r.t for r in spark.createDataFrame(list(enumerate(pages)), "i int, html string").orderBy("i").select(corpus.page_text(F.col("html")).alias("t")).collect()]
    assert got == ["a<!-- b\n\nc", "ac<!-- d", "yz", "b-->c", "ab", "ac"]


def test_long_texts_are_cut_in_linear_time(spark):
    import time

    text = spark.range(1).select("id", F.repeat(F.lit("wörd and 😀 "), 400_000).alias("t"))
    began = time.perf_counter()
    rows = corpus.fixed_chunks(text, "id", "t").agg(F.count("*").alias("n"), F.max(F.length("chunk")).alias("longest")).first()
    assert (rows.n, rows.longest <= 800) == (-(-400_000 * 11 // 679), True) and time.perf_counter() - began < 20


def test_lines_of_a_site_go(spark, monkeypatch):
    own = lambda i: f"This is what text {i} has to say, and it takes a while to say it."
    texts = [(i, "a.org", f"{own(i)}\nSign up for our letters today!\nA sentence of {i % 3} texts.\nSee [one](http://x.y/z) and https://b.c/d") for i in range(40)]
    texts += [(100 + i, "b.org", f"{own(100 + i)}\nSign up for our letters today!") for i in range(4)]  # too few texts
    texts += [(200 + i, "c.org", own(200) + "\nSame in all copies." + (" More." if i % 2 else "")) for i in range(30)]  # copies are one text
    texts += [(300, None, "alone"), (301, "a.org", None), (302, "a.org", "")]
    frame = spark.createDataFrame(texts, "document_id bigint, source string, extracted_text string").repartition(4)
    for sites in (corpus.BROADCAST_SITES, 0):
        monkeypatch.setattr(corpus, "BROADCAST_SITES", sites)
        got = {r.document_id: r.text for r in corpus.clean_documents(frame, site="source").collect()}
        assert all(got[i] == own(i) for i in range(40))  # a third of a site's texts have each of the three sentences
        assert all(got[100 + i] == f"{own(100 + i)}\nSign up for our letters today!" for i in range(4))
        assert all(got[200 + i].startswith(own(200) + "\nSame in all copies.") for i in range(30))
        assert (got[300], got[301], got[302]) == ("alone", "", "")
    kept = {r.document_id: r.text for r in corpus.clean_documents(frame).collect()}
    assert kept[0] == f"{own(0)}\nSign up for our letters today!\nA sentence of 0 texts."
