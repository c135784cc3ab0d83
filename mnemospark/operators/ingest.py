"""Batch ingest: envelopes, verdicts, clock policy, deduplicated appends and upserts, accounting."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.functions.columns import BANDS, canonical_url, domain_of

# Event types and document sources.
EVENT_TYPES = ("page_view", "page_read", "selection", "copy", "youtube_watch", "app_session", "search", "bookmark", "download")
EXPLICIT_TYPES = ("selection", "copy", "search", "bookmark", "download")
DURATION_TYPES = ("page_view", "app_session", "youtube_watch")
DOMAIN_TYPES = ("page_view", "page_read")
BATCH_EVENTS, BATCH_DOCUMENTS, SCHEMA_VERSION = 100, 5, 1
DOCUMENT_CHARS = (200, 500_000)
DOCUMENT_SOURCES = ("web", "youtube", "pdf", "gdoc", "newsletter", "manual")

_EVENT = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "deviceId", "type", "occurredAt", "dedupeKey", "url", "title", "domain", "payload")] + [T.StructField("importance", T.DoubleType())])
_DOCUMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "title", "source", "text", "contentHash", "capturedAt")] + [T.StructField("wordCount", T.LongType())])
ENVELOPE = T.StructType(
    [T.StructField("schemaVersion", T.IntegerType()), T.StructField("deviceId", T.StringType()), T.StructField("clientSentAt", T.StringType()), T.StructField("events", T.ArrayType(_EVENT)), T.StructField("documents", T.ArrayType(_DOCUMENT))]
)


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENVELOPE).json(path)


def envelope_verdict(batches: DataFrame) -> DataFrame:
    """Adds ``reason``: why a batch as a whole is refused, null where it is not."""
    events, documents = F.coalesce(F.size("events"), F.lit(0)), F.coalesce(F.size("documents"), F.lit(0))
    events, documents = F.greatest(events, F.lit(0)), F.greatest(documents, F.lit(0))
    foreign = F.exists(F.coalesce("events", F.array().cast(T.ArrayType(_EVENT))), lambda e: ~e["deviceId"].eqNullSafe(F.col("deviceId")))
    reason = (
        F.when(~F.col("schemaVersion").eqNullSafe(F.lit(SCHEMA_VERSION)), "schema_version")
        .when(events > BATCH_EVENTS, "too_many_events")
        .when(documents > BATCH_DOCUMENTS, "too_many_documents")
        .when((events == 0) & (documents == 0), "empty_batch")
        .when(foreign, "device_mismatch")
    )
    return batches.withColumn("reason", reason)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row breaks; a rule that is null counts as broken."""
    out = None
    for name, holds in rules:
        broken = ~F.coalesce(holds, F.lit(False))
        out = F.when(broken, name) if out is None else out.when(broken, name)
    return out


def event_verdict(events: DataFrame) -> DataFrame:
    """Adds ``reason``, null for a valid event: columns event_id, type, occurred_at, importance, dedupe_key, domain, duration_seconds."""
    return events.withColumn(
        "reason",
        first_reason(
            [
                ("event_id", F.col("event_id").isNotNull()),
                ("type", F.col("type").isin(*EVENT_TYPES)),
                ("occurred_at", F.col("occurred_at").isNotNull()),
                ("importance", F.col("importance").between(0, 1)),
                ("dedupe_key", F.length("dedupe_key").between(8, 128)),
                ("domain", ~F.col("type").isin(*DOMAIN_TYPES) | (F.length("domain") > 0)),
                ("duration", ~F.col("type").isin(*DURATION_TYPES) | (F.col("duration_seconds") >= 0)),
            ]
        ),
    )


# Forms of ids, times and digests on the wire.
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ISO_TIME = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
VIDEO_ID = "^[A-Za-z0-9_-]{6,64}$"
DIGEST = "^([a-zA-Z0-9]+:)?[0-9a-fA-F]{16,}$"


def wire_verdict(events: DataFrame, batch_device: str = "batch_device") -> DataFrame:
    """Adds ``reason``, null for a valid event of an envelope: the envelope's event fields as columns, and the batch's device.

    ``metadata`` and ``payload`` are JSON texts. The first rule that is broken names the reason.
    """
    needs = lambda types: F.col("type").isin(*types)
    number = F.when(F.col("type") == "page_view", F.get_json_object("payload", "$.durationMs")).otherwise(F.get_json_object("payload", "$.durationSeconds"))
    return events.withColumn(
        "reason",
        first_reason(
            [
                ("id", F.col("id").rlike(UUID)),
                ("type", F.col("type").isin(*EVENT_TYPES)),
                ("deviceId", F.col("deviceId") == F.col(batch_device)),
                ("occurredAt", F.col("occurredAt").rlike(ISO_TIME) & F.try_to_timestamp("occurredAt").isNotNull()),
                ("importance", F.col("importance").between(0, 1)),
                ("dedupeKey", F.length("dedupeKey").between(8, 128)),
                ("metadata", F.ltrim(F.coalesce("metadata", F.lit("{}"))).startswith("{")),
                ("domain", ~needs(DOMAIN_TYPES) | F.col("domain").isNotNull()),
                ("duration", ~needs(DURATION_TYPES) | (number.try_cast("double") >= 0)),
            ]
        ),
    )


_TEXT, _CONTEXT = "length(v) between 1 and 20000", "length(v) <= 500"
_COUNT, _URL = "try_cast(v as bigint) >= 0", "length(try_parse_url(v, 'HOST')) > 0"
# Per event type, the payload fields that it needs and the rule each must keep.
PAYLOAD_RULES = {
    "page_view": {"domain": "length(v) between 1 and 253", "durationMs": _COUNT, "scrollDepthPct": "try_cast(v as double) between 0 and 100"},
    "page_read": {"domain": "length(v) between 1 and 253", "wordCount": _COUNT, "readingTimeSeconds": _COUNT, "contentHash": f"length(v) between 16 and 128 and v rlike '{DIGEST}'"},
    "selection": {"text": _TEXT, "contextBefore": _CONTEXT, "contextAfter": _CONTEXT, "selectionLength": "try_cast(v as bigint) between 1 and 20000"},
    "copy": {"text": _TEXT, "selectionLength": "try_cast(v as bigint) between 1 and 20000"},
    "youtube_watch": {"videoId": f"v rlike '{VIDEO_ID}'", "channelName": "v is null or length(v) <= 200", "watchedSeconds": _COUNT, "durationSeconds": f"v is null or {_COUNT}", "watchedPct": "try_cast(v as double) between 0 and 1", "transcriptAvailable": "v in ('true', 'false')"},
    "app_session": {"packageName": "length(v) between 1 and 255", "appLabel": "length(v) between 1 and 200", "startAt": f"v rlike '{ISO_TIME}'", "endAt": f"v rlike '{ISO_TIME}'", "durationSeconds": _COUNT, "isForeground": "v in ('true', 'false')"},
    "search": {"query": "length(v) between 1 and 500", "engine": "length(v) between 1 and 50"},
    "bookmark": {"url": _URL, "folder": "v is null or length(v) <= 200"},
    "download": {"url": _URL, "filename": "length(v) between 1 and 255", "mimeType": "v is null or length(v) <= 255", "bytes": f"v is null or {_COUNT}"},
}


def payload_verdict(events: DataFrame, type_: str = "type", payload: str = "payload") -> DataFrame:
    """Adds ``payload_reason``: the first field that the event's type needs and its JSON payload does not keep to.

    A payload is parsed once, to a variant; one that is no JSON has no fields.
    """
    events = events.withColumn("__parsed", F.try_parse_json(F.col(payload)))
    reason = F.lit(None).cast("string")
    for kind, fields in PAYLOAD_RULES.items():
        rules = [(name, F.expr(re.sub(r"\bv\b", lambda _, n=name: f"try_variant_get(__parsed, '$.{n}', 'string')", rule))) for name, rule in fields.items()]
        reason = F.when(F.col(type_) == kind, first_reason(rules)).otherwise(reason)
    return events.withColumn("payload_reason", reason).drop("__parsed")


def document_verdict(documents: DataFrame, sources: Sequence[str] = DOCUMENT_SOURCES) -> DataFrame:
    """Adds ``reason``, null for a valid document: columns url, extracted_text, source, word_count, captured_at."""
    return documents.withColumn(
        "reason",
        first_reason(
            [
                ("url", F.length("url") > 0),
                ("text", F.length("extracted_text").between(*DOCUMENT_CHARS)),
                ("source", F.col("source").isin(*sources)),
                ("word_count", F.col("word_count") >= 1),
                ("captured_at", F.col("captured_at").isNotNull()),
            ]
        ),
    )


def capture_verdict(documents: DataFrame, url: str = "url", body: str = "body_text") -> DataFrame:
    """Adds ``reason``: a capture carries a url to fetch or a body to accept; an absolute url, a body of 1 to 2 000 000 characters."""
    rules = [
        ("url_or_body", F.col(url).isNotNull() | F.col(body).isNotNull()),
        ("url", F.col(url).isNull() | (F.length(F.try_parse_url(F.col(url), F.lit("HOST"))) > 0)),
        ("body", F.col(body).isNull() | F.length(body).between(1, 2_000_000)),
    ]
    return documents.withColumn("reason", first_reason(rules))


def clamp_clock(events: DataFrame, now: Column, ts: str = "occurred_at") -> DataFrame:
    """Times over an hour ahead or over 90 days old become ``now``; ``clamped_from`` keeps the original, lag_ms the delay."""
    off = (F.col(ts) > now + F.expr("INTERVAL 1 HOUR")) | (F.col(ts) < now - F.expr("INTERVAL 90 DAYS"))
    out = events.withColumn("clamped_from", F.when(off, F.col(ts))).withColumn(ts, F.when(off, now).otherwise(F.col(ts)))
    return out.withColumn("lag_ms", F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col(ts).cast("timestamp")))


def promote_duration(type_: Column, value: Column) -> Column:
    """Whole seconds from milliseconds of page views and seconds of sessions and videos; null for other types."""
    return F.when(type_ == "page_view", F.floor(value / 1000 + 0.5)).when(type_.isin("app_session", "youtube_watch"), F.floor(value + 0.5)).cast("bigint")


def split_payload(events: DataFrame, json: str, base: list[str]) -> DataFrame:
    """Adds ``payload``: the fields of a JSON object that are no base columns."""
    return events.withColumn("payload", F.map_filter(F.from_json(json, "map<string,string>"), lambda k, _: ~k.isin(*base)))


def exclude_domains(events: DataFrame, excluded: DataFrame, domain: str = "domain") -> DataFrame:
    """Events whose host is none of the excluded domains (domain), nor below one; an unknown host is excluded.

    The distinct hosts are split into their suffixes and matched by equality; the events then meet only the hosts
    that are to go.
    """
    hosts = events.where(F.length(domain) > 0).select(F.col(domain).alias("__host")).distinct()
    parts = F.split(F.lower("__host"), "\\.")
    suffixes = hosts.select("__host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 1000), "."))).alias("__suffix"))
    gone = suffixes.join(excluded.select(F.lower("domain").alias("__suffix")).distinct(), "__suffix", "left_semi").select("__host").distinct()
    return events.where(F.length(domain) > 0).join(gone, F.col(domain) == F.col("__host"), "left_anti")


def exclude_apps(events: DataFrame, packages: DataFrame, package: str = "package") -> DataFrame:
    return events.join(packages.select(F.col("package").alias("__listed")), F.col(package) == F.col("__listed"), "left_anti")


def capture_gate(type_: Column, score: Column, least: float = 0.15) -> Column:
    """Explicit intent is always kept, anything else from the threshold on (a critical score is above any threshold)."""
    return type_.isin(*EXPLICIT_TYPES) | (score >= 0.9) | (score >= least)


def text_floor(type_: Column, text: Column, least: int = 40) -> Column:
    """Selections and copies of fewer characters are no events."""
    return ~type_.isin("selection", "copy") | F.coalesce(F.length(text) >= least, F.lit(False))


def distillation_gate(score: Column) -> Column:
    """What is at least of the normal band goes on to be distilled."""
    return F.coalesce(score >= BANDS["normal"], F.lit(False))


def rejected_in_batch(batch: DataFrame, rejected: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows of the batch that the server refused; refused keys of other batches touch nothing."""
    return batch.join(rejected.select(key).distinct(), key, "left_semi")


def document_by_url(documents: DataFrame, wanted: DataFrame, url: str = "url") -> DataFrame:
    """Documents whose canonical url is that of a wanted one (url), with it as canonical_url."""
    asked = wanted.select(canonical_url(F.col(url)).alias("canonical_url")).where("canonical_url is not null").distinct()
    return documents.withColumn("canonical_url", canonical_url(F.col(url))).join(asked, "canonical_url")


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def append_new(batch: DataFrame, stored: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows to append: the first of each key in the batch that is not stored yet. Sending a batch again appends nothing."""
    return keep_first(batch, keys, order).join(stored.select(*keys).distinct(), keys, "left_anti")


def existing_keys(batch: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return batch.select(*keys).distinct().join(stored.select(*keys), keys, "left_semi")


def upsert_documents(captures: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row per (user_id, content_hash): the first capture's identity and time, the latest url and title, last_seen_at.

    Captures: document_id, user_id, content_hash, url, captured_at, and title and deleted_at where there are any. A
    deletion is not undone by a new capture. Partial aggregation absorbs a hot hash.
    """
    more = [c for c in ("title", "deleted_at") if c in captures.columns]
    rows = captures.select("document_id", "user_id", "content_hash", "url", "captured_at", *more, F.col("captured_at").alias("last_seen_at"))
    if stored is not None:
        rows = rows.unionByName(stored.select(*rows.columns), allowMissingColumns=True)
    first, last = F.struct("captured_at", "document_id"), F.struct("last_seen_at", "document_id")
    extra = {"title": F.max_by("title", last).alias("title"), "deleted_at": F.max("deleted_at").alias("deleted_at")} if more else {}
    found = rows.groupBy("user_id", "content_hash").agg(F.min_by("document_id", first).alias("document_id"), F.min("captured_at").alias("captured_at"), F.max_by("url", last).alias("url"), F.max("last_seen_at").alias("last_seen_at"), F.count("*").alias("captures"), *[extra[c] for c in more])
    return found


def replace_chunks(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored chunks with all chunks of re-chunked documents replaced, so that no old tail stays."""
    return stored.join(fresh.select("document_id").distinct(), "document_id", "left_anti").unionByName(fresh)


def attach_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Write (chunk_id, embedding, embedding_model) into existing chunks."""
    new = vectors.select("chunk_id", F.col("embedding").alias("__e"), F.col("embedding_model").alias("__m"))
    return chunks.join(new, "chunk_id", "left").withColumn("embedding", F.coalesce("__e", "embedding")).withColumn("embedding_model", F.coalesce("__m", "embedding_model")).drop("__e", "__m")


def stale_vectors(chunks: DataFrame, model: str) -> DataFrame:
    """Chunks without a vector of the current model."""
    return chunks.where(F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model)))


def embedding_backlog(documents: DataFrame, chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Undeleted documents, whose extraction succeeded where that is known, without any chunk, oldest first."""
    ready = documents.where("extraction_status = 'succeeded'") if "extraction_status" in documents.columns else documents
    waiting = ready.where("deleted_at is null").join(chunks.select("document_id").distinct(), "document_id", "left_anti").orderBy("captured_at", "document_id")
    return waiting if limit is None else waiting.limit(limit)


def batch_accounting(rows: DataFrame, batch: str, verdict: str) -> DataFrame:
    """Per batch: accepted, duplicate and rejected rows, and whether they add up to all."""
    kinds = ("accepted", "duplicate", "rejected")
    out = rows.groupBy(batch).agg(F.count("*").alias("total"), *[F.count_if(F.col(verdict) == k).alias(k) for k in kinds])
    return out.withColumn("balanced", sum((F.col(k) for k in kinds), F.lit(0)) == F.col("total"))


def server_cursor(events: DataFrame) -> DataFrame:
    """Per device: the last (received_at, event_id)."""
    last = F.max(F.struct("received_at", "event_id")).alias("last")
    return events.groupBy("device_id").agg(last).select("device_id", "last.received_at", "last.event_id")


def assign_batches(events: DataFrame, size: int = BATCH_EVENTS) -> DataFrame:
    """Adds ``batch_no``: per device oldest first, ``size`` to a batch."""
    w = Window.partitionBy("device_id").orderBy("occurred_at", "event_id")
    return events.withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / size))


def batch_keys(events: DataFrame) -> DataFrame:
    """Per device and batch: an idempotency key from the sorted ids; a batch has a bounded size."""
    ids = F.array_sort(F.collect_list(F.col("event_id")))
    return events.groupBy("device_id", "batch_no").agg(F.count("*").alias("events"), F.sha2(F.concat(F.col("device_id").cast("string"), F.lit(":"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")).cast("binary"), 256).alias("batch_key"))


def quarantine(rows: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with their reason)."""
    return rows.where(F.col(reason).isNull()).drop(reason), rows.where(F.col(reason).isNotNull())


def with_domain(rows: DataFrame, url: str = "url") -> DataFrame:
    return rows.withColumn("domain", domain_of(F.col(url)))
