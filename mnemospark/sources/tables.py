"""Parquet tables and the views over them that the activity operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions.columns import content_hash, squeeze, truncate, word_count


#: Tables whose rows take long to work on, and tasks of a file up to which they are dealt to all cores.
TEXT_TABLES, SMALL_TASKS = ("documents", "pages"), 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. A small file of texts is dealt to all cores, as a row group is one task however long its texts take;
    a file of over SMALL_TASKS tasks, which have spark.sql.files.maxPartitionBytes each, is left as it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_TABLES and df.rdd.getNumPartitions() < min(cores, SMALL_TASKS + 1):
        return df.repartition(cores)
    return df


#: What each event type of the raw table stands for.
EVENT_TYPES = {"view": "page_view", "click": "copy", "purchase": "bookmark", "signup": "download", "error": "app_session"}
#: Domains that the raw events are dealt to.
DOMAINS = 12


def activity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity events: one row per raw event, times in UTC, url and domain derived from the event's key."""
    raw = read(spark, sf_dir, "events")
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in EVENT_TYPES.items() for x in pair])[F.col("event_type")], F.col("event_type"))
    rows = raw.select(
        "event_id",
        "user_id",
        (F.col("user_id") * 10 + F.col("event_id") % 3).alias("device_id"),
        kind.alias("type"),
        F.col("ts").alias("occurred_at"),
        F.col("ts").alias("received_at"),
        F.floor(F.col("value") + 0.5).cast("bigint").alias("duration_seconds"),
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        "props",
    )
    rows = rows.withColumn("domain", F.concat(F.lit("site"), (F.col("k") % DOMAINS).cast("string"), F.lit(".example.com")))
    rows = rows.withColumn("url", F.concat(F.lit("https://"), "domain", F.lit("/p/"), F.col("k").cast("string")))
    minute = F.floor(F.unix_micros(F.col("occurred_at").cast("timestamp")) / 60_000_000)
    return rows.withColumn("dedupe_key", F.concat_ws(":", "type", minute.cast("string"), F.md5(F.col("url").cast("binary"))))


EPOCH = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
USERS = 150


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured documents: one row per text, captured a minute apart."""
    raw = read(spark, sf_dir, "documents")
    return raw.select(
        F.col("doc_id").alias("document_id"),
        (F.col("doc_id") % USERS).alias("user_id"),
        "source",
        "lang",
        F.col("text").alias("extracted_text"),
        content_hash(F.col("text")).alias("content_hash"),
        word_count(F.col("text")).alias("word_count"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/d/"), (F.col("doc_id") % 997).cast("string")).alias("url"),
        F.expr(f"{EPOCH} + make_dt_interval(0, 0, cast(doc_id as int), 0)").alias("captured_at"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with vectors: five to a document, the label as topic."""
    raw = read(spark, sf_dir, "embeddings")
    return raw.select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 5).alias("document_id"), F.col("label").alias("topic"), "embedding", F.lit("m1").alias("embedding_model"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements: what users say in conversations, valid from the conversation's day and the turn's hour."""
    raw = read(spark, sf_dir, "conversations").where("role = 'user'")
    return raw.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("memory_id"),
        "conv_id",
        (F.col("conv_id") % USERS).alias("user_id"),
        F.when(F.col("turn") % 2 == 0, "fact").otherwise("preference").alias("kind"),
        F.col("text").alias("statement"),
        F.expr(f"{EPOCH} + make_dt_interval(cast(conv_id as int), cast(turn as int), 0, 0)").alias("valid_from"),
        (F.col("turn") % 4).alias("access_count"),
    )


#: Users that the retrieval views are dealt to: few, so that each has many rows. Characters of a passage, and passages that a document may have.
TENANTS, PASSAGE_CHARS, MOST_PASSAGES = 10, 800, 1_000_000


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(__v, embedding, topic) and how many there are: texts are dealt the vectors by number, as often as it takes."""
    raw = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("__v"), "embedding", F.col("label").alias("topic"))
    return raw, max(1, raw.count())


def recall_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as retrieval sees them: owner, title, soft deletes, extraction status and the topics of their passages."""
    topics = chunks(spark, sf_dir).where("topic is not null").groupBy("document_id").agg(F.array_sort(F.collect_set("topic")).alias("topic_ids"))
    raw = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"),
        (F.col("doc_id") % TENANTS).alias("user_id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/d/"), F.col("doc_id").cast("string")).alias("url"),
        truncate(squeeze(F.col("text")), 40).alias("title"),
        word_count(F.col("text")).alias("word_count"),
        F.expr(f"{EPOCH} + make_dt_interval(0, 0, cast(doc_id % 500 as int), 0)").alias("captured_at"),
        F.expr(f"CASE WHEN doc_id % 50 = 49 THEN {EPOCH} END").alias("deleted_at"),
        F.when(F.col("doc_id") % 37 == 0, "failed").otherwise("succeeded").alias("extraction_status"),
        F.col("text").alias("extracted_text"),
    )
    return raw.join(topics, "document_id", "left")


def recall_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the whole text of every document, with owner and vector; a document without text has none."""
    vectors, many = _vectors(spark, sf_dir)
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{PASSAGE_CHARS}}}"), F.lit(0))).alias("ordinal", "text"))
    rows = texts.select((F.col("document_id") * MOST_PASSAGES + F.col("ordinal")).alias("chunk_id"), "document_id", (F.col("document_id") % TENANTS).alias("user_id"), F.col("ordinal").cast("bigint").alias("ordinal"), "text", ((F.col("document_id") * 5 + F.col("ordinal")) % many).alias("__v"))
    return rows.join(vectors, "__v", "left").drop("__v")


def recall_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with owner, status (a later statement of a conversation supersedes), vector and topics."""
    later = Window.partitionBy("conv_id").orderBy("valid_from", "memory_id")
    rows = memories(spark, sf_dir).withColumn("user_id", F.col("conv_id") % TENANTS).withColumn("status", F.when(F.lead("memory_id").over(later).isNull(), "active").otherwise("superseded"))
    vectors, many = _vectors(spark, sf_dir)
    vectors = vectors.select("__v", "embedding", F.when(F.col("topic").isNotNull(), F.array("topic")).alias("topic_ids"))
    rows = rows.withColumn("__v", (F.col("conv_id") * 10 + F.col("memory_id") % 1000) % many).join(vectors, "__v", "left").drop("__v")
    return rows.withColumn("confidence", (F.col("memory_id") % 10).cast("double") / 10).withColumn("statement_hash", content_hash(F.col("statement")))


def recall_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every statement whose id is divisible by 100, asked by its owner, with its text and vector."""
    asked = recall_memories(spark, sf_dir).where("memory_id % 100 = 0")
    return asked.select(F.col("memory_id").alias("query_id"), "user_id", F.col("statement").alias("query_text"), F.col("embedding").alias("query_embedding"))
