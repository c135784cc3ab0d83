"""Retention, purges, exports, seeding, version stamps and category routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Days that events of a band are kept; null is for ever.
RETENTION = [("noise", 0), ("low", 90), ("normal", 365), ("high", None), ("critical", None)]
CATEGORY_LEAST, CATEGORY_DEFAULT = 0.55, "unclassified"
# Category rules in order, as (category, confidence, hosts, topics, keywords).
CATEGORY_RULES = [
    ("research", 0.8, ["arxiv.org", "acm.org", "ieee.org", "nature.com", "sciencedirect.com", "pubmed.ncbi.nlm.nih.gov"], ["research-methods", "literature-review"], ["et al", "abstract", "methodology", "sample size"]),
    ("engineering", 0.75, ["github.com", "gitlab.com", "news.ycombinator.com", "developer.mozilla.org", "stackoverflow.com"], ["software-engineering", "distributed-systems", "databases", "infrastructure"], ["api", "refactor", "architecture", "postgres", "kubernetes", "typescript", "sql"]),
    ("ai", 0.75, ["huggingface.co", "paperswithcode.com", "openai.com", "anthropic.com"], ["machine-learning", "language-models", "retrieval-augmented-generation", "embeddings"], ["llm", "embedding", "transformer", "fine-tuning", "inference", "prompt", "vector search"]),
    ("learning", 0.6, ["coursera.org", "udemy.com", "educative.io", "leetcode.com", "khanacademy.org"], ["courses", "tutorials"], ["tutorial", "course", "lesson", "walkthrough", "exercises", "chapter"]),
    ("writing", 0.55, ["substack.com", "medium.com", "ghost.io"], ["writing-craft", "newsletters"], ["essay", "draft", "editing", "newsletter", "outline", "prose"]),
    ("business", 0.65, ["bloomberg.com", "ft.com", "wsj.com", "hbr.org", "stratechery.com"], ["strategy", "markets", "operations"], ["revenue", "pricing", "competitor", "market", "strategy", "hiring", "acquisition"]),
    ("product", 0.6, ["producthunt.com", "linear.app", "notion.so"], ["product-management", "user-experience"], ["roadmap", "user research", "design system", "feature spec", "onboarding"]),
    ("finance", 0.65, ["fidelity.com", "vanguard.com", "investopedia.com", "morningstar.com"], ["personal-finance", "investing"], ["portfolio", "budget", "tax", "retirement", "interest rate", "insurance"]),
    ("health", 0.65, ["who.int", "mayoclinic.org", "strava.com", "nih.gov"], ["fitness", "nutrition", "mental-health"], ["training plan", "nutrition", "sleep", "symptom", "therapy", "workout"]),
    ("personal", 0.5, ["nytimes.com", "allrecipes.com", "tripadvisor.com", "booking.com"], ["travel", "recipes", "hobbies", "home-admin"], ["recipe", "itinerary", "holiday", "flight", "gift", "appointment"]),
]


def retention_policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RETENTION, "band string, keep_days int")


def retained(events: DataFrame, as_of: Column, overrides: DataFrame | None = None, band: str = "band") -> DataFrame:
    """Events that their band's retention keeps; a user's override (user_id, band, keep_days) may only shorten it."""
    policy = F.broadcast(retention_policy(events.sparkSession).withColumnRenamed("band", band))
    rows = events.join(policy, band, "left")
    if overrides is not None:
        mine = overrides.select("user_id", F.col("band").alias(band), F.col("keep_days").alias("__mine"))
        rows = rows.join(mine, ["user_id", band], "left").withColumn("keep_days", F.least("keep_days", "__mine")).drop("__mine")
    kept = F.col("keep_days").isNull() | ((F.col("keep_days") > 0) & (F.col("occurred_at") >= as_of - F.make_dt_interval(F.col("keep_days"))))
    return rows.where(kept).drop("keep_days")


def purge_documents(purged: DataFrame, children: dict[str, DataFrame], key: str = "document_id") -> dict[str, DataFrame]:
    """Every child table without the rows of purged documents; memories are no child and survive."""
    gone = purged.select(key).distinct()
    return {name: table.join(gone, key, "left_anti") for name, table in children.items()}


def export_manifest(tables: dict[str, DataFrame], user: str = "user_id") -> DataFrame:
    """(user, table_name, rows) over all tables that hold something of a user."""
    out = None
    for name, table in tables.items():
        part = table.groupBy(user).agg(F.count("*").alias("rows")).select(user, F.lit(name).alias("table_name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def seed_topics(users: DataFrame, seeds: DataFrame, stored: DataFrame) -> DataFrame:
    """Topics (user_id, slug, parent_slug) that users lack; ``seeds``: (slug, parent_slug), roots without a parent."""
    each = F.broadcast(seeds.withColumn("__all", F.lit(True)))  # the seeds have a fixed size
    wanted = users.select("user_id").distinct().withColumn("__all", F.lit(True)).join(each, "__all").drop("__all")
    return wanted.join(stored.select("user_id", "slug"), ["user_id", "slug"], "left_anti")


def topic_parents(topics: DataFrame) -> DataFrame:
    """Each topic with its parent's id, by (user, slug)."""
    parents = topics.select("user_id", F.col("slug").alias("parent_slug"), F.col("topic_id").alias("parent_id"))
    return topics.join(parents, ["user_id", "parent_slug"], "left")


def not_current(rows: DataFrame, done: DataFrame, key: str, version: str) -> DataFrame:
    """Rows for a stage to process: those without a result (key, version) of this version."""
    return rows.join(done.where(F.col("version") == version).select(key), key, "left_anti")


def category_rules(spark: SparkSession) -> DataFrame:
    """(place, category, confidence, kind, value), one row per host, topic and keyword."""
    rows = [(i, c, p, kind, v) for i, (c, p, *lists) in enumerate(CATEGORY_RULES) for kind, values in zip(("host", "topic", "keyword"), lists, strict=True) for v in values]
    return spark.createDataFrame(rows, "place int, category string, confidence double, kind string, value string")


def route_categories(documents: DataFrame, rules: DataFrame, key: str = "document_id", host: str = "host", topics: str = "topics", text: str = "title") -> DataFrame:
    """(key, category, confidence, matched_by): the surest matching rule, hosts before topics before keywords, then in rule order.

    Hosts match by suffix, keywords as whole words. Of a document's words and pairs of words only those that some rule
    names leave its row; the rule table is small by its definition. Under CATEGORY_LEAST a document is unclassified.
    """
    parts = F.split(F.lower(F.coalesce(host, F.lit(""))), "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 100), "."))
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9-]+", " "), " "), lambda w: F.length(w) > 0)
    pairs = F.filter(F.zip_with(words, F.slice(words, 2, 2**30), lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())  # the last word has no next one
    tagged = F.concat(
        F.transform(suffixes, lambda v: F.struct(F.lit("host").alias("kind"), v.alias("value"))),
        F.transform(F.coalesce(F.col(topics), F.array().cast("array<string>")), lambda v: F.struct(F.lit("topic").alias("kind"), v.alias("value"))),
        F.transform(F.array_intersect(F.concat(words, pairs), F.col("__keywords")), lambda v: F.struct(F.lit("keyword").alias("kind"), v.alias("value"))),
    )
    keywords = rules.agg(F.coalesce(F.collect_set(F.when(F.col("kind") == "keyword", F.col("value"))), F.array().cast("array<string>")).alias("__keywords"))  # one row
    asked = documents.join(F.broadcast(keywords), how="cross").select(key, F.explode(tagged).alias("t")).select(key, "t.kind", "t.value")
    found = asked.join(F.broadcast(rules), ["kind", "value"])
    order = F.struct((-F.col("confidence")).alias("c"), F.when(F.col("kind") == "host", 0).when(F.col("kind") == "topic", 1).otherwise(2).alias("k"), "place", "value", "category", "kind")
    best = found.groupBy(key).agg(F.min(order).alias("b"))
    out = documents.select(key).join(best, key, "left")
    wins = F.coalesce(-F.col("b.c") >= CATEGORY_LEAST, F.lit(False))
    return out.select(
        key,
        F.when(wins, F.col("b.category")).otherwise(CATEGORY_DEFAULT).alias("category"),
        F.coalesce(-F.col("b.c"), F.lit(0.0)).alias("confidence"),
        F.when(wins, F.concat_ws(":", "b.kind", "b.value")).otherwise("fallback").alias("matched_by"),
    )


def topics_by_keyword(documents: DataFrame, topics: DataFrame, key: str = "document_id", text: str = "text", confidence: float = 0.7) -> DataFrame:
    """(key, topic_id, confidence) of documents (key, user_id, text) that hold one of a topic's keywords as a word.

    Topics (topic_id, user_id, keywords array) belong to their user; a keyword matches exactly, never nearly.
    """
    words = F.array_distinct(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}-]+", " "), " "))
    wanted = topics.select("topic_id", "user_id", F.explode(F.transform("keywords", F.lower)).alias("word")).where("word <> ''").distinct()
    found = documents.select(key, "user_id", F.explode(words).alias("word")).join(wanted, ["user_id", "word"])
    return found.groupBy(key, "topic_id").agg(F.lit(confidence).alias("confidence"))


def assign_topics(keyword_hits: DataFrame, centroid_hits: DataFrame, most: int = 5) -> DataFrame:
    """(document_id, topic_id, confidence, is_primary) from hits (document_id, topic_id, confidence): the surest ``most``, one of them primary."""
    best = keyword_hits.unionByName(centroid_hits).groupBy("document_id", "topic_id").agg(F.max("confidence").alias("confidence"))
    w = Window.partitionBy("document_id").orderBy(F.desc("confidence"), "topic_id")
    return best.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).withColumn("is_primary", F.col("rn") == 1).drop("rn")
