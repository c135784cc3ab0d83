"""Importance scores of events: weighted rules over normalised signals, overrides, bands and re-scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.columns import band_for, clamp01, working_hours

# Fixed values: (rule, signal, weight), in order; weights of the server's rules.
SERVER_RULES = [
    ("rule.dwell", "dwell_seconds", 0.16),
    ("rule.word-count", "word_count", 0.08),
    ("rule.topic-novelty", "topic_novelty", 0.13),
    ("rule.bookmark", "is_bookmarked", 0.12),
    ("rule.copy", "has_copy", 0.09),
    ("rule.selection", "has_selection", 0.07),
    ("rule.download", "is_downloaded", 0.07),
    ("rule.revisit", "revisit_count", 0.06),
    ("rule.scroll-depth", "scroll_depth_pct", 0.06),
    ("rule.youtube-progress", "youtube_watched_pct", 0.06),
    ("rule.unique-domain", "is_unique_domain", 0.05),
    ("rule.working-hours", "is_working_hours", 0.05),
    ("rule.app-excluded", "app_is_excluded", -1.0),
]
# Weights of the client's scorer.
CLIENT_WEIGHTS = {
    "dwell_seconds": 0.3,
    "scroll_depth_pct": 0.15,
    "is_unique_domain": 0.05,
    "revisit_count": 0.12,
    "word_count": 0.1,
    "has_selection": 0.1,
    "has_copy": 0.12,
    "is_bookmarked": 0.08,
    "is_downloaded": 0.05,
    "youtube_watched_pct": 0.12,
    "app_is_excluded": -1.0,
    "is_working_hours": 0.03,
    "topic_novelty": 0.15,
}
# Where a signal is full.
SERVER_FULL = {"dwell_seconds": 180.0, "scroll_depth_pct": 100.0, "word_count": 1500.0, "revisit_count": 3.0}
CLIENT_FULL = {"dwell_seconds": 10.0, "scroll_depth_pct": 100.0, "word_count": 2000.0, "revisit_count": 5.0}
SIGNALS = tuple(CLIENT_WEIGHTS)
#: Share of the positive weights that an enabled rule set is expected to reach.
WEIGHT_SUM = 1.0


def normalised(signal: str, full: dict[str, float]) -> Column:
    """A signal as a number between 0 and 1; missing or not finite counts as 0."""
    return clamp01(F.col(signal).cast("double") / full.get(signal, 1.0))


def rules_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, r, s, w, True) for i, (r, s, w) in enumerate(SERVER_RULES)], "place int, rule string, signal string, weight double, enabled boolean")


def override_rules(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """The rules of every user of ``overrides`` (user_id, rule, weight, enabled), and those of all other users under a null user_id.

    An override's values win, null ones do not. Each user of ``overrides`` meets the rule table, which has a fixed size.
    """
    users = overrides.where("user_id is not null").select("user_id").distinct()
    mine = overrides.select("user_id", "rule", F.col("weight").alias("__w"), F.col("enabled").alias("__e"))
    every = rules.withColumn("__all", F.lit(True))
    out = users.withColumn("__all", F.lit(True)).join(F.broadcast(every), "__all").drop("__all").join(mine, ["user_id", "rule"], "left")
    out = out.withColumn("weight", F.coalesce("__w", "weight")).withColumn("enabled", F.coalesce("__e", "enabled")).drop("__w", "__e")
    return out.unionByName(rules.withColumn("user_id", F.lit(None).cast(out.schema["user_id"].dataType)))


def weight_check(rules: DataFrame) -> DataFrame:
    total = F.sum(F.when(F.col("enabled") & (F.col("weight") > 0), F.col("weight")).otherwise(0.0))
    return rules.agg(F.round(total, 6).alias("weight_sum")).withColumn("complete", F.abs(F.col("weight_sum") - WEIGHT_SUM) < 1e-9)


def server_score(events: DataFrame) -> DataFrame:
    """Adds score, band and contributions (rule, weight, value) by the default rules, as one expression per row."""
    parts = [(r, s, w, normalised(s, SERVER_FULL)) for r, s, w in SERVER_RULES]
    score = clamp01(sum((F.lit(w) * v for _, _, w, v in parts), F.lit(0.0)))
    contributions = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(w).alias("weight"), v.alias("value")) for r, _, w, v in parts])
    return events.withColumn("score", F.round(score, 6)).withColumn("band", band_for(F.col("score"))).withColumn("contributions", contributions)


def server_score_by_rules(events: DataFrame, rules: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, score, band) by a rule table, which may have several signals to a rule and rules per user.

    The signals are unpivoted and joined with the small rule table; a weight is spread over its rule's signals. Users
    without rules of their own, and events without a user, have those under a null user_id.
    """
    keyed = "user_id" in rules.columns
    if keyed:
        own = rules.where("user_id is not null").select("user_id").distinct().withColumn("__own", F.lit(True))
        users = F.when(F.col("__own"), F.col("user_id"))
        events = events.join(own, "user_id", "left").withColumn("user_id", F.coalesce(users.cast("string"), F.lit(""))).drop("__own")
        rules = rules.withColumn("user_id", F.coalesce(F.col("user_id").cast("string"), F.lit("")))
    stack = ", ".join(f"'{s}', cast({s} as double)" for s in SIGNALS)
    signals = events.select(key, "user_id", F.expr(f"stack({len(SIGNALS)}, {stack}) as (signal, raw)"))
    full = F.coalesce(*[F.when(F.col("signal") == s, F.lit(v)) for s, v in SERVER_FULL.items()], F.lit(1.0))
    sizes = rules.groupBy(*(["user_id"] if keyed else []), "rule").agg(F.count("*").alias("signals"))
    on = ["user_id", "rule"] if keyed else ["rule"]
    shares = rules.where("enabled").join(sizes, on).select(*(["user_id"] if keyed else []), "signal", (F.col("weight") / F.col("signals")).alias("share"))
    joined = signals.join(F.broadcast(shares) if not keyed else shares, ["user_id", "signal"] if keyed else ["signal"])
    out = joined.groupBy(key).agg(F.sum(F.col("share") * clamp01(F.col("raw") / full)).alias("total"))
    return out.select(key, F.round(clamp01(F.col("total")), 6).alias("score")).withColumn("band", band_for(F.col("score")))


def extract_signals(events: DataFrame, type_: str = "type", payload: str = "payload") -> DataFrame:
    """Adds the thirteen signals to events with a JSON payload and a history.

    Of the history it takes revisit_count and is_unique_domain (see rollups.revisit_signals), of the topics
    topic_likeness, the cosine to the nearest known centroid (null: nothing known, a novelty of 0.5), and of the device
    app_is_excluded, each where the events have it. A field that the event's type does not have counts 0 or false.
    """
    kind = F.col(type_)
    number = lambda field: F.coalesce(F.expr(f"try_cast(get_json_object({payload}, '$.{field}') as double)"), F.lit(0.0))
    had = lambda name, default: F.coalesce(F.col(name), default) if name in events.columns else default
    dwell = F.when(kind == "page_view", number("durationMs") / 1000).when(kind == "app_session", number("durationSeconds")).otherwise(0.0)
    likeness = F.col("topic_likeness") if "topic_likeness" in events.columns else F.lit(None).cast("double")
    signals = {
        "dwell_seconds": F.greatest(F.lit(0.0), dwell),
        "scroll_depth_pct": F.when(kind == "page_view", F.greatest(F.lit(0.0), F.least(F.lit(100.0), number("scrollDepthPct")))).otherwise(0.0),
        "is_unique_domain": had("is_unique_domain", F.lit(False)),
        "revisit_count": had("revisit_count", F.lit(0)),
        "word_count": F.when(kind == "page_read", F.greatest(F.lit(0.0), number("wordCount"))).otherwise(0.0),
        "has_selection": kind == "selection",
        "has_copy": kind == "copy",
        "is_bookmarked": kind == "bookmark",
        "is_downloaded": kind == "download",
        "youtube_watched_pct": F.when(kind == "youtube_watch", clamp01(number("watchedPct"))).otherwise(0.0),
        "app_is_excluded": had("app_is_excluded", F.lit(False)),
        "is_working_hours": working_hours(F.col("occurred_at")),
        "topic_novelty": F.when(likeness.isNull(), 0.5).otherwise(clamp01(1 - likeness)),
    }
    return events.withColumns(signals)


def client_score(events: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds score, band and contributions by the client's weights; an excluded app scores 0 whatever else holds."""
    weights = CLIENT_WEIGHTS if weights is None else weights
    parts = [(s, weights.get(s, 0.0), normalised(s, CLIENT_FULL)) for s in SIGNALS]
    veto = F.coalesce(F.col("app_is_excluded"), F.lit(False))
    score = F.when(veto, 0.0).otherwise(clamp01(sum((F.lit(w) * v for _, w, v in parts), F.lit(0.0))))
    every = F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(w).alias("weight"), v.alias("value")) for s, w, v in parts])
    only = F.array(F.struct(F.lit("app_is_excluded").alias("signal"), F.lit(weights.get("app_is_excluded", 0.0)).alias("weight"), F.lit(1.0).alias("value")))
    contributions = F.when(veto, only).otherwise(F.filter(every, lambda c: (c["value"] != 0) & (c["weight"] != 0)))
    return events.withColumn("score", F.round(score, 6)).withColumn("band", band_for(F.col("score"))).withColumn("contributions", contributions)


def rescore_backlog(events: DataFrame, version: str) -> DataFrame:
    """Events whose score is not of this version."""
    return events.where(~F.col("importance_version").eqNullSafe(F.lit(version)))
