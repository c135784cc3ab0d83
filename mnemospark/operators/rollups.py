"""Dashboard roll-ups and history windows over activity events."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.columns import canonical_url, seconds_of, since_until
from mnemospark.sources.scratch import materialize


def with_as_of(rows: DataFrame, ts: str, name: str = "as_of", as_of: Column | None = None) -> DataFrame:
    """Adds the moment that a report looks back from: the given one, or the latest time of the rows (one broadcast row)."""
    if as_of is not None:
        return rows.withColumn(name, as_of)
    return rows.crossJoin(F.broadcast(rows.agg(F.max(ts).alias(name))))


def last_days(rows: DataFrame, days: int, ts: str = "occurred_at", as_of: Column | None = None) -> DataFrame:
    """Rows of the days before a moment, their start included: before the given one, or up to the latest time of the rows."""
    timed = with_as_of(rows, ts, "__as_of", as_of)
    held = since_until(F.col(ts), F.col("__as_of") - F.expr(f"INTERVAL {days} DAYS"), F.col("__as_of") if as_of is not None else None)
    return timed.where(held).drop("__as_of")


def top_domains(events: DataFrame, days: int = 7, limit: int = 5, as_of: Column | None = None) -> DataFrame:
    """The domains with most events of the last days; ties by name."""
    week = last_days(events.where("domain <> ''"), days, as_of=as_of)
    return week.groupBy("domain").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "domain").limit(limit)


def count_per_day(events: DataFrame, type_: str, ts: str = "occurred_at") -> DataFrame:
    return events.where(F.col("type") == type_).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))


def time_by(events: DataFrame, *keys: str) -> DataFrame:
    """Events, seconds and last time by any keys (type, domain, topic, day)."""
    return events.groupBy(*keys).agg(F.count("*").alias("events"), F.sum("duration_seconds").alias("seconds"), F.max("occurred_at").alias("last_at"))


def read_documents(events: DataFrame, documents: DataFrame, topics: DataFrame) -> DataFrame:
    """Events with the topics of the document that they are on: documents (url, document_id, and user_id if each user has
    their own) are met by canonical url, and by the event's user where documents have one."""
    pages = documents.select(F.coalesce(canonical_url(F.col("url")), "url").alias("__page"), "document_id", *(["user_id"] if "user_id" in documents.columns else []))
    on = [c for c in pages.columns if c != "document_id"]
    return _with_pages(events).join(pages, on).drop("__page").join(topics.select("document_id", "topic").distinct(), "document_id")


def time_by_topic(events: DataFrame, documents: DataFrame, topics: DataFrame) -> DataFrame:
    """Seconds, events and last time per topic: events meet documents (see :func:`read_documents`) and their topics (document_id, topic).

    Events without a document are absent; a document with several topics counts for each.
    """
    return time_by(read_documents(events, documents, topics), "topic")


def time_by_day_topic(events: DataFrame, documents: DataFrame, topics: DataFrame, values: list) -> DataFrame:
    """A column of seconds for each named topic, ``other`` for the rest, and one row per day, with the day's total over all topics."""
    read = read_documents(events, documents, topics)
    named = F.coalesce(F.when(F.col("topic").isin(*values), F.col("topic").cast("string")), F.lit("other"))
    return time_by_day_pivot(read.withColumn("topic", named), "topic", [*map(str, values), "other"])


def time_by_day_pivot(events: DataFrame, column: str, values: list[str]) -> DataFrame:
    """A column of seconds per value and one row per day, with the day's total over these values."""
    days = events.where(F.col(column).isin(values)).groupBy(F.to_date("occurred_at").alias("day")).pivot(column, values).agg(F.sum("duration_seconds")).na.fill(0, [str(v) for v in values])
    return days.withColumn("total", sum((F.col(f"`{v}`") for v in values), F.lit(0)))


def topic_cloud(members: DataFrame, topic: str) -> DataFrame:
    """Members per topic, min-max weight (0.5 when all are equal) and share; one row per topic passes through one task."""
    counts = members.groupBy(topic).agg(F.count("*").alias("members"))
    whole = Window.partitionBy()
    low, high = F.min("members").over(whole), F.max("members").over(whole)
    weight = F.when(high == low, F.lit(0.5)).otherwise((F.col("members") - low) / (high - low))
    return counts.withColumn("weight", F.round(weight, 6)).withColumn("share", F.round(F.col("members") / F.sum("members").over(whole), 6))


def device_last_seen(events: DataFrame) -> DataFrame:
    return events.groupBy("device_id").agg(F.max("occurred_at").alias("last_seen_at"), F.count("*").alias("events"))


def status_distribution(rows: DataFrame, status: str) -> DataFrame:
    counts = rows.groupBy(status).agg(F.count("*").alias("rows"))
    return counts.withColumn("share", F.round(F.col("rows") / F.sum("rows").over(Window.partitionBy()), 6))


def distinct_delivery(events: DataFrame) -> DataFrame:
    """Per device: events, distinct keys, and whether each key came once."""
    out = events.groupBy("device_id").agg(F.count("*").alias("events"), F.count_distinct("dedupe_key").alias("keys"))
    return out.withColumn("once", F.col("events") == F.col("keys"))


def pending_per_device(events: DataFrame, acknowledged: DataFrame) -> DataFrame:
    return events.join(acknowledged.select("event_id"), "event_id", "left_anti").groupBy("device_id").agg(F.count("*").alias("pending"), F.min("occurred_at").alias("oldest_at"))


def access_bump(memories: DataFrame, uses: DataFrame) -> DataFrame:
    """Adds each use (memory_id, used_at) to access_count and moves last_accessed_at on."""
    used = uses.groupBy("memory_id").agg(F.count("*").alias("__n"), F.max("used_at").alias("__at"))
    out = memories.join(used, "memory_id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("__n", F.lit(0)))
    return out.withColumn("last_accessed_at", F.greatest("last_accessed_at", "__at")).drop("__n", "__at")


def merge_topics(links: DataFrame, moves: DataFrame) -> DataFrame:
    """Links (document_id, topic_id) with topics repointed by (from_id, to_id); links that meet become one."""
    return links.join(moves, links["topic_id"] == moves["from_id"], "left").select("document_id", F.coalesce("to_id", "topic_id").alias("topic_id")).distinct()


def merge_topics_everywhere(links: DataFrame, memories: DataFrame, topics: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, memories, topics) after topics are merged: links and the memories' topic_ids repointed, the merged ones gone,
    and each topic's documents and memories counted anew. Moves (from_id, to_id) are broadcast only where Spark finds them small."""
    links = merge_topics(links, moves)
    each = memories.select("memory_id", F.explode("topic_ids").alias("topic_id"))
    each = each.join(moves, F.col("topic_id") == F.col("from_id"), "left").select("memory_id", F.coalesce("to_id", "topic_id").alias("topic_id")).distinct()
    held = each.groupBy("memory_id").agg(F.array_sort(F.collect_list("topic_id")).alias("topic_ids"))
    kept = topics.join(moves.select(F.col("from_id").alias("topic_id")), "topic_id", "left_anti").drop("documents", "memories")
    counted = kept.join(links.groupBy("topic_id").agg(F.count("*").alias("documents")), "topic_id", "left").join(each.groupBy("topic_id").agg(F.count("*").alias("memories")), "topic_id", "left")
    return links, memories.drop("topic_ids").join(held, "memory_id", "left"), counted.na.fill(0, ["documents", "memories"])


def topic_centroids(chunks: DataFrame, topic: str = "topic", vector: str = "embedding", model: str | None = None) -> DataFrame:
    """Mean vector per topic and, if named, model, component by component; partial sums absorb a hot topic."""
    keys = [topic] if model is None else [topic, model]
    parts = chunks.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("centroid"))


#: Time of an event within its user's, and the day by which long histories are cut.
_ORDER, _DAY = ("occurred_at", "event_id"), "__day"


def _with_day(events: DataFrame) -> DataFrame:
    return events.withColumn(_DAY, F.unix_date(F.col("occurred_at").cast("date")))


def _running(events: DataFrame, keys: Sequence[str], count: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``count`` over the earlier events of the same keys, in two levels.

    A window runs within each day of the keys; what the days before it bring is summed by day, which few rows hold, and
    joined back. So keys with many events (a user, a domain of theirs) are read by as many tasks as they have days.
    """
    own = Window.partitionBy(*keys, _DAY).orderBy(*_ORDER)
    counted = events.withColumn("__n", count)
    days = counted.groupBy(*keys, _DAY).agg(F.sum("__n").alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy(_DAY).rowsBetween(Window.unboundedPreceding, -1)
    marks = [f"__k{i}" for i in range(len(keys))] + ["__d"]
    carried = days.select(*[F.col(k).alias(m) for k, m in zip([*keys, _DAY], marks, strict=True)], F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__carry"))
    inner = counted.withColumn("__own", F.coalesce(F.sum("__n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(m)) for k, m in zip([*keys, _DAY], marks, strict=True)]
    return inner.join(carried, reduce(lambda a, b: a & b, same)).withColumn(name, F.col("__own") + F.col("__carry")).drop("__n", "__own", "__carry", *marks)


def _with_pages(events: DataFrame) -> DataFrame:
    """Adds __page, the canonical url or the url itself; each different url is worked on once."""
    pages = events.select(F.col("url").alias("__url")).where("url is not null").distinct().withColumn("__page", F.coalesce(canonical_url(F.col("__url")), "__url"))
    return events.join(pages, F.col("url") == F.col("__url"), "left").drop("__url")


def revisit_signals(events: DataFrame) -> DataFrame:
    """Adds revisit_count (earlier events of the same user and canonical url) and is_unique_domain (first of a domain, not the user's first event)."""
    out = _running(_with_day(_with_pages(events)), ["user_id", "__page"], F.lit(1), "revisit_count")
    out = _running(out, ["user_id", "domain"], F.lit(1), "__domains")
    first = events.groupBy(F.col("user_id").alias("__user")).agg(F.min(F.struct(*_ORDER)).alias("__first"))
    out = out.join(first, F.col("user_id").eqNullSafe(F.col("__user")))
    out = out.withColumn("is_unique_domain", (F.col("__domains") == 0) & (F.struct(*_ORDER) > F.col("__first")))
    return out.withColumn("revisit_count", F.col("revisit_count").cast("int")).drop("__page", "__domains", "__user", "__first", _DAY)


def history_window(events: DataFrame) -> DataFrame:
    """:func:`revisit_signals` and :func:`foreground_seconds`, with seen_domains: the domains that the user had met before."""
    out = _with_day(foreground_seconds(revisit_signals(events)))
    out = _running(out, ["user_id", "domain"], F.lit(1), "__domains")
    first = F.when(F.col("domain").isNotNull() & (F.col("__domains") == 0), 1).otherwise(0)
    return _running(out, ["user_id"], first, "seen_domains").drop("__domains", _DAY)


def foreground_seconds(events: DataFrame, hours: int = 24) -> DataFrame:
    """Adds foreground_seconds: the user's seconds over the trailing hours, the event's own included.

    Hours are cut into pieces of their own length. A piece sees the one before as a halo, whose rows count but are not
    returned, so that a user with many events is read by as many tasks as there are pieces.
    """
    length = hours * 3600
    rows = events.withColumn("__s", seconds_of(F.col("occurred_at"))).withColumn("__own", F.floor(F.col("__s") / max(1, length)))
    halo = rows.select("user_id", "__s", "duration_seconds", (F.col("__own") + 1).alias("__piece"), F.lit(True).alias("__halo"))
    sums = halo.groupBy("user_id", "__s", "__piece", "__halo").agg(F.sum("duration_seconds").alias("duration_seconds"))
    both = rows.withColumns({"__piece": F.col("__own"), "__halo": F.lit(False)}).unionByName(sums, allowMissingColumns=True)
    w = Window.partitionBy("user_id", "__piece").orderBy("__s").rangeBetween(-length, 0)
    return both.withColumn("foreground_seconds", F.sum("duration_seconds").over(w)).where("not __halo").drop("__s", "__own", "__piece", "__halo")


def evict_over_capacity(events: DataFrame, capacity: int) -> DataFrame:
    """Per device the ``capacity`` most important events; among equals the earlier stays."""
    w = Window.partitionBy("device_id").orderBy(F.desc("importance"), "occurred_at", "event_id")
    return events.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= capacity).drop("__rn")


def suppress_recent(events: DataFrame, seconds: int) -> DataFrame:
    """Events whose key did not occur on the device within the last ``seconds``; every sight renews a key."""
    w = Window.partitionBy("device_id", "dedupe_key").orderBy("occurred_at", "event_id")
    gap = seconds_of(F.col("occurred_at")) - F.lag(seconds_of(F.col("occurred_at"))).over(w)
    return events.withColumn("__gap", gap).where(F.col("__gap").isNull() | (F.col("__gap") > seconds)).drop("__gap")


#: Keys that a device remembers.
RECENT_KEYS = 2_000


def _last_keys(ordered: DataFrame, capacity: int) -> DataFrame:
    """(device_id, slice, keys): the device's last ``capacity`` keys before each of its slices but the first, latest first.

    A slice's own last keys are its summary. Summaries of 1, 2, 4, ... slices are joined to ones of twice as many, until
    each is full or reaches the device's first slice; a full one needs no older keys, so few rounds are made.
    """
    last = ordered.groupBy("device_id", "slice", "dedupe_key").agg(F.max(F.struct("occurred_at", "event_id")).alias("at"))
    latest = Window.partitionBy("device_id", "slice").orderBy(F.desc("at"))
    kept = last.withColumn("__rn", F.row_number().over(latest)).where(F.col("__rn") <= capacity)
    own = kept.groupBy("device_id", "slice").agg(F.transform(F.array_sort(F.collect_list(F.struct("__rn", "dedupe_key"))), lambda x: x["dedupe_key"]).alias("keys"))
    held = materialize(own.withColumn("k", F.row_number().over(Window.partitionBy("device_id").orderBy("slice"))))
    step = 1
    while not held.where((F.size("keys") < capacity) & (F.col("k") > step)).isEmpty():
        older = held.select("device_id", (F.col("k") + step).alias("k"), F.col("keys").alias("older"))
        both = F.slice(F.concat("keys", F.array_except("older", "keys")), F.lit(1), F.lit(capacity))
        joined = held.join(older, ["device_id", "k"], "left").withColumn("keys", F.when((F.size("keys") >= capacity) | F.col("older").isNull(), F.col("keys")).otherwise(both)).drop("older")
        held, step = materialize(joined), 2 * step
    following = held.select("device_id", (F.col("k") + 1).alias("k"), "keys")
    return held.select("device_id", "slice", "k").join(following, ["device_id", "k"]).select("device_id", "slice", "keys")


def suppress_last_keys(events: DataFrame, capacity: int = RECENT_KEYS) -> DataFrame:
    """Events (event_id, device_id, dedupe_key, occurred_at) whose key is not among the device's last ``capacity`` keys.

    Every sight makes a key the latest one. Events are dealt in order over all tasks, so that a device with many of them
    is cut into slices; each slice starts with the keys that the device remembers before it. Events without a device stay.
    """
    columns = ["event_id", "device_id", "dedupe_key", "occurred_at"]
    rows = events.select(*columns)
    if capacity <= 0:
        return rows
    known = rows.where("device_id is not null")
    ordered = materialize(known.repartitionByRange("device_id", "occurred_at", "event_id").withColumn("slice", F.spark_partition_id()))
    before = _last_keys(ordered, capacity).select(F.col("device_id").alias("__device"), F.col("slice").alias("__slice"), "keys")

    def run(events: pa.Table, remembered: pa.Table) -> pa.Table:
        events = events.sort_by([("occurred_at", "ascending"), ("event_id", "ascending")])
        held: OrderedDict = OrderedDict((k, None) for k in reversed(remembered["keys"][0].as_py() if remembered.num_rows else []))
        new = []
        for k in events["dedupe_key"].to_pylist():
            new.append(k not in held)
            held[k] = None
            held.move_to_end(k)
            if len(held) > capacity:
                held.popitem(last=False)
        return events.select(columns).filter(pa.array(new, pa.bool_()))

    met = ordered.groupBy("device_id", "slice").cogroup(before.groupBy("__device", "__slice"))
    return met.applyInArrow(run, rows.schema).unionByName(rows.where("device_id is null"))


def recent_events(events: DataFrame, limit: int = 50, types: Sequence[str] | None = None, devices: Sequence | None = None, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """The latest events by time of receipt, of some types or devices, of a range with both ends."""
    held = since_until(F.col("occurred_at"), low, high, closed=True)
    for name, values in (("type", types), ("device_id", devices)):
        if values is not None:
            held = held & F.col(name).isin(*values)
    return events.where(held).orderBy(F.desc("received_at"), F.desc("event_id")).limit(limit)


def recent_documents(documents: DataFrame, limit: int = 20) -> DataFrame:
    """The latest documents that are not deleted."""
    return documents.where("deleted_at is null").orderBy(F.desc("captured_at"), F.desc("document_id")).limit(limit)


def recent_memories(memories: DataFrame, limit: int = 20, kinds: Sequence[str] | None = None, topics: Sequence | None = None) -> DataFrame:
    """The latest active statements, of some kinds, about some topics."""
    rows = memories.where("status = 'active'")
    if kinds is not None:
        rows = rows.where(F.col("kind").isin(*kinds))
    if topics is not None:
        rows = rows.where(F.arrays_overlap("topic_ids", F.array(*map(F.lit, topics))))
    return rows.orderBy(F.desc("valid_from"), F.desc("memory_id")).limit(limit)


def keyset_page(rows: DataFrame, pivot: str, key: str, after: tuple | None, limit: int) -> DataFrame:
    """One page in descending (pivot, key) order after a cursor; the limit is held between 1 and 200."""
    if after is not None:
        rows = rows.where((F.col(pivot) < F.lit(after[0])) | ((F.col(pivot) == F.lit(after[0])) & (F.col(key) < F.lit(after[1]))))
    return rows.orderBy(F.desc(pivot), F.desc(key)).limit(max(1, min(200, limit)))
