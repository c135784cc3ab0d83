"""Intervals, versions of centroids, last keys and running totals by slices, against brute force."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.functions.intervals import FAR, dyadic_cells, join_moments
from mnemospark.operators import memory, novelty, rollups, sketches

DAY0 = datetime.datetime(2024, 1, 1)


def test_cells_tile_their_interval(spark):
    rng = random.Random(1)
    rows = [(a, a + rng.randrange(1, 300)) for a in (rng.randrange(-200, 200) for _ in range(60))] + [(5, 5), (7, 3), (None, None), (3, None), (None, -3)]
    for r in spark.createDataFrame(rows, "a bigint, b bigint").select("a", "b", dyadic_cells(F.col("a"), F.col("b")).alias("c")).collect():
        low, high = (-FAR if r.a is None else r.a), (FAR if r.b is None else r.b)
        blocks = sorted((c.cell << c.level, (c.cell + 1) << c.level) for c in r.c)
        assert sum(e - s for s, e in blocks) == max(0, high - low) and len(blocks) <= 2 * 43
        if blocks:
            assert blocks[0][0] == low and blocks[-1][1] == high and all(x[1] == y[0] for x, y in zip(blocks, blocks[1:], strict=False))


def test_moments_meet_their_intervals(spark):
    rng = random.Random(2)
    spans = [(i, rng.choice([None, rng.randrange(-50, 50)]), rng.choice([None, rng.randrange(-50, 90)])) for i in range(120)]
    times = [(1000 + i, rng.randrange(-60, 100)) for i in range(80)] + [(2000, None)]
    frame = join_moments(spark.createDataFrame(spans, "i bigint, a bigint, b bigint").repartition(3), F.col("a"), F.col("b"), spark.createDataFrame(times, "m bigint, at bigint"), F.col("at"))
    want = [(i, m) for i, a, b in spans for m, t in times if t is not None and (a is None or a <= t) and (b is None or t < b)]
    assert sorted((r.i, r.m) for r in frame.collect()) == sorted(want)
    assert "NestedLoop" not in frame._jdf.queryExecution().toString() and "Cartesian" not in frame._jdf.queryExecution().toString()
    assert join_moments(frame.limit(0).select("i", "a", "b"), F.col("a"), F.col("b"), spark.createDataFrame(times, "m bigint, at bigint"), F.col("at")).count() == 0


def test_statements_at_many_moments(spark):
    rng = random.Random(3)
    at = lambda: DAY0 + datetime.timedelta(microseconds=rng.randrange(10**10))
    held = [(i, *rng.choice([(x, y), (min(x, y), max(x, y)), (x, None), (x, x)])) for i, x, y in ((i, at(), at()) for i in range(60))] + [(100, None, None)]
    asked = [(i, at()) for i in range(200)] + [(900 + i, t) for i, (_, t, _) in enumerate(held) if t] + [(2000, None)]
    frame = memory.valid_at(spark.createDataFrame(held, "memory_id bigint, valid_from timestamp_ntz, valid_to timestamp_ntz"), spark.createDataFrame(asked, "moment_id bigint, at timestamp_ntz"))
    want = [(i, m) for i, a, b in held for m, t in asked if t and a and a <= t and (b is None or t < b)]
    assert sorted((r.memory_id, r.moment_id) for r in frame.collect()) == sorted(want)
    assert "NestedLoop" not in frame._jdf.queryExecution().toString()


@pytest.mark.parametrize("part", [novelty.PART, 7])
def test_novelty_by_hand(spark, monkeypatch, part):
    monkeypatch.setattr(novelty, "PART", part)
    rng = np.random.default_rng(5)
    day = lambda d: DAY0 + datetime.timedelta(days=int(d), hours=int(rng.integers(24)))
    passages = [(int(rng.integers(4)), day(rng.integers(6)), rng.standard_normal(3).tolist()) for _ in range(60)] + [(None, day(1), [1.0, 0.0, 0.0]), (1, None, [1.0, 0.0, 0.0]), (2, day(2), None), (2, day(2), [float("nan"), 0.0, 0.0])]
    events = [(i, day(rng.integers(-1, 9)), rng.standard_normal(3).tolist()) for i in range(100)] + [(200, day(3), None), (201, None, [1.0, 0.0, 0.0]), (202, day(3), [0.0, 0.0, 0.0]), (203, day(4), [1.0])]
    p, e = spark.createDataFrame(passages, "topic int, captured_at timestamp, embedding array<double>"), spark.createDataFrame(events, "event_id bigint, occurred_at timestamp, embedding array<double>")
    versions = novelty.centroid_versions(p)
    got = {r.event_id: (r.known_topics, r.topic, None if r.likeness is None else round(r.likeness, 6)) for r in novelty.known_likeness(e, versions, "event_id", "occurred_at").collect()}
    good = [(t, at.date(), v) for t, at, v in passages if t is not None and at and v and not np.isnan(v).any()]
    want = {}
    for k, at, v in events:
        known = {t: np.mean([w for u, d, w in good if u == t and d < at.date()], axis=0) for t in {u for u, d, _ in good if at and d < at.date()}} if at else {}
        likes = [(-round(float(np.dot(v, c) / np.linalg.norm(v) / np.linalg.norm(c)), 9), t) for t, c in known.items()] if v and len(v) == 3 and any(v) else []
        want[k] = (len(known), min(likes)[1] if likes else None, round(-min(likes)[0], 6) if likes else None)
    assert got == want
    for r in versions.collect():
        assert r.members == sum(1 for t, d, _ in good if t == r.topic and (d - datetime.date(1970, 1, 1)).days < r.from_day)
    assert [round(x, 3) for x in spark.createDataFrame([(0.2,), (None,), (-0.5,)], "x double").select(novelty.novelty(F.col("x")).alias("n")).toPandas()["n"]] == [0.8, 0.5, 1.0]


# ---- sequences by slices


def test_last_keys_of_a_busy_device(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *(f"k{j}" for j in range(25))]), DAY0 + datetime.timedelta(seconds=rng.randrange(4000))) for i in range(3000)]
    rows += [(5000 + i, 4, f"n{i}", DAY0 + datetime.timedelta(seconds=i)) for i in range(50)] + [(6000 + i, 4, f"n{i}", DAY0 + datetime.timedelta(seconds=100 + i)) for i in range(50)]
    events = spark.createDataFrame(rows, "event_id bigint, device_id bigint, dedupe_key string, occurred_at timestamp").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for capacity in (1, 3, 20, 49, 50, 1000):
            held, want = {}, []
            for i, d, k, _ in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[3], r[0])):
                seen = held.setdefault(d, [])
                if k not in seen:
                    want.append(i)
                else:
                    seen.remove(k)
                seen.append(k)
                del seen[: max(0, len(seen) - capacity)]
            got = [r.event_id for r in rollups.suppress_last_keys(events, capacity).collect()]
            assert sorted(got) == sorted(want + [r[0] for r in rows if r[1] is None])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_histories_in_two_levels(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([1, 1, 2, None]), DAY0 + datetime.timedelta(hours=rng.randrange(200), seconds=rng.randrange(3)), rng.choice([None, "a.org", "b.org", "c.org"]), rng.choice([None, "https://a.org/x?utm_source=f", "https://a.org/x", "https://b.org/y"]), rng.choice([None, 5, 70])) for i in range(600)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, occurred_at timestamp, domain string, url string, duration_seconds bigint").repartition(3)
    want, ordered = {}, sorted(rows, key=lambda r: (r[2], r[0]))
    page = lambda u: u and u.split("?")[0]
    for n, (i, u, at, d, url, _) in enumerate(ordered):
        mine = [r for r in ordered[:n] if r[1] == u]
        recent = [r[5] for r in rows if r[1] == u and 0 <= (at - r[2]).total_seconds() <= 86_400 and r[5] is not None]
        want[i] = (sum(page(r[4]) == page(url) for r in mine), bool(mine) and all(r[3] != d for r in mine), sum(recent) if recent else None, len({r[3] for r in mine} - {None}))
    got = {r.event_id: (r.revisit_count, r.is_unique_domain, r.foreground_seconds, r.seen_domains) for r in rollups.history_window(events).collect()}
    assert got == want and set(rollups.history_window(events).columns) == {*events.columns, "revisit_count", "is_unique_domain", "foreground_seconds", "seen_domains"}


# ---- sketches


def test_sketches_merge_within_their_error(spark):
    events = spark.range(120_000).select((F.col("id") % 3).alias("g"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(id % 40 as int), 0, 0, 0)").alias("occurred_at"), F.when(F.col("id") % 50 > 0, F.col("id") % 30_011).alias("k"), F.when(F.col("id") % 7 > 0, (F.xxhash64("id") % 1000).cast("double")).alias("v"))
    daily = sketches.daily_sketches(events, ["g"], "k", "v").persist()
    low, high = F.lit("2024-01-03").cast("date"), F.lit("2024-01-31").cast("date")
    held = events.where("occurred_at >= '2024-01-03' and occurred_at < '2024-01-31'")
    got = {r.g: r for r in sketches.over_range(daily, ["g"], low, high, [0.1, 0.5, 0.95]).collect()}
    for r in held.groupBy("g").agg(F.count("*").alias("events"), F.sum("v").alias("total"), F.count_distinct("k").alias("k"), F.sort_array(F.collect_list("v")).alias("v")).collect():
        assert (got[r.g].events, got[r.g].total) == (r.events, r.total) and abs(got[r.g].distinct / r.k - 1) < 0.05
        for q, x in zip([0.1, 0.5, 0.95], got[r.g].quantiles, strict=True):
            assert abs(np.searchsorted(r.v, x) / len(r.v) - q) < 0.0133 * 2
    nothing = sketches.daily_sketches(events.limit(3).withColumns({"k": F.lit(None).cast("bigint"), "v": F.lit(None).cast("double")}), ["g"], "k", "v")
    assert {(r.events, r.total, r.distinct, tuple(r.quantiles)) for r in sketches.over_range(nothing, ["g"]).collect()} == {(1, 0.0, 0, (None, None))}
    assert sketches.over_range(daily.limit(0), ["g"]).count() == 0


def test_members_are_counted_exactly(spark):
    """A sketch of so many values is off by some dozens; nulls are no member, a value on many days is one."""
    events = spark.range(60_000).select((F.col("id") % 2).alias("g"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(id % 40 as int), 0, 0, 0)").alias("occurred_at"), F.when(F.col("id") % 50 > 0, F.col("id") % 9_001).alias("k"))
    daily = sketches.daily_members(events, ["g"], "k")
    low, high = F.lit("2024-01-03").cast("date"), F.lit("2024-01-31").cast("date")
    want = {r.g: r.n for r in events.where("occurred_at >= '2024-01-03' and occurred_at < '2024-01-31'").groupBy("g").agg(F.count_distinct("k").alias("n")).collect()}
    assert {r.g: r.distinct for r in sketches.members_over_range(daily, ["g"], low, high).collect()} == want and min(want.values()) > 7_000
