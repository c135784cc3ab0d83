"""What was known before an event: versions of topic centroids, and how near an event comes to one of them.

A topic's centroid changes whenever it gains passages. Its versions are kept with the time from which, and up to which,
they held, so that an event meets the centroids of its own time and not those that came to be later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.arrow import bound_batches
from mnemospark.functions.intervals import join_moments
from mnemospark.operators.retrieval import PLACES, unit_rows

DAY = 86_400
#: Novelty of an event of which nothing is known, or before which no topic was.
UNKNOWN = 0.5
#: The day of a row without a time, before all others.
NEVER = -1_000_000_000


def day_of(at: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(at.cast("date")).cast("bigint")


def centroid_versions(passages: DataFrame, topic: str = "topic", at: str = "captured_at", vector: str = "embedding") -> DataFrame:
    """(topic, from_day, to_day, members, centroid) of passages (topic, at, vector): the mean of a topic's vectors captured
    before ``from_day``, until the next day before which it gained some (null: still).

    A day's vectors are summed before they are shuffled; the running sums of a topic are as many as its days. Vectors
    of another width than the topic's widest that day are not seen in the missing places; null and broken vectors are left out.
    """
    good = passages.select(F.col(topic).alias("topic"), (day_of(F.col(at)) + 1).alias("from_day"), F.col(vector).cast("array<double>").alias("v"))
    good = good.where("topic is not null and from_day is not null and size(v) > 0").where(F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    sums = good.select("topic", "from_day", F.posexplode("v").alias("pos", "x")).groupBy("topic", "from_day", "pos").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    days = sums.groupBy("topic", "from_day").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("sum"))
    each = days.select("topic", "from_day", "n", F.posexplode("sum").alias("pos", "x"))
    upto = Window.partitionBy("topic", "pos").orderBy("from_day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = each.withColumns({"x": F.sum("x").over(upto), "members": F.sum("n").over(upto)})
    whole = running.groupBy("topic", "from_day").agg(F.max("members").alias("members"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("sum"))
    following = Window.partitionBy("topic").orderBy("from_day")
    out = whole.withColumn("to_day", F.lead("from_day").over(following))
    return out.select("topic", "from_day", "to_day", "members", F.transform("sum", lambda x: x / F.col("members")).alias("centroid"))


def known_likeness(rows: DataFrame, versions: DataFrame, key: str, at: str, vector: str = "embedding") -> DataFrame:
    """(key, known_topics, topic, likeness) of rows (key, at, vector): how many topics had a centroid on the row's day, and the nearest (ties: the smallest topic).

    The days of the rows are joined with the versions that held on them; the vectors of a day then meet its centroids
    in parts, so that a busy day is more than one task. A row without a usable vector, or before any topic, has no likeness.
    """
    bound_batches(rows.sparkSession)
    asked = rows.select(F.col(key).alias("key"), F.coalesce(day_of(F.col(at)), F.lit(NEVER)).alias("day"), F.col(vector).cast("array<double>").alias("v"))
    days = asked.select("day").distinct()
    known = join_moments(versions, F.col("from_day"), F.col("to_day"), days, F.col("day")).select("day", "topic", "centroid")
    parts = asked.groupBy("day").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    left = asked.join(parts, "day").select("day", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), "key", "v")
    right = known.join(parts, "day").select(F.col("day").alias("own_day"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own_part"), "topic", "centroid")
    types = {c: f.dataType.simpleString() for c, f in (("key", left.schema["key"]), ("topic", right.schema["topic"]))}

    def run(rows: pa.Table, there: pa.Table) -> pa.Table:
        there = there.sort_by("topic")
        topics, held = there["topic"].combine_chunks(), there["centroid"].combine_chunks()
        vectors = rows["v"].combine_chunks()
        best, like = np.full(rows.num_rows, -1), np.full(rows.num_rows, -np.inf)
        widths = np.unique(pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False)) if len(held) else []
        for w in widths:
            at, m = unit_rows(held, int(w))
            own, v = unit_rows(vectors, int(w))
            if len(at) and len(own):
                near = np.round(v @ m.T, PLACES)
                best[own], like[own] = at[near.argmax(axis=1)], near.max(axis=1)
        found = best >= 0
        places = pa.array(np.maximum(best, 0), mask=~found)
        chosen = topics.take(places) if len(topics) else pa.nulls(rows.num_rows, topics.type)
        return pa.table([rows["key"], pa.array(np.full(rows.num_rows, there.num_rows)), chosen, pa.array(like, mask=~found)], names=["key", "known_topics", "topic", "likeness"])

    met = left.groupBy("day", "part").cogroup(right.groupBy("own_day", "own_part")).applyInArrow(run, f"key {types['key']}, known_topics bigint, topic {types['topic']}, likeness double")
    return met.withColumnRenamed("key", key)


#: Rows of a day that meet its centroids in one task.
PART = 4096


def novelty(likeness: Column) -> Column:
    """1 less the likeness, between 0 and 1; UNKNOWN without one."""
    return F.when(likeness.isNull(), F.lit(UNKNOWN)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - likeness)))
