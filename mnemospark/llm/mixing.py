"""Mixing sources to target weights by drawing fixed-length blocks of tokens.

Each source's documents are laid on a line of tokens that is cut into blocks. Every output shard draws, from a
multinomial over the sources given their quotas, how many of its slots each source fills; a source's slots are
numbered through, and a pseudorandom permutation maps the numbers to its blocks, one pass over all blocks after
another. A join by block index then says which words of which documents the mix takes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import blank, bound_batches, materialize

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most this many times its size, and so does each of its documents.
MOST_REPEATS = 3
#: Words in a block, slots in an output shard.
BLOCK_WORDS, SHARD_SLOTS = 64, 4096
#: A source's token line has so many lanes at least, and more where they would hold over LANE_ROWS rows, so that no task holds a whole source.
LEAST_LANES, LANE_ROWS = 512, 20_000
#: Shards that are drawn together, and tasks that draw.
STRETCH, TASKS = 16, 10_000
#: Counts under which numpy draws hypergeometric numbers; larger ones are brought down to such by exact steps. Draws that are made one by one.
NUMPY_DRAWS, FEW_DRAWS = 10**9, 64
#: Rounds of the permutations' Feistel network.
ROUNDS = 6


def word_count(text: str) -> Column:
    """Number of maximal runs without ASCII white space; 0 for null."""
    return F.regexp_count(blank(text), F.lit("[^ \\t-\\r]+")).cast("bigint")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights share the whole, capped at MOST_REPEATS sizes.

    What a cap cuts off is shared again by weight until no source is above its cap. That is a water level: with the
    sources in order of cap over weight, the first of them are capped and the rest share what is left by weight. One
    row per source passes through a single task.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    capped = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MOST_REPEATS))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levels = capped.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    # the first open source in this order sets the level of all that follow
    final = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return levels.select("source", "source_size", F.least("cap", F.coalesce(final * F.col("weight"), F.col("cap"))).alias("target"))


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` draws without replacement are good, at any size.

    The draws are the smallest of independent uniform numbers, one for each good and bad one. So where a population is
    beyond numpy, a place is drawn that cuts it: the k-th smallest good number has a beta distribution, and the bad ones
    below it are binomial. What lies below is either all drawn, or holds all draws; either way what is left to decide
    is a far smaller sample, or by symmetry a far smaller rest.
    """
    if not good or not sample:
        return 0
    if sample >= good + bad or not bad:
        return min(good, sample)
    if max(good, bad) < NUMPY_DRAWS:
        return int(rng.hypergeometric(good, bad, sample))
    if 2 * sample > good + bad:
        return good - _hypergeometric(rng, good, bad, good + bad - sample)
    if sample <= FEW_DRAWS:
        found = 0
        for done in range(sample):
            found += int(rng.integers(good + bad - done)) < good - found
        return found
    k = max(1, min(good, round(sample * (good / (good + bad)))))
    below = int(rng.binomial(bad, rng.beta(k, good - k + 1)))
    if k + below <= sample:
        return k + _hypergeometric(rng, good - k, bad - below, sample - k - below)
    return _hypergeometric(rng, k - 1, below, sample)


def shard_slots(quotas: list[int], seed: int, wanted: range) -> Iterator[tuple[int, int, int, int]]:
    """(source's place, shard, first slot, slots) of the shards in ``wanted``: multinomial counts given the quotas.

    Multinomial draws of all shards, given how much each source has in all, are the quotas dealt out at random. A tree
    over the shards does that: the draws of a node's left half are multivariate hypergeometric, those of the right
    half what is left. Every shard follows from the seed by the nodes above it alone, and so do the numbers of its
    slots among all slots of the source.
    """
    total = sum(quotas)

    def size(low: int, high: int) -> int:
        return min(total, high * SHARD_SLOTS) - min(total, low * SHARD_SLOTS)

    stack = [(0, -(-total // SHARD_SLOTS), list(quotas), [0] * len(quotas))]
    while stack:
        low, high, counts, first = stack.pop()
        if high <= wanted.start or low >= wanted.stop or low >= high:
            continue
        if high - low == 1:
            yield from ((s, low, first[s], n) for s, n in enumerate(counts) if n)
            continue
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        sample, rest, left = size(low, middle), size(low, high), []
        for n in counts:
            rest -= n
            left.append(_hypergeometric(rng, n, rest, sample))
            sample -= left[-1]
        stack.append((middle, high, [n - k for n, k in zip(counts, left, strict=True)], [f + k for f, k in zip(first, left, strict=True)]))
        stack.append((low, middle, left, first))


def permuted(x: np.ndarray, n: int, key: tuple[int, ...]) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n-1 at the places ``x``: a Feistel network over the least even number of
    bits that holds n; what falls outside walks on until it is inside (Black & Rogaway, 2002)."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    rounds = np.random.default_rng(key).integers(0, 1 << 63, (ROUNDS, 2), dtype=np.uint64)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        v = out[todo]
        left, right = v >> bits, v & mask
        for a, b in rounds:
            h = (right + a) * (b | np.uint64(1))
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask)
        out[todo] = left << bits | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def drawn_blocks(targets: DataFrame, seed: int) -> DataFrame:
    """(sid, block, times): how often the mix takes each block of each source.

    Each task draws the counts of a stretch of shards and maps their slots, pass by pass, through the source's
    permutation of that pass. The sources (one row each) are known to all tasks.
    """
    sources = [(r.sid, r.quota, r.blocks) for r in targets.select("sid", "quota", "blocks").where("quota > 0").orderBy("sid").collect()]  # one row per source
    shards = -(-sum(q for _, q, _ in sources) // SHARD_SLOTS)
    spark = targets.sparkSession
    if not shards:
        return spark.createDataFrame([], "sid bigint, block bigint, times bigint")

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for first in pdf["id"]:
                for s, _, start, n in shard_slots([q for _, q, _ in sources], seed, range(first * STRETCH, (first + 1) * STRETCH)):
                    sid, _, blocks = sources[s]
                    epoch, place = np.divmod(np.arange(start, start + n), blocks)
                    found = [permuted(place[epoch == e], blocks, (seed, sid, int(e))) for e in np.unique(epoch)]
                    block, times = np.unique(np.concatenate(found), return_counts=True)
                    yield pd.DataFrame({"sid": sid, "block": block, "times": times})

    stretches = -(-shards // STRETCH)
    drawn = spark.range(0, stretches, 1, min(stretches, TASKS)).mapInPandas(draw, "sid bigint, block bigint, times bigint")
    # written, as Spark would take the draws to be as small as the range that they come from, and broadcast them
    return materialize(drawn.groupBy("sid", "block").agg(F.sum("times").alias("times")), sum(b for _, _, b in sources))


def draw_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, rid: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(spans, drawn): where every row's words lie on the blocks of its source, and which blocks are drawn how often.

    spans: rid, key, size, source_size, target, sid, start; drawn: sid, block, times. The key may be null or repeat;
    ``rid`` names a column that tells rows apart, without one they get numbers that hold in the result only. Rows that
    share a key are placed by a hash of their texts, so a frequent key is spread over the lanes as well.
    """
    number = F.monotonically_increasing_id() if rid is None else F.col(rid)
    rows = materialize(docs.select(number.alias("rid"), F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(blank(text)).alias("words")))
    count = rows.count()
    rows = rows.withColumn("lane", F.pmod(F.xxhash64("key", "words", F.lit(seed)), F.lit(max(LEAST_LANES, 1 << (count // LANE_ROWS).bit_length()))))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = targets.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).cast("bigint"))
    targets = targets.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK_WORDS))
    targets = materialize(targets.withColumn("quota", F.least(F.round(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)) * F.col("blocks")), F.col("blocks") * MOST_REPEATS).cast("bigint")), 1)
    lanes = rows.groupBy("source", "lane").agg(F.sum("size").alias("lane_size"))
    lanes = lanes.withColumn("lane_start", F.coalesce(F.sum("lane_size").over(Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lanes = lanes.alias("l").join(targets.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source"))).select("sid", "l.source", "lane", "lane_start", "source_size", "target")
    inside = Window.partitionBy("source", "lane").orderBy(F.col("key").isNull(), "key", "size", "words").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    spans = placed.alias("r").join(lanes.alias("n"), F.col("r.source").eqNullSafe(F.col("n.source")) & (F.col("r.lane") == F.col("n.lane")))
    spans = materialize(spans.select("rid", "key", "size", "source_size", "target", "sid", (F.col("lane_start") + F.col("offset")).alias("start")), count)
    return spans, drawn_blocks(targets, seed)


def _pieces(spans: DataFrame, drawn: DataFrame) -> DataFrame:
    """One row per row and block that it lies on: rid, sid, start, the words' range in the document, times."""
    first, last = F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)
    on = spans.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("start"), F.col("block") * BLOCK_WORDS) - F.col("start")
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS) - F.col("start")
    return on.withColumn("low", low).withColumn("high", high).join(drawn, ["sid", "block"])


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """What the mix takes of every row: key, size, source_size, target, taken.

    A null text has no words; null is a source of its own, the last one; empty texts have size 0 and give nothing. A
    source gives whole blocks, so ``taken`` over a source is within one block of its target for its last, short
    block. No row gives more than MOST_REPEATS times its size. Rows that repeat a key are separate documents. The
    same rows and seed give the same mix. An empty table gives an empty result; other columns are left aside.
    """
    spans, drawn = draw_blocks(docs, key, text, source, seed)
    taken = _pieces(spans, drawn).groupBy("sid", "start").agg(F.sum((F.col("high") - F.col("low")) * F.col("times")).alias("taken"))
    out = spans.alias("s").join(taken.alias("t"), (F.col("s.sid") == F.col("t.sid")) & (F.col("s.start") == F.col("t.start")) & (F.col("s.size") > 0), "left")
    return out.select(F.col("key").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """The mix as rows with the columns of ``docs``: each row comes once per pass in which blocks of it are drawn.

    Its text is then the drawn words, with the white space between them; runs that are not adjacent are joined by a
    line feed. Rows without words are in no block and so in no mix. Rows with a null key, and rows that repeat one, are
    documents of their own with their own draws. The rows are written once with a number each, by which they meet
    their draws again.
    """
    bound_batches(docs.sparkSession)
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    rows = materialize(docs.select(row, F.monotonically_increasing_id().alias("rid")))
    named = rows.select("rid", *[F.col("row").getField(c).alias(n) for c, n in ((key, "key"), (text, "text"), (source, "source"))])
    spans, drawn = draw_blocks(named, "key", "text", "source", seed, "rid")
    passes = _pieces(spans, drawn).select("rid", "low", "high", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("pass"))
    takes = passes.groupBy("rid", "pass").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("runs"))  # bounded by one text's blocks
    takes = takes.groupBy("rid").agg(F.collect_list("runs").alias("passes"))
    joined = rows.join(takes, "rid").select("row", F.explode("passes").alias("runs"))

    @F.pandas_udf("string")
    def words_of(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([take_words(t or "", r) for t, r in zip(texts, runs, strict=True)])

    return joined.withColumn("taken", words_of(F.col("row").getField(text), "runs")).select(*[(F.col("taken") if c == text else F.col("row").getField(c)).alias(c) for c in columns])


def take_words(text: str, runs: list) -> str:
    """The words of the ranges [low, high), with what stands between them."""
    at = [m.span() for m in re.finditer("[^ \\t-\\r]+", text)]
    merged: list[list[int]] = []
    for run in runs:
        low, high = run["low"], min(run["high"], len(at))
        if low >= high:
            continue
        if merged and merged[-1][1] == low:
            merged[-1][1] = high
        else:
            merged.append([low, high])
    return "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in merged)
