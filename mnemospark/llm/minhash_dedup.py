"""MinHash near-deduplication with sequential Bayesian verification (after BayesLSH, Satuluri & Parthasarathy, 2012).

Identical shingle sets collapse first. The signatures of the rest are banded; documents that share a band are
candidates. A candidate pair's signatures are compared batch by batch, and the pair is dropped as soon as the
posterior probability that it is similar enough falls below a chosen miss probability. Survivors are verified on
their full shingle sets.

No bucket is expanded into its pairs. First every member of a bucket meets the bucket's smallest member, in blocks
of documents that mostly share their buckets; what is banded there is compared, and most groups are connected. Only
where a bucket's other members still lie in different components, they are compared in slices inside tasks, and those
that may link across components meet in blocks once more. Pairs inside a component need no comparison: their link
would change nothing. What leaves a task is bounded by its documents, not by its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.bloom import filter_of, only_possible, with_flag
from mnemospark.llm.common import blank, bound_batches, map_text, materialize, split_join, worker_state
from mnemospark.llm.components import connected_components

#: Words in a shingle, and the similarity of a link, in hundredths.
SHINGLE, SIMILAR = 5, 75
#: Bands and rows: a pair at the threshold shares no band with probability (1 - 0.75 ** 5) ** 45 = 5e-6.
BANDS, ROWS = 45, 5
HASHES = BANDS * ROWS
#: Signature positions compared at a time, and the posterior probability under which a pair is dropped.
BATCH, MISS = 16, 1e-6
#: Documents, and shingles of all of them, in a block whose sets meet in one task; members of a bucket in a slice whose signatures do.
BLOCK, BLOCK_SHINGLES, SLICE = 256, 400_000, 2048
#: Distinct words whose hashes a worker remembers.
CACHE_WORDS = 100_000

_rng = np.random.default_rng(20240501)
_MULTIPLY = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TOGGLE = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """A 64-bit hash of each word, computed once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = h
        return h


def shingles(text: bytes) -> np.ndarray:
    """The sorted set of 64-bit hashes of a text's five-word shingles; of all its words if there are fewer; empty without words.

    Words are runs without ASCII white space, A-Z in lower case; bytes.lower and bytes.split do just that.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = worker_state("minhash", _Words)
    if len(known) > CACHE_WORDS:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out * _STEP + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a set; the functions are permutations of 32-bit numbers."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    for start in range(0, len(x), 512):
        h = x[None, start : start + 512] * _MULTIPLY[:, None]
        h ^= _TOGGLE[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(out, h.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * _STEP + rows[:, k])
    return key.view(np.int64)


@lru_cache(maxsize=4)
def least_matches(miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """(n, m): after n compared positions a pair needs m matches, or P(similarity >= threshold) is under ``miss``.

    The prior is uniform, so after m of n matches the posterior is a Beta(m + 1, n - m + 1), integrated on a grid.
    """
    grid = (np.arange(200_000) + 0.5) / 200_000
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(log - log.max())
            if density[grid >= SIMILAR / 100].sum() / density.sum() >= miss:
                out.append((n, m))
                break
    return tuple(out)


def bayes_survivors(a: np.ndarray, b: np.ndarray, sig_a: np.ndarray, sig_b: np.ndarray) -> np.ndarray:
    """Of pairs (a[i], b[i]) of rows of the two signature matrices: the indexes that no batch prunes."""
    live = np.arange(len(a))
    match = np.zeros(len(a), np.int32)
    for n, least in least_matches():
        cols = slice(n - BATCH, n)
        match = match + (sig_a[a[live], cols] == sig_b[b[live], cols]).sum(axis=1, dtype=np.int32)
        stay = match >= least
        live, match = live[stay], match[stay]
        if not len(live):
            break
    return live


def sketch(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, set_key (digest of the set; null if empty), sig (16 bits a position), bands."""

    def run(columns: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
        sets = [shingles(t) for t in texts]
        sigs = [signature(s) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays(
            [
                *columns,
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([None if s is None else s.astype(np.uint16).tobytes() for s in sigs], pa.binary()),
                pa.array([None if s is None else band_keys(s) for s in sigs], pa.list_(pa.int64())),
            ],
            ["doc_id", "text_hash", "n_shingles", "set_key", "sig", "bands"],
        )

    return map_text(_named(docs, key, text), run, "doc_id bigint, text_hash bigint, n_shingles bigint, set_key binary, sig binary, bands array<bigint>")


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(blank(text)).alias("text_hash"), F.col(text).cast("binary").alias("text"))


def blocks_of(shared: DataFrame, rows: int) -> DataFrame:
    """(sid, block) of all sets that share a bucket: at most about BLOCK of them, or BLOCK_SHINGLES shingles, to a block.

    A set's home starts as the smallest leader of its buckets and becomes the smallest home in any of them, so that
    sets that are compared with each other mostly have one home, and their texts meet once however many buckets they
    share. Two steps do not run along chains of groups.
    """
    homes = shared.groupBy("sid").agg(F.min("leader").alias("home"), F.first("n_shingles").alias("n_shingles"))
    by_band = split_join(shared.select("band", "sid"), homes, "sid").groupBy("band").agg(F.min("home").alias("home"))
    homes = materialize(split_join(shared.select("band", "sid", "n_shingles"), by_band, "band").groupBy("sid").agg(F.min("home").alias("home"), F.first("n_shingles").alias("n_shingles")), rows)
    sizes = homes.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).alias("parts"))
    return split_join(homes, sizes, "home").select("sid", F.xxhash64("home", F.pmod(F.xxhash64("sid"), F.col("parts"))).alias("block"))


def _meetings(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(i, j, sid): the sets of distinct pairs (a, b), at the pair of blocks where the two ends meet."""
    block = blocks.select(F.col("sid").alias("a"), F.col("block").alias("i"))
    dealt = split_join(split_join(pairs, block, "a"), block.withColumnRenamed("a", "b").withColumnRenamed("i", "j"), "b")
    ends = F.explode(F.array("a", "b")).alias("sid")
    return dealt.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), ends).distinct()


class _Block:
    """Sets that meet in one task, with their documents, signatures and components."""

    def __init__(self, docs: list[int], components: list[int], sets: list[np.ndarray]):
        self.docs, self.sets = np.array(docs, np.int64), sets
        self.sigs = np.array([signature(s) for s in sets])
        self.bands = np.array([band_keys(s) for s in self.sigs])
        self.size = np.array([len(s) for s in sets])
        self.root = np.unique(np.array(components, np.int64), return_inverse=True)[1]

    def links(self) -> list[tuple[int, int]]:
        """Links between different components, each joining the two: banded pairs, pruned by signatures, verified on the sets."""
        out = []
        for a in range(len(self.docs) - 1):
            near = (self.root[a + 1 :] != self.root[a]) & (np.minimum(self.size[a + 1 :], self.size[a]) * 100 >= SIMILAR * np.maximum(self.size[a + 1 :], self.size[a]))
            b = a + 1 + np.flatnonzero(near)
            b = b[(self.bands[b] == self.bands[a]).any(axis=1)]
            if not len(b):
                continue
            for k in b[bayes_survivors(np.zeros(len(b), np.int64), b, self.sigs[a : a + 1], self.sigs)].tolist():
                if self.root[k] == self.root[a]:
                    continue
                p, q = self.sets[a], self.sets[k]
                same = len(np.intersect1d(p, q, assume_unique=True))
                if same and 100 * same >= SIMILAR * (len(p) + len(q) - same):
                    self.root[self.root == self.root[k]] = self.root[a]
                    out.append((int(self.docs[a]), int(self.docs[k])))
        return out


def verify(docs: DataFrame, entries: DataFrame, need: DataFrame, rows: int, key: str, text: str, components: DataFrame | None = None) -> DataFrame:
    """Links (a, b) among the documents whose sets meet (i, j, sid), as far as they connect what is not connected yet; a written table.

    Each text goes once to every pair of blocks that needs it; a task holds the sets of one pair of blocks. All banded
    pairs there are considered, so that one link is enough for each component. A set is that of the row of ``docs``
    with its key and text hash. ``components``: (node, component) so far.
    """
    need = split_join(need, entries.select("sid", "doc_id", "text_hash"), "sid")
    need = need.withColumn("component", F.col("doc_id")) if components is None else split_join(need, components.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    wanted = materialize(need.select("i", "j", "sid", "doc_id", "text_hash", F.coalesce("component", "doc_id").alias("component")), rows)
    if not wanted.head(1):
        return docs.sparkSession.createDataFrame([], "a bigint, b bigint")
    texts = only_possible(_named(docs, key, text).where("doc_id is not null"), "doc_id", wanted.select("doc_id").distinct())
    given = wanted.join(texts.dropDuplicates(["doc_id", "text_hash"]), ["doc_id", "text_hash"]).select("i", "j", "sid", "doc_id", "component", "text")
    together = given.repartition("i", "j").sortWithinPartitions("i", "j", "sid")
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        held: dict[int, tuple] = {}

        def links() -> pa.RecordBatch:
            found = _Block(*map(list, zip(*held.values(), strict=True))).links()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for x in batches:
            for i, j, sid, doc, component, t in zip(*(c.to_pylist() for c in x.columns), strict=True):
                if (i, j) != now:
                    if len(held) > 1:
                        yield links()
                    now, held = (i, j), {}
                held[sid] = (doc, component, shingles(t or b""))
        if len(held) > 1:
            yield links()

    return materialize(together.mapInArrow(run, "a bigint, b bigint"), rows)


def _across(buckets: DataFrame, entries: DataFrame) -> DataFrame:
    """(i, j, sid): where sets of different components, that share a bucket and survive the signatures, are to meet.

    Buckets: (band, nth, sid, component, block). A large bucket is compared in slices inside tasks; a task's result
    has one row for each of its sets, and a pair counts in the first band that it shares.
    """
    count = buckets.groupBy("band").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    members = split_join(buckets, count, "band").withColumn("slice", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("slices")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    members = members.select("band", F.least("slice", "other").alias("low"), F.greatest("slice", "other").alias("high"), "slice", "nth", "sid", "component", "block")
    rows = split_join(members, entries.select("sid", "sig", "n_shingles"), "sid")
    rows = rows.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "slice").select("band", "low", "high", "slice", "nth", "sid", "component", "block", "n_shingles", "sig")
    bound_batches(buckets.sparkSession)

    def compare(held: list[tuple]) -> pa.RecordBatch:
        part, nth, doc, comp, block, n = (np.array(c, np.int64) for c in list(zip(*held, strict=True))[:6])
        sig = np.frombuffer(b"".join(h[6] for h in held), np.uint16).reshape(-1, HASHES)
        first, last, before = part[0], part[-1], int(nth[0])
        found = []
        for a in np.flatnonzero(part == first):
            b = np.flatnonzero((part == last) & (comp != comp[a]) & (np.minimum(n, n[a]) * 100 >= SIMILAR * np.maximum(n, n[a])))
            b = b[b > a]
            if len(b):
                b = b[bayes_survivors(np.zeros(len(b), np.int64), b, sig[a : a + 1], sig)]
                b = b[~(sig[b, : before * ROWS] == sig[a, : before * ROWS]).reshape(len(b), before, ROWS).all(axis=2).any(axis=1)]
                if len(b):
                    i, j = np.minimum(block[a], block[b]), np.maximum(block[a], block[b])
                    found += [np.stack([doc[b], i, j]), np.unique(np.stack([np.full(len(b), doc[a]), i, j]), axis=1)]
        ids, i, j = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((3, 0), np.int64)
        own, begin = np.unique(ids, return_index=True)  # one row for each set
        meets = pa.ListArray.from_arrays(pa.array([*begin, len(ids)], pa.int32()), pa.StructArray.from_arrays([pa.array(i), pa.array(j)], ["i", "j"]))
        return pa.RecordBatch.from_arrays([pa.array(own), meets], ["sid", "meets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        held: list[tuple] = []
        for x in batches:
            for band, low, high, *row in zip(*(c.to_pylist() for c in x.columns), strict=True):
                if (band, low, high) != now:
                    if len(held) > 1:
                        yield compare(held)
                    now, held = (band, low, high), []
                held.append(tuple(row))
        if len(held) > 1:
            yield compare(held)

    found = rows.mapInArrow(run, "sid bigint, meets array<struct<i:bigint,j:bigint>>")
    each = found.groupBy("sid").agg(F.array_distinct(F.flatten(F.collect_set("meets"))).alias("meets"))
    return each.select("sid", F.explode("meets").alias("m")).select("m.i", "m.j", "sid")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept.

    Two documents link when 100 * |A & B| >= 75 * |A | B| over their shingle sets; the component is the smallest key
    that links reach. Null texts, and texts without words, have no shingles and link with nothing; so do rows with a
    null key, whose component is null and which are kept. Rows that repeat a key are one node of the graph with the
    sets of all of them. An empty table gives an empty result; other columns are left aside. A link is missed only if
    its signatures share no band (at most 5e-6 at the threshold), are pruned (MISS a batch, 1e-5 over the 14 batches), or
    look in their 16 bits a position as if an earlier band had been shared (2.5e-5).
    """
    return _near_duplicates(docs, key, text)[0]


def _near_duplicates(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """The rows of :func:`near_duplicates` and their number."""
    sketches = materialize(sketch(docs, key, text).withColumn("sid", F.monotonically_increasing_id()))
    rows = sketches.count()
    sets = sketches.where("set_key is not null and doc_id is not null").select("sid", "doc_id", "set_key", "n_shingles")
    heads = sets.groupBy("set_key").agg(F.min(F.struct("doc_id", "sid")).alias("h")).select("set_key", F.col("h.doc_id").alias("head"), F.col("h.sid").alias("head_sid"))
    placed_sets = materialize(split_join(sets, heads, "set_key").select("sid", "doc_id", "n_shingles", "head", "head_sid"), rows)
    copies = placed_sets.where("sid <> head_sid").select("sid")
    entries = materialize(sketches.where("set_key is not null and doc_id is not null").drop("set_key").join(copies, "sid", "left_anti"), rows)
    bands = entries.select("sid", "n_shingles", F.posexplode("bands").alias("nth", "band"))
    buckets = bands.groupBy("band").agg(F.min("sid").alias("leader"), F.count("*").alias("members")).where("members > 1")
    shared = materialize(split_join(bands, buckets, "band").select("band", "nth", "sid", "n_shingles", "leader", "members"), 4 * rows)
    pairs = shared.where("sid <> leader").select(F.col("leader").alias("a"), F.col("sid").alias("b")).distinct()
    blocks = materialize(blocks_of(shared, rows), rows)
    links = verify(docs, entries, _meetings(pairs, blocks), rows, key, text)
    # documents with several sets connect these
    several = placed_sets.groupBy("doc_id").agg(F.min("head").alias("a"), F.max("head").alias("top")).where("a <> top")
    links = links.unionByName(split_join(placed_sets.select("doc_id", F.col("head").alias("b")), several.select("doc_id", "a"), "doc_id").select("a", "b").distinct())
    found = materialize(connected_components(links), rows)
    placed = split_join(shared.where("members > 2 and sid <> leader").select("band", "nth", "sid"), entries.select("sid", "doc_id"), "sid")
    placed = split_join(placed, found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_bands = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    still = split_join(split_join(placed, open_bands, "band").select("band", "nth", "sid", "component"), blocks, "sid")
    more = verify(docs, entries, _across(still, entries), rows, key, text, found)
    component = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)) if more.head(1) else found
    classes = split_join(placed_sets.select("doc_id", "n_shingles", F.col("head").alias("node")), component, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    alone = sketches.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = classes.unionByName(_with_their_key(alone, placed_sets, component))
    return out.select(F.col("doc_id").alias(key), "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), rows


def _with_their_key(alone: DataFrame, placed_sets: DataFrame, component: DataFrame) -> DataFrame:
    """Rows without shingles, with the component of another row of the same key where there is one."""
    keys = alone.select("doc_id").where("doc_id is not null").distinct()
    of_key = split_join(placed_sets.join(keys, "doc_id", "left_semi").select("doc_id", F.col("head").alias("node")), component, "node", "left")
    of_key = of_key.groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("other"))
    return split_join(alone, of_key, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("other", "component_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, of which :func:`near_duplicates` keeps one document of each group.

    Rows without shingles or without a key stay; rows that repeat a key stay or go together. Only rows that a Bloom
    filter of the lost keys lets through shuffle. An empty table gives an empty result.
    """
    found, rows = _near_duplicates(docs, key, text)
    lost = materialize(found.where("not kept").select(F.col(key).alias("__key")).distinct(), rows)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    flagged = with_flag(docs.select(row, F.col(key).cast("bigint").alias("__key")), "__key", *filter_of(lost, "__key", lost.count()), "__maybe")
    stay = flagged.where("__maybe").join(lost, "__key", "left_anti")
    return flagged.where("not __maybe").select("__row.*").unionByName(stay.select("__row.*"))
