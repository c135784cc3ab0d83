"""An inverted file of vectors: lists around centroids, searched by a join of queries and lists.

Centroids are fitted on a bounded sample; every row is in the list of its nearest one, with its distance to it. By the
triangle inequality a row of a list is at least | d(query, centroid) - d(row, centroid) | from a query, so that a list
whose nearest possible row is farther than the k-th found so far is never looked at. A search first probes the lists
nearest to a query, which gives that k-th, then joins only the lists that can still hold a nearer row: the result is exact.
With ``probes`` it stops after the first step. Lists meet queries in zones, some thousand rows at a time. Distances are those of unit vectors, so that order by them is order by cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from mnemospark.functions.arrow import bound_batches
from mnemospark.sources.scratch import materialize

#: Rows that centroids are fitted on (those whose keys have the smallest hashes), and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 8
#: Lists are as many as the square root of the rows, up to this many; their centroids are broadcast.
MOST_LISTS = 4096
#: Lists that a search probes first.
PROBES = 4
#: Rows, and queries, of a cell that meet in one task; larger cells are cut into blocks.
ROW_BLOCK, QUERY_BLOCK = 16_384, 8192
#: Rows by queries of one matrix product, and pairs that wait for the next cut to the k best.
STEP, WAITING = 1024, 1 << 19
#: Queries that are compared with all centroids at a time.
ROUTED = 256
#: Cells up to which their sizes are broadcast.
MOST_CELLS = 100_000
#: Digits of a similarity that count, and what that may change of a distance.
PLACES, SLACK = 9, 2e-9
#: The list of vectors of another width than the centroids'.
OTHER = -1


@dataclass(frozen=True)
class VectorIndex:
    """Rows (list, by, key, kept columns, vec: vector as stored, d: distance to the centroid), centroids and, of each list, its least and greatest d."""

    rows: DataFrame
    key: str
    keep: tuple[str, ...]
    by: str | None
    centroids: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def save(self, path: str) -> None:
        """Rows and lists as Parquet under a path, rows together by list."""
        spark = self.rows.sparkSession
        self.rows.repartition("list").sortWithinPartitions("list").write.parquet(f"{path}/rows")
        lists = [(i, c.tolist(), float(a), float(b)) for i, (c, a, b) in enumerate(zip(self.centroids, self.low, self.high, strict=True))]
        spark.createDataFrame(lists, "list int, centroid array<double>, low double, high double").coalesce(1).write.parquet(f"{path}/lists")

    @classmethod
    def load(cls, spark, path: str, key: str, keep: Sequence[str] = (), by: str | None = None) -> VectorIndex:
        held = spark.read.parquet(f"{path}/lists").orderBy("list").collect()  # MOST_LISTS rows at most
        return cls(spark.read.parquet(f"{path}/rows"), key, tuple(keep), by, np.array([h.centroid for h in held]).reshape(len(held), -1), *(np.array([h[c] for h in held], float) for c in ("low", "high")))


def _fit(sample: np.ndarray, lists: int) -> np.ndarray:
    """Unit centroids by spherical k-means, started at sample rows far from those taken before."""
    if not len(sample):
        return np.zeros((0, 0))
    taken = [0]
    like = sample @ sample[0]
    while len(taken) < min(lists, len(sample)) and like.min() < 1 - 1e-12:
        taken.append(int(like.argmin()))
        like = np.maximum(like, sample @ sample[taken[-1]])
    centroids = sample[taken]
    for _ in range(ROUNDS):
        own = np.concatenate([(sample[i : i + STEP] @ centroids.T).argmax(axis=1) for i in range(0, len(sample), STEP)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centroids)
    return centroids


def _distance(like: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * like))


def _unit(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, rows, unit vectors) of all usable vectors, a width after another."""
    from mnemospark.operators.retrieval import unit_rows

    widths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for w in np.unique(widths[widths > 0]):
        yield int(w), *unit_rows(column, int(w))


def _vector(frame: DataFrame, name: str) -> Column:
    """Vectors as they are stored: single precision stays so, which halves what moves, and is widened before it is worked on."""
    kind = frame.select(name).schema[0].dataType.simpleString()
    return F.col(name) if kind == "array<float>" else F.col(name).cast("array<double>")


def build(corpus: DataFrame, key: str, vector: str = "embedding", keep: Sequence[str] = (), by: str | None = None, lists: int | None = None) -> VectorIndex:
    """Index every usable vector (not null, not zero, finite). ``by``: a column (a user) whose value a query must share."""
    bound_batches(corpus.sparkSession)
    columns = [*([by] if by else []), key, *[c for c in keep if c not in (key, by)]]
    source = corpus.select(*columns, _vector(corpus, vector).alias("__v")).where("__v is not null" + (f" and `{by}` is not null" if by else ""))
    sample = source.select("__v").orderBy(F.xxhash64(key, F.col("__v").cast("array<double>"))).limit(SAMPLE).toArrow()["__v"].combine_chunks()
    fitting = max((v for _, _, v in _unit(sample)), key=len, default=np.zeros((0, 0)))  # the commonest width
    centroids = _fit(fitting, lists or min(MOST_LISTS, math.ceil(math.sqrt(source.count()))))
    held = corpus.sparkSession.sparkContext.broadcast(centroids)
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in columns) + f", list int, vec {source.schema['__v'].dataType.simpleString()}, d double"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, at, v in _unit(b.column(b.num_columns - 1)):
                near, d = np.full(len(at), OTHER, np.int32), np.zeros(len(at))
                for i in range(0, len(at) if w == held.value.shape[1] else 0, STEP):
                    like = v[i : i + STEP] @ held.value.T
                    near[i : i + STEP], d[i : i + STEP] = like.argmax(axis=1), _distance(like.max(axis=1))
                *kept, vec = (c.take(pa.array(at)) for c in b.columns)
                yield pa.RecordBatch.from_arrays([*kept, pa.array(near), vec, pa.array(d)], [*columns, "list", "vec", "d"])

    rows = materialize(source.mapInArrow(assign, schema))
    low, high = np.full(len(centroids), np.inf), np.full(len(centroids), -np.inf)
    for r in rows.where("list >= 0").groupBy("list").agg(F.min("d").alias("low"), F.max("d").alias("high")).collect():  # MOST_LISTS rows at most
        low[r.list], high[r.list] = r.low, r.high
    return VectorIndex(rows, key, tuple(c for c in columns if c not in (by, key)), by, centroids, low, high)


def _turns(d: np.ndarray) -> np.ndarray:
    """Of distances (query, list) the list's place among the query's, from the nearest."""
    turns = np.empty(d.shape, np.int32)
    np.put_along_axis(turns, np.argsort(d, axis=1, kind="stable"), np.arange(d.shape[1], dtype=np.int32)[None], axis=1)
    return turns


def _routes(queries: DataFrame, index: VectorIndex, first: int | None, least: float, zones: np.ndarray | None = None) -> DataFrame:
    """Queries (query_id, by, v, tau) with the lists that they go to, ``turn`` counting them from the nearest: the ``first``
    nearest, or with None all but the PROBES nearest that can hold a row as near as tau.

    With ``zones``, a zone for each list, there is a row a zone with the query's vector and, as bits, which of the zone's
    lists it goes to."""
    held = queries.sparkSession.sparkContext.broadcast((index.centroids, index.low, index.high))
    probed = PROBES if first is None else first
    fields = queries.select("query_id", "by").schema
    names = ["query_id", "by", *(["list", "turn"] if zones is None else ["zone", "lists", "vec", "tau"])]
    members = None if zones is None else [np.flatnonzero(zones == z) for z in range(zones.max(initial=-1) + 1)]

    def of(b: pa.RecordBatch, width: int, at: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        centroids, low, high = held.value
        if width != centroids.shape[1]:
            if first is not None:
                other = np.full(len(at), OTHER, np.int32)
                yield at, [pa.array(other), pa.array(np.zeros(len(at), np.int32)) if zones is None else pa.array([b""] * len(at), pa.binary())]
            return
        d = _distance(v @ centroids.T)
        d[:, low > high] = np.inf  # lists without rows
        turns = _turns(d)
        if first is not None:
            chosen = turns < probed
        else:
            tau = b.column(3).fill_null(-1.0).to_numpy()[at]
            reach = _distance(np.maximum(tau, least) - SLACK) + SLACK
            nearest = np.maximum(np.maximum(d - high, low - d), 0.0)
            chosen = (turns >= probed) & (nearest <= reach[:, None])
        chosen &= low <= high
        if zones is None:
            i, j = np.nonzero(chosen)
            yield at[i], [pa.array(j.astype(np.int32)), pa.array(turns[i, j])]
            return
        for z, lists in enumerate(members):
            went = np.flatnonzero(chosen[:, lists].any(axis=1))
            bits = np.packbits(chosen[np.ix_(went, lists)], axis=1)
            yield at[went], [pa.array(np.full(len(went), z, np.int32)), pa.array([x.tobytes() for x in bits], pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROUTED):
                b = batch.slice(start, ROUTED)
                for width, at, v in _unit(b.column(2)):
                    for rows, columns in of(b, width, at, v):
                        took = pa.array(rows)
                        own = [] if zones is None else [b.column(c).take(took) for c in (2, 3)]
                        yield pa.RecordBatch.from_arrays([b.column(0).take(took), b.column(1).take(took), *columns, *own], names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    more = "list int, turn int" if zones is None else f"zone int, lists binary, vec {queries.schema['v'].dataType.simpleString()}, tau double"
    return queries.select("query_id", "by", "v", "tau").mapInArrow(run, f"{schema}, {more}")


class _Nearest:
    """The k best rows of each query that were met so far, equal ones by the row's number; a row may be met more than once.

    ``floor`` is what a similarity must reach; it rises with the k-th best."""

    def __init__(self, k: int, floor: np.ndarray) -> None:
        self.k, self.floor, self.most = k, floor, max(WAITING, 4 * k * len(floor))
        self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.many = 0

    def meet(self, queries: np.ndarray, rows: np.ndarray, like: np.ndarray) -> None:
        """Similarities (row, query)."""
        floor = self.floor[queries]
        hits = like >= floor - SLACK
        if 0 < self.k < len(like) and np.count_nonzero(hits) > 4 * self.k * len(queries):
            hits = like >= np.maximum(floor, np.partition(like, len(like) - self.k, axis=0)[len(like) - self.k]) - SLACK
        i, j = np.nonzero(hits)
        self.waiting.append((queries[j], rows[i], np.round(like[i, j], PLACES)))
        self.many += len(i)
        if self.many > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, similarity) of the k best."""
        q, r, s = (np.concatenate(x) for x in zip(self.held, *self.waiting, strict=True))
        order = np.lexsort((-s, r, q))
        q, r, s = q[order], r[order], s[order]
        once = np.ones(len(q), bool)
        once[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1])
        q, r, s = q[once], r[once], s[once]
        order = np.lexsort((r, -s, q))
        q, r, s = q[order], r[order], s[order]
        turn = np.arange(len(q)) - np.searchsorted(q, q)
        last = turn == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        kept = turn < self.k
        self.held, self.waiting, self.many = (q[kept], r[kept], s[kept]), [], 0
        return self.held


def _product(best: _Nearest, q: np.ndarray, queries: np.ndarray, r: np.ndarray, codes: np.ndarray) -> None:
    """All these queries meet all these rows, which are in order of their codes; rows of one code count as the nearest of them."""
    for a in range(0, len(r), STEP):
        own = codes[a : a + STEP]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        for c in range(0, len(q), STEP):
            like = r[a : a + STEP] @ q[c : c + STEP].T
            best.meet(queries[c : c + STEP], own[starts], like if len(starts) == len(own) else np.maximum.reduceat(like, starts, axis=0))


def _meet(left: DataFrame, right: DataFrame, cell: list[str], key: str, keep: Sequence[str], k: int, least: float, grouped: bool, zones: np.ndarray | None = None) -> DataFrame:
    """(query_id, key, kept columns, similarity): of each query and block its k nearest rows, ties by key. Cells, the rows and the queries of a
    ``by`` (and a zone of lists), meet in blocks of ROW_BLOCK by QUERY_BLOCK, so that neither many rows nor many queries of one are one task."""
    asked = left.groupBy(*cell).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("asks"))
    there = right.groupBy(*cell).agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("parts"))
    sizes = materialize(asked.join(there, cell))
    if sizes.limit(MOST_CELLS + 1).count() <= MOST_CELLS:
        sizes = F.broadcast(sizes)  # else all vectors would move once more
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    bits = [] if zones is None else ["lists"]
    left = left.join(sizes, cell).select(*cell, block("query_id", "asks").alias("ask"), spread("parts").alias("part"), "query_id", "vec", "tau", *bits)
    right = right.join(sizes, cell).select(*cell, spread("asks").alias("ask"), block(key, "parts").alias("part"), key, *keep, "vec", *(["list"] if bits else []))
    names = [key, *keep]
    fields = left.select("query_id").schema.fields + right.select(*names).schema.fields
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", similarity double"
    empty = to_arrow_schema(type(left.schema)(fields)).append(pa.field("similarity", pa.float64())).empty_table()
    members = None if zones is None else [np.flatnonzero(zones == z) for z in range(zones.max(initial=-1) + 1)]

    def run(asked: pa.Table, there: pa.Table) -> pa.Table:
        if not asked.num_rows or not there.num_rows or k <= 0:
            return empty
        there = there.take(pc.sort_indices(there, sort_keys=[(key, "ascending")], null_placement="at_start"))
        keys = there[key].combine_chunks()
        codes = np.arange(there.num_rows)
        if grouped:
            coded = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            codes = np.flatnonzero(np.concatenate([[True], coded[1:] != coded[:-1]]))[np.cumsum(np.concatenate([[0], coded[1:] != coded[:-1]]))]  # a key's first row
        best = _Nearest(k, np.maximum(pc.fill_null(asked["tau"], -np.inf).to_numpy(), least))
        zone = OTHER if zones is None else there["zone"][0].as_py()
        questions = {w: (at, v) for w, at, v in _unit(asked["vec"].combine_chunks())}
        for w, at, r in _unit(there["vec"].combine_chunks()):
            if w not in questions:
                continue
            q_at, q = questions[w]
            if zone == OTHER:
                _product(best, q, q_at, r, codes[at])
                continue
            mine = members[zone]
            wants = np.frombuffer(b"".join(asked["lists"].take(pa.array(q_at)).to_pylist()), np.uint8).reshape(len(q_at), -1)
            wants = np.unpackbits(wants, axis=1)[:, : len(mine)].astype(bool)
            lists = there["list"].to_numpy()[at]
            order = np.argsort(lists, kind="stable")
            ends = np.searchsorted(lists[order], mine, "right")
            for n, (a, b) in enumerate(zip(np.searchsorted(lists[order], mine), ends, strict=True)):
                went = np.flatnonzero(wants[:, n])
                if a < b and len(went):
                    _product(best, q[went], q_at[went], r[order[a:b]], codes[at[order[a:b]]])
        q, r, s = best.cut()
        q, r, s = (x[s >= least] for x in (q, r, s))
        took = there.select(names).take(pa.array(r))
        return pa.table([asked["query_id"].take(pa.array(q)), *took.columns, pa.array(s)], names=["query_id", *names, "similarity"]).cast(empty.schema)

    group = [*cell, "ask", "part"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(run, out_schema)


def _zones(index: VectorIndex) -> np.ndarray:
    """Of each list its zone: lists near to each other, with about ROW_BLOCK rows of a ``by`` together."""
    there = index.rows.agg(F.count("*").alias("n"), (F.approx_count_distinct(index.by) if index.by else F.lit(1)).alias("owners")).first()
    many = -(-there.n // (max(1, there.owners) * ROW_BLOCK))
    if many <= 1 or not len(index.centroids):
        return np.zeros(len(index.centroids), np.int64)
    middles = _fit(index.centroids, many)
    return (index.centroids @ middles.T).argmax(axis=1)


def _asked(queries: DataFrame, index: VectorIndex, query_vector: str) -> DataFrame:
    by = F.col(index.by) if index.by else F.lit("")
    asked = queries.select("query_id", by.alias("by"), _vector(queries, query_vector).alias("v"), F.lit(None).cast("double").alias("tau"))
    return asked.where("v is not null and by is not null")


def _best(found: DataFrame, key: str, k: int, grouped: bool) -> DataFrame:
    if grouped:
        found = found.groupBy("query_id", key).agg(F.max("similarity").alias("similarity"))
    better = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return found.withColumn("rank", F.row_number().over(better)).where(F.col("rank") <= max(0, k))


def search(queries: DataFrame, index: VectorIndex, k: int, least: float = 0.0, query_vector: str = "query_embedding", grouped: bool = False, probes: int | None = None) -> DataFrame:
    """(query_id, key, kept columns, similarity, rank): the k nearest rows of each query at or above a cosine, ties by key.

    Exact by default; with ``probes`` only that many lists nearest to a query are looked at. A query meets rows of its
    own ``by`` if the index has one. ``grouped`` takes rows of one key as one, by the nearest of them. Queries and rows
    pass no driver and no broadcast: a query goes once to a zone of lists, however many of these it needs, and is held
    against their rows in blocks.
    """
    asked = materialize(_asked(queries, index, query_vector))
    zones = _zones(index)
    numbers = ", ".join(map(str, zones)) or "0"
    zone = F.expr(f"if(list < 0, {OTHER}, element_at(array({numbers}), greatest(list, 0) + 1))").cast("int").alias("zone")
    by = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if index.by else F.lit("")
    rows = index.rows.select(by(index.by).alias("__by"), zone, index.key, *index.keep, "vec", "list")

    def met(routes: DataFrame) -> DataFrame:
        return _meet(routes.withColumn("__by", by("by")), rows, ["__by", "zone"], index.key, index.keep, k, least, grouped, zones)

    first = met(_routes(asked, index, PROBES if probes is None else probes, least, zones))
    if probes is not None:
        return _best(first, index.key, k, grouped)
    near = materialize(_best(first, index.key, k, grouped))
    tau = near.where(F.col("rank") == k).select("query_id", F.col("similarity").alias("tau"))
    rest = met(_routes(asked.drop("tau").join(tau, "query_id", "left"), index, None, least, zones))
    return _best(near.drop("rank").unionByName(rest), index.key, k, grouped)


def search_all(queries: DataFrame, corpus: DataFrame, key: str, k: int, least: float = 0.0, vector: str = "embedding", query_vector: str = "query_embedding", keep: Sequence[str] = (), by: str | None = None, grouped: bool = False) -> DataFrame:
    """What :func:`search` gives, without an index: each query meets all rows (of its ``by``), in blocks. Rows move once."""
    bound_batches(corpus.sparkSession)
    keep = [] if grouped else [c for c in keep if c != key]
    own = (lambda: F.col(by).cast("string")) if by else (lambda: F.lit(""))
    rows = materialize(corpus.select(own().alias("__by"), key, *keep, _vector(corpus, vector).alias("vec")).where("vec is not null and __by is not null"))
    asked = materialize(queries.select(own().alias("__by"), "query_id", _vector(queries, query_vector).alias("vec"), F.lit(None).cast("double").alias("tau")).where("vec is not null and __by is not null"))
    return _best(_meet(asked, rows, ["__by"], key, keep, k, least, grouped), key, k, grouped)


def probes_for(queries: DataFrame, index: VectorIndex, k: int, wanted: float = 0.9, least: float = 0.0, query_vector: str = "query_embedding", exact: DataFrame | None = None) -> int:
    """The least number of probes with which ``queries``, searched exactly for it, find that share of their k nearest.

    What it takes depends on the vectors: where they lie in groups a few lists hold most neighbours, where they point
    anywhere most lists hold some. Give it a sample of queries like those to come; ``exact`` is what the exact search of
    these, or of more, has found, if that is known.
    """
    exact = search(queries, index, k, least, query_vector) if exact is None else exact
    found = exact.select("query_id", index.key).join(index.rows.select(index.key, "list").distinct(), index.key)
    asked = _asked(queries, index, query_vector).select("query_id", "v").join(found.groupBy("query_id").agg(F.collect_list("list").alias("lists")), "query_id")
    held = queries.sparkSession.sparkContext.broadcast((index.centroids, index.low, index.high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, low, high = held.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROUTED):
                b = batch.slice(start, ROUTED)
                for width, at, v in _unit(b.column(0)):
                    lists = b.column(1).take(pa.array(at))
                    numbers = lists.flatten().to_numpy(zero_copy_only=False)
                    turns = np.zeros(len(numbers), np.int32)  # vectors of another width have one list
                    if width == centroids.shape[1]:
                        d = _distance(v @ centroids.T)
                        d[:, low > high] = np.inf
                        turns = _turns(d)[np.repeat(np.arange(len(at)), lists.value_lengths().to_numpy()), numbers]
                    yield pa.RecordBatch.from_arrays([pa.array(turns)], ["turn"])

    held_turns = asked.select("v", "lists").mapInArrow(run, "turn int").groupBy("turn").count().orderBy("turn").collect()  # MOST_LISTS rows at most
    total, seen = sum(h["count"] for h in held_turns), 0
    for h in held_turns:
        seen += h["count"]
        if seen >= wanted * total:
            return h.turn + 1
    return 1


def recall(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """One row: queries, wanted (rows of the exact result), held (of them found), recall."""
    wanted = exact.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("there")), ["query_id", key], "left")
    return wanted.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("there").alias("held")).withColumn("recall", F.round(F.try_divide("held", "wanted"), 6))
