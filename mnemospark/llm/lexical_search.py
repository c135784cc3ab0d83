"""Ranked lexical search by scanning the documents: no index of them is made.

All terms that items ask for become one Aho-Corasick automaton, guarded at both ends by a separator, so that it meets
whole terms only. It is broadcast; each document is read through it once, which gives the term frequencies. Counts of
documents are summed in Spark, and each task ranks what it has scored, so that what leaves it is its best documents of
each item. Items go in blocks of a bounded size; each block is one scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import blank, bound_batches, materialize, slices, worker_state

#: Best documents of an item.
TOP = 10
#: Bytes of the terms of a block of items, and items in it; one item aside, which is whole.
BLOCK_BYTES, BLOCK_ITEMS = 1 << 22, 4096
#: Scores that are held at a time (documents by items), and products of terms and items.
CELLS = 1 << 20

#: Bytes of a text as the automaton sees them: A-Z lower-cased, digits, letters and bytes of other characters as they are, all else the guard.
GUARD = b" "
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else GUARD[0] for c in range(256))
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), 0))


def automaton(words: list[str]) -> ahocorasick.Automaton:
    """Outputs the place of a word in the list, once for each time that it stands between two guards; bytes stand for characters."""
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, w in enumerate(words):
        out.add_word((GUARD + w.encode() + GUARD).decode("latin-1"), i)
    out.make_automaton()
    return out


def scan(text: bytes, found: ahocorasick.Automaton) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of terms with repeats, places of the asked terms, their frequencies) of a whole text."""
    plain = GUARD + text.translate(TABLE) + GUARD
    inside = np.frombuffer(plain, np.uint8) != GUARD[0]
    n = int(np.count_nonzero(inside[1:] & ~inside[:-1]))
    hits = np.fromiter((i for _, i in found.iter(plain.decode("latin-1"))), np.int32) if len(found) else np.zeros(0, np.int32)
    return n, *np.unique(hits, return_counts=True)


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """(key, terms) of the items in blocks, one after another through the driver; rows that repeat a key are one item."""
    asked = items.select(F.col(f"`{key}`").alias("item"), F.explode(terms(F.col(f"`{text}`"))).alias("term")).groupBy("item").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    block: list[tuple] = []
    held: set[str] = set()
    size = 0
    for row in asked.orderBy("item").toLocalIterator():
        new = sum(len(t.encode()) for t in row.terms if t not in held)
        if block and (size + new > BLOCK_BYTES or len(block) == BLOCK_ITEMS):
            yield block
            block, held, size, new = [], set(), 0, sum(len(t.encode()) for t in row.terms)
        block.append((row.item, row.terms))
        held.update(row.terms)
        size += new
    if block:
        yield block


def _counts(documents: DataFrame, key: str, text: str, words: Broadcast) -> DataFrame:
    """(doc, n, terms, tfs) of the documents that have any term."""
    name = f"lexical-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = worker_state(name, lambda: automaton(words.value))
        for batch in batches:
            for x in slices(batch, 1):
                rows = [(i, *scan(t or b"", found)) for i, t in enumerate(x.column(1).to_pylist())]
                rows = [r for r in rows if r[1]]
                ends = np.cumsum([0, *[len(r[2]) for r in rows]]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *[r[k] for r in rows]]).astype(kind))) for k, kind in ((2, np.int32), (3, np.int64))]
                yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), *lists], ["doc", "n", "terms", "tfs"])

    bound_batches(documents.sparkSession)
    rows = documents.select(F.col(f"`{key}`").cast("bigint").alias("doc"), F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc bigint, n bigint, terms array<int>, tfs array<bigint>")


def weight(documents: Column, df: Column) -> Column:
    """floor(1000 * ln((2 * N + 2) / (2 * df + 1))), in doubles."""
    return F.floor(F.lit(1000.0) * F.ln((F.lit(2.0) * documents + F.lit(2.0)) / (F.lit(2.0) * df + F.lit(1.0)))).cast("bigint")


class _Best:
    """The best documents of each item so far: highest score first, then the smallest doc, nulls before all."""

    NONE = np.iinfo(np.int64).min

    def __init__(self, items: int, top: int):
        self.top, self.items = top, items
        self.rows = np.zeros((0, 3), np.int64)  # item, -score, doc
        self.floor = np.ones(items, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        d, i = np.nonzero(scores >= self.floor)
        if not len(d):
            return
        rows = np.concatenate([self.rows, np.stack([i, -scores[d, i], docs[d]], axis=1)])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        starts = np.searchsorted(rows[:, 0], np.arange(self.items + 1))
        rank = np.arange(len(rows)) - starts[rows[:, 0]]
        self.rows = rows[rank < self.top]
        full = np.flatnonzero(np.diff(starts) >= self.top)
        self.floor[full] = -rows[starts[full] + self.top - 1, 1]


def _score(counted: DataFrame, block: list[tuple], words: list[str], docs: int, length: int, weights: np.ndarray, top: int) -> DataFrame:
    """(at, doc, score): each task's best documents of each item of the block, ``at`` being its place there."""
    place = {w: i for i, w in enumerate(words)}
    pairs = np.array(sorted((place[w], at) for at, (_, own) in enumerate(block) for w in own), np.int64).reshape(-1, 2)
    starts = np.searchsorted(pairs[:, 0], np.arange(len(words) + 1))
    held = counted.sparkSession.sparkContext.broadcast((pairs[:, 1].copy(), starts, weights))
    items = len(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_of, starts, w = held.value
        many = np.diff(starts)
        best = _Best(items, top)
        for b in batches:
            doc = b.column(0).fill_null(_Best.NONE).to_numpy()
            m = 10 + 90 * b.column(1).to_numpy() * docs // length
            bounds = b.column(2).value_lengths().to_numpy()
            term, tf = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()
            row = np.repeat(np.arange(len(doc)), bounds)
            part = w[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
            work = np.concatenate([[0], np.cumsum(np.bincount(row, many[term], len(doc)).astype(np.int64))])
            begin = 0
            while begin < len(doc):  # documents of which CELLS scores, or products, are held at a time
                end = max(begin + 1, min(begin + max(1, CELLS // items), int(np.searchsorted(work, work[begin] + CELLS, side="right")) - 1))
                lo, hi = np.searchsorted(row, [begin, end])
                reps = many[term[lo:hi]]
                at = np.repeat(starts[term[lo:hi]] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum()) if hi > lo else np.zeros(0, np.int64)
                scores = np.zeros((end - begin) * items, np.int64)
                np.add.at(scores, np.repeat((row[lo:hi] - begin) * items, reps) + item_of[at], np.repeat(part[lo:hi], reps))
                best.add(scores.reshape(-1, items), doc[begin:end])
                begin = end
        ids = pa.array(best.rows[:, 2], mask=best.rows[:, 2] == _Best.NONE)
        yield pa.RecordBatch.from_arrays([pa.array(best.rows[:, 0].astype(np.int32)), ids, pa.array(-best.rows[:, 1])], ["at", "doc", "score"])

    return counted.mapInArrow(run, "at int, doc bigint, score bigint")


def search(documents: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", asked: str = "text") -> DataFrame:
    """(item, rank, key, score): of each item the ``top`` documents with the highest score above 0, ties by ascending key.

    Terms are maximal runs of digits, letters and characters beyond ASCII, A-Z lower-cased. N documents hold at least
    one term, L terms together; n is the number of a document's terms, df of documents that hold a term, tf of its
    places in a document. weight = floor(1000 ln((2N + 2) / (2df + 1))), m = 10 + 90 n N div L, score = sum of weight
    * (1e9 tf div (1000 tf + 8 m)) over the item's distinct terms, in 64-bit integers.

    A null or empty text has no terms: such documents are found by nothing and count in nothing, such items find
    nothing. Rows that repeat an item's key are one item with the terms of all; documents that repeat a key are
    documents of their own. A null document key ranks before others of equal score. Empty tables give no rows.
    """
    spark = documents.sparkSession
    parts = []
    for block in item_blocks(items, item, asked):
        words = sorted({w for _, own in block for w in own})
        counted = materialize(_counts(documents, key, text, spark.sparkContext.broadcast(words)))
        whole = counted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        if not whole.docs:
            break
        df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weights = np.zeros(len(words), np.int64)
        for r in df.select("term", weight(F.lit(float(whole.docs)), F.col("df").cast("double")).alias("w")).toLocalIterator():  # one row a term of the block
            weights[r.term] = r.w
        scored = _score(counted, block, words, whole.docs, whole.length, weights, top)
        w = Window.partitionBy("at").orderBy(F.desc("score"), F.asc_nulls_first("doc"))
        ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(at, own) for at, (own, _) in enumerate(block)], f"at int, item {items.schema[item].dataType.simpleString()}")
        parts.append(ranked.join(F.broadcast(names), "at").select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(key), "score"))  # BLOCK_ITEMS rows
    if not parts:
        return spark.createDataFrame([], f"`{item}` {items.schema[item].dataType.simpleString()}, rank int, `{key}` bigint, score bigint")
    return reduce(DataFrame.unionByName, parts)
