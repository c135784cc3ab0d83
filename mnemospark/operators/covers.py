"""Ranking of texts by the minimal covers of a query's words (Clarke, Cormack and Tudhope, shortest substring ranking).

A cover is a stretch of a text that holds all the words of the query that the text has; a minimal one holds no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.arrow import bound_batches

#: Cells of the sweep (places by words) that are held at a time, besides one text.
CELLS = 1 << 21

#: The same sum for a column ``places`` (pos, token; in order) and its distinct tokens ``found``, as an expression for SQL
#: users: ``last`` has each token's last place, their minimum is where the cover that ends here begins.
COVER_SUM = """aggregate(places,
    named_struct('last', transform(found, t -> -1), 'start', -1, 'sum', 0D),
    (s, p) -> transform(array(transform(s.last, (x, j) -> if(found[j] = p.token, p.pos, x))), last ->
        named_struct('last', last, 'start', array_min(last),
                     'sum', s.sum + if(array_min(last) > s.start, size(found) / cast(p.pos - array_min(last) + 1 as double), 0D)))[0],
    s -> round(s.sum, 9))"""


def cover_sums(group: np.ndarray, pos: np.ndarray, word: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, sum) of each group of places (group, pos, word), in any order: how many different words it has, and the sum over
    its minimal covers of words / length.

    One sweep over the places in order, for all groups at once: each word has its last place, their minimum is where
    the cover that ends here begins, and it is minimal where it begins later than the one before.
    """
    order = np.lexsort((pos, group))
    group, pos, word = group[order], pos[order].astype(np.int64), word[order]
    by_word = np.lexsort((word, group))  # words numbered within their group
    new = np.ones(len(word), bool)
    new[1:] = (word[by_word][1:] != word[by_word][:-1]) | (group[by_word][1:] != group[by_word][:-1])
    many = np.bincount(group[by_word], new, groups).astype(np.int64)
    number = np.empty(len(word), np.int64)
    first = np.concatenate([[0], np.cumsum(many)[:-1]])
    number[by_word] = np.cumsum(new) - 1 - first[group[by_word]]
    sums = np.zeros(groups)
    starts = np.searchsorted(group, np.arange(groups + 1))
    lo = 0
    while lo < groups:
        hi, widest = lo, 0
        while hi < groups:  # groups whose places by their largest number of words fit
            widest_then = max(widest, int(many[hi]))
            if hi > lo and (starts[hi + 1] - starts[lo]) * widest_then > CELLS:
                break
            widest, hi = widest_then, hi + 1
        a, b = starts[lo], starts[hi]
        if b > a:
            g, p = group[a:b], pos[a:b]
            base = (g - lo) * ((1 << 32) + 1)  # places of earlier groups are before all of one's own
            last = np.where(number[a:b, None] == np.arange(widest), (base + p)[:, None], -1)
            np.maximum.accumulate(last, axis=0, out=last)
            last[np.arange(widest) >= many[g][:, None]] = np.iinfo(np.int64).max
            begin = last.min(axis=1)
            before = np.concatenate([[-1], begin[:-1]])
            cover = (begin >= base) & ((begin > before) | (np.concatenate([[-1], g[:-1]]) != g))
            sums[lo:hi] = np.bincount(g[cover] - lo, many[g[cover]] / (base + p - begin + 1)[cover], hi - lo)
        lo = hi
    return many, np.round(sums, 9)


def score_postings(hits: DataFrame, key: str) -> DataFrame:
    """(query_id, key, matched, raw) of postings (query_id, key, token, pos).

    ``matched`` counts the query's words in the text. ``raw`` is matched - 1 plus c / (c + 1), c being the sum over the
    minimal covers of matched / length. A text with more words of the query is always before one with fewer. A text's
    places are gathered, which its own words bound; words are told apart by 64-bit hashes.
    """
    kind = lambda c: hits.schema[c].dataType.simpleString()
    bound_batches(hits.sparkSession)
    held = hits.groupBy("query_id", key).agg(F.collect_list(F.col("pos").cast("int")).alias("pos"), F.collect_list(F.xxhash64("token")).alias("word"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group = np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy())
            many, sums = cover_sums(group, b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy(), b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(many), pa.array(sums)], ["query_id", key, "matched", "covers"])

    swept = held.mapInArrow(run, f"query_id {kind('query_id')}, `{key}` {kind(key)}, matched bigint, covers double")
    return swept.select("query_id", key, "matched", (F.col("matched") - 1 + F.col("covers") / (F.col("covers") + 1)).alias("raw"))
