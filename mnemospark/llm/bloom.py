"""Bloom filters as tables of 64-bit words, built by Spark and tested beside the rows.

A value hits PROBES bits of one word, which its hash names. The filter is the table (word, mask) of the words with a
marked bit; a row finds its word by a join on the word's number. The number of words follows the number of rows, so
the share of rows that pass by chance is the same at every size. The table is broadcast as long as it is small and
joined by a shuffle beyond.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import materialize, split_join

#: Rows to a word, and bits that a row hits in it.
ROWS_PER_WORD, PROBES = 2, 4
LEAST_WORDS = 1 << 12
#: Words with a marked bit up to which the table is broadcast: at two longs a word, 64 MB.
BROADCAST_WORDS = 1 << 22


def _bit(h: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(k + 1)), F.lit(64)).cast("int")


def _word(h: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(0)), F.lit(words))


def _probe(h: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(h, k)) for k in range(PROBES)])


def filter_of(rows: DataFrame, column: str, count: int, hits: int = 1) -> tuple[DataFrame, int]:
    """The table (word, mask) of the bits that at least ``hits`` rows hit, and the number of words it ranges over."""
    words = max(LEAST_WORDS, 1 << ceil(log2(max(1, count / ROWS_PER_WORD))))
    h = F.col(column)
    bits = F.explode(F.array_distinct(F.array(*[_bit(h, k) for k in range(PROBES)]))).alias("bit")
    hit = rows.select(_word(h, words).alias("word"), bits).groupBy("word", "bit").count().where(F.col("count") >= hits)
    return materialize(hit.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")), count), words


def with_flag(rows: DataFrame, column: str, marked: DataFrame, words: int, flag: str) -> DataFrame:
    """``rows`` with a column that is true wherever all bits of ``column`` are marked."""
    rows = rows.withColumn("__word", _word(F.col(column), words))
    small = marked.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    table = marked.withColumnRenamed("word", "__word").withColumnRenamed("mask", "__mask")
    joined = rows.join(F.broadcast(table), "__word", "left") if small else split_join(rows, table, "__word", "left")
    probe = _probe(F.col(column))
    return joined.withColumn(flag, F.coalesce(F.col("__mask").bitwiseAND(probe) == probe, F.lit(False))).drop("__word", "__mask")


def only_possible(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``rows`` less most of those whose ``column`` is not among the values of ``wanted`` (one column of that name), before a join shuffles them."""
    return with_flag(rows, column, *filter_of(wanted, column, wanted.count()), "__possible").where("__possible").drop("__possible")
