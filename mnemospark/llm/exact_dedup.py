"""Exact deduplication by two-pass Bloom filtering.

The first pass hashes every normalised text and marks, in a Bloom filter, the bits that at least two rows hit. The
second pass tests every row: only rows whose bits are all marked may be repeated, and only those shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.bloom import filter_of, with_flag
from mnemospark.llm.common import blank, materialize, split_join


def normalised(text: str) -> Column:
    """The text without the six ASCII white space characters; null counts as empty."""
    return F.regexp_replace(blank(text), "[ \\t-\\r]", "")


def with_repeat_flag(rows: DataFrame, h: str, count: int, hashes: DataFrame | None = None, flag: str = "maybe_repeated") -> DataFrame:
    """``rows`` with a flag that is true wherever the value of ``h`` occurs more than once (and rarely elsewhere)."""
    return with_flag(rows, h, *filter_of(hashes if hashes is not None else rows, h, count, hits=2), flag)


def _keepers(repeated: DataFrame, key: str) -> DataFrame:
    """For each digest: its rows, and the key of the row with the most code points, the smallest on ties."""
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col(key).alias("k")))
    return repeated.groupBy("text_sha256").agg(F.count("*").alias("group_size"), best.alias("__best")).select("text_sha256", "group_size", F.col("__best.k").alias("keep_id"))


def _digest(text: str) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256).alias("text_sha256")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ASCII white space; a null text counts as empty, and all empty
    texts are one group. Of a group the row with the most code points stays, then the smallest key; a null key comes
    before all others. Rows that repeat one key are one document seen twice: both count in group_size, both carry the
    same verdict. An empty table gives an empty result; other columns are left aside.
    """
    prints = materialize(docs.select(key, F.char_length(blank(text)).alias("__n"), _digest(text)).withColumn("__h", F.xxhash64("text_sha256")))
    flagged = with_repeat_flag(prints, "__h", prints.count())
    repeated = flagged.where("maybe_repeated")
    single = flagged.where("not maybe_repeated").select(key, F.col(key).alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    verdict = split_join(repeated, _keepers(repeated, key), "text_sha256")
    return single.unionByName(verdict.select(key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole and with all their columns, that :func:`exact_duplicates` keeps.

    Rows that the filter clears pass straight through; only rows that may be repeated shuffle with their texts. They
    alone are digested, as the filter works on a shorter hash of the normalised text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    h = F.xxhash64(normalised(text)).alias("__h")
    prints = materialize(docs.select(h))
    flagged = with_repeat_flag(docs.select(row, h), "__h", prints.count(), hashes=prints)
    part = lambda c: F.col("__row").getField(c)
    named = flagged.where("maybe_repeated").select("__row", part(key).alias("__key"), part(text).alias("__text"))
    repeated = named.select("__row", "__key", F.char_length(blank("__text")).alias("__n"), _digest("__text"))
    stay = split_join(repeated, _keepers(repeated.select("__key", "__n", "text_sha256"), "__key"), "text_sha256")
    stay = stay.where(F.col("__key").eqNullSafe(F.col("keep_id")))
    return flagged.where("not maybe_repeated").select("__row.*").unionByName(stay.select("__row.*"))
