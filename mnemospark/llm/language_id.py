"""Language identification by cross-parsing against suffix automata of labelled text.

One suffix automaton per language accepts exactly the substrings of that language's training text. A document is
parsed greedily: each phrase is the longest match from where the last one ended. The fewer phrases a language needs,
normalised by what a phrase costs with that much training text, the closer the document is to it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import bound_batches, map_text, materialize, worker_state

#: Bounds of the training sample: rows and symbols of each language, symbols of all languages. Rows are used whole or not at all.
TRAIN_DOCS, TRAIN_CHARS, TRAIN_CHARS_ALL = 400, 40_000, 800_000
#: Characters of a row from which it is long: such rows are used only where a language has too few others.
LONG_ROW = 5_000
UND = "und"
_PLANE = 0x3000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point: whether it is a letter (general category L)."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """For every code point: its lower-case form if that is one code point; 0 for what is not a letter."""
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(_PLANE):
        low = chr(i).lower()
        table[i] = ord(low) if len(low) == 1 else i
    table[~letters()] = 0
    return table


def symbols(text: str) -> str:
    """Lower-case letters, with one NUL for each run of anything else."""
    s = folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if len(s) > 1:
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    return s.tobytes().decode("utf-32-le", "surrogatepass")


def suffix_automaton(text: str) -> dict[str, dict]:
    """The start state of the suffix automaton of a text (Blumer et al.). A state is the map of its transitions."""
    start: dict[str, dict] = {}
    go, link, length, last = [start], [-1], [0], 0
    number = {id(start): 0}

    def state(edges: dict, size: int, suffix: int) -> int:
        go.append(edges)
        length.append(size)
        link.append(suffix)
        number[id(edges)] = len(go) - 1
        return len(go) - 1

    for c in text:
        cur = state({}, length[last] + 1, 0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = go[cur]
            p = link[p]
        if p >= 0:
            q = number[id(go[p][c])]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = state(dict(go[q]), length[p] + 1, link[q])
                while p >= 0 and go[p].get(c) is go[q]:
                    go[p][c] = go[clone]
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return start


class Sample(NamedTuple):
    lang: str
    #: the symbols that the language's automaton is built of
    line: str

    @property
    def cost(self) -> float:
        """Bits of a phrase: where in the training text it points to."""
        return float(np.log2(len(self.line) + 1))


def sample_of(lang: str, texts: Iterable[str], chars: int) -> Sample:
    """The training text of a language: the symbols of its first text, and of each further one that still fits, with a NUL about each."""
    line = "\0"
    for text in texts:
        new = symbols(text)
        if len(line) == 1 or len(line) + len(new) < chars:
            line += new + "\0"
    return Sample(lang, line)


def phrases(start: dict[str, dict], line: str) -> int:
    """Phrases of the greedy cross-parse of a whole text; a symbol that the training text lacks is one by itself."""
    count, state, none = 0, {}, {}
    for c in line:
        state = state.get(c)
        if state is None:
            count += 1
            state = start.get(c, none)
    return count


def _rank(h: Column) -> Column:
    """A hash as a number from 0 to 1."""
    return F.pmod(h, F.lit(1 << 40)).cast("double") / float(1 << 40)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[Sample]:
    """The training text of each language, from a bounded sample of whole labelled rows.

    Of each language the rows come in the order of a hash of key and text, equal rows once, and rows of over LONG_ROW
    characters after all others, the shortest first. Up to TRAIN_DOCS of them, with 4 * TRAIN_CHARS characters
    together, are fetched; of these the first is used, and each further one whose symbols fit within TRAIN_CHARS,
    fewer where the languages together would exceed TRAIN_CHARS_ALL. Rows with a null text, language or key, and rows
    of over 4 * TRAIN_CHARS characters, are not used. A count per language gives a bound of the hash that a few times
    TRAIN_DOCS rows are under, so that no more than these meet in a task.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & F.length(text).between(1, 4 * TRAIN_CHARS))
    labelled = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    bounds = labelled.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (F.lit(3.0 * TRAIN_DOCS) / F.col("n")).alias("most"))
    bounds = materialize(bounds, 1)  # one row per language
    near = labelled.join(F.broadcast(bounds), "lang").withColumn("h", F.xxhash64("key", "text")).where(_rank(F.col("h")) <= F.col("most"))
    sizes = near.groupBy("lang", "h").agg(F.min(F.length("text")).alias("size"))
    line = Window.partitionBy("lang").orderBy(F.when(F.col("size") > LONG_ROW, F.col("size")).otherwise(0), _rank(F.col("h")), "h")
    placed = sizes.withColumns({"place": F.row_number().over(line), "upto": F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    chosen = materialize(placed.where((F.col("place") <= TRAIN_DOCS) & (F.col("upto") <= 4 * TRAIN_CHARS)).select("lang", "h", "place"), TRAIN_DOCS)
    sample = near.join(F.broadcast(chosen), ["lang", "h"])  # at most TRAIN_DOCS rows per language
    sample = sample.groupBy("lang", "place").agg(F.min("text").alias("text"))
    rows = sample.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("texts")).orderBy("lang").collect()
    if not rows:
        return []
    chars = max(1000, min(TRAIN_CHARS, TRAIN_CHARS_ALL // len(rows)))
    return [sample_of(r.lang, [t.text for t in r.texts], chars) for r in rows]


def identify(samples: list[Sample], texts: list[str]) -> tuple[list[str], list[float]]:
    """The language of each text and how sure that is. A worker builds the automata once for as long as it is asked with the same samples."""
    docs = [symbols(t) for t in texts]
    lettered = np.array([bool(d.strip("\0")) for d in docs], bool)
    if not samples or not docs:
        return [UND] * len(texts), [0.0] * len(texts)
    held = worker_state("language_id", dict)
    if held.get("samples") != samples:
        held |= {"samples": samples, "starts": [suffix_automaton(x.line) for x in samples]}
    bits = np.array([[phrases(start, d) * x.cost for d in docs] for x, start in zip(samples, held["starts"], strict=True)])
    best = bits.argmin(axis=0)  # the first language on a tie
    least = bits.min(axis=0)
    if len(samples) > 1:
        second = np.partition(bits, 1, axis=0)[1]
        score = np.divide(second, second + least, out=np.full(len(least), 0.5), where=second + least > 0)
    else:
        score = np.ones(len(least))
    return [samples[i].lang if ok else UND for i, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0).tolist()


def detect_language(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang_pred, score) of every row of ``docs``.

    ``lang_pred`` is the language whose automaton needs the fewest bits of phrases, the first in code point order on
    a tie, and ``und`` with score 0 for a null text or one without a letter. ``score`` is the runner-up's bits over
    the sum of both: 0.5 says nothing, more says more. A null key stays null, repeated rows repeat, other columns are
    left aside, an empty table gives an empty result; without training rows everything is ``und``.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(training, key, text, lang))

    def run(columns: list[pa.Array], texts: list[str]) -> pa.RecordBatch:
        langs, scores = identify(held.value, texts)
        return pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["k", "lang_pred", "score"])

    return map_text(docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t")), run, "k bigint, lang_pred string, score double").withColumnRenamed("k", key)


def keep_identified(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", languages: Iterable[str] | None = None) -> DataFrame:
    """The rows of ``docs``, whole, whose text is found to be in one of ``languages`` (any learned one if None).

    The language that is found is what ``lang`` holds from then on, whatever it was before. Null texts and texts
    without letters have none and go. Without a labelled row to learn from, all texts with letters stay and keep the
    language they had. Null keys and repeated rows count as any row; an empty table gives an empty result.
    """
    samples = train(training, key, text, lang)
    held = docs.sparkSession.sparkContext.broadcast(samples)
    wanted = None if languages is None else set(languages)
    bound_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        texts = [t or "" for t in texts]
        if held.value:
            out = [x if x != UND and (wanted is None or x in wanted) else None for x in identify(held.value, texts)[0]]
        else:
            out = [UND if symbols(t).strip("\0") else None for t in texts]
        return pd.Series(out, dtype=object)

    # as it counts as nondeterministic, it is evaluated once and not again in the filter
    known = docs.withColumn("__found", found.asNondeterministic()(F.col(text))).where("__found is not null")
    new = F.col("__found") if samples else F.col(f"`{lang}`")
    return known.select(*[new.alias(c) if c == lang else F.col(f"`{c}`") for c in docs.columns])
