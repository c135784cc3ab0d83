"""Chat formatting by token-level assembly.

Roles and texts are encoded segment by segment; the ids of the turn marks are reserved ids that no text can produce,
and they are spliced in between. The loss mask comes from the segments' lengths by prefix sums. A control string that
occurs in a text is escaped before it is encoded, and the escape can be undone.

Template, with S and E for the reserved marks: S role newline text E newline, for each turn.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import bound_batches

# The marks of a turn as they are written out.
START, END = "<|im_start|>", "<|im_end|>"
#: The role whose texts are learnt from.
LEARNT = "assistant"

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    r"""Control strings begin with ``<|``; here that becomes ``<\|``, and any number of backslashes there grows by one."""
    return _CONTROL.sub(lambda m: f"<{m[1]}\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}|", text)


def escape_role(role: str) -> str:
    r"""A role ends at the first line feed, so one inside is written as ``\n``."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class ChatCodec:
    """Encodes segments with a byte-level tokenizer file and keeps two reserved ids after its vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.start = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.end = self.start + 1
        self.newline = self._encode(["\n"])[0]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def format(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of a conversation; the mask is 1 on the tokens of learnt texts."""
        segments = self._encode([s for role, text in turns for s in (escape_role(role) + "\n", escape(text))])
        parts: list[list[int]] = []
        learn: list[int] = []
        for k, (role, _) in enumerate(turns):
            parts += [[self.start], segments[2 * k], segments[2 * k + 1], [self.end], self.newline]
            learn += [0, 0, int(role == LEARNT), 0, 0]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes)
        step = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
        flags = np.array(learn, np.int64)
        np.add.at(step, ends - sizes, flags)
        np.add.at(step, ends, -flags)
        ids = np.fromiter((i for p in parts for i in p), np.int64, len(step) - 1)
        return ids, np.cumsum(step)[:-1]

    def decode(self, ids: np.ndarray) -> str:
        """The formatted text, marks written out."""
        out: list[str] = []
        cuts = np.flatnonzero(ids >= self.start)
        for low, high in zip([0, *(cuts + 1)], [*cuts, len(ids)], strict=True):
            out.append(self.tokenizer.decode(ids[low:high].tolist(), skip_special_tokens=False) if high > low else "")
            if high < len(ids):
                out.append(START if ids[high] == self.start else END)
        return "".join(out)

    def read_turns(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a formatted text."""
        turns = []
        for part in formatted.split(START)[1:]:
            role, _, text = part[: part.rindex(END)].partition("\n")
            turns.append((unescape_role(role), unescape(text)))
        return turns

    def read_loss(self, ids: np.ndarray, mask: np.ndarray) -> list[str]:
        """The texts under the mask, one for each run of it."""
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
        return [unescape(self.tokenizer.decode(ids[low:high].tolist(), skip_special_tokens=False)) for low, high in zip(edge[::2], edge[1::2], strict=True)]


@lru_cache(maxsize=2)
def codec(path: str) -> ChatCodec:
    return ChatCodec(path)


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, ids, mask.

    Turns come in order of turn, then role and text; a null turn comes first, a null role or text is empty, and rows
    with a null conversation are one conversation. Repeated rows are repeated turns. Other columns are left aside, an
    empty table gives an empty result. A task streams its conversations in order and holds one at a time, as each
    becomes one row.
    """
    rows = turns.select(F.col(conv).cast("bigint").alias("c"), F.col(turn).cast("bigint").alias("n"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.repartition("c").sortWithinPartitions("c", "n", "r", "t")
    bound_batches(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer))
        done: list[tuple] = []
        held, now, begun = [], None, False

        def finish() -> None:
            ids, mask = code.format(held)
            done.append((now, len(held), code.decode(ids), ids.tolist(), mask.tolist()))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), _TYPES, strict=True)], _NAMES)
            done.clear()
            return out

        for batch in batches:
            for c, _, r, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if begun and c != now:
                    finish()
                    held = []
                begun, now = True, c
                held.append((r, t))
            if done:
                yield flush()
        if begun:
            finish()
            yield flush()

    return rows.mapInArrow(run, "c bigint, n_turns bigint, formatted string, ids array<int>, mask array<int>").withColumnRenamed("c", conv)


_NAMES = ["c", "n_turns", "formatted", "ids", "mask"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]


def digest_formatted(formatted: DataFrame, conv: str = "conv_id", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """What the output of :func:`format_conversations` says when read back: turns and learnt texts, as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer))
        for batch in batches:
            rows = []
            for c, out, ids, mask in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                turns = code.read_turns(out)
                loss = "".join(code.read_loss(np.array(ids, np.int64), np.array(mask, np.int64)))
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((c, len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(out)))
            if rows:
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["c", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = "c bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.select(F.col(conv).alias("c"), "formatted", "ids", "mask").mapInArrow(run, schema).withColumnRenamed("c", conv)
