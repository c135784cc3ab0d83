"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a slice of a partition are laid out as one array of symbols. An index maps every adjacent
pair that has a merge rank to all its positions. Ranks are then applied in ascending order, each to all of its
positions at once; a merge updates the lists of the pairs to its left and right. A pair that a merge creates always
has a later rank than the merge, so ascending order gives every word the result it would get alone.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterable
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import map_text, worker_state

#: Distinct pre-tokens whose ids a worker remembers, the last ones that it met; about 20 MB.
CACHE_WORDS = 120_000
#: Pre-tokens above this length are encoded but not remembered.
CACHE_CHARS = 64
#: Positions from which the merges of a pair are made together.
MANY = 24
#: Characters that the narrow form of the pre-tokenizer's pattern does not know.
WIDE = re.compile("[\U00010000-\U0010ffff]")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, as a map back to the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


def narrow_pattern(pattern: str) -> re.Pattern:
    """The pre-tokenizer's pattern for texts without characters above U+FFFF, its classes spelled out as ranges; it finds
    what the given one does, in less time."""
    plane = "".join(map(chr, range(0x10000)))
    kinds = {k: "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in regex.findall(f"{k}+", plane)) for k in (r"\p{L}", r"\p{N}", r"\s")}
    space = kinds[r"\s"]
    inside = re.sub(r"\[[^]]*\]", lambda m: functools.reduce(lambda x, k: x.replace(k, kinds[k]), kinds, m[0]), pattern)
    return re.compile(functools.reduce(lambda x, k: x.replace(k, f"[{kinds[k]}]"), kinds, inside).replace(r"\S", f"[^{space}]"))


class ByteBpe:
    """Vocabulary, merges and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_symbols()
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token_bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in back.items():
            self.byte_id[b] = vocab[c]
        self.left, self.right, self.merged, self.rank = [], [], [], {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.left.append(vocab[a])
            self.right.append(vocab[b])
            self.merged.append(vocab[a + b])
            self.rank[vocab[a] << 20 | vocab[b]] = r
        self.sorted_pairs = np.array(sorted(self.rank), np.int64)
        self.sorted_ranks = np.array([self.rank[p] for p in self.sorted_pairs.tolist()], np.int64)
        none = len(self.left)
        self.byte_rank = np.full(65536, none, np.int64)
        id_byte = {int(i): b for b, i in enumerate(self.byte_id)}
        for r in range(none):
            if self.left[r] in id_byte and self.right[r] in id_byte:
                self.byte_rank[id_byte[self.left[r]] << 8 | id_byte[self.right[r]]] = r
        self.words, self.narrow_words = regex.compile(public_tokenizers.PATTERN), narrow_pattern(public_tokenizers.PATTERN)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.special_ids = {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
        self.cache: dict[str, bytes] = {}
        self.vocab = pa.array(self.token_bytes, pa.binary())

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        n = len(raw)
        if not n:
            return [b""] * len(words)
        # each array twice over the same memory: Python's for a pair with few positions, numpy's for one with many
        sym, following, before = array("i", [0]) * n, array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        nsym, nfollowing, nbefore = (np.frombuffer(x, np.int32) for x in (sym, following, before))
        nsym[:] = self.byte_id[raw]
        nfollowing[ends[ends > 0] - 1] = -1
        nbefore[ends[ends < n]] = -1
        # the index: positions of each ranked pair, left to right
        none = len(self.left)
        ranks = self.byte_rank[raw[:-1] << 8 | raw[1:]]
        ranks[ends[(ends > 0) & (ends < n)] - 1] = none
        order = np.argsort(ranks, kind="stable")
        order = order[: np.searchsorted(ranks[order], none)]
        starts, first = np.unique(ranks[order], return_index=True)
        places = {int(r): part.tolist() for r, part in zip(starts, np.split(order, first[1:]), strict=True)} if len(order) else {}
        active = list(places)
        heapq.heapify(active)
        rank_of = self.rank.get

        def note(r: int, i: int) -> None:
            if r in places:
                places[r].append(i)
            else:
                places[r] = [i]
                heapq.heappush(active, r)

        while active:
            r = heapq.heappop(active)
            a, b, ab, at = self.left[r], self.right[r], self.merged[r], places.pop(r)
            if a == b or len(at) < MANY:
                for i in sorted(at) if a == b else at:
                    j = following[i]
                    if j < 0 or sym[i] != a or sym[j] != b:
                        continue  # an earlier merge took one of the two
                    k, h = following[j], before[i]
                    sym[i], sym[j], following[i] = ab, -1, k
                    if k >= 0:
                        before[k] = i
                        if (new := rank_of(ab << 20 | sym[k])) is not None:
                            note(new, i)
                    if h >= 0 and (new := rank_of(sym[h] << 20 | ab)) is not None:
                        note(new, h)
                continue
            i = np.array(at, np.int64)  # a place comes twice, if at all, in a pair of equal symbols
            j = nfollowing[i]
            ok = (j >= 0) & (nsym[i] == a) & (nsym[j] == b)
            i, j = i[ok], j[ok]
            k = nfollowing[j]
            nsym[i], nsym[j], nfollowing[i] = ab, -1, k
            more = k >= 0
            nbefore[k[more]] = i[more]
            h = nbefore[i]
            left = h >= 0
            pairs = np.concatenate([ab << 20 | nsym[k[more]].astype(np.int64), nsym[h[left]].astype(np.int64) << 20 | ab])
            slot = np.minimum(np.searchsorted(self.sorted_pairs, pairs), none - 1)
            hit = self.sorted_pairs[slot] == pairs
            for new, p in zip(self.sorted_ranks[slot[hit]].tolist(), np.concatenate([i[more], h[left]])[hit].tolist(), strict=True):
                note(new, p)
        live = nsym >= 0
        ids, upto = nsym[live].astype("<u4").tobytes(), (np.cumsum(live)[ends - 1] * 4 * (ends > 0)).tolist()
        return [ids[s:e] for s, e in zip([0, *upto[:-1]], upto, strict=True)]

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens and special tokens, in order."""
        find = (self.words if WIDE.search(text) else self.narrow_words).findall
        if self.cut is None or not any(s in text for s in self.special):
            return find(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [part] if k % 2 else find(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        parts, known = [self.pretokens(t) for t in texts], self.cache
        met = dict.fromkeys(chain.from_iterable(parts))
        known.update(self.special_ids)
        new = [w for w in met if w not in known]
        known.update(zip(new, self.merge_words([w.encode() for w in new]), strict=True))
        out = [b"".join(map(known.__getitem__, part)) for part in parts]
        for w in met:
            ids = known.pop(w)
            if len(w) <= CACHE_CHARS:
                known[w] = ids  # as the last one met
        for w in list(islice(known, max(0, len(known) - CACHE_WORDS))):
            del known[w]
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        """The text of each document's ids."""
        tokens = self.vocab.take(pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
        starts = np.frombuffer(tokens.buffers()[1], np.int32)
        cuts = starts[np.cumsum([0, *[len(x) // 4 for x in ids]])].tolist()
        data = memoryview(tokens.buffers()[2] or b"")
        return [str(data[s:e], "utf-8", "replace") for s, e in pairwise(cuts)]


def load_bpe(tokenizer: str) -> ByteBpe:
    """The tokenizer of that file, which a worker loads once; a file name of public_tokenizers or a path."""
    path = tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer)
    return worker_state(f"bpe {path}", lambda: ByteBpe(path))


def _encoded(docs: DataFrame, key: str, text: str, tokenizer: str, columns: dict[str, tuple[str, Callable[[ByteBpe, list[bytes]], pa.Array]]], compared: bool = False) -> DataFrame:
    """Encode every text where it is; each column is made of a slice's ids by its function. ``compared``: the ids are
    decoded and must give the text."""

    def run(keys: list[pa.Array], texts: list[str]) -> pa.RecordBatch:
        bpe = load_bpe(tokenizer)
        ids = bpe.encode(texts)
        if compared:
            for k, t, back in zip(keys[0], texts, bpe.decode(ids), strict=True):
                if back != t:
                    raise ValueError(f"the ids of {key} {k} do not decode to its text; {tokenizer} loses some of it")
        return pa.RecordBatch.from_arrays([*keys, *[make(bpe, ids) for _, make in columns.values()]], [key, *columns])

    schema = ", ".join([f"`{key}` bigint", *[f"{name} {kind}" for name, (kind, _) in columns.items()]])
    return map_text(docs.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias("__text")), run, schema)


def _count(bpe: ByteBpe, ids: list[bytes]) -> pa.Array:
    return pa.array([len(x) // 4 for x in ids], pa.int64())


def _lists(bpe: ByteBpe, ids: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))


def _digests(parts: Iterable[bytes]) -> pa.Array:
    return pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", decoded: bool = True) -> DataFrame:
    """Token ids and decoded text of every row: (key, n_tokens, ids, decoded).

    Every row's ids are decoded. Without ``decoded`` that text is compared with the row's where it is and does not travel;
    a row whose ids give another text ends the job.
    A null text counts as empty and has no tokens; a null key stays null; repeated rows give repeated results; other
    columns are left aside; an empty table gives an empty result. Special tokens' strings in a text become their ids.
    ``tokenizer`` is a file name of the public_tokenizers package or a path that every executor can read.
    """
    columns = {"n_tokens": ("bigint", _count), "ids": ("array<int>", _lists)}
    if decoded:
        columns["decoded"] = ("string", lambda bpe, ids: pa.array(bpe.decode(ids), pa.string()))
    return _encoded(docs, key, text, tokenizer, columns, compared=not decoded)


def token_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row, digested where the tokens are, so that neither ids nor
    texts travel; rows as in :func:`encode_documents`."""
    columns = {
        "n_tokens": ("bigint", _count),
        "ids_sha256": ("string", lambda bpe, ids: _digests(ids)),
        "decoded_sha256": ("string", lambda bpe, ids: _digests(t.encode() for t in bpe.decode(ids))),
    }
    return _encoded(docs, key, text, tokenizer, columns)
