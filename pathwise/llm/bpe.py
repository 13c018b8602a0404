"""Byte-level BPE as a monoid: halves are encoded recursively and neighbours are joined.

An encoded text is a pair (text, ids). Joining two neighbours re-encodes a window around the seam that
grows on both sides to the next provable piece boundary, and keeps the ids outside it. A position
before a blank or line feed that follows a character other than white space is such a boundary: every
alternative of the splitting pattern takes white space only at its start, or nothing else, so no piece
spans it and no look-ahead of an earlier piece depends on what stands behind it. Where no boundary
exists the window grows to the whole text, which is still exact.

Defined results: a null text is the empty text and has no ids; repeated rows give repeated rows; an empty
table gives no rows. A text is encoded by one task, which holds it with its ids, of 8 bytes each while they
are joined; a long run without a boundary is encoded as one piece of text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

#: Characters in a leaf of the tree.
LEAF_CHARS = 8192
_CUTS = (" ", "\n")


class Codec:
    def __init__(self, ranks_path: str, leaf_chars: int = LEAF_CHARS) -> None:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.size = np.array([len(t) for t in self.token], np.int64)
        self.leaf = leaf_chars

    def _leaf(self, text: str) -> np.ndarray:
        return np.array(self.enc.encode_ordinary(text), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf:
            return self._leaf(text)
        mid = len(text) // 2
        return self.join(text[:mid], self.encode(text[:mid]), text[mid:], self.encode(text[mid:]))

    def join(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
        """The ids of left + right, from the ids of both."""
        i, j = _last_boundary(left), _first_boundary(left, right)
        window = left[i:] + right[:j]
        return np.concatenate([a[: len(a) - self._tail(a, left[i:])], self._leaf(window), b[self._head(b, right[:j]) :]])

    def _tail(self, ids: np.ndarray, text: str) -> int:
        n = len(text.encode())
        return int(np.searchsorted(np.cumsum(self.size[ids[max(0, len(ids) - n) :]][::-1]), n)) + 1 if n else 0

    def _head(self, ids: np.ndarray, text: str) -> int:
        n = len(text.encode())
        return int(np.searchsorted(np.cumsum(self.size[ids[:n]]), n)) + 1 if n else 0

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.token.__getitem__, ids.tolist()))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def _last_boundary(left: str) -> int:
    """The last provable boundary inside ``left``; 0 if there is none."""
    i = len(left)
    while (i := max(left.rfind(c, 0, i) for c in _CUTS)) > 0:
        if not left[i - 1].isspace():
            return i
    return 0


def _first_boundary(left: str, right: str) -> int:
    """The first provable boundary at or behind the start of ``right``; its length if there is none."""
    if right[:1] in _CUTS and left and not left[-1].isspace():
        return 0
    j = 0
    while True:
        found = [k for c in _CUTS if (k := right.find(c, j + 1)) > 0]
        if not found:
            return len(right)
        j = min(found)
        if not right[j - 1].isspace():
            return j


@lru_cache(maxsize=2)
def codec(ranks_path: str) -> Codec:
    return Codec(ranks_path)


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path)
        for batch in batches:
            n, ids_sha, out_sha = [], [], []
            for text in batch.column(1):
                ids = c.encode(text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                out_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, ranks_path: str, text_column: str = "text", ids_column: str = "token_ids") -> DataFrame:
    """``docs`` with an array column of token ids; a column of that name is replaced."""
    docs = docs.drop(ids_column)
    at = docs.columns.index(text_column)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path)
        for batch in batches:
            ids = pa.array([c.encode(t.as_py() or "").astype(np.int32) for t in batch.column(at)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, ids_column])

    return docs.mapInArrow(run, f"{kinds}, `{ids_column}` array<int>")


def encode_with_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, token_ids, n_tokens, ids_sha256, decoded_sha256 of every row; the last three are those of token_ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path)
        for batch in batches:
            all_ids = [np.array(x.values, np.uint32) for x in batch.column(1)]
            ids_sha = [hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in all_ids]
            out_sha = [hashlib.sha256(c.decode(ids)).hexdigest() for ids in all_ids]
            n = pa.array([len(ids) for ids in all_ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n, pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())], ["doc_id", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    encoded = encode(docs.select("doc_id", "text"), ranks_path).select("doc_id", "token_ids")
    return encoded.mapInArrow(run, f"doc_id {kind}, token_ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, ranks_path: str, ids_column: str = "token_ids", text_column: str = "text") -> DataFrame:
    """``encoded`` with the text its ids stand for; bytes that are no UTF-8 become U+FFFD, null ids null."""
    encoded = encoded.drop(text_column)
    at = encoded.columns.index(ids_column)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path)
        for batch in batches:
            out = [None if (v := x.as_py()) is None else c.decode(np.array(v, np.uint32)).decode("utf-8", "replace") for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, text_column])

    return encoded.mapInArrow(run, f"{kinds}, `{text_column}` string")
