"""Vectorised tokenising of Arrow text columns.

A batch of texts is viewed as one byte buffer in which every text is closed by a line feed. Words are
found with a byte table, and hashed with a polynomial prefix sum modulo 2**64, so no Python object is
made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_BYTES = np.arange(256, dtype=np.uint8)
#: A-Z become a-z, every other byte stays.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lowered.
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: Bytes of the words [^\x20\x09-\x0D]+.
NONSPACE = ~SPACE

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))


class _Powers:
    """P**j and P**-j modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            out = []
            for base in (_P, _PINV):
                f = np.full(n, base, np.uint64)
                f[0] = 1
                out.append(np.cumprod(f, dtype=np.uint64))
            self.up, self.down = out
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class Texts:
    """Some texts as one buffer; text k is buf[start[k]:start[k + 1] - 1], closed by a line feed."""

    def __init__(self, array: pa.Array) -> None:
        array = pc.fill_null(array, "") if array.null_count else array
        closed = pc.binary_join_element_wise(array.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
        _, offsets, data = closed.buffers()
        offs = np.frombuffer(offsets, np.int64)[closed.offset : closed.offset + len(closed) + 1]
        self.buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
        self.start = offs - offs[0]

    def __len__(self) -> int:
        return len(self.start) - 1

    def slice_bytes(self, a: int, b: int) -> bytes:
        return self.buf[a:b].tobytes()


class Words:
    """The words of ``texts``: byte spans, 64-bit hashes, and each text's range of words."""

    def __init__(self, texts: Texts, is_word: np.ndarray) -> None:
        self.lower = LOWER[texts.buf]
        edge = np.diff(is_word[self.lower].view(np.int8), prepend=np.int8(0))
        self.starts = np.flatnonzero(edge == 1)
        self.ends = np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.starts, texts.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        up, down = _POWERS.get(len(self.lower))
        total = np.zeros(len(self.lower) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[self.lower] * up, dtype=np.uint64, out=total[1:])
        return total, down

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        total, down = self._sums()
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])

    def prefixes(self, lengths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length in bytes: the words longer than it, and the hashes of their prefixes."""
        if not len(self.starts):
            return []
        total, down = self._sums()
        out = []
        for n in lengths:
            k = np.flatnonzero(self.ends - self.starts > n)
            a = self.starts[k]
            out.append((k, mix((total[a + n] - total[a]) * down[a] + np.uint64(n))))
        return out


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` text bytes; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)).astype(np.int64)
    done, size = 0, 0
    for k, s in enumerate(sizes.tolist()):
        if k > done and size + s > limit:
            yield batch.slice(done, k - done)
            done, size = k, 0
        size += s
    yield batch.slice(done)


def hash_word(word: bytes) -> int:
    """The hash that Words gives to the lower-cased bytes ``word``."""
    w = Words(Texts(pa.array([word.decode("utf-8", "surrogateescape")])), NONSPACE)
    return int(w.hashes()[0])
