"""Vectorised hashing of words and shingles of Arrow text batches."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that are looked at together, and the longest words that are hashed in lockstep.
_CHUNK = 1 << 18
_LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string column; a null is an empty text."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data or b"", np.uint8)


def bytes_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes: eight bytes at a time, each mixed with what came before.

    Ranges of more than _LONG bytes, which are few, are hashed by BLAKE2b.
    """
    size = ends - starts
    longs = np.frombuffer(raw.tobytes() + bytes(16 - len(raw) % 8), "<u8")
    out = mix(size.astype(U) * U(0x9E3779B97F4A7C15))
    at = np.flatnonzero(size <= _LONG)
    done = 0
    while len(at):
        s, n = starts[at] + done, np.minimum(size[at] - done, 8).astype(U)
        word, off = s >> 3, ((s & 7) << 3).astype(U)
        one = longs[word]
        x = np.where(off == 0, one, (one >> off) | (longs[word + 1] << ((U(64) - off) & U(63))))
        x &= ~U(0) >> (U(64) - U(8) * n)
        out[at] = mix((out[at] ^ x) + U(0x632BE59BD9B4E019))
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_hashes(offsets: np.ndarray, data: np.ndarray, lower: bool = True):
    """Yield (first row, hashes of words, bounds of rows in them), some rows at a time."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _CHUNK, "right")) - 1)
        a, b = int(offsets[row]), int(offsets[end])
        raw, n = data[a:b], b - a
        cuts = offsets[row : end + 1] - a
        if not n:
            yield row, np.zeros(0, U), np.zeros(end - row + 1, np.int64)
            row = end
            continue
        inside = ~_SEP[raw]
        first = np.zeros(n + 1, bool)
        first[cuts] = True
        before = np.concatenate(([False], inside[:-1]))
        starts = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.concatenate((inside[1:], [False]))
        ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        yield row, bytes_hashes(_LOWER[raw] if lower else raw, starts, ends), np.searchsorted(starts, cuts)
        row = end


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row its sorted distinct k-word shingles; a shorter text is one shingle."""
    weights = odd_constants(k, 77)
    n = len(hashes)
    joined = np.zeros(max(0, n - k + 1), U)
    for i in range(min(k, n)):
        joined += hashes[i : i + len(joined)] * weights[i]
    joined = mix(joined)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(joined[a : b - k + 1]))
        elif b > a:
            out.append(mix(np.array([(hashes[a:b] * weights[: b - a]).sum(dtype=U) + U(b - a)], U)))
        else:
            out.append(np.zeros(0, U))
    return out


def row_shingles(column, k: int):
    """Yield the shingle set of each row of an Arrow string column."""
    offsets, data = text_buffers(column)
    for _, hashes, bounds in word_hashes(offsets, data):
        yield from shingles(hashes, bounds, k)
