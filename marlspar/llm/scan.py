"""Vectorised scans over the UTF-8 bytes of whole texts (numpy on Arrow buffers, no Python strings)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
SLICE_BYTES = 1 << 19
BASE = U64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective): xor-shift and multiply, three rounds."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_LETTERS = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Low 8 * k bits, for k bytes that are left of a block.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U64)
#: Strings of more bytes are hashed one at a time.
_BLOCKS = 8
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        inverse = U64(pow(int(BASE), -1, 1 << 64))
        for name, b in (("up", BASE), ("down", inverse)):
            out = np.empty(size, U64)
            out[0] = 1
            done = 1
            with np.errstate(over="ignore"):
                while done < size:  # doubling: b**(done+i) = b**done * b**i
                    step = min(done, size - done)
                    out[done : done + step] = out[:step] * (out[done - 1] * b)
                    done += step
            _POWERS[name] = out
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of letter(data[j]) * BASE**j for j < i, so that substrings hash in O(1).

    Modulo 2**64 such sums have structural collisions on long strings: use them to group windows, never to tell
    contents apart (`block_hashes` and `digests` do that).
    """
    out = np.zeros(len(data) + 1, U64)
    if len(data):
        np.cumsum(_LETTERS[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.empty(0, U64)
    down = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))


def block_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], chained over eight-byte blocks by a non-linear step.

    All strings advance by one block a round; strings of more than 64 bytes go through BLAKE2b.
    """
    size = (ends - starts).astype(np.int64)
    out = mix((size.astype(U64) + U64(1)) * BASE)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    blocks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # eight bytes from every place on
    at = np.flatnonzero((size > 0) & (size <= 8 * _BLOCKS))
    for k in range(_BLOCKS):
        if not len(at):
            break
        left = size[at] - 8 * k
        out[at] = mix((out[at] + U64(k)) ^ (blocks[starts[at] + 8 * k] & _MASKS[np.minimum(left, 8)]))
        at = at[left > 8]
    for k in np.flatnonzero(size > 8 * _BLOCKS).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit cryptographic digests of data[start:end], as rows of two 64-bit numbers."""
    raw, blake = data.tobytes(), hashlib.blake2b
    parts = [blake(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.frombuffer(b"".join(parts), U64).reshape(-1, 2)


def text_slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, their bytes, offsets into them) with a null text as an empty one."""
    col = batch.column(column)
    if pa.types.is_null(col.type):
        col = pa.nulls(len(col), pa.large_string())
    col = col.cast(pa.large_string()).fill_null("")
    if not len(col):
        return
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    row = 0
    while row < len(col):
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(len(col), max(row + 1, end))
        lo, hi = int(offsets[row]), int(offsets[end])
        yield row, end, data[lo:hi], offsets[row : end + 1] - lo
        row = end


def word_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a slice, and where each row's words begin (length rows + 1).

    Words never reach over a row's end: they begin and end there too.
    """
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    starts = np.flatnonzero(first)
    return block_hashes(_LOWER[data], starts, np.flatnonzero(last) + 1), np.searchsorted(starts, offsets, "left")
