"""Word n-gram hashes of whole texts, vectorised over Arrow string buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

N_WORDS = 5
#: Bytes of text hashed at once; longer texts are hashed alone.
SLICE = 1 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _rng.integers(1, 2**63, N_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64, n of them at least."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(SLICE + 1, n)
        with np.errstate(over="ignore"):
            have = np.full(size, base, np.uint64)
            have[0] = 1
            have = np.cumprod(have, dtype=np.uint64)
        if size > SLICE + 1:
            return have
        _powers[base] = have
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; nulls have no bytes."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, start, end) of every word of the texts data[bounds[i]:bounds[i + 1]]."""
    n = len(data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.empty(n + 1, bool)
    before[0], before[1:] = False, inside
    before[bounds] = False
    after = np.empty(n + 1, bool)
    after[n], after[:n] = False, inside
    after[bounds] = False
    starts = np.flatnonzero(inside & ~before[:n])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _power(_BASE, n + 1)[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_BASE_INVERSE, n + 1)[starts]
    h = mix64(h ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(bounds, starts, side="right") - 1, starts, ends


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of texts of most bytes together, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def shingle_sets(column: pa.Array, width: int = N_WORDS) -> Iterator[np.ndarray]:
    """For each text its sorted distinct n-gram hashes. Fewer words than width: one n-gram of all of them; none: empty."""
    offsets, data = string_buffers(column)
    with np.errstate(over="ignore"):
        for i, j in slices(offsets):
            bounds = offsets[i : j + 1] - offsets[i]
            h, text, _, _ = word_hashes(data[offsets[i] : offsets[j]], bounds)
            first = np.searchsorted(text, np.arange(j - i + 1))
            m = len(h) - width + 1
            grams = np.zeros(max(m, 0), np.uint64)
            for k in range(width):
                grams += h[k : k + len(grams)] * _PLACE[k]
            grams = mix64(grams)
            for t in range(j - i):
                a, b = first[t], first[t + 1]
                if b - a >= width:
                    yield np.unique(grams[a : b - width + 1])
                elif b > a:
                    yield mix64(np.array([(h[a:b] * _PLACE[: b - a]).sum() + np.uint64(b - a)], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)
