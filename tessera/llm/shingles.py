"""Vectorised word shingles of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
SLICE_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base)]))


_FORWARD, _BACKWARD = _powers(_STEP, 1 << 12), _powers(_BACK, 1 << 12)


def _power_arrays(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _FORWARD, _BACKWARD
    if len(_FORWARD) <= n:
        _FORWARD, _BACKWARD = _powers(_STEP, n), _powers(_BACK, n)
    return _FORWARD[: n + 1], _BACKWARD[: n + 1]


def slices(texts: list[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts, lower-cased in A-Z, in groups of about ``limit`` bytes; with the place of the first."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode().lower()
        if held and size + len(data) > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield start, held


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    A word's hash is a polynomial over random byte values; a shingle's hash mixes
    those of its words in order. A text with fewer words is one shingle of all
    its words; one without words has none.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[data]
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    stops = np.flatnonzero(space & np.concatenate([[False], inside[:-1]]))
    forward, backward = _power_arrays(len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * forward[: len(data)])])
    word = mix64((total[stops] - total[starts]) * backward[starts] + (stops - starts).astype(np.uint64))
    first = np.searchsorted(starts, np.concatenate([[0], ends_of_text]))
    n = len(word)
    full = word.copy()
    for k in range(1, width):
        full[: n - k] = mix64(full[: n - k] * np.uint64(3) + word[k:]) if k < n else full[:0]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            h = word[a : a + 1].copy()
            for k in range(a + 1, b):
                h = mix64(h * np.uint64(3) + word[k : k + 1])
            out.append(h + np.uint64(b - a))  # not to be taken for a shingle of full width
        else:
            out.append(np.zeros(0, np.uint64))
    return out
