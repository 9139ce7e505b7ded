"""Word shingles of whole texts as sorted arrays of distinct 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np

WORDS = 5
CHUNK = 1 << 20

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype="u8") | np.uint64(1)
_COEFFICIENT = _RNG.integers(1, 1 << 63, 16, dtype="u8") | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE_TABLE = np.zeros(256, bool)
_SPACE_TABLE[[0x20, *range(0x09, 0x0E)]] = True
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_POWERS = np.ones(1, "u8")


def mixed(h: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([np.ones(1, "u8"), np.multiply.accumulate(np.full(2 * n, _BASE, "u8"))])
    return _POWERS


def _words(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of lower-cased bytes."""
    flat = np.frombuffer(blob, "u1")
    inside = ~_SPACE_TABLE[flat]
    edge = np.diff(inside.view("i1"), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, "u8"), starts
    length = ends - starts
    at = np.flatnonzero(inside)
    within = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    run = np.cumsum(_BYTE[flat[at]] * _powers(int(length.max()))[within])
    upto = run[np.cumsum(length) - 1]
    h = upto.copy()
    h[1:] -= upto[:-1]
    return mixed(h), starts


def _pieces(text: bytes):
    """A text's bytes, cut at white space into pieces of about CHUNK bytes."""
    at = 0
    while len(text) - at > CHUNK and (cut := _SPACE.search(text, at + CHUNK)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text."""
    hashes, counts = [], np.zeros(len(texts), "i8")
    group: list[tuple[int, bytes]] = []
    held = 0

    def close():
        nonlocal held
        if group:
            h, starts = _words(b" ".join(p for _, p in group))
            size = np.array([len(p) + 1 for _, p in group])
            own = np.searchsorted(np.cumsum(size), starts, side="right")
            np.add.at(counts, np.array([i for i, _ in group])[own], 1)
            hashes.append(h)
            group.clear()
            held = 0

    for i, text in enumerate(texts):
        for piece in _pieces(text.translate(_LOWER)):
            group.append((i, piece))
            held += len(piece)
            if held >= CHUNK:
                close()
    close()
    return (np.concatenate(hashes) if hashes else np.empty(0, "u8")), counts


def shingle_sets(texts: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """Distinct k-word shingles of each text; with fewer words the whole sequence is one; without words none."""
    w, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    if len(w) >= k:
        total = w[: len(w) - k + 1] * _COEFFICIENT[0]
        for j in range(1, k):
            total += w[j : len(w) - k + 1 + j] * _COEFFICIENT[j]
        total = mixed(total)
    out = []
    for end, n in zip(ends, counts, strict=True):
        if n >= k:
            own = np.sort(total[end - n : end - k + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif n:
            own = mixed((w[end - n : end] * _COEFFICIENT[:n]).sum(keepdims=True) + np.uint64(n))
        else:
            own = np.empty(0, "u8")
        out.append(own)
    return out
