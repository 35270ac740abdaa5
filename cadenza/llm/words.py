"""Vectorised word hashing: 64-bit hashes of all words of a run of texts, without a Python loop over words.

A word is `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. Each byte has a fixed random 64-bit value; a word's
hash is the polynomial of its bytes' values modulo 2**64, finished by a bijective mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cadenza.llm.shared import text_slices

_RNG = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
#: As above, but everything in ASCII that is not a letter or digit separates words.
_PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BYTE_PUNCT = np.where(_PUNCT, np.uint64(0), _BYTE)
_BYTE[_SEP] = 0
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20
_powers: dict[int, np.ndarray] = {}
ROW = np.uint64(0xD6E8FEB86659FD93)


def folded(text: bytes) -> bytes:
    """UTF-8 text in Unicode's full case folding, which makes and removes no ASCII punctuation or space."""
    return text.lower() if text.isascii() else text.decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape")


def folded_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As text_slices, with texts in folded case: their words are the same ones, their bytes may differ in number."""
    for lo, hi, data, offs in text_slices(column):
        raw = data.tobytes()
        if not raw.isascii():
            texts = [folded(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            data, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        yield lo, hi, data, offs


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, _BLOCK + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def word_spans(data: np.ndarray, offs: np.ndarray, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word in order; long inputs go block by block, cut between words.

    punctuation: whether ASCII punctuation separates words too.
    """
    parts, at = [], 0
    while at < len(data):
        end = min(at + _BLOCK, len(data))
        while end < len(data) and not _SEP[data[end - 1]]:
            cut = np.flatnonzero(_SEP[data[end : end + 4096]])
            end = end + int(cut[0]) + 1 if len(cut) else min(end + 4096, len(data))
        lo, hi = np.searchsorted(offs, at, "right"), np.searchsorted(offs, end, "left")
        hashes, starts, ends = _block(data[at:end], offs[lo:hi] - at, punctuation)
        parts.append((hashes, starts + at, ends + at))
        at = end
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def word_hashes(data: np.ndarray, offs: np.ndarray, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, number of words of each text)."""
    hashes, starts, _ = word_spans(data, offs, punctuation)
    return hashes, np.diff(np.searchsorted(starts, offs))


def _block(data: np.ndarray, cuts: np.ndarray, punctuation: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_spans for one block; cuts: where a new text begins inside it."""
    sep = (_PUNCT if punctuation else _SEP)[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = sep[:-1]
    edge[cuts] = True
    starts = np.flatnonzero(edge[:-1] & ~sep)
    edge[1:-1] = sep[1:]
    edge[cuts] = True
    ends = np.flatnonzero(edge[1:] & ~sep) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    values = (_BYTE_PUNCT if punctuation else _BYTE)[data] * _powers_of(_BASE, len(data))
    sums = np.add.reduceat(values, starts)
    return mix(sums * _powers_of(_INVERSE, len(data))[starts]), starts, ends


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k-word shingle, number of shingles of each text); a text of fewer words has one for all its words."""
    counts = counts.astype(np.int64)
    ends = np.cumsum(counts)
    n = len(hashes)
    joined = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        joined = joined * ROW + hashes[j : j + len(joined)]
    valid = np.ones(len(joined), bool)
    for j in range(1, k):
        cut = ends[:-1][ends[:-1] > 0] - j
        valid[cut[(cut >= 0) & (cut < len(joined))]] = False
    # texts shorter than k words: their starts were cut; they get one value of their own
    out_counts = np.where(counts >= k, counts - k + 1, 0)
    long_values = mix(joined[valid])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if not len(short):
        return long_values, out_counts
    pos = np.cumsum(out_counts)
    values = []
    for d in short:
        h = np.uint64(counts[d])
        with np.errstate(over="ignore"):
            for w in hashes[ends[d] - counts[d] : ends[d]]:
                h = h * np.uint64(0xA0761D6478BD642F) + w
        values.append(h)
    out = np.insert(long_values, pos[short], mix(np.array(values, np.uint64)))
    out_counts[short] = 1
    return out, out_counts
