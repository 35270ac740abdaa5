"""Byte pair merges of many words at once, as arrays.

A word begins as the symbols of its bytes, the last one with the vocabulary's end of word. In every round each word that has
a pair to merge merges one, as the library does: that of the lowest rank, of several the leftmost. Words without such a pair leave the
arrays, so rounds shrink; there are as many as the longest word has merges. Pairs are found in hash tables.
"""

from __future__ import annotations

import numpy as np

#: Above the rank of any merge.
NONE = 1 << 30
_EMPTY = np.uint64(2**64 - 1)
_BITS = 18


class PairMerges:
    """The merges of one byte-level vocabulary. letters: the letter that stands for each byte; suffix: what ends a word."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str, letters: dict[int, str]) -> None:
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32)
        self.into = np.array([vocab[a + b] for a, b in pairs], np.int32)
        rank = {(vocab[a] << 32) | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.tables: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []  # (multiplier, pair in each slot, its rank); what finds its slot taken goes to the next table
        keys, ranks = np.fromiter(rank.keys(), np.uint64, len(rank)), np.fromiter(rank.values(), np.int64, len(rank))
        multipliers = np.random.Generator(np.random.PCG64(20240502))
        while len(keys):
            multiplier = multipliers.integers(0, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            slot, first = np.unique(_slots(keys, multiplier), return_index=True)
            pair, of = np.full(1 << _BITS, _EMPTY), np.full(1 << _BITS, NONE, np.int32)
            pair[slot], of[slot] = keys[first], ranks[first]
            self.tables.append((multiplier, pair, of))
            keys, ranks = np.delete(keys, first), np.delete(ranks, first)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair of ids, or NONE."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        out = np.full(len(key), NONE, np.int32)
        rest = np.arange(len(key))
        for multiplier, pair, of in self.tables:
            slot = _slots(key, multiplier)
            found = pair[slot]
            same = found == key
            out[rest[same]] = of[slot[same]]
            other = ~same & (found != _EMPTY)
            rest, key = rest[other], key[other]
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each) of words whose bytes lie end to end from `starts` on; none is empty."""
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(data)))
        ends = starts + size - 1
        ids = self.inner[data]
        ids[ends] = self.last[data[ends]]
        rank = np.append(self.ranks(ids[:-1], ids[1:]), np.int32(NONE))
        rank[ends] = NONE
        word, at, done = np.arange(len(starts)), starts, []
        lens = np.zeros(len(starts), np.int64)
        while len(word):
            low = np.minimum.reduceat((rank.astype(np.int64) << 32) | np.arange(len(rank)), at)
            more = low < NONE << 32
            keep = np.repeat(more, size)
            done.append((word[~more], ids[~keep]))
            lens[word[~more]] = size[~more]
            place = low[more] & 0xFFFFFFFF
            ids[place] = self.into[low[more] >> 32]
            keep[place + 1] = False
            place -= at[more]
            word, size, ids, rank = word[more], size[more] - 1, ids[keep], rank[keep]
            at = np.cumsum(size) - size
            place += at
            rank[place] = NONE
            of = place[place + 1 < at + size]
            rank[of] = self.ranks(ids[of], ids[of + 1])
            of = place[place > at]
            rank[of - 1] = self.ranks(ids[of - 1], ids[of])
        out = np.zeros(lens.sum(), "<u4")
        begin = np.cumsum(lens) - lens
        for words, found in done:
            out[spread(begin[words], lens[words])] = found
        return out, lens


def _slots(keys: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    return (((keys ^ (keys >> np.uint64(32))) * multiplier) >> np.uint64(64 - _BITS)).astype(np.int64)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many as its size."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
