"""BPE merges of many short words at once, on flat arrays."""

from __future__ import annotations

import numpy as np

_NONE = np.int64(1 << 40)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class MergeTable:
    """Ranked merges {(a, b): (rank, new)} as an open hash table of arrays."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        bits = max(4, int(np.ceil(np.log2(max(1, len(merges)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, _NONE, np.int64)
        self.new = np.zeros(max([r for r, _ in merges.values()], default=0) + 1, np.int64)
        pairs = np.array(list(merges), np.int64).reshape(-1, 2)
        for (a, b), slot, (rank, new) in zip(pairs.tolist(), self._slot(pairs[:, 0] << 20 | pairs[:, 1]).tolist(), merges.values(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.ranks[slot], self.new[rank] = a << 20 | b, rank, new

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 20 | b
        slot = self._slot(keys)
        out = self.ranks[slot]
        wrong = np.flatnonzero(self.keys[slot] != keys)
        while len(wrong):
            at = slot[wrong]
            full = self.keys[at] >= 0
            out[wrong[~full]] = _NONE
            wrong, at = wrong[full], (at[full] + 1) & self.mask
            slot[wrong] = at
            out[wrong] = self.ranks[at]
            wrong = wrong[self.keys[at] != keys[wrong]]
        return out

    def merge(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of words laid end to end, word i of sizes[i] >= 1; gives the merged ids and sizes.

        In each round every word has its merge of lowest rank done, at its leftmost place.
        """
        n = len(sizes)
        word = np.repeat(np.arange(n), sizes)
        ids = ids.astype(np.int64)
        rank = np.full(len(ids), _NONE)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.rank(ids[inner], ids[inner + 1])
        done_ids, done_words = [], []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(ids)]))
            live = least < _NONE
            if not live.all():
                done_ids.append(ids[~live])
                done_words.append(word[~live])
                ids, word, rank, least = ids[live], word[live], rank[live], least[live]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == least)
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]
            ids[at] = self.new[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word, rank = ids[keep], word[keep], rank[keep]
            at = at - np.arange(len(at))
            for left in (at, at[at > 0] - 1):
                paired = np.zeros(len(left), bool)
                ok = left + 1 < len(ids)
                paired[ok] = word[left[ok]] == word[left[ok] + 1]
                rank[left[~paired & (left >= 0)]] = _NONE
                left = left[paired]
                rank[left] = self.rank(ids[left], ids[left + 1])
        words = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        order = np.argsort(words, kind="stable")
        return np.concatenate(done_ids)[order] if done_ids else ids, np.bincount(words, minlength=n)
