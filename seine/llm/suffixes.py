"""Suffix sorting in blocks: which windows of some byte strings occur twice among those of the same bucket.

The suffixes of a block are sorted bucket by bucket on their first bytes. Ties beyond these are resolved by the ranks of
a sample that is ranked before: the positions whose residues form a difference cover. Any two suffixes reach sampled
positions by one common shift of less than the modulus, so one comparison of ranks decides, however long the tie is.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Modulus of the difference cover: so many bytes are compared before ranks decide. A multiple of 8.
COVER = 32
_WORD = 8


@cache
def difference_cover(v: int) -> tuple[np.ndarray, np.ndarray]:
    """(cover, shift): residues that hold each difference modulo v, and the least shift that takes residues a and b into them."""
    cover, open_ = [0], set(range(1, v))
    while open_:
        # the residue that adds most differences
        new = {x: open_ & {d % v for c in cover for d in (x - c, c - x)} for x in range(1, v)}
        best = max(new, key=lambda x: (len(new[x]), -x))
        open_ -= new[best]
        cover.append(best)
    inside = np.isin(np.arange(v), cover)
    shift = np.zeros((v, v), np.int64)
    for a in range(v):
        for b in range(v):
            shift[a, b] = next(d for d in range(v) if inside[(a + d) % v] and inside[(b + d) % v])
    return inside, shift


class Text:
    """Bytes with their big-endian words at every position; zeros follow the end."""

    def __init__(self, data: bytes, beyond: int):
        raw = data + bytes(beyond + 2 * _WORD)
        self.words = np.ndarray((len(raw) - _WORD,), ">u8", raw, strides=(1,))
        self.size = len(data)

    def word(self, at: np.ndarray) -> np.ndarray:
        return self.words[at].astype(np.uint64)

    def same(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the strings of this length, a multiple of 8, at a and at b are equal."""
        left = np.arange(len(a))
        for k in range(0, length, _WORD):
            left = left[self.words[a[left] + k] == self.words[b[left] + k]]
        out = np.zeros(len(a), bool)
        out[left] = True
        return out


def _starts(order_keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """Where a new key starts among sorted keys."""
    new = np.zeros(len(order_keys[0]), bool)
    new[:1] = True
    for k in order_keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def refined(text: Text, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group) of positions sorted by group and their first `length` bytes; group numbers ascend and are equal for equal strings. Each round sorts by a word what is still tied."""
    order = np.argsort(group, kind="stable")
    group = np.cumsum(_starts((group[order],)))
    for k in range(0, length, _WORD):
        sizes = np.bincount(group)
        tied = np.flatnonzero(sizes[group] > 1)
        if not len(tied):
            break
        own, word = group[tied], text.word(at[order[tied]] + k)
        by = np.lexsort((word, own))
        order[tied] = order[tied[by]]
        new = np.zeros(len(order), bool)
        new[_firsts(group)] = True
        # within the tied places, a new word starts a new group
        new[tied] |= _starts((own[by], word[by]))
        group = np.cumsum(new)
    return order, group


def _firsts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(_starts((group,)))


class CoverRanks:
    """Ranks of the sampled positions of some ranges of a text, by their first `length` bytes."""

    def __init__(self, text: Text, ranges: np.ndarray, length: int, v: int = COVER):
        self.v = v
        inside, self.shift = difference_cover(v)
        # the ranges are marked by where they begin and end
        marks = np.zeros(text.size + v + 2, np.int32)
        np.add.at(marks, ranges[:, 0], 1)
        np.add.at(marks, np.minimum(ranges[:, 1] + v, text.size + v), -1)
        known = np.cumsum(marks[:-1]) > 0
        sample = np.flatnonzero(known & inside[np.arange(len(known)) % v])
        order, group = refined(text, sample, np.zeros(len(sample), np.int64), length)
        self.rank = np.zeros(len(known), np.int32)
        self.rank[sample[order]] = group

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for suffixes that agree in their first v bytes."""
        d = self.shift[a % self.v, b % self.v]
        return np.sign(self.rank[a + d] - self.rank[b + d])


def suffix_order(text: Text, at: np.ndarray, bucket: np.ndarray, ranks: CoverRanks) -> np.ndarray:
    """The order of the suffixes at some positions: bucket by bucket, by their first bytes, then by the cover's ranks.

    Tied suffixes are parted by a comparison with one of them, all groups at once, until nothing is tied but equals.
    """
    order, group = refined(text, at, bucket, ranks.v)
    settled = np.zeros(len(order), bool)
    while True:
        tied = np.flatnonzero(~settled & (np.bincount(group)[group] > 1))
        if not len(tied):
            return order
        own = group[tied]
        first = _firsts(own)
        sizes = np.diff(np.append(first, len(own)))
        middle = np.repeat(first + sizes // 2, sizes)
        side = ranks.compare(at[order[tied]], at[order[tied[middle]]])
        by = np.lexsort((side, own))
        order[tied] = order[tied[by]]
        side = side[by]
        settled[tied] = side == 0
        new = np.zeros(len(order), bool)
        new[_firsts(group)] = True
        new[tied] |= _starts((own[by], side))
        group = np.cumsum(new)


def repeated(contexts: list[bytes], windows: np.ndarray, bucket: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context, which of its windows (those of `length` bytes from its first `windows` positions) some other
    window of the same bucket equals. length: a multiple of 8; bucket: a number for each context."""
    text = Text(b"".join(contexts), length + COVER)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    start = np.cumsum(sizes) - sizes
    first = np.cumsum(windows) - windows
    row = np.repeat(np.arange(len(contexts)), windows)
    at = start[row] + np.arange(len(row)) - first[row]
    ranks = CoverRanks(text, np.column_stack([start, start + windows]), length)
    order = suffix_order(text, at, bucket[row], ranks)
    # neighbours in the order share the longest prefixes
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(bucket[row[a]] == bucket[row[b]])
    near = near[text.same(at[a[near]], at[b[near]], length)]
    found = np.zeros(len(row), bool)
    found[a[near]] = found[b[near]] = True
    return np.split(found, first[1:])
