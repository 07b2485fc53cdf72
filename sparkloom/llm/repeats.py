"""Repeated windows of a fixed length, found exactly by winnowed anchors.

A window of `length` symbols owns the position of its smallest k-gram hash (the leftmost, if it
occurs twice). Equal windows own their anchor at the same distance, so only windows whose anchors
agree can be equal. Windows that follow one another and share an anchor form a segment.

Round 1 asks of each distinct anchor of a chunk whether it occurs elsewhere, and whether it does so in
several surroundings (segments that differ). An anchor that occurs once settles its windows: they have
no copy. One that always stands in the same segment settles them too: all are repeated. The rest,
anchors in several surroundings, are what the operators compare in round 2.
"""

from __future__ import annotations

import numpy as np

from .arrays import Spans, mix, sliding_min, windows_within

_POSITION = np.uint64((1 << 24) - 1)
TWICE, SEVERAL = 1, 2


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    head = np.zeros(len(keys[0]), bool)
    head[:1] = True
    for k in keys:
        head[1:] |= k[1:] != k[:-1]
    return head


class Segments:
    """The segments of a chunk: anchor, first and last window start, and their keys."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.length, self.gram, self.spans = length, gram, Spans(symbols)
        starts = windows_within(offsets, length)
        grams = self.spans.every(gram)
        if not len(starts):
            self.anchor = self.first = self.last = np.zeros(0, np.int64)
            self.a_key = self.s_key = np.zeros(0, np.uint64)
        else:
            anchors = np.concatenate([x for x in self._anchors(grams, length - gram + 1)])[starts]
            new = np.ones(len(starts), bool)
            new[1:] = (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1)
            opens = np.flatnonzero(new)
            self.anchor, self.first = anchors[opens], starts[opens]
            self.last = starts[np.append(opens[1:], len(starts)) - 1]
            self.a_key = grams[self.anchor]
            whole = self.spans.hash(self.first, self.last + length)
            self.s_key = mix(whole + (self.anchor - self.first).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        order = np.lexsort((self.s_key, self.a_key))
        a, s = self.a_key[order], self.s_key[order]
        of_pair, of_anchor = _heads(a, s), _heads(a)
        #: a segment of each distinct pair (anchor, surroundings), how often the pair occurs, each segment's pair
        self.distinct = order[of_pair]
        self.pair = np.empty(len(order), np.int64)
        self.pair[order] = np.cumsum(of_pair) - 1
        self.count = np.bincount(self.pair, minlength=len(self.distinct))
        #: the distinct anchors: a segment of each, its number for each segment, whether it is met twice, in several surroundings
        self.anchors = order[of_anchor]
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(of_anchor) - 1
        n = len(self.anchors)
        self.twice = np.bincount(self.which, minlength=n) > 1
        self.several = np.bincount(self.which[self.distinct], minlength=n) > 1

    @staticmethod
    def _anchors(grams, w):
        """Positions of the leftmost smallest gram in each run of w, a stretch at a time: a
        position takes 24 bits of the compared value, the hash the other 40."""
        step = int(_POSITION) + 1 - w
        for at in range(0, len(grams) - w + 1, step):
            part = grams[at : at + step + w - 1]
            low = sliding_min((part & ~_POSITION) | np.arange(len(part), dtype=np.uint64), w)
            yield (low & _POSITION).astype(np.int64) + at

    def windows(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """All window starts of some runs of windows, run by run."""
        sizes = last - first + 1
        return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def by_shard(keys: np.ndarray, shards: int):
    """The places of `keys` for each shard, in an order that a later pass repeats."""
    shard = (keys % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    at = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.unique(shard).tolist():
        yield s, order[at[s] : at[s + 1]]


def ask_anchors(found: Segments, shards: int):
    """Round 1: the distinct anchors of a chunk, one of their surroundings, and what is known here."""
    a, s = found.a_key[found.anchors], found.s_key[found.anchors]
    known = (TWICE * found.twice + SEVERAL * found.several).astype(np.uint8)
    for shard, rows in by_shard(a, shards):
        yield shard, a[rows].tobytes() + s[rows].tobytes() + known[rows].tobytes()


def answer_anchors(asked: list[bytes]) -> list[bytes]:
    """For each anchor: TWICE if it occurs elsewhere too, SEVERAL if in several surroundings."""
    sizes = [len(x) // 17 for x in asked]
    a = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(asked, sizes, strict=True)])
    s = np.concatenate([np.frombuffer(x, np.uint64, n, 8 * n) for x, n in zip(asked, sizes, strict=True)])
    known = np.concatenate([np.frombuffer(x, np.uint8, n, 16 * n) for x, n in zip(asked, sizes, strict=True)])
    order = np.argsort(a, kind="stable")
    a, s, known = a[order], s[order], known[order]
    head = _heads(a)
    at, group = np.flatnonzero(head), np.cumsum(head) - 1
    times = np.bincount(group)
    twice = (times > 1) | (np.bitwise_or.reduceat(known, at) & TWICE > 0) if len(at) else np.zeros(0, bool)
    several = (np.minimum.reduceat(s, at) != np.maximum.reduceat(s, at)) | (np.bitwise_or.reduceat(known, at) & SEVERAL > 0) if len(at) else np.zeros(0, bool)
    flags = np.empty(len(a), np.uint8)
    flags[order] = (TWICE * twice + SEVERAL * several).astype(np.uint8)[group]
    return [x.tobytes() for x in np.split(flags, np.cumsum(sizes)[:-1])]


def read_anchors(found: Segments, answers: dict[int, bytes], shards: int) -> np.ndarray:
    """The flags of round 1 for each segment."""
    flags = np.zeros(len(found.anchors), np.uint8)
    for s, rows in by_shard(found.a_key[found.anchors], shards):
        flags[rows] = np.frombuffer(answers[s], np.uint8)
    return flags[found.which]


def open_segments(found: Segments, flags: np.ndarray) -> np.ndarray:
    """A segment of each distinct pair whose anchor has several surroundings: what round 2 compares."""
    return found.distinct[flags[found.distinct] & SEVERAL > 0]


def covered(found: Segments, flags: np.ndarray, hits: np.ndarray, n: int) -> np.ndarray:
    """Which of a chunk's n symbols lie in repeated windows: those of segments that are repeated as a
    whole, and the windows `hits` that round 2 found."""
    whole = np.flatnonzero((flags == TWICE) | ((flags & SEVERAL > 0) & (found.count[found.pair] > 1)))
    starts, stops = np.concatenate([found.first[whole], hits]), np.concatenate([found.last[whole], hits]) + found.length
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(stops, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0
