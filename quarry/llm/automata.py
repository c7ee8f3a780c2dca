"""Substring dedup: removal of word sequences that occur elsewhere, by suffix automata of reference shards.

The reference is the corpus itself, so it has no bound and its automata can't be broadcast to all tasks. Instead it is
cut into shards by content: the contexts around the anchors (see `repeats`) of a gram, and equal windows always share their
anchor's gram. Contexts that occur whole more than once are settled before, by their hash. In the others, windows whose hash
is unique among those of the gram can't occur elsewhere and are left out; what remains of a context are runs of windows.
Equal runs are one reference string with several places. Suffix automata are built of the gram's different runs, at most
SHARD in each, every state knowing the least and the greatest place at which its strings end; the runs that have one place
are streamed through each automaton, and the matching statistic at each word is the longest string ending there that also ends
at another place. Spans of at least WINDOW words go. All sizes take this way; memory is that of a gram's runs and of one
automaton.

Null texts and texts without words have nothing to remove; copies of a text remove each other, so rows that repeat a text
lose every window; rows that share a doc_id, or lack one, are documents of their own. A very long text is cut at no place: its
words are hashed in one task. Other columns aren't read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from quarry.llm import repeats
from quarry.llm.words import grams, mix

WINDOW, GRAM, SHARD = 35, 8, 2000
SPEC = repeats.Spec("words", WINDOW, GRAM, earlier=False)


class Automaton:
    """Generalised suffix automaton of sequences whose items have places (one number from 0 for each item of the shard)."""

    def __init__(self):
        self.following: list[dict] = [{}]
        self.link, self.size = [-1], [0]
        self.low, self.high = [2**63 - 1], [-1]

    def _state(self, following: dict, link: int, size: int) -> int:
        self.following.append(following)
        self.link.append(link)
        self.size.append(size)
        self.low.append(2**63 - 1)
        self.high.append(-1)
        return len(self.size) - 1

    def _split(self, p: int, item, q: int) -> int:
        """The state of the longest string of p followed by item, parted from q."""
        clone = self._state(dict(self.following[q]), self.link[q], self.size[p] + 1)
        while p >= 0 and self.following[p].get(item) == q:
            self.following[p][item] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, items, low, high) -> None:
        """One more sequence, and the least and the greatest place of each item; call `close` after the last."""
        following, size, link = self.following, self.size, self.link
        last = 0
        for item, least, most in zip(items, low, high):
            q = following[last].get(item)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._split(last, item, q)
            else:
                p, last = last, self._state({}, 0, size[last] + 1)
                while p >= 0 and item not in following[p]:
                    following[p][item] = last
                    p = link[p]
                if p >= 0:
                    q = following[p][item]
                    link[last] = q if size[q] == size[p] + 1 else self._split(p, item, q)
            self.low[last] = min(self.low[last], least)
            self.high[last] = max(self.high[last], most)

    def close(self) -> None:
        """Hand the places on to shorter strings."""
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            p = self.link[s]
            self.low[p] = min(self.low[p], self.low[s])
            self.high[p] = max(self.high[p], self.high[s])

    def statistics(self, items, places) -> list[int]:
        """For each item of a sequence at `places`: length of the longest string ending there that also ends at another place."""
        out, state, length = [], 0, 0
        following, link, size, low, high = self.following, self.link, self.size, self.low, self.high
        for item, place in zip(items, places):
            while state and item not in following[state]:
                state = link[state]
                length = size[state]
            if item in following[state]:
                state, length = following[state][item], length + 1
            s, found = state, length
            while s > 0 and low[s] == place == high[s]:
                s = link[s]
                found = size[s]
            out.append(found if s > 0 else 0)
        return out


def _spans(statistics: list[int], window: int):
    """Maximal runs of items that strings of at least `window` items cover."""
    begin = end = -1
    for i, length in enumerate(statistics):
        if length >= window:
            if end >= 0 and i - length + 1 > end:
                yield begin, end
                end = -1
            begin = i - length + 1 if end < 0 else min(begin, i - length + 1)
            end = i + 1
    if end >= 0:
        yield begin, end


def _repeated(runs: dict[bytes, list[int]], window: int, shard: int):
    """(sequence, begin, end) of the spans of each sequence (by its 64-bit items, with its places) that occur at another place."""
    alone = [(key, at[0]) for key, at in runs.items() if min(at) == max(at)]
    for key, at in runs.items():
        if min(at) < max(at):
            yield key, 0, len(key) // 8
    if not alone:
        return
    keys, best = list(runs), {key: [0] * (len(key) // 8) for key, _ in alone}
    for first in range(0, len(keys), shard):
        automaton = Automaton()
        for key in keys[first : first + shard]:
            n = len(key) // 8
            automaton.add(np.frombuffer(key, np.uint64).tolist(), range(min(runs[key]), min(runs[key]) + n), range(max(runs[key]), max(runs[key]) + n))
        automaton.close()
        for key, place in alone:
            got = automaton.statistics(np.frombuffer(key, np.uint64).tolist(), range(place, place + len(key) // 8))
            best[key] = got if not first else list(map(max, best[key], got))
    for key, _ in alone:
        for begin, end in _spans(best[key], window):
            yield key, begin, end


def refine(spec, h, doc, start, size, known, lead, raw, shard: int = SHARD):
    """Intervals of the contexts, not known yet, whose windows end at another place too."""
    none = (np.zeros(0, np.int64),) * 3
    names, doc = np.unique(doc, return_inverse=True)  # dense numbers: ids may be negative, or too large to pack with a place
    base, count = np.cumsum(size) - size, np.maximum(0, size - spec.window + 1)
    which = np.repeat(np.arange(len(size)), count)
    if not len(which):
        return none
    at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    own = mix(grams(raw, spec.window)[base[which] + at] + mix(h)[which])  # of windows under one gram
    place = (doc[which] << 32) + start[which] + at
    order = np.lexsort((place, own))
    new = np.diff(own[order], prepend=~own[order][:1]) != 0
    cut = np.flatnonzero(new)
    several = place[order][cut] != place[order][np.append(cut[1:], len(order)) - 1]
    twice = np.zeros(len(order), bool)
    twice[order] = np.repeat(several, np.diff(np.append(cut, len(order))))
    kept = np.flatnonzero(twice)
    if not len(kept):
        return none
    cut = np.flatnonzero((np.diff(kept, prepend=-2) != 1) | (np.diff(which[kept], prepend=-1) != 0))
    first, last = kept[cut], kept[np.append(cut[1:], len(kept)) - 1]
    row, begin, end = which[first], at[first], at[last] + spec.window
    out = []
    order = np.argsort(h[row], kind="stable")
    cut = np.flatnonzero(np.diff(h[row][order], prepend=~h[row][order][:1]) != 0)
    for some in np.split(order, cut[1:]):
        if known[row[some]].all():
            continue
        runs: dict[bytes, list[int]] = {}
        held: dict[bytes, list[int]] = {}
        for k in some.tolist():
            r = row[k]
            key = raw[base[r] + begin[k] : base[r] + end[k]].tobytes()
            runs.setdefault(key, []).append(int((doc[r] << 32) + start[r] + begin[k]))
            if not known[r]:
                held.setdefault(key, []).append(k)
        for key, a, b in _repeated(runs, spec.window, shard):
            out += [(doc[row[k]], start[row[k]] + begin[k] + a, start[row[k]] + begin[k] + b) for k in held.get(key, ())]
    if not out:
        return none
    d, a, b = (np.array(x, np.int64) for x in zip(*out))
    return names[d], a, b


def _result(doc, data, gone, spans):
    starts, ends = spans
    text = data.tobytes()
    kept = b" ".join(text[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist()))
    return doc, len(starts), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()


def dedup(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with `keep`, the kept words joined by one space."""
    d, names, buckets = repeats.keyed(docs)
    found = repeats.find(d, SPEC, buckets, refine)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep else "")
    return repeats.named(repeats.finish(found, SPEC, _result, schema), names)
