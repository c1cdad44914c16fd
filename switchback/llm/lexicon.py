"""A minimal acyclic transducer from words to token ids, in one file that readers map into memory."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

MAGIC = b"MATL0001"


class _State:
    __slots__ = ("arcs", "final", "number", "words")

    def __init__(self) -> None:
        self.arcs: dict[int, _State] = {}
        self.final, self.words, self.number = False, 0, -1

    def key(self) -> tuple:
        return (self.final, tuple((c, id(s)) for c, s in self.arcs.items()))


def compile_lexicon(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The file's bytes for distinct words and their ids.

    Words go in by byte order. States that accept the same suffixes are one state. Every arc holds the number of words
    that leave its state by smaller labels; the sum along a word's path, and of the words that end on it, is the word's place among all words,
    and so the place of its ids.
    """
    entries = sorted(entries)
    root, known, path = _State(), {}, []  # path: (parent, label, child) not yet merged

    def merge(down_to: int) -> None:
        while len(path) > down_to:
            parent, label, child = path.pop()
            parent.arcs[label] = known.setdefault(child.key(), child)

    before = b""
    for word, _ in entries:
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        merge(same)
        state = path[-1][2] if path else root
        for label in word[same:]:
            state.arcs[label] = child = _State()
            path.append((state, label, child))
            state = child
        state.final, before = True, word
    merge(0)

    order: list[_State] = []
    stack = [(root, False)]
    while stack:  # children before parents, so that words are counted once
        state, done = stack.pop()
        if done:
            if state.number < 0:
                state.words = state.final + sum(s.words for s in state.arcs.values())
                state.number = len(order)
                order.append(state)
        elif state.number < 0:
            stack.append((state, True))
            stack += [(s, False) for s in state.arcs.values() if s.number < 0]
    first, labels, targets, skips = [0], [], [], []
    for state in order:
        passed = int(state.final)
        for label, child in sorted(state.arcs.items()):
            labels.append(label)
            targets.append(child.number)
            skips.append(passed)
            passed += child.words
        first.append(len(labels))
    out_first = np.concatenate([[0], np.cumsum([len(ids) for _, ids in entries])]).astype("<i4")
    head = MAGIC + struct.pack("<5i", len(order), len(labels), len(entries), int(out_first[-1]), root.number)
    parts = [
        np.array(first, "<i4"), np.array(targets, "<i4"), np.array(skips, "<i4"), out_first, np.array([i for _, ids in entries for i in ids], "<u4"),
        np.array(labels, np.uint8), np.array([s.final for s in order], np.uint8)
    ]
    return head + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A reader of such a file; the operating system shares its pages among processes."""

    def __init__(self, path: str) -> None:
        data = memoryview(np.memmap(path, np.uint8, "r"))
        if bytes(data[:8]) != MAGIC:
            raise ValueError(f"{path} is not a lexicon")
        states, arcs, words, ids, self.root = struct.unpack("<5i", data[8:28])
        at = 28

        def take(n: int, kind: str, width: int) -> memoryview:
            nonlocal at
            at += n * width
            return data[at - n * width : at].cast(kind)

        self.first, self.target, self.skip = take(states + 1, "i", 4), take(arcs, "i", 4), take(arcs, "i", 4)
        self.out_first, self.out = take(words + 1, "i", 4), take(ids, "I", 4)
        self.label, self.final = take(arcs, "B", 1), take(states, "B", 1)
        self.states, self.words = states, words
        first, label = np.asarray(self.first), np.asarray(self.label)
        self.steps = np.repeat(np.arange(states, dtype=np.int64), np.diff(first)) << 8 | label  # in order, as labels are within their state

    def get(self, word: bytes) -> tuple[int, ...] | None:
        state, place, first, label = self.root, 0, self.first, self.label
        for c in word:
            lo, hi = first[state], first[state + 1]
            while lo < hi:
                mid = (lo + hi) >> 1
                if label[mid] < c:
                    lo = mid + 1
                else:
                    hi = mid
            if lo == first[state + 1] or label[lo] != c:
                return None
            place += self.skip[lo]
            state = self.target[lo]
        return tuple(self.out[self.out_first[place] : self.out_first[place + 1]]) if self.final[state] else None

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word as little-endian unsigned 32-bit numbers, or None: all words take their next step at once."""
        sizes = np.array([len(w) for w in words], np.int64)
        data, at = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        target, skip, final = np.asarray(self.target), np.asarray(self.skip), np.asarray(self.final)
        alive, state, place = np.flatnonzero(sizes), np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        found = np.full(len(words), -1, np.int64)
        k = 0
        while len(alive) and len(self.steps):
            want = state[alive] << 8 | data[at[alive] + k]
            arc = np.minimum(np.searchsorted(self.steps, want), len(self.steps) - 1)
            ok = self.steps[arc] == want
            alive, arc, k = alive[ok], arc[ok], k + 1
            place[alive] += skip[arc]
            state[alive] = target[arc]
            ended = sizes[alive] == k
            done = alive[ended]
            done = done[final[state[done]] > 0]
            found[done] = place[done]
            alive = alive[~ended]
        out, ends = np.asarray(self.out), np.asarray(self.out_first)
        return [None if i < 0 else out[ends[i] : ends[i + 1]].tobytes() for i in found.tolist()]
