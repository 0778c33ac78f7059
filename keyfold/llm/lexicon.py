"""Word lexicon as a minimal acyclic transducer in flat arrays that can be memory-mapped."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import numpy as np

_HEADER = 4096


def minimal_automaton(words: Iterable[bytes]) -> tuple[list[tuple[bool, tuple[tuple[int, int], ...]]], int]:
    """States (final, arcs to earlier states) of the minimal acyclic automaton of sorted distinct words, and the root.

    Words come in byte order; suffixes that can no longer change are merged with
    an equal state as soon as the next word branches off.
    """
    register: dict = {}
    states: list = []

    def freeze(node) -> int:
        key = (node[0], tuple(node[1]))
        found = register.get(key)
        if found is None:
            found = register[key] = len(states)
            states.append(key)
        return found

    # Open path: node = [final, arcs done, byte of the arc to the next open node].
    path: list = [[False, [], 0]]
    previous = b""
    for word in words:
        same = 0
        stop = min(len(word), len(previous))
        while same < stop and word[same] == previous[same]:
            same += 1
        while len(path) > same + 1:
            node = path.pop()
            path[-1][1].append((path[-1][2], freeze(node)))
        for byte in word[same:]:
            path[-1][2] = byte
            path.append([False, [], 0])
        path[-1][0] = True
        previous = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((path[-1][2], freeze(node)))
    return states, freeze(path[0])


class Lexicon:
    """Maps frequent words to their ids by walking all words of a text through the automaton together.

    Every arc adds to a sum that ends as the word's number in byte order; the ids
    of word w are ``ids[first[w]:first[w + 1]]``. Arcs lie in displaced rows:
    state s has byte c at ``base[s] + c``, valid if ``owner`` there is s.
    """

    NAMES = ("base", "owner", "target", "add", "final", "first", "ids")

    def __init__(self, arrays: dict[str, np.ndarray], root: int, longest: int):
        self.__dict__.update(arrays)
        self.arrays, self.root, self.longest = arrays, root, longest
        self.size = len(self.first) - 1
        self.counts = np.diff(self.first)

    @classmethod
    def build(cls, words: Iterable[bytes], encode: Callable[[bytes], list[int]]) -> Lexicon:
        """Compile distinct non-empty words; ``encode`` gives the ids of one word."""
        ordered = sorted(set(words) - {b""})
        states, root = minimal_automaton(ordered)
        below = np.zeros(len(states) + 1, np.int64)  # words accepted from a state on
        for s, (final, arcs) in enumerate(states):
            below[s] = final + sum(below[t] for _, t in arcs)
        dead = len(states)
        base = [0] * (dead + 1)
        used = bytearray(1024)
        rows = []
        hint = single = 0
        for s in sorted((s for s in range(dead) if states[s][1]), key=lambda s: -len(states[s][1])):
            arcs = states[s][1]
            if len(arcs) == 1:  # any free place will do
                c = arcs[0][0]
                place = used.find(0, max(single, c))
                if c <= single:
                    single = place
                at = place - c
            else:  # first fit, from a start that moves on where little fits
                at, tries = hint, 0
                while any(used[at + c] for c, _ in arcs):
                    at += 1
                    tries += 1
                    if at + 512 > len(used):
                        used.extend(bytes(len(used)))
                if tries > 32:
                    hint = at - 16
            base[s] = at
            if at + 1024 > len(used):
                used.extend(bytes(len(used)))
            total = int(states[s][0])
            for c, t in arcs:
                used[at + c] = 1
                rows.append((at + c, s, t, total))
                total += int(below[t])
        top = max((r[0] for r in rows), default=0) + 1
        base[dead] = top
        base = np.array(base, np.int64)
        owner = np.full(top + 256, -1, np.int64)
        target = np.full(top + 256, dead, np.int64)
        add = np.zeros(top + 256, np.int64)
        if rows:
            at, s, t, sums = np.array(rows, np.int64).T
            owner[at], target[at], add[at] = s, t, sums
        owner, target, add = (np.append(x, np.full(256, f, np.int64)) for x, f in ((owner, -1), (target, dead), (add, 0)))
        final = np.array([f for f, _ in states] + [False])
        ids = [encode(w) for w in ordered]
        first = np.zeros(len(ordered) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=first[1:])
        flat = np.array([i for x in ids for i in x], np.int32)
        arrays = dict(base=base, owner=owner, target=target, add=add, final=final, first=first, ids=flat)
        return cls(arrays, root, max(map(len, ordered), default=0))

    def to_bytes(self) -> bytes:
        parts, at, index = [], _HEADER, {}
        for name in self.NAMES:
            raw = np.ascontiguousarray(self.arrays[name]).tobytes()
            raw += b"\0" * (-len(raw) % 64)
            index[name] = [str(self.arrays[name].dtype), len(self.arrays[name]), at]
            parts.append(raw)
            at += len(raw)
        head = json.dumps({"root": self.root, "longest": self.longest, "arrays": index}).encode()
        return head.ljust(_HEADER) + b"".join(parts)

    @classmethod
    def open(cls, path: str) -> Lexicon:
        """Memory-map a file written from ``to_bytes``: processes of one machine share its pages."""
        whole = np.memmap(path, np.uint8, "r")
        head = json.loads(bytes(whole[:_HEADER]))
        arrays = {
            name: np.frombuffer(whole, dtype, count, at) if count else np.zeros(0, dtype)
            for name, (dtype, count, at) in head["arrays"].items()
        }
        return cls(arrays, head["root"], head["longest"])

    def find(self, b: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of each word ``b[start:start + length]``, or -1 for one that isn't held."""
        out = np.full(starts.size, -1, np.int64)
        if self.size == 0 or starts.size == 0:
            return out
        clipped = np.minimum(lengths, self.longest + 1).astype(np.uint16)
        order = np.argsort(clipped, kind="stable")[::-1]
        size = clipped[order]
        pos = starts[order]
        state = np.full(order.size, self.root, np.int64)
        total = np.zeros(order.size, np.int64)
        held = np.flatnonzero(size <= self.longest)
        skip = int(held[0]) if held.size else order.size  # words longer than any held come first
        dead = self.base.size - 1
        active = np.searchsorted(-size.astype(np.int32), -np.arange(1, self.longest + 1), side="right")
        for k in range(self.longest):
            stop = int(active[k])
            if stop <= skip:
                break
            now = slice(skip, stop)
            arc = self.base[state[now]]
            arc += b[pos[now] + k]
            ok = self.owner[arc] == state[now]
            state[now] = np.where(ok, self.target[arc], dead)
            total[now] += self.add[arc]
        hit = self.final[state]
        hit[:skip] = False
        out[order[hit]] = total[hit]
        return out
