"""A trie of reference entries searched with a bit-parallel Levenshtein automaton.

The automaton is the non-deterministic one of the typed name: bit ``i`` of ``R[d]`` says that ``i`` characters of the
name can be consumed with at most ``d`` errors by the path walked so far. One step costs a few integer operations per
error level; a subtree is left as soon as no bit is set. A swap of neighbours counts as one error.
"""

from __future__ import annotations

from collections.abc import Iterable


class Trie:
    """Entries with payloads; several paths (aliases) may lead to one payload."""

    __slots__ = ("children", "ends", "longest", "shortest", "size")

    def __init__(self, entries: Iterable[tuple[str, int]]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[str, int]]] = [[]]
        #: Lengths of the entries below each node.
        self.shortest: list[int] = [1 << 30]
        self.longest: list[int] = [0]
        self.size = 0
        for form, payload in entries:
            self.add(form, payload)

    def add(self, form: str, payload: int) -> None:
        node, length = 0, len(form)
        for char in form:
            following = self.children[node].get(char)
            if following is None:
                following = self.children[node][char] = len(self.children)
                self.children.append({})
                self.ends.append([])
                self.shortest.append(length)
                self.longest.append(length)
            node = following
            self.shortest[node] = min(self.shortest[node], length)
            self.longest[node] = max(self.longest[node], length)
        if (form, payload) not in self.ends[node]:
            self.ends[node].append((form, payload))
            self.size += 1

    def exact(self, form: str) -> list[tuple[str, int]]:
        node = 0
        for char in form:
            node = self.children[node].get(char, -1)
            if node < 0:
                return []
        return self.ends[node]

    def search(self, name: str, limit: int) -> list[tuple[int, str, int]]:
        """All (distance, form, payload) with a distance up to ``limit``; their distances are exact."""
        length = len(name)
        goal, full = 1 << length, (1 << (length + 1)) - 1
        masks: dict[str, int] = {}
        for i, char in enumerate(name):
            masks[char] = masks.get(char, 0) | (1 << i)
        found: list[tuple[int, str, int]] = []
        start = tuple(((1 << (d + 1)) - 1) & full for d in range(limit + 1))
        stack = [(0, start, (0,) * (limit + 1))]
        children, ends, levels = self.children, self.ends, range(1, limit + 1)
        shortest, longest = self.shortest, self.longest
        while stack:
            node, states, swaps = stack.pop()
            if ends[node]:
                for d in range(limit + 1):
                    if states[d] & goal:
                        found += [(d, form, payload) for form, payload in ends[node]]
                        break
            for char, following in children[node].items():
                if shortest[following] > length + limit or longest[following] < length - limit:
                    continue
                mask = masks.get(char, 0)
                before = ((states[0] & mask) << 1) & full
                new, pending, alive = [before], [0], before
                for d in levels:
                    less = states[d - 1]
                    here = ((((states[d] & mask) << 1) | less | (less << 1) | (before << 1)) | ((swaps[d] & mask) << 2)) & full
                    new.append(here)
                    pending.append(less & (mask >> 1))
                    alive |= here
                    before = here
                if alive:
                    stack.append((following, tuple(new), tuple(pending)))
        return found
