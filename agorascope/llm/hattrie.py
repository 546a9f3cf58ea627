"""A HAT-trie of word sequences: burstable hash containers under a shallow trie of word ids.

A path is a sequence of 64-bit word ids, as big-endian bytes, so the order of bytes is the order of the
trie. Paths lie in hash containers, each for a range of first ids. A container that grows over BURST
entries gives its heaviest first words subtrees of their own, which hold the rest of the paths; words
with few entries stay together. When the trie holds over ``limit`` entries its largest subtrees are
spilled whole, as sorted runs of (path, count), until half of the entries are gone.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

ID = 8  # bytes of a word id
BURST = 8192
FAN = 64  # containers of a node, by the leading bits of the next word id


class Node:
    """A subtree: containers of the rests of its paths, and subtrees of single words."""

    __slots__ = ("containers", "children", "bounds", "size")

    def __init__(self):
        self.containers: list[dict[bytes, int]] = [{} for _ in range(FAN)]
        self.children: dict[bytes, Node] = {}
        self.bounds = [BURST] * FAN
        self.size = 0

    def add(self, paths: Iterable[bytes], counts: Iterable[int]) -> int:
        """Entries that are new."""
        before, children, containers = self.size, self.children, self.containers
        below: dict[bytes, tuple[list, list]] = {}
        for path, count in zip(paths, counts):
            if children and path[:ID] in children and len(path) > ID:
                rest = below.setdefault(path[:ID], ([], []))
                rest[0].append(path[ID:])
                rest[1].append(count)
                continue
            container = containers[path[0] >> 2]
            if path in container:
                container[path] += count
            else:
                container[path] = count
                self.size += 1
        for word, (paths, counts) in below.items():
            self.size += children[word].add(paths, counts)
        for i, container in enumerate(containers):
            if len(container) > self.bounds[i]:
                self._burst(i)
        return self.size - before

    def _burst(self, i: int) -> None:
        container, heavy = self.containers[i], {}
        for path in container:
            if len(path) > ID:
                heavy.setdefault(path[:ID], []).append(path)
        for word, paths in heavy.items():
            if len(paths) * 8 >= BURST:
                child = self.children[word] = Node()
                child.add([p[ID:] for p in paths], [container.pop(p) for p in paths])
        # what is left are words of few entries each: they stay together
        self.bounds[i] = max(BURST, 2 * len(container))

    def items(self, prefix: bytes = b"") -> Iterator[tuple[bytes, int]]:
        for container in self.containers:
            for path, count in container.items():
                yield prefix + path, count
        for word, child in self.children.items():
            yield from child.items(prefix + word)


class HatTrie:
    def __init__(self, limit: int = 1 << 20):
        self.limit = limit
        self.roots: list[Node] = [Node() for _ in range(256)]  # subtrees, by the first byte

    @property
    def size(self) -> int:
        return sum(r.size for r in self.roots)

    def add(self, paths: list[bytes], counts: list[int]) -> None:
        """Add paths sorted by their first byte."""
        low = 0
        while low < len(paths):
            head = paths[low][0]
            high = bisect_right(paths, head, low, key=lambda p: p[0])
            self.roots[head].add(paths[low:high], counts[low:high])
            low = high

    def spill(self, all_: bool = False) -> Iterator[list[tuple[bytes, int]]]:
        """Sorted runs of the largest subtrees where the trie is over its limit; of all at the end."""
        size = self.size
        if not all_ and size <= self.limit:
            return
        keep = 0 if all_ else self.limit // 2
        for i in sorted(range(256), key=lambda i: -self.roots[i].size):
            if size <= keep or not self.roots[i].size:
                break
            size -= self.roots[i].size
            run = sorted(self.roots[i].items())
            self.roots[i] = Node()
            yield run
