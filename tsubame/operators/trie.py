"""A prefix trie in flat arrays, searched from all positions of a text batch at once.

Nodes are numbered by depth and, at one depth, in the order of their prefixes, so children
of a node are one range, sorted by their characters. One step of all positions that are
still alive is a binary search in these ranges, in step as well. What a run of sorted
surfaces gives to each depth (``levels``) can be made where the run lies; ``Levels`` joins
such runs in files, so a trie of any size is made without holding it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tsubame.functions.segment import code_points

FIELDS = ("first", "label", "kids", "lo", "hi")
# Columns of a level: character, number of children, first row, rows that end at the node.
LABEL, KIDS, ROW, ENDS = range(4)
# Nodes that are brought into their arrays at a time.
BLOCK = 1 << 20


class Trie:
    """Surfaces as ``FIELDS``: children of the root by code point; character, first child and range of rows of each node."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.arrays = arrays
        self.first, self.label, self.kids, self.lo, self.hi = (arrays[f] for f in FIELDS)

    @staticmethod
    def of(surfaces: pa.Array) -> Trie:
        """Of sorted surfaces; equal ones are one range of rows. The empty string is no surface."""
        made = levels(surfaces)
        out = {f: np.zeros(n, t) for f, (n, t) in shapes(sum(map(len, made))).items()}
        fill(out, made)
        return Trie(out)

    def child(self, node: np.ndarray, ch: np.ndarray) -> np.ndarray:
        """Children along one character each; 0 where there is none."""
        lo, end = self.kids[node], self.kids[node + 1]
        hi = end
        for _ in range(int((end - lo).max(initial=0)).bit_length()):
            mid = (lo + hi) >> 1
            # A range that is used up stays so: its middle is its end.
            less = (self.label.take(mid, mode="clip") < ch) & (lo < hi)
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
        return np.where((lo < end) & (self.label.take(lo, mode="clip") == ch), lo, 0)

    def matches(self, cp: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(position, length, first row, end row) of every surface in the text, in order of positions, shortest first.

        ``stop`` has, for each position, the end of what may be read from there.
        """
        node = self.first[cp]
        at = np.flatnonzero(node)
        node, depth, found = node[at], 1, []
        while len(at):
            lo, hi = self.lo[node], self.hi[node]
            full = hi > lo
            found.append((at[full], np.full(np.count_nonzero(full), depth), lo[full], hi[full]))
            on = (at + depth < stop[at]) & (self.kids[node + 1] > self.kids[node])
            at, node = at[on], node[on]
            node = self.child(node, cp[at + depth])
            on = node > 0
            at, node, depth = at[on], node[on], depth + 1
        if not found:
            return (np.zeros(0, np.int64),) * 4
        pos, length, lo, hi = (np.concatenate([f[i] for f in found]) for i in range(4))
        order = np.argsort(pos, kind="stable")
        return pos[order], length[order], lo[order].astype(np.int64), hi[order].astype(np.int64)


def levels(surfaces: pa.Array) -> list[np.ndarray]:
    """Nodes of each depth from 1 on, as rows of (LABEL, KIDS, ROW, ENDS), of sorted surfaces."""
    cp, at = code_points(surfaces)
    size = np.diff(at)
    rows = np.flatnonzero(size > 0)
    parent, out = np.zeros(len(rows), np.int64), []
    while len(rows):
        depth = len(out)
        ch = cp[at[rows] + depth]
        new = np.ones(len(rows), bool)
        new[1:] = (parent[1:] != parent[:-1]) | (ch[1:] != ch[:-1])
        begin = np.flatnonzero(new)
        if out:
            out[-1][:, KIDS] = np.bincount(parent[begin], minlength=len(out[-1]))
        # Rows that end here come first among those of the node.
        ends = size[rows] == depth + 1
        out.append(np.stack([ch[begin], np.zeros(len(begin), np.int64), rows[begin], np.add.reduceat(ends, begin)], 1).astype(np.int32))
        node = np.cumsum(new) - 1
        rows, parent = rows[~ends], node[~ends]
    return out


def shapes(nodes: int) -> dict[str, tuple[int, type]]:
    """Sizes and types of a trie's arrays; node 0 is the root."""
    number = np.int32 if nodes < 1 << 30 else np.int64
    return dict(zip(FIELDS, ((0x110000, number), (nodes + 1, np.uint32), (nodes + 2, number), (nodes + 1, np.int32), (nodes + 1, np.int32)), strict=True))


def fill(out: dict[str, np.ndarray], made: list[np.ndarray]) -> None:
    """Brings the nodes of all depths into the arrays of a trie, which may lie in files."""
    n = 1
    # Children of earlier nodes lie before those of later ones, and the root's before all.
    out["kids"][0], next_kid = 1, 1 + (len(made[0]) if made else 0)
    for depth, level in enumerate(made):
        for i in range(0, len(level), BLOCK):
            x = np.asarray(level[i : i + BLOCK])
            here = slice(n, n + len(x))
            out["label"][here] = x[:, LABEL]
            kids = np.cumsum(x[:, KIDS], dtype=np.int64)
            out["kids"][here] = next_kid + kids - x[:, KIDS]
            out["lo"][here] = x[:, ROW]
            out["hi"][here] = x[:, ROW] + x[:, ENDS]
            if not depth:
                out["first"][x[:, LABEL]] = np.arange(here.start, here.stop)
            n, next_kid = here.stop, next_kid + int(kids[-1])
    out["kids"][n] = next_kid


class Levels:
    """Levels of a long run of sorted surfaces, joined from those of its parts; each depth lies in a file of its own."""

    def __init__(self, folder: str) -> None:
        self.folder, self.depths, self.rows, self.last = folder, 0, 0, ""

    def _path(self, depth: int) -> str:
        return os.path.join(self.folder, f"level-{depth}")

    def add(self, first: str, last: str, rows: int, parts: Iterator[bytes]) -> None:
        """The next part: its first and last surface, its number of rows and its levels."""
        common = len(os.path.commonprefix([self.last, first]))
        for depth, raw in enumerate(parts):
            x = np.frombuffer(raw, np.int32).reshape(-1, 4).copy()
            x[:, ROW] += self.rows
            with open(self._path(depth), "r+b" if depth < self.depths else "w+b") as f:
                f.seek(0, os.SEEK_END)
                if depth < common:
                    # The part begins in the node that was the last one so far.
                    f.seek(-16, os.SEEK_END)
                    before = np.frombuffer(f.read(16), np.int32)
                    f.seek(-16, os.SEEK_END)
                    x[0, KIDS] += before[KIDS] - (depth + 1 < common)
                    if before[ENDS]:
                        x[0, ROW], x[0, ENDS] = before[ROW], before[ENDS] + x[0, ENDS]
                x.tofile(f)
            self.depths = max(self.depths, depth + 1)
        self.rows, self.last = self.rows + rows, last

    def all(self) -> list[np.ndarray]:
        return [np.memmap(self._path(d), np.int32, "r").reshape(-1, 4) for d in range(self.depths)]
