"""The decoder: candidates and minimum-cost paths of all segments of an Arrow batch, in step.

Code points, types, runs, entries (see ``trie``) and unknown words of a batch are flat arrays;
nodes lie sorted by end, so those that end at one place are a range. Where no node spans a
place and all that end there have one right_id, nothing behind depends on how it was
reached: segments are cut there into pieces. All pieces are then decoded together, one
place a step: totals of the nodes that end at a place plus the connection costs gathered
for the nodes that start there, and a segmented minimum whose key holds the order in
which ties are decided. Paths are read back in step as well.

A run of a class that groups without limit, in which no entry starts or ends, is one node if
no path through its characters can be cheaper, so text outside a lexicon costs a node a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tsubame.functions.charclass import TYPES, Classifier, class_of_type
from tsubame.functions.readings import NUMBER_POS, in_context
from tsubame.functions.segment import code_points, segment_ends
from tsubame.operators.entries import Entries

# Cost and part of speech of unknown words whose class has no template.
UNKNOWN_BY_TYPE = {
    "KANJI": (7000, "名詞,一般,*,*"),
    "HIRAGANA": (8000, "名詞,一般,*,*"),
    "KATAKANA": (5000, "名詞,一般,*,*"),
    "ALPHA": (6000, "名詞,固有名詞,組織,*"),
    "NUMERIC": (6000, "名詞,数,*,*"),
    "NUMERICWIDE": (6000, "名詞,数,*,*"),
    "SYMBOL": (9000, "記号,一般,*,*"),
    "SPACE": (3000, "記号,空白,*,*"),
    "DEFAULT": (10000, "名詞,サ変接続,*,*"),
}
UNKNOWN_FLAT = (10000, "名詞,一般,*,*")
# Characters of whole segments that are decoded at a time: bounds the memory of the nodes.
CHUNK_CHARS = 1 << 18
# Spelled words that a worker remembers.
SPOKEN_WORDS = 500_000
# A total that no path has.
FAR = 1 << 42
# Nodes that end at one place, as bits, up to which a total and the node's place make one number.
PACKED_BITS = 20

TOKEN_TYPE = pa.struct([
    ("surface", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pos", pa.string()), ("base_form", pa.string()),
    ("reading", pa.string()), ("pronunciation", pa.string()), ("word_cost", pa.int16()), ("is_known", pa.bool_()),
])
TOTAL_TYPE = pa.struct([("n_tokens", pa.int32()), ("n_known", pa.int32()), ("word_costs", pa.int64())])


def unknown_templates(classifier: Classifier, unk: list[tuple], mode: str = "by_class") -> list[tuple]:
    """For each type: (invoke, group, length, left_id, right_id, cost, pos).

    ``unk`` holds (class, left_id, right_id, cost, pos) in order; the first one counts.
    """
    first: dict[str, tuple] = {}
    for u in unk:
        first.setdefault(u[0], tuple(u[1:]))
    out = []
    for kind in TYPES:
        default = (0, 0, *(UNKNOWN_BY_TYPE[kind] if mode == "by_class" else UNKNOWN_FLAT))
        out.append((*classifier.settings(kind), *first.get(class_of_type(kind), default)))
    return out


def spans(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, .. (count of them), one range behind the other."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(begin - (np.cumsum(count) - count), count)


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """A batch in slices of about CHUNK_CHARS bytes of text: bounds what is made of a batch at a time."""
    end = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = done = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(end, done + CHUNK_CHARS, "right")))
        yield texts.slice(a, b - a)
        a, done = b, int(end[b - 1])


def first_least(value: np.ndarray, offset: np.ndarray, size: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value of each range, and the first place in the range that has it."""
    place = np.arange(len(value)) - np.repeat(offset, size)
    if bits <= PACKED_BITS:
        least = np.minimum.reduceat((value << bits) | place, offset)
        return least >> bits, least & ((1 << bits) - 1)
    least = np.minimum.reduceat(value, offset)
    place[value != np.repeat(least, size)] = len(value)
    return least, np.minimum.reduceat(place, offset)


class Nodes:
    """Candidates as columns, sorted by end, then start, known before unknown, then entry: the order of ties.

    ``row`` is the entry's row, or the type's number for an unknown word.
    """

    def __init__(self, start: np.ndarray, end: np.ndarray, unk: np.ndarray, row: np.ndarray, places: int) -> None:
        order = np.argsort((end << 32 | start) << 1 | unk, kind="stable")
        self.start, self.end, self.unk, self.row = start[order], end[order], unk[order].astype(bool), row[order]
        self.size = np.bincount(self.end, minlength=places)
        self.first = np.cumsum(self.size) - self.size


class Kernel:
    """All that decoding needs, in one object that is broadcast once; entries and costs lie in shared files."""

    def __init__(self, entries: Entries | list[tuple], matrix: np.ndarray, classifier: Classifier, unknown: list[tuple], costs=None) -> None:  # noqa: ANN001
        self.entries = entries if isinstance(entries, Entries) else Entries.of(entries)
        # ``costs``: the arrays of a shared file that hold the matrix.
        self._matrix, self._costs = matrix, costs
        self.matrix = matrix if costs is None else costs["matrix"]
        self.classifier, self.unknown = classifier, unknown
        self.table = classifier.table()
        self.invoke, self.group, self.length, self.left, self.right, self.cost = (np.array([u[i] for u in unknown], np.int64) for i in range(6))
        self.right_size, self.left_size = self.matrix.shape
        e = self.entries
        # Ids outside the matrix cost nothing; most lexicons have none.
        self.inside = max(int(e.left.max(initial=0)), int(self.left.max())) < self.left_size and max(int(e.right.max(initial=0)), int(self.right.max())) < self.right_size
        one = self.connections(self.right, self.left)
        self.whole_runs = (self.group != 0) & (self.length == 0) & (self.cost + one >= 0)
        self.pos = pa.array([u[6] for u in unknown], pa.string())
        self._spoken: dict[str, tuple[str, str]] = {}
        self.numeric = np.array([u[6].startswith(NUMBER_POS) for u in unknown])

    def __reduce__(self) -> tuple:
        return Kernel, (self.entries, None if self._costs else self._matrix, self.classifier, self.unknown, self._costs)

    def connections(self, right: np.ndarray, left: np.ndarray) -> np.ndarray:
        if self.inside_for(right, left):
            return self.matrix[right, left].astype(np.int64)
        ok = (right < self.right_size) & (left < self.left_size)
        out = np.zeros(len(right), np.int64)
        out[ok] = self.matrix[right[ok], left[ok]]
        return out

    def inside_for(self, right: np.ndarray, left: np.ndarray) -> bool:
        return self.inside and self.right_size > 0 and self.left_size > 0

    def connection(self, right_id: int, left_id: int) -> int:
        return int(self.matrix[right_id, left_id]) if right_id < self.right_size and left_id < self.left_size else 0

    # Nodes.

    def _nodes(self, cp: np.ndarray, stop: np.ndarray, prune: bool) -> Nodes:
        """All candidates of a text whose segments end at ``stop``; with ``prune`` whole runs are one node."""
        n = len(cp)
        types = self.table[cp]
        fresh = np.ones(n + 1, bool)
        fresh[1:-1] = (types[1:] != types[:-1]) | (stop[1:] != stop[:-1])
        begin = np.flatnonzero(fresh)
        run = np.cumsum(fresh[:-1]) - 1
        run_end = begin[1:]
        pos, size, lo, hi = self.entries.trie.matches(cp, stop)
        known = np.zeros(n, bool)
        known[pos] = True
        whole = np.zeros(len(run_end), bool)
        if prune:
            whole = self.whole_runs[types[begin[:-1]]]
            whole[run[pos]] = False
            ends = pos + size
            whole[run[ends[~fresh[ends]]]] = False
        at = np.flatnonzero(~whole[run] & ((self.invoke[types] != 0) | ~known)) if prune else np.flatnonzero((self.invoke[types] != 0) | ~known)
        kind, last = types[at], run_end[run[at]]
        group, length = self.group[kind] != 0, self.length[kind]
        # Grouping classes have one long candidate, others one of each length; a single character is always one.
        reach = np.where(length == 0, last, np.minimum(last, at + np.maximum(2, length)))
        long = at[group & (reach > at + 1)]
        long_end = reach[group & (reach > at + 1)]
        count = np.where(group, 1, np.minimum(last, at + np.maximum(1, length)) - at)
        each = np.repeat(at, count)
        heads = begin[:-1][whole]
        unk_start = np.concatenate([heads, long, each])
        unk_end = np.concatenate([run_end[whole], long_end, spans(at + 1, count)])
        row = spans(lo, hi - lo)
        k_start = np.repeat(pos, hi - lo)
        k_end = k_start + np.repeat(size, hi - lo)
        unk = np.concatenate([np.zeros(len(row), np.int64), np.ones(len(unk_start), np.int64)])
        return Nodes(np.concatenate([k_start, unk_start]), np.concatenate([k_end, unk_end]), unk, np.concatenate([row, types[unk_start]]), n + 1)

    def _ids(self, nodes: Nodes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """left_id, right_id and cost of each node."""
        out = []
        for known, unknown in ((self.entries.left, self.left), (self.entries.right, self.right), (self.entries.cost, self.cost)):
            x = np.empty(len(nodes.row), np.int64)
            x[nodes.unk] = unknown[nodes.row[nodes.unk]]
            x[~nodes.unk] = known[nodes.row[~nodes.unk]]
            out.append(x)
        return out[0], out[1], out[2]

    # The best paths.

    def _best(self, cp: np.ndarray, stop: np.ndarray) -> tuple[Nodes, np.ndarray]:
        """The nodes and the numbers of those on the best paths, in text order."""
        n = len(cp)
        nodes = self._nodes(cp, stop, True)
        left, right, cost = self._ids(nodes)
        # Cuts: nothing spans the place, and all that end there have one right_id.
        far = nodes.end - nodes.start > 1
        spanned = np.cumsum(np.bincount(nodes.start[far] + 1, minlength=n + 1) - np.bincount(nodes.end[far], minlength=n + 1)) > 0
        ended = np.flatnonzero(nodes.size)
        at = nodes.first[ended]
        one = np.zeros(n + 1, bool)
        one[ended] = np.minimum.reduceat(right, at) == np.maximum.reduceat(right, at)
        seg = np.ones(n + 1, bool)
        seg[1:-1] = stop[1:] != stop[:-1]
        cut = seg | (one & ~spanned)
        begin = np.flatnonzero(cut)
        piece = np.cumsum(cut) - 1
        before = np.where(seg[begin], 0, right[np.minimum(nodes.first[begin], len(right) - 1)])
        of = piece[nodes.start]
        many = np.bincount(of, minlength=len(begin)) > 1
        single = np.flatnonzero(~many[of])
        live = np.flatnonzero(many[of])
        if not len(live):
            return nodes, single
        chosen = self._lockstep(nodes, left, right, cost, live, of[live], begin, before, seg)
        best = np.full(n, -1, np.int64)
        best[nodes.start[single]] = single
        best[nodes.start[chosen]] = chosen
        return nodes, best[best >= 0]

    def _lockstep(self, nodes: Nodes, left: np.ndarray, right: np.ndarray, cost: np.ndarray, live: np.ndarray, of: np.ndarray, begin: np.ndarray, before: np.ndarray, seg: np.ndarray) -> np.ndarray:
        step = nodes.start[live] - begin[of]
        # By step, place and left_id: predecessors are weighed once for each left_id of a place.
        start = nodes.start[live]
        order = np.argsort((step * len(seg) + start) << 16 | left[live], kind="stable") if len(seg) < 1 << 22 else np.lexsort((left[live], start, step))
        by, place, lefts = live[order], nodes.start[live][order], left[live][order]
        new = np.ones(len(by), bool)
        new[1:] = (place[1:] != place[:-1]) | (lefts[1:] != lefts[:-1])
        head = np.flatnonzero(new)
        member = np.cumsum(new) - 1
        h_place, h_left = place[head], lefts[head]
        h_of = of[order][head]
        h_step = step[order][head]
        steps = np.searchsorted(h_step, np.arange(int(h_step[-1]) + 2))
        in_step = np.append(head, len(by))[steps]
        bits = int(nodes.size.max()).bit_length()
        total, back = np.full(len(nodes.row), FAR, np.int64), np.full(len(nodes.row), -1, np.int64)
        low, prev = np.zeros(len(head), np.int64), np.full(len(head), -1, np.int64)

        flat = self.matrix.reshape(-1) if self.inside else None
        rows = right * self.left_size

        def cheapest(first: np.ndarray, size: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Least total plus connection over ranges of nodes, and the first node that has it."""
            offset = np.cumsum(size) - size
            pairs = np.arange(int(offset[-1] + size[-1])) + np.repeat(first - offset, size)
            value = total.take(pairs)
            if flat is not None:
                value += flat.take(rows.take(pairs) + np.repeat(to, size))
            else:
                value += self.connections(right[pairs], np.repeat(to, size))
            least, at = first_least(value, offset, size, bits)
            return least, first + at

        a, b = steps[0], steps[1]
        low[a:b] = self.connections(before[h_of[a:b]], h_left[a:b])
        for k in range(len(steps) - 1):
            a, b = steps[k], steps[k + 1]
            if a == b:
                continue
            if k:
                p = h_place[a:b]
                size = nodes.size[p]
                if size.all():
                    low[a:b], prev[a:b] = cheapest(nodes.first[p], size, h_left[a:b])
                else:
                    ok = np.flatnonzero(size)
                    low[a:b] = FAR
                    if len(ok):
                        low[a + ok], prev[a + ok] = cheapest(nodes.first[p][ok], size[ok], h_left[a:b][ok])
            x = slice(in_step[k], in_step[k + 1])
            total[by[x]] = np.minimum(low[member[x]] + cost[by[x]], FAR)
            back[by[x]] = prev[member[x]]
        pieces = np.unique(of)
        end = begin[pieces + 1]
        # Only a segment's end connects to the end of the text.
        now = np.empty(len(pieces), np.int64)
        final = seg[end]
        if final.any():
            e = end[final]
            now[final] = cheapest(nodes.first[e], nodes.size[e], np.zeros(len(e), np.int64))[1]
        if (~final).any():
            e = end[~final]
            pairs, size = spans(nodes.first[e], nodes.size[e]), nodes.size[e]
            now[~final] = nodes.first[e] + first_least(total[pairs], np.cumsum(size) - size, size, bits)[1]
        chosen = []
        while len(now):
            chosen.append(now)
            now = back[now]
            now = now[now >= 0]
        return np.concatenate(chosen)

    # Whole texts.

    def token_array(self, texts: pa.Array) -> pa.Array:
        """Token lists of many texts; null for null."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        return self._arrow(texts, *self._paths(texts))

    def total_array(self, texts: pa.Array) -> pa.Array:
        """(n_tokens, n_known, word_costs) of many texts, without making their tokens; null for null."""
        cp, at, _, start, unk, row = self._paths(texts)
        cost = np.where(unk, self.cost[np.where(unk, row, 0)], 0)
        cost[~unk] = self.entries.cost[row[~unk]]
        lists = np.searchsorted(start, at)
        total = lambda x: np.diff(np.append(0, np.cumsum(x, dtype=np.int64))[lists])
        fields = [pa.array(np.diff(lists), pa.int32()), pa.array(total(~unk), pa.int32()), pa.array(total(cost), pa.int64())]
        return pa.StructArray.from_arrays(fields, fields=list(TOTAL_TYPE), mask=texts.is_null())

    def _paths(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Code points of many texts, where each text begins, ends of segments, and the tokens: start, unknown or not, row."""
        cp, at = code_points(texts.fill_null(""))
        n = len(cp)
        stops = segment_ends(cp, at)
        start, unk, row = [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
        a, i = 0, 0
        while a < n:
            # Whole segments, about CHUNK_CHARS in sum.
            j = max(i + 1, int(np.searchsorted(stops, a + CHUNK_CHARS, "right")))
            b = int(stops[j - 1])
            stop = np.repeat(stops[i:j], np.diff(stops[i:j], prepend=a)) - a
            nodes, best = self._best(cp[a:b], stop)
            start.append(nodes.start[best] + a)
            unk.append(nodes.unk[best])
            row.append(nodes.row[best])
            a, i = b, j
        return cp, at, stops, np.concatenate(start), np.concatenate(unk), np.concatenate(row).astype(np.int64)

    def _arrow(self, texts: pa.Array, cp: np.ndarray, at: np.ndarray, stops: np.ndarray, start: np.ndarray, unk: np.ndarray, row: np.ndarray) -> pa.Array:
        m, e = len(start), self.entries
        bytes_ = np.concatenate([[0], np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF), dtype=np.int64)])
        edge = np.append(start, len(cp))
        offset = bytes_[edge]
        # Tokens leave no gap, so together they are the bytes of the texts.
        raw = cp.astype("<u4").tobytes().decode("utf-32-le").encode()
        surface = pa.LargeStringArray.from_buffers(m, pa.py_buffer(offset), pa.py_buffer(raw)).cast(pa.string())
        lists = np.searchsorted(start, at)
        first = np.repeat(offset[lists[:-1]], np.diff(lists))
        known = pa.array(np.where(unk, 0, row), pa.int64(), mask=unk)
        kind = pa.array(np.where(unk, row, 0), pa.int64())
        pos = pc.coalesce(e.feature(0, known), self.pos.take(kind))
        base = pc.coalesce(e.feature(1, known), surface)
        reading, spoken = (pc.coalesce(e.feature(i, known), pa.scalar("")) for i in (2, 3))
        cost = np.empty(m, np.int64)
        cost[unk], cost[~unk] = self.cost[row[unk]], e.cost[row[~unk]]
        letters = _all(_letter(cp), start, edge)
        if letters.any():
            number = np.empty(m, bool)
            number[unk], number[~unk] = self.numeric[row[unk]], e.numeric[row[~unk]]
            number |= _all(_digit(cp), start, edge)
            # Context ends with the segment.
            seg = np.searchsorted(stops, start, "right")
            behind = np.zeros(m, bool)
            behind[1:] = number[:-1] & (seg[1:] == seg[:-1])
            mask = pa.array(letters)
            coded = surface.filter(mask).dictionary_encode()
            words = coded.dictionary.to_pylist()
            if len(self._spoken) > SPOKEN_WORDS:
                self._spoken.clear()
            known_ways = [self._spoken.get(w) or self._say(w) for w in words]
            ways = pa.array([x[0] for x in known_ways] + [x[1] for x in known_ways], pa.string())
            at_way = coded.indices.to_numpy() + np.where(behind[letters], len(words), 0)
            said = ways.take(pa.array(at_way))
            reading, spoken = (pc.replace_with_mask(x, mask, said) for x in (reading, spoken))
        fields = [surface, pa.array(offset[:-1] - first), pa.array(offset[1:] - first), pos, base, reading, spoken, pa.array(cost, pa.int16()), pa.array(~unk)]
        items = pa.StructArray.from_arrays(fields, fields=list(TOKEN_TYPE))
        valid = texts.is_valid().to_numpy(zero_copy_only=False)
        starts = pa.array(lists, pa.int32(), mask=np.append(~valid, False))
        return pa.ListArray.from_arrays(starts, items)

    def prefix_array(self, texts: pa.Array) -> pa.Array:
        """Lists of (start, length, entry_id) of the entries at all places of many texts; null for null."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        cp, at = code_points(texts.fill_null(""))
        pos, size, lo, hi = self.entries.trie.matches(cp, np.repeat(at[1:], np.diff(at)))
        count = hi - lo
        row = spans(lo, count)
        place = np.repeat(pos, count)
        before = np.repeat(at[:-1], np.diff(at))
        start = place - before[place]
        fields = [pa.array(x, pa.int32()) for x in (start, np.repeat(size, count), self.entries.ids[row])]
        items = pa.StructArray.from_arrays(fields, names=["start", "length", "entry_id"])
        valid = texts.is_valid().to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(place, at), pa.int32(), mask=np.append(~valid, False)), items)

    def _say(self, word: str) -> tuple[str, str]:
        """Readings of a word of letters: alone, and behind a number."""
        out = self._spoken[word] = in_context(word, None), in_context(word, ("0", ""))
        return out

    def tokens(self, text: str) -> list[tuple]:
        """Tokens of a text, sentence by sentence, with byte offsets in the text."""
        return [tuple(t.values()) for t in self.token_array(pa.array([text], pa.string()))[0].as_py()]

    # One segment, for inspection.

    def _shown(self, nodes: Nodes, which: np.ndarray) -> list[tuple]:
        left, right, cost = self._ids(nodes)
        number = np.where(nodes.unk, nodes.row, 0)
        number[~nodes.unk] = self.entries.ids[nodes.row[~nodes.unk]]
        return list(zip(*(x[which].tolist() for x in (nodes.start, nodes.end, nodes.unk.astype(int), number, left, right, cost)), strict=True))

    def candidates(self, seg: str) -> list[tuple]:
        """(start, end, unknown, entry number or type, left_id, right_id, cost) of all nodes of a segment.

        The order is that of starts; at one start known words before unknown ones.
        """
        cp, _ = code_points(pa.array([seg]))
        nodes = self._nodes(cp, np.full(len(cp), len(cp)), False)
        return self._shown(nodes, np.lexsort((np.arange(len(nodes.row)), nodes.unk, nodes.start)))

    def path(self, seg: str) -> tuple[int, list[tuple]]:
        """Total cost and nodes of the best path of a segment."""
        cp, _ = code_points(pa.array([seg]))
        if not len(cp):
            return 0, []
        nodes, best = self._best(cp, np.full(len(cp), len(cp)))
        out = self._shown(nodes, best)
        ids = [0, *(x[5] for x in out)]
        joined = sum(self.connection(r, k) for r, k in zip(ids, [*(x[4] for x in out), 0], strict=True))
        return joined + sum(x[6] for x in out), out


def _letter(cp: np.ndarray) -> np.ndarray:
    low = cp | 0x20
    return (low >= 0x61) & (low <= 0x7A) & (cp < 0x80)


def _digit(cp: np.ndarray) -> np.ndarray:
    """Characters of a number: those of ``readings.NUMBER``."""
    return ((cp >= 0x30) & (cp <= 0x39)) | (cp == 0x2E) | (cp == 0x2C) | ((cp >= 0xFF10) & (cp <= 0xFF19))


def _all(flag: np.ndarray, start: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Whether all characters of each token are flagged."""
    if not len(start):
        return np.zeros(0, bool)
    return np.logical_and.reduceat(flag, start)
