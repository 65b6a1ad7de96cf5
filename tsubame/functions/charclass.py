"""Character classes: default table, code-point ranges, classification, runs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = ["HIRAGANA", "KATAKANA", "KANJI", "ALPHA", "NUMERIC", "NUMERICWIDE", "SYMBOL", "SPACE", "DEFAULT"]

# Fixed values: (name, invoke, group, length) of the default character classes.
DEFAULT_CLASSES = [
    ("DEFAULT", False, True, 0),
    ("SPACE", False, True, 0),
    ("KANJI", False, False, 2),
    ("HIRAGANA", False, True, 2),
    ("KATAKANA", True, True, 2),
    ("ALPHA", True, True, 0),
    ("NUMERIC", True, True, 0),
    ("SYMBOL", True, True, 0),
    ("KANJINUMERIC", True, True, 0),
]

# Inclusive code-point intervals of each type where no ranges are given.
DEFAULT_INTERVALS = [
    (0x09, 0x0D, "SPACE"),
    (0x20, 0x20, "SPACE"),
    (0x21, 0x2F, "SYMBOL"),
    (0x30, 0x39, "NUMERIC"),
    (0x3A, 0x40, "SYMBOL"),
    (0x41, 0x5A, "ALPHA"),
    (0x5B, 0x60, "SYMBOL"),
    (0x61, 0x7A, "ALPHA"),
    (0x7B, 0x7E, "SYMBOL"),
    (0x3000, 0x3000, "SPACE"),
    (0x3001, 0x3006, "SYMBOL"),
    (0x3007, 0x3007, "KANJI"),
    (0x3008, 0x303F, "SYMBOL"),
    (0x3040, 0x309F, "HIRAGANA"),
    (0x30A0, 0x30FF, "KATAKANA"),
    (0x31F0, 0x31FF, "KATAKANA"),
    (0x3400, 0x4DBF, "KANJI"),
    (0x4E00, 0x9FFF, "KANJI"),
    (0xF900, 0xFAFF, "KANJI"),
    (0xFF01, 0xFF0F, "SYMBOL"),
    (0xFF10, 0xFF19, "NUMERICWIDE"),
    (0xFF1A, 0xFF20, "SYMBOL"),
    (0xFF21, 0xFF3A, "ALPHA"),
    (0xFF41, 0xFF5A, "ALPHA"),
    (0xFF65, 0xFF9F, "KATAKANA"),
    (0x20000, 0x2A6DF, "KANJI"),
]


def type_of_class(name: str) -> str:
    """Character type that a range's class name stands for."""
    if name == "KANJINUMERIC":
        return "KANJI"
    return name if name in TYPES else "DEFAULT"


def class_of_type(kind: str) -> str:
    return "NUMERIC" if kind == "NUMERICWIDE" else kind


def flatten(ranges: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Disjoint intervals in which the range of the nearest start decides.

    A range ends where the next one starts, even if that one is shorter: behind a
    nested range the outer one does not resume. Of equal starts the last one counts.
    """
    by_start = {start: (end, name) for start, end, name in ranges}
    starts = sorted(by_start)
    out = []
    for i, s in enumerate(starts):
        end, name = by_start[s]
        if i + 1 < len(starts):
            end = min(end, starts[i + 1] - 1)
        if end >= s:
            out.append((s, end, type_of_class(name)))
    return out


@dataclass
class Classifier:
    """Classes by name, and the intervals that give each code point its type."""

    classes: dict[str, tuple[bool, bool, int]]
    ranges: list[tuple[int, int, str]]

    @staticmethod
    def default() -> Classifier:
        return Classifier({n: (i, g, k) for n, i, g, k in DEFAULT_CLASSES}, [])

    def intervals(self) -> list[tuple[int, int, str]]:
        return flatten(self.ranges) if self.ranges else DEFAULT_INTERVALS

    def table(self) -> np.ndarray:
        """Index in TYPES of each code point."""
        out = np.full(0x110000, TYPES.index("DEFAULT"), np.uint8)
        for a, b, name in self.intervals():
            out[max(a, 0) : b + 1] = TYPES.index(name)
        return out

    def settings(self, kind: str) -> tuple[bool, bool, int]:
        """(invoke, group, length); a class that is not defined groups without limit."""
        return self.classes.get(class_of_type(kind), (False, True, 0))

    def column(self, ch: Column) -> Column:
        """Type of a one-character column: a page of its code point, then a place in it, whatever the number of ranges."""
        pages, page_of = np.unique(self.table().reshape(-1, 256), axis=0, return_inverse=True)
        cp = F.ascii(ch)
        page = F.get(_numbers(page_of.ravel()), F.shiftright(cp, 8))
        kind = F.get(_numbers(pages.ravel()), page * 256 + cp.bitwiseAND(F.lit(255)))
        return F.coalesce(F.get(F.split(F.lit(",".join(TYPES)), ","), kind), F.lit("DEFAULT"))


def _numbers(values: np.ndarray) -> Column:
    """An array constant; it is folded once, when the plan is made."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<int>")
