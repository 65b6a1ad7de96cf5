"""Renderers of a token array: tagged lines, spaced words, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mecab(tokens: Column) -> Column:
    """One line a token with its non-empty fields, then EOS."""

    def line(t: Column) -> Column:
        rest = [F.when(t[c] != "", t[c]) for c in ("base_form", "reading", "pronunciation")]
        return F.concat(t["surface"], F.lit("\t"), F.concat_ws(",", t["pos"], *rest), F.lit("\n"))

    return F.concat(F.array_join(F.transform(tokens, line), ""), F.lit("EOS\n"))


def wakachi(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["surface"]), " ")


def as_json(tokens: Column) -> Column:
    """Array of objects with seven fields, keys in alphabetical order."""
    fields = ("base_form", "end", "is_known", "pos", "reading", "start", "surface")
    return F.to_json(F.transform(tokens, lambda t: F.struct(*[t[c].alias(c) for c in fields])))


FORMATS = {"mecab": mecab, "wakachi": wakachi, "json": as_json}


def render(tokens: Column, fmt: str = "mecab") -> Column:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    return FORMATS[fmt](tokens)
