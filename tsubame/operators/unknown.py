"""Tokenisation without a lexicon, inside code generation.

With no entries and no costs a path never crosses a border between types. Runs of
classes without a length limit stay whole. Runs of limited classes (kana, kanji: two
characters at most) need the fewest tokens, and ties go to the earliest start, so they
are cut into pairs from the right, and an odd run begins with a single character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsubame.functions.charclass import DEFAULT_INTERVALS
from tsubame.functions.segment import sentences, split_sentences

UNLIMITED = ["ALPHA", "NUMERIC", "NUMERICWIDE", "SYMBOL", "SPACE"]
LIMITED = ["HIRAGANA", "KATAKANA", "KANJI"]


def _class(kinds: list[str], negate: bool = False) -> str:
    inside = "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b, k in DEFAULT_INTERVALS if k in kinds)
    return f"[{'^' if negate else ''}{inside}]"


OTHER = _class([*UNLIMITED, *LIMITED], True)
RUNS = "|".join(f"{c}+" for c in [*map(_class, ([k] for k in UNLIMITED)), OTHER, *map(_class, ([k] for k in LIMITED))])


def _pairs(run: Column) -> Column:
    """A run as pairs from the right; an odd one begins with its first character."""
    n = F.char_length(run)
    starts = F.sequence(F.lit(0), F.ceil(n / 2).cast("int") - 1)
    at = lambda j: F.greatest(F.lit(0), 2 * j - n % 2)
    return F.transform(starts, lambda j: F.substring(run, at(j) + 1, F.when((j == 0) & (n % 2 == 1), 1).otherwise(2)))


def surfaces(segment: Column) -> Column:
    """Array of the surfaces of a sentence segment."""
    runs = F.regexp_extract_all(segment, F.lit(RUNS), F.lit(0))
    limited = _class(LIMITED)
    cut_up = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^{limited}"), _pairs(r)).otherwise(F.array(r))))
    return F.when(segment.rlike(limited), cut_up).otherwise(runs)


def text_surfaces(text: Column) -> Column:
    """Array of the surfaces of a whole text, sentence by sentence."""
    return F.flatten(F.transform(sentences(text), surfaces))


def unknown_tokens(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, seg_idx, tok_idx, surface) of every token, in one pass."""
    segments = split_sentences(df, text, keys)
    return segments.select(*keys, "seg_idx", F.posexplode(surfaces(F.col("seg"))).alias("tok_idx", "surface"))
