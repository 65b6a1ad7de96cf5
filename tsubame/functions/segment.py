"""Sentence segments as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that end a sentence and belong to it.
BOUNDARIES = "。！？!?\n"
PATTERN = rf"[^{BOUNDARIES}]*[{BOUNDARIES}]|[^{BOUNDARIES}]+"


def is_boundary(ch: Column) -> Column:
    return ch.isin(*BOUNDARIES)


def sentences(text: Column) -> Column:
    """Array of segments; together they are the text again. Null stays null."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def split_sentences(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, seg_idx, seg) of every segment."""
    return df.select(*keys, F.posexplode(sentences(F.col(text))).alias("seg_idx", "seg"))


def code_points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string column, and where each string begins (with the end)."""
    if not len(strings):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    strings = strings.cast(pa.large_string())
    at = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = strings.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    head = (data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(head)])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), before[at - at[0]]


def segment_ends(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ends of the segments of texts that begin at ``at``."""
    end = np.zeros(len(cp) + 1, bool)
    end[at] = True
    end[1:] |= np.isin(cp, np.array([ord(c) for c in BOUNDARIES], np.uint32))
    end[0] = False
    return np.flatnonzero(end)


def offset_array(texts: pa.Array) -> pa.Array:
    """Lists of (seg, start, end) of many texts, in bytes; null for null."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    cp, at = code_points(texts.fill_null(""))
    ends = segment_ends(cp, at)
    size = np.concatenate([[0], np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF), dtype=np.int64)])
    # Segments leave no gap, so together they are the bytes of the texts.
    edge = size[np.concatenate([[0], ends])]
    lists = np.searchsorted(ends, at, "right")
    seg = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(edge), pa.py_buffer(cp.astype("<u4").tobytes().decode("utf-32-le").encode())).cast(pa.string())
    before = np.repeat(size[at[:-1]], np.diff(lists))
    items = pa.StructArray.from_arrays([seg, pa.array(edge[:-1] - before), pa.array(edge[1:] - before)], names=["seg", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(lists, pa.int32(), mask=np.append(texts.is_null().to_numpy(zero_copy_only=False), False)), items)


def split_with_offsets(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, seg_idx, seg, start, end) of every segment, with its byte offsets in the text; no shuffle."""

    @F.arrow_udf("array<struct<seg:string,start:bigint,end:bigint>>")
    def placed(texts: pa.Array) -> pa.Array:
        return offset_array(texts)

    return df.select(*keys, F.posexplode(placed(F.col(text))).alias("seg_idx", "s")).select(*keys, "seg_idx", "s.*")
