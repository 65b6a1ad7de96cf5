"""Cost and results of op3_line_dedup's inner steps, against plain Python and the one-by-one forms."""

import random
import time

import numpy as np
import pyarrow as pa
import xxhash

from tsubame.llm import line_dedup, ngram_join
from tsubame.llm import textvec as tv


def line_set(x):
    return {x[i : i + 8] for i in range(max(1, len(x) - 7))}


def alike(a, b):
    s, t = line_set(a), line_set(b)
    return 100 * len(s & t) >= 80 * len(s | t)


def pairs_of(rng, count):
    xs, ys = [], []
    for _ in range(count):
        a = "".join(rng.choice("abcdefgh ijé漢") for _ in range(rng.choice([1, 5, 9, 40, 120, 200, 300, 400])))
        b = list(a)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            b[rng.randrange(len(b))] = rng.choice("xyz\0")
        xs.append(a)
        ys.append("".join(b) * rng.choice([1, 1, 1, 2]))
    return xs, ys


def test_verification_of_many_pairs_is_cheap():
    """Pairs are checked many at a time, for less than half of what one by one takes, with the results of plain sets."""
    xs, ys = pairs_of(random.Random(21), 2_048)
    batch = pa.record_batch([pa.array(range(len(xs))), pa.array(range(len(xs))), pa.array(xs), pa.array(ys)], ["fx", "fy", "tx", "ty"])

    def one_by_one():
        sets = []
        for lines in (xs, ys):
            h, at = line_dedup.line_shingles(lines)
            sets.append([tv.distinct(h[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)])
        return [i for i, (x, y) in enumerate(zip(*sets, strict=True)) if ngram_join.similar(x, y)]

    def at_once():
        return [i for b in line_dedup._verify(iter([batch])) for i in b.column(0).to_pylist()]

    def least(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert at_once() == one_by_one() == [i for i, (a, b) in enumerate(zip(xs, ys, strict=True)) if alike(a, b)]
    assert least(at_once) < least(one_by_one) / 2


def test_pairs_of_odd_lines():
    odd = ["a", "\0", "ab", "ab\0", "ab\0\0", "-" * 100, "-" * 300, "x" * 7, "x" * 8, "x" * 9, "ab" * 4_000, "ab" * 4_001 + "c", "\ud800abc", "é" * 8, "0123456789" * 9]
    xs, ys = [a for a in odd for _ in odd], odd * len(odd)
    assert line_dedup.similar_lines(xs, ys).tolist() == [alike(a, b) for a, b in zip(xs, ys, strict=True)]
    h, at = line_dedup.line_shingles(odd)
    assert [len(set(h[i:j].tolist())) for i, j in zip(at[:-1], at[1:], strict=True)] == [len(line_set(x)) for x in odd]
    want = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in odd]
    assert line_dedup.line_ids(odd).view(tv.U).tolist() == want and line_dedup.line_ids(odd[:3]).view(tv.U).tolist() == want[:3]


def test_members_of_a_group_meet_as_one_by_one():
    """The comparison inside large groups gives the pairs of the one-by-one form, which op5 uses."""
    rng = random.Random(22)
    for blocks in ((0, 0), (0, 1)):
        stem = "".join(rng.choice("abcdefghij") for _ in range(400))
        lines = [stem[: rng.choice([1, 9, 60, 150, 300, 330, 400])] + str(rng.randrange(20)) * rng.choice([1, 30, 60]) for _ in range(300)]
        h, at = line_dedup.line_shingles(lines)
        sets = [tv.distinct(h[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        n = len(lines)
        group = pa.table({
            "fx": np.random.default_rng(5).permutation(n), "nx": np.array([len(s) for s in sets]), "px": np.zeros(n, np.int32),
            "lab": np.array([rng.randrange(60) for _ in lines]), "i": np.full(n, blocks[0]), "j": np.full(n, blocks[1]),
            "blk": np.array([blocks[rng.randrange(2)] for _ in lines]), "sketch": pa.array([ngram_join.sketch(s) for s in sets], pa.list_(pa.int64())),
        })
        got, want = (sorted(map(tuple, f(80)(group).to_pandas().to_numpy().tolist())) for f in (line_dedup._across_lines, ngram_join._across))
        assert got == want and got


def test_buckets_lose_nothing_that_meets():
    rng = np.random.default_rng(23)
    e = np.zeros(5_000, line_dedup._BAND)
    e["s"], e["f"] = rng.integers(0, 20_000, len(e)), rng.integers(0, 1 << 60, len(e))
    e["s"][:2_500] *= 200_000
    e["s"][:40], e["s"][40:43] = 7, 0xFFFFFFFF
    for part in (e, e[:1], e[:0]):
        blobs = [part[i::3].tobytes() for i in range(3)]
        group = pa.table({"bucket": pa.array([4] * 3, pa.int32()), "blob": pa.array(blobs, pa.binary())})
        got, want = (f(group).to_pylist() for f in (line_dedup._meet_lines(), ngram_join._meet(line_dedup.PERCENT, line_dedup._BAND)))
        assert got == want and (got or len(part) < 2)


def test_rows_that_share_or_lack_doc_id(spark):
    """Rows that share a doc_id lose lines together; rows without one are kept; the first place is by doc_id, then line."""
    long = "a line that stands in more than one document, and twice in one"
    near = long[:-1] + "x"
    texts = [(7, "x\n" + near), (3, "y\n" + long + "\n\n" + long.upper()), (3, long + "\nother"), (None, long + "\n" + long), (None, None), (9, near + "\n  ")]
    got = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        (7, 2, 1, "x"), (3, 4, 2, "y\n"), (3, 2, 2, long), (None, 2, 0, long + "\n" + long), (None, 1, 0, ""), (9, 2, 1, "  "),
    ], key=str)
