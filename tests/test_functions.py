import numpy as np
import pytest
from pyspark.sql import functions as F

from tsubame.functions import charclass as cc
from tsubame.functions import readings, render, segment
from tsubame.operators.kernel import Kernel, unknown_templates


def kinds(text, classifier=None):
    return [cc.TYPES[i] for i in (classifier or cc.Classifier.default()).table()[[ord(c) for c in text]]] if text else []


def test_default_types():
    assert kinds("あア漢aＡ1１!　 é🐱〇ｶ㐀。") == [
        "HIRAGANA", "KATAKANA", "KANJI", "ALPHA", "ALPHA", "NUMERIC", "NUMERICWIDE", "SYMBOL", "SPACE", "SPACE",
        "DEFAULT", "DEFAULT", "KANJI", "KATAKANA", "KANJI", "SYMBOL",
    ]


def test_nearest_start_decides_and_outer_range_does_not_resume():
    c = cc.Classifier({}, [(0x41, 0x5A, "ALPHA"), (0x43, 0x44, "NUMERIC"), (0x61, 0x61, "KANJINUMERIC"), (0x62, 0x62, "ODD")])
    assert kinds("BCDEab", c) == ["ALPHA", "NUMERIC", "NUMERIC", "DEFAULT", "KANJI", "DEFAULT"]


def test_equal_starts_last_counts():
    assert kinds("A", cc.Classifier({}, [(0x41, 0x5A, "ALPHA"), (0x41, 0x41, "SYMBOL")])) == ["SYMBOL"]


@pytest.mark.parametrize(
    ("at", "end", "group", "length", "want"),
    [(0, 5, True, 0, [5]), (0, 5, True, 1, [2]), (0, 5, True, 2, [2]), (0, 1, True, 2, [1]), (0, 5, True, 3, [3]), (1, 5, False, 2, [2, 3]), (0, 5, False, 0, [1])],
)
def test_ends_of_unknown_words(at, end, group, length, want):
    """By the class's rule, and always a single character."""
    c = cc.Classifier({"ALPHA": (True, group, length)}, [])
    found = Kernel([], np.zeros((1, 1), np.int16), c, unknown_templates(c, [])).candidates("a" * end)
    assert sorted(b for a, b, *_ in found if a == at) == sorted({*want, at + 1})


def test_column_agrees_with_function(spark):
    text = "".join(chr(c) for a, b, _ in cc.DEFAULT_INTERVALS for c in (a - 1, a, b, b + 1))
    rows = spark.createDataFrame([(i, ch) for i, ch in enumerate(text)], "i int, ch string")
    got = [r[1] for r in rows.select("i", cc.Classifier.default().column(F.col("ch"))).orderBy("i").collect()]
    assert got == kinds(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [("a。b", ["a。", "b"]), ("!!!", ["!", "!", "!"]), ("", []), ("a\r\nb、c.d", ["a\r\n", "b、c.d"]), ("猫！猫？猫", ["猫！", "猫？", "猫"]), ("🐱!x", ["🐱!", "x"])],
)
def test_sentences(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(segment.sentences(F.col("t"))).first()[0] == want


def test_offsets_are_bytes(spark):
    df = spark.createDataFrame([(1, "é!猫")], "k int, text string")
    rows = segment.split_with_offsets(df, "text", ["k"]).orderBy("seg_idx").collect()
    assert [(r["start"], r["end"]) for r in rows] == [(0, 3), (3, 6)]


@pytest.mark.parametrize(
    ("surface", "before", "want"),
    [
        ("W", ("100", "名詞,数,*,*"), "ワット"),
        ("w", ("5", "x"), "ワット"),
        ("km", ("3", "x"), "キロメートル"),
        ("KM", ("3", "x"), "ケーエム"),
        ("hp", ("1.5", "x"), "馬力"),
        ("W", None, "ダブリュー"),
        ("ab", ("c", "名詞,数"), "エービー"),
        ("猫", ("3", "x"), None),
        ("A1", None, None),
    ],
)
def test_readings(spark, surface, before, want):
    assert readings.in_context(surface, before) == want
    b = before or (None, None)
    df = spark.createDataFrame([(surface, *b)], "s string, ps string, pp string")
    assert df.select(readings.contextual(F.col("s"), F.col("ps"), F.col("pp"))).first()[0] == want


def test_renderers(spark):
    t = "surface string, start long, `end` long, pos string, base_form string, reading string, pronunciation string, word_cost short, is_known boolean"
    df = spark.createDataFrame([([("a", 0, 1, "p,q", "", "R", "", 1, True), ("b", 1, 2, "p", "b", "", "", 2, False)],), ([],)], f"t array<struct<{t.replace(' ', ':').replace(',:', ',')}>>")
    rows = df.select(render.mecab(F.col("t")), render.wakachi(F.col("t")), render.as_json(F.col("t"))).collect()
    assert rows[0][0] == "a\tp,q,R\nb\tp,b\nEOS\n" and rows[0][1] == "a b"
    assert rows[0][2].startswith('[{"base_form":"","end":1,"is_known":true,"pos":"p,q","reading":"R","start":0,"surface":"a"}')
    assert tuple(rows[1]) == ("EOS\n", "", "[]")
    with pytest.raises(ValueError, match="unknown format"):
        render.render(F.col("t"), "xml")


def test_a_thousand_ranges(spark):
    """The column's types by paged table equal the plain table, whatever the number of ranges."""
    c = cc.Classifier({}, [(0x100 + 40 * i, 0x100 + 40 * i + i % 40, ["ALPHA", "KANJI", "SYMBOL", "SPACE"][i % 4]) for i in range(1000)])
    points = [x for a, b, _ in c.intervals() for x in (a, b, b + 1) if not 0xD800 <= x < 0xE000]
    rows = spark.createDataFrame([(i, chr(x)) for i, x in enumerate(points)], "i int, ch string")
    got = [r[1] for r in rows.select("i", c.column(F.col("ch"))).orderBy("i").collect()]
    assert got == [cc.TYPES[k] for k in c.table()[points]]
    assert [r[0] for r in spark.createDataFrame([(None,), ("",)], "ch string").select(c.column(F.col("ch"))).collect()] == ["DEFAULT", "DEFAULT"]


def test_offsets_of_segments(spark):
    texts = ["ab。c\n", "", None, "é！！x?", "🌋", "\n"]
    rows = segment.split_with_offsets(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", ["i"]).collect()
    for i, text in enumerate(texts):
        mine = sorted((r["seg_idx"], r["seg"], r["start"], r["end"]) for r in rows if r["i"] == i)
        assert "".join(r[1] for r in mine) == (text or "") and [r[0] for r in mine] == list(range(len(mine)))
        raw = (text or "").encode()
        assert all(raw[s:e].decode() == seg for _, seg, s, e in mine)
    assert len(rows) == 2 + 3 + 1 + 1 + 0 + 0 + 0
