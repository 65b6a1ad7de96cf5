import random

import pytest
from pyspark.sql import functions as F

from tsubame.cli import main, parser
from tsubame.functions.charclass import Classifier
from tsubame.operators import compare
from tsubame.operators.analyzer import Analyzer, in_memory
from tsubame.plans import fixtures as fx
from tsubame.sources import convert
from tsubame.sources import definitions as d
from tsubame.sources import lexicon as lx
from tsubame.sources import text

CSV = "猫,1,1,100,名詞,一般,*,*,*,*,猫,ネコ,ネコ\n犬,1,1,100,名詞,一般,*,*,*,*,,イヌ,inu\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/b.csv").write_text("鳥,1,1,5,名詞\n")
    (tmp_path / "src/a.csv").write_bytes(CSV.encode("euc_jp"))
    (tmp_path / "src/matrix.def").write_text("2 2\n# no\n\n0 1 -7\n0 1 -8\n")
    (tmp_path / "src/char.def").write_text("DEFAULT 0 1 0\nHIRAGANA 1 0 7\n0x3041..0x3096 HIRAGANA KANJI\n0xZZ BAD\nALPHA 1 1 0\n")
    (tmp_path / "src/unk.def").write_text("DEFAULT,0,0,50,記号\nDEFAULT,0,0,1,x\nNOSUCH,0,0,1,x\n")
    return tmp_path


def test_csv_rules():
    rows = d.lexicon_rows(CSV)
    assert rows[1][5] == "" and rows[0][4] == "名詞,一般,*,*"
    assert d.lexicon_rows("x,1,2,-3,p\n")[0] == ("x", 1, 2, -3, "p", "x", "", "")
    for bad, said in (("a,1,2,3\n", "t:1: 4 columns"), ("a,1,2,3,p\nb,70000,1,1,p\n", "t:2:left_id"), ("a,1,1,40000,p\n", "cost"), ("a,x,1,1,p\n", "left_id"), (",1,1,1,p\n", "empty surface")):
        with pytest.raises(d.LexiconError, match=said):
            d.lexicon_rows(bad, "t")


def test_ranges():
    assert d.parse_range("0x41..0x5A") == (65, 90) and d.parse_range("0x41") == (65, 65)
    assert d.parse_range("41") is None and d.parse_range("0xG") is None
    assert d.char_rows("0x41 ALPHA\n") is None


def test_build_bundle_and_reopen(spark, folder):
    lex = lx.build(spark, f"{folder}/src")
    assert [r["surface"] for r in lex.entries.orderBy("entry_id").collect()] == ["猫", "犬", "鳥"]
    lex.write(f"{folder}/bundle")
    again = lx.Lexicon.read(spark, f"{folder}/bundle")
    assert again.counts() == lex.counts() and again.classifier() == lex.classifier()
    assert {(r[0], r[1], r[2]) for r in again.matrix.collect()} == {(0, 1, -8)}
    assert [r["class"] for r in again.unk.orderBy("ord").collect()] == ["DEFAULT", "DEFAULT"]
    assert Analyzer(again).tokens_of("猫")[0].word_cost == 100
    assert again.info().first()["entries"] == 3


def test_open_errors(spark, tmp_path):
    with pytest.raises(d.LexiconError, match="no lexicon bundle"):
        lx.Lexicon.read(spark, str(tmp_path))
    spark.createDataFrame([("other", 1)], "format string, version int").write.parquet(f"{tmp_path}/x/meta")
    with pytest.raises(d.LexiconError, match="not a lexicon bundle"):
        lx.Lexicon.read(spark, f"{tmp_path}/x")


def test_merge_keeps_or_resets_classes(spark, folder):
    lx.build(spark, f"{folder}/src").write(f"{folder}/b")
    (folder / "more.csv").write_text("猫,1,1,1,動詞\n")
    kept = lx.Lexicon.read(spark, lx.merge(spark, f"{folder}/b", f"{folder}/more.csv"))
    assert kept.entries.count() == 4 and kept.classifier().ranges == [(0x3041, 0x3096, "HIRAGANA")]
    reset = lx.Lexicon.read(spark, lx.merge(spark, f"{folder}/b", f"{folder}/more.csv", reset_char_def=True))
    assert reset.classifier() == Classifier.default()


def test_repair(spark):
    fixed, n = in_memory(spark, d.lexicon_rows(CSV)).repaired()
    assert n == 1 and {r["pronunciation"] for r in fixed.entries.collect()} == {"ネコ", "イヌ"}


def test_builder_is_used_once(spark):
    b = lx.LexiconBuilder(spark)
    b.build()
    with pytest.raises(RuntimeError, match="already built"):
        b.add_unk([])


def test_ids_out_of_range(spark):
    assert in_memory(spark, fx.entries(fx.JAPANESE)).ids_out_of_range().count() == len(fx.JAPANESE)


def test_lines(spark, tmp_path):
    (tmp_path / "t.txt").write_text("　猫 \n\n \t\nx\n")
    assert sorted(r[0] for r in text.read_lines(spark, str(tmp_path / "t.txt")).collect()) == ["x", "猫"]
    assert text.literal(spark, " a ").first()[0] == " a "


def test_conversions(spark):
    row = lambda *x: spark.createDataFrame([(list(r),) for r in x], "f array<string>")
    out = convert.from_sudachi(row(["助", "1", "1", "1", "", "助詞", "終助詞", "*", "*", "", "", "*", ""], ["z"] * 12))
    assert [tuple(r) for r in out.collect()] == [("助", "1", "1", "1", "助詞", "終助詞", "*", "*", "*", "*", "助", "", "")]
    got = convert.remap_pos(out).first()
    assert (got["left_id"], got["pos1"], got["pos2"]) == ("279", "助詞", "終助詞")
    assert convert.unmapped_pos(out).count() == 0


def test_compare(spark):
    df = spark.createDataFrame([(1, "大学生を")], "id int, text string")
    a, b = Analyzer(in_memory(spark, fx.entries(fx.JAPANESE))), Analyzer(in_memory(spark, fx.entries([x for x in fx.JAPANESE if x[0] != "大学生"])))
    rows = compare.compare(df, a, b, "text", ["id"]).collect()
    assert sorted(r["status"] for r in rows) == ["both", "left_only", "right_only", "right_only"]
    got = compare.agreement(compare.compare(df, a, b, "text", ["id"])).first()
    assert (got["spans"], got["both"], got["left_only"], got["right_only"], got["same_reading"]) == (4, 1, 1, 2, 1)
    aligned = compare.align(df, a, b).first()
    assert [(x["left"], x["right"]) for x in aligned["blocks"]] == [(["大学生"], ["大学", "生"]), (["を"], ["を"])]
    assert (aligned["scores"]["same_words"], aligned["scores"]["word_precision"], aligned["scores"]["same_readings"]) == (1, 1 / 3, 1)
    assert compare.summary(df, {"a": a, "b": b}, "text", ["id"]).where("engine = 'b'").first()["segmentation"] == "大学 | 生 | を"


def test_files_that_are_missing_or_wrong(spark, folder):
    (folder / "src/matrix.def").unlink()
    with pytest.warns(UserWarning, match="no matrix.def"):
        lx.build(spark, f"{folder}/src")
    (folder / "src/unk.def").write_text("DEFAULT,x,0,50,p\n")
    with pytest.warns(UserWarning), pytest.raises(d.LexiconError, match="unk.def:1"):
        lx.build(spark, f"{folder}/src")
    (folder / "src/a.csv").write_text("a,1,1,1,p\nb,1,x,1,p\n")
    with pytest.raises(d.LexiconError, match="a.csv:2:right_id"):
        lx.build(spark, f"{folder}/src")
    with pytest.raises(FileNotFoundError):
        lx.LexiconBuilder(spark).load_matrix(f"{folder}/none.def")


def test_conversion_of_folders(spark, folder):
    rows = '猫,1,2,30,名詞,a,b,*,"c,d",e,ネコ,"ね""こ",x,ネーコ,more\n短,1,1,1,p\n'
    (folder / "in").mkdir()
    (folder / "in/u.csv").write_text(rows)
    assert convert.convert(spark, "unidic", f"{folder}/in", f"{folder}/out") == {"converted": 2, "skipped": 0}
    assert convert.copy_matrix(spark, f"{folder}/src/matrix.def", f"{folder}/out") == (2, 2)
    built = lx.build(spark, f"{folder}/out")
    assert [tuple(r)[1:] for r in built.entries.orderBy("entry_id").collect()] == [("猫", 1, 2, 30, "名詞,a,b,*", 'ね"こ', "ネコ", "ネーコ"), ("短", 1, 1, 1, "p", "短", "", "")]
    main(["convert", "sudachi", "-i", f"{folder}/in/u.csv", "-o", f"{folder}/s"])
    main(["recipe", "-i", f"{folder}/src", "-m", f"{folder}/in", "-x", "b.csv", "-o", f"{folder}/r"])
    assert [r["surface"] for r in lx.Lexicon.read(spark, f"{folder}/r").entries.orderBy("entry_id").collect()] == ["猫", "犬", "猫", "短"]


def test_command_line(spark, folder, capsys):
    assert main(["build", "-i", f"{folder}/src", "-o", f"{folder}/d"]) == 0
    main(["tokenize", "-d", f"{folder}/d", "-f", "wakachi", "猫犬"])
    assert "猫 犬" in capsys.readouterr().out
    main(["bench", "-d", f"{folder}/d", "-n", "0", "猫"])
    main(["info", "-d", f"{folder}/d"])
    main(["compare", "-d", f"{folder}/d", "-e", f"{folder}/d", "猫犬"])
    assert "猫 | 犬" in capsys.readouterr().out
    main(["repair", "-d", f"{folder}/d", "-o", f"{folder}/e"])
    assert "1 entries repaired" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        parser().parse_args(["nonsense"])


def test_versions(spark, folder):
    """Readers keep the version that they opened; of two writers that follow one version the second is refused."""
    first = lx.build(spark, f"{folder}/src")
    assert first.commit(f"{folder}/v") == 1
    reader = lx.Lexicon.read(spark, f"{folder}/v")
    (folder / "more.csv").write_text("猫,1,1,1,動詞\n")
    assert lx.merge(spark, f"{folder}/v", f"{folder}/more.csv", f"{folder}/v") == f"{folder}/v"
    assert reader.entries.count() == 3 and lx.Lexicon.read(spark, f"{folder}/v").entries.count() == 4
    with pytest.raises(d.LexiconError, match="another writer has made version 2"):
        first.commit(f"{folder}/v", after=1)
    assert lx.latest(spark, f"{folder}/v") == 2 and lx.Lexicon.read(spark, f"{folder}/v").entries.count() == 4
    first.write(f"{folder}/plain")
    with pytest.raises(d.LexiconError, match="without versions"):
        lx.merge(spark, f"{folder}/plain", f"{folder}/more.csv", f"{folder}/plain")


def test_pools(spark, folder):
    lx.build(spark, f"{folder}/src").write(f"{folder}/p")
    read = lx.Lexicon.read(spark, f"{folder}/p")
    assert [r["value"] for r in read.pool("strings").orderBy("id").collect()] == ["猫", "名詞,一般,*,*", "ネコ", "犬", "", "イヌ", "inu", "鳥", "名詞"]
    assert [tuple(r)[1:] for r in read.pool("features").orderBy("id").collect()] == [("名詞,一般,*,*", "猫", "ネコ", "ネコ"), ("名詞,一般,*,*", "", "イヌ", "inu"), ("名詞", "鳥", "", "")]


def test_blocks_equal_a_plain_walk(spark):
    rng = random.Random(7)

    def cut(n):
        ends = sorted(rng.sample(range(1, n), rng.randint(0, n - 1))) + [n] if n else []
        return [{"surface": f"{a}-{b}", "start": a, "end": b, "reading": rng.choice("xy"), "pos": "p"} for a, b in zip([0, *ends], ends)]

    rows = [(i, cut(n), cut(n)) for i, n in enumerate([0, 1, 2, 30, 0, 9, *(rng.randint(1, 40) for _ in range(30))])] + [(99, None, None)]
    token = "array<struct<surface:string,start:bigint,end:bigint,reading:string,pos:string>>"
    df = spark.createDataFrame(rows, f"id int, l {token}, r {token}").repartition(3)
    out = df.withColumn("b", compare.blocks("l", "r")).withColumn("s", compare.scores(F.col("b"), F.col("l"), F.col("r")))
    got = {r["id"]: r for r in out.collect()}
    for i, l, r in rows:
        if l is None:
            assert got[i]["b"] is None
            continue
        want, a, b, at = [], [], [], 0
        l, r = list(l), list(r)
        while l or r:
            if not b or (a and a[-1]["end"] < b[-1]["end"]):
                (a if a and b or not a else b).append((l if a and b or not a else r).pop(0))
            else:
                b.append(r.pop(0)) if b[-1]["end"] < a[-1]["end"] else None
            if a and b and a[-1]["end"] == b[-1]["end"]:
                same = (a[0]["reading"] == b[0]["reading"], True) if len(a) == len(b) == 1 else (None, None)
                want.append((at, a[-1]["end"], [x["surface"] for x in a], [x["surface"] for x in b], *same))
                at, a, b = a[-1]["end"], [], []
        assert [tuple(x) for x in got[i]["b"]] == want, i
        s = got[i]["s"]
        ends = {x["end"] for x in rows[i][1]} & {x["end"] for x in rows[i][2]}
        spans = {(x["start"], x["end"]) for x in rows[i][1]} & {(x["start"], x["end"]) for x in rows[i][2]}
        assert (s["blocks"], s["same_words"]) == (len(ends), len(spans))
        if rows[i][1]:
            assert s["word_f"] == 2 * len(spans) / (len(rows[i][1]) + len(rows[i][2])) and s["boundary_recall"] == len(ends) / len(rows[i][1])
