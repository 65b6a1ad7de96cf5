"""Conversions between lexicon CSV layouts, as DataFrame operators on field arrays, and from folder to folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsubame.session import cut, put
from tsubame.sources.definitions import csv_fields, list_csv, read_bytes

FIELDS = ["surface", "left_id", "right_id", "cost", "pos1", "pos2", "pos3", "pos4", "conj_type", "conj_form", "base_form", "reading", "pronunciation"]

# Source part of speech (without trailing *) to target part of speech and id.
POS_MAP = {
    "名詞,普通名詞,一般": ("名詞,一般,*,*", 1285), "名詞,普通名詞,サ変可能": ("名詞,サ変接続,*,*", 1283),
    "名詞,普通名詞,形状詞可能": ("名詞,形容動詞語幹,*,*", 1287), "名詞,普通名詞,サ変形状詞可能": ("名詞,サ変接続,*,*", 1283),
    "名詞,普通名詞,副詞可能": ("名詞,副詞可能,*,*", 1314), "名詞,普通名詞,助数詞可能": ("名詞,一般,*,*", 1285),
    "名詞,固有名詞,一般": ("名詞,固有名詞,一般,*", 1288), "名詞,固有名詞,人名,一般": ("名詞,固有名詞,人名,一般", 1289),
    "名詞,固有名詞,人名,名": ("名詞,固有名詞,人名,名", 1291), "名詞,固有名詞,人名,姓": ("名詞,固有名詞,人名,姓", 1290),
    "名詞,固有名詞,地名,一般": ("名詞,固有名詞,地域,一般", 1293), "名詞,固有名詞,地名,国": ("名詞,固有名詞,地域,国", 1294),
    "名詞,数詞": ("名詞,数,*,*", 1295),
    "動詞,一般": ("動詞,自立,*,*", 619), "動詞,非自立可能": ("動詞,非自立,*,*", 919),
    "形容詞,一般": ("形容詞,自立,*,*", 35), "形容詞,非自立可能": ("形容詞,非自立,*,*", 129),
    "形状詞,一般": ("名詞,形容動詞語幹,*,*", 1287), "形状詞,タリ": ("名詞,形容動詞語幹,*,*", 1287), "形状詞,助動詞語幹": ("名詞,形容動詞語幹,*,*", 1287),
    "副詞": ("副詞,一般,*,*", 1281), "連体詞": ("連体詞,*,*,*", 1315), "接続詞": ("接続詞,*,*,*", 555),
    "感動詞,一般": ("感動詞,*,*,*", 3), "感動詞,フィラー": ("フィラー,*,*,*", 2),
    "助詞,格助詞": ("助詞,格助詞,一般,*", 155), "助詞,係助詞": ("助詞,係助詞,*,*", 258), "助詞,副助詞": ("助詞,副助詞,*,*", 350),
    "助詞,接続助詞": ("助詞,接続助詞,*,*", 307), "助詞,終助詞": ("助詞,終助詞,*,*", 279), "助詞,準体助詞": ("助詞,格助詞,一般,*", 155),
    "助動詞": ("助動詞,*,*,*", 483), "接頭辞": ("接頭詞,名詞接続,*,*", 560),
    "接尾辞,名詞的,一般": ("名詞,接尾,一般,*", 1298), "接尾辞,名詞的,サ変可能": ("名詞,接尾,サ変接続,*", 1297),
    "接尾辞,名詞的,副詞可能": ("名詞,接尾,副詞可能,*", 1305), "接尾辞,名詞的,助数詞": ("名詞,接尾,助数詞,*", 1300),
    "接尾辞,動詞的": ("動詞,接尾,*,*", 870), "接尾辞,形容詞的": ("形容詞,接尾,*,*", 91), "接尾辞,形状詞的": ("名詞,接尾,形容動詞語幹,*", 1299),
    "代名詞": ("名詞,代名詞,一般,*", 1306),
    "記号,一般": ("記号,一般,*,*", 5), "記号,文字": ("記号,アルファベット,*,*", 4),
    "補助記号,一般": ("記号,一般,*,*", 5), "補助記号,句点": ("記号,句点,*,*", 8), "補助記号,読点": ("記号,読点,*,*", 10),
    "補助記号,括弧開": ("記号,括弧開,*,*", 6), "補助記号,括弧閉": ("記号,括弧閉,*,*", 7),
    "補助記号,ＡＡ,一般": ("記号,一般,*,*", 5), "補助記号,ＡＡ,顔文字": ("記号,一般,*,*", 5),
    "空白": ("記号,空白,*,*", 9),
}


def _named(fields: list[Column]) -> list[Column]:
    return [c.alias(n) for c, n in zip(fields, FIELDS, strict=True)]


def from_unidic(rows: DataFrame, f: str = "f") -> DataFrame:
    """Field arrays of 14 or more become the 13 fields; shorter ones stay as they are."""
    pick = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 10, 13]
    return rows.withColumn(f, F.when(F.size(f) >= 14, F.array(*[F.get(f, i) for i in pick])).otherwise(F.col(f)))


def from_sudachi(rows: DataFrame, f: str = "f", keep: tuple[str, ...] = ()) -> DataFrame:
    """The usable rows in the 13 fields; what is missing or * gets its default."""
    c = [F.get(f, i) for i in range(13)]
    given = lambda i, other: F.when((c[i] != "") & (c[i] != "*"), c[i]).otherwise(other)
    star = lambda i: F.when(c[i] != "", c[i]).otherwise("*")
    blank = F.regexp_replace(c[0], r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", "") == ""
    usable = (F.size(f) >= 13) & (c[1] != "-1") & (c[2] != "-1") & ~blank
    reading = given(11, F.lit(""))
    return rows.where(usable).select(*keep, *_named([c[0], c[1], c[2], c[3], *[star(i) for i in range(5, 11)], given(4, c[0]), reading, reading]))


def pos_key(parts: list[Column]) -> Column:
    return F.array_join(F.array_remove(F.array(*parts), "*"), ",")


def _mapped(rows: DataFrame) -> DataFrame:
    pos = F.create_map(*[F.lit(x) for k, v in POS_MAP.items() for x in (k, v[0])])
    ids = F.create_map(*[F.lit(x) for k, v in POS_MAP.items() for x in (k, v[1])])
    p = [F.col(f"pos{i}") for i in (1, 2, 3, 4)]
    keys = [pos_key(p[:n]) for n in (4, 3, 2, 1)]
    return rows.withColumns({"_pos": F.coalesce(*[F.try_element_at(pos, k) for k in keys]), "_id": F.coalesce(*[F.try_element_at(ids, k) for k in keys])})


def remap_pos(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the 13 fields with mapped part of speech and ids; others are left out."""
    m = _mapped(rows).where("_pos is not null")
    part = F.split("_pos", ",")
    m = m.withColumns({f"pos{i + 1}": F.coalesce(F.get(part, i), F.lit("*")) for i in range(4)})
    return m.withColumns({"left_id": F.col("_id").cast("string"), "right_id": F.col("_id").cast("string")}).select(*keep, *FIELDS)


def fields_of(rows: DataFrame, f: str = "f") -> DataFrame:
    """Rows of 13 fields or more as named columns; shorter ones are left out."""
    return rows.where(F.size(f) >= 13).select(*[c for c in rows.columns if c != f], *_named([F.get(f, i) for i in range(13)]))


def write_csv(rows: DataFrame, f: str, output: str) -> None:
    """Field arrays as CSV files, in the order of (file, idx); a field is quoted where it must be."""
    field = lambda x: F.when(x.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    line = F.array_join(F.transform(f, field), ",")
    rows.orderBy("file", "idx").select(line.alias("value")).write.text(output)
    # The text writer knows one ending only.
    jvm = rows.sparkSession._jvm.org.apache.hadoop.fs
    fs = jvm.Path(output).getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration())
    for f in fs.globStatus(jvm.Path(f"{output}/part-*.txt*")):
        fs.rename(f.getPath(), jvm.Path(f.getPath().toString().replace(".txt", ".csv")))


def convert(spark: SparkSession, kind: str, source: str, output: str) -> dict[str, int]:
    """Converts a CSV file or folder; returns how many rows were converted and skipped.

    ``kind``: unidic (short rows are copied), sudachi (unusable rows are skipped) or
    remap (rows of 13 fields whose part of speech has no counterpart are skipped).
    """
    paths = [source] if source.endswith(".csv") or source.endswith(".txt") else list_csv(spark, source)
    rows = cut(csv_fields(spark, paths))
    if kind == "unidic":
        out = from_unidic(rows)
    elif kind == "sudachi":
        out = from_sudachi(rows, keep=("file", "idx"))
    elif kind == "remap":
        out = remap_pos(fields_of(rows), keep=("file", "idx"))
    else:
        raise ValueError(f"unknown conversion: {kind}")
    if kind != "unidic":
        out = out.select("file", "idx", F.array(*FIELDS).alias("f"))
    out = cut(out)
    write_csv(out, "f", output)
    done = out.count()
    return {"converted": done, "skipped": rows.count() - done}


def copy_matrix(spark: SparkSession, path: str, folder: str) -> tuple[int, int]:
    """Puts a matrix file into a folder as it is; returns its left and right size."""
    raw = read_bytes(spark, path)
    put(spark, f"{folder.rstrip('/')}/matrix.def", raw)
    left, right = raw.split(b"\n", 1)[0].split()[:2]
    return int(left), int(right)


def unmapped_pos(rows: DataFrame) -> DataFrame:
    """(pos, n) of the parts of speech that ``remap_pos`` leaves out."""
    return _mapped(rows).where("_pos is null").groupBy(F.concat_ws(",", "pos1", "pos2", "pos3", "pos4").alias("pos")).agg(F.count("*").alias("n"))
