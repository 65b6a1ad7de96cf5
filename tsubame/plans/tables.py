"""Inputs of queries that the given tables do not hold as such, derived from them in Spark and, in the same words, in SQL.

Kana texts, lexicon rows, definition files: what a query reads grows with its tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsubame.plans import fixtures as fx
from tsubame.session import cut, put, scratch, table
from tsubame.sources import convert
from tsubame.sources.lexicon import Lexicon, LexiconBuilder

LATIN = "abcdefghijklmnopqrstuvwxyz"
# Hiragana, katakana and kanji in turn, so words have runs of all three.
KANA = "あ山いカう見エ日お本サ学た大なトの川はヒ行まミ生やル"
KATAKANA = "アイウエオカキクケコサシスセソタチツテトナニヌネノハ"
UNITS = ["kHz", "W", "km", "Q", "a", "MB", "ABC", "v"]


def spelled(text: Column) -> Column:
    return F.translate(text, LATIN + ".", KANA + "。")


def kana_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(id, text): the items of ``benchmark`` in kana and kanji, and a number with a unit from each row of ``part``."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), spelled(F.col("text")).alias("text"))
    unit = F.element_at(F.array(*map(F.lit, UNITS)), (F.col("p_partkey") % len(UNITS) + 1).cast("int"))
    text = F.concat(F.col("p_size").cast("string"), unit, F.lit(" "), F.col("p_brand"), F.lit("！"), spelled(F.col("p_name")))
    return items.unionByName(table(spark, sf, "part").select((F.col("p_partkey") + 1_000_000).alias("id"), text.alias("text")))


KANA_TEXTS = f"""src AS (SELECT item_id AS id, translate(text, '{LATIN}.', '{KANA}。') AS text FROM benchmark
  UNION ALL SELECT p_partkey + 1000000, CAST(p_size AS VARCHAR) || (['{"', '".join(UNITS)}'])[p_partkey % {len(UNITS)} + 1] || ' ' || p_brand || '！' || translate(p_name, '{LATIN}.', '{KANA}。') FROM part)"""


def kana_lexicon(spark: SparkSession, sf: str) -> Lexicon:
    """Beginnings of the words of ``benchmark``, one to three letters long, as kana and kanji."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    roots = words.select(F.expr("substring(w, 1, 1 + length(w) % 3)").alias("w")).distinct()
    n, kana = F.length("w"), F.translate("w", LATIN, KATAKANA)
    ids = (F.ascii("w") % 5 + 1).cast("int")
    cost = 5500 + F.ascii(F.substring("w", -1, 1)) % 40 * 83 - 1700 * n
    rows = roots.select("w", F.translate("w", LATIN, KANA).alias("surface"), ids.alias("left_id"), ids.alias("right_id"), cost.alias("cost"), F.concat(F.lit("名詞,一般,"), n.cast("string"), F.lit(",*")).alias("pos"), F.translate("w", LATIN, KANA).alias("base_form"), kana.alias("reading"), F.concat(kana, F.lit("ー")).alias("pronunciation"))
    return LexiconBuilder(spark).add_frame(rows, ["w"]).set_matrix(fx.SIZE, fx.SIZE, fx.LATIN_MATRIX).build()


KANA_LEXICON = f"""(SELECT row_number() OVER (ORDER BY w) - 1, translate(w, '{LATIN}', '{KANA}'), unicode(w) % 5 + 1, unicode(w) % 5 + 1, 5500 + unicode(w[-1:]) % 40 * 83 - 1700 * length(w), '名詞,一般,' || length(w) || ',*',
  translate(w, '{LATIN}', '{KANA}'), translate(w, '{LATIN}', '{KATAKANA}'), translate(w, '{LATIN}', '{KATAKANA}') || 'ー'
  FROM (SELECT DISTINCT w[:1 + length(w) % 3] AS w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)))"""


# A lexicon of as many entries as ``documents`` has words, and a full matrix.
IDS = 1316


def word_lexicon(spark: SparkSession, sf: str) -> Lexicon:
    """All words of ``documents`` of two letters or more, with costs for every pair of ``IDS`` ids."""
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÖØ-öø-ÿ]{2,}"), F.lit(0))).alias("surface")).distinct()
    n = F.char_length("surface")
    ids = ((F.ascii("surface") * 31 + F.ascii(F.substring("surface", -1, 1)) * 7 + n * 131) % IDS).cast("int")
    rows = words.select("surface", ids.alias("left_id"), ids.alias("right_id"), (6000 - 400 * n + F.ascii("surface") % 50).alias("cost"), F.lit("名詞,一般,*,*").alias("pos"), F.col("surface").alias("base_form"), F.lit("").alias("reading"), F.lit("").alias("pronunciation"))
    cells = spark.range(IDS * IDS).select(F.floor(F.col("id") / IDS).cast("int").alias("right_id"), (F.col("id") % IDS).cast("int").alias("left_id"), ((F.col("id") * 37 + F.col("id") % 977 * 101) % 2001 - 1000).cast("short").alias("cost"))
    return LexiconBuilder(spark).add_frame(rows, ["surface"]).set_matrix(IDS, IDS, cells).build()


WORD_LEXICON = """lex AS MATERIALIZED (SELECT row_number() OVER (ORDER BY surface) - 1 AS entry_id, surface FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]{2,}')) AS surface FROM documents))"""


# Lexicon files: a CSV row of each row of ``part``, some short, some with quotes and line breaks.
def csv_fields(parts: DataFrame) -> DataFrame:
    """(file, idx, f): 5 or 13 fields."""
    k, name = F.col("p_partkey"), F.col("p_name")
    surface = F.when(k % 5 == 0, F.concat(name, F.lit(', "'), F.col("p_brand"), F.lit('"\n'), k.cast("string"))).otherwise(F.concat(name, k.cast("string")))
    head = [surface, F.col("p_size").cast("string"), (k % 50).cast("string"), (k % 3000 - 1500).cast("string"), F.col("p_type")]
    kana = F.translate(F.replace(name, F.lit(" "), F.lit("")), LATIN, KATAKANA)
    more = [F.col("p_brand"), F.lit("*"), F.lit("*"), F.lit("*"), F.lit("*"), F.when(k % 7 == 0, F.lit("")).otherwise(name), kana, F.when(k % 3 == 0, name).otherwise(kana)]
    return parts.select(F.lit("part").alias("file"), k.alias("idx"), F.when(k % 11 == 0, F.array(*head)).otherwise(F.array(*head, *more)).alias("f"))


CSV_ENTRIES = f"""(SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name || ', "' || p_brand || '"' || chr(10) || p_partkey ELSE p_name || p_partkey END AS surface, p_size AS left_id, CAST(p_partkey % 50 AS INTEGER) AS right_id,
  CAST(p_partkey % 3000 - 1500 AS SMALLINT) AS cost, CASE WHEN p_partkey % 11 = 0 THEN p_type ELSE p_type || ',' || p_brand || ',*,*' END AS pos,
  CASE WHEN p_partkey % 11 = 0 THEN CASE WHEN p_partkey % 5 = 0 THEN p_name || ', "' || p_brand || '"' || chr(10) || p_partkey ELSE p_name || p_partkey END WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS base_form,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE translate(replace(p_name, ' ', ''), '{LATIN}', '{KATAKANA}') END AS reading,
  CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN p_name ELSE translate(replace(p_name, ' ', ''), '{LATIN}', '{KATAKANA}') END AS pronunciation FROM part)"""


def lexicon_folder(spark: SparkSession, sf: str, where: str = "true") -> str:
    """A folder of CSV files that holds these rows of ``part`` in their order."""
    to = scratch(spark)
    convert.write_csv(csv_fields(table(spark, sf, "part").where(where)), "f", to)
    return to


def region_file(spark: SparkSession, sf: str, path: str) -> None:
    """An EUC-JP file of the five rows of ``region``."""
    rows = table(spark, sf, "region").orderBy("r_regionkey").collect()
    put(spark, path, "".join(f"{r['r_name'].lower().translate(str.maketrans(LATIN, KANA))},1,{r['r_regionkey']},-7,名詞,一般\n" for r in rows).encode("euc_jp"))


REGION_ENTRIES = f"(SELECT r_regionkey, translate(lower(r_name), '{LATIN}', '{KANA}') AS surface, 1 AS left_id, r_regionkey AS right_id, CAST(-7 AS SMALLINT) AS cost, '名詞,一般' AS pos, translate(lower(r_name), '{LATIN}', '{KANA}') AS base_form, '' AS reading, '' AS pronunciation FROM region)"


def matrix_folder(spark: SparkSession, sf: str) -> str:
    """A matrix of 50 x 40 in several files: a line of each row of ``orders``, so many cells come more than once."""
    to = scratch(spark)
    o = table(spark, sf, "orders")
    line = F.concat_ws(" ", F.col("o_custkey") % 40, F.col("o_orderkey") % 50, F.floor("o_totalprice") % 60_000 - 30_000)
    rows = o.select(F.col("o_orderkey").alias("at"), F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("value"))
    head = spark.createDataFrame([(-1, "50 40")], "at long, value string")
    head.unionByName(rows).orderBy("at").select("value").write.text(to)
    return to


CLASS_NAMES = ["HIRAGANA", "KATAKANA", "KANJI", "ALPHA", "SYMBOL"]


def char_def(spark: SparkSession, sf: str) -> bytes:
    """A class of each row of ``region`` and a range of each row of ``nation``."""
    regions = table(spark, sf, "region").orderBy("r_regionkey").collect()
    nations = table(spark, sf, "nation").orderBy("n_nationkey").collect()
    out = [f"{CLASS_NAMES[r['r_regionkey']]} {r['r_regionkey'] % 2} {int(r['r_regionkey'] < 3)} {r['r_regionkey']} # {r['r_name']}" for r in regions]
    out += [f"0x{0x60 + 3 * n['n_nationkey']:X}..0x{0x62 + 3 * n['n_nationkey']:x} {CLASS_NAMES[n['n_regionkey']]} X" for n in nations]
    return "\n".join([out[0], "ODD 1 1", *out[1:], "0xZZ BAD", "ALPHA 1 1 9"]).encode()


def unk_def(spark: SparkSession, sf: str) -> bytes:
    """A template of each row of ``supplier``, some for a class that does not exist, some short, some twice."""
    rows = table(spark, sf, "supplier").orderBy("s_suppkey").collect()
    line = lambda s: f"{[*CLASS_NAMES, 'NOSUCH'][s['s_suppkey'] % 6]},{s['s_nationkey']},{s['s_suppkey'] % 7},{int(s['s_acctbal'])},名詞,\"{s['s_name'][:9]}\"\n"
    return "".join(line(s) + ("short,1\n" + line(s)) * (s["s_suppkey"] % 4 == 0) for s in rows).encode()


# Field arrays of two other layouts.
POS = [["名詞", "普通名詞", "一般", "*"], ["動詞", "非自立可能", "*", "*"], ["外来", "謎", "*", "*"], ["助詞", "終助詞", "*", "*"], ["名詞", "固有名詞", "地名", "国"], ["代名詞", "*", "x", "*"]]


def unidic_fields(spark: SparkSession, sf: str) -> DataFrame:
    """15 fields, 14, or 4."""
    k, s = F.col("p_partkey"), lambda x: x.cast("string")
    all_ = [F.col("p_name"), s(F.col("p_size")), s(k % 9), s(k % 100), F.col("p_type"), F.col("p_brand"), F.lit("a"), F.lit("*"), F.lit("b"), F.lit(""), F.concat(F.lit("r"), s(k)), F.concat(F.lit("l"), s(k)), F.lit("z"), F.concat(F.lit("p"), s(k)), F.lit("more")]
    return table(spark, sf, "part").select(k.alias("idx"), F.when(k % 5 == 0, F.array(*all_[:4])).when(k % 5 == 1, F.array(*all_)).otherwise(F.array(*all_[:14])).alias("f"))


def sudachi_fields(spark: SparkSession, sf: str) -> DataFrame:
    """13 fields or 3; some rows have no ids, some a blank surface, some no base form or reading."""
    k, s = F.col("p_partkey"), lambda x: x.cast("string")
    pos = F.element_at(F.array(*[F.array(*map(F.lit, p)) for p in POS]), (k % len(POS) + 1).cast("int"))
    surface = F.when(k % 13 == 0, F.lit("　")).otherwise(F.concat(F.col("p_name"), s(k)))
    left = F.when(k % 10 == 3, F.lit("-1")).otherwise(s(F.col("p_size")))
    base = F.when(k % 4 == 0, F.lit("*")).when(k % 4 == 1, F.lit("")).otherwise(F.col("p_name"))
    all_ = [surface, left, s(k % 9), s(-k), base, *[F.element_at(pos, i) for i in (1, 2, 3, 4)], F.lit(""), F.lit("*"), F.when(k % 3 == 0, F.lit("*")).otherwise(F.col("p_brand")), surface]
    # Cut, so what reads the fields is not one expression with what makes them.
    return cut(table(spark, sf, "part").select(F.when(k % 17 == 0, F.array(*all_[:3])).otherwise(F.array(*all_)).alias("f")))


SUDACHI = f"""(SELECT p_name || p_partkey AS surface, CAST(p_size AS VARCHAR) AS left_id, CAST(p_partkey % 9 AS VARCHAR) AS right_id, CAST(-p_partkey AS VARCHAR) AS cost, p[1] AS pos1, p[2] AS pos2, p[3] AS pos3, p[4] AS pos4, '*' AS conj_type, '*' AS conj_form,
  CASE WHEN p_partkey % 4 < 2 THEN p_name || p_partkey ELSE p_name END AS base_form, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS reading, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS pronunciation
  FROM (SELECT *, ({POS})[p_partkey % {len(POS)} + 1] AS p FROM part) WHERE p_partkey % 17 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 10 <> 3)"""
