"""SQL pieces that express segmentation, candidates and the best path for DuckDB."""

from __future__ import annotations

from tsubame.plans.fixtures import quoted, values

# What follows states the semantics anew, in SQL's terms; nothing is taken from the engine.
SPLIT = r"[^。！？!?\n]*[。！？!?\n]|[^。！？!?\n]+"
# Code points of each type, and (invoke, group, length, cost, part of speech) of its unknown words.
CLASSES = {
    "HIRAGANA": ([(0x3040, 0x309F)], (False, True, 2, 8000, "名詞,一般,*,*")),
    "KATAKANA": ([(0x30A0, 0x30FF), (0x31F0, 0x31FF), (0xFF65, 0xFF9F)], (True, True, 2, 5000, "名詞,一般,*,*")),
    "KANJI": ([(0x3007, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF)], (False, False, 2, 7000, "名詞,一般,*,*")),
    "ALPHA": ([(65, 90), (97, 122), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)], (True, True, 0, 6000, "名詞,固有名詞,組織,*")),
    "NUMERIC": ([(48, 57)], (True, True, 0, 6000, "名詞,数,*,*")),
    "NUMERICWIDE": ([(0xFF10, 0xFF19)], (True, True, 0, 6000, "名詞,数,*,*")),
    "SYMBOL": ([(33, 47), (58, 64), (91, 96), (123, 126), (0x3001, 0x3006), (0x3008, 0x303F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20)], (True, True, 0, 9000, "記号,一般,*,*")),
    "SPACE": ([(9, 13), (32, 32), (0x3000, 0x3000)], (False, True, 0, 3000, "記号,空白,*,*")),
    "DEFAULT": ([], (False, True, 0, 10000, "名詞,サ変接続,*,*")),
}
_IN = {k: "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in v) for k, (v, _) in CLASSES.items()}
RUN = "|".join([*(f"[{x}]+" for x in _IN.values() if x), f"[^{''.join(_IN.values())}]+"])
PAIRED = f"^[{_IN['HIRAGANA']}{_IN['KATAKANA']}{_IN['KANJI']}]"


def surfaces(seg: str) -> str:
    """List of the surfaces of a segment without a lexicon: runs, those of kana and kanji in pairs from the right."""
    pairs = "list_transform(range(0, (length(r) + 1) // 2), lambda j: CASE WHEN length(r) % 2 = 0 THEN substr(r, 2 * j + 1, 2) WHEN j = 0 THEN r[1] ELSE substr(r, 2 * j, 2) END)"
    return f"flatten(list_transform(regexp_extract_all({seg}, '{RUN}'), lambda r: CASE WHEN regexp_matches(r, '{PAIRED}') THEN {pairs} ELSE [r] END))"


def type_case(ch: str) -> str:
    arms = " ".join(f"WHEN unicode({ch}) BETWEEN {a} AND {b} THEN '{k}'" for k, (v, _) in CLASSES.items() for a, b in v)
    return f"CASE {arms} ELSE 'DEFAULT' END"


def segments(source: str, key: str, text: str = "text") -> str:
    """CTE ``segs``: key, seg_idx (from 0), seg."""
    split = f"regexp_extract_all({text}, '{SPLIT}')"
    return f"segs AS (SELECT {key}, CAST(i - 1 AS INTEGER) AS seg_idx, s[i] AS seg FROM (SELECT {key}, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT {key}, {split} AS s FROM {source})))"


def runs(key: str) -> str:
    """CTE ``toks``: key, seg_idx, tok_idx, surface without a lexicon."""
    return f"toks AS (SELECT {key}, seg_idx, CAST(i - 1 AS INTEGER) AS tok_idx, t[i] AS surface FROM (SELECT {key}, seg_idx, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT {key}, seg_idx, {surfaces('seg')} AS t FROM segs)))"


def lattice(key: str, lexicon: list[tuple] | str, flat: bool = False) -> str:
    """CTEs up to ``nodes`` (key, seg_idx, start, end, unk, entry_id, left_id, right_id, word_cost, type).

    ``lexicon`` has rows (surface, left_id, right_id, cost, pos, base_form, reading, pronunciation), or is a
    select of such rows with their numbers in front.
    """
    lex = lexicon if isinstance(lexicon, str) else values([(i, *r) for i, r in enumerate(lexicon)]) if lexicon else "(SELECT 0, '', 0, 0, 0, '', '', '', '' WHERE false)"
    unk = values([(k, i, *u[:3], 0, 0, *((10_000, "名詞,一般,*,*") if flat else u[3:])) for i, (k, (_, u)) in enumerate(CLASSES.items())])
    k = f"{key}, seg_idx"
    return f"""lex(entry_id, surface, left_id, right_id, cost, pos, base_form, reading, pronunciation) AS MATERIALIZED {lex},
unk(type, no, invoke, grp, len, left_id, right_id, cost, pos) AS {unk},
chars AS (SELECT {k}, seg, length(seg) AS n, p, substr(seg, p + 1, 1) AS ch FROM (SELECT {k}, seg, unnest(range(0, length(seg))) AS p FROM segs)),
typed AS (SELECT *, {type_case("ch")} AS type FROM chars),
marked AS (SELECT *, CASE WHEN lead(type) OVER w IS NOT DISTINCT FROM type THEN NULL ELSE p + 1 END AS stop FROM typed WINDOW w AS (PARTITION BY {k} ORDER BY p)),
run AS (SELECT *, min(stop) OVER (PARTITION BY {k} ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS run_end FROM marked),
hit AS (SELECT {k}, p, lex.* FROM run JOIN lex ON lex.surface = substr(seg, p + 1, length(lex.surface))),
seen AS (SELECT DISTINCT {k}, p FROM hit),
open AS (SELECT run.*, unk.* EXCLUDE (type) FROM run JOIN unk USING (type) LEFT JOIN (SELECT *, true AS known FROM seen) USING ({k}, p) WHERE invoke OR known IS NULL),
reach AS (SELECT *, p + 1 AS e FROM open
  UNION SELECT *, CASE WHEN len = 0 THEN run_end ELSE least(run_end, p + greatest(2, len)) END FROM open WHERE grp
  UNION SELECT *, unnest(range(p + 1, least(run_end, p + greatest(1, len)) + 1)) FROM open WHERE NOT grp),
nodes AS (SELECT {k}, CAST(p AS INTEGER) AS start, CAST(p + length(surface) AS INTEGER) AS "end", 0 AS unk, entry_id, left_id, right_id, cost AS word_cost, NULL::VARCHAR AS type FROM hit
  UNION ALL SELECT {k}, CAST(p AS INTEGER), CAST(e AS INTEGER), 1, no, left_id, right_id, cost, type FROM reach)"""


def best_path(key: str, matrix: dict[tuple[int, int], int]) -> str:
    """CTE ``best``: key, seg_idx, seg, total and path ('start-end-unk-entry ...')."""
    k = f"{key}, seg_idx"
    pairs = [(r * 65_536 + c, v) for (r, c), v in matrix.items()] or [(0, 0)]
    conn = "MAP {" + ", ".join(f"{a}: {b}" for a, b in pairs) + "}"
    pred = "list_min(list_transform(list_filter(acc, lambda y: y.e = {at}), lambda y: {{'t': y.t + coalesce(({conn})[y.r * 65536 + {left}], 0), 's': y.s, 'u': y.u, 'id': y.id, 'path': y.path}}))"
    inner = pred.format(at="x[1].s", left="x[1].l", conn=conn)
    step = "[{'t': b.t + x[1].c, 's': x[1].s, 'u': x[1].u, 'id': x[1].id, 'e': x[1].e, 'r': x[1].r, 'l': x[1].l, 'c': x[1].c, 'path': b.path || x[1].path || ' '}]"
    done = pred.format(at="n", left="0", conn=conn)
    return f"""listed AS (SELECT {k}, max("end") AS n, list([{{'t': 0::BIGINT, 's': start, 'u': unk, 'id': CAST(entry_id AS INTEGER), 'e': "end", 'r': CAST(right_id AS INTEGER), 'l': CAST(left_id AS INTEGER), 'c': CAST(word_cost AS INTEGER),
    'path': start || '-' || "end" || '-' || unk || '-' || entry_id}}] ORDER BY "end", start, unk, entry_id) AS ns FROM nodes GROUP BY {k}),
folded AS (SELECT {k}, n, list_reduce(ns, lambda acc, x: list_concat(acc, flatten(list_transform(list_filter([{inner}], lambda b: b IS NOT NULL), lambda b: {step}))),
  [{{'t': 0::BIGINT, 's': -1, 'u': 0, 'id': 0, 'e': 0, 'r': 0, 'l': 0, 'c': 0, 'path': ''}}]) AS acc FROM listed),
ended AS (SELECT {k}, {done} AS b FROM folded),
best AS (SELECT {k}, seg, b.t AS total, trim(b.path) AS path FROM ended JOIN segs USING ({k}))"""


def path_tokens(key: str) -> str:
    """CTE ``toks``: one row a token, with byte offsets in the segment."""
    k = f"{key}, seg_idx"
    return f"""items AS (SELECT {k}, seg, i - 1 AS tok_idx, string_split(t[i], '-') AS f FROM (SELECT {k}, seg, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT {k}, seg, string_split(path, ' ') AS t FROM best WHERE path <> ''))),
cutup AS (SELECT {k}, tok_idx, CAST(f[3] AS INTEGER) AS u, CAST(f[4] AS INTEGER) AS eid, substr(seg, CAST(f[1] AS INTEGER) + 1, CAST(f[2] AS INTEGER) - CAST(f[1] AS INTEGER)) AS surface,
  strlen(substr(seg, 1, CAST(f[1] AS INTEGER))) AS s, strlen(substr(seg, 1, CAST(f[2] AS INTEGER))) AS e FROM items),
toks AS (SELECT {k}, CAST(tok_idx AS INTEGER) AS tok_idx, c.surface, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end",
  CASE WHEN u = 1 THEN unk.pos ELSE lex.pos END AS pos, CASE WHEN u = 1 THEN c.surface ELSE lex.base_form END AS base_form,
  CASE WHEN u = 1 THEN '' ELSE lex.reading END AS reading, CASE WHEN u = 1 THEN '' ELSE lex.pronunciation END AS pronunciation,
  CAST(CASE WHEN u = 1 THEN unk.cost ELSE lex.cost END AS SMALLINT) AS word_cost, u = 0 AS is_known
  FROM cutup c LEFT JOIN lex ON u = 0 AND lex.entry_id = eid LEFT JOIN unk ON u = 1 AND unk.no = eid)"""


def literal_map(m: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in m.items()) + "}"


# Fixed values, stated anew: readings of letters and units, numbers, default classes, parts of speech of another layout.
LETTERS = literal_map(dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "エー ビー シー ディー イー エフ ジー エイチ アイ ジェー ケー エル エム エヌ オー ピー キュー アール エス ティー ユー ブイ ダブリュー エックス ワイ ゼット".split(), strict=True)))
UNIT_LETTERS = literal_map(dict(zip("WAVJNTFH", "ワット アンペア ボルト ジュール ニュートン テスラ ファラド ヘンリー".split(), strict=True)))
UNIT_NAMES = "Hz kHz MHz GHz km cm mm nm kg mg kW MW mA kV dB Pa hPa kPa MPa KB MB GB TB Wh kWh Ah mAh cc hp rpm fps bps Mbps Gbps".split()
UNITS = literal_map(dict(zip(UNIT_NAMES, "ヘルツ キロヘルツ メガヘルツ ギガヘルツ キロメートル センチメートル ミリメートル ナノメートル キログラム ミリグラム キロワット メガワット ミリアンペア キロボルト デシベル パスカル ヘクトパスカル キロパスカル メガパスカル キロバイト メガバイト ギガバイト テラバイト ワットアワー キロワットアワー アンペアアワー ミリアンペアアワー シーシー 馬力 アールピーエム エフピーエス ビーピーエス メガビーピーエス ギガビーピーエス".split(), strict=True)))
NUMBER = "^[0-9.,０-９]+$"
NUMBER_POS = "名詞,数"
CLASS_NAMES = ["DEFAULT", "SPACE", "KANJI", "HIRAGANA", "KATAKANA", "ALPHA", "NUMERIC", "SYMBOL", "KANJINUMERIC"]
POS = values([("名詞,普通名詞,一般", "名詞,一般,*,*", 1285), ("動詞,非自立可能", "動詞,非自立,*,*", 919), ("助詞,終助詞", "助詞,終助詞,*,*", 279), ("名詞,固有名詞,地名,国", "名詞,固有名詞,地域,国", 1294), ("代名詞", "名詞,代名詞,一般,*", 1306)])
