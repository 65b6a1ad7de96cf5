"""Small lexicons for tests and registered queries, and SQL literals."""

from __future__ import annotations

import itertools

# (surface, id, cost, pos, reading, pronunciation); left and right id are equal.
JAPANESE = [
    ("犬", 3, 3100, "名詞,一般,*,*", "イヌ", "イヌ"),
    ("山", 3, 3300, "名詞,一般,*,*", "ヤマ", "ヤマ"),
    ("大学", 4, 2700, "名詞,一般,*,*", "ダイガク", "ダイガク"),
    ("学生", 4, 2800, "名詞,一般,*,*", "ガクセイ", "ガクセー"),
    ("大学生", 4, 2900, "名詞,一般,*,*", "ダイガクセイ", "ダイガクセー"),
    ("静か", 5, 3400, "名詞,形容動詞語幹,*,*", "シズカ", "シズカ"),
    ("も", 6, 3900, "助詞,係助詞,*,*", "モ", "モ"),
    ("生", 7, 4800, "名詞,接尾,一般,*", "セイ", "セー"),
    ("と", 8, 4100, "助詞,並立助詞,*,*", "ト", "ト"),
    ("を", 9, 4050, "助詞,格助詞,一般,*", "ヲ", "オ"),
    ("へ", 9, 4200, "助詞,格助詞,一般,*", "ヘ", "エ"),
    ("見る", 10, 4300, "動詞,自立,*,*", "ミル", "ミル"),
    ("行く", 10, 4250, "動詞,自立,*,*", "イク", "イク"),
    ("見", 11, 4600, "動詞,自立,*,*", "ミ", "ミ"),
    ("た", 12, 3700, "助動詞,*,*,*", "タ", "タ"),
    ("な", 12, 4400, "助動詞,*,*,*", "ナ", "ナ"),
]
_WORDS = "the th he in an and on of er re en to de la le que ou est st at ing ion ti es a e".split()
# Words of the tables, with homographs; few ids, so that equal totals occur.
LATIN = [(w, i % 5 + 1, 400 * (9 - len(w)) - 900 * (i % 3), f"名詞,一般,{len(w)},*", "", "") for i, w in enumerate([*_WORDS, "the", "on", "in", "er"])]
SIZE = 6
LATIN_MATRIX = {(r, k): (r * 7 + k * 11 + r * k) % 9 * 250 - 1000 for r, k in itertools.product(range(SIZE), repeat=2) if (r + k) % 4}


def entries(rows: list[tuple]) -> list[tuple]:
    """Lexicon rows with the base form equal to the surface."""
    return [(s, i, i, c, pos, s, reading, pron) for s, i, c, pos, reading, pron in rows]


def quoted(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return str(x).lower() if isinstance(x, bool) else str(x)


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"
