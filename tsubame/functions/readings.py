"""Readings of letters and units in context, as plain functions and as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reading of each letter.
LETTERS = {
    "A": "エー", "B": "ビー", "C": "シー", "D": "ディー", "E": "イー", "F": "エフ", "G": "ジー", "H": "エイチ", "I": "アイ",
    "J": "ジェー", "K": "ケー", "L": "エル", "M": "エム", "N": "エヌ", "O": "オー", "P": "ピー", "Q": "キュー", "R": "アール",
    "S": "エス", "T": "ティー", "U": "ユー", "V": "ブイ", "W": "ダブリュー", "X": "エックス", "Y": "ワイ", "Z": "ゼット",
}
# Reading of a unit after a number; single letters in either case.
UNIT_LETTERS = {"W": "ワット", "A": "アンペア", "V": "ボルト", "J": "ジュール", "N": "ニュートン", "T": "テスラ", "F": "ファラド", "H": "ヘンリー"}
UNITS = {
    "Hz": "ヘルツ", "kHz": "キロヘルツ", "MHz": "メガヘルツ", "GHz": "ギガヘルツ", "km": "キロメートル", "cm": "センチメートル",
    "mm": "ミリメートル", "nm": "ナノメートル", "kg": "キログラム", "mg": "ミリグラム", "kW": "キロワット", "MW": "メガワット",
    "mA": "ミリアンペア", "kV": "キロボルト", "dB": "デシベル", "Pa": "パスカル", "hPa": "ヘクトパスカル", "kPa": "キロパスカル",
    "MPa": "メガパスカル", "KB": "キロバイト", "MB": "メガバイト", "GB": "ギガバイト", "TB": "テラバイト", "Wh": "ワットアワー",
    "kWh": "キロワットアワー", "Ah": "アンペアアワー", "mAh": "ミリアンペアアワー", "cc": "シーシー", "hp": "馬力", "rpm": "アールピーエム",
    "fps": "エフピーエス", "bps": "ビーピーエス", "Mbps": "メガビーピーエス", "Gbps": "ギガビーピーエス",
}

NUMBER = r"^[0-9.,０-９]+$"
NUMBER_POS = "名詞,数"
KATAKANA = r"^[゠-ヿ]+$"
_NUMBER = re.compile(NUMBER[:-1] + r"\Z")
_ALPHA = re.compile(r"[A-Za-z]+\Z")


def is_number(surface: str, pos: str) -> bool:
    return pos.startswith(NUMBER_POS) or bool(_NUMBER.match(surface))


def in_context(surface: str, before: tuple[str, str] | None) -> str | None:
    """Reading of an all-letters token after (surface, pos) ``before``; else None."""
    if not _ALPHA.match(surface):
        return None
    if before and is_number(*before):
        unit = UNIT_LETTERS.get(surface.upper()) if len(surface) == 1 else UNITS.get(surface)
        if unit:
            return unit
    return "".join(LETTERS[c] for c in surface.upper())


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def is_number_like(surface: Column, pos: Column) -> Column:
    return pos.startswith(NUMBER_POS) | surface.rlike(NUMBER)


def is_katakana(text: Column) -> Column:
    return text.rlike(KATAKANA)


def unit_reading(surface: Column) -> Column:
    one = F.try_element_at(_map(UNIT_LETTERS), F.upper(surface))
    return F.when(F.length(surface) == 1, one).otherwise(F.try_element_at(_map(UNITS), surface))


def spell_out(surface: Column) -> Column:
    letters = F.split(F.upper(surface), "")
    return F.array_join(F.transform(letters, lambda c: F.try_element_at(_map(LETTERS), c)), "")


def contextual(surface: Column, before_surface: Column, before_pos: Column) -> Column:
    """Reading of an all-letters token given its predecessor in the segment; else null."""
    number = F.coalesce(is_number_like(before_surface, before_pos), F.lit(False))
    unit = F.when(number, unit_reading(surface))
    return F.when(surface.rlike("^[A-Za-z]+$"), F.coalesce(unit, spell_out(surface)))
