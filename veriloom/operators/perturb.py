"""Typing errors and disguises put into words, to measure how well our own recognition withstands them; native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and what looks like them.
SIMILAR = {
    "-": "˗", "9": "৭", "8": "Ȣ", "7": "𝟕", "6": "б", "5": "Ƽ", "4": "Ꮞ", "3": "Ʒ", "2": "ᒿ", "1": "l", "0": "O", "'": "`",
    "a": "ɑ", "b": "Ь", "c": "ϲ", "d": "ԁ", "e": "е", "f": "𝚏", "g": "ɡ", "h": "հ", "i": "і", "j": "ϳ", "k": "𝒌", "l": "ⅼ", "m": "ｍ",
    "n": "ո", "o": "о", "p": "р", "q": "ԛ", "r": "ⲅ", "s": "ѕ", "t": "𝚝", "u": "ս", "v": "ѵ", "w": "ԝ", "x": "×", "y": "у", "z": "ᴢ",
}
DIACRITICS = {"a": "á", "c": "ć", "e": "é", "i": "í", "n": "ñ", "o": "ó", "s": "ś", "u": "ú", "y": "ý", "z": "ź"}


def _at(t: Column, k: Column) -> Column:
    return F.substring(t, k + 1, 1)


def _left(t: Column, k: Column) -> Column:
    return F.substring(t, F.lit(1), k)


def _rest(t: Column, k: Column) -> Column:
    return F.substring(t, k + 1, F.length(t))


def repeat_char(t: Column, k: Column) -> Column:
    """The character at k (from 0) written twice."""
    return F.concat(_left(t, k), _at(t, k), _rest(t, k))


def delete_char(t: Column, k: Column) -> Column:
    return F.concat(_left(t, k), _rest(t, k + 1))


def swap_chars(t: Column, k: Column) -> Column:
    """The characters at k and k + 1 exchanged; unchanged at the end."""
    return F.when(k + 1 < F.length(t), F.concat(_left(t, k), _at(t, k + 1), _at(t, k), _rest(t, k + 2))).otherwise(t)


def similar_char(t: Column, k: Column) -> Column:
    c = _at(t, k)
    table = F.create_map(*[F.lit(x) for p in SIMILAR.items() for x in p])
    return F.concat(_left(t, k), F.coalesce(F.try_element_at(table, c), c), _rest(t, k + 1))


def insert_invisible(t: Column, k: Column, char: str = "​") -> Column:
    return F.concat(_left(t, k), F.lit(char), _rest(t, k))


def accent_all(t: Column) -> Column:
    return F.translate(t, "".join(DIACRITICS), "".join(DIACRITICS.values()))


def typo_place(t: Column) -> Column:
    """The first place from 1 on that holds a letter, else 1."""
    at = F.regexp_instr(F.substring(t, F.lit(2), F.length(t)), F.lit("[A-Za-z]"))
    return F.when(at > 0, at).otherwise(1)


TYPOS = {"repeat": repeat_char, "delete": delete_char, "switch": swap_chars, "homoglyph": similar_char, "insert": insert_invisible}


def typo(t: Column, kind: str) -> Column:
    """One error of a kind at the usual place; words shorter than two characters stay."""
    return F.when(F.length(t) >= 2, TYPOS[kind](t, typo_place(t))).otherwise(t)


def move_sentence_up(sentences: Column, k: Column) -> Column:
    """Sentence k (from 0) put at the end of the one before, joined by a comma."""
    joined = F.concat_ws(", ", F.regexp_replace(F.try_element_at(sentences, k), r"[.!?]\s*$", ""), F.try_element_at(sentences, k + 1))
    n = F.size(sentences)
    return F.when((k >= 1) & (k < n), F.concat(F.slice(sentences, F.lit(1), F.greatest(k - 1, F.lit(0))), F.array(joined), F.slice(sentences, k + 2, n))).otherwise(sentences)
