"""Text that looks the same brought to the same characters.

``canonical`` is the form for comparisons: compatibility normalisation in composed form, full case folding, mapped
white space, default-ignorable characters removed, and look-alike letters of another alphabet mapped into the alphabet
of their word. ``tidy`` is the readable form: it changes only the spans that are cases and leaves ordinary text alone.

Edge cases: null stays null, empty stays empty; pure ASCII is returned as it is (``canonical`` folds its case and white
space); joiners and variation selectors inside an emoji, joiners between letters of scripts that need them, CJK
punctuation, ordinals, fractions, unit and trade signs are no cases.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.mojibake import repair

#: Letters that look like a Latin letter, by alphabet (phonetic letters among them).
TO_LATIN = dict(
    zip(
        "АВЕЗКМНОРСТУХЅІЈԌԚԜӀаеорсухѕіјһӏԁԛԝѵӓӧү" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορτυχωϲϳ" + "ՕՍօսոհցքյ" + "ɑɡɩɪʏʀɴʜʙɢʟᴀᴄᴅᴇᴊᴋᴍᴏᴘᴛᴜᴠᴡᴢ",
        "ABE3KMHOPCTYXSIJGQWIaeopcyxsijhldqwväöy" + "ABEZHIKMNOPTYXayikvoptuxwcj" + "OUounhgpj" + "agiiYRNHBGLACDEJKMOPTUVWZ",
        strict=False,
    )
)
#: Letters of words in the other direction: Latin letters within a Cyrillic or Greek word.
_TO_CYRILLIC = dict(zip("AaBCcEeHKkMmOoPpTXxYyiIjJsSnhd", "АаВСсЕеНКкМмОоРрТХхУуіІјЈѕЅпһԁ", strict=True))
_TO_GREEK = dict(zip("ABEZHIKMNOPTYXoavu", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανυ", strict=True))

_SPACES = "\xa0  -   　"
_INVISIBLE = "\xad͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff"
#: Compatibility forms of letters and digits; ordinals, fractions, superscript figures and signs are not among them.
_FORMS = "０-９Ａ-Ｚａ-ｚｦ-ﾝ\U0001d400-\U0001d7ffﬀ-ﬆﬓ-ﬗⒶ-ⓩ\U0001f130-\U0001f149ĲĳǄ-ǌǱ-ǳℂℊ-ℒℕℙ-ℝℤℨℬℭℯ-ℱℳℴᴬ-ᴮᴰ-ᵪₐ-ₜ\U0001ee00-\U0001eebb\U0001fbf0-\U0001fbf9"
_MARKS = "̀-゙゚ͯ"
_LATIN, _CYR, _GREEK, _ARM = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏḀ-ỿ", "Ѐ-ԯ", "Ͱ-ͳͶ-ͽΆΈ-Ͽ", "Ա-Ֆա-և"
_PHON = "ɑɡɩɪʏʀɴʜʙɢʟᴀᴄᴅᴇᴊᴋᴍᴏᴘᴛᴜᴠᴡᴢ"
_SCRIPTS = [_LATIN, _CYR, _GREEK, _ARM]

_FORM_RE = re.compile(f"[{_FORMS}]")
_SPACE_RE = re.compile(f"[{_SPACES}]")
_INVISIBLE_RE = re.compile(f"[{_INVISIBLE}]")
_MARK_RE = re.compile(f"[^\\W\\d_][{_MARKS}]")
_MIXED_RE = re.compile("|".join(f"[{a}][{''.join(b for b in _SCRIPTS if b != a)}]" for a in _SCRIPTS) + f"|[{_LATIN}][{_PHON}]|[{_PHON}][{_LATIN}]")
_WORD_RE = re.compile(f"[{_LATIN}{_CYR}{_GREEK}{_ARM}{_PHON}{_MARKS}]+")
_ANY_RE = re.compile(f"[{_FORMS}{_SPACES}{_INVISIBLE}{_MARKS}{_PHON}{_CYR}{_GREEK}{_ARM}]")
#: Greek letters that stand for quantities and units before or after a few Latin letters.
_QUANTITIES = frozenset("μΔΣπλΩθσβδεφψωΨΦΓΛΠΘΞ")


def _emoji(c: str) -> bool:
    return c in "️‍⃣" or unicodedata.category(c) in ("So", "Sk") or "\U0001f000" <= c <= "\U0001faff" or "\U000e0020" <= c <= "\U000e007f"


def _joining(c: str) -> bool:
    return "؀" <= c <= "ࣿ" or "ऀ" <= c <= "෿" or "ក" <= c <= "᣿"


def _hidden(text: str, k: int) -> bool:
    """Whether the formatting character at k is one that nothing visible needs."""
    c, before, after = text[k], text[k - 1 : k], text[k + 1 : k + 2]
    if c == "‍":
        return not ((before and _emoji(before) and after and _emoji(after)) or (before and _joining(before)))
    if c == "‌":
        return not (before and after and _joining(before) and _joining(after))
    if "︀" <= c <= "️":
        return not (before and (_emoji(before) or before in "#*0123456789‼⁉©®™ℹ↔↩〰㊗㊙" or unicodedata.category(before) in ("Sm", "So") or "㐀" <= before <= "鿿"))
    if "\U000e0020" <= c <= "\U000e007f":
        return not (before and (before == "\U0001f3f4" or "\U000e0020" <= before <= "\U000e007f"))
    if "᠋" <= c <= "᠏" and c != "᠎":
        return not (before and _joining(before))
    return True


def _mixed_word(word: str) -> bool:
    if len(word) <= 3 and sum(c in _QUANTITIES for c in word) == 1 and all(c in _QUANTITIES or c.isascii() for c in word):
        return False
    return bool(_MIXED_RE.search(word))


def is_case(text: str | None) -> bool:
    """Whether the text holds a character that only looks like the usual one."""
    if text is None or text.isascii() or not _ANY_RE.search(text):
        return False
    if _FORM_RE.search(text) or _SPACE_RE.search(text):
        return True
    if any(_hidden(text, m.start()) for m in _INVISIBLE_RE.finditer(text)):
        return True
    if any(len(unicodedata.normalize("NFC", m[0])) == 1 for m in _MARK_RE.finditer(text)):
        return True
    if _MIXED_RE.search(text):
        return any(_mixed_word(m[0]) for m in _WORD_RE.finditer(text))
    return False


def _script(c: str) -> str:
    o = ord(c)
    if c in _PHON:
        return "phonetic"
    return "cyrillic" if 0x400 <= o <= 0x52F else "greek" if 0x370 <= o <= 0x3FF else "armenian" if 0x531 <= o <= 0x587 else "latin"


def _one_alphabet(m: re.Match) -> str:
    """A word of several alphabets written in one: the one in which every letter has a form; Latin first if several do."""
    word = m[0]
    if not _mixed_word(word):
        return word
    scripts = [_script(c) for c in word if not unicodedata.combining(c)]
    cyrillic_only = sum(1 for c in word if _script(c) == "cyrillic" and c not in TO_LATIN)
    greek_only = sum(1 for c in word if _script(c) == "greek" and c not in TO_LATIN)
    if cyrillic_only or (scripts.count("cyrillic") > len(scripts) / 2 and all(c in _TO_CYRILLIC for c in word if _script(c) == "latin") and "greek" not in scripts and "armenian" not in scripts and not any(c in "ѕԝԁӏһ" for c in word)):
        return "".join(_TO_CYRILLIC.get(c, c) for c in word)
    if greek_only:
        return "".join(_TO_GREEK.get(c, c) for c in word)
    return "".join(TO_LATIN.get(c, c) for c in word)


def tidy(text: str | None) -> str | None:
    """The text with only the cases replaced by the usual characters."""
    if text is None or text.isascii() or not _ANY_RE.search(text):
        return text
    text = _FORM_RE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    text = _SPACE_RE.sub(" ", text)
    if _INVISIBLE_RE.search(text):
        text = "".join(c for k, c in enumerate(text) if not (_INVISIBLE_RE.match(c) and _hidden(text, k)))
    text = re.sub(f"[^\\W\\d_][{_MARKS}]+", lambda m: unicodedata.normalize("NFC", m[0]), text)
    if _MIXED_RE.search(text):
        text = _WORD_RE.sub(_one_alphabet, text)
    return unicodedata.normalize("NFC", text) if re.search(f"[{_MARKS}]", text) else text


_QUOTES = str.maketrans({"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "–": "-", "—": "-", "‐": "-", "‑": "-", "−": "-"})


def canonical(text: str | None) -> str | None:
    """The form under which texts that look the same compare equal."""
    if text is None:
        return None
    if text.isascii():
        return " ".join(text.casefold().split())
    text = tidy(text)
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).translate(_QUOTES)
    text = _INVISIBLE_RE.sub("", text)
    return " ".join(unicodedata.normalize("NFC", text).split())


def per_distinct(values: pa.Array, *functions: Callable[[str | None], object]) -> list[pa.Array]:
    """The results of functions of a column, each worked out once for every distinct value of the column."""
    coded = values.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    return [pa.array([f(v) for v in distinct], pa.bool_() if f in _TESTS else pa.string()).take(coded.indices) for f in functions]


def looks_alike(text: str | None) -> bool:
    """Whether a text is not in the form that looks the same and has only usual characters, and isn't wrongly decoded besides."""
    return tidy(text) != text and not repair(text)[0]


_TESTS = (looks_alike,)


def normalise_text(df: DataFrame, field: str, readable: str = "text_tidy", key: str = "text_key") -> DataFrame:
    """df with the readable and the comparison form of a field; each distinct value of a batch is worked out once.

    Existing columns of the result names are replaced; a null field gives nulls.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    kept = [c for c in df.columns if c not in (readable, key)]
    fields = [df.schema[c] for c in kept] + [StructField(readable, StringType()), StructField(key, StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = per_distinct(batch.column(field), tidy, canonical)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + new, names=[*kept, readable, key])

    return df.select(*kept + ([] if field in kept else [field])).mapInArrow(run, StructType(fields))


def cases(df: DataFrame, keys: list[str], field: str) -> DataFrame:
    """The keys of rows whose field differs from its tidy form and isn't wrongly decoded besides. ASCII rows never reach Python."""
    rows = df.select(*keys, F.col(field).alias("__value")).where(F.col("__value").rlike(r"[^\x00-\x7F]"))
    schema = df.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(keys).filter(per_distinct(batch.column("__value"), looks_alike)[0])

    return rows.mapInArrow(run, schema)
