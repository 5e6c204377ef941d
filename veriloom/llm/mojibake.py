"""Text decoded with the wrong character encoding: find it and put the original back where it is still known.

For every pair (true encoding, wrong encoding) the garbled sequences of the characters that mail is written in are
computed beforehand and loaded into one Aho-Corasick automaton. A match longer than one character is proof by itself
(UTF-8 read as a one-byte encoding, twice too); a one-byte encoding read as another gives single characters, which are
judged within their word: the word must look wrong as it stands and right when re-read. Only matched spans are replaced.

Edge cases: null and empty texts are clean; U+FFFD marks a loss that cannot be undone, so the field is found and the
character stays; texts of pure ASCII are skipped at once; correct accents, symbols, box drawing and other alphabets are
left alone.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings that UTF-8 is read as by mistake.
UTF8_READ_AS = ["cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "iso8859-15", "cp437", "cp850", "mac-roman", "koi8-r", "cp866"]
#: Pairs (true, wrong) of one-byte encodings.
LATIN_PAIRS = [("mac-roman", "cp1252"), ("cp1252", "mac-roman"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp1252", "cp850"), ("cp850", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "cp866"), ("cp1252", "koi8-r"), ("mac-roman", "cp1251"), ("mac-roman", "latin-1"), ("cp850", "latin-1"), ("cp1252", "iso8859-7"), ("cp437", "latin-1")]
CYRILLIC_PAIRS = [("cp1251", "cp1252"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8-r", "cp1252"), ("koi8-r", "latin-1"), ("cp866", "cp1252"), ("cp1251", "mac-roman"), ("cp1251", "cp437"), ("iso8859-5", "cp1251"), ("cp1251", "cp850"), ("koi8-r", "cp866"), ("cp866", "cp437")]
JAPANESE_PAIRS = [("cp932", "cp1252"), ("cp932", "latin-1"), ("euc-jp", "cp1252"), ("euc-jp", "latin-1"), ("cp932", "mac-roman"), ("cp932", "cp437"), ("cp932", "cp1251")]

LATIN_LETTERS = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒ"
_RARE_LATIN = frozenset("ÿýÝøØåÅæÆìÌòÒïÏîÎðÐþÞ")
_CYRILLIC = "".join(map(chr, range(0x410, 0x450))) + "Ёё"
_RUSSIAN = frozenset(_CYRILLIC)
#: Russian letters that look like Latin ones; alone in a Latin word they say nothing about the encoding.
_LOOK_ALIKE = frozenset("АВЕКМНОРСТХЅІЈаеорсухѕіјһӏԁԝѵьΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυχικγϲ") - {"ь"}


def to_bytes(text: str, encoding: str) -> bytes | None:
    """The bytes that give text when read as encoding; bytes that cp125x leave undefined pass as control characters."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        pass
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(encoding)
        except UnicodeEncodeError:
            if 0x80 <= ord(ch) <= 0x9F and encoding.startswith(("cp125", "cp932")):
                out.append(ord(ch))
            else:
                return None
    return bytes(out)


def from_bytes(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        if not encoding.startswith("cp125"):
            return None
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def reread(text: str, true: str, wrong: str) -> str | None:
    data = to_bytes(text, wrong)
    return None if data is None else from_bytes(data, true)


def _mail_characters() -> list[str]:
    chars = [chr(c) for c in range(0xA0, 0x180)] + [chr(c) for c in range(0x400, 0x460)] + [chr(c) for c in range(0x490, 0x492)]
    chars += list("ȘșȚțƒˆ˜–—―‘’‚“”„†‡•…‰‹›€™№−≤≥≠→←⇒✓★﻿​‌‍‎    ⁠　")
    chars += [chr(c) for c in range(0x391, 0x3CF)] + [chr(c) for c in range(0x3001, 0x3020)] + [chr(c) for c in range(0x3041, 0x3100)] + [chr(c) for c in range(0xFF01, 0xFF61)]
    for lead in [*range(0x88, 0xA0), *range(0xE0, 0xEB)]:  # the kanji of the double-byte code, level 1 and 2
        for trail in range(0x40, 0xFD):
            c = from_bytes(bytes([lead, trail]), "cp932")
            if c and len(c) == 1 and "一" <= c <= "鿿":
                chars.append(c)
    chars += [chr(c) for c in range(0x1F300, 0x1F650)] + [chr(c) for c in range(0x1F680, 0x1F6C6)] + [chr(c) for c in range(0x1F900, 0x1FA00)]
    return list(dict.fromkeys(chars))


_CLOSERS = frozenset("’”»…—–‘“«›‹„‚\xa0™®№")


def _plausible(seq: str) -> bool:
    """Whether correct text can hold the sequence: letters only, or a letter with quotes, dashes or signs after it."""
    letter = lambda c: c.isalpha() and c not in "ªº"
    scripts = {unicodedata.name(c, "?").split()[0] for c in seq if letter(c)}
    if not letter(seq[0]) or len(scripts) > 1 or not all(letter(c) or c in _CLOSERS for c in seq[1:]):
        return False
    if "CYRILLIC" in scripts and seq[0].islower() and any(c.isupper() for c in seq[1:]):
        return False
    return not (seq[0] in "ÃÂÄÅ" and any(c in "šžŠŽŸƒˆ˜œŒ" for c in seq[1:]))


@functools.lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Garbled sequence -> (sequence, original, weak, wrong encoding)."""
    a = ahocorasick.Automaton()
    found: dict[str, tuple[str, str, bool, str]] = {}

    def put(seq: str | None, original: str, wrong: str) -> None:
        if seq and len(seq) > 1 and seq not in found and not seq.isascii() and not any(c in " \n\t\r" for c in seq) and seq != original:
            found[seq] = (seq, original, _plausible(seq), wrong)

    chars = _mail_characters()
    for wrong in UTF8_READ_AS:
        for c in chars:
            once = from_bytes(c.encode(), wrong)
            put(once, c, wrong)
            if once and wrong in ("cp1252", "latin-1", "mac-roman", "cp437", "cp1251") and ord(c) < 0x2200:
                put(from_bytes(once.encode(), wrong), c, wrong)
                if wrong == "latin-1":
                    put(from_bytes(once.encode(), "cp1252"), c, wrong)
    for seq, value in found.items():
        a.add_word(seq, value)
    a.make_automaton()
    return a


_SUSPECT_WORD = re.compile(r"[^\s!-@\[-`{-~¿¡“„«]*[^\x00-\x7f\s][^\s!-@\[-`{-~]*")
_EDGE = "“”‘’„‚«»‹›…–—¿¡。、，：；！？（）「」()[]{}*_#~'\",.;:!?/\\|-+"
_WEAK_MARKS = frozenset("’‘“”–—…™®©°·±÷×€£¥§¶†‡•ªº¿¡«»‹›¬¦¨´¸¯√∞≈≠≤≥∂∫△⌂√ʼ²³¹¼½¾µ∑∏πΩ№\xa0　")
_APOSTROPHE = re.compile(r"(?:[dlnstmjcy]|qu|jusqu|lorsqu|puisqu|quelqu|entr|aujourd|dell|nell|sull|all|dall|un|o|ch|presqu)['’].*|.*['’](?:s|t|d|m|ll|re|ve|n|em|st|er|il|elle|on|un|une|y|en|hui)", re.I)


def _case_ok(word: str) -> bool:
    """Usual case: lower, Capitalised, ALL CAPITALS, or parts of those."""
    letters = [c for c in word if c.isalpha() and (c.isupper() or c.islower() or c == "ß")]
    if len(letters) < 2:
        return True
    ups = sum(c.isupper() for c in letters)
    if ups == 0 or ups == len(letters) or (ups == len(letters) - word.count("ß")):
        return True
    return ups == 1 and letters[0].isupper()


def _latin_ok(word: str) -> bool:
    return all((c.isascii() and c.isalpha()) or c in LATIN_LETTERS or c in "'’-" for c in word) and all(_case_ok(p) for p in re.split(r"['’-]", word) if p)


def _latin_word(word: str) -> tuple[str, tuple[str, str]] | None:
    """The word re-read and the pair, if it looks wrong as it stands and right under some pair of Latin encodings."""
    ascii_letters = sum(c.isascii() and c.isalpha() for c in word)
    high = [c for c in word if not c.isascii()]
    if not high or ascii_letters < 1 or len(high) > max(3, ascii_letters):
        return None
    if _latin_ok(word) and not any(c in "’" for c in high):
        return None
    if any("Ѐ" <= c <= "ӿ" for c in word) and all(c in "aceopxyABCEHKMOPTX" for c in word if c.isascii() and c.isalpha()):
        return None  # a Russian word with Latin look-alikes
    if all(c in _LOOK_ALIKE for c in high):
        # an accent lost to a look-alike letter; only the commonest ending says which of the two it is
        ending = re.fullmatch(r"(.*[csnxg]i)у(n)|(.*[^\Waeiou])х(es)", word)
        return (f"{ending[1]}ó{ending[2]}" if ending[1] else f"{ending[3]}õ{ending[4]}", ("cp1252", "cp1251")) if ending else None
    if ending := re.fullmatch(r"(.*[csnxg]i)[—≤](n)", word):
        return f"{ending[1]}ó{ending[2]}", ("mac-roman", "cp1252") if "—" in word else ("cp1252", "cp437")
    if "’" in high and all(c == "’" or c in LATIN_LETTERS for c in high) and (_APOSTROPHE.fullmatch(word) or len(re.split("’", word)[-1]) > 4):
        return None
    return next(((new, pair) for pair, new in _latin_readings(word)), None)


#: Accented letters by how often the languages of the mail write them, roughly: the earlier, the likelier a reading that has it.
_ACCENTED = {c: 1 - k / 40 for k, c in enumerate("éüäöáãçíóèàêñßúôâõîëùûï")}


def likelihood(word: str, new: str) -> float:
    """How much a re-reading speaks for its pair: one for the word, and how usual the letters are that it brings."""
    brought = [n for o, n in zip(word, new, strict=True) if o != n]
    return 1 + sum(_ACCENTED.get(n.lower(), 0.2) for n in brought) / max(1, len(brought))


def _latin_readings(word: str) -> Iterator[tuple[tuple[str, str], str]]:
    """(pair, re-read word) of the pairs under which a word is right that looks wrong as it stands."""
    for true, wrong in LATIN_PAIRS:
        new = reread(word, true, wrong)
        if new is None or new == word or len(new) != len(word) or not _latin_ok(new):
            continue
        changed = [(o, n, k) for k, (o, n) in enumerate(zip(word, new, strict=True)) if o != n]
        if any(not n.isalpha() or n.isascii() for _, n, _ in changed):
            continue
        # a mark between two letters, or a strange letter within a word, is evidence; a mark at an edge is not
        strong = sum(1 for o, n, k in changed if n not in _RARE_LATIN and o not in _LOOK_ALIKE and (o not in _WEAK_MARKS or (0 < k < len(word) - 1 and word[k - 1].isalpha() and word[k + 1].isalpha() and o not in "–—…·°º")))
        if strong:
            yield (true, wrong), new


def _is_russian_word(word: str) -> bool:
    core = word.strip(_EDGE)
    return bool(core) and all(c in _RUSSIAN or c in "-№" for c in core) and all(_case_ok(p) for p in core.split("-"))


_VOWELS = frozenset("аеёиоуыэюяАЕЁИОУЫЭЮЯ")
#: Russian letters from the most to the least frequent.
_FREQUENCY = {c: 33 - k for k, c in enumerate("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё")}


def _cyrillic_words(words: list[str]) -> tuple[str, str] | None:
    """The pair of Cyrillic encodings under which the words, wrong as they stand, are Russian words; None if none."""
    best = None
    for true, wrong in CYRILLIC_PAIRS:
        hits = long = letters = 0
        for w in words:
            new = reread(w, true, wrong)
            if new is None or new == w or len(new) != len(w):
                continue
            core = new.strip(_EDGE)
            body = [c for c in core if not c.isascii()]
            if not body or not all(c in _RUSSIAN for c in body) or not all(_case_ok(p) for p in re.split(r"[^\w]+", core) if p and not p.isascii()):
                continue
            if len(body) >= 3 and not (_VOWELS & set(body)):
                continue
            hits += 1
            letters += sum(_FREQUENCY.get(c.lower(), 0) for c in body)
            long += len(body) >= 3
        if long >= 1 and hits * 2 >= len(words) and (best is None or letters > best[0]):
            best = (letters, true, wrong)
    return best[1:] if best else None


_ODD_CYRILLIC = re.compile("[ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЄЇґєЅїј\x98\x80-\x9f]|[а-яё][А-ЯЁ]")
_HIGH_RUN = re.compile(r"[^\x00-\x7f][^\s]*[^\x00-\x7f]|[^\x00-\x7f]")
_JAPANESE_RUN = re.compile(r"[^\x00-\x7f](?:[!-~]?[^\x00-\x7f])*[!-~]?")


_DOUBLE_BYTE = re.compile("[\x80-\x9fƒ„†‡ˆ‰Š‹ŒŽ•˜š›žŸ¤¥‚]")


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError as e:
        return e.start > len(data) // 2  # a run may end within a character
    return True


def _japanese(run: str) -> str | None:
    if len(run) < 4 or any("　" <= c <= "鿿" for c in run):
        return None
    for true, wrong in JAPANESE_PAIRS:
        data = to_bytes(run, wrong)
        if data is None or _is_utf8(data):
            continue
        for cut in (len(data), len(data) - 1):
            try:
                new = data[:cut].decode(true)
            except UnicodeDecodeError:
                continue
            body = [c for c in new if not c.isascii()]
            good = [c for c in body if "ぁ" <= c <= "ヿ" or "一" <= c <= "鿿" or c in "、。「」（）・ー　："]
            if len(good) >= 3 and len(good) == len(body) and len(new) - len(body) <= 1 and any("ぁ" <= c <= "ヿ" for c in good):
                return new + data[cut:].decode("latin-1")
    return None


#: Words already judged, per Python worker.
_VERDICTS: dict[str, tuple[str, str, tuple[str, str]] | str | None] = {}


def _verdict(w: str) -> tuple[str, str, tuple[str, str]] | str | None:
    """A word's repair (part, new, pair); "odd" if only its text can tell; None if it is sound."""
    core = w.strip(_EDGE)
    if core.isascii():
        return "odd" if w != core and any(c not in "“”‘’„«»…–—¿¡" for c in w if not c.isascii()) or (core and w[0] in "‘’“”…–—" and core.islower()) else None
    if any(c.isascii() and c.isalpha() for c in core):
        for part in dict.fromkeys((core, w)):
            if got := _latin_word(part):
                return part, got[0], got[1]
        return None if _latin_ok(core) and core == w else "odd"
    return "odd" if not _is_russian_word(w) or _looks_wrong(w) else None




def repair(text: str | None) -> tuple[bool, str | None]:
    """(whether any part was decoded wrongly, the text with the spans put right that still can be)."""
    return _repair(text) if text is not None and is_suspicious(text) else (False, text)


def is_suspicious(text: str) -> bool:
    """Whether a text holds a word that is not sound by itself, without which no part of it was decoded wrongly."""
    if text.isascii():
        return False
    known = _SOUND.get
    for w in text.replace("\n", " ").split(" "):  # at plain spaces only: others can be part of a garbled sequence
        if not w.isascii() and not (known(w) or _is_sound(w)):
            return True
    return False


#: Words (between spaces) that hold nothing suspicious by themselves, per Python worker.
_SOUND: dict[str, bool] = {}


def _is_sound(word: str) -> bool:
    if len(_SOUND) > 300_000:
        _SOUND.clear()
    sound = "�" not in word and not _DOUBLE_BYTE.search(word) and next(automaton().iter(word), None) is None and all((v := _verdict(w)) is None or (v == "odd" and not _looks_wrong(w)) for w in _SUSPECT_WORD.findall(word))
    if len(word) <= 60:
        _SOUND[word] = sound
    return sound


def _repair(text: str) -> tuple[bool, str]:
    damaged = "�" in text
    # 1. double-byte text read byte by byte
    if _DOUBLE_BYTE.search(text):
        for m in list(_JAPANESE_RUN.finditer(text)):
            new = _japanese(m[0])
            if new is not None:
                damaged = True
                text = text.replace(m[0], new)
        if text.isascii():
            return damaged, text
    # 2. sequences that prove a pair by themselves
    spans: list[tuple[int, int, str, bool, str]] = []
    end_of_last = -1
    for end, (seq, original, weak, wrong) in automaton().iter_long(text):
        start = end - len(seq) + 1
        if start > end_of_last:
            spans.append((start, end + 1, original, weak, wrong))
            end_of_last = end
    if spans:
        proven = {wrong for *_, weak, wrong in spans if not weak}
        kept = []
        for k, (start, end, original, weak, wrong) in enumerate(spans):
            if weak and wrong not in proven:
                # letters that correct text could hold must follow each other, or break the case within a word
                before = k > 0 and spans[k - 1][1] == start and spans[k - 1][4] == wrong
                after = k + 1 < len(spans) and spans[k + 1][0] == end and spans[k + 1][4] == wrong
                last, following = text[start - 1 : start], text[end : end + 1]
                broken = last.islower() and text[start].isupper() and (wrong != "cp1251" or not last.isascii())
                if wrong == "cp1251" and text[start] in "Гв":
                    broken = (last.isascii() and last.isalpha()) or (following.isascii() and following.isalpha())
                if not (before or after or broken):
                    continue
            kept.append((start, end, original))
        if kept:
            damaged = True
            out, at = [], 0
            for start, end, original in kept:
                out += [text[at:start], original]
                at = end
            text = "".join(out) + text[at:]
            if text.isascii():
                return True, text
    # 3. one-byte encodings, word by word
    odd: list[str] = []
    fixes: dict[str, str] = {}
    pairs: dict[tuple[str, str], int] = {}
    for w in dict.fromkeys(_SUSPECT_WORD.findall(text)):
        got = _VERDICTS.get(w, 0)
        if got == 0:
            if len(_VERDICTS) > 300_000:
                _VERDICTS.clear()
            got = _VERDICTS[w] = _verdict(w)
        if got is None:
            continue
        if got == "odd":
            odd.append(w)
        else:
            part, new, pair = got
            fixes[part] = new
            pairs[pair] = pairs.get(pair, 0) + 1
    if pairs:
        damaged = True
        # One text was most likely read wrongly in one way: the pair that explains the words best decides for all of them.
        weights: dict[tuple[str, str], float] = {}
        readings = {part: dict(_latin_readings(part)) for part, new in fixes.items() if len(part) == len(new)}
        for part, found in readings.items():
            for pair, new in found.items():
                weights[pair] = weights.get(pair, 0.0) + likelihood(part, new)
        true, wrong = max(weights, key=weights.get) if weights else max(pairs, key=pairs.get)
        for part, found in readings.items():
            fixes[part] = found.get((true, wrong), fixes[part])
        for w in odd:  # the rest of the text, where the pair makes words of what no language writes
            new = reread(w, true, wrong)
            if new and new != w and len(new) == len(w) and (not _latin_ok(w.strip(_EDGE)) or w.strip(_EDGE) != w) and all(c.isascii() or c in LATIN_LETTERS or c in "¿¡«»“”’–—" for c in new) and _case_ok(new):
                fixes[w] = new
        if fixes:
            one_of = "|".join(map(re.escape, sorted(fixes, key=len, reverse=True)))
            text = re.sub(rf"(?<!\w)(?:{one_of})(?!\w)", lambda m: fixes[m[0]], text)
    wrong_looking = [w for w in odd if w not in fixes and _looks_wrong(w)]
    if wrong_looking and (pair := _cyrillic_words(wrong_looking)):
        damaged = True
        text = re.sub(r"[^\x00-\x7f][^\s\x21-\x40]*|[\x80-\xff]", lambda m: _reread_word(m[0], *pair), text)
    return damaged, text


def _reread_word(word: str, true: str, wrong: str) -> str:
    """A word of a text of which the pair is known; a sound word stays unless only its capitals are odd."""
    if word.isascii():
        return word
    new = reread(word, true, wrong)
    if new is None:
        return word
    if _is_russian_word(word) and not _looks_wrong(word):
        core = new.strip(_EDGE)
        return new if word.isupper() and core.islower() and _is_russian_word(new) else word
    return new


def _looks_wrong(word: str) -> bool:
    """A word that no alphabet writes: Latin accents only, Cyrillic of rare letters or inverted case, symbols among letters."""
    core = word.strip("“”‘’„‚«»…–—¿¡()[]{}*_#~'\",.;:!?/\\|-+")
    if not core:
        return False
    if word[0] in "‘’“”…–—" and len(core) >= 3 and all("а" <= c <= "я" for c in core) and not _VOWELS & set(core):
        return True
    if any("　" <= c <= "鿿" or c >= "＀" for c in core):
        return False
    if any("Ѐ" <= c <= "ӿ" for c in core):
        if any(c.isascii() and c.isalpha() for c in core):
            return False
        return bool(_ODD_CYRILLIC.search(core)) or any(unicodedata.category(c)[0] in "SC" for c in core)
    latin = sum(c in LATIN_LETTERS or c in "ÐðÞþ×÷¸¨ŸŽžŠš" for c in core)
    if latin >= 3 and latin == len(core) - sum(c in "-." for c in core) and not any(c.isascii() and c.isalpha() for c in core):
        return True
    boxes = sum("─" <= c <= "▟" or c in "═║╒" for c in core)
    letters = sum(c.isalpha() for c in core)
    if boxes and letters >= 1 and not core.isascii() and not any(c.isascii() and c.isalpha() for c in core):
        return True
    return sum(c in "‡†‰√ƒ≈∆˚˜Æ∏" or "\x80" <= c <= "\x9f" for c in core) >= 1 and letters >= 2 and not any(c.isascii() for c in core)


def damaged_fields(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys…, field, original) for every field of df with a wrongly decoded part; original is the repaired text.

    ASCII-only values are dropped in the JVM, so only suspects reach Python. Null fields give no row.
    """
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    rows = df.select(*keys, stacked.alias("x")).select(*keys, "x.field", "x.value").where(F.col("value").rlike(r"[^\x00-\x7F]"))
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("value").to_pylist()
            memo: dict[str, tuple[bool, str | None]] = {}
            keep, fixed = [], []
            for k, v in enumerate(values):
                got = memo.get(v)
                if got is None:
                    got = memo[v] = repair(v)
                if got[0]:
                    keep.append(k)
                    fixed.append(got[1])
            index = pa.array(keep, pa.int64())
            arrays = [batch.column(c).take(index) for c in [*keys, "field"]] + [pa.array(fixed, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "field", "value"])

    return rows.mapInArrow(run, schema).withColumnRenamed("value", "original")
