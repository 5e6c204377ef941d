"""Personal information in free text: found, typed, and replaced by placeholders.

A skip-chain conditional random field over candidate segments of a text. Candidates are capitalised runs that can be a name,
addresses of mail, numbers in the shapes of telephones and identity numbers, and postal addresses; each is a node with the
labels "piece of its kind" and "other". Node potentials come from features of form, context and word statistics. Edges couple
neighbours on a line, and skip edges couple candidates anywhere in the text whose names are equal, differ by a slip or share
the surname, so that a doubtful mention follows the sure ones. Loopy sum-product messages run over all nodes and edges.

All potentials, those of the edges too, are trained: by pseudo-likelihood on about ``TRAIN_TEXTS`` texts at most, which label
themselves. Message headers, introductions of quotes, greetings and closings name persons; dates and verbs show which words
only look like names. What is known of the words themselves is hidden from a part of the training nodes, so that form and
context learn to do without it.

No names are given. Word statistics are counted over all texts: a word is a given name if ``LEXICON_TEXTS`` texts show it so in
headers, introductions or greetings, and it names something else if it closes or opens capitalised runs beside words that
are no given names. More than ``MOST_NAMES`` given names are an error. The other words are all kept, whatever the number of
texts: what a word counts as does not depend on how many others there are. Beyond ``MOST_OTHERS`` they are held packed
(``Words``), at a word's own bytes and eight more. A name that no other text shows is still a candidate.

Edge cases: null and empty texts have no pieces; a piece never crosses a line end; pieces are given as they stand in the
text, look-alike characters included; a name that is only a title, a brand or a role is no piece; equal pieces of a text
count once.
"""

from __future__ import annotations

import difflib
import functools
import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Set
from dataclasses import dataclass, field
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm.mojibake import is_suspicious, repair
from veriloom.llm.unicode_forms import _ANY_RE, _INVISIBLE_RE, _WORD_RE, _hidden, _one_alphabet, is_case
from veriloom.session import shared_path, table

#: Most texts the model is fitted on, and the most characters of those that are read for it.
TRAIN_TEXTS = 1500
#: A given name joins the lexicon when at least so many texts name a person so.
LEXICON_TEXTS = 2
#: Names that a lexicon may have beside the fixed ones.
MOST_NAMES = 500_000
#: A word that is no name opens or closes so many runs at least.
LEAST_OTHER = 5
#: Most words that are held as a set; more are held packed, with the same answers.
MOST_OTHERS = 200_000
#: Share of training nodes whose word statistics are hidden.
HIDDEN = 0.3
#: Edges: neighbours on a line of one kind and of two, equal candidates, those that share a surname or differ by a slip.
EDGES = ("chain", "chain_other", "equal", "similar")

_UP, _LOW = "A-ZÀ-ÖØ-ÞĀ-ŽА-ЯЁΑ-Ω", "a-zß-öø-ÿā-žа-яёα-ω"
_TOKEN = re.compile(rf"[{_UP}](?:[{_UP}{_LOW}]|['’](?=[{_UP}{_LOW}]))*(?:-[{_UP}](?:[{_UP}{_LOW}]|['’](?=[{_UP}{_LOW}]))*)*")
_PARTICLE = r"(?:de la|de los|van der|van den|von der|von dem|de|van|von|der|da|do|dos|das|du|di|del|la|le|ten|zu|af|al|bin)"
_SURNAME = rf"[{_UP}](?:[{_LOW}{_UP}]|['’](?=[{_UP}{_LOW}]))*[{_LOW}{_UP}](?:-[{_UP}](?:[{_LOW}{_UP}]|['’](?=[{_UP}{_LOW}]))+)*"
_AFTER = re.compile(rf"(?: [{_UP}]\.){{0,2}} (?:{_PARTICLE} )?({_SURNAME})(?![\w@])")
_BEFORE = re.compile(rf"(?:^|(?<=[\s(>|:;,\"“«*]))((?:{_PARTICLE} )?({_SURNAME}), )$", re.I)
_INITIAL = re.compile(rf" [{_UP}]\.(?=[\s,;:)\]>(-]|$)")
#: Capitalised words that are no surname.
_NO_SURNAME = frozenset(
    """I The A An And Or But If In On At To From For Of With By As It Is He She We They You My Your Our This That These Could Can Please Thank Thanks Both Some Someone Nothing Half Most
    Best Kind Regards Dear Hi Hello Sent Subject Date Cc Bcc To Re Fw Fwd Aw Wg Tag Am Im Die Der Das Wir Ich Sie Es Für Bitte Und Le La Les Il Elle Je Nous Vous Si El Los Las Un Una O Os As Um Uma
    Monday Tuesday Wednesday Thursday Friday Saturday Sunday Mon Tue Wed Thu Fri Sat Sun January February March April June July August September October November December Jan Feb Mar Apr Jun Jul
    Aug Sep Oct Nov Dec Lun Mié Jue Vie Sáb Dom ID PM AM Tel Phone Mail Email Apt Street Road Lane Drive Court Close Avenue Ave Rd St MBA PhD Dr Prof Mr Mrs Ms Herr Frau Team Support Service
    Department Office Bank Group Ltd Inc GmbH EUR USD GBP CHF Via""".split()
)
#: Common words for kinds of organisations and for roles; those of the data are counted.
_TRADES = frozenset("airlines bank bakery city club college company department energy foods group health hospital hotel hotels institute insurance international logistics media motors museum office school security services service society software systems team telecom travel university desk support helpdesk payable receivable reply noreply sales billing newsletter notifications alerts news orders payments info contact".split())
_GREETING = re.compile(r"(?:hi|hello|dear|hey|good (?:morning|day|afternoon|evening)|hallo|liebe[rs]?|lieber|guten (?:tag|morgen|abend)|sehr geehrte(?:/?r|r| frau| herr)?|moin|cher|chère|bonjour|bonsoir|salut|hola|estimad[oa](?:/a)?|querid[oa]|buenos días|bom dia|boa tarde|olá|car[oa]|prezad[oa]|здравствуйте|привет|уважаем(?:ый|ая)|дорог(?:ой|ая)|добрый день)[\s,]*(?:(?:dr|prof|mr|mrs|ms|herr|frau|me|sr|sra|dra)\.?\s+)*$", re.I)
#: The last words of those, and titles.
_GREETING_ENDS = frozenset("hi hello dear hey morning day afternoon evening hallo liebe lieber liebes guten tag abend geehrte geehrter geehrte/r geehrte/rr geehrterr frau herr moin cher chère bonjour bonsoir salut hola estimado estimada estimado/a estimada/a querido querida días dia tarde olá caro cara prezado prezada здравствуйте привет уважаемый уважаемая дорогой дорогая день dr prof mr mrs ms me sr sra dra".split())
_TITLE = re.compile(r"(?:^|[\s(>])(?:dr|prof|mr|mrs|ms|mx|herr|frau|herrn|me|mme|m|sr|sra|dr\.ª|dra|dña|don|doña|г-н|г-жа|господин|госпожа)\.?\s$", re.I)
_HEADER = re.compile(r"(?:^|[>|\s])\*?(?:from|to|cc|bcc|von|an|de|à|para|от|кому|reply-to|contact)\*?:\s*(?:\"?)$", re.I)
_LEAD = re.compile(r"\b(?:with|to|call|from|by|for|ask|asked|contact|copy|cc|of|and|und|et|y|e|и|mit|von|an|avec|à|par|con|com|a|para|por|is|named?|called)\s(?:(?:dr|prof|mr|mrs|ms|me|herrn?|frau)\.?\s)?$", re.I)
_TAIL = re.compile(r"\s*(?:<|\[mailto|\[(?:mon|tue|wed|thu|fri|sat|sun)|\(|wrote|schrieb|a écrit|escribi|escreveu|написал|on [+(\d]|and (?:he|she|they)\b|via |from |– |- )", re.I)
_DAY_BEFORE = re.compile(r"(?:\d{1,2}(?:st|nd|rd|th|\.)?|(?:mon|tue|wed|thu|fri|sat|sun)\w*,?|in|since|until|by|before|early|late|mid|of|last|next|im|am|until the end of)\s$", re.I)
_DAY_AFTER = re.compile(r"\s(?:\d{1,2}\b|\d{4}\b|,? \d{4})")
#: Given names that are words of everyday English too.
_AMBIGUOUS = frozenset("Amber Angel April Art August Bill Dawn Dean Faith Frank Grace Grant Holly Hope Iris Ivy Joy June Mark May Miles Pat Rich Rose Sky Summer Will".split())
_MONTHS = frozenset("May April June August".split())

_EMAIL = re.compile(r"(?<![\w.+-])[\w][\w.+%'-]*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}(?![\w-])")
_AT, _POINT = r"(?: ?[\[({] ?at ?[\])}] ?| AT | @ )", r"(?: dot | DOT | Dot | ?[\[({] ?[Dd][Oo][Tt] ?[\])}] ?)"
_SPELT = re.compile(rf"(?<![\w.+@-])[A-Za-z0-9][\w.+-]*(?:(?:{_AT}| at |\[AT\]|\(AT\))[A-Za-z0-9][\w-]*(?:(?:{_POINT}|\.)[A-Za-z0-9-]+)*{_POINT}[A-Za-z]{{2,}}|(?:{_AT}|\[AT\]|\(AT\))[A-Za-z0-9][\w-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}})(?![\w-])")
_NUMBER = re.compile(r"(?<![\w/.,#+€$£-])(?:\+|\()?\d(?:[ \t]?[().\/-]?[ \t]?\(?\d\)?)*(?![\w/]|[.,-]\d)")
_IDENTITY = re.compile(r"(?<![\w/.#+-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|\d{3}-\d{2}-\d{4}|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]?|\d{6}[-+]\d{4}|\d{2} \d{3} \d{3} \d{3}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{3}-\d{3}-\d{3} \d{2}|\d{13}|[A-Z]\d{8}|\d{4} \d{4} \d{4})(?![\w/-]|[.,]\d)")
_PHONE_FORMS = [
    ("plus", re.compile(r"\+\d{1,3}(?:[ .-]?\(?\d\)?)[\d ().-]{5,18}\d")),
    ("zeros", re.compile(r"00\d{2}[ .-]?[\d .()-]{6,16}\d")),
    ("nanp", re.compile(r"(?:1[ .-])?(?:\(\d{3}\)\s?|\d{3}[.-])\d{3}[.-]\d{4}")),
    ("slash", re.compile(r"0\d{1,5}\s?/\s?\d[\d -]{3,10}\d")),
    ("pairs", re.compile(r"0\d(?:[ .]\d\d){4}")),
    ("trunk", re.compile(r"\(?0\d{2,4}\)?[ -]\d{3,4}[ -]?\d{3,4}")),
]
_ID_CUE = re.compile(r"(?:\bid\b|passport|tax (?:number|id)|steuer|ausweis|social security|national insurance|insurance number|identity|identit|identificação|pièce|паспорт|инн\b|снилс|\bdni\b|\bnie\b|\bnif\b|\bcpf\b|\bssn\b|badge|sécurité sociale|contribu|documento|personal(?:nummer)?|versicherung|удостоверени|身分証|旅券)[^;\n]{0,28}$", re.I)
_PHONE_CUE = re.compile(r"(?:tel|phone|mobile|mob|fax|call|landline|reach|ring|telefon|téléphone|teléfono|telefone|телефон|handy|joindre|llamar|ligar|\b[tmpf]\b|電話)[^.;\n]{0,34}$", re.I)
_OTHER_CUE = re.compile(r"(?:order|case|invoice|ticket|part|parcel|version|reservation|meter|track|code|company|rechnung|dossier|facture|expediente|factura|processo|fatura|счёт|заказ|no\.|nr\.|n\.º|№|item|sku|ref\w*|room|units?|boxes)[^.;\n]{0,14}$", re.I)
_TOWN = rf"[{_UP}][{_LOW}'’-]+(?:[ -][{_UP}][{_LOW}'’-]+){{0,2}}"
_ADDRESSES = [
    ("en", re.compile(rf"\d(?<![\w.,/#].)\d{{0,4}}[A-Za-z]? (?:[{_UP}][\w'’]+(?:-[{_UP}][\w'’]+)*\.? ){{1,3}}(?:Street|St\.|St|Road|Rd\.|Rd|Lane|Ln|Drive|Dr|Court|Ct|Close|Avenue|Ave\.|Ave|Boulevard|Blvd|Way|Square|Sq|Place|Pl|Terrace|Crescent|Row|Hill|Park|Gardens|Mews|Walk)(?![\w])(?:,? (?:Apt|Apartment|Flat|Unit|Suite|Ste|Floor|No\.?|#)\.? ?[\w-]+)?(?:, {_TOWN}(?: \d{{4,6}}| [A-Z]{{1,2}}\d[\dA-Z]? \d[A-Z]{{2}})?|,? \d{{5}}(?: {_TOWN})?)?")),
    ("de", re.compile(rf"(?<!\w)(?:(?:[{_UP}][{_LOW}]+[ -])?[{_UP}][{_LOW}]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|hof|steig|stieg|graben|markt)|(?:[{_UP}][\w-]+ )?(?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ring|Damm|Ufer|Hof|Markt)|(?:Am|An der|An den|Auf der|Auf dem|Im|In der|In den|Zum|Zur|Unter den|Hinter der|Vor dem) [{_UP}][{_LOW}]+) \d{{1,4}} ?[a-z]?(?![\w])(?:, (?:[A-Z]-)?\d{{4,5}} {_TOWN})?")),
    ("fr", re.compile(rf"(?<![\w.,/])\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:rue|avenue|av\.|chemin|boulevard|bd|place|impasse|allée|quai|route|square|cours|passage|sentier|villa)\b (?:(?:de|du|des|la|le|les|l['’]|d['’]|de l['’]) ?)*(?:[{_UP}l][\w'’-]*)(?:[ -](?:de|du|des|la|le|les|l['’]|d['’])? ?[{_UP}][\w'’-]+){{0,4}}(?:, \d{{5}} {_TOWN})?", re.I)),
    ("es", re.compile(rf"(?<!\w)(?:Calle|C/|C\.|Avda\.|Avda|Av\.|Avenida|Plaza|Pza\.|Paseo|Camino|Ronda|Carrer|Travesía|Cuesta|Glorieta) ?(?:(?:de|del|la|las|los|el) )*[{_UP}][\w'’-]+(?: (?:(?:de|del|la|las|los|el|y) )*[{_UP}][\w'’-]+){{0,3}},? \d{{1,4}}[A-Za-z]?(?![\w])(?:, ?\d{{1,2}} ?[ºª°o](?: ?[A-Z]\b| ?(?:izq|dcha)\.?)?)?(?:, \d{{5}} {_TOWN})?")),
    ("pt", re.compile(rf"(?<!\w)(?:Rua|R\.|Av\.|Avenida|Travessa|Tv\.|Largo|Praça|Estrada|Alameda|Beco|Calçada|Rotunda) (?:(?:de|do|da|dos|das|o|a) )*[{_UP}][\w'’-]+(?: (?:(?:de|do|da|dos|das|e) )*[{_UP}][\w'’-]+){{0,3}},? (?:n\.? ?[ºo°]\.? ?)?\d{{1,4}}[A-Za-z]?(?![\w])(?:, ?\d{{1,2}}\.?[ºª°o](?: ?(?:Esq|Dto|Fte|[A-Z])\.?)?)?(?:, \d{{4}}-\d{{3}} {_TOWN})?")),
    ("ru", re.compile(rf"(?<!\w)(?:(?:ул\.|улица|проспект|пр-т|просп\.|пер\.|переулок|бульвар|б-р|наб\.|набережная|шоссе|площадь|пл\.|проезд|аллея) ?[А-ЯЁ][\w-]+(?: [А-ЯЁ][\w-]+){{0,2}}|[А-ЯЁ][\w-]+(?: [А-ЯЁ]?[\w-]+)? (?:ул\.|улица|проспект|пр-т|просп\.|пер\.|переулок|бульвар|б-р|наб\.|набережная|шоссе|площадь|пл\.|проезд)),? ?(?:дом |д\. ?)?\d{{1,4}}[а-я]?(?![\w])(?:, ?(?:корп\.|к\.|стр\.) ?\d+)?(?:, ?(?:кв\.|квартира|оф\.) ?\d+)?(?:, (?:\d{{6}},? )?(?:г\. ?)?[А-ЯЁ][а-яё-]+)?")),
    ("ja", re.compile(r"(?:〒?\d{3}-\d{4} ?)?[一-鿿]{2,4}[都道府県][一-鿿]{1,6}[市区町村郡][一-鿿ぁ-んァ-ヶ0-9０-９丁目番地号-]{1,20}\d")),
]
#: What a text must hold for an address of each form to be in it. The French form takes small and capital
#: letters alike: its words are looked for in the lower-cased text (``_french_possible``).
_STREET_WORDS = [
    (" Street", " St", " Road", " Rd", " Lane", " Ln", " Drive", " Dr", " Court", " Ct", " Close", " Avenue", " Ave", " Boulevard", " Blvd", " Way", " Square", " Sq", " Place", " Pl", " Terrace", " Crescent", " Row", " Hill", " Park", " Gardens", " Mews", " Walk"),
    ("traße ", "trasse ", "tr. ", "weg ", "Weg ", "asse ", "latz ", "llee ", "ing ", "amm ", "fer ", "hof ", "Hof ", "steig ", "stieg ", "graben ", "arkt ", "Am ", "An der ", "An den ", "Auf der ", "Auf dem ", "Im ", "In der ", "In den ", "Zum ", "Zur ", "Unter den ", "Hinter der ", "Vor dem "),
    (),
    ("Calle", "C/", "C. ", "Avda", "Av. ", "Avenida", "Plaza", "Pza", "Paseo", "Camino", "Ronda", "Carrer", "Travesía", "Cuesta", "Glorieta"),
    ("Rua ", "R. ", "Av. ", "Avenida", "Travessa", "Tv. ", "Largo ", "Praça", "Estrada", "Alameda", "Beco", "Calçada", "Rotunda"),
    ("ул.", "улица", "проспект", "пр-т", "просп", "пер.", "переулок", "бульвар", "б-р", "наб", "шоссе", "площадь", "пл.", "проезд", "аллея"),
    tuple("都道府県"),
]
_GERMAN_ENDS = frozenset(_STREET_WORDS[1][: _STREET_WORDS[1].index("Am ")])
_FRENCH = 2
_FRENCH_WORDS = tuple(f" {w} " for w in "rue avenue chemin boulevard bd place impasse allée quai route square cours passage sentier villa".split())


@functools.lru_cache(maxsize=1)
def _street_automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    forms: dict[str, int] = {}
    for k, words in enumerate(_STREET_WORDS):
        for w in words:
            forms[w] = forms.get(w, 0) | 1 << k
    for w, bits in forms.items():
        # 1: German words that end a street's name stand before its number; 2: English ones are whole words
        a.add_word(w, (bits, 1 if bits == 2 and w in _GERMAN_ENDS else 2 if bits == 1 else 0))
    a.make_automaton()
    return a


@functools.lru_cache(maxsize=1)
def _french_automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in _FRENCH_WORDS:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


def _french_possible(text: str, low: str) -> bool:
    """Whether a French street word stands after a number, its comma, or the end of bis, ter or quater."""
    if not text.isascii() and any(c in text for c in "ſıİ"):
        return True  # letters that the pattern takes for s and i, and lower() does not
    for at, size in _french_automaton().iter(low):
        if at >= size and ((c := low[at - size]) in ",sr" or c.isdecimal()):
            return True
    return False


def _address_forms(text: str, low: str) -> int:
    """Bits of the forms an address in the text, lower-cased in low, can have."""
    out = 1 << _FRENCH if _french_possible(text, low) else 0
    for at, (bits, then) in _street_automaton().iter(text):
        if not then:
            out |= bits
            continue
        following = text[at + 1 : at + 2]
        if following.isdigit() if then == 1 else not (following.isalnum() or following == "_"):
            out |= bits
    return out


#: Capitalised words joined by spaces; what greetings and titles name.
_RUN = re.compile(rf"[{_UP}](?<![\w@.#/'’-].){_SURNAME.removeprefix(f'[{_UP}]')}(?: (?:{_PARTICLE} )?(?:[{_UP}]\. )?{_SURNAME})+(?![\w@])")
_MORE_NAME, _NEXT_WORD, _NEXT_LETTERS = re.compile(r" (?:of|&|and)? ?[A-ZÀ-Þ]\w+"), re.compile(r" (?:& )?(\w+)"), re.compile(r" ([^\W\d_]+)")
_DATE_OR_SUM = re.compile(r"\d{1,2}\.\d{1,2}\.\d{4}.*|(?:19|20)\d\d-\d\d-\d\d(?!\d).*|\d+\.\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{4}/\d+")
_GREETED = re.compile(rf"(?m)^[ \t>|]*(?:Hi|Hello|Dear|Hey|Good (?:morning|day|afternoon|evening)|Hallo|Lieber?|Cher|Chère|Bonjour|Hola|Estimad[oa]|Querid[oa]|Bom dia|Olá|Car[oa]|Prezad[oa]|Здравствуйте,|Привет,|Уважаем(?:ый|ая)) ({_SURNAME})(?=[,:!]| [-–]|\s*$)")
_DIGIT = re.compile(r"\d")
#: The least that a telephone or identity number is: six figures with at most two signs between neighbours.
_DIGITS = re.compile(r"\d(?:[ ().\/+-]{0,3}\d){5,}")
KINDS = ("person", "email", "phone", "id_number", "address")


# ---------------------------------------------------------------- text with places


def _aligned(line: str, fixed: str) -> list[int]:
    """For each character of a repaired line its place in the line: by words where those correspond, else by difference."""
    old, new = re.split(r"(\s)", line), re.split(r"(\s)", fixed)
    places: list[int] = []
    if len(old) == len(new):
        at = 0
        for x, y in zip(old, new, strict=True):
            if len(x) == len(y):
                places.extend(range(at, at + len(y)))
            else:
                head = next((k for k, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))
                tail = len(x) - len(y)
                places.extend(at + k if k < head else min(at + len(x) - 1, max(at + head, at + k + tail)) if k > head else at + k for k in range(len(y)))
            at += len(x)
    else:
        places = [0] * len(fixed)
        for tag, a, b, x, y in difflib.SequenceMatcher(None, line, fixed, autojunk=False).get_opcodes():
            for k in range(x, y):
                places[k] = a + (k - x) if tag == "equal" else a if k == x else min(b, a + k - x)
    places.append(len(line))
    return places


def plain_line(line: str) -> tuple[str, list[int] | None]:
    """A line in usual characters, and for each of them its place in the line (None: the same places)."""
    if line.isascii():
        return line, None
    damaged, fixed = repair(line)
    if damaged and fixed != line:
        places = _aligned(line, fixed)
        inner, more = _usual(fixed)
        return (fixed, places) if more is None else (inner, [places[p] for p in more])
    return _usual(line)


def _usual(line: str) -> tuple[str, list[int] | None]:
    if not _ANY_RE.search(line) or not is_case(line):
        return line, None
    out: list[str] = []
    places: list[int] = []
    for k, c in enumerate(line):
        if c.isascii():
            out.append(c)
            places.append(k)
            continue
        if _INVISIBLE_RE.match(c) and _hidden(line, k):
            continue
        if unicodedata.combining(c) and out:
            joined = unicodedata.normalize("NFC", out[-1] + c)
            if len(joined) == 1:
                out[-1] = joined
                continue
        for x in unicodedata.normalize("NFKC", c) if not (c in "ªº²³¹¼½¾…™№°´¨¸µ" or "、" <= c <= "〟" or "！" <= c <= "／") else c:
            out.append(" " if x.isspace() else x)
            places.append(k)
    places.append(len(line))
    return _WORD_RE.sub(_one_alphabet, "".join(out)), places


@dataclass(slots=True)
class Node:
    """A candidate: kind, place, key under which equal ones agree, features, evidence and answer."""

    kind: str
    line: int
    start: int
    end: int
    key: str
    features: list[str]
    piece: str = ""
    surname: str = ""
    score: float = 0.0
    belief: float = 0.0


class Words(Set):
    """A set of words in one sorted string of bytes, for many of them."""

    def __init__(self, words: Iterable[str]):
        coded = sorted({w.encode() for w in words})
        self._bytes = b"".join(coded)
        self._ends = np.cumsum([0, *map(len, coded)], dtype=np.int64)
        self._memo: dict[object, bool] = {}

    def __len__(self) -> int:
        return len(self._ends) - 1

    def __iter__(self) -> Iterator[str]:
        return (self._bytes[a:b].decode() for a, b in pairwise(self._ends.tolist()))

    def __contains__(self, word: object) -> bool:
        got = self._memo.get(word)
        if got is None:
            if len(self._memo) >= 100_000:
                self._memo.clear()
            got = self._memo[word] = self._has(word)
        return got

    def _has(self, word: object) -> bool:
        if not isinstance(word, str):
            return False
        coded = word.encode()
        at = bisect_left(range(len(self)), coded, key=self._at)
        return at < len(self) and self._at(at) == coded

    def _at(self, k: int) -> bytes:
        return self._bytes[self._ends[k] : self._ends[k + 1]]

    def __hash__(self) -> int:
        return self._hash()


def _held(words: pa.ChunkedArray, less: frozenset[str] = frozenset()) -> Set[str]:
    """Words less some others, as a set or packed."""
    each = (w for chunk in words.iterchunks() for w in chunk.to_pylist() if w not in less)
    return frozenset(each) if len(words) <= MOST_OTHERS else Words(each)


@dataclass(frozen=True)
class Lexicon:
    """Given names, words that follow them in capitalised runs, and words that open or close such runs and are no names."""

    given: frozenset[str] = frozenset()
    others: Set[str] = frozenset()
    surnames: Set[str] = frozenset()
    memo: dict[str, tuple[int, int] | None] = field(default_factory=dict, compare=False, repr=False)  # of name_in_run()


    def name_in_run(self, run: str) -> tuple[int, int] | None:
        """Where in a capitalised run a name of unknown words can begin, and the length of its first word; None if nowhere."""
        got = self.memo.get(run, ())
        if got == ():
            if len(self.memo) >= 100_000:
                self.memo.clear()
            got = self.memo[run] = self._name_in_run(run)
        return got

    def _name_in_run(self, run: str) -> tuple[int, int] | None:
        parts = run.split(" ")
        begin = 0
        while parts and (parts[0] in self.others or parts[0] in _NO_SURNAME):
            begin += len(parts[0]) + 1
            parts = parts[1:]
        if not 2 <= len(parts) <= 4 or parts[0].isupper() or any(p in self.others or p in _NO_SURNAME or p.lower() in _TRADES for p in parts[1:]):
            return None
        return begin, len(parts[0])


@dataclass
class Model:
    """Word statistics, weights by feature, coupling by kind of edge."""

    words: Lexicon = field(default_factory=Lexicon)
    weights: dict[str, float] = field(default_factory=dict)
    edges: dict[str, float] = field(default_factory=lambda: dict.fromkeys(EDGES, 0.0))

    @property
    def given(self) -> frozenset[str]:
        return self.words.given


def _surname_features(surname_known: bool, given_known: bool) -> list[str]:
    """A surname that nobody else bears speaks against a name only where the given name is unknown too."""
    return ["p:surname_known"] if surname_known else [] if given_known else ["p:surname_new"]


def _person(line: str, number: int, start: int, end: int, word: str, earlier: str, alone: bool, words: Lexicon, known: bool = True) -> Node:
    left, right = line[:start], line[end:]
    f = ["p:bias", "p:known" if known else "p:unknown"]
    if word in _AMBIGUOUS:
        f.append("p:ambiguous")
    trade = lambda w: w.lower() in _TRADES or (w in words.others and w not in words.given)
    a, b = start, end
    m = _AFTER.match(right)
    if m and m[1] not in _NO_SURNAME and not trade(m[1]) and not (m[1].isupper() and not word.isupper() and len(m[1]) > 1):
        b = end + m.end()
        f += ["p:surname", *_surname_features(m[1] in words.surnames, known)]
        if _MORE_NAME.match(line, b) and (t := _NEXT_WORD.match(line, b)) and trade(t[1]):
            f.append("p:trade_after")
    else:
        if i := _INITIAL.match(right):
            b = end + i.end()
            f.append("p:initial")
        m = None
        if (s := _BEFORE.search(left)) and s[2] not in _NO_SURNAME and not trade(s[2]) and s[2] not in words.given and s[2][0].isupper() and (not s[2].isupper() or word.isupper()):
            before = left[: s.start(1)]
            if not _GREETING.search(left) and (not re.search(r"\b(?:in|at|near|from) $", before) or _HEADER.search(before)):
                a = s.start(1)
                f += ["p:surname_first", *_surname_features(s[2] in words.surnames, known)]
    left, right = line[:a], line[b:]
    bare = left.strip(" >|\t*-–—\"'“(")
    near = left[-24:].rstrip(" ,\t").rsplit(None, 1)
    if near and near[-1].lower().strip(">|*.\"'(") in _GREETING_ENDS and _GREETING.search(left):
        f.append("p:greeting")
    after_space = left[-1:].isspace()  # as titles and lead words must be
    if after_space and _TITLE.search(left):
        f.append("p:title")
    if left.rstrip(' \t"')[-1:] == ":" and _HEADER.search(left):
        f.append("p:header")
    elif after_space and _LEAD.search(left):
        f.append("p:lead")
    if _TAIL.match(right):
        f.append("p:tail")
    if not bare and not right.strip(" ,.!:;-–—\t\r"):
        f.append("p:whole_line")
    elif not bare:
        f.append("p:line_start")
    if alone and known:
        f.append("p:name_field")
    if b == end and a == start:
        f.append("p:single")
        if not bare and word in _MONTHS and earlier and _DAY_BEFORE.search(earlier.rstrip() + " "):
            f.append("p:date")
        if (after_space and _DAY_BEFORE.search(left)) or (_DAY_AFTER.match(right) and word in ("May", "April", "June", "August")):
            f.append("p:date")
        n = _NEXT_LETTERS.match(right)
        if n and n[1][0].islower():
            f.append("p:lower_after")
        elif n:
            f.append("p:upper_after")
        if right[:1] in ("@", ".") and right[1:2].isalnum():
            f.append("p:inside_address")
    if (left[-1:] and left[-1] in "@.-+/_" and (left[-2:-1].isalnum() or left[-2:-1] == "_")) or (right[:1] and right[0] in "-+_/@." and (right[0] == "@" or right[1:2].isalnum() or right[1:2] == "_")):
        f.append("p:inside_address")
    surname = m[1] if m else s[2] if "p:surname_first" in f else ""
    if "p:date" in f:  # whatever else is true of a month beside a figure
        f = [x for x in f if x in ("p:bias", "p:known", "p:unknown", "p:ambiguous", "p:greeting", "p:header", "p:date")]
    # a month beside a figure is not linked with the people of that name
    return Node("person", number, a, b, ("d:" if "p:date" in f else "p:") + word.lower(), f, surname=surname.lower())


def _left(text: str, at: int, most: int = 60) -> str:
    """What stands before a place on its line; with the end of the line above where that is little."""
    begin = text.rfind("\n", 0, at) + 1
    left = text[max(begin, at - most) : at]
    if begin and len(left.strip(" >|\t")) < 25 and at - begin < 25 + len(left):
        above = text[text.rfind("\n", 0, begin - 1) + 1 : begin - 1]
        left = above.strip()[-50:] + " " + left.lstrip(" >|\t")
    return left


@functools.lru_cache(maxsize=2)
def _name_automaton(given: frozenset[str]) -> ahocorasick.Automaton:
    """All given names, as they are and in capitals."""
    a = ahocorasick.Automaton()
    for name in given:
        a.add_word(name, name)
        if len(name) > 2:
            a.add_word(name.upper(), name.upper())
    a.make_automaton()
    return a


def _addresses(text: str) -> Iterator[re.Match]:
    """What _EMAIL finds, looked for around each @ only."""
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and (text[begin - 1].isalnum() or text[begin - 1] in "_.+%'-"):
            begin -= 1
        m = _EMAIL.search(text, begin, text.find("\n", at) if "\n" in text[at : at + 400] else len(text)) if begin < at else None
        if m and m.start() < at < m.end():
            yield m
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _segment(text: str, model: Model, alone: bool) -> list[Node]:
    """The candidates of a text in usual characters; places count from its beginning, line is not yet set."""
    mine: list[Node] = []
    starts: list[int] = []  # of the places that are taken, and their ends, in order
    ends: list[int] = []

    def free(a: int, b: int) -> bool:
        k = bisect_right(starts, a)
        return not (k and ends[k - 1] > a) and not (k < len(starts) and starts[k] < b)

    def take(a: int, b: int) -> None:
        k = bisect_right(starts, a)
        starts.insert(k, a)
        ends.insert(k, b)

    for m in _addresses(text):
        mine.append(Node("email", 0, m.start(), m.end(), "e:" + m[0].lower(), ["e:bias", "e:form"]))
        take(*m.span())
    low = text.lower()
    if "dot" in low or " AT " in text or "(at" in low or "[at" in low or "{at" in low or " @ " in text:
        for m in _SPELT.finditer(text):
            if free(*m.span()):
                mine.append(Node("email", 0, m.start(), m.end(), "e:" + m[0].lower(), ["e:bias", "e:spelt"]))
                take(*m.span())
    if _DIGIT.search(text):
        possible = _address_forms(text, low)
        for k, (form, pattern) in enumerate(_ADDRESSES):
            if not possible >> k & 1:
                continue
            for m in pattern.finditer(text):
                end = m.start() + len(m[0].rstrip(" ,"))
                if free(m.start(), end):
                    mine.append(Node("address", 0, m.start(), end, "a:" + m[0].lower(), ["a:bias", "a:" + form]))
                    take(m.start(), end)
    for run in _DIGITS.finditer(text):
        begin, stop = max(0, run.start() - 4), run.end() + 4
        for m in _IDENTITY.finditer(text, begin, stop):
            if not free(*m.span()):
                continue
            left = _left(text, m.start())
            f = ["i:bias", "i:shape:" + re.sub(r"\d+", lambda d: str(len(d[0])), re.sub("[A-Z]", "A", m[0]))]
            if _ID_CUE.search(left):
                f.append("i:cue")
            else:
                if _OTHER_CUE.search(left):
                    f.append("i:other_cue")
                if _PHONE_CUE.search(left):
                    f.append("i:phone_cue")
            mine.append(Node("id_number", 0, m.start(), m.end(), "i:" + m[0], f))
            take(*m.span())
        for m in _NUMBER.finditer(text, begin, stop):
            if m.end() - m.start() < 8 or not 8 <= sum(c.isdigit() for c in m[0]) <= 15 or not free(*m.span()):
                continue
            if _DATE_OR_SUM.fullmatch(m[0]):
                continue
            form = next((n for n, p in _PHONE_FORMS if p.fullmatch(m[0])), None)
            left = _left(text, m.start())
            f = ["t:bias", f"t:form:{form}"]
            if _PHONE_CUE.search(left):
                f.append("t:cue")
            elif _OTHER_CUE.search(left):
                f.append("t:other_cue")
            if not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip(" >|\t") and text[m.end() : m.end() + 1] in ("", "\n", "\r"):
                f.append("t:whole_line")
            mine.append(Node("phone", 0, m.start(), m.end(), "t:" + re.sub(r"\D", "", m[0]), f))
            take(*m.span())

    def add(start: int, end: int, word: str, known: bool, whole: int = 0) -> int:
        begin = text.rfind("\n", 0, start) + 1
        stop = text.find("\n", end)
        line = text[begin : stop if stop >= 0 else len(text)]
        earlier = text[text.rfind("\n", 0, begin - 1) + 1 : begin - 1] if begin else ""
        node = _person(line, 0, start - begin, end - begin, word, earlier, alone, model.words, known)
        node.start += begin
        node.end = max(node.end + begin, whole)
        if not free(node.start, node.end) or (known and node.start < last):
            node.start, node.end = start, end
        mine.append(node)
        take(node.start, node.end)
        return node.end

    last = -1
    n = len(text)
    for at, name in _name_automaton(model.given).iter(text) if model.given else ():
        end, start = at + 1, at + 1 - len(name)
        # a whole word: no letter, figure or joined part on either side
        if (end < n and (text[end].isalnum() or (text[end] in "'’" and text[end + 1 : end + 2].isalpha() and not text[end + 1 : end + 3].lower() in ("s", "s ")))) or (start and (text[start - 1].isalnum() or text[start - 1] in "'’")):
            continue
        word = name if name in model.given else name.title()
        if start < last or not free(start, end):
            continue
        last = add(start, end, word, True)
    # runs without a known name, less the words at their beginning that are known to be something else
    for m in _RUN.finditer(text):
        at = model.words.name_in_run(m[0])
        if at is None:
            continue
        start, end = m.start() + at[0], m.end()
        if free(start, end):
            add(start, start + at[1], m[0][at[0] : at[0] + at[1]], False, end)
    for m in _GREETED.finditer(text):
        if m[1] not in model.words.others and m[1] not in _NO_SURNAME and free(*m.span(1)):
            add(*m.span(1), m[1], False)
    keys = {n.key for n in mine if n.kind == "person" and "p:unknown" in n.features}
    if keys:  # single words that stand elsewhere in the text as a possible name
        for m in _TOKEN.finditer(text):
            if "p:" + m[0].lower() in keys and free(*m.span()):
                add(*m.span(), m[0], False)
    mine.sort(key=lambda n: n.start)
    return mine


def candidates(text: str, model: Model, alone: bool = False) -> tuple[list[Node], list[str]]:
    """All candidate nodes of a text in order, and its lines."""
    lines = text.split("\n")
    nodes: list[Node] = []
    if text.isascii() or not (is_suspicious(text) or is_case(text)):
        starts = [0]
        for x in lines:
            starts.append(starts[-1] + len(x) + 1)
        for n in _segment(text, model, alone):
            n.line = bisect_right(starts, n.start) - 1
            n.start -= starts[n.line]
            n.end -= starts[n.line]
            n.piece = lines[n.line][n.start : n.end]
            nodes.append(n)
        return nodes, lines
    # Unusual characters: the lines are put in usual ones and joined, and places are traced back line by line.
    plains, traced, starts = [], [], [0]
    for line in lines:
        plain, places = plain_line(line)
        plains.append(plain)
        traced.append(places)
        starts.append(starts[-1] + len(plain) + 1)
    for n in _segment("\n".join(plains), model, alone):
        n.line = bisect_right(starts, n.start) - 1
        line, places = lines[n.line], traced[n.line]
        a, b = n.start - starts[n.line], n.end - starts[n.line]
        if places is not None:
            a, z = places[a], places[b - 1] + 1
            if b < len(places) and places[b] > z and all(unicodedata.combining(c) for c in line[z : places[b]]):
                z = places[b]
            b = z
        n.start, n.end, n.piece = a, b, line[a:b]
        nodes.append(n)
    return nodes, lines


def _weak_label(n: Node) -> bool | None:
    """What the context alone makes certain; None where it does not."""
    f = set(n.features)
    if n.kind == "person":
        if "p:inside_address" in f or "p:date" in f or "p:trade_after" in f:
            return False
        if "p:unknown" in f:
            return False if "p:other_word" in f else True if "p:header" in f or "p:greeting" in f else None
        if f & {"p:header", "p:greeting", "p:title"} or "p:whole_line" in f:
            return True
        if "p:surname" in f and ("p:tail" in f or "p:lead" in f):
            return True
        if "p:single" in f and "p:ambiguous" in f and "p:lower_after" in f and "p:line_start" in f:
            return False
    elif n.kind == "phone":
        if ("t:cue" in f or "t:whole_line" in f) and "t:form:None" not in f:
            return True
        if "t:other_cue" in f or ("t:form:None" in f and "t:cue" not in f):
            return False
    elif n.kind in ("email", "address"):
        return True
    elif n.kind == "id_number":
        if "i:cue" in f:
            return True
        if "i:other_cue" in f or "i:phone_cue" in f:
            return False
    return None


#: A line's beginning, quote marks and white space, in a text put after a line end. Not over more line ends, or runs of empty
#: lines take time by their square.
_MARGIN = r"\n(?:[^\S\n]|[>|])*"
_SHOWN = rf"([{_UP}][{_LOW}]+)(?: [{_UP}]\.)?(?: {_PARTICLE})? {_SURNAME}"
_BEFORE_MAIL = r"(?=\s*(?:<|\[|wrote|a écrit|escribi|escreveu|schrieb|написал|$))"
#: Each begins with a character that is searched for quickly.
_NAMED = [
    re.compile(rf"(?m){_MARGIN}(?:(?:\*?(?:From|To|Von|An|De|Para|От|Кому):\s*|\* |(?:Le|El)\s[^,\n]{{4,25}}, ){_SHOWN}{_BEFORE_MAIL}|{_SHOWN} wrote on )"),
    re.compile(rf"(?m):\d\d(?:\s[AP]M)?,? {_SHOWN}{_BEFORE_MAIL}"),
    re.compile(rf"(?m)schrieb {_SHOWN}{_BEFORE_MAIL}"),
    re.compile(rf"(?m)пользователь {_SHOWN}{_BEFORE_MAIL}"),
]
_ADDRESSED = re.compile(rf"(?m){_MARGIN}(?:Hi|Hello|Dear|Good morning|Hallo|Cher|Chère|Hola|Estimad[oa]|Bom dia|Здравствуйте,)\s([{_UP}][{_LOW}]+)(?:[,:!]| -)\s*$")


def names_shown(text: str) -> set[str]:
    """Given names that the text's headers, introductions of quotes and greetings show."""
    text = "\n" + text
    found = {m[m.lastindex] for pattern in (_ADDRESSED, *_NAMED) for m in pattern.finditer(text)}
    return {w for w in found if w not in _NO_SURNAME and w.lower() not in _TRADES}


def runs_in(text: str) -> Iterator[tuple[str, str]]:
    """First and last word of every capitalised run of two words or more."""
    for run in _RUN.findall(text):
        yield run[: run.index(" ")], run[run.rindex(" ") + 1 :]


def _written(given: set[str]) -> frozenset[str]:
    """Given names, and how they are written without accents."""
    latin = {n for n in given if not n.isascii() and not "А" <= n[0] <= "я"}
    bare = {"".join(c for c in unicodedata.normalize("NFD", n) if not unicodedata.combining(c)) for n in latin}
    return frozenset(given | bare | {n.translate({0xE4: "ae", 0xF6: "oe", 0xFC: "ue"}) for n in latin})


def lexicon_of(docs: DataFrame, text: str) -> Lexicon:
    """The word statistics of docs, counted over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[tuple[str, str | None]] = Counter()
            for t in batch.column("text").to_pylist():
                seen.update((w, None) for w in names_shown(t))
                seen.update(runs_in(t))
            first, last = zip(*seen, strict=True) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.string()), pa.array(last, pa.string()), pa.array(list(seen.values()), pa.int64())], names=["first", "last", "n"])

    path = shared_path(docs.sparkSession, "pii")
    found = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInArrow(run, "first string, last string, n bigint")
    found.groupBy("first", "last").agg(F.sum("n").alias("n")).write.parquet(path)
    found = docs.sparkSession.read.parquet(path)
    shown = found.where("last is null").where(F.col("n") >= LEXICON_TEXTS).select("first")
    given = {r[0] for r in shown.limit(MOST_NAMES + 1).collect()}
    if len(given) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} given names in the texts")
    runs = found.where("last is not null").join(F.broadcast(shown.withColumn("named", F.lit(1))), "first", "left").withColumn("named", F.coalesce("named", F.lit(0)))
    ends = runs.select(F.col("last").alias("word"), "n", "named").unionByName(runs.where("named = 0").select(F.col("first").alias("word"), "n", "named"))
    counts = ends.groupBy("word").agg(F.sum(F.when(F.col("named") == 0, F.col("n")).otherwise(0)).alias("other"), F.sum(F.col("n") * F.col("named")).alias("surname"))
    other = (F.col("other") >= LEAST_OTHER) & (F.col("other") >= 4 * F.col("surname"))
    surname = (F.col("surname") >= LEXICON_TEXTS) & (F.col("other") < 4 * F.col("surname"))
    kept = counts.where(other | surname).select("word", other.alias("other")).toArrow()
    names = _written(given)
    is_other = kept.column("other")
    return Lexicon(names, _held(kept.column("word").filter(is_other), names), _held(kept.column("word").filter(pc.invert(is_other))))


def lexicon_of_texts(texts: list[str]) -> Lexicon:
    """The same of a list of texts, for small collections without a cluster."""
    shown: Counter[str] = Counter()
    runs: Counter[tuple[str, str]] = Counter()
    for t in texts:
        shown.update(names_shown(t))
        runs.update(runs_in(t))
    given = _written({w for w, n in shown.items() if n >= LEXICON_TEXTS})
    other: Counter[str] = Counter()
    surname: Counter[str] = Counter()
    for (first, last), n in runs.items():
        (surname if first in given else other)[last] += n
        if first not in given:
            other[first] += n
    others = frozenset(w for w, n in other.items() if n >= LEAST_OTHER and n >= 4 * surname[w])
    return Lexicon(given, others - given, frozenset(w for w, n in surname.items() if n >= LEXICON_TEXTS and other[w] < 4 * n))


def edges_of(nodes: list[Node]) -> list[tuple[int, int, int]]:
    """(node, node, kind of edge): neighbours on a line; each node and the one before it that is equal; those of names that
    differ by a slip or share the surname. Their number is in proportion to the nodes, whatever the text's length."""
    edges: list[tuple[int, int, int]] = []
    if len(nodes) < 2:
        return edges
    last: dict[str, int] = {}
    rough: dict[str, int] = {}
    for k, n in enumerate(nodes):
        if k and nodes[k - 1].line == n.line:
            edges.append((k - 1, k, 0 if nodes[k - 1].kind == n.kind else 1))
        before = last.get(n.key)
        if before is not None:
            edges.append((before, k, 2))
        last[n.key] = k
        if n.kind == "person":
            name = n.key[2:]
            # names that differ by one letter left out, doubled or exchanged for another are equal with one place left out
            forms = [name[:j] + name[j + 1 :] for j in range(1, len(name))] + [name] if 5 <= len(name) <= 24 else []
            if n.surname:
                forms.append("/" + n.surname)
            near = {rough[x] for x in forms if x in rough}
            edges.extend((j, k, 3) for j in near if nodes[j].key != n.key)
            for x in forms:
                rough[x] = k
    return edges


def potentials(nodes: list[Node], weights: dict[str, float]) -> None:
    get = weights.get
    for n in nodes:
        n.score = n.belief = sum(get(x, 0.0) for x in n.features)


def send(score: np.ndarray, edges: np.ndarray, strength: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Beliefs (log-odds) after loopy sum-product messages over edges (two columns of node numbers).

    For an agreement potential J the message of a node with odds h is 2·atanh(tanh(J/2)·tanh(h/2)). All are sent at once,
    each halfway to its new value, so that loops settle.
    """
    if not len(edges):
        return score.copy()
    a, b = edges[:, 0], edges[:, 1]
    t = np.tanh(strength / 2)
    to_b, to_a = np.zeros(len(a)), np.zeros(len(a))
    belief = score.copy()
    for _ in range(rounds):
        new_b = 2 * np.arctanh(t * np.tanh(np.clip(belief[a] - to_a, -20, 20) / 2))
        new_a = 2 * np.arctanh(t * np.tanh(np.clip(belief[b] - to_b, -20, 20) / 2))
        change = max(float(np.abs(new_b - to_b).max()), float(np.abs(new_a - to_a).max()))
        to_b, to_a = (to_b + new_b) / 2, (to_a + new_a) / 2
        belief = score + np.bincount(b, to_b, len(score)) + np.bincount(a, to_a, len(score))
        if change < 0.01:
            break
    return belief


def infer(texts: list[list[Node]], model: Model) -> int:
    """Sets the beliefs of the nodes of many texts at once; how many labels the messages changed."""
    nodes, edges, kinds = [], [], []
    for own in texts:
        for a, b, kind in edges_of(own):
            edges.append((a + len(nodes), b + len(nodes)))
            kinds.append(kind)
        nodes += own
    if not nodes:
        return 0
    potentials(nodes, model.weights)
    score = np.array([n.score for n in nodes])
    strength = np.array([model.edges[e] for e in EDGES])[np.array(kinds, int)]
    belief = send(score, np.array(edges, int).reshape(-1, 2), strength)
    for n, b in zip(nodes, belief.tolist(), strict=True):
        n.belief = b
    return int(((score > 0) != (belief > 0)).sum())


#: Means of the prior: what form says in a collection without an example. All other potentials are 0 before training.
PRIOR = {
    "e:bias": 3.0, "a:bias": 3.0, "t:bias": 2.0, "t:form:None": -4.0, "t:other_cue": -3.0, "i:bias": 1.0, "i:cue": 2.0, "i:other_cue": -4.0, "i:phone_cue": -3.0,
    "p:known": 1.0, "p:surname": 1.0, "p:surname_first": 2.0, "p:name_field": 2.0, "p:greeting": 2.0, "p:header": 2.0, "p:inside_address": -6.0, "p:date": -5.0, "p:trade_after": -3.0,
}


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, mean: np.ndarray, prior: float, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression of weighted rows by Newton's method, with a normal prior of that mean and precision."""
    w = mean.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + prior * np.eye(len(w)), x.T @ (weight * (y - p)) - prior * (w - mean))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _masked(key: str, share: float) -> bool:
    return zlib.crc32(key.encode()) < share * 2**32


def fit(texts: list[str], words: Lexicon | None = None, rounds: int = 3, prior: float = 0.3) -> Model:
    """Potentials by pseudo-likelihood from texts that label themselves; the order of the texts does not matter.

    The likelihood of each labelled node given its neighbours' labels is a logistic function of its features and, for every
    kind of edge, of the sum of its neighbours' labels (1 and -1), whose weight is the coupling. Labels of neighbours that
    do not label themselves are those of the round before. Couplings are not negative: edges make labels agree.
    """
    texts = sorted(t for t in texts if t)
    words = lexicon_of_texts(texts) if words is None else words
    model = Model(words, dict(PRIOR))
    bare = Model(Lexicon(words.given, frozenset(), words.surnames))
    found = []
    for t in texts:
        nodes = candidates(t, bare)[0]
        for n in nodes:
            if n.kind != "person":
                continue
            if "p:unknown" in n.features and (any(w in words.others for w in n.piece.split()) or n.piece.split()[0] in _NO_SURNAME):
                n.features.append("p:other_word")
        found.append(nodes)
    nodes = [n for own in found for n in own]
    labels = [_weak_label(n) for n in nodes]
    kept = []
    for at, n in enumerate(nodes):
        f = [x for x in n.features if x != "p:other_word"]
        if "p:surname_known" in f and _masked(f"{n.surname}|{at}", HIDDEN):
            f.remove("p:surname_known")
            f += _surname_features(False, "p:known" in f)
        if "p:known" in f and _masked(f"{n.key}|{at}", HIDDEN):
            f[f.index("p:known")] = "p:unknown"
            if n.surname and "p:surname_known" not in f:
                f += _surname_features(False, False)
        kept.append(f)
    names = sorted({x for f in kept for x in f})
    column = {x: k for k, x in enumerate(names)}
    edges, at = [], 0
    for own in found:
        edges += [(a + at, b + at, kind) for a, b, kind in edges_of(own)]
        at += len(own)
    x = np.zeros((len(nodes), len(names) + len(EDGES)))
    for k, f in enumerate(kept):
        x[k, [column[z] for z in f]] = 1.0
    known = np.array([y is not None for y in labels], bool)
    y = np.array([bool(v) for v in labels], float)
    if not known.any():
        return model
    # Runs of words that are known to be something else stand for runs of unknown words that are; how many of those there are
    # is not known, so they weigh together as much as the names whose words are hidden.
    other = np.array(["p:other_word" in n.features for n in nodes])
    names_hidden = np.array(["p:unknown" in f and n.kind == "person" for f, n in zip(kept, nodes, strict=True)]) & (y > 0)
    weight = np.where(other, min(1.0, max(1, names_hidden.sum()) / max(1, (other & known).sum())), 1.0)
    mean = np.array([PRIOR.get(f, 0.0) for f in names] + [0.0] * len(EDGES))
    sides = np.where(known, 2 * y - 1, 0.0)
    for _ in range(rounds):
        x[:, len(names) :] = 0.0
        for a, b, kind in edges:
            x[a, len(names) + kind] += sides[b]
            x[b, len(names) + kind] += sides[a]
        w = _logistic(x[known], y[known], weight[known], mean, prior)
        w[len(names) :] = np.clip(w[len(names) :], 0.0, 4.0)
        sides = np.where(known, 2 * y - 1, np.tanh(x @ w / 2))
    model.weights = PRIOR | dict(zip(names, w[: len(names)].tolist(), strict=True))
    model.edges = dict(zip(EDGES, w[len(names) :].tolist(), strict=True))
    return model


def pieces(text: str | None, model: Model, alone: bool = False) -> list[Node]:
    """The nodes that are personal information, in order."""
    if not text:
        return []
    nodes, _ = candidates(text, model, alone)
    infer([nodes], model)
    return [n for n in nodes if n.belief > 0 and n.piece]


def pieces_of(texts: list[str | None], model: Model, alone: bool = False) -> list[list[Node]]:
    """pieces() of many texts, with one pass of messages over all of them."""
    each = {t: candidates(t, model, alone)[0] for t in set(texts) if t}
    infer(list(each.values()), model)
    found = {t: [n for n in nodes if n.belief > 0 and n.piece] for t, nodes in each.items()}
    return [found[t] if t else [] for t in texts]


def redact(text: str | None, model: Model, alone: bool = False, found: list[Node] | None = None) -> str | None:
    """The text with each piece replaced by its typed placeholder."""
    if text is None:
        return None
    found = pieces(text, model, alone) if found is None else found
    lines = text.split("\n")
    for n in sorted(found, key=lambda n: (n.line, -n.start)):
        line = lines[n.line]
        lines[n.line] = f"{line[: n.start]}[{n.kind.upper()}]{line[n.end :]}"
    return "\n".join(lines)


def fit_on(docs: DataFrame, text: str, key: str, most: int = TRAIN_TEXTS) -> Model:
    """A model: word statistics from all texts of docs, potentials from about ``most`` at most, those of the smallest hashes of their key."""
    usable = docs.where(F.col(text).isNotNull())
    n = docs.count()
    h = F.xxhash64(F.lit("pii"), F.col(key))
    if n > most:
        # The share of hashes that holds the wanted number and a little more; the rest is never sent anywhere.
        usable = usable.where(h < int(-(2**63) + 2**64 * min(1.0, 1.15 * most / n)))
    rows = usable.select(h.alias("h"), text).limit(2 * most).collect()
    return fit([r[1] for r in sorted(rows)[:most]], lexicon_of(docs, text))


def find_pieces(df: DataFrame, keys: list[str], text: str, model: Model, alone: bool = False) -> DataFrame:
    """(keys…, kind, piece) for every distinct piece of every row's text."""
    from pyspark.sql.types import StringType, StructField, StructType

    rows = df.select(*keys, F.col(text).alias("__text")).where("__text is not null and __text != ''")
    schema = StructType([*df.select(*keys).schema.fields, StructField("kind", StringType()), StructField("piece", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, kinds, found = [], [], []
            for k, t in enumerate(pieces_of(batch.column("__text").to_pylist(), model, alone)):
                for kind, piece in dict.fromkeys((n.kind, n.piece) for n in t):
                    index.append(k)
                    kinds.append(kind)
                    found.append(piece)
            at = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in keys], pa.array(kinds, pa.string()), pa.array(found, pa.string())], names=[*keys, "kind", "piece"])

    return rows.mapInArrow(run, schema)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, rec_key, kind, piece) of all personal information in the texts and display names."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("rec_key"), "text")
    names = table(spark, sf_dir, "req2_llm_classified").select(F.col("file").alias("rec_key"), "from_name")
    model = fit_on(docs, "text", "rec_key")
    tag = lambda df, t: df.select(F.lit(t).alias("src_table"), "rec_key", "kind", "piece")
    return tag(find_pieces(docs, ["rec_key"], "text", model), "documents").unionByName(tag(find_pieces(names, ["rec_key"], "from_name", model, True).distinct(), "req2_llm_classified"))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, rec_key, redacted): every text and display name with its personal information replaced by typed placeholders."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("rec_key"), "text")
    names = table(spark, sf_dir, "req2_llm_classified").select(F.col("file").alias("rec_key"), F.col("from_name").alias("text"))
    model = fit_on(docs, "text", "rec_key")

    def run(alone: bool):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text").to_pylist()
                done = [redact(t, model, alone, found) for t, found in zip(texts, pieces_of(texts, model, alone), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("rec_key"), pa.array(done, pa.string())], names=["rec_key", "redacted"])

        return each

    out = lambda df, alone, t: df.mapInArrow(run(alone), "rec_key string, redacted string").select(F.lit(t).alias("src_table"), "rec_key", "redacted")
    return out(docs, False, "documents").unionByName(out(names, True, "req2_llm_classified"))


def p6_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, nodes, pieces, changed): candidates of each kind in all documents, those that are pieces, and how many labels the
    messages of their neighbours changed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on(docs, "text", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [candidates(t, model)[0] if t else [] for t in batch.column("text").to_pylist()]
            infer(found, model)
            nodes = [n for own in found for n in own]
            count = lambda keep: [sum(1 for n in nodes if n.kind == k and keep(n)) for k in KINDS]
            cols = [count(lambda n: True), count(lambda n: n.belief > 0), count(lambda n: (n.belief > 0) != (n.score > 0))]
            yield pa.RecordBatch.from_arrays([pa.array(KINDS), *[pa.array(c, pa.int64()) for c in cols]], names=["kind", "nodes", "pieces", "changed"])

    counted = docs.mapInArrow(run, "kind string, nodes bigint, pieces bigint, changed bigint")
    return counted.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("nodes", "pieces", "changed")])


QUERIES = {"p6_found": p6_found, "p6_redacted": p6_redacted, "p6_messages": p6_messages}
