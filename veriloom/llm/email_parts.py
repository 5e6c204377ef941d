"""What the sender of an e-mail wrote, apart from what the mail inherited or was given by machines.

Three steps. (1) The form of the text: lines under a quote mark, the lines that introduce earlier messages and all that
follows them unmarked, the signature from its delimiter or closing formula on, and notices of device, list or
organisation. (2) Inheritance: a generalised suffix automaton over the words of a thread's earlier messages, in their order;
matches of ``INHERITED_WORDS`` are inherited however they are wrapped or marked. Messages meet only if they share a sampled
run of words with the first message of the thread that has it. A large thread is split: an automaton holds about ``SOURCES``
messages, and about ``REPLIES`` are held against it, so a thread of any size is never in one task. (3) Endings: a paragraph
that closes a message or a quoted part wherever it occurs, in many different mails, is one that senders append, whatever it says.
The three steps are independent of each other; a line is not new if one of them says so.

Edge cases: null and empty texts have no lines; blank lines are never reported; ``\\r`` before a line end is ignored; exact
copies of a mail don't inherit from each other; a text without line breaks is one line; a quote mark before a number
("> 300 pallets") alone between blank lines is no quote.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm.mojibake import repair
from veriloom.llm.unicode_forms import tidy
from veriloom.session import shared_path, table

#: Fewest words of a run that counts as inherited; runs of half as many are sampled to find who may have it. Mails of one
#: thread share single stock sentences, so shorter runs name lines that were written anew.
INHERITED_WORDS = 30
#: Earlier messages in an automaton, and messages held against it, on average.
SOURCES, REPLIES = 64, 256
#: A paragraph is an appended ending if it closes this many different mails …
ENDING_MAILS = 8
#: … and this share of the mails that have it as a paragraph.
ENDING_SHARE = 0.95

# ---------------------------------------------------------------- subject

#: Marks of replies and forwards in the languages that mail clients write.
_MARK = r"(?:re|aw|antw|antwort|sv|vs|res|rif|ref|odp|ynt|r|fw|fwd|wg|tr|rv|enc|i|vb|vl|pd|doorst|fyi|ha|ответ|отв|на|пересл|fs|vá|továbbítás|回复|回覆|答复|转发|轉寄|返信|転送)"
_SUBJECT_MARK = re.compile(rf"^\s*{_MARK}\s?(?:[\[(]\d+[\])]|\^?\d{{1,2}})?\s?[:：]\s*", re.I)
_LIST_NAME = re.compile(r"^\s*\[[^\]]{1,40}\]\s*")
_TAIL_MARK = re.compile(r"\s*(?:[\[(]\s*(?:fwd?|re|wg|tr)\s*[\])]|\(was:?\s[^)]*\))\s*$", re.I)
#: Words that are no mark although they look like one.
_NO_MARK = re.compile(r"^\s*(?:i|r|ha|на|ref)\s?[:：]", re.I)


def bare_subject(subject: str | None) -> tuple[bool, str | None]:
    """(whether the subject carries a mark of a reply or forward or repeats an earlier subject, the subject without)."""
    if subject is None:
        return False, None
    text, marked = tidy(repair(subject)[1]), False
    while True:
        rest = text
        m = _LIST_NAME.match(rest)
        prefix = ""
        while m:
            prefix += m[0]
            rest = rest[m.end() :]
            m = _LIST_NAME.match(rest)
        if re.fullmatch(r"\s*\[(?:fwd?|re|wg)[:\s].*\]\s*", text, re.I):
            marked, text = True, text.strip()[1:-1]
            continue
        if (m := _SUBJECT_MARK.match(rest)) and not _NO_MARK.match(rest):
            marked, text = True, prefix + rest[m.end() :]
            continue
        if m := _TAIL_MARK.search(text):
            marked, text = True, text[: m.start()]
            continue
        return marked, text.strip()


# ---------------------------------------------------------------- form of the text

_PREFIX = re.compile(r"[ \t]{0,3}>")
_BAR = re.compile(r"[ \t]{0,3}\|(?!\s*[^|>\s][^|]*\|(?:[^|]*\|)*\s*$)")
_INDENT = re.compile(r"(?: {4}|\t)")
_COMPARISON = re.compile(r"\s*>\s?\d[\d.,]*\s?(?:%|[^\W\d_])")
_DAY = r"(?:mon|tue|wed|thu|fri|sat|sun|mo|di|mi|do|fr|sa|so|lun|mar|mer|mié|jeu|jue|ven|vie|sam|sáb|dim|dom|seg|ter|qua|qui|sex|пн|вт|ср|чт|пт|сб|вс)"
_VERB = r"(?:wrote|writes|schrieb|a\s+écrit|écrivait|escribi\S{1,8}|escreveu|ha\s+scritto|schreef|skrev|kirjoitti|napisa\S{1,4}|написал\S{0,3}|пишет|yazdı)"
_INTRO = re.compile(
    rf"(?:\*\s)?\S.{{1,90}}\[{_DAY}\w*\.?,?\s[^\]\n]*\d{{4}}[^\]]*\]\s*:$"
    rf"|(?:on|am|le|el|em|il|op|den|dnia|w dniu|в|в\s\S+)\s.{{4,200}}\b{_VERB}\b.{{0,120}}:$"
    rf"|\S.{{1,80}}\s{_VERB}\s(?:on|am|le|el|em)\s.{{4,40}}\d.{{0,20}}:$"
    rf"|\d.{{4,200}}\s{_VERB}\s*:$"
    rf"|.{{2,120}}<[^<>\s]+@[^<>\s]+>.{{0,20}}(?:{_VERB})?\s*:$"
    r"|\d{4}年.{2,120}[：:]$|.{2,80}さん(?:は|が).{0,20}書.{0,8}[：:]$",
    re.I,
)
_INTRO_END = re.compile(rf"<[^<>\s]+@[^<>\s]+>\s*(?:{_VERB})?\s*:$", re.I)
_INTRO_START = re.compile(r"(?:on|am|le|el|em|il|op|den|dnia|в)\s.*\d", re.I)
_SEPARATOR = re.compile(r"(?:-{2,}|_{2,}|={2,}|\*{2,})?\s*(?:original[\s-]+(?:message|appointment|nachricht)|ursprüngliche\s+nachricht|originalnachricht|forwarded\s+(?:message|by.*)|begin\s+forwarded\s+message|weitergeleitete\s+nachricht|mensaje\s+(?:original|reenviado)|mensagem\s+(?:original|encaminhada)|message\s+(?:d'origine|original|transféré)|messaggio\s+(?:originale|inoltrato)|oorspronkelijk\s+bericht|исходное\s+сообщение|пересылаемое\s+сообщение|元のメッセージ|転送メッセージ)\s*:?\s*(?:-{2,}|_{2,}|={2,}|\*{2,})?$", re.I)
_FROM = re.compile(r"\*?(?:from|von|de|da|van|от|от кого|差出人|lähettäjä|från|fra|od)\s?\*?[:：]\*?\s*\S", re.I)
_HEADER = re.compile(r"\*?(?:sent|date|to|cc|bcc|subject|reply-to|importance|gesendet|datum|an|betreff|kopie|envoyé|à|objet|date d'envoi|enviado|enviada(?: em)?|fecha|data|para|asunto|assunto|inviato|oggetto|verzonden|aan|onderwerp|отправлено|дата|кому|тема|копия|送信日時|日時|宛先|件名|skickat|till|ämne)\s?\*?[:：]", re.I)
_RULE = re.compile(r"[-_=*]{4,}$")
_DELIMITER = re.compile(r"(?:--|---|-- |—|__|_{3,}|-{4,}|={3,}|~{3,}|\*{3,})\s*$")

#: Closing formulas, folded, without their final punctuation.
_CLOSING = frozenset(
    x.strip()
    for x in """best; best regards; kind regards; kindest regards; warm regards; regards; rgds; best wishes; with best wishes; many thanks; thanks; thank you; thanks and regards; thx;
    thanks in advance; thank you in advance; cheers; sincerely; sincerely yours; yours sincerely; yours faithfully; yours truly; yours; respectfully; cordially; all the best; take care; br; kr;
    with kind regards; with best regards; talk soon; love; ciao; mfg; lg; vg; viele grüße; viele grüsse; beste grüße; beste grüsse; liebe grüße; schöne grüße; freundliche grüße;
    mit freundlichen grüßen; mit freundlichem gruß; mit besten grüßen; mit freundlichen grüssen; herzliche grüße; gruß; grüße; hochachtungsvoll; danke; vielen dank; danke und gruß;
    cordialement; bien cordialement; bien à vous; bien à toi; meilleures salutations; sincères salutations; salutations distinguées; salutations; merci; merci d'avance; amicalement; à bientôt;
    respectueusement; avec mes salutations distinguées; saludos; saludos cordiales; un saludo; un cordial saludo; un abrazo; atentamente; atte; muchas gracias; gracias; cordialmente; reciba un cordial saludo;
    obrigado; obrigada; muito obrigado; cumprimentos; com os melhores cumprimentos; melhores cumprimentos; atenciosamente; abraço; abraços; atentamente; cordiais saudações; att; saudações;
    с уважением; всего доброго; с наилучшими пожеланиями; спасибо; заранее спасибо; всего хорошего; искренне ваш; до свидания; с приветом; с благодарностью;
    よろしくお願いいたします; よろしくお願いします; 宜しくお願いいたします; 宜しくお願い致します; 敬具; 草々; 以上; 以上、よろしくお願いいたします; cordiali saluti; distinti saluti; met vriendelijke groet; groeten; mvh; med vänliga hälsningar;
    med vennlig hilsen; ystävällisin terveisin; z poważaniem; pozdrawiam""".replace("\n", " ").split(";")
)
_NOTICE = re.compile(
    r"""(?:\W{0,4}(?:caution|warning|attention|achtung|vorsicht|external|externe?\s+(?:e-?mail|nachricht))\b.*(?:e-?mail|message|mail|organi[sz]ation|nachricht|links?)
    |\[\s*(?:external|extern|externe)\s*\]
    |\*{2,}\s*extern
    |you\s+(?:do|don't)\s+(?:not\s+)?often\s+get\s+e-?mail
    |(?:confidentiality\s+notice|disclaimer|legal\s+notice|privacy\s+notice|important\s+notice|vertraulichkeitshinweis|haftungsausschluss|avis\s+de\s+confidentialité|aviso\s+(?:legal|de\s+confidencialidad\w*))\b
    |(?:this|the)\s+(?:e-?mail|message|communication|transmission)(?:\s+and\s+any\s+\w+)?(?:\s+\w+){0,6}\s+(?:may\s+contain|contains?|is\s+(?:intended|confidential|meant)|are\s+(?:intended|confidential|meant)|comes\s+from\s+outside|originated|was\s+sent\s+from\s+outside|has\s+been\s+scanned)
    |the\s+(?:views|opinions|information)\s+(?:\w+\s+){0,6}(?:are|is)\s+(?:those|intended|confidential|solely)
    |(?:\w+\s+){1,6}takes?\s+no\s+liability
    |diese\s+(?:e-?mail|nachricht)\s+(?:\w+\s+){0,4}(?:vertraulich\w*|enthält|ist\s+nur)
    |(?:ce|cet|cette)\s+(?:message|courriel|e-?mail|mail|communication)\s+(?:\w+\s+){0,8}confidentiel
    |este\s+(?:mensaje|correo|mensagem|e-?mail)\s+(?:\w+\s+){0,8}confidencia
    |esta\s+mensagem\s+(?:\w+\s+){0,8}(?:confidencia|destina)
    |questo\s+messaggio|dit\s+bericht\s+(?:\w+\s+){0,6}vertrouwelijk
    |(?:это|данное|настоящее)\s+(?:электронное\s+)?(?:письмо|сообщение)\s+(?:\w+\s+){0,8}(?:конфиденциаль|предназначен|содержит)
    |(?:この|本)(?:メール|電子メール|メッセージ).{0,40}(?:機密|宛先|秘密|破棄)
    |sent\s+from\s+(?:my|a|the)\s+\w+|sent\s+(?:via|with|using)\s+\w+|get\s+\w+\s+for\s+\w+
    |(?:von\s+(?:unterwegs|meinem\s+.{2,30}))\s+gesendet|gesendet\s+(?:von|mit|aus)\s+.{2,40}
    |envoyé\s+(?:de|depuis|avec)\s+(?:mon|ma|mes)?\s*\w+|enviado\s+(?:desde|do|de|a\s+partir\s+do)\s+(?:mi|meu|o|el)?\s*\w+|inviato\s+da|verzonden\s+vanaf|skickat\s+från
    |отправлено\s+(?:с|из)\s+\w+|.{2,20}から送信
    |please\s+(?:think|consider)\b.*(?:print|environment|trees)|think\s+before\s+you\s+print|bitte\s+denken\s+sie\s+an\s+die\s+umwelt|pensez\s+à\s+l'environnement
    |registered\s+(?:in|office)\b.*(?:company|no\.|number)|company\s+(?:registration\s+)?n(?:o|umber)\b
    |you\s+(?:received|are\s+receiving|got)\s+this\s+(?:message|e-?mail|mail|newsletter)\b
    |to\s+(?:unsubscribe|stop\s+(?:these|receiving)|leave\s+this\s+list|manage\s+your)\b|unsubscribe\b|click\s+here\s+to\s+unsubscribe
    |um\s+sich\s+abzumelden|zum\s+abbestellen|pour\s+vous\s+désabonner|pour\s+ne\s+plus\s+recevoir|para\s+(?:darse\s+de\s+baja|cancelar\s+(?:la|a|su)\s+\w+)|чтобы\s+отписаться|配信停止
    |[\w.-]+\s+mailing\s+list\s*$)""",
    re.I | re.X | re.S,
)


def _dashed(text: str) -> bool:
    """Whether a line is ruled at its beginning or its end, or ends with a colon."""
    return text.startswith(("--", "__", "==", "**")) or text.endswith(("--", ":"))


def _content(line: str) -> str:
    return line.strip()


def _closing(line: str) -> bool:
    text = line.strip().rstrip(",.!;:-–—、。 ").lower()
    if len(text) > 45:
        return False
    if "�" in text and sum(c.isalpha() for c in text) >= 3:  # characters were lost: one each, or one for two bytes
        lost = re.compile(re.sub("(?:�)+", lambda m: f".{{1,{len(m[0])}}}", "".join(c if c == "�" else re.escape(c) for c in text)))
        return any(lost.fullmatch(c) for c in _CLOSING)
    return text in _CLOSING


_SENTENCE_END = re.compile(r"[.!?…。]['\"”»)]*$")
_CONTACT = re.compile(r"@|www\.|https?:|^\W*(?:tel|phone|mobile|mob|fax|e-?mail|mail|t|m|e|p|f)\b\.?\s?:?|\+?\d(?:[\s().-]{0,2}\d){7,}|\|", re.I)


def _signature_like(lines: list[str]) -> bool:
    """Names, posts, addresses and numbers, not sentences."""
    body = [x.strip() for x in lines if x.strip()]
    if len(body) > 14:
        return False
    for k, x in enumerate(body):
        if len(x) > 110 and not _NOTICE.match(x):
            return False
        words = x.split()
        if _NOTICE.match(x):
            return all(len(y) < 400 for y in body[k:])
        cjk = sum("぀" <= c <= "鿿" for c in x)
        if _SENTENCE_END.search(x) and not _CONTACT.search(x) and not _closing(x) and (len(words) >= 5 or cjk >= 8):
            return False
        if (len(words) >= 9 or cjk >= 18) and not _CONTACT.search(x):
            return False
    return True


def _header_block(lines: list[str], at: int) -> int:
    """The line after a block of message headers that begins at a line, or the line itself if there is none."""
    first = lines[at].strip()
    if not (":" in first or "：" in first) or not _FROM.match(first):
        return at
    end, more = at + 1, 0
    while end < len(lines) and end - at < 10:
        text = lines[end].strip()
        if _HEADER.match(text):
            more += 1
        elif not text or not (more and lines[end - 1].strip() and lines[end].startswith((" ", "\t", "<"))):
            break
        end += 1
    return end if more >= 2 or (more == 1 and "@" in lines[at]) else at


def _marks(lines: list[str]) -> list[bool]:
    n = len(lines)
    out = [False] * n
    blank = [not x.strip() for x in lines]
    arrow = [">" in x[:4] and _PREFIX.match(x) is not None for x in lines]
    for i in range(n):
        if arrow[i] and _COMPARISON.match(lines[i]) and (i == 0 or blank[i - 1]) and (i + 1 == n or blank[i + 1]):
            near = [arrow[j] for j in range(max(0, i - 3), min(n, i + 4)) if j != i]
            if not any(near):
                arrow[i] = False
    any_arrow = any(arrow)
    i = 0
    style: re.Pattern | None = None  # of the block that an introduction opened
    styles: list[re.Pattern] = []  # that any introduction has opened: answers may stand between the lines
    while i < n:
        text = lines[i].strip()
        if blank[i]:
            i += 1
            continue
        if arrow[i]:
            out[i] = True
            style = None
            i += 1
            continue
        if (style is not None and style.match(lines[i])) or any(p.match(lines[i]) for p in styles):
            out[i] = True
            i += 1
            continue
        # lines that introduce an earlier message
        start, k = i, i
        if (_dashed(text) and _SEPARATOR.match(text)) or (text[0] in "-_=*" and _RULE.match(text) and i + 1 < n and _header_block(lines, i + 1) > i + 1):
            k = i + 1
            while k < n and blank[k]:
                k += 1
        end = _header_block(lines, k) if k < n else k
        opened = end > k or k > i
        wrapped = 0
        if not opened:
            for wrapped in (0, 1, 2):
                if i + wrapped >= n or blank[i + wrapped] or arrow[i + wrapped]:
                    break
                if lines[i + wrapped].rstrip()[-1] not in ":：":
                    continue
                if wrapped and not _INTRO_START.match(text):
                    break
                if _INTRO.match(" ".join(x.strip() for x in lines[i : i + wrapped + 1])):
                    opened, end = True, i + wrapped + 1
                    break
        if not opened and text[0] == "<" and _INTRO_END.match(text):
            # an introduction in two lines with an answer between them
            for b in range(i - 1, max(-1, i - 60), -1):
                if not blank[b] and not out[b] and _INTRO_START.match(lines[b].strip()) and not _SENTENCE_END.search(lines[b].strip()) and re.search(r"\d{4}", lines[b]):
                    opened, start, end = True, i, i + 1
                    out[b] = True
                    break
        if not opened:
            style = None
            i += 1
            continue
        is_header = end > k and not wrapped and k >= start and _FROM.match(lines[k].strip() if k < n else "") is not None
        for j in range(start, min(max(end, k), n)):
            out[j] = True
        j = max(end, k)
        while j < n and blank[j]:
            j += 1
        if j >= n:
            break
        if arrow[j]:
            style = None
        elif _BAR.match(lines[j]):
            style = _BAR
        elif _INDENT.match(lines[j]):
            style = _INDENT
        elif not is_header and any(_BAR.match(x) for x in lines[j:]):
            style = _BAR
        elif is_header or not any_arrow or k > start:
            for x in range(j, n):
                out[x] = True
            break
        else:
            style = None
        if style is not None and style not in styles:
            styles.append(style)
        i = j
    return out


def not_new(text: str | None) -> list[int]:
    """Numbers (from 1) of the non-blank lines that the sender did not newly write, by the form of the text."""
    if not text:
        return []
    if not text.isascii():
        damaged, fixed = repair(text)
        plain = tidy(fixed if damaged else text)
        text = plain if plain.count("\n") == text.count("\n") else text
    lines = [x.rstrip("\r") for x in text.split("\n")]
    out = _marks(lines)
    n = len(lines)
    # paragraphs that are notices
    i = 0
    while i < n:
        if not lines[i].strip() or out[i]:
            i += 1
            continue
        j = i
        while j < n and lines[j].strip() and not out[j]:
            j += 1
        for k in range(i, j):
            if (k == i or _NOTICE.match(lines[k].strip()) or _DELIMITER.match(lines[k - 1])) and _NOTICE.match(" ".join(lines[k:j]).strip()):
                for x in range(k, j):
                    out[x] = True
                if k > i and _DELIMITER.match(lines[k - 1]):
                    out[k - 1] = True
                break
        i = j
    # signatures: in each stretch between marked parts
    i = 0
    while i < n:
        if out[i] or not lines[i].strip():
            i += 1
            continue
        j = i
        while j < n and not out[j]:
            j += 1
        for k in range(i, j):
            line = lines[k]
            if not line.strip():
                continue
            if _closing(line) or (line[0] in "-—_=~*" and _DELIMITER.match(line) and k + 1 < j and lines[k + 1].strip()):
                if _signature_like(lines[k + 1 : j]):
                    for x in range(k, j):
                        out[x] = True
                    break
        i = j
    return [k + 1 for k in range(n) if out[k] and lines[k].strip()]


# ---------------------------------------------------------------- inheritance within threads


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of words; add() the earlier messages, then ask for matches."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list[str]) -> None:
        last = 0
        for w in words:
            if w in self.next[last]:
                q = self.next[last][w]
                if self.length[q] == self.length[last] + 1:
                    last = q
                    continue
                last = self._clone(last, w, q)
                continue
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p != -1 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p == -1:
                self.link[cur] = 0
            else:
                q = self.next[p][w]
                self.link[cur] = q if self.length[p] + 1 == self.length[q] else self._clone(p, w, q)
            last = cur

    def _clone(self, p: int, w: str, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def inherited(self, words: list[str], least: int) -> list[bool]:
        """For each word whether it lies in a match of at least that many words."""
        out = [False] * len(words)
        state = size = 0
        for k, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                size += 1
            else:
                size = 0
            if size >= least:
                out[k - size + 1 : k + 1] = [True] * size
        return out


_WORD = re.compile(r"[^\W_]+")
_QUOTE_MARKS = re.compile(r"[\s>|]*")
_MARKS_BEGIN = frozenset(" \t>|")


def words_of(text: str) -> tuple[list[str], list[int]]:
    """Words without quote marks and case, and the line number of each."""
    words, at = [], []
    for number, line in enumerate(text.split("\n"), 1):
        found = _WORD.findall(line.lower())
        words += found
        at += [number] * len(found)
    return words, at


def run_hashes(words: list[str], size: int) -> list[int]:
    """A hash of every run of ``size`` words, in order."""
    step = [xxhash.xxh3_64_intdigest(w) for w in words]
    mask, base = (1 << 64) - 1, 0x9E3779B97F4A7C15
    top = pow(base, size, 1 << 64)
    h, runs = 0, []
    for k, x in enumerate(step):
        h = (h * base + x) & mask
        if k >= size:
            h = (h - step[k - size] * top) & mask
        if k >= size - 1:
            runs.append(((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & mask)
    return runs


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def anchors(words: list[str], size: int = INHERITED_WORDS // 2) -> list[int]:
    """Hashes of sampled runs of words: of every ``size`` neighbouring runs the least is kept, so that two texts with
    2·size − 1 words in common share one at least."""
    if len(words) < size:
        return []
    runs = run_hashes(words, size)
    kept, best = set(), -1
    for k in range(len(runs) - size + 1):
        if best < k or runs[k + size - 1] <= runs[best]:
            best = min(range(k, k + size), key=lambda j: (runs[j], -j))
        kept.add(runs[best])
    if len(runs) < size:
        kept.add(min(runs))
    return [_signed(x) for x in kept]


def stretches(words: list[str], shared: set[int], least: int = INHERITED_WORDS) -> list[int]:
    """Hashes of the runs of ``least`` words that hold one of the shared anchors."""
    size = least // 2
    whole = run_hashes(words, least)
    near: set[int] = set()
    for k, x in enumerate(run_hashes(words, size)):
        if _signed(x) in shared:
            near.update(range(max(0, k + size - least), min(k + 1, len(whole))))
    return list({_signed(whole[k]) for k in near})


def inherited_lines(text: str, earlier: list[str], least: int = INHERITED_WORDS) -> list[int]:
    """Lines of the text most of whose words lie in long matches with earlier messages."""
    a = SuffixAutomaton()
    for e in earlier:
        a.add(words_of(e)[0])
    total = line_hits(text, a, least)
    return sorted(k for k, (hits, n) in total.items() if 2 * len(hits) > n)


def line_hits(text: str, automaton: SuffixAutomaton, least: int = INHERITED_WORDS) -> dict[int, tuple[list[int], int]]:
    """For each line with inherited words: their places among the words of the text, and the number of its words. None for a
    text that is inherited as a whole, which is a copy and no reply."""
    words, at = words_of(text)
    hit = automaton.inherited(words, least)
    if all(hit):
        return {}
    total: dict[int, tuple[list[int], int]] = {}
    for place, (line, h) in enumerate(zip(at, hit, strict=True)):
        places, n = total.get(line, ([], 0))
        if h:
            places.append(place)
        total[line] = (places, n + 1)
    return {k: v for k, v in total.items() if v[0]}


def paragraphs(text: str) -> list[tuple[int, bool, int, int]]:
    """(hash of its words, whether it closes the text or a part of one quote level, first line, last line) of every paragraph."""
    found: list[tuple[str, int, int, int]] = []
    level = begun = -1
    words: list[str] = []
    rows = text.split("\n")
    for number, row in enumerate([*rows, ""], 1):
        if row[:1] in _MARKS_BEGIN:
            m = _QUOTE_MARKS.match(row)
            body = row[m.end() :].split()
            depth = m[0].count(">") + m[0].count("|")
        else:
            body, depth = row.split(), 0
        if words and (not body or depth != level):
            found.append((" ".join(words).lower(), level, begun, number - 1))
            words = []
        if body:
            if not words:
                level, begun = depth, number
            words += body
    return [(xxhash.xxh3_64_intdigest(t) - (1 << 63), k + 1 == len(found) or found[k + 1][1] != d, a, b) for k, (t, d, a, b) in enumerate(found)]


def _parts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One Python pass over the texts, written once: lines by form, the thread, the paragraphs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, subjects, users = (batch.column(c).to_pylist() for c in ("text", "subject", "user_name"))
            lines, threads, replies, sums, parts = [], [], [], [], []
            for text, subject, user in zip(texts, subjects, users, strict=True):
                lines.append(not_new(text))
                reply, bare = bare_subject(subject)
                bare = (bare or "").lower()
                replies.append(reply)
                threads.append(xxhash.xxh3_64_intdigest(f"{user}\x1f{bare}") - (1 << 63) if bare and user and text else None)
                sums.append(xxhash.xxh3_64_intdigest(text) - (1 << 63) if text else None)
                parts.append([{"h": h, "closes": c, "first": a, "last": b} for h, c, a, b in paragraphs(text)] if text else [])
            data = [batch.column("rec_key"), lines, threads, replies, sums, parts]
            types = [None, pa.list_(pa.int32()), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.struct([("h", pa.int64()), ("closes", pa.bool_()), ("first", pa.int32()), ("last", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(d, t) if t else d for d, t in zip(data, types, strict=True)], names=["rec_key", "lines", "thread", "reply", "text_sum", "parts"])

    schema = "rec_key string, lines array<int>, thread bigint, reply boolean, text_sum bigint, parts array<struct<h:bigint,closes:boolean,first:int,last:int>>"
    path = shared_path(spark, "email-parts")
    docs.select("rec_key", "text", "subject", "user_name").mapInArrow(run, schema).write.parquet(path)
    return spark.read.parquet(path)


def _inherited(parts: DataFrame, docs: DataFrame) -> DataFrame:
    """(rec_key, line_no) of lines inherited from earlier messages of the thread."""
    many = parts.where("thread is not null").groupBy("thread").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("thread")
    path = shared_path(parts.sparkSession, "email-members")
    parts.select("rec_key", "thread", "reply", "text_sum").join(many, "thread", "left_semi").write.parquet(path)  # keys and hashes only; read several times below
    members = parts.sparkSession.read.parquet(path)
    texts = members.join(docs.select("rec_key", "text"), "rec_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t or "")[0] for t in batch.column("text").to_pylist()]
            sizes, got = pa.array([len(w) for w in words], pa.int32()), pa.array([anchors(w) for w in words], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("rec_key"), batch.column("thread"), batch.column("text_sum"), sizes, got], names=["rec_key", "thread", "text_sum", "words", "anchors"])

    runs = texts.mapInArrow(run, "rec_key string, thread bigint, text_sum bigint, words int, anchors array<bigint>").select("rec_key", F.explode("anchors").alias("anchor"), "thread", "text_sum", "words")
    path = shared_path(parts.sparkSession, "email-anchors")
    runs.select("rec_key", "thread", "text_sum", "words", F.col("anchor").alias("plain"), F.xxhash64("thread", "anchor").alias("anchor")).write.parquet(path)  # read twice below
    runs = parts.sparkSession.read.parquet(path)
    shared = runs.groupBy("anchor").agg(F.min("text_sum").alias("least"), F.max("text_sum").alias("most")).where("least != most").select("anchor")
    # The anchors are hashed with their thread: only what two different texts of a thread share is looked at closer.
    near = runs.join(shared, "anchor").groupBy("rec_key").agg(F.collect_set("plain").alias("anchors"), F.first("thread").alias("thread"), F.first("text_sum").alias("text_sum"), F.first("words").alias("words"))
    whole = docs.select("rec_key", "text")

    def long_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [stretches(words_of(t)[0], set(a)) for t, a in zip(batch.column("text").to_pylist(), batch.column("anchors").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("rec_key", "thread", "text_sum", "words")], pa.array(got, pa.list_(pa.int64()))], names=["rec_key", "thread", "text_sum", "words", "runs"])

    # Mails carry no time that can be relied on. A text that was sent without a reply's subject is earlier than one that never
    # was; among the like the shorter is, as a reply holds it and more. Every run of INHERITED_WORDS words names its first mail,
    # so the sources of a mail hold all that it shares with any earlier mail of the thread, without a comparison of all pairs.
    ranks = members.groupBy("thread", "text_sum").agg(F.min("reply").cast("int").alias("reply"))
    grams = near.join(whole, "rec_key").mapInArrow(long_runs, "rec_key string, thread bigint, text_sum bigint, words int, runs array<bigint>").join(ranks, ["thread", "text_sum"])
    grams = grams.select("rec_key", F.struct("reply", "words").alias("rank"), "text_sum", F.explode("runs").alias("run"), "thread").select("rec_key", "thread", "rank", "text_sum", F.xxhash64("thread", "run").alias("run"))
    path = shared_path(parts.sparkSession, "email-runs")
    grams.write.parquet(path)  # read twice below
    grams = parts.sparkSession.read.parquet(path)
    first = grams.groupBy("run").agg(F.min(F.struct("rank", "text_sum", "rec_key")).alias("first"))
    path = shared_path(parts.sparkSession, "email-pairs")
    grams.join(first, "run").where("rank > first.rank").select("rec_key", "thread", F.col("first.rec_key").alias("source")).distinct().write.parquet(path)  # read twice below
    met = parts.sparkSession.read.parquet(path)
    sizes = met.groupBy("thread").agg(F.approx_count_distinct("source").alias("sources"), F.approx_count_distinct("rec_key").alias("replies"))
    part = lambda key, n, size: F.pmod(F.xxhash64(key), F.ceil(F.col(n) / size))
    path = shared_path(parts.sparkSession, "email-met")
    met.join(sizes, "thread").select("thread", part("source", "sources", SOURCES).alias("bucket"), part("rec_key", "replies", REPLIES).alias("block"), "source", "rec_key").write.parquet(path)  # read three times below
    met = parts.sparkSession.read.parquet(path)
    group = ["thread", "bucket", "block"]
    met_keys = met.select("rec_key").unionByName(met.select(F.col("source").alias("rec_key"))).distinct()
    told = members.join(met_keys, "rec_key", "left_semi").join(ranks.withColumnRenamed("reply", "later"), ["thread", "text_sum"]).join(whole, "rec_key").select("rec_key", "text", "later", "text_sum")
    earlier = met.select(*group, F.col("source").alias("rec_key")).distinct().join(told, "rec_key")
    earlier = earlier.select(*[F.col(c).alias(f"s_{c}") for c in earlier.columns])  # names of its own: both sides come from one table
    replies = met.select(*group, "rec_key").distinct().join(told, "rec_key")

    def mark(sources: pd.DataFrame, later: pd.DataFrame) -> pd.DataFrame:
        """The messages of a part of a thread in their order: each is held against the automaton of all that came before."""

        def in_order(pdf: pd.DataFrame) -> list[tuple]:
            return sorted(((r.later, len(words_of(r.text)[0])), r.text_sum, r.rec_key, r.text) for r in pdf.itertuples())

        waiting, automaton, rows = in_order(sources.rename(columns=lambda c: c.removeprefix("s_"))), SuffixAutomaton(), []
        at = 0
        for rank, _, key, text in in_order(later):
            while at < len(waiting) and waiting[at][0] < rank:
                automaton.add(words_of(waiting[at][3])[0])
                at += 1
            rows += [(key, line, places, n) for line, (places, n) in line_hits(text, automaton).items()]
        return pd.DataFrame(rows, columns=["rec_key", "line_no", "places", "n"])

    hits = earlier.groupBy(*[f"s_{c}" for c in group]).cogroup(replies.groupBy(*group)).applyInPandas(mark, "rec_key string, line_no int, places array<int>, n int")
    all_places = hits.groupBy("rec_key", "line_no").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("hits"), F.first("n").alias("n"))
    return all_places.where(F.col("hits") * 2 > F.col("n")).select("rec_key", "line_no")


def _endings(parts: DataFrame) -> DataFrame:
    """(rec_key, line_no) of closing paragraphs that many different mails end with and hardly any has elsewhere."""
    each = parts.select("rec_key", "text_sum", F.explode("parts").alias("p")).select("rec_key", "text_sum", "p.*")
    seen = each.groupBy("h").agg(F.approx_count_distinct(F.when(F.col("closes"), F.col("text_sum"))).alias("mails"), F.avg(F.col("closes").cast("int")).alias("share"))
    appended = seen.where((F.col("mails") >= ENDING_MAILS) & (F.col("share") >= ENDING_SHARE)).select("h")
    return each.where("closes").join(appended, "h", "left_semi").select("rec_key", F.explode(F.sequence("first", "last")).alias("line_no"))


def steps(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(rec_key, line_no, step) of what each of the three steps says of docs (rec_key, text, subject, user_name)."""
    parts = _parts(spark, docs)
    said = lambda df, step: df.withColumn("step", F.lit(step))
    form = parts.select("rec_key", F.explode("lines").alias("line_no"))
    return said(form, "form").unionByName(said(_inherited(parts, docs), "inherited")).unionByName(said(_endings(parts), "ending"))


def not_newly_written(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(rec_key, line_no) of the lines of docs (rec_key, text, subject, user_name) that their senders didn't newly write."""
    return steps(spark, docs).select("rec_key", "line_no").distinct()


def reduced(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(rec_key, new_text, bare_subject) of every row of docs: the newly written lines, and the subject without marks.

    Runs of blank lines that a removed part leaves become one; a text of which nothing is new becomes empty, null stays null.
    """
    gone = not_newly_written(spark, docs).groupBy("rec_key").agg(F.collect_list("line_no").alias("gone"))
    rows = docs.select("rec_key", "text", "subject").join(gone, "rec_key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [new_text(t, set(g or ())) for t, g in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True)]
            bare = [bare_subject(s)[1] for s in batch.column("subject").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rec_key"), pa.array(texts, pa.string()), pa.array(bare, pa.string())], names=["rec_key", "new_text", "bare_subject"])

    return rows.mapInArrow(run, "rec_key string, new_text string, bare_subject string")


def new_text(text: str | None, gone: set[int]) -> str | None:
    """The text without the lines of those numbers."""
    if text is None or not gone:
        return text
    kept: list[str] = []
    cut = False
    for number, line in enumerate(text.split("\n"), 1):
        if number in gone:
            cut = True
        elif line.strip() or not cut or (kept and kept[-1].strip()):
            kept.append(line)
            cut = cut and not line.strip()
    return "\n".join(kept).strip()


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("rec_key"), "text", "subject", "user_name")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, rec_key, line_no): inherited and appended lines of documents; marked subjects as line 0."""
    docs = _documents(spark, sf_dir)
    found = not_newly_written(spark, docs).select(F.lit("documents").alias("src_table"), "rec_key", "line_no")
    rows = table(spark, sf_dir, "req2_llm_classified").select(F.col("file").alias("rec_key"), "subject").where("subject is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [bare_subject(s)[0] for s in batch.column("subject").to_pylist()]
            yield batch.select(["rec_key"]).filter(pa.array(hits, pa.bool_()))

    marked = rows.mapInArrow(run, "rec_key string").distinct().select(F.lit("req2_llm_classified").alias("src_table"), "rec_key", F.lit(0).alias("line_no"))
    return found.unionByName(marked)


def p5_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_key, new_text, bare_subject) of every document."""
    return reduced(spark, _documents(spark, sf_dir))


def p5_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_key, subject, bare_subject, marked) of every row of req2_llm_classified."""
    rows = table(spark, sf_dir, "req2_llm_classified").select(F.col("file").alias("rec_key"), "subject")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [bare_subject(x) for x in batch.column("subject").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b for _, b in got], pa.string()), pa.array([m for m, _ in got], pa.bool_())], names=["rec_key", "subject", "bare_subject", "marked"])

    return rows.mapInArrow(run, "rec_key string, subject string, bare_subject string, marked boolean")


def p5_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, lines, alone): lines of documents that each step finds, and those that no other step finds."""
    by_line = steps(spark, _documents(spark, sf_dir)).groupBy("rec_key", "line_no").agg(F.collect_set("step").alias("by"))
    return by_line.select(F.explode("by").alias("step"), (F.size("by") == 1).cast("int").alias("one")).groupBy("step").agg(F.count(F.lit(1)).alias("lines"), F.sum("one").alias("alone"))


QUERIES = {"p5_found": p5_found, "p5_reduced": p5_reduced, "p5_subjects": p5_subjects, "p5_steps": p5_steps}
