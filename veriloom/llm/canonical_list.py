"""Free-entered names mapped to a reference list.

The reference entries and their alias paths (other word order, joined, without accents, domains, the distinctive word if
one entry alone has it) form a trie. A value is stripped of signs and words that name nobody, and what is left is run through
the trie by a Levenshtein automaton with transpositions, kept as bit vectors, that returns every entry within a distance
depending on the length. The nearest entry wins if it is alone.

Words that name nobody are legal forms and common words (a short list), and those that the data show: a phrase that stands
beside the whole names of many different entries (``LEAST_ENTRIES``, and ``ENTRY_SHARE`` of them) says nothing about which
one is meant, be it a department, a country or the mail program. The phrases are counted over all values. Only names of two
words or more teach them, as a word beside a name of one word may make it another organisation's name.

Edge cases: null, empty and words for "nothing" give status ``empty``; a value no entry is near to ``none``; one with
several entries equally near ``ambiguous``; an empty reference leaves every value unmatched. Values of any length are read
whole; what is left of them after stripping cannot match beyond the length of the longest alias.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from veriloom.llm.unicode_forms import canonical
from veriloom.session import shared_path, table

#: Most entries of a reference list that are sent to every executor; a longer list raises an error instead.
MAX_REFERENCE = 200_000
#: Entries, and share of the entries of two words or more, beside which a phrase stands that names nobody. More than
#: MOST_PHRASES such phrases are an error.
LEAST_ENTRIES, ENTRY_SHARE, MOST_PHRASES = 5, 0.05, 100_000
#: Values that can have more than 1/HOT of all rows: so many at most are broadcast.
HOT = 100_000
#: Values and words that a worker remembers.
MEMO = 200_000

#: Words that a value may hold for "no name".
NOTHING = frozenset("n/a na none null nil nan unknown undefined unspecified - -- – — ? . set() [] {} () 0 no not empty nothing keine aucun aucune ninguno ninguna nenhum nenhuma tbd".split())
#: Common words and signs around a name that name no other organisation.
DECORATIONS = frozenset(
    """the team via mail email e mobile app customer customers support service services client clients kundenservice kundendienst help
    helpdesk centre center desk notifications notification billing no reply noreply donotreply security alerts alert accounts account payable official online
    web site website newsletter info contact office head hq headquarters ltd limited gmbh ag inc incorporated llc llp lp plc bv b v nv n sa s a sas sarl srl
    spa corp corporation co company cie kg kgaa se oy ab as pty pte usa us uk eu europe emea apac nordic nordics iberia deutschland germany france spain
    espana portugal italia italy uk ireland austria schweiz switzerland america americas north global worldwide international group holding holdings tm r c
    and und et y of de by from at for on behalf a an service equipe l""".split()
)
#: The same as they end or begin a name written in one.
GLUED_END = sorted("team mobileapp customersupport customerservice kundenservice securityalerts securityalert helpcentre helpdesk notifications billing noreply support service ltd limited gmbh inc llc plc bv corp co andcokg cokg usa europe emea nordic iberia deutschland france uk tm ag sa".split(), key=len, reverse=True)
GLUED_START = ("serviceclient", "team", "the")
#: Words for kinds of organisations, never a name by themselves.
KINDS = frozenset("university museum bank city town college school hospital institute ministry department foundation society association club church council library theatre hotel airport societe fundacion grupo cafe borse gesellschaft verein stiftung".split())
_JOINERS = frozenset("and und et y e".split())
_FOLD = str.maketrans({"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d"})
#: Figures and signs typed or recognised in place of letters.
_FIGURES = str.maketrans("013457|$@", "oleastlsa")


def fold(text: str) -> str:
    """Comparison form without accents."""
    text = unicodedata.normalize("NFD", (canonical(re.sub("[™®©℠]", " ", text)) or "").translate(_FOLD))
    return "".join(c for c in text if not unicodedata.combining(c))


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9|$@]+|[^\W_]+|&", text)


def squash(words: list[str]) -> str:
    return "".join(w for w in words if w != "&")


def limit(length: int) -> int:
    """Edits allowed for an alias of that length."""
    return 0 if length < 5 else 1 if length < 8 else 2 if length < 12 else 3


def _abbreviates(short: str, word: str) -> bool:
    """Whether short is the beginning of word, or some of its letters in order with the first among them."""
    if not 2 <= len(short) < len(word) or short[0] != word[0]:
        return False
    if word.startswith(short):
        return True
    if any(c in "aeiou" for c in short[1:]) and len(short) > 3:
        return False
    at = iter(word)
    return all(c in at for c in short) and short[-1] in word[len(word) // 2 :]


class Trie:
    """Strings with values, searched within an edit distance (transposition of neighbours counts one).

    A node is a list: children by character, values if a string ends there, and the least and most characters that follow.
    """

    def __init__(self) -> None:
        self.root: list = [{}, None, 1 << 30, 0]

    def add(self, key: str, value: object) -> None:
        node, rest = self.root, len(key)
        for c in key:
            node[2], node[3] = min(node[2], rest), max(node[3], rest)
            rest -= 1
            node = node[0].setdefault(c, [{}, None, 1 << 30, 0])
        node[2] = 0
        if node[1] is None:
            node[1] = (key, set())
        node[1][1].add(value)

    def get(self, key: str) -> set:
        node = self.root
        for c in key:
            if (node := node[0].get(c)) is None:
                return set()
        return node[1][1] if node[1] else set()

    def search(self, query: str, k: int) -> list[tuple[int, str, object]]:
        """(distance, key, value) of all keys within k.

        Bit i of row l: the first i characters of the query are matched with at most l edits by the path so far. Row l
        of ``swapped``: the next two characters would match exchanged. A path is left when none of its states can reach
        the query's end by the characters that still follow in the trie.
        """
        masks: dict[str, int] = {}
        for i, c in enumerate(query):
            masks[c] = masks.get(c, 0) | 1 << i
        n = len(query)
        full, done = (1 << (n + 1)) - 1, 1 << n
        windows: dict[tuple[int, int], int] = {}
        rows, row = [], 1
        for _ in range(k + 1):
            rows.append(row)
            row |= row << 1
        out: list[tuple[int, str, object]] = []
        levels = range(1, k + 1)
        stack = [(self.root, rows, [0] * (k + 1))]
        of = masks.get
        while stack:
            node, rows, swapped = stack.pop()
            if node[1] is not None and rows[k] & done:
                level = next(x for x, r in enumerate(rows) if r & done)
                key, values = node[1]
                out += [(level, key, v) for v in values]
            first = rows[0]
            for c, child in node[0].items():
                span = (child[2], child[3])
                window = windows.get(span)
                if window is None:
                    low = n - child[3] - k
                    window = windows[span] = ((1 << max(0, n - child[2] + k + 1)) - 1) & ~((1 << max(0, low)) - 1)
                b = of(c, 0)
                last = (first & b) << 1
                if not b:
                    # no character of the query: every state costs an edit
                    if not k:
                        continue
                    new = [0]
                    before = first
                    for level in levels:
                        last = (before | (before << 1) | (last << 1)) & full
                        new.append(last)
                        before = rows[level]
                    if last & window:
                        stack.append((child, new, [0] * (k + 1)))
                    continue
                new, swap, half, before = [last], [0], b >> 1, first
                for level in levels:
                    now = rows[level]
                    swap.append(before & half)
                    last = (((now & b) << 1) | before | (before << 1) | (last << 1) | ((swapped[level] & b) << 2)) & full
                    new.append(last)
                    before = now
                if last & window:
                    stack.append((child, new, swap))
        return out


def distance(a: str, b: str, most: int = 9) -> int:
    """Edit distance with transpositions of neighbours, most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, two[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


@dataclass
class Matcher:
    """A reference list made ready: entries (name, domains) with all alias paths."""

    entries: list[tuple[str, list[str]]]
    names: Trie = field(default_factory=Trie)
    domains: Trie = field(default_factory=Trie)
    single: dict[str, int] = field(default_factory=dict)
    common: set[str] = field(default_factory=set)
    tlds: set[str] = field(default_factory=set)
    longest: int = 0
    memo: dict[str, tuple[str, str | None, int | None]] = field(default_factory=dict)
    exact: frozenset[str] = frozenset()
    alias_words: dict[str, set[int]] = field(default_factory=dict)
    decor: Trie = field(default_factory=Trie)
    closest: dict[str, bool] = field(default_factory=dict)
    carriers: Trie = field(default_factory=Trie)
    learned: tuple[str, ...] = ()
    glued: list[str] = field(default_factory=list)
    decorations: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self.exact = frozenset(n for n, _ in self.entries)
        words = [[w for w in _words(fold(n)) if w != "&"] for n, _ in self.entries]
        holders: dict[str, set[int]] = {}
        for k, ws in enumerate(words):
            for w in ws:
                holders.setdefault(w, set()).add(k)
        # a word shared beside different companions is a trade or a kind; one shared first word names a family of brands
        first = {ws[0] for ws in words if ws}
        self.common = {w for w, h in holders.items() if len(h) > 2 or (len(h) == 2 and w not in first)} | ((DECORATIONS | KINDS) & set(holders))
        kinds = {ws[0] for ws, (n, _) in zip(words, self.entries, strict=True) if len(ws) > 1 and ws[1] not in self.common and len(holders[ws[1]]) == 1 and "&" not in n}
        after_of = {ws[-1] for ws in words if "of" in ws}
        for k, (name, hosts) in enumerate(self.entries):
            ws = words[k]
            if not ws:
                continue
            both = "&" in fold(name)
            heads = [w for w in ws if w not in self.common and (len(holders[w]) == 1 or not both)]
            forms = {squash(ws)}
            if both:
                left, right = (_words(x) for x in fold(name).split("&", 1))
                for j in [*_JOINERS, ""]:
                    forms |= {squash([*left, j, *right]), squash([*right, j, *left])}
            if len(ws) == 2:
                forms.add(ws[1] + ws[0])
            if "of" in ws:
                at = ws.index("of")
                forms |= {squash(ws[at + 1 :] + ws[:at]), squash(ws[:at] + ws[at + 1 :])}
            if len(ws) > 2 and not both and "of" not in ws:
                forms.add(squash([ws[0], *ws[1:-1]]))
                forms.add(squash([ws[-1], *ws[:-1]]))
            forms |= {f.replace("pharma", "pharmaceuticals") for f in list(forms) if "pharma" in ws}
            for f in forms:
                self._name(f, k)
            for w in heads if (both or "of" in ws) else heads[:1] or []:
                others = [j for j in holders[w] if j != k]
                if not others and len(w) >= 5 and not (w in kinds and w not in after_of and len(ws) > 1 and w == ws[0] and ws[1] not in self.common):
                    self._name(w, k)
                    self.single[w] = k
            if len(ws) == 2 and ws[0] in kinds and len(holders[ws[1]]) == 1 and ws[1] not in self.common and not both:
                self._name(ws[1], k)
                self.single[ws[1]] = k
            for h in hosts or []:
                h = h.strip().lower().rstrip(".")
                if h:
                    self.domains.add(h, k)
                    self.tlds.add(h.rsplit(".", 1)[-1])
                    self.longest = max(self.longest, len(h))
        names = {w for ws in words for w in ws}
        self.decorations = DECORATIONS | {w for phrase in self.learned for w in phrase.split() if len(w) > 1 and w not in names}
        self.glued = sorted({*GLUED_END, *(squash(p.split()) for p in self.learned if len(p) > 2 and not set(p.split()) & self.common)}, key=lambda w: (-len(w), w))
        for w in self.decorations:
            self.decor.add(w, w)
        for w in self.glued:
            self.carriers.add(w, w)

    def _name(self, form: str, k: int) -> None:
        self.names.add(form, k)
        self.longest = max(self.longest, len(form))

    def _is_decoration(self, w: str) -> bool:
        got = self.closest.get(w)
        if got is None:
            plain = w.translate(_FIGURES)
            got = w in self.decorations or plain in self.decorations or w.isdigit() or w == "&"
            if not got and len(w) >= 4 and not self.names.get(w) and w not in self.common:
                k = 1 if len(w) < 7 else 2
                got = any((len(key) >= 4 or key in ("via", "the", "inc", "ltd", "llc", "plc")) and (d == 1 or len(key) >= 7) and key not in self.common for d, key, _ in self.decor.search(w, k))
            self._remember(w, got)
        return got

    def _remember(self, key: str, got: bool) -> None:
        if len(self.closest) >= MEMO:
            self.closest.clear()
        self.closest[key] = got

    def _is_carrier(self, tail: str) -> bool:
        """Whether the end of a value is a misspelt phrase that names nobody."""
        got = self.closest.get("\x00" + tail)
        if got is None:
            k = 0 if len(tail) < 3 else 1 if len(tail) < 6 else 2
            got = bool(k) and any(len(p) >= 3 and (d == 1 or len(p) >= 7) for d, p, _ in self.carriers.search(tail, k))
            self._remember("\x00" + tail, got)
        return got

    def _best(self, core: str, k: int) -> tuple[int, list[int]] | None:
        """(distance, entries) nearest to a joined core within the limits."""
        if len(core) > self.longest + 3 or len(core) < 3:
            return None
        if hit := self.names.get(core):
            return 0, sorted(hit)
        plain = core.translate(_FIGURES)
        if plain != core and (hit := self.names.get(plain)):
            return 1, sorted(hit)
        k = min(k, limit(len(core) + 1))
        if k < 1:
            return None
        found: dict[int, int] = {}
        for text in dict.fromkeys((core, plain)):
            for d, key, entry in self.names.search(text, k):
                d += text is not core and text != core
                most = min(limit(len(key)), 1 if key in self.single and len(key) < 9 else 2 if key in self.single else 3)
                if d <= most:
                    found[entry] = min(d, found.get(entry, 99))
        if not found:
            return None
        d = min(found.values())
        near = sorted(e for e, x in found.items() if x == d)
        if d >= 3 and any(x - d < 1 for e, x in found.items() if e not in near):
            return None
        return d, near

    def _domain(self, host: str) -> tuple[int, list[int]] | None:
        host = host.strip(".").removeprefix("www.")
        if hit := self.domains.get(host):
            return 0, sorted(hit)
        tld = host.rsplit(".", 1)[-1]
        found: dict[int, int] = {}
        for text in dict.fromkeys((host, host.translate(_FIGURES))):
            for d, _, entry in self.domains.search(text, min(2, limit(len(host) - len(tld) - 1))):
                found[entry] = min(d, found.get(entry, 99))
        if not found:
            return None
        d = min(found.values())
        return d, sorted(e for e, x in found.items() if x == d)

    def _is_tld(self, label: str) -> bool:
        return label in self.tlds or (len(label) >= 5 and label not in self.common and any(len(t) >= 5 and distance(label, t, 2) <= 2 for t in self.tlds))

    def _glued(self, core: str) -> tuple[int, list[int]] | None:
        """A name joined with the words around it: those are cut off in turn until an entry is left."""
        best, todo, seen = None, [core], {core}
        while todo:
            text = todo.pop(0)
            for end in self.glued:
                if text.endswith(end) and len(text) - len(end) >= 5 and text[: -len(end)] not in seen:
                    seen.add(text[: -len(end)])
                    todo.append(text[: -len(end)])
            for start in GLUED_START:
                if text.startswith(start) and len(text) - len(start) >= 5 and text[len(start) :] not in seen:
                    seen.add(text[len(start) :])
                    todo.append(text[len(start) :])
        for text in seen - {core}:
            got = self._best(text, 2)
            if got and (best is None or got[0] < best[0]):
                best = got
        return best

    def _expansions(self, words: list[str]) -> Iterator[list[str]]:
        """The words with abbreviated common words written out, in all ways."""
        options = []
        for k, w in enumerate(words):
            longs = [g for g in self.common if g not in DECORATIONS or g in ("services", "group", "international", "security")]
            got = [g for g in longs if k and _abbreviates(w, g)] or [g for g in longs if not k and _abbreviates(w, g) and len(words) > 1]
            options.append([w, *sorted(got)])
        ways: list[list[str]] = [[]]
        for o in options:
            ways = [[*x, y] for x in ways for y in o]
        yield from (x for x in ways if x != words)

    def match(self, value: str | None) -> tuple[str, str | None, int | None]:
        """(status, entry, distance)."""
        if value is None:
            return "empty", None, None
        got = self.memo.get(value)
        if got is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.memo[value] = self._match(value)
        return got

    def _match(self, value: str) -> tuple[str, str | None, int | None]:
        if value in self.exact:
            return "exact", value, 0
        text = fold(value).strip()
        if text.strip("'\"()[]{} ") in NOTHING or not text:
            return "empty", None, None
        address = re.search(r"<([^<>@\s]+@[^<>\s]+)>", text)
        if address:
            rest = (text[: address.start()] + " " + text[address.end() :]).strip(" '\"")
            by_name = self._phrase(rest, value) if re.search(r"\w", rest) else None
            found = by_name or self._domain(address[1].rsplit("@", 1)[1])
        else:
            found = self._phrase(text, value)
        if not found:
            return "none", None, None
        d, near = found
        if len(near) > 1:
            return "ambiguous", None, d
        return ("alias" if d == 0 else "fuzzy"), self.entries[near[0]][0], d

    def _phrase(self, text: str, value: str) -> tuple[int, list[int]] | None:
        # a host among the tokens decides, if the rest names nobody
        tokens = text.split()
        hosts = []
        for t in tokens:
            bare = re.sub(r"^[<\[({'\"]+|[>\])}'\",;.!]+$", "", t)
            m = re.fullmatch(r"(?:[a-z]{3,7}:/{1,3}|mailto:)?(?:[^@\s/]+@)?((?:[a-z0-9_-]+\.)+[a-z0-9]{2,})(?:[:/?#]\S*)?", bare)
            if m and (self._is_tld(m[1].rsplit(".", 1)[-1]) or "@" in bare or "://" in bare or bare.startswith("www.")):
                hosts.append((t, m[1]))
        if len(hosts) == 1:
            others = [w for t in tokens if t != hosts[0][0] for w in _words(t)]
            if all(self._is_decoration(w) for w in others):
                return self._domain(hosts[0][1])
        words = _words(text)
        if not words:
            return None
        singles = sum(len(w) == 1 and w.isalnum() for w in words)
        if singles >= 4 and singles >= len(words) - 4:  # letters set apart
            runs = [w.replace(" ", "") if re.fullmatch(r"(?:\w ){2,}\w", w) or len(w) == 1 else w for w in re.split(r"\s{2,}|(?<=\w\s)(?=\w{2,})", text)]
            words = [x for r in runs for x in _words(r)]
        n = len(words)
        left = 0
        while left < n and self._is_decoration(words[left]):
            left += 1
        right = n
        while right > 0 and self._is_decoration(words[right - 1]):
            right -= 1
        best: tuple[int, list[int]] | None = None
        ends = {*range(max(right, 1), n + 1)} | {j for j in range(max(1, n - 4), n) if self._is_carrier(squash(words[j:]))}
        # only what is as short as an alias; for each beginning these are few, however long the value
        at = [0]
        for w in words:
            at.append(at[-1] + (len(w) if w != "&" else 0))
        stops = sorted(ends)
        cores = sorted(((i, j) for i in range(0, min(left, n - 1) + 1) for j in stops[bisect_right(stops, i) : bisect_right(stops, bisect_right(at, at[i] + self.longest + 3) - 1)]), key=lambda x: (x[0] - x[1], x[0]))
        for want in (0, 3):
            for i, j in cores:
                core = words[i:j]
                got = self._best(squash(core), want)
                if got and self._names_other(core, got):
                    continue
                if got and (best is None or got[0] < best[0]):
                    best = got
                    if got[0] == 0:
                        return best
        if best and best[0] <= 2:
            return best
        for core in [words[left:right] or words, words]:
            if len(core) <= 3 and max(map(len, core)) >= 9 and (got := self._glued(squash(core))):
                if best is None or got[0] < best[0]:
                    best = got
        if best and best[0] <= 2:
            return best
        camel = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode())]
        tries = [words[i:j] for i, j in cores]
        if len(words) <= 2 and len(camel) > 1:
            tries.append(camel)
        for core in tries:
            if not 2 <= len(core) <= 6:
                continue
            for way in self._expansions(core):
                got = self._best(squash(way), 2)
                if got and not self._names_other(way, got) and (best is None or got[0] + 1 < best[0]):
                    best = (got[0] + 1, got[1])
        return best

    def _names_other(self, core: list[str], got: tuple[int, list[int]]) -> bool:
        """Whether the core is an entry's alias and a word more that stands for something else."""
        d, near = got
        if d == 0 or len(core) < 2:
            return False
        entry = [w for w in _words(fold(self.entries[near[0]][0])) if w != "&"]
        plain = [w.translate(_FIGURES) if not w.isdigit() else w for w in core if w != "&"]
        if len(plain) == len(entry):
            gaps = [distance(a, b, 9) for a, b in zip(plain, entry, strict=True)]
            if any(g > (2 if len(b) <= 7 else 3) for g, b in zip(gaps, entry, strict=True)) and sum(gaps) > d - 1 and sum(gaps) <= d + 1:
                return True
        for k, w in enumerate(core):
            rest = squash(core[:k] + core[k + 1 :])
            if len(w) > 1 and len(rest) >= 5 and w != "&" and not self._is_decoration(w) and (hit := self.names.get(rest)) and hit & set(near):
                entry_words = set(_words(fold(self.entries[near[0]][0])))
                if not any(_abbreviates(w, e) or (len(e) > 3 and distance(w, e, 2) <= 2) or (len(w) <= 3 and distance(w, e, 1) <= 1) for e in entry_words):
                    return True
        return False


    def phrases(self, value: str) -> set[tuple[str, int]]:
        """(phrase, entry) of the words on either side of the longest part of a value that is an entry's whole name."""
        words = _words(fold(value))
        best = None
        at = [0]
        for w in words:
            at.append(at[-1] + (len(w) if w != "&" else 0))
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                if at[j] - at[i] > self.longest or (best and j - i <= best[1] - best[0]):
                    if at[j] - at[i] > self.longest:
                        break
                    continue
                hit = self.names.get(squash(words[i:j]))
                if len(hit) == 1:
                    best = (i, j, next(iter(hit)))
        if best is None:
            return set()
        return {(" ".join(part), best[2]) for part in (words[: best[0]], words[best[1] :]) if part and at[best[0]] + at[-1] - at[best[1]] <= 60}


_MATCHERS: dict[int, Matcher] = {}


def matcher(entries: tuple, learned: tuple[str, ...] = ()) -> Matcher:
    """The matcher of a reference list, built once per Python worker."""
    key = hash((entries, learned))
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher([(n, list(d)) for n, d in entries], learned=learned)
    return _MATCHERS[key]


def learn_phrases(df: DataFrame, value: str, entries: tuple) -> tuple[str, ...]:
    """The phrases that stand beside the names of many entries in the values of df, counted over all of them."""
    wide = sum(1 for n, _ in entries if len(_words(fold(n))) > 1)
    least = max(LEAST_ENTRIES, int(wide * ENTRY_SHARE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(entries)
        seen: set[str] = set()
        for batch in batches:
            fresh = set(batch.column("value").drop_null().to_pylist()) - seen
            seen = fresh if len(seen) + len(fresh) > MEMO else seen | fresh
            got = sorted({x for v in fresh for x in m.phrases(v)})
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.string()), pa.array([k for _, k in got], pa.int64())], names=["phrase", "entry"])

    pairs = df.select(F.col(value).alias("value")).where("value is not null").mapInArrow(run, "phrase string, entry bigint")
    often = pairs.distinct().groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("phrase").limit(MOST_PHRASES + 1).collect()
    if len(often) > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases beside the names of the reference list")
    return tuple(sorted(r[0] for r in often))


def reference_entries(reference: DataFrame, name: str, aliases: str, most: int = MAX_REFERENCE) -> tuple:
    """The reference list on the driver, if it is within its bound."""
    rows = reference.where(F.col(name).isNotNull()).select(name, aliases).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the reference list has more than {most} entries")
    return tuple(sorted({(r[0], tuple(d for d in (r[1] or []) if d)) for r in rows}))


def map_to_list(df: DataFrame, keys: list[str], value: str, entries: tuple, unmatched: bool = True) -> DataFrame:
    """(keys…, value, match_status, match, match_distance) of each row; without ``unmatched`` only rows with a match.

    Every distinct value is matched once. The results of the most frequent values, HOT at most, go to the rows by
    broadcast; the other values meet their rows in a join in which no value has more than 1/HOT of the rows.
    """
    spark = df.sparkSession
    path = shared_path(spark, "canonical-list")
    rows = df.select(*keys, F.col(value).alias("value"))
    rows.where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/values")
    values = spark.read.parquet(f"{path}/values")
    learned = learn_phrases(values, "value", entries)
    new = [StructField("match_status", StringType()), StructField("match", StringType()), StructField("match_distance", IntegerType())]
    schema = StructType([*values.schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(entries, learned)
        for batch in batches:
            got = [m.match(v) for v in batch.column("value").to_pylist()]
            cols = [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=["value", "n", "match_status", "match", "match_distance"])

    # matching is the costly part: a task for every few thousand values, at most a few for each core
    spread = min(-(-values.count() // 2000), 4 * spark.sparkContext.defaultParallelism)
    (values.repartition(spread) if spread > 1 else values).mapInArrow(run, schema).write.parquet(f"{path}/matches")
    matches = spark.read.parquet(f"{path}/matches")
    total = matches.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = matches if unmatched else matches.where("match is not null")
    often = F.col("n") * HOT >= total
    names = ["match_status", "match", "match_distance"]
    # All frequent values take part here, matched or not, so that none of them is sent to the join below.
    hot = rows.join(F.broadcast(matches.where(often).drop("n")), "value", "left")
    found = hot.where("match_status is not null" if unmatched else "match is not null")
    rest = hot.where("match_status is null and value is not null").drop(*names).join(wanted.where(~often).drop("n"), "value")
    out = found.unionByName(rest)
    if unmatched:
        nothing = hot.where("value is null").drop(*names).withColumns({"match_status": F.lit("empty"), "match": F.lit(None).cast("string"), "match_distance": F.lit(None).cast("int")})
        out = out.unionByName(nothing)
    return out.select(*keys, "value", *names)


def p4_matches(spark: SparkSession, sf_dir: str, unmatched: bool) -> DataFrame:
    entries = reference_entries(table(spark, sf_dir, "kb"), "brand", "domains")
    rows = table(spark, sf_dir, "req2_llm_classified").select(F.lit("req2_llm_classified").alias("src_table"), F.col("file").alias("rec_key"), F.col("claimed_organization").alias("value"))
    more = table(spark, sf_dir, "decision").select(F.lit("decision").alias("src_table"), F.col("join_key").alias("rec_key"), F.col("claimed_identity").alias("value"))
    both = rows.unionByName(more)
    return map_to_list(both if unmatched else both.where("value is not null and value != ''"), ["src_table", "rec_key"], "value", entries, unmatched)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, rec_key, brand) of values that mean a brand of the knowledge base without being its exact name."""
    return p4_matches(spark, sf_dir, False).where("match_status != 'exact'").select("src_table", "rec_key", F.col("match").alias("brand")).distinct()


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each table matched how, unmatched ones with their count by value."""
    m = p4_matches(spark, sf_dir, True)
    return m.groupBy("src_table", "match_status", F.when(F.col("match").isNull(), F.col("value")).alias("unmatched_value")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
