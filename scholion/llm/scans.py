"""Repair of text from scanned pages: running lines, page numbers, words cut over line ends, misread characters.

A line is a running line or a printed page number if it has the form of one and its paper bears it out: the line recurs in other chunks, page
numbers go on with the pages, or the paper has other noise. A line of no known form is one if it stands at the edge of chunks on several pages.
Headings stay. All lines are counted over the whole corpus, by paper and normalised line.

A frequency lexicon of words, hyphenated words and word pairs is counted over the whole corpus. It keeps the entries above a share of all
tokens, so its size is bounded by that share whatever the corpus. A symmetric-delete index over it gives the candidates for a rare word;
a weighted edit distance, in which pairs of shapes that scanners confuse are cheap, and the word pairs around it choose the repair.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.tables import cut, spread

#: Least share of all tokens of a lexicon entry: at most 1 / SHARE entries of each kind exist. Least count of one, however small the corpus.
SHARE, LEAST = 4e-6, 4
#: How many times as frequent as the word as it stands a repair must be; most edits; most cost of a repair a word.
RATIO, EDITS, COST = 30.0, 2, 0.8
#: Cost of a confused pair of shapes, and of any other edit.
CONFUSED, OTHER = 0.35, 1.0

# Shapes that scanners confuse, as (read, printed).
CONFUSIONS = [
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("b", "h"), ("h", "b"), ("u", "v"), ("v", "u"), ("n", "u"), ("u", "n"), ("o", "c"), ("c", "o"),
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("m", "in"), ("in", "m"), ("m", "ni"), ("vv", "w"), ("w", "vv"), ("h", "li"), ("li", "h"), ("nn", "m"), ("ri", "n"), ("n", "ri"),
]
# Signs that are no letters, as the letters they are read from.
SIGNS = {"@": "a", "|": "l", "0": "o", "1": "l", "5": "s", "9": "g", "6": "b", "8": "b", "$": "s", "€": "e", "£": "e", "!": "l"}
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}

_MARK = "-‐‑¬­"
_BREAK = re.compile(rf"([{_MARK}])[ \t]*\r?\n\s*")
_HEAD, _TAIL = re.compile(r"[^\W_]+(?:[@|]+[^\W_]+)*[@|]?$"), re.compile(r"[^\W\d_][^\W_]*(?:[@|]+[^\W_]+)*[@|]?")


def at_breaks(text: str, mend: Callable[[str, str, str], str]) -> str:
    """The text with each word that a mark cuts over a line end replaced by what ``mend`` makes of its head, mark and tail."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        head = _HEAD.search(text, max(at, m.start() - 60), m.start()) if m.start() > at else None
        tail = _TAIL.match(text, m.end())
        if head and tail:
            out += [text[at : head.start()], mend(head[0], m[1], tail[0])]
            at = tail.end()
    return "".join(out) + text[at:] if out else text


_NUMBER = r"\d[\dOolI|]{0,3}"
_PAGE = re.compile(rf"(?:[Pp][a@]g[ec]\s+{_NUMBER}|{_NUMBER}\s*\|\s*P[a@]g[ec]|[-–—]\s*{_NUMBER}\s*[-–—]|\[\s*{_NUMBER}\s*\]|p\.\s*{_NUMBER}|\d{{1,4}})")
_NUMBER_FIRST, _NUMBER_LAST = re.compile(r"^(\d{1,4})\s{2,}(\S.*)$"), re.compile(r"^(.*\S)\s{2,}(\d{1,4})$")
_ISSUE = re.compile(r", V[o0][l1I|]\. ?[\dOlI|]+, N[o0]\. ?[\dOlI|]+\.?$")
_VOLUME = re.compile(r"^(?:[^\W\d_][\w@|]*(?:\. ?| )){1,14}\d{1,3} ?\((?:1[5-9]|20)\d\d\)$")
_STAMP = re.compile(r"^(?:©|\(c\) ?(?:1[89]|20)\d\d|Sc[a@]nn?[ec]d? (?:at|by|from|@t)\b|Digiti[sz]ed (?:at|by|from)\b|Downloaded from\b)", re.I)
_AND_OTHERS = re.compile(r"^[^!?]{2,60}\b(?:[a@]nd [o0](?:th|tb|fh)[ec]rs?|[ec][tf] [a@][l1|]\.?) ?[·•] ?\S.{0,80}$")
_TWO_LETTERS = re.compile(r"[^\W\d_]{2}")
# what any of the lines above has: a number at an end, a sign, a volume, a year, a stamp's first letters, or no lower-case letter
_MAYBE = re.compile(r"\d\W*$|^\W*\d|P[a@]g[ec]|[·•©]|V[o0][l1I|]\.|^(?:S[cC]|D[ioIO]|\([cC])|^p\.|^[^a-zà-öø-ÿ]*$")
# Usual headings of papers by their letters; a line of capitals that is one of them stays.
HEADINGS = frozenset(
    "abstract summary introduction background relatedwork method methods materialsandmethods methodology data dataandmethods experiments experimentalsetup result results resultsanddiscussion discussion conclusion conclusions "
    "conclusionsandoutlook outlook acknowledgement acknowledgements acknowledgment acknowledgments references bibliography appendix keywords limitations funding dataavailability conflictofinterest authorcontributions supplementarymaterial".split()
)
_HEADING = re.compile(r"^(?:\d+(?:\.\d+)*\.? |#|Table |Fig|[-*•] )")


def running(line: str) -> bool:
    """Whether a line (without a page number) is a running header, a footer or a stamp of the scan."""
    if "|" in line[:1] or len(line) > 110 or _HEADING.match(line):
        return False
    if _STAMP.match(line) or _ISSUE.search(line) or _AND_OTHERS.match(line):
        return True
    if _VOLUME.match(line) and ("." in line or line[:1].isupper()) and not re.search(r"\b(?:the|of the|in|et al)\b", line):
        return True
    letters = [c for c in line if c.isalpha()]
    return len(letters) >= 3 and not any(c.islower() for c in letters) and len(line) <= 70 and bool(re.search(r"[^\W\d_]{3}", line)) and not re.search(r"[=\\{}]", line)


_DIGITS = str.maketrans({"O": "0", "S": "5", "l": "1", "|": "1", "I": "1"})


_INNER = re.compile(r"(?<=[^\W\d_])[" + re.escape("".join(SIGNS)) + r"](?=[^\W\d_])")


def _letters(line: str) -> str:
    """A line for comparison: its letters, with signs inside words as the letters they are read from."""
    return "".join(c for c in _INNER.sub(lambda m: SIGNS[m[0]], line.lower()) if c.isalpha())


_EDGE_LEAST, _EDGE_MOST = 6, 110


def noise_lines(text: str, page: int | None = None, title: str = "") -> tuple[list[str], list[tuple[int, str, str, bool]]]:
    """(lines, candidates): of each line that may be noise its place, kind, what follows a page number in it, and whether there is one.

    The kind is a key by which the line is counted in its paper: ``s:`` a stamp of the scan, ``r:`` a running line by its letters, ``p:`` a
    page number by its form and how far it is from the page, ``e:`` a line of no form at an edge of the text. Headings, which are the
    chunk's own title or a usual one in ``HEADINGS``, are none.
    """
    if "\n" not in text and "\x0c" not in text and len(text) > 200:
        return [text], []
    lines, out = re.split(r"\r?\n|\x0c", text), []
    filled = [i for i, x in enumerate(lines) if x.strip()]
    edges = {filled[0], filled[-1]} if len(filled) > 1 else set()
    own = {_letters(title)} if title else set()
    mostly: bool | None = None
    for i in filled:
        s = lines[i].strip()
        if _MAYBE.search(s):
            if _PAGE.fullmatch(s) and not _in_table(lines, i):
                number = "".join(c for c in s.translate(_DIGITS) if c.isdigit())
                form = re.sub(r"\d+", "#", s.translate(_DIGITS))
                out.append((i, f"p:{form}:{int(number) - page if page is not None and number else ''}", "", True))
                continue
            found, rest = False, s
            for pattern, part in ((_NUMBER_FIRST, 2), (_NUMBER_LAST, 1)):
                m = pattern.match(s)
                if m and running(m[part].strip()):
                    found, rest = True, m[part].strip()
            capital = bool(_TWO_LETTERS.search(lines[i])) and lines[i].upper() == lines[i]
            if capital and mostly is None:  # a text in capitals has no running lines of this form
                capitals = sum(bool(_TWO_LETTERS.search(x)) and x.upper() == x for x in lines)
                mostly = capitals > 2 and capitals > 0.5 * len(filled)
            letters = _letters(rest)
            if (found or running(rest)) and not (capital and mostly):
                if found or not (letters in HEADINGS or letters in own):
                    out.append((i, ("s:" if _STAMP.match(rest) else "r:") + letters, rest, found))
                continue
            if capital and mostly or re.fullmatch(r"\S+ {2}\d+", s):
                continue
        if i in edges and len(s) <= _EDGE_MOST and not _HEADING.match(s) and s[:1] != "|" and not re.search(r"[.!?:;,…][\"'”’)]*$|[=\\{}|]", s):
            letters = _letters(s)
            if len(letters) >= _EDGE_LEAST and letters not in HEADINGS and letters not in own:
                out.append((i, "e:" + letters, s, False))
    return lines, out


def without_lines(text: str, accepted: frozenset[str] | None = None, page: int | None = None, title: str = "") -> tuple[str, set[str]]:
    """The text without running lines and printed page numbers, and the kinds of them that it had.

    ``accepted`` holds the keys of the lines that their paper bears out; without it every line of a known form counts.
    """
    lines, found = noise_lines(text, page, title)
    kinds: set[str] = set()
    drop = set()
    for i, key, rest, number in found:
        if accepted is None and key[0] == "e" or accepted is not None and key not in accepted:
            continue
        drop.add(i)
        if key[0] == "p":
            kinds.add("page_number")
            continue
        kinds.add("running_line")
        if number:
            kinds.add("page_number")
        if _odd_word(rest):
            kinds.add("misread")
    return ("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text), kinds


def _in_table(lines: list[str], i: int) -> bool:
    near = [x.strip() for x in lines[max(0, i - 1) : i] + lines[i + 1 : i + 2]]
    return any(x.startswith("|") or re.fullmatch(r"\S+ {2}\d+", x) for x in near)


def _odd_word(line: str) -> bool:
    """Whether a running line has a sign inside a word where its letters want a letter."""
    return bool(re.search(r"[^\W\d_][@|]|[@|][^\W\d_]|[^\W\d_][015][^\W\d_]|\b0[A-Za-z]+\b|\b[A-Za-z]{2,}[01]\b(?=[.,]? )|[ﬁﬂﬀ]", line)) and not re.fullmatch(r".*[A-Z]\d{2}:?.*", line) or bool(re.search(r"\bV[o0][1|]\.|\bN0\.|\b0[NFR]\b|[A-Z]0[A-Z]", line))


_TOKEN = re.compile(r"[@|]?[^\W_]+(?:[@|]+[^\W_]+)*[@|]?")
_CODE = re.compile(r"[A-Za-z]*\d+[A-Za-z]*")


def tokens(text: str) -> list[re.Match]:
    return list(_TOKEN.finditer(text))


_PLAIN = re.compile(r"(?<![\w@|])[^\W\d_]+(?![\w@|])")
_RUN = re.compile(r"(?<![\w@|])[^\W\d_]+(?: [^\W\d_]+)+(?![\w@|])")
_HYPHENED = re.compile(r"(?<![\w@|])[^\W\d_]+-[^\W\d_]+(?![\w@|])")


def count_into(text: str, words: Counter, hyphened: Counter, pairs: Counter) -> None:
    """Add the words, hyphenated words and pairs of words a space apart of a text without noisy lines; words broken over line ends are left out."""
    body = at_breaks(text, lambda *_: " ").lower()
    words.update(_PLAIN.findall(body))
    if "-" in body:
        hyphened.update(_HYPHENED.findall(body))
    for run in _RUN.findall(body):
        ws = run.split(" ")
        pairs.update(zip(ws, ws[1:]))


class Lexicon:
    """Counts of words, hyphenated words and pairs above the share, with a symmetric-delete index over the words that aren't doubtful."""

    def __init__(self, words: dict[str, int], hyphened: dict[str, int], pairs: dict[str, int], least: int, doubtful: frozenset[str] = frozenset(), rare: dict[str, int] | None = None) -> None:
        self.least, self.hyphened, self.pairs, self.rare = least, hyphened, pairs, rare or {}
        self.index: dict[str, list[str]] = defaultdict(list)
        self.words = words
        self.common = {w for w, n in words.items() if n >= least and w not in doubtful}
        for w in self.common:
            if len(w) >= 3:
                for d in _deletes(w, EDITS if len(w) > 4 else 1):
                    self.index[d].append(w)
        self.repair = lru_cache(200_000)(self._repair)

    def candidates(self, word: str) -> list[tuple[float, int, str]]:
        """(cost, -count, candidate) of the common words within reach of ``word``, best first."""
        found = set()
        for d in _deletes(word, EDITS if len(word) > 3 else 1):
            found.update(self.index.get(d, ()))
        found.discard(word)
        out = [(c, -self.words[f], f) for f in found if abs(len(f) - len(word)) <= 2 for c in [weighted_distance(word, f)] if c <= COST]
        return sorted(out)

    def _repair(self, word: str, before: str, after: str) -> str | None:
        """The printed form of a misread lower-case word, or None if it is to stay."""
        plain = "".join(LIGATURES.get(c, c) for c in word)
        signs = "".join(SIGNS.get(c, c) for c in plain)
        own = self.words.get(word) or self.rare.get(word, 0)
        digits = sum(c.isdigit() for c in word)
        if digits and (len(plain) - digits < 2 or len(plain) - digits <= digits) and not (len(word) == 2 and "0" in word and signs in self.common):
            return None  # a code, not a word
        if plain != word or signs != plain:
            if signs in self.common or not signs.isalpha() and any(c in "@|" for c in word):
                return signs
            if plain != word and signs == plain:
                return plain
            found = self.candidates(signs) if signs.isalpha() else []
            if found and found[0][0] <= CONFUSED:
                return found[0][2]
            if "@" in word or "|" in word:
                return signs if sum(c.isalpha() for c in word) >= 2 else None
            inner = re.search(r"[^\W\d_][0159][^\W\d_]", word)
            return signs if inner and sum(c.isalpha() for c in word) >= 3 and sum(c.isdigit() for c in word) <= 2 and signs.isalpha() else None
        if len(word) < 3 or not word.isalpha():
            return None
        best = None
        for cost, count, f in self.candidates(word):
            context = self.pairs.get(f"{before} {f}", 0) + self.pairs.get(f"{f} {after}", 0)
            here = self.pairs.get(f"{before} {word}", 0) + self.pairs.get(f"{word} {after}", 0)
            if -count < RATIO * max(own, 0.5) or own >= self.least and context <= RATIO * here:
                continue
            if len(word) <= 4 and not context > RATIO * here:
                continue
            rank = (cost - min(0.3, 0.1 * (context > 0)), count, f)
            if best is None or rank < best:
                best = rank
        return best[2] if best else None

    def broken(self, head: str, tail: str, mark: str) -> bool:
        """Whether the mark between the two parts of a word over a line end isn't part of the word."""
        a, b = head.lower(), tail.lower()
        whole, hyphen = self.words.get(a + b, 0), self.hyphened.get(f"{a}-{b}", 0)
        if whole or hyphen:
            return whole >= hyphen
        if mark in "¬­" or not tail[:1].islower():
            return mark in "¬­" or tail[:1].islower()
        if self.repair(a + b, "", ""):
            return True
        if b in ("and", "or"):
            return False
        fixed = (self.repair(a, "", "") or a, self.repair(b, "", "") or b)
        if self.hyphened.get("-".join(fixed), 0):
            return False
        return not (len(a) >= 3 and len(b) >= 3 and all(x in self.common for x in fixed))

    def gap(self, a: str, b: str) -> bool:
        """Whether two words side by side are one word with a gap inside."""
        whole = a + b
        if whole not in self.common or a in self.common and b in self.common and len(a) > 2 and len(b) > 2 and self.pairs.get(f"{a} {b}", 0):
            return False
        n = self.words[whole]
        return n >= RATIO * max(0.5, self.pairs.get(f"{a} {b}", 0)) and (a not in self.common or b not in self.common or len(a) <= 2 or len(b) <= 2 or self.pairs.get(f"{a} {b}", 0) == 0)


@lru_cache(100_000)
def _deletes(word: str, most: int) -> frozenset[str]:
    out, edge = {word}, {word}
    for _ in range(most):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        out |= edge
    return frozenset(out)


_PAIRS: dict[str, list[str]] = defaultdict(list)
for _read, _printed in CONFUSIONS:
    _PAIRS[_read].append(_printed)


def weighted_distance(read: str, printed: str) -> float:
    """Cheapest way from the word as read to the word as printed: confused shapes cost CONFUSED, other inserted, lost or changed letters OTHER."""
    n, m = len(read), len(printed)
    best = [[float("inf")] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n + 1):
        row = best[i]
        for j in range(m + 1):
            here = row[j]
            if here > COST:
                continue
            if i < n and j < m:
                step = 0.0 if read[i] == printed[j] else OTHER
                best[i + 1][j + 1] = min(best[i + 1][j + 1], here + step)
            if i < n:
                best[i + 1][j] = min(best[i + 1][j], here + OTHER)
            if j < m:
                row[j + 1] = min(row[j + 1], here + OTHER)
            for k in (1, 2):
                if i + k <= n:
                    for to in _PAIRS.get(read[i : i + k], ()):
                        if printed.startswith(to, j):
                            best[i + k][j + len(to)] = min(best[i + k][j + len(to)], here + CONFUSED)
    return best[n][m]


_NUMERIC = re.compile(r"(?=.*[OSl|I])[\dOSl|I]+")


def misread_number(word: str, before: str, after: str) -> str | None:
    """The number that a word of digits and letters of their shape stands for; litres after a number and single capitals are none."""
    if not _NUMERIC.fullmatch(word) or not re.search(r"[a-z,]\s$|^$|\s[(]$", before) or not re.match(r"\s[a-z]|\.\d|\)", after):
        return None
    digits = sum(c.isdigit() for c in word)
    if re.fullmatch(r"\d+l", word) and re.match(r"\sper\b|[).]", after) or digits == 0 and word not in ("ll", "l", "S", "O", "lO", "lS", "SO", "SS", "Sl"):
        return None
    return word.translate(_DIGITS)


def _cased(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def repaired(text: str, lexicon: Lexicon, accepted: frozenset[str] | None = None, page: int | None = None, title: str = "") -> tuple[str, set[str]]:
    """The text with its noise repaired, and the kinds of noise it had; a text without noise comes back as it is."""
    body, kinds = (text, set()) if accepted is not None and not accepted else without_lines(text, accepted, page, title)

    def mend(head: str, mark: str, tail: str) -> str:
        if lexicon.broken(head, tail, mark):
            kinds.add("hyphen")
            return head + tail
        return head + mark + tail

    body = at_breaks(body, mend)
    common = lexicon.common
    if all(w in common and len(w) > 1 or w.isascii() and w.isdigit() for w in set(_TOKEN.findall(body.lower()))):
        return (body if kinds else text), kinds  # nothing but usual words
    out, at, found = [], 0, tokens(body)
    lower = [m[0].lower() for m in found]
    skip = -1
    for i, m in enumerate(found):
        if i <= skip:
            continue
        w = lower[i]
        if w in common and len(w) > 1 and (i + 1 == len(found) or lower[i + 1] in common):
            continue  # the usual case
        if w.isascii() and w.isdigit():
            continue
        number = misread_number(m[0], body[max(0, m.start() - 2) : m.start()], body[m.end() : m.end() + 6])
        if number:
            kinds.add("misread")
            out += [body[at : m.start()], number]
            at = m.end()
            continue
        if w not in lexicon.common and i + 1 < len(found) or w.isalpha() and i + 1 < len(found) and lower[i + 1] not in lexicon.common:
            nxt = found[i + 1]
            space = body[m.end() : nxt.start()]
            if (space == " " or space in ("\n", "\r\n") and not (w in lexicon.common and lower[i + 1] in lexicon.common)) and w.isalpha() and lower[i + 1].isalpha() and nxt[0].islower() and lexicon.gap(w, lower[i + 1]):
                kinds.add("misread")
                out += [body[at : m.start()], m[0] + nxt[0]]
                at, skip = nxt.end(), i + 1
                continue
        if w in lexicon.common:
            continue
        if w.isalpha() and w.isascii() and m[0][:1].isupper() and i and not re.search(r"[.!?:]\s*$|^\s*$|\n\s*$", body[max(0, m.start() - 3) : m.start()]) and not m[0].isupper():
            continue  # a name within a sentence
        to = lexicon.repair(w, lower[i - 1] if i else "", lower[i + 1] if i + 1 < len(found) else "")
        if to:
            kinds.add("misread")
            out += [body[at : m.start()], _cased(to, m[0])]
            at = m.end()
    body = "".join(out) + body[at:]
    return (body if kinds else text), kinds


def reflowed(text: str) -> str:
    """Lines of one paragraph joined; tables, lists and headings keep their lines."""
    out = []
    for paragraph in re.split(r"\n[ \t\r]*(?:\n[ \t\r]*)+", text):
        lines: list[str] = []
        for line in paragraph.split("\n"):
            s = line.strip()
            if not s:
                continue
            if lines and not _HEADING.match(s) and s[:1] != "|" and not re.fullmatch(r"\S+ {2}\d+", s) and not re.match(r"(?:\d+(?:\.\d+)*\.? [A-Z ]+$|#|Table )", lines[-1]) and lines[-1][:1] != "|":
                lines[-1] += s if re.search(r"\w-$", lines[-1]) and s[:1].islower() else " " + s
            else:
                lines.append(s)
        out.append("\n".join(lines))
    # a paragraph that goes on after a page's end is joined again
    joined: list[str] = []
    for p in (p for p in out if p):
        if joined and p[:1].islower() and not re.search(r"[.!?:]$", joined[-1]):
            joined[-1] += " " + p
        else:
            joined.append(p)
    return "\n\n".join(joined)


def surveyed(taken: DataFrame) -> DataFrame:
    """One pass over all texts (row, text, paper, unit, page, title): counts of words, hyphenated words and pairs, and the lines that may be noise.

    The result has ``kind`` ``w``, ``h`` or ``b`` with ``key`` and ``n``, pre-aggregated batch by batch, or ``l`` with a line's ``key`` and its
    row, paper, unit and page. Lines that have the form of noise are not counted.
    """
    columns = ["kind", "key", "n", "row", "paper", "unit", "page"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, h, p = Counter(), Counter(), Counter()

        def flush() -> pd.DataFrame:
            rows = [("w", k, n) for k, n in w.items()] + [("h", k, n) for k, n in h.items()] + [("b", f"{x} {y}", n) for (x, y), n in p.items()]
            for c in (w, h, p):
                c.clear()
            return pd.DataFrame(rows, columns=columns[:3]).reindex(columns=columns).astype({"n": "Int64", "row": "Int64", "page": "Int32", "paper": object, "unit": object})

        for b in batches:
            rows = []
            for row, t, who, part, at, name in b[["row", "text", "paper", "unit", "page", "title"]].itertuples(index=False, name=None):
                place = int(at) if at == at and at is not None else None
                lines, found = noise_lines(t, place, name)
                drop = {i for i, k, _, _ in found if k[0] != "e"}
                count_into("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else t, w, h, p)
                keys = {k for _, k, _, _ in found}
                if "\n" in t and _BREAK.search(t):
                    keys.add("h:")
                rows += [("l", k, 1, row, who, part, place) for k in keys]
            if rows:
                yield pd.DataFrame(rows, columns=columns).astype({"n": "Int64", "row": "Int64", "page": "Int32"})
            if len(w) + len(p) > 400_000:
                yield flush()
        yield flush()

    return cut(spread(taken.select("row", "text", "paper", "unit", "page", "title")).mapInPandas(run, "kind string, key string, n long, row long, paper string, unit string, page int"))


def build_lexicon(survey: DataFrame, share: float = SHARE) -> tuple[DataFrame, tuple[dict, dict, dict, int]]:
    """(counts, lexicon parts) of a survey of all texts: counts are summed, and only entries above the share are gathered.

    As counts add up to the number of tokens, fewer than 1 / ``share`` entries of each kind can be above it: the result is bounded. Shares,
    and so what is repaired, do not change with the size of the corpus.
    """
    counts = cut(survey.where("kind <> 'l'").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    total = counts.where("kind = 'w'").agg(F.sum("n")).first()[0] or 0
    least = max(LEAST, int(total * share))
    parts: dict[str, dict[str, int]] = {"w": {}, "h": {}, "b": {}}
    for r in counts.where(F.col("n") >= least).toLocalIterator():
        parts[r["kind"]][r["key"]] = r["n"]
    return counts, (parts["w"], parts["h"], parts["b"], least)


def doubtful(lexicon: Lexicon, words: list[str]) -> list[str]:
    """Of the given common words those for which a far more common one is a confused shape away: they are judged in context."""
    return [w for w in words if any(-n >= RATIO * lexicon.words[w] for _, n, _ in lexicon.candidates(w))]


def judged_words(counts: DataFrame, parts: tuple[dict, dict, dict, int]) -> tuple[frozenset[str], dict[str, int]]:
    """(doubtful words of the lexicon, true counts of rarer words that have a common word within reach), looked for in parallel.

    A rarer word's count matters from LEAST occurrences on, and where a common word is not RATIO times as frequent as the lexicon's least:
    such words have a share of at least SHARE / RATIO, which bounds their number.
    """
    least = parts[3]
    shared = counts.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(*shared.value)
        for b in batches:
            rows = []
            for w, n in zip(b["key"], b["n"]):
                if n < least:
                    if lexicon.candidates(w):
                        rows.append((w, int(n)))
                elif w in lexicon.common and doubtful(lexicon, [w]):
                    rows.append((w, -1))
            yield pd.DataFrame(rows, columns=["w", "n"])

    words = counts.where((F.col("kind") == "w") & (F.col("n") >= max(LEAST, least / RATIO))).select("key", "n")
    tasks = max(1, min(64, len(parts[0]) // 500))
    found = [(r["w"], r["n"]) for r in words.repartition(tasks, "key").mapInPandas(run, "w string, n long").toLocalIterator()]
    return frozenset(w for w, n in found if n < 0), {w: n for w, n in found if n >= 0}


#: Chunks of a paper in which a line recurs, pages on which a line of no form stands at an edge, and kinds of noise of which one bears out the other.
RECURS, EDGE_PAGES, OTHERS = 2, 3, 2


def borne_out(lines: DataFrame) -> DataFrame:
    """``(row, accepted)``: the keys of each row's lines that their paper bears out, from (row, paper, unit, page, key, none of them null but page).

    A stamp stands for itself; a line or page number counts if its key is in RECURS units of the paper or the paper has OTHERS different keys
    of noise; a line of no form if it is on EDGE_PAGES pages. Units and pages are counted by key, so no paper is gathered.
    """
    known = lines.where("key not like 'e:%'")
    by_key = lines.select("paper", "key", "unit").distinct().groupBy("paper", "key").agg(F.count(F.lit(1)).alias("units"))
    pages = lines.where("key like 'e:%' and page is not null").select("paper", "key", "page").distinct().groupBy("paper", "key").agg(F.count(F.lit(1)).alias("pages"))
    others = known.select("paper", "key").distinct().groupBy("paper").agg(F.count(F.lit(1)).alias("others"))
    told = by_key.join(pages, ["paper", "key"], "left").join(others, "paper", "left")
    edge = F.col("key").startswith("e:")
    good = F.when(edge, F.coalesce("pages", F.lit(0)) >= EDGE_PAGES).otherwise(F.col("key").startswith("s:") | (F.col("units") >= RECURS) | (F.coalesce("others", F.lit(0)) >= OTHERS))
    return lines.select("row", "paper", "key").distinct().join(told.where(good).select("paper", "key"), ["paper", "key"], "left_semi").groupBy("row").agg(F.collect_set("key").alias("accepted"))


def repair_scans(chunks: DataFrame, key: str = "id", text: str = "text", paper: str | None = None, unit: str | None = None, page: str | None = None, title: str | None = None) -> DataFrame:
    """``(key, repaired, kinds)`` for every non-null text; ``kinds`` is an array, empty where the text has no noise and stays as it is.

    ``paper`` names the document of a text, ``unit`` the chunk (repeated deliveries have the same), ``page`` and ``title`` its place; where
    they are not given or null a text is a paper of its own. Empty texts stay empty; repeated rows are repaired each; very long texts are
    handled whole, where they are read. The lexicon is a broadcast of bounded size (see :func:`build_lexicon`).
    """
    kind = chunks.schema[key].dataType.simpleString()
    column = lambda c, type_: (F.col(c) if c else F.lit(None)).cast(type_)
    lone = F.concat(F.lit("row "), F.xxhash64(key).cast("string"))
    taken = chunks.where(F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(key).alias("row"), F.coalesce(column(paper, "string"), lone).alias("paper"), F.coalesce(column(unit, "string"), lone).alias("unit"), column(page, "int").alias("page"), F.coalesce(column(title, "string"), F.lit("")).alias("title"),
    )

    survey = surveyed(taken)
    accepted = borne_out(survey.where("kind = 'l'"))
    counts, parts = build_lexicon(survey)
    shared = chunks.sparkSession.sparkContext.broadcast((*parts, *judged_words(counts, parts)))
    both = spread(taken.join(accepted, "row", "left").select("key", "text", "page", "title", "accepted"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(*shared.value)
        for b in batches:
            rows = []
            for k, t, at, name, ok in zip(b["key"], b["text"], b["page"], b["title"], b["accepted"]):
                new, kinds = repaired(t, lexicon, frozenset(ok if ok is not None else ()), int(at) if at == at and at is not None else None, name)
                rows.append((k, new, sorted(kinds)))
            yield pd.DataFrame(rows, columns=["key", "repaired", "kinds"])

    return both.mapInPandas(run, f"key {kind}, repaired string, kinds array<string>").withColumnRenamed("key", key)


def repair_chunks(chunks: DataFrame) -> DataFrame:
    """``(id, text, kinds)``: repaired and reflowed text of the chunks of scanned papers, all other text as it is.

    A paper counts as scanned if any of its chunks has noise; a chunk without a paper is judged by itself.
    """
    own = F.coalesce("paper_id", F.concat(F.lit("chunk "), F.col("id").cast("string")))
    found = repair_scans(chunks.withColumn("of", F.struct("id", own.alias("paper"))), "of", "text", "paper_id", *(c if c in chunks.columns else None for c in ("chunk_id", "page_number", "section_title")))
    found = found.select("of.id", "of.paper", "repaired", "kinds")
    scanned = found.where(F.size("kinds") > 0).select("paper").distinct().withColumn("scanned", F.lit(True))
    flow = F.pandas_udf(lambda s: s.map(reflowed), "string")
    both = found.join(scanned, "paper", "left")
    return both.select("id", F.when(F.col("scanned"), flow("repaired")).otherwise(F.col("repaired")).alias("text"), "kinds")
