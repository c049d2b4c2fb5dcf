"""Mapping of freely typed values to the entries of a reference list: token repair, then soft TF-IDF over complete entries.

Each distinct token is joined to the vocabulary of the reference list: by itself, by edit distance (through a symmetric-delete index), or as
the abbreviation of a word. The repaired tokens are combined by soft TF-IDF to rank the entries that share a word with the value, and of
these an entry is taken only if every word of the value and every word of the entry has its partner: values that merely resemble an entry
denote none. Values, tokens, words and entries are tables that are joined on equal keys; the reference list may have any size.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.language import plain, repaired
from scholion.tables import cut, fanned

#: Least similarity of a token and the word it is taken for; the similarity of an abbreviation and of a lost space.
ABBREVIATED, JOINED = 0.85, 0.9
# Words that titles have or lack without changing what they denote.
PARTICLES = frozenset("of the on in for and und et y e des der die das fur fuer de la le di".split())

_LEAD = re.compile(r"^(?:(?:published|appeared|to appear|printed|accepted|presented|reprinted|forthcoming) (?:in|at|by)|in|the)\b[:\s]+", re.I)
_NOTE = re.compile(r"\s*[\[(](?!\s*\d+\s*[\])]\s*$)[^\[\]()]*[\])]\s*")
_WORD = re.compile(r"[^\W_]+")


def cleaned(value: str) -> str:
    """The value without damage, markup, notes in brackets and what comes before or after a name: volume, pages, year, publisher."""
    s = html.unescape(html.unescape(repaired(value))).replace(" ", " ")
    s = re.split(r"\s+/\s+|\s+\|\s+", s)[0]
    s = _NOTE.sub(" ", s).strip(" \t\r\n\"'“”„«»*.,;:/-–—")
    for _ in range(3):
        before = s
        s = _LEAD.sub("", s)
        s = _tail_cut(s)
        if s == before:
            break
    return s


def _tail_cut(s: str) -> str:
    m = re.search(r"[\s,;:.\-–—/]+(?:vol|volume|v|no|nr|issue|iss|pp|p|issn)\b\.?\s*:?\s*[\dxX]+(?:\s*[-–(:/,]\s*\w*\.?\s*\d*\)?)*\s*$", s, re.I)
    if m:
        return s[: m.start()]
    m = re.search(r"[\s,;:\-–—]+\(?\d[\d\s()\-–:/,.]*$", s)
    if m and m.start() > 0:
        return s[: m.start()]
    return re.sub(r"[\s,;:\-–—]+(?:online|print|in press)$", "", s, flags=re.I).strip(" .,;:")


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with swapped neighbours, or ``most`` + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        prev2, prev = prev, row
    return prev[-1]


def allowed(word: str) -> int:
    """Most edits in a word of that length."""
    return 0 if len(word) <= 3 else 1 if len(word) <= 5 else 2


class Reference:
    """Vocabulary, postings and inverse frequencies of a reference list: (key, name) pairs."""

    def __init__(self, entries: list[tuple[str, str]], publishers: list[str] = ()) -> None:
        names = {(key, tuple(self.words(name))) for key, name in entries if key and name and name.strip()}
        self.entries = sorted((k, w) for k, w in names if w)
        self.most_words = max((len(words) for _, words in self.entries), default=0)
        count = Counter(w for _, words in self.entries for w in set(words))
        self.longest = max(map(len, [*count, *PARTICLES]))
        self.idf = {w: math.log(1 + len(self.entries) / n) for w, n in count.items()}
        self.postings: dict[str, list[int]] = defaultdict(list)
        self.deletes: dict[str, set[str]] = defaultdict(set)
        self.prefixes: dict[str, set[str]] = defaultdict(set)
        for i, (_, words) in enumerate(self.entries):
            for w in set(words):
                self.postings[w].append(i)
        for w in list(self.idf) + sorted(PARTICLES):
            for d in _deleted(w, allowed(w)):
                self.deletes[d].add(w)
        for w in self.idf:
            for n in range(1, len(w)):
                self.prefixes[w[:n]].add(w)
        self.initials: dict[str, set[str]] = defaultdict(set)
        for key, words in self.entries:
            self.initials["".join(w[0] for w in words)].add(key)
        self.publishers = sorted({plain(p).strip() for p in publishers if p and p.strip()}, key=len, reverse=True)
        self.candidates = lru_cache(100_000)(self._candidates)
        self.norms = [math.sqrt(sum(self.idf[w] ** 2 for w in words)) for _, words in self.entries]

    @staticmethod
    def words(name: str) -> list[str]:
        """Content words of a name; particles only count where nothing else is left."""
        all_words = _WORD.findall(plain(html.unescape(repaired(name))))
        return [w for w in all_words if w not in PARTICLES] or all_words

    def _candidates(self, token: str) -> dict[str, float]:
        """Words that a token may stand for, with similarities."""
        out: dict[str, float] = {}
        if token in self.idf:
            out[token] = 1.0
        else:
            for k in cuts(token, self.longest) if len(token) > 4 else ():
                if token[:k] in self.idf and token[k:] in self.idf:
                    out[token[:k] + " " + token[k:]] = JOINED
            for d in _deleted(token, 2 if len(token) > 5 else 1) if len(token) <= self.longest + 2 else ():
                for w in self.deletes.get(d, ()):
                    e = osa(token, w, allowed(w))
                    if e <= allowed(w):
                        out[w] = max(out.get(w, 0), 1 - e / max(len(w), 1) / 2)
        for w in self.prefixes.get(token, ()):
            out.setdefault(w, ABBREVIATED)
        return out

    def tokens(self, value: str) -> list[str]:
        """Tokens of a cleaned value without particles; words that lost their space are cut, words with a gap joined."""
        raw = _WORD.findall(plain(value))
        out: list[str] = []
        i = 0
        while i < len(raw):
            t = raw[i]
            if t in PARTICLES and t not in self.idf:
                i += 1
                continue
            if not self.candidates(t):
                if i + 1 < len(raw) and t + raw[i + 1] in self.idf:
                    out.append(t + raw[i + 1])
                    i += 2
                    continue
                cut = self._cut(t)
                if cut is not None:
                    out += cut
                    i += 1
                    continue
                if len(t) > 1 and any(osa(t, p, 1) <= 1 for p in PARTICLES if len(p) > 2):
                    i += 1
                    continue
            out.append(t)
            i += 1
        return out

    def _cut(self, token: str) -> list[str] | None:
        """Two words run together, either of them possibly a particle, and one of them possibly misspelt."""
        best = None
        for k in cuts(token, self.longest):
            a, b = token[:k], token[k:]
            sims = []
            for x in (a, b):
                if x in self.idf or x in PARTICLES:
                    sims.append(1.0)
                elif len(x) > 3:
                    found = [s for w, s in self.candidates(x).items() if s not in (ABBREVIATED, JOINED)]
                    sims.append(max(found, default=0))
                else:
                    sims.append(0)
            if min(sims) > 0 and max(sims) == 1.0 and (best is None or sum(sims) > best[0]):
                best = (sum(sims), [x for x in (a, b) if x not in PARTICLES])
        return best[1] if best else None

    def rank(self, tokens: list[str]) -> list[tuple[float, str]]:
        """(soft TF-IDF, key) of the entries that share all their words with the tokens, best first."""
        if not tokens or len(tokens) > self.most_words:
            return []
        sims: list[dict[str, float]] = []
        flat: list[str] = []
        for t in tokens:
            found = self.candidates(t)
            if not found:
                return []
            joined = [w for w in found if " " in w]
            if joined and len(found) == len(joined):
                for w in joined[0].split(" "):
                    sims.append({w: JOINED})
                    flat.append(w)
            else:
                sims.append({w: s for w, s in found.items() if " " not in w})
                flat.append(t)
        rarest = min(sims, key=lambda c: sum(len(self.postings.get(w, ())) for w in c))
        near = {i for w in rarest for i in self.postings.get(w, ())}
        out: dict[str, float] = {}
        for i in near:
            key, words = self.entries[i]
            if len(words) != len(sims):
                continue
            score = self._cover(sims, words)
            if score is None:
                continue
            norm = math.sqrt(sum(max(self.idf.get(w, 0) for w in c) ** 2 for c in sims)) or 1.0
            out[key] = max(out.get(key, 0), score / (norm * self.norms[i]))
        return sorted(((s, k) for k, s in out.items()), key=lambda x: (-x[0], x[1]))

    def _cover(self, sims: list[dict[str, float]], words: tuple[str, ...]) -> float | None:
        """Sum of the similarities, weighted by inverse frequency, of a matching of all tokens and all words; None if there is none."""
        if all(w in c for c, w in zip(sims, words)):
            return sum(c[w] * self.idf[w] ** 2 for c, w in zip(sims, words))
        free = list(words)

        def place(k: int) -> float | None:
            if k == len(sims):
                return 0.0
            best = None
            for w in sorted({w for w in free if w in sims[order[k]]}):
                free.remove(w)
                rest = place(k + 1)
                free.append(w)
                if rest is not None:
                    got = rest + 0.98 * sims[order[k]][w] * self.idf[w] ** 2
                    best = got if best is None else max(best, got)
            return best

        order = sorted(range(len(sims)), key=lambda i: sum(w in sims[i] for w in words))
        if any(not any(w in c for w in words) for c in sims):
            return None
        return place(0)

    def resemblance(self, tokens: list[str]) -> float:
        """Best soft TF-IDF of any entry that shares a word with the tokens, however many of their words have no partner."""
        best: dict[str, float] = {}
        for t in tokens:
            for w, x in self.candidates(t).items():
                if w in self.idf:
                    best[w] = max(best.get(w, 0.0), x)
        norm = math.sqrt(sum(max((self.idf.get(w, 0.0) for w in self.candidates(t)), default=1.0) ** 2 for t in tokens))
        near = {i for w in best for i in self.postings.get(w, ())}
        full = lambda words: math.sqrt(sum(self.idf.get(w, 1.0) ** 2 for w in words))
        return max((sum(best.get(w, 0.0) * self.idf.get(w, 0.0) ** 2 for w in self.entries[i][1]) / (norm * full(self.entries[i][1]) or 1.0) for i in near), default=0.0)

    def denoted(self, value: str) -> tuple[str | None, float]:
        """Key of the entry that a value denotes and its score; (None, best score) if it denotes none, or several alike."""
        if not value or not value.strip():
            return None, 0.0
        s = cleaned(value)
        ends = dict(endings(s))
        s = without_ending(s, next((len(p) for p in self.publishers if p in ends), 0))
        keys = self.initials.get(letters_of(s), ())
        if len(keys) == 1:
            return next(iter(keys)), 1.0
        return self.ranked(s)

    def ranked(self, s: str) -> tuple[str | None, float]:
        """The entry that a cleaned value denotes by its words, as in :meth:`denoted`."""
        tokens = self.tokens(s)
        ranked = self.rank(tokens)
        if not ranked:  # a word that looked misspelt may be two that lost their space
            apart = [x for t in tokens for x in (self._cut(t) or [t] if t not in self.idf else [t])]
            ranked = self.rank(apart) if apart != tokens else []
        if not ranked:
            return None, self.resemblance(tokens)
        if len(ranked) > 1 and ranked[0][0] - ranked[1][0] < 1e-6:
            return None, ranked[0][0]
        return ranked[0][1], ranked[0][0]


def endings(s: str) -> list[tuple[str, int]]:
    """(ending, place): what of a cleaned value may be a publisher's name at its end, in plain letters: it follows a sign and more than three characters."""
    low = plain(s)
    return [(low[k:], k) for k in range(4, len(low)) if not low[k].isspace() and not low[:k].rstrip()[-1:].isalnum()]


def without_ending(s: str, length: int) -> str:
    return s[: len(s) - length].rstrip(" ,;:-–—/.(") if length else s


def letters_of(s: str) -> str:
    """The letters of a value that consists of initials; empty for any other."""
    letters = re.fullmatch(r"\s*((?:[^\W\d_]\s?\.\s?){2,}[^\W\d_]?|[A-Z]{3,10})\.?\s*", s)
    return plain("".join(_WORD.findall(letters[1]))) if letters else ""


def cuts(token: str, longest: int) -> range:
    """The places at which a token may be two words of at most ``longest`` letters and two errors."""
    return range(max(1, len(token) - longest - 2), min(len(token), longest + 3))


class Found(Reference):
    """What was found of the reference list for one value: the candidates of its tokens and of their parts, and the entries it may denote."""

    def __init__(self, words: dict[str, dict[str, float]], idf: dict[str, float], entries: list[tuple[str, tuple[str, ...]]], longest: int) -> None:
        self.found, self.idf, self.longest = words, idf, longest
        self.entries = sorted(set(entries))
        self.most_words = max((len(w) for _, w in self.entries), default=0)
        self.postings = defaultdict(list)
        for i, (_, w) in enumerate(self.entries):
            for x in set(w):
                self.postings[x].append(i)
        self.norms = [math.sqrt(sum(idf.get(x, 0.0) ** 2 for x in w)) for _, w in self.entries]
        self.candidates = self._joined

    def _joined(self, token: str) -> dict[str, float]:
        out = dict(self.found.get(token, ()))
        if token not in self.idf and len(token) > 4:
            for k in cuts(token, self.longest):
                if token[:k] in self.idf and token[k:] in self.idf:
                    out[token[:k] + " " + token[k:]] = JOINED
        return out


def _deleted(word: str, most: int) -> set[str]:
    out, edge = {word}, {word}
    for _ in range(most):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        out |= edge
    return out


def reference_entries(reference: DataFrame, key: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(entries, vocabulary) of a reference list: ``(entry, key, words, initials, rare)``, ``rare`` being the entry's rarest word, and ``(word, idf)``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, w) for k, n in zip(b["key"], b["name"]) for w in [Reference.words(n)] if n.strip() and w]
            yield pd.DataFrame(rows, columns=["key", "words"])

    raw = reference.select(F.col(key).cast("string").alias("key"), F.explode(F.array(*names)).alias("name")).where("key is not null and name is not null").distinct()
    listed = cut(raw.mapInPandas(read, "key string, words array<string>").distinct().withColumn("entry", F.monotonically_increasing_id()))
    total = listed.count()
    vocabulary = listed.select("entry", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    vocabulary = cut(vocabulary.select("word", F.log(1 + F.lit(float(total)) / F.col("df")).alias("idf")))
    rare = listed.select("entry", F.explode(F.array_distinct("words")).alias("word")).join(vocabulary, "word").groupBy("entry").agg(F.max_by("word", F.struct("idf", "word")).alias("rare"))
    initials = F.array_join(F.transform("words", lambda w: F.substring(w, 1, 1)), "")
    return listed.join(rare, "entry").select("entry", "key", "words", initials.alias("initials"), "rare"), vocabulary


def token_candidates(lookups: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(token, word, sim, idf)``: the words that each token of ``lookups`` (token, known, edits, prefixes) may stand for, ``idf`` null for particles.

    Equal words are joined as they are; misspelt ones by what is left of token and word without a letter or two, and then compared; short
    forms by the beginnings of the words. ``edits`` and ``prefixes`` say which of these a token is looked up by besides.
    """
    spark = lookups.sparkSession
    extra = spark.createDataFrame([(w,) for w in sorted(PARTICLES)], "word string").withColumn("idf", F.lit(None).cast("double"))
    every = vocabulary.unionByName(extra.join(vocabulary, "word", "left_anti"))

    def keys(column: str, most):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(w, d) for w in b[column] for d in _deleted(w, most(w))]
                yield pd.DataFrame(rows, columns=[column, "d"])

        return run

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(t, w, 1 - e / max(len(w), 1) / 2) for t, w in zip(b["token"], b["word"]) for e in [osa(t, w, allowed(w))] if e <= allowed(w)]
            yield pd.DataFrame(rows, columns=["token", "word", "sim"])

    exact = lookups.select(F.col("token")).join(vocabulary.select(F.col("word").alias("token")), "token").select("token", F.col("token").alias("word"), F.lit(1.0).alias("sim"))
    left = fanned(lookups.where("edits").select("token")).mapInPandas(keys("token", lambda t: 2 if len(t) > 5 else 1), "token string, d string")
    right = every.select("word").mapInPandas(keys("word", allowed), "word string, d string")
    near = left.join(right, "d").select("token", "word").distinct().mapInPandas(judge, "token string, word string, sim double")
    short = vocabulary.select("word", F.explode(F.expr("transform(sequence(1, length(word) - 1), n -> substring(word, 1, n))")).alias("token")).where("length(word) > 1")
    begun = lookups.where("prefixes").select("token").join(short, "token").select("token", "word", F.lit(ABBREVIATED).alias("sim"))
    # of several ways to one word the one looked at first holds: equal, misspelt, abbreviated
    ways = exact.withColumn("way", F.lit(0)).unionByName(near.withColumn("way", F.lit(1))).unionByName(begun.withColumn("way", F.lit(2)))
    best = ways.groupBy("token", "word").agg(F.min_by("sim", "way").alias("sim"))
    return best.join(every, "word").select("token", "word", "sim", "idf")


def map_values(values: DataFrame, column: str, reference: DataFrame, key: str, names: list[str], publisher: str | None = None) -> DataFrame:
    """``(column, key, score)`` for each distinct non-null value of ``column``; ``key`` is null for a value that denotes no entry.

    ``reference`` has ``key`` and the name columns ``names``; several rows of a key may spell it differently. Blank values denote nothing,
    nor do those that equally good entries fit; values and names may have any length and the list any size. Values are made distinct
    map-side first, so that a value of any frequency is mapped once, and so are their tokens, each joined to the vocabulary once.
    """
    entries, vocabulary = reference_entries(reference, key, names)
    longest = max([r or 0 for r in vocabulary.agg(F.max(F.length("word"))).first()] + [max(map(len, PARTICLES))])

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, v, s, [e for e, _ in endings(s)] if publisher else []) for i, v in zip(b["id"], b["value"]) for s in [cleaned(v) if v.strip() else ""]]
            yield pd.DataFrame(rows, columns=["id", "value", "s", "ends"])

    distinct = values.select(F.col(column).alias("value")).where("value is not null").distinct().withColumn("id", F.monotonically_increasing_id())
    told = cut(fanned(distinct.select("id", "value")).mapInPandas(clean, "id long, value string, s string, ends array<string>"))
    if publisher:
        small = F.pandas_udf(lambda c: c.map(lambda p: plain(p).strip()), "string")
        presses = reference.select(F.trim(F.col(publisher)).alias("p")).where("p <> ''").distinct().select(small("p").alias("end")).where("end <> ''").distinct()
        ended = told.select("id", F.explode("ends").alias("end")).join(presses, "end").groupBy("id").agg(F.max(F.length("end")).alias("cut"))
        told = told.join(ended, "id", "left")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, s, n in zip(b["id"], b["s"], b["cut"]):
                s = without_ending(s, int(n) if n == n else 0)
                raw = _WORD.findall(plain(s))
                rows.append((i, s, letters_of(s), raw, [x + y for x, y in zip(raw, raw[1:])]))
            yield pd.DataFrame(rows, columns=["id", "s", "letters", "tokens", "pairs"])

    told = told.select("id", "value", "s", F.col("cut") if publisher else F.lit(None).cast("int").alias("cut"))
    words = cut(told.select("id", "s", F.col("cut").cast("double")).mapInPandas(read, "id long, s string, letters string, tokens array<string>, pairs array<string>"))
    tokens = words.select("id", F.explode(F.array_distinct("tokens")).alias("token"))
    once = tokens.select("token").distinct().join(vocabulary.select(F.col("word").alias("token"), F.lit(True).alias("known")), "token", "left")
    # a token that is no word may be two that lost their space: where a part is a word, both are looked up too
    splits = F.expr(f"transform(sequence(greatest(1, length(token) - {longest + 2}), least(length(token) - 1, {longest + 2})), k -> struct(substring(token, 1, k) as a, substring(token, k + 1) as b))")
    halves = once.where(f"known is null and length(token) between 2 and {2 * longest + 4}").select("token", F.explode(splits).alias("h")).select("token", "h.a", "h.b")
    spark = values.sparkSession
    whole = vocabulary.select("word").unionByName(spark.createDataFrame([(w,) for w in sorted(PARTICLES)], "word string")).distinct()
    either = halves.join(whole.withColumnRenamed("word", "a"), "a", "left_semi").select("token", "a", "b").unionByName(halves.join(whole.withColumnRenamed("word", "b"), "b", "left_semi").select("token", "a", "b"))
    divided = cut(either.select("token", F.explode(F.array("a", "b")).alias("part")).distinct())
    looked = once.select("token", (F.col("known").isNull() & (F.length("token") <= longest + 2)).alias("edits"), F.lit(True).alias("prefixes"))
    looked = looked.unionByName(divided.select(F.col("part").alias("token"), (F.length("part").between(4, longest + 2)).alias("edits"), F.lit(False).alias("prefixes")))
    looked = looked.unionByName(words.select(F.explode("pairs").alias("token"), F.lit(False).alias("edits"), F.lit(False).alias("prefixes")))
    lookups = looked.groupBy("token").agg(F.max("edits").alias("edits"), F.max("prefixes").alias("prefixes"))
    known = vocabulary.select(F.col("word").alias("token"), F.lit(True).alias("known"))
    lookups = cut(lookups.join(known, "token", "left").select("token", (F.col("edits") & F.col("known").isNull()).alias("edits"), "prefixes"))
    candidates = token_candidates(lookups, vocabulary).groupBy("token").agg(F.collect_list(F.struct("word", "sim", "idf")).alias("words"))
    candidates = cut(candidates)
    asked = tokens.unionByName(words.select("id", F.explode("pairs").alias("token"))).unionByName(tokens.join(divided, "token").select("id", F.col("part").alias("token"))).distinct()
    own = cut(asked.join(candidates, "token"))
    reached = own.select("id", F.explode("words.word").alias("rare")).distinct().join(entries.select("rare", "key", "words"), "rare").groupBy("id").agg(F.collect_set(F.struct("key", "words")).alias("entries"))
    lists = own.groupBy("id").agg(F.collect_list(F.struct("token", "words")).alias("found"))
    named = words.where("letters <> ''").select("id", F.col("letters").alias("initials")).join(entries.select("initials", "key").distinct(), "initials").groupBy("id").agg(F.min("key").alias("named"), F.count(F.lit(1)).alias("n")).where("n = 1").select("id", "named")
    rows = words.select("id", "s").join(named, "id", "left").join(lists, "id", "left").join(reached, "id", "left")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, s, by_letters, found, listed in zip(b["id"], b["s"], b["named"], b["found"], b["entries"]):
                if isinstance(by_letters, str):
                    out.append((i, by_letters, 1.0))
                    continue
                words, idf = {}, {}
                for f in found if found is not None else ():
                    words[f["token"]] = {w["word"]: w["sim"] for w in f["words"]}
                    idf.update((w["word"], w["idf"]) for w in f["words"] if w["idf"] is not None and w["idf"] == w["idf"])
                these = [(e["key"], tuple(e["words"])) for e in (listed if listed is not None else ())]
                # of words that no token stands for only the entry knows, so it cannot be covered
                out.append((i, *Found(words, idf, these, longest).ranked(s)) if these else (i, None, 0.0))
            yield pd.DataFrame(out, columns=["id", "key", "score"]).astype({"key": object})

    chosen = rows.mapInPandas(choose, "id long, key string, score double")
    return told.select("id", "value").join(chosen, "id").select(F.col("value").alias(column), F.col("key").alias(key), "score")


def map_venues(records: DataFrame, journals: DataFrame) -> DataFrame:
    """``(rec_id, venue, source_id, score)`` for each record with a venue; ``source_id`` is null where it denotes no journal listed."""
    found = map_values(records, "venue", journals, "source_id", ["title", "title_normalized"], "publisher")
    return records.select("rec_id", "venue").where("venue is not null").join(found, "venue")
