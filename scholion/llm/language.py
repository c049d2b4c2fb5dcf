"""Languages of documents and of the passages in them, by hyperdimensional profiles.

Every letter has a random vector of +1 and -1; an n-gram is the elementwise product of its letters' vectors, each permuted by its place; a
text is the sum of its n-grams; a language is the sum of labelled texts. A text is compared with a language by the cosine of their vectors.
As the product is linear in the n-grams, those of every n-gram with every language are worked out once, and a text's is the sum of the rows
of its n-grams, for a whole batch of sentences at a time. Only the text's own length is taken as expected, that of independent n-gram
vectors, and not as built; the tests compare both. A passage that is like none of the languages is given none of them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.tables import spread

#: Dimension of the vectors, letters in an n-gram, and labelled texts a language to fit on (drawn by hash; the fit is bounded by this).
DIMENSION, LETTERS, SAMPLE = 4096, 3, 400
#: Symbols: 0 is any gap between words, 1..26 the letters without marks, 27 any other letter.
SYMBOLS = 32
#: Log-odds that a sentence is in another language than the one before it, in a paragraph and across paragraphs.
SWITCH, SWITCH_PARAGRAPH = 3.0, 1.0
#: Fewest words of a full sentence; characters that are scored at a time.
WORDS, CHARACTERS = 4, 200_000
#: Factors of which the one is taken that makes confidences fit the labels best; the share of the usual cosine that a passage must have.
SCALES, LIKE = [0.05 * 1.25**i for i in range(20)], 0.3

# ISO 639 codes and English and own names of the languages.
NAMES = {
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "es": ["es", "spa", "esp", "spanish", "español", "espanol", "castilian", "castellano"],
    "it": ["it", "ita", "italian", "italiano"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands", "flemish"],
}
LANGUAGES = sorted(NAMES)


def named_language(label: Column) -> Column:
    """The one language that a label names by any common code or name, region and script parts aside; null if it names none."""
    head = F.regexp_extract(F.lower(F.trim(label)), r"(?U)^([^\W\d_]+)(?:[-_ (].*)?$", 1)
    entries = [F.lit(x) for code, names in NAMES.items() for name in names for x in (name, code)]
    return F.create_map(*entries)[head]


# Windows-1252's characters for the bytes 80 to 9F; each byte of a damaged letter is shown as one of these or as itself.
_SHOWN = {bytes([b]).decode("cp1252"): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_TAIL = "\x80-\xbf" + "".join(_SHOWN)
_DAMAGED = re.compile(f"[\xc2-\xc5][{_TAIL}]|[\xe2\xef][{_TAIL}]{{2}}")  # the letters and marks of European languages


def _rebuilt(found: re.Match) -> str:
    try:
        return bytes(_SHOWN.get(c, ord(c)) for c in found[0]).decode("utf-8")
    except UnicodeError:
        return found[0]


def repaired(text: str) -> str:
    """Undo UTF-8 that was read as Windows-1252 or Latin-1, letter by letter; other text stays as it is."""
    return _DAMAGED.sub(_rebuilt, text)


_SPECIAL = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ı": "i", "’": " ", "'": " "})


def plain(text: str) -> str:
    """Lower case, without marks on letters."""
    if text.isascii():
        return text.lower().replace("'", " ")
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().translate(_SPECIAL)) if not unicodedata.combining(c))


_BYTES = np.zeros(256, np.int32)
_BYTES[ord("a") : ord("z") + 1] = np.arange(1, 27)


def symbols(text: str) -> np.ndarray:
    """Symbol numbers of a text that :func:`plain` gave; runs of gaps count as one, and there is a gap at either end."""
    raw = np.frombuffer((" " + text + " ").encode("ascii", "replace").replace(b"?", b"\x7f"), np.uint8)
    codes = _BYTES[raw]
    codes[raw == 0x7F] = 0
    return codes[~((codes == 0) & np.concatenate(([False], codes[:-1] == 0)))]


def grams(codes: np.ndarray) -> np.ndarray:
    """N-gram numbers of a symbol array."""
    n = len(codes) - LETTERS + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for i in range(LETTERS):
        out = out * SYMBOLS + codes[i : i + n]
    return out


def letter_vectors(dimension: int = DIMENSION, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimension))


def gram_vectors(numbers: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The bound vector of each n-gram number."""
    out = np.ones((len(numbers), letters.shape[1]), np.int8)
    for i in range(LETTERS):
        digit = (numbers // SYMBOLS ** (LETTERS - 1 - i)) % SYMBOLS
        out *= np.roll(letters, LETTERS - 1 - i, axis=1)[digit]
    return out


def prototypes(counts: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Language vectors from n-gram counts (languages by n-grams): n-grams weighted evenly by language, bundled, centred and of length 1."""
    share = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    seen = np.flatnonzero(counts.sum(0))
    total = np.zeros((counts.shape[0], letters.shape[1]))
    for part in np.array_split(seen, max(1, len(seen) // 2048)):
        total += share[:, part] @ gram_vectors(part, letters).astype(np.float32)
    total -= total.mean(0)
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)


def score_table(protos: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Cosine of every n-gram's vector with every language: (n-grams, languages)."""
    size, step = SYMBOLS**LETTERS, SYMBOLS ** (LETTERS - 1)
    scale = np.sqrt(letters.shape[1])
    return np.concatenate([gram_vectors(np.arange(a, a + step), letters).astype(np.float32) @ protos.T.astype(np.float32) / scale for a in range(0, size, step)])


_QUOTED = re.compile(r"[„“”«»\"‚‘‹›](?:[^„“”«»\"‚‘‹›\n]|\n(?!\s*\n)){2,120}[“”«»\"’‘‹›]")
_BRACKETED = re.compile(r"\[[^\]\n]{1,30}\]|\([^()\n]{1,120}\)")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
_END = re.compile(r"[.!?…]+[\"'”’»)\]]*(?:\s+|$)(?=[\"'“„«(\[¿¡]*[A-ZÀ-ÖØ-ÞĀ-ſ]|$)")
_ABBREVIATED = re.compile(r"(?:\b(?:e\.g|i\.e|z\.B|p\.ex|cf|al|fig|figs|sect|abb|tab|vgl|bzw|ca|vs|no|vol|eq|dr|prof|pp?|ref)|\b[^\W\d_])\.$", re.I)
_WORD = re.compile(r"[^\W\d_]{2,}")
_LISTED = re.compile(r"^\s*(?:[|$#>]|[-*•]\s*$|\S+(?: \S+){0,2}:\s*[^.?!]*$)")
_QA = re.compile(r"^\s*[QAF]\s*:\s*")


_SIGNED = re.compile(r"[„“”«»\"‚‘‹›\[(]")


def bare_sentences(text: str) -> Iterator[tuple[int, int, int, str]]:
    """Full sentences of a text as (start, end, paragraph, bare text): a terminal mark, and a few words outside quotes and brackets.

    Headings, table rows, formulas, keyword lists, titles in quotation marks and fragments without an end are none.
    """
    at, paragraphs = 0, []
    for m in _PARAGRAPH.finditer(text):
        paragraphs.append((at, m.start()))
        at = m.end()
    paragraphs.append((at, len(text)))
    for number, (a, b) in enumerate(paragraphs):
        lines, start = [], a
        for line in text[a:b].split("\n"):
            lines.append((start, line))
            start += len(line) + 1
        spans, first = [], None  # runs of running text between table rows, formulas and headings
        for s, line in lines:
            if _LISTED.match(line) and not _QA.match(line) and (line.lstrip()[:1] in "|$#>" or len(lines) == 1 or "," in line):
                if first is not None:
                    spans.append((first, s))
                first = None
            elif first is None:
                first = s
        if first is not None:
            spans.append((first, b))
        for x, y in spans:
            start, block = x, text[x:y]
            signed = _SIGNED.search(block) is not None
            for m in _END.finditer(block):
                if block[m.start()] == "." and m.end() < len(block) and _ABBREVIATED.search(block[max(0, m.start() - 8) : m.start() + 1]):
                    continue
                end = x + m.end()
                bare = text[start:end]
                if signed:
                    bare = _BRACKETED.sub(" ", _QUOTED.sub(" ", bare))
                if len(_WORD.findall(bare)) >= WORDS:
                    yield start, end, number, plain(_QA.sub("", bare))
                start = end


def sentences(text: str) -> list[tuple[int, int, int]]:
    """Full sentences of a text as (start, end, paragraph)."""
    return [s[:3] for s in bare_sentences(text)]


def batch_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram numbers, text of each, symbols a text) of plain texts at once; what :func:`symbols` and :func:`grams` give, one after the other."""
    raw = [(" " + t + " ").encode("ascii", "replace") for t in texts]
    size = np.array([len(r) for r in raw])
    codes = _BYTES[np.frombuffer(b"".join(raw), np.uint8)]
    starts = np.cumsum(size) - size
    before = np.concatenate(([1], codes[:-1]))
    before[starts] = 1
    keep = ~((codes == 0) & (before == 0))
    of = np.repeat(np.arange(len(texts)), size)[keep]
    codes = codes[keep].astype(np.int64)
    numbers = np.zeros(max(len(codes) - LETTERS + 1, 0), np.int64)
    for i in range(LETTERS):
        numbers = numbers * SYMBOLS + codes[i : i + len(numbers)]
    whole = of[: len(numbers)] == of[LETTERS - 1 :]
    return numbers[whole], of[: len(numbers)][whole], np.bincount(of, minlength=len(texts))


class Model:
    """Score table, languages, the factor from cosine to log-odds, that from log-odds to confidence, and the least mean cosine of a passage."""

    def __init__(self, table: np.ndarray, languages: list[str], factor: float = 60.0, scale: float = 1.0, least: float = 0.0) -> None:
        self.table, self.languages, self.factor, self.scale, self.least = table, languages, factor, scale, least

    def cosines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, symbols): of plain texts with each language, and their lengths; a text's length is that of independent n-gram vectors."""
        out, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        i = 0
        while i < len(texts):
            j, total = i, 0
            while j < len(texts) and (j == i or total + len(texts[j]) < CHARACTERS):
                total += len(texts[j])
                j += 1
            numbers, of, sizes[i:j] = batch_grams(texts[i:j])
            if len(numbers):
                firsts = np.flatnonzero(np.diff(of, prepend=-1))
                key, counts = np.unique(of * SYMBOLS**LETTERS + numbers, return_counts=True)
                square = np.bincount(key // SYMBOLS**LETTERS, counts.astype(float) ** 2, j - i)
                out[i + of[firsts]] = np.add.reduceat(self.table[numbers], firsts, dtype=np.float64) / np.sqrt(square[of[firsts]])[:, None]
            i = j
        return out, sizes

    def passages(self, texts: list[str]) -> list[list[tuple[int, int, str, float, int]]]:
        """Passages of each text as (start, end, language, confidence, sentences): the best path over its sentences, a change of language costing a penalty.

        The language of a passage that is like none of the languages is empty.
        """
        found = [list(bare_sentences(repaired(t))) for t in texts]
        cosines, sizes = self.cosines([s[3] for parts in found for s in parts])
        weight = np.minimum(1.0, np.sqrt(sizes / 60))[:, None]
        odds, at, out = self.factor * cosines * weight, 0, []
        for parts in found:
            n = len(parts)
            out.append(self._path(parts, odds[at : at + n], cosines[at : at + n], sizes[at : at + n]) if n else [])
            at += n
        return out

    def _path(self, parts: list, odds: np.ndarray, cosines: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, str, float, int]]:
        top = odds.argmax(1)
        if (top == top[0]).all():
            path = [int(top[0])] * len(parts)
        else:
            best, back = odds[0], []
            for i in range(1, len(parts)):
                penalty = SWITCH if parts[i][2] == parts[i - 1][2] else SWITCH_PARAGRAPH
                lead = int(best.argmax())
                change = best[lead] - penalty > best
                back.append(np.where(change, lead, np.arange(len(best))))
                best = np.where(change, best[lead] - penalty, best) + odds[i]
            path = [int(best.argmax())]
            for step in reversed(back):
                path.append(int(step[path[-1]]))
            path.reverse()
        out, i = [], 0
        while i < len(parts):
            j = i
            while j + 1 < len(parts) and path[j + 1] == path[i]:
                j += 1
            total = self.scale * odds[i : j + 1].sum(0)
            p = np.exp(total - total.max())
            like = float((cosines[i : j + 1, path[i]] * sizes[i : j + 1]).sum() / max(sizes[i : j + 1].sum(), 1))
            name = self.languages[path[i]] if like >= self.least else ""
            out.append((parts[i][0], parts[j][1], name, float(p[path[i]] / p.sum()) if name else 0.0, j - i + 1))
            i = j + 1
        return out


def fit(documents: DataFrame, text: str = "text", label: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit the language profiles on at most ``sample`` labelled texts a language (drawn by hash of the text), in two rounds.

    The second round leaves out the sentences that the first takes for another language than their label, so that wrong labels and
    mixed texts don't blur the profiles. Blank texts and labels that name no language are not used.
    """
    labelled = documents.select(named_language(F.col(label)).alias("code"), F.col(text).alias("t")).where("code is not null and length(trim(t)) > 40")
    ranked = labelled.withColumn("h", F.xxhash64("t"))
    # the smallest hashes of each language; the bound is a threshold on the hash, from the language's count, so that no group is gathered
    counts = {r["code"]: r["n"] for r in ranked.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model(np.zeros((SYMBOLS**LETTERS, len(LANGUAGES)), np.float32), LANGUAGES)
    share = F.create_map(*(F.lit(x) for c, n in counts.items() for x in (c, min(1.0, 0.8 * sample / n))))[F.col("code")]
    rows = ranked.where((F.pmod("h", F.lit(1 << 20)) / float(1 << 20)) < share).select("code", "t").limit(2 * sample * len(NAMES)).collect()
    languages = sorted(counts)
    letters = letter_vectors()
    found = [(languages.index(r["code"]), s[3]) for r in sorted(rows, key=lambda r: (r["code"], r["t"])) for s in bare_sentences(repaired(r["t"]))]
    named, texts = np.array([k for k, _ in found], int), [t for _, t in found]
    numbers, of, _ = batch_grams(texts) if texts else (np.zeros(0, int), np.zeros(0, int), None)
    use = np.ones(len(found), bool)
    model = Model(np.zeros((SYMBOLS**LETTERS, len(languages)), np.float32), languages)
    for _ in range(2 if len(numbers) else 0):
        mine = use[of]
        totals = np.bincount(named[of[mine]] * SYMBOLS**LETTERS + numbers[mine], minlength=len(languages) * SYMBOLS**LETTERS).reshape(len(languages), -1).astype(float)
        model = Model(score_table(prototypes(totals, letters), letters), languages)
        cosines, sizes = model.cosines(texts)
        use = cosines.argmax(1) == named
    if use.any() and len(languages) > 1:
        # confidences are fitted to how often the labels are right, and a passage must be like a language as nearly all its sentences are
        odds = model.factor * cosines * np.minimum(1.0, np.sqrt(sizes / 60))[:, None]
        own = odds - np.take_along_axis(odds, named[:, None], 1)
        loss = lambda x: np.log(np.exp(np.minimum(x * own, 500)).sum(1)).mean()
        model.scale = min(SCALES, key=loss)
        model.least = LIKE * float(np.median(cosines[use, named[use]]))
    return model


def passages(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every passage in one language: ``(key, passage, char_start, char_end, lang, confidence, sentences)``.

    Places count characters of the text (of its repaired form where letters were damaged). The language of a passage that is like none is empty, its confidence 0. Null, blank and sentence-less texts give no
    row; repeated rows give repeated passages. Texts are handled where they are read: there is no shuffle.
    """
    taken = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null"))
    kind = documents.schema[key].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast((model.table, model.languages, model.factor, model.scale, model.least))  # 0.9 MB, fixed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for b in batches:
            rows = [(k, i, *p) for k, ps in zip(b["key"], own.passages(list(b["text"]))) for i, p in enumerate(ps)]
            yield pd.DataFrame(rows, columns=["key", "passage", "char_start", "char_end", "lang", "confidence", "sentences"])

    out = taken.mapInPandas(run, f"key {kind}, passage int, char_start int, char_end int, lang string, confidence double, sentences int")
    return out.withColumnRenamed("key", key)


def document_languages(documents: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``(key, lang, confidence, sentences)``: one row for each language with a full sentence in a document."""
    return passages(documents, model, key).where("lang <> ''").groupBy(key, "lang").agg(F.max("confidence").alias("confidence"), F.sum("sentences").alias("sentences"))


def mislabelled(documents: DataFrame, model: Model, key: str = "doc_id", label: str = "lang") -> DataFrame:
    """``(key, lang)`` for each document whose label doesn't name exactly the one language of its text."""
    labelled = documents.select(F.struct(key, named_language(F.col(label)).alias("named")).alias("of"), "text")
    found = passages(labelled, model, "of").where("lang <> ''").groupBy("of").agg(F.collect_set("lang").alias("langs"))
    wrong = found.where(~((F.size("langs") == 1) & F.coalesce(F.element_at("langs", 1) == F.col("of.named"), F.lit(False))))
    return wrong.select(f"of.{key}", F.explode("langs").alias("lang")).distinct()
