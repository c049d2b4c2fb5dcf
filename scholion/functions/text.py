"""Text functions as columns: tokens, identifiers, titles, sentences, markers. All are built-in expressions and stay in generated code."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, which results of other tools are compared with: formulas, boilerplate, headings, markers, greetings, stop words.
FORMULA_SIGNS, FORMULA_LEAST, FORMULA_SHARE = "∑∏√∞≈≤≥±∫πλμσΩ{}[]<>|=+*/^_", 40, 0.08
CITE_NOTE = "Please cite this article as:"
BOILERPLATE = (r"^please cite this article as:?$", r"^corresponding author", r"^tel\s*\+?\d")
HEADING, HEADING_MOST = r"^(\d+(?:\.\d+)*)?\s*[A-Z][A-Za-z0-9\-,:()\s]{2,}$", 120
EVIDENCE_TAIL = r"(?i)\s*/\s*(Figure|Table|Formula)\s+Evidence\s*$"
MARKER, SCOPED = r"\(cite:[^)]+\)", r"\(cite:([^|)]+)\|([^|)]+)(?:\|(\d+)\|(\d+))?\)"
GREETINGS = ("hi", "hello", "hey", "thanks", "thank you", "ok", "okay", "yes", "no", "bye", "goodbye", "please", "help")
STOPWORDS = (
    "the", "and", "that", "with", "from", "this", "those", "these", "their", "there", "where", "when", "which", "what", "about", "into", "than", "then", "were", "been", "being", "have", "has", "had", "does", "did", "while",
    "using", "used", "also", "such", "more", "most", "less", "many", "very", "some", "over", "under", "between", "among", "across", "within", "without",
)
#: Characters before a marker in which its claim is looked for.
CLAIM_WINDOW = 150


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """Lower-case words of letters a-z and digits."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(text: Column | str) -> Column:
    return F.array_distinct(tokens(text))


def overlap_ratio(a: Column | str, b: Column | str) -> Column:
    """Share of the tokens of ``a`` that ``b`` has; 0 where ``a`` has none."""
    own = token_set(a)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, token_set(b))) / F.size(own)).otherwise(F.lit(0.0))


def terms(text: Column | str, stopwords: tuple[str, ...] = (), least: int = 4) -> Column:
    """Distinct words of at least ``least`` letters, digits, underscores and hyphens that aren't stop words."""
    found = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[a-z0-9_\-]+"), F.lit(0))), lambda w: F.length(w) >= least)
    return F.array_except(found, F.array(*(F.lit(s) for s in stopwords))) if stopwords else found


def normalize_doi(value: Column | str) -> Column:
    """Bare lower-case DOI, or null where the value is none."""
    bare = F.regexp_replace(F.lower(F.trim(_c(value))), r"^(?:https?://)?(?:dx\.)?doi\.org/|^doi:\s*", "")
    bare = F.regexp_replace(bare, r"[/\s]+$", "")
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), bare)


def extract_dois(text: Column | str) -> Column:
    """DOIs within a text, lower case, without closing punctuation."""
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"10\.\d{4,9}/[^\s\"<>]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda d: F.regexp_replace(d, r"[.,;:)\]]+$", "")))


def extract_arxiv(text: Column | str) -> Column:
    """arXiv identifier, with its version: of a DOI, an address, a prefixed id, or a bare one that is the whole text; null if there is none."""
    t = F.trim(_c(text))
    found = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(t, "^https?://", ""), "^ar[xX]iv:", "")
    named = F.coalesce(found(r"(?i)10\.48550/arxiv\.([^/?#\s]+)"), F.regexp_replace(found(r"(?i)arxiv\.org/(?:abs|pdf)/([^?#\s]+)"), "/+$", ""), found(r"(?i)\barxiv:(\S+)"))
    return F.coalesce(F.regexp_replace(named, r"(?i)\.pdf$", ""), F.when(bare.rlike(r"(?i)^(?:\d{4}\.\d{4,5}|[a-z\-]+(?:\.[a-z]{2})?/\d{7})(?:v\d+)?$"), bare))


def normalize_issn(value: Column | str) -> Column:
    """Eight characters without hyphen, or null."""
    bare = F.upper(F.regexp_replace(_c(value), r"[\s\-]", ""))
    return F.when(bare.rlike(r"^\d{7}[\dX]$"), bare)


def issn_variants(value: Column | str) -> Column:
    """The ISSN with and without hyphen; empty where there is none."""
    bare = normalize_issn(value)
    return F.when(bare.isNotNull(), F.array(bare, F.concat(F.substring(bare, 1, 4), F.lit("-"), F.substring(bare, 5, 4)))).otherwise(F.array().cast("array<string>"))


def normalize_title(value: Column | str) -> Column:
    """Lower case, only letters, digits, spaces and hyphens of any script, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(value)), r"(?U)[^\w\s\-]", ""), r"(?U)\s+", " "))


def surname(name: Column | str) -> Column:
    """Last word of a name in lower case; null for an empty one."""
    parts = F.split(F.trim(_c(name)), r"\s+")
    return F.nullif(F.lower(F.element_at(parts, -1)), F.lit(""))


def sentences(text: Column | str) -> Column:
    """Sentences: text split after . ! or ? and white space; blank parts are left out."""
    return F.filter(F.transform(F.split(_c(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def first_wins(values: Column) -> Column:
    """Array without later elements that differ from an earlier one in case only."""
    return F.aggregate(
        values, F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isNull() | F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )


def vowel_ratio(text: Column | str) -> Column:
    letters = F.regexp_replace(F.lower(_c(text)), "[^a-z]", "")
    n = F.length(letters)
    return F.when(n == 0, 0.0).when(n < 3, 1.0).otherwise(F.length(F.regexp_replace(letters, "[^aeiou]", "")) / n)


def shannon_entropy(text: Column | str) -> Column:
    """Bits a character of a text without spaces."""
    chars = F.split(F.regexp_replace(_c(text), " ", ""), "")
    kept = F.filter(chars, lambda c: c != "")
    n = F.size(kept)
    total = F.aggregate(F.array_distinct(kept), F.lit(0.0), lambda acc, c: acc - F.size(F.filter(kept, lambda x: x == c)) / n * F.log2(F.size(F.filter(kept, lambda x: x == c)) / n))
    return F.when(n > 0, total).otherwise(F.lit(0.0))


def looks_like_identifier(text: Column | str) -> Column:
    t = _c(text)
    letters = F.regexp_replace(F.lower(t), "[^a-z]", "")
    mixed = t.contains("_") | F.lower(t).rlike("[a-z][0-9]|[0-9][a-z]")
    return t.rlike(r"^[a-zA-Z_][a-zA-Z0-9_]*\d+") | (mixed & (F.length(letters) > 2) & (vowel_ratio(t) < 0.25))


def citation_markers(text: Column | str) -> Column:
    """Ids in ``(cite:...)`` markers, in order."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(r"(?i)\(cite:([^)]+)\)"), F.lit(1)), lambda m: F.trim(m))


def marker_numbers(text: Column | str) -> Column:
    """Distinct numbers of ``(cite:n)`` markers, in order of size."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(_c(text), F.lit(r"\(cite:(\d+)\)"), F.lit(1)), lambda m: m.try_cast("int"))))


def _placed(text: Column, pattern: str) -> Column:
    """``(position, mark)`` of every match of ``pattern``, positions from 0: what lies between the matches is measured."""
    between, marks = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    upto = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, x: a + F.length(x))
    return F.transform(marks, lambda m, i: F.struct((upto(between, i + 1) + upto(marks, i)).alias("position"), m.alias("mark")))


def scoped_citations(text: Column | str) -> Column:
    """Markers ``(cite:paper|chunk)`` or ``(cite:paper|chunk|start|end)`` as structs of paper, chunk, char_start, char_end, position and marker."""
    part = lambda m, i: F.regexp_extract(m, SCOPED, i)
    return F.transform(
        _placed(_c(text), SCOPED),
        lambda p: F.struct(part(p["mark"], 1).alias("paper"), part(p["mark"], 2).alias("chunk"), part(p["mark"], 3).try_cast("int").alias("char_start"), part(p["mark"], 4).try_cast("int").alias("char_end"), p["position"].alias("position"), p["mark"].alias("marker")),
    )


def marked_claims(text: Column | str) -> Column:
    """For every marker its ``(source, position, claim)``: the text before it, from the last full stop (else ! or ?) of CLAIM_WINDOW characters on."""
    t = _c(text)

    def claim(at: Column) -> Column:
        w = F.trim(F.substring(t, F.greatest(at - CLAIM_WINDOW, F.lit(0)) + 1, F.least(at, F.lit(CLAIM_WINDOW))))
        after = lambda sign: F.trim(F.substring_index(w, sign, -1))
        return F.when(w.contains("."), after(".")).when(w.contains("!"), after("!")).when(w.contains("?"), after("?")).otherwise(w)

    return F.transform(_placed(t, MARKER), lambda p: F.struct(F.regexp_extract(p["mark"], r"\(cite:([^)]+)\)", 1).alias("source"), p["position"].alias("position"), claim(p["position"]).alias("claim")))


def numeric_citations(text: Column | str) -> Column:
    """Numbers in ``[n]`` markers, in order."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(r"\[(\d{1,4})\]"), F.lit(1)), lambda x: x.cast("int"))


def truncated(text: Column | str, most: int) -> Column:
    """At most ``most`` characters, the last three being dots where something was cut."""
    t = _c(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def collapsed(text: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def clean_noise(text: Column | str) -> Column:
    """Without NUL characters, runs of white space and the note how to cite."""
    return F.trim(F.replace(collapsed(F.replace(_c(text), F.lit("\0"), F.lit(""))), F.lit(CITE_NOTE), F.lit("")))


def is_boilerplate(text: Column | str) -> Column:
    """Whether a line says nothing: null, blank, without letters a-z and digits, or one of the usual notes."""
    t = F.lower(collapsed(F.coalesce(_c(text), F.lit(""))))
    out = (t == "") | ~t.rlike("[a-z0-9]")
    for p in BOILERPLATE:
        out = out | t.rlike(p)
    return out


def is_formula(text: Column | str) -> Column:
    """Whether a text is a formula: of some length, and a share of its characters are mathematical signs."""
    t = _c(text)
    signs = F.length(t) - F.length(F.translate(t, FORMULA_SIGNS, ""))
    return (F.length(t) >= FORMULA_LEAST) & (signs / F.greatest(F.length(t), F.lit(1)) > FORMULA_SHARE)


def is_section_header(text: Column | str) -> Column:
    """Whether a line looks like a heading: short, numbered or not, from a capital on only letters, digits and a few signs."""
    t = F.trim(_c(text))
    return (F.length(t) <= HEADING_MOST) & ~t.contains("\n") & t.rlike("(?U)" + HEADING)


def section_key(title: Column | str) -> Column:
    """A section's title for comparison: lower case, without the mark of a piece of evidence; empty where it is null."""
    return F.lower(collapsed(F.regexp_replace(F.coalesce(_c(title), F.lit("")), EVIDENCE_TAIL, "")))


def plain_string(text: Column | str) -> Column:
    """Lower case without full stops, commas, colons and semicolons, single spaces; empty where it is null."""
    return collapsed(F.translate(F.lower(F.coalesce(_c(text), F.lit(""))), ".,:;", ""))


def question_key(text: Column | str) -> Column:
    """A question for comparison: lower case, single spaces."""
    return F.lower(collapsed(F.coalesce(_c(text), F.lit(""))))


def repair_text(text: str) -> str:
    """Characters in compatible form (NFKD), none that cannot be printed but line ends and tabs, at most one space and two line ends in a row."""
    t = "".join(c for c in unicodedata.normalize("NFKD", text) if c.isprintable() or c in "\n\t").replace("€", "e").replace("\ufffd", "")
    while "  " in t:
        t = t.replace("  ", " ")
    while "\n\n\n" in t:
        t = t.replace("\n\n\n", "\n\n")
    return t.strip()


def repaired_encoding(text: Column | str) -> Column:
    """:func:`repair_text` of a column, in Arrow batches: there is no built-in normal form."""

    @F.pandas_udf("string")
    def repair(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(repair_text, na_action="ignore")

    return repair(text)


def normalize_target(url: Column | str) -> Column:
    """A download target as an address: DOIs and bare hosts get their scheme."""
    u = F.trim(_c(url))
    return (
        F.when(u.isNull() | (u == ""), F.lit(None).cast("string")).when(u.rlike("(?i)^https?://"), u).when(u.rlike("(?i)^doi:"), F.concat(F.lit("https://doi.org/"), F.regexp_replace(u, r"(?i)^doi:\s*", "")))
        .when(u.startswith("10."), F.concat(F.lit("https://doi.org/"), u)).otherwise(F.concat(F.lit("https://"), u))
    )


def denied_reason(body: Column | str, server: Column | None = None, ray: Column | None = None) -> Column:
    """Why an access was refused, from the page's text and headers; the first class that applies."""
    m, server, ray = F.lower(F.coalesce(_c(body), F.lit(""))), F.lower(F.coalesce(server if server is not None else F.lit(""), F.lit(""))), F.coalesce(ray if ray is not None else F.lit(""), F.lit(""))
    return (
        F.when(m.contains("cloudflare") | m.contains("cf-challenge") | (ray != ""), "Cloudflare bot/challenge protection").when(m.contains("captcha"), "CAPTCHA or human verification required")
        .when(m.contains("paywall") | m.contains("purchase") | m.contains("subscribe"), "Publisher paywall / subscription required").when(m.contains("access denied") | m.contains("forbidden"), "Generic access-control policy denied the request")
        .when(m.contains("akamai") | server.contains("akamai"), "Akamai edge security policy denied the request").otherwise("Unknown (inspect headers/body snippet)")
    )


def sanitized(text: Column | str, fields: list[str]) -> Column:
    """A query for a fielded index: a text with a known ``field:`` passes, else signs are dropped and the words are asked of each field."""
    t = _c(text)
    known = F.lit(False)
    for f in fields:
        known = known | t.contains(f"{f}:")
    signs = '+-!(){}[]^"~*?:\\/'
    words = collapsed(F.translate(F.replace(t, F.lit("'"), F.lit("")), signs, " " * len(signs)))
    asked = F.concat_ws(" OR ", *(F.concat(F.lit(f"{f}:("), words, F.lit(")")) for f in fields))
    return F.when(known, t).when(words == "", "").otherwise(asked)


def repeats(text: Column | str, times: int = 5) -> Column:
    """Whether a character occurs ``times`` times in a row."""
    return _c(text).rlike(rf"(.)\1{{{times - 1},}}")


def first_id(ids: Column, *keys: str) -> Column:
    """First non-null value of an id map under any spelling of its keys."""
    return F.coalesce(*(F.nullif(F.trim(ids[k]), F.lit("")) for k in keys))


def canonical_ids(ids: Column) -> Column:
    """External ids under lower-case keys, DOIs bare; of keys that differ in case only the first wins, capitals sorting first."""
    alias = F.create_map(*(F.lit(x) for pair in (("corpusid", "corpus_id"), ("pubmed", "pmid"), ("pubmedcentral", "pmcid"), ("openalex", "openalex"), ("mag", "mag"), ("doi", "doi"), ("arxiv", "arxiv")) for x in pair))
    entries = F.transform(F.array_sort(F.map_entries(ids)), lambda e: F.struct(F.coalesce(alias[F.lower(e["key"])], F.lower(e["key"])).alias("key"), F.when(F.lower(e["key"]) == "doi", F.coalesce(normalize_doi(e["value"]), e["value"])).otherwise(e["value"]).alias("value")))
    once = F.filter(entries, lambda e: e["value"].isNotNull())
    return F.map_from_entries(F.aggregate(once, F.expr("cast(array() as array<struct<key:string,value:string>>)"), lambda acc, e: F.when(F.exists(acc, lambda x: x["key"] == e["key"]), acc).otherwise(F.concat(acc, F.array(e)))))
