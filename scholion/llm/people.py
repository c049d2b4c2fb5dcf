"""Linking the spellings of people's names by merging and matching again.

Profiles that agree in name and field, or in an identifier, are merged; a merged profile has all its members' spellings, initials, fields
and institutions, and enters the next round with them; rounds go on until none merges. Names are compared without regard to order, case,
marks, titles and particles; surnames may differ by a typing error, given names may be short forms or initials.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.canonical import osa
from scholion.llm.language import plain, repaired
from scholion.tables import cut, fanned, release

#: Share of the distinct name words that a given name is seen beside at least, and least number; so there are fewer than 1 / GIVEN of them a row.
GIVEN, GIVEN_LEAST = 0.004, 8
#: Most topics that are grouped into fields on the driver; topics are a controlled vocabulary, and a larger one is refused.
MOST_TOPICS = 50_000
#: Least share of the rarer topic's profiles that also have the other, for two topics to be of one field.
SAME_FIELD = 0.02

# Titles and suffixes, particles of surnames, and short forms of given names.
TITLES = frozenset("dr prof professor phd md msc bsc jr sr mr mrs ms dipl ing habil ii iii".split())
PARTICLES = frozenset("van der den de di da dos del della ten ter von zu zur la le el al bin ibn do du y".split())
SHORT = {
    "alexander": "alex sandy sasha xander", "alexandra": "alex sandra sasha", "andrew": "andy drew", "andres": "andy", "anthony": "tony ant", "benjamin": "ben benny", "charles": "charlie chuck carl",
    "christopher": "chris kit topher", "christina": "chris tina", "daniel": "dan danny", "david": "dave", "dmitri": "dima mitya", "edward": "ed eddie ted ned", "eleni": "lena elena helen", "elizabeth": "liz beth betty eliza lizzie libby",
    "ewa": "eva", "frederick": "fred freddy rick", "francois": "frank fran", "giulia": "julia", "gregory": "greg", "hans": "hansi", "ioana": "joana ioanna", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn", "john": "jack johnny jon",
    "jonathan": "jon", "jose": "pepe", "joseph": "joe joey jo", "jurgen": "jorg", "katherine": "kate kathy katie kat kit", "kenneth": "ken", "kenji": "ken", "lawrence": "larry", "margaret": "meg maggie peggy greta", "maria": "mia",
    "matthew": "matt", "michael": "mike mick mickey misha", "nicholas": "nick nicky", "nikolaos": "nikos niko", "patricia": "pat patty tricia", "patrick": "pat", "paolo": "paul", "peter": "pete", "philip": "phil", "rebecca": "becky becca",
    "richard": "rick dick richie", "robert": "bob rob bobby bert", "samuel": "sam sammy", "stephen": "steve", "susan": "sue susie suzy", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky vicki tori",
    "william": "will bill billy liam", "zoe": "zo", "anneliese": "anne anna liese", "anna": "ann annie", "marta": "martha", "tomas": "tom tomi", "olga": "olya", "lukasz": "luke lukas", "giovanni": "gianni", "francisco": "paco pancho", "ana": "anita",
}


@lru_cache(500_000)
def folded(word: str) -> str:
    """A plain word in which rewritten umlauts and doubled letters are alike."""
    w = re.sub(r"ae|oe|ue|aa", lambda m: m[0][0], word)
    return re.sub(r"(.)\1+", r"\1", w)


_FORMAL: dict[str, frozenset[str]] = {}
for _name, _shorts in SHORT.items():
    for _s in [_name, *_shorts.split()]:
        _FORMAL[folded(_s)] = _FORMAL.get(folded(_s), frozenset()) | {folded(_name)}


def name_parts(name: str | None) -> tuple[str, ...]:
    """Plain words of a name, sorted, without titles and particles; initials are single letters, each of its own."""
    if not name:
        return ()
    raw = re.findall(r"[^\W\d_]+", re.sub(r"(?<=\w)['’](?=\w)", "", repaired(name)))
    shouted = all(w.isupper() for w in raw if len(w) > 3)
    out: list[str] = []
    for i, w in enumerate(raw):
        p = plain(w)
        follows = raw[i + 1] if i + 1 < len(raw) else ""
        if p in TITLES or p in PARTICLES and (not w.isupper() or len(follows) > 3 and follows.isupper() or p in ("van", "von", "der", "del", "ten", "dos") and follows):
            continue
        if len(w) <= 3 and w.isupper() and not shouted and len(raw) > 1 or len(w) == 2 and w.isupper() and not re.search("[AEIOUY]", p.upper()):
            out += list(p)  # initials written together
            continue
        out.append(p)
    return tuple(sorted(out))


def is_given(word: str, given: frozenset[str]) -> bool:
    f = folded(word)
    return f in given or f in _FORMAL


def formal(word: str) -> frozenset[str]:
    f = folded(word)
    return _FORMAL.get(f, frozenset({f}))


def given_like(a: str, b: str) -> bool:
    """Whether two given names, or a given name and an initial, may be one."""
    if a == b:
        return True
    if len(a) == 1 or len(b) == 1:
        x, y = sorted((a, b), key=len)
        return y[:1] == x or any(f[:1] == x for f in formal(y))
    if formal(a) & formal(b):
        return True
    return len(a) > 3 and len(b) > 3 and (osa(a, b, 1) <= 1 or osa(folded(a), folded(b), 1) <= 1)


def surname_distance(a: str, b: str) -> int:
    """Typing errors between two surnames, rewritten letters and doubled ones aside; 3 if there are more than 2 or the names are short."""
    if a == b or folded(a) == folded(b):
        return 0
    if min(len(a), len(b)) < 5:
        return 3
    if any(x.startswith(p) and x[len(p) :] == y for x, y in ((a, b), (b, a)) for p in PARTICLES):
        return 0
    most = 1 if min(len(a), len(b)) < 9 else 2
    d = min(osa(a, b, most), osa(folded(a), folded(b), most))
    return d if d <= most else 3


def compatible(a: tuple[str, ...], b: tuple[str, ...], given: frozenset[str]) -> int:
    """2 if two names may be one person's, 1 if only through initials, 0 if they may not."""
    if a == b:
        return 2 if any(is_given(w, given) for w in a) or sum(len(w) > 2 for w in a) > 1 else 1
    ga, gb = [w for w in a if len(w) == 1 or is_given(w, given)], [w for w in b if len(w) == 1 or is_given(w, given)]
    left, right = [w for w in a if w not in ga], [w for w in b if w not in gb]
    hits, far = 0, 0
    for x in sorted(left, key=len, reverse=True):
        near = min(((surname_distance(x, y), y) for y in right), default=(3, ""))
        if near[0] < 3:
            left.remove(x)
            right.remove(near[1])
            hits += 1
            far = max(far, near[0])
    if not hits or left and right:  # a whole word on either side has no partner
        return 0
    if far > 1 and not any(len(x) > 1 and x in gb for x in ga):
        return 0
    # what is left of the longer name must be a misspelt or shortened given name, or one run together
    whole = not left and not right and hits > 1
    ga, gb = ga + left, gb + right
    if not ga or not gb:
        return 2 if whole else 0
    full, used = 0, 0
    right, rest = list(gb), []
    for x in sorted(ga, key=lambda w: (-len(w), w)):
        y = next((y for y in right if y == x), None) or next((y for y in right if len(y) > 1 and len(x) > 1 and given_like(x, y)), None) or next((y for y in right if given_like(x, y)), None)
        if y is None:
            rest.append(x)
        else:
            right.remove(y)
            used += 1
            full += len(x) > 1 and len(y) > 1
    if rest and right and sorted("".join(rest)) == sorted("".join(right)):
        return 2  # names run together
    if not used or rest and right:
        return 0
    # two whole given names that don't match aren't held together by an initial
    if full == 0 and any(len(w) > 1 for w in ga) and any(len(w) > 1 for w in gb):
        return 0
    return 2 if full or whole or used > 1 else 1


def _name_column(column) -> object:
    @F.pandas_udf("array<string>")
    def parts(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in names:
            yield s.map(lambda n: list(name_parts(n)))

    return parts(column)


def given_words(words: DataFrame) -> frozenset[str]:
    """Words seen beside so many different words that they are given names; the share bounds their number."""
    pairs = words.select(F.explode("parts").alias("w"), "parts").where("length(w) > 1").select("w", F.explode("parts").alias("v")).where("w <> v and length(v) > 3").distinct()
    beside = pairs.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    total = beside.count()
    return frozenset(folded(r["w"]) for r in beside.where(F.col("n") >= max(GIVEN_LEAST, GIVEN * total)).toLocalIterator())


def topic_fields(profiles: DataFrame) -> dict[str, str]:
    """The field of each topic: topics that occur together are of one field. The vocabulary is checked against MOST_TOPICS."""
    topics = profiles.select("profile_id", F.explode(F.array_distinct(F.expr("filter(transform(topics, t -> t.display_name), t -> t is not null)"))).alias("t"))
    counts = {r["t"]: r["n"] for r in topics.groupBy("t").agg(F.count(F.lit(1)).alias("n")).limit(MOST_TOPICS + 1).collect()}
    if len(counts) > MOST_TOPICS:
        raise ValueError(f"more than {MOST_TOPICS} topics")
    sets = profiles.select(F.array_sort(F.array_distinct(F.expr("filter(transform(topics, t -> t.display_name), t -> t is not null)"))).alias("s"))
    pairs = sets.select(F.explode(F.expr("flatten(transform(s, (a, i) -> transform(slice(s, i + 2, size(s)), b -> struct(a as a, b as b))))")).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
    root = {t: t for t in counts}

    def find(x: str) -> str:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for r in pairs.toLocalIterator():
        if r["n"] > SAME_FIELD * min(counts[r["a"]], counts[r["b"]]):
            x, y = sorted((find(r["a"]), find(r["b"])))
            root[y] = x
    return {t: find(t) for t in counts}


def _plain(df: DataFrame) -> DataFrame:
    """Joined by sorting: the many small joins of the rounds would otherwise each leave a broadcast with the driver."""
    return df.hint("merge")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``(node, component)`` of the undirected ``edges`` (a, b): the smallest label spreads by large-star and small-star steps.

    No group is gathered: every step is a minimum by key and a join. Lineage is cut each round in the shared folder. A state that still
    changes after ``rounds`` is refused; their number grows with the logarithm of the longest chain.
    """
    both = edges.select("a", "b").where("a <> b")
    edge, state = cut(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    for number in range(rounds):
        # large star: larger neighbours of a node go to its smallest neighbour
        around = edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(around.join(_plain(low), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # small star: smaller neighbours and the node itself go to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(_plain(low), "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        before, edge = edge, cut(small)
        release(before)
        release(large)
        if number >= 2:
            now = edge.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
            if now == state:
                break
            state = now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return edge.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(edge.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).distinct()


def _place(column):
    """An institution's name without department, country, case and marks, for comparison."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(column), r"^dept\.? [^,]*, ", ""), r",\s*[a-z]{2}$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\buniv\.?(?=\s|$)", "university"), r"\binst\.?(?=\s|$)", "institute")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\bctr\.?(?=\s|$)", "centre"), r"\blab\.?(?=\s|$)", "laboratory"), r"\b(of|de|the)\b", "")
    return F.nullif(F.regexp_replace(F.translate(bare, "àáâãäåçèéêëìíîïñòóôõöùúûü", "aaaaaaceeeeiiiinooooouuuu"), r"[^a-z0-9]", ""), F.lit(""))


def resolve(profiles: DataFrame) -> DataFrame:
    """``(profile_id, person)`` for every row; ``person`` is the smallest ``profile_id`` of the person's rows.

    Rows of one provider id or one ORCID are one person. Null or blank names are linked through these alone. Different ORCIDs are never one
    person, and different fields keep namesakes apart, unless they are at one institution and list each other's names. Repeated rows fall
    into the class of their provider id.
    """
    fields = topic_fields(profiles)
    spark = profiles.sparkSession
    field_of = spark.createDataFrame(sorted(fields.items()) or [("", "")], "topic string, field string")
    oid = F.upper(F.regexp_extract("orcid", r"(\d{4}\W?\d{4}\W?\d{4}\W?\d{3}[\dXx])", 1))
    given_id = lambda c: F.nullif(F.trim(c), F.lit(""))
    account = F.coalesce(F.concat(F.lit("A"), given_id("openalex_id")), F.concat(F.lit("S"), given_id("s2_author_id")), F.concat(F.lit("P"), F.col("profile_id").cast("string")))
    rows = profiles.select("profile_id", account.alias("account"), F.nullif(F.regexp_replace(oid, r"\W", ""), F.lit("")).alias("orcid"), _place(F.col("affiliation.display_name")).alias("place"), F.regexp_extract(F.upper(F.col("affiliation.id")), r"(I\d+)", 1).alias("place_id"), F.get(F.expr("filter(topics, t -> t.display_name is not null)"), 0)["display_name"].alias("topic"),
                           F.concat(F.array("display_name"), F.coalesce("display_name_alternatives", F.array().cast("array<string>"))).alias("names"))
    rows = rows.join(field_of, "topic", "left").drop("topic")
    spelled = cut(fanned(rows.select("profile_id", F.explode("names").alias("name"))).where("name is not null").withColumn("parts", _name_column(F.col("name"))).where("size(parts) > 0").select("profile_id", "parts").distinct())
    base = cut(rows.groupBy("account").agg(F.min("profile_id").alias("node"), F.max("orcid").alias("orcid"), F.max("field").alias("field"), F.max("place").alias("place"), F.max(F.nullif("place_id", F.lit(""))).alias("place_id")))
    member = rows.select("profile_id", "account").join(base.select("account", "node"), "account").select("profile_id", "node")
    names = cut(spelled.join(member, "profile_id").select("node", F.concat_ws(" ", "parts").alias("sig")).distinct())
    near = cut(near_names(names.select("sig").distinct()))

    # first round: identifiers, and names within a field
    fielded = names.join(base.where("field is not null").select("node", "field"), "node").select("node", F.concat_ws("|", F.lit("F"), "sig", "field").alias("key"), "sig", "field")
    cells = fielded.select("sig", "field", "key").distinct()
    sides = near.where("level = 2").join(cells.select(F.col("sig").alias("one"), "field", F.col("key").alias("k1")), "one").join(cells.select(F.col("sig").alias("two"), "field", F.col("key").alias("k2")), ["two", "field"]).select("k1", "k2")
    # an initial stands for a given name only if the field has one such name
    weak = near.where("level = 1")
    weak = weak.select(F.when(F.col("one_short"), F.col("one")).otherwise(F.col("two")).alias("short"), F.when(F.col("one_short"), F.col("two")).otherwise(F.col("one")).alias("long"), "full")
    bridged = weak.join(cells.select(F.col("sig").alias("short"), "field", F.col("key").alias("k1")), "short").join(cells.select(F.col("sig").alias("long"), "field", F.col("key").alias("k2")), ["long", "field"])
    clear = bridged.groupBy("short", "field").agg(F.size(F.collect_set("full")).alias("n")).where("n <= 1").select("short", "field")
    sides = sides.unionByName(bridged.join(clear, ["short", "field"]).select("k1", "k2"))
    number = lambda c: F.col(c)
    edges = (
        fielded.select(F.concat(F.lit("N"), number("node").cast("string")).alias("a"), F.col("key").alias("b"))
        .unionByName(sides.select(F.col("k1").alias("a"), F.col("k2").alias("b")))
        .unionByName(base.where("orcid is not null").select(F.concat(F.lit("N"), number("node").cast("string")).alias("a"), F.concat(F.lit("O"), "orcid").alias("b")))
    )
    found = components(edges.unionByName(_mutual(profiles, account, rows, base)))
    nodes = base.select("node", "orcid", "field", "place", "place_id").join(found.where("node like 'N%'").select(F.expr("substring(node, 2)").cast("long").alias("node"), "component"), "node", "left")
    state = cut(nodes.withColumn("person", F.coalesce("component", F.concat(F.lit("N"), number("node").cast("string")))).drop("component"))

    # further rounds: merged profiles with all their names, fields and places are matched again
    either = near.where("level > 0").select("one", "two", "level", F.col("one_short").alias("brief"))
    either = cut(either.unionByName(either.select(F.col("two").alias("one"), F.col("one").alias("two"), "level", F.expr("not brief").alias("brief"))).unionByName(names.select(F.col("sig").alias("one"), F.col("sig").alias("two"), F.lit(2).alias("level"), F.lit(False).alias("brief")).distinct()))
    while True:  # each round but the last lowers the number of people
        people = state.groupBy("person").agg(F.max("field").alias("field"), F.max("orcid").alias("orcid"))
        called = cut(names.join(_plain(state.select("node", "person")), "node").select("person", "sig").distinct().join(_plain(people), "person"))
        mine = called.where("field is null").select(F.col("person").alias("p"), F.col("sig").alias("one"), F.col("orcid").alias("po"))
        at = state.select("person", F.explode(F.array("place", "place_id")).alias("at")).where("at is not null").distinct()
        # of the open profiles of a name only the smallest, and the smallest of each place, are met by the others: never all with all
        still_open = called.where("field is null").select("sig", "person")
        first = still_open.groupBy("sig").agg(F.min("person").alias("person"))
        near_by = still_open.join(_plain(at), "person").groupBy("sig", "at").agg(F.min("person").alias("person")).select("sig", "person")
        met = called.where("field is not null").unionByName(called.join(_plain(first.unionByName(near_by).distinct()), ["sig", "person"], "left_semi").where("field is null").select(called.columns))
        theirs = met.select(F.col("person").alias("q"), F.col("sig").alias("two"), F.col("field").alias("qf"), F.col("orcid").alias("qo"))
        pairs = mine.join(_plain(either), "one").join(_plain(theirs), "two").where("p <> q and (po is null or qo is null or po = qo)")
        pairs = cut(pairs.groupBy("p", "q", "qf").agg(F.max("level").alias("level")))
        shared = pairs.select("p", "q").join(_plain(at.withColumnRenamed("person", "p")), "p").join(_plain(at.withColumnRenamed("person", "q")), ["q", "at"]).select("p", "q").distinct().withColumn("shared", F.lit(4))
        scored = cut(pairs.join(_plain(shared), ["p", "q"], "left").withColumn("score", F.coalesce("shared", F.lit(0)) + F.col("level") + F.when(F.col("qf").isNotNull(), 0.5).otherwise(0.0)))
        # the best candidate, if no other of a different field comes as near; of two open profiles the larger label joins the smaller
        ranked = scored.groupBy("p").agg(F.min_by(F.struct("q", "score", "qf"), F.struct(-F.col("score"), "q")).alias("best"))
        told = scored.join(_plain(ranked), "p").withColumn("rival", F.expr("q <> best.q and score >= best.score - 0.5 and qf is not null and (best.qf is null or qf <> best.qf)"))
        merge = told.groupBy("p").agg(F.max(F.coalesce("rival", F.lit(False))).alias("rival"), F.any_value("best").alias("best")).where("not rival and (best.qf is not null or p > best.q and best.score >= 2)").select("p", F.col("best.q").alias("q"))
        kin = cut(_kin(called, either, at))
        merge = cut(merge.unionByName(kin))
        for old in (called, pairs, scored, kin):
            release(old)
        if merge.isEmpty():
            break
        merge = _ends(merge)
        before, state = state, cut(state.join(_plain(merge.select(F.col("p").alias("person"), "q")), "person", "left").withColumn("person", F.coalesce("q", "person")).drop("q"))
        release(before)
    state = _parted(state, names)
    grouped = member.join(state.select("node", "person"), "node")
    first = grouped.groupBy("person").agg(F.min("profile_id").alias("first"))
    return grouped.join(first, "person").select("profile_id", F.col("first").alias("person"))


def _mutual(profiles: DataFrame, account, rows: DataFrame, base: DataFrame) -> DataFrame:
    """Edges (a, b) of accounts at one institution that list each other's name among their own spellings: one person, whatever their fields."""
    words = lambda c: F.array_join(F.array_sort(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)[^\W\d_]+"), F.lit(0))), " ")
    shown = profiles.select(account.alias("account"), words(F.col("display_name")).alias("own"), F.explode("display_name_alternatives").alias("x")).select("account", "own", words(F.col("x")).alias("also")).where("own <> '' and also <> '' and own <> also").distinct()
    at = rows.select("account", F.explode(F.array("place", F.nullif("place_id", F.lit("")))).alias("at")).where("at is not null").distinct()
    seen = shown.join(at, "account")
    both = seen.select(F.col("account").alias("x"), "own", "also", "at").join(seen.select(F.col("account").alias("y"), F.col("own").alias("also"), F.col("also").alias("own"), "at"), ["own", "also", "at"]).where("x < y").select("x", "y").distinct()
    told = base.select("account", "node", "orcid")
    both = both.join(told.select(F.col("account").alias("x"), F.col("node").alias("n"), F.col("orcid").alias("o")), "x").join(told.select(F.col("account").alias("y"), F.col("node").alias("m"), F.col("orcid").alias("q")), "y")
    return both.where("o is null or q is null or o = q").select(F.concat(F.lit("N"), F.col("n").cast("string")).alias("a"), F.concat(F.lit("N"), F.col("m").cast("string")).alias("b"))


def likeness(one: list[str], two: list[str]) -> float:
    """How alike the nearest of two people's names are, from 0 to 1."""
    return max((1 - osa(a, b, max(len(a), len(b))) / max(len(a), len(b), 1) for a in one for b in two), default=0.0)


def _parted(state: DataFrame, names: DataFrame) -> DataFrame:
    """The state without people of several ORCIDs: each ORCID is a person, and a profile without one goes to that whose names are nearest.

    A shared place counts as a tenth; a profile that is as near to two of them stays by itself. Such people come from names that could be
    two persons'; they are few, and each ORCID of one is compared with each of its profiles only.
    """
    many = state.groupBy("person").agg(F.count_distinct("orcid").alias("n")).where("n > 1").select("person")
    mixed = cut(state.join(many, "person", "left_semi").join(names, "node", "left").groupBy("person", "node", "orcid").agg(F.collect_set("sig").alias("sigs"), F.array_compact(F.array(F.max("place"), F.max("place_id"))).alias("places")))
    anchors = mixed.where("orcid is not null").groupBy("person", "orcid").agg(F.array_distinct(F.flatten(F.collect_list("sigs"))).alias("known"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("there"))
    pairs = mixed.where("orcid is null").select("person", "node", "sigs", "places").join(anchors, "person")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scores = [likeness(list(x), list(y)) + 0.1 * bool(set(p) & set(q)) for x, y, p, q in zip(b["sigs"], b["known"], b["places"], b["there"])]
            yield b[["person", "node", "orcid"]].assign(score=scores)

    told = pairs.select("person", "node", "orcid", "sigs", "known", "places", "there").mapInPandas(near, "person string, node long, orcid string, score double")
    best = told.groupBy("node").agg(F.max_by("orcid", "score").alias("to"), F.max("score").alias("top"))
    rivals = told.join(best, "node").where("orcid <> to and score > top - 0.02").select("node").distinct().withColumn("rival", F.lit(True))
    new = mixed.select("person", "node", "orcid").join(best, "node", "left").join(rivals, "node", "left")
    label = F.when(F.col("orcid").isNotNull(), F.concat_ws("|", "person", "orcid")).when(F.col("rival").isNull() & F.col("to").isNotNull(), F.concat_ws("|", "person", "to")).otherwise(F.concat(F.lit("N"), F.col("node").cast("string"), F.lit("|alone")))
    return cut(state.join(new.select("node", label.alias("label")), "node", "left").withColumn("person", F.coalesce("label", "person")).drop("label"))


def _kin(called: DataFrame, either: DataFrame, at: DataFrame) -> DataFrame:
    """``(p, q)``: people of one field that are one, by all the names and places that they have by now; the larger label joins the smaller.

    Names that agree in full are one person's in a field. An initial is settled for the person, not the spelling: it goes to the only person
    of the field that it may stand for or, of several, to the only one of a shared place. All names of the person must fit, so one whose
    initial is settled stays apart from the others it could have stood for.
    """
    own = called.where("field is not null")
    mine = own.select(F.col("person").alias("p"), F.col("sig").alias("one"), "field", F.col("orcid").alias("po"))
    theirs = own.select(F.col("person").alias("q"), F.col("sig").alias("two"), "field", F.col("orcid").alias("qo"))
    pairs = mine.join(_plain(either), "one").join(_plain(theirs), ["two", "field"]).where("p <> q and (po is null or qo is null or po = qo)")
    pairs = cut(pairs.groupBy("p", "q").agg(F.max("level").alias("level"), F.max("brief").alias("brief"), F.count_distinct("one").alias("fit")))
    sure = pairs.where("level = 2").select("p", "q")
    called_by = own.groupBy(F.col("person").alias("p")).agg(F.count_distinct("sig").alias("names"))
    weak = pairs.where("level = 1 and brief").join(_plain(called_by), "p").where("fit = names")
    shared = weak.select("p", "q").join(_plain(at.withColumnRenamed("person", "p")), "p").join(_plain(at.withColumnRenamed("person", "q")), ["q", "at"]).select("p", "q").distinct().withColumn("shared", F.lit(1))
    scored = weak.join(_plain(shared), ["p", "q"], "left").select("p", "q", F.coalesce("shared", F.lit(0)).alias("shared"))
    best = scored.groupBy("p").agg(F.max("shared").alias("most"))
    only = scored.join(_plain(best), "p").where("shared = most").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("q").alias("q")).where("n = 1").select("p", "q")
    return sure.unionByName(only).select(F.greatest("p", "q").alias("p"), F.least("p", "q").alias("q")).groupBy("p").agg(F.min("q").alias("q"))


def _ends(merge: DataFrame) -> DataFrame:
    """``(p, q)`` with every chain p -> q -> ... followed to its end; chains have no circles."""
    while True:
        hop = merge.select(F.col("p").alias("q"), F.col("q").alias("next"))
        if merge.join(_plain(hop), "q", "left_semi").isEmpty():
            return merge
        before, merge = merge, cut(merge.join(_plain(hop), "q", "left").select("p", F.coalesce("next", "q").alias("q")))
        release(before)


def near_names(sigs: DataFrame) -> DataFrame:
    """Pairs of the different names ``sigs`` that may be one person's: ``(one, two, level, one_short, full)``.

    Names are blocked by their surname-like words with at most one letter left out (a symmetric-delete index), so that any pair a typing
    error apart meets; words of nine or more letters, of which two errors are accepted beside an equal given name, also with two left out
    and that name. Pairs are made within a block of a rare word only, never among all names.
    """
    split = sigs.withColumn("parts", F.split("sig", " "))
    given = given_words(split)
    shared = sigs.sparkSession.sparkContext.broadcast(given)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for b in batches:
            out = []
            for sig in b["sig"]:
                parts = sig.split(" ")
                for i, w in enumerate(parts):
                    if len(w) < 2 or is_given(w, g):
                        continue
                    forms = {w, folded(w)} | {w[len(p) :] for p in PARTICLES if w.startswith(p) and len(w) - len(p) > 4}
                    ks = {f for x in forms for f in ([x] if len(x) < 5 else [x, *(x[:j] + x[j + 1 :] for j in range(len(x)))])}
                    # another word's first letter, short forms' too, goes with each: names of one person share one
                    firsts = {f[:1] for j, o in enumerate(parts) if j != i for f in formal(o) | {o}} or {""}
                    out += [(sig, k + "|" + f) for k in ks for f in firsts]
                    whole = {o for j, o in enumerate(parts) if j != i and len(o) > 1 and is_given(o, g)} if len(w) >= 9 else ()
                    if whole:
                        twice = {x[:j] + x[j + 1 : k] + x[k + 1 :] for x in {w, folded(w)} for k in range(len(x)) for j in range(k)}
                        out += [(sig, k + "||" + o) for k in twice | ks for o in whole]
            yield pd.DataFrame(out, columns=["sig", "key"])

    keyed = cut(fanned(sigs).mapInPandas(keys, "sig string, key string").select("sig", F.xxhash64("key").alias("key")))
    pairs = keyed.select(F.col("sig").alias("one"), "key").join(keyed.select(F.col("sig").alias("two"), "key"), "key").where("one < two").select("one", "two").distinct()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for b in batches:
            out = []
            for one, two in zip(b["one"], b["two"]):
                x, y = tuple(one.split(" ")), tuple(two.split(" "))
                level = compatible(x, y, g)
                if level:
                    # which name an initial stands for, by its first letters: two that differ make the initial ambiguous
                    short = sum(map(len, x)) < sum(map(len, y))
                    brief, longer = (x, y) if short else (y, x)
                    letters = {w for w in brief if len(w) == 1}
                    meant = sorted(min(formal(w))[:2] for w in longer if len(w) > 1 and (w[0] in letters or min(formal(w))[0] in letters) and w not in brief)
                    out.append((one, two, level, short, meant[0] if meant else ""))
            yield pd.DataFrame(out, columns=["one", "two", "level", "one_short", "full"])

    return fanned(pairs).mapInPandas(judge, "one string, two string, level int, one_short boolean, full string")


def person_pairs(profiles: DataFrame) -> DataFrame:
    """``(profile_id_1, profile_id_2)``: all pairs of rows of one person, smaller id first."""
    who = cut(resolve(profiles))
    return who.alias("x").join(who.alias("y"), F.expr("x.person = y.person and x.profile_id < y.profile_id")).select(F.col("x.profile_id").alias("profile_id_1"), F.col("y.profile_id").alias("profile_id_2"))
