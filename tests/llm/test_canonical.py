import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholion.llm.canonical import Reference, cleaned, map_values, map_venues, osa

NAMES = [("1", "Journal of Applied Optics"), ("2", "Archives of Applied Optics"), ("3", "Optics Letters"), ("4", "Annals of Marine Ecology"), ("5", "Optics and Marine Methods: Section A"), ("6", "Optics and Marine Methods: Section B"), ("4", "ANNALS OF MARINE ECOLOGY"), ("7", "Advances in Advanced Optics")]


@pytest.fixture(scope="module")
def ref():
    return Reference(NAMES, ["Leaf Press"])


@pytest.mark.parametrize(
    ("value", "key"),
    [
        ("Journal of Applied Optics", "1"), (" the JOURNAL  of applied optics. ", "1"), ("Jounral of Aplied Optics, vol. 12", "1"), ("J. Appl. Opt.", "1"), ("J.Appl.Opt.", "1"), ("J Appl Opt 2003", "1"), ("Applied Optics, Journal of", "1"), ("Journalof Applied Optics", "1"),
        ("Annals of Marine Ecology (Print) 12(3)", "4"), ("Published in Annals of Marine Ecology / Leaf Press", "4"), ("Annals of Marine Ecology, Leaf Press", "4"), ("Optics &amp; Marine Methods: Section B", "6"), ("Optics and Marine Methods: SectionA", "5"), ("JAO", "1"), ("A.M.E.", "4"),
        ("Adv. Adv. Opt.", "7"), ("Optics and Marine Methods: Section C", None), ("Journal of Marine Optics", None), ("Symposium on Applied Optics", None), ("Optics", None), ("", None), ("   ", None), ("-", None), ("2003", None), ("n/a", None), ("x" * 5000, None), (" ".join(["of"] * 50), None),
    ],
)
def test_denoted(ref, value, key):
    assert ref.denoted(value)[0] == key


def test_ambiguous_denotes_nothing():
    r = Reference([("1", "Journal of Optics"), ("2", "Journal of Options")])
    assert r.denoted("J. Opt.")[0] is None and r.denoted("JO")[0] is None and r.denoted("Journal of Optics")[0] == "1"


def brute(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_distance(a, b):
    assert min(osa(a, b, 2), 3) == min(brute(a, b), 3)


@settings(max_examples=100, deadline=None)
@given(st.text("opticsjurnal ", min_size=1, max_size=10))
def test_candidates_hold_all_words_in_reach(word):
    r = Reference(NAMES)
    t = word.replace(" ", "")
    got = r.candidates(t)
    for w in r.idf:
        if t not in r.idf and osa(t, w, 2) <= (0 if len(w) <= 3 else 1 if len(w) <= 5 else 2) and len(t) > 5:
            assert w in got


def test_tables(spark):
    j = spark.createDataFrame([(k, n, None, "Leaf Press") for k, n in NAMES] + [(None, "Null Journal", None, None), ("9", None, None, None)], "source_id string, title string, title_normalized string, publisher string")
    r = spark.createDataFrame([(1, "J. Appl. Opt."), (2, None), (3, "nothing"), (4, "J. Appl. Opt."), (4, "J. Appl. Opt.")], "rec_id long, venue string").withColumn("score", F.lit("clash")).withColumn("source_id", F.lit("clash"))
    got = sorted((x["rec_id"], x["source_id"]) for x in map_venues(r, j).collect())
    assert got == sorted([(1, "1"), (3, None), (4, "1"), (4, "1")], key=lambda x: (x[0], str(x[1])))
    assert map_venues(r.limit(0), j).count() == 0 and map_values(r, "venue", j.limit(0), "source_id", ["title"]).where("source_id is not null").count() == 0


def test_tables_agree_with_brute_force(spark):
    """The joins give what comparing each value with the whole list gives."""
    j, r = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("journals", "paper_records"))
    ref = Reference([(x["source_id"], n) for x in j.collect() for n in (x["title"], x["title_normalized"]) if n], [x["publisher"] for x in j.collect()])
    odd = ["Journalof Applied Optics", "x" * 5000, "of " * 60, "J. Appl. Opt.", "JAO", " - ", "Annals of Marin eEcology / Leaf Press"]
    got = {x["venue"]: (x["source_id"], round(x["score"], 9)) for x in map_values(r.unionByName(spark.createDataFrame([(v,) for v in odd], "venue string"), True), "venue", j, "source_id", ["title", "title_normalized"], "publisher").collect()}
    want = {v: ref.denoted(v) for v in got}
    assert {v: k for v, (k, _) in got.items()} == {v: k for v, (k, _) in want.items()} and all(abs(got[v][1] - s) < 1e-6 for v, (k, s) in want.items() if k)


def test_names_of_any_length(spark):
    """An entry of many words, given verbatim or with an error, is found; so is a value of thousands of characters."""
    long = " ".join(f"word{chr(97 + i)}{chr(97 + i // 3)}" for i in range(27))
    j = spark.createDataFrame([("1", long), ("2", "Short Name")], "source_id string, title string")
    r = spark.createDataFrame([(long,), (long.replace("wordcb", "wodrcb").upper(),), ("Short Name [" + "a note " * 300 + "]",), ("nothing " * 900,)], "venue string")
    got = [x["source_id"] for x in map_values(r, "venue", j, "source_id", ["title"]).orderBy(F.length("venue")).collect()]
    assert got == ["1", "1", "2", None]


def test_cleaned_keeps_plain_names():
    assert cleaned("Journal of Applied Optics") == "Journal of Applied Optics"
