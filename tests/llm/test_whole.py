"""Cases that an index or a filter once lost."""

import itertools

import pytest
from pyspark.sql import functions as F

from scholion.llm.canonical import Reference
from scholion.llm.entities import confidence, match_records, prepared
from scholion.llm.people import _ends, compatible, components, given_words, near_names, person_pairs

RECORD = "rec_id long, source string, title string, venue string, year int, publication_date string, authors array<struct<name:string,author_id:string>>"


def _accepted(prep) -> set:
    """All pairs that the comparison accepts, every record compared with every other."""
    p = [r.asDict() for r in prep.collect()]
    side = lambda r: (r["core"], r["kind"], r["y"] or 0, r["people"], r["venue"])
    return {tuple(sorted((a["rec_id"], b["rec_id"]))) for a, b in itertools.combinations(p, 2) if None not in (a["source"], b["source"]) and a["source"] != b["source"] and confidence(side(a), side(b)) >= 0.5}


def _found(df) -> set:
    return {(r["rec_id_1"], r["rec_id_2"]) for r in match_records(df).collect()}


def test_misspelt_words_are_not_filtered(spark):
    """p4: nearly every title word has a typing error, and so has the surname; a shortened title has a misspelt author."""
    t = "Characterization of photosynthetic microorganisms underneath Antarctic glaciers throughout midwinter"
    wrong = "Charracterization of photosyntheticc microorganismms underneaath Antarrctic glacierrs throughoutt midwinteer"
    people = lambda *names: [(n, None) for n in names]
    rows = [
        (1, "a", t, None, 2001, None, people("Wilhelmina Steurtaidis", "Ada Lovelace")), (2, "b", wrong, None, 2001, None, people("Wilhelmina Steurtaidis", "Ada Lovelace")),
        (3, "a", "Sediments of shallow lakes and their seasonal mixing: evidence out of twelve basins", None, 2003, None, people("Anneliese Steurtaidis")), (4, "b", "Sediments of shallow lakes and their seasonal", None, 2003, None, people("Annelise Steurtaiddis")),
    ]
    df = spark.createDataFrame(rows, RECORD)
    assert _found(df) == _accepted(prepared(df)) == {(1, 2), (3, 4)}


def test_titles_that_differ_at_the_beginning_meet(spark):
    """p4: errors in the first words and no authors; a title that says little with an error, its author given with an initial on one side."""
    t, wrong = "Thermohaline circulation beneath drifting sea ice shelves around the northern archipelago", "Thermohaaline circullation bbeneath driffting sea ice shelves around the northern archipelago"
    rows = [
        (1, "a", t, "Journal of Lakes", 2001, None, []), (2, "b", wrong, "Journal of Lakes", 2002, None, []),
        (3, "a", "Shallow sediments", "Journal of Lakes", None, "2003-02", [("Steurtaidis, Wilhelmina", None)]), (4, "b", "Shallow sedimments", "Journal of Lakes", 2003, None, [("W. Steurtaidis", None)]),
    ]
    df = spark.createDataFrame(rows, RECORD)
    assert _found(df) == _accepted(prepared(df)) == {(1, 2), (3, 4)}


def test_every_accepted_pair_is_found(spark):
    """p4: equality with brute force, not a share of it."""
    df = spark.read.parquet("/root/testdata/sf0.001/paper_records.parquet")
    assert _found(df) == _accepted(prepared(df))


PROFILE = "profile_id long, source string, openalex_id string, s2_author_id string, display_name string, display_name_alternatives array<string>, orcid string, affiliation struct<id:string,display_name:string>, topics array<struct<display_name:string,score:double>>"


def _profiles(spark, rows):
    """Rows of (id, name, ORCID, institution, topics)."""
    return spark.createDataFrame([(i, "s", None, str(i), name, None, orcid, (None, place), [(t, 0.5) for t in topics]) for i, name, orcid, place, topics in rows], PROFILE)


def _people(df) -> set:
    return {(r["profile_id_1"], r["profile_id_2"]) for r in person_pairs(df).collect()}


def test_people_with_a_field_are_matched_again(spark):
    """p7: an initial that two given names could stand for is settled by a place, or once both names turn out to be one person's."""
    lakes, one = ["lakes", "rivers"], "0000-0002-1825-0097"
    rows = [
        (1, "Robert Steurtaidis", None, "Univ. X", lakes), (2, "Richard Steurtaidis", None, "Univ. Y", lakes), (3, "R. Steurtaidis", None, "University of Y", lakes),
        (4, "Alexander Holgikeau", one, None, lakes), (5, "Andrew Holgikeau", one, None, lakes), (6, "A. Holgikeau", None, None, lakes),
        (7, "Robert Garewellis", None, "Univ. X", lakes), (8, "Richard Garewellis", None, "Univ. Y", lakes), (9, "R. Garewellis", None, "Univ. Z", lakes),
    ]
    assert _people(_profiles(spark, rows)) == {(2, 3), (4, 5), (4, 6), (5, 6)}


def test_no_chain_is_left_half_merged(spark):
    """p7: an unfinished state is refused, and chains of merges are followed to their end however long."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int")
    with pytest.raises(RuntimeError):
        components(chain, 3)
    assert {r["component"] for r in components(chain).collect()} == {0}
    assert {r["q"] for r in _ends(spark.createDataFrame([(f"{i:02}", f"{i - 1:02}") for i in range(1, 20)], "p string, q string")).collect()} == {"00"}


def test_near_names_are_all_found(spark):
    """p7: against all pairs of a small table: two errors in a long surname, surnames of two letters."""
    given, surnames = ["robert", "richard", "thomas"], ["volgemetard", "volegmetord", "ilmovislyan", "ilmvosilyan", "steurtaidis", "steurtiadsi", "holgikeau", "holgikau", "li", "wu", "moeller", "moller"]
    sigs = sorted({" ".join(sorted(x)) for s in surnames for x in ([s, "robert"], [s, "richard"], [s, "r"], [s, "bob"], [s, "k", "thomas"])})
    df = spark.createDataFrame([(s,) for s in sigs], "sig string")
    words = given_words(df.withColumn("parts", F.split("sig", " "))) | frozenset(given)
    want = {(a, b) for a, b in itertools.combinations(sigs, 2) if compatible(tuple(a.split(" ")), tuple(b.split(" ")), words)}
    got = {(r["one"], r["two"]) for r in near_names(df).collect()}
    assert ("robert volegmetord", "robert volgemetard") in want and ("li r", "li robert") in want
    assert got == want


def test_a_long_note_hides_no_venue():
    """p1: a value is cleaned before it is judged by its length; a title may have any number of words."""
    long = "Journal of " + " ".join(f"w{chr(97 + i)}rd{chr(97 + i)}ology" for i in range(26))
    r = Reference([("1", "Journal of Optics"), ("2", long)])
    assert r.denoted("Journal of Optics (" + "formerly known by other names " * 20 + ")")[0] == "1"
    assert r.denoted(long)[0] == "2" and r.denoted("x" * 5000)[0] is None
