"""Closed-form scores as columns; their weights, steps and caps are fixed values that scores of other tools are compared with. Years are compared with a given one, never with the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The parts that the scores below have in a ranking of papers, in one of authors, and in exploration.
WEIGHTS = {
    "citation_quality": 0.25, "venue_prestige": 0.20, "institution_reputation": 0.15, "influential_citations": 0.15, "recency_factor": 0.10, "open_access_bonus": 0.05, "field_normalization": 0.10,
    "author_h_index": 0.20, "author_citation_count": 0.15, "coauthor_network": 0.15, "author_productivity": 0.10, "diversity_boost": 0.15, "novelty_score": 0.10,
}


def _n(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def cap(c: Column, most: float) -> Column:
    return F.least(c, F.lit(float(most)))


def paper_rank(relevance: Column, citations: Column, quartile: Column, w_relevance: float = 0.7, w_authority: float = 0.3) -> Column:
    """Relevance and authority on a scale of 100; little relevance damps the authority."""
    rel = F.lit(100.0) * F.greatest(F.coalesce(relevance, F.lit(0.0)), F.lit(0.0))
    bonus = F.when(F.upper(quartile) == "Q1", 30.0).when(F.upper(quartile) == "Q2", 15.0).when(F.upper(quartile) == "Q3", 5.0).otherwise(0.0)
    authority = cap(20.0 * F.log10(_n(citations) + 1.0), 70) + bonus
    authority = F.when(rel < 30, authority * rel / 30).otherwise(authority)
    return w_relevance * rel + w_authority * authority


def paper_rank_decayed(evidence: Column, citations: Column, year: Column, quartile: Column, as_of: int) -> Column:
    """Evidence times citation, age and venue factors."""
    cited = F.least(F.lit(1.3), 1.0 + 0.1 * F.log10(1.0 + _n(citations)))
    age = F.when(year.isNull(), 1.0).otherwise(F.exp(-0.15 * F.greatest(F.lit(0), F.lit(as_of) - year)))
    venue = F.when(F.upper(quartile) == "Q1", 1.15).when(F.upper(quartile) == "Q2", 1.0).otherwise(0.9)
    return evidence * cited * age * venue


def citation_quality(citations: Column, year: Column, fwci: Column, percentile: Column, top_tenth: Column, as_of: int) -> Column:
    c = _n(citations)
    velocity = c / F.greatest(F.lit(1), F.lit(as_of) - year)
    score = F.when(c > 0, cap(10 * F.log10(c + 1.0), 40)).otherwise(0.0) + F.when(fwci.isNotNull(), cap(10 * fwci, 30)).otherwise(0.0)
    score = score + F.when(year.isNotNull() & (c > 0), cap(5 * F.log10(velocity + 1), 15)).otherwise(0.0)
    score = score + F.when(percentile >= 99, 10).when(percentile >= 95, 7).when(percentile >= 90, 5).otherwise(0) + F.when(F.coalesce(top_tenth, F.lit(False)), 5).otherwise(0)
    return cap(score, 100)


def listed_venue_prestige(quartile: Column, h_index: Column, cites_per_doc: Column, sjr: Column, diamond: Column) -> Column:
    """Prestige of a venue in the journal list."""
    q, h, d, s = F.upper(quartile), _n(h_index), _n(cites_per_doc), _n(sjr)
    score = F.lit(20.0) + F.when(q == "Q1", 50).when(q == "Q2", 35).when(q == "Q3", 20).when(q == "Q4", 10).otherwise(0)
    score = score + F.when(h > 200, 20).when(h > 100, 15).when(h > 50, 10).when(h > 20, 5).otherwise(0) + F.when(d > 10, 15).when(d > 5, 10).when(d > 2, 5).otherwise(0)
    return cap(score + F.when(s > 2, 10).when(s > 1, 5).otherwise(0) + F.when(F.coalesce(diamond, F.lit(False)), 5).otherwise(0), 100)


# Names that mark a venue that isn't in the list.
TOP_NAMES = ("nature", "science", "cell", "lancet", "nejm", "pnas", "jama")


def unlisted_venue_prestige(name: Column, kind: Column, open_access: Column) -> Column:
    low = F.lower(name)
    top = F.lit(False)
    for w in TOP_NAMES:
        top = top | low.contains(w)
    named = F.when(top, 40).when(low.contains("ieee") | low.contains("acm"), 25).when(low.contains("conference") | low.contains("proceedings"), 15).otherwise(0)
    return cap(F.lit(25.0) + F.coalesce(named, F.lit(0)) + F.when(kind == "journal", 10).when(kind == "conference", 5).otherwise(0) + F.when(F.coalesce(open_access, F.lit(False)), 5).otherwise(0), 100)


def institution_base(kind: Column, citations: Column) -> Column:
    c = _n(citations)
    return F.lit(40.0) + F.when(kind == "education", 10).otherwise(0) + F.when(c > 1_000_000, 30).when(c > 100_000, 20).when(c > 10_000, 10).otherwise(0)


def institution_reputation(best_base: Column, countries: Column, institutions: Column) -> Column:
    return cap(F.coalesce(best_base, F.lit(40.0)) + F.least(F.lit(10), _n(countries) * 2) + F.least(F.lit(5), _n(institutions)), 100)


def author_reputation(h_index: Column, citations: Column, papers: Column) -> Column:
    h, c, p = _n(h_index), _n(citations), _n(papers)
    score = F.lit(20.0) + F.least(F.lit(30), 2 * h) + F.when(c > 0, 4 * F.log10(c + 1.0)).otherwise(0.0) + F.when(p > 0, cap(3 * F.log10(p + 1.0), 15)).otherwise(0.0)
    return cap(score, 100)


def diversity(year: Column, topics: Column, shown: Column, open_access: Column, as_of: int) -> Column:
    age = F.lit(as_of) - year
    fresh = F.when(age <= 2, 20).when(age <= 5, 10).when(age <= 10, 5).otherwise(0)
    new = F.size(F.array_except(topics, shown))
    bonus = F.when((F.size(topics) > 0) & (F.size(shown) > 0), F.least(F.lit(20), 5 * new)).otherwise(0)
    return cap(F.lit(50.0) + F.coalesce(fresh, F.lit(0)) + F.coalesce(bonus, F.lit(0)) + F.when(F.coalesce(open_access, F.lit(False)), 10).otherwise(0), 100)


def h_index_estimate(citations: Column, papers: Column) -> Column:
    return F.least(F.floor(F.sqrt(_n(citations).cast("double"))), _n(papers))


def field_strength(in_field: Column, papers: Column) -> Column:
    return F.when((_n(in_field) > 0) & (_n(papers) > 0), cap(15 * F.log10(in_field + 1.0), 50) + 50.0 * in_field / papers).otherwise(0.0)


def institution_score(papers: Column, citations: Column, h_index: Column, highly_cited: Column, fwci: Column, international: Column, notable: Column) -> Column:
    """Seven capped terms of an institution's output and impact."""
    p, c = _n(papers), _n(citations)
    share = lambda n: F.when(p > 0, _n(n) / p).otherwise(0.0)
    score = F.when(p > 0, cap(5 * F.log10(p + 1.0), 20)).otherwise(0.0) + F.when(c > 0, cap(3 * F.log10(c + 1.0), 25)).otherwise(0.0) + cap(_n(h_index) / 5.0, 20)
    return cap(score + 15 * share(highly_cited) + cap(5 * F.greatest(F.coalesce(fwci, F.lit(0.0)), F.lit(0.0)), 10) + 5 * share(international) + cap(0.5 * _n(notable), 5), 100)


def conflict(a: Column, b: Column, threshold: float = 0.6, one_sided: bool = True) -> Column:
    """Whether two counts differ by the threshold or more of the larger; ``one_sided``: a missing side is a conflict."""
    far = F.abs(a - b) / F.greatest(a, b) >= threshold
    return F.when(a.isNull() & b.isNull(), False).when(a.isNull() | b.isNull(), one_sided).when(F.greatest(a, b) == 0, False).otherwise(far)
