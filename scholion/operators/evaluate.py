"""Retrieval metrics against relevance judgements, and checks of answers against their contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.text import citation_markers, numeric_citations, overlap_ratio, sentences, terms


def ir_metrics(run: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = (10, 20), most: int = 20) -> DataFrame:
    """Per judged query: precision, recall, F1, NDCG at each cutoff, and the reciprocal rank.

    ``run`` is (query_id, key, rank), ``qrels`` (query_id, key, rel). Repeated keys of a query count at their first rank, and at most
    ``most`` keys count. Precision is over the keys returned, the ideal order is cut to as many keys as were returned; a judged query
    without results has zeros.
    """
    first = run.groupBy("query_id", "key").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id").orderBy("rank", "key")
    cut = first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    rels = qrels.groupBy("query_id", "key").agg(F.max("rel").alias("rel"))
    joined = cut.join(rels, ["query_id", "key"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    gain = F.col("rel") / F.log2(F.col("r") + 1.0)
    aggs = []
    for k in cutoffs:
        within = F.col("r") <= k
        aggs += [F.count_if(within).alias(f"n_{k}"), F.count_if(within & (F.col("rel") > 0)).alias(f"hits_{k}"), F.sum(F.when(within, gain)).alias(f"dcg_{k}")]
    got = joined.groupBy("query_id").agg(*aggs, F.min(F.when(F.col("rel") > 0, F.col("r"))).alias("first_hit"))
    ideal = rels.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rel").desc(), "key"))).where(F.col("i") <= max(cutoffs))
    ideal = ideal.join(got.select("query_id", *(f"n_{k}" for k in cutoffs)), "query_id", "left")
    best = ideal.groupBy("query_id").agg(*(F.sum(F.when(F.col("i") <= F.least(F.lit(k), F.col(f"n_{k}")), F.col("rel") / F.log2(F.col("i") + 1.0))).alias(f"idcg_{k}") for k in cutoffs))
    relevant = rels.groupBy("query_id").agg(F.count_if(F.col("rel") > 0).alias("relevant"))
    out = relevant.join(got, "query_id", "left").join(best, "query_id", "left")
    cols = []
    for k in cutoffs:
        hits = F.coalesce(F.col(f"hits_{k}"), F.lit(0))
        p = F.when(F.coalesce(F.col(f"n_{k}"), F.lit(0)) > 0, hits / F.col(f"n_{k}")).otherwise(0.0)
        r = F.when(F.col("relevant") > 0, hits / F.col("relevant")).otherwise(0.0)
        cols += [p.alias(f"precision_{k}"), r.alias(f"recall_{k}"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias(f"f1_{k}"), F.coalesce(F.col(f"dcg_{k}") / F.nullif(F.col(f"idcg_{k}"), F.lit(0.0)), F.lit(0.0)).alias(f"ndcg_{k}")]
    return out.select("query_id", *cols, F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("mrr"))


def mean_metrics(per_query: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Arithmetic means of all metric columns, and the number of queries."""
    names = [c for c in per_query.columns if c not in ("query_id", *by)]
    return per_query.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), *(F.avg(c).alias(c) for c in names))


def mean_with_skips(rows: DataFrame, value: str, skip: str | None = None) -> DataFrame:
    """Mean of the numeric values of a text column, rows marked ``skip`` left out; null where none is left."""
    number = F.trim(F.col(value)).try_cast("double") if dict(rows.dtypes)[value] == "string" else F.col(value)
    kept = F.when(~F.coalesce(F.col(skip), F.lit(False)), number) if skip else number
    return rows.agg(F.avg(kept).alias("mean"), F.count(kept).alias("used"))


def citation_validity(answers: DataFrame) -> DataFrame:
    """Per answer: distinct markers, how many are valid, and the ratio (0 without markers).

    ``answers`` has id, answer, contexts, paper_ids, truth_ids (arrays, null as empty). Only what comes before a marker's ``|`` counts. A
    number is valid from 1 to the number of contexts that aren't blank, or of paper ids where there is none; any other marker is, if it
    is a paper's or truth's id or is cited in a context.
    """
    filled = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    trimmed = lambda c: F.transform(c, lambda x: F.trim(x))
    out = answers.select("id", F.array_distinct(citation_markers("answer")).alias("marks"), filled("contexts").alias("contexts"), filled("paper_ids").alias("paper_ids"), filled("truth_ids").alias("truth_ids"))
    known = F.concat(trimmed(F.col("paper_ids")), trimmed(F.col("truth_ids")), F.flatten(F.transform("contexts", lambda c: citation_markers(c))))
    most = F.when(F.size("contexts") > 0, F.size("contexts")).otherwise(F.size("paper_ids"))
    out = out.withColumn("known", known).withColumn("most", most)
    bare = lambda m: F.trim(F.substring_index(m, "|", 1))
    valid = F.filter("marks", lambda m: F.when(bare(m).rlike(r"^\d+$"), F.coalesce(bare(m).try_cast("int").between(F.lit(1), F.col("most")), F.lit(False))).otherwise(F.array_contains("known", bare(m))))
    out = out.select("id", F.size("marks").alias("markers"), F.size(valid).alias("valid"))
    return out.withColumn("validity", F.when(F.col("markers") > 0, F.col("valid") / F.col("markers")).otherwise(0.0))


def numeric_citation_check(answers: DataFrame) -> DataFrame:
    """Per answer with ``papers`` in its context: citations, right, hallucinated and missing ones, and the accuracy."""
    c = F.array_distinct(numeric_citations("answer"))
    out = answers.select("id", "papers", c.alias("c"))
    right = F.size(F.filter("c", lambda x: (x >= 1) & (x <= F.col("papers"))))
    return out.select("id", F.size("c").alias("total"), right.alias("correct"), (F.size("c") - right).alias("hallucinated"), F.greatest(F.lit(0), F.col("papers") - F.size("c")).alias("missing"), F.when(F.size("c") > 0, right / F.size("c")).otherwise(0.0).alias("accuracy"))


def text_match(pairs: DataFrame, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """Per (id, answer, context): distinct terms of the answer, those found in the context, their percentage, and suspicious sentences.

    A sentence of four or more words is suspicious if under 40 % of its terms are in the context.
    """
    low = F.lower("context")
    own = terms("answer", stopwords)
    hits = lambda ts: F.size(F.filter(ts, lambda t: F.contains(low, t)))
    bad = F.filter(sentences("answer"), lambda s: (F.size(F.split(F.trim(s), r"\s+")) >= 4) & (F.size(terms(s, stopwords)) > 0) & (hits(terms(s, stopwords)) / F.size(terms(s, stopwords)) < 0.4))
    out = pairs.select("id", "context", own.alias("own"), F.size(bad).alias("suspicious")).withColumn("matched", F.size(F.filter("own", lambda t: F.contains(F.lower("context"), t))))
    return out.select("id", F.size("own").alias("terms"), "matched", F.when(F.size("own") > 0, 100.0 * F.col("matched") / F.size("own")).otherwise(0.0).alias("percentage"), "suspicious")


def passage_overlap(rows: DataFrame) -> DataFrame:
    """Best share of a key passage's tokens that any one of its contexts has: (id, passage, contexts)."""
    exploded = rows.select("id", "passage", F.explode_outer("contexts").alias("context"))
    return exploded.groupBy("id").agg(F.max(F.coalesce(overlap_ratio("passage", "context"), F.lit(0.0))).alias("overlap"))


# Phrases by which an answer says that it has no evidence.
NO_EVIDENCE = ("don't know", "do not know", "not provided", "no evidence", "does not contain evidence", "insufficient evidence", "cannot be determined")


def says_no_evidence(text):
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    out = F.lit(False)
    for p in NO_EVIDENCE:
        out = out | low.contains(p)
    return out


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that aren't evaluated yet."""
    return rows.join(done.select(key), key, "left_anti")


def run_statistics(log: DataFrame, by: str, seconds: str) -> DataFrame:
    """Count, mean, least, most and median time of each kind of run, from the counts of equal times, so that no kind is gathered."""
    counts = log.groupBy(by, seconds).agg(F.count(F.lit(1)).alias("n"))
    timed = F.when(F.col(seconds).isNotNull(), F.col("n"))
    return counts.groupBy(by).agg(F.sum("n").alias("runs"), (F.sum(F.col(seconds) * timed) / F.sum(timed)).alias("mean"), F.min(seconds).alias("least"), F.max(seconds).alias("most"), F.expr(f"percentile(`{seconds}`, 0.5D, n)").alias("median"))


def compared_runs(one: DataFrame, two: DataFrame, k: int = 10) -> DataFrame:
    """Per query of two rankings: how many of the first ``k`` keys they share, and how many rows more the second has."""
    top = lambda r, n: r.groupBy("query_id").agg(F.count(F.lit(1)).alias(n))
    both = one.where(F.col("rank") <= k).select("query_id", "key").join(two.where(F.col("rank") <= k).select("query_id", "key"), ["query_id", "key"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("shared"))
    out = top(one, "rows_1").join(top(two, "rows_2"), "query_id", "full").join(both, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("query_id", zero("shared").alias("shared"), (zero("rows_2") - zero("rows_1")).alias("more"))


def bare_keys(ranking: DataFrame, prefix: str = "beir_") -> DataFrame:
    """A ranking whose keys lack a corpus' prefix."""
    return ranking.withColumn("key", F.regexp_replace("key", f"^{prefix}", ""))


def chunks_else_papers(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """The ranking (query_id, key, rank) that is judged: a query's chunks by their papers, or its papers where it has no chunk."""
    return chunks.select("query_id", "key", "rank").unionByName(papers.join(chunks.select("query_id"), "query_id", "left_anti").select("query_id", "key", "rank"))


def reranked_abstracts(queries: DataFrame, papers: DataFrame, ranking: DataFrame, top: int = 100, k: int = 20, load=None) -> DataFrame:
    """The first ``top`` papers of each query as chunks of their abstracts, ranked anew and cut to ``k``; ``papers`` is (key, abstract), null ones empty."""
    from scholion.operators.pipelines import rerank

    pairs = ranking.where(F.col("rank") <= top).select("query_id", "key")
    texts = papers.select("key", F.coalesce("abstract", F.lit("")).alias("text"))
    return rerank(queries, pairs, texts, k, load)


def variants(original: DataFrame, split: DataFrame, queries: DataFrame, papers: DataFrame, qrels: DataFrame, load=None) -> DataFrame:
    """Metrics of four ways to search, a row a query and variant: whole or split queries, before and after reranking.

    ``original`` and ``split`` are rankings of papers; each is made once and judged twice.
    """
    out = None
    for name, ranking in (("original", original), ("decomposed", split)):
        for stage, run in (("before_rerank", ranking), ("after_rerank", reranked_abstracts(queries, papers, ranking, load=load))):
            m = ir_metrics(bare_keys(run), qrels).withColumn("variant", F.lit(f"{name}_{stage}"))
            out = m if out is None else out.unionByName(m)
    return out


def id_hits(rows: DataFrame) -> DataFrame:
    """Whether any id retrieved is a true one: (id, hit), 1 or 0, from (id, paper_ids, truth_ids); blank ids count for nothing."""
    kept = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("id", F.arrays_overlap(kept("paper_ids"), kept("truth_ids")).cast("double").alias("hit")).withColumn("hit", F.coalesce("hit", F.lit(0.0)))


def embedded_agreement(rows: DataFrame, one: str, two: str, load=None, prefixes: tuple[str, str] = ("search_query: ", "search_document: ")) -> DataFrame:
    """Cosine of two embedded texts, held between 0 and 1; 0 where either is null or blank. Question and answer, or key passage and answer."""
    from scholion.functions.scorers import embedding, hashing_embedder
    from scholion.operators.search import cosine

    load = load or hashing_embedder
    e = rows.select("id", F.trim(F.col(one)).alias("x"), F.trim(F.col(two)).alias("y"))
    e = e.select("id", "x", "y", embedding("x", load, prefixes[0]).alias("v"), embedding("y", load, prefixes[1]).alias("w"))
    return e.select("id", clamped(F.when((F.col("x") != "") & (F.col("y") != ""), cosine("v", "w"))).alias("agreement"))


def clamped(c):
    """Between 0 and 1; 0 where it is null."""
    return F.when(c.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def validated(answers: DataFrame, w_citations: float = 0.8, w_grounding: float = 0.2) -> DataFrame:
    """Per (id, answer, context): citations by number, right, hallucinated and missing ones, accuracy and the overall score.

    A number is right from 1 to what the context offers: its markers, or else the larger number of the papers and chunks it names. The
    score weighs the citations and the grounding, which both are the accuracy.
    """
    from scholion.functions.text import MARKER, marker_numbers
    from scholion.operators.answers import context_chunks, context_papers

    marks = F.size(F.regexp_extract_all(F.coalesce("context", F.lit("")), F.lit("(?i)" + MARKER), F.lit(0)))
    c = answers.select("id", marker_numbers(F.coalesce("answer", F.lit(""))).alias("cited"), marks.alias("marks"), F.size(context_papers(F.coalesce("context", F.lit("")))).alias("papers"), F.size(context_chunks(F.coalesce("context", F.lit("")))).alias("chunks"))
    most = F.when(F.col("marks") > 0, F.col("marks")).otherwise(F.greatest("papers", "chunks"))
    c = c.withColumn("total", F.size("cited")).withColumn("most", most).withColumn("correct", F.size(F.filter("cited", lambda x: (x >= 1) & (x <= F.col("most")))))
    c = c.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0))
    return c.select("id", "total", "correct", (F.col("total") - F.col("correct")).alias("hallucinated"), F.greatest(F.lit(0), F.col("papers") - F.col("total")).alias("missing"), "accuracy", clamped(w_citations * F.col("accuracy") + w_grounding * F.col("accuracy")).alias("overall"))


def written_back(stored: DataFrame, results: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows, counters): stored rows with a result's non-null scores, and how many results were attempted, updated, missing, invalid or without id.

    ``results`` has ``validation_id`` as text, ``pos`` and the score columns; of several results of an id the last by ``pos`` holds.
    ``columns`` names the stored column of each score.
    """
    r = results.withColumn("vid", F.trim(F.col("validation_id").cast("string")).try_cast("long"))
    known = stored.select(F.col("id").alias("vid")).withColumn("there", F.lit(True))
    told = r.join(known, "vid", "left")
    good = F.col("vid") > 0
    counters = told.agg(
        F.count_if(good).alias("attempted"), F.count_if(good & F.col("there").isNotNull()).alias("updated"), F.count_if(good & F.col("there").isNull()).alias("missing"), F.count_if(F.col("vid") <= 0).alias("invalid"), F.count_if(F.col("vid").isNull()).alias("skipped_no_id"),
    )
    last = r.where("vid > 0").groupBy("vid").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(f"_{c}") for c in columns))
    joined = stored.join(last, F.col("id") == F.col("vid"), "left")
    score = {new: old for old, new in columns.items()}
    return joined.select(*(F.coalesce(F.col(f"_{score[c]}"), F.col(c)).alias(c) if c in score else F.col(c) for c in stored.columns)), counters


def progress_summary(rows: DataFrame, done: DataFrame, key: str, scores: list[str]) -> DataFrame:
    """One row of a run that can be taken up again: how many rows are done and left, how many of them say that they have no evidence, and mean scores so far."""
    g = done.agg(F.count(F.lit(1)).alias("done"), F.count_if(F.coalesce("no_evidence", F.lit(False))).alias("no_evidence"), *(F.avg(c).alias(c) for c in scores))
    left = pending(rows, done, key).agg(F.count(F.lit(1)).alias("left"))
    return g.crossJoin(left)  # one row each
