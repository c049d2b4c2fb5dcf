"""Operators around answers and their contexts: claims by source, context assembly, plans from model output, merged rounds of search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.text import GREETINGS, looks_like_identifier, marked_claims, normalize_doi, question_key, repeats, shannon_entropy, vowel_ratio
from scholion.operators.search import rrf


def boosted_similarity(rows: DataFrame, similarity: str, open_access: Column, boost: float = 1.1, least: float | None = None, k: int | None = None, group: str = "query_id", key: str = "key") -> DataFrame:
    """Similarities raised by ``boost`` for open access; the best ``k`` of a query, or all of at least ``least``, or by default 0.5 or open access."""
    oa = F.coalesce(open_access, F.lit(False))
    out = rows.withColumn("boosted", F.col(similarity) * F.when(oa, boost).otherwise(1.0))
    if k is not None:
        w = Window.partitionBy(group).orderBy(F.round("boosted", 9).desc(), key)
        return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.where(F.col("boosted") >= least) if least is not None else out.where((F.col("boosted") >= 0.5) | oa)


def valid_rows(rows: DataFrame, required: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows in which each required field has a non-blank value under one of its names; the field takes the first."""
    filled = {f: F.coalesce(*(F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names)) for f, names in required.items()}
    cond = F.lit(True)
    for c in filled.values():
        cond = cond & c.isNotNull()
    keep = [c for c in rows.columns if c not in filled]
    return rows.where(cond).select(*keep, *(c.alias(f) for f, c in filled.items()))


def claims_by_source(answers: DataFrame) -> DataFrame:
    """Per (id, source) of the markers in ``answer``: number of claims, first place, longest claim, and a confidence.

    The confidence starts at 0.8, goes up a tenth for claims of over 100 characters in the mean and down one for under 30, up 0.05 for
    standing in the body and 0.05 for more than two claims. Ties of length go to the earlier claim.
    """
    c = answers.select("id", F.explode(marked_claims("answer")).alias("c")).select("id", "c.*")
    g = c.groupBy("id", "source").agg(F.count(F.lit(1)).alias("claims"), F.min("position").alias("first"), F.max_by("claim", F.struct(F.length("claim"), -F.col("position"))).alias("longest"), F.floor(F.avg(F.length("claim"))).alias("mean"))
    step = F.when(F.col("mean") > 100, 0.1).when(F.col("mean") < 30, -0.1).otherwise(0.0) + 0.05 + F.when(F.col("claims") > 2, 0.05).otherwise(0.0)
    return g.select("id", "source", "claims", "first", "longest", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.8 + step)), 9).alias("confidence"))


def grouped_ids(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, pos, value)``: the distinct values of each key, each in a row of its own with its place in order.

    A key of any number of values is never gathered: values are made distinct map-side, and the places are those of a window over them.
    """
    own = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value).distinct()
    return own.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(value)))


def spread(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, median, least, most and distinct values by group, from the counts of equal values, so that no group is gathered."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg((F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"), F.expr(f"percentile(`{value}`, 0.5D, n)").alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(F.lit(1)).alias("values"))


# The form of a context that is handed to a model, and the ways in which it names papers and chunks.
LEGEND, CONTENT = "--- REFERENCE LEGEND ---", "--- RESEARCH CONTENT ---"
PAPER_NAMES = (r"(?m)(?:^|\n)SOURCE_ID:\s*([^\n\r]+)", r"(?m)(?:^|\n)PAPER\s+ID:\s*([^\n\r]+)", r"(?m)(?:^|\n)paper_id:\s*([^\n\r]+)", r"(?m)(?:^|\n)paperId:\s*([^\n\r]+)", r'"paperId":\s*"([^"]+)"', r'"paper_id":\s*"([^"]+)"', r'"id":\s*"([^"]+)"')
CHUNK_NAMES = (r"(?m)(?:^|\n)CHUNK_ID:\s*([^\n\r]+)", r"(?m)(?:^|\n)chunk_id:\s*([^\n\r]+)", r'"chunkId":\s*"([^"]+)"', r'"chunk_id":\s*"([^"]+)"')


def assembled_context(papers: DataFrame, chunks: DataFrame, base: int = 0) -> DataFrame:
    """``(query_id, context, papers, chunks)``: a legend of each query's papers, numbered from ``base``, and its chunks under these numbers.

    ``papers`` has query_id, rank, paper, title, year, doi, citation; ``chunks`` query_id, rank, paper, chunk_id, section, text. Both are
    top-k lists; texts are whole. Chunks of a paper that isn't in the legend have the number UNKNOWN.
    """
    w = Window.partitionBy("query_id").orderBy("rank", "paper")
    p = papers.withColumn("number", F.row_number().over(w) + (base - 1))
    or_ = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other))
    line = F.concat(F.lit("PAPER ID: "), F.col("number"), F.lit(" | Title: "), or_("title", ""), F.lit(" ("), or_("year", "N/A"), F.lit(") | DOI: "), or_("doi", "N/A"), F.lit(" | APA: "), or_("citation", "N/A"))
    block = F.concat(F.lit("SOURCE_ID: "), or_("number", "UNKNOWN"), F.lit("\nCHUNK_ID: "), F.col("chunk_id"), F.lit("\nSECTION: "), F.coalesce(F.nullif("section", F.lit("")), F.lit("Main text")), F.lit("\nCONTENT: "), or_("text", ""))
    ordered = lambda rows, text, name: rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", text.alias("t")))), lambda x: x["t"]).alias(name))
    legend = ordered(p.withColumn("at", F.struct("number")), line, "legend")
    content = ordered(chunks.join(p.select("query_id", "paper", "number"), ["query_id", "paper"], "left").withColumn("at", F.struct("rank", "chunk_id")), block, "content")
    both = legend.join(content, "query_id", "left").withColumn("content", F.coalesce("content", F.array().cast("array<string>")))
    context = F.concat(F.lit(LEGEND + "\n"), F.array_join("legend", "\n"), F.lit("\n\n" + CONTENT + "\n"), F.array_join("content", "\n\n"))
    return both.select("query_id", context.alias("context"), F.size("legend").alias("papers"), F.size("content").alias("chunks"))


def _named(text: Column, patterns: tuple[str, ...]) -> Column:
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.trim(x), "^,+|,+$", ""))))


def context_papers(context: Column | str) -> Column:
    """Sorted distinct ids by which a context names its papers, in its own form or in JSON."""
    return _named(F.col(context) if isinstance(context, str) else context, PAPER_NAMES)


def context_chunks(context: Column | str) -> Column:
    """Sorted distinct ids of the chunks that a context names."""
    return _named(F.col(context) if isinstance(context, str) else context, CHUNK_NAMES)


def context_passages(context: Column | str) -> Column:
    """The blocks of a context's content, each with its source number; empty where it has none."""
    c = F.col(context) if isinstance(context, str) else context
    parts = F.transform(F.split(F.trim(F.get(F.split(c, CONTENT, -1), F.lit(1))), "SOURCE_ID:", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.coalesce(F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit("SOURCE_ID: "), x)), F.array().cast("array<string>"))


def context_legend(context: Column | str) -> Column:
    """The legend of a context as structs of number, title, doi and apa; lines without a number are left out."""
    c = F.col(context) if isinstance(context, str) else context
    lines = F.split(F.get(F.split(F.get(F.split(c, LEGEND, -1), F.lit(1)), CONTENT, -1), F.lit(0)), "\n")
    part = lambda x, name: F.nullif(F.get(F.filter(F.split(x, r" \| "), lambda y: y.startswith(name + ":")), F.lit(0)), F.lit(""))
    value = lambda x, name: F.trim(F.replace(part(x, name), F.lit(name + ":"), F.lit("")))
    number = lambda x: F.trim(F.replace(F.get(F.split(x, r" \| "), F.lit(0)), F.lit("PAPER ID:"), F.lit(""))).try_cast("int")
    rows = F.transform(F.filter(lines, lambda x: x.startswith("PAPER ID:")), lambda x: F.struct(number(x).alias("number"), value(x, "Title").alias("title"), value(x, "DOI").alias("doi"), value(x, "APA").alias("apa")))
    return F.coalesce(F.filter(rows, lambda r: r["number"].isNotNull()), F.expr("cast(array() as array<struct<number:int,title:string,doi:string,apa:string>>)"))


def context_sources(context: Column | str) -> Column:
    """Distinct source numbers in a context's content, in order."""
    c = F.col(context) if isinstance(context, str) else context
    found = F.regexp_extract_all(F.get(F.split(c, CONTENT, -1), F.lit(1)), F.lit(r"(?m)^SOURCE_ID:\s*(\d+)\s*$"), F.lit(1))
    return F.coalesce(F.array_distinct(F.transform(found, lambda x: x.try_cast("int"))), F.array().cast("array<int>"))


# What a question may ask for; the first is taken where a plan names none of them.
INTENTS = ("comprehensive_search", "author_papers", "comparison", "foundational", "general", "gibberish", "system")


def query_plan(answer: Column | str, question: Column | str) -> Column:
    """A query plan in a model's answer as a struct; fields of a wrong kind take their defaults, and so does an answer that isn't JSON."""
    a, q = (F.col(x) if isinstance(x, str) else x for x in (answer, question))
    a = F.when(F.trim(a).startswith("{"), a)
    at = lambda name: F.get_json_object(a, f"$.{name}")
    listed = lambda name: F.coalesce(F.filter(F.transform(F.from_json(F.when(F.trim(at(name)).startswith("["), at(name)), "array<string>"), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))
    intent = F.lower(F.trim(at("intent")))
    parted = F.filter(F.transform(F.split(at("skip"), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    skip = F.when(F.trim(at("skip")).startswith("["), F.transform(listed("skip"), lambda x: F.lower(x))).when(at("skip").isNotNull(), parted).otherwise(F.array().cast("array<string>"))
    return F.struct(
        F.trim(F.coalesce(F.nullif(at("clarified_question"), F.lit("")), q)).alias("question"), listed("hybrid_queries").alias("queries"), listed("specific_papers").alias("papers"), F.when(intent.isin(*INTENTS), intent).otherwise(INTENTS[0]).alias("intent"),
        skip.alias("skip"), F.coalesce(at("has_doi").isin("true", "True", "TRUE"), F.lit(False)).alias("has_doi"), F.when(F.trim(at("filters")).startswith("{"), at("filters")).otherwise("{}").alias("filters"),
    )


def validation_export(checks: DataFrame, messages: DataFrame, questions: DataFrame, papers: DataFrame) -> DataFrame:
    """Rows of answer validation for other tools: (id, dataset, question, answer, contexts, paper_ids, truth_ids, doi, key_passage, ground_truth).

    ``checks`` is (id, question, message, context, status), ``messages`` (message, content), ``questions`` (dataset, priority, text, doi array,
    key_passage, ideal), ``papers`` (paper, doi). A completed check is matched to the question of equal words, that of the smallest
    priority first; checks without a question, answer or context are left out. The true ids are the numbers that the context's legend gives
    the question's DOIs or, if it has none of them, the papers of these DOIs, in their order and each once.
    """
    own = questions.select(question_key("text").alias("asked"), F.struct("dataset", F.transform(F.coalesce("doi", F.array().cast("array<string>")), lambda d: normalize_doi(d)).alias("doi"), "key_passage", "ideal").alias("q"), "priority")
    own = own.where("asked <> ''").groupBy("asked").agg(F.min_by("q", F.struct("priority", "q")).alias("q"))
    c = checks.where("status = 'completed'").withColumn("asked", question_key("question")).join(own, "asked").join(messages, "message", "left")
    c = c.withColumn("answer", F.trim(F.coalesce("content", F.lit("")))).withColumn("contexts", context_passages("context")).where((F.col("answer") != "") & (F.size("contexts") > 0))
    dois = F.array_distinct(F.filter("q.doi", lambda d: d.isNotNull()))
    legend = F.transform(context_legend("context"), lambda l: F.struct(normalize_doi(l["doi"]).alias("doi"), l["number"].alias("number")))
    c = c.withColumn("doi", dois).withColumn("legend", legend)
    numbered = F.flatten(F.transform("doi", lambda d: F.transform(F.filter("legend", lambda l: l["doi"] == d), lambda l: l["number"].cast("string"))))
    known = papers.select("paper", normalize_doi("doi").alias("d")).where("d is not null")
    listed = c.select("id", F.posexplode("doi").alias("pos", "d")).join(known, "d").groupBy("id", "paper").agg(F.min("pos").alias("pos")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "paper"))), lambda x: x["paper"]).alias("papers"))
    c = c.withColumn("numbered", F.array_distinct(numbered)).join(listed, "id", "left")
    truth = F.when(F.size("numbered") > 0, F.col("numbered")).otherwise(F.coalesce("papers", F.array().cast("array<string>")))
    passage = F.trim(F.coalesce("q.key_passage", F.lit("")))
    return c.select(
        "id", F.col("q.dataset").alias("dataset"), F.trim("question").alias("question"), "answer", "contexts", F.transform(context_sources("context"), lambda n: n.cast("string")).alias("paper_ids"), truth.alias("truth_ids"), "doi", passage.alias("key_passage"),
        F.trim(F.coalesce(F.nullif("q.ideal", F.lit("")), passage)).alias("ground_truth"),
    )


def route(paper_ids: Column) -> Column:
    """``scoped`` where a list of paper ids with any that isn't blank is given, else ``database``."""
    return F.when(F.exists(F.coalesce(paper_ids, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != "")), "scoped").otherwise("database")


def gibberish(rows: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """``(key, gibberish, score)``: whether a text asks nothing. ``words`` has the ``word`` s in common use.

    Null, blank, very short texts, greetings, identifiers and short words that nobody uses are; else two of: few or too many vowels, few
    words in use, high entropy, no vowel at all, a sign repeated. Words are joined as rows, each text's distinct word once.
    """
    t = rows.select(F.col(key).alias("key"), F.trim(F.col(text)).alias("text"))
    used = words.select(F.lower("word").alias("word")).distinct().withColumn("used", F.lit(1))
    each = t.select("key", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    share = each.groupBy("key", "word").agg(F.count(F.lit(1)).alias("n")).join(used, "word", "left").groupBy("key").agg((F.sum(F.when(F.length("word") > 1, F.coalesce("used", F.lit(0))).otherwise(0) * F.col("n")) / F.sum("n")).alias("share"))
    short = t.where("length(text) between 3 and 5").select("key", F.lower("text").alias("word")).join(used, "word", "left").groupBy("key").agg(F.max(F.coalesce("used", F.lit(0))).alias("known"))
    t = t.join(share, "key", "left").join(short, "key", "left")
    letters, v = F.regexp_replace("text", "[^a-zA-Z]", ""), vowel_ratio("text")
    tests = ((v < 0.2) | (v > 0.9), F.coalesce("share", F.lit(0.0)) < 0.3, shannon_entropy("text") > 4.5, (F.length(letters) > 5) & ~letters.rlike("[aeiouAEIOU]"), repeats("text"))
    score = sum((c.cast("int") for c in tests[1:]), tests[0].cast("int"))
    plainly = F.coalesce(F.col("text"), F.lit("")) == ""
    at_once = plainly | (F.length("text") <= 2) | F.lower("text").isin(*GREETINGS) | looks_like_identifier("text") | ((F.length("text") <= 5) & (F.coalesce("known", F.lit(0)) == 0))
    return t.select(F.col("key").alias(key), F.coalesce(at_once | (score >= 2), F.lit(True)).alias("gibberish"), F.coalesce(score, F.lit(0)).alias("score"))


def fenced_json(text: Column | str, schema: str) -> Column:
    """The object in a model's answer, with or without a code fence; null if it is none."""
    c = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    return F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), schema)


def new_queries(asked: Column, existing: Column, most: int = 2) -> Column:
    """Asked queries without repeats and without what exists already, whatever the case, at most ``most``."""
    known = F.transform(existing, lambda x: F.lower(F.trim(x)))
    fresh = F.filter(asked, lambda x: (F.trim(x) != "") & ~F.array_contains(known, F.lower(F.trim(x))))
    once = F.aggregate(fresh, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(F.trim(y)) == F.lower(F.trim(x))), acc).otherwise(F.concat(acc, F.array(x))))
    return F.slice(once, 1, most)


def merged_rounds(rounds: DataFrame, owner: DataFrame, k: int) -> DataFrame:
    """Chunk rankings of several rounds fused by reciprocal ranks as a share of the best; papers by their best chunk: (query_id, paper, chunk_score, rrf, rank)."""
    fused = rrf(rounds.select("query_id", "key", "rank"))
    top = Window.partitionBy("query_id")
    share = fused.withColumn("share", F.col("score") / F.max("score").over(top)).select("query_id", "key", "share")
    best = rounds.groupBy("query_id", "key").agg(F.max("score").alias("score"))
    papers = share.join(best, ["query_id", "key"]).join(owner, "key").groupBy("query_id", "paper").agg(F.max("score").alias("chunk_score"), F.max("share").alias("rrf"))
    w = Window.partitionBy("query_id").orderBy(F.round("chunk_score", 9).desc(), F.round("rrf", 9).desc(), "paper")
    return papers.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def null_as_zero_means(rows: DataFrame, zero: list[str], conditional: dict[str, Column]) -> DataFrame:
    """Means in which nulls count as 0, and means over the rows of a condition only."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), *(F.avg(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in zero), *(F.avg(c).alias(n) for n, c in conditional.items()))
