"""Listings, lookups and changes of state: pages with their counts, histories, searches by text or EXISTS, clones and soft deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.text import tokens
from scholion.operators.filters import like


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = 20) -> DataFrame:
    """One page in a full order, with the ``total`` of all rows and the ``next_offset``, null on the last page."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    own = rows.orderBy(*order).offset(offset).limit(limit)
    return own.crossJoin(total).withColumn("next_offset", F.when(F.lit(offset + limit) < F.col("total"), offset + limit))  # a page and one row


def point_lookup(rows: DataFrame, wanted: DataFrame, number: str, key: str) -> DataFrame:
    """Rows for wanted ``value`` s: a value of digits only is the ``number``, any other the ``key``."""
    w = wanted.select(F.trim("value").alias("value")).where("value <> ''").distinct()
    by_number = w.where(F.col("value").rlike(r"^\d+$")).withColumn("_n", F.col("value").try_cast("long")).join(rows, F.col("_n") == F.col(number)).drop("_n")
    return by_number.unionByName(w.where(~F.col("value").rlike(r"^\d+$")).join(rows, F.col("value") == F.col(key)))


def lacking(rows: DataFrame, kinds: dict[str, Column], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows in ``order`` of each kind of lack: a row for each kind whose condition holds."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in kinds.items())))
    w = Window.partitionBy("kind").orderBy(*order)
    return rows.withColumn("kind", F.explode(found)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def conversation_search(conversations: DataFrame, messages: DataFrame, text: str, without: str = "single_paper") -> DataFrame:
    """Conversations (id, title, kind, updated) whose title or any active message (conversation, text, active) contains a text; those of a kind are left out. Newest first by ``rank``."""
    said = messages.where(F.coalesce(F.col("active"), F.lit(False)) & like("text", text)).select(F.col("conversation").alias("id")).distinct().withColumn("said", F.lit(True))
    hit = conversations.where(F.coalesce(F.col("kind"), F.lit("")) != without).join(said, "id", "left").where(F.coalesce(like("title", text), F.lit(False)) | F.col("said").isNotNull()).drop("said")
    return hit.withColumn("rank", F.row_number().over(Window.orderBy(F.col("updated").desc_nulls_last(), "id")))


def bookmarks(marks: DataFrame, papers: DataFrame, authors: DataFrame, text: str = "", has_notes: bool | None = None, open_access: bool | None = None, by: str | None = None, descending: bool = True, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of active bookmarks (id, paper, notes, active) with their paper (paper, title, venue, year, citations, open_access).

    ``text`` must have all its words in title, venue and notes, or occur in the name of an author (paper, name). Order is by citations,
    year or id as given, else for a text by the number of its words' occurrences; ties by id in the same direction, nulls last.
    """
    m = marks.where(F.coalesce(F.col("active"), F.lit(False))).join(papers, "paper", "left")
    noted = F.length(F.trim(F.coalesce("notes", F.lit("")))) > 0
    if has_notes is not None:
        m = m.where(noted if has_notes else ~noted)
    if open_access is not None:
        m = m.where(F.col("open_access") == open_access)
    m = m.withColumn("hits", F.lit(0))
    if text.strip():
        words = tokens(F.lit(text))
        there = tokens(F.concat_ws(" ", "title", "venue", "notes"))
        named = authors.where(like("name", text.strip())).select("paper").distinct().withColumn("named", F.lit(True))
        m = m.join(named, "paper", "left").withColumn("hits", F.when(F.size(F.array_except(words, there)) == 0, F.size(F.filter(there, lambda x: F.array_contains(words, x)))).otherwise(0))
        m = m.where((F.col("hits") > 0) | F.col("named").isNotNull()).drop("named")
    first = by if by in ("citations", "year", "id") else "hits" if text.strip() else "id"
    way = (lambda c: F.col(c).desc_nulls_last()) if descending else (lambda c: F.col(c).asc_nulls_last())
    return page(m, [way(first), way("id")], offset, limit)


def people(rows: DataFrame, text: str | None = None, names: tuple[str, ...] = ("name",), verified: bool = False, by: str = "citations", key: str = "id", offset: int = 0, limit: int = 20, **equal: str) -> DataFrame:
    """One page of authors or institutions: any of the names contains the text, fields equal those given, the most cited first."""
    if text:
        any_of = F.lit(False)
        for n in names:
            any_of = any_of | F.coalesce(like(n, text), F.lit(False))
        rows = rows.where(any_of)
    if verified:
        rows = rows.where("verified")
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    return page(rows, [F.col(by).desc_nulls_last(), F.col(key)], offset, limit)


def history(checks: DataFrame, messages: DataFrame, conditions: Column | None = None, preview: int = 280, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of answer checks (id, message, created, ...), newest first, with their message's conversation and the beginning of its text."""
    m = messages.select(F.col("id").alias("message"), "conversation", F.nullif(F.substring("text", 1, preview), F.lit("")).alias("preview"))
    rows = checks.join(m, "message", "left")
    return page(rows if conditions is None else rows.where(conditions), [F.col("created").desc_nulls_last(), F.col("id")], offset, limit)


def messages_where(messages: DataFrame, conversation: str, metadata: str, key: str, value: str | None, active: Column | None = None) -> DataFrame:
    """Messages whose JSON metadata have a value under a key, or all (value None), active ones only where a condition is given."""
    out = messages if value is None else messages.where(F.get_json_object(metadata, f"$.{key}") == value)
    return out if active is None else out.where(active)


def open_access_pdfs(rows: DataFrame, flag: str, pdf: Column) -> DataFrame:
    """Rows that are open access and have a PDF's address."""
    return rows.where(F.coalesce(F.col(flag), F.lit(False)) & (F.coalesce(F.trim(pdf), F.lit("")) != ""))


def newest(rows: DataFrame, group: list[str], order: list[Column], k: int = 20) -> DataFrame:
    """The newest ``k`` rows of each group, by ``order``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= k)


def stale(at: Column, now: Column, days: int = 30) -> Column:
    """Whether a time is unknown or more than ``days`` before ``now``."""
    return at.isNull() | (now - at > F.expr(f"interval {days} days"))


def merged_maps(old: Column, new: Column) -> Column:
    """Both maps in one, the new one's entries holding; a null map is empty."""
    empty = F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def insert_or_touch(old: DataFrame, new: DataFrame, key: str, touched: str, order: str) -> DataFrame:
    """Rows of new keys (the first by ``order``), and old rows unchanged but for the time of their last mention, the latest of ``new``."""
    rest = [c for c in old.columns if c not in (key, touched)]
    last = new.groupBy(key).agg(F.max(touched).alias("_at"), F.min_by(F.struct(*rest), order).alias("_row"))
    both = old.withColumn("_old", F.lit(True)).join(last, key, "full")
    return both.select(key, *(F.when(F.col("_old").isNotNull(), F.col(c)).otherwise(F.col(f"_row.{c}")).alias(c) for c in rest), F.coalesce("_at", touched).alias(touched))


def cloned(conversations: DataFrame, messages: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) copied for ``wanted`` (conversation, user, new_id) of another user: active or not, in their order, with the count of messages."""
    asked = wanted.join(conversations.withColumnRenamed("user", "owner"), "conversation").where("owner <> user")
    own = messages.withColumnRenamed("user", "sender").join(asked.select("conversation", "user", "new_id"), "conversation")
    place = F.row_number().over(Window.partitionBy("new_id").orderBy("id"))
    copies = own.withColumn("place", place).select(F.col("new_id").alias("conversation"), "user", "place", F.col("id").alias("copied_from"))
    counts = copies.groupBy("conversation").agg(F.count(F.lit(1)).alias("messages"))
    heads = asked.select(F.col("new_id").alias("conversation"), "user", F.col("conversation").alias("copied_from")).join(counts, "conversation", "left").withColumn("messages", F.coalesce("messages", F.lit(0)))
    return heads, copies


def soft_deleted(messages: DataFrame, deleted: DataFrame, answers: DataFrame) -> DataFrame:
    """Messages with ``active`` false for the deleted ``id`` s and, of questions (question, answer), for their answers; other rows stay as they are."""
    also = answers.join(deleted.select(F.col("id").alias("question")), "question", "left_semi").where("answer is not null").select(F.col("answer").alias("id"))
    gone = deleted.select("id").unionByName(also).distinct().withColumn("_gone", F.lit(True))
    return messages.join(gone, "id", "left").withColumn("active", F.when(F.col("_gone").isNotNull(), False).otherwise(F.col("active"))).drop("_gone")


def status_table(changes: DataFrame, task: str, order: str) -> DataFrame:
    """Per task of a log (task, order, status, error): last status, whether it was ever completed, the last error given and the number of changes."""
    g = changes.groupBy(task).agg(F.max_by("status", order).alias("status"), F.coalesce(F.max(F.col("status") == "completed"), F.lit(False)).alias("is_processed"), F.max_by("error", F.when(F.coalesce("error", F.lit("")) != "", F.col(order))).alias("error"), F.count(F.lit(1)).alias("changes"))
    return g


def job_counters(status: DataFrame) -> DataFrame:
    """How many tasks a job has by state."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return status.agg(F.count(F.lit(1)).alias("total"), *(count(s) for s in ("pending", "processing", "completed", "failed")))


def papers_with_authors(papers: DataFrame, authorships: DataFrame, authors: DataFrame) -> DataFrame:
    """Every paper with its authorships and their authors, two left joins: papers without authors and authors that aren't known stay."""
    return papers.join(authorships, "paper", "left").join(authors, "author", "left")


def citing_page(edges: DataFrame, papers: DataFrame, side: str = "citing", k: int = 20, offset: int = 0) -> DataFrame:
    """For each paper, the citing (or cited) papers from ``offset`` on, newest first: (paper, other, year, place)."""
    here, other = ("cited", "citing") if side == "citing" else ("citing", "cited")
    rows = edges.select(F.col(here).alias("paper"), F.col(other).alias("other")).join(papers.select(F.col("paper").alias("other"), "year"), "other")
    w = Window.partitionBy("paper").orderBy(F.col("year").desc_nulls_last(), "other")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place").between(offset + 1, offset + k)).select("paper", "other", "year", "place")
