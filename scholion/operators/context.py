"""Windows over message sequences: token budgets, sliding windows, next answers, sequence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_estimate(text: Column | str) -> Column:
    """A quarter of the characters and four."""
    return F.floor(F.length(text) / 4) + 4


def context_window(messages: DataFrame, conversation: str, order: list[str], tokens: Column, budget: int) -> DataFrame:
    """Newest messages of each conversation within the budget; the last one always stays, and the first that overflows ends the window."""
    w = Window.partitionBy(conversation).orderBy(*(F.col(c).desc() for c in order))
    out = messages.withColumn("n_tokens", F.coalesce(tokens, F.lit(0))).withColumn("used", F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("back", F.row_number().over(w))
    return out.where((F.col("back") == 1) | (F.col("used") <= budget))


def last_messages(messages: DataFrame, conversation: str, order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(conversation).orderBy(*(F.col(c).desc() for c in order))
    return messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def needs_summary(messages: DataFrame, conversation: str, tokens: Column, summarised: str, most: int = 20, most_after: int = 10, budget: int = 8000) -> DataFrame:
    """Conversations with over ``most`` messages, over ``most_after`` since the last summary, or over twice the budget of tokens."""
    g = messages.groupBy(conversation).agg(F.count(F.lit(1)).alias("messages"), F.count_if(~F.coalesce(F.col(summarised), F.lit(False))).alias("since"), F.sum(tokens).alias("tokens"), F.max(F.coalesce(F.col(summarised), F.lit(False))).alias("any"))
    due = (~F.col("any") & (F.col("messages") > most)) | (F.col("any") & (F.col("since") > most_after)) | (F.col("tokens") > 2 * budget)
    return g.select(conversation, "messages", "since", "tokens", due.alias("due"))


def next_answer(messages: DataFrame, conversation: str, order: list[str], role: str, asked: str, answered: str, key: str) -> DataFrame:
    """For each message of role ``asked``, the first of role ``answered`` after it and before the next of role ``asked``; null if there is none."""
    turn = Window.partitionBy(conversation).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = messages.where(F.col(role).isin(asked, answered)).withColumn("turn", F.count_if(F.col(role) == asked).over(turn))
    replies = numbered.where((F.col(role) == answered) & (F.col("turn") > 0)).groupBy(conversation, "turn").agg(F.min_by(key, F.struct(*order)).alias("answer"))
    return numbered.where(F.col(role) == asked).join(replies, [conversation, "turn"], "left").select(conversation, F.col(key).alias("question"), "answer")


def with_sequence(new: DataFrame, log: DataFrame, task: str, order: list[str]) -> DataFrame:
    """Sequence numbers that go on from each task's largest in the log, from 1."""
    top = log.groupBy(task).agg(F.max("sequence").alias("top"))
    w = Window.partitionBy(task).orderBy(*order)
    return new.withColumn("rn", F.row_number().over(w)).join(top, task, "left").withColumn("sequence", F.coalesce("top", F.lit(0)) + F.col("rn")).drop("rn", "top")


def sections(lines: DataFrame, doc: str, order: str, is_header: Column) -> DataFrame:
    """Group lines under their latest header: running count of headers; lines before the first are of section 0."""
    w = Window.partitionBy(doc).orderBy(order)
    return lines.withColumn("header", is_header).withColumn("section", F.sum(F.col("header").cast("int")).over(w))


def page_anchors(lines: DataFrame, doc: str, order: str, page: str, header_text: Column) -> DataFrame:
    """The header in force at the first line of each page."""
    w = Window.partitionBy(doc).orderBy(order)
    seen = lines.withColumn("anchor", F.last(header_text, ignorenulls=True).over(w))
    return seen.where(F.col(page).isNotNull()).groupBy(doc, page).agg(F.min_by("anchor", order).alias("anchor"))
