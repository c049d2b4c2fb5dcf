"""Mixing sources to target weights: quotas by token counts, order by Pfair scheduling.

Each source's quota of the total is its target share as far as repeating its texts at most the allowed number of times yields it; what it
lacks is taken from the others in proportion to their targets. The total is cut into equal blocks; block ``k`` of a source of weight ``w``
may not come before slot ``floor(k / w)`` and is due by slot ``ceil((k + 1) / w)``, and of the blocks released the earliest due comes next. So at
every slot each source has had its share to within one block, and the text that a block ends in. Blocks are as many as texts, or a
65,536th of the mix where there are more: the deviation is that share of the whole at most, at any size, and no long text makes it larger.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.llm.tokens import token_count
from scholion.tables import cut

#: Most blocks that a mix of any size is scheduled in; the schedule is worked out on the driver and is bounded by this number.
BLOCKS = 1 << 16
#: Buckets of a source's texts, over which running totals are taken in two steps, so that no source is gathered in one task.
BUCKETS = 4096
#: Most sources.
MOST_SOURCES = 1024


def canonical_source(column: Column) -> Column:
    """A source's name in lower case, words joined by ``_``: spaces, hyphens and joined spellings of the listed names are alike."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s\-_]+", "")


def quotas(targets: dict[str, float], capacity: dict[str, float], total: float) -> dict[str, float]:
    """Tokens each source gives: its share of the total, at most its capacity; what is lacking is shared out in proportion to the targets."""
    given = {s: 0.0 for s in targets}
    open_ = {s for s in targets if targets[s] > 0 and capacity.get(s, 0) > 0}
    rest = float(total)
    while open_ and rest > 1e-9:
        weight = sum(targets[s] for s in open_)
        full = {s for s in open_ if given[s] + rest * targets[s] / weight >= capacity[s]}
        if not full:
            for s in open_:
                given[s] += rest * targets[s] / weight
            rest = 0.0
            break
        for s in full:
            rest -= capacity[s] - given[s]
            given[s] = capacity[s]
        open_ -= full
    return given


def pfair(weights: list[float], slots: int) -> np.ndarray:
    """The source number of each slot: earliest deadline first among released blocks, ties to the larger weight, then the smaller number.

    The weights add up to 1; a source's blocks at any slot ``t`` differ from ``t`` times its weight by less than one.
    """
    out = np.zeros(slots, np.int32)
    waiting: list[tuple[int, int]] = []  # (release, source)
    ready: list[tuple[int, float, int]] = []  # (deadline, -weight, source)
    done = [0] * len(weights)
    for s, w in enumerate(weights):
        if w > 0:
            heapq.heappush(waiting, (0, s))
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil((done[s] + 1) / weights[s] - 1e-9), -weights[s], s))
        if not ready:  # by rounding of the weights only
            release, s = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil((done[s] + 1) / weights[s] - 1e-9), -weights[s], s))
        _, _, s = heapq.heappop(ready)
        out[t] = s
        done[s] += 1
        heapq.heappush(waiting, (math.floor(done[s] / weights[s] + 1e-9), s))
    return out


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """``(slot, source, doc_id, copy, tokens, place)``: the texts of the mix, in order of ``slot`` and ``place``.

    ``targets`` has ``source``, ``target_share`` and ``max_repeats``. Sources are matched however their names are written; texts of no
    listed source are left out. Equal texts count as one text: it belongs to the source that is shortest of tokens, is represented by its
    smallest ``doc_id``, and occurs at most as often as that source's ``max_repeats``. Null and token-less texts are left out. Without ``total`` the mix is
    as large as all tokens of the documents, as far as the repeats allow. Empty tables give an empty mix.
    """
    listed = [(r["source"], r["key"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.select("source", canonical_source(F.col("source")).alias("key"), "target_share", "max_repeats").where("source is not null").orderBy("source").limit(MOST_SOURCES + 1).collect()]
    if len(listed) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    name = F.create_map(*(F.lit(x) for s, k, _, _ in listed for x in (k, s)))[canonical_source(F.col("source"))] if listed else F.lit(None).cast("string")
    sized = documents.select("doc_id", name.alias("source"), F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), token_count("text").alias("tokens")).where("tokens > 0")
    sized = cut(sized)
    every = sized.agg(F.sum("tokens")).first()[0] or 0
    goal = int(every if total is None else total)
    # distinct texts by source, then each text in one source: the one with the fewest tokens for its share
    texts = sized.where("source is not null").groupBy("h1", "h2", "tokens", "source").agg(F.min("doc_id").alias("doc_id"))
    stock = {r["source"]: r["n"] for r in texts.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    scarce = sorted((stock.get(s, 0) * r / w if w else math.inf, s) for s, _, w, r in listed)
    rank = F.create_map(*(F.lit(x) for i, (_, s) in enumerate(scarce) for x in (s, i)))[F.col("source")] if scarce else F.lit(0)
    own = cut(texts.groupBy("h1", "h2", "tokens").agg(F.min_by(F.struct("source", "doc_id"), F.struct(rank.alias("rank"), "doc_id")).alias("o")).select("o.source", "o.doc_id", "tokens", F.pmod(F.xxhash64("h1", "h2"), F.lit(BUCKETS)).cast("int").alias("bucket"), F.xxhash64("h2", "h1").alias("at")))
    stock = {r["source"]: r["n"] for r in own.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    share, repeats = {s: w for s, _, w, _ in listed}, {s: r for s, _, _, r in listed}
    quota = quotas(share, {s: float(stock.get(s, 0) * repeats[s]) for s in share}, goal)
    used = [s for s in share if quota[s] > 0]
    empty = "slot int, source string, doc_id long, copy int, tokens long, place long"
    if not used:
        return documents.sparkSession.createDataFrame([], empty)
    whole = sum(quota[s] for s in used)
    texts = own.agg(F.count(F.lit(1))).first()[0]
    count = max(1, min(BLOCKS, texts))
    block = whole / count  # a text belongs to the block that it begins in, and may go on into the next
    slots = pfair([quota[s] / whole for s in used], count)
    order = np.zeros(count, np.int64)
    for k in range(len(used)):
        mine = np.flatnonzero(slots == k)
        order[mine] = np.arange(len(mine))
    spark = documents.sparkSession
    schedule = spark.createDataFrame([(used[s], int(k), t) for t, (s, k) in enumerate(zip(slots.tolist(), order.tolist()))], "source string, block long, slot int")
    # running totals in two steps: of whole buckets, then within a bucket; every pass over a source is in the same order of its texts
    sums = own.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    from pyspark.sql import Window

    before = sums.withColumn("before", F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))  # at most BUCKETS rows a source
    inner = Window.partitionBy("source", "bucket").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("within", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(before.select("source", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["source", "bucket"])
    limits = spark.createDataFrame([(s, float(quota[s]), int(stock[s]), int(repeats[s])) for s in used], "source string, quota double, stock long, most int")
    copies = placed.join(F.broadcast(limits), "source").withColumn("copy", F.explode(F.expr("sequence(0, most - 1)")))  # limits: at most MOST_SOURCES rows
    start = F.col("copy") * F.col("stock") + F.col("before") + F.col("within")
    chosen = copies.withColumn("place", start).where(F.col("place") + F.col("tokens") / 2.0 <= F.col("quota"))
    chosen = chosen.withColumn("block", F.floor((F.col("place")) / F.lit(block)).cast("long"))
    last = schedule.groupBy("source").agg(F.max("block").alias("last"))
    chosen = chosen.join(F.broadcast(last), "source").withColumn("block", F.least("block", "last"))
    return chosen.join(schedule, ["source", "block"]).select("slot", "source", "doc_id", "copy", "tokens", "place")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Report of the mix: for each listed source its target and actual share of the tokens, tokens, texts and most repeats."""
    by_text = mixed.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("times"))
    got = by_text.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("texts"), F.max("times").alias("most_times"))
    total = got.agg(F.sum("tokens").alias("total"))
    out = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").crossJoin(total)  # one row
    return out.select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("total")).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_times", F.lit(0)).alias("most_times"), "max_repeats")
