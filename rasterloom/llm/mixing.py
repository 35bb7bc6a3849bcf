"""Mix sources to target weights: equal-token blocks, apportioned by Sainte-Laguë.

Each source gets a target number of words. The targets become whole blocks by the
method of the highest quotients v/(2s+1), first over the sources, then over the
shards of each source. Within a shard, documents lie in an order seeded by their
hash; the shard is cut into equal blocks, and a seeded choice of blocks, closed in
form, says how many of each document's words the mix takes.

Sizes per source are the only thing the driver sees (a row for each source). Shards
are apportioned source by source on the executors, and a shard's documents are
narrow rows (key, size, hash), so no text is shuffled.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut, free_name, WORD

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
SHARD_WORDS = 1 << 16
MAX_SHARDS = 1 << 17  # of a source; beyond SHARD_WORDS * MAX_SHARDS words its shards grow
MANY_SOURCES = 100_000  # beyond, the plan is joined by a shuffle instead of broadcast
MOST_SOURCES = 2_000_000  # rows of sources that the driver takes; more are an error
MAX_BLOCK = 64


def sainte_lague(votes: list[int], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients v/(2s+1), none above its cap; ties go to the earlier party.

    >>> sainte_lague([53, 24, 23], 7, [9, 9, 9])
    [3, 2, 2]
    """
    seats = min(seats, sum(caps))
    out = [0] * len(votes)
    open_ = [i for i, v in enumerate(votes) if v > 0 and caps[i] > 0]
    while open_ and seats > 0:
        total = sum(votes[i] for i in open_)
        got = {i: (2 * votes[i] * seats + total) // (2 * total) for i in open_}
        gap = seats - sum(got.values())
        if gap > 0:
            heap = [(-Fraction(votes[i], 2 * got[i] + 1), i) for i in open_]
        else:
            heap = [(Fraction(votes[i], 2 * got[i] - 1), -i) for i in open_ if got[i]]
        heapq.heapify(heap)
        while gap:
            i = abs(heapq.heappop(heap)[1])
            got[i] += 1 if gap > 0 else -1
            if gap > 0:
                heapq.heappush(heap, (-Fraction(votes[i], 2 * got[i] + 1), i))
            elif got[i]:
                heapq.heappush(heap, (Fraction(votes[i], 2 * got[i] - 1), -i))
            gap -= 1 if gap > 0 else -1
        full = [i for i in open_ if got[i] >= caps[i]]
        if not any(got[i] > caps[i] for i in open_):
            full = open_
        for i in full:
            out[i] = min(got[i], caps[i])
            seats -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> dict:
    """Words for each source: ``share`` of all words by weight, no source above ``repeats`` times its own, the excess reshared.

    Sources go by code point, null last, and take the weights in turn.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, out = share * sum(size.values()), [s for s, _ in order], {}
    while open_:
        total = sum(weight[s] for s in open_)
        want = {s: left * weight[s] / total for s in open_}
        full = [s for s in open_ if want[s] > repeats * size[s]]
        if not full:
            return out | want
        for s in full:
            out[s] = float(repeats * size[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


#: Words of the chosen blocks among a shard's first p words: k whole blocks lie before p, of which floor((k * rest + phase) / blocks) are chosen.
_UPTO = "(({k} * rest + phase) div blocks) * {b} + ({p} - {k} * {b}) * ((({k} + 1) * rest + phase) div blocks - ({k} * rest + phase) div blocks)"


def _taken(block: int) -> Column:
    upto = lambda p: _UPTO.format(p=p, b=block, k=f"({p} div {block})")
    return F.expr(f"case when blocks > 0 then (quota div blocks) * size + ({upto('end')}) - ({upto('(end - size)')}) else 0 end").cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 42, carry: bool = False) -> DataFrame:
    """How many words of every row the mix takes.

    Returns doc_id, size, source_size, target, taken, source, shard: a row for each row of ``docs``. With ``carry``
    it returns the columns of ``docs`` and then size, source_size, target and taken (with underscores before a name
    that is taken); the rows then go through the one shuffle by shard whole.
    A null text has size 0 and gives nothing; a null source is a source of its own, the last;
    repeated rows are separate documents, and rows that tie in every way share their place in the order as they come;
    a document of any length is one narrow row; an empty table gives no rows. Columns of ``docs``
    other than the three named are not looked at, so clashing names do no harm. Reruns on the
    same rows give the same numbers, however the rows are partitioned.
    """
    kept = [column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)] if carry else []
    narrow = docs.select(
        column(id_col).alias("doc_id"),
        column(source).alias("source"),
        F.coalesce(F.regexp_count(column(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), column(id_col), column(text)).alias("place"),
        *kept,
    )
    narrow = narrow if carry else cut(narrow)
    sizes = [(r[0], r[1]) for r in narrow.groupBy("source").agg(F.sum("size")).limit(MOST_SOURCES + 1).collect()]  # a row for each source
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"the driver apportions {MOST_SOURCES} sources at most")
    want = targets(sizes, weights, share, repeats)
    least = min((t for t in want.values() if t > 0), default=0)
    block = max(1, min(MAX_BLOCK, int(least / 1000)))
    shards = {s: min(MAX_SHARDS, -(-n // SHARD_WORDS)) or 1 for s, n in sizes}

    spark = docs.sparkSession
    plan = spark.createDataFrame([(s, n, want[s], shards[s]) for s, n in sizes], "source string, source_size long, target double, shards int")
    rows = narrow.join(F.broadcast(plan) if len(sizes) <= MANY_SOURCES else plan, narrow["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    rows = rows.withColumn("shard", F.pmod("place", "shards").cast("int"))

    held = rows.groupBy("key", "source", "shard").agg(F.sum("size").alias("words"))
    bounds = cut(held.select("key", "source", "shard", F.ceil(F.col("words") / block).cast("long").alias("blocks")))
    limits = {r[0]: r[1] for r in bounds.groupBy("source").agg(F.sum("blocks")).collect()}
    order = sorted(want, key=lambda s: (s is None, s or ""))
    seats = round(sum(want.values()) / block)
    quota = dict(zip(order, sainte_lague([round(want[s] * 1024) for s in order], seats, [repeats * limits[s] for s in order]), strict=True)) if order else {}

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        name = pdf["source"].iloc[0]
        name = None if pd.isna(name) else name
        got = sainte_lague([int(x) for x in pdf["blocks"]], quota[name], [repeats * int(x) for x in pdf["blocks"]])
        return pd.DataFrame({"key": pdf["key"], "shard": pdf["shard"], "blocks": pdf["blocks"], "quota": got})

    dealt = bounds.groupBy("key").applyInPandas(deal, "key string, shard int, blocks long, quota long")  # at most MAX_SHARDS rows for each
    w = Window.partitionBy("key", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    some = F.greatest("blocks", F.lit(1).cast("long"))
    out = rows.join(dealt, ["key", "shard"]).withColumn("end", F.sum("size").over(w))
    out = out.withColumn("rest", F.pmod("quota", some)).withColumn("phase", F.pmod(F.xxhash64(F.lit(seed), "key", "shard"), some))
    out = out.withColumn("taken", _taken(block))
    if not carry:
        return out.select("doc_id", "size", "source_size", "target", "taken", "source", "shard")
    more = [F.col(c).alias(free_name(docs.columns, c)) for c in ("size", "source_size", "target", "taken")]
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], *more)
