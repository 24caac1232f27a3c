"""Mixing sources to target weights: Sainte-Lague apportionment, given by equal-token blocks and a part of one."""

from __future__ import annotations

import heapq
import random
from fractions import Fraction
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import blank_words, materialize, table

#: Blocks that a mix is cut into, at least while a block has 65536 words or fewer.
BLOCKS = 1 << 18
MOST_IN_BLOCK = 1 << 16
#: Shards of all sources together, besides one for each source; bounds the table that is sent out.
SHARDS = 4096
LEAST_IN_SHARD = 1 << 16
#: One row per source comes to the driver. More sources than this raise an error; none is dropped.
MAX_SOURCES = 100_000


def water_fill(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Targets that share share * sum(sizes) by weight, none above most times its size.

    What a stopped source leaves goes to the others by weight, until none is above its limit.
    """
    left, open_, targets = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = float(most * sizes[i])
            open_.discard(i)
        left -= sum(targets[i] for i in over)
    return targets


def sainte_lague(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients vote / (2 k + 1), none above its entry of most; ties to the smaller index.

    Starts from a lower bound of each quota and deals out what is left from a heap, so the work doesn't grow with seats.
    """
    limits = most if most is not None else [seats] * len(votes)
    seats, total = min(seats, sum(limits)), sum(votes)
    got = [0] * len(votes)
    if total <= 0:
        return got
    lo, hi = 0.0, 2.0 * seats / total + 2.0 / min(v for v in votes if v > 0)
    at = lambda x: [min(m, int((v * x + 1) // 2)) for v, m in zip(votes, limits, strict=True)]
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(at(mid)) <= seats:
            lo = mid
        else:
            hi = mid
    got = at(lo)
    quotient = lambda i: (-Fraction(votes[i]) / (2 * got[i] + 1), i)
    heap = [quotient(i) for i in range(len(votes)) if got[i] < limits[i] and votes[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        i = heapq.heappop(heap)[1]
        got[i] += 1
        if got[i] < limits[i]:
            heapq.heappush(heap, quotient(i))
    return got


def _order(n: int, rnd: random.Random) -> tuple[int, int]:
    """a, b such that i -> (a i + b) mod n is a seeded order of n blocks."""
    if n <= 1:
        return 0, 0
    a = rnd.randrange(1, n)
    while gcd(a, n) != 1:
        a = a % (n - 1) + 1
    return a, rnd.randrange(n)


def _selection(size: int, words: int, block: int, rnd: random.Random) -> tuple[int, int, int, int, int, int]:
    """(passes, n, a, b, full, part): how a shard of size words gives exactly words words.

    The whole shard passes times; then the blocks whose rank in the seeded order is below full, and part words of the next.
    """
    passes, rest = divmod(words, size)
    n = -(-size // block)
    a, b = _order(n, rnd)
    tail, at = size - (n - 1) * block, (a * (n - 1) + b) % n
    if rest <= at * block:
        full, part = divmod(rest, block)
    elif rest <= at * block + tail:
        full, part = at, rest - at * block
    else:
        more, part = divmod(rest - at * block - tail, block)
        full = at + 1 + more
    return passes, n, a, b, full, part


def _row_hash(docs: DataFrame, key: str, text: str, source: str, seed: int) -> Column:
    """Where a row stands in the seeded order; equal for rows of one key, text and source only."""
    return F.xxhash64(F.lit(seed), docs[key], F.coalesce(docs[text], F.lit("")), docs[source])


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cycle: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """(key, source, size, source_size, target, taken, h, shard) for every row: how many words the mix takes of each.

    size: words of the text, 0 for null or empty. Sources weigh cycle, repeating, by code point with null last, and
    share share times all words; no target is above most times its source, the excess reshared by weight.
    Sources get words by Sainte-Lague on their targets, shards of a source by Sainte-Lague on their sizes, and within a
    shard blocks of equal words are chosen in a seeded order, the last of them in part. So a source's words come within
    about one of its target, however small it is against a block. A document's words stand in
    seeded order of its key, size and text hash; equal rows are interchangeable. Documents without words take nothing.
    Rows with a null key or source count like others. An empty table gives an empty result. A shard holds 1/4096 of all
    words at most (or 65536), so a hot source is split; only shard totals reach the driver, 4096 and one per source.
    """
    if share > most:
        raise ValueError("share can't exceed most")
    spark = docs.sparkSession
    sized = docs.select(F.col(key).alias("k"), F.col(source).alias("s"), F.size(blank_words(F.col(text), lower=False)).cast("long").alias("size"), _row_hash(docs, key, text, source, seed).alias("h"))
    sized = materialize(sized, "sizes")
    totals = sized.groupBy("s").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals = sorted(((r["s"], r["size"]) for r in totals), key=lambda x: (x[0] is None, x[0] or ""))
    sizes, total = [x[1] for x in totals], sum(x[1] for x in totals)
    targets = water_fill(sizes, [cycle[i % len(cycle)] for i in range(len(sizes))], share, most)
    block = max(1, min(MOST_IN_BLOCK, total // BLOCKS))
    in_shard = max(LEAST_IN_SHARD, -(-total // SHARDS))
    shards = [max(1, -(-x // in_shard)) for x in sizes]
    sources = spark.createDataFrame([(s, x, t, n) for (s, x), t, n in zip(totals, targets, shards, strict=True)], T.StructType([T.StructField("s", docs.schema[source].dataType), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("shards", T.IntegerType())]))
    dealt = sized.join(F.broadcast(sources), sized["s"].eqNullSafe(sources["s"])).drop(sources["s"]).withColumn("shard", F.pmod("h", F.col("shards")).cast("int"))
    held: dict = {}
    for r in dealt.groupBy("s", "shard").agg(F.sum("size").alias("size")).filter("size > 0").collect():  # SHARDS rows and one per source at most
        held.setdefault(r["s"], []).append((r["shard"], r["size"]))
    quotas = sainte_lague(targets, round(sum(targets)), [int(most * x) for x in sizes])
    rows = []
    for (s, _), quota in zip(totals, quotas, strict=True):
        parts = sorted(held.get(s, []))
        got = sainte_lague([float(x) for _, x in parts], quota, [int(most * x) for _, x in parts])
        for (shard, size), q in zip(parts, got, strict=True):
            rows.append((s, shard, *_selection(size, q, block, random.Random(f"{seed}/{s}/{shard}"))))
    plan = spark.createDataFrame(rows, T.StructType([T.StructField("s", docs.schema[source].dataType), T.StructField("shard", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("passes", "n", "a", "b", "full", "part"))]))
    w = Window.partitionBy("s", "shard").orderBy("h", "k", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0)))
    chosen = placed.join(F.broadcast(plan), placed["s"].eqNullSafe(plan["s"]) & (placed["shard"] == plan["shard"]), "left").drop(plan["s"]).drop(plan["shard"]).withColumn("own_shard", F.col("shard"))
    one = F.lit(block).cast("long")
    end = F.col("start") + F.col("size")

    def overlap(i):
        rank = F.pmod(i * F.col("a") + F.col("b"), F.col("n"))
        until = F.when(rank < F.col("full"), one).when(rank == F.col("full"), F.col("part")).otherwise(F.lit(0))
        return F.greatest(F.lit(0), F.least(end, i * one + until) - F.greatest(F.col("start"), i * one))

    first, last = F.floor(F.col("start") / one), F.floor((end - 1) / one)
    parts = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda acc, i: acc + overlap(i))
    taken = F.when((F.col("size") > 0) & F.col("n").isNotNull(), F.col("passes") * F.col("size") + parts).otherwise(F.lit(0).cast("long"))
    return chosen.select(F.col("k").alias(key), F.col("s").alias(source), "size", "source_size", "target", taken.cast("long").alias("taken"), "h", "own_shard").withColumnRenamed("own_shard", "shard")


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, **how) -> DataFrame:
    """The mix as whole documents: each row of docs never, once or more often; the columns are those of docs.

    Within a shard rows are ordered by size and the shares of their texts that the mix takes are added up; a row occurs as
    often as that sum passes a whole number, so a shard's words come within about one document of what the mix takes.
    Rows without words don't occur. Equal rows share alike.
    """
    upto = Window.partitionBy("source", "shard").orderBy("size", "h", "taken").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = mix(docs, key, text, source, seed=seed, **how).filter("size > 0").withColumnRenamed(source, "source")
    share = F.col("taken") / F.col("size")
    passed = named.withColumn("__sum", F.round(F.sum(share).over(upto), 9)).withColumn("__share", share)
    drawn = passed.withColumn("__n", F.floor(F.col("__sum") + 0.5) - F.floor(F.round(F.col("__sum") - F.col("__share"), 9) + 0.5))
    drawn = drawn.groupBy("h").agg(F.round(F.avg("__n")).cast("int").alias("__n")).filter("__n > 0").withColumnRenamed("h", "__h")
    joined = docs.join(drawn, _row_hash(docs, key, text, source, seed) == F.col("__h"))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__copy")).drop("__copy")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_mixing": op1_mixing}
ORACLE: dict[str, str] = {}
