"""The gate for candidate findings: evidence, place, memory, confidence, rank; each drop keeps its stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clamp, combined_confidence, gram_hashes, score, strip_space

# The shortest quotation that proves anything, the threshold, the cap.
SHORTEST_QUOTE, LEAST_CONFIDENCE, MOST_POSTED = 8, 0.7, 10
STAGES = ("hallucination", "bad_location", "dedupe", "low_confidence")
RANKED_OUT = "ranked_out"


def containment(needles: DataFrame, evidence: DataFrame, needle: str = "quoted_code", text: str = "text", gram: int = SHORTEST_QUOTE) -> DataFrame:
    """Pairs of a row of needles and a row of evidence (columns e_*) whose text holds the quotation, white space apart.

    Quotations under 8 characters never count. Each needle is posted under one gram, that of the least hash; evidence
    meets it by equality of a gram that it holds, so no needle meets a text that lacks it; contains() then decides.
    A gram's row carries a key of its text; the texts themselves are joined to the distinct pairs that meet.
    """
    bare = needles.withColumn("__bare", strip_space(F.coalesce(F.col(needle), F.lit("")))).filter(F.length("__bare") >= gram)
    wanted = bare.select("__bare").distinct().withColumn("__gram", F.array_min(gram_hashes(F.col("__bare"), gram)))
    plain = evidence.withColumn("__text", strip_space(F.coalesce(F.col(text), F.lit(""))))
    keyed = plain.withColumns({"__k1": F.xxhash64("__text"), "__k2": F.xxhash64(F.lit("second"), F.col("__text"))})
    posted = keyed.select("__k1", "__k2", F.explode(F.array_distinct(gram_hashes(F.col("__text"), gram))).alias("__gram"))
    pairs = posted.join(wanted, "__gram").select("__k1", "__k2", "__bare").distinct()
    texts = keyed.select("__k1", "__k2", "__text", *[F.col(c).alias(f"e_{c}") for c in evidence.columns])
    held = texts.join(pairs, ["__k1", "__k2"]).filter(F.col("__text").contains(F.col("__bare"))).drop("__k1", "__k2", "__text")
    return held.join(bare, "__bare").drop("__bare")


def quotes(needles: DataFrame, evidence: DataFrame, needle: str = "quoted_code", text: str = "text") -> DataFrame:
    """Rows of needles that some row of evidence holds."""
    found = containment(needles.select(needle).distinct(), evidence.select(text), needle, text).select(needle).distinct()
    return needles.join(found, needle, "left_semi")


def quote_in(quote: Column, texts: Column) -> Column:
    """Whether a quotation stands in one of an array of texts, white space apart; 8 characters at least."""
    bare = strip_space(F.coalesce(quote, F.lit("")))
    return (F.length(bare) >= SHORTEST_QUOTE) & F.exists(texts, lambda t: strip_space(t).contains(bare))


def cascade(found: DataFrame, review: list[str], order: str = "ord", least: float = LEAST_CONFIDENCE, most: int = MOST_POSTED) -> DataFrame:
    """found with combined, stage, score, rank and posted.

    found needs: review columns, order, fingerprint, quote_ok, loc_ok (without it places aren't checked), in_memory, proof, severity, confidence, is_real,
    is_actionable, verifier (null verdicts: not real). The first failing check names the stage: quotation, place,
    fingerprint seen before (in memory, or by an earlier row that passed), confidence below least. A proof stands in for
    the verifier. Rows that pass are ranked by score, then order; those beyond most keep a null stage but aren't posted.
    """
    unplaced = "loc_ok" not in found.columns
    found = found.withColumn("loc_ok", F.lit(True)) if unplaced else found
    proven = F.coalesce(F.col("proof"), F.lit("")) != ""
    verified = combined_confidence(F.col("confidence"), F.coalesce("is_real", F.lit(False)), F.coalesce("is_actionable", F.lit(False)), F.coalesce("verifier", F.lit(0.0)))
    sure = F.when(proven, clamp(F.col("confidence"))).otherwise(verified)
    passes = F.col("quote_ok") & F.col("loc_ok") & (proven | (sure >= least))
    rows = found.withColumn("__sure", sure).withColumn("__ok", passes)
    fresh = F.min(F.when(F.col("__ok") & ~F.col("in_memory"), F.col(order))).over(Window.partitionBy(*review, "fingerprint"))
    rows = rows.withColumn("__first", fresh)
    stage = (
        F.when(~F.col("quote_ok"), F.lit(STAGES[0])).when(~F.col("loc_ok"), F.lit(STAGES[1]))
        .when(F.col("in_memory") | (F.col(order) > F.col("__first")), F.lit(STAGES[2])).when(~F.col("__ok"), F.lit(STAGES[3]))
    )
    rows = rows.withColumn("stage", stage)
    reached = F.col("stage").isNull() | (F.col("stage") == STAGES[3])
    rows = rows.withColumn("combined", F.when(reached, F.col("__sure"))).withColumn("score", score(F.col("severity"), F.col("combined")))
    rank = F.row_number().over(Window.partitionBy(*review, F.col("stage").isNull()).orderBy(F.desc("score"), F.asc(order)))
    rows = rows.withColumn("rank", F.when(F.col("stage").isNull(), rank)).withColumn("posted", F.coalesce(F.col("rank") <= most, F.lit(False)))
    return rows.drop("__sure", "__ok", "__first", *["loc_ok"] * unplaced)


def breakdown(verdicts: DataFrame, review: list[str], order: str = "ord") -> DataFrame:
    """(review, stage, n, place): drops by stage, the most frequent first, ties by first appearance."""
    drops = verdicts.filter(~F.col("posted")).withColumn("stage", F.coalesce("stage", F.lit(RANKED_OUT)))
    counts = drops.groupBy(*review, "stage").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    w = Window.partitionBy(*review).orderBy(F.desc("n"), "first") if review else Window.orderBy(F.desc("n"), "first")
    return counts.withColumn("place", F.row_number().over(w)).drop("first")


def unseen(found: DataFrame, memory: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of found whose keys memory doesn't hold."""
    return found.join(memory.select(*keys).distinct(), keys, "left_anti")


def first_per(found: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return found.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
