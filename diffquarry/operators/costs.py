"""What a review will cost: estimates by call, sums by file and phase, ceilings between phases, and calls that failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cost_estimate
from .packing import added_up


def plan(calls: DataFrame, prices: DataFrame, answer_tokens: int = 800) -> DataFrame:
    """calls (review, phase, file, model, prompt) with tokens and cost; cost is null if prices (model, price_in, price_out) lacks the model."""
    priced = calls.join(F.broadcast(prices), "model", "left")
    made = priced.withColumn("__e", cost_estimate(F.col("prompt"), F.col("price_in"), F.col("price_out"), answer_tokens))
    return made.withColumns({"tokens": F.col("__e.tokens"), "cost": F.col("__e.cost")}).drop("__e", "price_in", "price_out")


def summed(planned: DataFrame, by: list[str]) -> DataFrame:
    """(by, calls, tokens, cost): an unknown cost makes a sum unknown."""
    return planned.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), added_up(F.col("cost")).alias("cost"))


def phase_gate(planned: DataFrame, review: list[str], ceiling: Column, order: dict[str, int]) -> DataFrame:
    """(review, phase, calls, tokens, cost, through, runs): phases in order; one runs if no known total through an earlier
    or this phase is above a known ceiling. through: the total up to the phase, unknown as soon as a part is."""
    place = F.coalesce(*[F.when(F.col("phase") == p, F.lit(n)) for p, n in order.items()])
    sums = summed(planned, [*review, "phase"]).withColumn("__place", place).withColumn("__ceiling", ceiling)
    upto = Window.partitionBy(*review).orderBy("__place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.when(F.count_if(F.col("cost").isNull()).over(upto) == 0, F.sum("cost").over(upto))
    sums = sums.withColumn("through", F.bround(total, 6)).withColumn("__over", F.coalesce(F.col("through") > F.col("__ceiling"), F.lit(False)))
    return sums.withColumn("runs", ~F.max("__over").over(upto)).drop("__place", "__ceiling", "__over")


def stop_text(phases: DataFrame, ceiling: Column) -> DataFrame:
    """phases with text: why a phase doesn't run, null if it does."""
    said = F.format_string("estimated cost $%.4f through the %s exceeds the ceiling of $%.4f", "through", "phase", ceiling)
    return phases.withColumn("text", F.when(~F.col("runs") & F.col("through").isNotNull(), said))


class CeilingExceeded(RuntimeError):
    """A phase would cost more than a run may."""


def check_ceiling(phases: DataFrame, ceiling: float | None) -> None:
    """Raise for the first phase that doesn't run (see phase_gate); a run is stopped before it, not after."""
    over = stop_text(phases, F.lit(ceiling).cast("double")).filter("text is not null").orderBy("through").first()
    if over is not None:
        raise CeilingExceeded(over["text"])


def tally(answers: DataFrame, by: list[str]) -> DataFrame:
    """(by, made, failed, all_failed) of calls with a column failed; without an answer a review says nothing about the code."""
    sums = answers.groupBy(*by).agg(F.count(F.lit(1)).alias("made"), F.count_if("failed").alias("failed"))
    return sums.withColumn("all_failed", (F.col("made") > 0) & (F.col("made") == F.col("failed")))
