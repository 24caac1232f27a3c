"""The paid stages of a review over relations of answers: prompts, proposals, verification, summary; each fails in its way."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import mentions_only
from ..sources.cases import parse_findings
from .costs import plan


def review_prompts(blocks: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """(group, prompt): blocks (label, text) that were kept, in order, each under its label."""
    part = F.concat(F.lit("--- "), F.col("label"), F.lit(" ---\n"), F.col("text"))
    made = blocks.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order, part.alias("__t")))).alias("x"))
    return made.select(*group, F.array_join(F.col("x.__t"), "\n\n").alias("prompt"))


def evidence_text(parts: Column) -> Column:
    """Texts of evidence that aren't empty, between blank lines."""
    return F.array_join(F.filter(parts, lambda t: t.isNotNull() & (t != "")), "\n\n")


def verify_prompts(findings: DataFrame, evidence: Column) -> DataFrame:
    """findings with prompt: the claim, its quotation, and the evidence to check it against."""
    claim = F.concat(F.lit("Claim: "), F.col("title"), F.lit("\nPlace: "), F.col("file"), F.lit(":"), F.col("line"), F.lit("\nQuoted: "), F.coalesce("quoted_code", F.lit("")))
    return findings.withColumn("prompt", F.concat(claim, F.lit("\n\nEvidence:\n"), evidence_text(evidence)))


def summary_prompts(posted: DataFrame, review: list[str]) -> DataFrame:
    """(review, prompt): one line for each posted finding by rank; reviews without one have no row."""
    line = F.concat(F.lit("- ["), "severity", F.lit("] "), "file", F.lit(":"), F.col("line"), F.lit(" "), "title")
    made = posted.groupBy(*review).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))).alias("x"))
    return made.select(*review, F.array_join(F.col("x.t"), "\n").alias("prompt"))


def answered(calls: DataFrame, complete: Callable[[str], str | None]) -> DataFrame:
    """calls with answer and failed, from a function of the prompt; what it raises is a failed call."""

    def ask(prompts: pd.Series) -> pd.Series:
        made = []
        for p in prompts:
            try:
                made.append(complete(p))
            except Exception:
                made.append(None)
        return pd.Series(made, dtype=object)

    return calls.withColumn("answer", F.pandas_udf(ask, "string")(F.col("prompt"))).withColumn("failed", F.col("answer").isNull())


def propose(answers: DataFrame, key: list[str]) -> DataFrame:
    """(key, ord, finding...): the findings in answers (key, ord, answer), in order of calls; a failed call gives none."""
    found = answers.filter("answer is not null").select(*key, F.col("ord").alias("call"), F.posexplode(parse_findings(F.col("answer"))).alias("at", "f"))
    return found.select(*key, F.struct("call", "at").alias("ord"), "f.*")


def summarise(answers: DataFrame, posted: DataFrame, review: list[str]) -> DataFrame:
    """(review, summary) of answers (review, answer); null if a file is named that no posted finding is in, or the call failed."""
    files = posted.groupBy(*review).agg(F.collect_set("file").alias("files"))
    said = F.nullif(F.trim("answer"), F.lit(""))
    return answers.join(files, review).select(*review, F.when(mentions_only(said, F.col("files")), said).alias("summary"))


def verification_cost(candidates: DataFrame, prices: DataFrame) -> DataFrame:
    """The cost plan of candidates (prompt, model, proof, ...) that no proof stands in for."""
    return plan(candidates.filter(F.coalesce("proof", F.lit("")) == "").withColumn("phase", F.lit("verify")), prices)


def summary_cost(posted: DataFrame, review: list[str], model: str, prices: DataFrame) -> DataFrame:
    """The cost plan of summaries; reviews that post nothing have none."""
    return plan(summary_prompts(posted, review).withColumns({"phase": F.lit("summary"), "model": F.lit(model)}), prices)


def measured(calls: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """calls, and the number, sum and largest of their prompts' lengths, known once calls has run."""
    seen = Observation(name)
    size = F.length("prompt")
    return calls.observe(seen, F.count(F.lit(1)).alias("calls"), F.sum(size).alias("chars"), F.max(size).alias("longest")), seen


def unverified(verdicts: DataFrame, by: list[str], failure: str) -> DataFrame:
    """(by, failed): drops whose reason is that the verifier couldn't be reached."""
    return verdicts.groupBy(*by).agg(F.count_if(~F.col("posted") & F.col("reason").eqNullSafe(F.lit(failure))).alias("failed"))
