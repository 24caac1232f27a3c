"""Reports as rows: outcome JSON, aligned text, Markdown by file in rank order, comment payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import encode_finding_marker
from .gate import breakdown

JSON_FIELDS = ("fingerprint", "file", "line", "category", "severity", "confidence", "title", "quoted_code", "proof", "stage")


def verdict_json(verdicts: DataFrame) -> DataFrame:
    """verdicts with json; a row that ranking left out is at stage ranked_out, a posted row at none."""
    stage = F.when(F.col("posted"), F.lit(None).cast("string")).otherwise(F.coalesce("stage", F.lit("ranked_out")))
    return verdicts.withColumn("json", F.to_json(F.struct(*[stage.alias("dropped_at") if c == "stage" else F.col(c) for c in JSON_FIELDS if c in verdicts.columns]), {"ignoreNullFields": "false"}))


def outcome_json(verdicts: DataFrame, review: list[str]) -> DataFrame:
    """(review, json): posted findings by rank and dropped ones by order in one document."""
    body = F.struct(*[F.col(c) for c in JSON_FIELDS if c in verdicts.columns])
    listed = lambda flag, by: F.transform(F.array_sort(F.collect_list(F.when(F.col("posted") == flag, F.struct(F.col(by).alias("by"), body.alias("f"))))), lambda x: x["f"])
    return verdicts.groupBy(*review).agg(F.to_json(F.struct(listed(True, "rank").alias("findings"), listed(False, "ord").alias("dropped"))).alias("json"))


def by_file(posted: DataFrame, review: list[str], line: Column) -> DataFrame:
    """(review, file, place, body): lines of each file by rank; files by their best rank."""
    parts = F.array_sort(F.collect_list(F.struct("rank", line.alias("t"))))
    made = posted.groupBy(*review, "file").agg(F.min("rank").alias("place"), parts.alias("x"))
    return made.select(*review, "file", "place", F.array_join(F.col("x.t"), "\n").alias("body"))


def markdown(posted: DataFrame, review: list[str]) -> DataFrame:
    """(review, text): a heading for each file in rank order, then its findings."""
    item = F.concat(F.lit("- **"), F.upper("severity"), F.lit("** line "), F.col("line"), F.lit(": "), F.col("title"))
    files = by_file(posted, review, item)
    parts = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("### `"), "file", F.lit("`\n"), "body").alias("t"))))
    return files.groupBy(*review).agg(parts.alias("x")).select(*review, F.array_join(F.col("x.t"), "\n\n").alias("text"))


def aligned(rows: DataFrame, group: list[str], name: str, text: str) -> DataFrame:
    """(group, report): one line per row in the order of name, names padded to the widest."""
    width = F.max(F.length(name))
    made = rows.groupBy(*group).agg(width.alias("w"), F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(text).alias("t")))).alias("x"))
    return made.select(*group, F.array_join(F.transform("x", lambda r: F.concat(F.rpad(r["n"], F.col("w"), F.lit(" ")), F.lit("  "), r["t"])), "\n").alias("report"))


def text_report(verdicts: DataFrame, runs: DataFrame, review: list[str]) -> DataFrame:
    """(review, report): what a reader at a terminal sees of each run, its findings in aligned columns by rank.

    runs: (review, model, cost, prompt_tokens, review_calls, review_failures, verify_failures, summary, cut), one row each;
    verdicts: as the gate gives them, with combined. Failed calls are told first, as without answers no finding means nothing.
    """
    place = F.concat(F.col("file"), F.lit(":"), F.col("line"))
    shown = verdicts.filter("posted").withColumn("place", place)
    widths = shown.groupBy(*review).agg(F.max(F.length("severity")).alias("w"), F.max(F.length("place")).alias("v"))
    margin = F.repeat(F.lit(" "), F.col("w") + F.col("v") + 6)
    head = F.concat(F.lit("  "), F.rpad(F.upper("severity"), F.col("w"), F.lit(" ")), F.lit("  "), F.rpad("place", F.col("v"), F.lit(" ")), F.lit("  "), "title")
    meta = F.concat(margin, "category", F.format_string(" · confidence %.2f", F.coalesce("combined", F.lit(0.0))))
    block = F.concat_ws("\n", head, meta, F.concat(margin, F.trim("quoted_code")))
    parts = shown.join(widths, review).groupBy(*review).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("t")))).alias("x"))
    drops = breakdown(verdicts, review).groupBy(*review).agg(F.sum("n").alias("dropped"), F.array_sort(F.collect_list(F.struct("place", F.concat(F.col("n"), F.lit(" "), F.col("stage")).alias("t")))).alias("d"))
    made = runs.join(parts, review, "left").join(drops, review, "left")
    by_stage = F.concat(F.col("dropped"), F.lit(" dropped ("), F.array_join(F.col("d.t"), ", "), F.lit(")"))
    failed_all = (F.col("review_calls") > 0) & (F.col("review_calls") == F.col("review_failures"))
    cost = F.when(F.col("cost").isNull(), F.lit("unknown (no price for this model)")).otherwise(F.format_string("$%.4f", "cost"))
    none = F.when(failed_all, F.lit("No findings reported, because the review did not complete.")).otherwise(F.concat_ws(" — ", F.lit("No findings survived the gate"), by_stage))
    some = F.concat_ws("\n\n", "summary", F.concat_ws(", ", F.concat(F.size("x"), F.lit(" verified finding(s)")), by_stage), F.array_join(F.col("x.t"), "\n\n"))
    said = [
        F.when(F.col("model").isNotNull(), F.concat(F.lit("model "), "model", F.lit("  ·  estimated cost "), cost, F.lit("  ·  "), F.format_number("prompt_tokens", 0), F.lit(" prompt tokens"))),
        F.when(failed_all, F.format_string("WARNING: all %d review call(s) failed; the review did not run.", "review_calls")).when(F.col("review_failures") > 0, F.format_string("WARNING: %d of %d review call(s) failed, so some files were not reviewed.", "review_failures", "review_calls")),
        F.when(F.col("verify_failures") > 0, F.format_string("WARNING: %d finding(s) were dropped because their verification failed.", "verify_failures")),
        F.when(F.col("x").isNull(), none).otherwise(some),
        F.when(F.col("cut") > 0, F.format_string("context trimmed to fit the budget: %d block(s)", "cut")),
    ]
    return made.select(*review, F.concat_ws("\n\n", *said).alias("report"))


def comments(posted: DataFrame) -> DataFrame:
    """One payload per posted finding: path, line, side, body with the finding's marker."""
    proof = F.when(F.coalesce("proof", F.lit("")) != "", F.concat(F.lit("\n\n"), F.col("proof"))).otherwise(F.lit(""))
    body = F.concat(F.lit("**"), F.upper("severity"), F.lit("** "), F.col("title"), proof, F.lit("\n\n"), encode_finding_marker(F.col("fingerprint")))
    return posted.select(F.col("file").alias("path"), "line", F.lit("RIGHT").alias("side"), body.alias("body"))


def first_with(comments_: DataFrame, group: list[str], order: str, marked: Column) -> DataFrame:
    """The first comment of each group that carries a marker."""
    return comments_.filter(marked).groupBy(*group).agg(F.min_by(F.struct(*comments_.columns), order).alias("c")).select("c.*")


def reaction_counts(reactions: DataFrame) -> DataFrame:
    """(fingerprint, source, count) of reactions on own comments; rows without a fingerprint are others' comments."""
    return reactions.filter(F.col("fingerprint").isNotNull()).groupBy("fingerprint", "source").agg(F.count(F.lit(1)).alias("count"))
