"""Grading of findings against labelled expectations: one-to-one matching, totals, rates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that a match may be away.
NEAR = 2
BUCKETS = ("caught", "gated", "missed", "near_miss", "held", "leaked", "wrong_stage", "unexercised", "false_positive")
OUTCOMES = "case string, ord int, bucket string, matched int"


def located(a_file: Column, a_line: Column, b_file: Column, b_line: Column) -> Column:
    return (a_file == b_file) & (F.abs(a_line - b_line) <= NEAR)


def matches(file: Column, line: Column, words: Column, other_file: Column, other_line: Column, title: Column) -> Column:
    """Same file, near line, and any keyword in the lower-cased title, or no keyword at all."""
    low = F.lower(title)
    return located(file, line, other_file, other_line) & ((F.size(words) == 0) | F.exists(words, lambda w: low.contains(w)))


def grade(expected: DataFrame, verdicts: DataFrame, held_back: DataFrame | None = None) -> DataFrame:
    """(case, ord, bucket, matched) for every expectation, every near miss and every posted verdict that none matched.

    expected: (case, ord, file, line, words array<string>); verdicts: (case, ord, file, line, title, posted and, for
    held_back, stage); held_back: expectations that the gate must reject, with stage or null for any.
    Each expectation in order takes the first unused posted verdict that matches (caught), else the first unused dropped
    one (gated), else it is missed; if an unused verdict lies near, that is used and gives a row near_miss besides. Then
    those of held_back take what is left: a posted verdict (leaked), else a dropped one (held, or wrong_stage), else none
    (unexercised). What is posted and unused at last is false_positive. Matching is sequential, so a case is one group;
    cases are independent. Within a case verdicts are looked up by file and line.
    """
    both = expected.select("case", "ord", "file", "line", "words", F.lit(False).alias("gate"), F.lit(None).cast("string").alias("stage"))
    if held_back is not None:
        both = both.unionByName(held_back.select("case", "ord", "file", "line", "words", F.lit(True).alias("gate"), "stage"))
    if "stage" not in verdicts.columns:
        verdicts = verdicts.withColumn("stage", F.lit(None).cast("string"))

    def one(key, want: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        pools = []
        for posted in (True, False):
            by_place: dict = {}
            for v in got[got["posted"] == posted].sort_values("ord").itertuples():
                by_place.setdefault((v.file, v.line), []).append(v)
            pools.append(by_place)

        def take(pool, e, words):
            near = [v for at in range(e.line - NEAR, e.line + NEAR + 1) for v in pool.get((e.file, at), ())]
            fits = [v for v in near if not len(words) or any(w in (v.title or "").lower() for w in words)]
            if not fits:
                return None
            best = min(fits, key=lambda v: v.ord)
            pool[best.file, best.line].remove(best)
            return best

        out, (shown, gone) = [], pools
        for e in want[~want["gate"]].sort_values("ord").itertuples():
            caught = take(shown, e, e.words)
            gated = take(gone, e, e.words) if caught is None else None
            bucket, hit = ("caught", caught) if caught is not None else ("gated", gated) if gated is not None else ("missed", None)
            out.append((e.ord, bucket, hit and hit.ord))
            if hit is None:
                near = take(shown, e, ()) or take(gone, e, ())
                out += [(e.ord, "near_miss", near.ord)] if near else []
        for e in want[want["gate"]].sort_values("ord").itertuples():
            leak = take(shown, e, e.words)
            hit = leak or take(gone, e, e.words)
            right = hit and (e.stage is None or (hit.stage or "ranked_out") == e.stage)
            out.append((e.ord, "leaked" if leak else "unexercised" if not hit else "held" if right else "wrong_stage", hit and hit.ord))
        out += [(None, "false_positive", v.ord) for vs in shown.values() for v in vs]
        made = pd.DataFrame(out, columns=["ord", "bucket", "matched"]).astype({"ord": "Int32", "matched": "Int32"})
        made.insert(0, "case", key[0])
        return made

    return both.groupBy("case").cogroup(verdicts.groupBy("case")).applyInPandas(one, OUTCOMES)


def totals(graded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by bucket, expected (caught, gated or missed), catch_rate and fp_rate; see rates."""
    sums = graded.groupBy(*(by or [])).agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS])
    return rates(sums.withColumn("expected", F.col("caught") + F.col("gated") + F.col("missed")))


def report(graded: DataFrame, proven: DataFrame | None = None, calls: DataFrame | None = None) -> DataFrame:
    """One row of the 13 totals of an evaluation, its two rates and the number of cases.

    proven: (case, ord) of posted verdicts that a proof found, of which those that were caught count; calls: (case, made,
    failed) of model calls.
    """
    sums = totals(graded).crossJoin(graded.agg(F.count_distinct("case").alias("cases")))  # single rows
    found = graded.filter("bucket = 'caught'").select("case", F.col("matched").alias("ord"))
    sums = sums.crossJoin((found.join(proven, ["case", "ord"], "left_semi") if proven is not None else found.limit(0)).agg(F.count(F.lit(1)).alias("proven")))
    spent = calls.agg(F.coalesce(F.sum("made"), F.lit(0)).alias("review_calls"), F.coalesce(F.sum("failed"), F.lit(0)).alias("review_failures")) if calls is not None else found.sparkSession.range(1).select(F.lit(0).cast("long").alias("review_calls"), F.lit(0).cast("long").alias("review_failures"))
    return sums.crossJoin(spent)


def report_text(sums: DataFrame) -> DataFrame:
    """(text) of the closing lines of a report: warnings where there is cause, then the rates."""
    said = [
        F.when(F.col("near_miss") > 0, F.format_string("%d near miss(es): the place was right and no keyword matched; counted as missed", "near_miss")),
        F.when(F.col("review_failures") > 0, F.format_string("WARNING: %d of %d review call(s) failed; what they didn't answer counts as missed", "review_failures", "review_calls")),
        F.format_string("catch rate %.0f%% (%d caught, %d gated, %d missed)", F.col("catch_rate") * 100, "caught", "gated", "missed"),
        F.when(F.col("proven") > 0, F.format_string("%d of the %d caught were proven by parsing", "proven", "caught")),
        F.format_string("false positives %d (%.2f per expected finding)", "false_positive", "fp_rate"),
        F.when(F.col("held") + F.col("leaked") + F.col("wrong_stage") + F.col("unexercised") > 0, F.format_string("gate assertions %d held, %d leaked, %d wrong stage, %d untested", "held", "leaked", "wrong_stage", "unexercised")),
    ]
    return sums.select(F.concat_ws("\n", *said).alias("text"))


def report_lines(graded: DataFrame, expected: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(case, place, text): a line for each outcome, in the order of buckets, then of expectations.

    expected: as for grade, those of held_back among them; verdicts with title.
    """
    place = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("bucket"))
    e = expected.select("case", "ord", F.col("file").alias("e_file"), F.col("line").alias("e_line")).dropDuplicates(["case", "ord"])
    v = verdicts.select("case", F.col("ord").alias("matched"), "file", "line", "title")
    met = graded.join(e, ["case", "ord"], "left").join(v, ["case", "matched"], "left")
    text = F.concat(F.rpad("bucket", 15, " "), F.coalesce("e_file", "file"), F.lit(":"), F.coalesce("e_line", "line"), F.when(F.col("bucket").isin("near_miss", "false_positive"), F.concat(F.lit("  "), "title")).otherwise(""))
    return met.select("case", place.alias("place"), "ord", "matched", text.alias("text"))


def rates(sums: DataFrame) -> DataFrame:
    """sums with catch_rate and fp_rate from caught, false_positive and expected."""
    none = F.col("expected") == 0
    catch = F.when(none, F.lit(1.0)).otherwise(F.col("caught") / F.col("expected"))
    wrong = F.when(none, F.col("false_positive").cast("double")).otherwise(F.col("false_positive") / F.col("expected"))
    return sums.withColumns({"catch_rate": F.bround(catch, 4), "fp_rate": F.bround(wrong, 4)})
