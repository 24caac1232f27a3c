"""Unified diffs as relations: lines, hunks, added lines, and back to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import split_lines

# Headers of files and hunks.
FILE_HEADER = r"^\+\+\+ (?:b/)?(.+)$"
HUNK_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def diff_lines(diffs: DataFrame, key: str = "diff_id", text: str = "diff") -> DataFrame:
    """(key, pos, line) of each diff text; pos counts from 0."""
    return diffs.select(F.col(key), F.posexplode(split_lines(F.col(text))).alias("pos", "line"))


def hunk_lines(lines: DataFrame, key: str = "diff_id") -> DataFrame:
    """(key, path, file_ord, hunk, pos, line, kind, new_line) of the lines inside hunks.

    lines: (key, pos, line). kind: '+', '-' or ' '. new_line: the line's number in the new file, for '+' and ' '.
    Lines are read by their prefix alone, so inside a hunk '+++ x' opens a file and '--- x' says nothing. A file at
    /dev/null and whatever stands before a file's or hunk's header belong to no hunk. hunk counts within a diff.
    """
    line = F.col("line")
    opens = line.rlike(FILE_HEADER) & ~line.startswith("--- ")
    leaves = line.startswith("diff --git ")
    kept = lines.filter(~line.startswith("--- ") & ~line.startswith("\\"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = F.when(leaves, F.lit("/dev/null")).when(opens, F.regexp_extract("line", FILE_HEADER, 1))
    rows = kept.withColumn("path", F.last(path, ignorenulls=True).over(w)).withColumn("edge", opens | leaves)
    rows = rows.filter(F.col("path").isNotNull() & (F.col("path") != "/dev/null"))
    header = ~F.col("edge") & line.rlike(HUNK_HEADER)
    rows = rows.withColumn("header", header).withColumn("hunk", F.sum(F.col("header").cast("int")).over(w))
    rows = rows.withColumn("section", F.sum(F.col("edge").cast("int")).over(w))
    first = F.min("pos").over(Window.partitionBy(key, "path"))
    inside = Window.partitionBy(key, "section", "hunk").orderBy("pos")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("file_ord", first).withColumn("own", F.max("header").over(Window.partitionBy(key, "section", "hunk")))
    rows = rows.filter(F.col("own") & ~F.col("edge"))
    kind = F.when(F.col("header"), "@").when(line.startswith("+") & ~line.startswith("+++"), "+").when(line.startswith("-") & ~line.startswith("---"), "-").otherwise(" ")
    rows = rows.withColumn("kind", kind)
    start = F.first(F.when(F.col("header"), F.regexp_extract("line", HUNK_HEADER, 3).cast("int")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.coalesce(F.sum(F.col("kind").isin("+", " ").cast("int")).over(upto), F.lit(0)).cast("int")
    rows = rows.withColumn("new_line", F.when(F.col("kind").isin("+", " "), start + before))
    return rows.select(key, "path", "file_ord", "hunk", "pos", "line", "kind", "new_line")


def hunks(lines: DataFrame, key: str = "diff_id") -> DataFrame:
    """One row per hunk: (key, file_ord, path, hunk_ord, old_start, old_count, new_start, new_count, added, removed,
    header, lines, new_end). A missing count is 1. Files are ordered by first appearance, hunks by position."""
    rows = hunk_lines(lines, key)
    body = F.array_sort(F.collect_list(F.when(F.col("kind") != "@", F.struct("pos", "line"))))
    added = F.array_sort(F.collect_list(F.when(F.col("kind") == "+", F.col("new_line"))))
    head = F.max(F.when(F.col("kind") == "@", F.col("line")))
    made = rows.groupBy(key, "file_ord", "path", "hunk").agg(body.alias("body"), added.alias("added"), F.count_if(F.col("kind") == "-").cast("int").alias("removed"), head.alias("header"))
    number = lambda i: F.regexp_extract("header", HUNK_HEADER, i)
    count = lambda i: F.coalesce(F.nullif(number(i), F.lit("")).cast("int"), F.lit(1))
    w = Window.partitionBy(key, "path").orderBy("hunk")
    return made.select(
        key, "file_ord", "path", (F.row_number().over(w) - 1).alias("hunk_ord"), number(1).cast("int").alias("old_start"), count(2).alias("old_count"), number(3).cast("int").alias("new_start"), count(4).alias("new_count"),
        "added", "removed", "header", F.col("body.line").alias("lines"),
    ).withColumn("new_end", F.col("new_start") + F.greatest(F.col("new_count") - 1, F.lit(0)))


def added_lines(hunk_rows: DataFrame, key: str = "diff_id") -> DataFrame:
    """(key, path, line): distinct numbers of added lines."""
    return hunk_rows.select(key, "path", F.explode("added").alias("line")).distinct()


def render_files(hunk_rows: DataFrame, key: str = "diff_id") -> DataFrame:
    """(key, path, diff): a diff text of each file from its hunks, in order."""
    parts = F.array_sort(F.collect_list(F.struct("hunk_ord", F.concat(F.array("header"), F.col("lines")).alias("t"))))
    made = hunk_rows.groupBy(key, "path").agg(F.flatten(parts["t"]).alias("body"))
    return made.select(key, "path", F.array_join(F.concat(F.array(F.concat(F.lit("--- a/"), "path"), F.concat(F.lit("+++ b/"), "path")), "body"), "\n").alias("diff"))


def in_any_hunk(findings: DataFrame, hunk_rows: DataFrame, key: str = "diff_id") -> Column | DataFrame:
    """Findings (key, file, line) whose line lies between new_start and new_end of a hunk of the file."""
    spans = hunk_rows.select(F.col(key).alias("__k"), F.col("path").alias("__p"), "new_start", "new_end")
    hit = (findings[key] == spans["__k"]) & (findings["file"] == spans["__p"]) & findings["line"].between(spans["new_start"], spans["new_end"])
    return findings.join(spans, hit, "left_semi")


def nearby_text(findings: DataFrame, lines: DataFrame, key: str = "diff_id", within: int = 2) -> DataFrame:
    """findings with text: the lines (key, path, line, text) within that distance of their own, in order, joined."""
    near = lines.select(F.col(key).alias("__k"), F.col("path").alias("__p"), F.col("line").alias("__l"), F.col("text").alias("__t"))
    hit = (findings[key] == near["__k"]) & (findings["file"] == near["__p"]) & (F.abs(findings["line"] - near["__l"]) <= within)
    made = findings.join(near, hit, "left").groupBy(*findings.columns).agg(F.array_sort(F.collect_list(F.when(F.col("__l").isNotNull(), F.struct("__l", "__t")))).alias("__x"))
    return made.withColumn("text", F.array_join(F.col("__x.__t"), "\n")).drop("__x")
