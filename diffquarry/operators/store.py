"""The review store: upsert, replace by key, feedback that survives a replacement, statistics.

Plain columnar tables have no MERGE, so each mutation is a function from old and new rows to the rows to write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written

REVIEW_KEY = ["platform", "repo", "head_sha"]
# Signals that count for and against a finding.
THUMBS_UP, THUMBS_DOWN = ("+1", "thumbsup"), ("-1", "thumbsdown")


def latest(rows: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in newest])
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of old and new; where keys meet, new's row with old's values of the columns in keep."""
    if not keep:
        return old.join(new, keys, "left_anti").unionByName(new).select(*new.columns)
    kept = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep])
    merged = new.join(kept, keys, "left").select(*[F.coalesce(f"__{c}", F.col(c)).alias(c) if c in keep else F.col(c) for c in new.columns])
    return old.join(new, keys, "left_anti").unionByName(merged).select(*new.columns)


def assign_ids(rows: DataFrame, order: list[str], after: int = 0, name: str = "id") -> DataFrame:
    """rows with dense ids from after + 1 in order, without one task for all rows.

    Ranges are sorted apart and written once; the counts of the ranges before, one for each partition, are added.
    """
    spread = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    spread = spread.withColumn("__p", F.shiftright("__m", 33))
    counts = spread.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    number = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before") + after + 1
    return spread.join(F.broadcast(before), "__p").withColumn(name, number.cast("long")).drop("__m", "__p", "__before")


def replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old whose keys new doesn't have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def reattach(feedback: DataFrame, old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """feedback of old findings given to the first posted new finding of the same group and fingerprint; else lost."""
    named = feedback.join(old.select(F.col("id").alias("finding_id"), *group, "fingerprint"), "finding_id").drop("finding_id")
    target = new.filter("posted").groupBy(*group, "fingerprint").agg(F.min("id").alias("finding_id"))
    return named.join(target, [*group, "fingerprint"]).select(*feedback.columns)


def resolve(reported: DataFrame, findings: DataFrame, scope: list[str]) -> DataFrame:
    """reported reactions with finding_id: the latest posted finding of their scope and fingerprint; misses are left out."""
    target = findings.filter("posted").groupBy(*scope, "fingerprint").agg(F.max("id").alias("finding_id"))
    return reported.join(target, [*scope, "fingerprint"])


def cascade_delete(parents: DataFrame, children: DataFrame, key: str, reference: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(key).alias("__k")), F.col(reference) == F.col("__k"), "left_semi")


def in_window(started: Column, now: Column, days: int) -> Column:
    return started >= now - F.make_dt_interval(F.lit(days))


def conditional_counts(rows: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    """Per key the rows that meet each condition."""
    return rows.groupBy(*by).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def conform(rows: DataFrame, columns: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """rows in the columns (type, default) of a newer table: absent ones are added and nulls filled with the default."""

    def made(name, kind, default):
        own = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        return (own if default is None else F.coalesce(own, default.cast(kind))).alias(name)

    return rows.select(*[made(name, *how) for name, how in columns.items()])


def stats(reviews: DataFrame, findings: DataFrame, feedback: DataFrame, repo: str, days: int, now: Column) -> DataFrame:
    """One row: what stored reviews of a repository in the last days and the feedback on them add up to.

    Reactions are counted by finding, not by reaction. Categories without a posted finding are left out. days: 1 to 3650.
    """
    if not 1 <= days <= 3650:
        raise ValueError("days must be between 1 and 3650")
    recent = reviews.filter((F.col("repo") == repo) & in_window(F.col("started_at"), now, days))
    total = recent.agg(F.struct(F.count(F.lit(1)).alias("total"), F.count_if("review_incomplete").alias("incomplete")).alias("reviews"))
    own = findings.join(recent.select(F.col("id").alias("review_id")), "review_id", "left_semi")
    signal = F.split_part("source", F.lit(":"), F.lit(2))
    marks = feedback.groupBy("finding_id").agg(
        F.bool_or((F.col("kind") == "reaction") & signal.isin(*THUMBS_UP)).alias("up"), F.bool_or((F.col("kind") == "reaction") & signal.isin(*THUMBS_DOWN)).alias("down"), F.bool_or(F.col("kind") == "resolved").alias("resolved")
    )
    marked = own.join(marks.withColumnRenamed("finding_id", "id"), "id", "left").fillna(False, ["up", "down", "resolved"])
    proven = F.coalesce("proof", F.lit("")) != ""
    sums = own.agg(F.count_if("posted").alias("posted"), F.count_if(F.col("posted") & proven).alias("proven"))
    drops = own.filter(~F.col("posted")).groupBy(F.coalesce("dropped_at", F.lit("ranked_out")).alias("stage")).count()
    dropped = drops.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "count")))).alias("dropped"))
    by = conditional_counts(marked, ["category"], posted=F.col("posted"), thumbs_up=F.col("posted") & F.col("up"), thumbs_down=F.col("posted") & F.col("down"), resolved=F.col("posted") & F.col("resolved")).filter("posted > 0")
    categories = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", F.struct("posted", "thumbs_up", "thumbs_down", "resolved"))))).alias("by_category"))
    one = total.crossJoin(sums).crossJoin(dropped).crossJoin(categories)  # four single rows
    return one.select(F.lit(repo).alias("repo"), F.lit(days).alias("days"), "reviews", F.struct("posted", "proven", "dropped").alias("findings"), "by_category")
