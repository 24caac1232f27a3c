"""What review hosts answer, as relations: pages of comments, resolved threads, reactions, and the comment to write.

Calls aren't made here: pages are rows (scope, page, body), body being the JSON that a host sent, and a plan of comments is
rows for whoever calls the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import decode_finding_marker, decode_marker, has_marker

# Items on a full page, pages read at most.
PER_PAGE, MOST_PAGES = 100, 10
COMMENT = "struct<id:bigint,body:string,reactions:map<string,string>>"
THREADS = "struct<pageInfo:struct<hasNextPage:boolean,endCursor:string>,nodes:array<struct<isResolved:boolean,comments:struct<nodes:array<struct<databaseId:bigint>>>>>>"


def _until(pages: DataFrame, scope: list[str], last: Column) -> DataFrame:
    """Pages up to the first that is the last one, MOST_PAGES at most; none beyond a page that is absent."""
    w = Window.partitionBy(*scope).orderBy("page")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.withColumn("__place", F.row_number().over(w)).withColumn("__over", F.coalesce(F.max(last).over(before), F.lit(False)))
    return rows.filter((F.col("__place") == F.col("page")) & (F.col("page") <= MOST_PAGES) & ~F.col("__over")).drop("__place", "__over")


def comments(pages: DataFrame, scope: list[str], per_page: int = PER_PAGE) -> DataFrame:
    """(scope, ord, id, body, reactions) of the items of pages from 1; a page that isn't full, or no JSON, is the last."""
    parsed = pages.withColumn("items", F.coalesce(F.from_json("body", f"array<{COMMENT}>"), F.array().cast(f"array<{COMMENT}>")))
    read = _until(parsed, scope, F.size("items") < per_page)
    return read.select(*scope, "page", F.posexplode("items").alias("at", "c")).select(*scope, ((F.col("page") - 1) * per_page + F.col("at")).alias("ord"), "c.*")


def resolved(pages: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, id): first comments of threads that are marked resolved, from pages of threads that end where none follows."""
    parsed = pages.withColumn("t", F.from_json("body", THREADS))
    read = _until(parsed, scope, ~F.coalesce("t.pageInfo.hasNextPage", F.lit(False)))
    nodes = read.select(*scope, F.explode("t.nodes").alias("n")).filter("n.isResolved")
    return nodes.select(*scope, F.get(F.col("n.comments.nodes"), F.lit(0))["databaseId"].alias("id")).filter("id is not null").distinct()


def feedback(made: DataFrame, done: DataFrame, scope: list[str], host: str) -> DataFrame:
    """(scope, fingerprint, kind, source, count) of own comments: their reactions above 0, and whether they are resolved."""
    own = made.withColumn("fingerprint", decode_finding_marker(F.col("body"))).filter("fingerprint is not null")
    said = own.select(*scope, "fingerprint", F.explode("reactions").alias("key", "n")).withColumn("count", F.expr("try_cast(n as int)")).filter("count > 0 and key not in ('total_count', 'url')")
    said = said.select(*scope, "fingerprint", F.lit("reaction").alias("kind"), F.concat(F.lit(f"{host}:"), "key").alias("source"), "count")
    closed = own.join(done, [*scope, "id"], "left_semi")
    return said.unionByName(closed.select(*scope, "fingerprint", F.lit("resolved").alias("kind"), F.lit(f"{host}:resolved").alias("source"), F.lit(1).alias("count")))


def remembered(made: DataFrame, posted: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, fingerprints): those of the first comment with a marker and those just posted, each once, sorted."""
    old = made.filter(has_marker(F.col("body"))).groupBy(*scope).agg(F.min_by("body", "ord").alias("body")).select(*scope, decode_marker(F.col("body")).alias("old"))
    new = posted.groupBy(*scope).agg(F.collect_set("fingerprint").alias("new"))
    none = F.array().cast("array<string>")
    return old.join(new, scope, "full").select(*scope, F.array_sort(F.array_union(F.coalesce("old", none), F.coalesce("new", none))).alias("fingerprints"))


def summary_plan(bodies: DataFrame, made: DataFrame, scope: list[str]) -> DataFrame:
    """bodies (scope, text) with action and id: the first comment with a marker is updated, else one is created."""
    first = made.filter(has_marker(F.col("body"))).groupBy(*scope).agg(F.min_by("id", "ord").alias("id"))
    return bodies.join(first, scope, "left").withColumn("action", F.when(F.col("id").isNull(), "create").otherwise("update"))


def after_failure(plan: DataFrame, failed: DataFrame, scope: list[str]) -> DataFrame:
    """What is left to do of a plan: an update that failed (scope) becomes a new comment, so that the review isn't lost."""
    again = plan.filter("action = 'update'").join(failed, scope, "left_semi")
    return again.withColumn("action", F.lit("create")).withColumn("id", F.lit(None).cast("bigint"))
