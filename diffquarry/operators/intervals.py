"""Points in intervals: the innermost or the first enclosing span; bounded hops; ranking by place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calls import shared_depth


def enclosing(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str, order: list[str], innermost: bool = True, bucket: float | None = None) -> DataFrame:
    """points with the columns of the one span (on equal, start <= at <= end) that encloses each.

    innermost: the shortest, ties by order; else the first by order. Points without a span are left out. With a bucket
    width, spans are posted under each bucket that they touch, so a key with many spans is no product of all of them.
    """
    points = points.withColumn("__id", F.monotonically_increasing_id())
    keys = list(on)
    if bucket:
        points = points.withColumn("__b", F.floor(F.col(at) / bucket))
        spans = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
        keys.append("__b")
    met = points.join(spans, keys).filter(F.col(at).between(F.col(start), F.col(end)))
    rank = [F.col(end) - F.col(start), *order] if innermost else order
    return met.withColumn("__r", F.row_number().over(Window.partitionBy("__id").orderBy(*rank))).filter("__r = 1").drop("__r", "__id", "__b")


def k_hops(seeds: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(seed, node, hop): what each seed reaches over edges (src, dst) in 1 to most hops, by the fewest hops.

    One equi-join for each hop; what a seed has reached before is taken away, so cycles end.
    """
    links = edges.select("src", "dst").distinct()
    reached = front = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop")).distinct()
    for hop in range(1, most + 1):
        step = front.join(links, front["node"] == links["src"]).select("seed", F.col("dst").alias("node")).distinct()
        front = step.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.unionByName(front)
    return reached.filter("hop > 0")


def nearest_paths(hits: DataFrame, by: list[str], origin: str, path: str, order: list[str], most: int) -> DataFrame:
    """The most hits of each key whose paths share the most leading directories with origin; ties by path, then order."""
    w = Window.partitionBy(*by).orderBy(F.desc("depth"), path, *order)
    return hits.withColumn("depth", shared_depth(F.col(origin), F.col(path))).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def nearest_of_all(asked: DataFrame, rows: DataFrame, on: list[str], path: str, key: str, most: int) -> DataFrame:
    """(origin, key, path, depth, place): for each asked row (origin, from_path, on) the most rows of its own key columns on
    whose paths share the most leading directories with from_path; ties by path, then key. A row isn't its own neighbour.

    Rows are posted under each prefix of their directories, of which only the first few by path can ever be wanted: most
    of one subdirectory, and twice as many in all, as an origin leaves out its own subdirectory there. So no origin
    meets all rows of its key.
    """

    def posted(df, name, kept):
        dirs = F.slice(F.split(name, "/"), 1, F.size(F.split(name, "/")) - 1)
        steps = F.transform(F.sequence(F.lit(0), F.size(dirs)), lambda j: F.struct(j.alias("depth"), F.array_join(F.slice(dirs, F.lit(1), j), "/").alias("prefix"), F.get(dirs, j).alias("child")))
        return df.select(*on, *kept, F.explode(steps).alias("s")).select(*on, *kept, "s.*")

    lists = posted(rows, path, [key, path])
    for by, n in (([*on, "depth", "prefix", "child"], most + 1), ([*on, "depth", "prefix"], 2 * most + 2)):
        lists = lists.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(path, key))).filter(F.col("__n") <= n).drop("__n")
    wanted = posted(asked, "from_path", ["origin"]).withColumnRenamed("child", "own")
    met = wanted.join(lists, [*on, "depth", "prefix"]).filter((F.col("origin") != F.col(key)) & (F.col("own").isNull() | ~F.col("own").eqNullSafe(F.col("child"))))
    w = Window.partitionBy("origin").orderBy(F.desc("depth"), path, key)
    return met.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("origin", key, path, "depth", "place")


def unique_only(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose name occurs once."""
    return rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(name))).filter("__n = 1").drop("__n")
