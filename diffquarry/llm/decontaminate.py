"""Benchmark decontamination: prefix-filtered set join of item windows and documents, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, discard, materialize, table

#: ASCII but for digits and letters: what separates words.
SEPARATORS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())
#: A side is broadcast up to this many bytes, measured by row count and longest row; beyond, it is shuffled.
BROADCAST_BYTES = 32 << 20


def plain(text: Column) -> Column:
    """A-Z lowered, every separator a space; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))


def split_plain(body: Column) -> Column:
    return F.filter(F.split(body, " "), lambda w: w != "")


def _bounded(df: DataFrame, width: Column) -> bool:
    """Whether a written table has BROADCAST_BYTES at most."""
    n, most = df.agg(F.count(F.lit(1)), F.max(width)).first()
    return n * ((most or 0) + 64) <= BROADCAST_BYTES


def item_windows(items: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """(win array<string>, item): all windows of width words; an item of fewer words, but not none, is one."""
    words = items.select(F.col(item).alias("item"), split_plain(plain(F.col(text))).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1))
    return words.select("item", "words", F.explode(starts).alias("at")).select(F.slice("words", F.col("at"), width).alias("win"), "item").distinct()


def _text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a whole text."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit("second"), whole).alias("k2")]


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 13, part: float = 0.05) -> DataFrame:
    """(key, k1, k2, n_words, n_hit, items array<string>, contaminated) for every row of docs.

    A document word is hit if it lies in an occurrence of a window of any item; contaminated if hit words are above 0
    and part of all words at least. items: ids of items with an occurring window, sorted as strings.
    Null and empty texts have no words and aren't contaminated; null or empty items have no window. Equal windows and
    repeated rows count once each in n_hit and items. Either table may be empty.

    Method: window words are ordered by how often they occur in all documents; a window must match whole, so the
    prefix that a partner has to share is its one rarest word. Documents meet windows by an equi-join on that word,
    then the position must leave room for the window on either side, and the window must equal the words there.
    Windows with a word that no document holds go at once. The window side is broadcast only below BROADCAST_BYTES;
    beyond, postings carry the words around them and are shuffled by their word.
    """
    windows = materialize(item_windows(items, item, item_text, width).groupBy("win").agg(F.collect_set(F.col("item").cast("string")).alias("items")).withColumn("wid", F.monotonically_increasing_id()), "windows")
    body = docs.select(F.col(key).alias("key"), *_text_keys(F.col(text)), plain(F.col(text)).alias("body"))
    body = materialize(body.withColumn("n_words", F.size(split_plain(F.col("body"))).cast("long")), "bodies")

    needed = materialize(windows.select(F.explode("win").alias("word")).distinct(), "vocabulary")
    few = _bounded(needed, F.length("word") * 3)
    small = F.broadcast if few else lambda df: df
    seen = body.select(F.explode(split_plain(F.col("body"))).alias("word")).join(small(needed), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = needed.join(materialize(seen, "rarity"), "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    spots = windows.select("wid", F.posexplode("win").alias("offset", "word")).join(counts, "word")
    rarest = spots.groupBy("wid").agg(F.min(F.struct("n", "word", "offset")).alias("r")).filter("r.n > 0")
    anchors = materialize(windows.join(rarest, "wid").select(F.col("r.word").alias("word"), F.col("r.offset").alias("offset"), "win", "wid"), "anchors")

    tokens = body.select("k1", "k2", "n_words", split_plain(F.col("body")).alias("words")).select("k1", "k2", "n_words", "words", F.posexplode("words").alias("pos", "word"))
    fits = (F.col("pos") >= F.col("offset")) & (F.col("pos") - F.col("offset") + F.size("win") <= F.col("n_words"))
    if _bounded(anchors, F.length(F.array_join("win", " ")) * 4):
        same = F.slice("words", F.col("pos") - F.col("offset") + 1, F.size("win")) == F.col("win")
        met = tokens.join(F.broadcast(anchors), "word")
    else:
        left = F.least(F.col("pos"), F.lit(width - 1))
        around = tokens.select("k1", "k2", "n_words", "pos", "word", left.alias("left"), F.slice("words", F.col("pos") - left + 1, 2 * width - 1).alias("near"))
        same = F.slice("near", F.col("left") - F.col("offset") + 1, F.size("win")) == F.col("win")
        met = around.join(anchors, "word")
    hits = met.filter(fits & F.when(fits, same)).select("k1", "k2", (F.col("pos") - F.col("offset")).alias("start"), F.size("win").alias("len"), "wid").distinct()
    hits = materialize(hits, "hits")

    before = F.max(F.col("start") + F.col("len")).over(Window.partitionBy("k1", "k2").orderBy("start", "len", "wid").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    spans = hits.select("k1", "k2", new.alias("new")).groupBy("k1", "k2").agg(F.sum("new").alias("n_hit"))
    named = hits.select("k1", "k2", "wid").distinct().join(windows.select("wid", F.explode("items").alias("item")), "wid")
    named = named.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = materialize(spans.join(named, ["k1", "k2"]), "found")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    made = body.join(found, ["k1", "k2"], "left").select(
        F.col("key").alias(key), "k1", "k2", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (n_hit >= F.col("n_words") * F.lit(part))).alias("contaminated"),
    )
    made = materialize(made, "contamination")
    discard(body, windows, needed, anchors, hits, found)
    return made


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs that aren't contaminated, with the columns of docs; equal texts share their fate."""
    bad = contamination(docs, items, key, text, **how).filter("contaminated").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    k1, k2 = _text_keys(docs[text])
    return docs.join(bad, (k1 == F.col("__k1")) & (k2 == F.col("__k2")), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated.alias("contaminated"))


#: Words of a column t: the class is that of the contract, in RE2's notation.
_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM b)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, s, dw.n AS n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
QUERIES = {"op10_decontaminate": op10_decontaminate}
ORACLE = {"op10_decontaminate": SQL}
