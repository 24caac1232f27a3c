"""Substring deduplication: paragraphs by MinHash banding of word shingles, passages inside them by their windows' minima."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANKS, by_parts, discard, free_shuffles, materialize
from .common import table as read
from .minhash import first_place, place_of, tune, unit_classes, word_hashes

WIDTH, THRESHOLD, ROWS, RECALL = 5, 0.8, 3, 0.99
#: Words of a window, and of a passage that can't be missed if two documents share it.
SPAN, LEAST = 20, 50
BLANK = " " + BLANKS
PIECE = re.compile(r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+")
#: Odd multipliers that mix the words of a shingle.
MIXERS = np.array([2 * k + 1 for k in np.random.default_rng(5).integers(1 << 62, size=WIDTH).tolist()], np.uint64)


def mixed(parts: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """64-bit hashes of rows of numbers, one array for each place."""
    made = np.full(len(parts[0]), salt, np.uint64)
    for x, m in zip(parts, MIXERS, strict=False):
        made = (made ^ x) * m
        made ^= made >> np.uint64(31)
    return made


def shingles(hashes: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of all runs of width words of each line; a shorter line is one shingle. hashes: those of all words."""
    ends = np.cumsum(sizes)
    line = np.repeat(np.arange(len(sizes)), sizes)
    padded = np.append(hashes, np.zeros(width, np.uint64))
    at = np.flatnonzero((np.arange(len(hashes)) + width <= ends[line]) | (np.arange(len(hashes)) == (ends - sizes)[line]))
    parts = [np.where(at + i < ends[line[at]], padded[at + i], np.uint64(0)) for i in range(width)]
    return line[at], mixed(parts)


def signatures(line: np.ndarray, hashes: np.ndarray, n: int, values: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(ends, keys): the band_keys of n lines from their shingles, those of each line up to its end."""
    by = np.lexsort((hashes, line))
    line, hashes = line[by], hashes[by]
    new = np.append(True, (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])) if len(line) else np.zeros(0, bool)
    line, hashes = line[new], hashes[new]
    size = np.bincount(line, minlength=n)
    first = np.cumsum(size) - size
    rank, of = np.arange(len(line)) - first[line], size[line]
    ahead = np.flatnonzero((of >= rows) & (rank + rows <= np.minimum(of, values)))
    around = np.flatnonzero(of <= values)
    there, m = first[line[around]], of[around]
    turns = [np.where(i < m, hashes[there + (rank[around] + i) % m], np.uint64(0)) for i in range(rows)]
    keys = np.concatenate([mixed([hashes[ahead + i] for i in range(rows)], 1), mixed(turns, 2)])
    owner = np.concatenate([line[ahead], line[around]])
    return np.cumsum(np.bincount(owner, minlength=n)), keys[np.argsort(owner, kind="stable")].view(np.int64)


def window_starts(hashes: np.ndarray, sizes: np.ndarray, span: int, least: int) -> np.ndarray:
    """Where in all words the windows of span words begin by which texts of these sizes are known: of any least - span + 1
    neighbours the one whose first shingle has the least hash.

    So two texts that share least words share a window: among those wholly inside the passage both take the same.
    """
    n, wide, width = len(hashes) - span + 1, least - span + 1, len(MIXERS)
    if n <= 0:
        return np.zeros(0, np.int64)
    value = mixed([hashes[i : i + n] for i in range(width)])
    ends = np.cumsum(sizes)
    last = ends - span  # of each text the last start, below its first if it has none
    found, step = [], 1 << 16
    for at in range(0, n - wide + 1, step):
        part = value[at : at + step + wide - 1]
        p = at + np.arange(len(part) - wide + 1)
        whole = p + wide - 1 <= last[np.searchsorted(ends, p, side="right")]
        found.append((p + np.lib.stride_tricks.sliding_window_view(part, wide).argmin(axis=1))[whole])
    for begin, end in zip((ends - sizes).tolist(), last.tolist(), strict=True):
        if 0 <= end - begin < wide - 1:
            found.append([begin + int(value[begin : end + 1].argmin())])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def scanned(docs: DataFrame, key: str, text: str, width: int, values: int, rows: int, span: int, least: int) -> DataFrame:
    """(kind, k, unit, h1, h2, words, keys, text): in one pass every line that has a word (kind 0; unit: the line's number)
    and every window (kind 1; unit: the words before it). h1 and h2 stand for the words, single-spaced and lowered."""

    def batches(it):
        from xxhash import xxh3_128_digest

        def table(kind, keys, units, digests, words, lists, texts):
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(units), kind, np.int32)), pa.array(keys, pa.int64()), pa.array(units, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), words, lists, texts],
                names=["kind", "k", "unit", "h1", "h2", "words", "keys", "text"],
            )

        for b in it:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                all_, sizes, doc_sizes, keys, units, texts = [], [], [], [], [], []
                docs_ = part.column(0).to_pylist()
                for k, t in zip(docs_, part.column(1), strict=True):
                    before = len(all_)
                    for i, line in enumerate((t.as_py() or "").lower().split("\n")):
                        words = line.encode("utf-8", "replace").split()
                        if words:
                            all_ += words
                            sizes.append(len(words))
                            keys.append(k)
                            units.append(i)
                            texts.append(b" ".join(words))
                    doc_sizes.append(len(all_) - before)
                hashes, sizes = np.fromiter(map(zlib.crc32, all_), np.uint64, len(all_)), np.array(sizes, np.int64)
                ends, lists = signatures(*shingles(hashes, sizes, width), len(sizes), values, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(lists))
                yield table(0, keys, units, [xxh3_128_digest(t) for t in texts], pa.array(sizes), lists, pa.array(texts, pa.binary()).cast(pa.string()))
                doc_sizes = np.array(doc_sizes, np.int64)
                at = window_starts(hashes, doc_sizes, span, least)
                doc = np.searchsorted(np.cumsum(doc_sizes), at, side="right")
                digests = [xxh3_128_digest(b" ".join(all_[i : i + span])) for i in at.tolist()]
                none = pa.nulls(len(at), pa.list_(pa.int64()))
                yield table(1, [docs_[i] for i in doc.tolist()], at - (np.cumsum(doc_sizes) - doc_sizes)[doc], digests, pa.array(np.full(len(at), span)), none, pa.nulls(len(at), pa.string()))

    made = docs.select(F.col(key).cast("long").alias("k"), F.col(text)).mapInArrow(batches, "kind int, k long, unit long, h1 long, h2 long, words long, keys array<long>, text string")
    return materialize(made, "scanned", "zstd", "kind")


def _scan(docs: DataFrame, key: str, text: str, width: int = WIDTH, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL, span: int = SPAN, least: int = LEAST) -> DataFrame:
    return scanned(docs, key, text, width, tune(threshold, rows, recall), rows, span, least)


def _classes(table: DataFrame, key: str, width: int = WIDTH, threshold: float = THRESHOLD, **_) -> DataFrame:
    lines = table.filter("kind = 0").withColumn("unit", F.col("unit").cast("int"))
    found = unit_classes(lines.select("k", "unit", "text", "h1"), lines.drop("text", "kind"), key, lambda t: word_hashes(t, width), threshold, ("words",))
    return found.withColumnsRenamed({"unit": "paragraph", "first_unit": "first_paragraph"})


def paragraph_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(key, paragraph, first_key, first_paragraph, members, words, keep) for every paragraph of docs that has a word.

    how: width, threshold, rows, recall. Paragraphs are the lines of a text, lowered and single-spaced. They are similar if
    the sets of their word shingles (width; a shorter paragraph is one shingle) have a Jaccard of threshold or more,
    verified exactly (by 64-bit hashes) for pairs that meet in a band; signatures are tuned so that pairs at the threshold
    meet with probability recall. Classes are connected components of whole texts' paragraphs, of members paragraphs; the
    smallest (key, paragraph) of each is kept. Null and empty texts have no row. A null key comes last and is returned as
    null. Rows that repeat a key and its paragraph are one, kept or dropped together. Empty tables give empty results;
    other columns aren't read.
    """
    return _classes(_scan(docs, key, text, **how), key, **how)


def _windows(table: DataFrame, key: str) -> DataFrame:
    """See repeated_windows; the windows of table are gone afterwards. Rows may repeat if a key has several texts."""

    def repeated(made: DataFrame, _: int) -> DataFrame:
        place = place_of("k", "at")
        seen = made.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").drop("last")
        found = made.join(seen, ["h1", "h2"]).select("k", "at", *first_place("first", "first_key", "first_at"), (place == F.col("first")).alias("keep"))
        return found.drop("first_at").distinct()

    made = table.filter("kind = 1").select("k", F.col("unit").alias("at"), "h1", "h2")
    found = by_parts(made, "h1", repeated, "repeats").withColumnRenamed("k", key)
    discard(table, part="/kind=1")
    free_shuffles(table.sparkSession)
    return found


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, least: int = LEAST) -> DataFrame:
    """(key, at, first_key, keep): windows of span words that stand in more than one place, at words from their text's
    start, whatever its lines; the smallest (key, at) of equal windows is kept.

    Any passage of least words that two texts share, in lower case and up to white space, holds such a window. Texts of
    fewer than span words have none, as have null and empty ones. A null key comes last. Rows that repeat a key count
    as one text, so a passage that only they share isn't repeated. An empty table gives an empty result. Hot windows are
    added up before they are shuffled.
    """
    return _windows(_scan(docs, key, text, span=span, least=least), key).distinct()


def _covered(spans: DataFrame, span: int, name: str) -> DataFrame:
    """(k, name): words of each text that lie in a span."""
    before = F.max(F.col("at") + span).over(Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("at") + span - F.greatest(F.col("at"), F.coalesce(before, F.lit(0)))
    return spans.withColumn("new", F.greatest(F.lit(0), new)).groupBy("k").agg(F.sum("new").alias(name))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, least: int = LEAST, **how) -> DataFrame:
    """One row for every row of docs: what of it other places repeat, and what goes.

    n_paragraphs, n_repeated (in a class of several), n_removed (all but the first of each class); passage_words and
    removed_words: words in repeated windows, and in those that aren't the first; kept_in: the keys that hold the first copy
    of what goes, ascending; classes: those of its repeated paragraphs and windows, each by the key of its first copy;
    repeated: whether the text has a repeated window, or a repeated paragraph of span words or more.
    Texts without words have zeros. Rows with one key share its figures, those with a null key theirs. See paragraph_classes
    and repeated_windows.
    """
    table = _scan(docs, key, text, span=span, least=least, **how)
    found = _windows(table, key).withColumnRenamed(key, "k")
    classes = _classes(table, key, **how).withColumnRenamed(key, "k")
    again = F.col("members") > 1
    long_ = F.coalesce(F.max(again & (F.col("words") >= span)), F.lit(False)).alias("long")
    in_lines = classes.groupBy("k").agg(F.count(F.lit(1)).alias("n_paragraphs"), F.count_if(again).alias("n_repeated"), F.count_if(~F.col("keep")).alias("n_removed"), long_)
    firsts = found.select("k", "first_key", "keep").union(classes.filter(again).select("k", "first_key", "keep"))
    firsts = firsts.groupBy("k").agg(F.array_sort(F.collect_set(F.when(~F.col("keep"), F.col("first_key")))).alias("kept_in"), F.array_sort(F.collect_set("first_key")).alias("classes"))
    parts = [in_lines, _covered(found, span, "passage_words"), _covered(found.filter(~F.col("keep")), span, "removed_words"), firsts]
    made = docs.select(F.col(key).cast("long").alias("k"))
    for part in parts:
        part = part.withColumnRenamed("k", "of")
        made = made.join(part, made["k"].eqNullSafe(part["of"]), "left").drop("of")
    none = F.array().cast("array<bigint>")
    made = made.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_paragraphs", "n_repeated", "n_removed", "passage_words", "removed_words")} | {c: F.coalesce(c, none) for c in ("kept_in", "classes")})
    repeated = F.coalesce("long", F.lit(False)) | (F.col("passage_words") > 0)
    return made.select(F.col("k").alias(key), "n_paragraphs", "n_repeated", "n_removed", "passage_words", "removed_words", "kept_in", "classes", repeated.alias("repeated"))


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, least: int = LEAST, **how) -> DataFrame:
    """docs with their texts cut down to first copies: paragraphs that aren't kept go, and words in windows that aren't.

    Needs unique keys; rows with a null key share what goes. Words stay apart by what stood before them; texts of which
    nothing goes are untouched. The columns are those of docs.
    """
    table = _scan(docs, key, text, span=span, least=least, **how)
    spans = _windows(table, key).filter(~F.col("keep")).groupBy(key).agg(F.collect_set("at").alias("__spans")).withColumnRenamed(key, "__k1")
    lines = _classes(table, key, **how).filter(~F.col("keep")).groupBy(key).agg(F.collect_set(F.col("paragraph").cast("long")).alias("__lines")).withColumnRenamed(key, "__k2")
    joined = docs.join(spans, docs[key].cast("long").eqNullSafe(F.col("__k1")), "left").join(lines, docs[key].cast("long").eqNullSafe(F.col("__k2")), "left")

    def cuts(texts: pd.Series, at: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([cut_text(*x, span) for x in zip(texts, at, gone, strict=True)], dtype=object)

    cut = F.pandas_udf(cuts, "string")
    some = F.col("__spans").isNotNull() | F.col("__lines").isNotNull()
    return joined.select(*[F.when(some, cut(docs[c], F.col("__spans"), F.col("__lines"))).otherwise(docs[c]).alias(c) if c == text else docs[c] for c in docs.columns])


def cut_text(text: str | None, spans, lines, span: int) -> str | None:
    """text without the given lines and without the span words from each place of spans on."""
    if text is None:
        return None
    starts, gone = set([] if spans is None else spans), set([] if lines is None else lines)
    kept, at, until = [], 0, 0
    for i, line in enumerate(text.split("\n")):
        held, before = [], ""
        for piece in PIECE.findall(line):
            if piece[0] in BLANK:
                before = piece
                continue
            until = at + span if at in starts else until
            if at >= until and i not in gone:
                held.append(before + piece)
            at, before = at + 1, ""
        if i not in gone and (held or not line.strip(BLANK)):
            kept.append("".join(held) + before)
    return "\n".join(kept)


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(read(spark, sf_dir, "documents"))


QUERIES = {"op5_paragraph_dedup": op5_paragraph_dedup}
ORACLE: dict[str, str] = {}
