"""SimHash near-duplicates: byte-position inverted index with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, materialize, table
from .components import components

#: A-Z to a-z on UTF-8 bytes.
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Shingles that are turned into bits at once.
STEP = 1 << 15
#: Distinct fingerprints that meet in one posting list before it is dealt out in blocks.
HOT_LIST = 128
#: Fingerprints in a block of a hot posting list.
BLOCK = 16384


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of a text; 0 where there is no word.

    Words are bytes.split()'s, which are exactly [^\\x20\\x09-\\x0D]+. A text of fewer than width words is one shingle.
    """
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        part = words[at : at + min(STEP, n - at) + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        hashes = np.array([xxh64_intdigest(s, 42) for s in shingles], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp) for every row of docs."""

    def batches(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), width) for t in b.column(1)], pa.int64())], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(batches, f"`{key}` {kind}, fp long")


def _keys(threshold: int) -> list[tuple[int, ...]]:
    """Byte positions of each posting key, such that fingerprints that differ in threshold bits share one at least.

    threshold bits spoil threshold bytes at most, so 8 - threshold of the 8 positions match. Of any 5 positions
    three lie in one half, hence all triples of either half do for 3 bits; fewer bits may use the same keys.
    """
    if not 0 <= threshold <= 3:
        raise ValueError("threshold must be 0 to 3")
    return [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]


def _posting_keys(fp, keys):
    byte = [F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    made = [F.lit(k) + sum((byte[p] * F.lit(1 << (8 + 8 * i)) for i, p in enumerate(ps)), F.lit(0).cast("long")) for k, ps in enumerate(keys)]
    return F.explode(F.array(*[m.cast("long") for m in made]))


def _links_in_block(threshold: int):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(pdf["fp"].to_numpy().view(np.uint64))
        label = np.arange(len(fps))
        rows = max(1, (1 << 22) // max(1, len(fps)))
        moved = True
        while moved:
            moved = False
            for at in range(0, len(fps), rows):
                near = np.bitwise_count(fps[at : at + rows, None] ^ fps[None, :]) <= threshold
                low = np.where(near, label[None, :], len(fps)).min(axis=1)
                if (low < label[at : at + rows]).any():
                    moved = True
                    label[at : at + rows] = np.minimum(label[at : at + rows], low)
            label = label[label]
        linked = label != np.arange(len(fps))
        return pd.DataFrame({"a": fps[linked].view(np.int64), "b": fps[label[linked]].view(np.int64)})

    return links


def fingerprint_links(fps: DataFrame, threshold: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints of threshold differing bits or fewer, enough of them to
    connect all that such links connect.

    fps: distinct fingerprints in column fp. An inverted index posts each fingerprint under positional byte triples;
    a pair that meets is kept if it shares 8 - threshold positional bytes at least, then verified bit by bit.
    Posting lists above HOT_LIST members aren't joined with themselves: they are dealt out in pairs of blocks, each
    compared exactly, which returns a spanning set of links rather than all pairs.
    """
    keys = _keys(threshold)
    posted = materialize(fps.select("fp", _posting_keys(F.col("fp"), keys).alias("key")), "postings")
    sizes = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    listed = materialize(posted.join(sizes, "key"), "lists")
    cold = listed.filter(F.col("n") <= HOT_LIST).select("key", "fp")
    x = F.col("fp").bitwiseXOR(F.col("other"))
    shared = sum(F.when(F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for p in range(8))
    pairs = cold.join(cold.withColumnRenamed("fp", "other"), "key").filter((F.col("fp") < F.col("other")) & (shared >= 8 - threshold) & (F.bit_count(x) <= threshold))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    hot = listed.filter(F.col("n") > HOT_LIST).withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
    hot = hot.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
    near = hot.select("key", "fp", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j")).groupBy("key", "i", "j").applyInPandas(_links_in_block(threshold), "a long, b long")
    return pairs.select(F.col("fp").alias("a"), F.col("other").alias("b")).union(near)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, threshold: int = 3) -> DataFrame:
    """(key, fp, component): every row of docs with its fingerprint and the smallest key reachable over links.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows with a null key belong to the
    component of their fingerprint, and get a null component only if no member has a key. Repeated rows stay.
    An empty table gives an empty result. Only the two named columns are read, so others may have any name.
    """
    prints = materialize(with_fingerprint(docs, key, text, width).withColumnRenamed(key, "k"), "prints")
    distinct = prints.groupBy("fp").agg(F.min("k").alias("first"))
    roots = components(fingerprint_links(distinct, threshold)).withColumnRenamed("node", "fp")
    rooted = materialize(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(least, "root").select("fp", "component")
    found = materialize(prints.join(named, "fp").select(F.col("k").alias(key), "fp", "component"), "components")
    discard(prints, rooted)
    return found


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = 3) -> DataFrame:
    """The rows of docs whose key is the smallest of their group; the columns are those of docs.

    Needs unique keys; rows with a null key are kept, as they can't be told apart.
    """
    drop = near_duplicates(docs, key, text, threshold=threshold).filter(F.col(key) != F.col("component")).select(F.col(key).alias("__dropped"))
    return docs.join(drop, docs[key] == drop["__dropped"], "left_anti")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op3_simhash": op3_simhash}
ORACLE: dict[str, str] = {}
