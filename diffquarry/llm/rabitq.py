"""Approximate nearest neighbours: randomly rotated one-bit codes with error bounds, then exact reranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, table

#: Codes in a block, and queries in a block.
BLOCK, QUERY_BLOCK = 32768, 256
#: Bits of a code at least; vectors of fewer dimensions are rotated several times.
BITS = 512
#: Bits to which a query's rotated components are rounded, and their places.
PLANES = 6
#: Queries' vectors are sent to all executors up to this many numbers; beyond, they are joined.
BROADCAST_NUMBERS = 1 << 21


def rotations(dim: int, seed: int, bits: int = BITS) -> np.ndarray:
    """Random orthogonal matrices one below the other, bits rows at least; the same for a seed on every executor."""
    rnd, made = np.random.default_rng(seed), []
    for _ in range(max(1, -(-bits // dim))):
        q, r = np.linalg.qr(rnd.standard_normal((dim, dim)))
        made.append(q * np.sign(np.diag(r)))
    return np.vstack(made)


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words, filled up with zeros."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, correction): the signs of each rotated unit vector as 64-bit words, and its inner product with its own code.

    The code of x is sign(Px) / sqrt(bits), a unit vector; the correction <code, Px> is near 0.8 for any x, where P is the
    rotations over the root of their number.
    """
    size = len(turn)
    turned = unit @ turn.T
    return _words(turned > 0), np.abs(turned).sum(axis=1) / np.sqrt(size) / np.sqrt(size / unit.shape[1])


def rounded(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(planes, low, step, total) of rotated queries: their components are low + step * n, and planes holds the bits of n."""
    turned = unit @ turn.T / np.sqrt(len(turn) / unit.shape[1])
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / (2**PLANES - 1), 1e-300)
    n = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    planes = np.stack([_words(n >> b & 1) for b in range(PLANES)], axis=1)
    return planes, low, step, low * turned.shape[1] + step * n.sum(axis=1, dtype=np.int64)


def estimates(codes: np.ndarray, correction: np.ndarray, plane: np.ndarray, low: float, step: float, total: float, size: int) -> np.ndarray:
    """Of one query's inner products with the coded vectors, from packed bits and the correction alone."""
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    counts = sum(np.bitwise_count(codes & p).sum(axis=1, dtype=np.int64) << b for b, p in enumerate(plane))
    return (2 * (low * ones + step * counts) - total) / np.sqrt(size) / correction


def bounds(correction: np.ndarray, step: float, size: int, eps: float) -> np.ndarray:
    """How far an estimate may be off: more only with a chance that falls as exp(-eps^2 / 2)."""
    c2 = np.square(correction)
    return eps * np.sqrt(np.maximum(0.0, 1 - c2) / c2 / max(1, size - 1) + step * step / 12 / c2)


def _usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & good & F.exists(vector, lambda x: x != 0)


def _by_dimension(pdfs, size: int):
    """(dim, rids, vectors as rows of one length 1): each partition fills its own blocks of up to size rows."""
    held: dict[int, tuple[list, list]] = {}

    def made(dim):
        rids, rows = held.pop(dim)
        x = np.array(rows, float).reshape(len(rows), dim)
        x /= np.abs(x).max(axis=1, keepdims=True)
        return dim, np.array(rids, "<i8"), x / np.sqrt(np.square(x).sum(axis=1))[:, None]

    for pdf in pdfs:
        for i, v in zip(pdf["rid"], pdf["v"], strict=True):
            rids, rows = held.setdefault(len(v), ([], []))
            rids.append(i)
            rows.append(v)
            if len(rids) == size:
                yield made(len(v))
    for dim in list(held):
        yield made(dim)


def coded(rows: DataFrame, seed: int, block: int) -> DataFrame:
    """(dim, rids, codes, corrections): blocks of rows (rid, v); an eighth of a byte for each bit, no vectors."""

    def pack(pdfs):
        for dim, rids, unit in _by_dimension(pdfs, block):
            codes, c = encode(unit, rotations(dim, seed))
            yield pd.DataFrame({"dim": [dim], "rids": [rids.tobytes()], "codes": [codes.tobytes()], "corrections": [c.astype("<f4").tobytes()]})

    return rows.select("rid", "v").mapInPandas(pack, "dim int, rids binary, codes binary, corrections binary")


def asked(rows: DataFrame, seed: int, block: int) -> DataFrame:
    """(q_dim, q_rids, planes, scales): blocks of rotated and rounded queries."""

    def pack(pdfs):
        for dim, rids, unit in _by_dimension(pdfs, block):
            planes, *scales = rounded(unit, rotations(dim, seed))
            yield pd.DataFrame({"q_dim": [dim], "q_rids": [rids.tobytes()], "planes": [planes.tobytes()], "scales": [np.stack(scales, axis=1).tobytes()]})

    return rows.select("rid", "v").mapInPandas(pack, "q_dim int, q_rids binary, planes binary, scales binary")


def chosen(codes: DataFrame, queries: DataFrame, k: int, eps: float, seed: int) -> DataFrame:
    """(q, rid): for each query the vectors whose upper bound reaches the k-th largest lower bound, however many they are, and
    itself.

    A block gives the rows that its own k-th largest lower bound leaves, its k best among them, from which that of all
    blocks is found. Queries are a stated set that meets all codes, in blocks.
    """

    def scan(pdfs):
        for pdf in pdfs:
            for r in pdf.itertuples():
                if r.dim != r.q_dim:
                    continue
                size = len(rotations(r.dim, seed))
                rids, q_rids, c = np.frombuffer(r.rids, "<i8"), np.frombuffer(r.q_rids, "<i8"), np.frombuffer(r.corrections, "<f4").astype(float)
                codes_, planes = np.frombuffer(r.codes, np.uint64).reshape(len(rids), -1), np.frombuffer(r.planes, np.uint64).reshape(len(q_rids), PLANES, -1)
                for q, plane, scale in zip(q_rids, planes, np.frombuffer(r.scales, "<f8").reshape(-1, 3), strict=True):
                    about, off = estimates(codes_, c, plane, *scale, size), bounds(c, scale[1], size, eps)
                    low, up = np.where(rids == q, -np.inf, about - off), about + off
                    floor = np.partition(low, -k)[-k] if len(low) > k else -np.inf
                    near = np.flatnonzero((up >= floor) & (rids != q))
                    yield pd.DataFrame({"q": q, "rid": rids[near], "low": low[near], "up": up[near]})

    met = materialize(codes.crossJoin(queries).mapInPandas(scan, "q long, rid long, low double, up double"), "bounds")
    ranked = met.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))).filter(F.col("n") <= k)
    floors = ranked.groupBy("q").agg(F.when(F.count(F.lit(1)) == k, F.min("low")).otherwise(F.lit(float("-inf"))).alias("least"))
    own = queries.mapInPandas(lambda pdfs: (pd.DataFrame({"q": np.frombuffer(x, "<i8"), "rid": np.frombuffer(x, "<i8")}) for pdf in pdfs for x in pdf["q_rids"]), "q long, rid long")
    return met.join(floors, "q").filter("up >= least").select("q", "rid").union(own)


def _cosines(pdfs):
    for pdf in pdfs:
        if len(pdf):
            made = []
            for x, y in zip(pdf["v"], pdf["q_v"], strict=True):
                x, y = np.asarray(x, float), np.asarray(y, float)
                made.append((x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum()))
            yield pd.DataFrame({"q": pdf["q"], "rid": pdf["rid"], "least": pdf["least"], "score": made})


def nearest(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, eps: float = 2.0, seed: int = 11, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that queries marks its k nearest other rows by cosine.

    Nearest first, ties to the smaller id. Rows whose vector is null, zero, or holds null or non-finite components take
    no part, nor do rows with a null id; vectors meet those of their own dimension only. Rows that share an id each count,
    as candidates of each other too, and each marked row has its own ranks. Fewer candidates than k: all. An empty table
    gives an empty result. Only codes, corrections and rounded queries are scanned; the vectors of chosen rows alone are
    fetched for the exact scores.
    Equal vectors are coded and asked once, however many rows have them; of those rows the k + 1 with the smallest ids can be
    neighbours. So a vector that a third of all rows share costs as much as any other.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = rows.filter(F.col("vec_id").isNotNull() & _usable(F.col("v"))).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), F.col("v"))})
    rows = materialize(rows, "vectors")
    same = Window.partitionBy("h1", "h2").orderBy("vec_id", "rid")
    first = materialize(rows.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).select("rid", "vec_id", "v", "h1", "h2", "n"), "firsts")
    distinct = first.filter("n = 1").select("rid", "vec_id", "v", "h1", "h2")
    named = distinct.select("h1", "h2", F.col("rid").alias("g"))
    wanted = materialize(rows.filter("asked").select("rid", "vec_id", "h1", "h2").join(named, ["h1", "h2"]).select(F.col("rid").alias("own"), F.col("vec_id").alias("query_id"), F.col("g").alias("q")), "asked")
    parts = max(1, -(-distinct.count() // block))
    codes = materialize(coded(distinct.repartition(parts), seed, block), "codes")
    own = distinct.join(wanted.select(F.col("q").alias("rid")).distinct(), "rid", "left_semi")
    few = max(1, -(-own.count() // query_block))
    blocks = materialize(asked(own.repartition(few), seed, query_block), "queries")
    near = materialize(chosen(codes, blocks, k, eps, seed), "chosen")
    own = own.select(F.col("rid").alias("q"), F.col("v").alias("q_v"))
    numbers = own.agg(F.sum(F.size("q_v"))).first()[0] or 0
    met = near.join(distinct.select("rid", F.col("vec_id").alias("least"), "v"), "rid").join(F.broadcast(own) if numbers <= BROADCAST_NUMBERS else own, "q")
    scored = met.mapInPandas(_cosines, "q long, rid long, least long, score double")

    def best(pairs, by, order, most):
        return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), *order))).filter(F.col("rank") <= most)

    members = first.join(named, ["h1", "h2"]).select(F.col("g").alias("rid"), F.col("rid").alias("row"), "vec_id")
    held = best(scored, "q", ["least"], k + 1).drop("rank").join(members, "rid").select("q", "row", "vec_id", "score")
    found = wanted.join(best(held, "q", ["vec_id", "row"], k + 1).drop("rank"), "q").filter("row <> own")
    made = materialize(best(found, "own", ["vec_id", "row"], k).select("query_id", "rank", "vec_id", "score"), "nearest")
    discard(rows, first, wanted, codes, blocks, near)
    return made


def op4_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: The search over all vectors; recall is 1 where the tables are small, and measured at 50,000 vectors (README).
ORACLE: dict[str, str] = {}
QUERIES = {"op4_rabitq": op4_rabitq}
