"""Language-model scores by prediction by partial matching: byte contexts over whole texts, escapes, exclusion, update exclusion.

text_scores is what the query runs. code_lengths, a mixture of words by class with a trie for new words, is kept beside it.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, materialize, table

#: Bytes of context at most; with the next byte and the order they fill a 64-bit key.
ORDER = 6
#: Entries (context, byte) of the trie that executors hold, the most frequent ones; all others are joined.
ENTRIES = 1_000_000
#: Most frequent words whose counts and code lengths executors hold; all others are joined.
HEAD = 1 << 16
#: Classes of texts with counts of their own, besides one for all others.
MOST_CLASSES = 6
#: Bytes of context at most over whole texts, across words; entries that executors hold; bytes that are looked at at once.
TEXT_ORDER, TEXT_ENTRIES, PIECE = 5, 1 << 21, 1 << 20
#: Longest contexts that are counted together before they are sent on.
COUNTED = 1 << 23
#: The byte before and after a text, which no word holds.
TEXT_EDGE = 10
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())



def split_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def is_held_out(key) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % 10 == 0


def symbol_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes to predict: (word number, position from 1, the word between two edges as one flat array of symbols)."""
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    flat = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8) if words else np.zeros(0, np.uint8)
    ends = np.cumsum(sizes)
    number = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(flat)) - (ends - sizes)[number]
    return number, place, flat


def contexts(place: np.ndarray, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order k: the positions that have k bytes before them, and those k bytes tagged with k."""
    made, key, at = [], np.zeros(len(flat), np.uint64), np.flatnonzero(place > 0)
    for k in range(ORDER + 1):
        at = at[place[at] >= k]
        if k:
            key = key.copy()
            key[at] |= flat[at - k].astype(np.uint64) << np.uint64(8 * (k - 1))
        made.append((at, key[at] | np.uint64(k << 48)))
    return made


class Trie:
    """Counts of bytes after contexts of 0 to ORDER bytes, all within one word.

    Escape method D: a byte seen c times in a context of n has (c - 1/2) / n, an escape the rest. Bytes seen in a longer
    context are excluded from shorter ones, which their counts leave. This form is held in memory, for small tries and
    as what word_codes must equal.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.__setstate__((keys, counts))

    def __getstate__(self):
        return self.given

    def __setstate__(self, given):
        self.given, self.ready = given, False

    def _prepare(self) -> None:
        keys, counts = self.given
        by = np.argsort(keys)
        self.keys, self.counts = keys[by], counts[by].astype(np.float64)
        context = self.keys >> np.uint64(8)
        self.contexts, first = np.unique(context, return_index=True)
        owner = np.repeat(np.arange(len(self.contexts)), np.diff(np.append(first, len(context))))
        k = context >> np.uint64(48)
        low = np.uint64(8) * (np.maximum(k, np.uint64(1)) - np.uint64(1))
        parent = (((k - np.uint64(1)) << np.uint64(48)) | (context & ((np.uint64(1) << low) - np.uint64(1)))) << np.uint64(8) | (self.keys & np.uint64(255))
        there, at = self._find(self.keys, parent)
        below = np.where((k > 0) & there, self.counts[at] if len(self.counts) else 0.0, 0.0)
        n = len(self.contexts)
        self.total = np.bincount(owner, self.counts, n)
        self.kinds = np.bincount(owner, minlength=n).astype(np.float64)
        self.excluded, self.ready = np.bincount(owner, below, n), True

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, at

    def code(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word and the edge after it, given the edge before it."""
        if not self.ready:
            self._prepare()
        number, place, flat = symbol_rows(words)
        logp = np.zeros(len(flat))
        open_ = place > 0
        excluded, without = np.zeros(len(flat)), np.zeros(len(flat))
        for at, key in reversed(contexts(place, flat)):
            use = open_[at]
            at, key = at[use], key[use]
            known, c = self._find(self.contexts, key)
            at, key, c = at[known], key[known], c[known]
            if not len(at):
                continue
            total, kinds = self.total[c] - excluded[at], self.kinds[c] - without[at]
            seen, e = self._find(self.keys, (key << np.uint64(8)) | flat[at].astype(np.uint64))
            fresh = kinds > 0.5
            with np.errstate(divide="ignore", invalid="ignore"):
                logp[at] += np.where(seen, np.log10((self.counts[e] - 0.5) / total), np.where(fresh, np.log10(kinds / 2 / total), 0.0))
            open_[at[seen]] = False
            excluded[at], without[at] = self.excluded[c], self.kinds[c]
        logp[open_] -= np.log10(256 - without[open_])
        return np.bincount(number, logp, len(words))


def entries(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trie entries of distinct words, each counted once: update exclusion, as a word's repeats are told by itself."""
    _, place, flat = symbol_rows(words)
    keys = [(key << np.uint64(8)) | flat[at].astype(np.uint64) for at, key in contexts(place, flat)]
    keys, counts = np.unique(np.concatenate(keys), return_counts=True)
    return keys, counts.astype(np.int64)


def vocabulary(docs: DataFrame, key: str, text: str, group: str | None, classes: list) -> DataFrame:
    """(word, n0, n1, ...): every word of docs with its counts in rows of each class that aren't held out.

    The null word counts such rows. Rows of other groups than classes names fall into a last class.
    """
    at_class = {g: z for z, g in enumerate(classes)}
    n_classes = len(classes) + 1

    def batches(it):
        counts: Counter = Counter()

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array([w for w, _ in counts], pa.binary()), pa.array([z for _, z in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["word", "z", "n"])
            counts.clear()
            return made

        for b in it:
            for k, t, g in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                z = at_class.get(g, n_classes - 1)
                if is_held_out(k):
                    for w in set(split_words(t.as_py())):
                        counts[w, z] += 0
                else:
                    counts[None, z] += 1
                    for w, m in Counter(split_words(t.as_py())).items():
                        counts[w, z] += m
                if len(counts) > 400_000:
                    yield flush()
        yield flush()

    by = F.col(group) if group else F.lit(None).cast("string")
    made = docs.select(F.col(key), F.col(text), by.alias("__g")).mapInArrow(batches, "word binary, z int, n long")
    return made.groupBy("word").agg(*[F.sum(F.when(F.col("z") == z, F.col("n")).otherwise(0)).alias(f"n{z}") for z in range(n_classes)])


def longest_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, key of the entry under the longest context) of all bytes to predict."""
    number, place, flat = symbol_rows(words)
    keys = np.zeros(len(flat), np.uint64)
    for at, key in contexts(place, flat):
        keys[at] = (key << np.uint64(8)) | flat[at].astype(np.uint64)
    return number[place > 0], keys[place > 0]


def _order(key: str) -> Column:
    return F.shiftright(key, 56).cast("int")


def _shorter(key: str, k: Column) -> Column:
    """The entry of the same byte under the last k bytes of its context."""
    held = F.shiftright(key, 8).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), 8 * k) - 1)
    return F.call_function("shiftleft", k.cast("long"), F.lit(56)).bitwiseOR(F.call_function("shiftleft", held, F.lit(8))).bitwiseOR(F.col(key).bitwiseAND(F.lit(255).cast("long")))


def train(words: DataFrame) -> DataFrame:
    """(key, n, context, total, kinds, excluded): all entries of the trie of the distinct training words, with the sums of
    their contexts."""

    def batches(it):
        for b in it:
            keys, counts = entries(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])

    made = words.filter("word is not null and n > 0").select("word").mapInArrow(batches, "key long, n long")
    return _sums(materialize(made.groupBy("key").agg(F.sum("n").alias("n")), "trie"))


def _sums(made: DataFrame) -> DataFrame:
    """Entries (key, n) with context and its sums: total, kinds, and excluded, the counts of its bytes in the next shorter one."""
    shorter = F.when(_order("key") > 0, _shorter("key", F.greatest(_order("key") - 1, F.lit(0))))
    below = made.select(F.col("key").alias("parent"), F.col("n").alias("below"))
    held = made.withColumn("parent", shorter).join(below, "parent", "left").withColumn("context", F.shiftright("key", 8))
    of = Window.partitionBy("context")
    sums = {"total": F.sum("n").over(of), "kinds": F.count(F.lit(1)).over(of), "excluded": F.sum(F.coalesce("below", F.lit(0))).over(of)}
    return materialize(held.withColumns(sums).select("key", "n", "context", *sums), "sums")


def _escapes(asked: DataFrame, trie: DataFrame) -> DataFrame:
    """(key, code) of entries (key) that aren't in the trie but have known contexts: escapes down to the byte."""
    rows = asked.select("key", F.explode(F.sequence(F.lit(0), _order("key"))).alias("k"))
    rows = rows.withColumn("entry", _shorter("key", F.col("k"))).withColumn("context", F.shiftright("entry", 8))

    def met(rows, trie, send):
        of = trie.groupBy("context").agg(*[F.max(c).cast("double").alias(c) for c in ("total", "kinds", "excluded")])
        seen = trie.select(F.col("key").alias("entry"), "n")
        return rows.join(send(of), "context").join(send(seen), "entry", "left").select("key", "k", "total", "kinds", "excluded", "n")

    # Orders 0 and 1 have 257 contexts at most, which all rows ask for: sent out rather than joined on hot keys.
    low = met(rows.filter("k < 2"), trie.filter(_order("key") < 2), F.broadcast)
    both = low.union(met(rows.filter("k >= 2"), trie.filter(_order("key") >= 2), lambda t: t))
    path = both.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "total", "kinds", "excluded", "n"))).alias("path"))
    state = lambda code, excluded, without, done: F.struct(code.alias("code"), excluded.alias("excluded"), without.alias("without"), done.alias("done"))

    def step(s, r):
        total, kinds, seen = r["total"] - s["excluded"], r["kinds"] - s["without"], r["n"].isNotNull()
        more = F.when(s["done"], 0.0).when(seen, F.log10((r["n"] - 0.5) / total)).when(kinds > 0.5, F.log10(kinds / 2 / total)).otherwise(0.0)
        return state(s["code"] + more, r["excluded"], r["kinds"], s["done"] | seen)

    start = state(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(False))
    return path.select("key", F.aggregate("path", start, step, lambda s: F.when(s["done"], s["code"]).otherwise(s["code"] - F.log10(256 - s["without"]))).alias("code"))


def _head(trie: DataFrame, order: int, first: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, codes, counts), by key, of up to most entries, the most frequent ones, under contexts that aren't shorter than
    need be: those of order bytes, and those that begin with first."""
    k = _order("key")
    edge = F.expr(f"shiftright(shiftright(key, 8) & 281474976710655, 8 * (greatest(cast(shiftright(key, 56) as int), 1) - 1)) = {first}")
    longest = trie.filter((k == order) | ((k > 0) & edge))
    steps = [1 << i for i in range(40)]
    sizes = longest.agg(*[F.count_if(F.col("n") >= s).alias(str(s)) for s in steps]).first()
    least = next(s for s in steps if sizes[str(s)] <= most)
    got = longest.filter(F.col("n") >= least).select("key", _code().alias("code"), "n").toArrow()  # most rows of three numbers
    keys, by = got["key"].to_numpy().view(np.uint64), np.argsort(got["key"].to_numpy())
    return keys[by], got["code"].to_numpy()[by], got["n"].to_numpy()[by]


def _code() -> Column:
    """log10 probability of an entry under a longest context."""
    return F.log10((F.col("n") - 0.5) / F.col("total"))


def _joined(rare: DataFrame, trie: DataFrame) -> DataFrame:
    """(rid, more): the sums of m times the code by the whole trie of entries (rid, key, m) under longest contexts."""
    rare = rare.join(trie.select("key", _code().alias("more")), "key", "left")
    rare = materialize(rare.select("rid", "m", F.when(F.col("more").isNull(), F.col("key")).alias("key"), "more"), "rare")
    escaped = rare.filter("key is not null").select("rid", "m", "key")
    codes = _escapes(escaped.select("key").distinct(), trie)
    none = F.lit(-math.log10(256))
    escaped = escaped.join(codes, "key", "left").select("rid", "m", F.coalesce("code", none).alias("more"))
    return rare.filter("key is null").select("rid", "m", "more").union(escaped).groupBy("rid").agg(F.sum(F.col("m") * F.col("more")).alias("more"))


def word_codes(words: DataFrame, trie: DataFrame, most: int | None = None) -> DataFrame:
    """words (word, ...) with code: log10 probability by the whole trie of each word and its end.

    A byte that the trie holds under its longest context needs that entry only; executors hold up to most of those
    entries, the most frequent ones, and the others are joined. Bytes that must escape are joined with all their contexts.
    """
    spark, columns = words.sparkSession, words.columns
    keys, codes, _ = _head(trie, ORDER, 32, ENTRIES if most is None else most)
    head = spark.sparkContext.broadcast((keys, codes))

    def coded(it):
        from pyspark import TaskContext

        row, (known_keys, known_codes) = TaskContext.get().partitionId() << 40, head.value
        for b in it:
            number, wanted = longest_keys(b.column("word").to_pylist())
            known, at = Trie._find(known_keys, wanted)
            code = np.bincount(number[known], known_codes[at[known]], b.num_rows)
            rare, rid = wanted[~known].view(np.int64), row + np.arange(b.num_rows)
            row += b.num_rows
            more = [pa.concat_arrays([c, pa.nulls(len(rare), c.type)]) for c in b.columns]
            made = [pa.array(np.concatenate([rid, rid[number[~known]]])), *more, pa.array(np.append(code, np.zeros(len(rare)))), pa.concat_arrays([pa.nulls(b.num_rows, pa.int64()), pa.array(rare)])]
            yield pa.RecordBatch.from_arrays(made, names=["rid", *b.schema.names, "code", "key"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    both = materialize(words.mapInArrow(coded, f"rid long, {fields}, code double, key long"), "coded")
    sums = _joined(both.filter("key is not null").select("rid", "key", F.lit(1).alias("m")), trie)
    whole = both.filter("key is null").join(sums, "rid", "left")
    return whole.select(*columns, (F.col("code") + F.coalesce("more", F.lit(0.0))).alias("code"))


def code_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text", group: str | None = "lang") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Rows whose crc32(key as text) mod 10 is 0 are held out and teach nothing; null keys aren't held out. Tokens are a
    row's words and one end. base_score: add-0.1 smoothed token counts, as log10.

    score: log10 probability of the words between single blanks. The longest context of a byte is all of its word so
    far within texts of one class: a word that the class has c times among n has (c - 1/2) / n there, and what is left
    is the escape to the byte trie of shorter contexts, learnt from all classes, from which the class's own words are
    excluded. A text's probability is the mean over classes by their share of training rows, so the class of the text
    scored is never an input. Classes: the MOST_CLASSES most frequent values of group, all others together.

    Null and empty texts are one end. Repeated rows count and score each for themselves. An empty table gives an
    empty result; without training rows every byte is as likely and an end as likely as a word.
    Executors hold the ENTRIES most frequent entries of the trie and the HEAD most frequent words; other entries and other
    words of a row are joined with the whole trie and vocabulary, so memory doesn't grow with the corpus, and nothing is
    left out.
    """
    spark = docs.sparkSession
    classes = [r[0] for r in docs.groupBy(group).count().orderBy(F.desc("count"), group).limit(MOST_CLASSES).collect()] if group else []
    names = [f"n{z}" for z in range(len(classes) + 1)]
    counted = materialize(vocabulary(docs, key, text, group, classes).withColumn("n", sum(map(F.col, names))), "counts")
    word = F.col("word").isNotNull()
    sums = counted.agg(*[f(c).alias(f"{i}{c}") for c in [*names, "n"] for i, f in (("w", lambda c: F.sum(F.when(word, F.col(c)))), ("k", lambda c: F.count_if(word & (F.col(c) > 0))), ("e", lambda c: F.sum(F.when(~word, F.col(c)))))]).first()
    n_words, kinds, ends = sums["wn"] or 0, sums["kn"] or 0, sums["en"] or 0
    tokens, kinds = n_words + ends, kinds + (ends > 0)
    smooth = tokens + 0.1 * (kinds + 1)

    plain = materialize(word_codes(counted.filter(word), train(counted)), "codes")
    taken = plain.agg(*[F.sum(F.when(F.col(c) > 0, F.pow(F.lit(10.0), "code"))).alias(c) for c in names]).first()
    shares, end_codes, codes = [], [], []
    for c in names:
        w, k, e = sums[f"w{c}"] or 0, sums[f"k{c}"] or 0, sums[f"e{c}"] or 0
        shares.append(e / ends if ends else 1 / len(names))
        more, end = (math.log10(w / (w + e)) if w else 0.0, math.log10(e / (w + e))) if e else (math.log10(0.5), math.log10(0.5))
        escape = math.log10(k / 2 / w) - math.log10(max(1e-9, 1 - (taken[c] or 0))) if w else 0.0
        end_codes.append(end)
        codes.append((more + F.when(F.col(c) > 0, F.log10((F.col(c) - 0.5) / F.lit(float(w or 1)))).otherwise(F.col("code") + escape)).alias(f"z{c}"))
    scores = [f"z{c}" for c in names]
    known = plain.select("word", "n", *codes)
    top = known.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()  # HEAD rows
    index = {w: i for i, w in enumerate(top["word"].to_pylist())}
    n_of, codes_of = top["n"].to_numpy().astype(float), np.array([top[c].to_numpy() for c in scores], float).T.reshape(-1, len(names))
    head = spark.sparkContext.broadcast((index, np.vstack([n_of > 0, np.log10((n_of + 0.1) / smooth), codes_of.T]).T if top.num_rows else np.zeros((0, 2 + len(names)))))
    kind = docs.schema[key].dataType.simpleString()
    at_end = [float(ends > 0), math.log10((ends + 0.1) / smooth), *end_codes]
    columns = ["n_known", "base_score", *scores]

    def scored(it):
        from pyspark import TaskContext

        row, (index, of) = TaskContext.get().partitionId() << 40, head.value
        get = index.get
        for b in it:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                rid, words, n, sizes, held, sums = [], [], [], [], [], []
                for k, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    counts = Counter(split_words(t.as_py()))
                    hits, times = [], []
                    for w, m in counts.items():
                        if (i := get(w)) is None:
                            rid.append(row)
                            words.append(w)
                            n.append(m)
                        else:
                            hits.append(i)
                            times.append(m)
                    sums.append((np.array(times, float) @ of[hits] if hits else np.zeros(of.shape[1])) + at_end)
                    sizes.append(counts.total() + 1)
                    held.append(is_held_out(k))
                    row += 1
                none, rows, sums = [None] * len(rid), [None] * len(sizes), np.array(sums)
                made = {
                    "rid": pa.array(rid + list(range(row - len(sizes), row)), pa.int64()), "word": pa.array(words + rows, pa.binary()), "m": pa.array(n + rows, pa.int64()),
                    "key": pa.concat_arrays([pa.nulls(len(rid), part.column(0).type), part.column(0)]), "held_out": pa.array(none + held, pa.bool_()), "n_tokens": pa.array(none + sizes, pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(made | {c: pa.array(none + sums[:, i].tolist(), pa.float64()) for i, c in enumerate(columns)})

    both = docs.select(F.col(key), F.col(text)).mapInArrow(scored, f"rid long, word binary, m long, key {kind}, held_out boolean, n_tokens long, " + ", ".join(f"{c} double" for c in columns))
    both = materialize(both, "parts")
    rest = both.filter(word).select("rid", "word", "m").join(known, "word")
    more = [F.when(F.col("n") > 0, 1.0).otherwise(0.0), F.log10((F.col("n") + 0.1) / smooth), *map(F.col, scores)]
    rest = rest.groupBy("rid").agg(*[F.sum(F.col("m") * x).alias(f"more_{c}") for c, x in zip(columns, more, strict=True)])
    whole = both.filter(~word).drop("word", "m").join(rest, "rid", "left")
    whole = whole.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0.0)) for c in columns})
    usable = [(c, math.log10(p)) for c, p in zip(scores, shares, strict=True) if p > 0]
    terms = [F.col(c) + p for c, p in usable]
    best = F.greatest(*terms) if len(terms) > 1 else terms[0]
    score = best + F.log10(sum((F.pow(F.lit(10.0), t - best) for t in terms), F.lit(0.0)))
    return whole.select(F.col("key").alias(key), "held_out", "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), "base_score", score.alias("score"))


def joined_words(words: list[bytes]) -> bytes:
    """What is predicted of a text: its words with single blanks, between two edges."""
    return b"\n" + b" ".join(words) + b"\n"


def pieces(text: bytes) -> Iterator[tuple[bytes, int, bool]]:
    """(bytes, how many at their start are context only, whether they begin the text): a text in parts of PIECE bytes."""
    for at in range(0, len(text), PIECE):
        yield text[max(0, at - TEXT_ORDER) : at + PIECE], min(at, TEXT_ORDER) or 1, at <= TEXT_ORDER


def piece_keys(parts: list[tuple[bytes, int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the part, key of the entry under the longest context) of all bytes to predict.

    The longest context is the TEXT_ORDER bytes before, across words; at the start of a text, all that is before.
    """
    sizes, skipped, starts = (np.array([f(p) for p in parts], np.int64) for f in (lambda p: len(p[0]), lambda p: p[1], lambda p: p[2]))
    flat = np.frombuffer(bytes(TEXT_ORDER) + b"".join([p[0] for p in parts]), np.uint8)
    n = len(flat) - TEXT_ORDER
    keys = np.zeros(n, np.uint64)
    for k in range(TEXT_ORDER, -1, -1):
        np.left_shift(keys, np.uint64(8), out=keys)
        keys |= flat[TEXT_ORDER - k : TEXT_ORDER - k + n]
    keys |= np.uint64(TEXT_ORDER << 56)
    first, keep = np.cumsum(sizes) - sizes, np.ones(n, bool)
    for p in range(TEXT_ORDER):
        at = first[(starts > 0) & (sizes > p)] + p
        keys[at] = (keys[at] & np.uint64((1 << 8 * (p + 1)) - 1)) | np.uint64(p << 56)
        keep[first[skipped > p] + p] = False
    return np.repeat(np.arange(len(parts)), sizes - skipped), keys[keep]


def train_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The trie, see _sums, of the texts that aren't held out, with contexts of 0 to TEXT_ORDER bytes across words.

    Every byte of every text counts under its longest context. Update exclusion: under a shorter one it counts only where
    it is new under the next longer one, so once for each longer context that it follows.
    """

    def batches(it):
        made, size = [], 0

        def flush():
            keys = np.concatenate([np.zeros(0, np.uint64), *made])
            keys.sort()
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(np.diff(np.append(first, len(keys))))], names=["key", "n"])

        for b in it:
            parts, held = [], 0
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if is_held_out(k):
                    continue
                for part in pieces(joined_words(split_words(t.as_py()))):
                    parts.append(part)
                    held += len(part[0])
                    if held >= PIECE:
                        made.append(piece_keys(parts)[1])
                        size, parts, held = size + held, [], 0
                if size >= COUNTED:
                    yield flush()
                    size = 0
            if parts:
                made.append(piece_keys(parts)[1])
                size += held
        yield flush()

    counted = docs.select(F.col(key), F.col(text)).mapInArrow(batches, "key long, n long")
    counted = materialize(counted.groupBy("key").agg(F.sum("n").alias("n")), "longest")
    trie = longer = counted.filter(_order("key") == TEXT_ORDER)
    for k in range(TEXT_ORDER - 1, -1, -1):
        new = longer.select(_shorter("key", F.lit(k)).alias("key"), F.lit(1).cast("long").alias("n"))
        longer = materialize(counted.filter(_order("key") == k).union(new).groupBy("key").agg(F.sum("n").alias("n")), "order")
        trie = trie.union(longer)
    return _sums(trie)


def hash_tables(keys: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(multiplier, shift, table): where a key may stand in keys. A key that loses its slot to a more frequent one goes to
    the next table; what has no slot in the last isn't found, and is joined as a rare one."""
    made, left, bits = [], np.argsort(counts, kind="stable").astype(np.int32), max(4, (2 * len(keys)).bit_length())
    for by in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93):
        at = (keys[left] * np.uint64(by)) >> np.uint64(64 - bits)
        slots = np.zeros(1 << bits, np.int32)
        slots[at] = left
        made.append((by, 64 - bits, slots))
        left = left[slots[at] != left]
        bits = max(4, bits - 1)
    return made


def look_up(keys: np.ndarray, tables: list[tuple[int, int, np.ndarray]], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of wanted is found, and where in keys."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int32)
    by, shift, slots = tables[0]
    at = slots[(wanted * np.uint64(by)) >> np.uint64(shift)]
    found = keys[at] == wanted
    for by, shift, slots in tables[1:]:
        rest = np.flatnonzero(~found)
        at[rest] = slots[(wanted[rest] * np.uint64(by)) >> np.uint64(shift)]
        found[rest] = keys[at[rest]] == wanted[rest]
    return found, at


def text_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int | None = None) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Rows whose crc32(key as text) mod 10 is 0 are held out and teach nothing; null keys aren't held out. Tokens are a
    row's words and one end. base_score: add-0.1 smoothed token counts, as log10.

    score: log10 probability of all bytes of the words, with single blanks, and of the end. Each byte is predicted from the
    TEXT_ORDER bytes before it, across words: a byte seen c times in a context of n has (c - 1/2) / n (escape method D), an
    escape to the next shorter context the rest; bytes seen in a longer context are excluded from shorter ones, which
    count by update exclusion; below the empty context all bytes left are as likely.

    Null and empty texts are one end. Repeated rows count and score each for themselves. An empty table gives an empty
    result; without training rows every byte is as likely. Executors hold up to most entries of the trie (TEXT_ENTRIES),
    the most frequent ones, and the HEAD most frequent words; other entries and words of a row are joined with the whole trie
    and vocabulary, so memory doesn't grow with the corpus or with a text, and nothing is left out.
    """
    spark = docs.sparkSession
    counted = materialize(vocabulary(docs, key, text, None, []).withColumnRenamed("n0", "n"), "counts")
    word = F.col("word").isNotNull()
    sums = counted.agg(F.sum(F.when(word, F.col("n"))).alias("words"), F.count_if(word & (F.col("n") > 0)).alias("kinds"), F.sum(F.when(~word, F.col("n"))).alias("ends")).first()
    ends = sums["ends"] or 0
    tokens, kinds = (sums["words"] or 0) + ends, sums["kinds"] + (ends > 0)
    smooth = tokens + 0.1 * (kinds + 1)

    trie = train_texts(docs, key, text)
    keys, codes, counts = _head(trie, TEXT_ORDER, TEXT_EDGE, TEXT_ENTRIES if most is None else most)
    known = counted.filter(word)
    top = known.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()  # HEAD rows
    index = {w: i for i, w in enumerate(top["word"].to_pylist())}
    n_of = top["n"].to_numpy().astype(float)
    head = spark.sparkContext.broadcast((index, np.stack([n_of > 0, np.log10((n_of + 0.1) / smooth)], 1), keys, hash_tables(keys, counts), codes))
    kind = docs.schema[key].dataType.simpleString()
    at_end = [float(ends > 0), math.log10((ends + 0.1) / smooth)]

    def scored(it):
        from pyspark import TaskContext

        row, (index, of, keys, tables, codes) = TaskContext.get().partitionId() << 40, head.value
        get = index.get

        def coded(parts, rows, score):
            """Adds known codes to score, and gives (row, key, times) of bytes that aren't."""
            number, wanted = piece_keys(parts)
            found, at = look_up(keys, tables, wanted)
            number = np.array(rows, np.int64)[number]
            score += np.bincount(number[found], codes[at[found]], len(score))
            number, wanted = number[~found], wanted[~found]
            by = np.lexsort((wanted, number))
            number, wanted = number[by], wanted[by]
            first = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (wanted[1:] != wanted[:-1]))) if len(number) else by
            return number[first], wanted[first].view(np.int64), np.diff(np.append(first, len(number)))

        for b in it:
            for start in range(0, b.num_rows, 200):
                part = b.slice(start, 200)
                rid, words, n, sizes, held, base = [], [], [], [], [], []
                score, parts, rows, size, rare = np.zeros(part.num_rows), [], [], 0, [(np.zeros(0, np.int64),) * 3]
                for i, (k, t) in enumerate(zip(part.column(0).to_pylist(), part.column(1), strict=True)):
                    split = split_words(t.as_py())
                    hits, times = [], []
                    for w, m in Counter(split).items():
                        if (j := get(w)) is None:
                            rid.append(row + i)
                            words.append(w)
                            n.append(m)
                        else:
                            hits.append(j)
                            times.append(m)
                    base.append((np.array(times, float) @ of[hits] if hits else np.zeros(2)) + at_end)
                    sizes.append(len(split) + 1)
                    held.append(is_held_out(k))
                    for p in pieces(joined_words(split)):
                        parts.append(p)
                        rows.append(i)
                        size += len(p[0])
                        if size >= PIECE:
                            rare.append(coded(parts, rows, score))
                            parts, rows, size = [], [], 0
                if parts:
                    rare.append(coded(parts, rows, score))
                number, entry, m = (np.concatenate(x) for x in zip(*rare, strict=True))
                base, spare = np.array(base), len(rid) + len(entry)
                before = lambda x: pa.concat_arrays([pa.nulls(spare, x.type), x])  # noqa: B023, E731
                made = {
                    "rid": pa.array(np.concatenate([np.array(rid, np.int64), row + number, row + np.arange(part.num_rows)])),
                    "word": pa.array(words + [None] * (len(entry) + part.num_rows), pa.binary()),
                    "entry": pa.concat_arrays([pa.nulls(len(rid), pa.int64()), pa.array(entry), pa.nulls(part.num_rows, pa.int64())]),
                    "m": pa.concat_arrays([pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.nulls(part.num_rows, pa.int64())]),
                    "key": before(part.column(0)), "held_out": before(pa.array(held, pa.bool_())), "n_tokens": before(pa.array(sizes, pa.int64())),
                    "n_known": before(pa.array(base[:, 0])), "base_score": before(pa.array(base[:, 1])), "score": before(pa.array(score)),
                }
                row += part.num_rows
                yield pa.RecordBatch.from_pydict(made)

    fields = f"rid long, word binary, entry long, m long, key {kind}, held_out boolean, n_tokens long, n_known double, base_score double, score double"
    both = materialize(docs.select(F.col(key), F.col(text)).mapInArrow(scored, fields), "parts")
    rest = both.filter(word).select("rid", "word", "m").join(known, "word")
    rest = rest.groupBy("rid").agg(F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("more_known"), F.sum(F.col("m") * F.log10((F.col("n") + 0.1) / smooth)).alias("more_base"))
    deep = _joined(both.filter("entry is not null").select("rid", F.col("entry").alias("key"), "m"), trie)
    whole = both.filter("held_out is not null").drop("word", "entry", "m").join(rest, "rid", "left").join(deep, "rid", "left")
    more = lambda c, d: F.col(c) + F.coalesce(d, F.lit(0))
    return whole.select(F.col("key").alias(key), "held_out", "n_tokens", more("n_known", "more_known").cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), more("base_score", "more_base").alias("base_score"), more("score", "more").alias("score"))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_scores(table(spark, sf_dir, "documents"))


QUERIES = {"op7_ppm": op7_ppm}
ORACLE: dict[str, str] = {}
