"""Toxicity by noisy-channel deobfuscation: Viterbi decoding of character lattices, then scoring of restored text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_shuffles, materialize, send, table

#: Labelled documents that must hold a feature, and how much more often toxic ones must.
LEAST_DOCS, LEAST_LIFT = 3, 8
#: Word starts that count as features besides whole words.
STARTS = (3, 4, 5, 6, 7)

#: Columns of what the classifier sees of a text, see signals().
SIGNALS = ("most", "strong", "total")

#: What a mark may stand for, with costs in nats.
LEET = {
    "0": (("o", 0.5),), "1": (("i", 0.5), ("l", 0.7)), "2": (("z", 1.0),), "3": (("e", 0.5),), "4": (("a", 0.5),),
    "5": (("s", 0.5),), "6": (("g", 1.0), ("b", 1.2)), "7": (("t", 0.5),), "8": (("b", 0.7),), "9": (("g", 0.9),),
    "@": (("a", 0.3),), "$": (("s", 0.3),), "!": (("i", 0.4), ("l", 0.9)), "|": (("i", 0.6), ("l", 0.6)), "+": (("t", 0.6),),
    "*": tuple((v, 1.6) for v in "aeiou"), "€": (("e", 0.4),), "£": (("l", 0.6),), "(": (("c", 0.8),), "#": (("h", 1.2),),
}
#: Costs of dropping a mark, a letter of a run of three or more, a letter of a pair.
DROP_MARK, DROP_RUN, DROP_PAIR = 1.2, 0.2, 2.0

WORD = re.compile(r"[^\W\d_]+")
MARKS = re.escape("".join(LEET))
#: Words with marks inside or in front, with digits or such at the end, or with a letter three times in a row.
ODD = re.compile(rf"[^\W\d_]*[{MARKS}]+[^\W\d_][^\W_{MARKS}]*(?:[{MARKS}]+[^\W\d_]+)*[0-9@$€£]*|[^\W\d_]+[0-9@$€£]+(?![^\W_])|[^\W\d_]*?([^\W\d_])\1\1[^\W\d_]*")
#: A mark before a letter or a digit or such after one: with three equal letters in a row, what each match of ODD holds. It begins
#: with a mark, so that a search passes over letters at once.
MARK = re.compile(rf"[{MARKS}](?:(?=[^\W\d_])|(?<=[^\W\d_][0-9@$€£]))")
#: Single characters that blanks or marks hold apart.
SPACED = re.compile(rf"(?<![^\W_])(?:[^\W_]|[{MARKS}])(?:[ .\-_*~/\\]{{1,3}}(?:[^\W_]|[{MARKS}])){{2,}}(?![^\W_])")
#: The last two characters of what SPACED finds, which few texts hold.
TWO_SPACED = re.compile(rf"[ .\-_*~/\\](?:[^\W_]|[{MARKS}])[ .\-_*~/\\]{{1,3}}(?:[^\W_]|[{MARKS}])(?![^\W_])")
APART = re.compile(r"[ .\-_*~/\\]+")


def trigrams(words: dict[str, float]) -> Counter:
    """Three neighbouring characters of words between two openings and an end, with the counts of the words."""
    made: Counter = Counter()
    for w, n in words.items():
        s = f"^^{w}$"
        for i in range(2, len(s)):
            made[s[i - 2 : i + 1]] += n
    return made


class CharacterModel:
    """Trigrams of letters with back-off, from their counts."""

    def __init__(self, three: dict[str, float]):
        two, one = Counter(), Counter()
        for t, n in three.items():
            two[t[:2]] += n
            one[t[2]] += n
        total = sum(one.values()) or 1.0
        self.cost = {t: -math.log(0.9 * n / two[t[:2]] + 0.1 * one[t[2]] / total) for t, n in three.items()}
        self.back = {c: -math.log(0.1 * n / total) for c, n in one.items()}
        self.unseen = -math.log(0.01 / (total + 1))

    def __call__(self, context: str, c: str) -> float:
        found = self.cost.get(context + c)
        return found if found is not None else self.back.get(c, self.unseen)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each character what it may have been before it was obfuscated, '' if it was put in, and the cost."""
    out = []
    for i, c in enumerate(token):
        options = [] if c in LEET else [(c, 0.0)]
        options += LEET.get(c, ())
        if c in LEET:
            options.append(("", DROP_MARK))
        elif i and token[i - 1] == c:
            run = len(token[:i]) - len(token[:i].rstrip(c)) + len(token[i:]) - len(token[i:].lstrip(c))
            options.append(("", DROP_RUN if run >= 3 else DROP_PAIR))
        out.append(options)
    return out


def decode(token: str, model: CharacterModel) -> str:
    """The likeliest word behind a token: Viterbi over its lattice, states are the last two letters."""
    states = {"^^": (0.0, "")}
    for options in lattice(token):
        after: dict[str, tuple[float, str]] = {}
        for context, (cost, word) in states.items():
            for c, price in options:
                state, now, made = (context[1] + c, cost + price + model(context, c), word + c) if c else (context, cost + price, word)
                if state not in after or now < after[state][0]:
                    after[state] = (now, made)
        states = after
    return min((cost + model(context, "$"), word) for context, (cost, word) in states.items())[1]


def triples(text: str) -> list[str]:
    """The letters that stand three times in a row somewhere, three times each."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    same = c[1:] == c[:-1]
    return [3 * x for x in map(chr, np.unique(c[:-2][same[1:] & same[:-1]]).tolist()) if WORD.match(x)]


class Restorer:
    """Words of a text with obfuscated ones restored; remembers tokens up to a bound."""

    def __init__(self, three: dict[str, float], strong: frozenset[str], most: int = 200_000):
        self.model, self.strong, self.most, self.known = CharacterModel(three), strong, most, {}
        self.find = re.compile("|".join(sorted(map(re.escape, strong), key=len, reverse=True))) if strong else None

    def one(self, token: str) -> str:
        if token not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[token] = decode(token, self.model)
        return self.known[token]

    def __call__(self, text: str) -> set[str]:
        text = text.lower()
        tokens = set(text.split())  # no match of WORD, MARK or ODD holds white space
        words = set(filter(str.isalpha, tokens))
        other = tokens - words
        mixed = " ".join(other)
        odd = [t for t in other if MARK.search(t)] if MARK.search(mixed) else []
        if found := triples(text):
            odd += [t for t in tokens if any(x in t for x in found)]
        words.update(WORD.findall(mixed))
        words.update(self.one(m[0]) for m in ODD.finditer(" ".join(odd)))
        for m in SPACED.finditer(text) if TWO_SPACED.search(text) else ():
            joined = self.one(APART.sub("", m[0]))
            words.add(joined)
            if self.find:
                words.update(self.find.findall(joined))
        return words


def count_features(words: set[str], into: Counter, starts: dict[int, Counter]) -> None:
    """Add the words of a document and their starts, by length, each once."""
    into.update(words)
    for n in STARTS:
        words = [w for w in words if len(w) > n]
        starts[n].update({w[:n] for w in words})


def weight(p: float, n: float, toxic: float, clean: float) -> float:
    """Smoothed log odds of a feature that p of toxic and n of clean documents hold."""
    return math.log((p + 0.2) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1))


def signals(words: set[str], weights: dict[str, float], openings: set[str]) -> list[float]:
    """What the classifier sees of the best features of words: the largest weight, how many weigh 3 or more, and the sum of those.

    openings: the first four letters of all features, three of shorter ones, which most words don't share with any.
    """
    most, strong = 0.0, []
    for w in [w for w in words if w[:4] in openings or w[:3] in openings]:
        best = max(weights.get(w, 0.0), *[weights.get(w[:n] + "-", 0.0) for n in STARTS if len(w) > n], 0.0)
        most = max(most, best)
        if best >= 3:
            strong.append(best)
    return [min(most, 6.0), math.log1p(len(strong)), min(math.fsum(strong), 20.0) / 4]


def newton_sums(x: np.ndarray, y: np.ndarray, n: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the logistic loss of rows x with labels y that occur n times, as one array."""
    x = np.hstack([x, np.ones((len(x), 1))])
    p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
    return np.append(x.T @ (n * (p - y)), (x * (n * p * (1 - p))[:, None]).T @ x)


def fit_logistic(sums: Callable[[np.ndarray], np.ndarray], size: int, penalty: float = 0.001, rounds: int = 50) -> np.ndarray:
    """Coefficients, the intercept last, by Newton's method. sums: newton_sums of all rows at given coefficients."""
    b = np.zeros(size)
    for _ in range(rounds):
        got = sums(b)
        step = np.linalg.solve(got[size:].reshape(size, size) + penalty * np.eye(size), got[:size] + penalty * b)
        b = b - step
        if np.abs(step).max() <= 1e-9 * max(1.0, np.abs(b).max()):
            break
    return b


class Model:
    """A fitted scorer: trigrams of the rows' words, features and their counts, and coefficients. It holds no rows: its size
    grows with the different trigrams of letters and with the words that are toxic by LEAST_DOCS and LEAST_LIFT.
    typical: the count of the most frequent word."""

    def __init__(self, three: dict[str, float], typical: float, table: dict[str, tuple[int, int]], toxic: int, clean: int):
        self.three, self.typical, self.table, self.toxic, self.clean, self.b = three, typical, table, toxic, clean, np.array([0.0, 0.0, 0.0, -2.0])
        self.openings = {f[:4].rstrip("-") for f in table}
        self.restore: Restorer | None = None
        self.by_label: dict[int | None, dict[str, float]] = {}

    def __getstate__(self):
        return vars(self) | {"restore": None, "by_label": {}}

    def weights(self, own: int | None) -> dict[str, float]:
        """The weight of each feature. own: the label of a training row, whose own share in the counts is taken away."""
        if own not in self.by_label:
            counts = {f: (p - (own == 1), max(0, n - (own == 0))) for f, (p, n) in self.table.items()}
            self.by_label[own] = {f: weight(*c, self.toxic, self.clean) for f, c in counts.items() if c[0] >= 2}
        return self.by_label[own]

    def words_of(self, text: str) -> set[str]:
        if self.restore is None:
            strong = {f: weight(*c, self.toxic, self.clean) for f, c in self.table.items() if len(f) >= 4 and not f.endswith("-")}
            strong = {f for f, w in strong.items() if w >= 3}
            self.restore = Restorer(Counter(self.three) + trigrams(dict.fromkeys(strong, 0.05 * self.typical)), frozenset(strong))
        return self.restore(text)

    def signals(self, text: str | None, own: int | None = None) -> list[float]:
        return signals(self.words_of(text or ""), self.weights(own), self.openings)

    def score(self, text: str | None) -> float:
        x = self.signals(text)
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.b[:-1] @ x) + self.b[-1])))))


def _counts(it):
    """(kind, item, p, n): documents of either label that hold a feature, a whole word or, with a hyphen, a word's start; and
    word counts."""
    wholes, starts, words = (Counter(), Counter()), tuple({n: Counter() for n in STARTS} for _ in range(2)), Counter()

    def flush():
        items, p, n = [], [], []
        for label, whole, of in zip((0, 1), wholes, starts, strict=True):
            for held, end in [(whole, ""), *((c, "-") for c in of.values())]:
                items += [f + end for f in held] if end else held
                (p if label else n).extend(held.values())
                (n if label else p).extend([0] * len(held))
                held.clear()
        kinds = [0] * len(items) + [1] * len(words)
        made = [pa.array(kinds, pa.int32()), pa.array([*items, *words], pa.string()), pa.array([*p, *words.values()], pa.int64()), pa.array(n + [0] * len(words), pa.int64())]
        words.clear()
        return pa.RecordBatch.from_arrays(made, names=["kind", "item", "p", "n"])

    for b in it:
        for text, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            found = WORD.findall((text.as_py() or "").lower())
            words.update(found)
            label = 1 if label else 0
            count_features(set(found), wholes[label], starts[label])
            if sum(len(c) for x in (*starts, dict(enumerate(wholes))) for c in x.values()) > 400_000:
                yield flush()
    yield flush()


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic") -> Model:
    """A model from all labelled rows: their counts, and coefficients from the signals of each; null labels don't count.

    Rows repeat as often as they stand there. Signals stay in the shared folder, equal ones together; a round of Newton's
    method brings sums to the driver. Without rows of both labels the model knows no feature and scores every text alike.
    """
    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(text).alias("t"), (F.col(label) != 0).cast("int").alias("y"))
    rows = materialize(rows, "labelled", "zstd")
    free_shuffles(rows.sparkSession)
    by = {r["y"]: r["c"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("c")).collect()}
    toxic, clean = by.get(1, 0), by.get(0, 0)
    if not toxic or not clean:
        discard(rows)
        return Model({}, 1.0, {}, toxic, clean)
    counted = materialize(rows.mapInArrow(_counts, "kind int, item string, p long, n long").groupBy("kind", "item").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), "features")
    lift = (F.col("p") + 0.2) / (toxic + 1) / ((F.col("n") + 0.5) / (clean + 1))
    kept = counted.filter((F.col("kind") == 0) & (F.col("p") >= LEAST_DOCS) & (lift >= LEAST_LIFT))
    words = counted.filter("kind = 1").select(F.concat(F.lit("^^"), "item", F.lit("$")).alias("s"), "p")
    parts = F.transform(F.sequence(F.lit(1), F.length("s") - 2), lambda i: F.substring("s", i, F.lit(3)))
    three = words.select(F.explode(parts).alias("t"), "p").groupBy("t").agg(F.sum("p").alias("p")).collect()  # different trigrams of letters
    typical = words.agg(F.max("p")).first()[0] or 1
    model = Model({r["t"]: float(r["p"]) for r in three}, float(typical), {r["item"]: (r["p"], r["n"]) for r in kept.select("item", "p", "n").collect()}, toxic, clean)
    sent = send(rows.sparkSession, model)

    def seen(it):
        for b in it:
            labels = b.column(1).to_pylist()
            x = [sent().signals(t.as_py(), y) for t, y in zip(b.column(0), labels, strict=True)]
            yield pa.RecordBatch.from_pydict({"y": pa.array(labels, pa.int32()), **{c: pa.array([v[i] for v in x], pa.float64()) for i, c in enumerate(SIGNALS)}})

    signalled = rows.mapInArrow(seen, "y int, " + ", ".join(f"{c} double" for c in SIGNALS))
    signalled = materialize(signalled.groupBy("y", *SIGNALS).agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("y", *SIGNALS), "signals")

    def sums(b: np.ndarray) -> np.ndarray:
        def partial(it):
            got = [newton_sums(np.stack([r.column(c).to_numpy() for c in SIGNALS], 1), r.column("y").to_numpy(), r.column("n").to_numpy(), b) for r in it if r.num_rows]
            yield pa.RecordBatch.from_pydict({"sums": pa.array([g.tolist() for g in got], pa.list_(pa.float64()))})

        return np.array([math.fsum(c) for c in zip(*[r["sums"] for r in signalled.mapInArrow(partial, "sums array<double>").collect()], strict=True)])

    model.b = fit_logistic(sums, len(SIGNALS) + 1)
    discard(rows, counted, signalled)
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row from its whole text, however long; null texts score as empty ones.

    A word counts once, however often a text repeats it. Repeated rows score alike, null keys stay, an empty table gives an
    empty result, and other columns aren't read.
    """
    sent = send(docs.sparkSession, model)

    def batches(it):
        for b in it:
            made = [sent().score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.float64())], names=[key, "score"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(batches, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from; null keys have none."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> Model:
    """A model of the rows of docs that have a label and aren't held out."""
    known = labels.filter(~held_out(F.col(key)) & F.col(key).isNotNull()).select(F.col(key).alias("__k"), F.col("toxic").alias("__toxic")).dropDuplicates(["__k"]).hint("merge")  # labels grow with texts
    return fit(docs.join(known, docs[key] == F.col("__k")).select(docs[key].alias("doc_id"), docs["text"].alias("text"), F.col("__toxic").alias("toxic")))


def reject(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below threshold, with the columns of docs; see score. Rows without words are kept."""
    sent = send(docs.sparkSession, model)
    at = docs.columns.index(text)

    def batches(it):
        for b in it:
            keep = [sent().score(t.as_py()) < threshold for t in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit_on(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE: dict[str, str] = {}
