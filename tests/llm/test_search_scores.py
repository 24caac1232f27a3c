import hashlib
import math
import os
import random
import subprocess
import sys
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from diffquarry.llm import decontaminate, html_text, ppm, rabitq, toxicity


def nearest_by_hand(rows, k):
    """For each usable row with an id divisible by 20 its k nearest other rows."""
    good = []
    for i, v in rows:
        x = np.array([np.nan if c is None else c for c in v or []], float)
        if i is not None and len(x) and np.isfinite(x).all() and x.any():
            good.append((i, x))
    out = []
    for n, (q, x) in enumerate(good):
        if q % 20 == 0:
            scores = sorted((-(x @ y) / np.sqrt((x @ x) * (y @ y)), j) for m, (j, y) in enumerate(good) if m != n and len(y) == len(x))
            out += [(q, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_nearest_against_all_vectors(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rnd.standard_normal(24).astype(np.float32)]) for i in range(900)]
    rows[40] = (40, rows[7][1])
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] + [1.0] * 23), (2060, [None] + [1.0] * 23), (2080, [float("inf")] * 24), (None, [1.0] * 24), (2100, [1.0, 2.0]), (2120, []), rows[3]]
    rows += [(20, rows[20][1]), (60, [1.0] * 24), (7, rows[8][1]), (7, rows[8][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("rid", F.lit(1))
    got = sorted(map(tuple, rabitq.nearest(df, F.col("vec_id") % 20 == 0, block=200, query_block=16).collect()))
    want = nearest_by_hand(rows, 5)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    same = [g[2] == w[2] and g[3] == pytest.approx(w[3], abs=1e-9) for g, w in zip(got, want, strict=True)]
    assert np.mean(same) >= 0.97
    assert [r[2] for r in got if r[0] == 40] == [7, 1000, 1001, 1002, 1003]
    assert rabitq.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_estimates_from_packed_bits():
    """The estimate equals the inner product with the code, and stays within its bound nearly always."""
    rnd = np.random.default_rng(4)
    for dim in (3, 64, 700):
        x = rnd.standard_normal((3000, dim))
        x /= np.linalg.norm(x, axis=1)[:, None]
        turn = rabitq.rotations(dim, 1)
        codes, c = rabitq.encode(x, turn)
        planes, *scales = rabitq.rounded(x[:5], turn)
        signs = np.where(x @ turn.T > 0, 1, -1) / np.sqrt(len(turn))
        for j, scale in enumerate(zip(*scales, strict=True)):
            got = rabitq.estimates(codes, c, planes[j], *scale, len(turn))
            plain = signs @ (turn @ x[j] / np.sqrt(len(turn) / dim)) / c
            assert np.abs(got - plain).max() < 0.05
            assert np.mean(np.abs(got - x @ x[j]) <= rabitq.bounds(c, scale[1], len(turn), 3.0)) > (0.9 if dim == 3 else 0.99)


def test_recall_on_many_vectors(spark):
    rnd = np.random.default_rng(8)
    x = rnd.standard_normal((50_000, 64)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in rabitq.nearest(df, F.col("vec_id") % 500 == 0).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = set()
    for q in range(0, len(x), 500):
        s = unit @ unit[q]
        s[q] = -2
        want |= {(q, int(j)) for j in np.argsort(-s)[:5]}
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)


def hand_contamination(docs, items):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in low).split(" ")

    split = lambda t: [w for w in words(t) if w]
    windows = {}
    for i, t in items:
        w = split(t)
        for s in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[s : s + 13]), set()).add(str(i))
    out = []
    for k, t in docs:
        w, hit, ids = split(t), set(), set()
        for win, names in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    ids |= names
        out.append((str(k), len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_contamination_against_all_windows(spark, monkeypatch, limit):
    rnd = random.Random(9)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    vocabulary = [f"w{i}" for i in range(9)] + ["É", "ñu"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 30)))) for i in range(25)] + [(90, None), (91, " ., "), (3, "repeat of item three"), (92, "the the the the"), (None, "no name")]
    docs = []
    for k in range(80):
        t = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 80))]
        if k % 2:
            t[10:10] = (rnd.choice(items)[1] or "x").split(" ")
        docs.append((k, rnd.choice([" ", ", ", "\n"]).join(t).upper() if k % 5 == 0 else " ".join(t)))
    docs += [(100, None), (101, ""), (102, "the " * 50), (102, "the " * 50), (None, "REPEAT, of item-three!")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("word", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(df, bench)
    rows = sorted((str(r.doc_id), r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got.collect())
    named = [(i, t) for i, t in items if i is not None]
    whole, by_name = hand_contamination(docs, items), hand_contamination(docs, named)
    assert [(*r[:3], r[5]) for r in rows] == [(*r[:3], r[5]) for r in whole]
    assert sorted((r[0], r[1], r[3], r[4]) for r in rows) == sorted((r[0], r[1], r[3], r[4]) for r in by_name)
    clean = decontaminate.clean(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(not r[5] for r in rows)


def test_contamination_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).first().n_hit == 0
    assert decontaminate.contamination(docs.limit(0), none).count() == 0


def trie_by_hand(words, word):
    """Code length of one word by dictionaries."""
    counts = {}
    for w in set(words):
        s = b" " + w + b" "
        for i in range(1, len(s)):
            for k in range(min(i, ppm.ORDER) + 1):
                counts.setdefault(s[i - k : i], {}).setdefault(s[i], 0)
                counts[s[i - k : i]][s[i]] += 1
    total, s = 0.0, b" " + word + b" "
    for i in range(1, len(s)):
        gone = set()
        for k in range(min(i, ppm.ORDER), -1, -1):
            seen = {b: n for b, n in counts.get(s[i - k : i], {}).items()}
            if not seen:
                continue
            mass, kinds = sum(n for b, n in seen.items() if b not in gone), len(set(seen) - gone)
            if s[i] in seen:
                total += math.log10((seen[s[i]] - 0.5) / mass)
                break
            if kinds:
                total += math.log10(kinds / 2 / mass)
            gone = set(seen)
        else:
            total -= math.log10(256 - len(gone))
    return total


def test_trie_against_dictionaries():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 10))).encode() for _ in range(200)]
    trie = ppm.Trie(*ppm.entries(list(dict.fromkeys(words))))
    asked = words[:20] + [b"zzz", b"abz", b"\xff\x00", b"aaaaaaaaaaaaaaaa"]
    assert trie.code(asked).tolist() == pytest.approx([trie_by_hand(words, w) for w in asked], rel=1e-9)
    first = trie.code([bytes([b]) for b in range(256) if b != 32])
    assert trie.code([]).tolist() == [] and sum(10**first) <= 1


def test_scores_by_hand(spark, monkeypatch):
    monkeypatch.setattr(ppm, "HEAD", 3)
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["aa", "bb", "Cc", "dé", f"x{i}"]) for _ in range(rnd.randrange(0, 12))), rnd.choice(["u", "v", None])) for i in range(60)]
    rows += [(None, "aa aa", "u"), (77, None, None), (78, "", "u"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n", F.lit("clash")).withColumn("word", F.lit(1))
    out = [(k, zlib.crc32(str(k).encode()) % 10 == 0 if k is not None else False) for k, *_ in rows]
    tokens = [[*ppm.split_words(t), None] for _, t, _ in rows]
    train = [w for t, (_, held) in zip(tokens, out, strict=True) if not held for w in t]
    n, kinds = len(train), len(set(train))
    want = sorted((str(k), held, len(t), sum(w in set(train) for w in t), n, round(sum(math.log10((train.count(w) + 0.1) / (n + 0.1 * (kinds + 1))) for w in t), 6)) for (k, held), t in zip(out, tokens, strict=True))
    got = ppm.code_lengths(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert ppm.code_lengths(docs.limit(0)).count() == 0
    only = ppm.code_lengths(docs.filter("doc_id = 77")).first()
    assert only.n_tokens == 1 and only.score <= 0


def scores_by_dictionaries(rows, most):
    """The score of every row, by dictionaries: each class tells its own words by their counts and escapes to the trie."""
    held = [k is not None and zlib.crc32(str(k).encode()) % 10 == 0 for k, *_ in rows]
    words = [ppm.split_words(t) for _, t, _ in rows]
    by_size = sorted({g for *_, g in rows}, key=lambda g: (-sum(x[2] == g for x in rows), g is not None, g or ""))[:most]
    classes = {g: z for z, g in enumerate(by_size)}
    counts, ends = [{} for _ in range(len(by_size) + 1)], [0] * (len(by_size) + 1)
    for ws, out, (_, _, g) in zip(words, held, rows, strict=True):
        if not out:
            z = classes.get(g, len(by_size))
            ends[z] += 1
            for w in ws:
                counts[z][w] = counts[z].get(w, 0) + 1
    learnt = sorted({w for c in counts for w in c})
    code = {w: trie_by_hand(learnt, w) for w in {w for ws in words for w in ws}}
    made = []
    for ws in words:
        terms = []
        for c, e in zip(counts, ends, strict=True):
            n = sum(c.values())
            if not e:
                continue
            more = math.log10(n / (n + e)) if n else 0.0
            escape = math.log10(len(c) / 2 / n) - math.log10(max(1e-9, 1 - sum(10 ** code[w] for w in c))) if n else 0.0
            total = sum(more + (math.log10((c[w] - 0.5) / n) if w in c else code[w] + escape) for w in ws) + math.log10(e / (n + e))
            terms.append(total + math.log10(e / sum(ends)))
        best = max(terms)
        made.append(best + math.log10(sum(10 ** (t - best) for t in terms)))
    return made


def test_scores_against_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(ppm, "HEAD", 3)
    monkeypatch.setattr(ppm, "MOST_CLASSES", 2)
    rnd = random.Random(15)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 5)))
    rows = [(i, " ".join(word() for _ in range(rnd.randrange(0, 15))), rnd.choice(["u", "u", "v", "w", None])) for i in range(70)] + [(200, None, "u"), (201, "", "v"), (202, "a b " * 3000, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.score for r in ppm.code_lengths(docs).collect()}
    want = scores_by_dictionaries(rows, 2)
    assert [got[k] for k, *_ in rows] == pytest.approx(want, rel=1e-9)


def test_rare_entries_are_joined(spark):
    """Codes by a trie of which executors hold few or no entries equal those by the whole trie in memory."""
    rnd = random.Random(9)
    words = list({"".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 14))).encode() for _ in range(400)})
    rows = [(w, int(i % 4 > 0)) for i, w in enumerate(words)] + [(b"\xff\x00", 0), (b"zzzz", 0), (b"a" * 50, 0)]
    counted = spark.createDataFrame(rows, "word binary, n long")
    for seen in (counted, counted.withColumn("n", F.lit(0))):
        learnt = [bytes(r.word) for r in seen.filter("n > 0").collect()]
        trie, table = ppm.Trie(*ppm.entries(learnt)), ppm.train(seen)
        asked = [w for w, _ in rows]
        want = dict(zip(asked, trie.code(asked).tolist(), strict=True))
        for most in (0, 100, None):
            got = {bytes(r.word): r.code for r in ppm.word_codes(seen, table, most).collect()}
            assert got == pytest.approx(want, rel=1e-9)


def test_held_out_texts_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = ppm.code_lengths(docs).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held.s > held.b


def ppm_by_hand(rows, order):
    """The score of every row by an adaptive model: dictionaries, updated byte by byte down to where a byte is known."""
    texts = [b"\n" + b" ".join(ppm.split_words(t)) + b"\n" for _, t in rows]
    counts = {}
    for (k, _), s in zip(rows, texts, strict=True):
        for i in range(1, len(s)) if k is None or zlib.crc32(str(k).encode()) % 10 else ():
            for n in range(min(i, order), -1, -1):
                at = counts.setdefault(s[i - n : i], {})
                at[s[i]] = at.get(s[i], 0) + 1
                if at[s[i]] > 1:
                    break
    made = []
    for s in texts:
        total = 0.0
        for i in range(1, len(s)):
            gone = set()
            for n in range(min(i, order), -1, -1):
                if not (seen := counts.get(s[i - n : i], {})):
                    continue
                mass, kinds = sum(c for b, c in seen.items() if b not in gone), len(set(seen) - gone)
                if s[i] in seen:
                    total += math.log10((seen[s[i]] - 0.5) / mass)
                    break
                if kinds:
                    total += math.log10(kinds / 2 / mass)
                gone = set(seen)
            else:
                total -= math.log10(256 - len(gone))
        made.append(total)
    return made


@pytest.mark.parametrize(("most", "piece"), [(None, 1 << 20), (0, 3), (40, 7)])
def test_text_scores_against_an_adaptive_model(spark, monkeypatch, most, piece):
    """Contexts cross words, entries that executors don't hold are joined, and long texts are cut without a loss."""
    monkeypatch.setattr(ppm, "HEAD", 3)
    monkeypatch.setattr(ppm, "PIECE", piece)
    rnd = random.Random(15)
    word = lambda: "".join(rnd.choice("abcÉé") for _ in range(rnd.randrange(1, 5)))
    rows = [(i, " ".join(word() for _ in range(rnd.randrange(0, 15)))) for i in range(70)]
    rows += [(i, "ab zz\u4e00 q " + word()) for i in range(300, 340)] + [(200, None), (201, ""), (None, " \n"), (202, "a b " * 500), rows[0], (400, "one two three"), (401, "three two one")]
    assert any(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows if k is not None)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "word", "entry", "score")})
    got = ppm.text_scores(docs, most=most).collect()
    assert sorted((str(r.doc_id), r.score) for r in got) == [(k, pytest.approx(s, rel=1e-9)) for k, s in sorted((str(k), s) for (k, _), s in zip(rows, ppm_by_hand(rows, ppm.TEXT_ORDER), strict=True))]
    base = {str(r.doc_id): (r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in ppm.code_lengths(docs.drop("lang"), group=None).collect()}
    assert base == {str(r.doc_id): (r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got}
    assert ppm.text_scores(docs.limit(0)).count() == 0


def test_ppm_query_reads_the_order_of_words(spark, tmp_path):
    rows = [(i, "the cat sat on the mat") for i in range(1, 30)] + [(1000, "the cat sat on the mat"), (1001, "mat the on sat cat the")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in ppm.op7_ppm(spark, str(tmp_path)).collect()}
    assert got[1000].base_score == pytest.approx(got[1001].base_score) and got[1000].score > got[1001].score + 1
    untaught = ppm.text_scores(spark.createDataFrame([(k, "ab") for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0], "doc_id long, text string")).collect()
    assert untaught and all(r.score == pytest.approx(-3 * math.log10(256)) and r.n_known == 0 for r in untaught)


def test_ppm_query_beats_the_base(spark):
    held = ppm.op7_ppm(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.count("*").alias("n")).first()
    assert held.n > 0 and held.s > held.b


def test_decoding():
    words = {w: 50.0 for w in ("idiot", "stupid", "loser", "hello", "good", "tree", "book", "letter")}
    restore = toxicity.Restorer(toxicity.trigrams(words), frozenset(("idiot", "stupid", "loser")))
    for text, word in (("1d10t", "idiot"), ("st*pid!", "stupid"), ("l0$er", "loser"), ("stuuuupid", "stupid"), ("i d i o t", "idiot"), ("l.o.s.e.r", "loser"), ("1 D 1 0 T", "idiot"), ("idi07", "idiot"), ("stup1d", "stupid")):
        assert word in restore(text), text
    assert not {"idiot", "stupid", "loser"} & restore("hello good tree, book 10 a a a 555-1234")
    assert restore("") == set()


def test_plain_texts_are_not_searched_for_oddities(monkeypatch):
    """The costly patterns run only where they may match, and find what they find in whole texts."""
    restore = toxicity.Restorer(toxicity.trigrams({"idiot": 9, "stupid": 9, "hello": 9}), frozenset(("idiot", "stupid")))
    rnd = random.Random(8)
    for _ in range(3000):
        text = "".join(rnd.choice("aaiot 01@$!|*€(#._-~/\\²Ⅷ٣ªß\n\u3000İ") for _ in range(rnd.randrange(30)))
        low = text.lower()
        want = {*toxicity.WORD.findall(low), *(restore.one(m[0]) for t in low.split() for m in toxicity.ODD.finditer(t))}
        for m in toxicity.SPACED.finditer(low):
            joined = restore.one(toxicity.APART.sub("", m[0]))
            want |= {joined, *restore.find.findall(joined)}
        assert restore(text) == want, text

    class Refused:
        def finditer(self, text):
            assert not text
            return ()

    monkeypatch.setattr(toxicity, "SPACED", Refused())
    monkeypatch.setattr(toxicity, "ODD", Refused())
    assert restore("A plain text, with a comma, well-made, 12 numbers... and a line\nin it") >= {"plain", "comma", "well", "made", "numbers", "line"}


def test_viterbi_against_all_paths():
    """The decoded word is the cheapest of all that the lattice allows."""
    rnd = random.Random(6)
    model = toxicity.CharacterModel(toxicity.trigrams({w: rnd.randrange(1, 60) for w in ("idiot", "stupid", "loser", "hello", "tree", "boss", "aloe")}))
    for _ in range(150):
        token = "".join(rnd.choice("idotslb01$3!*e") for _ in range(rnd.randrange(1, 7)))

        def cheapest(options, context, model=model):
            if not options:
                return [(model(context, "$"), "")]
            made = []
            for c, price in options[0]:
                after = context[1] + c if c else context
                for cost, word in cheapest(options[1:], after):
                    made.append((cost + price + (model(context, c) if c else 0.0), c + word))
            return made

        every = cheapest(toxicity.lattice(token), "^^")
        best = min(cost for cost, _ in every)
        assert toxicity.decode(token, model) in {word for cost, word in every if cost <= best + 1e-9}


FAR = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from diffquarry.llm import registry
import corpus_pipeline
for name in ("op7_ppm", "op8_toxicity", "op4_rabitq", "op9_html_text"):
    print("ROWS", name, registry.QUERIES[name](spark, "/root/testdata/sf0.001").count())
print("ROWS pipeline", corpus_pipeline.run(spark, "/root/testdata/sf0.001").count())
"""


def test_executors_need_no_package(tmp_path):
    """Python workers that can't import the package still run what is sent to them."""
    repo = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", FAR.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert done.stdout.count("ROWS") == 5, done.stderr[-3000:]


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumn("score", F.lit("clash"))
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit_on(docs, labels)
    rows = toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()
    caught = [r.score >= 0.7 for r in rows if r.toxic == 1]
    wrong = [r.score >= 0.7 for r in rows if r.toxic == 0]
    assert np.mean(caught) > 0.8 and np.mean(wrong) < 0.01
    odd = spark.createDataFrame([(1, None), (None, ""), (3, "idiot moron " * 5), (3, "1d10t m0r0n " * 5), (4, "plain words here " * 40000)], "doc_id long, text string")
    got = [r.score for r in toxicity.score(odd, model).collect()]
    assert all(0 <= s <= 1 for s in got) and got[0] == got[1] < 0.5 and min(got[2:4]) >= 0.7 and got[4] < 0.5
    assert toxicity.reject(odd, model).columns == odd.columns and toxicity.reject(odd, model).count() == 3
    none = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {none.score("")}


def test_toxicity_learns_from_all_labelled_rows(spark):
    """Counts, coefficients and thresholds are those of every labelled row, beyond 20,000 of them as below."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("aeiounrst") for _ in range(5))
    rows = [(i, " ".join([word(), word(), *(["scumbag"] if i % 10 == 0 and i % 40 else []), *(["1d10t"] if i % 1000 == 7 else [])]), int(i % 10 == 0)) for i in range(30_000)]
    rows += [(30_001, "no label", None), (30_002, None, 0), (None, "scumbag", 1), (None, "scumbag", 1)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4))
    known = [r for r in rows if r[2] is not None]
    assert (model.toxic, model.clean) == (3002, 27_001)
    assert model.table["scumbag"] == (sum("scumbag" in r[1] for r in known if r[1]), 0)
    words = Counter(w for _, t, _ in known for w in toxicity.WORD.findall((t or "").lower()))
    assert model.three == dict(toxicity.trigrams(words)) and model.typical == max(words.values())
    x, y = np.array([model.signals(t, y) for _, t, y in known]), np.array([y for *_, y in known], float)
    assert model.b == pytest.approx(toxicity.fit_logistic(lambda b: toxicity.newton_sums(x, y, np.ones(len(y)), b), 4), rel=1e-6)
    slope = toxicity.newton_sums(x, y, np.ones(len(y)), model.b)[:4] + 0.001 * model.b
    assert np.abs(slope).max() < 1e-6


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x = "</p>";</script><style>p{}</style></head><body>
<header><h1>Site</h1><nav><ul><li><a href=a>Home</a><li><a href=b>About</a></ul></nav></header>
<div class="cookie-notice">We use cookies on this site, please accept all of them now.</div>
<main><article><header><h1>The &eacute;tude</h1></header><p>First <b>bold paragraph of   the article,</b> with
a line end &amp; a&nbsp;space.<p>Second one, never closed, long enough to be a text.<!-- hidden <p>no</p> --><ul><li>point one<li>point two</ul>
<form><p>Subscribe to our newsletter today.</p><input type=text><button>Go</button></form><p style="display:none">Ad</p></article></main>
<aside><p>Some other story that has nothing to do with it.</p></aside><div id="comments"><p>I liked this article very much, thank you.</p></div>
<div class="ad">Buy things now, they are cheap and good.</div><footer><p>Copyright notice of the site.</p></footer></body>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "The étude\n\nFirst bold paragraph of the article, with a line end & a space.\n\nSecond one, never closed, long enough to be a text.\n\npoint one\n\npoint two"
    for empty in (None, "", "   ", "<html></html>", "<script>x", "<!-- a"):
        assert html_text.main_text(empty) == ""
    assert html_text.main_text("<p>Plain words without any article around them, in a full sentence.") == "Plain words without any article around them, in a full sentence."
    assert html_text.main_text("<article>" + "<div>" * 3000 + "<p>Deep text that still counts as a paragraph.</article>")


LONG = "This is the text of the story, which goes on for a while and says what happened, where and to whom."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body class='no-sidebar single-post'><h1>Title</h1><p>{LONG}</p></body>", ["Title", LONG]),
        (f"<div class='post has-comments'><h2>Title</h2><p>{LONG}</p></div><footer>Imprint and privacy</footer>", ["Title", LONG]),
        (f"<nav><a href=/>Home</a></nav><article id='navigation-systems'><p>{LONG}</p></article>", [LONG]),
        (f"<main><section class='main-text social-science'><p>{LONG}</p></section></main><div class='cookie-notice'><p>{LONG}</p></div>", [LONG]),
        (f"<form id=aspnet><div id=page><div class=site-header><a href=/>Home</a></div><p>{LONG}</p><p>{LONG}</p></div></form>", [LONG, LONG]),
        (f"<body class='home with-sidebar comments-open'><article><p>{LONG}</p></article><div class='sidebar-right widget-area'><p>{LONG}</p></div></body>", [LONG]),
        (f"<article><p>{LONG}</p></article><section id=comments><article class=comment><p>{LONG}</p></article><article><p>{LONG}</p></article></section>", [LONG]),
        (f"<article><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, the sum is even and the rest follows from it.</p><p>{LONG}</p></article>", ["Where x=2 holds, the sum is even and the rest follows from it.", LONG]),
        (f"<article><p>{LONG}</p><aside><p>{LONG}</p></aside><p>{LONG}</p></article>", [LONG, LONG]),
        (f"<article><header><h1>Title</h1></header><p>{LONG}<script>if (a < b) c('</p>')</script></p><ul><li>one point of the list<li>another one</ul></article>", ["Title", LONG, "one point of the list", "another one"]),
        (f"<div id=header><p>Site of the paper</p></div><div class='content'><p>{LONG}</p><p>{LONG}</p><table><tr><td>Cell one<td>Cell two</table></div><div id=footer><p>All rights reserved.</p></div>", [LONG, LONG, "Cell one", "Cell two"]),
        (f"<article><p>{LONG}</p><p hidden>{LONG}</p><form><p>{LONG}</p><input><button>Send</button></form></article>", [LONG, LONG]),
    ],
)
def test_main_text_of_written_pages(page, want):
    assert html_text.main_text(page).split("\n\n") == want


def test_deep_pages_take_linear_time():
    start = time.monotonic()
    page = "<article>" + "<div><p>" * 8000 + LONG + "</article>"
    assert html_text.main_text(page) == LONG
    assert html_text.main_text("<article>" + f"<p>{LONG}</p>" * 8000 + "</article>").count(LONG) == 8000
    assert time.monotonic() - start < 8


def test_cut_is_minimal():
    rnd = random.Random(1)
    for _ in range(60):
        n = rnd.randrange(1, 9)
        terminal = [round(rnd.uniform(-3, 3), 2) for _ in range(n)]
        edges = [(i, j, round(rnd.uniform(0, 2), 2)) for i in range(n) for j in range(i) if rnd.random() < 0.5]

        def cost(side, terminal=terminal, edges=edges):
            return sum(max(t, 0) if not s else max(-t, 0) for s, t in zip(side, terminal, strict=True)) + sum(c for i, j, c in edges if side[i] != side[j])

        best = min(cost([m >> i & 1 == 1 for i in range(n)]) for m in range(1 << n))
        assert cost(html_text.minimum_cut(n, terminal, edges)) == pytest.approx(best)


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (None, None, None), (1, "u", PAGE), (2, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(pages).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and sum(r.text == "" for r in got) == 2
    assert html_text.extract(pages.limit(0)).count() == 0
