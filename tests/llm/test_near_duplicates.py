import os
import random
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from diffquarry.llm import common, line_dedup, minhash, paragraph_dedup, simhash
from diffquarry.llm.common import shared_dir
from diffquarry.llm.components import components


def closed(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(300, j) for j in range(301, 360)] + [(5, None), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    pairs = [(a, b) for a, b in links if b is not None and a != b]
    assert got == closed({x for p in pairs for x in p}, pairs)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(spark):
    rnd = random.Random(4)
    base = [" ".join(rnd.choice(["one", "Two", "three", "four", "fïve", "six"]) for _ in range(rnd.randrange(0, 60))) for _ in range(60)]
    texts = base + [t + " end" for t in base[:30]] + base[:20] + [None, "", "a", "a b", "A\tb\x0b", "x " * 40000]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, base[0]), (None, None), (3000, base[5]), (3000, base[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component", F.lit(0))
    got = simhash.near_duplicates(docs).collect()
    prints = {t: plain_fingerprint(t) for _, t in rows}
    fps = sorted(set(prints.values()))
    root = closed(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3])
    least = defaultdict(lambda: None)
    for k, t in rows:
        r = root[prints[t]]
        if k is not None and (least[r] is None or k < least[r]):
            least[r] = k
    want = sorted((str(k), prints[t], str(least[root[prints[t]]])) for k, t in rows)
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component)) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {v for v in least.values() if v is not None} | {None}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_posting_list(spark, monkeypatch):
    """Fingerprints that crowd one list are linked by blocks as by all pairs."""
    rnd = np.random.default_rng(2)
    centre = int(rnd.integers(1 << 62))
    fps = {centre}
    while len(fps) < 400:
        fps.add(centre ^ sum(1 << int(b) for b in rnd.choice(64, rnd.integers(1, 7), replace=False)))
    monkeypatch.setattr(simhash, "BLOCK", 100)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = dict(map(tuple, components(links).collect()))
    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 3]
    want = closed(signed, near)
    assert {n: got.get(n, n) for n in signed} == want


def brute(texts, normal, shingles):
    units = defaultdict(list)
    for d, t in texts:
        for i, line in enumerate((t or "").split("\n")):
            if line := normal(line):
                units[line].append((d, i))
    names = list(units)
    sets = [set(shingles(u)) for u in names]
    links = [(i, j) for i in range(len(names)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = closed(range(len(names)), links)
    groups = defaultdict(list)
    for i, u in enumerate(names):
        groups[root[i]] += units[u]
    return {p: min(g) for g in groups.values() for p in g}


def variants(seed, n, words):
    rnd = random.Random(seed)
    lines = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(words)) for _ in range(12)]
    out = []
    for i in range(n):
        part = []
        for line in rnd.sample(lines, 4):
            w = line.split()
            if rnd.random() < 0.7:
                w[rnd.randrange(len(w))] = f"new{rnd.randrange(40)}"
            part.append(" ".join(w))
        out.append((i, "\n".join(part + rnd.sample(["tiny", "", "A", "  spaced  out "], 2))))
    return out + [(n, None), (n + 1, ""), (n + 2, "x" * 3000 + "\n" + "x" * 2990)]


def test_lines_against_all_pairs(spark):
    texts = variants(6, 50, 14)
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("line", F.lit("clash")).withColumn("unit", F.lit(0))
    got = {(r.doc_id, r.line): (r.first_key, r.first_line) for r in line_dedup.line_classes(docs).collect()}
    want = brute(texts, lambda x: x.strip(" \t\n\x0b\x0c\r").lower(), lambda u: [u[i : i + 8] for i in range(max(1, len(u) - 7))])
    assert got.keys() == want.keys() and got == want
    cut = line_dedup.drop_lines(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    kept = {k for k, v in got.items() if k == v}
    for r in cut.collect():
        if r.text:
            before = dict(texts)[r.doc_id].split("\n")
            assert r.text.split("\n") == [x for i, x in enumerate(before) if (r.doc_id, i) in kept or not x.strip()]


def test_paragraphs_against_all_pairs(spark):
    texts = variants(8, 50, 60)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.paragraph): (r.first_key, r.first_paragraph) for r in paragraph_dedup.paragraph_classes(docs).collect()}
    shingles = lambda u: [" ".join(u.split()[i : i + 5]) for i in range(max(1, len(u.split()) - 4))]
    assert got == brute(texts, lambda x: " ".join(x.lower().split()), shingles)


def test_units_with_null_keys_and_repeats(spark):
    docs = spark.createDataFrame([(None, "same line here"), (5, "same line here"), (5, "same line here"), (None, "alone in the dark")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.first_key), r.keep) for r in line_dedup.line_classes(docs).collect())
    assert got == [("5", "5", True), ("5", "5", True), ("None", "5", False), ("None", "None", True)]
    assert line_dedup.line_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_lines_against_all_pairs(spark):
    """Lines of 1 to 10 words and lines without blanks, with edits at either end and inside."""
    rnd, rows = random.Random(12), []
    for i in range(600):
        line = (" " if i % 4 else "").join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(3, 9))) for _ in range(rnd.randrange(1, 11)))
        at = rnd.randrange(len(line))
        rows += [line, line + rnd.choice("xyz"), rnd.choice("xyz") + line, line[:at] + "q" + line[at + 1 :], line[:-1]]
    texts = list(enumerate(rows))
    got = {(r.doc_id, r.line): (r.first_key, r.first_line) for r in line_dedup.line_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    by_family = [brute(texts[i : i + 5], str.strip, lambda u: [u[j : j + 8] for j in range(max(1, len(u) - 7))]) for i in range(0, len(texts), 5)]
    want = {k: v for part in by_family for k, v in part.items()}
    assert got.keys() == want.keys() and sum(got[k] != want[k] for k in want) <= 0.005 * len(want)


def test_repetitive_units_against_all_pairs(spark):
    """Texts of few distinct shingles that repeat often, in different numbers."""
    lines = [c * n for c in "-=*" for n in (7, 8, 60, 120, 500)] + ["-=" * n for n in (30, 31, 400)] + ["ab cd ef gh " * n for n in (8, 60, 300)]
    sentence = "this page was left empty on purpose by the publisher "
    units = [sentence * n for n in (2, 5, 20, 200)] + ["buy now " * n for n in (10, 90, 700)] + [sentence * 40 + "and one end"]
    texts = list(enumerate(lines + units))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.line): (r.first_key, r.first_line) for r in line_dedup.line_classes(docs).collect()}
    assert got == brute(texts, str.strip, lambda u: [u[i : i + 8] for i in range(max(1, len(u) - 7))])
    got = {(r.doc_id, r.paragraph): (r.first_key, r.first_paragraph) for r in paragraph_dedup.paragraph_classes(docs).collect()}
    assert got == brute(texts, lambda x: " ".join(x.split()), lambda u: [" ".join(u.split()[i : i + 5]) for i in range(max(1, len(u.split()) - 4))])


def test_recall_by_length(spark):
    """Pairs whose exact Jaccard is between 0.8 and 0.85, by length of line: nearly all end in one class."""
    rnd, rows, kinds = random.Random(31), [], []
    shingles = lambda u: {u[i : i + 8] for i in range(max(1, len(u) - 7))}
    for kind, (least, most) in enumerate(((1, 6), (8, 12), (20, 60))):
        made = 0
        while made < 200:
            line = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(4, 14))) for _ in range(rnd.randrange(least, most + 1)))
            other = line
            for _ in range(rnd.randrange(1, 9)):
                at = rnd.randrange(max(1, len(other)))
                other = rnd.choice((other[:at] + rnd.choice("0123456789") + other[at + rnd.randrange(2) :], other[rnd.randrange(3) :], other + rnd.choice("0123456789")))
            x, y = shingles(line), shingles(other)
            if 0.8 <= len(x & y) / len(x | y) <= 0.85:
                rows += [(2 * len(kinds), line), (2 * len(kinds) + 1, other)]
                kinds.append(kind)
                made += 1
    got = {r.doc_id: r.first_key for r in line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in range(3):
        assert np.mean([got[2 * i] == got[2 * i + 1] for i in range(len(kinds)) if kinds[i] == kind]) >= 0.95


def hot_variants(n, words, edits, seed):
    """Variants of one line that mostly lie below the threshold of it and of each other."""
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(words)]
    out = [" ".join(base)] * 3
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            at = rnd.randrange(len(w))
            w[at : at + 1] = rnd.choice(([], [f"{rnd.randrange(10**6)}"], [w[at], f"{rnd.randrange(10**6)}"]))
        out.append(" ".join(w))
    return list(enumerate(out))


def test_hot_bucket(spark, monkeypatch):
    """A crowd of variants in the same buckets is classed as by all pairs, and few of its pairs are compared."""
    monkeypatch.setattr(minhash, "HOT", 2)
    monkeypatch.setattr(minhash, "PARTS", 3)
    compared, whole = [], minhash._compared

    def counted(pairs, *a, **k):
        made = whole(pairs, *a, **k)
        compared.append(made.count())
        return made

    monkeypatch.setattr(minhash, "_compared", counted)
    texts = hot_variants(500, 60, 4, 3)
    got = {(r.doc_id, r.line): (r.first_key, r.first_line) for r in line_dedup.line_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    want = brute(texts, str.strip, lambda u: [u[i : i + 8] for i in range(max(1, len(u) - 7))])
    assert sum(got[k] != want[k] for k in want) <= 0.01 * len(want)
    assert sum(compared) < 30 * len(texts)


def test_parts_go_once_they_are_read(spark):
    """Keys, buckets, comparisons and posting lists don't stay in the shared folder; the result is read after they are gone."""
    folder = f"{shared_dir(spark)}/diffquarry"
    there = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    texts = hot_variants(60, 60, 4, 3)
    found = line_dedup.line_classes(spark.createDataFrame(texts, "doc_id long, text string"))
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - there}
    assert left and not left & {"signed", "keyed", "members", "buckets", "tokens", "postings", "texts", "pairs"}
    assert found.count() == len(texts)


def spied(monkeypatch):
    """Rows of each table that is written, by name."""
    wrote, real = defaultdict(list), common.materialize

    def spy(df, name, *a, **how):
        wrote[name].append(df.count())
        return real(df, name, *a, **how)

    for module in (common, minhash, paragraph_dedup):
        monkeypatch.setattr(module, "materialize", spy)
    return wrote


def test_lines_are_shuffled_in_parts(spark, monkeypatch):
    """Different lines don't come from one shuffle of all lines; equal ones are in one part, and ids differ."""
    wrote = spied(monkeypatch)
    docs = spark.createDataFrame([(i, "\n".join(f"line {j} of {i % 40} texts" for j in range(i % 40, i % 40 + 6))) for i in range(120)], "doc_id long, text string")
    places, units = minhash.split_units(docs, "doc_id", "text", line_dedup.normal_line)
    rows = units.collect()
    assert places.count() == 720 and len(rows) == len({r.id for r in rows}) == len({r.text for r in rows}) == 240 and {r.n for r in rows} == {3}
    assert len(wrote["units"]) > 1 and sum(wrote["units"]) == 240 and max(wrote["units"]) < 192


def test_windows_are_shuffled_in_parts(spark, monkeypatch):
    wrote = spied(monkeypatch)
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 20}x{j}" for j in range(90))) for i in range(40)], "doc_id long, text string")
    found = paragraph_dedup.repeated_windows(docs).collect()
    assert {(r.doc_id, r.first_key, r.keep) for r in found} == {(i, i % 20, i < 20) for i in range(40)}
    assert len(wrote["repeats"]) > 1 and sum(wrote["repeats"]) == len(found) and max(wrote["repeats"]) < 0.8 * len(found)


def test_no_keys_are_written(spark, monkeypatch):
    """What stands in the shared folder while lines are classed is a small multiple of the lines: no key of theirs is written."""
    folder = f"{shared_dir(spark)}/diffquarry"
    there = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    written, whole = [], minhash.materialize

    def sized(df, name, *a, **k):
        made = whole(df, name, *a, **k)
        new = set(os.listdir(folder)) - there
        written.append((name, sum(os.path.getsize(f"{d}/{f}") for x in new for d, _, files in os.walk(f"{folder}/{x}") for f in files)))
        return made

    monkeypatch.setattr(minhash, "materialize", sized)
    rnd = random.Random(17)
    rows = [(i, "\n".join(" ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(6)) for _ in range(40))) for i in range(100)]
    found = line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert written[0][0] == "lines" and max(n for _, n in written) <= 4 * written[0][1]
    assert found.filter("keep and members = 1").count() == 4000


def test_lines_are_not_sorted(spark, monkeypatch):
    """Lines are brought together by hashing, not by sorting their texts; keys that are compiled are those of band_keys."""
    plans, real = [], common.materialize

    def spy(df, name, *a, **how):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name, *a, **how)

    for module in (common, minhash):
        monkeypatch.setattr(module, "materialize", spy)
    rnd = random.Random(23)
    lines = [" ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)) for n in range(1, 60)] + ["x", "-" * 90, "\u4e2d" * 30, "d" * 8 + "g" * 8]
    docs = spark.createDataFrame([(i, "\n".join(lines[i:])) for i in range(3)], "doc_id long, text string")
    places, units = minhash.split_units(docs, "doc_id", "text", line_dedup.normal_line)
    assert units.count() == len(lines) and not [name for name, plan in plans if name == "units" and "SortAggregate" in plan]
    hashes, few = minhash.character_hashes(F.col("text"), 8), minhash.anchored_hashes(F.col("text"), 8)
    want = units.select("id", "n", F.size(F.array_distinct(few)).alias("m"), minhash.band_keys(hashes, 15, 3).alias("a"), minhash.band_keys(few, 15, 3).alias("f")).collect()
    want = sorted((r.id, r.n, k) for r in want for k in (r.a if r.m < 16 else []) + (r.f if r.m >= 8 else []))
    assert sorted(map(tuple, minhash.sampled_keys(units, 8, 15, 3).collect())) == want


def test_few_keys_find_pairs(spark):
    """Sets of 24 hashes or more have 8 keys at most, smaller ones 16; pairs of sets at 0.8 nearly all have one in common."""
    rnd, rows = random.Random(41), []
    for n in (10, 15, 20, 25, 40, 150):  # of a pair's union, 0.8 is common
        for _ in range(300):
            u = [rnd.randrange(-(1 << 63), 1 << 63) for _ in range(n)]
            common, one = n * 4 // 5, n * 9 // 10
            rows.append((n, u[:one], u[:common] + u[one:]))
    sets = spark.createDataFrame(rows, "n int, x array<long>, y array<long>")
    got = sets.select("n", F.size("x").alias("size"), minhash.band_keys(F.col("x"), 15, 3).alias("x"), minhash.band_keys(F.col("y"), 15, 3).alias("y")).collect()
    assert max(len(r.x) for r in got if r["size"] >= 24) <= 8 and max(len(r.x) for r in got) <= 16
    assert all(np.mean([bool(set(r.x) & set(r.y)) for r in got if r.n == n]) >= 0.985 for n in (10, 15, 20, 25, 40, 150))
    assert minhash.tune_spread(0.8, 3, 0.99) == minhash.tune(0.8, 3, 0.99) == 15
    assert 1 - (1 - 0.5**3) ** ((minhash.tune_spread(0.5, 3, 0.99) + 1) // 2) >= 0.99


def test_keys_are_not_sorted(spark, monkeypatch):
    """Buckets of several members are found by hashing, from one shuffle of all keys; pivots are the most frequent members."""
    made, real = [], minhash.materialize

    def spy(df, name, *a, **how):
        if name == "buckets":
            made.append((df.collect(), df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name, *a, **how)

    monkeypatch.setattr(minhash, "materialize", spy)
    rnd = random.Random(43)
    rows = [(i, rnd.randrange(1, 4), rnd.randrange(900)) for i in range(1200)]
    minhash._pivots(spark.createDataFrame(rows, "id long, n long, band long"))
    (got, plan), buckets = made[0], defaultdict(list)
    for i, n, band in rows:
        buckets[band].append((-n, i))
    assert sorted(map(tuple, got)) == sorted((b, i, -n, min(m)[1], len(m) > minhash.SMALL) for b, m in buckets.items() if len(m) > 1 for n, i in m)
    assert "ShuffledHashJoin" in plan and "ReusedExchange" in plan


def passages(seed):
    """Texts of which some share 50 to 120 words somewhere in their lines, and those that do."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8)))
    shared = [[word() for _ in range(rnd.randrange(50, 120))] for _ in range(12)]
    rows, planted = [], set()
    for i in range(120):
        words = [word() for _ in range(rnd.randrange(0, 300))]
        if i % 3 == 0:
            at = rnd.randrange(len(words) + 1)
            words[at:at] = [w.upper() if rnd.random() < 0.1 else w for w in shared[i // 3 % 12]]
            planted.add(i)
        rows.append((i, "".join(w + rnd.choice([" ", " ", " ", "  ", "\n"] if i % 2 else " ") for w in words)))
    return rows, planted


def test_passages_inside_lines(spark):
    rows, planted = passages(5)
    odd = [(500, None), (501, ""), (502, "tiny\ntiny"), (None, "a b c"), (503, "x " * 70000), (504, "x " * 70000)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("at", F.lit("clash")).withColumn("k", F.lit("clash"))
    got = {r.doc_id: r for r in paragraph_dedup.repeats(docs).collect()}
    assert len(got) == len(rows) + len(odd)
    assert {k for k, r in got.items() if r.repeated} == planted | {503, 504}
    first = {min(i for i in planted if i // 3 % 12 == g) for g in range(12)}
    assert {k for k in planted if got[k].removed_words} == planted - first
    assert all(min(i for i in planted if i // 3 % 12 == k // 3 % 12) in got[k].kept_in for k in planted - first)
    assert (got[502].n_paragraphs, got[502].n_repeated, got[502].n_removed, got[502].repeated) == (2, 2, 1, False)
    assert (got[500].n_paragraphs, got[500].kept_in, got[501].passage_words) == (0, [], 0)
    kept = paragraph_dedup.drop_repeats(docs)
    assert kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    by_id = dict(rows + odd)
    for k in got:
        if not got[k].n_removed and not got[k].removed_words:
            assert texts[k] == by_id[k]
        elif not got[k].n_removed:
            assert len(texts[k].split()) == len(by_id[k].split()) - got[k].removed_words
    assert texts[502] == "tiny" and texts[504] == ""
    assert paragraph_dedup.repeats(docs.limit(0)).count() == 0


def test_windows_of_shared_passages():
    """Any shared run of LEAST words has a window that both texts take; windows never cross texts."""
    rnd = random.Random(3)
    word = lambda: rnd.randrange(1 << 20)
    for _ in range(200):
        run, texts, starts = [word() for _ in range(50)], [], []
        for _ in range(2):
            before = [word() for _ in range(rnd.randrange(0, 90))]
            texts.append(before + run + [word() for _ in range(rnd.randrange(0, 90))])
            starts.append(len(before))
        texts.insert(1, [word() for _ in range(rnd.randrange(0, 60))])
        sizes = np.array([len(t) for t in texts])
        got = paragraph_dedup.window_starts(np.array(sum(texts, []), np.uint64), sizes, 20, 50).tolist()
        begins = np.cumsum(sizes) - sizes
        assert all(any(b <= g and g + 20 <= b + n for b, n in zip(begins, sizes, strict=True)) for g in got)
        assert all((len(t) < 20) == (not any(b <= g < b + len(t) for g in got)) for t, b in zip(texts, begins, strict=True))
        taken = [{g - b - s for g in got if 0 <= g - b - s <= 30} for b, s in ((begins[0], starts[0]), (begins[2], starts[1]))]
        assert taken[0] & taken[1]
    assert paragraph_dedup.window_starts(np.zeros(19, np.uint64), np.array([19]), 20, 50).tolist() == []


def test_signatures_by_hand():
    rnd = random.Random(4)
    lines = [[rnd.randrange(30) for _ in range(rnd.randrange(1, 40))] for _ in range(80)] + [[7] * 60, [7] * 9]
    flat = np.array(sum(lines, []), np.uint64)
    line, hashes = paragraph_dedup.shingles(flat, np.array([len(x) for x in lines]), 5)
    ends, keys = paragraph_dedup.signatures(line, hashes, len(lines), 15, 3)
    mix = lambda parts, salt: int(paragraph_dedup.mixed([np.array([p], np.uint64) for p in parts], salt).view(np.int64)[0])
    at = 0
    for i, words in enumerate(lines):
        grams = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))}
        assert len(set(hashes[line == i].tolist())) == len(grams)
        v = sorted(set(hashes[line == i].tolist()))
        m = min(len(v), 15)
        want = [mix(v[j : j + 3], 1) for j in range(m - 2)]
        if len(v) <= 15:
            want += [mix([v[(j + t) % m] if t < m else 0 for t in range(3)], 2) for j in range(m)]
        assert sorted(keys[at : ends[i]].tolist()) == sorted(want)
        at = ends[i]
    assert at == len(keys)
