import random

import pytest
from pyspark.sql import functions as F

from diffquarry.operators import diff, evaluate, gate, intervals, packing, proof, store
from diffquarry.plans import review
from diffquarry.sources import cases, python_code, trees

DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,4 +1,4 @@ head
 one
-two
-three
+TWO
+THREE
 four
\\ No newline at end of file
@@ -10 +10,2 @@
+ten
 eleven
diff --git a/gone.py b/gone.py
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-bye
diff --git a/y.py b/y.py
+++ b/y.py
@@ -0,0 +1,2 @@
+a
+++ z.py
@@ -1 +1 @@
+q
"""


def hunks(spark, text):
    rows = diff.hunks(diff.diff_lines(spark.createDataFrame([(1, text)], "diff_id long, diff string")))
    return rows.orderBy("file_ord", "hunk_ord").collect()


def test_diff_to_hunks(spark):
    got = hunks(spark, DIFF)
    assert [(h.path, h.hunk_ord, h.new_start, h.new_count, h.new_end, h.added, h.removed) for h in got] == [
        ("x.py", 0, 1, 4, 4, [2, 3], 2), ("x.py", 1, 10, 2, 11, [10], 0), ("y.py", 0, 1, 2, 2, [1], 0), ("z.py", 0, 1, 1, 1, [1], 0),
    ]
    assert got[1].old_count == 1 and got[0].lines == [" one", "-two", "-three", "+TWO", "+THREE", " four"]
    assert hunks(spark, "no diff\n@@ -1 +1 @@\n+x") == [] and hunks(spark, "") == []


def test_diff_round_trip(spark):
    rows = diff.hunks(diff.diff_lines(spark.createDataFrame([(1, DIFF)], "diff_id long, diff string")))
    again = [r["diff"] for r in diff.render_files(rows).orderBy("path").collect()]
    assert again[0].split("\n")[:4] == ["--- a/x.py", "+++ b/x.py", "@@ -1,4 +1,4 @@ head", " one"]
    assert [h.added for h in hunks(spark, again[0])] == [[2, 3], [10]]


def sequential(rows, least, most):
    seen, posted, out = {r["fingerprint"] for r in rows if r["in_memory"]}, [], {}
    for r in rows:
        sure = min(1.0, r["confidence"]) if r["proof"] else min(1.0, r["confidence"]) * r["verifier"] if r["is_real"] else 0.0
        if not r["quote_ok"]:
            out[r["ord"]] = "hallucination"
        elif not r["loc_ok"]:
            out[r["ord"]] = "bad_location"
        elif r["fingerprint"] in seen:
            out[r["ord"]] = "dedupe"
        elif not r["proof"] and sure < least:
            out[r["ord"]] = "low_confidence"
        else:
            seen.add(r["fingerprint"])
            posted.append((-{"critical": 4, "high": 3, "medium": 2, "low": 1}[r["severity"]] * sure, r["ord"]))
    for place, (_, o) in enumerate(sorted(posted)):
        out[o] = "posted" if place < most else "ranked_out"
    return out


def test_cascade_is_the_sequential_gate(spark):
    rnd, rows, want = random.Random(3), [], {}
    for case in range(40):
        made = []
        memory = {f"f{rnd.randrange(6)}"}
        for i in range(rnd.randrange(1, 14)):
            f = f"f{rnd.randrange(6)}"
            made.append({"case": case, "ord": i, "fingerprint": f, "quote_ok": rnd.random() < 0.8, "loc_ok": rnd.random() < 0.8, "in_memory": f in memory, "proof": rnd.choice([None, "", "", "p"]), "severity": rnd.choice(["critical", "high", "medium", "low"]), "confidence": round(rnd.uniform(0.5, 1.3), 2), "is_real": rnd.random() < 0.8, "is_actionable": True, "verifier": round(rnd.uniform(0.6, 1), 2)})
        rows += made
        want |= {(case, o): s for o, s in sequential(made, 0.7, 3).items()}
    df = spark.createDataFrame(rows, "case int, ord int, fingerprint string, quote_ok boolean, loc_ok boolean, in_memory boolean, proof string, severity string, confidence double, is_real boolean, is_actionable boolean, verifier double")
    verdicts = gate.cascade(df, ["case"], "ord", 0.7, 3)
    got = {(r.case, r.ord): r.stage or ("posted" if r.posted else "ranked_out") for r in verdicts.collect()}
    assert got == want
    drops = gate.breakdown(verdicts, ["case"]).agg(F.sum("n")).first()[0]
    assert drops == sum(s != "posted" for s in want.values())


def test_quotes(spark):
    needles = spark.createDataFrame([("a = b + c",), ("short",), ("not there at all",), (None,), ("  a=b+c ",)], "quoted_code string")
    evidence = spark.createDataFrame([("x\n a  =  b +c\n",), (None,), ("",)], "text string")
    assert sorted(r[0] for r in gate.quotes(needles, evidence).collect()) == []
    long = spark.createDataFrame([("value = b + c",), ("short",), (None,)], "quoted_code string")
    text = spark.createDataFrame([("x\n value  =  b +c\n" + "y" * 500,), (None,)], "text string")
    assert [r[0] for r in gate.quotes(long, text).collect()] == ["value = b + c"]


def test_packing_is_greedy(spark):
    rnd = random.Random(5)
    rows = [(g, i, rnd.randrange(1, 60), rnd.randrange(1, 9), rnd.random() < 0.1) for g in range(12) for i in range(rnd.randrange(1, 20))]
    df = spark.createDataFrame(rows, "g int, i int, size int, short int, must boolean")
    want = {}
    for g in range(12):
        used = 0
        for _, i, size, short, must in sorted((r for r in rows if r[0] == g), key=lambda r: (not r[4], r[1])):
            kept = "whole" if must or used + size <= 100 else "short" if used + short <= 100 else "dropped"
            used += {"whole": size, "short": short, "dropped": 0}[kept]
            want[g, i] = kept
    assert {(r.g, r.i): r.kept for r in packing.pack(df, ["g"], ["i"], "size", "short", "must", 100).collect()} == want
    bins = {(r.g, r.i): r.bin for r in packing.bins(df, ["g"], ["i"], "size", 80).collect()}
    for g in range(12):
        at, used = 0, 0
        for _, i, size, *_ in sorted(r for r in rows if r[0] == g):
            if used and used + size > 80:
                at, used = at + 1, 0
            used += size
            assert bins[g, i] == at


def test_enclosing_and_hops(spark):
    spans = spark.createDataFrame([("a", 0, 1, 100), ("a", 1, 10, 50), ("a", 2, 20, 30), ("b", 0, 1, 5)], "p string, ord int, s int, e int")
    points = spark.createDataFrame([("a", 25), ("a", 60), ("a", 200), ("b", 5)], "p string, at int")
    for bucket in (None, 7):
        inner = intervals.enclosing(points, spans, ["p"], "at", "s", "e", ["ord"], bucket=bucket)
        assert sorted((r.p, r.at, r.ord) for r in inner.collect()) == [("a", 25, 2), ("a", 60, 0), ("b", 5, 0)]
    first = intervals.enclosing(points, spans, ["p"], "at", "s", "e", ["ord"], innermost=False)
    assert sorted((r.at, r.ord) for r in first.collect()) == [(5, 0), (25, 0), (60, 0)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    got = intervals.k_hops(spark.createDataFrame([(1,)], "node long"), edges, 3)
    assert sorted((r.node, r.hop) for r in got.collect()) == [(2, 1), (3, 2), (4, 3)]


def test_store(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, k string, v string")
    new = spark.createDataFrame([(9, "b", "z"), (10, "c", "w")], "id long, k string, v string")
    assert sorted(map(tuple, store.upsert(old, new, ["k"], ("id",)).collect())) == [(1, "a", "x"), (2, "b", "z"), (10, "c", "w")]
    assert sorted(r.v for r in store.replace(old, new, ["k"]).collect()) == ["w", "x", "z"]
    ids = store.assign_ids(spark.range(100).select((F.col("id") * 7 % 100).alias("n")), ["n"], 5)
    assert sorted((r.n, r.id) for r in ids.collect()) == [(i, i + 6) for i in range(100)]
    findings = spark.createDataFrame([(1, 1, "f", True), (2, 1, "g", False), (3, 1, "f", True)], "id long, review_id long, fingerprint string, posted boolean")
    feedback = spark.createDataFrame([(1, "reaction", 2), (2, "reaction", 1)], "finding_id long, kind string, count int")
    again = spark.createDataFrame([(7, 1, "f", True), (8, 1, "f", True), (9, 1, "g", False)], "id long, review_id long, fingerprint string, posted boolean")
    assert [tuple(r) for r in store.reattach(feedback, findings, again, ["review_id"]).collect()] == [(7, "reaction", 2)]


def test_stats_of_an_empty_and_a_small_store(spark):
    reviews = spark.sql("select 1L id, 'r' repo, timestamp'2024-01-10' started_at, false review_incomplete union all select 2L, 'r', timestamp'2023-01-01', true")
    findings = spark.createDataFrame([(1, 1, "c", True, None, "p"), (2, 1, "c", False, None, None), (3, 1, "d", False, "dedupe", None), (4, 2, "c", True, None, None)], "id long, review_id long, category string, posted boolean, dropped_at string, proof string")
    feedback = spark.createDataFrame([(1, "reaction", "github:+1"), (1, "reaction", "github:+1"), (1, "resolved", "github:")], "finding_id long, kind string, source string")
    now = F.lit("2024-01-12").cast("timestamp")
    got = store.stats(reviews, findings, feedback, "r", 30, now).first().asDict(recursive=True)
    assert got["reviews"] == {"total": 1, "incomplete": 0} and got["findings"] == {"posted": 1, "proven": 1, "dropped": {"ranked_out": 1, "dedupe": 1}}
    assert got["by_category"] == {"c": {"posted": 1, "thumbs_up": 1, "thumbs_down": 0, "resolved": 1}}
    none = store.stats(reviews, findings, feedback, "other", 30, now).first().asDict(recursive=True)
    assert none["reviews"]["total"] == 0 and none["by_category"] == {}


BINDINGS = [
    ("a, b", 2, [], None), ("a, b", 3, [], "passes 3 positional arguments, but f takes 2"), ("a, b=1", 3, [], "passes 3 positional arguments, but f takes at most 2"),
    ("a", 1, ["z"], "passes unknown keyword 'z'"), ("a", 1, ["a"], "passes 'a' twice, positionally and by keyword"), ("a, b, c", 1, [], "does not pass required arguments 'b', 'c'"),
    ("a, *r", 5, [], None), ("a, **k", 1, ["z"], None), ("a, /, b", 1, ["a"], "passes unknown keyword 'a'"), ("*, k", 0, [], "does not pass required argument 'k'"), ("*, k", 0, ["k"], None),
    ("a, b", 1, ["b", "z"], "passes unknown keyword 'z'"), ("a, b", 1, ["a", "z"], "passes 'a' twice, positionally and by keyword"), ("a, /, *, b=2, **k", 1, ["a", "b"], None), ("", 1, [], "passes 1 positional argument, but f takes 0"),
]


def test_binding(spark):
    rows = [(i, python_code.read_python(f"def f({params}): pass").definitions[0]["params"], n, keywords) for i, (params, n, keywords, _) in enumerate(BINDINGS)]
    df = spark.createDataFrame(rows, "i int, params array<struct<name:string,kind:string,has_default:boolean>>, n int, keywords array<string>")
    got = {r.i: r.fault for r in df.select("i", proof.binding_fault(F.lit("f"), F.col("params"), F.col("n"), F.col("keywords")).alias("fault")).collect()}
    assert [got[i] for i in range(len(BINDINGS))] == [b[3] for b in BINDINGS]


def test_proof_of_a_broken_caller(spark):
    src = lambda **files: spark.createDataFrame(list({k.replace("__", "/") + ".py": v for k, v in files.items()}.items()), "path string, text string")
    head = src(pkg__mod="def f(a, b):\n    return a\n\ndef ok(a): return f(a, 1)\n", use="from pkg.mod import f\nx = f(1)\ny = f(*z)\n", other="def g(): return f(2)\n", bad="def (")
    base = src(pkg__mod="def f(a):\n    return a\n\ndef ok(a): return f(a, 1)\n")
    files = python_code.parsed(head)
    assert files.count() == 3
    broken = proof.broken_calls(proof.signature_changes(files, python_code.parsed(base)), files)
    assert [(r.at_path, r.line, r.fault) for r in broken.collect()] == [("use.py", 2, "does not pass required argument 'b'")]
    added = spark.createDataFrame([("pkg/mod.py", 1)], "path string, line int")
    found = proof.proof_findings(broken, added, review.source_lines(head)).first()
    assert (found.file, found.line, found.quoted_code) == ("pkg/mod.py", 1, "def f(a, b):") and "use.py:2" in found.title


def test_grading(spark):
    want = spark.createDataFrame([("c", 0, "a", 10, ["null"]), ("c", 1, "a", 10, []), ("c", 2, "b", 5, ["x"]), ("c", 3, "z", 1, [])], "case string, ord int, file string, line int, words array<string>")
    got = spark.createDataFrame([("c", 0, "a", 11, "A NULL value", True), ("c", 1, "a", 12, "other", False), ("c", 2, "b", 5, "nope", True), ("c", 3, "q", 1, "extra", True)], "case string, ord int, file string, line int, title string, posted boolean")
    graded = evaluate.grade(want, got)
    assert sorted(((r.ord if r.ord is not None else -1, r.bucket, r.matched) for r in graded.collect()), key=str) == [(-1, "false_positive", 3), (0, "caught", 0), (1, "gated", 1), (2, "missed", None), (2, "near_miss", 2), (3, "missed", None)]
    total = evaluate.totals(graded).first()
    assert (total.catch_rate, total.fp_rate, total.expected) == (0.25, 0.25, 4)


def test_answers(spark):
    body = '```json\n{"findings":[{"file":"a","line":3,"severity":"HIGH","confidence":1.7,"title":"t"},{"file":"b","severity":"low"},{"file":"c","line":"x","severity":"low","confidence":1,"title":"t"}]}\n```'
    rows = spark.createDataFrame([(body,), ("not json",)], "a string")
    got = [r[0] for r in rows.select(cases.parse_findings(F.col("a"))).collect()]
    assert [(f.file, f.line, f.severity, f.confidence) for f in got[0]] == [("a", 3, "high", 1.0)] and got[1] == []
    answers = spark.createDataFrame([('[{"match":"foo","response":"1"},{"response":"2"}]', "a foo"), ('[{"match":"foo","response":"1"},{"response":"2"}]', "bar"), ("{}", "x")], "s string, p string")
    assert [r[0] for r in answers.select(cases.replay(cases.recorded_answers(F.col("s")), F.col("p"))).collect()] == ["1", "2", "{}"]


def test_tree_source(spark, tmp_path):
    for p, t in {"a/__init__.py": "x", "a/_private/m.py": "y", "node_modules/z.py": "n", "b.txt": "n", "build.py": "k"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    assert sorted(r.path for r in trees.read_tree(spark, str(tmp_path)).collect()) == ["a/__init__.py", "a/_private/m.py", "build.py"]


def test_review_plan(spark):
    diffs = spark.createDataFrame([(1, "+++ b/m.py\n@@ -1,2 +1,2 @@\n-old_value = 1\n+new_value = 2\n keep\n")], "diff_id long, diff string")
    sources = spark.createDataFrame([("m.py", "new_value = 2\nkeep\n")], "path string, text string")
    findings = spark.createDataFrame([(1, 0, "m.py", 1, "c", "high", 0.9, "t", "new_value  = 2", None), (1, 1, "m.py", 9, "c", "high", 0.9, "t", "new_value = 2", None), (1, 2, "m.py", 1, "c", "high", 0.9, "t", "invented = 3", None), (1, 3, "m.py", 1, "c", "low", 0.9, "t", "new_value = 2", None)], "diff_id long, ord int, file string, line int, category string, severity string, confidence double, title string, quoted_code string, proof string")
    verdicts = spark.createDataFrame([(1, 0, True, True, 0.9), (1, 3, True, True, 0.9)], "diff_id long, ord int, is_real boolean, is_actionable boolean, verifier double")
    memory = spark.createDataFrame([], "diff_id long, fingerprint string")
    got = {r.ord: (r.stage, r.posted) for r in review.review(diffs, sources, findings, verdicts, memory).collect()}
    assert got == {0: (None, True), 1: ("bad_location", False), 2: ("hallucination", False), 3: ("dedupe", False)}


def test_context_follows_callers(spark):
    sources = spark.createDataFrame([("a.py", "def base(x, y):\n    return x\n"), ("b.py", "def mid(z):\n    return base(z)\n"), ("c.py", "def top(q):\n    return mid(q)\n")], "path string, text string")
    old = spark.createDataFrame([("a.py", "def base(x):\n    return x\n")], "path string, text string")
    chunks = python_code.chunks(python_code.parsed(sources), sources)
    lines = review.source_lines(sources)
    added = spark.createDataFrame([("a.py", 1)], "path string, line int")
    changed = review.signature_changed(review.changed_chunks(added, chunks), python_code.chunks(python_code.parsed(old), old))
    index = review.call_index(lines)
    callees = review.callees(changed, added, lines, review.definition_index(lines))
    blocks = review.context_blocks(chunks, changed, index, callees)
    assert sorted((r.path, r.tier, r.must_include) for r in blocks.collect()) == [("a.py", 0, True), ("b.py", 1, True), ("c.py", 3, False)]
    kept = review.packed_context(blocks.withColumn("g", F.lit(1)), ["g"], 1)
    assert {r.path: r.kept for r in kept.collect()} == {"a.py": "whole", "b.py": "whole", "c.py": "dropped"}
