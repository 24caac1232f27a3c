"""Rendering, costs, settings, evaluation reports and what the store numbers, against results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from diffquarry.functions import calls, text
from diffquarry.operators import costs, evaluate, render, store
from diffquarry.plans import settings

VERDICTS = "review string, ord int, fingerprint string, file string, line int, category string, severity string, confidence double, title string, quoted_code string, proof string, stage string, rank int, posted boolean"


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [
        ("r", 0, "f0", "b.py", 3, "correctness", "high", 0.9, "Second", "x = 1", None, None, 2, True),
        ("r", 1, "f1", "a.py", 7, "security", "critical", 1.0, "First", "y = 2", "parsed", None, 1, True),
        ("r", 2, "f2", "b.py", 9, "correctness", "low", 0.8, "Third", "z", None, None, 3, True),
        ("r", 3, "f3", "c.py", 1, "correctness", "low", 0.1, "Gone", "q", None, "low_confidence", None, False),
        ("r", 4, "f4", "c.py", 2, "correctness", "low", 0.9, "Beyond", "q", None, None, 4, False),
    ]
    return spark.createDataFrame(rows, VERDICTS)


def test_verdict_json(verdicts):
    got = {r.ord: json.loads(r.json) for r in render.verdict_json(verdicts).collect()}
    assert got[1]["dropped_at"] is None and got[3]["dropped_at"] == "low_confidence" and got[4]["dropped_at"] == "ranked_out"
    assert list(got[0]) == ["fingerprint", "file", "line", "category", "severity", "confidence", "title", "quoted_code", "proof", "dropped_at"]
    assert got[0]["proof"] is None and got[1]["proof"] == "parsed"


def test_outcome_json(verdicts):
    got = json.loads(render.outcome_json(verdicts, ["review"]).first().json)
    assert [f["title"] for f in got["findings"]] == ["First", "Second", "Third"]
    assert [f["title"] for f in got["dropped"]] == ["Gone", "Beyond"]


def test_markdown(verdicts):
    got = render.markdown(verdicts.filter("posted"), ["review"]).first().text
    assert got == "### `a.py`\n- **CRITICAL** line 7: First\n\n### `b.py`\n- **HIGH** line 3: Second\n- **LOW** line 9: Third"


def test_aligned(spark):
    rows = spark.createDataFrame([("g", "long name", "2"), ("g", "ab", "1"), ("h", "x", "3")], "g string, n string, t string")
    got = {r.g: r.report for r in render.aligned(rows, ["g"], "n", "t").collect()}
    assert got == {"g": "ab         1\nlong name  2", "h": "x  3"}


def test_comments(spark, verdicts):
    got = {r.path: r for r in render.comments(verdicts.filter("posted and rank <= 2")).collect()}
    assert got["a.py"].body == "**CRITICAL** First\n\nparsed\n\n<!-- review-finding f1 -->" and got["a.py"].side == "RIGHT" and got["b.py"].line == 3
    back = spark.createDataFrame([(r.body,) for r in got.values()], "body string").select(text.decode_finding_marker(F.col("body")).alias("f"))
    assert sorted(r.f for r in back.collect()) == ["f0", "f1"]


def test_first_comment_with_a_marker_and_reactions(spark):
    marked = "x <!-- review-fingerprints a b -->"
    rows = spark.createDataFrame([("p", 1, "hello"), ("p", 2, marked), ("p", 3, marked + "later"), ("q", 1, "none")], "pr string, id int, body string")
    assert [tuple(r) for r in render.first_with(rows, ["pr"], "id", text.has_marker(F.col("body"))).collect()] == [("p", 2, marked)]
    reactions = spark.createDataFrame([("f", "host:+1"), ("f", "host:+1"), ("f", "host:-1"), (None, "host:+1")], "fingerprint string, source string")
    assert sorted(map(tuple, render.reaction_counts(reactions).collect())) == [("f", "host:+1", 2), ("f", "host:-1", 1)]


def test_cost_plan(spark):
    calls_ = spark.createDataFrame(
        [("r", "review", "a.py", "m", "x" * 4000), ("r", "review", "b.py", "m", "x" * 8), ("r", "verify", None, "m", "x" * 400), ("s", "review", "a.py", "other", "x" * 40), ("s", "verify", None, "m", "")],
        "review string, phase string, file string, model string, prompt string",
    )
    prices = spark.createDataFrame([("m", 0.001, 0.0)], "model string, price_in double, price_out double")
    planned = costs.plan(calls_, prices)
    assert {(r.review, r.file): (r.tokens, r.cost) for r in costs.summed(planned, ["review", "file"]).filter("file is not null").collect()} == {("r", "a.py"): (1000, 1.0), ("r", "b.py"): (2, 0.002), ("s", "a.py"): (10, None)}
    phases = costs.phase_gate(planned, ["review"], F.lit(1.05), {"review": 0, "verify": 1})
    got = {(r.review, r.phase): (r.through, r.runs) for r in phases.collect()}
    assert got == {("r", "review"): (1.002, True), ("r", "verify"): (1.102, False), ("s", "review"): (None, True), ("s", "verify"): (None, True)}
    assert [r.text for r in costs.stop_text(phases, F.lit(1.05)).filter("text is not null").collect()] == ["estimated cost $1.1020 through the verify exceeds the ceiling of $1.0500"]
    assert all(r.runs for r in costs.phase_gate(planned, ["review"], F.lit(None).cast("double"), {"review": 0, "verify": 1}).collect())


def test_tally(spark):
    answers = spark.createDataFrame([("r", True), ("r", True), ("s", True), ("s", False)], "review string, failed boolean")
    assert {r.review: (r.made, r.failed, r.all_failed) for r in costs.tally(answers, ["review"]).collect()} == {"r": (2, 2, True), "s": (2, 1, False)}


def test_settings_tiers():
    env = {"REVIEW_BASE_URL": "http://one", "REVIEW_VERIFY_BASE_URL": "http://two"}
    made = settings.from_mapping({"model": "a", "model_params": {"temperature": 1}, "verify_model": "b"}, "file", env)
    assert made.tier("review") == settings.Tier("a", "http://one", {"temperature": 1.0})
    assert made.tier("verify") == settings.Tier("b", "http://two", {})
    assert made.tier("summary") == settings.Tier("b", "http://two", {})
    named = settings.from_mapping({"model": "a", "summary_model": "c", "model_params": {"max_tokens": 9}}, "file", env)
    assert named.tier("verify") == settings.Tier("a", "http://two", {"max_tokens": 9}) and named.tier("summary") == settings.Tier("c", "http://one", {})
    with pytest.raises(settings.SettingsError, match="needs 'host/a'"):
        made.check_prefixes({"http://one": "host/"})
    assert settings.read(None) == settings.from_mapping(None, "nothing")


@pytest.mark.parametrize(
    "given",
    [
        {"api_key": "x"}, {"nested": [{"my_secret": 1}]}, {"llm_base_url": "http://x"}, {"caller_depth": 4}, {"caller_depth": True}, {"caller_depth": "2"}, {"proofs": "yes"}, {"model_params": {"stream": True}},
        {"model_params": {"temperature": 3}}, {"model_params": {"temperature": True}}, {"model_params": {"max_tokens": 1.5}}, {"model_params": [1]}, ["a"], "text",
    ],
)
def test_settings_that_are_refused(given):
    with pytest.raises(settings.SettingsError):
        settings.from_mapping(given, "file")


def test_settings_of_a_file(tmp_path):
    (tmp_path / "s.json").write_text('{"caller_depth": 3, "min_confidence": 0.5, "dimensions": ["style"], "unknown": 1}')
    made = settings.read(tmp_path / "s.json", {})
    assert (made.caller_depth, made.min_confidence, made.dimensions, made.max_inline_comments) == (3, 0.5, ("style",), 10)
    assert settings.read(tmp_path / "absent.json", {}).caller_depth == 2


def test_gate_assertions_use_up_what_they_match(spark):
    place = "case string, ord int, file string, line int, words array<string>"
    want = spark.createDataFrame([("c", 0, "a", 10, ["null"])], place)
    held = spark.createDataFrame([("c", 0, "a", 10, ["leak"], None), ("c", 1, "b", 5, [], "dedupe"), ("c", 2, "b", 5, [], "dedupe"), ("c", 3, "b", 6, [], "ranked_out"), ("c", 4, "z", 1, [], None)], f"{place}, stage string")
    got = spark.createDataFrame(
        [("c", 0, "a", 9, "a null", True, None), ("c", 1, "a", 11, "a leak", True, None), ("c", 2, "b", 5, "t", False, "dedupe"), ("c", 3, "b", 5, "t", False, "low_confidence"), ("c", 4, "b", 5, "t", False, None), ("c", 5, "q", 1, "noise", True, None)],
        "case string, ord int, file string, line int, title string, posted boolean, stage string",
    )
    graded = evaluate.grade(want, got, held)
    assert sorted((r.bucket, r.ord, r.matched) for r in graded.collect() if r.ord is not None) == [("caught", 0, 0), ("held", 1, 2), ("held", 3, 4), ("leaked", 0, 1), ("unexercised", 4, None), ("wrong_stage", 2, 3)]
    assert [r.matched for r in graded.filter("bucket = 'false_positive'").collect()] == [5]
    proven = spark.createDataFrame([("c", 0), ("c", 5)], "case string, ord int")
    made = spark.createDataFrame([("c", 3, 1)], "case string, made int, failed int")
    sums = evaluate.report(graded, proven, made)
    row = sums.first()
    assert (row.expected, row.caught, row.proven, row.leaked, row.held, row.wrong_stage, row.unexercised, row.false_positive, row.review_failures, row.cases, row.catch_rate, row.fp_rate) == (1, 1, 1, 1, 2, 1, 1, 1, 1, 1, 1.0, 1.0)
    said = evaluate.report_text(sums).first().text
    assert "WARNING: 1 of 3" in said and "catch rate 100% (1 caught, 0 gated, 0 missed)" in said and "2 held, 1 leaked, 1 wrong stage, 1 untested" in said
    lines = [r.text for r in evaluate.report_lines(graded, want.unionByName(held.drop("stage")), got).orderBy("place", "ord").collect()]
    assert lines[0] == "caught         a:10" and lines[-1] == "false_positive q:1  noise"


def test_dense_ids(spark):
    rows = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5003).alias("x"))
    got = store.assign_ids(rows, ["x"], after=10).orderBy("x").collect()
    assert [r.id for r in got] == list(range(11, 5011))


def test_signature_starts_at_the_first_parenthesis(spark):
    rows = spark.createDataFrame([("x) def f(a, (b)):\n  y",), ("def g(a,\n  b) -> int:\n  z",), ("no list\nrest",)], "t string")
    assert [r[0] for r in rows.select(calls.signature(F.col("t"))).collect()] == ["x) def f(a, (b)):", "def g(a, b) -> int:", "no list"]


def test_mentions_keep_backslashes(spark):
    rows = spark.createDataFrame([("see a/b.py and 1.5",), ("see c/b.py",), (r"see a\b.py",), ("see é/x.py",)], "t string")
    assert [r[0] for r in rows.select(text.mentions_only(F.col("t"), F.array(F.lit("a/b.py")))).collect()] == [True, True, False, False]


def test_nearest_of_all_against_all_pairs(spark):
    import random

    from diffquarry.operators import intervals

    rnd = random.Random(2)
    paths = ["/".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 6))) for _ in range(300)]
    rows = [(i, p, rnd.choice("xy")) for i, p in enumerate(paths)] + [(900, "top", "x"), (901, "", "x")]
    df = spark.createDataFrame(rows, "id long, path string, k string")
    asked = df.filter("id % 5 = 0").select(F.col("id").alias("origin"), F.col("path").alias("from_path"), "k")
    got = sorted((r.origin, r.place, r.id, r.depth) for r in intervals.nearest_of_all(asked, df, ["k"], "path", "id", 3).collect())

    def shared(a, b):
        n = 0
        for x, y in zip(a.split("/")[:-1], b.split("/")[:-1]):
            if x != y:
                break
            n += 1
        return n

    want = []
    for i, p, k in rows:
        if i % 5 == 0:
            best = sorted((-shared(p, q), q, j) for j, q, m in rows if m == k and j != i)[:3]
            want += [(i, n, j, -d) for n, (d, _, j) in enumerate(best, 1)]
    assert got == sorted(want)


def test_text_report(spark, verdicts):
    runs = spark.createDataFrame(
        [("r", "m", 0.5, 12345, 3, 1, 2, "In short.", 4), ("s", None, None, 0, 2, 2, 0, None, 0), ("t", "m", None, 9, 1, 0, 0, None, 0)],
        "review string, model string, cost double, prompt_tokens long, review_calls int, review_failures int, verify_failures int, summary string, cut int",
    )
    got = {r.review: r.report for r in render.text_report(verdicts.withColumn("combined", F.col("confidence")), runs, ["review"]).collect()}
    assert got["r"] == (
        "model m  ·  estimated cost $0.5000  ·  12,345 prompt tokens\n\nWARNING: 1 of 3 review call(s) failed, so some files were not reviewed.\n\n"
        "WARNING: 2 finding(s) were dropped because their verification failed.\n\nIn short.\n\n3 verified finding(s), 2 dropped (1 low_confidence, 1 ranked_out)\n\n"
        "  CRITICAL  a.py:7  First\n" + " " * 20 + "security · confidence 1.00\n" + " " * 20 + "y = 2\n\n  HIGH      b.py:3  Second\n" + " " * 20 + "correctness · confidence 0.90\n" + " " * 20 + "x = 1\n\n"
        "  LOW       b.py:9  Third\n" + " " * 20 + "correctness · confidence 0.80\n" + " " * 20 + "z\n\ncontext trimmed to fit the budget: 4 block(s)"
    )
    assert got["s"] == "WARNING: all 2 review call(s) failed; the review did not run.\n\nNo findings reported, because the review did not complete."
    assert got["t"] == "model m  ·  estimated cost unknown (no price for this model)  ·  9 prompt tokens\n\nNo findings survived the gate"


def test_ceiling_stops_a_run(spark):
    calls_ = spark.createDataFrame([("r", "review", "m", "x" * 4000), ("r", "verify", "m", "x" * 4000)], "review string, phase string, model string, prompt string")
    planned = costs.plan(calls_, spark.createDataFrame([("m", 0.001, 0.0)], "model string, price_in double, price_out double"))
    phases = lambda c: costs.phase_gate(planned, ["review"], F.lit(c).cast("double"), {"review": 0, "verify": 1})
    with pytest.raises(costs.CeilingExceeded, match="through the verify"):
        costs.check_ceiling(phases(1.5), 1.5)
    for c in (2.5, None):
        costs.check_ceiling(phases(c), c)


def test_markers_hold_each_fingerprint_once(spark):
    rows = spark.createDataFrame([(["b", "a", "b"],), ([],)], "f array<string>")
    assert [r[0] for r in rows.select(text.encode_marker(F.col("f"))).collect()] == ["<!-- review-fingerprints a b -->", ""]


def test_diff_of_a_stream(spark):
    import io

    from diffquarry.sources import trees

    assert tuple(trees.read_diff_stream(spark, io.StringIO("--- a\n+++ b\n")).first()) == ("-", "--- a\n+++ b\n")
