"""Review hosts, paid stages, languages with braces and the smaller parts of the store, against results by hand."""

import json

import pytest
from pyspark.sql import functions as F

from diffquarry.operators import gate, stages, store
from diffquarry.plans import review
from diffquarry.sources import brace_code, hosts
from diffquarry.streaming import reviews


def page(*items):
    return json.dumps(list(items))


def test_comments_end_with_a_page_that_is_not_full(spark):
    one = {"id": 1, "body": "<!-- review-finding ab -->", "reactions": {"+1": 2, "-1": 0, "total_count": 2, "url": "u"}}
    pages = spark.createDataFrame([("p", 1, page(one, {"id": 2, "body": "x"})), ("p", 2, page({"id": 3, "body": "<!-- review-fingerprints b a -->"})), ("p", 3, page({"id": 9, "body": "beyond"})), ("q", 2, page({"id": 8})), ("r", 1, "no json")], "pr string, page int, body string")
    made = hosts.comments(pages, ["pr"], per_page=2)
    assert sorted((r.pr, r.ord, r.id) for r in made.collect()) == [("p", 0, 1), ("p", 1, 2), ("p", 2, 3)]
    threads = lambda more, *ids: json.dumps({"pageInfo": {"hasNextPage": more, "endCursor": "c"}, "nodes": [{"isResolved": done, "comments": {"nodes": [{"databaseId": i}] if i else []}} for i, done in ids]})
    answers = spark.createDataFrame([("p", 1, threads(True, (1, True), (2, False), (None, True))), ("p", 2, threads(False, (3, True))), ("p", 3, threads(False, (4, True)))], "pr string, page int, body string")
    done = hosts.resolved(answers, ["pr"])
    assert sorted(r.id for r in done.collect()) == [1, 3]
    got = hosts.feedback(made, done, ["pr"], "host")
    assert sorted(map(tuple, got.collect())) == [("p", "ab", "reaction", "host:+1", 2), ("p", "ab", "resolved", "host:resolved", 1)]
    posted = spark.createDataFrame([("p", "c"), ("p", "a"), ("z", "n")], "pr string, fingerprint string")
    assert sorted((r.pr, r.fingerprints) for r in hosts.remembered(made, posted, ["pr"]).collect()) == [("p", ["a", "b", "c"]), ("z", ["n"])]
    plan = hosts.summary_plan(spark.createDataFrame([("p", "t"), ("z", "u")], "pr string, text string"), made, ["pr"])
    assert sorted((r.pr, r.action, r.id) for r in plan.collect()) == [("p", "update", 3), ("z", "create", None)]
    again = hosts.after_failure(plan, spark.createDataFrame([("p",), ("z",)], "pr string"), ["pr"])
    assert [(r.pr, r.action, r.id) for r in again.collect()] == [("p", "create", None)]


def test_paid_stages(spark):
    blocks = spark.createDataFrame([("r", 2, "b", "two"), ("r", 1, "a", "one")], "review string, ord int, label string, text string")
    assert stages.review_prompts(blocks, ["review"], ["ord"]).first().prompt == "--- a ---\none\n\n--- b ---\ntwo"
    answer = json.dumps({"findings": [{"file": "a.py", "line": 3, "severity": "high", "confidence": 0.9, "title": "t", "category": "c", "quoted_code": "q"}]})
    calls = spark.createDataFrame([("r", 0, "ask"), ("r", 1, "fail")], "review string, ord int, prompt string")

    def complete(prompt):
        if prompt == "fail":
            raise OSError("gone")
        return answer

    got = stages.answered(calls, complete)
    assert [r.failed for r in got.orderBy("ord").collect()] == [False, True]
    found = stages.propose(got, ["review"])
    assert [(r.file, r.line, r.title, tuple(r.ord)) for r in found.collect()] == [("a.py", 3, "t", (0, 0))]
    prompts = stages.verify_prompts(found, F.array(F.lit("x"), F.lit(""), F.lit(None), F.lit("y"))).first().prompt
    assert prompts.startswith("Claim: t\nPlace: a.py:3\nQuoted: q") and prompts.endswith("Evidence:\nx\n\ny")
    posted = spark.createDataFrame([("r", 2, "low", "b.py", 1, "second"), ("r", 1, "high", "a.py", 3, "first")], "review string, rank int, severity string, file string, line int, title string")
    assert stages.summary_prompts(posted, ["review"]).first().prompt == "- [high] a.py:3 first\n- [low] b.py:1 second"
    said = spark.createDataFrame([("r", "Look at a.py."), ("s", "x")], "review string, answer string")
    assert [tuple(r) for r in stages.summarise(said, posted, ["review"]).collect()] == [("r", "Look at a.py.")]
    for wrong in ("See z.py first", "  ", None):
        assert stages.summarise(spark.createDataFrame([("r", wrong)], "review string, answer string"), posted, ["review"]).first().summary is None
    prices = spark.createDataFrame([("m", 0.001, 0.0)], "model string, price_in double, price_out double")
    candidates = spark.createDataFrame([("m", "x" * 400, None), ("m", "x" * 400, "proven")], "model string, prompt string, proof string")
    assert [r.cost for r in stages.verification_cost(candidates, prices).collect()] == [0.1]
    assert stages.summary_cost(posted, ["review"], "m", prices).count() == 1 and stages.summary_cost(posted.limit(0), ["review"], "m", prices).count() == 0
    rows, seen = stages.measured(calls, "prompts")
    assert rows.count() == 2 and seen.get == {"calls": 2, "chars": 7, "longest": 4}
    drops = spark.createDataFrame([("r", False, "down"), ("r", False, "other"), ("r", True, "down")], "review string, posted boolean, reason string")
    assert stages.unverified(drops, ["review"], "down").first().failed == 1


CODE = """
// function no() { }
function outer(a) {
  const inner = (x) => { return "}" + x; };
  if (a) { run(a) }
  return inner
}
class A {
  method(one, two = f(1)) {
    return `${"{"}`
  }
}
func (s *S) Go(x int) error { return nil }
pub fn rust<T>(x: T) -> u8 { 1 }
static int plain(char *p) {
  while (*p) { p++; }
  return 0;
}
int declared(int x);
function open() {
"""


def test_functions_of_braces(spark):
    got = {name: (start, end) for name, start, end in brace_code.read_functions(CODE)}
    assert got == {"outer": (3, 7), "inner": (4, 4), "method": (9, 11), "Go": (13, 13), "rust": (14, 14), "plain": (15, 18)}
    rows = spark.createDataFrame([("x/a.js", CODE), ("b.txt", CODE), ("c.go", None), (None, CODE), ("d.rs", "")], "path string, text string")
    chunks = brace_code.chunks(rows).collect()
    assert {r.path for r in chunks} == {"x/a.js"} and len(chunks) == 6
    first = min(chunks, key=lambda r: r.ord)
    assert (first.name, first.header, first.language) == ("outer", "function outer(a) {", "javascript") and first.text.endswith("return inner\n}")
    added = spark.createDataFrame([("x/a.js", 10)], "path string, line int")
    assert [r.name for r in review.changed_chunks(added, brace_code.chunks(rows)).collect()] == ["method"]


def test_calls_per_file(spark):
    text = "def ff(x): pass\n" + "ff(1)\n" * 50
    lines = review.source_lines(spark.createDataFrame([("a.py", text), ("b.py", "ff(2)\n")], "path string, text string"))
    some = review.call_index(lines, per_file=40).groupBy("path").count().collect()
    assert {r.path: r["count"] for r in some} == {"a.py": 39, "b.py": 1}
    assert review.call_index(lines).count() == 51


def test_gate_without_places(spark):
    rows = spark.createDataFrame([("r", 0, "f", True, False, None, "high", 1.0, True, True, 0.9)], "review string, ord int, fingerprint string, quote_ok boolean, in_memory boolean, proof string, severity string, confidence double, is_real boolean, is_actionable boolean, verifier double")
    got = gate.cascade(rows, ["review"])
    assert "loc_ok" not in got.columns and got.first().posted


def test_conform_and_days(spark):
    rows = spark.createDataFrame([(1, None)], "id int, old string")
    got = store.conform(rows, {"id": ("bigint", None), "old": ("string", F.lit("filled")), "new": ("int", F.lit(7)), "bare": ("string", None)}).first()
    assert tuple(got) == (1, "filled", 7, None)
    for days in (0, 3651):
        with pytest.raises(ValueError):
            store.stats(rows, rows, rows, "r", days, F.current_timestamp())


def test_delivery_survives_a_failure(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string").repartition(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id int, t string").parquet(str(tmp_path / "in"))

    def send(outcomes):
        raise OSError(f"{len(outcomes)} not taken")

    reviews.deliver(rows, send, str(tmp_path / "c"), str(tmp_path / "f")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "f" / "b0")).first()
    assert (got.rows, got.failure) == (2, "OSError: 2 not taken")
