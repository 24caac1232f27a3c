import hashlib
import re
import sys

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from diffquarry.functions import calls, text


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_white_space_is_python_s(spark):
    odd = [chr(c) for c in range(1, sys.maxunicode + 1) if chr(c).isspace()]
    assert column(spark, [f"a{c}b" for c in odd], text.strip_space) == ["ab"] * len(odd)
    near = [chr(c) for c in (0x200B, 0x180E, 0xFEFF, 0x2060, 0x1B)]
    assert column(spark, [f"a{c}b" for c in near], text.strip_space) == [f"a{c}b" for c in near]


@settings(max_examples=20, deadline=None)
@given(values=st.lists(st.text(alphabet="ab \t\n\r\x0b\x0c\x1c\x1d\x85  ", max_size=12), min_size=1, max_size=20))
def test_lines_and_hash_are_python_s(spark, values):
    assert column(spark, values, text.split_lines) == [v.splitlines() for v in values]
    want = [hashlib.sha1(" ".join(v.lower().split()).encode()).hexdigest()[:16] for v in values]
    assert column(spark, values, text.content_hash) == want


def test_redaction_and_errors(spark):
    keys = ["sk-abcdefgh12", "ghp_12345678", "AKIA0123456789AB", "Bearer x.y", "a" * 32]
    assert column(spark, [f"x {k} y" for k in keys], text.redact) == ["x [redacted] y"] * 5
    assert column(spark, ["sk-short", None], text.redact) == ["sk-short", None]
    got = column(spark, ["\n  \n first \nsecond", "", "z " * 300], lambda c: text.describe_error(F.lit("E"), c))
    assert got[:2] == ["E: first", "E"] and len(got[2]) == 240 and got[2].endswith("...")


def test_small_scalars(spark):
    assert column(spark, ["", "a" * 7, "a" * 8], text.estimate_tokens) == [1, 2, 2]
    assert column(spark, [" http://a// ", "/", None], text.normal_url) == ["http://a", None, None]
    assert column(spark, ["```json\n{}\n```", "{}"], text.strip_fence) == ["{}", "{}"]
    assert column(spark, ["a " * 60], text.one_line)[0].endswith("…")
    back = column(spark, [["b", "a"], []], lambda c: text.decode_marker(F.concat(F.lit("x"), text.encode_marker(c))), "array<string>")
    assert back == [["a", "b"], []]
    assert column(spark, ["ab12"], lambda c: text.decode_finding_marker(text.encode_finding_marker(c))) == ["ab12"]
    assert column(spark, ["see a/b.py and 3.11", "see c.py", "none"], lambda c: text.mentions_only(c, F.array(F.lit("a/b.py")))) == [True, False, True]


def test_confidence_is_a_product(spark):
    rows = spark.createDataFrame([(0.9, True, True, 0.6), (2.0, True, True, 0.5), (0.9, False, True, 0.9), (0.9, True, False, 0.9)], "a double, r boolean, b boolean, v double")
    got = [round(r[0], 6) for r in rows.select(text.combined_confidence(F.col("a"), F.col("r"), F.col("b"), F.col("v"))).collect()]
    assert got == [0.54, 0.5, 0.0, 0.0]


def test_callees(spark):
    lines = ["  # skipped(x)", "total = compute(a) + self.helper(b) + obj.get(c)", "def own(x): return compute(x)", "if (x): print(len(y))", "foo(bar(baz(1)))"]
    assert column(spark, [lines], lambda c: calls.callee_names(c, F.lit("own")), "array<string>") == [["compute", "helper", "foo", "bar", "baz"]]


def test_signature_and_depth(spark):
    values = ["def f(a,\n      b=(1, 2)):\n    return a", "x = 1\ny", "def g( a ): pass"]
    assert column(spark, values, calls.signature) == ["def f(a, b=(1, 2)):", "x = 1", "def g( a ): pass"]
    rows = spark.createDataFrame([("a/b/c.py", "a/b/d.py"), ("a.py", "b.py"), ("a/x/c.py", "a/y/c.py")], "p string, q string")
    assert [r[0] for r in rows.select(calls.shared_depth(F.col("p"), F.col("q"))).collect()] == [2, 0, 1]


def test_key_patterns_compile():
    assert re.compile(text.KEY_LIKE) and re.compile(text.SETTING_KEY)
