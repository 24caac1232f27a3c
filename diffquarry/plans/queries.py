"""Operators bound to the driver's tables, each with the SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calls, text
from ..operators import costs, diff, evaluate, gate, intervals, packing, render, store
from ..sources import cases
from ..sources.scratch import scratch

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# DuckDB forms of shared expressions.
_COLLAPSE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_STRIP = r"regexp_replace({0}, '\s', '', 'g')"
_HASH = "substr(sha1(lower(" + _COLLAPSE + ")), 1, 16)"
_TOKENS = "greatest(1, CAST(floor(length({0}) / 3.5) AS INTEGER))"
_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(f"""
SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b
ON contains({_STRIP.format('d.text')}, {_STRIP.format('b.text')}) WHERE length({_STRIP.format('b.text')}) >= 8
""")
def q01_quoted_passages(spark, sf_dir):
    found = gate.containment(_t(spark, sf_dir, "benchmark").withColumnRenamed("text", "quoted_code"), _t(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("e_doc_id").alias("doc_id"), "item_id")


@query(f"""
SELECT doc_id, fp, row_number() OVER (PARTITION BY fp ORDER BY doc_id) = 1 AS is_first FROM (
SELECT doc_id, sha1(concat_ws('|', source, {_HASH.format('text')}, lang, {_HASH.format('left(text, 40)')})) AS fp FROM documents)
""")
def q02_fingerprint_dedupe(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    rows = docs.select("doc_id", text.fingerprint(F.col("source"), F.col("text"), F.col("lang"), F.substring("text", 1, 40)).alias("fp"))
    return rows.withColumn("is_first", F.row_number().over(Window.partitionBy("fp").orderBy("doc_id")) == 1)


_KEY = text.KEY_LIKE.replace("'", "''")


@query(f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '{_KEY}')) AS INTEGER) AS hits, sha1(regexp_replace(text, '{_KEY}', '[redacted]', 'g')) AS redacted FROM documents
""")
def q03_redaction(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    found = docs.select("doc_id", text.redactions(F.col("text")).alias("r"))
    return found.select("doc_id", "r.hits", F.sha1(F.col("r.text").cast("binary")).alias("redacted"))


@query(f"""
SELECT 'document' AS kind, lang AS name, count(*) AS n, CAST(sum({_TOKENS.format('text')}) AS BIGINT) AS tokens FROM documents GROUP BY lang
UNION ALL SELECT 'turn', role, count(*), CAST(sum({_TOKENS.format('text')}) AS BIGINT) FROM conversations GROUP BY role
""")
def q04_token_estimates(spark, sf_dir):
    part = lambda name, kind, by: _t(spark, sf_dir, name).groupBy(F.col(by).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum(text.estimate_tokens(F.col("text"))).alias("tokens")).select(F.lit(kind).alias("kind"), "name", "n", "tokens")
    return part("documents", "document", "lang").unionByName(part("conversations", "turn", "role"))


@query(f"""
WITH RECURSIVE s AS (SELECT conv_id, turn, {_TOKENS.format('text')} AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations),
f AS (SELECT conv_id, turn, size, n, 0 AS bin, CAST(size AS BIGINT) AS used FROM s WHERE n = 1
UNION ALL SELECT s.conv_id, s.turn, s.size, s.n, f.bin + CASE WHEN f.used > 0 AND f.used + s.size > 150 THEN 1 ELSE 0 END,
CASE WHEN f.used > 0 AND f.used + s.size > 150 THEN s.size ELSE f.used + s.size END FROM f JOIN s ON s.conv_id = f.conv_id AND s.n = f.n + 1)
SELECT conv_id, turn, size, bin FROM f
""")
def q05_sequential_bins(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations").withColumn("size", text.estimate_tokens(F.col("text")))
    return packing.bins(turns, ["conv_id"], ["turn", "text"], "size", 150).select("conv_id", "turn", "size", "bin")


_FIRST_LINE = "string_split(text, chr(10))[1]"


@query(f"""
WITH RECURSIVE s AS (SELECT source, doc_id, {_TOKENS.format('text')} AS size, {_TOKENS.format(_FIRST_LINE)} AS short, doc_id % 40 = 0 AS must,
row_number() OVER (PARTITION BY source ORDER BY doc_id % 40 = 0 DESC, doc_id) AS n FROM documents),
f AS (SELECT source, doc_id, n, CASE WHEN must OR size <= 3000 THEN 'whole' WHEN short <= 3000 THEN 'short' ELSE 'dropped' END AS kept,
CAST(CASE WHEN must OR size <= 3000 THEN size WHEN short <= 3000 THEN short ELSE 0 END AS BIGINT) AS used FROM s WHERE n = 1
UNION ALL SELECT s.source, s.doc_id, s.n, CASE WHEN must OR used + size <= 3000 THEN 'whole' WHEN used + short <= 3000 THEN 'short' ELSE 'dropped' END,
used + CASE WHEN must OR used + size <= 3000 THEN size WHEN used + short <= 3000 THEN short ELSE 0 END FROM f JOIN s ON s.source = f.source AND s.n = f.n + 1)
SELECT source, doc_id, kept FROM f
""")
def q06_budget_pack(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("source", "doc_id", text.estimate_tokens(F.col("text")).alias("size"), text.estimate_tokens(F.substring_index("text", "\n", 1)).alias("short"), (F.col("doc_id") % 40 == 0).alias("must"))
    return packing.pack(docs, ["source"], ["doc_id"], "size", "short", "must", 3000).select("source", "doc_id", "kept")


@query(f"SELECT doc_id, CAST(n AS INTEGER) AS line_no, CAST(length(line) AS INTEGER) AS n_chars FROM {_LINES} WHERE n BETWEEN doc_id % 5 + 1 AND doc_id % 5 + 3")
def q07_lines_in_span(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").alias("diff_id"), F.lit("a").alias("file"), F.posexplode(text.split_lines(F.col("text"))).alias("n", "line_text")).withColumn("line", F.col("n") + 1)
    spans = docs.select(F.col("doc_id").alias("diff_id"), F.lit("a").alias("path"), (F.col("doc_id") % 5 + 1).alias("new_start"), (F.col("doc_id") % 5 + 3).alias("new_end"))
    return diff.in_any_hunk(lines, spans).select(F.col("diff_id").alias("doc_id"), F.col("line").alias("line_no"), F.length("line_text").alias("n_chars"))


@query(f"""
SELECT l.doc_id, CAST(l.anchor AS INTEGER) AS anchor, {_HASH.format("string_agg(x.line, chr(10) ORDER BY x.n)")} AS h FROM
(SELECT doc_id, doc_id % 4 + 1 AS anchor FROM labels WHERE quality = 1) l JOIN {_LINES} x ON x.doc_id = l.doc_id AND abs(x.n - l.anchor) <= 2 GROUP BY l.doc_id, l.anchor
""")
def q08_nearby_hash(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("diff_id"), F.lit("a").alias("path"), F.posexplode(text.split_lines(F.col("text"))).alias("n", "text")).withColumn("line", F.col("n") + 1)
    marks = _t(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("diff_id"), F.lit("a").alias("file"), (F.col("doc_id") % 4 + 1).cast("int").alias("line"))
    near = diff.nearby_text(marks, lines).filter("text <> ''")
    return near.select(F.col("diff_id").alias("doc_id"), F.col("line").alias("anchor"), text.content_hash(F.col("text")).alias("h"))


def _candidates(spark, sf_dir):
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    memory = docs.filter("lang = 'es'").select(text.content_hash(F.col("text")).alias("fingerprint")).distinct().withColumn("in_memory", F.lit(True))
    rows = docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("review"), F.col("doc_id").alias("ord"), text.content_hash(F.col("text")).alias("fingerprint"), (F.col("n_chars") >= 200).alias("quote_ok"), (F.col("doc_id") % 7 != 0).alias("loc_ok"),
        F.when(F.col("doc_id") % 60 == 1, "checked").alias("proof"), F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("severity"),
        ((F.col("n_chars") % 40 + 61) / 100).alias("confidence"), (F.coalesce("quality", F.lit(1)) == 1).alias("is_real"), (F.coalesce("toxic", F.lit(0)) == 0).alias("is_actionable"), F.lit(0.9).alias("verifier"),
    )
    return gate.cascade(rows.join(memory, "fingerprint", "left").fillna(False, ["in_memory"]), ["review"], "ord", 0.7, 10)


_GATE = f"""
WITH c AS (SELECT d.source AS review, d.doc_id AS ord, {_HASH.format('d.text')} AS fp, d.n_chars >= 200 AS quote_ok, d.doc_id % 7 <> 0 AS loc_ok, d.doc_id % 60 = 1 AS proven,
CAST(4 - d.doc_id % 4 AS INTEGER) AS weight, (d.n_chars % 40 + 61) / 100 AS conf, coalesce(l.quality, 1) = 1 AND coalesce(l.toxic, 0) = 0 AS agreed,
{_HASH.format('d.text')} IN (SELECT {_HASH.format('text')} FROM documents WHERE lang = 'es') AS mem FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
s AS (SELECT *, CASE WHEN proven THEN least(1.0, conf) WHEN agreed THEN least(1.0, conf) * 0.9 ELSE 0.0 END AS sure FROM c),
o AS (SELECT *, quote_ok AND loc_ok AND (proven OR sure >= 0.7) AS ok FROM s),
f AS (SELECT *, min(CASE WHEN ok AND NOT mem THEN ord END) OVER (PARTITION BY review, fp) AS first_ok FROM o),
g AS (SELECT *, CASE WHEN NOT quote_ok THEN 'hallucination' WHEN NOT loc_ok THEN 'bad_location' WHEN mem OR coalesce(ord > first_ok, false) THEN 'dedupe' WHEN NOT ok THEN 'low_confidence' END AS stage FROM f),
r AS (SELECT *, CASE WHEN stage IS NULL OR stage = 'low_confidence' THEN sure END AS combined FROM g),
v AS (SELECT *, weight * coalesce(combined, 0) AS score, CASE WHEN stage IS NULL THEN row_number() OVER (PARTITION BY review, stage IS NULL ORDER BY weight * coalesce(combined, 0) DESC, ord) END AS rank FROM r)
"""


@query(_GATE + "SELECT review, ord, coalesce(stage, '') AS stage, round(coalesce(combined, 0.0), 6) AS combined, round(score, 6) AS score, CAST(coalesce(rank, 0) AS INTEGER) AS rank, coalesce(rank <= 10, false) AS posted FROM v")
def q09_gate_cascade(spark, sf_dir):
    return _candidates(spark, sf_dir).select("review", "ord", F.coalesce("stage", F.lit("")).alias("stage"), F.round(F.coalesce("combined", F.lit(0.0)), 6).alias("combined"), F.round("score", 6).alias("score"), F.coalesce("rank", F.lit(0)).alias("rank"), "posted")


@query("""
SELECT event_type, event_id, CAST(place AS INTEGER) AS place, place > 10 AS overflow FROM (SELECT event_type, event_id,
row_number() OVER (PARTITION BY event_type ORDER BY (event_id % 4 + 1) * value DESC, event_id) AS place FROM events)
""")
def q10_rank_with_overflow(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy(F.desc((F.col("event_id") % 4 + 1) * F.col("value")), "event_id")
    return _t(spark, sf_dir, "events").select("event_type", "event_id", F.row_number().over(w).alias("place")).withColumn("overflow", F.col("place") > 10)


@query(_GATE + """
SELECT review, stage, n, CAST(row_number() OVER (PARTITION BY review ORDER BY n DESC, first) AS INTEGER) AS place FROM (
SELECT review, coalesce(stage, 'ranked_out') AS stage, count(*) AS n, min(ord) AS first FROM v WHERE NOT coalesce(rank <= 10, false) GROUP BY 1, 2)
""")
def q11_drop_breakdown(spark, sf_dir):
    return gate.breakdown(_candidates(spark, sf_dir), ["review"])


@query("""
SELECT o_orderpriority AS category, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS posted,
count(*) FILTER (WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')) AS returned,
count(*) FILTER (WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'O')) AS open
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = 'BUILDING' AND o_orderdate >= TIMESTAMP '1998-08-02' - INTERVAL 1500 DAY
GROUP BY o_orderpriority HAVING count(*) FILTER (WHERE o_orderstatus = 'F') > 0
""")
def q12_stats_with_exists(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_linestatus") == "O").alias("o"))
    own = _t(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    recent = _t(spark, sf_dir, "orders").filter(store.in_window(F.col("o_orderdate"), F.expr("timestamp_ntz'1998-08-02'"), 1500))
    rows = recent.join(own, recent["o_custkey"] == own["c_custkey"]).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").fillna(False, ["r", "o"])
    posted = F.col("o_orderstatus") == "F"
    return store.conditional_counts(rows.withColumnRenamed("o_orderpriority", "category"), ["category"], total=F.lit(True), posted=posted, returned=posted & F.col("r"), open=posted & F.col("o")).filter("posted > 0")


@query("""
SELECT e.event_id, t.finding_id FROM events e JOIN (SELECT user_id, max(event_id) AS finding_id FROM events WHERE event_type = 'purchase' GROUP BY user_id) t ON t.user_id = e.user_id WHERE e.event_type = 'error'
""")
def q13_latest_lookup(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    posted = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_id", F.lit("x").alias("fingerprint"), F.lit(True).alias("posted"))
    asked = events.filter("event_type = 'error'").select("event_id", "user_id", F.lit("x").alias("fingerprint"))
    return store.resolve(asked, posted, ["user_id"]).select("event_id", "finding_id")


@query("""
WITH old AS (SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
new AS (SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_type, o.event_type) AS event_type, coalesce(n.value, o.value) AS value
FROM old o FULL JOIN new n ON n.user_id = o.user_id AND n.event_type = o.event_type
""")
def q14_upsert_latest(spark, sf_dir):
    events, keys = _t(spark, sf_dir, "events"), ["user_id", "event_type"]
    part = lambda r: store.latest(events.filter(f"event_id % 2 = {r}"), keys, ["event_id"]).select(*keys, "value")
    return store.upsert(part(0), part(1), keys)


@query("""
WITH o AS (SELECT l_orderkey, l_linenumber, min(l_suppkey % 4) AS fingerprint, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber),
n AS (SELECT l_orderkey, l_linenumber, fingerprint FROM o WHERE flag <> 'R')
SELECT n.l_orderkey, n.l_linenumber AS old_line, CAST((SELECT min(m.l_linenumber) FROM n m WHERE m.l_orderkey = n.l_orderkey AND m.fingerprint = n.fingerprint) AS INTEGER) AS new_line
FROM o n WHERE EXISTS (SELECT 1 FROM n m WHERE m.l_orderkey = n.l_orderkey AND m.fingerprint = n.fingerprint)
""")
def q15_reattach(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_suppkey") % 4).alias("fingerprint"), F.min("l_returnflag").alias("flag"))
    old = lines.withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    new = old.filter("flag <> 'R'").withColumn("posted", F.lit(True))
    feedback = old.select(F.col("id").alias("finding_id"), F.col("l_linenumber").alias("old_line"), F.col("l_orderkey").alias("order"))
    found = store.reattach(feedback, old, new, ["l_orderkey"])
    return found.select(F.col("order").alias("l_orderkey"), "old_line", (F.col("finding_id") - F.col("order") * 10).cast("int").alias("new_line"))


@query(f"SELECT doc_id FROM documents WHERE {_HASH.format('text')} NOT IN (SELECT {_HASH.format('text')} FROM documents WHERE lang = 'en')")
def q16_unseen(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "lang", text.content_hash(F.col("text")).alias("fingerprint"))
    return gate.unseen(rows, rows.filter("lang = 'en'"), ["fingerprint"]).select("doc_id")


@query("""
WITH s AS (SELECT user_id, event_id AS start, event_id + 200 + event_id % 500 AS stop FROM events WHERE event_type = 'click')
SELECT event_id, start AS span_start FROM (SELECT e.event_id, s.start, row_number() OVER (PARTITION BY e.event_id ORDER BY s.stop - s.start, s.start) AS r
FROM events e JOIN s ON s.user_id = e.user_id AND e.event_id BETWEEN s.start AND s.stop WHERE e.event_type = 'error') WHERE r = 1
""")
def q17_innermost_span(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    spans = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + 200 + F.col("event_id") % 500).alias("stop"))
    points = events.filter("event_type = 'error'").select("user_id", "event_id")
    return intervals.enclosing(points, spans, ["user_id"], "event_id", "start", "stop", ["start"], bucket=500).select("event_id", F.col("start").alias("span_start"))


_PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(f"""
WITH p AS (SELECT page_id, {_PATH} AS path, string_split({_PATH}, '/') AS parts FROM pages),
x AS (SELECT a.page_id AS origin, b.page_id, b.path, len(list_filter(range(1, least(len(a.parts), len(b.parts))), lambda i: a.parts[1:i] = b.parts[1:i])) AS depth
FROM p a JOIN p b ON a.page_id % 20 = 0 AND a.page_id <> b.page_id AND a.parts[-2] = b.parts[-2])
SELECT origin, page_id, CAST(depth AS INTEGER) AS depth, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY depth DESC, path, page_id) AS place FROM x) WHERE place <= 5
""")
def q18_nearest_paths(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    pages = _t(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.element_at(F.split(path, "/"), -2).alias("lang"))
    asked = pages.filter("page_id % 20 = 0").select(F.col("page_id").alias("origin"), F.col("path").alias("from_path"), "lang")
    return intervals.nearest_of_all(asked, pages, ["lang"], "path", "page_id", 5).select("origin", "page_id", "depth", "place")


@query(r"""
SELECT page_id, name, CAST(min(n) AS INTEGER) AS first_place FROM (SELECT page_id, unnest(l) AS name, generate_subscripts(l, 1) AS n FROM (
SELECT page_id, list_filter(regexp_extract_all(html, '(?:^|[^\w.])([A-Za-z_]\w*)\s*\(', 1), lambda x: length(x) >= 3 AND x NOT IN ('var')) AS l FROM pages)) GROUP BY page_id, name
""")
def q19_called_names(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("page_id", calls.callee_names(F.array("html"), F.lit("var")).alias("names"))
    return pages.select("page_id", F.posexplode("names").alias("place", "name")).select("page_id", "name", (F.col("place") + 1).alias("first_place"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 100 + 1 AS dst FROM lineitem),
r AS (SELECT 4 AS seed, CAST(4 AS BIGINT) AS node, 0 AS hop UNION SELECT r.seed, e.dst, r.hop + 1 FROM r JOIN e ON e.src = r.node WHERE r.hop < 3)
SELECT seed, node, min(hop) AS hop FROM r WHERE NOT (hop > 0 AND node = 4) GROUP BY seed, node HAVING min(hop) > 0
""")
def q20_bounded_hops(spark, sf_dir):
    edges = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100 + 1).alias("dst"))
    seeds = edges.sparkSession.range(4, 5).select(F.col("id").alias("node"))
    return intervals.k_hops(seeds, edges, 3).select(F.col("seed").cast("int").alias("seed"), "node", "hop")


@query("SELECT p_partkey, name FROM (SELECT p_partkey, p_brand || '-' || p_size AS name, count(*) OVER (PARTITION BY p_brand || '-' || p_size, p_type) AS n FROM part) WHERE n = 1")
def q21_unique_names(spark, sf_dir):
    name = F.concat_ws("-", "p_brand", "p_size")
    return intervals.unique_only(_t(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.struct(name, "p_type").alias("whole")), "whole").select("p_partkey", "name")


@query("""
SELECT source, caught, false_positive, expected, CASE WHEN expected = 0 THEN 1.0 ELSE round_even(caught / expected, 4) END AS catch_rate,
CASE WHEN expected = 0 THEN false_positive ELSE round_even(false_positive / expected, 4) END AS fp_rate FROM (
SELECT source, count(*) FILTER (WHERE toxic = 1 AND n_chars > 800) AS caught, count(*) FILTER (WHERE toxic = 0 AND n_chars > 4000) AS false_positive, count(*) FILTER (WHERE toxic = 1) AS expected
FROM documents JOIN labels USING (doc_id) GROUP BY source)
""")
def q22_catch_rates(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    toxic, sure = F.col("toxic") == 1, F.col("n_chars")
    sums = store.conditional_counts(rows, ["source"], caught=toxic & (sure > 800), false_positive=~toxic & (sure > 4000), expected=toxic)
    return evaluate.rates(sums).select("source", "caught", "false_positive", "expected", "catch_rate", "fp_rate")


@query()
def q23_greedy_matching(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    place = [F.col("source").alias("case"), F.col("doc_id").cast("int").alias("ord"), F.col("lang").alias("file"), (F.col("n_chars") % 50).cast("int").alias("line")]
    expected = docs.filter("toxic = 1").select(*place, F.array(F.substring("text", 1, 1)).alias("words")).withColumn("words", F.transform("words", lambda w: F.lower(w)))
    verdicts = docs.filter("toxic = 0").select(*place, F.substring("text", 1, 40).alias("title"), (F.col("quality") == 1).alias("posted"))
    return evaluate.grade(expected, verdicts)


@query("SELECT event_id, k, least(1.0, k / 80.0) AS confidence FROM (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE k IS NOT NULL")
def q24_parse_and_clamp(spark, sf_dir):
    item = F.format_string('{"findings":[{"file":"a","line":%s,"severity":"LOW","confidence":"%s","title":"t"}]}', F.get_json_object("props", "$.k"), (F.get_json_object("props", "$.k") / 80.0).cast("string"))
    rows = _t(spark, sf_dir, "events").select("event_id", F.explode(cases.parse_findings(item)).alias("f"))
    return rows.select("event_id", F.col("f.line").alias("k"), F.col("f.confidence").alias("confidence"))


@query("""
SELECT l_suppkey, CASE WHEN bool_and(x IS NOT NULL) THEN round(sum(x), 2) END AS cost, count(*) AS n FROM (SELECT l_suppkey, CASE WHEN l_discount < 0.1 OR l_orderkey % 11 <> 0 THEN l_extendedprice END AS x FROM lineitem) GROUP BY l_suppkey
""")
def q25_unknown_poisons_sum(spark, sf_dir):
    known = F.when((F.col("l_discount") < 0.1) | (F.col("l_orderkey") % 11 != 0), F.col("l_extendedprice"))
    return _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(packing.added_up(known), 2).alias("cost"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT src, id, CAST(row_number() OVER (ORDER BY src, id) AS BIGINT) AS ord FROM (SELECT 0 AS src, event_id AS id FROM events WHERE event_type = 'purchase' UNION ALL SELECT 1, o_orderkey FROM orders WHERE o_orderstatus = 'P')
""")
def q26_ordered_union(spark, sf_dir):
    first = _t(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.lit(0).alias("src"), F.col("event_id").alias("id"))
    both = first.unionByName(_t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.lit(1).alias("src"), F.col("o_orderkey").alias("id")))
    return store.assign_ids(both, ["src", "id"], name="ord").select("src", "id", "ord")


@query(r"""
SELECT doc_id, n, bad = 0 AS fine FROM (SELECT doc_id, CAST(len(l) AS INTEGER) AS n,
len(list_filter(l, lambda x: NOT regexp_full_match(x, '[0-9.]+') AND string_split(x, '/')[-1] NOT IN ('example.com', 'www.example.org'))) AS bad
FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_./\\-]+\.[A-Za-z0-9]{1,8}') AS l FROM documents))
""")
def q27_allowed_mentions(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    allowed = F.array(F.lit("https://example.com"), F.lit("www.example.org"))
    return docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(f"({text.FILE_LIKE})"), F.lit(1))).alias("n"), text.mentions_only(F.col("text"), allowed).alias("fine"))


@query("""
SELECT event_type, file, min(rank) AS place, sha1(string_agg(event_id || ':' || user_id, chr(10) ORDER BY rank)) AS body FROM (
SELECT event_type, 'u' || user_id % 5 AS file, event_id, user_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events) WHERE rank <= 200 GROUP BY event_type, file
""")
def q28_report_by_file(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    rows = _t(spark, sf_dir, "events").withColumn("rank", F.row_number().over(w)).filter("rank <= 200").withColumn("file", F.concat(F.lit("u"), F.col("user_id") % 5))
    made = render.by_file(rows, ["event_type"], F.concat_ws(":", "event_id", "user_id"))
    return made.select("event_type", "file", "place", F.sha1(F.col("body").cast("binary")).alias("body"))


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id FROM events GROUP BY user_id, event_type")
def q29_stream_upsert(spark, sf_dir):
    """A stream of the events table, run to its end, against the same table as a batch."""
    from ..streaming import reviews

    folder = scratch(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(_stream_folder(spark, sf_dir, folder))
    reviews.upsert_stream(rows.select("user_id", "event_type", "event_id"), f"{folder}/table", ["user_id", "event_type"], ["event_id"], f"{folder}/checkpoint").awaitTermination()
    return reviews.newest_version(spark, f"{folder}/table")


def _stream_folder(spark, sf_dir: str, folder: str) -> str:
    """events as a folder of files, which a file stream needs."""
    _t(spark, sf_dir, "events").repartitionByRange(4, "event_id").write.parquet(f"{folder}/in")
    return f"{folder}/in"


@query("""
SELECT event_type AS repo, event_id % 2 = 0 AS posted, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL
""")
def q30_nested_json_round_trip(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    entry = F.struct(F.col("event_id").cast("string").alias("fingerprint"), F.col("value").alias("confidence"))
    pick = lambda odd: F.collect_list(F.when(F.col("event_id") % 2 == odd, entry))
    body = events.groupBy("event_type", "user_id").agg(F.struct(pick(0).alias("findings"), pick(1).alias("dropped")).alias("outcome"))
    sent = body.select(F.to_json(F.struct(F.col("event_type").alias("repo"), "outcome")).alias("json"))
    got = sent.select(F.from_json("json", cases.INGEST).alias("r")).select("r.*")
    found = cases.ingest_findings(got.withColumns({c: F.coalesce(c, F.lit("")) for c in ("platform", "pr_number", "head_sha")}).withColumn("platform", F.col("repo")))
    return found.groupBy(F.col("platform").alias("repo"), "posted").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 2).alias("total"))


_PLANNED = """
SELECT source, lang, CASE WHEN lang = 'en' THEN 'review' ELSE 'verify' END AS phase, CAST(greatest(1, floor(length(text) / 4)) AS BIGINT) AS tokens,
round_even(greatest(1, floor(length(text) / 4)) * CASE lang WHEN 'en' THEN 0.000003 WHEN 'fr' THEN 0.000001 WHEN 'de' THEN 0.000002 END
+ 800 * CASE lang WHEN 'en' THEN 0.000015 WHEN 'fr' THEN 0.000005 WHEN 'de' THEN 0.0 END, 6) AS cost FROM documents
"""


def _planned(spark, sf_dir):
    """Every document as the prompt of a call, its language as the model; one language has no price."""
    prices = spark.createDataFrame([("en", 0.000003, 0.000015), ("fr", 0.000001, 0.000005), ("de", 0.000002, 0.0)], "model string, price_in double, price_out double")
    docs = _t(spark, sf_dir, "documents").select("source", "lang", F.col("lang").alias("model"), F.col("text").alias("prompt"), F.when(F.col("lang") == "en", "review").otherwise("verify").alias("phase"))
    return costs.plan(docs, prices)


@query(f"""
SELECT source, lang, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, CASE WHEN bool_and(cost IS NOT NULL) THEN round(sum(cost), 4) END AS cost FROM ({_PLANNED}) GROUP BY source, lang
""")
def q31_cost_plan(spark, sf_dir):
    return costs.summed(_planned(spark, sf_dir), ["source", "lang"]).withColumn("cost", F.round("cost", 4))


@query(f"""
WITH s AS (SELECT source, phase, count(*) AS calls, CASE WHEN bool_and(cost IS NOT NULL) THEN sum(cost) END AS cost FROM ({_PLANNED}) WHERE lang <> 'es' OR length(source) % 2 = 0 GROUP BY source, phase),
t AS (SELECT *, CASE WHEN count(*) FILTER (WHERE cost IS NULL) OVER w = 0 THEN sum(cost) OVER w END AS through FROM s WINDOW w AS (PARTITION BY source ORDER BY phase ROWS UNBOUNDED PRECEDING))
SELECT source, phase, calls, round(through, 4) AS through, NOT bool_or(coalesce(through > 0.4, false)) OVER (PARTITION BY source ORDER BY phase ROWS UNBOUNDED PRECEDING) AS runs FROM t
""")
def q32_phase_ceiling(spark, sf_dir):
    rows = _planned(spark, sf_dir).filter((F.col("lang") != "es") | (F.length("source") % 2 == 0))
    got = costs.phase_gate(rows, ["source"], F.lit(0.4), {"review": 0, "verify": 1})
    return got.select("source", "phase", "calls", F.round("through", 4).alias("through"), "runs")


@query("SELECT user_id, count(*) AS made, count(*) FILTER (WHERE value > 50) AS failed, count(*) = count(*) FILTER (WHERE value > 50) AS all_failed FROM events GROUP BY user_id")
def q33_call_tally(spark, sf_dir):
    return costs.tally(_t(spark, sf_dir, "events").select("user_id", (F.col("value") > 50).alias("failed")), ["user_id"])


@query("""
WITH n AS (SELECT event_type, 'user ' || user_id AS name, CAST(count(*) AS VARCHAR) AS t FROM events GROUP BY event_type, user_id),
w AS (SELECT *, max(length(name)) OVER (PARTITION BY event_type) AS w FROM n)
SELECT event_type, sha1(string_agg(rpad(name, CAST(w AS INTEGER), ' ') || '  ' || t, chr(10) ORDER BY name, t)) AS report FROM w GROUP BY event_type
""")
def q34_aligned_report(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").groupBy("event_type", F.concat(F.lit("user "), "user_id").alias("name")).agg(F.count(F.lit(1)).cast("string").alias("t"))
    return render.aligned(rows, ["event_type"], "name", "t").select("event_type", F.sha1(F.col("report").cast("binary")).alias("report"))


@query("""
WITH r AS (SELECT o_orderpriority AS review, 'f' || o_custkey % 7 AS file, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
f AS (SELECT review, file, min(rank) AS place, string_agg('- **' || o_orderstatus || '** line ' || o_orderkey || ': order', chr(10) ORDER BY rank) AS body FROM r GROUP BY review, file)
SELECT review, sha1(string_agg('### `' || file || '`' || chr(10) || body, chr(10) || chr(10) ORDER BY place)) AS text FROM f GROUP BY review
""")
def q35_markdown_report(spark, sf_dir):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    rows = _t(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(w))
    posted = rows.select(F.col("o_orderpriority").alias("review"), F.concat(F.lit("f"), F.col("o_custkey") % 7).alias("file"), F.col("o_orderkey").alias("line"), F.col("o_orderstatus").alias("severity"), F.lit("order").alias("title"), "rank")
    return render.markdown(posted, ["review"]).select("review", F.sha1(F.col("text").cast("binary")).alias("text"))
