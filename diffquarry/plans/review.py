"""From diffs and sources to verdicts in one lazy plan: changed chunks, callers, callees, hops, packed context, gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calls import callee_names, called_names, defined_names, signature
from ..functions.text import estimate_tokens, fingerprint, split_lines
from ..operators import diff, gate, intervals, packing

# How many callers, indirect callers and callees of a changed function are shown, and how far.
CALLERS, INDIRECT, CALLEES, DEPTH = 5, 2, 4, 2
# Names looked up for one changed function.
LOOKUPS = 10


def source_lines(sources: DataFrame) -> DataFrame:
    """(path, line, text) of each source, numbered from 1."""
    return sources.select("path", F.posexplode(split_lines(F.col("text"))).alias("n", "text")).select("path", (F.col("n") + 1).alias("line"), "text")


def call_index(lines: DataFrame, per_file: int | None = None) -> DataFrame:
    """(name, path, line, text) of every call in lines that aren't definitions of that name; names of two letters at least.

    per_file: lines of a file that a name is looked up in at most, definitions among them, as a search tool limits itself.
    """
    if per_file is not None:
        named = lines.select("path", "line", "text", F.explode(called_names(F.col("text"))).alias("name")).filter(F.length("name") >= 2)
        first = named.withColumn("__n", F.row_number().over(Window.partitionBy("name", "path").orderBy("line"))).filter(F.col("__n") <= per_file)
        return first.filter(~F.array_contains(defined_names(F.col("text")), F.col("name"))).select("name", "path", "line", F.trim("text").alias("text"))
    found = lines.select("path", "line", F.trim("text").alias("text"), F.explode(F.array_except(called_names(F.col("text")), defined_names(F.col("text")))).alias("name"))
    return found.filter(F.length("name") >= 2)


def definition_index(lines: DataFrame) -> DataFrame:
    """(name, path, line, n): definition lines, and how many the name has."""
    found = lines.select("path", "line", F.explode(defined_names(F.col("text"))).alias("name"))
    return found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("name")))


def changed_chunks(added: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct innermost chunks around added lines (path, line)."""
    met = intervals.enclosing(added.select("path", F.col("line").alias("at")), chunks, ["path"], "at", "start", "end", ["ord"])
    return met.drop("at").distinct()


def signature_changed(head: DataFrame, base: DataFrame) -> DataFrame:
    """head chunks with promoted: the same (path, name) had another signature before."""
    old = gate.first_per(base, ["path", "name"], ["ord"]).select("path", "name", signature(F.col("text")).alias("__old"))
    return head.join(old, ["path", "name"], "left").withColumn("promoted", F.coalesce(F.col("__old") != signature(F.col("text")), F.lit(False))).drop("__old")


def callers(symbols: DataFrame, index: DataFrame, most: int = CALLERS) -> DataFrame:
    """symbols (path, name, start, end) with at_path, at_line, at_text of the nearest calls outside of themselves."""
    hits = index.select("name", F.col("path").alias("at_path"), F.col("line").alias("at_line"), F.col("text").alias("at_text"))
    met = symbols.join(hits, "name").filter(~((F.col("path") == F.col("at_path")) & F.col("at_line").between(F.col("start"), F.col("end"))))
    return intervals.nearest_paths(met, ["path", "name"], "path", "at_path", ["at_line"], most)


def callees(chunks: DataFrame, added: DataFrame, lines: DataFrame, definitions: DataFrame, most: int = CALLEES) -> DataFrame:
    """chunks with the one definition of each name that their added lines call: (path, name, callee, at_path, at_line)."""
    new = lines.join(added, ["path", "line"]).withColumnsRenamed({"line": "l", "text": "t"})
    own = chunks.join(new, "path").filter(F.col("l").between(F.col("start"), F.col("end")))
    rows = own.groupBy("path", "name", "start").agg(F.array_sort(F.collect_list(F.struct("l", "t"))).alias("x"))
    named = rows.select("path", "name", "start", F.posexplode(F.slice(callee_names(F.col("x.t"), F.col("name")), 1, LOOKUPS)).alias("place", "callee"))
    single = definitions.filter("n = 1").select(F.col("name").alias("callee"), F.col("path").alias("at_path"), F.col("line").alias("at_line"))
    w = Window.partitionBy("path", "name", "start").orderBy("place")
    return named.join(single, "callee").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def context_blocks(chunks: DataFrame, changed: DataFrame, index: DataFrame, found_callees: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(path, start, end, label, text, tier, must_include, ord): changed code, callers, callees, then callers of callers.

    changed needs path, name, start, end, text and promoted. A span is shown once, by its first tier; changed spans are
    never shown again as context. Callers of a changed signature must be included.
    """
    outer = chunks.select(F.col("path").alias("at_path"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("name").alias("in_name"), F.col("text").alias("in_text"), F.col("ord").alias("in_ord"))
    made = changed.select("path", "start", "end", "name", "text", F.lit(0).alias("tier"), F.lit(True).alias("must_include"))
    front = changed.select("path", "name", "start", "end", F.col("promoted").alias("must"))
    for hop in range(1, depth + 1):
        hits = callers(front, index, CALLERS if hop == 1 else INDIRECT)
        inside = intervals.enclosing(hits, outer, ["at_path"], "at_line", "s", "e", ["in_ord"], innermost=False)
        spans = inside.groupBy(F.col("at_path").alias("path"), F.col("s").alias("start"), F.col("e").alias("end"), F.col("in_name").alias("name"), F.col("in_text").alias("text")).agg(F.max("must").alias("must"))
        made = made.unionByName(spans.select("path", "start", "end", "name", "text", F.lit(hop if hop == 1 else hop + 1).alias("tier"), F.col("must").alias("must_include")))
        front = spans.select("path", "name", "start", "end", F.lit(False).alias("must"))
    target = found_callees.select("at_path", "at_line").distinct()
    named = intervals.enclosing(target, outer, ["at_path"], "at_line", "s", "e", ["in_ord"], innermost=False)
    made = made.unionByName(named.select(F.col("at_path").alias("path"), F.col("s").alias("start"), F.col("e").alias("end"), F.col("in_name").alias("name"), F.col("in_text").alias("text"), F.lit(2).alias("tier"), F.lit(False).alias("must_include")))
    once = gate.first_per(made, ["path", "start", "end"], ["tier", F.desc("must_include"), "name"])
    label = F.concat("path", F.lit(":"), "start", F.lit(" "), "name")
    return once.withColumn("label", label).withColumn("ord", F.struct("tier", "path", "start"))


def packed_context(blocks: DataFrame, group: list[str], budget: int = packing.CONTEXT_TOKENS) -> DataFrame:
    """blocks with kept; a block that doesn't fit is tried by its first line."""
    head = F.substring_index("text", "\n", 1)
    sized = blocks.withColumn("size", estimate_tokens(F.col("text"))).withColumn("short", estimate_tokens(head))
    return packing.pack(sized, group, ["tier", "path", "start"], "size", "short", "must_include", budget)


def hunk_groups(hunks: DataFrame, key: str = "diff_id", most: int = packing.CALL_TOKENS) -> DataFrame:
    """hunks with bin: which call of their file they go to; a hunk is never split."""
    text = F.concat(F.col("header"), F.lit("\n"), F.array_join("lines", "\n"))
    return packing.bins(hunks.withColumn("size", estimate_tokens(text)), [key, "path"], ["hunk_ord"], "size", most)


def review(diffs: DataFrame, sources: DataFrame, findings: DataFrame, verdicts: DataFrame, memory: DataFrame, key: str = "diff_id", least: float = gate.LEAST_CONFIDENCE, most: int = gate.MOST_POSTED) -> DataFrame:
    """findings with the gate's columns.

    diffs: (key, diff); sources: (path, text) of the head; findings: (key, ord, file, line, category, severity,
    confidence, title, quoted_code, proof); verdicts: (key, ord, is_real, is_actionable, verifier); memory: (key,
    fingerprint). Verdicts are joined only with findings that pass the checks that cost nothing.
    """
    hunk_rows = diff.hunks(diff.diff_lines(diffs, key), key)
    lines = source_lines(sources)
    added = diff.added_lines(hunk_rows, key)
    texts = added.join(lines, ["path", "line"]).select(key, "path", "line", "text")
    rows = diff.nearby_text(findings, texts, key)
    body = hunk_rows.groupBy(key, F.col("path").alias("file")).agg(F.collect_list(F.array_join("lines", "\n")).alias("__hunks"))
    whole = sources.select(F.col("path").alias("file"), F.col("text").alias("__whole"))
    rows = rows.join(body, [key, "file"], "left").join(whole, "file", "left")
    evidence = F.filter(F.concat(F.coalesce("__hunks", F.array().cast("array<string>")), F.array("__whole")), lambda x: x.isNotNull())
    rows = rows.withColumn("quote_ok", gate.quote_in(F.col("quoted_code"), evidence)).drop("__hunks", "__whole")
    placed = diff.in_any_hunk(rows.select(key, "ord", "file", "line"), hunk_rows, key).select(key, "ord", F.lit(True).alias("loc_ok"))
    rows = rows.join(placed, [key, "ord"], "left").fillna(False, ["loc_ok"])
    rows = rows.withColumn("fingerprint", fingerprint(F.col("file"), F.col("text"), F.col("category"), F.col("quoted_code")))
    rows = rows.join(memory.select(key, "fingerprint").distinct().withColumn("in_memory", F.lit(True)), [key, "fingerprint"], "left").fillna(False, ["in_memory"])
    free = rows.filter("quote_ok and loc_ok and not in_memory").select(key, "ord")
    asked = verdicts.join(free, [key, "ord"], "left_semi")
    return gate.cascade(rows.join(asked, [key, "ord"], "left"), [key], "ord", least, most)
