"""Calls and definitions in source lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calls on the own object, and words that open a definition.
OWN_CALL = r"\b(?:self|cls|this)\.([A-Za-z_]\w*)\s*\("
DEFINING = ("def", "function", "func", "fn")
# Names that are no callees.
NOT_CALLEES = (
    "if elif else for while switch catch with return yield await assert raise try except finally "
    "and or not in is lambda class def function func fn new delete typeof sizeof "
    "print len range str int float bool list dict set tuple bytes type object super isinstance issubclass "
    "open sorted reversed min max sum any all map filter zip enumerate repr id iter next hash round abs "
    "getattr setattr hasattr callable format join append extend"
).split()


def is_comment(line: Column) -> Column:
    return F.ltrim(line).rlike(r"^(#|//|\*|/\*)")


def callee_names(lines: Column, own: Column) -> Column:
    """Distinct names called on an array of lines in order of first appearance: per line bare calls, then own ones."""
    definer = "|".join(DEFINING)
    #: One pass: a defining word is taken along with the name after it, so that the match can be told from a call.
    either = rf"(?:(?<!\w)(?:{definer})\s{{1,8}}|(?<![\w.]))[A-Za-z_]\w*+\s*+\("

    def on_line(line):
        calls = F.filter(F.regexp_extract_all(line, F.lit(either), F.lit(0)), lambda x: ~x.rlike(rf"^(?:{definer})\s+\w"))
        bare = F.transform(calls, lambda x: F.regexp_extract(x, r"^\w+", 0))
        return F.concat(bare, F.regexp_extract_all(line, F.lit(OWN_CALL), F.lit(1)))

    found = F.flatten(F.transform(F.filter(lines, lambda x: ~is_comment(x)), on_line))
    fits = lambda n: (F.length(n) >= 3) & ~n.isin(NOT_CALLEES) & ~n.eqNullSafe(own)
    return F.array_distinct(F.filter(found, fits))


def called_names(line: Column) -> Column:
    """Every name that stands before an opening parenthesis, for a join on names instead of a pattern per name."""
    return F.array_distinct(F.regexp_extract_all(line, F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)))


def defined_names(line: Column) -> Column:
    """Names that the line defines."""
    return F.array_distinct(F.regexp_extract_all(line, F.lit(rf"\b(?:{'|'.join(DEFINING)})\s+([A-Za-z_]\w*)\s*\("), F.lit(1)))


def shared_depth(a: Column, b: Column) -> Column:
    """How many leading directories two paths share."""
    left, right = (F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1) for p in (a, b))
    same = F.zip_with(left, right, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    first_difference = F.array_position(F.concat(same, F.array(F.lit(False))), False)
    return (first_difference - 1).cast("int")


def signature(text: Column) -> Column:
    """The header of a definition through the line of its balanced closing parenthesis, white space collapsed.

    Without a readable parameter list it is the first line.
    """
    chars = F.split(text, "")
    state = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end")),  # depth stays 0 until the first "("
        lambda s, c: F.struct(
            (s["depth"] + F.when(s["end"] > 0, 0).when(c == "(", 1).when((c == ")") & (s["depth"] > 0), -1).otherwise(0)).alias("depth"),
            (s["at"] + 1).alias("at"),
            F.when(s["end"] > 0, s["end"]).when((c == ")") & (s["depth"] == 1), s["at"] + 1).otherwise(F.lit(0)).alias("end"),
        ),
    )
    from .text import collapse_space

    rest = F.locate("\n", text, 1)
    end = state["end"]
    cut = F.when(end > 0, F.concat(F.substring(text, F.lit(1), end), F.substring_index(F.substring(text, end + 1, F.length(text)), "\n", 1))).when(rest > 0, F.substring_index(text, "\n", 1)).otherwise(text)
    return collapse_space(cut)
