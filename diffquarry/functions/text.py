"""Scalar text functions as Column expressions: white space, lines, hashes, redaction, estimates, markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# All code points that count as white space, as a class for Java's regular expressions.
WS = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Line ends.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
# What looks like a credential and is replaced in messages.
KEY_LIKE = r"(sk-[A-Za-z0-9_-]{8,}|nvapi-[A-Za-z0-9_-]{8,}|gh[pousr]_[A-Za-z0-9]{8,}|AKIA[0-9A-Z]{12,}|Bearer\s+\S+|[A-Za-z0-9_-]{32,})"
REDACTED = "[redacted]"
# A credential inside a setting, stricter than KEY_LIKE.
SETTING_KEY = r"\b(sk-[A-Za-z0-9_-]{10,}|nvapi-[A-Za-z0-9_-]{10,}|gh[pousr]_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16})\b"
# Characters a token, and the longest description of an error.
CHARS_PER_TOKEN = 3.5
LONGEST_ERROR = 240
# Weight of each severity; others weigh as the lowest.
SEVERITY_WEIGHT = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def split_lines(text: Column) -> Column:
    """Lines of a text without their ends; no empty line after a final end; empty text has none."""
    parts = F.split(text, LINE_END)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(whole)


def collapse_space(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def strip_space(text: Column) -> Column:
    """All white space gone."""
    return F.regexp_replace(text, WS, "")


def gram_hashes(text: Column, width: int) -> Column:
    """Hashes of all runs of width characters; none for a shorter text. In UTF-32 each run is a slice of fixed size."""
    size = 4 * width
    runs = lambda b: F.transform(F.sequence(F.lit(1), F.length(b) - size + 1, F.lit(4)), lambda i: F.xxhash64(F.substring(b, i, F.lit(size))))
    none = F.array().cast("array<bigint>")
    return F.get(F.transform(F.array(F.encode(text, "UTF-32")), lambda b: F.when(F.length(b) >= size, runs(b)).otherwise(none)), F.lit(0))


def estimate_tokens(text: Column) -> Column:
    """length / 3.5 rounded down, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN)).cast("int")


def content_hash(text: Column) -> Column:
    """16 hex digits of the SHA-1 of the lower-cased text with white space collapsed."""
    return F.substring(F.sha1(F.lower(collapse_space(text)).cast("binary")), 1, 16)


def fingerprint(file: Column, hunk: Column, category: Column, quoted: Column) -> Column:
    """40 hex digits that identify a finding by file, changed text, category and quotation; nulls count as empty."""
    parts = [F.coalesce(file, F.lit("")), content_hash(F.coalesce(hunk, F.lit(""))), F.coalesce(category, F.lit("")), content_hash(F.coalesce(quoted, F.lit("")))]
    return F.sha1(F.concat_ws("|", *parts).cast("binary"))


def redact(text: Column) -> Column:
    """What looks like a key replaced, everywhere."""
    return F.regexp_replace(text, KEY_LIKE, REDACTED)


def redactions(text: Column) -> Column:
    """(hits, text): how many keys redact() replaces, and its result, from one pass."""
    pieces = F.split(text, KEY_LIKE, -1)
    return F.get(F.transform(F.array(pieces), lambda p: F.struct((F.size(p) - 1).alias("hits"), F.array_join(p, REDACTED).alias("text"))), F.lit(0))


def has_setting_key(text: Column) -> Column:
    return text.rlike(SETTING_KEY)


def describe_error(kind: Column, message: Column) -> Column:
    """'kind: first line that isn't blank', redacted, 240 characters at most."""
    lines = F.filter(F.transform(split_lines(message), lambda x: F.regexp_replace(x, f"^{WS}+|{WS}+$", "")), lambda x: x != "")
    first = F.get(lines, F.lit(0))
    return shorten(redact(F.when(first.isNull(), kind).otherwise(F.concat(kind, F.lit(": "), first))), LONGEST_ERROR, "...")


def shorten(text: Column, most: int, mark: str) -> Column:
    """The text, or its start and mark, most characters in all."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - len(mark)), F.lit(mark)))


def one_line(text: Column, most: int = 90) -> Column:
    """White space collapsed, cut to most characters with an ellipsis."""
    return shorten(collapse_space(text), most, "…")


def normal_url(url: Column) -> Column:
    """Trimmed, without final slashes; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(url, f"^{WS}+|{WS}+$", ""), "/+$", ""), F.lit(""))


def strip_fence(text: Column) -> Column:
    """A JSON answer without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def combined_confidence(reviewer: Column, real: Column, actionable: Column, verifier: Column) -> Column:
    """clamp(reviewer) * verifier if both flags hold, else 0."""
    return F.when(real & actionable, clamp(reviewer) * verifier).otherwise(F.lit(0.0))


def severity_weight(severity: Column) -> Column:
    made = F.lit(SEVERITY_WEIGHT["low"])
    for name, weight in SEVERITY_WEIGHT.items():
        made = F.when(severity == name, F.lit(weight)).otherwise(made)
    return made


def score(severity: Column, combined: Column) -> Column:
    """Severity weight times combined confidence, which counts as 0 if null."""
    return severity_weight(severity) * F.coalesce(combined, F.lit(0.0))


def cost_estimate(prompt: Column, price_in: Column, price_out: Column, answer_tokens: int = 800) -> Column:
    """(tokens, cost): a quarter of the characters, 1 at least; cost is null if a price is."""
    tokens = F.greatest(F.lit(1), F.floor(F.length(prompt) / 4)).cast("long")
    return F.struct(tokens.alias("tokens"), F.bround(tokens * price_in + answer_tokens * price_out, 6).alias("cost"))


def over_ceiling(cost: Column, ceiling: Column) -> Column:
    """Known cost above a known ceiling."""
    return F.coalesce(cost > ceiling, F.lit(False))


def source_signal(source: Column) -> Column:
    """What stands after the colon of 'platform:signal', or ''."""
    return F.split_part(source, F.lit(":"), F.lit(2))


MARKER, FINDING_MARKER = "review-fingerprints", "review-finding"


def encode_marker(fingerprints: Column) -> Column:
    """Sorted fingerprints, each once, in an HTML comment; '' without any."""
    return F.when(F.size(fingerprints) > 0, F.concat(F.lit(f"<!-- {MARKER} "), F.array_join(F.array_sort(F.array_distinct(fingerprints)), " "), F.lit(" -->"))).otherwise(F.lit(""))


def decode_marker(body: Column) -> Column:
    """The fingerprints of the first marker of a text; none without one or without its end."""
    inside = F.regexp_extract(F.coalesce(body, F.lit("")), rf"(?s)<!-- {MARKER} (.*?)-->", 1)
    return F.filter(F.split(inside, r"\s+"), lambda x: x != "")


def encode_finding_marker(print_: Column) -> Column:
    return F.concat(F.lit(f"<!-- {FINDING_MARKER} "), print_, F.lit(" -->"))


def decode_finding_marker(body: Column) -> Column:
    """The fingerprint in a comment's marker, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(body, F.lit("")), rf"<!-- {FINDING_MARKER} ([0-9a-f]+) -->", 1), F.lit(""))


def has_marker(body: Column) -> Column:
    return F.coalesce(body, F.lit("")).contains(f"<!-- {MARKER} ")


# What a failed verifier call is recorded as.
CALL_FAILED = "verifier call failed"


def verdict_note(stage: Column, reason: Column, real: Column, actionable: Column, reviewer: Column, verifier: Column, combined: Column, least: float) -> Column:
    """Why the verifier turned a finding away; '' for drops that never reached it."""
    product = F.format_string(f"reviewer %.2f x verifier %.2f = %.2f, needs {least:.2f}", reviewer, verifier, combined)
    reached = stage.eqNullSafe(F.lit("low_confidence")) & verifier.isNotNull()
    return (
        F.when(~reached, F.lit("")).when(reason.eqNullSafe(F.lit(CALL_FAILED)), F.lit("verifier call failed"))
        .when(~real, F.lit("verifier: not real")).when(~actionable, F.lit("verifier: real, not worth fixing")).otherwise(product)
    )


def meta_line(parts: list[Column]) -> Column:
    """Known parts between middle dots."""
    return F.concat_ws(" · ", *parts)


def cost_text(cost: Column) -> Column:
    return F.when(cost.isNull(), F.lit("unknown")).otherwise(F.format_string("$%.4f", cost))


# File-like tokens of prose.
FILE_LIKE = r"[\p{L}\p{N}_./\\-]+\.[A-Za-z0-9]{1,8}"


def mentions_only(prose: Column, allowed: Column) -> Column:
    """Whether every file-like token of prose is in the array allowed, by path or last part; numbers don't count."""
    tokens = F.regexp_extract_all(F.coalesce(prose, F.lit("")), F.lit(f"({FILE_LIKE})"), F.lit(1))
    last = lambda p: F.element_at(F.split(p, "/"), -1)
    bases = F.transform(allowed, last)
    return F.forall(F.filter(tokens, lambda t: ~t.rlike(r"^[0-9.]+$")), lambda t: F.array_contains(allowed, t) | F.array_contains(bases, last(t)))
