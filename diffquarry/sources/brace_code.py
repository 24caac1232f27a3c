"""Functions of languages with braces as rows, by pattern and balanced braces; no grammar is needed.

Strings and comments are skipped when braces are counted. What isn't balanced gives no chunk.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Endings of files that this reads, with their languages.
LANGUAGES = {".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".cs": "csharp", ".swift": "swift", ".php": "php", ".scala": "scala"}
SKIP = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])+'", re.S)
#: What opens a function: a defining word and a name, an arrow bound to a name, or a name before its parameters and a brace.
OPENING = re.compile(
    r"\b(?:function\*?|func|fn|fun|def)\s+(?:\([^()]*\)\s*)?([A-Za-z_$][\w$]*)|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*=>(?=\s*\{)"
    r"|(?<![.\w$])([A-Za-z_$][\w$]*)\s*\((?:[^();{}]|\([^()]*\))*\)\s*(?:const\s*|noexcept\s*|override\s*|throws\s+[\w.,\s]+|:\s*[\w<>\[\]., |]+|->\s*[\w<>:&\[\]., ]+)*\{"
)
NO_NAMES = frozenset("if for while switch catch return else do try synchronized using lock foreach match sizeof new when with".split())


def blanked(text: str) -> str:
    """text with comments and strings as blanks, line ends kept."""
    return SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def read_functions(text: str | None) -> list[tuple[str, int, int]]:
    """(name, first line, last line) of each function, outer ones first."""
    plain = blanked(text or "")
    closes, stack = {}, []
    for m in re.finditer(r"[{}]", plain):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            closes[stack.pop()] = m.start()
    starts = [0, *(m.end() for m in re.finditer("\n", plain))]

    def line(at: int) -> int:
        import bisect

        return bisect.bisect_right(starts, at)

    found, seen = [], set()
    for m in OPENING.finditer(plain):
        name = m[1] or m[2] or m[3]
        at = plain.find("{", m.end() - 1 if m[3] else m.end())
        end = plain.find(";", m.end()) if not m[3] else -1
        if name in NO_NAMES or at < 0 or at not in closes or at in seen or 0 <= end < at:
            continue
        seen.add(at)
        found.append((name, line(m.start()), line(closes[at])))
    return found


def chunks(sources: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, ord, name, kind, start, end, header, text, language) of the functions of files whose ending LANGUAGES has."""

    def batches(it):
        for pdf in it:
            rows = []
            for p, t in zip(pdf["path"], pdf["text"], strict=True):
                language = LANGUAGES.get("." + p.rsplit(".", 1)[-1]) if p and "." in p else None
                if language is None:
                    continue
                lines = (t or "").split("\n")
                for i, (name, start, end) in enumerate(read_functions(t)):
                    rows.append((p, i, name, "function", start, end, lines[start - 1].strip(), "\n".join(lines[start - 1 : end]), language))
            yield pd.DataFrame(rows, columns=["path", "ord", "name", "kind", "start", "end", "header", "text", "language"])

    schema = "path string, ord int, name string, kind string, start int, end int, header string, text string, language string"
    return sources.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(batches, schema)
