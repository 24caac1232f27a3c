"""Python sources as rows: definitions, calls and imports by the standard parser.

A file with a syntax error gives no rows, as does a file of another language.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAM = "struct<name:string,kind:string,has_default:boolean>"
DEFINITION = f"struct<name:string,kind:string,owner:string,start:int,end:int,sig_end:int,decorated:boolean,childless:boolean,params:array<{PARAM}>>"
CALL = "struct<name:string,form:string,receiver:string,start:int,end:int,column:int,positional:int,keywords:array<string>,splat:boolean,text:string>"
IMPORT = "struct<module:string,name:string>"


def parameters(a: ast.arguments) -> list[dict]:
    """Parameters in order of declaration with their kinds and whether they have a default."""
    listed = [(p, "posonly") for p in a.posonlyargs] + [(p, "pos") for p in a.args]
    without = len(listed) - len(a.defaults)
    out = [{"name": p.arg, "kind": kind, "has_default": i >= without} for i, (p, kind) in enumerate(listed)]
    if a.vararg:
        out.append({"name": a.vararg.arg, "kind": "varargs", "has_default": False})
    out += [{"name": p.arg, "kind": "kwonly", "has_default": d is not None} for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
    if a.kwarg:
        out.append({"name": a.kwarg.arg, "kind": "varkw", "has_default": False})
    return out


class _Reader(ast.NodeVisitor):
    """Definitions outer first, calls in order, imports from modules."""

    def __init__(self, text: str):
        self.text, self.owners = text, [None]
        self.definitions, self.calls, self.imports = [], [], []

    def _definition(self, node, kind: str, params: list | None) -> None:
        inner = any(isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) for x in ast.walk(node) if x is not node)
        last = max([node.lineno, *(x.end_lineno for x in ast.walk(node.args) if hasattr(x, "end_lineno"))]) if params is not None else node.lineno
        self.definitions.append({"name": node.name, "kind": kind, "owner": self.owners[-1], "start": node.lineno, "end": node.end_lineno, "sig_end": last, "decorated": bool(node.decorator_list), "childless": not inner, "params": params or []})

    def visit_FunctionDef(self, node):  # noqa: N802
        self._definition(node, "method" if self.owners[-1] else "function", parameters(node.args))
        self.generic_visit(node)

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def visit_ClassDef(self, node):  # noqa: N802
        self._definition(node, "class", None)
        self.owners.append(node.name)
        self.generic_visit(node)
        self.owners.pop()

    def visit_Call(self, node):  # noqa: N802
        f = node.func
        form = "bare" if isinstance(f, ast.Name) else "attr" if isinstance(f, ast.Attribute) else None
        if form:
            splat = any(isinstance(x, ast.Starred) for x in node.args) or any(k.arg is None for k in node.keywords)
            receiver = ast.get_source_segment(self.text, f.value) or "" if form == "attr" else ""
            self.calls.append({"name": f.id if form == "bare" else f.attr, "form": form, "receiver": receiver, "start": node.lineno, "end": node.end_lineno, "column": node.col_offset, "positional": len(node.args), "keywords": [k.arg for k in node.keywords if k.arg], "splat": splat, "text": ast.get_source_segment(self.text, node) or ""})
        self.generic_visit(node)

    def visit_ImportFrom(self, node):  # noqa: N802
        if node.module:
            self.imports += [{"module": node.module.rsplit(".", 1)[-1], "name": x.name} for x in node.names]


def read_python(text: str | None) -> _Reader | None:
    try:
        reader = _Reader(text or "")
        reader.visit(ast.parse(text or ""))
        return reader
    except (SyntaxError, ValueError, RecursionError):
        return None


def parsed(sources: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, definitions, calls, imports) of each Python file that parses; repeated paths stay."""

    def batches(it):
        for pdf in it:
            rows = []
            for p, t in zip(pdf["path"], pdf["text"], strict=True):
                if p is not None and p.endswith(".py") and (r := read_python(t)) is not None:
                    rows.append((p, r.definitions, r.calls, r.imports))
            yield pd.DataFrame(rows, columns=["path", "definitions", "calls", "imports"])

    schema = f"path string, definitions array<{DEFINITION}>, calls array<{CALL}>, imports array<{IMPORT}>"
    return sources.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(batches, schema)


def definitions(files: DataFrame) -> DataFrame:
    """(path, ord, name, kind, owner, start, end, ...) in order, outer definitions first."""
    return files.select("path", F.posexplode("definitions").alias("ord", "d")).select("path", "ord", "d.*")


def calls(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode("calls").alias("ord", "c")).select("path", "ord", "c.*")


def imports(files: DataFrame) -> DataFrame:
    return files.select("path", F.explode("imports").alias("i")).select("path", "i.*").distinct()


def chunks(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, ord, name, kind, start, end, header, text) of functions, methods and classes without inner definitions."""
    from ..functions.text import split_lines

    lines = sources.select("path", split_lines(F.col("text")).alias("__lines"))
    found = definitions(files).filter((F.col("kind") != "class") | F.col("childless")).join(lines, "path")
    body = F.slice("__lines", F.col("start"), F.col("end") - F.col("start") + 1)
    return found.select("path", "ord", "name", "kind", "start", "end", F.trim(F.element_at("__lines", F.col("start"))).alias("header"), F.array_join(body, "\n").alias("text"))
