"""The source behind an entity: signature, documentation, and a piece of its text."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame

from graphloom.sources.extract.javascript import _Module

SNIPPET = 1200
_FIELDS = "signature string, docstring string, snippet string, start_line int, end_line int"


def _empty() -> dict:
    return {"signature": "", "docstring": "", "snippet": "", "start_line": None, "end_line": None}


def _cut(lines: list[str], first: int, last: int) -> str:
    return "\n".join(lines[first - 1 : last])[:SNIPPET]


def _python(text: str, name: str) -> dict:
    lines = text.split("\n")
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and node.name == name:
            head = "\n".join(lines[node.lineno - 1 : max(node.lineno, node.body[0].lineno - 1)])
            signature = re.sub(r"\s+", " ", head).strip().rstrip(":")
            return {"signature": signature, "docstring": ast.get_docstring(node) or "", "snippet": _cut(lines, node.lineno, node.end_lineno), "start_line": node.lineno, "end_line": node.end_lineno}
    return _empty()


def _javascript(text: str, path: str, name: str) -> dict:
    m = _Module(text, path)
    for at, end, found in m.functions:
        if found == name:
            stop = min(end, len(m.t) - 1)
            first, last = m.t[at].line, m.t[stop].line
            lines = text.split("\n")
            above = text[: text.rfind("\n", 0, m.t[at].start) + 1].rstrip()
            comment = re.search(r"/\*\*(.*?)\*/\s*$", above, re.DOTALL)
            doc = re.sub(r"^\s*\*? ?", "", comment[1], flags=re.MULTILINE).strip() if comment else ""
            params = text[m.t[at + 1].start : m.t[m.pair[at + 1]].end] if m.at(at + 1) == "(" and at + 1 in m.pair else ""
            return {"signature": name + params, "docstring": doc, "snippet": _cut(lines, first, last), "start_line": first, "end_line": last}
    return _empty()


def context(text: str, path: str, name: str) -> dict:
    """What can be told of an entity; empty fields for the rest. Never raises."""
    try:
        if path.endswith(".py"):
            return _python(text, name)
        if path.endswith((".js", ".ts", ".tsx")):
            return _javascript(text, path, name)
    except Exception:  # a source that can't be parsed tells nothing
        pass
    return _empty()


def with_context(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, signature, docstring, snippet, start_line, end_line) of nodes (id, name, file), read from files (path, content)."""

    def read(batches):
        for batch in batches:
            rows = []
            for i, name, path, content in zip(batch["id"], batch["name"], batch["path"], batch["content"], strict=True):
                text = content.decode("utf-8", "replace") if isinstance(content, bytes | bytearray) else content or ""
                rows.append({"id": i, **context(text, path, name)})
            out = pd.DataFrame(rows, columns=["id", "signature", "docstring", "snippet", "start_line", "end_line"])
            yield out.astype({"start_line": "Int32", "end_line": "Int32"})

    joined = nodes.select("id", "name", "file").join(files.withColumnRenamed("path", "file"), "file").withColumnRenamed("file", "path")
    return joined.select("id", "name", "path", "content").mapInPandas(read, "id string, " + _FIELDS)
