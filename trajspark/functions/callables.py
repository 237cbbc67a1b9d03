"""Callables of Python sources, from their syntax trees."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "file_path string, qualified_name string, name string, start_line int, end_line int, source string"


def callables(source: str | None, file_path: str) -> list[tuple]:
    """(path, qualified name, name, first line with decorators, last line, own text) of each function; none if the source has no valid syntax."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return []
    lines, out = (source or "").split("\n"), []

    def visit(node: ast.AST, prefix: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                visit(child, f"{prefix}{child.name}.")
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                start = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                out.append((file_path, prefix + child.name, child.name, start, child.end_lineno, "\n".join(lines[start - 1 : child.end_lineno])))
                visit(child, f"{prefix}{child.name}.<locals>.")
            else:
                visit(child, prefix)

    visit(tree, "")
    return out


def extract_callables(sources: DataFrame) -> DataFrame:
    """Callables of each row (file_path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [c for p, s in zip(f["file_path"], f["content"], strict=True) for c in callables(s, p)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return sources.select("file_path", "content").mapInPandas(run, SCHEMA)
