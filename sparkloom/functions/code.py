"""Python sources as data: a row per function, with its arguments."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARGUMENT = "struct<name: string, type_hint: string, default: string, is_kwarg: boolean, is_variadic: boolean>"
FUNCTION = f"array<struct<name: string, owner: string, args: array<{ARGUMENT}>, docstring: string, first_line: int, last_line: int>>"


def _argument(a: ast.arg, default: ast.expr | None, kwarg: bool, variadic: bool) -> dict:
    return {"name": a.arg, "type_hint": ast.unparse(a.annotation) if a.annotation else None, "default": ast.unparse(default) if default is not None else None, "is_kwarg": kwarg, "is_variadic": variadic}


def functions_of(source: str) -> list[dict]:
    """The functions and methods of a module, nested ones included, in the order of their lines; none if it doesn't
    parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out = []
    todo: list[tuple[ast.AST, str]] = [(tree, "")]
    while todo:
        node, owner = todo.pop()
        for child in ast.iter_child_nodes(node):
            name = getattr(child, "name", None) if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) else None
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = child.args
                plain = [*a.posonlyargs, *a.args]
                defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
                args = [_argument(x, d, False, False) for x, d in zip(plain, defaults, strict=True)]
                args += [_argument(a.vararg, None, False, True)] if a.vararg else []
                args += [_argument(x, d, True, False) for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
                args += [_argument(a.kwarg, None, True, True)] if a.kwarg else []
                out.append({"name": child.name, "owner": owner or None, "args": args, "docstring": ast.get_docstring(child), "first_line": child.lineno, "last_line": child.end_lineno})
            todo.append((child, f"{owner}.{name}" if owner and name else name or owner))
    return sorted(out, key=lambda f: (f["first_line"], f["name"]))


def functions_in(source: Column) -> Column:
    """Array of a source's functions."""
    kind = pa.list_(pa.struct([("name", pa.string()), ("owner", pa.string()), ("args", pa.list_(pa.struct([("name", pa.string()), ("type_hint", pa.string()), ("default", pa.string()), ("is_kwarg", pa.bool_()), ("is_variadic", pa.bool_())]))), ("docstring", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32())]))

    @F.arrow_udf(FUNCTION)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([functions_of(s or "") for s in batch.to_pylist()], kind)

    return scanned(source)


def function_rows(files: DataFrame, path: str, source: str) -> DataFrame:
    """A row per function of the files: path, name, owner, args, docstring and lines."""
    return files.select(F.col(path).alias("path"), functions_in(F.col(source)).alias("f")).select("path", F.inline("f"))
