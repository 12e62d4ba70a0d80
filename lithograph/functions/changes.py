"""What changed between two versions of a definition, and drift from a module's error convention."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels from the weightiest to the lightest.
LABELS = ("deleted", "added", "signature_change", "return_type_change", "exception_change", "body_only", "unchanged")
#: Labels that callers can notice.
VISIBLE = ("deleted", "signature_change", "return_type_change", "exception_change")
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def definition(source: str) -> ast.stmt:
    """The one function or class at the top of a source; anything else is a ValueError."""
    try:
        found = [n for n in ast.parse(source).body if isinstance(n, (*_FUNCTION, ast.ClassDef))]
    except SyntaxError as error:
        raise ValueError(f"source does not parse: {error}") from error
    if len(found) != 1:
        raise ValueError(f"one definition at the top expected, {len(found)} found")
    return found[0]


def written(node: ast.stmt) -> str:
    """The head of a definition without its colon."""
    if isinstance(node, ast.ClassDef):
        bases = ", ".join(map(ast.unparse, node.bases))
        return f"class {node.name}({bases})" if bases else f"class {node.name}"
    word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    result = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return f"{word} {node.name}({', '.join(_parameters(node.args))}){result}"


def _parameters(args: ast.arguments) -> Iterator[str]:
    """Parameters with annotation and default, and the marks for positional-only and keyword-only ones."""

    def one(arg: ast.arg, stars: str = "", default: ast.expr | None = None) -> str:
        typed = f": {ast.unparse(arg.annotation)}" if arg.annotation else ""
        return f"{stars}{arg.arg}{typed}" + (f" = {ast.unparse(default)}" if default else "")

    defaults = iter([None] * (len(args.posonlyargs) + len(args.args) - len(args.defaults)) + list(args.defaults))
    yield from (one(a, "", next(defaults)) for a in args.posonlyargs)
    if args.posonlyargs:
        yield "/"
    yield from (one(a, "", next(defaults)) for a in args.args)
    if args.vararg or args.kwonlyargs:
        yield one(args.vararg, "*") if args.vararg else "*"
    yield from (one(a, "", d) for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True))
    if args.kwarg:
        yield one(args.kwarg, "**")


def raised(node: ast.AST) -> set[str]:
    """Dotted names of the exceptions that a definition raises anywhere within; a bare raise has none."""
    names = set()
    for inner in ast.walk(node):
        if isinstance(inner, ast.Raise) and inner.exc is not None:
            target = inner.exc.func if isinstance(inner.exc, ast.Call) else inner.exc
            parts: list[str] = []
            while isinstance(target, ast.Attribute):
                parts.append(target.attr)
                target = target.value
            if isinstance(target, ast.Name):
                parts.append(target.id)
            if parts:
                names.add(".".join(reversed(parts)))
    return names


def _without_doc(node: ast.stmt) -> list[str]:
    body = node.body
    if body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
        body = body[1:]
    return [ast.dump(s) for s in body]


def classify(before: str | None, after: str | None) -> dict:
    """classification, all_changes, both signatures and the exceptions added and removed. At least one side must be given."""
    if before is None and after is None:
        raise ValueError("a change has at least one side")
    old, new = (None if s is None else definition(s) for s in (before, after))
    seen: set[str] = set()
    gone: set[str] = set()
    come: set[str] = set()
    if old is None or new is None:
        seen = {"added" if old is None else "deleted"}
    elif isinstance(old, _FUNCTION) and isinstance(new, _FUNCTION):
        gone, come = raised(old) - raised(new), raised(new) - raised(old)
        tests = {
            "signature_change": ast.dump(old.args) != ast.dump(new.args),
            "return_type_change": (old.returns and ast.dump(old.returns)) != (new.returns and ast.dump(new.returns)),
            "exception_change": bool(gone or come),
            "body_only": _without_doc(old) != _without_doc(new),
        }
        seen = {label for label, differs in tests.items() if differs}
    elif isinstance(old, ast.ClassDef) and isinstance(new, ast.ClassDef):
        heads = [[ast.dump(x) for x in (*n.bases, *n.keywords)] for n in (old, new)]
        seen = {"body_only"} if heads[0] != heads[1] or _without_doc(old) != _without_doc(new) else set()
    else:
        seen = {"signature_change"}
    ordered = [label for label in LABELS if label in seen] or ["unchanged"]
    return {"classification": ordered[0], "all_changes": ordered, "before_signature": old and written(old), "after_signature": new and written(new), "added_exceptions": sorted(come), "removed_exceptions": sorted(gone), "error": None}


_FIELDS = {"classification": T.StringType(), "all_changes": T.ArrayType(T.StringType()), "before_signature": T.StringType(), "after_signature": T.StringType(), "added_exceptions": T.ArrayType(T.StringType()), "removed_exceptions": T.ArrayType(T.StringType()), "error": T.StringType()}
CHANGE = T.StructType([T.StructField(name, kind) for name, kind in _FIELDS.items()])


@F.pandas_udf(CHANGE)
def _classified(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    rows, seen = [], {}
    for one, two in zip(before, after, strict=True):
        pair = (one if isinstance(one, str) else None, two if isinstance(two, str) else None)
        # A definition that many pull requests change comes many times.
        if pair not in seen:
            try:
                seen[pair] = classify(*pair)
            except (ValueError, RecursionError) as error:
                seen[pair] = {"classification": None, "all_changes": None, "before_signature": None, "after_signature": None, "added_exceptions": None, "removed_exceptions": None, "error": str(error)}
        rows.append(seen[pair])
    return pd.DataFrame(rows, columns=CHANGE.names)


def change(before: Column, after: Column) -> Column:
    """``classify`` for columns. A pair it cannot judge has a null classification and says why in ``error``."""
    return _classified(before, after)


def _shape(path: str, source: object) -> list[dict]:
    try:
        tree = ast.parse(source) if isinstance(source, str) else ast.Module([], [])
    except (SyntaxError, ValueError, RecursionError):
        return []
    typed = any(isinstance(n, ast.ImportFrom) and (n.module or "").endswith("exceptions") for n in ast.walk(tree))
    rows = []
    for node in tree.body:
        if isinstance(node, _FUNCTION) and not node.name.startswith("_") and isinstance(node.returns, ast.Subscript):
            base = node.returns.value
            name = base.id if isinstance(base, ast.Name) else getattr(base, "attr", "")
            inner = node.returns.slice.elts if isinstance(node.returns.slice, ast.Tuple) else [node.returns.slice]
            first = inner[0].id if inner and isinstance(inner[0], ast.Name) else ""
            listed = len(inner) > 1 and isinstance(inner[1], ast.Subscript) and getattr(inner[1].value, "id", getattr(inner[1].value, "attr", "")) in ("list", "List")
            status = name in ("tuple", "Tuple") and len(inner) > 1 and (first == "bool" or (first == "int" and listed))
            rows.append({"path": path, "function_name": node.name, "annotation": ast.unparse(node.returns), "is_status": status, "typed": typed})
    return rows or [{"path": path, "function_name": None, "annotation": None, "is_status": False, "typed": typed}]


def status_return_drift(files: DataFrame, module: str) -> DataFrame:
    """Key, path, function_name, annotation of new functions that report failure by a status tuple.

    ``files`` has key, path, content and changed for all files of the module
    (a directory prefix) in each change ``key``. A finding needs a file of the
    module that imports from its exceptions, and no unchanged file that already
    returns status tuples.
    """
    rows = files.where(F.col("path").startswith(module)).select("key", "path", "content", "changed")

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [{"key": k, "changed": bool(c), **row} for k, p, s, c in frame.itertuples(index=False) for row in _shape(p, s)]
            yield pd.DataFrame(out, columns=["key", "changed", "path", "function_name", "annotation", "is_status", "typed"])

    kind = rows.schema["key"].dataType.simpleString()
    shapes = rows.mapInPandas(look, f"key {kind}, changed boolean, path string, function_name string, annotation string, is_status boolean, typed boolean")
    fits = shapes.groupBy("key").agg(F.bool_or("typed").alias("typed_module"), F.bool_or(F.col("is_status") & ~F.col("changed")).alias("usual")).where(F.col("typed_module") & ~F.col("usual"))
    return shapes.where(F.col("changed") & F.col("is_status")).join(fits, "key").select("key", "path", "function_name", "annotation")
