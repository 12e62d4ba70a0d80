"""Symbols, imports and calls of Python sources, from one parse of each file.

Python's own parser is used. A file that does not parse has no rows, where a
parser that recovers from errors might find some.
"""

from __future__ import annotations

import ast
import hashlib
import io
import tokenize
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithograph.functions.text import LANGUAGE_EXTENSIONS

SYMBOL = "struct<qualified_name: string, kind: string, signature: string, ast_hash: string, start_line: int, end_line: int>"
IMPORT = "struct<place: int, raw: string, module: string, symbol: string, alias: string, kind: string, lazy: boolean>"
CALL = "struct<caller_qualified_name: string, target_name: string, line: int, kind: string, dynamic: boolean>"
_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)


def _is_text(node: ast.stmt) -> bool:
    return isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str)


def ast_hash(node: ast.AST) -> str:
    """SHA-256 of a node's structure, names and literals. Comments, layout, decorators and the first bare string of a body do not count."""
    digest = hashlib.sha256()

    def visit(value: object, name: str) -> None:
        if isinstance(value, ast.AST):
            digest.update(f"({type(value).__name__}".encode())
            for field, inner in ast.iter_fields(value):
                if field not in ("decorator_list", "type_comment", "ctx"):
                    visit(inner, field)
            digest.update(b")")
        elif isinstance(value, list):
            digest.update(f"[{name}".encode())
            start = 1 if name == "body" and value and isinstance(value[0], ast.stmt) and _is_text(value[0]) else 0
            for inner in value[start:]:
                visit(inner, "")
            digest.update(b"]")
        else:
            digest.update(f"{name}={value!r};".encode("utf-8", "surrogatepass"))

    visit(node, "")
    return digest.hexdigest()


def signature(source: str, node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """Name, parameters and result of a function, as written."""
    lines = source.splitlines(keepends=True)[node.lineno - 1 : node.end_lineno]
    depth, begin, end = 0, None, None
    for token in tokenize.generate_tokens(io.StringIO("".join(lines)).readline):
        if begin is None:
            if token.type == tokenize.NAME and token.string == node.name:
                begin = token.start
            continue
        if token.string in "([{" and token.type == tokenize.OP:
            depth += 1
        elif token.string in ")]}" and token.type == tokenize.OP:
            depth -= 1
        elif token.string == ":" and token.type == tokenize.OP and depth == 0:
            break
        if token.type not in (tokenize.NL, tokenize.NEWLINE, tokenize.COMMENT):
            end = token.end
    if begin is None or end is None:
        return node.name
    (a, i), (b, j) = begin, end
    return lines[a - 1][i:j] if a == b else "".join([lines[a - 1][i:], *lines[a : b - 1], lines[b - 1][:j]])


def symbols(source: str, tree: ast.Module) -> list[dict]:
    """Functions, classes, methods and constants of a module and of its classes; bodies of functions and of compound statements are not entered."""
    out: list[dict] = []

    def add(node: ast.stmt, scope: tuple[str, ...], name: str, kind: str, written: str | None) -> None:
        out.append({"qualified_name": ".".join((*scope, name)), "kind": kind, "signature": written, "ast_hash": ast_hash(node), "start_line": node.lineno, "end_line": node.end_lineno})

    def visit(node: ast.stmt, scope: tuple[str, ...]) -> None:
        if isinstance(node, _DEF):
            add(node, scope, node.name, "method" if scope else "function", signature(source, node))
        elif isinstance(node, ast.ClassDef):
            add(node, scope, node.name, "class", None)
            for inner in node.body:
                visit(inner, (*scope, node.name))
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            target = node.targets[0] if isinstance(node, ast.Assign) else node.target
            if isinstance(target, ast.Name) and target.id.isupper():
                add(node, scope, target.id, "constant", None)

    for statement in tree.body:
        visit(statement, ())
    return out


def imports(source: str, tree: ast.Module) -> list[dict]:
    """Imports at the top level of a module, in order; a wildcard's symbol is ``*``."""
    out: list[dict] = []
    for node in tree.body:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            raw = ast.get_source_segment(source, node)
            for name in node.names:
                bound = {"module": name.name, "symbol": None, "kind": "import"} if isinstance(node, ast.Import) else {"module": "." * node.level + (node.module or ""), "symbol": name.name, "kind": "from"}
                out.append({"place": len(out), "raw": raw, "alias": name.asname, "lazy": False, **bound})
    return out


def calls(source: str, tree: ast.Module) -> list[dict]:
    """Calls in the bodies of functions and methods. Nested definitions, decorators, defaults and class or module level are left out."""
    out: list[dict] = []

    def walk(node: ast.AST, caller: str) -> None:
        if isinstance(node, (*_DEF, ast.ClassDef)):
            return
        if isinstance(node, ast.Call):
            kind = "direct" if isinstance(node.func, ast.Name) else "method" if isinstance(node.func, ast.Attribute) else "dynamic"
            out.append({"caller_qualified_name": caller, "target_name": ast.get_source_segment(source, node.func), "line": node.lineno, "kind": kind, "dynamic": kind == "dynamic"})
        for inner in ast.iter_child_nodes(node):
            walk(inner, caller)

    def enter(node: ast.stmt, scope: tuple[str, ...]) -> None:
        if isinstance(node, _DEF):
            for statement in node.body:
                walk(statement, ".".join((*scope, node.name)))
        elif isinstance(node, ast.ClassDef):
            for inner in node.body:
                enter(inner, (*scope, node.name))

    for statement in tree.body:
        enter(statement, ())
    return out


def parsed_python(source: str) -> tuple[list[dict], list[dict], list[dict]]:
    """Symbols, imports and calls of a Python source; a SyntaxError or ValueError if it does not parse."""
    tree = ast.parse(source)
    return symbols(source, tree), imports(source, tree), calls(source, tree)


#: From a source to its symbols, imports and calls, in the shapes of SYMBOL, IMPORT and CALL.
Parser = Callable[[str], tuple[list[dict], list[dict], list[dict]]]
#: Parsers by language. What ``register`` adds must be importable on executors, or small enough to travel with a task.
PARSERS: dict[str, Parser] = {"python": parsed_python}


def register(language: str, extensions: Sequence[str], parser: Parser) -> None:
    """Lets files with these extensions (with their dot) be parsed as a language; a later parser of a language replaces the earlier one."""
    PARSERS[language] = parser
    for extension in extensions:
        LANGUAGE_EXTENSIONS[extension] = language


def extracted(files: DataFrame, text: str = "content", language: str | None = None) -> DataFrame:
    """``files`` (any columns) with symbols, imports and calls of each text, and ``parsed``.

    Texts are parsed by the parser of their language, as Python if no column
    names it. Null texts, languages without a parser and texts that do not
    parse have empty lists and parsed = false. Repeated rows are parsed each.
    """
    names = [c for c in files.columns if c not in ("symbols", "imports", "calls", "parsed")]
    at, lang = names.index(text), names.index(language) if language else None
    codes = [f"__{i}" for i in range(len(names))]
    parsers = dict(PARSERS)
    rows = files.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, codes, strict=True)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: dict[str, list] = {"symbols": [], "imports": [], "calls": [], "parsed": []}
            for i, source in enumerate(frame.iloc[:, at]):
                parser = parsers.get("python" if lang is None else frame.iloc[i, lang]) if isinstance(source, str) else None
                try:
                    values = parser(source) if parser else None
                except (SyntaxError, ValueError, RecursionError, MemoryError, tokenize.TokenError):
                    values = None
                for key, value in zip(found, (*(values or ([], [], [])), values is not None), strict=True):
                    found[key].append(value)
            yield frame.assign(**found)

    shape = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in codes), f"symbols array<{SYMBOL}>", f"imports array<{IMPORT}>", f"calls array<{CALL}>", "parsed boolean"])
    return rows.mapInPandas(run, shape).select(*[F.col(c).alias(n) for n, c in zip(names, codes, strict=True)], "symbols", "imports", "calls", "parsed")
