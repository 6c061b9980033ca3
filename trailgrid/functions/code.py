"""Whether recorded Python code only prints an answer that it holds, told from its syntax tree; the code is never run."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

_LOGIC = (ast.While, ast.For, ast.If, ast.ListComp, ast.DictComp, ast.SetComp, ast.GeneratorExp)
_ARITHMETIC = (ast.Add, ast.Sub, ast.Mult, ast.Div)
#: Functions that only show or convert.
SHOWING = frozenset(("print", "str", "int", "float", "bool", "list", "dict", "tuple", "set", "type", "isinstance"))
_PRINTED_OBJECT = re.compile(r"print\s*\(\s*[\"']+\s*\{")


class NotStatic(Exception):
    """A value that the tree alone does not tell."""


def value_of(node: ast.AST, known: dict[str, object]) -> object:
    match node:
        case ast.Constant(value=v):
            return v
        case ast.List(elts=xs) | ast.Tuple(elts=xs):
            return [value_of(x, known) for x in xs]
        case ast.Dict(keys=ks, values=vs) if None not in ks:
            return {value_of(k, known): value_of(v, known) for k, v in zip(ks, vs)}
        case ast.Name(id=name) if name in known:
            return known[name]
        case ast.JoinedStr(values=parts):
            return "".join(str(value_of(p.value if isinstance(p, ast.FormattedValue) else p, known)) for p in parts)
    raise NotStatic


def _shows(call: ast.Call) -> bool:
    match call.func:
        case ast.Name(id=name):
            return name in SHOWING
        case ast.Attribute(value=ast.Name(id="json"), attr="dumps" | "loads"):
            return True
    return False


def static_values(tree: ast.Module) -> dict[str, object]:
    """Values of all assigned names; NotStatic if one is not told by literals and names before it."""
    known: dict[str, object] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign):
            for target in node.targets:
                if isinstance(target, ast.Name):
                    known[target.id] = value_of(node.value, known)
    return known


def presented(code: str | None) -> tuple[bool, dict | None]:
    """Whether code only presents, and the answer object that it prints, or else that it assigns, if there is one without nulls."""
    if not code or "print" not in code or not ("json.dumps" in code or _PRINTED_OBJECT.search(code)):
        return False, None
    try:
        tree = ast.parse(code)
        nodes = list(ast.walk(tree))
        if any(isinstance(n, _LOGIC) or (isinstance(n, ast.BinOp) and isinstance(n.op, _ARITHMETIC)) or (isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub)) or (isinstance(n, ast.Call) and not _shows(n)) for n in nodes):
            return False, None
        known = static_values(tree)
    except (SyntaxError, ValueError, RecursionError, TypeError, MemoryError, NotStatic):
        return False, None
    for call in (n for n in nodes if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == "print"):
        for shown in call.args:
            inner = shown.args[0] if isinstance(shown, ast.Call) and isinstance(shown.func, ast.Attribute) and shown.func.attr == "dumps" and shown.args else shown
            try:
                found = value_of(inner, known)
                found = json.loads(found) if isinstance(found, str) else found
            except (NotStatic, ValueError, TypeError, RecursionError):
                continue
            if isinstance(found, dict) and "answer" in found:
                return True, None if None in found.values() else found
    found = next((v for v in known.values() if isinstance(v, dict) and "answer" in v), None)
    return True, None if found is None or None in found.values() else found


def _answer(code: str | None) -> str | None:
    found = presented(code)[1]
    try:
        return None if found is None else json.dumps(found, ensure_ascii=False)
    except (TypeError, ValueError):
        return None


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def presented_answers(codes: pd.Series) -> pd.Series:
    """For arrays of arrays of code, the answers (JSON) that code only presents, each at its place; else null."""
    return pd.Series([None if steps is None else [[] if calls is None else [_answer(c) for c in calls] for calls in steps] for steps in codes], dtype=object)


@F.pandas_udf(StructType([StructField("only_presents", BooleanType()), StructField("answer", StringType())]))
def presentation(code: pd.Series) -> pd.DataFrame:
    """struct<only_presents, answer JSON> of code; null code presents nothing. An answer that JSON cannot hold is null."""
    return pd.DataFrame([(presented(text)[0], _answer(text)) for text in code], columns=["only_presents", "answer"])
