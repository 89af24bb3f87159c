"""User formulas compiled to Columns: an allow-listed expression language, nothing runs per row in Python."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from eventmill.functions.columns import NAN, asinh, is_finite

#: Of formulas over events, and over tables.
MOST_CHARS, MOST_NODES = 1024, 160
MOST_TABLE_CHARS, MOST_TABLE_NODES, FARTHEST_ROW = 2048, 200, 50_000
_REDUCTIONS = ("mean", "median", "sum", "sd", "n")


def _nan_if(bad: Column, value: Column) -> Column:
    return F.when(bad, F.lit(NAN)).otherwise(value)


def _any_nan(cs: list[Column]) -> Column:
    out = F.isnan(cs[0])
    for c in cs[1:]:
        out = out | F.isnan(c)
    return out


_UNARY = {
    "abs": F.abs,
    "sqrt": lambda c: _nan_if(c < 0, F.sqrt(c)),
    "log": lambda c: _nan_if(c <= 0, F.log(c)),
    "log10": lambda c: _nan_if(c <= 0, F.log10(c)),
    "exp": F.exp,
    "asinh": asinh,
    "ceil": lambda c: F.ceil(c).cast("double"),
    "floor": lambda c: F.floor(c).cast("double"),
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
}
_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: _nan_if(b == 0, a / F.nullif(b, F.lit(0.0))), ast.Pow: F.pow}
_COMPARE = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}


def _parsed(text: str, chars: int, nodes: int) -> ast.expr:
    if not text or len(text) > chars:
        raise ValueError("the formula is empty or too long")
    try:
        tree = ast.parse(text, mode="eval").body
    except (SyntaxError, RecursionError, ValueError) as problem:
        raise ValueError("the formula cannot be read") from problem
    if sum(1 for _ in ast.walk(tree)) > nodes:
        raise ValueError("the formula has too many parts")
    return tree


class _Columns(dict):
    """Columns by name; of a table's formula, also what ``table`` gives for a reference."""

    table: Callable[[tuple], Column] | None = None


def compile_formula(text: str, columns: dict[str, Column], table: Callable[[tuple], Column] | None = None) -> Column:
    """A formula over named columns; results that are not finite become NaN.

    With ``table`` it is a formula over a table's rows, and ``table`` gives the column of each of its ``references``.
    """
    tree = _parsed(text, MOST_CHARS, MOST_NODES) if table is None else _parsed(text, MOST_TABLE_CHARS, MOST_TABLE_NODES)
    held = _Columns(columns)
    held.table = table
    value = _value(tree, held).cast("double")
    return F.when(is_finite(value), value).otherwise(F.lit(NAN))


def _whole(node: ast.expr) -> int:
    sign = 1
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
        sign, node = (-1 if isinstance(node.op, ast.USub) else 1), node.operand
    if not isinstance(node, ast.Constant) or type(node.value) is not int or node.value > FARTHEST_ROW:
        raise ValueError("a row is a whole number written out")
    return sign * node.value


def _reference(node: ast.expr) -> tuple | None:
    """What of the table a call stands for."""
    match node:
        case ast.Call(func=ast.Name(id="col"), args=[ast.Constant(value=str() as c)], keywords=[]):
            return ("col", c)
        case ast.Call(func=ast.Name(id="control"), args=[ast.Constant(value=str() as c), ast.Constant(value=str() as of)], keywords=[]):
            return ("control", c, of)
        case ast.Call(func=ast.Name(id="offset"), args=[ast.Constant(value=str() as c), k], keywords=[]):
            return ("offset", c, _whole(k))
        case ast.Call(func=ast.Name(id="row"), args=[ast.Constant(value=str() as c), k], keywords=[]):
            if _whole(k) < 1:
                raise ValueError("rows begin at 1")
            return ("row", c, _whole(k))
        case ast.Call(func=ast.Name(id=f), args=[inner], keywords=[]) if f in _REDUCTIONS:
            return (f, ast.unparse(inner))
    return None


def references(text: str) -> set[tuple]:
    """What a table's formula reads: ``("col", c)``, ``("control", c, sample)``, ``("offset", c, k)``, ``("row", c, k)`` and reductions ``(f, formula)``."""
    out: set[tuple] = set()

    def visit(node: ast.AST) -> None:
        if (r := _reference(node)) is not None:
            out.add(r)
            return
        for child in ast.iter_child_nodes(node):
            visit(child)

    visit(_parsed(text, MOST_TABLE_CHARS, MOST_TABLE_NODES))
    return out


def names(text: str) -> set[str]:
    """Columns that a formula reads."""
    return {n.id for n in ast.walk(ast.parse(text, mode="eval")) if isinstance(n, ast.Name)} - {*_UNARY, "min", "max", "clip", "ch", "ifelse", "coalesce"} | {
        n.args[0].value for n in ast.walk(ast.parse(text, mode="eval")) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == "ch"
    }


def in_order(formulas: dict[str, str]) -> list[str]:
    """Names of formulas so that each comes after those it reads; a cycle is an error."""
    out: list[str] = []
    path: list[str] = []

    def visit(n: str) -> None:
        if n in path:
            raise ValueError(f"formulas read each other: {' > '.join([*path, n])}")
        if n in formulas and n not in out:
            path.append(n)
            for m in sorted(names(formulas[n])):
                visit(m)
            out.append(path.pop())

    for n in formulas:
        visit(n)
    return out


def _value(node: ast.expr, columns: dict[str, Column]) -> Column:
    def of(n: ast.expr) -> Column:
        return _value(n, columns)

    if getattr(columns, "table", None) is not None:
        if (r := _reference(node)) is not None:
            return columns.table(r)
        if isinstance(node, (ast.Compare, ast.BoolOp)) or isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return _truth(node, columns).cast("double")
    match node:
        case ast.Constant(value=bool()):
            raise ValueError("a formula has numbers only")
        case ast.Constant(value=int() | float() as v):
            return F.lit(float(v))
        case ast.Name(id=n):
            if n not in columns:
                raise ValueError(f"no column {n!r}")
            return columns[n]
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -of(x)
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return of(x)
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
            return _BINARY[type(op)](of(a), of(b))
        case ast.Call(func=ast.Name(id="ch"), args=[ast.Constant(value=str() as n)]) if n in columns:
            return columns[n]
        case ast.Call(func=ast.Name(id="ifelse"), args=[test, a, b]):
            return F.when(_truth(test, columns), of(a)).otherwise(of(b))
        case ast.Call(func=ast.Name(id="coalesce"), args=args) if args:
            values = [of(a).cast("double") for a in args]
            return F.coalesce(*[F.when(is_finite(v), v) for v in values], F.lit(NAN))
        case ast.Call(func=ast.Name(id="clip"), args=[x, lo, hi]):
            v = [of(x), of(lo), of(hi)]
            return _nan_if(_any_nan(v), F.least(F.greatest(v[0], v[1]), v[2]))
        case ast.Call(func=ast.Name(id="min" | "max" as f), args=args) if 2 <= len(args) <= 32:
            v = [of(a) for a in args]
            return _nan_if(_any_nan(v), (F.least if f == "min" else F.greatest)(*v))
        case ast.Call(func=ast.Name(id=f), args=[x]) if f in _UNARY:
            return _UNARY[f](of(x))
    raise ValueError(f"a formula may not hold {ast.dump(node)[:60]}")


def _truth(node: ast.expr, columns: dict[str, Column]) -> Column:
    match node:
        case ast.Compare(left=a, ops=ops, comparators=rest):
            nodes = (a, *rest)
            if any(isinstance(n, ast.Constant) and isinstance(n.value, str) for n in nodes):
                values = [F.lit(n.value) if isinstance(n, ast.Constant) else _value(n, columns) for n in nodes]
                tests = [F.coalesce(_COMPARE[type(op)](x, y), F.lit(isinstance(op, ast.NotEq))) for op, x, y in zip(ops, values, values[1:])]
            else:
                values = [_value(n, columns) for n in nodes]
                tests = [is_finite(x.cast("double")) & is_finite(y.cast("double")) & _COMPARE[type(op)](x, y) for op, x, y in zip(ops, values, values[1:])]
            out = F.lit(True)
            for t in tests:
                out = out & t
            return out
        case ast.BoolOp(op=op, values=vs):
            out = _truth(vs[0], columns)
            for v in vs[1:]:
                out = out & _truth(v, columns) if isinstance(op, ast.And) else out | _truth(v, columns)
            return out
        case ast.UnaryOp(op=ast.Not(), operand=x):
            return ~_truth(x, columns)
    raise ValueError("a condition is made of comparisons")
