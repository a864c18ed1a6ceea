"""Band-math text to a Spark ``Column``.

Only arithmetic, a few functions and the declared bands are accepted, so a user product
cannot reach other columns or embed SQL. Division by zero gives NULL (masked).
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_BINARY: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
    ast.Pow: F.pow,
}
_CALLS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "log10": F.log10,
    "pow": F.pow, "min": F.least, "max": F.greatest,
}


def band_math(expression: str, bands: Mapping[str, Column]) -> Column:
    """Build the column for ``expression`` over ``bands``; anything else is refused."""
    try:
        tree = ast.parse(expression, mode="eval").body
    except SyntaxError as exc:
        raise ValueError(f"cannot read expression {expression!r}: {exc.msg}") from exc

    def fold(node: ast.expr) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            if node.id not in bands:
                raise ValueError(f"{expression!r} uses {node.id!r}, which is not a declared band")
            return bands[node.id]
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](fold(node.left), fold(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -fold(node.operand)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords:
            return _CALLS[node.func.id](*[fold(a) for a in node.args])
        raise ValueError(f"{ast.dump(node)[:60]} is not allowed in {expression!r}")

    return fold(tree)
