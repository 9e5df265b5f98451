"""Repair of generated code by its syntax tree, in Arrow batches: indentation, the result variable, the variable of a branch. No program
is executed."""

from __future__ import annotations

import ast
import re
import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the variable that holds a program's result.
RESULT = "RESULT"
OPENS = re.compile(r":\s*(#.*)?$")


def readable(code: str) -> bool:
    try:
        ast.parse(code)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def _even(code: str) -> str:
    """Indentation of each line rounded to steps of four."""
    return "\n".join(" " * (round((len(x) - len(x.lstrip())) / 4) * 4) + x.lstrip() for x in code.split("\n"))


def _rebuilt(code: str) -> str:
    """A line is as deep as the one before, deeper after a colon, and no deeper than that."""
    out, depth = [], 0
    for line in code.split("\n"):
        text = line.strip()
        if not text:
            out.append("")
            continue
        own = (len(line) - len(line.lstrip())) // 4
        depth = min(own, depth)
        if re.match(r"(elif|else|except|finally)\b", text) and own >= depth:
            depth = max(0, depth - 1) if out and not OPENS.search(out[-1]) and own < depth else own if own <= depth else depth
        out.append("    " * depth + text)
        if OPENS.search(text):
            depth += 1
    return "\n".join(out)


def indented(code: str) -> str:
    """Code that can be read, by the first of these that helps: as it is, tabs to blanks, common indentation off, a first line that lost its
    own given that of the second, depths rounded to four, depths rebuilt from colons; else the code as it came."""
    first, _, rest = code.partition("\n")
    tries = [
        lambda: code,
        lambda: code.expandtabs(4),
        lambda: textwrap.dedent(code.expandtabs(4)),
        lambda: first.lstrip() + "\n" + textwrap.dedent(rest.expandtabs(4)),
        lambda: _even(textwrap.dedent(code.expandtabs(4))),
        lambda: _rebuilt(textwrap.dedent(code.expandtabs(4))),
    ]
    for make in tries:
        got = make()
        if readable(got):
            return got
    return code


def sink(code: str) -> tuple[str | None, str | None]:
    """(how, name): `assigned` if the program sets RESULT at any depth; else `inferred` with the last variable that its last statements
    assign, or `expression` if it ends in a bare one; (None, None) if there is none or it can't be read."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None, None
    for n in ast.walk(tree):
        if isinstance(n, ast.Name) and n.id == RESULT and isinstance(n.ctx, ast.Store):
            return "assigned", RESULT
    body = tree.body
    while body:
        last = body[-1]
        if isinstance(last, ast.Assign | ast.AnnAssign | ast.AugAssign):
            targets = last.targets if isinstance(last, ast.Assign) else [last.target]
            names = [n.id for t in targets for n in ast.walk(t) if isinstance(n, ast.Name)]
            return ("inferred", names[-1]) if names else (None, None)
        if isinstance(last, ast.If) and isinstance(last.body[-1], ast.Assign):
            body = last.body
            continue
        if isinstance(last, ast.Expr) and isinstance(last.value, ast.Name):
            return "expression", last.value.id
        body = body[:-1]
    return None, None


def with_sink(code: str) -> str:
    """The program with its result in RESULT, where one can be told."""
    how, name = sink(code)
    return code.rstrip("\n") + f"\n{RESULT} = {name}\n" if how in ("inferred", "expression") else code


def branch_variable(code: str) -> str | None:
    """The variable that the first `if` tests; by a pattern where the program can't be read."""
    try:
        for n in ast.walk(ast.parse(code)):
            if isinstance(n, ast.If):
                for v in ast.walk(n.test):
                    if isinstance(v, ast.Name) and not (isinstance(n.test, ast.Call) and v is n.test.func):
                        return v.id
                return None
        return None
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        m = re.search(r"^[ \t]*if\s+(?:not\s+)?(?:len\(\s*)?([A-Za-z_]\w*)", code, re.M)
        return m[1] if m else None


def _udf(f, kind: str):
    def run(codes: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else f(c) for c in codes], dtype=object)

    return F.pandas_udf(run, kind)


def repaired(code: Column) -> Column:
    return _udf(indented, "string")(code)


def result_set(code: Column) -> Column:
    return _udf(with_sink, "string")(code)


def result_kind(code: Column) -> Column:
    return _udf(lambda c: sink(c)[0], "string")(code)


def tested(code: Column) -> Column:
    return _udf(branch_variable, "string")(code)
