"""Data flow of programs. A Python UDTF reads each program's syntax tree and gives facts; everything after that is joins.

Facts: `call` (ord, func, line, receiver, gated), `arg` (ord, var, origin_ord of each call that the variable's value comes from
directly, -1 if it is known but comes from none, -2 if it is unknown). No program is ever executed or imported.
"""

from __future__ import annotations

import ast
import builtins
import math
import sys

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tracelode.operators.book import FIRST, count_pairs

# Names that are modules rather than data.
MODULES = {"torch", "np", "json", "requests", "os", "sys", "math"}
#: Without a list of allowed names, calls of these are no operations: Python's builtins, its standard library, functions of math.
BUILTINS = {x for x in dir(builtins) if callable(getattr(builtins, x))}
MATH = {x for x in dir(math) if not x.startswith("_")}


class _Visitor:
    def __init__(self, allowlist: set[str] | None):
        self.allowed, self.out, self.calls, self.origins, self.known = allowlist, [], 0, {}, set()
        self.imported: dict[str, str] = {}

    @staticmethod
    def dotted(node) -> str | None:
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        if isinstance(node, ast.Name):
            return ".".join([node.id, *reversed(parts)])
        return None

    def listed(self, name: str) -> bool:
        if self.allowed is not None:
            return name in self.allowed or name.rpartition(".")[2] in self.allowed
        first = name.split(".")[0]
        module = self.imported.get(first, "" if first in self.known else first)
        return name not in BUILTINS and name not in MATH and not (module.split(".")[0] in sys.stdlib_module_names and ("." in name or first in self.imported))

    def value(self, node, gated: bool) -> set[int]:
        """Calls below an expression, in the order they happen; those its value comes from directly."""
        if isinstance(node, ast.Call):
            inner: set[int] = set()
            parts = [*node.args, *[k.value for k in node.keywords]]
            before = self.calls
            for a in parts:
                inner |= self.value(a, gated)
            name = self.dotted(node.func)
            if name is None:
                return inner | self.value(getattr(node.func, "value", None), gated) if isinstance(node.func, ast.Attribute) else inner
            if not self.listed(name):
                return inner
            no = self.calls
            self.calls += 1
            receiver = name.split(".")[0] if "." in name else None
            self.out.append(("call", no, name, node.lineno, receiver, gated, None, None))
            # the receiver is an argument too
            names = {v.id for a in parts for v in ast.walk(a) if isinstance(v, ast.Name)} | ({receiver} if receiver else set())
            for v in sorted(names - MODULES - self.imported.keys() - BUILTINS):
                got = self.origins.get(v)
                for o in sorted(got) if got else [-1 if v in self.known else -2]:
                    self.out.append(("arg", no, name, node.lineno, None, gated, v, o))
            # calls written inside the arguments; origins reached through a name are told by the name
            for o in sorted(x for x in inner if x >= before):
                self.out.append(("arg", no, name, node.lineno, None, gated, f"<call {o}>", o))
            return {no}
        found: set[int] = set()
        if node is None:
            return found
        if isinstance(node, ast.Name):
            return set(self.origins.get(node.id, ()))
        direct: set[int] = set()
        for child in ast.iter_child_nodes(node):
            direct |= self.value(child, gated)
        return direct

    def bind(self, target, origins: set[int]) -> None:
        for n in ast.walk(target):
            if isinstance(n, ast.Name):
                self.origins[n.id] = set(origins)
                self.known.add(n.id)

    def block(self, body: list, gated: bool) -> None:
        for s in body:
            if isinstance(s, ast.Import | ast.ImportFrom):
                for n in s.names:
                    self.imported[n.asname or n.name.split(".")[0]] = getattr(s, "module", None) or n.name
            elif isinstance(s, ast.Assign):
                o = self.value(s.value, gated)
                for t in s.targets:
                    self.bind(t, o)
            elif isinstance(s, ast.AnnAssign | ast.AugAssign):
                o = self.value(s.value, gated) if s.value is not None else set()
                self.bind(s.target, o | (self.origins.get(getattr(s.target, "id", ""), set()) if isinstance(s, ast.AugAssign) else set()))
            elif isinstance(s, ast.For | ast.AsyncFor):
                o = self.value(s.iter, gated)
                self.bind(s.target, o)
                self.block(s.orelse, True)
                self.block(s.body, True)
            elif isinstance(s, ast.If | ast.While):
                self.value(s.test, True)
                self.block(s.body, True)
                self.block(s.orelse, True)
            elif isinstance(s, ast.Try):
                for part in (s.body, *[h.body for h in s.handlers], s.orelse, s.finalbody):
                    self.block(part, True)
            elif isinstance(s, ast.With | ast.AsyncWith):
                for i in s.items:
                    o = self.value(i.context_expr, True)
                    if i.optional_vars is not None:
                        self.bind(i.optional_vars, o)
                self.block(s.body, True)
            elif isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef):
                self.known |= {a.arg for a in s.args.args}
                self.block(s.body, gated)
            elif isinstance(s, ast.Expr | ast.Return):
                self.value(s.value, gated)


@udtf(returnType="fact string, ord int, func string, line int, receiver string, gated boolean, var string, origin int")
class AstFacts:
    def eval(self, code: str, allowlist: list):
        if not code:
            return
        try:
            tree = ast.parse(code)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        v = _Visitor(set(allowlist) if allowlist else None)
        v.block(tree.body, False)
        yield from v.out


def facts(programs: DataFrame, key: str, code: str, allowlist: list[str] | None = None) -> DataFrame:
    """Facts of each program; null, empty and unreadable programs have none."""
    names = F.array(*[F.lit(x) for x in allowlist]) if allowlist else F.array().cast("array<string>")
    base = programs.where(F.col(code).isNotNull()).select(F.col(key), F.col(code).alias("_code"), names.alias("_names"))
    return base.lateralJoin(AstFacts(F.col("_code").outer(), F.col("_names").outer()), how="inner").drop("_code", "_names")


def transitions(f: DataFrame, key: str) -> DataFrame:
    """(key, src, dst, occ): from the call that an argument comes from to the call that takes it, NONE for known variables
    without origin and unknown ones that aren't capitalised; and between calls in a row on one receiver."""
    calls = f.where("fact = 'call'").select(key, "ord", "func", "receiver")
    args = f.where("fact = 'arg'").select(key, "ord", F.col("func").alias("dst"), "var", "origin").distinct()
    made = args.where("origin >= 0").join(calls.select(key, F.col("ord").alias("origin"), F.col("func").alias("src")), [key, "origin"]).where("origin <> ord").select(key, "src", "dst")
    none = args.where((F.col("origin") == -1) | ((F.col("origin") == -2) & ~F.col("var").rlike("^[A-Z]"))).select(key, F.lit(FIRST).alias("src"), "dst")
    w = Window.partitionBy(key, "receiver").orderBy("ord")
    same = calls.where(F.col("receiver").isNotNull() & ~F.col("receiver").isin(list(MODULES))).select(key, F.lag("func").over(w).alias("src"), F.col("func").alias("dst")).where("src is not null")
    every = made.unionByName(none).unionByName(same)
    return every.groupBy(key, "src", "dst").agg(F.count("*").alias("occ"))


def calls_per_function(f: DataFrame, key: str) -> DataFrame:
    return f.where("fact = 'call'").groupBy(key, "func").agg(F.count("*").alias("calls"), F.count_if("gated").alias("gated"))


def total_pairs(t: DataFrame) -> DataFrame:
    return count_pairs(t)
