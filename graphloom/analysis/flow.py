"""Control-flow graphs, post-dominators, reaching definitions and dependences of Python functions.

Statements are the nodes, numbered in source order from 1; 0 is the entry and -1 the exit. Compound statements that are
not branches or loops (try, with, match) are one opaque node whose whole text counts. A slice may hold too much, never
too little.
"""

from __future__ import annotations

import ast
import warnings
from collections import defaultdict
from dataclasses import dataclass, field

ENTRY, EXIT = 0, -1


@dataclass
class Flow:
    """A function's statements (number: (first line, last line, node)) and its labelled control edges."""

    statements: dict[int, tuple[int, int, ast.AST]] = field(default_factory=dict)
    edges: set[tuple[int, int, str]] = field(default_factory=set)
    parameters: list[str] = field(default_factory=list)

    def successors(self) -> dict[int, set[int]]:
        out: dict[int, set[int]] = defaultdict(set)
        for a, b, _ in self.edges:
            out[a].add(b)
        return out


class _Builder:
    def __init__(self) -> None:
        self.flow = Flow()
        self.loops: list[tuple[int, list[tuple[int, str]]]] = []  # header, open breaks

    def build(self, function: ast.FunctionDef | ast.AsyncFunctionDef) -> Flow:
        a = function.args
        self.flow.parameters = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg)))]
        self._close(self._body(function.body, [(ENTRY, "seq")]), EXIT)
        return self.flow

    def _close(self, open_ends: list[tuple[int, str]], to: int) -> None:
        self.flow.edges.update((a, to, label) for a, label in open_ends)

    def _node(self, s: ast.AST) -> int:
        k = len(self.flow.statements) + 1
        self.flow.statements[k] = (s.lineno, s.end_lineno or s.lineno, s)
        return k

    def _body(self, body: list[ast.stmt], ends: list[tuple[int, str]]) -> list[tuple[int, str]]:
        for s in body:
            ends = self._statement(s, ends)
        return ends

    def _statement(self, s: ast.stmt, ends: list[tuple[int, str]]) -> list[tuple[int, str]]:
        k = self._node(s)
        self._close(ends, k)
        if isinstance(s, ast.If):
            return self._body(s.body, [(k, "true")]) + (self._body(s.orelse, [(k, "false")]) if s.orelse else [(k, "false")])
        if isinstance(s, ast.While | ast.For | ast.AsyncFor):
            self.loops.append((k, []))
            self._close(self._body(s.body, [(k, "true")]), k)
            _, breaks = self.loops.pop()
            return [(k, "false"), *breaks]
        if isinstance(s, ast.Break) and self.loops:
            self.loops[-1][1].append((k, "break"))
            return []
        if isinstance(s, ast.Continue) and self.loops:
            self.flow.edges.add((k, self.loops[-1][0], "continue"))
            return []
        if isinstance(s, ast.Return | ast.Raise):
            self.flow.edges.add((k, EXIT, "return" if isinstance(s, ast.Return) else "raise"))
            return []
        return [(k, "seq")]


def build(function: ast.FunctionDef | ast.AsyncFunctionDef) -> Flow:
    return _Builder().build(function)


def reachable_from_entry(flow: Flow) -> set[int]:
    nxt, seen, todo = flow.successors(), {ENTRY}, [ENTRY]
    while todo:
        for b in nxt[todo.pop()] - seen:
            seen.add(b)
            todo.append(b)
    return seen


def unreachable(flow: Flow) -> list[tuple[int, int]]:
    """Line spans of dead statements, inner ones left out."""
    live = reachable_from_entry(flow)
    spans = sorted({(a, b) for k, (a, b, _) in flow.statements.items() if k not in live}, key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def post_dominators(flow: Flow) -> dict[int, set[int]]:
    """Nodes that every path to the exit passes, by node; a node that cannot reach the exit has all."""
    nodes = {ENTRY, EXIT, *flow.statements}
    nxt = flow.successors()
    pdom = {n: set(nodes) for n in nodes}
    pdom[EXIT] = {EXIT}
    changed = True
    while changed:
        changed = False
        for n in sorted(nodes - {EXIT}, reverse=True):
            after = [pdom[m] for m in nxt[n]]
            new = {n} | (set.intersection(*after) if after else nodes)
            if new != pdom[n]:
                pdom[n], changed = new, True
    return pdom


def immediate_post_dominators(pdom: dict[int, set[int]]) -> dict[int, int | None]:
    """The nearest strict post-dominator: the one that all the others post-dominate in turn."""
    out: dict[int, int | None] = {}
    for n, ps in pdom.items():
        strict = ps - {n}
        out[n] = next((p for p in sorted(strict) if pdom[p] >= strict), None)
    return out


def control_dependences(flow: Flow) -> set[tuple[int, int, str]]:
    """(branch, dependent, label): the dependent runs on one way out of the branch but need not run on another."""
    pdom = post_dominators(flow)
    out = set()
    for a, b, label in flow.edges:
        if a == ENTRY:
            continue
        out.update((a, n, label) for n in pdom[b] if n not in (EXIT,) and n not in pdom[a] - {a})
    return out


class _Names(ast.NodeVisitor):
    """Strong definitions, weak ones (part of a value may change) and uses of a piece of code."""

    def __init__(self) -> None:
        self.strong: set[str] = set()
        self.weak: set[str] = set()
        self.uses: set[str] = set()

    def visit_Name(self, n: ast.Name) -> None:
        (self.uses if isinstance(n.ctx, ast.Load) else self.strong).add(n.id)

    def _root(self, n: ast.AST) -> str | None:
        while isinstance(n, ast.Attribute | ast.Subscript | ast.Starred):
            n = n.value
        return n.id if isinstance(n, ast.Name) else None

    def _part(self, n: ast.Attribute | ast.Subscript) -> None:
        if isinstance(n.ctx, ast.Store | ast.Del) and (root := self._root(n)):
            self.weak.add(root)
        self.generic_visit(n)

    visit_Attribute = visit_Subscript = _part

    def visit_Call(self, n: ast.Call) -> None:
        if isinstance(n.func, ast.Attribute) and (root := self._root(n.func)):
            self.weak.add(root)
        for arg in (*n.args, *(k.value for k in n.keywords)):
            if root := self._root(arg):
                self.weak.add(root)
        self.generic_visit(n)

    def visit_AugAssign(self, n: ast.AugAssign) -> None:
        if isinstance(n.target, ast.Name):
            self.uses.add(n.target.id)
        self.generic_visit(n)

    def _imports(self, n: ast.Import | ast.ImportFrom) -> None:
        self.strong.update((a.asname or a.name).split(".")[0] for a in n.names if a.name != "*")

    visit_Import = visit_ImportFrom = _imports

    def visit_ExceptHandler(self, n: ast.ExceptHandler) -> None:
        if n.name:
            self.strong.add(n.name)
        self.generic_visit(n)

    def visit_MatchAs(self, n: ast.MatchAs) -> None:
        if n.name:
            self.weak.add(n.name)
        self.generic_visit(n)

    def visit_MatchStar(self, n: ast.MatchStar) -> None:
        if n.name:
            self.weak.add(n.name)

    def _definition(self, n: ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) -> None:
        inner = _Names()
        for child in ast.iter_child_nodes(n):
            inner.visit(child)
        self.uses |= inner.uses
        self.strong.add(n.name)

    visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = _definition

    def visit_Lambda(self, n: ast.Lambda) -> None:
        inner = _Names()
        inner.visit(n.body)
        self.uses |= inner.uses

    def _comprehension(self, n) -> None:
        inner = _Names()
        for child in ast.iter_child_nodes(n):
            inner.visit(child)
        self.uses |= inner.uses | inner.strong & inner.uses
        self.weak |= inner.weak

    visit_ListComp = visit_SetComp = visit_DictComp = visit_GeneratorExp = _comprehension


def names(s: ast.AST) -> _Names:
    """Definitions and uses of a statement; branches and loops count with their header only."""
    if not isinstance(s, ast.AST):  # a statement of another language brings its names
        return s
    v = _Names()
    if isinstance(s, ast.If | ast.While):
        v.visit(s.test)
    elif isinstance(s, ast.For | ast.AsyncFor):
        v.visit(s.iter)
        v.visit(s.target)
    else:
        v.visit(s)
    return v


def reaching_definitions(flow: Flow) -> dict[int, set[tuple[str, int]]]:
    """(variable, defining statement) that may hold before each statement; parameters are defined at the entry."""
    what = {k: names(s) for k, (_, _, s) in flow.statements.items()}
    before: dict[int, set[int]] = defaultdict(set)
    for a, b, _ in flow.edges:
        before[b].add(a)
    out = {k: set() for k in (*flow.statements, EXIT)}
    out[ENTRY] = {(p, ENTRY) for p in flow.parameters}
    into: dict[int, set] = {k: set() for k in out}
    todo = set(flow.statements)
    nxt = flow.successors()
    while todo:
        k = min(todo)
        todo.discard(k)
        into[k] = set().union(*(out[p] for p in before[k])) if before[k] else set()
        n = what[k]
        new = {d for d in into[k] if d[0] not in n.strong} | {(x, k) for x in n.strong | n.weak}
        if new != out[k]:
            out[k] = new
            todo |= {b for b in nxt[k] if b in flow.statements}
    return into


def data_dependences(flow: Flow) -> set[tuple[int, int, str]]:
    into = reaching_definitions(flow)
    return {(d, k, x) for k, (_, _, s) in flow.statements.items() for x, d in into[k] if x in names(s).uses | names(s).weak}


def dependence_graph(flow: Flow) -> list[tuple[int, int, str, str]]:
    """(from, to, control or data, label or variable), sorted."""
    return sorted({(a, b, "control", x) for a, b, x in control_dependences(flow)} | {(a, b, "data", x) for a, b, x in data_dependences(flow)})


def closure(pdg: list[tuple[int, int, str, str]], seeds: set[int], backward: bool) -> set[int]:
    step: dict[int, set[int]] = defaultdict(set)
    for a, b, _, _ in pdg:
        step[b if backward else a].add(a if backward else b)
    seen, todo = set(seeds), list(seeds)
    while todo:
        for n in step[todo.pop()] - seen:
            seen.add(n)
            todo.append(n)
    return seen


def seed_for_line(flow: Flow, line: int) -> int | None:
    """The innermost statement around a line."""
    around = [(b - a, k) for k, (a, b, _) in flow.statements.items() if a <= line <= b]
    return min(around)[1] if around else None


def slice_lines(flow: Flow, line: int, backward: bool = True) -> list[int]:
    """Lines of the statements that a line depends on (or that depend on it), itself included; headers without bodies."""
    seed = seed_for_line(flow, line)
    if seed is None:
        return []
    kept = closure(dependence_graph(flow), {seed}, backward)
    lines: set[int] = set()
    for k in kept & set(flow.statements):
        a, b, s = flow.statements[k]
        if not isinstance(s, ast.AST):
            b = s.head_last
        elif isinstance(s, ast.If | ast.While | ast.For | ast.AsyncFor):
            b = max(a, s.body[0].lineno - 1) if s.body[0].lineno > a else a
        lines.update(range(a, b + 1))
    return sorted(lines)


def output_nodes(flow: Flow, function: ast.AST) -> set[int]:
    """Statements whose effect shows outside: return, raise, yield, calls, writes to what is not local."""
    if not isinstance(function, ast.AST):
        return {k for k, (_, _, s) in flow.statements.items() if s.shows}
    outside = {x for n in ast.walk(function) if isinstance(n, ast.Global | ast.Nonlocal) for x in n.names}
    out = set()
    for k, (_, _, s) in flow.statements.items():
        head = [s.test] if isinstance(s, ast.If | ast.While) else [s.iter, s.target] if isinstance(s, ast.For | ast.AsyncFor) else [s]
        parts = [n for h in head for n in ast.walk(h)]
        shows = any(isinstance(n, ast.Return | ast.Raise | ast.Yield | ast.YieldFrom | ast.Await | ast.Call) for n in parts)
        writes = any(isinstance(n, ast.Attribute | ast.Subscript) and isinstance(n.ctx, ast.Store | ast.Del) for n in parts)
        if shows or writes or any(isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store) and n.id in outside for n in parts):
            out.add(k)
    return out


def functions(source: str | None) -> list[tuple[str, ast.AST]]:
    """(qualified name, definition) of every function of a Python text; none if it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse((source or "").removeprefix("﻿"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []

    def walk(node: ast.AST, prefix: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                name = f"{prefix}{child.name}"
                if not isinstance(child, ast.ClassDef):
                    out.append((name, child))
                walk(child, name + ".")
            else:
                walk(child, prefix)

    walk(tree, "")
    return out


def function_at(source: str, line: int) -> tuple[str, ast.AST] | None:
    """The function that begins at a line, else the innermost around it."""
    found = functions(source)
    exact = next((f for f in found if f[1].lineno == line), None)
    around = [f for f in found if f[1].lineno <= line <= (f[1].end_lineno or f[1].lineno)]
    return exact or min(around, key=lambda f: (f[1].end_lineno or 0) - f[1].lineno, default=None)


def interprocedural_slice(source: str, line: int, depth: int = 3) -> dict[str, list[int]]:
    """Lines of a backward slice by function, following calls to functions of the same text up to a depth."""
    found = dict(functions(source))
    start = function_at(source, line)
    if start is None:
        return {}
    out: dict[str, set[int]] = defaultdict(set)
    todo, seen = [(start[0], line, 0)], set()
    by_last = defaultdict(list)
    for name in found:
        by_last[name.rsplit(".", 1)[-1]].append(name)
    while todo:
        name, at, level = todo.pop()
        f = found[name]
        lines = slice_lines(build(f), at)
        out[name].update(lines)
        if level >= depth:
            continue
        for n in ast.walk(f):
            if isinstance(n, ast.Call) and n.lineno in lines:
                called = n.func.attr if isinstance(n.func, ast.Attribute) else n.func.id if isinstance(n.func, ast.Name) else ""
                for callee in by_last.get(called, []):
                    flow = build(found[callee])
                    for k, (a, _, s) in flow.statements.items():
                        if isinstance(s, ast.Return) and (callee, a) not in seen:
                            seen.add((callee, a))
                            todo.append((callee, a, level + 1))
                    if callee not in out:
                        out[callee] |= set()
    return {k: sorted(v) for k, v in out.items()}
