"""Control flow, definitions and uses of functions in languages with braces: Java, C#, Go, JavaScript, TypeScript, C, C++.

The statements come from the tokens of `syntax` once its parser has found the text valid, so that blocks, headers and ends
of statements need no second grammar. As for Python, compound statements that are no branches or loops are opaque, and
what may change part of a value (a member, an element, an argument of a call) is a weak definition.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

from graphloom.analysis.flow import ENTRY, EXIT, Flow
from graphloom.sources.walkers import parsed

LANGUAGES = ("java", "csharp", "go", "javascript", "typescript", "c", "cpp")
_ASSIGN = frozenset(["=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", "&&=", "||=", "??=", "**=", "&^="])
_MEMBER = frozenset([".", "?.", "->", "::"])
_GOES_ON = frozenset([".", "?.", "+", "-", "*", "/", "%", "&&", "||", "??", "?", ":", "=", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "&", "|", "^", "=>", ",", "+=", "-=", "(", "[", "{", "in", "instanceof"])
_OPAQUE = frozenset(["try", "synchronized", "lock", "using", "fixed", "checked", "unchecked", "unsafe", "select", "with"])
_DECLARE = frozenset(["var", "const", "final", "static", "auto", "register", "volatile", "unsigned", "signed", "readonly"])


@dataclass
class Code:
    """One statement: its lines, the last line of its header, and the names in what counts of it."""

    first: int
    last: int
    head_last: int
    strong: set[str] = field(default_factory=set)
    weak: set[str] = field(default_factory=set)
    uses: set[str] = field(default_factory=set)
    shows: bool = False


@dataclass
class Function:
    """One function of a text: its qualified name within the module, its line, and where its parts stand among the tokens."""

    name: str
    lineno: int
    parameters: list[str]
    body: tuple[int, int]


class _File:
    def __init__(self, text: str, language: str):
        self.tokens, self.parser, self.source = parsed(text, language)
        self.K, self.V, self.N, self.ends, self.language = self.parser.K, self.parser.V, self.parser.N, self.parser.ends, language
        self.starts = [0, *(k + 1 for k, c in enumerate(self.source) if c == "\n")]

    def line(self, k: int) -> int:
        places = self.tokens.places
        return bisect_right(self.starts, max(0, places[min(k, len(places) - 1)] - 1))

    def functions(self) -> list[Function]:
        out = []
        for kind, name, first, last, within in self.parser.found:
            if kind != "callable":
                continue
            at = name + 1
            while at <= last and self.K[at] not in ("(", "{"):
                at += 1
            if at > last or self.K[at] != "(":
                continue
            close = self.ends[at]
            body = close + 1
            while body <= last and self.K[body] != "{":
                body = self.ends[body] + 1 if self.K[body] in ("(", "[") else body + 1
            if body <= last:
                out.append(Function(within, self.line(first), self._parameters(at + 1, close), (body, self.ends[body])))
        return out

    def _parameters(self, lo: int, hi: int) -> list[str]:
        """Names before their types in Go and the scripts, after them elsewhere."""
        out = []
        for a, b in self.parts(lo, hi, ","):
            stop = next((k for k in range(a, b) if self.K[k] in ("=", ":")), b)
            names = [k for k in range(a, stop) if self.K[k] == "i"]
            if names:
                out.append(self.V[names[0] if self.language in ("go", "javascript", "typescript") else names[-1]])
        return out

    def parts(self, lo: int, hi: int, sign: str) -> list[tuple[int, int]]:
        """Stretches between the signs outside all brackets."""
        out, start, k = [], lo, lo
        while k < hi:
            if self.K[k] == sign:
                out.append((start, k))
                start = k + 1
            k = self.ends[k] + 1 if self.K[k] in ("(", "[", "{") else k + 1
        return [*out, (start, hi)] if start < hi else out


class _Builder:
    def __init__(self, file: _File, function: Function):
        self.f, self.function, self.flow = file, function, Flow()
        self.flow.parameters = function.parameters
        self.breaks: list[list[tuple[int, str]]] = []
        self.continues: list[list[tuple[int, str]]] = []

    def build(self) -> Flow:
        lo, hi = self.function.body
        self._close(self._body(lo + 1, hi, [(ENTRY, "seq")]), EXIT)
        return self.flow

    def _close(self, ends: list[tuple[int, str]], to: int) -> None:
        self.flow.edges.update((a, to, label) for a, label in ends)

    def _node(self, lo: int, hi: int, last: int | None = None, shows: bool = False, of: int | None = None) -> int:
        """A statement whose names are those of the tokens [of, hi), by default [lo, hi), and whose lines reach from lo to the
        token before `last`."""
        f = self.f
        k = len(self.flow.statements) + 1
        code = Code(f.line(lo), f.line(max(lo, (last or hi) - 1)), f.line(max(lo, hi - 1)), shows=shows)
        _names(f, lo if of is None else of, hi, code, of is not None)
        self.flow.statements[k] = (code.first, code.last, code)
        return k

    def _body(self, k: int, hi: int, ends):
        while k < hi:
            k, ends = self._statement(k, hi, ends)
        return ends

    def _header(self, k: int) -> tuple[int, int, int]:
        """Of the header after a keyword: its first token, the one after its last, and where the branch begins."""
        f = self.f
        if f.language == "go":
            b = k
            while f.K[b] != "{" or f.K[b - 1] in ("struct", "interface") or self._literal(b):
                b = f.ends[b] + 1 if f.K[b] in ("(", "[", "{") else b + 1
            return k, b, b
        while f.K[k] != "(":
            k += 1
        return k + 1, f.ends[k], f.ends[k] + 1

    def _literal(self, k: int) -> bool:
        """Whether a brace within a header of Go belongs to a value: another brace follows it on the same level."""
        f = self.f
        after = f.ends[k] + 1
        return f.K[after] in ("{", ";") and f.V[after] != "\n" and f.K[k - 1] in ("i", "]", "}")

    def _statement(self, k: int, hi: int, ends):
        f = self.f
        t = f.K[k]
        if t == ";":
            return k + 1, ends
        if t == "{":
            return f.ends[k] + 1, self._body(k + 1, f.ends[k], ends)
        if t == "i" and f.K[k + 1] == ":" and f.K[k + 2] != ":" and t != "case":
            return k + 2, ends
        if t == "if":
            return self._if(k, hi, ends)
        if t in ("while", "for", "foreach"):
            a, b, body = self._header(k + 1)
            node = self._node(k, b, self._end(body, hi), of=a)
            self._close(ends, node)
            self.breaks.append([])
            self.continues.append([])
            after, inner = self._statement(body, hi, [(node, "true")]) if body < hi else (body, [(node, "true")])
            self._close(inner + self.continues.pop(), node)
            bare = a >= b or t == "for" and f.language != "go" and [x for x in f.parts(a, b, ";")][1:2] == [] and f.K[b - 1] == ";"
            out = self.breaks.pop() + ([] if bare and t != "while" else [(node, "false")])
            return after, out
        if t == "do":
            first = len(self.flow.statements) + 1
            self.breaks.append([])
            self.continues.append([])
            after, inner = self._statement(k + 1, hi, ends)
            a, b, rest = self._header(after)
            node = self._node(after, b, rest, of=a)
            self._close(inner + self.continues.pop(), node)
            self.flow.edges.add((node, first, "true"))
            return rest + (f.K[rest] == ";"), [(node, "false"), *self.breaks.pop()]
        if t == "switch":
            return self._switch(k, hi, ends)
        end = self._end(k, hi)
        if t in ("return", "throw"):
            node = self._node(k, end, shows=True)
            self._close(ends, node)
            self.flow.edges.add((node, EXIT, "return" if t == "return" else "raise"))
            return end, []
        if t == "break" and self.breaks or t == "continue" and self.continues:
            node = self._node(k, end)
            self._close(ends, node)
            (self.breaks if t == "break" else self.continues)[-1].append((node, t))
            return end, []
        node = self._node(k, end)
        self._close(ends, node)
        return end, [(node, "seq")]

    def _if(self, k: int, hi: int, ends):
        f = self.f
        a, b, body = self._header(k + 1)
        node = self._node(k, b, self._end(k, hi), of=a)
        self._close(ends, node)
        after, out = self._statement(body, hi, [(node, "true")])
        if f.K[after] == ";" and f.K[after + 1] == "else":
            after += 1
        if after < hi and f.K[after] == "else":
            after, other = self._statement(after + 1, hi, [(node, "false")])
            return after, out + other
        return after, [*out, (node, "false")]

    def _switch(self, k: int, hi: int, ends):
        f = self.f
        a, b, body = self._header(k + 1)
        close = f.ends[body]
        node = self._node(k, b, close + 1, of=a)
        self._close(ends, node)
        self.breaks.append([])
        at, fall, default = body + 1, [], False
        while at < close:
            default |= f.K[at] == "default"
            while f.K[at] not in (":", "->", "=>"):
                at = f.ends[at] + 1 if f.K[at] in ("(", "[", "{") else at + 1
            arrow = f.K[at] != ":"
            at += 1
            stop = at
            while stop < close and f.K[stop] not in ("case", "default"):
                stop = f.ends[stop] + 1 if f.K[stop] in ("(", "[", "{") else stop + 1
            fall = self._body(at, stop, [*fall, (node, "case")])
            if arrow or f.language == "go":
                self.breaks[-1] += fall
                fall = []
            at = stop
        return close + 1, [*fall, *self.breaks.pop(), *([] if default else [(node, "false")])]

    def _end(self, k: int, hi: int) -> int:
        """The token after a statement."""
        f = self.f
        t = f.K[k]
        if t == "{":
            return f.ends[k] + 1
        if t in ("if", "while", "for", "foreach", "switch"):
            _, _, body = self._header(k + 1)
            at = self._end(body, hi) if body < hi else hi
            while t == "if" and at < hi and f.K[at] == "else":
                at = self._end(at + 1, hi)
            return at
        if t == "do":
            at = self._end(k + 1, hi)
            _, _, rest = self._header(at)
            return rest + (f.K[rest] == ";")
        if t in _OPAQUE:
            at = k
            while at < hi and f.K[at] not in ("{", ";"):
                at = f.ends[at] + 1 if f.K[at] in ("(", "[") else at + 1
            at = f.ends[at] + 1 if at < hi and f.K[at] == "{" else min(at + 1, hi)
            while at < hi and f.K[at] in ("catch", "finally"):
                while f.K[at] != "{":
                    at = f.ends[at] + 1 if f.K[at] == "(" else at + 1
                at = f.ends[at] + 1
            return at
        script = f.language in ("javascript", "typescript")
        at = k
        while at < hi and f.K[at] != ";":
            if script and at > k and f.N[at] and f.K[at] not in _GOES_ON and f.K[at - 1] not in _GOES_ON:
                return at
            at = f.ends[at] + 1 if f.K[at] in ("(", "[", "{") else at + 1
        return min(at + 1, hi)


def _names(f: _File, lo: int, hi: int, code: Code, header: bool) -> None:
    for a, b in f.parts(lo, hi, ";"):
        _segment(f, a, b, code, not header)


def _segment(f: _File, lo: int, hi: int, code: Code, may_declare: bool = False) -> None:
    """Names of a stretch without semicolons: its first assignment splits it into targets and value.

    Without one, a statement that ends in a name after its type declares that name.
    """
    K, V = f.K, f.V
    sign = k = lo
    while k < hi and K[k] not in _ASSIGN and not (K[k] == ":" and f.language in ("java", "cpp") or K[k] == "i" and V[k] == "of" or K[k] == "in" and f.language in ("javascript", "typescript", "csharp")):
        k = f.ends[k] + 1 if K[k] in ("(", "[", "{") else k + 1
    sign = k
    if sign >= hi:
        after_type = hi - lo >= 2 and K[hi - 1] == "i" and (K[hi - 2] in ("i", "prim", "*", "&", "]") or K[hi - 2] == ">" and "<" in K[lo:hi] or K[lo] in _DECLARE)
        if may_declare and after_type and K[lo] in ("i", "prim", *_DECLARE):
            code.strong.add(V[hi - 1])
            hi -= 1
        return _uses(f, lo, hi, code)
    while lo < sign and (K[lo] in ("for", "foreach", "if", "while", "switch", "(") or K[lo] in _DECLARE or K[lo] == "i" and V[lo] in ("let", "await") and K[lo + 1] != "."):
        lo += 1
    for a, b in f.parts(lo, sign, ","):
        last = b - 1
        if f.language == "typescript" and (colon := next((k for k in range(a, b) if K[k] == ":"), None)):
            last = colon - 1
        if f.language == "go" and K[a] == "i" and K[a + 1] != "." and K[a - 1] == "var":
            last = a
        if last >= a and K[last] == "i" and (last == a or K[last - 1] not in _MEMBER):
            code.strong.add(V[last])
            if K[sign] not in ("=", ":=", ":", "i", "in"):
                code.uses.add(V[last])
        elif K[a] in ("{", "[") and a == lo:  # taken apart
            code.strong.update(V[k] for k in range(a, b) if K[k] == "i" and K[k + 1] != ":")
        else:
            roots = [k for k in range(a, b) if K[k] == "i" and K[k - 1] not in _MEMBER]
            if roots:
                code.weak.add(V[roots[0]])
                code.uses.update(V[k] for k in roots)
                code.shows = True
    if sign + 1 < hi:
        _segment(f, sign + 1, hi, code)


def _uses(f: _File, lo: int, hi: int, code: Code) -> None:
    K, V = f.K, f.V
    for k in range(lo, hi):
        if K[k] != "i" or K[k - 1] in _MEMBER and k > lo:
            continue
        n = K[k + 1]
        if n == "i" or n == ":" and K[k - 1] in ("{", ","):
            continue
        code.uses.add(V[k])
        if n in ("++", "--") or K[k - 1] in ("++", "--"):
            code.strong.add(V[k])
        elif n in _ASSIGN:  # within a function or a condition: it may not happen
            code.weak.add(V[k])
        elif n in _MEMBER:
            end = k
            while K[end + 1] in _MEMBER:
                end += 2
            if K[end + 1] == "(":
                code.weak.add(V[k])
        elif K[k - 1] in ("(", ",") and n in (")", ",") and _in_call(f, k):
            code.weak.add(V[k])
    code.shows |= any(K[k] == "(" and K[k - 1] == "i" for k in range(lo, hi))


def _in_call(f: _File, k: int) -> bool:
    """Whether the innermost bracket around a token is that of a call's arguments."""
    depth = 0
    for j in range(k - 1, -1, -1):
        if f.K[j] in (")", "]", "}"):
            depth += 1
        elif f.K[j] in ("(", "[", "{"):
            if not depth:
                return f.K[j] == "(" and f.K[j - 1] == "i"
            depth -= 1
    return False


def flows(text: str | None, language: str) -> list[tuple[str, Function, Flow]]:
    """(name, function, flow) of every function with a body; none of a text that is not valid."""
    try:
        file = _File(text or "", language)
    except ValueError:
        return []
    out = []
    for function in file.functions():
        out.append((function.name, function, _Builder(file, function).build()))
    return out
