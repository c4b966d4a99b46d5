"""Go; the lexer has put in the semicolons."""

from __future__ import annotations

from graphloom.syntax.base import JOINED, PLAIN, Bad, Parser

_TYPE_STARTS = frozenset(["i", "*", "[", "func", "map", "chan", "struct", "interface", "(", "<-"])


class Go(Parser):
    LANGUAGE = "go"
    BINARY = frozenset(["+", "-", "*", "/", "%", "&", "|", "^", "&&", "||", "==", "!=", "<", ">", "<=", ">=", "<<", "&^"])
    PREFIX = frozenset(["!", "+", "-", "^", "*", "&", "<-"])
    ASSIGN = frozenset(["=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", "&^="])
    TERNARY = False

    def __init__(self, tokens):
        super().__init__(tokens)
        self.no_literal = False

    # ------------------------------------------------------------ types

    def type(self):
        K = self.K
        t = K[self.p]
        if t == "i":
            self.dotted()
            if K[self.p] == "[" and K[self.p + 1] != "]" and K[self.p + 1] in _TYPE_STARTS and not self.N[self.p]:
                self.p += 1
                self.listed(self.type, "]", ",", True)
        elif t == "*":
            self.p += 1
            self.type()
        elif t == "[":
            self.p += 1
            if not self.ok("]"):
                if not self.ok("..."):
                    self.inside(self.expr)
                self.need("]")
            self.type()
        elif t == "map":
            self.p += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif t == "chan":
            self.p += 1
            self.ok("<-")
            self.type()
        elif t == "<-":
            self.p += 1
            self.need("chan")
            self.type()
        elif t == "func":
            self.p += 1
            self.signature()
        elif t == "struct":
            self.p += 1
            self.struct()
        elif t == "interface":
            self.p += 1
            self.interface()
        elif t == "(":
            self.p += 1
            self.type()
            self.need(")")
        else:
            raise Bad

    def struct(self):
        self.need("{")
        K = self.K
        while not self.ok("}"):
            if K[self.p] == "*" or K[self.p] == "i" and K[self.p + 1] in (";", "}", ".", "s"):
                self.ok("*")
                self.type()
            elif K[self.p] == "i" and K[self.p + 1] == "[" and self.tries(self._embedded):
                pass
            else:
                self.name()
                while self.ok(","):
                    self.name()
                self.type()
            self.ok("s")
            if K[self.p] != "}":
                self.need(";")

    def _embedded(self):
        """An embedded generic type: nothing follows its arguments."""
        self.type()
        if self.K[self.p] not in (";", "}", "s"):
            raise Bad

    def interface(self):
        self.need("{")
        while not self.ok("}"):
            if self.K[self.p] == "i" and self.K[self.p + 1] == "(":
                self.p += 1
                self.signature()
            else:
                self.union()
            if self.K[self.p] != "}":
                self.need(";")

    def union(self):
        while True:
            self.ok("~")
            self.type()
            if not self.ok("|"):
                return

    def signature(self):
        self.params()
        if self.K[self.p] == "(":
            self.params()
        elif self.K[self.p] in _TYPE_STARTS and not (self.K[self.p] == "<-" and self.K[self.p + 1] != "chan"):
            self.type()

    def params(self):
        """Either all parameters have names or none has."""
        self.need("(")
        K = self.K
        named = bare = False
        last_named = True
        while not self.ok(")"):
            if K[self.p] == "i" and K[self.p + 1] not in (",", ")", ".") and not (K[self.p + 1] == "[" and K[self.ends[self.p + 1] + 1] in (",", ")")):
                self.p += 1
                self.ok("...")
                self.type()
                named = last_named = True
            else:
                self.ok("...")
                simple = K[self.p] == "i" and K[self.p + 1] in (",", ")")
                self.type()
                if simple:
                    last_named = False
                else:
                    bare = last_named = True
            if K[self.p] != ")":
                self.need(",")
        if named and (bare or not last_named):
            raise Bad

    # ------------------------------------------------------------ expressions

    def inside(self, f, *args):
        old, self.no_literal = self.no_literal, False
        f(*args)
        self.no_literal = old

    def expr(self):
        """Without assignments, which are statements."""
        K, binary = self.K, self.BINARY
        form = PLAIN
        while True:
            self.unary()
            t = K[self.p]
            if t not in binary:
                return form
            if t == ">" and self.V[self.p] == ">>":
                if K[self.p + 1] == ">=":
                    return form
                self._shifts()
            else:
                self.p += 1
            form = JOINED

    def unary(self):
        K = self.K
        while K[self.p] in self.PREFIX:
            if K[self.p] == "<-" and K[self.p + 1] == "chan":
                self.type()
                return self.postfix()
            self.p += 1
        t = K[self.p]
        if t == "i":
            self.p += 1
            if K[self.p] == "{" and not self.no_literal:
                self.literal()
        elif t in ("n", "s"):
            self.p += 1
        elif t == "(":
            self.p += 1
            self.inside(self._expr_or_type)
            self.need(")")
        elif t == "func":
            self.p += 1
            self.signature()
            if K[self.p] == "{":
                self.inside(self.block)
        elif t in ("[", "map", "struct", "chan", "interface"):
            self.type()
            if K[self.p] == "{" and t not in ("chan", "interface"):
                self.literal()
            elif K[self.p] not in ("(", ")", ",", "]", "}", ";", ":"):
                raise Bad
        else:
            raise Bad
        self.postfix()

    def _expr_or_type(self):
        self.expr()

    def literal(self):
        self.need("{")
        self.inside(self.listed, self.element, "}", ",", True)

    def element(self):
        self.value()
        if self.ok(":"):
            self.value()

    def value(self):
        if self.K[self.p] == "{":
            self.literal()
        else:
            self.expr()

    def postfix(self):
        K = self.K
        while True:
            t = K[self.p]
            if t == ".":
                self.p += 1
                if self.ok("("):
                    if not self.ok("type"):
                        self.type()
                    self.need(")")
                else:
                    self.name()
                    if K[self.p] == "{" and not self.no_literal:
                        self.literal()
            elif t == "(":
                self.calls()
                self.p += 1
                self.inside(self.listed, self.argument, ")", ",", True)
            elif t == "[":
                self.p += 1
                self.inside(self.index)
                if K[self.p] == "{" and not self.no_literal and K[self.p - 2] in ("i", "]"):
                    if not self.tries(self._literal_ahead):
                        return
                    self.literal()
            else:
                return

    def _literal_ahead(self):
        at, end = self.p, self.ends[self.p]
        if self.K[at + 1] not in ("i", "s", "n", "}", "{", "&", "[", "-") or self.K[end + 1] == "else":
            raise Bad

    def argument(self):
        self.expr()
        self.ok("...")

    def index(self):
        colons = 0
        if self.K[self.p] == "]":
            raise Bad
        while not self.ok("]"):
            if self.ok(":"):
                colons += 1
                if colons > 2:
                    raise Bad
                continue
            self.expr()
            if self.K[self.p] == "," and not colons:
                self.p += 1
                if self.K[self.p] != "]":
                    self.listed(self.expr, "]", ",", True)
                    return
            elif self.K[self.p] not in (":", "]"):
                raise Bad

    # ------------------------------------------------------------ statements

    def block(self):
        self.need("{")
        self.statements(("}",))
        self.need("}")

    def statements(self, until):
        K = self.K
        while K[self.p] not in until:
            if self.ok(";"):
                continue
            self.statement()
            if K[self.p] not in until:
                self.need(";")

    def simple(self, ranged: bool = False) -> bool:
        """An expression, assignment, send or count; whether it was a range clause."""
        K = self.K
        start = self.p
        if ranged and K[self.p] == "range":
            self.p += 1
            self.expr()
            return True
        form = self.expr()
        n = 1
        while self.ok(","):
            self.expr()
            n += 1
            form = PLAIN
        t = K[self.p]
        if t in self.ASSIGN or t == ">" and K[self.p + 1] == ">=":
            if form != PLAIN or K[self.p - 1] in ("n", "s") or t == ":=" and K[self.p - 1] != "i" or n > 1 and t not in ("=", ":="):
                raise Bad
            while not self.ok(t) or t == ">" and not self.ok(">="):
                pass
            if ranged and K[self.p] == "range":
                self.p += 1
                self.expr()
                return True
            self.expr()
            m = 1
            while self.ok(","):
                self.expr()
                m += 1
            if m != n and m != 1 or t not in ("=", ":=") and m > 1:
                raise Bad
        elif t in ("++", "--"):
            if K[self.p - 1] in ("n", "s") or n > 1:
                raise Bad
            self.p += 1
        elif t == "<-":
            self.p += 1
            self.expr()
        elif n > 1:
            raise Bad
        elif K[start] != "<-" and not (form == PLAIN and K[self.p - 1] == ")") and not self.header:
            raise Bad
        return False

    header = False

    def clause(self, ranged: bool = False) -> bool:
        old = self.no_literal, self.header
        self.no_literal = self.header = True
        out = self.simple(ranged)
        self.no_literal, self.header = old
        return out

    def statement(self):
        K = self.K
        t = K[self.p]
        if t == "i" and K[self.p + 1] == ":":
            self.p += 2
            if K[self.p] not in ("}", ";"):
                self.statement()
        elif t == "{":
            self.block()
        elif t in ("var", "const", "type"):
            self.declaration()
        elif t == "if":
            self._if()
        elif t == "for":
            self._for()
        elif t == "switch":
            self._switch()
        elif t == "select":
            self.p += 1
            self.need("{")
            while not self.ok("}"):
                if self.ok("case"):
                    self.clause()
                else:
                    self.need("default")
                self.need(":")
                self.statements(("case", "default", "}"))
        elif t == "return":
            self.p += 1
            if K[self.p] not in (";", "}"):
                self.expr()
                while self.ok(","):
                    self.expr()
        elif t in ("break", "continue"):
            self.p += 1
            self.ok("i")
        elif t == "fallthrough":
            self.p += 1
        elif t == "goto":
            self.p += 1
            self.name()
        elif t in ("go", "defer"):
            self.p += 1
            if self.expr() != PLAIN or K[self.p - 1] != ")":
                raise Bad
        else:
            old, self.header = self.header, False
            self.simple()
            self.header = old

    def _if(self):
        self.need("if")
        if self.K[self.p] == ";":
            self.p += 1
            self.clause()
        else:
            self.clause()
            if self.ok(";"):
                self.clause()
        self.block()
        if self.ok("else"):
            if self.K[self.p] == "if":
                self._if()
            else:
                self.block()

    def _for(self):
        self.need("for")
        K = self.K
        if K[self.p] != "{":
            ranged = K[self.p] != ";" and self.clause(True)
            if not ranged and K[self.p] != "{":
                self.need(";")
                if K[self.p] != ";":
                    self.clause()
                self.need(";")
                if K[self.p] != "{":
                    self.clause()
        self.block()

    def _switch(self):
        self.need("switch")
        K = self.K
        if K[self.p] != "{":
            if K[self.p] != ";":
                self.clause()
            if self.ok(";") and K[self.p] != "{":
                self.clause()
        self.need("{")
        while not self.ok("}"):
            if self.ok("case"):
                self._case()
                while self.ok(","):
                    self._case()
            else:
                self.need("default")
            self.need(":")
            self.statements(("case", "default", "}"))

    def _case(self):
        if self.K[self.p] in ("map", "[", "chan", "interface", "struct", "func", "*") and self.tries(self._case_type):
            return
        self.expr()

    def _case_type(self):
        self.type()
        if self.K[self.p] not in (",", ":"):
            raise Bad

    # ------------------------------------------------------------ declarations

    def declaration(self):
        spec = {"var": self._var, "const": self._const, "type": self._type, "import": self._import}[self.K[self.p]]
        self.p += 1
        if self.ok("("):
            while not self.ok(")"):
                spec()
                if self.K[self.p] != ")":
                    self.need(";")
        else:
            if spec == self._const and self.K[self.p + 1] in (";", "}"):
                raise Bad
            spec()

    def _names(self) -> int:
        self.name()
        n = 1
        while self.ok(","):
            self.name()
            n += 1
        return n

    def _values(self, n: int):
        self.expr()
        m = 1
        while self.ok(","):
            self.expr()
            m += 1
        if m != n and m != 1:
            raise Bad

    def _var(self):
        n = self._names()
        if self.K[self.p] != "=":
            self.type()
        if self.ok("="):
            self._values(n)

    def _const(self):
        n = self._names()
        if self.K[self.p] not in ("=", ";", ")"):
            self.type()
            if self.K[self.p] != "=":
                raise Bad
        if self.ok("="):
            self._values(n)

    def _type(self):
        name = self.p
        self.opens(self.V[name])
        self._type_spec()
        self.closes("type", name, name - 1)

    def _type_spec(self):
        self.name()
        if self.K[self.p] == "[" and self.K[self.p + 1] == "i" and self.K[self.p + 2] != "]" and self.tries(self._type_params):
            self.ok("=")
            return self.type()
        self.ok("=")
        self.type()

    def _type_params(self):
        self.need("[")
        self.listed(self._type_param, "]", ",", True, False)

    def _type_param(self):
        self._names()
        self.union()

    def _import(self):
        first = self.p
        if not self.ok("i"):
            self.ok(".")
        self.need("s")
        self.found.append(("import", self.p - 1, first, self.p - 1, ""))

    @staticmethod
    def begins(kinds, words, fresh):
        return kinds[0] in ("package", ";")

    def top(self):
        K = self.K
        while self.ok(";"):
            pass
        self.need("package")
        self.name()
        self.need(";")
        while K[self.p]:
            if self.ok(";"):
                continue
            t = K[self.p]
            if t == "func":
                first, receiver = self.p, ""
                self.p += 1
                if K[self.p] == "(":
                    inner = [k for k in range(self.p, self.ends[self.p]) if K[k] == "i"]
                    receiver = self.V[inner[1] if len(inner) > 1 else inner[0]] if inner else ""
                    self.params()
                name = self.p
                self.name()
                self.opens(receiver + "." + self.V[name] if receiver else self.V[name])
                if K[self.p] == "[":
                    self._type_params()
                self.signature()
                if K[self.p] == "{":
                    self.block()
                self.closes("callable", name, first)
            elif t in ("var", "const", "type", "import"):
                self.declaration()
            else:
                raise Bad
            if K[self.p]:
                self.need(";")
