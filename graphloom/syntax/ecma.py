"""JavaScript and TypeScript, with markup elements (which the lexer reads)."""

from __future__ import annotations

from graphloom.syntax.base import Bad, Parser
from graphloom.syntax.lexing import RESERVED

_WORDS = frozenset(RESERVED["javascript"].split()) | {"i", "n"}
_MODIFIERS = frozenset("static public private protected readonly abstract override declare async get set accessor".split())
_DECLARED = frozenset("let type interface namespace module abstract global async".split())
#: What shows that a word before it was the member's name and no modifier.
_AFTER_NAME = frozenset(["(", "=", ";", ":", "?", "!", "}", "<", ",", ""])
_STARTS = frozenset(["i", "n", "s", "(", "[", "{", "this", "super", "new", "function", "class", "!", "~", "+", "-", "++", "--", "typeof", "void", "delete", "import", "@"])


class JavaScript(Parser):
    LANGUAGE = "javascript"
    TS = False
    PREFIX = frozenset(["!", "~", "+", "-", "++", "--", "typeof", "void", "delete"])
    SHIFT = 3
    BINARY = Parser.BINARY | {"**", "===", "!==", "??", "instanceof"}
    ANGLED = frozenset(["i", "n", "s", ",", ".", "[", "(", "{", "|", "&", "=>", "typeof", "void", "this", "extends", "?", ":", "-", "in", "import", "new"])

    def __init__(self, tokens):
        super().__init__(tokens)
        self.no_in = self.no_typed_arrow = False

    # ------------------------------------------------------------ expressions

    def joint(self, kind):
        if kind == "in" and not self.no_in:
            self.p += 1
            return 1
        if self.TS and kind == "i" and self.V[self.p] in ("as", "satisfies") and not self.N[self.p]:
            self.p += 1
            if not self.ok("const"):
                self.type()
            return 2
        return 0

    def middle(self):
        old, self.no_typed_arrow, no_in, self.no_in = self.no_typed_arrow, True, self.no_in, False
        self.expr()
        self.no_typed_arrow, self.no_in = old, no_in

    def inside(self, f, *args):
        """Within brackets no restriction of the outside holds."""
        old = self.no_in, self.no_typed_arrow
        self.no_in = self.no_typed_arrow = False
        f(*args)
        self.no_in, self.no_typed_arrow = old

    def exprs(self):
        self.expr()
        while self.ok(","):
            self.expr()

    def hole(self):
        self.ok("...")
        self.exprs()

    def unary(self):
        K, V = self.K, self.V
        while True:
            t = K[self.p]
            if t in self.PREFIX:
                self.p += 1
            elif t == "i" and V[self.p] in ("await", "yield") and not self.N[self.p + 1] and K[self.p + 1] in _STARTS:
                self.p += 1
            elif t == "i" and V[self.p] == "yield" and K[self.p + 1] == "*":
                self.p += 2
            else:
                break
        if t == "<" and self.TS:
            end = self.angle(self.p)
            if not end:
                raise Bad
            if K[end] == "(" and self.arrow_at(end):
                self.type_params()
                return self.arrow()
            self.p += 1
            self.type()
            self.need(">")
            return self.unary()
        if self.primary():
            return
        self.postfix()

    def primary(self) -> bool:
        """Whether what was read takes no postfix: an arrow function."""
        K, p = self.K, self.p
        t = K[p]
        if t == "i":
            if K[p + 1] == "=>" and not self.N[p + 1]:
                self.p += 2
                self.arrow_body()
                return True
            if self.V[p] == "async" and not self.N[p + 1]:
                if K[p + 1] == "function":
                    self.p += 1
                    self.function()
                    return False
                if K[p + 1] == "i" and K[p + 2] == "=>":
                    self.p += 3
                    self.arrow_body()
                    return True
                if K[p + 1] == "(" and self.arrow_at(p + 1):
                    self.p += 1
                    self.arrow()
                    return True
                if K[p + 1] == "<" and self.TS and (end := self.angle(p + 1)) and K[end] == "(" and self.arrow_at(end):
                    self.p += 1
                    self.type_params()
                    self.arrow()
                    return True
            self.p += 1
        elif t in ("n", "s", "this", "super"):
            self.p += 1
        elif t == "(":
            if self.arrow_at(p):
                self.arrow()
                return True
            self.p += 1
            self.inside(self.exprs)
            self.need(")")
        elif t == "[":
            self.p += 1
            self.inside(self.elements)
        elif t == "{":
            self.p += 1
            self.inside(self.listed, self.property, "}", ",", True)
        elif t == "function":
            self.function()
        elif t == "class" or t == "@":
            self.decorators()
            self.classed(False)
        elif t == "new":
            self.p += 1
            if self.ok("."):
                self.name()
            else:
                if self.primary():
                    raise Bad
                self.postfix(False)
                if K[self.p] == "<" and self.TS and (end := self.angle(self.p)) and K[end] == "(":
                    self.type_args()
                if K[self.p] == "(":
                    self.args()
        elif t == "import":
            self.p += 1
            if self.ok("."):
                self.name()
            elif K[self.p] == "(":
                self.args()
            else:
                raise Bad
        else:
            raise Bad
        return False

    def postfix(self, calls: bool = True):
        K = self.K
        while True:
            t = K[self.p]
            if t == "." or t == "?.":
                self.p += 1
                n = K[self.p]
                if n in _WORDS:
                    self.p += 1
                elif t == "?." and n == "(" and calls:
                    self.args()
                elif t == "?." and n == "[":
                    continue
                else:
                    raise Bad
            elif t == "(":
                if not calls:
                    return
                self.calls()
                self.args()
            elif t == "[":
                self.p += 1
                self.inside(self.exprs)
                self.need("]")
            elif t == "s" and self.V[self.p] == "`":
                self.p += 1
            elif (t == "++" or t == "--") and calls:
                if self.N[self.p] or K[self.p - 1] in ("n", "s"):
                    return
                self.p += 1
            elif t == "!" and self.TS and not self.N[self.p]:
                self.p += 1
            elif t == "<" and self.TS and calls and (end := self.angle(self.p)) and (K[end] == "(" or K[end] == "s" and self.V[end] == "`"):
                self.type_args()
            else:
                return

    def args(self):
        self.p += 1
        self.inside(self.listed, self.argument, ")", ",", True)

    def argument(self):
        self.ok("...")
        self.expr()

    def elements(self):
        while not self.ok("]"):
            if self.ok(","):
                continue
            self.argument()
            if self.K[self.p] != "]":
                self.need(",")

    def key(self):
        t = self.K[self.p]
        if t in _WORDS or t == "s" and self.V[self.p] != "`":
            self.p += 1
        elif t == "[":
            self.p += 1
            self.inside(self.expr)
            self.need("]")
        else:
            raise Bad

    def property(self):
        K, V = self.K, self.V
        if self.ok("..."):
            return self.expr()
        star = False
        while K[self.p] == "i" and V[self.p] in ("async", "get", "set") and K[self.p + 1] not in _AFTER_NAME:
            self.p += 1
        if self.ok("*"):
            star = True
        start = self.p
        self.key()
        if K[self.p] in ("(", "<"):
            return self.method(True)
        if star:
            raise Bad
        if self.ok(":"):
            self.expr()
        elif K[start] != "i":
            raise Bad
        elif self.ok("="):
            self.expr()

    def arrow_at(self, p: int) -> bool:
        """Whether the parenthesis at p opens the parameters of an arrow function."""
        after = self.ends[p] + 1
        if self.K[after] == "=>":
            return not self.N[after]
        if not self.TS or self.K[after] != ":" or self.no_typed_arrow:
            return False
        at, self.p = self.p, after + 1
        try:
            self.returned()
            return self.K[self.p] == "=>"
        except Bad:
            return False
        finally:
            self.p = at

    def arrow(self):
        self.inside(self.params)
        if self.TS and self.ok(":"):
            self.returned()
        self.need("=>")
        self.arrow_body()

    def arrow_body(self):
        if self.K[self.p] == "{":
            self.inside(self.block)
        else:
            self.expr()

    def function(self, declared: bool = False):
        first = self.p
        self.need("function")
        self.ok("*")
        if self.K[self.p] == "i":
            name = self.p
            self.p += 1
            self.opens(self.V[name])
            self.method(not declared)
            return self.closes("callable", name, first)
        if declared:
            raise Bad
        self.method(not declared)

    def method(self, bodied: bool):
        """Type parameters, parameters, result and body; a declaration of TypeScript may lack the body."""
        if self.TS and self.K[self.p] == "<":
            self.type_params()
        self.inside(self.params)
        if self.TS and self.ok(":"):
            self.returned()
        if self.K[self.p] == "{":
            self.inside(self.block)
        elif self.TS and not bodied:
            self.end()
        else:
            raise Bad

    # ------------------------------------------------------------ parameters and patterns

    def params(self):
        self.need("(")
        self.listed(self.param, ")", ",", True)

    def param(self):
        self.decorators()
        if self.TS:
            while self.K[self.p] == "i" and self.V[self.p] in _MODIFIERS and self.K[self.p + 1] in ("i", "[", "{"):
                self.p += 1
        if self.ok("..."):
            self.pattern()
        elif not (self.TS and self.ok("this")):
            self.pattern()
        if self.TS:
            self.ok("?")
            if self.ok(":"):
                self.type()
        if self.ok("="):
            self.expr()

    def pattern(self):
        t = self.K[self.p]
        if t == "i":
            self.p += 1
        elif t == "[":
            self.p += 1
            while not self.ok("]"):
                if self.ok(","):
                    continue
                self.ok("...")
                self.defaulted()
                if self.K[self.p] != "]":
                    self.need(",")
        elif t == "{":
            self.p += 1
            self.listed(self.field_pattern, "}", ",", True)
        else:
            raise Bad

    def defaulted(self):
        self.pattern()
        if self.ok("="):
            self.expr()

    def field_pattern(self):
        if self.ok("..."):
            return self.pattern()
        start = self.p
        self.key()
        if self.ok(":"):
            return self.defaulted()
        if self.K[start] != "i":
            raise Bad
        if self.ok("="):
            self.expr()

    # ------------------------------------------------------------ classes

    def decorators(self):
        while self.ok("@"):
            if self.K[self.p] == "(":
                self.p += 1
                self.expr()
                self.need(")")
            else:
                self.dotted()
                if self.K[self.p] == "<" and self.TS and self.angle(self.p):
                    self.type_args()
                if self.K[self.p] == "(":
                    self.args()

    def classed(self, named: bool):
        first = self.p
        self.need("class")
        name = self.p
        if self.K[self.p] == "i" and not (self.V[self.p] == "implements" and self.K[self.p + 1] == "i"):
            self.p += 1
        elif named:
            raise Bad
        self.opens(self.V[name] if self.p > name else "")
        self.class_rest()
        if self.p and self.K[name] == "i":
            self.closes("type", name, first)
        else:
            self.inside_of.pop()

    def class_rest(self):
        if self.TS and self.K[self.p] == "<":
            self.type_params()
        if self.ok("extends"):
            base = self.p
            self.unary()
            if self.K[self.p - 1] == "i":
                self.found.append(("inherits", self.p - 1, base, self.p - 1, ".".join(self.inside_of)))
            if self.TS and self.K[self.p] == "<":
                self.type_args()
        if self.TS and self.word("implements"):
            while True:
                base = last = self.p
                while self.K[last + 1] == "." and self.K[last + 2] == "i":
                    last += 2
                self.type()
                self.found.append(("implements", last, base, last, ".".join(self.inside_of)))
                if not self.ok(","):
                    break
        self.need("{")
        while not self.ok("}"):
            self.inside(self.member)

    def member(self):
        K, V = self.K, self.V
        start = self.p
        if self.ok(";"):
            return
        self.decorators()
        if K[self.p] == "i" and V[self.p] == "static" and K[self.p + 1] == "{":
            self.p += 1
            return self.block()
        abstract = False
        while K[self.p] == "i" and V[self.p] in _MODIFIERS and K[self.p + 1] not in _AFTER_NAME and not (self.N[self.p + 1] and V[self.p] in ("get", "set", "async")):
            if not self.TS and V[self.p] not in ("static", "async", "get", "set", "accessor"):
                break
            abstract |= V[self.p] in ("abstract", "declare")
            self.p += 1
        if self.ok("*"):
            self.key()
            return self.method(True)
        if K[self.p] == "[" and self.TS and K[self.p + 1] == "i" and K[self.p + 2] == ":":
            self.index_signature()
            return self.end()
        name = self.p
        self.key()
        if self.TS and not self.ok("?"):
            self.ok("!")
        if K[self.p] in ("(", "<"):
            self.opens(V[name])
            self.method(not self.TS)
            return self.closes("callable", name, start) if K[name] == "i" or K[name].isalpha() and K[name] != "s" else self.inside_of.pop()
        if self.TS and self.ok(":"):
            self.type()
        if self.ok("="):
            self.exprs()
        self.end()

    # ------------------------------------------------------------ statements

    def end(self):
        if not self.ok(";") and self.K[self.p] not in ("}", "") and not self.N[self.p]:
            raise Bad

    def block(self):
        self.need("{")
        while not self.ok("}"):
            self.statement()

    def body(self):
        if self.K[self.p] in ("const", "class"):
            raise Bad
        self.statement()

    def declaration(self, header: bool = False):
        """After var, let or const."""
        while True:
            name = self.p
            self.pattern()
            if self.TS:
                self.ok("!")
                if self.ok(":"):
                    self.type()
            if self.ok("="):
                t, n = self.K[self.p], self.K[self.p + 1]
                bound = self.K[name] == "i" and (t == "function" or t == "i" and (n == "=>" or self.V[self.p] == "async") or t == "(" and self.arrow_at(self.p))
                if bound:  # a function under the variable's name
                    self.opens(self.V[name])
                self.expr()
                if bound:
                    self.closes("callable", name, name - 1)
            if not self.ok(","):
                return

    def statement(self):
        K, V = self.K, self.V
        t = K[self.p]
        handler = self.STATEMENTS.get(t)
        if handler:
            return handler(self)
        if t == "i":
            w, n = V[self.p], K[self.p + 1]
            if n == ":":
                self.p += 2
                return self.statement()
            if w == "let" and n in ("i", "[", "{"):
                self.p += 1
                self.declaration()
                return self.end()
            if w == "async" and n == "function" and not self.N[self.p + 1]:
                self.p += 1
                return self.function(True)
            if self.TS and self.typed_statement(w, n):
                return
        self.exprs()
        self.end()

    def _block(self):
        self.block()

    def _empty(self):
        self.p += 1

    def _var(self):
        if self.K[self.p + 1] == "enum":
            if not self.TS:
                raise Bad
            self.p += 1
            return self._enum()
        self.p += 1
        self.declaration()
        self.end()

    def _function(self):
        self.function(True)

    def _class(self):
        self.decorators()
        if self.K[self.p] == "export":
            return self._export()
        if self.TS:
            self.word("abstract")
        self.classed(True)

    def _if(self):
        self.p += 1
        self._condition()
        self.body()
        if self.ok("else"):
            self.body()

    def _condition(self):
        self.need("(")
        self.inside(self.exprs)
        self.need(")")

    def _for(self):
        self.p += 1
        self.word("await")
        self.need("(")
        K, V = self.K, self.V
        if K[self.p] != ";":
            self.no_in = True
            if K[self.p] in ("var", "const") or K[self.p] == "i" and V[self.p] == "let" and K[self.p + 1] in ("i", "[", "{"):
                self.p += 1
                self.declaration(True)
            else:
                self.exprs()
            self.no_in = False
            if self.ok("in") or self.word("of"):
                self.inside(self.exprs)
                self.need(")")
                return self.body()
        self.need(";")
        if K[self.p] != ";":
            self.inside(self.exprs)
        self.need(";")
        if K[self.p] != ")":
            self.inside(self.exprs)
        self.need(")")
        self.body()

    def _while(self):
        self.p += 1
        self._condition()
        self.body()

    def _do(self):
        self.p += 1
        self.body()
        self.need("while")
        self._condition()
        self.ok(";")

    def _switch(self):
        self.p += 1
        self._condition()
        self.need("{")
        while not self.ok("}"):
            if self.ok("case"):
                self.exprs()
            else:
                self.need("default")
            self.need(":")
            while self.K[self.p] not in ("case", "default", "}"):
                self.statement()

    def _try(self):
        self.p += 1
        self.block()
        done = False
        if self.ok("catch"):
            done = True
            if self.ok("("):
                self.pattern()
                if self.TS and self.ok(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.ok("finally"):
            self.block()
        elif not done:
            raise Bad

    def _return(self):
        self.p += 1
        if not self.N[self.p] and self.K[self.p] not in (";", "}", ""):
            self.exprs()
        self.end()

    def _throw(self):
        self.p += 1
        if self.N[self.p]:
            raise Bad
        self.exprs()
        self.end()

    def _jump(self):
        self.p += 1
        if self.K[self.p] == "i" and not self.N[self.p]:
            self.p += 1
        self.end()

    def _debugger(self):
        self.p += 1
        self.end()

    def _import(self):
        K = self.K
        first = self.p
        if K[self.p + 1] in ("(", "."):
            self.exprs()
            return self.end()
        self.p += 1
        if not self.ok("s"):
            if self.TS and self.is_word("type") and K[self.p + 1] in ("i", "{", "*") and not self.is_word("from", 1):
                self.p += 1
            if self.ok("i"):
                if self.TS and self.ok("="):
                    self.exprs()
                    return self.end()
                if self.ok(","):
                    self._bindings()
            else:
                self._bindings()
            if not self.word("from"):
                raise Bad
            self.need("s")
        self.found.append(("import", self.p - 1, first, self.p - 1, ""))
        if self.ok("with") or self.word("assert"):
            self.unary()
        self.end()

    def _bindings(self):
        if self.ok("*"):
            if not self.word("as"):
                raise Bad
            return self.name()
        self.need("{")
        self.listed(self._binding, "}", ",", True)

    def _binding(self):
        K = self.K
        if self.TS and self.is_word("type") and (K[self.p + 1] in _WORDS) and not (self.is_word("as", 1) and K[self.p + 2] == "i" and not self.is_word("as", 2)):
            self.p += 1
        if K[self.p] not in _WORDS and K[self.p] != "s":
            raise Bad
        self.p += 1
        if self.word("as"):
            if K[self.p] not in _WORDS and K[self.p] != "s":
                raise Bad
            self.p += 1

    def _export(self):
        K = self.K
        self.p += 1
        if self.ok("default"):
            if K[self.p] == "function":
                self.p += 1
                self.ok("*")
                self.ok("i")
                return self.method(False)
            if self.is_word("async") and K[self.p + 1] == "function":
                self.p += 2
                self.ok("*")
                self.ok("i")
                return self.method(False)
            if K[self.p] in ("class", "@") or self.TS and self.is_word("abstract") and K[self.p + 1] == "class":
                self.decorators()
                self.word("abstract")
                return self.classed(False)
            if self.TS and self.is_word("interface") and K[self.p + 1] == "i":
                return self.statement()
            self.expr()
            return self.end()
        if self.TS and self.ok("="):
            self.expr()
            return self.end()
        if self.TS and self.is_word("as") and self.is_word("namespace", 1):
            self.p += 2
            self.name()
            return self.end()
        if self.TS and self.is_word("type") and K[self.p + 1] in ("{", "*"):
            self.p += 1
        if self.ok("*"):
            if self.word("as"):
                self.p += 1
            if not self.word("from"):
                raise Bad
            self.need("s")
            return self.end()
        if K[self.p] == "{":
            self._bindings()
            if self.word("from"):
                self.need("s")
            return self.end()
        if K[self.p] in ("var", "const", "function", "class", "@", "import", "enum") or K[self.p] == "i" and self.V[self.p] in ("let", "async", "type", "interface", "namespace", "module", "declare", "abstract"):
            if K[self.p] == "i" and K[self.p + 1] not in ("i", "[", "{", "function", "class", "var", "const", "enum", "s"):
                raise Bad
            return self.statement()
        raise Bad

    def _enum(self):
        raise Bad

    def _bad(self):
        raise Bad

    STATEMENTS = {
        "{": _block, ";": _empty, "var": _var, "const": _var, "function": _function, "class": _class, "@": _class, "if": _if, "for": _for, "while": _while, "do": _do, "switch": _switch, "try": _try, "return": _return, "throw": _throw, "break": _jump, "continue": _jump,
        "debugger": _debugger, "import": _import, "export": _export, "enum": lambda self: self._enum(), "else": _bad, "case": _bad, "catch": _bad, "finally": _bad, "default": _bad,
    }

    @staticmethod
    def begins(kinds, words, fresh):
        t = kinds[0]
        return not (t == "import" and kinds[1] == "n" or t == "i" and words[0] in ("package", "use", "fn", "func", "def", "from") and kinds[1] == "i" and not fresh[1]) and t not in ("#", "<", ")", "}", "else", "case", ".", "*")

    def top(self):
        while self.K[self.p]:
            self.statement()


class TypeScript(JavaScript):
    LANGUAGE = "typescript"
    TS = True

    def typed_statement(self, w: str, n: str) -> bool:
        K = self.K
        if w == "type" and n == "i" and not self.N[self.p + 1]:
            self.p += 2
            if K[self.p] == "<":
                self.type_params()
            self.need("=")
            self.type()
            self.end()
        elif w == "interface" and n == "i":
            first = self.p
            self.opens(self.V[first + 1])
            self.p += 2
            if K[self.p] == "<":
                self.type_params()
            if self.ok("extends"):
                while True:
                    base = self.p
                    self.type()
                    self.found.append(("inherits", base, base, base, ".".join(self.inside_of)))
                    if not self.ok(","):
                        break
            self.object_type()
            self.closes("type", first + 1, first)
        elif w in ("namespace", "module") and n in ("i", "s") and not self.N[self.p + 1]:
            self.p += 1
            if not self.ok("s"):
                self.dotted()
            if K[self.p] == "{":
                self.block()
            else:
                self.end()
        elif w == "abstract" and n == "class":
            self.p += 1
            self.classed(True)
        elif w == "declare" and (n in ("class", "function", "var", "const", "enum", "import") or n == "i" and self.V[self.p + 1] in _DECLARED) and not self.N[self.p + 1]:
            self.p += 1
            if self.word("global"):
                self.block()
            else:
                self.statement()
        else:
            return False
        return True

    def _enum(self):
        first = self.p
        self.need("enum")
        self.name()
        self.opens(self.V[first + 1])
        self.need("{")
        self.listed(self._enum_member, "}", ",", True)
        self.closes("type", first + 1, first)

    def _enum_member(self):
        self.key()
        if self.ok("="):
            self.expr()

    # ------------------------------------------------------------ types

    def type_params(self):
        self.need("<")
        self.listed(self._type_param, ">", ",", True, False)

    def _type_param(self):
        while self.K[self.p] in ("const", "in") or self.is_word("out") and self.K[self.p + 1] == "i":
            self.p += 1
        self.name()
        if self.ok("extends"):
            self.type()
        if self.ok("="):
            self.type()

    def type_args(self):
        self.need("<")
        self.listed(self.type, ">", ",", False, False)

    def returned(self):
        K = self.K
        if self.is_word("asserts") and K[self.p + 1] in ("i", "this") and not self.N[self.p + 1]:
            self.p += 2
            if self.word("is"):
                self.type()
            return
        if K[self.p] in ("i", "this") and self.is_word("is", 1) and not self.N[self.p + 1]:
            self.p += 2
        self.type()

    def type(self):
        K = self.K
        if not self.ok("|"):
            self.ok("&")
        while True:
            self.one_type()
            if K[self.p] in ("|", "&"):
                self.p += 1
                continue
            break
        if K[self.p] == "extends" and not self.N[self.p]:
            self.p += 1
            self.type()
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def one_type(self):
        K, V = self.K, self.V
        while K[self.p] == "i" and V[self.p] in ("keyof", "unique", "readonly", "infer") and K[self.p + 1] in ("i", "[", "{", "(", "typeof", "s"):
            self.p += 1
        t = K[self.p]
        if t == "i":
            if V[self.p] == "abstract" and K[self.p + 1] == "new":
                self.p += 1
                return self.one_type()
            self.dotted()
            if K[self.p] == "<" and not self.N[self.p]:
                self.type_args()
        elif t in ("n", "s", "this", "void"):
            self.p += 1
        elif t == "-" and K[self.p + 1] == "n":
            self.p += 2
        elif t == "typeof":
            self.p += 1
            if self.K[self.p] == "import":
                return self.one_type()
            if not self.ok("this"):
                self.name()
            while self.ok("."):
                self.p += 1
            if K[self.p] == "<" and not self.N[self.p]:
                self.type_args()
        elif t == "import":
            self.p += 1
            self.need("(")
            self.type()
            self.need(")")
            while self.ok("."):
                self.name()
            if K[self.p] == "<":
                self.type_args()
        elif t == "[":
            self.p += 1
            self.listed(self._tuple_item, "]", ",", True)
        elif t == "{":
            self.object_type()
        elif t == "<" or t == "new" or t == "(" and K[self.ends[self.p] + 1] == "=>":
            self.ok("new")
            if K[self.p] == "<":
                self.type_params()
            self.params()
            self.need("=>")
            return self.returned()
        elif t == "(":
            self.p += 1
            self.type()
            self.need(")")
        else:
            raise Bad
        while K[self.p] == "[" and not self.N[self.p]:
            self.p += 1
            if not self.ok("]"):
                self.type()
                self.need("]")

    def _tuple_item(self):
        self.ok("...")
        if self.K[self.p] == "i" and (self.K[self.p + 1] == ":" or self.K[self.p + 1] == "?" and self.K[self.p + 2] == ":"):
            self.p += 1
            self.ok("?")
            self.need(":")
        self.type()
        self.ok("?")

    def index_signature(self):
        self.need("[")
        self.name()
        self.need(":")
        self.type()
        self.need("]")
        self.need(":")
        self.type()

    def object_type(self):
        K, V = self.K, self.V
        self.need("{")
        while not self.ok("}"):
            if self.ok(";") or self.ok(","):
                continue
            while self.ok("+") or self.ok("-"):
                pass
            while K[self.p] == "i" and V[self.p] in ("readonly", "get", "set") and K[self.p + 1] not in _AFTER_NAME:
                self.p += 1
            if K[self.p] == "[" and K[self.p + 1] == "i" and K[self.p + 2] == ":":
                self.index_signature()
            elif K[self.p] == "[" and K[self.p + 1] == "i" and K[self.p + 2] == "in":
                self.p += 3
                self.type()
                if self.word("as"):
                    self.type()
                self.need("]")
                while self.ok("+") or self.ok("-"):
                    pass
                self.ok("?")
                if self.ok(":"):
                    self.type()
            else:
                self.ok("new")
                if K[self.p] not in ("(", "<"):
                    self.key()
                    self.ok("?")
                if K[self.p] in ("(", "<"):
                    if K[self.p] == "<":
                        self.type_params()
                    self.params()
                    if self.ok(":"):
                        self.returned()
                elif self.ok(":"):
                    self.type()
            if K[self.p] not in (";", ",", "}") and not self.N[self.p]:
                raise Bad
