"""Java."""

from __future__ import annotations

from graphloom.syntax.base import Bad, Parser

_MODIFIERS = frozenset("public private protected static final abstract synchronized native strictfp transient volatile default".split())
_TYPES = frozenset(["class", "interface", "enum"])
#: What may follow a cast to a class or interface.
_CAST = frozenset(["i", "n", "s", "(", "!", "~", "this", "super", "new", "switch", "prim", "void"])


class Java(Parser):
    LANGUAGE = "java"
    SHIFT = 3
    BINARY = Parser.BINARY
    ANGLED = frozenset(["i", "prim", ",", ".", "?", "&", "[", "extends", "super", "@", "("])
    NO_TARGET = Parser.NO_TARGET | {")", "this", "super", "}"}

    def __init__(self, tokens):
        super().__init__(tokens)
        self.in_label = False

    # ------------------------------------------------------------ types

    def annotations(self):
        while self.K[self.p] == "@" and self.K[self.p + 1] != "interface":
            self.p += 1
            self.dotted()
            if self.K[self.p] == "(":
                self.p += 1
                self.listed(self._element, ")")

    def _element(self):
        if self.K[self.p] == "i" and self.K[self.p + 1] == "=":
            self.p += 2
        self._element_value()

    def _element_value(self):
        if self.K[self.p] == "@":
            self.annotations()
        elif self.ok("{"):
            self.listed(self._element_value, "}", ",", True)
        else:
            self.expr()

    def type(self):
        self.annotations()
        if not self.ok("prim"):
            self.class_type()
        self.dims()

    def class_type(self):
        while True:
            self.annotations()
            self.name()
            if self.K[self.p] == "<":
                self.type_args()
            if self.K[self.p] == "." and self.K[self.p + 1] in ("i", "@"):
                self.p += 1
            else:
                return

    def dims(self):
        while self.K[self.p] == "[" and self.K[self.p + 1] == "]":
            self.p += 2

    def type_args(self):
        self.need("<")
        self.listed(self._type_arg, ">")

    def _type_arg(self):
        self.annotations()
        if self.ok("?"):
            if self.ok("extends") or self.ok("super"):
                self.type()
        else:
            self.type()

    def type_params(self):
        self.need("<")
        self.listed(self._type_param, ">", empty=False)

    def _type_param(self):
        self.annotations()
        self.name()
        if self.ok("extends"):
            self.types("&")

    def bases(self, relation: str, several: bool):
        while True:
            first = self.p
            while self.K[first] == "@":
                first += 2
            last = first
            while self.K[last + 1] == "." and self.K[last + 2] == "i":
                last += 2
            self.type()
            self.found.append((relation, last, first, last, ".".join(self.inside_of)))
            if not several or not self.ok(","):
                return

    def types(self, sep=","):
        self.type()
        while self.ok(sep):
            self.type()

    # ------------------------------------------------------------ expressions

    def joint(self, kind):
        if kind == "instanceof":
            self.p += 1
            self.ok("final")
            self.pattern()
            return 2
        return 0

    def pattern(self):
        """A type, or a type with a name or with patterns of its components."""
        self.modifiers()
        self.type()
        if self.ok("("):
            self.listed(self.pattern, ")")
        if self.K[self.p] == "i" and not (self.V[self.p] == "when" and self.K[self.p + 1] not in ("->", ":", ",", ")", "&&", "||", "?", ";")):
            self.p += 1

    def unary(self):
        K = self.K
        while K[self.p] in self.PREFIX:
            self.p += 1
        p = self.p
        t = K[p]
        if t == "i":
            if K[p + 1] == "->" and not self.in_label:
                self.p += 2
                return self.lambda_body()
            self.p += 1
            if K[self.p] == "<" and (end := self.angle(self.p)) and K[end] in ("::", "[", "."):
                self.class_type_rest()
        elif t in ("n", "s", "this", "super"):
            self.p += 1
        elif t == "(":
            end = self.ends[p]
            if K[end + 1] == "->" and not self.in_label or K[end + 1] == "->" and K[end + 2] == "{" and K[p + 1] in (")", "i") and not self.in_label:
                self.p += 1
                self.listed(self.lambda_param, ")")
                self.need("->")
                return self.lambda_body()
            if self.tries(self.cast):
                return self.unary()
            self.p += 1
            self.inside(self.expr)
            self.need(")")
        elif t == "new":
            self.creator()
        elif t == "switch":
            self.switch()
        elif t in ("prim", "void"):
            self.p += 1
            self.dims()
            if K[self.p] == ".":
                self.p += 1
                self.need("class")
            elif K[self.p] != "::":
                raise Bad
        else:
            raise Bad
        self.postfix()

    def class_type_rest(self):
        self.type_args()
        while self.K[self.p] == "." and self.K[self.p + 1] == "i":
            self.p += 2
            if self.K[self.p] == "<":
                self.type_args()

    def inside(self, f, *args):
        old, self.in_label = self.in_label, False
        f(*args)
        self.in_label = old

    def cast(self):
        """Only a cast whose operand follows."""
        self.need("(")
        prim = self.K[self.p] == "prim"
        self.types("&")
        self.need(")")
        if not (self.K[self.p] in _CAST or prim and self.K[self.p - 2] == "prim" and self.K[self.p] in ("+", "-", "++", "--")):
            raise Bad

    def lambda_param(self):
        if self.K[self.p] == "i" and self.K[self.p + 1] in (",", ")"):
            self.p += 1
        else:
            self.param()

    def lambda_body(self):
        if self.K[self.p] == "{":
            self.inside(self.block)
        else:
            self.expr()

    def postfix(self):
        K = self.K
        while True:
            t = K[self.p]
            if t == ".":
                self.p += 1
                n = K[self.p]
                if n == "new":
                    self.creator()
                elif n in ("i", "this", "super", "class"):
                    self.p += 1
                    if K[self.p] == "<" and (end := self.angle(self.p)) and K[end] in ("::", "["):
                        self.class_type_rest()
                elif n == "<":
                    self.type_args()
                    if not self.ok("super"):
                        self.name()
                else:
                    raise Bad
            elif t == "(":
                if K[self.p - 1] not in ("i", "this", "super"):
                    raise Bad
                self.calls()
                self.args()
            elif t == "[":
                if K[self.p + 1] == "]":
                    self.dims()
                    if K[self.p] == ".":
                        self.p += 1
                        self.need("class")
                    elif K[self.p] != "::":
                        raise Bad
                else:
                    self.p += 1
                    self.inside(self.expr)
                    self.need("]")
            elif t == "++" or t == "--":
                if K[self.p - 1] in ("n", "s"):
                    raise Bad
                self.p += 1
            elif t == "::":
                self.p += 1
                if K[self.p] == "<":
                    self.type_args()
                if not self.ok("new"):
                    self.name()
            else:
                return

    def args(self):
        self.p += 1
        self.inside(self.listed, self.expr, ")")

    def creator(self):
        self.need("new")
        K = self.K
        self.annotations()
        if not self.ok("prim"):
            self.class_type()
        if K[self.p] == "[":
            sized = False
            while K[self.p] == "[":
                self.p += 1
                if not self.ok("]"):
                    sized = True
                    self.inside(self.expr)
                    self.need("]")
            if not sized:
                self.array()
        else:
            if K[self.p] != "(":
                raise Bad
            self.args()
            if K[self.p] == "{":
                self.inside(self.class_body)

    def array(self):
        self.need("{")
        if self.ok(","):
            return self.need("}")
        self.inside(self.listed, self.initializer, "}", ",", True)

    def initializer(self):
        if self.K[self.p] == "{":
            self.array()
        else:
            self.expr()

    # ------------------------------------------------------------ statements

    def block(self):
        self.need("{")
        while not self.ok("}"):
            self.statement()

    def condition(self):
        self.need("(")
        self.inside(self.expr)
        self.need(")")

    def statement(self):
        """A statement or a local declaration."""
        K = self.K
        t = K[self.p]
        handler = self.STATEMENTS.get(t)
        if handler:
            return handler(self)
        if t == "i":
            w = self.V[self.p]
            if K[self.p + 1] == ":":
                self.p += 2
                return self.statement()
            if w == "yield" and K[self.p + 1] not in ("=", ".", "[", "++", "--", "("):
                self.p += 1
                self.expr()
                return self.need(";")
            if w in ("record", "sealed") and K[self.p + 1] in ("i", "interface", "class") and K[self.p + 2] in ("(", "<", "class", "i"):
                return self.type_decl()
        if self.tries(self.declared):
            return self.declarators()
        start = self.p
        if not self.counts(self.expr(), start):
            raise Bad
        self.need(";")

    def declared(self):
        """The head of a local variable's declaration: its type, before a name."""
        self.type()
        if self.K[self.p] != "i" or self.K[self.p + 1] not in ("=", ";", ",", "[", ":"):
            raise Bad

    def declarators(self, end: str = ";"):
        while True:
            self.name()
            self.dims()
            if self.ok("="):
                self.initializer()
            if not self.ok(","):
                break
        self.need(end)

    def modifiers(self):
        while True:
            if self.K[self.p] == "@" and self.K[self.p + 1] != "interface":
                self.annotations()
            elif self.K[self.p] in _MODIFIERS:
                self.p += 1
            elif self.is_word("sealed") and self.K[self.p + 1] in ("class", "interface", "abstract", "public", "static"):
                self.p += 1
            elif self.is_word("non") and self.K[self.p + 1] == "-" and self.is_word("sealed", 2):
                self.p += 3
            else:
                return

    def _block(self):
        self.block()

    def _empty(self):
        self.p += 1

    def _if(self):
        self.p += 1
        self.condition()
        self.statement()
        if self.ok("else"):
            self.statement()

    def _while(self):
        self.p += 1
        self.condition()
        self.statement()

    def _do(self):
        self.p += 1
        self.statement()
        self.need("while")
        self.condition()
        self.need(";")

    def _for(self):
        self.p += 1
        self.need("(")
        if self.K[self.p] != ";":
            self.modifiers()
            if self.tries(self.declared):
                if self.K[self.p + 1] == ":":
                    self.p += 2
                    self.inside(self.expr)
                    self.need(")")
                    return self.statement()
                self.declarators()
            else:
                self.exprs()
                self.need(";")
        else:
            self.p += 1
        if self.K[self.p] != ";":
            self.inside(self.expr)
        self.need(";")
        if self.K[self.p] != ")":
            self.exprs()
        self.need(")")
        self.statement()

    def exprs(self):
        while True:
            start = self.p
            if not self.counts(self.expr(), start):
                raise Bad
            if not self.ok(","):
                return

    def _switch(self):
        self.switch()
        if self.K[self.p] in (".",):
            self.postfix()
            self.need(";")

    def switch(self):
        self.need("switch")
        self.condition()
        self.need("{")
        while not self.ok("}"):
            if self.ok("case"):
                self.in_label = True
                while True:
                    if not self.ok("default") and not self.tries(self._case_pattern):
                        self.expr()
                    if not self.ok(","):
                        break
                if self.word("when"):
                    self.expr()
                self.in_label = False
            else:
                self.need("default")
            if self.ok("->"):
                if self.K[self.p] == "{":
                    self.block()
                elif self.K[self.p] == "throw":
                    self.statement()
                else:
                    self.inside(self.expr)
                    self.need(";")
            else:
                self.need(":")
                while self.K[self.p] not in ("case", "default", "}"):
                    self.statement()

    def _case_pattern(self):
        start = self.p
        self.pattern()
        if self.K[self.p] not in ("->", ":", ",") and not self.is_word("when") or self.p == start + 1:
            raise Bad

    def _try(self):
        self.p += 1
        done = False
        if self.ok("("):
            done = True
            while True:
                self.modifiers()
                if self.tries(self.declared):
                    self.name()
                    self.need("=")
                self.inside(self.expr)
                if self.ok(")"):
                    break
                self.need(";")
                if self.ok(")"):
                    break
        self.block()
        while self.ok("catch"):
            done = True
            self.need("(")
            self.modifiers()
            self.types("|")
            self.name()
            self.need(")")
            self.block()
        if self.ok("finally"):
            done = True
            self.block()
        if not done:
            raise Bad

    def _return(self):
        self.p += 1
        if self.K[self.p] != ";":
            self.expr()
        self.need(";")

    def _throw(self):
        self.p += 1
        self.expr()
        self.need(";")

    def _jump(self):
        self.p += 1
        self.ok("i")
        self.need(";")

    def _synchronized(self):
        if self.K[self.p + 1] != "(":
            return self._local()
        self.p += 1
        self.condition()
        self.block()

    def _assert(self):
        self.p += 1
        self.expr()
        if self.ok(":"):
            self.expr()
        self.need(";")

    def _local(self):
        """Modifiers, then a local class or variable."""
        self.modifiers()
        if self.K[self.p] in _TYPES or self.is_word("record") and self.K[self.p + 1] == "i":
            return self.type_decl()
        if not self.tries(self.declared):
            raise Bad
        self.declarators()

    def _bad(self):
        raise Bad

    STATEMENTS = {
        "{": _block, ";": _empty, "if": _if, "while": _while, "do": _do, "for": _for, "switch": _switch, "try": _try, "return": _return, "throw": _throw, "break": _jump, "continue": _jump, "synchronized": _synchronized, "assert": _assert,
        "final": _local, "abstract": _local, "static": _local, "@": _local, "class": _local, "interface": _local, "enum": _local, "else": _bad, "case": _bad, "default": _bad, "catch": _bad, "finally": _bad, "import": _bad, "package": _bad,
    }

    # ------------------------------------------------------------ declarations

    def params(self):
        self.need("(")
        self.listed(self.param, ")")

    def param(self):
        self.modifiers()
        self.type()
        self.annotations()
        self.ok("...")
        if self.ok("this"):
            return
        self.name()
        if self.K[self.p] == "." and self.K[self.p + 1] == "this":
            self.p += 2
        self.dims()

    def type_decl(self):
        """After the modifiers."""
        first = self.p
        name = first + 1 + (self.K[first] == "@")
        self.opens(self.V[name])
        self._type_decl()
        self.closes("type", name, first)

    def _type_decl(self):
        K = self.K
        t = K[self.p]
        if t == "@":
            self.p += 1
            self.need("interface")
            self.name()
            return self.class_body()
        self.p += 1
        self.name()
        if K[self.p] == "<":
            self.type_params()
        if t == "i":
            self.params()
        if t != "enum" and self.ok("extends"):
            self.bases("inherits", t == "interface")
        if t != "interface" and self.ok("implements"):
            self.bases("implements", True)
        if self.word("permits"):
            self.types()
        if t == "enum":
            self.need("{")
            while self.K[self.p] in ("i", "@"):
                self.annotations()
                self.name()
                if K[self.p] == "(":
                    self.args()
                if K[self.p] == "{":
                    self.class_body()
                if not self.ok(","):
                    break
            if self.ok(";"):
                return self.members()
            return self.need("}")
        self.class_body()

    def class_body(self):
        self.need("{")
        self.members()

    def members(self):
        while not self.ok("}"):
            self.member()

    def member(self):
        K = self.K
        start = self.p
        if self.ok(";"):
            return
        if K[self.p] == "{" or K[self.p] == "static" and K[self.p + 1] == "{":
            self.ok("static")
            return self.block()
        self.modifiers()
        t = K[self.p]
        if t in _TYPES or t == "@" or t == "i" and self.V[self.p] == "record" and K[self.p + 1] == "i" and K[self.p + 2] in ("(", "<"):
            return self.type_decl()
        if t == "<":
            self.type_params()
            self.annotations()
        if K[self.p] == "i" and K[self.p + 1] == "(":
            name = self.p
            self.opens(self.V[name])
            self.p += 1
            self.params()
            self.throws_and_body(True)
            return self.closes("callable", name, start)
        if K[self.p] == "i" and K[self.p + 1] == "{":  # a record's compact constructor
            self.p += 1
            return self.block()
        if not self.ok("void"):
            self.type()
        elif K[self.p + 1] != "(":
            raise Bad
        if K[self.p + 1] == "(":
            name = self.p
            self.opens(self.V[name])
            self.name()
            self.params()
            self.dims()
            self.throws_and_body(False)
            return self.closes("callable", name, start)
        self.declarators()

    def throws_and_body(self, bodied: bool):
        if self.ok("throws"):
            self.types()
        if self.ok("default"):
            self._element_value()
        if self.K[self.p] == "{":
            self.block()
        elif bodied:
            raise Bad
        else:
            self.need(";")

    @staticmethod
    def begins(kinds, words, fresh):
        t = kinds[0]
        return t in ("package", "import", "@", ";", "class", "interface", "enum") or t in _MODIFIERS or t == "i" and words[0] in ("record", "sealed", "non", "module", "open")

    def top(self):
        K = self.K
        start = self.p
        self.annotations()
        if self.ok("package"):
            self.dotted()
            self.need(";")
        else:
            self.p = start
        while K[self.p] in ("import", ";"):
            if self.ok(";"):
                continue
            first = self.p
            self.p += 1
            self.ok("static")
            self.dotted()
            self.found.append(("import", self.p - 1, first + 1 + (K[first + 1] == "static"), self.p - 1, "*" if K[self.p] == "." else ""))
            if K[self.p] == ".":
                self.p += 1
                self.need("*")
            self.need(";")
        while K[self.p]:
            if self.ok(";"):
                continue
            self.modifiers()
            if K[self.p] in _TYPES or K[self.p] == "@" or self.is_word("record"):
                self.type_decl()
            elif self.is_word("module") or self.is_word("open") and self.is_word("module", 1):
                self.module()
            else:
                raise Bad

    def module(self):
        self.word("open")
        self.p += 1
        self.dotted()
        self.need("{")
        while not self.ok("}"):
            if not self.is_word("requires") and not self.is_word("exports") and not self.is_word("opens") and not self.is_word("uses") and not self.is_word("provides"):
                raise Bad
            self.p += 1
            self.ok("static")
            if self.is_word("transitive") and self.K[self.p + 1] == "i":
                self.p += 1
            self.dotted()
            if self.word("to") or self.word("with"):
                self.dotted()
                while self.ok(","):
                    self.dotted()
            self.need(";")
