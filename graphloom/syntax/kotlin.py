"""Kotlin. A new line ends a statement unless what stands there can only go on."""

from __future__ import annotations

from graphloom.syntax.base import Bad, Parser

_MODIFIERS = frozenset("public private protected internal open abstract final override sealed data inline suspend const lateinit operator infix companion tailrec external annotation inner vararg noinline crossinline reified expect actual enum value out".split())
_DECLARES = frozenset(["class", "interface", "fun", "val", "var", "object", "typealias"])
#: Operators that may begin a line and still belong to the expression before.
_GO_ON = frozenset([".", "?.", "?:", "&&", "||", "::"])


class Kotlin(Parser):
    LANGUAGE = "kotlin"
    PREFIX = frozenset(["!", "+", "-", "++", "--"])
    BINARY = frozenset(["+", "-", "*", "/", "%", "==", "!=", "===", "!==", "<", ">", "<=", ">=", "&&", "||", "..", "..<", "?:"])
    ASSIGN = frozenset(["=", "+=", "-=", "*=", "/=", "%="])
    ANGLED = frozenset(["i", ",", ".", "?", "(", "->", "*", "in", ":", "&", "@"])
    NO_TARGET = Parser.NO_TARGET | {"this", "super", "}", ")"}
    TERNARY = False

    # ------------------------------------------------------------ types

    def annotations(self):
        K = self.K
        while K[self.p] == "@":
            self.p += 1
            if K[self.p] == "i" and K[self.p + 1] == ":":
                self.p += 2
            if self.ok("["):
                while not self.ok("]"):
                    self._annotation()
            else:
                self._annotation()

    def _annotation(self):
        self.dotted()
        if self.K[self.p] == "<" and self.angle(self.p):
            self.type_args()
        if self.K[self.p] == "(" and not self.N[self.p]:
            self.args()

    def type(self):
        K = self.K
        self.annotations()
        if self.is_word("suspend") and K[self.p + 1] in ("(", "i"):
            self.p += 1
        if K[self.p] == "(":
            end = self.ends[self.p]
            if K[end + 1] == "->" or K[end + 1] == "." and K[end + 2] == "(":
                self.p += 1
                self.listed(self._function_type_param, ")", ",", True)
                if self.ok("."):
                    return self.type()
                self.need("->")
                return self.type()
            self.p += 1
            self.type()
            self.need(")")
        else:
            self.user_type()
        while self.ok("?") or K[self.p] == "!!" and self.ok("!!"):
            pass
        if K[self.p] == "." and K[self.p + 1] == "(":  # a receiver
            self.p += 2
            self.listed(self._function_type_param, ")", ",", True)
            self.need("->")
            return self.type()
        if K[self.p] == "&" and not self.N[self.p]:
            self.p += 1
            self.type()

    def _function_type_param(self):
        if self.K[self.p] == "i" and self.K[self.p + 1] == ":":
            self.p += 2
        self.type()

    def user_type(self):
        K = self.K
        while True:
            self.name()
            if K[self.p] == "<":
                self.type_args()
            if K[self.p] == "." and K[self.p + 1] == "i":
                self.p += 1
            else:
                return

    def type_args(self):
        self.need("<")
        self.listed(self._type_arg, ">", ",", True, False)

    def _type_arg(self):
        if self.ok("*"):
            return
        if not self.ok("in") and self.is_word("out") and self.K[self.p + 1] in ("i", "("):
            self.p += 1
        self.type()

    def type_params(self):
        self.need("<")
        self.listed(self._type_param, ">", ",", True, False)

    def _type_param(self):
        self.annotations()
        if not self.ok("in") and self.K[self.p + 1] == "i":
            self.p += self.V[self.p] in ("out", "reified")
        self.name()
        if self.ok(":"):
            self.type()

    def constraints(self):
        if self.word("where"):
            while True:
                self.annotations()
                self.name()
                self.need(":")
                self.type()
                if not self.ok(","):
                    return

    # ------------------------------------------------------------ expressions

    def expr(self):
        """Without assignments, which are statements."""
        K, V, N, binary = self.K, self.V, self.N, self.BINARY
        form = 0
        while True:
            self.unary()
            while True:
                t = K[self.p]
                if N[self.p] and t not in _GO_ON:
                    return form
                form = max(form, 1) if t in binary or t in ("as", "is", "in") else form
                if t in binary:
                    self.p += 1
                    break
                if t == "as":
                    self.p += 1
                    self.ok("?")
                    self.type()
                    continue
                if t == "is" or t == "!" and K[self.p + 1] == "is":
                    self.p += 1 + (t == "!")
                    self.type()
                    form = 1
                    continue
                if t == "in" and not self.no_in or t == "!" and K[self.p + 1] == "in":
                    self.p += 1 + (t == "!")
                    form = 1
                    break
                if t == "i" and self._operand_ahead() and V[self.p] not in ("where", "get", "set"):  # an infix function
                    self.p += 1
                    form = 1
                    break
                return form

    no_in = False

    def _operand_ahead(self) -> bool:
        t = self.K[self.p + 1]
        return not self.N[self.p + 1] and t in ("i", "n", "s", "(", "this", "super", "-", "!", "{", "if", "when", "object", "fun", "try", "[", "throw", "return", "++", "--", "::", "+")

    def inside(self, f, *args):
        old, self.no_in = self.no_in, False
        f(*args)
        self.no_in = old

    def unary(self):
        K = self.K
        while K[self.p] in self.PREFIX or K[self.p] == "@":
            if K[self.p] == "@":
                self.annotations()
            else:
                self.p += 1
        t = K[self.p]
        if t == "i" and K[self.p + 1] == "@" and K[self.p + 2] in ("{", "for", "while", "do") and not self.N[self.p + 2]:
            self.p += 2
            t = K[self.p]
            if t != "{":
                return self.statement()
        if t in ("i", "n", "s"):
            self.p += 1
        elif t in ("this", "super"):
            self.p += 1
            if t == "super" and K[self.p] == "<":
                self.type_args()
            if K[self.p] == "@" and not self.N[self.p]:
                self.p += 1
                self.name()
        elif t == "(":
            self.p += 1
            self.inside(self.expr)
            self.need(")")
        elif t == "[":
            self.p += 1
            self.inside(self.listed, self.expr, "]", ",", True)
        elif t == "{":
            self.inside(self.lambda_)
        elif t == "if":
            self._if(True)
        elif t == "when":
            self._when()
        elif t == "try":
            self._try()
        elif t == "object":
            self.p += 1
            if self.ok(":"):
                self.supers()
            self.inside(self.class_body)
        elif t == "fun":
            self.p += 1
            if K[self.p] != "(":
                self.type()
                self.ok(".")
            self.params()
            if self.ok(":"):
                self.type()
            if self.ok("="):
                self.expr()
            else:
                self.inside(self.block)
        elif t == "throw":
            self.p += 1
            return self.expr_()
        elif t == "return":
            self.p += 1
            self._at()
            if not self.N[self.p] and K[self.p] not in (";", "}", ")", ",", "]", "else", "", "?:", "->"):
                self.expr_()
            return
        elif t in ("break", "continue"):
            self.p += 1
            self._at()
            return
        elif t == "::":
            self.p += 1
            if not self.ok("class"):
                self.name()
        else:
            raise Bad
        self.postfix()

    def expr_(self):
        self.expr()

    def _at(self):
        if self.K[self.p] == "@" and not self.N[self.p]:
            self.p += 1
            self.name()

    def postfix(self):
        K, N = self.K, self.N
        while True:
            t = K[self.p]
            if t in (".", "?."):
                self.p += 1
                if K[self.p] == "(" :
                    continue
                if not self.ok("class"):
                    self.name()
            elif t == "::":
                if K[self.p - 1] == "n":
                    raise Bad
                self.p += 1
                if not self.ok("class"):
                    self.name()
            elif t == "?" and K[self.p + 1] == "::":
                self.p += 1
            elif N[self.p]:
                return
            elif t == "(":
                if K[self.p - 1] == "n":
                    raise Bad
                self.calls()
                self.args()
            elif t == "[":
                if K[self.p - 1] == "n":
                    raise Bad
                self.p += 1
                self.inside(self.listed, self.expr, "]", ",", True, False)
            elif t in ("++", "--"):
                if K[self.p - 1] in ("n", "s"):
                    raise Bad
                self.p += 1
            elif t == "!!":
                self.p += 1
            elif t == "{" and K[self.p - 1] in ("i", ")", ">", "]", "@") and not self.no_lambda:
                self.inside(self.lambda_)
            elif t == "i" and K[self.p + 1] == "@" and K[self.p + 2] == "{" and not N[self.p + 1] and K[self.p - 1] in ("i", ")"):
                self.p += 2
                self.inside(self.lambda_)
            elif t == "<" and (end := self.angle(self.p)) and (K[end] in ("(", "{", "::") and not N[end] or K[end] == "." and K[self.p - 1] == "i"):
                self.type_args()
            else:
                return

    no_lambda = False

    def args(self):
        self.p += 1
        self.inside(self.listed, self._argument, ")", ",", True)

    def _argument(self):
        self.annotations()
        if self.K[self.p] == "i" and self.K[self.p + 1] == "=":
            self.p += 2
        self.ok("*")
        self.expr()

    def lambda_(self):
        self.need("{")
        at = self.p
        if not self.tries(self._lambda_params):
            self.p = at
        self.statements()

    def _lambda_params(self):
        while self.K[self.p] != "->":
            if self.ok("("):
                self.listed(self._lambda_param, ")", ",", True)
                if self.ok(":"):
                    self.type()
            else:
                self._lambda_param()
            if self.K[self.p] != "->":
                self.need(",")
        self.need("->")

    def _lambda_param(self):
        self.annotations()
        self.name()
        if self.ok(":"):
            self.type()

    def _condition(self):
        self.need("(")
        self.inside(self.expr)
        self.need(")")

    def _branch(self, value: bool):
        if self.K[self.p] == "{":
            self.block()
        elif self.K[self.p] == ";" and not value:
            return
        else:
            self.simple()

    def _if(self, value: bool = False):
        self.need("if")
        self._condition()
        if self.K[self.p] != ";" or self.K[self.p + 1] != "else":
            self._branch(value)
        if self.K[self.p] == ";" and self.K[self.p + 1] == "else":
            self.p += 1
        if self.ok("else"):
            self._branch(value)

    def _when(self):
        K = self.K
        self.need("when")
        subject = self.ok("(")
        if subject:
            self.annotations()
            if self.ok("val"):
                self.name()
                if self.ok(":"):
                    self.type()
                self.need("=")
            self.inside(self.expr)
            self.need(")")
        self.need("{")
        while not self.ok("}"):
            if not self.ok("else"):
                while True:
                    if K[self.p] in ("in", "is") or K[self.p] == "!" and K[self.p + 1] in ("in", "is"):
                        if not subject:
                            raise Bad
                        self.ok("!")
                        if self.ok("is"):
                            self.type()
                        else:
                            self.p += 1
                            self.expr()
                    else:
                        self.inside(self.expr)
                    if not self.ok(","):
                        break
                    if K[self.p] == "->":
                        break
                if self.ok("if"):
                    self.expr()
            elif self.ok("if"):
                self.expr()
            self.need("->")
            self._branch(False)
            if not self.ok(";") and K[self.p] != "}" and not self.N[self.p]:
                raise Bad

    def _try(self):
        self.need("try")
        self.block()
        done = False
        while self.word("catch"):
            done = True
            self.need("(")
            self.annotations()
            self.name()
            self.need(":")
            self.type()
            self.ok(",")
            self.need(")")
            self.block()
        if self.word("finally"):
            done = True
            self.block()
        if not done:
            raise Bad

    # ------------------------------------------------------------ statements

    def block(self):
        old, self.no_in = self.no_in, False
        self.need("{")
        self.statements()
        self.no_in = old

    def statements(self):
        K = self.K
        while True:
            while self.ok(";"):
                pass
            if self.ok("}"):
                return
            self.statement()
            if K[self.p] not in (";", "}") and not self.N[self.p]:
                raise Bad

    def simple(self):
        """An expression or an assignment."""
        K = self.K
        if K[self.p] in ("for", "while", "do"):
            return self.statement()
        form = self.expr()
        if K[self.p] in self.ASSIGN and not self.N[self.p]:
            if form or not self.assignable():
                raise Bad
            self.p += 1
            self.expr()

    def statement(self):
        K = self.K
        t = K[self.p]
        if t == "i" and K[self.p + 1] == "@" and K[self.p + 2] in ("for", "while", "do"):
            self.p += 2
            t = K[self.p]
        if t == "for":
            self.p += 1
            self.need("(")
            self.annotations()
            if self.ok("("):
                self.listed(self._lambda_param, ")", ",", True)
            else:
                self._lambda_param()
            self.need("in")
            self.inside(self.expr)
            self.need(")")
            self._branch(False)
        elif t == "while":
            self.p += 1
            self._condition()
            self._branch(False)
        elif t == "do":
            self.p += 1
            if K[self.p] == "{":
                self.block()
            else:
                self.simple()
            self.need("while")
            self._condition()
        elif self.declares():
            self.declaration()
        else:
            self.simple()

    def declares(self) -> bool:
        """Whether a declaration begins here, maybe after modifiers and annotations."""
        K, k = self.K, self.p
        while True:
            t = K[k]
            if t == "@":
                k += 1
                if K[k] == "i" and K[k + 1] == ":":
                    k += 2
                if K[k] == "[":
                    k = self.ends[k] + 1
                    continue
                if K[k] != "i":
                    return False
                k += 1
                while K[k] == "." and K[k + 1] == "i":
                    k += 2
                if K[k] == "<":
                    k = self.angle(k) or k
                if K[k] == "(" and not self.N[k]:
                    k = self.ends[k] + 1
            elif t in _DECLARES:
                if t == "object":
                    return K[k + 1] == "i" or k > self.p and self.V[k - 1] == "companion"
                if t == "fun":
                    return K[k + 1] in ("i", "<", "(", "interface") and not self._anonymous(k + 1)
                return True
            elif t == "i" and self.V[k] in _MODIFIERS and K[k + 1] in ("i", "@", *_DECLARES):
                k += 1
            else:
                return False

    def _anonymous(self, k: int) -> bool:
        return self.K[k] == "(" and self.K[self.ends[k] + 1] != "."

    def modifiers(self):
        K = self.K
        while True:
            if K[self.p] == "@":
                self.annotations()
            elif K[self.p] == "i" and self.V[self.p] in _MODIFIERS and K[self.p + 1] in ("i", "@", *_DECLARES):
                self.p += 1
            else:
                return

    def declaration(self):
        K = self.K
        self.modifiers()
        t = K[self.p]
        if t == "fun" and K[self.p + 1] == "interface":
            self.p += 1
            t = "interface"
        if t not in _DECLARES:
            raise Bad
        enum = K[self.p - 1] == "i" and self.V[self.p - 1] == "enum"
        first = self.p
        self.p += 1
        named = first + 1 if t in ("class", "interface", "object") and K[first + 1] == "i" else 0
        if named:
            self.opens(self.V[named])
            self._declare(t, enum)
            return self.closes("type", named, first)
        self._declare(t, enum)

    def _declare(self, t: str, enum: bool):
        K = self.K
        if t in ("class", "interface"):
            self.name()
            if K[self.p] == "<":
                self.type_params()
            self.constructor()
            if self.ok(":"):
                self.supers()
            self.constraints()
            if K[self.p] == "{":
                self.class_body(enum)
        elif t == "object":
            self.ok("i")
            if self.ok(":"):
                self.supers()
            if K[self.p] == "{":
                self.class_body()
        elif t == "typealias":
            self.name()
            if K[self.p] == "<":
                self.type_params()
            self.need("=")
            self.type()
        elif t == "fun":
            if K[self.p] == "<":
                self.type_params()
            first = self.p - 1
            self.receiver()
            name = self.p - 1
            self.opens(self.V[name])
            self.params()
            if self.ok(":"):
                self.type()
            self.constraints()
            if self.ok("="):
                self.expr()
            elif K[self.p] == "{":
                self.block()
            self.closes("callable", name, first)
        else:
            self._property()

    def receiver(self):
        """A name, after a receiver's type or not."""
        K = self.K
        self.annotations()
        if K[self.p] == "(":
            self.p += 1
            self.type()
            self.need(")")
            self.ok("?")
            self.need(".")
            return self.name()
        while True:
            self.name()
            if K[self.p] == "<":
                self.type_args()
            if self.ok("?.") or self.ok("."):
                continue
            if self.ok("?"):
                self.need(".")
                continue
            return

    def _property(self):
        K = self.K
        if K[self.p] == "<":
            self.type_params()
        if K[self.p] == "(" and K[self.ends[self.p] + 1] in ("=", "by"):
            self.p += 1
            self.listed(self._lambda_param, ")", ",", True)
        else:
            self.receiver()
        if self.ok(":"):
            self.type()
        self.constraints()
        if self.ok("=") or self.word("by"):
            self.expr()
        while True:
            at = self.p
            self.ok(";")
            self.modifiers()
            if (self.is_word("get") or self.is_word("set")) and K[self.p + 1] in ("(", ";", "}", "") or (self.is_word("set") or self.is_word("get")) and self.N[self.p + 1] and self.p > at and self.V[self.p - 1] in _MODIFIERS:
                self.p += 1
                if self.ok("("):
                    self.listed(self._setter_param, ")", ",", True)
                    if self.ok(":"):
                        self.type()
                    if self.ok("="):
                        self.expr()
                    else:
                        self.block()
            else:
                self.p = at
                return

    def _setter_param(self):
        self._lambda_param()

    def params(self):
        self.need("(")
        self.listed(self._param, ")", ",", True)

    def _param(self):
        self.modifiers()
        self.name()
        self.need(":")
        self.type()
        if self.ok("="):
            self.expr()

    def constructor(self):
        K = self.K
        at = self.p
        self.modifiers()
        if not self.word("constructor"):
            self.p = at
        if K[self.p] == "(":
            self.p += 1
            self.listed(self._class_param, ")", ",", True)

    def _class_param(self):
        self.modifiers()
        if not self.ok("val"):
            self.ok("var")
        self.name()
        self.need(":")
        self.type()
        if self.ok("="):
            self.expr()

    def supers(self):
        K = self.K
        while True:
            self.annotations()
            base = last = self.p
            while K[last + 1] == "." and K[last + 2] == "i":
                last += 2
            self.type()
            self.found.append(("inherits", last, base, last, ".".join(self.inside_of)))
            if K[self.p] == "(" and not self.N[self.p]:
                self.args()
            elif self.word("by"):
                old, self.no_lambda = self.no_lambda, True
                self.expr()
                self.no_lambda = old
            if not self.ok(","):
                return

    def class_body(self, enum: bool = False):
        K = self.K
        old, self.no_lambda = (self.no_lambda, self.no_in), False
        no_in, self.no_in = self.no_in, False
        self.need("{")
        if enum:
            while K[self.p] in ("i", "@") and not self._member_ahead():
                self.annotations()
                self.name()
                if K[self.p] == "(":
                    self.args()
                if K[self.p] == "{":
                    self.class_body()
                if not self.ok(","):
                    break
            if K[self.p] != "}":
                self.need(";")
        while True:
            while self.ok(";"):
                pass
            if self.ok("}"):
                break
            self.member()
            if K[self.p] not in (";", "}") and not self.N[self.p]:
                raise Bad
        self.no_lambda, self.no_in = old[0], no_in

    def _member_ahead(self) -> bool:
        return self.declares()

    def member(self):
        K = self.K
        if self.is_word("init") and K[self.p + 1] == "{":
            self.p += 1
            return self.block()
        at = self.p
        self.modifiers()
        if self.is_word("constructor") and K[self.p + 1] == "(":
            self.p += 1
            self.params()
            if self.ok(":"):
                if not self.ok("this"):
                    self.need("super")
                self.args()
            if K[self.p] == "{":
                self.block()
            return
        self.p = at
        if not self.declares():
            raise Bad
        self.declaration()

    @staticmethod
    def begins(kinds, words, fresh):
        t = kinds[0]
        return t in ("package", "@", ";") or t in _DECLARES or t == "i" and (words[0] in _MODIFIERS or words[0] == "import")

    def top(self):
        K = self.K
        while K[self.p] == "@" and self.is_word("file", 1):
            self.annotations()
        if self.ok("package"):
            self._path()
        while K[self.p] == ";" or self.is_word("import") and K[self.p + 1] != "=":
            if self.ok(";"):
                continue
            first = self.p + 1
            self.p += 1
            self._path()
            self.found.append(("import", self.p - 1, first, self.p - 1, "*" if K[self.p] == "." else self.V[self.p + 1] if K[self.p] == "as" else ""))
            if K[self.p] == "." and K[self.p + 1] == "*":
                self.p += 2
            if self.ok("as"):
                self.name()
            self._line()
        while K[self.p]:
            if self.ok(";"):
                continue
            if not self.declares():
                raise Bad
            self.declaration()
            self._line()

    def _path(self):
        """Words of any kind between dots."""
        self.p += 1
        if not self.K[self.p - 1].isalpha():
            raise Bad
        while self.K[self.p] == "." and self.K[self.p + 1].isalpha():
            self.p += 2
        if self.K[self.p - 1] in ("n", "s"):
            raise Bad

    def _line(self):
        if self.K[self.p] not in (";", "") and not self.N[self.p]:
            raise Bad
